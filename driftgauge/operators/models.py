"""Heads over feature tables: fitted with Spark ML, or many small fits in one grouped job.

Feature tables have ``features`` (array<double>) and ``y``. A scored table has ``score``,
the probability of class 1, or a value that rises with it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import heads as H
from . import metrics as M
from . import solvers as S
from .common import hash_order, join_on, stored
from .features import tfidf
from .forests import forest_scores
from .prefix import hash_rank
from .splits import stratified_kfold
from .text_heads import fit_text_folds, text_cv, text_folds  # noqa: F401


def _vectors(df: DataFrame) -> DataFrame:
    """``_v`` and ``label``; features that are vectors, as those of texts, stay as they are."""
    if isinstance(df.schema["features"].dataType, VectorUDT):
        return df.withColumns({"_v": F.col("features"), "label": F.col("y").cast("double")})
    return df.withColumns({"_v": array_to_vector(F.col("features").cast("array<double>")), "label": F.col("y").cast("double")})


def balanced_weights(df: DataFrame) -> tuple[DataFrame, int]:
    """``w`` = n / (2 n_c) for each class, and n; two class counts are all that reaches the driver."""
    counts = {r.y: r.n for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    w = F.lit(1.0)
    for y, c in counts.items():
        w = F.when(F.col("y") == y, n / (2.0 * c)).otherwise(w)
    return df.withColumn("w", w), n


class Head:
    """A fitted pipeline that scores tables."""

    def __init__(self, model, raw: bool = False):
        self.model, self.raw = model, raw

    def score(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(_vectors(df))
        if "probability" in out.columns:
            score = vector_to_array("probability")[1]
        else:
            score = vector_to_array("rawPrediction")[1] if "rawPrediction" in out.columns else F.col("prediction")
        return out.withColumn("_score", score).select(*[c for c in df.columns if c != "score"], F.col("_score").alias("score"))


def fit_logreg(train: DataFrame, c: float = 1.0, balanced: bool = True) -> Head:
    """Standardised logistic regression with L2 strength 1 / C, as a mean loss: regParam = 1 / (C n).

    Sparse vectors are not standardised, which would fill them.
    """
    sparse = isinstance(train.schema["features"].dataType, VectorUDT)
    rows, n = balanced_weights(train) if balanced else (train.withColumn("w", F.lit(1.0)), train.count())
    scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True)
    lr = LogisticRegression(featuresCol="_v" if sparse else "_s", labelCol="label", weightCol="w", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=200, tol=1e-8)
    return Head(Pipeline(stages=[lr] if sparse else [scaler, lr]).fit(_vectors(rows)))


class LinearHead:
    """One row of weights and intercept."""

    def __init__(self, head: DataFrame):
        self.head = head

    def score(self, df: DataFrame) -> DataFrame:
        both = df.drop("score").crossJoin(F.broadcast(self.head.select(F.col("weights").alias("_w"), F.col("intercept").alias("_b"))))  # one row
        return both.withColumn("score", H.linear_score("features", "_w", "_b")).drop("_w", "_b")


def fit_ridge(train: DataFrame, alpha: float = 1.0, scaled: bool = True) -> LinearHead:
    """Ridge on +-1 targets, balanced, over standardised columns; score tables are min-max normalised by ``normalize_scores``.

    Solved from sums over the rows, in one pass after their mean.
    """
    member = F.array(F.struct(F.lit(0).alias("k"), F.lit("train").alias("split")))
    return LinearHead(stored(H.ridge_heads(train.select("y", "features", member.alias("m"), F.lit(0).alias(H.ALL)), [H.ALL], alpha, scaled=scaled)))


def cv_ridge(df: DataFrame, keys: list[str], k: int = 5, alpha: float = 1.0, seed: int = 42, scaled: bool = True) -> DataFrame:
    """Out-of-fold ridge scores; a fold's training sums are those of all other folds."""
    own = keys or [H.ALL]
    rows = _folded(df if keys else df.withColumn(H.ALL, F.lit(0)), k, seed)
    heads = H.ridge_heads(rows, own, alpha, scaled=scaled).withColumnRenamed("k", "fold")
    out = join_on(rows, heads, [*own, "fold"])
    return out.select(*keys, F.col("fold").alias("held"), "sample_id", "y", H.linear_score("features", "weights", "intercept").alias("score"))


def platt(margins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): probabilities 1 / (1 + exp(-(a score + b))) fitted to y of each group, its targets drawn in from 0 and 1.

    Every Newton step of all groups is one aggregate; groups are few, as folds are.
    """
    sizes = [(tuple(r[k] for k in keys), r.n0, r.n1) for r in margins.groupBy(*keys).agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).collect()]
    spark, fields = margins.sparkSession, ", ".join(f"`{k}` {margins.schema[k].dataType.simpleString()}" for k in keys)
    rows = stored(margins.select(*keys, "y", F.col("score").alias("s")))

    def evaluate(asked: dict) -> dict:
        at = spark.createDataFrame([(*sizes[g][0], g, float(w[0]), float(w[1]), 1.0 / (sizes[g][1] + 2), (sizes[g][2] + 1.0) / (sizes[g][2] + 2)) for g, w in asked.items()], f"{fields}, _g int, _a double, _b double, _t0 double, _t1 double")
        x = join_on(rows, F.broadcast(at), keys).withColumns({"_z": F.col("_a") * F.col("s") + F.col("_b"), "_t": F.when(F.col("y") == 1, F.col("_t1")).otherwise(F.col("_t0"))})
        x = x.withColumn("_p", 1 / (1 + F.exp(-F.col("_z"))))
        d, h = F.col("_p") - F.col("_t"), F.col("_p") * (1 - F.col("_p"))
        loss = F.greatest("_z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("_z"))) - F.col("_t") * F.col("_z")
        sums = x.groupBy("_g").agg(F.sum(loss).alias("f"), F.sum(d * F.col("s")).alias("g0"), F.sum(d).alias("g1"), F.sum(h * F.col("s") ** 2).alias("h00"), F.sum(h * F.col("s")).alias("h01"), F.sum(h).alias("h11"))
        return {r._g: (r.f, -np.linalg.solve(np.array([[r.h00, r.h01], [r.h01, r.h11]]) + 1e-12 * np.eye(2), np.array([r.g0, r.g1]))) for r in sums.collect()}

    found = S.run_together({g: S.newton(1, tol=1e-9) for g in range(len(sizes))}, evaluate)
    return spark.createDataFrame([(*sizes[g][0], float(w[0]), float(w[1])) for g, w in found.items()], f"{fields}, a double, b double")


def calibrated_svm(train: DataFrame, test: DataFrame, k: int = 3, c: float = 1.0, seed: int = 42) -> DataFrame:
    """(y, score) of ``test``: the mean of k linear SVMs' probabilities, each calibrated on the fold that it wasn't trained on."""
    folded = stored(stratified_kfold(train, k, "y", "sample_id", seed))
    held, told = [], []
    for f in range((folded.agg(F.max("fold")).first()[0] or 0) + 1):  # k fits
        own = _vectors(folded.where(F.col("fold") != f))
        scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True)
        head = Head(Pipeline(stages=[scaler, LinearSVC(featuresCol="_s", labelCol="label", regParam=1.0 / (c * max(own.count(), 1)), standardization=False, maxIter=200)]).fit(own))
        held.append(head.score(folded.where(F.col("fold") == f)).select("fold", "y", "score"))
        told.append(head.score(test).select("sample_id", "y", F.lit(f).alias("fold"), "score"))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    at = F.broadcast(platt(union(held), ["fold"]))  # one row for each fold
    each = union(told).join(at, "fold").select("sample_id", "y", (1 / (1 + F.exp(-(F.col("a") * F.col("score") + F.col("b"))))).alias("score"))
    return each.groupBy("sample_id", "y").agg(F.avg("score").alias("score")).select("y", "score")


def _dealt(kept: DataFrame, rows: int = 5_000) -> DataFrame:
    """``kept`` in tasks of about ``rows`` rows, in a fixed order: trees are grown in very many short jobs, with no more tasks than the rows ask for.

    There are no more tasks than cores, until a task has forty times as many rows."""
    n, cores = kept.count(), kept.sparkSession.sparkContext.defaultParallelism
    return kept.repartition(max(1, min(n // rows, max(cores, n // (40 * rows)))), "sample_id").sortWithinPartitions("sample_id")


def compare_classifiers(train: DataFrame, test: DataFrame, trees: int = 200, target_fpr: float = 0.01) -> DataFrame:
    """One row per classifier (lr, rf, gbdt, svm) with auroc, macro_f1 and tpr at the target on ``test``.

    Needs sample_id, y, features. Classes are not weighted, the forest is as deep as Spark allows and its trees never reach the driver, the SVM is calibrated out of fold.
    """
    common = {"featuresCol": "_v", "labelCol": "label", "seed": 42}
    rows = _vectors(_dealt(stored(train.select("sample_id", "y", "features"))))
    made = {
        "lr": fit_logreg(rows, balanced=False),
        "gbdt": Head(GBTClassifier(maxIter=trees, maxDepth=5, stepSize=0.1, **common).fit(rows)),
    }
    scored = [h.score(test).select("y", "score").withColumn("classifier", F.lit(n)) for n, h in made.items()]
    scored.append(forest_scores(train, test, trees).withColumn("classifier", F.lit("rf")))
    scored.append(calibrated_svm(train, test).withColumn("classifier", F.lit("svm")))
    return summary(stored(reduce(DataFrame.unionByName, scored)), ["classifier"], target_fpr)


def summary(scores: DataFrame, keys: list[str], target_fpr: float = 0.01, tau: float = 0.5) -> DataFrame:
    """auroc, average_precision, accuracy, macro_f1 at tau and tpr at the target fpr of each group."""
    ranks = M.rank_metrics(M.prefix_table(scores, keys), keys, [target_fpr])
    ranks = ranks.select(*keys, "auroc", "average_precision", *[c for c in ranks.columns if c.startswith("tpr_")])
    return join_on(M.confusion(scores, keys, tau), ranks, keys)


def fit_mlp(train: DataFrame, hidden: tuple[int, ...] = (256, 64), steps: int = 100) -> Head:
    width = len(train.select("features").first().features)
    scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True)
    net = MultilayerPerceptronClassifier(featuresCol="_s", labelCol="label", layers=[width, *hidden, 2], maxIter=steps, seed=42)
    return Head(Pipeline(stages=[scaler, net]).fit(_vectors(train)))


def select_c(train: DataFrame, val: DataFrame, metric: str = "macro_f1", grid=(0.01, 0.1, 1.0)) -> tuple[float, Head]:
    """The first C with the best validation metric (macro_f1 or tpr_0_001), and its head."""
    best = None
    for c in grid:
        head = fit_logreg(train, c)
        row = summary(head.score(val).select("y", "score"), [], 0.001).first()
        value = row[metric] or 0.0
        if best is None or value > best[0]:
            best = (value, c, head)
    return best[1], best[2]


def newton_logreg(x: np.ndarray, y: np.ndarray, c: float, balanced: bool = True) -> tuple[np.ndarray, float]:
    """The minimum of |w|^2 / 2 + C * weighted log loss."""
    n1 = int((y == 1).sum())
    w0, w1 = S.class_weights(len(y) - n1, n1, balanced)
    s = np.where(y == 1, w1, w0)
    w = S.run(S.newton(x.shape[1]), lambda w: S.direction(w, c, *H.derivatives(x, y, s, w)))
    return w[:-1], float(w[-1])


def grouped_logreg(df: DataFrame, keys: list[str], grid=(0.01, 0.1, 1.0), max_train: int = 20_000, balanced: bool = True, metric: str = "macro_f1") -> DataFrame:
    """Scores of the val and test rows of each group (say, layer and fold) from a head of its own.

    Needs columns sample_id, split, y, features. C is the first of the grid with the best ``metric`` (macro_f1, or
    a tpr such as tpr_0_001) on val. Groups of up to ``max_train`` rows are each fitted in a task, larger
    ones over the whole cluster, all at once; the optimum is the same.
    """
    own = keys or [H.ALL]
    rows = (df if keys else df.withColumn(H.ALL, F.lit(0))).withColumn("m", F.array(F.struct(F.lit(0).alias("k"), "split")))
    scores = H.choose_c(H.fit_heads(rows, own, tuple(grid), balanced, max_train), own, tuple(grid), metric)
    return scores.select(*keys, "sample_id", "split", "y", "c", "score")


def _folded(df: DataFrame, k: int, seed: int) -> DataFrame:
    """``df`` with ``m``: a row is val for its own fold's head and trains the others'."""
    folded = stratified_kfold(df, k, "y", "sample_id", seed)
    last = folded.agg(F.max("fold")).first()[0]
    split = lambda f: F.struct(f.cast("int").alias("k"), F.when(f == F.col("fold"), "val").otherwise("train").alias("split"))
    return folded.withColumn("m", F.transform(F.sequence(F.lit(0), F.lit(last or 0)), split))


def cv_scores(df: DataFrame, keys: list[str], k: int = 5, c: float = 1.0, seed: int = 42, **limits) -> DataFrame:
    """Out-of-fold scores: every row is scored by the head of the folds it isn't in (``held``). Rows aren't copied for the folds."""
    own = keys or [H.ALL]
    rows = _folded(df if keys else df.withColumn(H.ALL, F.lit(0)), k, seed)
    scores = H.choose_c(H.fit_heads(rows, own, (c,), **limits), own, (c,))
    return scores.select(*keys, F.col("k").alias("held"), "sample_id", "y", "score")


def select_gamma_cv(df: DataFrame, grid=(0.01, 0.1, 1.0), k: int = 5, seed: int = 42, **limits) -> float:
    """The gamma (1 / C) with the best mean of the folds' macro F1; close means give the smaller, too few rows the last."""
    least = df.groupBy("y").count().agg(F.min("count"), F.count("*")).first()
    if least[1] < 2 or least[0] < 2:
        return grid[-1]
    tried = sorted(grid)
    scores = H.fit_heads(_folded(df.withColumn(H.ALL, F.lit(0)), k, seed), [H.ALL], tuple(1.0 / g for g in tried), **limits)
    each = scores.where("scores is not null").select("k", "y", F.posexplode("scores").alias("i", "score"))
    means = {r.i: r.f1 for r in M.confusion(each, ["k", "i"], 0.5).groupBy("i").agg(F.avg("macro_f1").alias("f1")).collect()}
    best = None
    for i, g in enumerate(tried):
        f1 = means.get(i, 0.0)
        if best is None or f1 > best[0] + 1e-8 + 1e-5 * abs(best[0]):
            best = (f1, g)
    return best[1]


def family_drift(pre: DataFrame, post: DataFrame, k: int = 5, family: str = "family", seed: int = 42) -> DataFrame:
    """Reports (part = pre k-fold, post) of a multinomial head over families.

    Families are numbered in a table that is joined in, so the plan doesn't grow with them. Rows without a family are left out.
    """
    names = stored(hash_rank(pre.select(F.col(family).alias("_name")).where("_name is not null").distinct(), [], hash_order("_name", seed), "_name").select("_name", (F.col("rank") - 1).cast("double").alias("_y")))
    back = names.select(F.col("_y").alias("prediction"), F.col("_name").cast("string").alias("pred"))
    lr = LogisticRegression(featuresCol="_v", labelCol="_y", family="multinomial", regParam=1e-3)
    ready = lambda d: d.withColumn("_v", array_to_vector(F.col("features").cast("array<double>"))).join(names, F.col(family) == F.col("_name"), "left")
    told = lambda d, m: m.transform(ready(d)).select(F.col(family).cast("string").alias("y"), "prediction").join(back, "prediction").select("y", "pred")
    folded = stored(stratified_kfold(pre.where(F.col(family).isNotNull()), k, family, "sample_id", seed))
    inside = []
    for f in range((folded.agg(F.max("fold")).first()[0] or 0) + 1):  # k fits
        model = lr.fit(ready(folded.where(F.col("fold") != f)))
        inside.append(told(folded.where(F.col("fold") == f), model))
    outside = told(post, lr.fit(ready(folded)))
    both = reduce(DataFrame.unionByName, inside).withColumn("part", F.lit("pre")).unionByName(outside.withColumn("part", F.lit("post")))
    return M.classification_report(stored(both), ["part"])


def text_features(weights: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``ids`` with ``features``, a sparse vector over the vocabulary of (id, gram, tfidf), in gram order.

    The vocabulary is bounded by ``max_features`` of ``tfidf``, so the driver numbers it and it is broadcast. A vector is
    written as the columns that it consists of and read as a vector, so none passes through Python.
    """
    spark = ids.sparkSession
    weights = stored(weights)
    grams = sorted(r.gram for r in weights.select("gram").distinct().collect())
    numbers = spark.createDataFrame(pd.DataFrame({"gram": grams, "i": np.arange(len(grams), dtype=np.int32)}), "gram string, i int")
    rows = weights.join(F.broadcast(numbers), "gram").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("i", "tfidf"))).alias("x"))
    empty = F.array().cast("array<struct<i:int,tfidf:double>>")
    x = F.coalesce("x", empty)
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(max(len(grams), 1)).alias("size"), x["i"].alias("indices"), x["tfidf"].alias("values"))
    out = ids.join(rows, id_col, "left").withColumn("features", parts).drop("x")
    return stored(out, StructType([*[f for f in out.schema.fields if f.name != "features"], StructField("features", VectorUDT())]))


def text_baseline(train: DataFrame, test: DataFrame, id_col: str, max_features: int = 50_000, clf: str = "lr", **how) -> DataFrame:
    """Scores of ``test`` (id, y, text) by TF-IDF and a logistic or boosted head; vocabulary from train alone.

    The logistic head's columns are scaled, not centred (``scaled=False`` leaves them).
    """
    part = lambda d, t: d.select(id_col, "y", "text", F.array(F.struct(F.lit(0).alias("k"), F.lit(t).alias("train"))).alias("m"))
    both = part(train, True).unionByName(part(test, False))
    if clf == "lr":
        return fit_text_folds(both, id_col, [0], max_features, **how).drop("fold")
    both = both.withColumn("_p", F.col("m")[0]["train"])
    weights = tfidf(train, both.select(id_col, "text"), id_col, max_features=max_features, **how)
    rows = text_features(weights, both.select(id_col, "y", "_p"), id_col)
    head = Head(GBTClassifier(featuresCol="_v", labelCol="label", maxIter=50, maxDepth=5, stepSize=0.1, seed=42).fit(_vectors(rows.where("_p"))))
    return head.score(rows.where("not _p")).select(id_col, "y", "score")
