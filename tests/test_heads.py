"""Heads of many groups and folds: one optimum, wherever the rows are."""

import math
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgauge.operators import heads as H
from driftgauge.operators import metrics as M
from driftgauge.operators import models as L
from driftgauge.operators import solvers as S
from driftgauge.operators import text_heads as T


def grouped(spark, groups, n=120, d=3, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for g in groups:
        x = rng.normal(size=(n, d)) * [1, 10, 0.1] + [0, 100, 5]
        y = (x[:, 0] + rng.normal(size=n) > 0).astype(int)
        rows += [(g, i, ("train", "train", "val", "test")[i % 4], int(y[i]), x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "layer int, sample_id long, split string, y int, features array<double>")


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-6), k


@pytest.mark.parametrize("balanced, metric", [(False, "tpr_0_001")])
def test_groups_in_tasks_and_together(spark, balanced, metric):
    df = grouped(spark, [1, None, 3]).unionByName(grouped(spark, [9], 20).withColumn("y", F.lit(1)))
    read = lambda out: {(r.layer, r.sample_id, r.split, r.y): r for r in out.collect()}
    a, b = [read(L.grouped_logreg(df, ["layer"], balanced=balanced, metric=metric, max_train=n)) for n in (1000, 50)]
    same({k: r.score for k, r in a.items()}, {k: r.score for k, r in b.items()})
    same({k: r.c for k, r in a.items()}, {k: r.c for k, r in b.items()})
    assert all(r.score is None for k, r in a.items() if k[0] == 9) and len(a) == 3 * 60 + 10


def test_choice_of_c_is_that_of_single_heads(spark):
    df = grouped(spark, [1], 400, seed=8)
    for metric in ("macro_f1", "tpr_0_001"):
        got = {r.c for r in L.grouped_logreg(df, ["layer"], metric=metric).select("c").distinct().collect()}
        assert got == {L.select_c(df.where("split = 'train'"), df.where("split = 'val'"), metric)[0]}


def test_jobs_do_not_grow_with_groups(spark):
    def jobs(groups):
        name = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(name, name)
        L.grouped_logreg(grouped(spark, groups, 80), ["layer"], max_train=10).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    few, many = jobs([1, 2]), jobs(range(1, 13))
    assert many <= 1.5 * few


def test_folds_are_separate_fits(spark):
    df = grouped(spark, [1, 2], 100).drop("split")
    for n in (1000, 10):
        got = {(r.layer, r.held, r.sample_id): r.score for r in L.cv_scores(df, ["layer"], 4, max_train=n).collect()}
        folded = {(r.layer, r.sample_id): r for r in L._folded(df, 4, 42).collect()}
        want = {}
        for layer in (1, 2):
            own = [r for k, r in folded.items() if k[0] == layer]
            x, y, f = np.array([r.features for r in own]), np.array([r.y for r in own]), np.array([r.fold for r in own])
            for k in range(4):
                t = f != k
                z = H.standard(x, x[t].mean(0), x[t].std(0))
                w, b = L.newton_logreg(z[t], y[t], 1.0)
                want |= {(layer, k, own[i].sample_id): float(S.sigmoid(z[i] @ w + b)) for i in np.flatnonzero(~t)}
        same(got, want)


def test_gamma_is_the_best_mean_of_folds(spark):
    df = grouped(spark, [1], 90, seed=5).drop("split", "layer")
    means = {}
    for g in (0.01, 0.1, 1.0):
        f1 = M.confusion(L.cv_scores(df, [], 5, 1.0 / g), ["held"], 0.5)
        means[g] = f1.agg(F.avg("macro_f1")).first()[0]
    best = max(means.values())
    assert L.select_gamma_cv(df) == min(g for g, v in means.items() if math.isclose(v, best, rel_tol=1e-5))
    assert L.select_gamma_cv(df.where("y = 1")) == 1.0


def closed_ridge(x, y, alpha=1.0, scaled=True):
    s = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    mean, std = (x.mean(0), x.std(0)) if scaled else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z, t = (x - mean) / np.where(std == 0, 1, std), 2.0 * y - 1
    a, b = (s[:, None] * z).sum(0) / s.sum(), (s * t).sum() / s.sum()
    w = np.linalg.solve((z - a).T @ (s[:, None] * (z - a)) + alpha * np.eye(x.shape[1]), (z - a).T @ (s * (t - b)))
    return lambda q: ((q - mean) / np.where(std == 0, 1, std) - a) @ w + b


def test_ridge_is_the_closed_form(spark):
    df = grouped(spark, [1], 90, seed=6).drop("layer", "split").withColumn("features", F.concat("features", F.array(F.lit(7.0))))
    rows = df.orderBy("sample_id").collect()
    x, y = np.array([r.features for r in rows]), np.array([r.y for r in rows])
    for scaled in (True, False):
        got = np.array([r.score for r in L.fit_ridge(df, 2.0, scaled).score(df).orderBy("sample_id").collect()])
        assert np.abs(got - closed_ridge(x, y, 2.0, scaled)(x)).max() < 1e-9
    folded = {r.sample_id: r.fold for r in L._folded(df, 3, 42).collect()}
    f = np.array([folded[r.sample_id] for r in rows])
    got = {r.sample_id: (r.held, r.score) for r in L.cv_ridge(df, [], 3).collect()}
    for k in range(3):
        want = closed_ridge(x[f != k], y[f != k])(x)
        assert all(got[r.sample_id][0] == k and abs(got[r.sample_id][1] - want[i]) < 1e-9 for i, r in enumerate(rows) if f[i] == k)


def texts(n=70):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(40)]
    out = []
    for i in range(n):
        own = list(rng.choice(words, 12)) + (["bad"] * int(rng.integers(0, 3)) if i % 2 else ["good"] * int(rng.integers(0, 2)))
        out.append((i, i % 2, " ".join(own)))
    return [*out, (n, 0, None), (n + 1, 1, "")]


def brute_text(train, test, c=1.0, most=50_000):
    """TF-IDF by dictionaries, scaled without a mean, fitted by Newton steps."""
    count = [Counter((t or "").split()) for _, _, t in train]
    total = Counter()
    for k in count:
        total.update(k)
    vocab = sorted(sorted(total, key=lambda w: (-total[w], w))[:most])
    df = {w: sum(w in k for k in count) for w in vocab}
    idf = np.array([math.log((1 + len(train)) / (1 + df[w])) + 1 for w in vocab])

    def rows(docs):
        x = np.array([[Counter((t or "").split())[w] for w in vocab] for _, _, t in docs]) * idf
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(n == 0, 1, n)

    a, y = rows(train), np.array([y for _, y, _ in train])
    std = a.std(0)
    std[std == 0] = 1
    w, b = L.newton_logreg(a / std, y, c)
    return {d[0]: float(s) for d, s in zip(test, S.sigmoid(rows(test) / std @ w + b), strict=True)}


@pytest.mark.parametrize("most", [50_000, 15])
def test_text_folds_are_separate_fits(spark, most):
    docs = texts()
    df = spark.createDataFrame(docs, "sample_id long, y int, text string")
    folded = {r.sample_id: r.fold for r in L.stratified_kfold(df, 3, "y", "sample_id").collect()}
    want = {}
    for k in range(3):
        want |= brute_text([d for d in docs if folded[d[0]] != k], [d for d in docs if folded[d[0]] == k], most=most)
    for n in (1000, 0)[: 2 if most == 15 else 1]:
        got = T.text_cv(df, "sample_id", 3, max_features=most, max_rows=n, pattern=r"(?Ud)\b\w+\b").collect()
        assert all(r.fold == folded[r.sample_id] and r.y == r.sample_id % 2 or r.sample_id >= 70 for r in got)
        same({r.sample_id: r.score for r in got}, want)


def test_text_folds_of_given_splits(spark):
    docs = texts(40)
    df = spark.createDataFrame(docs, "sample_id long, y int, text string")
    rows = [(f, i, s) for i, _, _ in docs for f, s in (("a", "train" if i % 3 else "test"), ("b", "test" if i < 10 else "train" if i < 30 else "val"), (None, "train" if i % 2 else "test"))]
    folds = spark.createDataFrame(rows, "fold string, sample_id long, split string")
    got = {(r.fold, r.sample_id): r.score for r in T.text_folds(df, folds, "sample_id", pattern=r"(?Ud)\b\w+\b").collect()}
    want = {(None, i): None for f, i, s in rows if f is None and s == "test"}
    for f in "ab":
        own = {i: s for g, i, s in rows if g == f}
        want |= {(f, i): s for i, s in brute_text([d for d in docs if own[d[0]] == "train"], [d for d in docs if own[d[0]] == "test"]).items()}
    same(got, want)
    alone = L.text_baseline(df.where("sample_id % 3 > 0"), df.where("sample_id % 3 = 0"), "sample_id", pattern=r"(?Ud)\b\w+\b")
    same({("a", r.sample_id): r.score for r in alone.collect()}, {k: v for k, v in want.items() if k[0] == "a"})
    boosted = L.text_baseline(df.where("sample_id % 3 > 0"), df.where("sample_id % 3 = 0"), "sample_id", clf="gbdt")
    assert boosted.count() == len([1 for d in docs if d[0] % 3 == 0])


def test_texts_without_words(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 1, ""), (3, 0, "?"), (4, 1, None)], "sample_id long, y int, text string")
    assert {r.score for r in T.text_cv(df, "sample_id", 2).collect()} == {0.5}
    assert T.text_cv(df.limit(0), "sample_id", 2).count() == 0


def test_platt_finds_the_optimum(spark):
    rng = np.random.default_rng(9)
    rows = [(g, int(rng.random() < 1 / (1 + np.exp(-2 * s - g))), float(s)) for g in (0, 1) for s in rng.normal(size=150)]
    got = {r.fold: (r.a, r.b) for r in L.platt(spark.createDataFrame(rows, "fold int, y int, score double"), ["fold"]).collect()}
    for g in (0, 1):
        y, s = (np.array([r[k] for r in rows if r[0] == g], float) for k in (1, 2))
        t = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
        d = S.sigmoid(got[g][0] * s + got[g][1]) - t
        assert abs((d * s).sum()) < 1e-6 and abs(d.sum()) < 1e-6


def test_rank_metrics_equal_each_alone(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(rng.random() < 0.4) if g < 3 else 0, float(rng.integers(0, 12)) / 12) for g in range(4) for _ in range(200)]
    df = spark.createDataFrame(rows, "layer int, y int, score double")
    targets = (0.001, 0.05, 0.3)
    for n in (100_000, 3):
        table = M.prefix_table(df, ["layer"], n)
        got = {r.layer: r for r in M.rank_metrics(table, ["layer"], targets, {"q": 0.9}).collect()}
        curve = M.roc_curve(df, ["layer"], rows=n)
        tpr = {r.layer: r for r in M.tpr_at_fpr(curve, ["layer"], targets).collect()}
        at = {r.layer: r for r in M.threshold_at_fpr(curve, ["layer"], targets).collect()}
        for g in range(4):
            for c in tpr[g].__fields__[1:]:
                assert got[g][c] == tpr[g][c]
            for c in at[g].__fields__[1:]:
                assert got[g][c] == at[g][c]
            neg = [s for k, y, s in rows if k == g and y == 0]
            assert abs(got[g].q - np.quantile(neg, 0.9)) < 1e-12
            pos = [s for k, y, s in rows if k == g and y == 1]
            if pos:
                area = np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg])
                assert abs(got[g].auroc - area) < 1e-12


def test_ablation_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    from driftgauge.operators import features as X
    from driftgauge.plans import jobs as J

    rows = [(i, i % 2, f"{'bad' if i % 3 else 'good'} word{i % 5} {'0' * 40} http://a.example.com/{i}") for i in range(40)]
    reports = spark.createDataFrame(rows, "sample_id long, y int, text string")
    split = reports.select("sample_id", F.element_at(F.array(F.lit("train"), F.lit("train"), F.lit("val"), F.lit("test")), (F.floor(F.col("sample_id") / 2) % 4 + 1).cast("int")).alias("split"))
    fits, fit = [], L.grouped_logreg
    at = str(tmp_path / "results")

    def counted(df, *a, **k):
        fits.append([tuple(r) for r in df.select("condition", "layer").distinct().collect()])
        if len(fits) == 3:
            raise RuntimeError("stopped")
        return fit(df, *a, **k)

    monkeypatch.setattr(L, "grouped_logreg", counted)
    run = lambda layers: J.identifier_ablation_layers(reports, split, X.hash_encoder(4, 3), layers=layers, results=at)
    with pytest.raises(RuntimeError):
        run([0, 1])
    first = fits[:2]
    del fits[:]
    fits.append([])  # the second run fits what is left, and does not stop
    fits.append([])
    fits.append([])
    out = sorted(map(tuple, run([0, 1]).collect()))
    again = [x for f in fits for x in f]
    assert len(again) == 4 and not set(again) & {x for f in first for x in f}
    del fits[3:]
    run([0, 1, 2]).collect()
    assert {x for f in fits[3:] for x in f} == {(c, 2) for c in ("with_hash", "without_hash", "without_strong_ids", "without_iocs")}
    monkeypatch.setattr(L, "grouped_logreg", fit)
    assert out == sorted(map(tuple, J.identifier_ablation_layers(reports, split, X.hash_encoder(4, 3), layers=[0, 1]).collect()))


def test_steps_read_packed_rows(spark, monkeypatch):
    """A step reads blocks of documents that train the same folds, not a row for each document."""
    docs = spark.createDataFrame(texts(200), "sample_id long, y int, text string").coalesce(2)
    kept = []
    packed = T._packed
    monkeypatch.setattr(T, "_packed", lambda *a: kept.append(packed(*a)) or kept[-1])
    assert T.text_cv(docs, "sample_id", 3, max_rows=0).count() == 202
    blocks = kept[0].collect()
    assert len(blocks) < 100 and sum(len(b.y) // 8 for b in blocks) == 202 and all(len(b.trains) == 2 for b in blocks)


def test_steps_plan_no_query(spark, monkeypatch):
    """Steps of large folds are jobs on persisted blocks: no query plans them, and no plan's sums."""
    docs = spark.createDataFrame(texts(120), "sample_id long, y int, text string")
    want = {r.sample_id: r.score for r in T.text_cv(docs, "sample_id", 3).collect()}
    monkeypatch.setattr(S, "added", None)
    same({r.sample_id: r.score for r in T.text_cv(docs, "sample_id", 3, max_rows=0).collect()}, want)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_ablation_counts_a_text_once(spark, monkeypatch):
    """Conditions that leave a text as it is share its row."""
    from driftgauge.plans import jobs as J

    docs = spark.createDataFrame(texts(120), "sample_id long, y int, text string")
    split = docs.select("sample_id", F.when(F.col("sample_id") % 5 == 0, "test").otherwise("train").alias("split"))
    hashed = docs.withColumn("text", F.when(F.col("sample_id") < 10, F.concat("text", F.lit(f" {'0' * 40}"))).otherwise(F.col("text")))
    seen, fit = [], L.fit_text_folds
    monkeypatch.setattr(L, "fit_text_folds", lambda d, *a, **k: seen.append(d.count()) or fit(d, *a, **k))
    assert J.identifier_ablation(hashed, split).count() == 3 and seen == [132]


def test_forest_stays_in_tasks(spark):
    """A dealt forest finds what rows show, is the same however rows and trees are dealt, and agrees with that of Spark ML."""
    from driftgauge.operators import forests as R

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(1500)], "sample_id long, y int, features array<double>")
    train, test = df.where("sample_id % 4 > 0"), df.where("sample_id % 4 = 0")
    read = lambda out: sorted((r.y, r.score) for r in out.collect())
    got = read(R.forest_scores(train, test, 9))
    again = read(R.forest_scores(train.repartition(5), test.repartition(3), 9))
    assert np.allclose(got, again, atol=1e-12) and len(got) == 375
    large = read(R.forest_scores(train, test, 9, max_cells=0))
    named = read(R.forest_scores(train.withColumn("sample_id", F.col("sample_id").cast("string")), test.withColumn("sample_id", F.col("sample_id").cast("string")), 9))
    for scores in (got, large, named):
        assert np.mean([(s > 0.5) == y for y, s in scores]) > 0.9
    # each leaf of a tree without a bound of depth is pure where bins tell rows apart
    bins, own = np.arange(30).reshape(-1, 1).astype(np.uint8), np.arange(30) % 2.0
    assert (R.grow(bins, own, np.ones(30), rng) == own).all()


def test_query_fits_all_trees(spark, sf, monkeypatch):
    """``m5_compare_classifiers`` asks for no fewer trees than the operator's 200."""
    import inspect

    from driftgauge.plans import registered

    asked, whole = [], inspect.signature(L.compare_classifiers)
    monkeypatch.setattr(L, "compare_classifiers", lambda *a, **k: asked.append(whole.bind(*a, **k)))
    registered.QUERIES["m5_compare_classifiers"](spark, sf)
    asked[0].apply_defaults()
    assert asked[0].arguments["trees"] == 200
