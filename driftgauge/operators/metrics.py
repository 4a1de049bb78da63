"""Detector metrics over a score table (keys..., y, score), for all groups in one pass.

Rows whose y is null or not 0/1, or whose score is null or NaN, are left out. A group
with one class has null metrics and ``valid = false``, and never fails the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import div, join_on
from .prefix import RANGE_ROWS, prefix_sums


def usable(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("y").isin(0, 1) & F.col("score").isNotNull() & ~F.isnan("score"))


def score_counts(scores: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct score with its positives and negatives."""
    return usable(scores).groupBy(*keys, "score").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))


def prefix_table(scores: DataFrame, keys: list[str], rows: int = RANGE_ROWS) -> DataFrame:
    """W1's base: per distinct score, falling, the cumulated tp and fp."""
    t = prefix_sums(score_counts(scores, keys), keys, "score", ["pos", "neg"], head=["pos", "neg"], rows=rows)
    return t.withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp", "all_pos": "p", "all_neg": "n"})


def roc_curve(scores: DataFrame, keys: list[str], drop_intermediate: bool = True, rows: int = RANGE_ROWS) -> DataFrame:
    """(keys, threshold, tpr, fpr, tp, fp): points by falling threshold, from (inf, 0, 0) on.

    With ``drop_intermediate`` a point goes when it lies within a straight stretch of
    equal steps: the next distinct score has the same positives and negatives. The first
    and last score stay.
    """
    t = prefix_table(scores, keys, rows)
    if drop_intermediate:
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        t = t.where(first | F.col("next_pos").isNull() | bend)
    points = t.select(*keys, F.col("score").alias("threshold"), div(F.col("tp"), F.col("p")).alias("tpr"), div(F.col("fp"), F.col("n")).alias("fpr"), "tp", "fp", "p", "n")
    start = points.groupBy(*keys).agg(F.max("p").alias("p"), F.max("n").alias("n"))
    start = start.select(*keys, F.lit(float("inf")).alias("threshold"), div(F.lit(0), F.col("p")).alias("tpr"), div(F.lit(0), F.col("n")).alias("fpr"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "p", "n")
    return points.unionByName(start).drop("p", "n")


def _name(target: float) -> str:
    return f"{target:g}".replace(".", "_")


def tpr_at_fpr(curve: DataFrame, keys: list[str], targets=(0.001, 0.005, 0.01)) -> DataFrame:
    """tpr of the last kept point with fpr <= target."""
    return curve.groupBy(*keys).agg(*[F.max(F.when(F.col("fpr") <= t, F.col("tpr"))).alias(f"tpr_{_name(t)}") for t in targets])


def threshold_at_fpr(curve: DataFrame, keys: list[str], targets=(0.001, 0.005, 0.01)) -> DataFrame:
    """Threshold of the last kept point with fpr <= target, perhaps infinite; 1.0 where no point is valid."""
    low = lambda t: F.coalesce(F.min(F.when(F.col("fpr") <= t, F.col("threshold"))), F.lit(1.0))
    return curve.groupBy(*keys).agg(*[low(t).alias(f"threshold_{_name(t)}") for t in targets])


def nearest_fpr(curve: DataFrame, keys: list[str], target: float) -> DataFrame:
    """The point whose fpr is nearest to the target, the first one on ties, with its f1."""
    at = F.min_by(F.struct("threshold", "tpr", "fpr", "tp", "fp"), F.struct(F.abs(F.col("fpr") - target), -F.col("threshold")))
    top = curve.groupBy(*keys).agg(at.alias("x"), F.max("tp").alias("p")).select(*keys, "x.*", "p")
    f1 = div(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p"))
    return top.select(*keys, "threshold", "tpr", "fpr", F.coalesce(f1, F.lit(0.0)).alias("f1"))


def _quantiles(shares: dict[str, float]) -> tuple[list[Column], dict[str, Column]]:
    """Aggregates over a prefix table, and from these (and ``n``) linear quantiles of the negatives' scores."""
    before = F.col("n") - F.col("fp")  # negatives below this score
    found, values = [], {}
    for name, share in shares.items():
        at, place = F.lit(float(share)) * (F.col("n") - 1), F.lit(float(share)) * (F.col("_n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            found.append(F.max(F.when((before <= rank) & (rank < before + F.col("neg")), F.col("score"))).alias(f"_{name}_{side}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        values[name] = F.when(lo == hi, lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi)
    return found, values


def rank_metrics(table: DataFrame, keys: list[str], targets=(), shares: dict[str, float] | None = None) -> DataFrame:
    """Everything that one prefix table holds, in one aggregate: auroc, average_precision, tpr and threshold at each
    target fpr (of the points that ``roc_curve`` keeps), and quantiles of the negatives by ``shares``.
    """
    above = F.col("tp") - F.col("pos")
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    kept = first | F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    found, values = _quantiles(shares or {})
    aggs = [F.sum(F.col("neg") * (above + F.col("pos") / 2)).alias("_a"), F.sum(F.col("pos") * div(F.col("tp"), F.col("tp") + F.col("fp"))).alias("_ap"), F.max("p").alias("_p"), F.max("n").alias("_n"), *found]
    out = {"auroc": div(F.col("_a"), F.col("_p") * F.col("_n")), "average_precision": div(F.col("_ap"), F.col("_p"))}
    for t in targets:
        here = kept & (div(F.col("fp"), F.col("n")) <= t)
        aggs += [F.max(F.when(here, F.col("tp"))).alias(f"_tp_{_name(t)}"), F.min(F.when(here, F.col("score"))).alias(f"_at_{_name(t)}")]
        # the curve begins at an infinite threshold without a hit
        out[f"tpr_{_name(t)}"] = F.when(F.col("_n") > 0, div(F.coalesce(f"_tp_{_name(t)}", F.lit(0)), F.col("_p")))
        out[f"threshold_{_name(t)}"] = F.when(F.col("_n") > 0, F.coalesce(f"_at_{_name(t)}", F.lit(float("inf")))).otherwise(1.0)
    return table.groupBy(*keys).agg(*aggs).select(*keys, *[v.alias(k) for k, v in (out | values).items()])


def auroc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve with ties counted half."""
    return rank_metrics(prefix_table(scores, keys), keys).select(*keys, "auroc")


def average_precision(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over distinct scores of the recall gained times the precision there."""
    return rank_metrics(prefix_table(scores, keys), keys).select(*keys, "average_precision")


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(div(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def confusion(scores: DataFrame, keys: list[str], tau: Column | float = 0.5) -> DataFrame:
    """tn, fp, fn, tp at score >= tau, accuracy and the mean F1 of both classes."""
    tau = tau if isinstance(tau, Column) else F.lit(tau)
    y, hit = F.col("y") == 1, F.col("score") >= tau
    t = usable(scores).groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in (("tn", ~y & ~hit), ("fp", ~y & hit), ("fn", y & ~hit), ("tp", y & hit))])
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return t.withColumns({"accuracy": div(tn + tp, tn + fp + fn + tp), "macro_f1": (_f1(tp, fp, fn) + _f1(tn, fn, fp)) / 2})


def classification_report(pred: DataFrame, keys: list[str], y: str = "y", p: str = "pred") -> DataFrame:
    """precision, recall, f1 and support of each class, and ``macro avg``, ``weighted avg`` and ``accuracy`` rows."""
    pairs = pred.groupBy(*keys, F.col(y).cast("string").alias("y"), F.col(p).cast("string").alias("p")).agg(F.count("*").alias("c"))
    sides = F.array(F.struct(F.col("y").alias("label"), F.lit(1).alias("is_y")), F.struct(F.col("p").alias("label"), F.lit(0).alias("is_y")))
    side = pairs.select(*keys, "c", (F.col("y") == F.col("p")).alias("same"), F.inline(sides))
    hit = F.col("same") & (F.col("is_y") == 1)
    per = side.groupBy(*keys, "label").agg(
        F.sum(F.when(hit, F.col("c")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("is_y") == 1, F.col("c")).otherwise(0)).alias("support"), F.sum(F.when(F.col("is_y") == 0, F.col("c")).otherwise(0)).alias("chosen")
    )
    zero = F.lit(0.0)
    per = per.select(*keys, "label", F.coalesce(div(F.col("tp"), F.col("chosen")), zero).alias("precision"), F.coalesce(div(F.col("tp"), F.col("support")), zero).alias("recall"), F.coalesce(div(2 * F.col("tp"), F.col("support") + F.col("chosen")), zero).alias("f1"), "support", "tp")
    names = ["precision", "recall", "f1"]
    macro = per.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in names], F.sum("support").alias("support")).withColumn("label", F.lit("macro avg"))
    weighted = per.groupBy(*keys).agg(*[div(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in names], F.sum("support").alias("support")).withColumn("label", F.lit("weighted avg"))
    right = per.groupBy(*keys).agg(div(F.sum("tp"), F.sum("support")).alias("f1"), F.sum("support").alias("support"))
    right = right.select("*", F.col("f1").alias("precision"), F.col("f1").alias("recall"), F.lit("accuracy").alias("label"))
    cols = [*keys, "label", *names, "support"]
    return per.select(*cols).unionByName(macro.select(*cols)).unionByName(weighted.select(*cols)).unionByName(right.select(*cols))


def _rates(tau: Column, lenient: bool = False) -> list[Column]:
    y, hit = F.col("y") == 1, F.col("score") >= tau
    floor = (lambda c: F.greatest(c, F.lit(1))) if lenient else (lambda c: c)
    return [div(F.count_if(y & hit), floor(F.count_if(y))).alias("tpr"), div(F.count_if(~y & hit), floor(F.count_if(~y))).alias("fpr")]


def _z(tau: Column, mean: Column, std: Column, how: str) -> Column:
    if how == "safe":  # a std of zero, or of one row, counts as 1
        return (tau - mean) / F.when(F.coalesce(std, F.lit(0.0)) == 0, 1.0).otherwise(std)
    return (tau - mean) / (F.coalesce(std, F.lit(0.0)) + 1e-8)


def negative_quantiles(scores: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Exact linear quantiles of the negatives' scores, from cumulated counts of distinct scores.

    The wanted ranks are looked up in the prefix table, so no group is held in one buffer.
    """
    return rank_metrics(prefix_table(scores.where("y = 0"), keys), keys, shares=shares).select(*keys, *shares)


def quantile_threshold(scores: DataFrame, keys: list[str], target_fpr: float = 0.01, adjust: bool = False, z: str = "eps", table: DataFrame | None = None) -> DataFrame:
    """(keys, tau, fpr, tpr, z_neg, z_all, valid): tau is the linear quantile of the negatives at 1 - target.

    ``adjust``: where the fpr exceeds the target, tau + 0.001 std * {1, 1.5, 2, 3, 5}, the
    first that meets it, else the quantile at 1 - 0.9 target. ``z``: "eps" adds 1e-8 to
    the std, "safe" takes a std of 0 as 1. Quantiles and rates are read from the prefix table of the scores (``table``, if
    there is one already); the scores themselves are read for means and deviations alone.
    """
    rows = usable(scores)
    table = prefix_table(scores, keys) if table is None else table
    neg = F.when(F.col("y") == 0, F.col("score"))
    stats = rows.groupBy(*keys).agg(
        F.avg(neg).alias("_mn"), F.stddev_samp(neg).alias("_sn"), F.avg("score").alias("_ma"), F.stddev_samp("score").alias("_sa"),
        ((F.min("y") == 0) & (F.max("y") == 1)).alias("valid"),
    )
    stats = join_on(stats, rank_metrics(table, keys, shares={"tau": 1 - target_fpr, "_tight": 1 - 0.9 * target_fpr}).select(*keys, "tau", "_tight"), keys, "left")
    steps = (0.0, 1.0, 1.5, 2.0, 3.0, 5.0) if adjust else (0.0,)
    tries = F.array(*[F.when(F.lit(s) == 0.0, F.col("tau")).otherwise(F.col("tau") + 0.001 * F.col("_sn") * s) for s in steps], "_tight")
    tried = join_on(table, stats.select(*keys, tries.alias("_try")), keys)
    at = lambda c, k: F.coalesce(F.max(F.when(F.col("score") >= F.col("_try")[k], F.col(c))), F.lit(0))
    rates = [F.struct(div(at("tp", k), F.max("p")).alias("tpr"), div(at("fp", k), F.max("n")).alias("fpr"), F.max(F.col("_try")[k]).alias("tau")) for k in range(len(steps) + 1)]
    tried = tried.groupBy(*keys).agg(*[r.alias(f"_r{k}") for k, r in enumerate(rates)])
    chosen = F.col("_r0")
    if adjust:
        chosen = F.when(F.col("_r0.fpr") <= target_fpr, F.col("_r0"))
        for k in range(1, len(steps)):
            chosen = chosen.when(F.col(f"_r{k}.fpr") <= target_fpr, F.col(f"_r{k}"))
        chosen = chosen.otherwise(F.col(f"_r{len(steps)}"))
    out = join_on(stats.drop("tau"), tried.select(*keys, chosen.alias("_c")).select(*keys, "_c.*"), keys, "left")
    null = F.lit(None).cast("double")
    values = {"tau": F.col("tau"), "fpr": F.col("fpr"), "tpr": F.col("tpr"), "z_neg": _z(F.col("tau"), F.col("_mn"), F.col("_sn"), z), "z_all": _z(F.col("tau"), F.col("_ma"), F.col("_sa"), z)}
    return out.select(*keys, *[F.when(F.col("valid"), v).otherwise(null).alias(k) for k, v in values.items()], "valid")


def evaluate_at(scores: DataFrame, taus: DataFrame, keys: list[str], lenient: bool = True, z: str = "eps") -> DataFrame:
    """tpr, fpr and z_all of another split at given thresholds (keys, tau)."""
    rows = join_on(usable(scores), taus.select(*keys, "tau"), keys)
    t = rows.groupBy(*keys, "tau").agg(*_rates(F.col("tau"), lenient), F.avg("score").alias("_m"), F.stddev_samp("score").alias("_s"))
    return t.select(*keys, "tau", "tpr", "fpr", _z(F.col("tau"), F.col("_m"), F.col("_s"), z).alias("z_all"))


def bin_of(score: Column, bins: int = 50) -> Column:
    """Bin of equal bins on [0, 1], the last closed; null outside. Edges are those of linspace."""
    k = F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")
    edges = F.array(*[F.lit(float(e)) for e in np.linspace(0, 1, bins + 1)])
    k = F.when((F.get(edges, k + 1) <= score) & (k < bins - 1), k + 1).when(score < F.get(edges, k), k - 1).otherwise(k)
    return F.when((score >= 0) & (score <= 1), k)


def score_histogram(scores: DataFrame, keys: list[str], bins: int = 50) -> DataFrame:
    """(keys, bin, count) with every bin of each group, and the group's mean and population std."""
    rows = scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
    have = rows.groupBy(*keys, bin_of(F.col("score"), bins).alias("bin")).agg(F.count("*").alias("count")).where("bin is not null")
    groups = rows.groupBy(*keys).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    every = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return join_on(every, have, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"), "mean", "std")


def kl_drift(scores: DataFrame, keys: list[str], p_split: str, q_split: str, bins: int = 50, split: str = "split") -> DataFrame:
    """KL(P || Q) in nats of two splits' histograms, for ``all``, ``neg`` and ``pos`` scores.

    Histograms are clipped at 1e-12 and normalised again; null where a side is empty.
    """
    rows = scores.where(F.col(split).isin(p_split, q_split) & F.col("score").isNotNull() & ~F.isnan("score"))
    parts = F.array(F.lit("all"), F.when(F.col("y") == 1, "pos").otherwise("neg"))
    rows = rows.withColumn("part", F.explode(parts)).withColumn("bin", bin_of(F.col("score"), bins)).where("bin is not null")
    side = lambda s: F.count_if(F.col(split) == s)
    c = rows.groupBy(*keys, "part", "bin").agg(side(p_split).alias("p"), side(q_split).alias("q"))
    sizes = c.groupBy(*keys, "part").agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    every = sizes.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    c = join_on(every, c, [*keys, "part", "bin"], "left")
    clip = lambda x, n: F.greatest(F.coalesce(div(F.coalesce(F.col(x), F.lit(0)), F.col(n)), F.lit(0.0)), F.lit(1e-12))
    c = c.withColumns({"p": clip("p", "np"), "q": clip("q", "nq")})
    sp, sq = F.sum("p"), F.sum("q")
    kl = F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))) / sp + F.ln(sq / sp)
    t = c.groupBy(*keys, "part").agg(kl.alias("kl"), F.max("np").alias("np"), F.max("nq").alias("nq"))
    return t.select(*keys, "part", F.when((F.col("np") > 0) & (F.col("nq") > 0), F.col("kl")).alias("kl"))


def kl_alerts(metrics: DataFrame, run: list[str], value: str = "kl", factor: float = 1.5) -> DataFrame:
    """Threshold mean + factor * sample std over a run's layers, and whether a layer exceeds it."""
    w = Window.partitionBy(*run)
    v = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf")), F.col(value))
    out = metrics.withColumn("threshold", F.avg(v).over(w) + factor * F.coalesce(F.stddev_samp(v).over(w), F.lit(0.0)))
    return out.withColumn("alert", F.coalesce(v > F.col("threshold"), F.lit(False)))


def normalize_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Min-max scores of each group; 0.5 where their range is under 1e-8."""
    ends = scores.groupBy(*keys).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    out = join_on(scores, ends, keys).withColumn("score", F.when(width < 1e-8, F.lit(0.5)).otherwise((F.col("score") - F.col("_lo")) / width))
    return out.drop("_lo", "_hi")


def selection_score(metrics: DataFrame, strategy: str = "drift", penalty: float = 0.1) -> DataFrame:
    """``selection_score``: drift is min(tpr_id, tpr_ood) - penalty * |z_id - z_ood|, tpr_id where those lack."""
    drift = F.when(F.col("tpr_ood").isNotNull() & F.col("z_id").isNotNull() & F.col("z_ood").isNotNull(), F.least("tpr_id", "tpr_ood") - penalty * F.abs(F.col("z_id") - F.col("z_ood")))
    how = {"drift": F.coalesce(drift, F.col("tpr_id")), "min_tpr": F.coalesce(F.least("tpr_id", F.coalesce("tpr_ood", "tpr_id")), F.col("tpr_id")), "tpr_id": F.col("tpr_id"), "macro_f1": F.col("macro_f1")}
    return metrics.withColumn("selection_score", how[strategy])


def best_layer(metrics: DataFrame, run: list[str], by: str = "selection_score", index: str = "layer") -> DataFrame:
    """The row of each run with the highest score, the lowest index on ties."""
    w = Window.partitionBy(*run).orderBy(F.desc_nulls_last(by), index)
    return metrics.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def delta_tau(scores: DataFrame, keys: list[str], base: str, target: str, target_fpr: float = 0.01, split: str = "split") -> DataFrame:
    """Threshold found anew on the target split minus that of the base split; 0 where the target has one class."""
    a = quantile_threshold(scores.where(F.col(split) == base), keys, target_fpr, adjust=True).select(*keys, F.col("tau").alias("tau_base"))
    b = quantile_threshold(scores.where(F.col(split) == target), keys, target_fpr, adjust=True).select(*keys, F.col("tau").alias("tau_target"))
    return join_on(a, b, keys, "left").withColumn("delta_tau", F.coalesce("tau_target", "tau_base") - F.col("tau_base"))


def bootstrap_ci(scores: DataFrame, taus: DataFrame, keys: list[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """95 % interval of the rate score >= tau of each class, from ``n`` resamples.

    A resample of m rows hits Binomial(m, rate) times, so one row per group and class is
    drawn from, whatever the number of scores.
    """
    rows = join_on(usable(scores), taus.select(*keys, "tau"), keys)
    per = rows.groupBy(*keys, "y").agg(F.count("*").alias("m"), F.count_if(F.col("score") >= F.col("tau")).alias("hits"))

    @F.pandas_udf("struct<lo double, hi double>")
    def draw(m: pd.Series, hits: pd.Series, salt: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, s in zip(m, hits, salt, strict=True):
            if n <= 0 or a == 0:
                out.append((float("nan"), float("nan")))
                continue
            got = np.random.default_rng([seed, int(s) & 0x7FFFFFFF]).binomial(a, b / a, n) / a
            out.append(tuple(np.quantile(got, [0.025, 0.975])))
        return pd.DataFrame(out, columns=["lo", "hi"])

    salt = F.xxhash64(*keys, "y")
    return per.withColumn("ci", draw("m", "hits", salt)).select(*keys, "y", "m", div(F.col("hits"), F.col("m")).alias("rate"), *[F.coalesce(f"ci.{c}", F.lit(float("nan"))).alias(c) for c in ("lo", "hi")])
