"""Queries over the score views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import reports as R
from . import views as V
from .registry import query


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


S, SF = V.scores_sql(), V.scores_sql(True)
KEYS = ["layer", "split"]
CURVE = """c AS (SELECT layer, split, score, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM s GROUP BY ALL),
p AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER g AS p, sum(neg) OVER g AS n, lead(pos) OVER w AS np, lead(neg) OVER w AS nn
 FROM c WINDOW w AS (PARTITION BY layer, split ORDER BY score DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY layer, split)),
k AS (SELECT layer, split, score AS threshold, tp / p AS tpr, fp / n AS fpr, tp::BIGINT AS tp, fp::BIGINT AS fp, p FROM p WHERE (tp = pos AND fp = neg) OR np IS NULL OR np <> pos OR nn <> neg
 UNION ALL SELECT DISTINCT layer, split, 'inf'::DOUBLE, 0.0, 0.0, 0, 0, p FROM p)"""


@query("w1_roc_curve", f"WITH {S}, {CURVE} SELECT layer, split, threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, tp, fp FROM k")
def roc(spark, d):
    return r6(M.roc_curve(V.scores(spark, d), KEYS), "tpr", "fpr")


@query("w1_prefix_table_fine", f"WITH {SF}, {CURVE} SELECT layer, split, score, pos, neg, tp::BIGINT AS tp, fp::BIGINT AS fp FROM p")
def prefix(spark, d):
    return M.prefix_table(V.scores(spark, d, True), KEYS).select(*KEYS, "score", "pos", "neg", "tp", "fp")


_AT = ", ".join(f"round(max(CASE WHEN fpr <= {t} THEN tpr END), 6) AS tpr_{n}" for t, n in ((0.001, "0_001"), (0.005, "0_005"), (0.01, "0_01")))


@query("w2_tpr_at_fpr", f"WITH {S}, {CURVE} SELECT layer, split, {_AT} FROM k GROUP BY ALL")
def tpr_at(spark, d):
    out = M.tpr_at_fpr(M.roc_curve(V.scores(spark, d), KEYS), KEYS)
    return r6(out, *[c for c in out.columns if c.startswith("tpr_")])


_TH = ", ".join(f"coalesce(min(CASE WHEN fpr <= {t} THEN threshold END), 1.0) AS threshold_{n}" for t, n in ((0.001, "0_001"), (0.005, "0_005"), (0.01, "0_01")))


@query("w3_threshold_at_fpr", f"WITH {SF}, {CURVE} SELECT layer, split, {_TH} FROM k GROUP BY ALL")
def threshold_at(spark, d):
    return M.threshold_at_fpr(M.roc_curve(V.scores(spark, d, True), KEYS), KEYS)


@query(
    "w4_nearest_fpr",
    f"""WITH {S}, {CURVE}, o AS (SELECT *, row_number() OVER (PARTITION BY layer, split ORDER BY abs(fpr - 0.05), threshold DESC) AS rn, max(tp) OVER (PARTITION BY layer, split) AS mp FROM k)
SELECT layer, split, threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(2.0 * tp / (tp + fp + mp), 6) AS f1 FROM o WHERE rn = 1""",
)
def nearest(spark, d):
    return r6(M.nearest_fpr(M.roc_curve(V.scores(spark, d), KEYS), KEYS, 0.05), "tpr", "fpr", "f1")


@query("a11_auroc", f"WITH {S}, {CURVE} SELECT layer, split, round(sum(neg * (tp - pos + pos / 2)) / (max(p) * max(n)), 6) AS auroc FROM p GROUP BY ALL")
def auroc(spark, d):
    return r6(M.auroc(V.scores(spark, d), KEYS), "auroc")


@query("a12_average_precision", f"WITH {S}, {CURVE} SELECT layer, split, round(sum(pos * (tp / (tp + fp))) / max(p), 6) AS average_precision FROM p GROUP BY ALL")
def ap(spark, d):
    return r6(M.average_precision(V.scores(spark, d), KEYS), "average_precision")


_CM = """count(*) FILTER (y = 0 AND score < 0.6) AS tn, count(*) FILTER (y = 0 AND score >= 0.6) AS fp, count(*) FILTER (y = 1 AND score < 0.6) AS fn, count(*) FILTER (y = 1 AND score >= 0.6) AS tp"""
_F1 = "(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0 * tn / nullif(2 * tn + fn + fp, 0), 0)) / 2"


@query("a5_confusion", f"WITH {S}, c AS (SELECT layer, split, {_CM} FROM s GROUP BY ALL) SELECT layer, split, tn, fp, fn, tp, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy, round({_F1}, 6) AS macro_f1 FROM c")
def confusion(spark, d):
    return r6(M.confusion(V.scores(spark, d), KEYS, 0.6), "accuracy", "macro_f1")


@query(
    "a6_classification_report",
    """WITH c AS (SELECT l_returnflag AS y, CASE WHEN l_quantity > 30 THEN 'R' WHEN l_quantity > 15 THEN 'A' ELSE 'N' END AS p, count(*) AS c FROM lineitem GROUP BY ALL),
l AS (SELECT y AS label FROM c UNION SELECT p FROM c),
t AS (SELECT label, (SELECT coalesce(sum(c), 0) FROM c WHERE y = label AND p = label) AS tp, (SELECT coalesce(sum(c), 0) FROM c WHERE y = label) AS s, (SELECT coalesce(sum(c), 0) FROM c WHERE p = label) AS h FROM l),
u AS (SELECT label, coalesce(tp / nullif(h, 0), 0) AS precision, coalesce(tp / nullif(s, 0), 0) AS recall, coalesce(2 * tp / nullif(s + h, 0), 0) AS f1, s, tp FROM t),
a AS (SELECT label, precision, recall, f1, s FROM u UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(s) FROM u
 UNION ALL SELECT 'weighted avg', sum(precision * s) / sum(s), sum(recall * s) / sum(s), sum(f1 * s) / sum(s), sum(s) FROM u
 UNION ALL SELECT 'accuracy', sum(tp) / sum(s), sum(tp) / sum(s), sum(tp) / sum(s), sum(s) FROM u)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, s::BIGINT AS support FROM a""",
)
def report(spark, d):
    from .registry import table

    li = table(spark, d, "lineitem")
    pred = li.select(F.col("l_returnflag").alias("y"), F.when(F.col("l_quantity") > 30, "R").when(F.col("l_quantity") > 15, "A").otherwise("N").alias("pred"))
    return r6(M.classification_report(pred, []), "precision", "recall", "f1")


_Q = """q AS (SELECT layer, split, quantile_cont(score, 0.99) FILTER (y = 0) AS tau, quantile_cont(score, 1 - 0.9 * 0.01) FILTER (y = 0) AS tight, avg(score) FILTER (y = 0) AS mn, stddev_samp(score) FILTER (y = 0) AS sn, avg(score) AS ma, stddev_samp(score) AS sa FROM s GROUP BY ALL)"""
_AFTER = """SELECT q.layer, q.split, round(tau, 6) AS tau, round(count(*) FILTER (y = 0 AND score >= tau) / count(*) FILTER (y = 0), 6) AS fpr, round(count(*) FILTER (y = 1 AND score >= tau) / count(*) FILTER (y = 1), 6) AS tpr,
 round((tau - any_value(mn)) / ({neg}), 5) AS z_neg, round((tau - any_value(ma)) / ({all}), 5) AS z_all, true AS valid FROM s JOIN q ON s.layer = q.layer AND s.split = q.split GROUP BY q.layer, q.split, tau"""
_EPS = {"neg": "any_value(sn) + 1e-8", "all": "any_value(sa) + 1e-8"}
_SAFE = {"neg": "any_value(sn)", "all": "any_value(sa)"}


def z5(df):
    return r6(df, "tau", "fpr", "tpr").withColumns({c: F.round(c, 5) for c in ("z_neg", "z_all") if c in df.columns})


@query("a7_quantile_threshold", f"WITH {S}, {_Q} {_AFTER.format(**_EPS)}")
def quantile(spark, d):
    return z5(M.quantile_threshold(V.scores(spark, d), KEYS))


_ADJ = f"""q0 AS (SELECT * FROM q), f AS (SELECT q0.layer, q0.split, i, tau + 0.001 * sn * i AS t, count(*) FILTER (s.score >= tau + 0.001 * sn * i) / count(*) AS fpr
 FROM q0 JOIN s ON s.layer = q0.layer AND s.split = q0.split AND y = 0, (SELECT unnest([0.0, 1.0, 1.5, 2.0, 3.0, 5.0]) AS i) GROUP BY q0.layer, q0.split, i, tau, sn),
b AS (SELECT layer, split, min_by(t, i) AS t FROM f WHERE fpr <= 0.01 GROUP BY ALL), qa AS (SELECT q0.* REPLACE (coalesce(b.t, q0.tight) AS tau) FROM q0 LEFT JOIN b ON b.layer = q0.layer AND b.split = q0.split)"""


@query("a8_quantile_threshold_adjusted", f"WITH {S}, {_Q}, {_ADJ} {_AFTER.format(**_EPS).replace('JOIN q ON', 'JOIN qa q ON')}")
def adjusted(spark, d):
    return z5(M.quantile_threshold(V.scores(spark, d), KEYS, adjust=True))


@query("a9_quantile_threshold_external", f"WITH {S}, {_Q} {_AFTER.format(**_SAFE)}")
def external(spark, d):
    return z5(M.quantile_threshold(V.scores(spark, d), KEYS, z="safe"))


_TAUS = "t AS (SELECT layer, quantile_cont(score, 0.99) FILTER (y = 0) AS tau FROM s WHERE split = 'val' GROUP BY layer)"


def taus(spark, d):
    s = V.scores(spark, d)
    return s, M.quantile_threshold(s.where("split = 'val'"), ["layer"]).select("layer", "tau")


@query(
    "a10_evaluate_at",
    f"""WITH {S}, {_TAUS} SELECT s.layer, round(tau, 6) AS tau, round(count(*) FILTER (y = 1 AND score >= tau) / greatest(count(*) FILTER (y = 1), 1), 6) AS tpr, round(count(*) FILTER (y = 0 AND score >= tau) / greatest(count(*) FILTER (y = 0), 1), 6) AS fpr,
 round((tau - avg(score)) / (stddev_samp(score) + 1e-8), 5) AS z_all FROM s JOIN t ON s.layer = t.layer WHERE split = 'test' GROUP BY s.layer, tau""",
)
def evaluate(spark, d):
    s, t = taus(spark, d)
    return z5(M.evaluate_at(s.where("split = 'test'"), t, ["layer"]))


_BIN = "CASE WHEN score >= 0 AND score <= 1 THEN CASE WHEN (k + 1) * (1 / 50.0::DOUBLE) <= score AND k < 49 THEN k + 1 WHEN score < k * (1 / 50.0::DOUBLE) THEN k - 1 ELSE k END END"
_HIST = f"h AS (SELECT *, {_BIN} AS bin FROM (SELECT *, least(floor(score * 50), 49)::INT AS k FROM s))"


@query(
    "a13_score_histogram",
    f"""WITH {S}, {_HIST}, g AS (SELECT layer, split, avg(score) AS mean, stddev_pop(score) AS std FROM s GROUP BY ALL), b AS (SELECT unnest(range(50))::INT AS bin)
SELECT g.layer, g.split, b.bin, (SELECT count(*) FROM h WHERE h.layer = g.layer AND h.split = g.split AND h.bin = b.bin) AS count, round(mean, 6) AS mean, round(std, 6) AS std FROM g, b""",
)
def histogram(spark, d):
    return r6(M.score_histogram(V.scores(spark, d), KEYS), "mean", "std")


_KL = f"""{_HIST}, x AS (SELECT layer, 'all' AS part, split, bin FROM h UNION ALL SELECT layer, CASE WHEN y = 1 THEN 'pos' ELSE 'neg' END, split, bin FROM h),
b AS (SELECT layer, part, unnest(range(50))::INT AS bin FROM (SELECT DISTINCT layer, part FROM x)),
c AS (SELECT b.layer, b.part, b.bin, count(*) FILTER (split = 'val') AS p, count(*) FILTER (split = 'test') AS q FROM b LEFT JOIN x ON b.layer = x.layer AND b.part = x.part AND b.bin = x.bin AND x.split IN ('val', 'test') GROUP BY ALL),
n AS (SELECT layer, part, greatest(p / sum(p) OVER w, 1e-12) AS p, greatest(q / sum(q) OVER w, 1e-12) AS q FROM c WINDOW w AS (PARTITION BY layer, part)),
kl AS (SELECT layer, part, sum(p * ln(p / q)) / sum(p) + ln(sum(q) / sum(p)) AS kl FROM n GROUP BY ALL)"""


@query("a14_kl_drift", f"WITH {S}, {_KL} SELECT layer, part, round(kl, 6) AS kl FROM kl")
def kl(spark, d):
    return r6(M.kl_drift(V.scores(spark, d), ["layer"], "val", "test"), "kl")


@query("w5_kl_alerts", f"WITH {S}, {_KL} SELECT layer, part, round(kl, 6) AS kl, round(avg(kl) OVER w + 1.5 * coalesce(stddev_samp(kl) OVER w, 0), 6) AS threshold, kl > avg(kl) OVER w + 1.5 * coalesce(stddev_samp(kl) OVER w, 0) AS alert FROM kl WINDOW w AS (PARTITION BY part)")
def alerts(spark, d):
    return r6(M.kl_alerts(M.kl_drift(V.scores(spark, d), ["layer"], "val", "test"), ["part"]), "kl", "threshold")


@query("w6_normalize_scores", f"WITH {SF} SELECT layer, split, y, round(CASE WHEN hi - lo < 1e-8 THEN 0.5 ELSE (score - lo) / (hi - lo) END, 6) AS score FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM s WINDOW w AS (PARTITION BY layer, split))")
def normalize(spark, d):
    return r6(M.normalize_scores(V.scores(spark, d, True), KEYS), "score")


_SEL = f"""{_TAUS}, i AS (SELECT s.layer, split, tau, count(*) FILTER (y = 1 AND score >= tau) / greatest(count(*) FILTER (y = 1), 1) AS tpr, count(*) FILTER (y = 0 AND score >= tau) / greatest(count(*) FILTER (y = 0), 1) AS fpr,
 (tau - avg(score)) / (stddev_samp(score) + 1e-8) AS z FROM s JOIN t ON s.layer = t.layer GROUP BY s.layer, split, tau),
sel AS (SELECT a.layer, a.tpr AS tpr_id, b.tpr AS tpr_ood, a.z AS z_id, b.z AS z_ood, a.fpr AS fpr_id, b.fpr AS fpr_ood, least(a.tpr, b.tpr) - 0.1 * abs(a.z - b.z) AS selection_score FROM i a JOIN i b ON a.layer = b.layer AND a.split = 'val' AND b.split = 'test')"""


def id_ood(spark, d):
    s, t = taus(spark, d)
    a, b = (M.evaluate_at(s.where(F.col("split") == x), t, ["layer"]) for x in ("val", "test"))
    a = a.select("layer", F.col("tpr").alias("tpr_id"), F.col("z_all").alias("z_id"), F.col("fpr").alias("fpr_id"))
    return a.join(b.select("layer", F.col("tpr").alias("tpr_ood"), F.col("z_all").alias("z_ood"), F.col("fpr").alias("fpr_ood")), "layer")


@query("w7_selection_score", f"WITH {S}, {_SEL} SELECT layer, round(tpr_id, 6) AS tpr_id, round(tpr_ood, 6) AS tpr_ood, round(selection_score, 6) AS selection_score FROM sel")
def selection(spark, d):
    return r6(M.selection_score(id_ood(spark, d)).select("layer", "tpr_id", "tpr_ood", "selection_score"), "tpr_id", "tpr_ood", "selection_score")


@query("w8_best_layer", f"WITH {S}, {_SEL} SELECT 1 AS run, layer, round(selection_score, 6) AS selection_score FROM sel ORDER BY round(selection_score, 9) DESC, layer LIMIT 1")
def best(spark, d):
    m = M.selection_score(id_ood(spark, d)).withColumn("selection_score", F.round("selection_score", 9)).withColumn("run", F.lit(1))
    return r6(M.best_layer(m, ["run"]).select("run", "layer", "selection_score"), "selection_score")


@query("w9_delta_tau", f"WITH {S}, {_Q}, {_ADJ} SELECT a.layer, round(a.tau, 6) AS tau_base, round(b.tau, 6) AS tau_target, round(b.tau - a.tau, 6) AS delta_tau FROM qa a JOIN qa b ON a.layer = b.layer AND a.split = 'val' AND b.split = 'test'")
def shift(spark, d):
    return r6(M.delta_tau(V.scores(spark, d), ["layer"], "val", "test"), "tau_base", "tau_target", "delta_tau")


@query("w10_bootstrap_ci", f"WITH {S}, {_TAUS} SELECT s.layer, y, count(*) AS m, round(avg(CASE WHEN score >= tau THEN 1 ELSE 0 END), 6) AS rate, true AS covers FROM s JOIN t ON s.layer = t.layer WHERE split = 'test' GROUP BY s.layer, y")
def bootstrap(spark, d):
    """The interval is drawn; what is fixed is that it holds the rate and is as wide as the binomial's."""
    s, t = taus(spark, d)
    out = M.bootstrap_ci(s.where("split = 'test'"), t, ["layer"])
    wide = 2 * 1.96 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("m")) + 2 / F.col("m")
    return out.select("layer", "y", "m", F.round("rate", 6).alias("rate"), ((F.col("lo") <= F.col("rate")) & (F.col("rate") <= F.col("hi")) & (F.col("hi") - F.col("lo") <= 1.5 * wide)).alias("covers"))


@query("p8_false_positives", f"WITH x AS (SELECT doc_id AS sample_id, toxic AS y, (n_chars % 1000) / 1000.0::DOUBLE AS score, source AS family, n_chars FROM documents JOIN labels USING (doc_id)) SELECT sample_id, y, round(score, 6) AS score, family, n_chars FROM x WHERE y = 0 AND score >= 0.8")
def fps(spark, d):
    from .registry import table

    docs = table(spark, d, "documents")
    s = docs.join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("sample_id"), F.col("toxic").alias("y"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"))
    return R.false_positives(s, docs.select(F.col("doc_id").alias("sample_id"), F.col("source").alias("family"), "n_chars"), 0.8)


@query("a22_scores_by_family", "WITH x AS (SELECT source AS family, (n_chars % 1000) / 1000.0::DOUBLE AS score FROM documents) SELECT family, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.75), 6) AS p75 FROM x GROUP BY family")
def by_family(spark, d):
    from .registry import table

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("family"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"))
    return r6(R.scores_by_family(docs.select("sample_id", "score"), docs, "sample_id"), "mean", "std", "p25", "p50", "p75")


_FLAG = f"""{_SEL}, {_Q.replace('q AS', 'qq AS')}, m AS (SELECT layer, split, {_CM} FROM s WHERE split = 'test' GROUP BY ALL),
cc AS (SELECT layer, score, sum(y) AS pos, sum(1 - y) AS neg FROM s WHERE split = 'test' GROUP BY ALL), pp AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER g AS p, sum(neg) OVER g AS n FROM cc WINDOW w AS (PARTITION BY layer ORDER BY score DESC), g AS (PARTITION BY layer)),
au AS (SELECT layer, sum(neg * (tp - pos + pos / 2)) / (max(p) * max(n)) AS auroc, sum(pos * (tp / (tp + fp))) / max(p) AS aupr FROM pp GROUP BY layer),
lm AS (SELECT sel.layer, round({_F1}, 6) AS macro_f1, round(auroc, 6) AS auroc, round(aupr, 6) AS aupr, tpr_id, tpr_ood, fpr_id, fpr_ood FROM sel JOIN m ON sel.layer = m.layer JOIN au ON au.layer = sel.layer)"""


def layer_metrics(spark, d):
    test = V.scores(spark, d).where("split = 'test'")
    k = ["layer"]
    m = M.confusion(test, k, 0.6).select("layer", F.round("macro_f1", 6).alias("macro_f1"))
    m = m.join(r6(M.auroc(test, k), "auroc"), "layer").join(r6(M.average_precision(test, k), "average_precision").withColumnRenamed("average_precision", "aupr"), "layer")
    return m.join(id_ood(spark, d), "layer")


@query(
    "a21_layer_report",
    f"""WITH {S}, {_FLAG}, o AS (SELECT *, row_number() OVER (ORDER BY layer) AS i, count(*) OVER () AS n FROM lm)
SELECT 1 AS run, arg_min(layer, (-macro_f1, layer)) AS best_macro_f1_layer, arg_min(layer, (macro_f1, layer)) AS worst_macro_f1_layer, round(avg(macro_f1), 6) AS mean_macro_f1,
 arg_min(layer, (-auroc, layer)) AS best_auroc_layer, arg_min(layer, (auroc, layer)) AS worst_auroc_layer, round(avg(auroc), 6) AS mean_auroc,
 arg_min(layer, (-aupr, layer)) AS best_aupr_layer, arg_min(layer, (aupr, layer)) AS worst_aupr_layer, round(avg(aupr), 6) AS mean_aupr,
 bool_and(abs(tpr_id - tpr_ood) < 0.001 AND abs(fpr_id - fpr_ood) < 0.001) AS id_equals_ood, bool_and(fpr_id <= 0.015) AS fpr_controlled,
 round(avg(macro_f1) FILTER (i <= 5), 6) AS first_mean, round(avg(macro_f1) FILTER (i > n - 5), 6) AS last_mean, avg(macro_f1) FILTER (i > n - 5) > avg(macro_f1) FILTER (i <= 5) AS deep_is_better,
 CASE WHEN arg_min(layer, (-macro_f1, layer)) = max(layer) THEN 'deepest' WHEN arg_min(layer, (-macro_f1, layer)) <= 3 THEN 'shallow' ELSE 'middle' END AS best_position,
 CASE WHEN max(macro_f1) >= 0.95 THEN 'excellent' WHEN max(macro_f1) >= 0.9 THEN 'good' WHEN max(macro_f1) >= 0.85 THEN 'fair' ELSE 'poor' END AS f1_band,
 CASE WHEN arg_min(auroc, (-macro_f1, layer)) >= 0.98 THEN 'excellent' WHEN arg_min(auroc, (-macro_f1, layer)) >= 0.95 THEN 'good' WHEN arg_min(auroc, (-macro_f1, layer)) >= 0.9 THEN 'fair' ELSE 'poor' END AS auroc_band FROM o""",
)
def layer_report(spark, d):
    out = R.layer_report(layer_metrics(spark, d).withColumn("run", F.lit(1)))
    return r6(out, "mean_macro_f1", "mean_auroc", "mean_aupr", "first_mean", "last_mean")


_LM = f"WITH {S}, lm AS (SELECT split, layer, avg(score) AS mean_score, avg(y) AS rate FROM s GROUP BY ALL)"


def split_metrics(spark, d):
    return V.scores(spark, d).groupBy("split", "layer").agg(F.avg("score").alias("mean_score"), F.avg("y").alias("rate"))


@query(
    "a18_aggregate_seeds",
    f"{_LM}, u AS (SELECT split, layer, 'mean_score' AS metric, mean_score AS value FROM lm UNION ALL SELECT split, layer, 'rate', rate FROM lm) SELECT split, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(stddev_pop(value), 6) AS std_pop, round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) AS n FROM u GROUP BY ALL",
)
def seeds(spark, d):
    out = R.aggregate_seeds(split_metrics(spark, d), ["split"], ["mean_score", "rate"], seed="layer")
    return r6(out.withColumn("n", F.size("values").cast("long")).drop("values"), "mean", "std", "std_pop", "min", "max")


@query("a19_family_mean", f"{_LM} SELECT split, CASE WHEN grouping(layer) = 1 THEN '_mean' ELSE layer::VARCHAR END AS layer, round(avg(mean_score), 6) AS mean_score, round(avg(rate), 6) AS rate FROM lm GROUP BY GROUPING SETS ((split, layer), (split))")
def families(spark, d):
    m = split_metrics(spark, d).withColumn("layer", F.col("layer").cast("string"))
    return r6(R.family_mean(m, ["mean_score", "rate"], method="split", family="layer"), "mean_score", "rate")


@query("a20_layer_stability", f"{_LM}, b AS (SELECT 'lineitem' AS model, split, arg_max(layer, (round(rate, 9), -layer)) AS layer FROM lm GROUP BY split) SELECT model, array_to_string(list(layer ORDER BY split), ',') AS layers, round(avg(layer), 2) AS mean, round(stddev_pop(layer), 2) AS std, min(layer) AS min, max(layer) AS max FROM b GROUP BY model")
def stability(spark, d):
    best = split_metrics(spark, d).withColumn("rate", F.round("rate", 9))
    best = M.best_layer(best, ["split"], by="rate").withColumn("model", F.lit("lineitem"))
    return R.layer_stability(best, fold="split").withColumn("layers", F.array_join(F.transform("layers", lambda x: x.cast("string")), ","))


@query("j7_compare_conditions", f"{_LM} SELECT a.layer, a.split AS condition, round(b.mean_score - a.mean_score, 6) AS drop_mean_score, round(b.rate - a.rate, 6) AS drop_rate, round((b.mean_score - a.mean_score) * 100, 2) AS pp_mean_score, round((b.rate - a.rate) * 100, 2) AS pp_rate FROM lm a JOIN lm b ON a.layer = b.layer AND b.split = 'train' WHERE a.split <> 'train'")
def conditions(spark, d):
    m = split_metrics(spark, d).withColumnRenamed("split", "condition")
    return R.compare_conditions(m, "train", ["mean_score", "rate"], ["layer"])


@query("j8_variant_delta", f"{_LM} SELECT layer, split AS variant, round(mean_score, 6) AS score, round(mean_score - max(CASE WHEN split = 'train' THEN mean_score END) OVER (PARTITION BY layer), 6) AS score_delta FROM lm")
def variants(spark, d):
    m = split_metrics(spark, d).select("layer", F.col("split").alias("variant"), F.col("mean_score").alias("score"))
    return r6(R.variant_delta(m, ["layer"], base="train"), "score", "score_delta")
