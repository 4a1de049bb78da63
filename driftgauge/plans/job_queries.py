"""Queries that fit heads, run whole jobs, or write and read tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import manifest as MF
from ..operators import features as X
from ..operators import metrics as M
from ..operators import models as L
from ..operators import splits as P
from ..operators.common import scratch
from ..sources import corpus as S
from . import jobs as J
from . import metric_queries as MQ
from . import views as V
from .registry import query, table


def emb_split(spark, d):
    """Embedding layers and a train/val/test split of their samples."""
    e = V.layer_emb(spark, d)
    ids = e.where("layer = 1").select("sample_id", "y")
    return e, P.stratified_split(ids, {"train": 0.6, "val": 0.2, "test": 0.2}, "y", "sample_id").select("sample_id", "split")


def one_layer(spark, d):
    e, s = emb_split(spark, d)
    return e.where("layer = 2").join(s, "sample_id").select("sample_id", "y", "split", F.col("embedding").alias("features"))


@query("m1_fit_logreg")
def logreg(spark, d):
    rows = one_layer(spark, d)
    return L.fit_logreg(rows.where("split = 'train'")).score(rows.where("split = 'test'")).select("sample_id", "y", "score")


@query("m2_select_c")
def select_c(spark, d):
    rows = one_layer(spark, d)
    c, head = L.select_c(rows.where("split = 'train'"), rows.where("split = 'val'"))
    return head.score(rows.where("split = 'test'")).select("sample_id", "y", "score", F.lit(c).alias("c"))


@query("m2_select_gamma_cv")
def select_gamma(spark, d):
    rows = one_layer(spark, d)
    return rows.groupBy("y").agg(F.count("*").alias("n")).withColumn("gamma", F.lit(L.select_gamma_cv(rows.select("sample_id", "y", "features"))))


@query("m3_fit_ridge")
def ridge(spark, d):
    rows = one_layer(spark, d)
    return M.normalize_scores(L.fit_ridge(rows.where("split = 'train'")).score(rows.where("split = 'test'")).select("split", "sample_id", "y", "score"), ["split"])


@query("m3_cv_ridge")
def ridge_cv(spark, d):
    return L.cv_ridge(one_layer(spark, d).drop("split"), [])


@query("m2_select_c_groups")
def select_c_groups(spark, d):
    """Every layer's C by the rate at a low false-positive rate, all layers at once."""
    e, s = emb_split(spark, d)
    rows = e.join(s, "sample_id").select("layer", "sample_id", "y", "split", F.col("embedding").alias("features"))
    return L.grouped_logreg(rows, ["layer"], balanced=False, metric="tpr_0_001").where("split = 'test'").select("layer", "sample_id", "y", "c", "score")


@query("m4_cv_scores")
def cv(spark, d):
    return L.cv_scores(one_layer(spark, d).drop("split"), [])


@query("m5_compare_classifiers")
def classifiers(spark, d):
    rows = one_layer(spark, d)
    return L.compare_classifiers(rows.where("split = 'train'"), rows.where("split = 'test'"))


@query("m6_fit_mlp")
def mlp(spark, d):
    rows = one_layer(spark, d)
    return L.fit_mlp(rows.where("split = 'train'")).score(rows.where("split = 'test'")).select("sample_id", "y", "score")


@query("m7_family_drift")
def drift(spark, d):
    e = V.layer_emb(spark, d).where("layer = 1").select("sample_id", "family", F.col("embedding").alias("features"))
    return L.family_drift(e.where("sample_id % 2 = 0"), e.where("sample_id % 2 = 1"))


@query("m8_text_baseline")
def text(spark, d):
    r = V.reports(spark, d).select("sample_id", F.col("label").alias("y"), "text")
    return L.text_baseline(r.where("sample_id % 5 > 0"), r.where("sample_id % 5 = 0"), "sample_id")


@query("m8_text_cv")
def text_cv(spark, d):
    return L.text_cv(V.reports(spark, d).select("sample_id", F.col("label").alias("y"), "text"), "sample_id")


@query("m8_text_folds")
def text_folds(spark, d):
    r = V.reports(spark, d).select("sample_id", F.col("label").alias("y"), "text", "lang")
    held = r.select(F.col("lang").alias("fold")).distinct()
    folds = r.select("sample_id", "lang").crossJoin(held).select("fold", "sample_id", F.when(F.col("lang") == F.col("fold"), "test").otherwise("train").alias("split"))
    return L.text_folds(r.drop("lang"), folds, "sample_id")


@query("e1_layer_profile")
def profile(spark, d):
    return J.layer_profile(*emb_split(spark, d))


_S2 = V.scores_sql().replace("s AS (", "s0 AS (", 1) + ", s AS (SELECT * REPLACE (CASE split WHEN 'val' THEN 'val_id' WHEN 'train' THEN 'val_ood' ELSE 'test' END AS split) FROM s0)"
_KL2 = re.sub(r"\bb\b", "kb", MQ._KL).replace("split = 'val')", "split = 'val_id')").replace("split = 'test')", "split = 'val_ood')").replace("IN ('val', 'test')", "IN ('val_id', 'val_ood')")
_CM2 = "count(*) FILTER (y = 0 AND score < tau) AS tn, count(*) FILTER (y = 0 AND score >= tau) AS fp, count(*) FILTER (y = 1 AND score < tau) AS fn, count(*) FILTER (y = 1 AND score >= tau) AS tp"


@query(
    "e2_select_layer",
    f"""WITH {_S2}, {MQ._Q}, {MQ._ADJ}, {_KL2}, a AS (SELECT layer, tau FROM qa WHERE split = 'val_id'),
r AS (SELECT s.layer, s.split, tau, {_CM2}, (tau - avg(score)) / (stddev_samp(score) + 1e-8) AS z FROM s JOIN a ON a.layer = s.layer GROUP BY s.layer, s.split, tau),
v AS (SELECT layer, split, tau, z, tp / (tp + fn) AS tpr, fp / (fp + tn) AS fpr, {MQ._F1} AS macro_f1 FROM r),
o AS (SELECT i.layer, i.tau, i.tpr AS tpr_id, i.fpr AS fpr_id, i.z AS z_id, x.tpr AS tpr_ood, x.fpr AS fpr_ood, x.z AS z_ood, t.tpr AS tpr_test, t.fpr AS fpr_test, i.macro_f1, kl.kl,
 least(i.tpr, x.tpr) - 0.1 * abs(i.z - x.z) AS selection_score FROM v i JOIN v x ON x.layer = i.layer AND x.split = 'val_ood' JOIN v t ON t.layer = i.layer AND t.split = 'test' JOIN kl ON kl.layer = i.layer AND kl.part = 'all' WHERE i.split = 'val_id'),
w AS (SELECT *, avg(kl) OVER () + 1.5 * coalesce(stddev_samp(kl) OVER (), 0) AS kl_threshold, row_number() OVER (ORDER BY selection_score DESC, layer) = 1 AS chosen FROM o)
SELECT layer, round(tau, 6) AS tau, round(tpr_id, 6) AS tpr_id, round(fpr_id, 6) AS fpr_id, round(z_id, 5) AS z_id, round(tpr_ood, 6) AS tpr_ood, round(fpr_ood, 6) AS fpr_ood, round(z_ood, 5) AS z_ood, round(tpr_test, 6) AS tpr_test, round(fpr_test, 6) AS fpr_test,
 round(kl, 6) AS kl, round(macro_f1, 6) AS macro_f1, round(selection_score, 5) AS selection_score, round(kl_threshold, 6) AS kl_threshold, kl > kl_threshold AS kl_alert, chosen FROM w""",
)
def choose(spark, d):
    s = V.scores(spark, d)
    half = F.when(F.col("split") == "val", "val_id").when(F.col("split") == "train", "val_ood").otherwise("test")
    out = J.select_layer(s.withColumn("split", half), [])
    out = MQ.r6(out, "tau", "tpr_id", "fpr_id", "tpr_ood", "fpr_ood", "tpr_test", "fpr_test", "kl", "macro_f1", "kl_threshold")
    return out.withColumns({c: F.round(c, 5) for c in ("z_id", "z_ood", "selection_score")})


def _folds(spark, d):
    e = V.layer_emb(spark, d)
    ids = e.where("layer = 1").select("sample_id", "family", "y")
    top = P.top_families(ids, 3, seen="sample_id")
    folds = P.lofo_folds(ids, top, 0.2, "sample_id")
    # a family has one class here; every fifth sample of the others stands in for the test negatives
    test = F.when((F.col("sample_id") % 5 == 0) & (F.col("split") == "train"), "test").otherwise(F.col("split"))
    return e, folds.select(F.col("held_out_family").cast("string").alias("fold"), "sample_id", test.alias("split"))


@query("e3_family_profile")
def family_profile(spark, d):
    return J.family_profile(*_folds(spark, d))[0]


@query("e3_layer_stability")
def family_stability(spark, d):
    return J.family_profile(*_folds(spark, d))[1]


@query("e4_cv_layers")
def cv_layers(spark, d):
    return J.cv_layers(V.layer_emb(spark, d))


@query(
    "e5_evaluate_scores",
    f"""WITH {MQ.S}, {MQ._Q}, {MQ.CURVE}, x AS ({MQ._AFTER.format(**MQ._SAFE)}), au AS (SELECT layer, split, sum(neg * (tp - pos + pos / 2)) / (max(p) * max(n)) AS auroc, sum(pos * (tp / (tp + fp))) / max(p) AS ap FROM p GROUP BY ALL),
m AS (SELECT s.layer, s.split, {_CM2} FROM s JOIN q ON s.layer = q.layer AND s.split = q.split GROUP BY s.layer, s.split)
SELECT x.*, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy, round({MQ._F1}, 6) AS macro_f1, round(auroc, 6) AS auroc, round(ap, 6) AS average_precision FROM x JOIN m ON m.layer = x.layer AND m.split = x.split JOIN au ON au.layer = x.layer AND au.split = x.split""",
)
def evaluate(spark, d):
    out = J.evaluate_scores(V.scores(spark, d), ["layer", "split"], z="safe", adjust=False)
    return MQ.z5(MQ.r6(out, "accuracy", "macro_f1", "auroc", "average_precision"))


@query(
    "e6_fold_thresholds",
    """WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, value / 1000 AS score FROM events),
f AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5('42:' || event_id), event_id) - 1) % 5 AS fold FROM s), h AS (SELECT unnest(range(5)) AS held),
t AS (SELECT held, quantile_cont(score, 0.99) FILTER (y = 0) AS tau FROM f, h WHERE fold <> held GROUP BY held),
g AS (SELECT held, tau, count(*) FILTER (y = 1 AND score >= tau) / greatest(count(*) FILTER (y = 1), 1) AS tpr, count(*) FILTER (y = 0 AND score >= tau) / greatest(count(*) FILTER (y = 0), 1) AS fpr, (tau - avg(score)) / stddev_samp(score) AS z_all FROM f JOIN t ON fold = held GROUP BY held, tau),
u AS (SELECT 'tau' AS metric, tau AS v FROM g UNION ALL SELECT 'tpr', tpr FROM g UNION ALL SELECT 'fpr', fpr FROM g UNION ALL SELECT 'z_all', z_all FROM g)
SELECT metric, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, round(stddev_pop(v), 5) AS std_pop, round(min(v), 5) AS min, round(max(v), 5) AS max, count(*) AS n FROM u GROUP BY metric""",
)
def folds(spark, d):
    s = table(spark, d, "events").select(F.col("event_id").alias("sample_id"), (F.col("event_type") == "error").cast("int").alias("y"), (F.col("value") / 1000).alias("score"))
    out = J.fold_thresholds(s, 5, "sample_id")
    return out.select("metric", *[F.round(c, 5).alias(c) for c in ("mean", "std", "std_pop", "min", "max")], F.size("values").cast("long").alias("n"))


@query("e7_identifier_ablation")
def ablation(spark, d):
    r = V.reports(spark, d).select("sample_id", F.col("label").alias("y"), "text")
    split = r.select("sample_id", F.when(F.col("sample_id") % 5 == 0, "test").otherwise("train").alias("split"))
    return J.identifier_ablation(r, split)


@query("e7_identifier_ablation_layers")
def ablation_layers(spark, d):
    r = V.reports(spark, d).select("sample_id", F.col("label").alias("y"), "text")
    k = F.col("sample_id") % 5
    split = r.select("sample_id", F.when(k == 0, "test").when(k == 1, "val").otherwise("train").alias("split"))
    return J.identifier_ablation_layers(r, split, X.hash_encoder())


@query("e8_masking_report", V.VARIANTS_SQL + f", {V.COUNTED_SQL} SELECT sample_id, variant, approx_tokens, token_delta, {V.INDICATORS_SQL} FROM counted")
def masking(spark, d):
    return J.masking_report(V.section_reports(spark, d))


_PREP = """r AS (SELECT doc_id AS sample_id, lang || '/' || source || '/' || doc_id || '.md' AS path, toxic FROM documents JOIN labels USING (doc_id)),
m AS (SELECT event_id::VARCHAR AS sample_id, ts AS first_seen, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, path AS report_path, CASE WHEN ts <= TIMESTAMP '2024-01-20' THEN 'train' WHEN ts <= TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END AS split FROM events JOIN r ON r.sample_id = event_id)"""


@query("e9_prepare_dataset", f"WITH {_PREP} SELECT split, count(*) AS n, count(*) FILTER (label = 1) AS positives, round(avg(label), 6) AS rate FROM m GROUP BY split")
def prepare(spark, d):
    from .split_queries import T1, T2

    man = V.manifest(spark, d).withColumn("sample_id", F.col("sample_id").cast("string")).withColumn("md_path", F.lit(None).cast("string"))
    return J.prepare_dataset(man, V.reports(spark, d), T1, T2)[1].withColumn("rate", F.round("rate", 6))


@query(
    "e9_prepare_drift_dataset",
    """WITH r AS (SELECT source AS family, CASE WHEN doc_id % 2 = 0 THEN 'pre-drift' ELSE 'post-drift' END AS state FROM documents JOIN labels USING (doc_id))
SELECT state, family, count(*) AS n, grouping(state, family)::BIGINT AS level FROM r GROUP BY GROUPING SETS ((state), (family, state), ())""",
)
def prepare_drift(spark, d):
    r = V.reports(spark, d)
    state = F.when(F.col("sample_id") % 2 == 0, "pre-drift").otherwise("post-drift")
    labels = r.select(F.col("sample_id").cast("string").alias("sha256"), "family", "label", state.alias("state"))
    return J.prepare_drift_dataset(labels, r)[1]


@query(
    "e9_prepare_family_dataset",
    """WITH f AS (SELECT event_type AS family, count(*) AS n, min(event_id) AS first FROM events WHERE event_type <> 'error' GROUP BY 1),
h AS (SELECT family AS held FROM f ORDER BY n DESC, first, family LIMIT 3),
v AS (SELECT family, n, CASE WHEN n <= 1 THEN 0 ELSE greatest(1, least(n - 1, round_even(n * 0.1, 0)::BIGINT)) END AS val FROM f),
c AS (SELECT held, 'test' AS split, n FROM h JOIN f ON family = held UNION ALL SELECT held, 'val', sum(val) FROM h, v WHERE family <> held GROUP BY held UNION ALL SELECT held, 'train', sum(n - val) FROM h, v WHERE family <> held GROUP BY held)
SELECT held AS held_out_family, split, 1 AS label, n::BIGINT AS n FROM c WHERE n > 0 UNION ALL SELECT held, split, 0, floor(n * 0.2)::BIGINT FROM c WHERE floor(n * 0.2) > 0""",
)
def prepare_family(spark, d):
    """A fifth as many benign rows: the pool of these is a quarter of the malicious ones here."""
    m = V.manifest(spark, d)
    return J.prepare_family_dataset(m.withColumn("label", 1 - F.col("label")), ratio=0.2)[1]


@query("s3_read_manifest", "SELECT event_id::VARCHAR AS sample_id, date_trunc('second', ts) AS first_seen, event_type AS family FROM events")
def read_manifest(spark, d):
    at = f"{scratch(spark)}.csv"
    e = table(spark, d, "events").select(F.col("event_id").alias("SHA256"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("First_Seen"), "event_type")
    e.write.option("header", "true").option("sep", ";").csv(at)
    rows = S.read_manifest(spark, at)
    return rows.select(MF.coalesce_aliases(rows, MF.ID_KEYS).alias("sample_id"), MF.normalise_timestamp(MF.coalesce_aliases(rows, MF.TIMESTAMP_KEYS)).alias("first_seen"), F.col("event_type").alias("family"))


@query("s1_read_reports", "SELECT lang, source, count(*)::BIGINT AS n_documents, (sum(strlen(text)) + count(*))::BIGINT AS size_bytes FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def read_reports(spark, d):
    """A file for each language and source, read back with its size; each text ends with a line break."""
    at = scratch(spark)
    docs = table(spark, d, "documents").where("text is not null")
    docs.select("lang", "source", "text").repartition("lang", "source").write.partitionBy("lang", "source").text(at)
    files = S.read_reports(spark, at, "*.txt")
    part = lambda c: F.regexp_extract("path", rf"/{c}=([^/]+)", 1)
    counts = docs.groupBy("lang", "source").agg(F.count("*").alias("n_documents"))
    per = files.groupBy(part("lang").alias("lang"), part("source").alias("source")).agg(F.sum("size_bytes").alias("size_bytes"))
    return counts.join(per, ["lang", "source"], "left").select("lang", "source", "n_documents", "size_bytes")


@query("s2_read_json_reports", "SELECT conv_id AS sample_id, count(*) AS n_calls FROM conversations GROUP BY conv_id")
def read_json(spark, d):
    """A JSON file for each conversation, read back by the reader of reports; about a hundred of them share a folder."""
    from ..operators import behavior as B

    at = scratch(spark)
    # a folder is written by one task, so that it is moved as a whole
    dealt = V.sandbox(spark, d).select(F.floor(F.col("sample_id") / 100).alias("folder"), "raw").repartition("folder")
    dealt.write.partitionBy("folder").option("maxRecordsPerFile", 1).text(at)
    rows = S.read_json_reports(spark, at, "*.txt").withColumn("sample_id", F.get_json_object("raw", "$.info.id").cast("long"))
    return B.extract_api_calls(rows).groupBy("sample_id").agg(F.count("*").alias("n_calls"))


@query(
    "s6_split_spec",
    """WITH d AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), f AS (SELECT unnest(['web', 'books']) AS fold, unnest([0, 1]) AS k)
SELECT fold, k::INT AS fold_index, CASE (i + k) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, count(*) AS n, sum(doc_id)::BIGINT AS ids, count(DISTINCT source) AS families FROM d, f GROUP BY ALL""",
)
def split_spec(spark, d):
    """A split file of all documents, written and read back."""
    from ..operators.prefix import hash_rank

    at = scratch(spark)
    docs = table(spark, d, "documents").select("doc_id", "source")
    ranked = hash_rank(docs.select("doc_id"), [], F.lpad(F.hex("doc_id"), 16, "0"), "doc_id").select("doc_id", (F.col("rank") - 1).alias("i"))
    k = F.explode(F.array(F.struct(F.lit("web").alias("fold"), F.lit(0).alias("fold_index")), F.struct(F.lit("books").alias("fold"), F.lit(1).alias("fold_index"))))
    folds = ranked.select("doc_id", "i", k.alias("f")).select("doc_id", "f.*", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), ((F.col("i") + F.col("f.fold_index")) % 3 + 1).cast("int")).alias("split"))
    path = F.concat(F.lit("/r/"), F.col("doc_id").cast("string"), F.lit(".md"))
    S.write_split_spec(docs.select("doc_id", path.alias("path"), F.lit(0).alias("label"), F.md5(F.col("doc_id").cast("string")).alias("sha256"), F.col("source").alias("family"), "source", F.lit("2024-01-01").alias("first_seen")), folds, at)
    known, read = S.read_split_spec(spark, at)
    rows = read.join(known.select("doc_id", "family"), "doc_id")
    return rows.groupBy("fold", "fold_index", "split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.count_distinct("family").alias("families"))


@query("s4_drift_labels", "SELECT md5(doc_id::VARCHAR) AS sha256, source AS family, toxic AS label, CASE WHEN doc_id % 2 = 0 THEN 'pre-drift' ELSE 'post-drift' END AS state FROM documents JOIN labels USING (doc_id)")
def drift_labels(spark, d):
    at = f"{scratch(spark)}.csv"
    r = V.reports(spark, d)
    state = F.when(F.col("sample_id") % 2 == 0, " Pre-Drift ").otherwise("POST-drift")
    r.select(F.upper(F.md5(F.col("sample_id").cast("string"))).alias("Malware SHA-256"), F.col("family").alias("Family"), F.col("label").alias("Label"), state.alias("State")).write.option("header", "true").csv(at)
    return S.read_drift_labels(spark, at)


@query("s5_read_embeddings", f"WITH {V.EMB} SELECT sample_id, layer::INT AS layer, y FROM e WHERE layer IN (2, 3)")
def embeddings(spark, d):
    at = scratch(spark)
    S.write_embeddings(V.layer_emb(spark, d), at)
    return S.read_embeddings(spark, at, [2, 3]).select("sample_id", F.col("layer").cast("int").alias("layer"), "y")


@query("s7_export_subsets", "SELECT lang AS subset, toxic AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def export(spark, d):
    at = scratch(spark)
    S.export_subsets(V.reports(spark, d).withColumnRenamed("lang", "subset"), at)
    return spark.read.parquet(at).groupBy("subset", F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))


@query("s8_write_index", "SELECT lang AS state, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def index(spark, d):
    at = scratch(spark)
    S.write_index(V.reports(spark, d).select("sample_id", "path", "label", F.col("lang").alias("state")), at)
    return spark.read.json(at).groupBy("state").agg(F.count("*").alias("n"), F.sum("sample_id").alias("ids"))


@query("s9_read_results", f"WITH {V.scores_sql()} SELECT split AS condition, layer, 'rate' AS metric, round(avg(y), 6) AS value FROM s GROUP BY ALL")
def results(spark, d):
    at = scratch(spark)
    m = V.scores(spark, d).groupBy("split", "layer").agg(F.avg("y").alias("rate"))
    per = m.groupBy("split").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("layer_"), F.col("layer").cast("string")), F.create_map(F.lit("rate"), "rate")))).alias("x"))
    per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("split", "x")))).alias("value")).write.text(at)
    return S.read_results(spark, at).select("condition", "layer", "metric", F.round("value", 6).alias("value"))


@query(
    "a17_mean_all_layers",
    f"WITH {V.EMB}, x AS (SELECT sample_id, layer, unnest(range(16)) AS i, unnest(embedding) AS v FROM e) SELECT sample_id, array_to_string(list(printf('%.4f', v) ORDER BY i), ' ') AS embedding FROM (SELECT sample_id, i, avg(v) AS v FROM x GROUP BY ALL) GROUP BY sample_id",
)
def mean_all(spark, d):
    out = X.pool_layers(V.layer_emb(spark, d), ["sample_id"])
    return out.withColumn("embedding", F.array_join(F.transform("embedding", lambda x: F.format_string("%.4f", x)), " "))
