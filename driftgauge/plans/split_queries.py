"""Queries over the manifest view: splits, folds, corpus joins and counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import manifest as MF
from ..operators import corpus as C
from ..operators import splits as P
from . import views as V
from .registry import query, table

M, RP = V.MANIFEST, V.REPORTS
T1, T2 = dt.datetime(2024, 1, 20), dt.datetime(2024, 1, 25)
HASH = "md5('42:' || sample_id)"


@query("d1_time_split", f"WITH {M} SELECT *, CASE WHEN first_seen <= TIMESTAMP '2024-01-20' THEN 'train' WHEN first_seen <= TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END AS split FROM m WHERE first_seen IS NOT NULL")
def time_split(spark, d):
    return P.time_split(V.manifest(spark, d), T1, T2)


@query(
    "d2_ratio_split",
    f"""WITH {M}, c AS (SELECT count(*) FILTER (first_seen <= TIMESTAMP '2024-01-20') AS a, count(*) FILTER (first_seen > TIMESTAMP '2024-01-20' AND first_seen <= TIMESTAMP '2024-01-25') AS b, count(*) FILTER (first_seen > TIMESTAMP '2024-01-25') AS c FROM m WHERE label = 1),
b AS (SELECT sample_id, row_number() OVER (ORDER BY {HASH}, sample_id) AS rank, count(*) OVER () AS n FROM m WHERE label = 0),
f AS (SELECT *, floor(n * a / (a + b + c)) AS fa, floor(n * b / (a + b + c)) AS fb, floor(n * c / (a + b + c)) AS fc FROM b, c),
g AS (SELECT *, n - fa - fb - fc AS l FROM f)
SELECT sample_id, CASE WHEN rank <= fa + (l > 0)::INT THEN 'train' WHEN rank <= fa + (l > 0)::INT + fb + (l > 1)::INT THEN 'val' ELSE 'test' END AS split FROM g""",
)
def ratio(spark, d):
    m = V.manifest(spark, d)
    mal = P.time_split(m.where("label = 1"), T1, T2)
    parts = mal.agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")])
    return P.ratio_split(m.where("label = 0").select("sample_id"), parts, "sample_id")


_ST = f"""x AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY {HASH}, sample_id) AS rank, count(*) OVER (PARTITION BY label) AS n FROM m)"""


def _largest(weights, size="n"):
    """DuckDB expressions of the largest-remainder sizes."""
    t = sum(weights.values())
    ks = list(weights)
    fl = [f"floor({size} * {weights[k] / t!r})" for k in ks]
    rest = [f"round({size} * {weights[k] / t!r} - {f}, 9)" for k, f in zip(ks, fl, strict=True)]
    left = f"({size} - {' - '.join(fl)})"
    out = []
    for i in range(len(ks)):
        ahead = " + ".join(f"({rest[j]} {'>=' if j > i else '>'} {rest[i]})::INT" for j in range(len(ks)) if j != i)
        out.append(f"({fl[i]} + (({ahead}) < {left})::INT)")
    return out


_A, _B, _C = _largest({"train": 0.8, "val": 0.1, "test": 0.1})


@query("d3_stratified_split", f"WITH {M}, {_ST} SELECT sample_id, label, CASE WHEN rank <= {_A} THEN 'train' WHEN rank <= {_A} + {_B} THEN 'val' ELSE 'test' END AS split FROM x")
def stratified(spark, d):
    return P.stratified_split(V.manifest(spark, d).select("sample_id", "label"), {"train": 0.8, "val": 0.1, "test": 0.1}, "label", "sample_id")


_H1 = _largest({"rest": 1 - 0.2, "test": 0.2})
_H2 = _largest({"train": 1 - 0.1 / (1 - 0.2), "val": 0.1 / (1 - 0.2)}, "n2")


@query(
    "d4_stratified_holdout",
    f"""WITH {M}, {_ST}, a AS (SELECT sample_id, label, rank > {_H1[0]} AS is_test FROM x), b AS (SELECT *, row_number() OVER w AS r2, count(*) OVER (PARTITION BY label, is_test) AS n2 FROM a WINDOW w AS (PARTITION BY label, is_test ORDER BY md5('43:' || sample_id), sample_id))
SELECT sample_id, label, CASE WHEN is_test THEN 'test' WHEN r2 <= {_H2[0]} THEN 'train' ELSE 'val' END AS split FROM b""",
)
def holdout(spark, d):
    return P.stratified_holdout(V.manifest(spark, d).select("sample_id", "label"), 0.1, 0.2, "label", "sample_id")


@query("d5_stratified_kfold", f"WITH {M}, {_ST} SELECT sample_id, label, ((rank - 1) % greatest(2, least(5, (SELECT min(n) FROM x))))::INT AS fold FROM x")
def kfold(spark, d):
    return P.stratified_kfold(V.manifest(spark, d).select("sample_id", "label"), 5, "label", "sample_id")


@query(
    "d6_stratified_limit",
    f"""WITH {M}, {_ST}, k AS (SELECT label, n, n * 500 / (SELECT count(*) FROM m) AS share FROM (SELECT DISTINCT label, n FROM x)),
l AS (SELECT *, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, label DESC) AS place, 500 - sum(floor(share)) OVER () AS left_over, sum(n) OVER () AS total FROM k)
SELECT x.sample_id, x.label FROM x JOIN l USING (label) WHERE rank <= CASE WHEN total <= 500 THEN total ELSE floor(share) + (place <= left_over)::INT END""",
)
def limit(spark, d):
    return P.stratified_limit(V.manifest(spark, d).select("sample_id", "label"), 500, "label", "sample_id")


@query("d7_limit_per_class", f"WITH {RP} SELECT sample_id, label, path FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY path) AS rn FROM r) WHERE rn <= 25")
def first_n(spark, d):
    return P.limit_per_class(V.reports(spark, d).select("sample_id", "label", "path"), 25, "label", "path")


@query("d8_partition_validation", f"WITH {M}, v AS (SELECT *, CASE WHEN first_seen <= TIMESTAMP '2024-01-20' THEN 'train' WHEN first_seen <= TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END AS split FROM m), x AS (SELECT *, row_number() OVER (PARTITION BY label, split ORDER BY {HASH}, sample_id) AS rank, count(*) OVER (PARTITION BY label, split) AS n FROM v) SELECT sample_id, label, CASE WHEN split <> 'val' THEN split WHEN rank <= {_largest({'a': 0.5, 'b': 0.5})[0]} THEN 'val_id' ELSE 'val_ood' END AS split FROM x")
def validation(spark, d):
    rows = P.time_split(V.manifest(spark, d), T1, T2).select("sample_id", "label", "split")
    return P.partition_validation(rows, "label", "sample_id")


@query("d9_top_families", f"WITH {RP} SELECT family, count(*) AS n, min(sample_id) AS first FROM r GROUP BY family ORDER BY n DESC, first LIMIT 5")
def families(spark, d):
    return P.top_families(V.reports(spark, d), 5, seen="sample_id")


_SEED = "(('0x' || substr(md5(h.family), 1, 8))::BIGINT + 42)"
_LOFO = f"""h AS (SELECT family, count(*) AS c, min(sample_id) AS f FROM m WHERE label = 0 GROUP BY family ORDER BY c DESC, f LIMIT 3),
x AS (SELECT h.family AS held_out_family, m.sample_id, m.family, row_number() OVER (PARTITION BY h.family, m.family ORDER BY md5({_SEED} || ':' || m.sample_id), m.sample_id) AS rank, count(*) OVER (PARTITION BY h.family, m.family) AS n FROM m, h WHERE m.label = 0),
lofo AS (SELECT held_out_family, sample_id, family, CASE WHEN family = held_out_family THEN 'test' WHEN rank <= CASE WHEN n <= 1 THEN 0 ELSE greatest(1, least(n - 1, round_even(n * 0.1, 0))) END THEN 'val' ELSE 'train' END AS split FROM x)"""


def _lofo(spark, d):
    rows = V.manifest(spark, d).where("label = 0")
    top = P.top_families(rows, 3, seen="sample_id")
    return P.lofo_folds(rows, top, 0.1, "sample_id")


@query("d10_lofo_folds", f"WITH {M}, {_LOFO} SELECT * FROM lofo")
def lofo(spark, d):
    return _lofo(spark, d)


_FEW = "n AS (SELECT held_out_family, (count(*) FILTER (split = 'train') // 40)::BIGINT AS train, (count(*) FILTER (split = 'val') // 40)::BIGINT AS val, (count(*) FILTER (split = 'test') // 40)::BIGINT AS test FROM lofo GROUP BY ALL)"


@query(
    "d11_balanced_negatives",
    f"""WITH {M}, {_LOFO}, {_FEW}, y AS (SELECT n.*, b.sample_id, row_number() OVER (PARTITION BY held_out_family ORDER BY md5({_SEED.replace('h.family', 'held_out_family')} || ':' || b.sample_id), b.sample_id) AS rank, count(*) OVER (PARTITION BY held_out_family) AS pool FROM n, (SELECT sample_id FROM m WHERE label = 1) b)
SELECT held_out_family, sample_id, CASE WHEN rank <= train THEN 'train' WHEN rank <= train + val THEN 'val' ELSE 'test' END AS split FROM y WHERE rank <= train + val + test AND pool >= train + val + test
UNION ALL SELECT held_out_family, NULL, 'missing' FROM n WHERE train + val + test > (SELECT count(*) FROM m WHERE label = 1)""",
)
def balanced(spark, d):
    counts = _lofo(spark, d).groupBy("held_out_family").agg(*[F.floor(F.count_if(F.col("split") == s) / 40).cast("long").alias(s) for s in ("train", "val", "test")])
    return P.balanced_negatives(V.manifest(spark, d).where("label = 1"), counts, "sample_id")


@query("d12_fold_seed", f"WITH {M} SELECT DISTINCT family, ('0x' || substr(md5(family), 1, 8))::BIGINT + 42 AS seed FROM m")
def seeds(spark, d):
    return V.manifest(spark, d).select("family").distinct().withColumn("seed", P.fold_seed(F.col("family")))


@query("j5_apply_split", f"WITH {M}, {_LOFO} SELECT m.sample_id, m.family, label, split FROM m JOIN lofo ON m.sample_id = lofo.sample_id WHERE held_out_family = 'click'")
def apply(spark, d):
    folds = _lofo(spark, d).select(F.col("held_out_family").alias("fold"), "sample_id", "split")
    return P.apply_split(V.manifest(spark, d).select("sample_id", "family", "label"), folds, "click", "sample_id")


@query(
    "p9_check_splits",
    """WITH s AS (SELECT source AS fold, CASE doc_id % 7 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, doc_id FROM documents UNION ALL SELECT source, 'test', doc_id FROM documents WHERE doc_id % 50 = 3),
k AS (SELECT doc_id, toxic AS label FROM labels), j AS (SELECT s.*, k.label, k.doc_id IS NOT NULL AS known FROM s LEFT JOIN k USING (doc_id))
SELECT 'unknown id' AS "check", fold, doc_id::VARCHAR AS detail FROM j WHERE NOT known
UNION ALL SELECT 'label', fold, doc_id::VARCHAR FROM j WHERE known AND (label IS NULL OR label NOT IN (0, 1))
UNION ALL SELECT 'one class', fold, split FROM j WHERE known GROUP BY fold, split HAVING count(DISTINCT label) < 2
UNION ALL SELECT 'in two splits', fold, doc_id::VARCHAR FROM j GROUP BY fold, doc_id HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'empty split', f.fold, p.p FROM (SELECT DISTINCT fold FROM s) f, (SELECT unnest(['train', 'val', 'test']) AS p) p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.fold = f.fold AND s.split = p.p)""",
)
def checks(spark, d):
    docs = table(spark, d, "documents")
    split = F.when(F.col("doc_id") % 7 == 0, "val").when(F.col("doc_id") % 7 == 1, "test").otherwise("train")
    s = docs.select(F.col("source").alias("fold"), split.alias("split"), "doc_id")
    s = s.unionByName(docs.where("doc_id % 50 = 3").select(F.col("source").alias("fold"), F.lit("test").alias("split"), "doc_id"))
    return P.check_splits(s, table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label")))


@query("p9_check_alignment", "SELECT CASE WHEN l.doc_id IS NULL THEN 'missing right' WHEN d.doc_id IS NULL THEN 'missing left' ELSE 'label differs' END AS \"check\", coalesce(d.doc_id, l.doc_id)::VARCHAR AS id FROM (SELECT doc_id, (n_chars % 2)::INT AS label FROM documents) d FULL JOIN (SELECT doc_id, toxic AS label FROM labels) l USING (doc_id) WHERE d.label IS DISTINCT FROM l.label OR l.doc_id IS NULL OR d.doc_id IS NULL")
def alignment(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), (F.col("n_chars") % 2).cast("int").alias("label"))
    return P.check_alignment(a, table(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), F.col("toxic").alias("label")))


@query("a1_subset_stats", f"WITH {RP} SELECT lang, count(*) AS samples, count(*) FILTER (label = 1) AS black, count(*) FILTER (label = 0) AS white, sum(size_bytes)::BIGINT AS total_bytes FROM r GROUP BY lang")
def subset(spark, d):
    return C.subset_stats(V.reports(spark, d), ["lang"])


@query("a2_state_counts", f"WITH {M}, x AS (SELECT family, CASE WHEN first_seen <= TIMESTAMP '2024-01-20' THEN 'pre' ELSE 'post' END AS state FROM m) SELECT state, family, count(*) AS n, (grouping(state) * 2 + grouping(family))::BIGINT AS level FROM x GROUP BY GROUPING SETS ((state), (family, state), ())")
def states(spark, d):
    m = V.manifest(spark, d).withColumn("state", F.when(F.col("first_seen") <= F.lit(T1), "pre").otherwise("post"))
    return C.state_counts(m)


@query("a3_duplicate_stems", f"WITH {RP}, x AS (SELECT 'a/' || (sample_id % 50) || '_' || lang || '.MD' AS path FROM r UNION SELECT 'b/' || (sample_id % 30) || '_' || lang || '.md' FROM r), y AS (SELECT lower(regexp_extract(path, '([^/]+)\\.[^.]*$', 1)) AS stem, path FROM x) SELECT stem, count(*) AS n, array_to_string(list(path ORDER BY path), ' ') AS paths FROM y GROUP BY stem HAVING count(*) > 1")
def stems(spark, d):
    r = V.reports(spark, d)
    a = r.select(F.concat(F.lit("a/"), (F.col("sample_id") % 50).cast("string"), F.lit("_"), "lang", F.lit(".MD")).alias("path"))
    b = r.select(F.concat(F.lit("b/"), (F.col("sample_id") % 30).cast("string"), F.lit("_"), "lang", F.lit(".md")).alias("path"))
    return C.duplicate_stems(a.union(b).distinct()).withColumn("paths", F.array_join("paths", " "))


@query("a4_class_balance", f"WITH {RP} SELECT family, count(*) AS n, count(*) FILTER (label = 1) AS positives, round(avg(label), 6) AS rate FROM r GROUP BY family")
def balance(spark, d):
    return C.class_balance(V.reports(spark, d), ["family"]).withColumn("rate", F.round("rate", 6))


_MAN = "man AS (SELECT CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE ' ' || doc_id || ' ' END AS sample_id, CASE WHEN doc_id % 5 = 0 THEN lang || '/' || source || '/' || (doc_id + 1) || '.md' END AS md_path, CASE WHEN doc_id % 3 > 0 THEN n_chars END AS first_seen, source AS state FROM documents)"


def _man(spark, d):
    docs = table(spark, d, "documents")
    i = F.col("doc_id").cast("string")
    path = F.concat_ws("/", "lang", "source", F.concat((F.col("doc_id") + 1).cast("string"), F.lit(".md")))
    return docs.select(
        F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.concat(F.lit(" "), i, F.lit(" "))).alias("sample_id"), F.when(F.col("doc_id") % 5 == 0, path).alias("md_path"),
        F.when(F.col("doc_id") % 3 > 0, F.col("n_chars")).alias("first_seen"), F.col("source").alias("state"),
    )


_RES = f"""{RP}, {_MAN}, i AS (SELECT regexp_extract(path, '([^/]+)\\.md$', 1) AS stem, max(path) AS p FROM r GROUP BY 1),
res AS (SELECT man.*, coalesce(r2.path, i.p) AS report_path FROM man LEFT JOIN (SELECT DISTINCT path FROM r) r2 ON man.md_path = r2.path LEFT JOIN i ON trim(man.sample_id) = i.stem)"""


@query("j1_resolve_reports", f"WITH {_RES} SELECT * FROM res")
def resolve(spark, d):
    return C.resolve_reports(_man(spark, d), V.reports(spark, d))


@query("j1_resolve_counts", f"WITH {_RES} SELECT count(*) FILTER (report_path IS NOT NULL AND first_seen IS NOT NULL) AS matched, count(*) FILTER (report_path IS NULL) AS missing_path, count(*) FILTER (report_path IS NOT NULL AND first_seen IS NULL) AS missing_timestamp FROM res")
def resolve_counts(spark, d):
    return C.resolve_counts(C.resolve_reports(_man(spark, d), V.reports(spark, d)))


@query("j2_missing_reports", f"WITH {RP} SELECT source AS state, doc_id::VARCHAR AS sample_id FROM documents WHERE doc_id NOT IN (SELECT sample_id FROM r)")
def missing(spark, d):
    man = table(spark, d, "documents").select(F.col("source").alias("state"), F.col("doc_id").alias("sample_id"))
    return C.missing_reports(man, V.reports(spark, d))


@query("j3_allow_list", f"WITH {RP} SELECT doc_id AS sample_id, n_chars FROM documents WHERE doc_id IN (SELECT sample_id FROM r WHERE label = 0)")
def allow(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "n_chars")
    return C.allow_list(docs, V.reports(spark, d).where("label = 0"))


@query("j4_pending", f"WITH {RP}, x AS (SELECT sample_id, c AS condition, l AS layer FROM r, (SELECT unnest(['with_hash', 'without_hash']) AS c), (SELECT unnest([1, 2]) AS l)) SELECT sample_id, condition, layer FROM x WHERE NOT (sample_id % 3 = 0 AND condition = 'with_hash')")
def pending(spark, d):
    docs = V.reports(spark, d).select("sample_id").withColumn("condition", F.explode(F.array(F.lit("with_hash"), F.lit("without_hash")))).withColumn("layer", F.explode(F.array(F.lit(1), F.lit(2))))
    done = docs.where("sample_id % 3 = 0 and condition = 'with_hash'")
    return C.pending(docs, done, ["sample_id", "condition", "layer"])


@query("j6_map_to_json", f"WITH {RP}, j AS (SELECT label, sample_id, 'json/' || label || '/' || sample_id || '.json' AS json_path FROM r WHERE sample_id % 4 > 0) SELECT r.sample_id, r.label, r.path, j.json_path FROM r LEFT JOIN j ON r.label = j.label AND r.sample_id = j.sample_id")
def to_json(spark, d):
    r = V.reports(spark, d).select("sample_id", "label", "path")
    j = r.where("sample_id % 4 > 0").select("label", F.concat(F.lit("json/"), F.col("label").cast("string"), F.lit("/"), F.col("sample_id").cast("string"), F.lit(".json")).alias("path"))
    return C.map_to_json(r, j)


@query("o1_order_samples", f"WITH {M} SELECT sample_id, CASE WHEN first_seen <= TIMESTAMP '2024-01-20' THEN 'train' WHEN first_seen <= TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END AS split FROM m ORDER BY split, sample_id")
def order(spark, d):
    return C.order_samples(P.time_split(V.manifest(spark, d), T1, T2).select("sample_id", "split"))


@query("o3_union_labelled", f"WITH {M} SELECT sample_id, family, label, CASE WHEN label = 1 THEN 'malicious' ELSE 'benign' END AS source FROM m")
def union(spark, d):
    m = V.manifest(spark, d).select("sample_id", "family", "label")
    return C.union_labelled(m.where("label = 1"), m.where("label = 0"))


@query("o4_union_by_hash", "WITH p AS (SELECT md5(text) AS sha256, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), q AS (SELECT md5(text) AS sha256, min(doc_id) AS doc_id FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) SELECT coalesce(q.sha256, p.sha256) AS sha256, coalesce(q.doc_id, p.doc_id) AS doc_id FROM p FULL JOIN q ON p.sha256 = q.sha256")
def by_hash(spark, d):
    docs = table(spark, d, "documents")
    pre, post = (docs.where(w).groupBy(F.md5("text").alias("sha256")).agg(F.min("doc_id").alias("doc_id")) for w in ("doc_id % 2 = 0", "doc_id % 3 = 0"))
    return C.union_by_hash(pre, post)


@query("p1_coalesce_aliases", "SELECT event_id, CASE WHEN trim(event_type) <> '' AND event_id % 4 > 0 THEN event_type WHEN event_id % 4 = 0 AND event_id % 8 > 0 THEN event_id::VARCHAR ELSE user_id::VARCHAR END AS value FROM events")
def aliases(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("event_type")).otherwise(" ").alias("SHA256"), F.when(F.col("event_id") % 8 > 0, F.col("event_id")).alias("sample_id"), F.col("user_id").alias("hash"))
    return e.select("event_id", MF.coalesce_aliases(e, MF.ID_KEYS).alias("value"))


@query("p2_normalise_timestamp", "SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL WHEN event_id % 7 = 5 THEN date_trunc('day', ts) WHEN event_id % 7 = 3 THEN date_trunc('second', ts) - INTERVAL 2 HOUR ELSE date_trunc('second', ts) END AS first_seen FROM events")
def timestamps(spark, d):
    e = table(spark, d, "events")
    f = lambda p: F.date_format("ts", p)
    k = F.col("event_id") % 7
    seconds = F.unix_timestamp(f("yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd HH:mm:ss")
    raw = (
        F.when(k == 0, seconds.cast("string")).when(k == 1, F.concat(seconds.cast("string"), F.lit("000"))).when(k == 2, f("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 3, f("yyyy-MM-dd'T'HH:mm:ss'+02:00'")).when(k == 4, f("yyyy/MM/dd HH:mm:ss")).when(k == 5, f("yyyy/MM/dd")).otherwise("soon")
    )
    return e.select("event_id", MF.normalise_timestamp(raw).alias("first_seen"))


@query("p3_infer_label", f"WITH {RP}, x AS (SELECT sample_id, (CASE sample_id % 4 WHEN 0 THEN 'root/Black/' WHEN 1 THEN 'root/benign/' WHEN 2 THEN 'root/unknown/black/' ELSE 'root/' END) || path AS path, CASE WHEN sample_id % 9 = 0 THEN label::VARCHAR WHEN sample_id % 9 = 1 THEN 'x' END AS sidecar, label FROM r) SELECT sample_id, CASE WHEN sample_id % 9 = 0 THEN label ELSE CASE sample_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END END AS plain, CASE WHEN sample_id % 9 = 0 THEN label WHEN sample_id % 9 = 1 THEN NULL ELSE CASE sample_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END END AS wide FROM x")
def labels(spark, d):
    k = F.col("sample_id") % 4
    root = F.when(k == 0, "root/Black/").when(k == 1, "root/benign/").when(k == 2, "root/unknown/black/").otherwise("root/")
    side = F.when(F.col("sample_id") % 9 == 0, F.col("label").cast("string")).when(F.col("sample_id") % 9 == 1, "x")
    path = F.concat(root, "path")
    return V.reports(spark, d).select("sample_id", MF.infer_label(path, side).alias("plain"), MF.infer_label(path, side, "wide").alias("wide"))


@query("p4_filter_window", f"WITH {M} SELECT sample_id, family FROM m WHERE family <> 'view' AND first_seen BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-25'")
def window(spark, d):
    return MF.filter_window(V.manifest(spark, d), T1, T2, ["VIEW"], hash_col="sample_id").select("sample_id", "family")


@query("p5_path_metadata", f"WITH {RP} SELECT sample_id, CASE WHEN sample_id % 2 = 0 THEN 'TrojanX' ELSE 'Unknown' END AS path_family, CASE WHEN sample_id % 3 = 0 THEN '2024-05-06' END AS path_date, length(text) AS text_length FROM r")
def metadata(spark, d):
    path = F.concat(F.when(F.col("sample_id") % 2 == 0, "a/TrojanX/").otherwise("a/"), F.when(F.col("sample_id") % 3 == 0, "2024/05/06/").otherwise("x/"), F.col("sample_id").cast("string"))
    r = V.reports(spark, d).select("sample_id", path.alias("path"), "text")
    return MF.path_metadata(r).select("sample_id", "path_family", "path_date", "text_length")
