"""The given tables seen as scores, manifests, reports and embeddings, in Spark and in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

TRAIN_END, VAL_END = dt.datetime(1999, 10, 8), dt.datetime(2000, 10, 20)


def _split(c: str):
    return F.when(F.col(c) <= F.lit(TRAIN_END), "train").when(F.col(c) <= F.lit(VAL_END), "val").otherwise("test")


def scores(spark: SparkSession, d: str, fine: bool = False) -> DataFrame:
    """lineitem as 7 layers of scores: many ties, or hardly any (``fine``)."""
    score = F.col("l_extendedprice") / 110000 if fine else (F.round(F.abs("l_discount") * 100) * 50 + F.col("l_quantity")) / 600
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("layer"), (F.col("l_returnflag") == "R").cast("int").alias("y"), score.alias("score"), _split("l_shipdate").alias("split"))


def scores_sql(fine: bool = False) -> str:
    score = "l_extendedprice / 110000" if fine else "(round(abs(l_discount) * 100) * 50 + l_quantity) / 600"
    return f"""s AS (SELECT l_linenumber AS layer, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, {score} AS score,
 CASE WHEN l_shipdate <= TIMESTAMP '1999-10-08' THEN 'train' WHEN l_shipdate <= TIMESTAMP '2000-10-20' THEN 'val' ELSE 'test' END AS split FROM lineitem)"""


def manifest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("sample_id"), F.col("ts").alias("first_seen"), F.col("event_type").alias("family"), (F.col("event_type") == "error").cast("int").alias("label"))


MANIFEST = "m AS (SELECT event_id AS sample_id, ts AS first_seen, event_type AS family, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events)"


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as reports."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("sample_id"), path.alias("path"), F.col("source").alias("family"), F.col("toxic").alias("label"), F.col("n_chars").alias("size_bytes"), "lang", "text")


REPORTS = "r AS (SELECT doc_id AS sample_id, lang || '/' || source || '/' || doc_id || '.md' AS path, source AS family, toxic AS label, n_chars AS size_bytes, lang, text FROM documents JOIN labels USING (doc_id))"


def md_reports(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as Markdown: a heading per turn."""
    block = F.concat(F.lit("## "), "role", F.lit("\n"), "text", F.lit("\n"))
    rows = table(spark, d, "conversations").select("conv_id", F.struct("turn", block.alias("b")).alias("t"))
    return rows.groupBy(F.col("conv_id").alias("sample_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["b"]), "").alias("text"))


MD = "md AS (SELECT conv_id AS sample_id, string_agg('## ' || role || chr(10) || text || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"


_HEADS = {"user": "Executed Commands", "assistant": "Network Activity", "system": "Summary Statistics"}
_TAILS = [" see http://a.example/x?y=1 now", " from 10.0.0.7:8080 to evil.top", " HKLM\\Software\\Run and C:\\Temp\\a.exe"]


def section_reports(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as Markdown with the headings of behaviour reports, and an indicator in each section."""
    c = table(spark, d, "conversations")
    head = F.create_map(*[F.lit(x) for kv in _HEADS.items() for x in kv])[F.col("role")]
    tail = F.element_at(F.array(*[F.lit(t) for t in _TAILS]), (F.col("turn") % 3 + 1).cast("int"))
    rows = c.select("conv_id", F.struct("turn", F.concat(F.lit("## "), head, F.lit("\n"), "text", tail, F.lit("\n")).alias("b")).alias("t"))
    return rows.groupBy(F.col("conv_id").alias("sample_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["b"]), "").alias("text"))


def _variants_sql() -> str:
    from ..functions.text import SECTION_GROUPS

    b = "\\"
    red = "body"
    for pattern, mark in ((f"{b}bhttps?://[^{b}s`|<>)]+", "[URL]"), (f"{b}b(?:{b}d{{1,3}}{b}.){{3}}{b}d{{1,3}}(?::{b}d{{1,5}})?{b}b", "[IP]"), (f"{b}bevil{b}.top{b}b", "[DOMAIN]"), (f"HKLM{b}{b}[^{b}s`|]+", "[REGISTRY]"), (f"C:{b}{b}[^{b}s`|]+", "[PATH]")):
        red = f"regexp_replace({red}, '{pattern}', '{mark}', 'g')"
    case = lambda col, values: f"CASE {col} " + " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in values) + " END"
    out = f"""WITH b AS (SELECT conv_id, turn, {case("role", _HEADS.items())} AS h, text || ({case("turn % 3", list(enumerate(_TAILS)))}) AS body FROM conversations),
k AS (SELECT conv_id, turn, h, '## ' || h || chr(10) || body || chr(10) AS raw, '## ' || h || chr(10) || {red} || chr(10) AS red, '## ' || h || chr(10) || '[MASKED_' || upper(replace(h, ' ', '_')) || ']' || chr(10) AS hid FROM b), v AS ("""
    parts = []
    for name, col in (("original", "raw"), ("redact_ioc_identifiers", "red")):
        parts.append(f"SELECT conv_id AS sample_id, '{name}' AS variant, string_agg({col}, '' ORDER BY turn) AS text FROM k GROUP BY conv_id")
    for prefix, col in (("mask", "raw"), ("redact_ioc_mask", "red")):
        for group, heads in SECTION_GROUPS.items():
            names = ", ".join(f"'{h}'" for h in heads)
            parts.append(f"SELECT conv_id, '{prefix}_{group}', string_agg(CASE WHEN h IN ({names}) THEN hid ELSE {col} END, '' ORDER BY turn) FROM k GROUP BY conv_id")
    return out + " UNION ALL ".join(parts) + ")"


def _count_sql(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


#: All 18 variants of ``section_reports``: v (sample_id, variant, text).
VARIANTS_SQL = _variants_sql()
COUNTED_SQL = f"""n AS (SELECT sample_id, variant, text, {_count_sql("[A-Za-z0-9_]+|[^" + chr(92) + "s]")} AS approx_tokens FROM v),
counted AS (SELECT *, approx_tokens - max(CASE WHEN variant = 'original' THEN approx_tokens END) OVER (PARTITION BY sample_id) AS token_delta FROM n)"""
INDICATORS_SQL = ", ".join(
    f"{_count_sql(p)} AS {n}"
    for n, p in (
        ("sha256", r"\b[0-9a-fA-F]{64}\b"),
        ("md5", r"\b[0-9a-fA-F]{32}\b"),
        ("url", r"\bhttps?://[^\s`|<>)]+"),
        ("ipv4", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?\b"),
        ("registry", r"\bHKLM\\[^\s`|]+"),
        ("windows_path", r"[A-Za-z]:\\[^\s`|]+"),
    )
)


def sandbox(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as sandbox JSON: a process per role, a call per turn, and the conversation as ``info.id``."""
    rows = table(spark, d, "conversations")
    call = F.struct(F.concat("role", F.col("turn").cast("string")).alias("api"), F.array("text").alias("arguments"), (F.col("turn") % 3).alias("return"))
    per = rows.groupBy("conv_id", "role").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", call.alias("c")))), lambda t: t["c"]).alias("calls"))
    per = per.groupBy(F.col("conv_id").alias("sample_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("role", "calls"))), lambda p: F.struct(p["calls"].alias("calls"))).alias("processes"))
    return per.select("sample_id", F.to_json(F.struct(F.struct(F.col("sample_id").alias("id")).alias("info"), F.struct("processes").alias("behavior"))).alias("raw"))


def layer_emb(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings cut into 4 layers of 16."""
    e = table(spark, d, "embeddings").withColumn("layer", F.explode(F.sequence(F.lit(1), F.lit(4))))
    part = F.slice("embedding", (F.col("layer") - 1) * 16 + 1, F.lit(16))
    return e.select(F.col("vec_id").alias("sample_id"), "layer", part.cast("array<double>").alias("embedding"), (F.col("label") >= 5).cast("int").alias("y"), F.col("label").alias("family"))


EMB = "e AS (SELECT vec_id AS sample_id, layer, list_transform(embedding[(layer - 1) * 16 + 1 : layer * 16], lambda x: x::DOUBLE) AS embedding, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, label AS family FROM embeddings, (SELECT unnest([1, 2, 3, 4]) AS layer))"
