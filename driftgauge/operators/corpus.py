"""Joins and counts over manifests and report indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """File name without folders and the last extension, in lower case."""
    return F.lower(F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1))


def resolve_reports(manifest: DataFrame, reports: DataFrame, id_col: str = "sample_id", path_col: str = "md_path") -> DataFrame:
    """``manifest`` with ``report_path``: its own path where that exists, else the report with the id as stem.

    Of reports with one stem the last path in order counts. Blank ids and paths match nothing.
    """
    index = reports.select(F.col("path").alias("report_path"), stem(F.col("path")).alias("_stem"))
    by_stem = index.where("_stem <> ''").groupBy("_stem").agg(F.max("report_path").alias("_by_stem"))
    by_path = index.select(F.col("report_path").alias("_by_path")).distinct()
    key = F.lower(F.trim(F.col(id_col).cast("string")))
    rows = manifest.withColumn("_key", F.when(key != "", key))
    rows = rows.join(by_path, F.col(path_col) == F.col("_by_path"), "left").join(by_stem, F.col("_key") == F.col("_stem"), "left")
    return rows.select(*manifest.columns, F.coalesce("_by_path", "_by_stem").alias("report_path"))


def resolve_counts(resolved: DataFrame, ts: str = "first_seen") -> DataFrame:
    """One row: matched, missing_path and missing_timestamp."""
    found, timed = F.col("report_path").isNotNull(), F.col(ts).isNotNull()
    return resolved.agg(F.count_if(found & timed).alias("matched"), F.count_if(~found).alias("missing_path"), F.count_if(found & ~timed).alias("missing_timestamp"))


def missing_reports(manifest: DataFrame, reports: DataFrame, id_col: str = "sample_id", state: str = "state") -> DataFrame:
    """(state, id) of manifest rows without a report."""
    have = reports.select(stem(F.col("path")).alias("_stem")).distinct()
    rows = manifest.select(state, F.lower(F.trim(F.col(id_col).cast("string"))).alias(id_col))
    return rows.join(have, F.col(id_col) == F.col("_stem"), "left_anti")


def allow_list(docs: DataFrame, manifest: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Documents whose id the manifest names."""
    return docs.join(manifest.select(id_col), id_col, "left_semi")


def pending(docs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows not processed yet: resume by anti-join."""
    return docs.join(done.select(*keys), keys, "left_anti")


def map_to_json(docs: DataFrame, json_reports: DataFrame) -> DataFrame:
    """``docs`` with ``json_path``: the JSON report of the same label and stem; null is unresolved."""
    index = json_reports.groupBy("label", stem(F.col("path")).alias("_stem")).agg(F.max("path").alias("json_path"))
    rows = docs.withColumn("_stem", stem(F.col("path")))
    return rows.join(index, ["label", "_stem"], "left").select(*docs.columns, "json_path")


def subset_stats(df: DataFrame, keys: list[str], label: str = "label", size: str = "size_bytes") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("samples"), F.count_if(F.col(label) == 1).alias("black"), F.count_if(F.col(label) == 0).alias("white"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_bytes"))


def state_counts(df: DataFrame, state: str = "state", family: str = "family") -> DataFrame:
    """Counts by state, by family and state, and in total (nulls stand for all)."""
    return df.groupingSets([[state], [family, state], []], state, family).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def duplicate_stems(df: DataFrame) -> DataFrame:
    """(stem, n, paths) of stems with more than one path."""
    rows = df.select(stem(F.col("path")).alias("stem"), "path")
    twice = rows.groupBy("stem").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(twice, "stem").groupBy("stem", "n").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def class_balance(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("positives"), F.avg((F.col(label) == 1).cast("double")).alias("rate"))


def union_labelled(mal: DataFrame, ben: DataFrame) -> DataFrame:
    tag = lambda d, y, s: d.withColumns({"label": F.lit(y), "source": F.lit(s)})
    return tag(mal, 1, "malicious").unionByName(tag(ben, 0, "benign"))


def union_by_hash(pre: DataFrame, post: DataFrame, key: str = "sha256") -> DataFrame:
    """Distinct by hash; of one hash the post row counts, then the largest row."""
    both = pre.withColumn("_at", F.lit(0)).unionByName(post.withColumn("_at", F.lit(1)))
    row = F.struct(*pre.columns)
    return both.groupBy(key).agg(F.max_by(row, F.struct("_at", F.to_json(row))).alias("_r")).select("_r.*")


def order_samples(df: DataFrame, split: str = "split", id_col: str = "sample_id") -> DataFrame:
    return df.orderBy(split, id_col)
