"""Readers and writers of reports, manifests, splits, embeddings and results.

All paths go through Spark's readers, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.manifest import normalise_timestamp
from ..operators.behavior import parsed
from ..operators.corpus import stem


def _whole(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    # bad UTF-8 becomes the replacement character
    return raw.select("path", F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("text"))


def read_reports(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(sample_id, path, size_bytes, text) of all files of a pattern below root; empty files are left out."""
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")
    rows = _whole(spark, root, pattern).where("size_bytes > 0")
    return rows.select(stem(F.col("path")).alias("sample_id"), "path", "size_bytes", "text")


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(sample_id, sidecar) of all *.label files."""
    return _whole(spark, root, "*.label").select(stem(F.col("path")).alias("sample_id"), F.col("text").alias("sidecar"))


def read_json_reports(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(sample_id, path, raw, report) of all files of a pattern that hold an object."""
    rows = _whole(spark, root, pattern).where("size_bytes > 0")
    return parsed(rows.select(stem(F.col("path")).alias("sample_id"), "path", F.col("text").alias("raw")))


def delimiter(header: str) -> str:
    """The most frequent of tab, semicolon and comma in the header line."""
    return max("\t;,", key=header.count)


def read_manifest(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Rows of a CSV (any of three delimiters), TSV, JSONL or JSON manifest; all CSV columns are strings.

    JSON may be a list, an object with ``items``, or one object; what isn't an object goes.
    """
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt in ("csv", "tsv"):
        first = spark.read.text(path).first()
        sep = "\t" if fmt == "tsv" else delimiter(first.value if first else ",")
        return spark.read.option("header", "true").option("sep", sep).csv(path)
    if fmt == "jsonl":
        rows = spark.read.text(path).select(F.col("value").alias("raw"))
    else:
        v = F.try_parse_json("value")
        items = F.coalesce(F.try_variant_get(v, "$.items", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array(v))
        rows = spark.read.text(path, wholetext=True).select(F.explode(items).alias("v")).select(F.to_json("v").alias("raw"))
    rows = rows.where(F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT"))
    keys = rows.select(F.explode(F.json_object_keys("raw")).alias("k")).distinct().orderBy("k").collect()
    fields = T.StructType([T.StructField(r.k, T.StringType()) for r in keys])
    return rows.select(F.from_json("raw", fields).alias("r")).select("r.*")


DRIFT_COLUMNS = ["Malware SHA-256", "Family", "Label", "State"]


def read_drift_labels(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, family, label, state) of a drift label CSV; all four columns are required."""
    rows = spark.read.option("header", "true").csv(path)
    lacking = [c for c in DRIFT_COLUMNS if c not in rows.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return rows.select(F.lower(F.trim(F.col("Malware SHA-256"))).alias("sha256"), F.trim("Family").alias("family"), F.trim("Label").try_cast("int").alias("label"), F.lower(F.trim("State")).alias("state"))


def write_embeddings(df: DataFrame, path: str) -> None:
    df.write.partitionBy("layer").parquet(path)


def read_embeddings(spark: SparkSession, path: str, layers: list[int] | None = None) -> DataFrame:
    """Embeddings of the given layers; others' files aren't opened."""
    rows = spark.read.parquet(path)
    return rows if layers is None else rows.where(F.col("layer").isin(layers))


_DOC = "array<struct<doc_id:bigint,path:string,label:int,sha256:string,family:string,source:string,first_seen:string>>"


def read_split_spec(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(docs, folds) of a split file, or of a folder of its parts: folds as a list or by name, ``*_ids`` or ``*_indices``.

    A document is numbered by ``doc_id``, or by its place in the list.
    """
    # a part has an object in each line; another file is one object, in as many lines as it likes
    lines = F.split("value", "\n")
    each = F.when(F.try_parse_json(F.get(lines, F.lit(0))).isNotNull(), lines).otherwise(F.array("value"))
    v = spark.read.text(path, wholetext=True).select(F.explode(each).alias("value")).select(F.try_parse_json("value").alias("v")).where("v is not null")
    docs = v.select(F.posexplode(F.try_variant_get("v", "$.docs", _DOC)).alias("doc_id", "d")).select(F.coalesce("d.doc_id", F.col("doc_id").cast("long")).alias("doc_id"), "d.path", "d.label", "d.sha256", "d.family", "d.source", "d.first_seen")
    listed = v.select(F.posexplode(F.try_variant_get("v", "$.folds", "array<variant>")).alias("i", "f"))
    listed = listed.select(F.coalesce(F.try_variant_get("f", "$.name", "string"), F.col("i").cast("string")).alias("fold"), F.coalesce(F.try_variant_get("f", "$.fold_index", "int"), F.col("i")).alias("fold_index"), F.try_variant_get("f", "$.held_out_family", "string").alias("held_out_family"), "f")
    named = v.select(F.explode(F.try_variant_get("v", "$.folds", "map<string,variant>")).alias("fold", "f"))
    named = named.select("fold", F.try_variant_get("f", "$.fold_index", "int").alias("fold_index"), F.try_variant_get("f", "$.held_out_family", "string").alias("held_out_family"), "f")
    ids = lambda s: F.coalesce(F.try_variant_get("f", f"$.{s}_ids", "array<bigint>"), F.try_variant_get("f", f"$.{s}_indices", "array<bigint>"))
    splits = F.array(*[F.struct(F.lit(s).alias("split"), ids(s).alias("ids")) for s in ("train", "val", "test")])
    folds = listed.unionByName(named).select("fold", "fold_index", "held_out_family", F.inline(splits))
    return docs, folds.select("fold", "fold_index", "held_out_family", "split", F.explode("ids").alias("doc_id"))


def write_split_spec(docs: DataFrame, folds: DataFrame, path: str, part: int = 10_000) -> None:
    """A split file in parts that ``read_split_spec`` reads: JSON objects of up to about ``part`` documents or ids each.

    ``docs`` has doc_id and what else a document is described by; ``folds`` has fold,
    fold_index, split, doc_id, and perhaps held_out_family.
    """
    held = F.col("held_out_family") if "held_out_family" in folds.columns else F.lit(None).cast("string")
    dealt = lambda df: df.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-df.count() // part)))))
    listed = dealt(docs).groupBy("_part").agg(F.collect_list(F.struct(*docs.columns)).alias("docs"))
    ids = lambda s: F.collect_list(F.when(F.col("split") == s, F.col("doc_id"))).alias(f"{s}_ids")
    per = dealt(folds.select("fold", "fold_index", held.alias("held_out_family"), "split", "doc_id")).groupBy("_part", "fold", "fold_index", "held_out_family").agg(*[ids(s) for s in ("train", "val", "test")])
    fold = F.struct(F.col("fold").alias("name"), "fold_index", "held_out_family", "train_ids", "val_ids", "test_ids")
    out = listed.select(F.to_json(F.struct(F.lit(1).alias("version"), "docs")).alias("value"))
    out = out.unionByName(per.select(F.to_json(F.struct(F.lit(1).alias("version"), F.array(fold).alias("folds"))).alias("value")))
    out.write.text(path)


def export_subsets(df: DataFrame, path: str) -> None:
    df.write.partitionBy("subset", "label").parquet(path)


def write_index(df: DataFrame, path: str, fmt: str = "json", state: str = "state") -> None:
    """JSON lines or CSV per state."""
    writer = df.write.partitionBy(state)
    writer.json(path) if fmt == "json" else writer.option("header", "true").csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, condition, layer, metric, value): result files in one long table.

    Objects map a condition to ``layer_k`` objects of metrics, or hold ``all_layers``.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    top = files.select("file", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("condition", "c")).where("condition not in ('protocol', 'config', 'best', 'all_layers')")
    layered = top.select("file", "condition", F.explode(F.try_variant_get("c", "$", "map<string,variant>")).alias("layer", "m"))
    layered = layered.select("file", "condition", F.regexp_extract("layer", r"(\d+)$", 1).try_cast("int").alias("layer"), "m").where("layer is not null")
    every = files.select("file", F.lit("all_layers").alias("condition"), F.explode(F.try_variant_get("v", "$.all_layers", "array<variant>")).alias("m"))
    every = every.select("file", "condition", F.try_variant_get("m", "$.layer_index", "int").alias("layer"), "m")
    rows = layered.unionByName(every).select("file", "condition", "layer", F.explode(F.try_variant_get("m", "$", "map<string,variant>")).alias("metric", "x"))
    return rows.select("file", "condition", "layer", "metric", F.try_variant_get("x", "$", "double").alias("value")).where("value is not null and metric <> 'layer_index'")


def typed_manifest(rows: DataFrame, id_col, ts_col, path_col) -> DataFrame:
    """(sample_id, first_seen, md_path) from resolved alias columns."""
    return rows.select(F.trim(id_col).alias("sample_id"), normalise_timestamp(ts_col).alias("first_seen"), path_col.alias("md_path"))
