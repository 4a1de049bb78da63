"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir).

    Only where the session names none and runs on one machine, as in tests, is a temporary one set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="driftgauge-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str = "t", codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage and survives lost executors.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``stored`` that nothing needs any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: str | int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batches`` of about ``size``, the bytes of a text or the members of a list in ``column``.

    What Python makes of a batch of Spark's, 10,000 rows of any length, is several times as large.
    """
    for batch in batches:
        cells = batch.column(column)
        length = pc.list_value_length if pa.types.is_list(cells.type) else pc.binary_length
        block = np.cumsum(pc.fill_null(length(cells), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // size
        at = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            yield batch.slice(a, b - a)


class Remembered(dict):
    """What was found for the last ``size`` to 2 * ``size`` keys in use; Python workers outlive their tasks, and so do their caches.

    ``find(key)`` asks the older half too. Keys that aren't found there are put in by the caller.
    """

    def __init__(self, size: int):
        super().__init__()
        self.size, self.older = size, {}

    def find(self, key):
        found = self.get(key)
        if found is None and (found := self.older.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value):
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns of these names renamed, and what selects ``df``'s columns, by their own names, of a result.

    For operators that add columns of these names. As everywhere in Spark, case doesn't tell names apart.
    """
    lower, fresh = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            k = 0
            while (new := f"_{c}_{k}").lower() in lower:
                k += 1
            lower.add(new.lower())
            fresh[c] = new
    back = lambda out: out.select(*[F.col(f"`{fresh.get(c, c)}`").alias(c) for c in df.columns])
    return df.withColumnsRenamed(fresh), back


def doc_key(doc_id: str, text: str) -> list[Column]:
    """128 bits that stand for one (id, text); rows alike in both are one document."""
    whole = [F.col(doc_id).isNull(), F.col(doc_id).cast("string"), F.col(text).isNull(), F.col(text)]
    return [F.xxhash64(F.lit(11), *whole).alias("k1"), F.xxhash64(F.lit(23), *whole).alias("k2")]
