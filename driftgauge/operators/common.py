"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one (spark.checkpoint.dir); a temporary one only on one machine, where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="driftgauge-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: it is computed once, and lost executors don't matter."""
    spark = df.sparkSession
    at = scratch(spark)
    df.write.parquet(at)
    return spark.read.schema(schema or df.schema).parquet(at)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the left side's keys stay."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], F.lit(True))
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def hash_order(id_col: str | Column, seed: int = 42) -> Column:
    """md5 of "seed:id": a fixed shuffle, equal in every engine."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def div(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
