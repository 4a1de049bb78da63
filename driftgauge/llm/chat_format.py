"""Chat formatting: snapshots that a longer conversation continues collapse, the rest is rendered.

A conversation is logged again and again while it grows. Every turn has a hash of its
place, role and text, and the rolling sum over a conversation's turns (two sums of 56-bit
halves, with the number of turns) names each prefix. A conversation whose whole is
a prefix of a longer one is anti-joined away; of equal ones the smallest id stays.

A prefix common to many conversations is one row after a partial aggregation, so the
anti-join meets each prefix once. The rolling sum runs along one conversation at a time
and spills, so its length isn't bound by memory.

Rendering: each turn is a line ``<|role|>`` with its text and ``<|end|>`` behind it.
Turns are rendered before they meet, and a conversation becomes one text.

Nulls: turns are ordered by number, null first, then role and text; a null role is
``unknown``, a null text empty, and repeated rows are one turn. A null conversation id is
a conversation as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


def prefixes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, n, s1, s2, role, text, size): each turn with the name of the prefix it ends; size is the conversation's."""
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).distinct()
    along = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("n", F.row_number().over(along))
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)

    def rolling(seed: int):
        h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "n", "role", "text"), 8)
        return F.sum(h.cast("decimal(20,0)")).over(so_far)

    whole = Window.partitionBy("conv")
    return rows.select("conv", "n", "role", "text", rolling(3).alias("s1"), rolling(5).alias("s2"), F.count("*").over(whole).alias("size"))


def maximal_conversations(turns: DataFrame, **columns) -> DataFrame:
    """(conv, n, role, text) of the conversations that no longer one continues."""
    rows = prefixes(turns, **columns)
    name = ["n", "s1", "s2"]
    inner = rows.where("n < size").groupBy(*name).agg(F.lit(1).alias("_one")).select(*name)
    whole = rows.where("n = size").groupBy(*name).agg(F.min(F.struct("conv")).alias("c")).select(*name, "c.conv")
    kept = whole.join(inner, name, "left_anti").select(F.col("conv").alias("_c"))
    return rows.join(kept, F.col("conv").eqNullSafe(F.col("_c"))).select("conv", "n", "role", "text")


def render_chats(turns: DataFrame, **columns) -> DataFrame:
    """(conv, n_turns, rendered) of each maximal conversation."""
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n"))
    rows = maximal_conversations(turns, **columns).select("conv", "n", line.alias("line"))
    told = rows.groupBy("conv").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("n", "line"))).alias("lines"))
    return told.select("conv", "n_turns", F.array_join("lines.line", "").alias("rendered"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_chats(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


ORACLE = r"""
WITH r AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
t AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS size,
      string_agg(role || chr(1) || text || chr(2), '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS p
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
whole AS (SELECT p, min(conv_id) AS conv_id FROM t WHERE n = size GROUP BY p),
kept AS (SELECT conv_id FROM whole WHERE p NOT IN (SELECT p FROM t WHERE n < size))
SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY n) AS rendered
FROM t JOIN kept USING (conv_id) GROUP BY conv_id
"""
