"""Prefix sums and ranks in large groups.

A plain window sorts a whole group in one task. Here a group is cut into ranges of the
order column, each range is a window of its own, and small tables of range totals, one
row per group and range, give what comes before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_on, stored


#: Rows that one window should sort, and the most ranges that a group is cut into.
RANGE_ROWS, MOST_RANGES = 100_000, 1024


def ranged(df: DataFrame, keys: list[str], order: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``_range``, which falls as the numeric column ``order`` rises.

    A group has a range for each ``rows`` of its rows: of many quantiles, taken in the same
    aggregate that counts it, every so many are its cuts. A small group isn't cut.
    """
    shares = F.array(*[F.lit(i / MOST_RANGES) for i in range(1, MOST_RANGES)])
    every = F.greatest(F.lit(1), F.floor(MOST_RANGES * rows / F.greatest(F.col("_n"), F.lit(1))))
    cuts = df.groupBy(*keys).agg(F.percentile_approx(order, shares, F.lit(2 * MOST_RANGES)).alias("_cuts"), F.count("*").alias("_n"))
    cuts = cuts.select(*keys, F.filter("_cuts", lambda _c, i: (i + 1) % every == 0).alias("_cuts"))
    out = join_on(df, cuts, keys)
    return out.withColumn("_range", F.size(F.filter("_cuts", lambda c: c > F.col(order)))).drop("_cuts")


def prefix_sums(df: DataFrame, keys: list[str], order: str, values: list[str], head: list[str] | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """Per row, sums of ``values`` up to it (``cum_*``) and over its group (``all_*``), by falling ``order``.

    ``order`` is distinct within a group. ``head`` columns of the next row come as
    ``next_*`` (null behind the last). ``df`` is stored and counted: where no group has over ``rows``
    rows, each is one plain window.
    """
    head = head or []
    df = stored(df)
    largest = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    if largest <= rows:
        w, whole = Window.partitionBy(*keys).orderBy(F.desc(order)), Window.partitionBy(*keys)
        up = w.rowsBetween(Window.unboundedPreceding, 0)
        return df.select(
            "*", *[F.sum(v).over(up).alias(f"cum_{v}") for v in values], *[F.sum(v).over(whole).alias(f"all_{v}") for v in values], *[F.lead(h).over(w).alias(f"next_{h}") for h in head]
        )
    cut = ranged(df, keys, order, rows)
    w = Window.partitionBy(*keys, "_range").orderBy(F.desc(order))
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumns({f"_in_{v}": F.sum(v).over(up) for v in values} | {f"_n_{h}": F.lead(h).over(w) for h in head} | {"_last": F.lead(F.lit(1)).over(w).isNull()})
    totals = cut.groupBy(*keys, "_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in values], *[F.max_by(h, order).alias(f"_h_{h}") for h in head])
    tw = Window.partitionBy(*keys).orderBy("_range")
    before = tw.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = totals.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values],
        *[F.sum(f"_t_{v}").over(whole).alias(f"all_{v}") for v in values],
        *[F.lead(f"_h_{h}").over(tw).alias(f"_f_{h}") for h in head],
    )
    out = join_on(cut, totals, [*keys, "_range"])
    return out.select(
        *df.columns,
        *[(F.col(f"_in_{v}") + F.col(f"_b_{v}")).alias(f"cum_{v}") for v in values],
        *[f"all_{v}" for v in values],
        *[F.when(F.col("_last"), F.col(f"_f_{h}")).otherwise(F.col(f"_n_{h}")).alias(f"next_{h}") for h in head],
    )


def hash_rank(df: DataFrame, keys: list[str], order: Column, tie: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``rank`` (from 1), ``group_size`` and ``hash`` within ``keys``, by a hexadecimal hash and then ``tie``.

    The first hexadecimal digits cut a group into ranges of about ``rows`` rows or fewer.
    ``df`` should hold the keys and the id alone: it is sorted and joined.
    """
    hashed = df.withColumn("_h", order)
    sizes = hashed.groupBy(*keys).agg(F.count("*").alias("group_size"))
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.greatest(F.col("group_size"), F.lit(1)) / rows))).cast("int")
    hashed = join_on(hashed, sizes, keys).withColumn("_range", F.substring(F.col("_h"), F.lit(1), digits))
    hashed = hashed.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_h", tie)))
    counts = hashed.groupBy(*keys, "_range").agg(F.count("*").alias("_c"))
    tw = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_range", F.coalesce(F.sum("_c").over(tw), F.lit(0)).alias("_before"))
    out = join_on(hashed, counts, [*keys, "_range"])
    return out.select(*df.columns, (F.col("_in") + F.col("_before")).cast("long").alias("rank"), F.col("group_size").cast("long"), F.col("_h").alias("hash"))


def hash_parts(df: DataFrame, keys: list[str], order: Column, tie: str, parts: list[tuple[str, Column]], name: str) -> DataFrame:
    """``df`` with ``name``: which part of its group a row is in, by its rank.

    ``parts`` are names and last ranks, expressions of ``group_size``; behind the last it is
    null. Only keys and ids are ranked. What comes back for each group are the hash and id
    at which each part ends, and every row is compared with these, so wide rows are not
    sorted, and not shuffled where the table of groups is small. Rows alike in id are in
    the same part.
    """
    ranked = hash_rank(df.select(*dict.fromkeys([*keys, tie])), keys, order, tie)
    last = [F.max(F.when(F.col("rank") <= end, F.struct(F.col("hash").alias("h"), F.col(tie).alias("i")))).alias(f"_end{k}") for k, (_, end) in enumerate(parts)]
    ends = ranked.groupBy(*keys).agg(*last)
    here = F.struct(order.alias("h"), F.col(tie).alias("i"))
    out = F.when(F.lit(False), F.lit(""))
    for k, (n, _) in enumerate(parts):
        out = out.when(here <= F.col(f"_end{k}"), F.lit(n))
    return join_on(df, ends, keys).withColumn(name, out).drop(*[f"_end{k}" for k in range(len(parts))])
