"""Splits and samples of keyed rows. Order is md5("seed:id"), never a random generator.

Ranks are taken in ranges of the hash, of keys and ids alone, so one large class isn't
sorted in one task and wide rows aren't sorted at all. Rows with a null key column form a
group of their own; ids should be distinct, and rows with equal ids stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_order, join_on
from .prefix import hash_parts, hash_rank


def time_split(df: DataFrame, train_end, val_end, ts: str = "first_seen") -> DataFrame:
    """``split``: train up to train_end, val up to val_end, test behind; null times are left out."""
    if not train_end < val_end:
        raise ValueError("train_end must be before val_end")
    at = F.col(ts)
    return df.where(at.isNotNull()).withColumn("split", F.when(at <= F.lit(train_end), "train").when(at <= F.lit(val_end), "val").otherwise("test"))


def _few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df``, to be broadcast if a count says that it is short, as a list of folds or families is; else Spark pairs partitions."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _cut(rank: Column, ends: list[tuple[str, Column]]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, end in ends:
        out = out.when(rank <= end, name)
    return out


def ratio_split(df: DataFrame, parts: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Rows cut in the proportions of ``parts`` (one row: train, val, test counts).

    Sizes are the floors of the shares; what is left over is dealt one each from train on.
    """
    names = ["train", "val", "test"]
    given = parts.select(*names).first()
    total = sum(given)
    floors = [F.floor(F.col("group_size") * g / total) for g in given]
    left = F.col("group_size") - sum(floors[1:], floors[0])
    ends, end = [], F.lit(0)
    for k, n in enumerate(names):
        end = end + floors[k] + F.when(left > k, 1).otherwise(0)
        ends.append((n, end))
    return hash_parts(df, [], hash_order(id_col, seed), id_col, ends, "split")


def largest_remainder(size: Column, weights: dict[str, float]) -> list[tuple[str, Column]]:
    """Sizes that add up to ``size``; remainders go to the largest fractions, the later part on ties."""
    total = sum(weights.values())
    names = list(weights)
    exact = [size * F.lit(weights[n] / total) for n in names]
    floors = [F.floor(e).cast("long") for e in exact]
    left = size - sum(floors[1:], floors[0])
    rest = [F.round(e - f, 9) for e, f in zip(exact, floors, strict=True)]
    sizes = []
    for k in range(len(names)):
        ahead = sum([((rest[j] > rest[k]) | ((rest[j] == rest[k]) & F.lit(j > k))).cast("int") for j in range(len(names)) if j != k], F.lit(0))
        sizes.append((names[k], floors[k] + (ahead < left).cast("long")))
    return sizes


def stratified_split(df: DataFrame, weights: dict[str, float], label: str, id_col: str, seed: int = 42, name: str = "split") -> DataFrame:
    """``split`` in given proportions within each label."""
    ends, end = [], F.lit(0)
    for n, size in largest_remainder(F.col("group_size"), weights):
        end = end + size
        ends.append((n, end))
    return hash_parts(df, [label], hash_order(id_col, seed), id_col, ends, name)


def stratified_holdout(df: DataFrame, val: float, test: float, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """train, val and test: test is cut first, then val relative to the rest."""
    first = stratified_split(df, {"rest": 1 - test, "test": test}, label, id_col, seed, "_first")
    share = val / (1 - test)
    rest = stratified_split(first.where("_first = 'rest'"), {"train": 1 - share, "val": share}, label, id_col, seed + 1)
    return rest.drop("_first").unionByName(first.where("_first = 'test'").drop("_first").withColumn("split", F.lit("test")))


def stratified_kfold(df: DataFrame, k: int, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """``fold`` from 0, dealt in turn within each label; k is cut to the smallest class, 2 at least."""
    ranked = hash_rank(df.select(*dict.fromkeys([label, id_col])).distinct(), [label], hash_order(id_col, seed), id_col)
    least = ranked.agg(F.min("group_size").alias("_least"))
    folds = F.greatest(F.lit(2), F.least(F.lit(k), F.col("_least")))
    dealt = ranked.crossJoin(F.broadcast(least)).withColumn("fold", ((F.col("rank") - 1) % folds).cast("int"))  # one row
    return join_on(df, dealt.select(*dict.fromkeys([label, id_col]), "fold"), list(dict.fromkeys([label, id_col]))).select(*df.columns, "fold")


def stratified_limit(df: DataFrame, limit: int, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """About ``limit`` rows in the classes' proportions; all where there are no more.

    A class keeps the floor of its share, and the largest fractions one more each.
    """
    classes = df.groupBy(label).agg(F.count("*").alias("_n"))
    every = Window.partitionBy()
    share = F.col("_n") * limit / F.sum("_n").over(every)
    classes = classes.select(label, F.sum("_n").over(every).alias("_total"), share.alias("_share"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("_share") - F.floor("_share"), 9)), F.desc(label)))
    left = limit - F.sum(F.floor("_share")).over(every)
    classes = classes.select(label, F.when(F.col("_total") <= limit, F.col("_total")).otherwise(F.floor("_share") + (place <= left).cast("long")).alias("_keep"))
    ranked = hash_rank(df.select(*dict.fromkeys([label, id_col])), [label], hash_order(id_col, seed), id_col)
    at = F.max(F.when(F.col("rank") <= F.col("_keep"), F.struct(F.col("hash").alias("h"), F.col(id_col).alias("i")))).alias("_last")
    last = join_on(ranked, classes, [label]).groupBy(label).agg(at)
    return join_on(df, last, [label]).where(F.struct(hash_order(id_col, seed).alias("h"), F.col(id_col).alias("i")) <= F.col("_last")).select(*df.columns)


def limit_per_class(df: DataFrame, n: int, label: str, order: str) -> DataFrame:
    """The first n rows of each class by ``order``. Spark limits each partition before the shuffle."""
    w = Window.partitionBy(label).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def partition_validation(df: DataFrame, label: str, id_col: str, ratio: float = 0.5, seed: int = 42, split: str = "split") -> DataFrame:
    """val rows become val_id or val_ood, stratified; all others stay."""
    val = df.where(F.col(split) == "val").drop(split)
    halves = stratified_split(val, {"val_id": 1 - ratio, "val_ood": ratio}, label, id_col, seed, split)
    return df.where(~F.col(split).eqNullSafe(F.lit("val"))).unionByName(halves.select(*df.columns))


def top_families(df: DataFrame, k: int, family: str = "family", seen: str = "position") -> DataFrame:
    """The k families with most rows, the one seen first on ties."""
    counts = df.where(F.col(family).isNotNull()).groupBy(family).agg(F.count("*").alias("n"), F.min(seen).alias("first"))
    return counts.orderBy(F.desc("n"), "first", family).limit(k)


def fold_seed(family: Column, base: int = 42) -> Column:
    """The first 8 hexadecimal digits of md5(family) as a number, plus the base seed."""
    return F.conv(F.substring(F.md5(family.cast("string")), 1, 8), 16, 10).cast("long") + F.lit(base)


def lofo_folds(mal: DataFrame, families: DataFrame, val_ratio: float, id_col: str, family: str = "family", seed: int = 42) -> DataFrame:
    """(fold, held_out_family, id, family, split): one fold for each of a short list of families.

    test is the held-out family. Of any other, round-half-even(n * ratio) rows, 1 to n - 1,
    are val; a family of one row is all train.
    """
    held = _few(families.select(F.col(family).alias("held_out_family")).distinct())
    rows = mal.select(id_col, family).where(F.col(family).isNotNull()).crossJoin(held)
    rows = rows.withColumn("_seed", fold_seed(F.col("held_out_family"), seed))
    order = F.md5(F.concat(F.col("_seed").cast("string"), F.lit(":"), F.col(id_col).cast("string")))
    ranked = hash_rank(rows, ["held_out_family", family], order, id_col)
    n = F.col("group_size")
    val = F.when(n <= 1, 0).otherwise(F.greatest(F.lit(1), F.least(n - 1, F.bround(n * val_ratio).cast("long"))))
    split = F.when(F.col(family) == F.col("held_out_family"), "test").when(F.col("rank") <= val, "val").otherwise("train")
    return ranked.select("held_out_family", id_col, family, split.alias("split"))


def balanced_negatives(benign: DataFrame, counts: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """(held_out_family, id, split): disjoint draws of benign rows with the counts of each fold.

    ``counts`` has held_out_family, train, val and test. A fold whose pool is too small has
    one row with a null id and the split ``missing``.
    """
    few = _few(counts.select("held_out_family", *[F.col(c).alias(f"_{c}") for c in ("train", "val", "test")]))
    need = F.col("_train") + F.col("_val") + F.col("_test")
    pool = benign.agg(F.count("*").alias("_pool"))  # one row
    few = few.crossJoin(F.broadcast(pool)).select("*", need.alias("_need"))

    def ranked(folds: DataFrame, share: Column) -> DataFrame:
        """Ranks of the rows whose hash is in the first ``share`` of all."""
        rows = benign.select(id_col).crossJoin(F.broadcast(folds))
        order = F.md5(F.concat(fold_seed(F.col("held_out_family"), seed).cast("string"), F.lit(":"), F.col(id_col).cast("string")))
        rows = rows.withColumn("_o", order).where(F.conv(F.substring("_o", 1, 8), 16, 10).cast("double") < share * 2.0**32)
        return hash_rank(rows, ["held_out_family"], F.col("_o"), id_col)

    # a draw takes the smallest hashes: those in twice the share wanted, and some more, nearly always hold it
    share = F.least(F.lit(1.0), (2 * F.col("_need") + 50) / F.greatest(F.col("_pool"), F.lit(1)))
    enough = few.where("_need <= _pool")
    first = ranked(enough, share).where("group_size >= _need and rank <= _need")
    missed = enough.join(first.select("held_out_family").distinct(), "held_out_family", "left_anti").where("_need > 0")
    drawn = first.unionByName(ranked(missed, F.lit(1.0)).where("rank <= _need"))
    cut = _cut(F.col("rank"), [("train", F.col("_train")), ("val", F.col("_train") + F.col("_val")), ("test", F.col("_need"))])
    short = few.where("_need > _pool").select("held_out_family", F.lit(None).cast(benign.schema[id_col].dataType).alias(id_col), F.lit("missing").alias("split"))
    return drawn.select("held_out_family", id_col, cut.alias("split")).unionByName(short)


def apply_split(docs: DataFrame, folds: DataFrame, name: str, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` with the split that a fold gives them."""
    return docs.join(folds.where(F.col("fold") == name).select(id_col, "split"), id_col)


def check_splits(splits: DataFrame, docs: DataFrame, id_col: str = "doc_id", label: str = "label") -> DataFrame:
    """(check, fold, detail) of each violation: unknown ids, labels other than 0 and 1, splits with
    one class or no rows, ids in two splits of a fold. Null folds are a fold."""
    known = docs.select(F.col(id_col), F.col(label).alias("_y"), F.lit(True).alias("_in"))
    rows = splits.select("fold", "split", id_col).join(known, id_col, "left")
    text = lambda c: F.col(c).cast("string")
    lost = rows.where("_in is null").select(F.lit("unknown id").alias("check"), "fold", text(id_col).alias("detail"))
    bad = rows.where("_in and (_y is null or _y not in (0, 1))").select(F.lit("label").alias("check"), "fold", text(id_col).alias("detail"))
    one = rows.where("_in").groupBy("fold", "split").agg(F.count_distinct("_y").alias("c")).where("c < 2").select(F.lit("one class").alias("check"), "fold", text("split").alias("detail"))
    twice = rows.groupBy("fold", id_col).agg(F.count_distinct("split").alias("c")).where("c > 1").select(F.lit("in two splits").alias("check"), "fold", text(id_col).alias("detail"))
    have = splits.groupBy("fold").agg(F.collect_set("split").alias("s")).select("fold", F.explode(F.array_except(F.array(F.lit("train"), F.lit("val"), F.lit("test")), "s")).alias("detail"))
    empty = have.select(F.lit("empty split").alias("check"), "fold", "detail")
    return lost.unionByName(bad).unionByName(one).unionByName(twice).unionByName(empty)


def check_alignment(a: DataFrame, b: DataFrame, id_col: str = "sample_id", label: str = "label") -> DataFrame:
    """(check, id): ids that one table lacks, and ids with another label in the other."""
    x = a.select(F.col(id_col), F.col(label).alias("_a"), F.lit(True).alias("_ina"))
    y = b.select(F.col(id_col), F.col(label).alias("_b"), F.lit(True).alias("_inb"))
    both = x.join(y, id_col, "full")
    what = F.when(F.col("_inb").isNull(), "missing right").when(F.col("_ina").isNull(), "missing left").when(~F.col("_a").eqNullSafe(F.col("_b")), "label differs")
    return both.select(what.alias("check"), F.col(id_col).cast("string").alias("id")).where("check is not null")
