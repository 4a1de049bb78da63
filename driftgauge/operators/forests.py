"""Deep forests without their trees on the driver.

A forest without a bound of depth has about as many nodes as rows and trees. Spark ML holds them all on the
driver. Here rows are cut into bins, packed in blocks and broadcast, as long as they take ``max_cells`` bytes at
most. Trees are dealt over tasks: a task grows a tree level by level, leads the test rows down with the others and adds
up their scores, so that no tree leaves it. More rows are fitted by Spark ML, few trees at a time: the driver holds ``max_nodes``, or one tree where it has more.

A tree draws its rows by a hash of their ids (Poisson of mean 1), each node the square root of the columns. Bins, Gini gain,
depth and the mean of the leaves' shares are those of Spark ML.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import stored

BINS = 32
#: Distribution function of Poisson(1); a draw is how many of these lie under a uniform number.
_POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


def _uniform(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Numbers in [0, 1) from hashes of 64-bit ids (splitmix64)."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(((seed << 32) + tree) * 0xD1342543DE82EF95 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) / float(1 << 53)


def _best_splits(bins: np.ndarray, own: np.ndarray, nodes: int, tried: np.ndarray, w: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column and last bin to the left of each node's best split by Gini gain, and whether there is any; ``own`` is the node of a row."""
    total, positives = np.bincount(own, w, nodes), np.bincount(own, pos, nodes)
    best, column, cut = np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    gini = lambda n, p: 2 * p * (n - p) / np.maximum(n, 1)
    impurity = gini(total, positives)
    for f in tried.T:
        key = own * BINS + bins[np.arange(len(own)), f[own]]
        n, p = (np.bincount(key, v, nodes * BINS).reshape(nodes, BINS).cumsum(1)[:, :-1] for v in (w, pos))
        gain = impurity[:, None] - gini(n, p) - gini(total[:, None] - n, positives[:, None] - p)
        gain[(n == 0) | (n == total[:, None])] = 0
        at = gain.argmax(1)
        got = gain[np.arange(nodes), at]
        better = got > best + 1e-9
        best[better], column[better], cut[better] = got[better], f[better], at[better]
    return column, cut, best > 0


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator, depth: int = 30, chunk: int = 4096) -> np.ndarray:
    """Share of class 1 in the leaf of each row, of a tree grown by the rows with a weight. Nodes of a level are taken ``chunk`` at a time."""
    d, score = bins.shape[1], np.zeros(len(y))
    rows, node, nodes = np.arange(len(y)), np.zeros(len(y), np.int64), 1
    pos = w * y
    for level in range(depth + 1):
        total, positives = np.bincount(node, w[rows], nodes), np.bincount(node, pos[rows], nodes)
        open_ = (positives > 0) & (positives < total) & (level < depth)
        column, cut, split = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes, bool)
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        ends = np.searchsorted(node, np.arange(nodes + 1))
        for a in range(0, nodes, chunk):
            b = min(a + chunk, nodes)
            tried = rng.random((b - a, d)).argpartition(min(int(np.ceil(np.sqrt(d))), d) - 1, 1)[:, : int(np.ceil(np.sqrt(d)))]
            mine = np.arange(ends[a], ends[b])
            mine = mine[open_[node[mine]] & (w[rows[mine]] > 0)]
            if len(mine):
                r = rows[mine]
                column[a:b], cut[a:b], split[a:b] = _best_splits(bins[r], node[mine] - a, b - a, tried, w[r], pos[r])
        done = ~split[node]
        score[rows[done]] = (positives / np.maximum(total, 1e-300))[node[done]]
        rows, node = rows[~done], node[~done]
        if not len(rows):
            break
        number = np.cumsum(split) - 1
        node, nodes = number[node] * 2 + (bins[rows, column[node]] > cut[node]), 2 * int(split.sum())
    return score


def _blocks(rows: DataFrame, splits: np.ndarray) -> DataFrame:
    """Blocks of rows: ids, classes, which train, and bins of the columns."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            bins = np.stack([np.searchsorted(s, v, "left") for s, v in zip(splits, x.T, strict=True)], 1).astype(np.uint8)
            data = [b.column("sample_id").to_numpy().astype("<i8"), b.column("y").to_numpy().astype("i1"), b.column("train").to_numpy(zero_copy_only=False).astype("i1"), bins]
            yield pa.RecordBatch.from_arrays([pa.array([d.tobytes()], pa.binary()) for d in data], names=["ids", "y", "train", "bins"])

    # ids that are no whole numbers are drawn and told apart by a hash
    key = F.col("sample_id").cast("long") if isinstance(rows.schema["sample_id"].dataType, IntegralType) else F.xxhash64("sample_id")
    return rows.select(key.alias("sample_id"), "y", "train", F.col("features").cast("array<double>")).mapInArrow(run, "ids binary, y binary, train binary, bins binary")


def forest_scores(train: DataFrame, test: DataFrame, trees: int, seed: int = 42, max_cells: int = 1 << 26) -> DataFrame:
    """(y, score) of ``test`` by a forest of trees as deep as Spark ML allows. Needs sample_id, y, features."""
    both = stored(train.select("sample_id", "y", "features", F.lit(True).alias("train")).unionByName(test.select("sample_id", "y", "features", F.lit(False).alias("train"))))
    size = both.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
    if (size.n or 0) * ((size.d or 0) + 10) > max_cells:
        return _by_spark(both.where("train"), both.where("not train"), trees, seed)
    shares = [float(q) for q in np.arange(1, BINS) / BINS]
    one = both.where("train").select(F.posexplode("features").alias("j", "v")).groupBy("j").agg(F.percentile_approx("v", shares, 10_000).alias("q"))
    splits = [np.array(r.q) for r in one.orderBy("j").collect()]  # BINS numbers for each column
    spark, d = both.sparkSession, len(splits)
    tasks = max(1, min(trees, 4 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]):
        mine, parts = {}, []
        for b in batches:
            for i, tree in enumerate(b.column("id").to_pylist()):
                mine[tree] = None
                if tree == next(iter(mine)):  # all trees have the same blocks
                    raw = lambda n, t: np.frombuffer(b.column(n)[i].as_buffer(), t)  # noqa: B023, E731
                    parts.append((raw("ids", "<i8"), raw("y", "i1"), raw("train", "i1") == 1, raw("bins", np.uint8).reshape(-1, d)))
        if not parts:
            return
        ids, y, known, bins = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(ids, kind="stable")
        ids, y, known, bins = ids[order], y[order].astype(float), known[order], bins[order]
        total = np.zeros(int((~known).sum()))
        for tree in mine:
            w = np.where(known, np.searchsorted(_POISSON, _uniform(ids, seed, tree), "right"), 0).astype(float)
            led = (w > 0) | ~known
            total += grow(bins[led], y[led], w[led], np.random.default_rng([seed, tree]))[~known[led]]
        yield pa.RecordBatch.from_arrays([pa.array(ids[~known]), pa.array(y[~known].astype(np.int32)), pa.array(total)], names=["sample_id", "y", "total"])

    dealt = spark.range(0, trees, 1, tasks).join(F.broadcast(stored(_blocks(both, splits))))
    told = dealt.mapInArrow(run, "sample_id long, y int, total double")
    return told.groupBy("sample_id", "y").agg((F.sum("total") / trees).alias("score")).select("y", "score")


def _by_spark(train: DataFrame, test: DataFrame, trees: int, seed: int, max_nodes: int = 4_000_000) -> DataFrame:
    """The same by Spark ML, few trees at a time: a tree has no more than twice as many nodes as rows."""
    from pyspark.ml.classification import RandomForestClassifier

    from .models import Head, _vectors

    each, rows, parts = max(1, min(trees, max_nodes // max(2 * train.count(), 1))), _vectors(train), []
    for at in range(0, trees, each):  # parts of the forest
        n = min(each, trees - at)
        forest = RandomForestClassifier(numTrees=n, maxDepth=30, maxMemoryInMB=512, cacheNodeIds=True, featuresCol="_v", labelCol="label", seed=seed + at)
        parts.append(stored(Head(forest.fit(rows)).score(test).select("sample_id", "y", (F.col("score") * n).alias("total"))))
    return reduce(DataFrame.unionByName, parts).groupBy("sample_id", "y").agg((F.sum("total") / trees).alias("score")).select("y", "score")
