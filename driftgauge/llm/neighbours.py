"""Approximate nearest neighbours: NN-descent by Spark joins, then greedy graph search.

Index
1. Equal vectors are one node; a node keeps its ``k + 1`` smallest ids, which is all that
   a list of k can need of it, so a hot vector is as cheap as any other.
2. For largest inner product, vectors get one more component e that makes all lengths
   equal to the longest, R; neighbours in the graph are those of the lengthened vectors.
   Similarities are kept less R^2, from e - R, so that one vector of a thousand times the
   length doesn't drown the differences of all others.
3. First lists: nodes are sorted by the signs of random projections, in several orders;
   within each stretch of an order all pairs are compared.
4. NN-descent: around every node its neighbours, and the best of those that name it, are
   compared with each other, and each takes what is better than its worst neighbour.
   Nodes are joined area by area, some neighbouring stretches of the first order: an area
   receives each vector it needs once, and sends back only improvements. Lists hold ``degree`` neighbours, so what a node
   sends and receives is bounded. Steps are repeated until under ``QUIET`` of all list
   places change in one.

Search: equal queries are one. From a start node, the best ``EXPANDED`` of each query's
unexpanded nodes are joined with their neighbours, and of what these score the best
``beam`` stay; it goes on until no query has an unexpanded node among its best, however
many hops that takes. (It ends: what falls out of the best never comes back.) Candidates
are scored in cells: the queries of an area, and a ``PARTS``-th of all nodes. A cell
receives each vector and each query it needs once, and sends back only what is better
than a query's worst. The hops score in single precision; scores and ranks of the result
are inner products of the given vectors in double precision.

Nothing is compared outside stretches and neighbourhoods, hence recall below 1; the
tests measure it against brute force (0.9 or more is asked for).

Nulls: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components take no part; rows with a null id neither. Repeated rows are one,
and only the id and the vector are read, so other columns can't clash.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored, table

DEGREE = 40
ORDERS = 5
STRETCH = 512
#: Nodes of a sorted part, and the least and most of an area, a tenth of all nodes between. What an area receives is at most
#: its nodes' neighbourhoods, ``2 * DEGREE`` vectors a node, and in fact far fewer different ones.
SPAN, AREA = 4096, (1024, 25_000)
#: New improvements of an area between two cuts.
HELD = 2_000_000
QUIET = 0.02
BEAM = 224
EXPANDED = 64
PARTS = 8


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) with v as doubles, of vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (usual.d if usual else 0)).distinct()


def _prepare(longest: float, middle: list[float], seed: int):
    dim, middle = len(middle), np.array(middle)
    turns = np.random.default_rng(seed).standard_normal((ORDERS, dim, 20))

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("v").to_pylist(), np.float64).reshape(len(batch), dim)
            n2 = (x * x).sum(1)
            short = -n2 / (longest + np.sqrt(np.maximum(longest * longest - n2, 0)))  # e - R
            y = np.hstack([x, short[:, None], longest * short[:, None]]).astype(np.float32)
            codes = [(((x - middle) @ p > 0) @ (1 << np.arange(20)[::-1])).astype(np.int32) for p in turns]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in y], pa.binary()), pa.array(list(np.stack(codes, 1)), pa.list_(pa.int32()))],
                names=["node", "x", "y", "codes"],
            )

    return run


def similarities(y: np.ndarray) -> np.ndarray:
    """Inner products of all lengthened vectors, less the square of their length."""
    return y[:, :-1] @ y[:, :-1].T + y[:, -1:] + y[:, -1]


def _best(sims: np.ndarray, degree: int) -> np.ndarray:
    """Column numbers of the best of each row, the best first."""
    k = min(degree, sims.shape[1])
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)


LISTS = "node long, nbrs array<long>, sims array<float>"


def _lists(node, nbrs, sims, **more):
    kinds = {"nbrs": pa.list_(pa.int64()), "sims": pa.list_(pa.float32())}
    cols = {"node": pa.array(node, pa.int64()), "nbrs": pa.array(nbrs, kinds["nbrs"]), "sims": pa.array(sims, kinds["sims"])} | more
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _stretches(batches):
    """All pairs within each stretch of the sorted rows, and the number of the stretch along all of them."""
    part = TaskContext.get().partitionId()
    node, y = [], []
    for b in batches:
        node += b.column("node").to_pylist()
        y += b.column("y").to_pylist()
    if not node:
        return
    node = np.array(node, np.int64)
    y = np.frombuffer(b"".join(y), np.float32).reshape(len(node), -1)
    for at, rows in enumerate(np.array_split(np.arange(len(node)), max(1, len(node) // STRETCH))):
        sims = similarities(y[rows])
        np.fill_diagonal(sims, -np.inf)
        top = _best(sims, min(DEGREE, len(rows) - 1)) if len(rows) > 1 else np.zeros((len(rows), 0), np.int64)
        yield _lists(node[rows], list(node[rows][top]), list(np.take_along_axis(sims, top, 1)), stretch=pa.array([part * SPAN // STRETCH + min(at, SPAN // STRETCH - 1)] * len(rows), pa.int64()))


def _merge(batches):
    """One list of the best distinct neighbours from several, and how many of them are new."""
    for batch in batches:
        nbrs, sims, news = [], [], []
        for lists in batch.column("lists").to_pylist():
            n = np.array([x for m in lists for x in m["nbrs"]], np.int64)
            s = np.array([x for m in lists for x in m["sims"]], np.float32)
            new = np.repeat([m["found"] for m in lists], [len(m["nbrs"]) for m in lists]).astype(bool)
            order = np.lexsort((new, n, -s))
            _, first = np.unique(n[order], return_index=True)
            keep = order[np.sort(first)[:DEGREE]]
            nbrs.append(n[keep])
            sims.append(s[keep])
            news.append(int(new[keep].sum()))
        yield _lists(batch.column("node"), nbrs, sims, news=pa.array(news, pa.int64()))


def merged(known: DataFrame, found: DataFrame | None = None) -> DataFrame:
    lists = known.select("node", "nbrs", "sims", F.lit(False).alias("found"))
    if found is not None:
        lists = lists.unionByName(found.withColumn("found", F.lit(True)))
    return lists.groupBy("node").agg(F.collect_list(F.struct("nbrs", "sims", "found")).alias("lists")).mapInArrow(_merge, LISTS + ", news long")


def _join(around: pa.Table, vectors: pa.Table) -> pa.Table:
    """Improvements found in one stretch: neighbours of a node compared with each other."""
    if not len(around) or not len(vectors):
        return pa.table(_lists([], [], []).to_pydict(), schema=_lists([], [], []).schema)
    node = vectors.column("node").to_numpy()
    y = np.frombuffer(b"".join(vectors.column("y").to_pylist()), np.float32).reshape(len(node), -1)
    worst = vectors.column("worst").to_numpy()
    order = np.argsort(node)
    node, y, worst = node[order], y[order], worst[order]
    us, ws, ss, held = [], [], [], 0

    def best(us, ws, ss):
        """The best ``DEGREE`` different improvements of each node."""
        u, w, s = np.concatenate(us), np.concatenate(ws), np.concatenate(ss)
        _, first = np.unique(u.astype(np.int64) * len(node) + w, return_index=True)
        u, w, s = u[first], w[first], s[first]
        order = np.lexsort((w, -s, u))
        u, w, s = u[order], w[order], s[order]
        starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, np.int64)
        keep = np.arange(len(u)) - np.repeat(starts, np.diff(np.r_[starts, len(u)])) < DEGREE
        return u[keep], w[keep], s[keep]

    for members in around.column("members").to_pylist():
        m = np.searchsorted(node, np.unique(np.array(members, np.int64)))
        sims = similarities(y[m])
        np.fill_diagonal(sims, -np.inf)
        i, j = np.nonzero(sims > worst[m][:, None])
        us.append(m[i])
        ws.append(m[j])
        ss.append(sims[i, j])
        held += len(i)
        if held > HELD:  # cut as they come: what is held doesn't grow with the area's improvements
            us, ws, ss = ([x] for x in best(us, ws, ss))
            held = 0
    u, w, s = best(us, ws, ss)
    if not len(u):
        return pa.table(_lists([], [], []).to_pydict(), schema=_lists([], [], []).schema)
    starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
    ends = np.r_[starts[1:], len(u)]
    return pa.Table.from_batches([_lists(node[u[starts]], [node[w[a:b]] for a, b in zip(starts, ends, strict=True)], [s[a:b] for a, b in zip(starts, ends, strict=True)])])


def around_each(graph: DataFrame) -> DataFrame:
    """(node, m): the neighbours of each node, and the best ``DEGREE`` of those that name it."""
    edges = graph.select("node", F.explode(F.arrays_zip("nbrs", "sims")).alias("e")).select("node", F.col("e.nbrs").alias("nbr"), F.col("e.sims").alias("sim"))
    namers = Window.partitionBy("nbr").orderBy(F.desc("sim"), "node")
    back = edges.withColumn("r", F.row_number().over(namers)).where(F.col("r") <= DEGREE).select(F.col("nbr").alias("node"), F.col("node").alias("m"))
    return edges.select("node", F.col("nbr").alias("m")).unionByName(back)


class Index:
    """``nodes`` (node, x, y), ``members`` (node, id) and ``graph`` (node, nbrs)."""

    def __init__(self, vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7):
        rows = usable(vectors, id_col, vec_col)
        named = rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(9), "v").alias("h2"))
        one = named.groupBy("h1", "h2").agg(F.first("v").alias("v"))
        one = stored(one.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "v"), "vectors")
        self.nodes_by_hash = one.select("node", "h1", "h2")
        lowest = Window.partitionBy("h1", "h2").orderBy("id")
        few = named.select("id", "h1", "h2").withColumn("r", F.row_number().over(lowest)).where(F.col("r") <= k + 1)
        self.members = stored(few.join(self.nodes_by_hash, ["h1", "h2"]).select("node", "id"), "members")
        stats = one.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("n2"), F.count("*").alias("n")).first()
        self.size = stats.n
        middle = one.agg(vector_to_array(Summarizer.mean(array_to_vector("v")))).first()[0] if self.size else []
        self.dim = len(middle)
        prepared = one.select("node", "v").mapInArrow(_prepare(float(np.sqrt(stats.n2 or 0.0)), middle, seed), "node long, x binary, y binary, codes array<int>")
        nodes = stored(prepared, "nodes")
        self.nodes = nodes.select("node", "x", "y")
        parts = max(1, self.size // SPAN)
        # areas grow with the nodes, so that a node's neighbourhood is spread over as few of them
        self.area = min(max(self.size / 10, AREA[0]), AREA[1])
        first = None
        for o in range(ORDERS):
            spread = nodes.select("node", "y", F.element_at("codes", o + 1).alias("c"), F.xxhash64("node").alias("h"))
            lists = spread.repartitionByRange(parts, "c", "h").sortWithinPartitions("c", "h").select("node", "y").mapInArrow(_stretches, LISTS + ", stretch long")
            lists = stored(lists, "lists")
            if o == 0:
                places = lists.select("node", F.floor(F.col("stretch") / max(1, round(self.area / STRETCH))).cast("long").alias("stretch"))
            first = lists.drop("stretch") if first is None else first.unionByName(lists.drop("stretch"))
        graph, news = stored(merged(first), "graph"), self.size
        while news > QUIET * DEGREE * self.size:
            graph, last = self.improved(graph, places), graph
            discard(last)
            news = graph.agg(F.sum("news")).first()[0] or 0
        # a search also goes from a node to the best of those that name it
        self.places = stored(places, "places")
        self.graph = stored(around_each(graph).groupBy("node").agg(F.collect_set("m").alias("nbrs")), "ways")
        discard(graph)

    def improved(self, graph: DataFrame, places: DataFrame) -> DataFrame:
        """One step of NN-descent."""
        around = around_each(graph).groupBy("node").agg(F.collect_set("m").alias("members"))
        around = stored(around.join(places, "node").select("stretch", "members"), "around")
        worst = F.when(F.size("sims") < DEGREE, F.lit(float("-inf"))).otherwise(F.array_min("sims")).cast("float")
        wanted = around.select(F.col("stretch").alias("at"), F.explode("members").alias("node")).distinct()
        vectors = wanted.join(self.nodes.select("node", "y").join(graph.select("node", worst.alias("worst")), "node"), "node")
        found = around.groupBy("stretch").cogroup(vectors.groupBy("at")).applyInArrow(_join, LISTS)
        out = stored(merged(graph, found), "graph")
        discard(around)
        return out

    def search(self, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = BEAM) -> DataFrame:
        """(query_id, rank, id, score): the k best rows found for each query, its own id apart."""
        q = usable(queries, id_col, vec_col).where(F.size("v") == self.dim)
        q = q.select(F.col("id").alias("q"), "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(9), "v").alias("h2"))
        # an indexed vector starts at its own node, any other at a few fixed ones
        entries = [r.node for r in self.nodes.select("node").orderBy(F.xxhash64("node")).limit(8).collect()]
        one = q.groupBy("h1", "h2").agg(F.first("v").alias("v")).join(self.nodes_by_hash, ["h1", "h2"], "left").join(self.places, "node", "left")
        starts = F.when(F.col("node").isNotNull(), F.array("node")).otherwise(F.array(*[F.lit(e) for e in entries]) if entries else F.array().cast("array<long>"))
        queries = stored(one.select("h1", "h2", "v", starts.alias("starts"), "stretch", F.monotonically_increasing_id().alias("n")), "queries")
        blocks = max(1, ceil(queries.count() / self.area))
        block = F.coalesce("stretch", F.pmod(F.xxhash64("n"), F.lit(blocks)))
        beam = max(beam, k + 1)
        empty = [F.array().cast(f"array<{t}>").alias(n) for n, t in (("nodes", "long"), ("scores", "float"), ("done", "boolean"))]
        state, hop = stored(queries.select("n", block.alias("block"), F.col("starts").alias("fresh"), *empty), "beam"), 0
        while not state.where(F.size("fresh") > 0).isEmpty():
            pairs = state.select("n", "block", F.explode("fresh").alias("node"))
            if hop:
                pairs = pairs.join(self.graph, "node").select("n", "block", F.explode("nbrs").alias("node"))
            cell = F.xxhash64("block", F.pmod(F.xxhash64("node"), F.lit(PARTS)))
            cells = stored(pairs.groupBy(cell.alias("cell"), "n").agg(F.collect_set("node").alias("ms")), "cells")
            needed = cells.select(F.col("cell").alias("of"), F.explode("ms").alias("node")).distinct().join(self.nodes.select("node", "y"), "node")
            worst = F.when(F.size("scores") >= beam, F.array_min("scores")).otherwise(F.lit(float("-inf"))).cast("float")
            asking = cells.join(state.select("n", worst.alias("worst")), "n").join(queries.select("n", "v"), "n")
            found = asking.groupBy("cell").cogroup(needed.groupBy("of")).applyInArrow(_score_cell(beam), "n long, nodes array<long>, scores array<float>")
            got = found.groupBy("n").agg(F.collect_list(F.struct("nodes", "scores")).alias("found"))
            last, state = state, stored(state.join(got, "n", "left").mapInArrow(_hop(beam), state.schema), "beam")
            discard(last)
            discard(cells)
            hop += 1
        best = state.select("n", F.explode("nodes").alias("node")).join(self.nodes.select("node", "x"), "node").join(queries.select("n", "v"), "n")
        exact = best.select("n", "node", "v", "x").mapInArrow(_exact, "n long, node long, score double")
        order = [F.desc("score"), "id"]
        rows = exact.join(self.members, "node").withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(*order))).where(F.col("r") <= k + 1)
        rows = q.select("q", "h1", "h2").join(queries.select("h1", "h2", "n"), ["h1", "h2"]).join(rows.select("n", "id", "score"), "n").where("q <> id")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(*order))
        return rows.select(F.col("q").alias("query_id"), rank.alias("rank"), F.col("id").alias(id_col), "score").where(F.col("rank") <= k)


def _score_cell(beam: int):
    """For each query of a cell the best of its candidates there that beat its worst."""

    def run(asking: pa.Table, needed: pa.Table) -> pa.Table:
        node = needed.column("node").to_numpy()
        y = np.frombuffer(b"".join(needed.column("y").to_pylist()), np.float32).reshape(len(node), -1)[:, :-2]
        order = np.argsort(node)
        node, y = node[order], y[order]
        ns, nodes, scores = [], [], []
        for n, ms, worst, v in zip(*[asking.column(c).to_pylist() for c in ("n", "ms", "worst", "v")], strict=True):
            at = np.searchsorted(node, np.array(ms, np.int64))
            s = y[at] @ np.array(v, np.float32)
            keep = np.flatnonzero(s > worst)
            keep = keep[np.lexsort((at[keep], -s[keep]))[:beam]]
            if len(keep):
                ns.append(n)
                nodes.append(node[at[keep]])
                scores.append(s[keep])
        return pa.table({"n": pa.array(ns, pa.int64()), "nodes": pa.array(nodes, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float32()))})

    return run


def _hop(beam: int):
    """Merge what was found into the best of each query, and choose what to expand next."""
    names = ["n", "block", "fresh", "nodes", "scores", "done"]

    def run(batches):
        for batch in batches:
            out = {c: [] for c in names[2:]}
            for nodes, scores, done, fresh, found in zip(*[batch.column(c).to_pylist() for c in ("nodes", "scores", "done", "fresh", "found")], strict=True):
                expanded = np.array(fresh if nodes else [], np.int64)
                n = np.concatenate([np.array(nodes, np.int64), *[np.array(f["nodes"], np.int64) for f in found or []]])
                s = np.concatenate([np.array(scores, np.float32), *[np.array(f["scores"], np.float32) for f in found or []]])
                d = np.zeros(len(n), bool)
                d[: len(nodes)] = np.array(done, bool)
                n, first = np.unique(n, return_index=True)  # the first of equal ones is that of the beam
                s, d = s[first], d[first] | np.isin(n, expanded)
                keep = np.lexsort((n, -s))[:beam]
                n, s, d = n[keep], s[keep], d[keep]
                out["nodes"].append(n)
                out["scores"].append(s)
                out["done"].append(d)
                out["fresh"].append(n[~d][:EXPANDED])
            kinds = {"fresh": pa.int64(), "nodes": pa.int64(), "scores": pa.float32(), "done": pa.bool_()}
            yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("block"), *[pa.array(out[c], pa.list_(t)) for c, t in kinds.items()]], names=names)

    return run


def _exact(batches):
    for batch in batches:
        score = [float(np.dot(np.frombuffer(x, np.float64), np.array(v))) for x, v in zip(batch.column("x").to_pylist(), batch.column("v").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("node"), pa.array(score, pa.float64())], names=["n", "node", "score"])


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return Index(vectors).search(vectors.where("vec_id % 20 = 0"))
