"""Heads of many groups: logistic by Newton steps, ridge by sums.

Rows have the keys of their group, a sample_id, y, features (array<double>) and ``m``, an array of (k, split):
which of the group's heads a row trains or is scored by. So k folds are k heads over one copy of
the rows. A logistic head standardises by its training rows (population deviation).

A group of up to ``max_train`` rows is fitted in one task. Larger groups are fitted together: each Newton
step of all of them, and of all values of C, is one job that adds up gradients and matrices of second derivatives
and solves for the steps where these are; only weights reach the driver. Both find the same optimum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as M
from . import solvers as S
from .common import join_on, stored

ALL = "_all"
MEMBERS = "array<struct<k:int,split:string>>"


def standard(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return (x - mean) / np.where(std == 0, 1, std)


def derivatives(x: np.ndarray, y: np.ndarray, s: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log losses at w, gradient and second derivatives, the intercept last."""
    z = x @ w[:-1] + w[-1]
    loss, d = S.losses(z, y, s)
    p = S.sigmoid(z)
    a = s * p * (1 - p)
    xa = x * a[:, None]
    edge = xa.sum(0)
    return loss, np.append(x.T @ d, d.sum()), np.block([[x.T @ xa, edge[:, None]], [edge[None], np.array([[a.sum()]])]])


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _splits(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
    """Row, head and split of every entry of ``m``."""
    row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = column.flatten()
    return row, flat.field("k").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("split").to_pylist()


def _one(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def fit_heads(rows: DataFrame, keys: list[str], grid: tuple[float, ...], balanced: bool = True, max_train: int = 20_000) -> DataFrame:
    """(keys, k, sample_id, split, y, scores) of every row and head that it doesn't train; ``scores`` has one for each C.

    Scores are null where a head's training rows lack a class.
    """
    rows = rows.select(*keys, "sample_id", F.col("y").cast("int").alias("y"), F.col("features").cast("array<double>").alias("features"), F.col("m").cast(MEMBERS).alias("m"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max_train).drop("_n").collect()
    if not sizes:
        return _in_tasks(rows, keys, grid, balanced)
    # each of these has over ``max_train`` rows, so they are few
    large = rows.sparkSession.createDataFrame([(*r, g) for g, r in enumerate(sizes)], ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", _g int")
    marked = join_on(rows, F.broadcast(large), keys, "left")
    small = _in_tasks(marked.where("_g is null").drop("_g"), keys, grid, balanced)
    spread = marked.where("_g is not null").repartitionByRange("_g", F.xxhash64("sample_id")).sortWithinPartitions("_g")
    return small.unionByName(_together(stored(spread), keys, grid, balanced))


def _schema(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in [*keys, "sample_id"])


def _in_tasks(rows: DataFrame, keys: list[str], grid: tuple[float, ...], balanced: bool) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        x, y = _matrix(_one(t.column("features"))), t.column("y").to_numpy()
        row, head, split = _splits(_one(t.column("m")))
        trains, out = np.array([s == "train" for s in split], bool), []
        for k in np.unique(head).tolist():
            mine, rest = row[(head == k) & trains], np.flatnonzero((head == k) & ~trains)
            known = y[mine]
            n1 = int((known == 1).sum())
            scores: pa.Array = pa.nulls(len(rest), pa.list_(pa.float64()))
            if n1 and n1 < len(known):
                w0, w1 = S.class_weights(len(known) - n1, n1, balanced)
                s = np.where(known == 1, w1, w0)
                mean, std = x[mine].mean(0), x[mine].std(0)
                a, b = standard(x[mine], mean, std), standard(x[row[rest]], mean, std)
                found = [S.run(S.newton(x.shape[1]), lambda w, c=c: S.direction(w, c, *derivatives(a, known, s, w))) for c in grid]
                scores = pa.array(list(np.stack([S.sigmoid(b @ w[:-1] + w[-1]) for w in found], 1)), pa.list_(pa.float64()))
            some = t.select([*keys, "sample_id", "y"]).take(pa.array(row[rest]))
            out.append(some.append_column("k", pa.array(np.full(len(rest), k, np.int32))).append_column("split", pa.array([split[i] for i in rest], pa.string())).append_column("scores", scores))
        order = [*keys, "sample_id", "y", "k", "split", "scores"]
        return pa.concat_tables(out).select(order) if out else t.slice(0, 0).select([*keys, "sample_id", "y"]).append_column("k", pa.nulls(0, pa.int32())).append_column("split", pa.nulls(0, pa.string())).append_column("scores", pa.nulls(0, pa.list_(pa.float64())))

    return rows.groupBy(*keys).applyInArrow(run, f"{_schema(rows, keys)}, y int, k int, split string, scores array<double>")


def _by_group(batches: Iterator[pa.RecordBatch], columns: list[str]):
    """(group, columns) of stretches of rows sorted by group."""
    for b in batches:
        g = b.column("_g").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
        for a, e in zip(cuts, cuts[1:], strict=False):
            if a < e:
                yield int(g[a]), [b.column(c).slice(a, e - a) for c in columns]


def _added(rows: DataFrame, answer) -> DataFrame:
    """(id, part): ``answer(group, x, y, row, head, split)`` gives (id, array) pairs, which are added up by id."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        last = None

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["id", "part"])

        for g, (f, y, m) in _by_group(batches, ["features", "y", "m"]):
            if g != last and total:  # one group's matrices at a time
                yield out()
                total = {}
            last = g
            for i, part in answer(g, _matrix(f), y.to_numpy(), *_splits(m)):
                total[i] = total[i] + part if i in total else part
        if total:
            yield out()

    return S.added(rows.select("_g", "features", "y", "m").mapInArrow(run, "id long, part binary"), ["id"])


def _values(parts: DataFrame) -> dict[int, np.ndarray]:
    return {r.id: np.frombuffer(bytes(r.part), "<f8") for r in parts.collect()}


def _together(rows: DataFrame, keys: list[str], grid: tuple[float, ...], balanced: bool) -> DataFrame:
    heads = 1 << 20  # a head is group * heads + k; with C, (head * len(grid)) + number of C

    def each(g, row, head, split):
        for k in np.unique(head).tolist():
            yield g * heads + k, row[(head == k) & np.array([s == "train" for s in split], bool)]

    def count(g, x, y, row, head, split):
        for i, own in each(g, row, head, split):
            yield i, np.concatenate([[(y[own] == 0).sum(), (y[own] == 1).sum()], x[own].sum(0)])

    sums = _values(_added(rows, count))
    mean = {i: v[2:] / max(v[0] + v[1], 1) for i, v in sums.items()}

    def spread(g, x, y, row, head, split):
        for i, own in each(g, row, head, split):
            yield i, ((x[own] - mean[i]) ** 2).sum(0)

    std = {i: np.sqrt(v / max(sums[i][0] + sums[i][1], 1)) for i, v in _values(_added(rows, spread)).items()}
    weights = {i: S.class_weights(v[0], v[1], balanced) for i, v in sums.items() if v[0] and v[1]}

    def evaluate(asked: dict[int, np.ndarray]) -> dict:
        def both(g, x, y, row, head, split):
            for i, own in each(g, row, head, split):
                at = [i * len(grid) + j for j in range(len(grid)) if i * len(grid) + j in asked]
                if at and len(own):
                    a, known = standard(x[own], mean[i], std[i]), y[own]
                    s = np.where(known == 1, weights[i][1], weights[i][0])
                    for n in at:
                        loss, grad, h = derivatives(a, known, s, asked[n])
                        yield n, np.concatenate([[loss], grad, h.reshape(-1)])

        def solve(batches):
            for b in batches:
                values, moves = [], []
                for n, raw in zip(b.column("id").to_pylist(), b.column("part").to_pylist(), strict=True):
                    v, w = np.frombuffer(raw, "<f8"), asked[n]
                    value, move = S.direction(w, grid[n % len(grid)], v[0], v[1 : len(w) + 1], v[len(w) + 1 :].reshape(len(w), len(w)))
                    values.append(value)
                    moves.append(move.tobytes())
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(values, pa.float64()), pa.array(moves, pa.binary())], names=["id", "value", "move"])

        got = _added(rows, both).mapInArrow(solve, "id long, value double, move binary").collect()
        return {r.id: (r.value, np.frombuffer(bytes(r.move), "<f8")) for r in got}

    fitted = S.run_together({i * len(grid) + j: S.newton(len(mean[i])) for i in weights for j in range(len(grid))}, evaluate)

    def score(batches):
        for g, (f, m, *kept) in _by_group(batches, ["features", "m", *keys, "sample_id", "y"]):
            x = _matrix(f)
            row, head, split = _splits(m)
            trains = np.array([s == "train" for s in split], bool)
            for k in np.unique(head).tolist():
                rest, i = np.flatnonzero((head == k) & ~trains), g * heads + k
                if not len(rest):
                    continue
                scores = pa.nulls(len(rest), pa.list_(pa.float64()))
                if i in weights:
                    b = standard(x[row[rest]], mean[i], std[i])
                    w = [fitted[i * len(grid) + j] for j in range(len(grid))]
                    scores = pa.array(list(np.stack([S.sigmoid(b @ v[:-1] + v[-1]) for v in w], 1)), pa.list_(pa.float64()))
                at = pa.array(row[rest])
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in kept], pa.array(np.full(len(rest), k, np.int32)), pa.array([split[j] for j in rest], pa.string()), scores], names=[*keys, "sample_id", "y", "k", "split", "scores"])

    return rows.mapInArrow(score, f"{_schema(rows, keys)}, y int, k int, split string, scores array<double>")


def choice_metric(scores: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """(keys, value): macro_f1 at 0.5, or the tpr at a low fpr, named as by ``tpr_at_fpr``."""
    if metric == "macro_f1":
        return M.confusion(scores, keys, 0.5).select(*keys, F.col(metric).alias("value"))
    if not metric.startswith("tpr_"):
        raise ValueError(f"no choice by {metric}")
    target = float(metric.removeprefix("tpr_").replace("_", "."))
    return M.rank_metrics(M.prefix_table(scores, keys), keys, [target]).select(*keys, F.col(metric).alias("value"))


def choose_c(scores: DataFrame, keys: list[str], grid: tuple[float, ...], metric: str = "macro_f1") -> DataFrame:
    """``scores`` of ``fit_heads`` with c and score: of each head the first C with the best value on its val rows."""
    own = [*keys, "k"]
    values = F.array(*[F.lit(float(c)) for c in grid])
    if len(grid) == 1:
        out = scores.withColumn("_i", F.lit(0))
    else:
        scores = stored(scores)
        val = scores.where("split = 'val' and scores is not null").select(*own, "y", F.posexplode("scores").alias("_i", "score"))
        value = choice_metric(val, [*own, "_i"], metric)
        best = value.groupBy(*own).agg(F.max_by("_i", F.struct(F.coalesce("value", F.lit(0.0)), -F.col("_i"))).alias("_i"))
        out = join_on(scores, best, own, "left").withColumn("_i", F.coalesce("_i", F.lit(0)))
    c = F.when(F.col("scores").isNotNull(), F.get(values, F.col("_i")))
    return out.select(*own, "sample_id", "split", "y", c.alias("c"), F.get("scores", F.col("_i")).alias("score"))


def ridge_heads(rows: DataFrame, keys: list[str], alpha: float = 1.0, balanced: bool = True, scaled: bool = True) -> DataFrame:
    """(keys, k, weights, intercept) of ridge regressions on +-1, from sums alone.

    ``m`` has the folds (k, split): counts, sums and products are added up once for each group, class and set of heads that a
    row trains, and a head's are the sums of its sets; rows aren't copied. Null weights where a class is missing.
    """
    rows = rows.select(*keys, F.col("y").cast("int").alias("y"), F.col("features").cast("array<double>").alias("features"), F.col("m").cast(MEMBERS).alias("m"))
    middle = rows.groupBy(*keys).agg(F.transform(F.sequence(F.lit(0), F.max(F.size("features")) - 1), lambda i: i).alias("_d"))
    means = join_on(rows.select(*keys, F.posexplode("features").alias("_i", "_x")), middle.drop("_d"), keys).groupBy(*keys, "_i").agg(F.avg("_x").alias("_x"))
    means = means.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_mean"))
    trains = F.sort_array(F.transform(F.filter("m", lambda m: m["split"] == "train"), lambda m: m["k"]))
    near = join_on(rows, means, keys).select(*keys, "y", F.zip_with("features", "_mean", lambda a, b: a - b).alias("x"), "_mean", trains.alias("_t"), F.transform("m", lambda m: m["k"]).alias("_k"))
    marked = near.withColumn("_id", F.xxhash64(*keys, "y", F.to_json("_t")))
    names = marked.groupBy("_id").agg(*[F.first(c).alias(c) for c in [*keys, "y", "_t", "_mean"]], F.first("_k").alias("_k"))

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x, i = _matrix(b.column("x")), b.column("_id").to_numpy()
            for k in np.unique(i).tolist():
                own = x[i == k]
                part = np.concatenate([[len(own)], own.sum(0), (own.T @ own).reshape(-1)])
                total[k] = total[k] + part if k in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["_id", "part"])

    parts = S.added(marked.select("_id", "x").mapInArrow(sums, "_id long, part binary"), ["_id"])

    def solve(t: pa.Table) -> pa.Table:
        mean = np.array(t.column("_mean")[0].as_py())
        d, out = len(mean), []
        sets = list(zip(t.column("y").to_pylist(), t.column("_t").to_pylist(), [np.frombuffer(p, "<f8") for p in t.column("part").to_pylist()], strict=True))
        for k in sorted({k for ks in t.column("_k").to_pylist() for k in ks}):
            by = [sum((p for y, ks, p in sets if y == c and k in ks), np.zeros(1 + d + d * d)) for c in (0, 1)]
            n = [b[0] for b in by]
            if not n[0] or not n[1]:
                out.append((k, None, None))
                continue
            both, total = by[0] + by[1], n[0] + n[1]
            shift = both[1 : d + 1] / total
            var = np.diag(both[d + 1 :].reshape(d, d)) / total - shift**2
            std = np.sqrt(np.where(var > 1e-14 * np.maximum(shift**2, 1e-300), var, 1.0)) if scaled else np.ones(d)
            s = S.class_weights(n[0], n[1], balanced)
            weight = s[0] * n[0] + s[1] * n[1]
            first = (s[0] * by[0][1 : d + 1] + s[1] * by[1][1 : d + 1]) / weight
            t_mean = (s[1] * n[1] - s[0] * n[0]) / weight
            gram = (s[0] * by[0][d + 1 :] + s[1] * by[1][d + 1 :]).reshape(d, d) - weight * np.outer(first, first)
            cross = s[1] * by[1][1 : d + 1] - s[0] * by[0][1 : d + 1] - weight * t_mean * first
            w = np.linalg.solve(gram / np.outer(std, std) + alpha * np.eye(d), cross / std) / std
            out.append((k, w.tolist(), float(t_mean - w @ (first + mean))))
        one = t.select(keys).take(pa.array([0] * len(out), pa.int64()))
        ks, ws, bs = zip(*out, strict=True)
        return one.append_column("k", pa.array(ks, pa.int32())).append_column("weights", pa.array(ws, pa.list_(pa.float64()))).append_column("intercept", pa.array(bs, pa.float64()))

    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return names.join(parts, "_id").groupBy(*keys).applyInArrow(solve, f"{fields}, k int, weights array<double>, intercept double")


def linear_score(features: str, weights: str, intercept: str):
    """Inner product plus intercept, as an expression."""
    return F.aggregate(F.zip_with(F.col(features).cast("array<double>"), F.col(weights), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) + F.col(intercept)
