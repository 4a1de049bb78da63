"""Benchmark decontamination: pigeonhole pieces find, Myers' bit-parallel distance verifies.

An item of L characters may be met with up to k = floor(rate * L) edits. It is split
into k + 1 pieces; a place with at most k edits leaves at least one piece whole, so
exact hits of all pieces miss no such place. A piece is found by the rolling hash of its
first 16, 8, 4, 2 or 1 bytes, taken at every place of a text at once in numpy, and then
compared whole. The window around each hit is measured with Myers' bit-parallel edit
distance.

Texts and items are compared in lower case with white space (Python's, control characters
among it) as single blanks, and none at the ends: ``plain``, for both. The match ends
where the distance is least; its span is given in the raw text.

The items, distinct by text, are broadcast: up to ``block_chars`` characters of them (32
million, some hundred times a usual benchmark) take one narrow pass over the documents.
A larger benchmark takes a pass for each further such block, so what a task holds is
bounded whatever its size. Nothing is shuffled, and a hot document or item costs no more
than its own text.

Nulls and blanks: a null or blank text holds nothing; null or blank items match
nothing. Items with equal texts are one item, named by the smallest id. Repeated rows
are searched each on their own.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .near_dedup import powers

KEYS = (16, 8, 4, 2, 1)
#: Bytes of texts that Python works on at a time.
SLICE = 1 << 20
_U = np.uint64


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def places(text: str) -> list[int]:
    """For each character of ``plain(text)`` its index in the text."""
    out, blank = [], True
    for i, c in enumerate(text):
        if not c.isspace():
            blank = False
            out += [i] * len(c.lower())
        elif not blank:
            blank = True
            out.append(i)
    return out[:-1] if blank else out


def pieces(length: int, errors: int) -> list[tuple[int, int]]:
    """The spans of errors + 1 pieces."""
    n = errors + 1
    return [(length * i // n, length * (i + 1) // n) for i in range(n)]


class Item:
    def __init__(self, name, text: str, rate: float):
        self.name, self.text, self.size = name, text, len(text)
        self.errors = int(rate * len(text))
        self.high, self.full = 1 << (len(text) - 1), (1 << len(text)) - 1
        self.ahead, self.back = self.masks(text), self.masks(text[::-1])

    @staticmethod
    def masks(text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, c in enumerate(text):
            out[c] = out.get(c, 0) | 1 << i
        return out

    def distances(self, text: str, masks: dict[str, int]) -> list[int]:
        """At each character, the least distance of the item to what ends there."""
        up, down, score, out = self.full, 0, self.size, []
        full, high = self.full, self.high
        for c in text:
            eq = masks.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = (down | ~(xh | up)) & full
            mh = up & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            ph = (ph << 1) & full
            mh = (mh << 1) & full
            up = (mh | ~(xv | ph)) & full
            down = ph & xv
            out.append(score)
        return out

    def matches(self, text: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
        """(begin, end, distance) of the best matches in text[lo:hi]; those nearer than half an item count once."""
        out: list[tuple[int, int, int]] = []
        taken: list[int] = []
        far = self.distances(text[lo:hi], self.ahead)
        for d, i in sorted((d, i) for i, d in enumerate(far) if d <= self.errors):
            at = bisect_left(taken, i)
            if any(abs(t - i) <= self.size // 2 for t in taken[max(at - 1, 0) : at + 1]):
                continue
            insort(taken, i)
            part = text[max(lo, lo + i + 1 - self.size - d) : lo + i + 1][::-1]
            back = self.distances(part, self.back)
            width = back.index(min(back)) + 1
            out.append((lo + i + 1 - width, lo + i + 1, d))
        return sorted(out)


def rolling(data: np.ndarray, total: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all stretches of q bytes; ``total`` are the prefix sums of the text."""
    n = len(data) - q + 1
    return (total[q:] - total[:n]) * powers(len(data) + 1)[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * powers(len(data) + 1)[0][:-1], out=total[1:])
    return total


class Finder:
    """Finds items, a list of (id, plain text), in texts."""

    def __init__(self, items: list[tuple], rate: float):
        self.items, self.rate, self.made = items, rate, {}
        found: dict[int, list[tuple[int, int, int, int]]] = {q: [] for q in KEYS}
        for k, (_, text) in enumerate(items):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            total = prefix_sums(data)
            # bytes before each character
            at = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
            down = powers(len(data) + 1)[1]
            for a, b in pieces(len(text), int(rate * len(text))):
                x, y = int(at[a]), int(at[b])
                q = next(q for q in KEYS if q <= y - x)
                key = (total[x + q : x + q + 1] - total[x : x + 1]) * down[x : x + 1]
                found[q].append((int(key[0]), k, a, b))
        self.tables = []
        for q, rows in found.items():
            if rows:
                rows.sort()
                key = np.array([r[0] for r in rows], _U)
                bits = min(27, max(16, len(key).bit_length() + 5))
                seen = np.zeros(1 << bits, bool)
                seen[key >> _U(64 - bits)] = True
                self.tables.append((q, key, np.array([r[1:] for r in rows], np.int32), _U(64 - bits), seen))

    def item(self, k: int) -> Item:
        if k not in self.made:
            if len(self.made) > 10_000:
                self.made.clear()
            self.made[k] = Item(*self.items[k], self.rate)
        return self.made[k]

    def hits(self, low: str) -> dict[int, list[int]]:
        """For each item the places where it would begin, by the pieces that are found whole."""
        data = np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8)
        total, char = prefix_sums(data), None
        starts: dict[int, list[int]] = {}
        for q, key, piece, shift, seen in self.tables:
            if len(data) < q:
                continue
            h = rolling(data, total, q)
            at = np.flatnonzero(seen[h >> shift])
            if not len(at):
                continue
            left, right = np.searchsorted(key, h[at], "left"), np.searchsorted(key, h[at], "right")
            keep = right > left
            at, left, right = at[keep], left[keep], right[keep]
            if len(at) and len(data) != len(low):
                char = np.cumsum((data & 0xC0) != 0x80) - 1 if char is None else char
                at = char[at]
            for s, x, y in zip(at.tolist(), left.tolist(), right.tolist(), strict=True):
                for k, a, b in piece[x:y].tolist():
                    if low.startswith(self.items[k][1][a:b], s):
                        starts.setdefault(k, []).append(s - a)
        return starts

    def __call__(self, text: str) -> list[tuple]:
        """(item, begin, end, distance), with spans of the raw text."""
        low = plain(text)
        found = []
        for k, at in self.hits(low).items():
            x = self.item(k)
            windows: list[list[int]] = []
            for s in sorted(at):
                lo, hi = max(0, s - x.errors), min(len(low), s + x.size + x.errors)
                if windows and lo <= windows[-1][1]:
                    windows[-1][1] = max(hi, windows[-1][1])
                else:
                    windows.append([lo, hi])
            # a match lies whole in one window, so no two windows find the same
            found += [(x.name, a, b, d) for lo, hi in windows for a, b, d in x.matches(low, lo, hi)]
        if not found:
            return []
        at = places(text)
        return sorted(((n, at[a], at[b - 1] + 1, d) for n, a, b, d in found), key=lambda r: (r[1], str(r[0])))


_finders: dict[str, Finder] = {}


def finder(name: str, sent, rate: float) -> Finder:
    """One finder in each Python worker, for the block of items called ``name``."""
    if name not in _finders:
        _finders.clear()
        _finders[name] = Finder(sent.value, rate)
    return _finders[name]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int):
    """Lists of (id, plain text), one bounded block of the benchmark after the other."""
    kind = benchmark.schema[item_col].dataType.simpleString()

    def told(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([plain(t or "") for t in batch.column(1).to_pylist()], pa.string())], names=["i", "t"])

    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(told, f"i {kind}, t string")
    items = items.where("t <> ''").groupBy("t").agg(F.min("i").alias("i"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, ceil(total / block_chars))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).orderBy("t").collect()
        if rows:
            yield [(r.i, r.t) for r in rows]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = 32_000_000) -> DataFrame:
    """(id, item, begin, end, distance) of each place of an item in a document."""
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc {kinds[0]}, item string, begin int, end int, distance int"
    out = None
    for items in item_blocks(benchmark, item_col, item_text, block_chars):
        sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches, sent=sent, name=name):
            find = finder(name, sent, rate)
            for batch in slices(batches, 1, SLICE):
                rows = [(r, str(n), a, b, d) for r, t in enumerate(batch.column(1).to_pylist()) if t for n, a, b, d in find(t)]
                if rows:
                    at, item, a, b, d = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(item), *[pa.array(c, pa.int32()) for c in (a, b, d)]], names=["doc", "item", "begin", "end", "distance"])

        part = base.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = base.sparkSession.createDataFrame([], schema)
    return out.select(F.col("doc").alias(id_col), F.col("item").cast(kinds[1]).alias(item_col), "begin", "end", "distance")


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = 32_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    place = docs.columns.index(text_col)
    for items in item_blocks(benchmark, item_col, item_text, block_chars):
        sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches, sent=sent, name=name):
            find = finder(name, sent, rate)
            for batch in slices(batches, place, SLICE):
                yield batch.filter(pa.array([not (t and find(t)) for t in batch.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
