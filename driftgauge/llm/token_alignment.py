"""Cross-tokenizer alignment: two tokenizers' ids of one text, cut where tokens of both end.

1. Chunks of documents are encoded by both. The byte ends of A's and B's tokens, over all
   texts of a chunk one behind the other, are two rising lists. Merging them is divided by
   merge-path partitioning: binary searches on equally spaced diagonals find how many
   elements of each list come before, so that every piece has the same number of ends,
   however long the documents are. Pieces are rows of a table.
2. A piece is merged on its own, wherever Spark puts it. It emits, for each document in it, the
   overlaps that both tokenizers close: runs of A's and B's ids between common ends, and links.
   Equal ends never fall into two pieces, so links are whole. What a document has in
   several pieces is stitched together, a document at a time.
3. Links are counted by blocks of pieces first: a block keeps its own list of distinct id
   pairs, a document the (place, frequency) of its pairs. The lists meet by pair, are
   summed, ranked within each B id, and go back to their blocks, where documents add up.

Nothing is broadcast. A frequent pair is one row for each block, in a shuffled join.

A text that is null or empty, or whose tokens don't spell space + text, has no tokens: zeros and ''.
Null ids stay, repeated rows give a row each, an empty table gives none; only id and text are read,
so other columns can't clash. A document must fit in a task's memory, as its row does.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .piece_ids import ByteLevelIds, PieceIds
from .token_counts import packed, unpacked

DOC = pa.struct([("uid", pa.int64()), ("doc_id", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("whole", pa.bool_())])
PIECE = pa.schema([("seq", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("a_at", pa.int64()), ("b_at", pa.int64()), ("docs", pa.list_(DOC))])
PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
ROW = pa.schema(
    [("block", pa.int64()), ("uid", pa.int64()), ("doc_id", pa.string()), ("seq", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()), ("freqs", pa.binary()), ("sha", pa.string()), ("part", pa.binary()), ("pairs", pa.list_(PAIR))]
)
SUMS = "uid long, doc_id string, n_a long, n_b long, n_links long, n_best long, count_sum long, sha string"


@lru_cache(maxsize=2)
def encoders(path_a: str, path_b: str):
    a, b = ByteLevelIds(path_a, special=False), PieceIds(path_b)
    return a, b, a.widths(), b.widths()


def merge_path(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (i, j) of pieces of ``work`` merged elements of two rising lists.

    On each diagonal i + j = d the least i is searched with a[i] > b[d - 1 - i], all diagonals
    at once. Where a cut would part two equal elements, b's goes with a's.
    """
    n, m = len(a), len(b)
    d = np.append(np.arange(0, n + m, work), n + m)
    low, high = np.maximum(0, d - m), np.minimum(d, n)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = np.flatnonzero(open_)
        before = a[mid[at]] <= b[d[at] - 1 - mid[at]]
        low[at[before]] = mid[at[before]] + 1
        high[at[~before]] = mid[at[~before]]
    i, j = low, d - low
    parted = (i > 0) & (j < m)
    parted[parted] = a[i[parted] - 1] == b[j[parted]]
    return i, j + parted


def _cut(chunk: list[tuple], wide_a: np.ndarray, wide_b: np.ndarray, work: int, first: int, kind: str):
    """Pieces of a chunk of (uid, id, A's ids, B's ids)."""
    a = np.frombuffer(b"".join(c[2] for c in chunk), "<u4")
    b = np.frombuffer(b"".join(c[3] for c in chunk), "<u4")
    ends_a, ends_b = np.cumsum(wide_a[a]), np.cumsum(wide_b[b])
    i, j = merge_path(ends_a, ends_b, work)
    doc_a, doc_b = (np.cumsum([0, *[len(c[k]) // 4 for c in chunk]]) for k in (2, 3))
    for p in range(max(len(i) - 1, 1)):
        (i0, i1), (j0, j1) = (i[p : p + 2], j[p : p + 2]) if len(i) > 1 else ((0, 0), (0, 0))
        inside_a = np.minimum(doc_a[1:], i1) - np.maximum(doc_a[:-1], i0)
        inside_b = np.minimum(doc_b[1:], j1) - np.maximum(doc_b[:-1], j0)
        empty = (doc_a[1:] == doc_a[:-1]) & (p == 0)
        docs = []
        for k in np.flatnonzero((inside_a > 0) | (inside_b > 0) | empty).tolist():
            na, nb = max(int(inside_a[k]), 0), max(int(inside_b[k]), 0)
            docs.append({"uid": chunk[k][0], "doc_id": chunk[k][1], "a": na, "b": nb, "whole": na == doc_a[k + 1] - doc_a[k] and nb == doc_b[k + 1] - doc_b[k]})
        at = lambda ends, k: int(ends[k - 1]) if k else 0
        yield {"seq": first + p, "a": a[i0:i1].astype(kind).tobytes(), "b": b[j0:j1].astype(kind).tobytes(), "a_at": at(ends_a, i0), "b_at": at(ends_b, j0), "docs": docs}


def _pieces(path_a: str, path_b: str, work: int, kind: str, chunk_chars: int = 2_000_000):
    def run(batches):
        encode_a, encode_b, wide_a, wide_b = encoders(path_a, path_b)
        uid = seq = TaskContext.get().partitionId() << 36
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and size < chunk_chars:
                    size += len(texts[stop])
                    stop += 1
                chunk = []
                some = texts[at:stop]
                for name, text, x, y in zip(names[at:stop], some, encode_a([" " + t for t in some]), encode_b(some), strict=True):
                    chunk.append((uid, name, x, y) if text and y is not None else (uid, name, b"", b""))
                    uid += 1
                rows = list(_cut(chunk, wide_a, wide_b, work, seq, kind))
                seq += len(rows)
                yield pa.RecordBatch.from_pylist(rows, schema=PIECE)
                at = stop

    return run


@lru_cache(maxsize=1)
def _written(size: int) -> list[str]:
    """Each id with each of the marks that may follow it."""
    return [f"{i}{c}" for i in range(size) for c in ",|;"]


def groups_text(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
    """Written ids, in order of groups: A's, then B's; ``last_*`` are the places of the last ids of the groups."""
    i, j = np.arange(len(a)), np.arange(len(b))
    of_a, of_b = np.searchsorted(last_a, i), np.searchsorted(last_b, j)
    before_b, upto_a = np.append(0, last_b + 1), np.append(last_a + 1, len(a))
    code = np.empty(len(a) + len(b), np.int64)
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[last_a], mark_b[last_b] = 1, 2
    code[i + before_b[of_a]] = a.astype(np.int64) * 3 + mark_a
    code[j + upto_a[of_b]] = b.astype(np.int64) * 3 + mark_b
    top = int(max(a.max(initial=0), b.max(initial=0))) + 1
    return list(map(_written(1 << (top - 1).bit_length()).__getitem__, code.tolist()))


def _sha(text: list[str]) -> str:
    return hashlib.sha256("".join(text)[:-1].encode()).hexdigest() if text else ""


class _Block:
    """Documents and links of some pieces."""

    def __init__(self, block: int):
        self.block, self.docs, self.links = block, [], []
        self.count = 0

    def add(self, piece: dict, wide_a: np.ndarray, wide_b: np.ndarray, kind: str) -> None:
        a, b = np.frombuffer(piece["a"], kind), np.frombuffer(piece["b"], kind)
        ends_a, ends_b = piece["a_at"] + np.cumsum(wide_a[a]), piece["b_at"] + np.cumsum(wide_b[b])
        _, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        text = groups_text(a, b, last_a, last_b)
        x = y = 0
        for d in piece["docs"]:
            to_x, to_y = x + d["a"], y + d["b"]
            g0, g1 = np.searchsorted(last_a, [x, to_x])
            row = {"block": self.block, "uid": d["uid"], "doc_id": d["doc_id"], "seq": piece["seq"], "n_a": d["a"], "n_b": d["b"], "n_links": int(g1 - g0)}
            if d["whole"]:
                row["sha"] = _sha(text[x + y : to_x + to_y])
            else:
                ends = [np.isin(np.arange(x, to_x), last_a), np.isin(np.arange(y, to_y), last_b)]
                row["part"] = b"".join([np.array([d["a"], d["b"]], "<u4").tobytes(), a[x:to_x].astype("<u4").tobytes(), b[y:to_y].astype("<u4").tobytes(), *[e.astype("u1").tobytes() for e in ends]])
            self.links.append((a[last_a[g0:g1]].astype(np.int64) << 32) | b[last_b[g0:g1]])
            self.docs.append(row)
            self.count += int(g1 - g0)
            x, y = to_x, to_y

    def rows(self) -> pa.RecordBatch:
        sizes = [len(x) for x in self.links]
        pairs, place, total = np.unique(np.concatenate(self.links), return_inverse=True, return_counts=True)
        key, freq = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(len(pairs), 1) + place, return_counts=True)
        doc, place = np.divmod(key, max(len(pairs), 1))
        bounds = np.searchsorted(doc, np.arange(len(sizes) + 1))
        for k, row in enumerate(self.docs):
            row["freqs"] = packed(place[bounds[k] : bounds[k + 1]].astype(np.uint32), freq[bounds[k] : bounds[k + 1]])
        lists = pa.StructArray.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(total.astype(np.int64))], fields=list(PAIR))
        own = pa.Table.from_pylist(self.docs, schema=ROW)
        last = pa.table([pa.array([self.block], pa.int64()), *[pa.nulls(1, f.type) for f in list(ROW)[1:-1]], pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), lists)], schema=ROW)
        return pa.concat_tables([own, last]).combine_chunks().to_batches()[0]


def _align(path_a: str, path_b: str, block_links: int, kind: str):
    def run(batches):
        _, _, wide_a, wide_b = encoders(path_a, path_b)
        number = TaskContext.get().partitionId() << 24
        block = _Block(number)
        for batch in batches:
            for k in range(batch.num_rows):
                block.add(batch.slice(k, 1).to_pylist()[0], wide_a, wide_b, kind)
                if block.count >= block_links:
                    yield block.rows()
                    number += 1
                    block = _Block(number)
        if block.docs:
            yield block.rows()

    return run


def _stitch(parts: pa.Table) -> pa.Table:
    """The text of one document's groups, from its parts in order."""
    a, b, ends_a, ends_b = [], [], [], []
    for raw in parts.sort_by("seq").column("part").to_pylist():
        na, nb = np.frombuffer(raw, "<u4", 2).tolist()
        a.append(np.frombuffer(raw, "<u4", na, 8))
        b.append(np.frombuffer(raw, "<u4", nb, 8 + 4 * na))
        ends_a.append(np.frombuffer(raw, "u1", na, 8 + 4 * (na + nb)))
        ends_b.append(np.frombuffer(raw, "u1", nb, 8 + 4 * (na + nb) + na))
    text = groups_text(np.concatenate(a), np.concatenate(b), *[np.flatnonzero(np.concatenate(e)) for e in (ends_a, ends_b)])
    return pa.table({"uid": parts.column("uid")[:1], "sha": pa.array([_sha(text)], pa.string())})


def _sums(docs: pa.Table, lists: pa.Table) -> pa.Table:
    at = lists.column("at").to_numpy()
    size = int(at.max()) + 1 if len(at) else 1
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    count[at], best[at] = lists.column("count").to_numpy(), lists.column("best").to_numpy(zero_copy_only=False)
    got = [(int((count[i] * f).sum()), int((best[i] * f).sum())) for i, f in map(unpacked, docs.column("freqs").to_pylist())]
    columns = [docs.column(c) for c in ("uid", "doc_id", "n_a", "n_b", "n_links")]
    return pa.table([*columns, pa.array([g[1] for g in got], pa.int64()), pa.array([g[0] for g in got], pa.int64()), docs.column("sha")], names=[c.split()[0] for c in SUMS.split(", ")])


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, work: int = 1 << 15, block_links: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    ``path_a`` is a byte-level tokenizers file, ``path_b`` a sentencepiece model that adds a space.
    """
    return summed(aligned(docs, path_a, path_b, work, block_links, id_col, text_col), docs.schema[id_col].dataType, id_col)


def aligned(docs: DataFrame, path_a: str, path_b: str, work: int = 1 << 15, block_links: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of blocks: a row for each document and piece, and a row with the list of pairs."""
    kind = "<u2" if max(len(w) for w in encoders(path_a, path_b)[2:]) <= 1 << 16 else "<u4"
    base = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = stored(base.mapInArrow(_pieces(path_a, path_b, work, kind), "seq long, a binary, b binary, a_at long, b_at long, docs array<struct<uid long, doc_id string, a long, b long, whole boolean>>"), "pieces")
    schema = "block long, uid long, doc_id string, seq long, n_a long, n_b long, n_links long, freqs binary, sha string, part binary, pairs array<struct<a int, b int, n long>>"
    return stored(pieces.mapInArrow(_align(path_a, path_b, block_links, kind), schema), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, count, best) of every linked pair of ids; ``best`` marks the highest counts of each B id, ties included."""
    counts = blocks.where("pairs is not null").select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def summed(blocks: DataFrame, kind="long", id_col: str = "doc_id") -> DataFrame:
    lists = blocks.where("pairs is not null").select("block", F.posexplode("pairs").alias("at", "p")).select(F.col("block").alias("of"), "at", "p.a", "p.b")
    known = lists.join(pair_counts(blocks), ["a", "b"]).select("of", "at", "count", "best")
    rows = blocks.where("pairs is null").select("block", "uid", "doc_id", "n_a", "n_b", "n_links", "freqs", "sha")
    sums = rows.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_sums, SUMS)
    whole = blocks.where("part is not null").select("uid", "seq", "part").groupBy("uid").applyInArrow(_stitch, "uid long, sha string")
    zero = F.lit(0).cast("long")
    all_ = sums.unionByName(whole.select("uid", F.lit(None).cast("string").alias("doc_id"), *[zero.alias(c) for c in ("n_a", "n_b", "n_links", "n_best", "count_sum")], "sha"))
    out = all_.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_links", "n_best", "count_sum")], F.max("sha").alias("groups_sha256"))
    return out.select(F.col("doc_id").cast(kind).alias(id_col), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
