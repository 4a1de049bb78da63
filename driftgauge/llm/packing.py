"""Packing: Karmarkar-Karp differencing cuts a corpus into near-equal windows.

Each document's ids, with an end id behind them, are cut into pieces: whole windows of
``capacity`` ids first, each a sequence of its own, then the rest in parts of at most
``grain`` ids. The parts are dealt at random, by a hash of their number, into groups of
about ``windows`` windows. In a group the window count starts at the least possible and
multiway differencing merges, again and again, the two partial partitions with the
largest imbalance, the heaviest window of one with the lightest of the other. When a
window exceeds the capacity, the window count rises and the group is done again.

A group's size follows the total only through the number of groups, so no task grows
with the corpus, and copies of a document spread over all groups.

Nulls: a null text is empty and has the end id alone; null ids stay. Repeated rows are
packed each on their own. Other columns of ``docs`` are not kept.
"""

from __future__ import annotations

import heapq
import json
from array import array
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table
from .token_counts import tokenizer

#: Words that a worker remembers, and as many of before; bytes of texts that are split at a time.
CACHE = 300_000
SLICE = 1 << 21
MARK = b"\xff"


def word_encoder(tok):
    """A faster twin of the tokenizer for single lower-case words of Latin-1 letters, or None.

    A byte that no UTF-8 text has stands for the word end. Merges by rank need ids that
    grow with the merges.
    """
    state = json.loads(tok.to_str())
    model = state["model"]
    end = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not end or model.get("continuing_subword_prefix"):
        return None
    vocab = model["vocab"]
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if made != sorted(made):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
    ranks = {}
    for token, i in vocab.items():
        body, tail = (token[: -len(end)], MARK) if token.endswith(end) else (token, b"")
        if all(c in byte for c in body):
            ranks[bytes(byte[c] for c in body) + tail] = i
    if any(bytes([b]) not in ranks for b in range(256)):
        return None
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


class WordIds:
    """ids of a text as little-endian 32-bit bytes, for a tokenizer that drops white space.

    What stands between white space is encoded once and remembered. This holds where
    no pre-token spans white space, as for the word-end vocabularies.
    """

    def __init__(self, path: str, end: int):
        self.tok = tokenizer(path)
        self.word = word_encoder(self.tok)
        self.end = np.uint32(end).tobytes()
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.marks = {m: self.ids([m])[0] for m in ",."}

    def ids(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        known, marks, word, slow = self.known, self.marks, self.word, []
        again = words.intersection(self.older)
        known.update((w, self.older[w]) for w in again)
        for w in words - again:
            tail = w[-1] if w[-1] in marks else ""
            low = (w[:-1] if tail else w).lower()
            if word is None or not low.isalpha() or len(low) != len(w) - len(tail):
                slow.append(w)
                continue
            ids = known.get(low)
            if ids is None:
                if not (low.isascii() or max(low) <= "\xff"):
                    slow.append(w)
                    continue
                raw = low.encode()
                ids = known[low] = array("I", word(raw + MARK)).tobytes()
            known[w] = ids + marks[tail] if tail else ids
        for i in range(0, len(slow), 8192):
            part = slow[i : i + 8192]
            known.update(zip(part, self.ids(part), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {"": b""}
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new: set[str] = set()
        for words in split:
            new.update(words)
        self.learn(new.difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) + self.end for words in split]


_encoders: dict[tuple, WordIds] = {}


def cuts(n: int, capacity: int, grain: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    at = n - n % capacity
    return [(s, capacity) for s in range(0, at, capacity)] + [(s, min(grain, n - s)) for s in range(at, n, grain)]


def _pieces(path: str, end: int, capacity: int, grain: int):
    def run(batches):
        key = (path, end)
        if key not in _encoders:
            _encoders[key] = WordIds(path, end)
        encode = _encoders[key]
        task, count = TaskContext.get().partitionId(), 0
        for batch in slices(batches, 1, SLICE):
            rows = []
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, ids in zip(docs, encode([t or "" for t in texts]), strict=True):
                n = len(ids) // 4
                for s, k in cuts(n, capacity, grain):
                    rows.append((doc, s, k, n, (task << 36) + count, ids[4 * s : 4 * (s + k)]))
                    count += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), *[pa.int64()] * 4, pa.binary()], strict=True)],
                names=["doc_id", "start", "length", "doc_tokens", "piece", "ids"],
            )

    return run


def cut_documents(docs: DataFrame, path: str, end: int = 1, capacity: int = 2048, grain: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, doc_tokens, piece, ids) of each piece; ids are little-endian 32-bit."""
    kind = docs.schema[id_col].dataType
    base = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = base.mapInArrow(_pieces(path, end, capacity, grain), "doc_id string, start long, length long, doc_tokens long, piece long, ids binary")
    return out.select(F.col("doc_id").cast(kind).alias(id_col), "start", "length", "doc_tokens", "piece", "ids")


def differencing(sizes: np.ndarray, n: int) -> np.ndarray:
    """The window, 0 to n - 1, of each size, by multiway Karmarkar-Karp differencing.

    A partial partition is the weights of its windows, heaviest first, and the node of
    each: a node is a size, or two nodes put together.
    """
    if n <= 1:
        return np.zeros(len(sizes), np.int64)
    left, right = [], []
    p = len(sizes)
    heap = [(-int(s), i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = p
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, tie, b, y = heapq.heappop(heap)
        both = len(a) + len(b) - n
        if both > 0:
            keep = len(a) - both
            opposite = y[::-1][: both]
            left.append(x[keep:])
            right.append(opposite)
            weights = np.concatenate([a[:keep], a[keep:] + b[::-1][:both], b[: len(b) - both]])
            nodes = np.concatenate([x[:keep], np.arange(made, made + both), y[: len(b) - both]])
            made += both
        else:
            weights, nodes = np.concatenate([a, b]), np.concatenate([x, y])
        order = np.argsort(-weights, kind="stable")
        weights, nodes = weights[order], nodes[order]
        imbalance = int(weights[0]) - (int(weights[-1]) if len(weights) == n else 0)
        heapq.heappush(heap, (-imbalance, tie, weights, nodes))
    window = np.full(made, -1, np.int64)
    top = heap[0][3]
    window[top] = np.arange(len(top))
    for k, (a, b) in enumerate(zip(reversed(left), reversed(right), strict=True)):
        end = made
        made -= len(a)
        got = window[made:end]
        window[a], window[b] = got, got
    return window[:p]


def balance(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A window for each size; the least count of windows for which differencing fits."""
    n = max(1, ceil(int(sizes.sum()) / capacity))
    while True:
        window = differencing(sizes, n)
        if np.bincount(window, weights=sizes).max(initial=0) <= capacity:
            return window
        n += 1


def assign_windows(pieces: DataFrame, capacity: int = 2048, windows: int = 128) -> DataFrame:
    """``pieces`` (with ``piece`` and ``length``) with ``sequence_id`` and ``offset``."""
    pieces = pieces.drop("sequence_id", "offset")
    rest = pieces.where(F.col("length") < capacity)
    total = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (capacity * windows)))
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": F.col("piece") * 2 + 1, "offset": F.lit(0).cast("long")})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "piece"], ascending=[False, True], ignore_index=True)
        window = balance(pdf["length"].to_numpy(np.int64), capacity)
        pdf["sequence_id"] = (pdf["_g"].to_numpy() * (1 << 24) + window) * 2
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf.drop(columns="_g")

    dealt = rest.withColumn("_g", F.pmod(F.xxhash64("piece"), F.lit(groups)).cast("long"))
    return dealt.groupBy("_g").applyInPandas(pack, full.schema).unionByName(full)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, **cut) -> DataFrame:
    """Whole output: each piece with its ids, sequence and offset."""
    return assign_windows(stored(cut_documents(docs, path, capacity=capacity, **cut), "pieces"), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def digest(docs: DataFrame) -> DataFrame:
    """One row for each piece of ``docs``, with a checksum in place of its ids."""
    import public_tokenizers

    cut = cut_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    cut = stored(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return assign_windows(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
