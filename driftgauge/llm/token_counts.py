"""Token counts: each distinct pre-token is encoded once, documents only add up.

1. Blocks of documents are split into pre-tokens. A block keeps its own list of
   distinct pre-tokens; a document keeps (place in that list, frequency) pairs.
2. The lists of all blocks meet by pre-token, sorted; each distinct pre-token is encoded
   once, by the tokenizer itself, and only the length is kept.
3. The lengths go back and are joined with their block's frequencies, where each
   document's frequencies and lengths are multiplied and summed.

No token ids are kept, no table is broadcast, and a block holds at most
``block_chars`` characters (or one longer document), so memory doesn't grow with the
corpus. A frequent pre-token makes one row per block, not per occurrence.

Pre-tokens are those of the tokenizer: texts of Latin-1 characters are split by an
equal pattern, all others by the library's own pre-tokenizer. Special strings inside
a text are found first, as the library does, and count as one token each.

Nulls: a null text counts as empty, with 0 tokens; null ids stay. Repeated rows give a
row each. Only the id column is kept, so other columns can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
#: The byte-level pattern, written out for Latin-1.
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Splitter:
    """Pre-tokens of a text, equal to those of the tokenizer at ``path``."""

    def __init__(self, path: str):
        import json

        tok = tokenizer(path)
        state = json.loads(tok.to_str())
        kind = state["pre_tokenizer"] or {}
        self.plain = state["normalizer"] is None and kind.get("type") == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"]
        if state["normalizer"] is not None:
            raise ValueError("pre-tokens of a tokenizer with a normalizer aren't parts of the text")
        special = sorted((t["content"] for t in state["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.first = [s[0] for s in special]
        self.names = special
        self.library = tok.pre_tokenizer.pre_tokenize_str

    def part(self, text: str) -> list[str]:
        if self.plain:
            try:
                text.encode("latin-1")
                return LATIN.findall(text)
            except UnicodeEncodeError:
                pass
        return [text[a:b] for _, (a, b) in self.library(text)]

    def __call__(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.names):
            return self.part(text)
        out: list[str] = []
        for i, x in enumerate(self.special.split(text)):
            out += [x] if i % 2 else self.part(x)
        return out


def packed(idx: np.ndarray, freq: np.ndarray) -> bytes:
    """Places, as differences of sorted numbers, and frequencies, in few bytes."""
    order = np.argsort(idx, kind="stable")
    gaps = np.diff(idx[order].astype(np.int64), prepend=0)
    wide, many = bool(gaps.max(initial=0) > 0xFFFF), bool(freq.max(initial=0) > 0xFF)
    parts = bytes([wide, many]), gaps.astype("<u4" if wide else "<u2").tobytes(), freq[order].astype("<u4" if many else "u1").tobytes()
    return zlib.compress(b"".join(parts), 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(blob)
    gap, count = np.dtype("<u4" if raw[0] else "<u2"), np.dtype("<u4" if raw[1] else "u1")
    n = (len(raw) - 2) // (gap.itemsize + count.itemsize)
    return np.cumsum(np.frombuffer(raw, gap, n, 2), dtype=np.int64), np.frombuffer(raw, count, n, 2 + n * gap.itemsize)


BLOCK = pa.schema([("block", pa.int64()), ("doc_id", pa.string()), ("n_bytes", pa.int64()), ("freqs", pa.binary()), ("pieces", pa.list_(pa.string()))])


def _blocks(path: str, block_chars: int):
    def run(batches):
        split = Splitter(path)
        block, place, rows, size = TaskContext.get().partitionId() << 24, {}, [], 0

        def out():
            rows.append((block, None, 0, None, list(place)))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), BLOCK, strict=True)], schema=BLOCK)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                found = Counter(split(text))
                for p in found:
                    if p not in place:
                        place[p] = len(place)
                idx = np.fromiter(map(place.__getitem__, found), np.uint32, len(found))
                rows.append((block, doc, len(text.encode("utf-8", "surrogatepass")), packed(idx, np.fromiter(found.values(), np.uint32, len(found))), None))
                size += len(text)
                if size >= block_chars:
                    yield out()
                    block, place, rows, size = block + 1, {}, [], 0
        if rows:
            yield out()

    return run


def _lengths(path: str):
    """(block, at, n) of rows sorted by piece; each piece is encoded where it comes first."""

    def run(batches):
        tok = tokenizer(path)
        last, last_n = None, 0
        for batch in batches:
            pieces = batch.column("piece").to_pylist()
            new = [p for p in dict.fromkeys(pieces) if p != last]
            n = dict(zip(new, map(len, tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))
            if last is not None:
                n.setdefault(last, last_n)
            if pieces:
                last, last_n = pieces[-1], n[pieces[-1]]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("at"), pa.array([n[p] for p in pieces], pa.int32())], names=["part", "at", "n"])

    return run


def _sums(docs: pa.Table, lists: pa.Table) -> pa.Table:
    at = lists.column("at").to_numpy()
    n = np.zeros(int(at.max()) + 1 if len(at) else 1, np.int64)
    n[at] = lists.column("n").to_numpy()
    total = []
    for blob in docs.column("freqs").to_pylist():
        idx, freq = unpacked(blob)
        total.append(int((n[idx] * freq).sum()))
    return pa.table({"_id": docs.column("doc_id"), "n_bytes": docs.column("n_bytes"), "n_tokens": pa.array(total, pa.int64())})


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 32_000_000) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row, by the tokenizers file at ``path``."""
    kind = docs.schema[id_col].dataType
    base = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = stored(base.mapInArrow(_blocks(path, block_chars), "block long, doc_id string, n_bytes long, freqs binary, pieces array<string>"), "pretokens")
    lists = blocks.where("pieces is not null").select("block", F.posexplode("pieces").alias("at", "piece"))
    known = lists.repartition("piece").sortWithinPartitions("piece").mapInArrow(_lengths(path), "part long, at int, n int")
    rows = blocks.where("pieces is null").select("block", "doc_id", "n_bytes", "freqs")
    summed = rows.groupBy("block").cogroup(known.groupBy("part")).applyInArrow(_sums, "_id string, n_bytes long, n_tokens long")
    return summed.select(F.col("_id").cast(kind).alias(id_col), "n_bytes", "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)
