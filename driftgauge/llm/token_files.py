"""Token ids in binary files: Simple-8b words with escapes and offsets of every block.

``write_tokens`` sorts documents by id, encodes them and writes one file for each task.
``read_tokens`` gives the documents back, each with its place in the whole sequence.

A file, all numbers little-endian: the mark ``IDS8``; frames; a table of the frames
(byte offset, first id, ids: 64 bits each); the number of frames (64 bits); the mark again.
A frame holds whole documents, as many as reach ``FRAME`` ids: eight counts of 32 bits
(ids, words, escapes, blocks, documents, words of the two document columns, bytes of document names),
the word and escape offsets of its blocks (32 bits each), the words, the escaped values, the ids
of each document and the length of its name plus one (0 is null), both as Simple-8b words, and the names.

A task writes a file under a name of its own, and the table that Spark commits names the
files of the tasks that won. So a task that runs again, on another executor or twice at a time,
neither loses nor repeats a document; files that the table doesn't name are leftovers.
Files go through ``pyarrow.fs``, by the address of the shared folder.

Order: ascending id, nulls first; rows alike in id by a hash of their text. Rows of one id may fill
several files, so a frequent id is no hot task. A null text is empty and has the end id alone. Repeated
rows are a document each. An empty table gives no file and no row. Only the id and the text are
read, so other columns can't clash.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import shared_dir, stored, table
from .piece_ids import ByteLevelIds

MAGIC, FRAME = b"IDS8", 1 << 20
_encoders: dict[str, ByteLevelIds] = {}


def _alone(values: np.ndarray) -> np.ndarray:
    """Words of values that all fit in 59 bits."""
    return simple8b.encode(values).words


def _frame(ids: np.ndarray, sizes: list[int], names: list[str | None]) -> bytes:
    coded = simple8b.encode(ids)
    raw = [None if n is None else n.encode() for n in names]
    columns = [_alone(np.array(sizes, np.uint64)), _alone(np.array([0 if r is None else len(r) + 1 for r in raw], np.uint64))]
    text = b"".join(r for r in raw if r)
    counts = [len(ids), len(coded.words), len(coded.escaped), len(coded.word_at) - 1, len(sizes), *map(len, columns), len(text)]
    offsets = np.concatenate([coded.word_at, coded.escape_at]).astype("<u4")
    return b"".join([np.array(counts, "<u4").tobytes(), offsets.tobytes(), coded.words.astype("<u8").tobytes(), coded.escaped.astype("<u8").tobytes(), *[c.astype("<u8").tobytes() for c in columns], text])


class Writer:
    """Writes one file, frame by frame."""

    def __init__(self, out):
        self.out, self.at, self.frames, self.ids = out, len(MAGIC), [], 0
        self.parts: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.names: list[str | None] = []
        self.held = 0
        out.write(MAGIC)

    def add(self, name: str | None, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.sizes.append(len(ids))
        self.names.append(name)
        self.held += len(ids)
        if self.held >= FRAME:
            self.flush()

    def flush(self) -> None:
        if self.sizes:
            raw = _frame(np.concatenate(self.parts), self.sizes, self.names)
            self.out.write(raw)
            self.frames.append((self.at, self.ids, self.held))
            self.at, self.ids = self.at + len(raw), self.ids + self.held
            self.parts, self.sizes, self.names, self.held = [], [], [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(np.array(self.frames, "<u8").tobytes() + np.array([len(self.frames)], "<u8").tobytes() + MAGIC)
        self.out.close()


class TokenFile:
    """A file of ``Writer``: frames in turn, or any stretch of its ids."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 12)
        tail = source.read(12)
        if tail[8:] != MAGIC:
            raise ValueError("not a file of token ids")
        n = int(np.frombuffer(tail[:8], "<u8")[0])
        source.seek(size - 12 - 24 * n)
        self.table = np.frombuffer(source.read(24 * n), "<u8").reshape(n, 3).astype(np.int64)

    def _head(self, k: int):
        self.source.seek(int(self.table[k, 0]))
        counts = np.frombuffer(self.source.read(32), "<u4").astype(np.int64)
        offsets = np.frombuffer(self.source.read(8 * (int(counts[3]) + 1)), "<u4").astype(np.int64)
        return counts, offsets[: counts[3] + 1], offsets[counts[3] + 1 :]

    def frame(self, k: int) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
        """(ids, documents' sizes, documents' names)."""
        counts, word_at, escape_at = self._head(k)
        read = lambda n: np.frombuffer(self.source.read(8 * int(n)), "<u8")
        ids = simple8b.decode(simple8b.Coded(read(counts[1]), read(counts[2]), word_at, escape_at))
        alone = lambda n: simple8b.decode(simple8b.Coded(read(n), np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64))).astype(np.int64)
        sizes, lengths = alone(counts[5]), alone(counts[6])
        text = self.source.read(int(counts[7]))
        ends = np.cumsum(np.maximum(lengths - 1, 0)).tolist()
        names = [None if n == 0 else text[e - n + 1 : e].decode() for n, e in zip(lengths.tolist(), ends, strict=True)]
        return ids, sizes, names

    def stretch(self, first: int, n: int) -> np.ndarray:
        """ids ``first`` to ``first + n - 1`` of the file; only the blocks that hold them are read."""
        out = []
        while n > 0:
            k = int(np.searchsorted(self.table[:, 1], first, side="right")) - 1
            counts, word_at, escape_at = self._head(k)
            body = self.source.tell()
            at = first - int(self.table[k, 1])
            take = min(n, int(self.table[k, 2]) - at)
            if take <= 0:
                raise IndexError("behind the last id of the file")
            a, b = at // simple8b.BLOCK, (at + take - 1) // simple8b.BLOCK + 1
            self.source.seek(body + 8 * int(word_at[a]))
            words = np.frombuffer(self.source.read(8 * int(word_at[b] - word_at[a])), "<u8")
            self.source.seek(body + 8 * int(counts[1] + escape_at[a]))
            escaped = np.frombuffer(self.source.read(8 * int(escape_at[b] - escape_at[a])), "<u8")
            ids = simple8b.decode(simple8b.Coded(words, escaped, word_at[a : b + 1] - word_at[a], escape_at[a : b + 1] - escape_at[a]))
            out.append(ids[at - a * simple8b.BLOCK :][:take])
            first, n = first + take, n - take
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _write(folder: str, path: str, end: int):
    tail = np.uint32(end).tobytes()

    def run(batches):
        encode = _encoders.setdefault(path, ByteLevelIds(path))
        part, docs, out, at = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for k in range(0, len(names), 1000):
                if out is None:
                    where, root = fs.FileSystem.from_uri(folder)
                    where.create_dir(root)
                    at = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
                    out = Writer(where.open_output_stream(f"{root}/{at}"))
                some = [t or "" for t in texts.slice(k, 1000).to_pylist()]
                for name, ids in zip(names[k : k + 1000], encode(some), strict=True):
                    out.add(name, np.frombuffer(ids + tail, "<u4"))
                    docs += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": at, "n_docs": docs, "n_ids": out.ids}], schema=FILES)

    return run


FILES = pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_tokens(docs: DataFrame, folder: str, path: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Files in ``folder``, an address that all executors reach; returns (part, file, n_docs, n_ids, start), a row for each file."""
    kept = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    keys = ["_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    kept = kept.withColumns({"_h": keys[1], "_n": keys[2]}).repartitionByRange("_id", "_h", "_n").sortWithinPartitions("_id", "_h", "_n")
    files = stored(kept.select(F.col("_id").cast("string"), "text").mapInArrow(_write(folder, path, end), "part long, file string, n_docs long, n_ids long"), "files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def _read(folder: str, digest: bool):
    def run(batches):
        where, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with where.open_input_file(f"{root}/{file}") as source:
                    tokens = TokenFile(source)
                    for k in range(len(tokens.table)):
                        ids, sizes, names = tokens.frame(k)
                        ids = ids.astype("<u4")
                        ends = np.cumsum(sizes)
                        raw = memoryview(ids.tobytes())
                        each = [raw[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                        last = pa.array([zlib.crc32(x) for x in each], pa.int64()) if digest else pa.array(each, pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(start + ends - sizes), pa.array(sizes), last], names=["_id", "start", "n_tokens", "_last"])
                        start += len(ids)

    return run


def read_tokens(files: DataFrame, folder: str, kind="long", digest: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids as little-endian 32-bit bytes) of each document; with ``digest`` their checksum ids_crc32 instead."""
    n = max(files.count(), 1)
    last = "ids_crc32" if digest else "ids"
    out = files.select("file", "start").repartition(n).mapInArrow(_read(folder, digest), f"_id string, start long, n_tokens long, _last {'long' if digest else 'binary'}")
    return out.select(F.col("_id").cast(kind).alias(id_col), "start", "n_tokens", F.col("_last").alias(last))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    files = write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(files, folder, docs.schema["doc_id"].dataType, digest=True)
