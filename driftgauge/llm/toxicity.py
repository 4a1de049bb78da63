"""Toxicity: multiple-instance learning over sentences, combined by noisy-or.

A document is a bag of sentences. Each has a probability p = sigmoid(bias + sum of the
weights of its distinct words), a word's weight being the sum over the word and its
beginnings of three to seven letters (hashed). The document is toxic with probability
1 - prod(1 - p). Only documents carry labels; the gradient of the noisy-or decides
which sentences have to answer for them, and these are then located.

Training: about ``sample`` labelled documents (all, where there are fewer; the one
bound here), chosen by hash, become rows of feature numbers in the shared folder.
Features that toxic documents have significantly more often start at their log odds,
all others stay at zero. In each of ``steps`` steps the weights (2^18 floats) go to the
executors, every partition returns its part of the gradient of the noisy-or, and the
driver takes a step of Adam. A sentence in which no word
has a weight is taken as clean.

Scoring is one narrow pass over all whole texts.

Nulls: a null or empty text has one empty sentence, hence the score 0. Labels that
are null, or not 0 or 1, are no labels. A document with two labels is two examples.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Remembered, discard, slices, stored, table

BITS = 18
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]*")
WORD = re.compile(r"\w+")
#: Bytes of texts, or of features, that Python works on at a time.
SLICE = 1 << 20


@lru_cache(maxsize=1 << 15)
def features(word: str) -> tuple[int, ...]:
    """Numbers of a word and of its beginnings."""
    parts = [f"={word}", *[f"^{word[:k]}" for k in range(3, 8) if k <= len(word)]]
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for p in parts)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences; they cover the text. An empty text has one, (0, 0)."""
    out = [m.span() for m in SENTENCE.finditer(text) if m.end() > m.start()]
    return out or [(0, 0)]


def worded(text: str, low: str) -> list[tuple[int, int, set[str]]]:
    """Spans of the sentences of ``text``, which are cut before they are lowered, and their distinct words.

    ``low`` is the lowered text; it can be longer than the text (a capital dotted I
    becomes two characters), and then each sentence is lowered by itself.
    """
    same = len(low) == len(text)
    return [(a, b, set(WORD.findall(low, a, b) if same else WORD.findall(text[a:b].lower()))) for a, b in sentences(text)]


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.weighted = set(np.flatnonzero(weights).tolist())
        self.known = Remembered(150_000)
        self.chunks = Remembered(150_000)

    def word(self, word: str) -> float:
        s = self.known.get(word)
        if s is None and (s := self.known.find(word)) is None:
            own = features.__wrapped__(word)
            s = 0.0 if self.weighted.isdisjoint(own) else float(self.weights[list(own)].sum())
            self.known.put(word, s)
        return s

    def chunk(self, chunk: str) -> float:
        """Whether any word between two blanks has a weight."""
        s = self.chunks.get(chunk)
        if s is None and (s := self.chunks.find(chunk)) is None:
            s = any(self.word(w) for w in WORD.findall(chunk))
            self.chunks.put(chunk, s)
        return s

    def __call__(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and spans of sentences above one half."""
        low = text.lower()
        if not any(map(self.chunk, set(low.split()))):
            return 0.0, []
        clean, found = 0.0, []
        for a, b, own in worded(text, low):
            s = sum(map(self.word, own))
            if s:
                z = s + self.bias
                clean -= np.logaddexp(0, z)
                if z > 0:
                    found.append((a, b, float(1 / (1 + np.exp(-z)))))
        return float(-np.expm1(clean)), found


def _bags(batches):
    """Distinct (sentence, feature) pairs of each labelled text."""
    for batch in slices(batches, 1, SLICE):
        ends, feats = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            f: list[int] = []
            e = []
            for _, _, own in worded(text, text.lower()):
                f += {x for w in own for x in features(w)}
                e.append(len(f))
            feats.append(np.array(f, np.int32).tobytes())
            ends.append(np.array(e, np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.binary()), pa.array(feats, pa.binary())], names=["y", "ends", "feats"])


def _load(batches):
    y, ends, feats = [], [], []
    for b in batches:
        y += b.column(0).to_pylist()
        ends += [np.frombuffer(x, np.int32) for x in b.column(1).to_pylist()]
        feats += [np.frombuffer(x, np.int32) for x in b.column(2).to_pylist()]
    return np.array(y, np.float64), ends, feats


def _reply(idx: np.ndarray, value: np.ndarray, bias: float, n: int):
    return pa.RecordBatch.from_arrays(
        [pa.array([idx.astype(np.int32).tobytes()]), pa.array([value.astype(np.float32).tobytes()]), pa.array([float(bias)]), pa.array([n], pa.int64())],
        names=["idx", "value", "bias", "n"],
    )


REPLY = "idx binary, value binary, bias double, n long"


def _frequency(batches):
    """For each label the documents that have a feature."""
    df, n = np.zeros((2, 1 << BITS), np.int64), [0, 0]
    for batch in slices(batches, 2, SLICE):
        y, _, feats = _load([batch])
        for label, f in zip(y.astype(int), feats, strict=True):
            df[label][np.unique(f)] += 1
            n[label] += 1
    for label in (0, 1):
        if n[label]:
            idx = np.flatnonzero(df[label])
            yield _reply(idx, df[label][idx], label, n[label])


def gradient(y, ends, feats, weights, bias):
    """Gradient of the log loss of the noisy-or, summed over the documents.

    A sentence in which no word has a weight is clean, in training as in scoring.
    """
    width = np.array([len(e) for e in ends])
    doc = np.repeat(np.arange(len(ends)), width)
    words = np.concatenate([np.diff(e, prepend=0) for e in ends])
    sentence = np.repeat(np.arange(len(words)), words)
    f = np.concatenate(feats)
    z = np.bincount(sentence, weights=weights[f], minlength=len(words)) + bias
    open_ = np.bincount(sentence, weights=weights[f] != 0, minlength=len(words)) > 0
    p = np.where(open_, 1 / (1 + np.exp(-z)), 0.0)
    clean = np.bincount(doc, weights=np.where(open_, -np.logaddexp(0, z), 0.0), minlength=len(y))
    toxic = np.maximum(-np.expm1(clean), 1e-12)
    pull = np.where(y == 1, -np.exp(clean) / toxic, 1.0)
    d = pull[doc] * p
    return np.bincount(f, weights=d[sentence], minlength=len(weights))


def _sum(rows, size=1 << BITS):
    total = np.zeros(size)
    for r in rows:
        total[np.frombuffer(r.idx, np.int32)] += np.frombuffer(r.value, np.float32)
    return total, sum(r.n for r in rows)


def screened(toxic: np.ndarray, p: int, clean: np.ndarray, n: int, least_z: float, min_docs: int) -> np.ndarray:
    """Log odds of features that toxic documents have significantly more often; 0 for all others."""
    share = (toxic + clean) / (p + n)
    z = (toxic / p - clean / n) / np.sqrt(share * (1 - share) * (1 / p + 1 / n) + 1e-12)
    odds = np.log((toxic + 0.5) / (p + 1)) - np.log((clean + 0.5) / (n + 1))
    return np.where((z > least_z) & (toxic >= min_docs), odds, 0.0)


def train(examples: DataFrame, steps: int = 30, rate: float = 0.3, l2: float = 0.03, least_z: float = 6.0, min_docs: int = 3, bias: float = -8.0) -> tuple[np.ndarray, float]:
    """Weights and bias from ``examples`` (y, text).

    The bias stays: a sentence without a weighted word is clean, however many there are.
    """
    spark = examples.sparkSession
    kept = stored(examples.select(F.col("y").cast("int").alias("y"), "text").mapInArrow(_bags, "y int, ends binary, feats binary"), "bags")
    bags = kept.coalesce(12)
    counts = bags.mapInArrow(_frequency, REPLY).collect()
    (clean, n), (toxic, p) = (_sum([r for r in counts if r.bias == label]) for label in (0, 1))
    if not n or not p:
        discard(kept)
        return np.zeros(1 << BITS, np.float32), bias
    w = screened(toxic, p, clean, n, least_z, min_docs)
    use, m, v = w != 0, np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        sent = spark.sparkContext.broadcast((w.astype(np.float32), bias))

        def part(batches, sent=sent):
            g, n = np.zeros(1 << BITS), 0
            for batch in slices(batches, 2, SLICE):  # some documents at a time, however long they are
                y, ends, feats = _load([batch])
                if len(y):
                    g += gradient(y, ends, feats, *sent.value)
                    n += len(y)
            if n:
                idx = np.flatnonzero(g * (sent.value[0] != 0))
                yield _reply(idx, g[idx], 0, n)

        g = _sum(bags.mapInArrow(part, REPLY).collect())[0]
        sent.unpersist()
        g = np.where(use, (g + l2 * w) / (n + p), 0.0)
        m, v = 0.8 * m + 0.2 * g, 0.95 * v + 0.05 * g * g
        w = np.where(use, w - rate * (m / (1 - 0.8**t)) / (np.sqrt(v / (1 - 0.95**t)) + 1e-5), 0.0)
    discard(kept)
    return w.astype(np.float32), bias


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = 20_000, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(y, text) of about ``sample`` labelled documents, chosen by a hash of the id."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("y")).where("_id is not null and y in (0, 1)")
    if where is not None:
        known = known.where(where)
    known = known.distinct()
    n = known.count()
    share = min(1.0, sample / max(n, 1))
    known = known.where(F.pmod(F.xxhash64(F.lit(41), F.col("_id").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about ``sample`` ids, whatever the size of the tables
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "_id").select("y", "text")


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``offending`` (spans and probabilities of sentences)."""
    docs = docs.drop("toxicity", "offending")
    place = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    more = StructType.fromDDL("toxicity double, offending array<struct<begin: int, `end`: int, p: double>>")
    out = StructType([*docs.schema.fields, *more.fields])
    spans = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        score = Scorer(*sent.value)
        for batch in slices(batches, place, SLICE):
            got = [score(t or "") for t in batch.column(place).to_pylist()]
            found = [[{"begin": a, "end": b, "p": p} for a, b, p in f] for _, f in got]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p for p, _ in got], pa.float64()), pa.array(found, spans)], names=out.names)

    return docs.mapInArrow(run, out)


def _held_out(col: str) -> Column:
    return F.crc32(F.col(col).cast("string")) % 3 == 1


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[np.ndarray, float]:
    """The model of the registered query and of the pipeline."""
    return train(training_rows(docs, table(spark, sf_dir, "labels"), where=~_held_out("_id")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, fitted(spark, docs, sf_dir))
    return out.select("doc_id", F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
