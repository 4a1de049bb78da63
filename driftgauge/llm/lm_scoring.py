"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(unit | class, history) * P(word | unit). A class
is a word ending: the 61 two-byte endings with most training tokens have one each, the end
of a text has its own, all other words share one. The 63 most frequent training words of a
class are units of their own; its 64th unit holds the rest, in which words have their
smoothed share of the training tokens and unseen words together half a count. Both
factors are learnt softmaxes, each in two levels of eight. At every node on the way to a
word, these hashed features of the history have a row of eight weights:

- for the class: the word before (n-gram) and the word two before (skip), the last two
  classes (n-gram) and the classes one and three before (skip), and a bias;
- for the unit: the word before (n-gram), the word two before (skip), and a bias.

The rows of a level are a power of two, at least a sixteenth of the distinct words,
``LEAST_ROWS`` to ``max_rows``; the bound is there because the model is broadcast.

1. Texts become 64-bit word hashes in numpy. Blocks of documents keep their own list of
   distinct words; a document is a row of places in it.
2. The counts of all blocks are summed by word; a second join brings them back to each
   block's list. Both go by word with Spark's own aggregation and join, so that a
   frequent word, one row for each block, is combined before the shuffle and, in the
   join, split by adaptive execution.
3. Each document becomes a number for each token, its leaf of the tree or its class and
   17 bits of its hash, and the sums of what doesn't depend on the history. These coded
   documents go to the shared folder, in planes of bytes, which pack well.
4. Training: each of ``ROUNDS`` rounds takes another part of all training documents, so
   each training token is used once. A task goes through its documents in minibatches
   and returns the rows it moved; rows are averaged over the tasks, weighted by use, in
   a grouped job by slices of the model. The number of tasks is tokens over
   ``tokens_per_task``, at every size. The model alone reaches the driver.
5. Scoring is one narrow pass in numpy batches.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased, then one end. Words are
told apart by 64-bit hashes: among 10^8 distinct words, two share one with odds of 1 in 4,000.

Nulls: a null text is empty, with the end alone; a null id is held out of nothing and
trains nothing. Repeated rows count as often as they stand. Without training documents
every probability is that of an unseen word. Only the id and the text are read, so other
columns can't clash. A very long text is a few arrays of numbers, gone through in slices.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored, table
from .near_dedup import mix, powers

_U = np.uint64
#: The end of a text, as a word hash, and as an ending.
END, ENDING_OF_END = _U(0), 1 << 16
CLASSES = UNITS = 64
REST = UNITS - 1
ROUNDS = 4
SLICES = 4
BATCH = 65_536
LEAST_ROWS = 4096
#: Nodes of each level of the tree.
NODES = (1, 8, 64, 512)
IMPOSSIBLE = -60.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_CHUNK = 1 << 18


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts or binaries, end to end, and the offsets; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of bytes from numbers laid end to end; ``ends`` counts numbers."""
    at = np.r_[0, ends].astype(np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def planes(values: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """Rows of numbers in three columns: the low byte, the next one and the two high ones of each number."""
    return [binaries(x, ends) for x in (values.astype(np.uint8), (values >> 8).astype(np.uint8), (values >> 16).astype(np.uint16))]


def whole(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``planes`` end to end, and the offsets of the rows."""
    (low, at), (mid, _), (high, _) = map(raw, columns)
    high = np.frombuffer(high.tobytes(), np.uint16)
    return low | mid.astype(np.uint32) << 8 | high.astype(np.uint32) << 16, at


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and endings of all tokens of a column of texts, and where each text's tokens end."""
    data, at = raw(column)
    data = _LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = at[1:-1]
    first[bounds] = inside[bounds]
    starts = np.flatnonzero(first)
    # a word ends before the next byte that is a blank or begins another text
    stop = ~inside
    stop[bounds] = True
    stop[-1] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, "right")]
    h = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + _CHUNK, "right")))
        part = data[a : ends[j - 1]]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, _U)
        np.cumsum((part.astype(_U) + _U(1)) * up[: len(part)], out=total[1:])
        s = starts[i:j] - a
        h[i:j] = mix((total[ends[i:j] - a] - total[s]) * down[s])
        i = j
    n = np.searchsorted(starts, at[1:])  # words up to the end of each text
    docs = np.arange(len(n))
    place = np.arange(len(starts)) + np.repeat(docs, np.diff(n, prepend=0))
    word, ending = np.full(len(starts) + len(n), END), np.full(len(starts) + len(n), ENDING_OF_END, np.int32)
    word[place] = h
    last = data[ends - 1].astype(np.int32)
    ending[place] = last | np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)].astype(np.int32) << 8, 0)
    return word, ending, n + docs + 1


BLOCK = pa.schema([("block", pa.int64()), ("doc_id", pa.string()), ("held", pa.bool_()), ("trains", pa.bool_()), ("low", pa.binary()), ("mid", pa.binary()), ("high", pa.binary()), ("words", pa.list_(pa.int64())), ("endings", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
BLOCK_DDL = "block long, doc_id string, held boolean, trains boolean, low binary, mid binary, high binary, words array<long>, endings array<int>, counts array<long>"


def _blocks(block_tokens: int):
    """Rows of documents, as places in the list of their block, and a row with the list of each block."""

    def out(block: int, parts: list):
        word, ending = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        lengths = np.concatenate([np.diff(p[2], prepend=0) for p in parts])
        doc, held, trains = (pa.concat_arrays([p[3][k] for p in parts]) for k in range(3))
        order = np.argsort(word)
        new = np.r_[True, word[order[1:]] != word[order[:-1]]]
        place = np.empty(len(word), np.uint32)
        place[order] = np.cumsum(new) - 1
        # frequent words get small numbers
        by_count = np.argsort(-np.bincount(place), kind="stable")
        number = np.empty(len(by_count), np.uint32)
        number[by_count] = np.arange(len(by_count))
        place, one = number[place], order[new][by_count]
        used = np.repeat(trains.to_numpy(zero_copy_only=False).astype(bool), lengths)
        count = np.bincount(place[used], minlength=len(one))
        n, none = len(doc), pa.nulls
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), doc, held, trains, *planes(place, np.cumsum(lengths)), *[none(n, BLOCK.field(k).type) for k in (7, 8, 9)]], schema=BLOCK
        )
        lists = [pa.array([x], BLOCK.field(k).type) for k, x in ((7, word[one].view(np.int64)), (8, ending[one]), (9, count))]
        yield pa.RecordBatch.from_arrays([pa.array([block]), *[none(1, BLOCK.field(k).type) for k in range(1, 7)], *lists], schema=BLOCK)

    def run(batches):
        block, parts, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            a = 0
            while a < len(batch):
                # as many texts as fit, by their bytes; one at least
                b = a + 1
                room = 8 * (block_tokens - size)
                lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(3).slice(a)), 0).to_numpy(zero_copy_only=False))
                b = a + max(1, int(np.searchsorted(lengths, room, "right")))
                piece = batch.slice(a, b - a)
                parts.append((*tokens_of(piece.column(3)), [piece.column(k) for k in range(3)]))
                size += len(parts[-1][0])
                a = b
                if size >= block_tokens or a < len(batch):
                    yield from out(block, parts)
                    block, parts, size = block + 1, [], 0
        if parts:
            yield from out(block, parts)

    return run


class Lexicon:
    """The tree: a class for each ending, a leaf for each frequent word, and the shares in the rest of a class."""

    def __init__(self, per: list[tuple[int, int, int]], head: list[tuple[int, int, int]], classes: dict[int, int]):
        """``per`` has (ending, tokens, words), ``head`` (hash, class, tokens) of frequent words, most frequent first."""
        self.of_ending = np.full(ENDING_OF_END + 1, CLASSES - 2, np.int64)
        for e, k in classes.items():
            self.of_ending[e] = k
        tokens, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
        for e, n, v in per:
            tokens[self.of_ending[e]] += n
            kinds[self.of_ending[e]] += v
        self.n, self.v = int(tokens.sum()), int(kinds.sum())
        leaf, share, seen = {}, np.zeros((CLASSES, UNITS)), np.zeros(CLASSES, np.int64)
        for h, k, c in head:
            leaf[h] = k * UNITS + int(seen[k])
            share[k, seen[k]] = c
            seen[k] += 1
            tokens[k] -= c
            kinds[k] -= 1
        self.rest = tokens + 0.5 * (kinds + 1)  # half a count for each word, and one half for all unseen
        share[:, REST] = self.rest
        share[0, REST] = 0
        share[0, 0] = max(share[0, 0], 0.5)
        self.share = share
        order = sorted(leaf)
        self.words, self.leaves = np.array(order, np.int64), np.array([leaf[h] for h in order], np.int64)

    def leaf(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = self.of_ending[endings] * UNITS + REST
        out[endings == ENDING_OF_END] = 0
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            out = np.where(self.words[at] == words, self.leaves[at], out)
        return out

    def biases(self) -> list[np.ndarray]:
        """Log shares of the eight branches of every node."""
        s, out = self.share.reshape(8, 8, 8, 8), []
        for level in range(4):
            t = s.sum(tuple(range(level + 1, 4))).reshape(-1, 8)
            whole = t.sum(1, keepdims=True)
            out.append(np.where(t > 0, np.log(np.maximum(t, 1e-9) / np.maximum(whole, 1e-9)), np.where(whole > 0, IMPOSSIBLE, 0.0)).astype(np.float32))
        return out


CODED = "doc_id string, held boolean, trains boolean, n_tokens long, n_known long, base_score double, inside double, low binary, mid binary, high binary"


def coded(words: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """A number for each word: its leaf, or for words in the rest of a class the class and 17 bits of the hash."""
    rest = CLASSES * UNITS + ((words.view(_U) >> _U(47)) << _U(6) | (leaf >> 6).astype(_U))
    return np.where((leaf & REST) == REST, rest, leaf.astype(_U)).astype(np.uint32)


def leaves(code: np.ndarray) -> np.ndarray:
    return np.where(code < CLASSES * UNITS, code, (code & 63) << 6 | REST)


def _code(lexicon: Lexicon):
    """Documents of a block with what its words say of each token."""
    n, v = lexicon.n, lexicon.v

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        at = words.column("at").to_numpy()
        size = int(at.max()) + 1 if len(at) else 1

        def by_place(name, kind):
            out = np.zeros(size, kind)
            out[at] = words.column(name).to_numpy()
            return out

        c, word, ending = by_place("c", np.int64), by_place("word", np.int64), by_place("ending", np.int64)
        leaf = lexicon.leaf(word, ending)
        code = coded(word, leaf)
        inside = np.where((leaf & REST) == REST, np.log10((c + 0.5) / lexicon.rest[leaf >> 6]), 0.0)
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        known = (c > 0).astype(np.float64)
        seq, offsets = whole([docs.column(k).combine_chunks() for k in ("low", "mid", "high")])
        starts, ends = offsets[:-1], offsets[1:]
        low, mid, high = planes(code[seq], ends)
        total = lambda x: np.add.reduceat(x[seq], starts)  # noqa: E731  each document has a token, its end
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held": docs.column("held"),
                "trains": docs.column("trains"),
                "n_tokens": pa.array(ends - starts),
                "n_known": pa.array(total(known).astype(np.int64)),
                "base_score": pa.array(total(base)),
                "inside": pa.array(total(inside)),
                "low": low,
                "mid": mid,
                "high": high,
            }
        )

    return run


def contexts(code: np.ndarray, starts: np.ndarray, a: int, b: int) -> list[np.ndarray]:
    """Hashes of the history of tokens a..b of documents laid end to end: two of words, two of classes."""
    low = max(a - 3, 0)
    past = code[low:b]
    cls = leaves(past) >> 6
    firsts = [(p := starts + j)[(p >= a) & (p < b)] - a for j in range(3)]

    def back(x: np.ndarray, k: int) -> np.ndarray:
        """What stands k tokens before; before the first token of a document stands an end, 0."""
        out = np.zeros(b - a, _U)
        skip = max(low + k - a, 0)
        out[skip:] = x[a + skip - k - low : b - k - low]
        for p in firsts[:k]:
            out[p] = 0
        return out

    w1, w2, c1, c2, c3 = back(past, 1), back(past, 2), back(cls, 1), back(cls, 2), back(cls, 3)
    values = [w1 << _U(3) | _U(1), w2 << _U(3) | _U(2), (c1 << _U(6) | c2) << _U(3) | _U(3), (c1 << _U(6) | c3) << _U(3) | _U(4)]
    return [x * _U(0x9E3779B97F4A7C15) for x in values]


def rows_at(features: list[np.ndarray], level: int, node: np.ndarray, bits: int) -> list[np.ndarray]:
    """Weight rows of a level: the node's bias and its hashed features."""
    salt = (node.astype(_U) + _U(1 + 1000 * level)) * _U(0xD6E8FEB86659FD93)
    use = features if level < 2 else features[:2]
    return [node, *[(((f ^ salt) * _U(0xC2B2AE3D27D4EB4F)) >> _U(64 - bits)).astype(np.int64) + NODES[level] for f in use]]


def shares(weights: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Summed weight rows, their exponentials (8, n), shifted by the largest, and the sums of these."""
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z = np.ascontiguousarray(z.T)
    z -= z.max(0)
    e = np.exp(z)
    return z, e, e.sum(0)


def levels(leaf: np.ndarray):
    """(level, node, branch) on the way to each leaf."""
    leaf = leaf.astype(np.int64)
    return [(k, leaf >> (12 - 3 * k), (leaf >> (9 - 3 * k)) & 7) for k in range(4)]


def log_prob(model: list[np.ndarray], bits: int, features: list[np.ndarray], leaf: np.ndarray) -> np.ndarray:
    at = np.arange(len(leaf))
    out = np.zeros(len(leaf))
    for k, node, branch in levels(leaf):
        z, _, whole = shares(model[k], rows_at(features, k, node, bits))
        out += z[branch, at] - np.log(whole)
    return out


def descend(weights: np.ndarray, used: np.ndarray, rows: list[np.ndarray], target: np.ndarray, rate: float, ridge: float = 2.0) -> None:
    """One step down the log loss of a minibatch, scaled by how often a row is used in it."""
    _, d, whole = shares(weights, rows)
    d = np.divide(d, whole, dtype=np.float64)
    d[target, np.arange(len(target))] -= 1
    count = np.bincount(rows[0], minlength=len(weights))
    for r in rows[1:]:
        count += np.bincount(r, minlength=len(weights))
    hit = np.flatnonzero(count)
    scale = rate / (count[hit] + ridge)
    move = np.empty((len(hit), 8), np.float32)
    for b in range(8):
        g = np.bincount(rows[0], weights=d[b], minlength=len(weights))
        for r in rows[1:]:
            g += np.bincount(r, weights=d[b], minlength=len(weights))
        move[:, b] = scale * g[hit]
    weights[hit] -= move
    used += count


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The coded tokens of the documents of a batch end to end, and where each document begins."""
    code, at = whole([batch.column(k) for k in ("low", "mid", "high")])
    return code, at[:-1]


def _train_part(sent, bits: int, rate: float):
    def run(batches):
        start = sent.value
        model = [w.copy() for w in start]
        used = [np.zeros(len(w), np.int64) for w in model]
        for batch in batches:
            code, starts = _flat(batch)
            for a in range(0, len(code), BATCH):
                b = min(a + BATCH, len(code))
                features = contexts(code, starts, a, b)
                for k, node, branch in levels(leaves(code[a:b])):
                    descend(model[k], used[k], rows_at(features, k, node, bits), branch, rate)
        for k in range(4):
            for s, part in enumerate(np.array_split(np.arange(len(model[k])), SLICES)):
                hit = part[used[k][part] > 0]
                if len(hit):
                    moved = (model[k][hit] - start[k][hit]).astype(np.float16)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k * SLICES + s], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (hit.astype(np.int32), used[k][hit].astype(np.float32), moved)]],
                        names=["slice", "idx", "used", "moved"],
                    )

    return run


MOVED = "slice int, idx binary, used binary, moved binary"


def _average(parts: pa.Table) -> pa.Table:
    """The moves of one slice of the model, averaged by use."""
    idx = [np.frombuffer(x, np.int32) for x in parts.column("idx").to_pylist()]
    used = [np.frombuffer(x, np.float32) for x in parts.column("used").to_pylist()]
    moved = [np.frombuffer(x, np.float16).reshape(-1, 8) for x in parts.column("moved").to_pylist()]
    rows = np.unique(np.concatenate(idx))
    total, weight = np.zeros((len(rows), 8)), np.zeros(len(rows))
    for i, u, m in zip(idx, used, moved, strict=True):
        at = np.searchsorted(rows, i)
        total[at] += u[:, None].astype(np.float64) * m
        weight[at] += u
    return pa.table({"slice": parts.column("slice").slice(0, 1), "idx": pa.array([rows.astype(np.int32).tobytes()]), "used": pa.array([weight.astype(np.float32).tobytes()]), "moved": pa.array([(total / weight[:, None]).astype(np.float16).tobytes()])})


def train(coded: DataFrame, lexicon: Lexicon, bits: int, tokens_per_task: int = 4_000_000) -> list[np.ndarray]:
    """The weight rows of the four levels, from the coded documents that train."""
    spark = coded.sparkSession
    model = [np.vstack([b, np.zeros((1 << bits, 8), np.float32)]) for b in lexicon.biases()]
    rows = coded.where("trains").select("doc_id", "low", "mid", "high")
    tasks = ceil(max(lexicon.n, 1) / ROUNDS / tokens_per_task)
    for k in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)
        part = rows.where(F.pmod(F.xxhash64(F.lit(29), "doc_id", "low"), F.lit(ROUNDS)) == k).select("low", "mid", "high").coalesce(tasks)
        moves = part.mapInArrow(_train_part(sent, bits, 0.8 / (1 + k)), MOVED)
        model = [w.copy() for w in model]
        for r in moves.groupBy("slice").applyInArrow(_average, MOVED).collect():
            idx = np.frombuffer(r.idx, np.int32)
            model[r.slice // SLICES][idx] += np.frombuffer(r.moved, np.float16).reshape(-1, 8)
        sent.unpersist()
    return model


def _score(sent, bits: int):
    names = ["doc_id", "held", "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        model = sent.value
        for batch in batches:
            if not len(batch):
                continue
            code, starts = _flat(batch)
            log = np.empty(len(code))
            for a in range(0, len(code), BATCH):
                b = min(a + BATCH, len(code))
                log[a:b] = log_prob(model, bits, contexts(code, starts, a, b), leaves(code[a:b]))
            score = np.add.reduceat(log, starts) / np.log(10) + batch.column("inside").to_numpy()
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names[:-1]], pa.array(score)], names=names)

    return run


def coded_documents(docs: DataFrame, held: Column, id_col: str, text_col: str, block_tokens: int) -> tuple[DataFrame, Lexicon]:
    """Steps 1 to 3."""
    base = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.coalesce(~held & F.col(id_col).isNotNull(), F.lit(False)).alias("trains"), F.col(text_col).cast("string").alias("text"))
    blocks = stored(base.mapInArrow(_blocks(block_tokens), BLOCK_DDL), "words")

    lists = blocks.where("words is not null").select("block", F.posexplode(F.arrays_zip("words", "endings", "counts")).alias("at", "x"))
    lists = lists.select("block", "at", F.col("x.words").alias("word"), F.col("x.endings").alias("ending"), F.col("x.counts").alias("c"))
    counted = stored(lists.groupBy("word").agg(F.sum("c").alias("c"), F.min("ending").alias("ending")), "counts")
    # endings are 65,537 at most
    per = [(r.ending, r.n, r.v) for r in counted.groupBy("ending").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).collect()]
    frequent = sorted((r for r in per if r[1] > 0 and r[0] != ENDING_OF_END), key=lambda r: (-r[1], r[0]))[: CLASSES - 3]
    classes = {ENDING_OF_END: 0} | {e: 1 + i for i, (e, _, _) in enumerate(frequent)}
    number = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]), F.col("ending")), F.lit(CLASSES - 2))
    by_count = Window.partitionBy("class").orderBy(F.desc("c"), "word")
    head = counted.where("c > 0").select("word", "c", number.alias("class")).withColumn("r", F.row_number().over(by_count)).where(F.col("r") < UNITS)
    # 63 words of each of 63 classes at most
    lexicon = Lexicon(per, [(r.word, r["class"], r.c) for r in head.orderBy("class", "r").collect()], classes)

    back = lists.drop("c").join(counted.select("word", "c"), "word").select(F.col("block").alias("part"), "at", "word", "ending", "c")
    rows = blocks.where("words is null").select("block", "doc_id", "held", "trains", "low", "mid", "high")
    coded = stored(rows.groupBy("block").cogroup(back.groupBy("part")).applyInArrow(_code(lexicon), CODED), "coded")
    discard(blocks)
    discard(counted)
    return coded, lexicon


def row_bits(words: int, max_rows: int) -> int:
    """Bits of the rows of a level."""
    return int(ceil(log2(min(max(words / 16, LEAST_ROWS), max_rows))))


def score_documents(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 5_000_000, max_rows: int = 1 << 17) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; ``held`` rows don't train."""
    coded, lexicon = coded_documents(docs, held, id_col, text_col, block_tokens)
    bits = row_bits(lexicon.v, max_rows)
    model = docs.sparkSession.sparkContext.broadcast(train(coded, lexicon, bits))
    out = coded.mapInArrow(_score(model, bits), "doc_id string, held boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(lexicon.n).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
