"""Near-duplicates: ProbMinHash signatures, banding, exact verification, components.

Two texts are linked when the similarity of their five-word shingles is ``threshold`` or
more; classes are the connected components of all links, together with exact copies. The
similarity is the probability Jaccard of the shingles' weights, which for equal weights is
the Jaccard similarity of their sets. Weights are all 1 by default, so that a repeated
passage doesn't hide a near copy; with ``weighted`` they are the shingles' counts.
Signatures, filters and verification are of the same measure in either case.

1. Copies of a text collapse to one node, by a 128-bit hash, with partial aggregation.
2. ProbMinHash: the distinct shingles of a text are Poisson processes with their weight as
   rate. Each arrival falls into one register and a register keeps its first arrival; a
   shingle stops as soon as its next arrival is later than every register's. Two texts
   agree in a register with a probability that is their probability Jaccard.
3. Banding: ``bands`` groups of ``rows`` registers. A pair of similarity 0.8 shares a
   band with probability 1 - (1 - 0.8^4)^20 > 0.9999. Registers are cut to 16 bits, and a
   band is its four registers, so bands and signatures never disagree.
4. The nodes of a bucket are a group. A bucket larger than ``BLOCK`` is dealt into blocks
   of that size, in each band in another way: n nodes make n / ``BLOCK`` groups.
   In a group signatures are compared in numpy; pairs that agree in under 0.6 of the
   registers fall away (over four standard deviations below 0.8), and for sets pairs
   whose sizes forbid 0.8.
5. Verification, on whole texts. First each node's closest pair in its groups, which
   joins most classes. Then, in every group where nodes of two components still have
   such a pair, all these pairs, the closest first, until they are joined. Last, in
   buckets of several blocks, the nodes outside the largest component (few, for copies of
   a template, as these were joined by the blocks of other bands) meet all blocks of the
   bucket; so each pair of different components is compared, and a class with n texts in
   a bucket isn't compared n^2 times.
   A pair is left out only when its nodes are joined already, and a group of n nodes
   sends under n links.

What is missed: a pair that shares no band (under 1 in 10,000 at 0.8) or agrees in under 0.6
of the registers (under 1 in 50,000 at 0.8); either is found through a third text in a
class of more than two.

Nulls: texts without a word (null, empty, white space) are in no class but their own.
Texts of under five words have one shingle, all their words. A class is named by its
smallest id; a null id counts only where the whole class has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, slices, stored, table
from .components import components

BANDS, ROWS = 20, 4
M = BANDS * ROWS
LOW = 0.6
BLOCK = 512
#: Bytes of texts, and nodes of groups, that Python works on at a time.
SLICE, NODES = 1 << 20, 2048
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_ODD = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, _BACK)):
            step = np.full(2 * n, base, _U)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def shingles(text: str, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts. Words are parted by ASCII white space.

    A polynomial hash of the bytes, by prefix sums: a shingle is a stretch of bytes from
    its first word's first to its last word's last, with single blanks between words.
    """
    raw = b" ".join(text.encode("utf-8", "surrogatepass").split())
    if not raw:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    data = np.frombuffer(raw, np.uint8)
    blank = np.flatnonzero(data == 32)
    starts, ends = np.r_[0, blank + 1], np.r_[blank, len(data)]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:-1], out=total[1:])
    k = min(words, len(starts))
    a, b = starts[: len(starts) - k + 1], ends[k - 1 :]
    return np.unique(mix((total[b] - total[a]) * down[a]), return_counts=True)


def probminhash(items: np.ndarray, weights: np.ndarray, m: int = M) -> np.ndarray:
    """The item of the first arrival in each of ``m`` registers."""
    first, who = np.full(m, np.inf), np.zeros(m, _U)
    at, rate, item, state = np.zeros(len(items)), weights, items, items
    while len(item):
        state = mix(state + _U(0x9E3779B97F4A7C15))
        at = at - np.log(((state >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        register = (mix(state) % _U(m)).astype(np.int64)
        late = np.argsort(-at, kind="stable")
        late = late[at[late] < first[register[late]]]
        first[register[late]], who[register[late]] = at[late], item[late]
        go = at < first.max()
        at, rate, item, state = at[go], rate[go], item[go], state[go]
    return who


def set_jaccard(x, y) -> float:
    both = len(np.intersect1d(x[0], y[0], assume_unique=True))
    return both / (len(x[0]) + len(y[0]) - both)


def probability_jaccard(x, y) -> float:
    """Sum over common items i of 1 / sum over all items j of max(x_j / x_i, y_j / y_i)."""
    items, inverse = np.unique(np.concatenate([x[0], y[0]]), return_inverse=True)
    a, b = (np.bincount(i, w, len(items)) for i, w in ((inverse[: len(x[0])], x[1]), (inverse[len(x[0]) :], y[1])))
    with np.errstate(divide="ignore"):
        ratio = a / b
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    # where the ratio is that of i or more, x decides; below it, y
    first = np.searchsorted(ratio, ratio, "left")
    more, less = np.cumsum(a[::-1])[::-1], np.r_[0, np.cumsum(b)]
    common = (a > 0) & (b > 0)
    return float((1 / (more[first] / np.where(common, a, 1) + less[first] / np.where(common, b, 1)))[common].sum())


def similar(x, y, threshold: float, weighted: bool) -> bool:
    return (probability_jaccard if weighted else set_jaccard)(x, y) >= threshold - 1e-9


def _signatures(weighted: bool):
    salt = mix(np.arange(100, 100 + BANDS, dtype=_U))

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            size, sig, band = [], [], []
            for text in batch.column("text").to_pylist():
                items, counts = shingles(text or "")
                size.append(len(items))
                if not len(items):
                    sig.append(b"")
                    band.append([])
                    continue
                cut = probminhash(items, counts.astype(np.float64) if weighted else np.ones(len(items))).astype(np.uint16)
                sig.append(cut.tobytes())
                # the four registers of a band are its 64 bits
                band.append(mix(cut.view(_U) + salt).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("t1"), batch.column("t2"), pa.array(size, pa.int32()), pa.array(sig, pa.binary()), pa.array(band, pa.list_(pa.int64()))],
                names=["id", "t1", "t2", "size", "sig", "bands"],
            )

    return run


class Group:
    """The nodes of one group, with what tells which pairs it has to judge."""

    def __init__(self, rows: list[dict], band: int, least: float):
        """``least`` is the smallest share of a set's size that the other can have; 0 for weighted shingles."""
        self.rows, self.band, self.least = rows, band, least
        self.node = np.array([x["node"] for x in rows], np.int64)
        self.comp = np.array([x["comp"] for x in rows], np.int64)
        self.side = np.array([x["side"] for x in rows], np.int32)
        self.size = np.array([x["size"] for x in rows], np.float64)
        self.sig = np.frombuffer(b"".join(x["sig"] for x in rows), np.uint16).reshape(len(rows), M)
        self.crossed = bool(self.side.min() != self.side.max())

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes behind i that may be linked to it and aren't yet, and the registers they share.

        A pair that shares several bands is judged in the first of them alone.
        """
        js = np.arange(i + 1, len(self.node))
        ok = self.comp[js] != self.comp[i]
        if self.crossed:
            ok &= self.side[js] != self.side[i]
        ok &= np.minimum(self.size[js], self.size[i]) >= self.least * np.maximum(self.size[js], self.size[i]) - 1e-9
        js = js[ok]
        equal = self.sig[js] == self.sig[i]
        same = equal.sum(1)
        js, equal, same = js[same >= LOW * M], equal[same >= LOW * M], same[same >= LOW * M]
        first = equal.reshape(-1, BANDS, ROWS).all(2).argmax(1) == self.band
        return js[first], same[first]


def _closest(least: float):
    """For each node of a group the node closest to it: pairs (a, b)."""

    def run(batches):
        for batch in slices(batches, "members", NODES):
            a, b = [], []
            for rows, band in zip(batch.column("members").to_pylist(), batch.column("band").to_pylist(), strict=True):
                g = Group(rows, band, least)
                best = np.zeros(len(rows), np.int64)
                with_ = np.full(len(rows), -1)
                for i in range(len(rows)):
                    js, same = g.near(i)
                    if len(js):
                        k = same.argmax()
                        if same[k] > best[i]:
                            best[i], with_[i] = same[k], js[k]
                        better = same > best[js]
                        best[js[better]], with_[js[better]] = same[better], i
                at = np.flatnonzero(with_ >= 0)
                a.append(np.minimum(g.node[at], g.node[with_[at]]))
                b.append(np.maximum(g.node[at], g.node[with_[at]]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _open(least: float):
    """(g, band, node) of nodes that still have a pair to be judged in their group."""

    def run(batches):
        for batch in slices(batches, "members", NODES):
            names, bands, nodes = [], [], []
            for g, rows, band in zip(*[batch.column(c).to_pylist() for c in ("g", "members", "band")], strict=True):
                x = Group(rows, band, least)
                has = np.zeros(len(rows), bool)
                for i in range(len(rows)):
                    js, _ = x.near(i)
                    has[i] |= len(js) > 0
                    has[js] = True
                got = x.node[has].tolist()
                names += [g] * len(got)
                bands += [band] * len(got)
                nodes += got
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(bands, pa.int32()), pa.array(nodes, pa.int64())], names=["g", "band", "node"])

    return run


def _judged(threshold: float, weighted: bool, least: float):
    """Links (a, b) that join the components of a group: its pairs are verified, the closest first,
    but for those whose nodes are joined already, so that n nodes give under n links."""

    def run(batches):
        for batch in slices(batches, "members", NODES):
            a, b = [], []
            for rows, band in zip(batch.column("members").to_pylist(), batch.column("band").to_pylist(), strict=True):
                g = Group(rows, band, least)
                up = {int(c): int(c) for c in g.comp}

                def find(c, up=up):
                    while up[c] != c:
                        up[c] = c = up[up[c]]
                    return c

                pairs = []
                for i in range(len(rows)):
                    js, same = g.near(i)
                    pairs.append(np.stack([-same, np.full(len(js), i), js]))
                pairs = np.concatenate(pairs, axis=1)
                sets: dict[int, tuple] = {}
                for i, j in pairs[1:, np.argsort(pairs[0], kind="stable")].T.tolist():
                    p, q = find(int(g.comp[i])), find(int(g.comp[j]))
                    if p == q:
                        continue
                    for k in (i, j):
                        if k not in sets:
                            sets[k] = shingles(rows[k]["text"])
                    if similar(sets[i], sets[j], threshold, weighted):
                        up[p] = q
                        a.append(min(rows[i]["node"], rows[j]["node"]))
                        b.append(max(rows[i]["node"], rows[j]["node"]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _verify(threshold: float, weighted: bool):
    def run(batches):
        last, x = None, None
        for batch in slices(batches, "ta", SLICE):
            keep = []
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                if ta != last:
                    last, x = ta, shingles(ta)
                keep.append(similar(x, shingles(tb), threshold, weighted))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _groups(buckets: DataFrame) -> DataFrame:
    """(g, band, members): the nodes of a bucket, or of a block of it; array<struct<node, side>>.

    A set that several bands have alike is one group, that of the first band.
    """
    block = F.pmod(F.xxhash64("node", F.when(F.col("c") > BLOCK, F.col("band"))), F.ceil(F.col("c") / BLOCK)).alias("block")
    rows = buckets.select("band", "value", "node", block).groupBy("band", "value", "block")
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("node", F.lit(0).alias("side")))).alias("members")).where(F.size("members") > 1)
    rows = rows.groupBy(F.xxhash64("members.node").alias("h1"), F.xxhash64(F.lit(3), "members.node").alias("h2"))
    return rows.agg(F.min("band").alias("band"), F.first("members").alias("members")).select(F.monotonically_increasing_id().alias("g"), "band", "members")


def _crossed(large: DataFrame, comps: DataFrame) -> DataFrame:
    """(g, band, node, side, comp): in buckets of several blocks and components, the nodes outside the
    largest component, block by block, together with each block of the bucket.
    """
    rows = large.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = rows.groupBy("band", "value", "comp").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("band", "value").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("c")).where("top.n < c")
    rows = rows.drop("c").join(sizes, ["band", "value"]).withColumn("few", F.col("comp") != F.col("top.comp"))
    number = lambda c: F.ceil(c / BLOCK).cast("int")
    n_few, n_many = number(F.col("c") - F.col("top.n")), number(F.col("top.n"))
    rows = rows.select("band", "value", "node", "comp", "few", n_few.alias("nf"), n_many.alias("nm"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("few"), F.col("nf")).otherwise(F.col("nm"))).cast("int")
    rows = rows.withColumn("own", own)
    # blocks 0 .. nf - 1 hold the few, the others the many; (i, j) with i <= j, i of the few
    few = F.transform(F.sequence(F.lit(0), F.col("nf") + F.col("nm") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    many = F.transform(F.sequence(F.lit(0), F.col("nf") - 1), lambda k: F.struct(k.alias("i"), (F.col("nf") + F.col("own")).alias("j")))
    rows = rows.select("band", "value", "node", "comp", F.when(F.col("few"), F.col("own")).otherwise(F.col("nf") + F.col("own")).alias("side"), F.explode(F.when(F.col("few"), few).otherwise(many)).alias("x"))
    return rows.select(F.xxhash64("band", "value", "x.i", "x.j").alias("g"), "band", "node", "side", "comp")


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", weighted: bool = False) -> DataFrame:
    """(id, class_id) for each row of ``docs``: the smallest id of its class."""
    named = _classes(docs, threshold, id_col, text_col, weighted)
    smallest = named.groupBy("comp").agg(F.min("id").alias("class_id"))
    named = named.join(smallest, "comp").select("t1", "t2", "class_id", F.lit(True).alias("known"))
    out = _base(docs, id_col, text_col).select("id", "t1", "t2").join(named, ["t1", "t2"], "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("known"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"))


def one_of_each_class(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", weighted: bool = False) -> DataFrame:
    """``docs`` with one row of each class: the smallest id, a null id last, and of rows alike in id the
    first text by hash. Texts without a word have no shingles, but equal ones are exact copies,
    of which one row stays too (null, empty and blank texts differ).
    """
    named = _classes(docs, threshold, id_col, text_col, weighted)
    chosen = named.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")).alias("x")).select("x.id", "x.t1", "x.t2")
    t1, t2 = _text_keys(text_col)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), t1, t2)
    kept = keyed.join(chosen.withColumnRenamed("id", "_i"), ["t1", "t2"]).where(F.col("_id").eqNullSafe(F.col("_i")))
    # rows alike in id and text: their number is combined before the shuffle, and few rows meet
    twice = kept.groupBy("t1", "t2").agg(F.count("*").alias("n")).where("n > 1").select("t1", "t2")
    once = kept.join(twice, ["t1", "t2"], "left_anti").select("_row")
    one = kept.join(twice, ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("_row").alias("_row")).select("_row")
    blank = keyed.where(~F.coalesce(F.col("_row")[text_col].cast("string").rlike("\\S"), F.lit(False)))
    blank = blank.groupBy("t1", "t2", F.col("_row")[text_col].isNull()).agg(F.min_by("_row", F.struct(F.col("_id").isNull(), F.col("_id"))).alias("_row")).select("_row")
    return once.unionByName(one).unionByName(blank).select("_row.*")


def _text_keys(text_col: str) -> list[Column]:
    text = F.col(f"`{text_col}`").cast("string")
    return [F.xxhash64(F.lit(5), text).alias("t1"), F.xxhash64(F.lit(17), text).alias("t2")]


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), *_text_keys(text_col), F.col(f"`{text_col}`").cast("string").alias("text"))


def _classes(docs: DataFrame, threshold: float, id_col: str, text_col: str, weighted: bool) -> DataFrame:
    """(id, t1, t2, comp) of each distinct text with a word, with its smallest id."""
    if threshold < 0.75:
        raise ValueError("the bands are laid out for a threshold of 0.75 or more")
    least = 0.0 if weighted else threshold
    base = _base(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, t1 long, t2 long, size int, sig binary, bands array<long>"
    signed = base.where(F.col("text").rlike("\\S")).mapInArrow(_signatures(weighted), schema).where("size > 0")
    one = signed.groupBy("t1", "t2").agg(F.min("id").alias("id"), F.first(F.struct("size", "sig", "bands")).alias("x"))
    nodes = stored(one.select(F.monotonically_increasing_id().alias("node"), "id", "t1", "t2", "x.*"), "nodes")

    placed = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    shared = placed.groupBy("band", "value").agg(F.count("*").alias("c")).where("c > 1")
    buckets = placed.join(shared, ["band", "value"])
    groups = stored(_groups(buckets), "groups")
    large = stored(buckets.where(F.col("c") > BLOCK), "large")
    wanted = groups.select(F.explode("members.node").alias("node")).distinct()
    wanted = nodes.select("node", F.col("id").alias("_i"), F.col("t1").alias("_1"), F.col("t2").alias("_2")).join(wanted, "node")
    texts = base.join(wanted, F.col("id").eqNullSafe(F.col("_i")) & (F.col("t1") == F.col("_1")) & (F.col("t2") == F.col("_2")))
    texts = stored(texts.select("node", "text").groupBy("node").agg(F.first("text").alias("text")), "texts")

    sigs = nodes.select("node", "size", "sig")
    member = ["node", "side", "comp", "size", "sig"]
    rows = groups.select("g", "band", F.inline("members"))

    def gathered(rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows.groupBy("g", "band").agg(F.collect_list(F.struct(*columns)).alias("members"))

    first = gathered(rows.withColumn("comp", F.col("node")).join(sigs, "node"), member)
    pairs = first.select("band", "members").mapInArrow(_closest(least), "a long, b long").distinct()
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    comps = components(stored(both.select("a", "b", "ta", "tb").mapInArrow(_verify(threshold, weighted), "a long, b long"), "links"))

    def judged(rows: DataFrame, comps: DataFrame) -> DataFrame:
        """Components once all pairs in the groups of (g, band, node, side, comp) are judged."""
        split = rows.groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("g")
        rows = stored(rows.join(split, "g").join(sigs, "node"), "rows")
        left = stored(gathered(rows, member).mapInArrow(_open(least), "g long, band int, node long"), "open")
        last = gathered(rows.join(left, ["g", "band", "node"]).join(texts, "node"), [*member, "text"])
        links = last.select("band", "members").mapInArrow(_judged(threshold, weighted, least), "a long, b long")
        out = components(links.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))))
        discard(rows)
        discard(left)
        return out

    comps = judged(rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), comps)
    if not large.isEmpty():
        comps = judged(_crossed(large, comps), comps)
    named = stored(nodes.select("node", "id", "t1", "t2").join(comps, "node", "left").select("id", "t1", "t2", F.coalesce("comp", "node").alias("comp")), "classes")
    for spent in (nodes, groups, large, texts):
        discard(spent)
    return named


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
