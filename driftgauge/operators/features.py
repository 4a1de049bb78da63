"""Features: TF-IDF, mean word vectors, layer-wise embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import div, join_on

WORD = r"(?Ud)\b\w+\b"
WORD2 = r"(?Ud)\b\w\w+\b"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once for use inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(units: Column, k: int, sep: str) -> Column:
    """All runs of k units, joined; none where there are fewer."""
    if k == 1:
        return units
    some = F.transform(F.sequence(F.lit(1), F.size(units) - (k - 1)), lambda i: F.array_join(F.slice(units, i, F.lit(k)), sep))
    return F.when(F.size(units) >= k, some).otherwise(F.array().cast("array<string>"))


def _grams(units: Column, low: int, high: int, sep: str) -> Column:
    return _let(units, lambda u: F.concat(*[_runs(u, k, sep) for k in range(low, high + 1)]))


def grams(text: Column, analyzer: str = "word", ngram: tuple[int, int] = (1, 1), pattern: str = WORD2) -> Column:
    """n-grams of the lower-case text: ``word``, ``char`` (runs of blanks are one) or ``char_wb`` (within padded words)."""
    low = F.lower(text)
    if analyzer == "word":
        return _grams(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)), *ngram, " ")
    if analyzer == "char":
        return _grams(F.split(F.regexp_replace(low, r"(?U)\s\s+", " "), ""), *ngram, "")
    words = F.filter(F.split(low, r"(?U)\s+"), lambda w: w != "")
    # grams are made once for each different word
    return F.flatten(F.transform(_tally(words), lambda w: F.flatten(F.array_repeat(_of_word(w["item"], *ngram), w["n"].cast("int")))))


def _of_word(word: Column, low: int, high: int, short: int = 100) -> Column:
    """Runs of characters of the padded word; one shorter than the least n gives itself once."""

    def runs(p: Column, k: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.length(p) - (k - 1)), lambda i: F.substring(p, i, F.lit(k)))
        return F.when(F.length(p) >= k, some).otherwise(F.array().cast("array<string>"))

    def cut(p: Column) -> Column:
        # to cut a run out of a text takes time as its place, so long words are split first
        made = F.concat(*[runs(p, k) for k in range(low, high + 1)])
        return F.when(F.length(p) < low, F.array(p)).when(F.length(p) <= short, made).otherwise(_grams(F.split(p, ""), low, high, ""))

    return _let(F.concat(F.lit(" "), word, F.lit(" ")), cut)


def _tally(items: Column) -> Column:
    """array<struct<item, n>>: how often each item stands in an array, by sorting it; empty for null."""

    def ends(s: Column) -> Column:
        """The sorted array and the places at which runs of equal items end."""
        last = lambda i: (i == F.size(s)) | (F.element_at(s, i) != F.get(s, i))
        return F.struct(s.alias("s"), F.filter(F.sequence(F.lit(1), F.size(s)), last).alias("e"))

    def counts(x: Column) -> Column:
        before = lambda j: F.coalesce(F.when(j > 0, F.get(x["e"], j - 1)), F.lit(0))
        return F.transform(x["e"], lambda e, j: F.struct(F.element_at(x["s"], e).alias("item"), (e - before(j)).cast("long").alias("n")))

    none = F.array().cast("array<struct<item:string,n:bigint>>")
    return F.when(F.size(items) > 0, _let(_let(F.sort_array(items), ends), counts)).otherwise(none)


def gram_counts(docs: DataFrame, id_col: str, text: str = "text", **how) -> DataFrame:
    """(id, gram, tf). The text itself is never shuffled."""
    # ``explode`` would make Spark ask first whether there are any, which makes all grams once more
    return docs.select(id_col, F.explode_outer(grams(F.col(text), **how)).alias("gram")).where("gram is not null").groupBy(id_col, "gram").agg(F.count("*").alias("tf"))


def gram_totals(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """(gram, total) over all documents."""
    return docs.select(F.explode_outer(grams(F.col(text), **how)).alias("gram")).where("gram is not null").groupBy("gram").agg(F.count("*").alias("total"))


def _row_counts(docs: DataFrame, id_col: str, text: str, **how) -> DataFrame:
    """``gram_counts``, counted within the rows; only where an id has several rows are they added up by a shuffle."""
    counts = docs.select(id_col, F.inline_outer(_let(grams(F.col(text), **how), _tally))).where("item is not null").select(id_col, F.col("item").alias("gram"), F.col("n").alias("tf"))
    one_each = docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return counts if one_each else counts.groupBy(id_col, "gram").agg(F.sum("tf").alias("tf"))


def top_vocabulary(counts: DataFrame, n: int, by: str = "total", key: str = "gram") -> DataFrame:
    """The n most frequent grams, in gram order on ties."""
    return counts.orderBy(F.desc(by), key).limit(n)


def vocabulary(train_counts: DataFrame, n_docs: Column, max_features: int) -> DataFrame:
    """(gram, df, idf) of the most frequent grams of the training documents."""
    totals = train_counts.groupBy("gram").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    top = top_vocabulary(totals, max_features)
    return top.select("gram", "df", (F.ln((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(train: DataFrame, docs: DataFrame, id_col: str, text: str = "text", max_features: int = 50_000, sublinear: bool = False, **how) -> DataFrame:
    """(id, gram, tfidf), each document of length 1; vocabulary and idf come from ``train`` alone.

    The vocabulary has ``max_features`` rows at most, so it is broadcast. What is shuffled of a document is its
    grams of the vocabulary, once.
    """
    n = train.agg(F.count("*").alias("_n"))
    counts = _row_counts(train, id_col, text, **how)
    top = top_vocabulary(counts.groupBy("gram").agg(F.sum("tf").alias("total"), F.count("*").alias("df")), max_features)
    vocab = top.crossJoin(F.broadcast(n)).select("gram", (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))
    tf = 1 + F.ln("tf") if sublinear else F.col("tf").cast("double")
    rows = _row_counts(docs, id_col, text, **how).join(F.broadcast(vocab), "gram").select(id_col, "gram", (tf * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return rows.select(id_col, "gram", (F.col("w") / norm).alias("tfidf"))


def vector_mean(df: DataFrame, keys: list[str], vec: str = "embedding", weight: str | None = None) -> DataFrame:
    """Mean vector (array<double>) and row count of each group, with partial aggregation."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    mean = Summarizer.mean(v, F.col(weight).cast("double")) if weight else Summarizer.mean(v)
    return df.groupBy(*keys).agg(vector_to_array(mean).alias(vec), F.count("*").alias("n"))


def mean_word_vectors(docs: DataFrame, vectors: DataFrame, id_col: str, dim: int, text: str = "text", max_broadcast: int = 200_000, zeros: bool = True) -> DataFrame:
    """Mean vector of a document's known words, counted as often as they stand; zeros without any, or null.

    ``vectors`` (token, vector) is broadcast only when it has ``max_broadcast`` rows at most.
    """
    words = docs.select(id_col, F.explode(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("w"))
    table = F.broadcast(vectors) if vectors.limit(max_broadcast + 1).count() <= max_broadcast else vectors
    mean = vector_mean(words.join(table, "token"), [id_col], "vector", "w").drop("n")
    out = docs.select(id_col).join(mean, id_col, "left").select(id_col, "vector")
    return out.withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), dim))) if zeros else out


def sanitize(col: Column, policy: str = "clip") -> Column:
    """Components that aren't finite: ``clip`` maps nan to 0 and infinities to +-1e6, ``zero`` all to 0. Null counts as nan."""
    inf = float("inf")

    def one(x: Column) -> Column:
        bad = F.when(x.isNull() | F.isnan(x), 0.0)
        if policy == "clip":
            return bad.when(x == inf, 1e6).when(x == -inf, -1e6).otherwise(x)
        return bad.when(F.abs(x) == inf, 0.0).otherwise(x)

    return F.transform(col.cast("array<double>"), one)


def layer_numbers(layers: list[int], total: int) -> list[int]:
    """1-based numbers, negatives from the end; repeats go, 0 and what is out of range is refused."""
    out: list[int] = []
    for x in layers:
        n = x if x > 0 else total + 1 + x
        if x == 0 or not 1 <= n <= total:
            raise ValueError(f"no layer {x} of {total}")
        if n not in out:
            out.append(n)
    return out


def view_label(layers: list[int]) -> str:
    """L7, L11-L15 for a stretch, else mean(L3,L5)."""
    if len(layers) == 1:
        return f"L{layers[0]}"
    if layers == list(range(layers[0], layers[-1] + 1)):
        return f"L{layers[0]}-L{layers[-1]}"
    return f"mean({','.join(f'L{x}' for x in layers)})"


def select_layers(emb: DataFrame, layers: list[int], total: int, layer: str = "layer") -> DataFrame:
    """Rows of the chosen layers with ``view_index``, the order in which they were named."""
    chosen = layer_numbers(layers, total)
    place = F.create_map(*[F.lit(v) for i, x in enumerate(chosen) for v in (x, i)])
    return emb.where(F.col(layer).isin(chosen)).withColumn("view_index", place[F.col(layer)])


def fisher_ratio(emb: DataFrame, keys: list[str], vec: str = "embedding", y: str = "y") -> DataFrame:
    """Squared distance of the class means over the summed mean variances (population), to 6 digits.

    0 unless both classes are there; infinite where the variance within is under 1e-10.
    """
    v = array_to_vector(F.col(vec).cast("array<double>"))
    s = emb.where(F.col(y).isin(0, 1)).groupBy(*keys, y).agg(Summarizer.metrics("mean", "variance").summary(v).alias("s"), F.count("*").alias("n"))
    s = s.select(*keys, y, "n", vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    s = s.withColumn("var", total(F.col("v")) / F.size("v") * (F.col("n") - 1) / F.col("n"))
    pick = lambda c, k: F.max(F.when(F.col(y) == k, F.col(c)))
    t = s.groupBy(*keys).agg(pick("m", 0).alias("m0"), pick("m", 1).alias("m1"), F.sum("var").alias("within"), F.count("*").alias("c"))
    between = total(F.zip_with("m1", "m0", lambda a, b: (a - b) * (a - b)))
    ratio = F.when(F.col("c") < 2, 0.0).when(F.col("within") < 1e-10, float("inf")).otherwise(between / F.col("within"))
    return t.select(*keys, F.round(ratio, 6).alias("fisher_ratio"))


def pool_chunks(chunks: DataFrame, keys: list[str], vec: str = "embedding", tokens: str = "n_tokens", chunk: str = "chunk", cap: int = 50) -> DataFrame:
    """Sum of token sums over sum of tokens, of a document's first ``cap`` chunks; a chunk has one token at least."""
    rows = chunks.where(F.col(chunk) < cap).withColumn("_w", F.greatest(F.col(tokens), F.lit(1)).cast("double"))
    rows = rows.withColumn(vec, F.transform(F.col(vec).cast("array<double>"), lambda x: x / F.col("_w")))
    return vector_mean(rows, keys, vec, "_w").drop("n")


def pool_layers(emb: DataFrame, keys: list[str], layers: list[int] | None = None, how: str = "mean", vec: str = "embedding", layer: str = "layer") -> DataFrame:
    """One vector per sample: the mean over layers, or the layers put end to end."""
    rows = emb if layers is None else emb.where(F.col(layer).isin(layers))
    if how == "mean":
        return vector_mean(rows, keys, vec).drop("n")
    parts = F.sort_array(F.collect_list(F.struct(layer, F.col(vec).cast("array<double>").alias("_v"))))
    return rows.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda p: p["_v"])).alias(vec))


def relative_depth(df: DataFrame, model: str = "model", layer: str = "layer") -> DataFrame:
    """``depth_pct``: layer as a share of the model's last."""
    top = df.groupBy(model).agg(F.max(layer).alias("_top"))
    return join_on(df, top, [model]).withColumn("depth_pct", div(F.col(layer) * 100, F.col("_top"))).drop("_top")


def encode(chunks: DataFrame, keys: list[str], window: str, encoder, batch: int = 256) -> DataFrame:
    """(keys, layer, embedding, n_tokens) from a user's encoder: list of token lists -> list of [layers][hidden] token sums.

    The encoder is given up to ``batch`` windows at a time.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                tokens = part.column(window).to_pylist()
                made = [np.asarray(x, np.float64) for x in encoder(tokens)]
                sizes = [len(x) for x in made]
                own = part.select(keys).take(pa.array(np.repeat(np.arange(len(made)), sizes)))
                layer = pa.array([k for n in sizes for k in range(n)], pa.int32())
                vectors = pa.array([v for x in made for v in x], pa.list_(pa.float64()))
                n_tokens = pa.array(np.repeat([len(t) for t in tokens], sizes), pa.int64())
                yield pa.RecordBatch.from_arrays([*own.columns, layer, vectors, n_tokens], names=[*keys, "layer", "embedding", "n_tokens"])

    return chunks.select(*keys, window).mapInArrow(run, f"{schema}, layer int, embedding array<double>, n_tokens long")


def hash_encoder(hidden: int = 8, layers: int = 2):
    """A test encoder: signs of token hashes, summed over the tokens. A token is hashed once for each call."""
    import zlib

    starts = [zlib.crc32(f"{k}:{h}:".encode()) for k in range(layers) for h in range(hidden)]

    def run(token_lists):
        number: dict[str, int] = {}
        rows = [np.array([number.setdefault(t, len(number)) for t in tokens], np.int64) for tokens in token_lists]
        signs = np.array([[1.0 if zlib.crc32(raw, s) & 1 else -1.0 for s in starts] for raw in (f"{t}".encode() for t in number)]).reshape(len(number), layers, hidden)
        return [signs[r].sum(0) for r in rows]

    return run
