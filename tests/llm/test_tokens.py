import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftgauge.llm.packing import WordIds, balance, cuts, differencing, digest, pack_documents
from driftgauge.llm.token_counts import Splitter, count_tokens, op7_token_counts

ODD = [
    None,
    "",
    " ",
    "  a  b\n\n c\t d \r\n",
    "it's DON'T we'll 'sq x'm",
    "a<|endoftext|> b <|endoftext|>",
    "naïve café x 　 日本語 テスト 123½²  \x85y\x1cz\x1f",
    "١٢٣ Ω ς Σ ΑΣ é ́x İ",
    "x" * 5000,
    "...,, ),( a,b, c.d. ,",
    "  lead \x0b\x0c trail  ",
    "😀😀 zwj 👩‍👩‍👧 ok",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "tok") for i, t in enumerate(ODD)] + [(3, ODD[3], "again"), (None, "no id", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_counts_equal_the_library(spark, sf, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1000))
    want = sorted((str(d), len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for d, t in docs.collect())
    got = sorted((str(r[0]), r[1], r[2]) for r in count_tokens(docs, path, block_chars=50_000).collect())
    assert got == want
    assert count_tokens(odd.limit(0), path).count() == 0
    assert op7_token_counts(spark, sf).where("over_limit <> (n_tokens > 512)").count() == 0


def test_splitter_is_the_pre_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    split, tok = Splitter(path), Tokenizer.from_file(path)
    for t in ODD[1:]:
        t = t.replace("<|endoftext|>", "")
        assert split(t) == [t[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(t)]


def check_packing(docs, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for d, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[d])) and r.length > 0
            assert zlib.crc32(ids[d][at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[d])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return sum(map(len, ids.values())) / (2048 * len(by_sequence))


def test_packing(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert check_packing(docs.collect(), digest(docs).collect()) > 0.97
    plain = odd.select("doc_id", "text", F.lit(1).alias("offset")).dropDuplicates(["doc_id"])
    check_packing([(d, t) for d, t, _ in plain.collect()], digest(plain).collect())
    assert digest(plain.limit(0)).count() == 0
    whole = pack_documents(plain, public_tokenizers.path("word_bpe_49k.json"))
    assert whole.where("octet_length(ids) <> 4 * length").count() == 0
    assert digest(odd).count() == digest(plain).count() + 1  # a repeated row is packed again


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 40):
        sizes = rng.integers(1, 256, n * 9)
        w = differencing(sizes, n)
        load = np.bincount(w, weights=sizes, minlength=n)
        assert len(w) == len(sizes) and load.sum() == sizes.sum()
        assert load.max() - load.min() <= 40
    for sizes in ([2048], [1, 1], [1500, 1500, 1500], list(rng.integers(1, 2048, 50))):
        w = balance(np.array(sizes), 2048)
        assert np.bincount(w, weights=sizes).max() <= 2048
    assert balance(np.array([4, 5, 6, 7, 8]), 16).max() == 1  # 30 in two windows of 16


def test_fast_words_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    words = WordIds(path, 1)
    assert words.word is not None
    vocab = sorted({t.removesuffix("</w>") for t in words.tok.get_vocab()})
    texts = [*[t for t in ODD if t], " ".join(vocab), " ".join(v.upper() for v in vocab), "ªº µß ÿ ñandú. Ünder, it's e.g.,"]
    want = [[*e.ids, 1] for e in words.tok.encode_batch(texts, add_special_tokens=False)]
    assert [list(np.frombuffer(x, "<u4")) for x in words(texts)] == want


def test_cuts():
    assert cuts(1, 8, 4) == [(0, 1)]
    assert cuts(16, 8, 4) == [(0, 8), (8, 8)]
    assert cuts(21, 8, 4) == [(0, 8), (8, 8), (16, 4), (20, 1)]
