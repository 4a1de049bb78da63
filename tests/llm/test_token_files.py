"""Simple-8b words, files of ids and their way back, against the tokenizers library."""

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftgauge.llm import simple8b, token_files
from driftgauge.llm.common import shared_dir, table
from driftgauge.llm.piece_ids import ByteLevelIds, PieceIds

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", " a", "a ", "a \n b", "\n\n a\n\n\nb", "<|endoftext|> x<|endoftext|>y", "don't we've  'll", "日本語 テキスト　x", "a▁b ▁", "é́ 𝔘 😀😀 x", "<s> <0x0A> </s>", "a\tb \t c\r\n", "x\x00y \x85z", "ﬁ ½ Ⅷ", "foo, bar. baz!!", "x" * 5000]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=600), st.sampled_from([3, 64, 1024]))
def test_words_round_trip(values, size):
    x = np.array(values, np.uint64)
    coded = simple8b.encode(x, size)
    assert simple8b.decode(coded).tolist() == values
    for k in range(len(coded.word_at) - 1):
        a, b = coded.word_at[k : k + 2]
        c, d = coded.escape_at[k : k + 2]
        one = simple8b.Coded(coded.words[a:b], coded.escaped[c:d], np.array([0, b - a]), np.array([0, d - c]))
        assert simple8b.decode(one).tolist() == values[k * size : (k + 1) * size]


def test_words_take_as_many_values_as_fit():
    assert len(simple8b.encode(np.zeros(240)).words) == 1
    assert len(simple8b.encode(np.full(60, 1)).words) == 1
    assert len(simple8b.encode(np.full(12, 31)).words) == 1
    assert len(simple8b.encode(np.array([2**63, 2**59, 2**59 - 1], np.uint64)).escaped) == 2


def test_ids_are_the_librarys():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    draw = np.random.default_rng(0)
    texts = ODD + ["".join(draw.choice(list(" \n\tab',1é日<|>▁."), draw.integers(0, 30))) for _ in range(2000)]
    for special in (True, False):
        lib = Tokenizer.from_file(PATH)
        lib.encode_special_tokens = not special
        assert [np.frombuffer(x, "<u4").tolist() for x in ByteLevelIds(PATH, special)(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    ours = PieceIds(public_tokenizers.path("piece_bpe_32k.model"))
    lib = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for text, got, ids in zip(texts, ours(texts), lib.encode(texts, num_threads=1), strict=True):
        ids = ids if text else []
        spelled = b"".join(ours.bytes[i] for i in ids) == (" " + text if text else "").encode()
        assert (None if got is None else np.frombuffer(got, "<u4").tolist()) == (ids if spelled else None)


def brute(rows):
    from tokenizers import Tokenizer

    lib, out, start = Tokenizer.from_file(PATH), [], 0
    for doc, text in rows:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_library(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect())
    assert len({d for d, _ in rows}) == len(rows)
    got = sorted(tuple(r) for r in token_files.op12_token_files(spark, sf).collect())
    assert got == brute(rows)


def test_files_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME", 500)
    rows = [(i, t, 0, 0) for i, t in enumerate(ODD)] + [(None, "no id", 1, 1), (99, None, 2, 2), (99, None, 2, 2), (99, "again", 3, 3), (98, "word " * 30_000, 4, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, _id long").repartition(5)
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    files = token_files.write_tokens(docs, folder, PATH)
    got = token_files.read_tokens(files, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, *range(len(ODD)), 98, 99, 99, 99]
    own = lambda r: (r.doc_id is not None, r.doc_id or 0)
    assert sorted((own(r), r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got) == sorted(((d is not None, d or 0), n, c) for d, _, n, c in brute([r[:2] for r in rows]))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    empty = token_files.write_tokens(docs.limit(0), f"{folder}-none", PATH)
    assert token_files.read_tokens(empty, f"{folder}-none").count() == 0


def test_stretches_read_only_their_blocks():
    ids = np.random.default_rng(1).integers(0, 50_000, 10_000).astype("<u4")
    sink = pa.BufferOutputStream()
    writer = token_files.Writer(sink)
    for k in range(0, 10_000, 700):
        writer.add(str(k), ids[k : k + 700])
        if k % 2100 == 0:
            writer.flush()
    writer.flush()
    sink.write(np.array(writer.frames, "<u8").tobytes() + np.array([len(writer.frames)], "<u8").tobytes() + token_files.MAGIC)
    file = token_files.TokenFile(pa.BufferReader(sink.getvalue()))
    for first, n in ((0, 1), (699, 3), (0, 10_000), (5000, 4000), (9999, 1)):
        assert file.stretch(first, n).tolist() == ids[first : first + n].tolist()
    with pytest.raises(IndexError):
        file.stretch(9999, 2)


def test_rows_of_one_id_fill_several_files(spark):
    docs = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = token_files.write_tokens(docs, folder, PATH)
        assert files.count() > 4 and files.agg(F.sum("n_docs")).first()[0] == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
