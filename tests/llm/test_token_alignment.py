"""Alignment of two tokenizers against a merge by sets of byte ends."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftgauge.llm import token_alignment
from driftgauge.llm.common import table
from driftgauge.llm.piece_ids import byte_letters

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 200)), st.sets(st.integers(0, 200)), st.integers(1, 40))
def test_merge_path_gives_equal_work(x, y, work):
    a, b = np.array(sorted(x), np.int64), np.array(sorted(y), np.int64)
    i, j = token_alignment.merge_path(a, b, work)
    assert (i[0], j[0], i[-1], j[-1]) == (0, 0, len(a), len(b))
    assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all() and (np.diff(i + j) <= work + 1).all()
    for k in range(len(i) - 1):
        own = set(a[i[k] : i[k + 1]]) | set(b[j[k] : j[k + 1]])
        later = set(a[i[k + 1] :]) | set(b[j[k + 1] :])
        assert not own & later and (not own or not later or max(own) < min(later))


def brute(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    lib, model = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    lib.encode_special_tokens = True
    byte = byte_letters()
    spelled_a = lambda i: bytes(byte[c] for c in lib.id_to_token(i))
    spelled_b = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for doc, text in rows:
        a = lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        if text and not b"".join(map(spelled_a, a)) == b"".join(map(spelled_b, b)) == (" " + text).encode():
            a, b = [], []
        ends_a = dict(zip(np.cumsum([len(spelled_a(i)) for i in a]).tolist(), range(len(a)), strict=True))
        ends_b = dict(zip(np.cumsum([len(spelled_b(i)) for i in b]).tolist(), range(len(b)), strict=True))
        common = sorted(set(ends_a) & set(ends_b))
        links = [(a[ends_a[e]], b[ends_b[e]]) for e in common]
        counts.update(links)
        groups, x, y = [], 0, 0
        for e in common:
            groups.append(",".join(map(str, a[x : ends_a[e] + 1])) + "|" + ",".join(map(str, b[y : ends_b[e] + 1])))
            x, y = ends_a[e] + 1, ends_b[e] + 1
        docs.append((doc, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    key = lambda r: (r[0] is not None, r)
    return sorted(((d, na, nb, len(s), len(s), sum(counts[p] == top[p[1]] for p in s), sum(counts[p] for p in s), h) for d, na, nb, s, h in docs), key=key)


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = token_alignment.op11_token_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_odd_rows_and_small_pieces(spark):
    texts = [None, "", " ", "a  b", "a▁b", "<|endoftext|> x <s>", "日本語 テキスト é́ 😀", "don't\n\nstop\t,.", "x" * 3000, "word and " * 2000, "same text", "same text", "tail "]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, "no id", 1, 2), (10, "same text", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a long, block long").repartition(3)
    got = token_alignment.align_tokenizers(docs, A, B, work=40, block_links=500).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0] is not None, r)) == brute([r[:2] for r in rows])
    assert token_alignment.align_tokenizers(docs.limit(0), A, B).count() == 0
