import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgauge.llm import lm_scoring as LM

MASK = (1 << 64) - 1
HELD = "crc32(cast(doc_id as string)) % 5 = 1"


def tokens(text):
    """Words and an end (None), as the contract has them."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", low)] + [None]


def word_hash(word):
    """The polynomial hash of one word, byte after byte."""
    if word is None:
        return 0
    x = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(word)) & MASK
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor & MASK
    return x ^ (x >> 31)


class Plain:
    """The same model, one token at a time."""

    def __init__(self, lexicon, model, bits, counts):
        self.lexicon, self.model, self.bits, self.counts = lexicon, model, bits, counts
        self.units = dict(zip(lexicon.words.tolist(), lexicon.leaves.tolist()))

    def leaf(self, w):
        h = word_hash(w)
        h -= (h >> 63) << 64
        if h in self.units:
            return self.units[h]
        if w is None:
            return 0
        ending = w[-1] | (w[-2] << 8 if len(w) > 1 else 0)
        return int(self.lexicon.of_ending[ending]) * 64 + 63

    def code(self, w):
        leaf = self.leaf(w)
        return leaf if leaf % 64 < 63 else 4096 + (word_hash(w) >> 47) * 64 + leaf // 64

    def log_p(self, history, w):
        leaf = self.leaf(w)
        total = self.log_leaf(history, leaf)
        if w is not None and leaf % 64 == 63:
            total += math.log((self.counts[w] + 0.5) / self.lexicon.rest[leaf // 64])
        return total

    def log_leaf(self, history, leaf):
        past = [None, None, None, *history][-3:]
        slot = [self.code(x) for x in past]
        cls = [0 if len(history) < k else self.leaf(history[-k]) >> 6 for k in (1, 2, 3)]
        values = [slot[2] << 3 | 1, slot[1] << 3 | 2, (cls[0] << 6 | cls[1]) << 3 | 3, (cls[0] << 6 | cls[2]) << 3 | 4]
        total = 0.0
        for level in range(4):
            node, branch = leaf >> (12 - 3 * level), leaf >> (9 - 3 * level) & 7
            z = self.model[level][node].astype(float)
            salt = (node + 1 + 1000 * level) * 0xD6E8FEB86659FD93 & MASK
            for v in values if level < 2 else values[:2]:
                x = ((v * 0x9E3779B97F4A7C15 & MASK) ^ salt) * 0xC2B2AE3D27D4EB4F & MASK
                z = z + self.model[level][LM.NODES[level] + (x >> (64 - self.bits))]
            total += z[branch] - math.log(sum(math.exp(q) for q in z))
        return total

    def score(self, toks):
        return sum(self.log_p(toks[:i], w) for i, w in enumerate(toks)) / math.log(10)


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 1


def corpus():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 1 + int(400 * rng.random() ** 2)]) for _ in range(rng.randint(0, 80)))) for i in range(150)]
    return rows + [(500, None), (501, ""), (502, "A b\tB\x0bc\x0ca\rZ\nÉ\x1cü\x85x y "), (503, "ab " * 70_000), (504, "new0words only1here"), (None, "a b")]


def test_scores_equal_a_plain_version(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + rows[:3]], "doc_id long, text string, score int, leaf string").repartition(3)
    c = Counter(w for d, t in rows + rows[:3] if d is not None and not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    coded, lexicon = LM.coded_documents(df, F.expr(HELD), "doc_id", "text", 3_000)
    assert (lexicon.n, lexicon.v) == (n, v)
    bits = LM.row_bits(v, 1 << 17)
    model = LM.train(coded, lexicon, bits)
    assert any(np.abs(m[k:]).max() > 0 for m, k in zip(model, LM.NODES))
    plain = Plain(lexicon, model, bits, c)
    out = LM.score_documents(df, F.expr(HELD), block_tokens=3_000).collect()
    assert len(out) == len(rows) + 3
    text = dict(rows)
    for r in out:
        toks = tokens(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(toks), sum(c[w] > 0 for w in toks), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks))
    sent = spark.sparkContext.broadcast(model)
    scored = {r.doc_id: r.score for r in coded.mapInArrow(LM._score(sent, bits), "doc_id string, held boolean, n_tokens long, n_known long, base_score double, score double").collect()}
    for d, t in rows:
        if len(t or "") < 10_000:
            assert scored[None if d is None else str(d)] == pytest.approx(plain.score(tokens(t)), rel=1e-4), d


def test_probabilities_sum_to_one(spark):
    rows = corpus()[:150]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    coded, lexicon = LM.coded_documents(df, F.lit(False), "doc_id", "text", 10_000)
    bits = LM.row_bits(lexicon.v, 1 << 17)
    plain = Plain(lexicon, LM.train(coded, lexicon, bits), bits, Counter(w for _, t in rows for w in tokens(t)))
    some = tokens(rows[7][1])[:4]
    for history in ([], some[:1], some):
        total = sum(math.exp(plain.log_p(history, w)) for w in plain.counts)
        # all unseen words of a class together have half a count
        total += sum(math.exp(plain.log_leaf(history, k * 64 + 63)) * 0.5 / lexicon.rest[k] for k in range(1, 64))
        assert total == pytest.approx(1, abs=1e-3)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert LM.score_documents(df.limit(0), F.lit(False)).count() == 0
    untrained = LM.score_documents(df, F.lit(True)).collect()
    assert {r.train_tokens for r in untrained} == {0} and all(r.held_out and r.n_known == 0 and r.score <= 0 for r in untrained)


def test_gains_on_held_out(spark):
    out = LM.op8_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (out[0] - out[1]) / out[2] > 0.1
