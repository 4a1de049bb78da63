"""What a Python worker holds of a batch, and between tasks, is bounded; results don't change by it."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from driftgauge.llm import packing, toxicity
from driftgauge.llm.common import Remembered, slices


def test_slices_hold_every_row_once():
    texts = ["", None, "a" * 50, "é" * 300, *["b c"] * 100, None]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    got = list(slices([batch, batch.slice(0, 0), batch.slice(2, 3)], "text", 64))
    assert sum((b.column(0).to_pylist() for b in got), []) == [*range(len(texts)), 2, 3, 4]
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()[1:]) <= 64 for b in got)
    groups = pa.record_batch([pa.array([[1] * 5, None, [2] * 9, [], [3]])], names=["members"])
    assert pa.Table.from_batches(slices([groups], "members", 4)).column(0).to_pylist() == groups.column(0).to_pylist()
    assert len(list(slices([groups], "members", 4))) > 2


def test_remembered_is_bounded():
    r = Remembered(10)
    for k in range(1000):
        assert r.find(k) is None
        r.put(k, k)
        assert r.find(0) == 0, "a key in use stays"
        assert len(r) + len(r.older) <= 20


def test_words_of_a_worker_are_bounded(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"W{x:x}, zé{x % 97} {x}" for x in rng.integers(0, 1 << 40, 50)) for _ in range(60)]
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = packing.WordIds(path, 1)(texts)
    monkeypatch.setattr(packing, "CACHE", 400)
    words = packing.WordIds(path, 1)
    assert [words([t])[0] for t in texts] == whole
    assert len(words.known) + len(words.older) < 1500
    assert packing.WordIds(path, 1)(texts[:1]) == whole[:1]


def test_scorer_is_bounded_and_scores_alike():
    weights = np.zeros(1 << toxicity.BITS, np.float32)
    weights[list(toxicity.features("vile"))] = 3
    score, rng = toxicity.Scorer(weights, -8.0), np.random.default_rng(5)
    texts = [" ".join([f"w{x:x}" for x in rng.integers(0, 1 << 40, 2000)] + ["vile."] * (k % 2)) for k in range(300)]
    got = [score(t)[0] for t in texts]
    assert [toxicity.Scorer(weights, -8.0)(t)[0] for t in texts[::10]] == got[::10] and min(got[1::2]) > 0
    for held in (score.known, score.chunks):
        assert len(held) + len(held.older) <= 300_000
    assert toxicity.features.cache_info().currsize <= 1 << 15
