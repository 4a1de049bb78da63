import random

import numpy as np
from pyspark.sql import functions as F

from driftgauge.llm import near_dedup as nd
from driftgauge.llm.components import components


def sets(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def classes(rows):
    """Brute force over all pairs."""
    rows = [(i, d, sets(t)) for i, (d, t) in enumerate(rows)]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, _, a in rows:
        for j, _, b in rows[:i]:
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                up[find(i)] = find(j)
    low = {}
    for i, d, _ in rows:
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted((str(d), str(low.get(find(i)) if a else d)) for i, d, a in rows)


def test_classes_equal_brute_force(spark, sf, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.choice([6, 30, 80, 300]))) for _ in range(12)]
    docs = []
    for t in base:
        for _ in range(8):
            w = t.split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append(" ".join(w))
    docs += [None, "", "  ", "a", "a", "a b", " ".join(["x"] * 3000), " ".join(["x"] * 2999), "a b c d e"]
    rows = [(i, t) for i, t in enumerate(docs)] + [(None, docs[0]), (None, "alone"), (5, docs[5]), (5, docs[5])]
    rows += [(r.doc_id + 10_000, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame([(*r, "z", "y") for r in rows], "doc_id long, text string, node string, class_id string")
    want = classes(rows)
    assert sorted((str(a), str(b)) for a, b in nd.near_duplicate_classes(df).collect()) == want
    monkeypatch.setattr(nd, "BLOCK", 3)  # large buckets are dealt into blocks
    assert sorted((str(a), str(b)) for a, b in nd.near_duplicate_classes(df).collect()) == want
    assert nd.near_duplicate_classes(df.limit(0)).count() == 0


def test_repeated_blocks_keep_their_links(spark):
    rows = []
    for i in range(20):
        block, tail = " ".join(f"b{i}_{k}" for k in range(20)), " ".join(f"t{i}_{k}" for k in range(80))
        rows += [(2 * i, f"{block} {block} {tail}"), (2 * i + 1, f"{block} " * 1000 + tail)]
    got = dict(nd.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {d: d - d % 2 for d, _ in rows}


def test_weighted_links_are_of_the_measure_that_is_hashed(spark):
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(1, 30))
        a, b = rng.integers(0, 4, n).astype(float), rng.integers(0, 4, n).astype(float)
        a[0] = b[0] = 1
        items = np.arange(n, dtype=np.uint64)
        true = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(n) if a[i] and b[i])
        assert abs(nd.probability_jaccard((items[a > 0], a[a > 0]), (items[b > 0], b[b > 0])) - true) < 1e-9
    words = [f"w{k}" for k in range(204)]
    near = [*words[:190], "x", *words[191:]]
    rows = [(1, " ".join(words)), (2, " ".join(words[:50] * 200 + words)), (3, " ".join(near))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(nd.near_duplicate_classes(df).collect()) == {1: 1, 2: 1, 3: 1}
    assert dict(nd.near_duplicate_classes(df, weighted=True).collect()) == {1: 1, 2: 2, 3: 1}


def test_one_row_of_each_class_stays(spark):
    text = " ".join(f"w{k}" for k in range(60))
    near = text.replace("w7 ", "q ")
    rows = [(1, text, "a"), (1, text, "a"), (1, near, "b"), (2, text, "c"), (3, "other words that are all on their own here", "d"), (None, text, "e"), (None, "no id but words of its own in here", "f"), (4, None, "g"), (4, None, "g"), (5, " ", "h"), (6, "x y", "i"), (7, "x y", "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t1 string")
    got = nd.one_of_each_class(df)
    assert got.columns == df.columns
    out = sorted((str(r.doc_id), str(r.text)) for r in got.collect())
    first = [x for x in out if x[0] == "1"]
    assert len(first) == 1 and first[0][1] in (text, near)
    assert [x for x in out if x[0] != "1"] == sorted([("3", rows[4][1]), ("None", rows[6][1]), ("4", "None"), ("5", " "), ("6", "x y")])
    assert nd.one_of_each_class(df.limit(0)).count() == 0


def test_a_large_bucket_of_two_classes(spark, monkeypatch):
    """Blocks of a bucket meet only through nodes outside its largest component."""
    monkeypatch.setattr(nd, "BLOCK", 4)
    rng = random.Random(8)
    rows, common = [], [f"c{k}" for k in range(60)]
    for i in range(60):
        own = list(common)
        # a chain: neighbours are near, ends are not
        for k in range(i // 4):
            own[k * 3] = f"v{k}"
        own[59] = f"e{i % 4}"
        rows.append((i, " ".join(own)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(a), str(b)) for a, b in nd.near_duplicate_classes(df).collect()) == classes(rows)


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(30):
        items = nd.mix(rng.integers(0, 1 << 62, 300).astype(np.uint64))
        a, b = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 300).astype(float)
        a[:40], b[-40:] = 0, 0
        x, y = (nd.probminhash(items[w > 0], w[w > 0], 512) for w in (a, b))
        true = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(300) if a[i] and b[i])
        errors.append((x == y).mean() - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_components(spark):
    rng = random.Random(5)
    n = 300
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    up = {x: x for e in links for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
