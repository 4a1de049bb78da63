"""License scans: patience decides, against a plain recursive patience."""

import random

from driftgauge.llm import license_scan as L


def plain_patience(a, b, a0=0, b0=0):
    """The same alignment by its definition."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(a0, b0), *plain_patience(a[1:], b[1:], a0 + 1, b0 + 1)]
    if a[-1] == b[-1]:
        return [*plain_patience(a[:-1], b[:-1], a0, b0), (a0 + len(a) - 1, b0 + len(b) - 1)]
    anchors = L.rising([(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == b.count(w) == 1])
    if not anchors:
        return [(a0 + i, b0 + j) for i, j in L.common(a, b)] if len(a) <= L.GAP and len(b) <= L.GAP else []
    (i, j), out = anchors[0], []
    out = plain_patience(a[:i], b[:j], a0, b0)
    for (i, j), (x, y) in zip(anchors, [*anchors[1:], (len(a), len(b))], strict=True):
        out += [(a0 + i, b0 + j), *plain_patience(a[i + 1 : x], b[j + 1 : y], a0 + i + 1, b0 + j + 1)]
    return out


def test_rising_is_the_longest():
    rng = random.Random(2)
    for _ in range(100):
        pairs = list(enumerate(rng.sample(range(40), rng.randrange(15))))
        best = [1] * len(pairs)
        for k in range(len(pairs)):
            best[k] = 1 + max((best[m] for m in range(k) if pairs[m][1] < pairs[k][1]), default=0)
        got = L.rising(pairs)
        assert len(got) == max(best, default=0) and all(p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_patience_equals_its_definition():
    rng = random.Random(3)
    for size in (8, 40, 150):
        for _ in range(150):
            a, b = [[f"w{rng.randrange(size)}" for _ in range(rng.randrange(120))] for _ in "ab"]
            assert L.patience(a, b) == plain_patience(a, b)


def test_common_is_the_longest():
    rng = random.Random(4)
    for _ in range(100):
        a, b = [[rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in "ab"]
        got = L.common(a, b)
        assert all(a[i] == b[j] for i, j in got) and len(got) == L.lcs_ends(a, L.masks_of(b), len(b))[0]


def test_patience_decides(monkeypatch):
    text = "Some code. " + L.TEMPLATES["isc"] + " More. Released under the MIT License."
    assert [x[0] for x in L.Scanner(L.TEMPLATES, 0.8)(text)] == ["isc", "mit"]
    monkeypatch.setattr(L, "patience", lambda a, b: [])
    assert L.Scanner(L.TEMPLATES, 0.8)(text) == []


def test_templates_of_one_name_are_apart(spark, monkeypatch):
    df = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "one two three four five")], "doc_id long, text string")
    rows = [("x", "alpha beta gamma delta epsilon"), ("x", "one two three four five"), ("y", "one two three four six"), (None, "one"), ("z", None)]
    templates = spark.createDataFrame(rows, "name string, text string")
    want = [(1, "x", 1.0), (2, "x", 1.0), (2, "y", 0.8)]
    assert sorted((r.doc_id, r.license, r.coverage) for r in L.scan_licenses(df, templates).collect()) == want
    monkeypatch.setattr(L, "MOST_TEMPLATES", 1)
    assert sorted((r.doc_id, r.license, r.coverage) for r in L.scan_licenses(df, templates).collect()) == want
    assert L.scan_licenses(df, templates.limit(0)).count() == 0


def test_index_finds_what_trying_all_templates_finds():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(200)]
    templates = [(f"t{k}", " ".join(rng.choices(vocabulary[: rng.choice([10, 200])], k=rng.randrange(1, 60)))) for k in range(300)]
    scan, each = L.Scanner(templates, 0.8), [L.Scanner([t], 0.8) for t in templates]
    for _ in range(40):
        own = L.words(rng.choice(templates)[1])
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        text = " ".join(rng.choices(vocabulary, k=30) + own + rng.choices(vocabulary, k=30))
        assert sorted(map(str, scan(text))) == sorted(str(x) for s in each for x in s(text))


def test_long_text_and_wide_notices():
    grant = L.TEMPLATES["mit-grant"].split()
    spaced = " ".join(f"{w} / # filler" if k % 2 else w for k, w in enumerate(grant))
    text = "word " * 50_000 + spaced + " word" * 50_000 + " " + " ".join(grant)
    got = {x[0]: x for x in L.Scanner(L.TEMPLATES, 0.8)(text)}["mit-grant"]
    assert got[1] == 1.0 and len(got[3]) == 2
    assert all(b["end"] <= a["begin"] for b, a in zip(got[3], got[3][1:], strict=False))
