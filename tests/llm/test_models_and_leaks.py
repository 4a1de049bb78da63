import math
import random

import numpy as np
import pytest

from driftgauge.llm import decontamination as D
from driftgauge.llm import toxicity as T
from driftgauge.llm.neighbours import Index, op9_nearest_neighbours


def edit_search(p, t):
    """Least edit distance of p to any part of t."""
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, x in enumerate(p):
            new.append(min(row[i + 1] + 1, new[i] + 1, row[i] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    items = [" ".join(word() for _ in range(rng.randint(6, 20))) for _ in range(12)] + ["Ab", "", None, "   "]
    docs = []
    for i in range(60):
        body = [word() for _ in range(40)]
        t = items[i % 12]
        for _ in range(rng.choice([0, 0, 2, 4, 9])):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", "x", "yz"]) + t[k + 1 :]
        docs.append(" ".join(body[:20]) + ("\n\t" if i % 2 else " ") + t.upper() + " " + " ".join(body[20:]))
    rows = [*enumerate(docs), (100, None), (101, ""), (102, "z " * 30_000), (None, docs[0])]
    b = spark.createDataFrame([*enumerate(items), (50, items[0])], "item_id long, text string")
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, item string")
    want = set()
    for d, t in rows:
        for i, x in enumerate(items):
            if x and x.strip() and t and len(t) < 10_000 and edit_search(D.plain(x), D.plain(t)) <= int(0.06 * len(D.plain(x))):
                want.add((d, i))
    got = D.find_leaks(df, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    text = {d: t for d, t in rows if d is not None}
    for r in got:
        if r.doc_id is not None:
            assert edit_search(D.plain(items[r.item_id]), D.plain(text[r.doc_id][r.begin : r.end])) == r.distance
    few = D.find_leaks(df, b, block_chars=200)
    assert {(r.doc_id, r.item_id) for r in few.collect()} == want
    kept = {r.doc_id for r in D.without_leaks(df, b).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}
    assert D.find_leaks(df, b.limit(0)).count() == 0 and D.find_leaks(df.limit(0), b).count() == 0


def test_leaks_in_any_white_space(spark):
    blanks = [chr(i) for i in range(0x110000) if chr(i).isspace()]
    item = "Nine Grey foxes, İ and é, crossed the frozen river at dawn"
    rows = []
    for k, w in enumerate(blanks):
        rows.append((k, f"{w}{w}so it is {w} told:{w}" + item.replace(" ", w + w) + f"{w}and more{w}"))
    rows.append((200, "nothing" + "".join(blanks) + "here"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(1, "\x1c" + item + "\x0b"), (2, item.lower())], "item_id long, text string")
    got = {r.doc_id: r for r in D.find_leaks(df, b).collect()}
    assert set(got) == set(range(len(blanks)))
    for k, t in rows[:-1]:
        r = got[k]
        assert r.item_id == 1 and r.distance == 0 and D.plain(t[r.begin : r.end]) == D.plain(item)
    for _, t in rows:
        assert len(D.places(t)) == len(D.plain(t)) and all(D.plain(t[i]) in ("", D.plain(t)[j][:1]) or t[i] == "İ" for j, i in enumerate(D.places(t)))
    assert {r.doc_id for r in D.without_leaks(df, b).collect()} == {200}


def test_leaks_of_one_item_many_times():
    item = "a short sentence that is said again and again"
    find = D.Finder([("x", item)], 0.06)
    text = "\x0c".join([item] * 10_000)
    found = find(text)
    assert len(found) == 10_000 and all(text[a:b] == item and d == 0 for _, a, b, d in found)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = T.op4_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    pos, neg = rows[rows.toxic == 1].score.to_numpy(), rows[rows.toxic == 0].score.to_numpy()
    auc = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
    assert auc > 0.75 and (neg >= 0.7).mean() < 0.03


def test_toxicity_of_texts_that_lower_longer():
    weights = np.zeros(1 << T.BITS, np.float32)
    for word, w in (("mild", 2.0), ("grub", 12.0), ("plain", 2.0), ("some", 2.0), ("other", 2.0), ("more", 2.0)):
        weights[T.features(word)[0]] = w
    score = T.Scorer(weights, -8.0)
    clean = "İstanbul is mild. It is plain. Take some. The other one. Have more."
    for text in (clean, clean + " You grub! İ."):
        p, found = score(text)
        same, places = score(text.replace("İ", "I"))
        assert abs(p - same) < 1e-9 and [x[:2] for x in found] == [x[:2] for x in places]
    assert score(clean)[0] < 0.1 and [text[a:b].strip() for a, b, _ in found] == ["You grub!"]


def test_toxicity_locates_and_edges(spark):
    good, bad = "The day was fine. We went on.", "The day was fine. You are a vile grub. We went on."
    docs = [(i, bad if i % 3 == 0 else good + f" Number {i}.") for i in range(150)] + [(200, None), (201, ""), (None, bad)]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, toxicity int, p int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(150)] + [(0, None, 0), (1, 7, 0)], "doc_id long, toxic int, quality int")
    model = T.train(T.training_rows(df, labels))
    out = {r.doc_id: r for r in T.score_toxicity(df, model).collect()}
    assert out[0].toxicity > 0.9 and out[1].toxicity < 0.1 and out[200].toxicity == 0 and out[201].toxicity == 0
    assert [bad[s.begin : s.end].strip() for s in out[0].offending] == ["You are a vile grub."]
    assert T.score_toxicity(df.limit(0), model).count() == 0
    nothing = T.train(T.training_rows(df, labels.limit(0)))
    assert T.score_toxicity(df, nothing).where("toxicity > 0").count() == 0


def test_toxicity_scores_equal_a_plain_version(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcé", k=rng.randint(1, 6))) for _ in range(60)]
    weights = np.zeros(1 << T.BITS, np.float32)
    for w in vocabulary[:20]:
        weights[T.features(w)[-1]] = rng.choice([-1.5, 0.75, 6.5, 9.25])
    docs = [(i, "".join(rng.choice([" ", " ", ". ", "! ", "\n", "?? "]) + rng.choice([str.upper, str, str.title])(rng.choice(vocabulary)) for _ in range(rng.randint(0, 40)))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "İ. " + vocabulary[0] + ".\n\n"), (103, (vocabulary[1] + ". ") * 20_000)]

    def plain(text):
        clean, sentence = 1.0, ""
        for c, follows in zip(text, [*text[1:], ""]):
            sentence += c
            if c in ".!?\n" and (follows == "" or follows not in ".!?\n") or follows == "":
                own, word = set(), ""
                for x in sentence.lower() + " ":
                    if x.isalnum() or x == "_":
                        word += x
                    else:
                        own |= {word} if word else set()
                        word = ""
                z = sum(float(sum(weights[k] for k in T.features(w))) for w in own)
                if z:
                    clean *= 1 - 1 / (1 + math.exp(8 - z))
                sentence = ""
        return 1 - clean

    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in T.score_toxicity(df, (weights, -8.0)).collect()}
    want = {d: plain((t or "").replace("İ", "i")) for d, t in docs}
    assert max(got.values()) > 0.5 and got == {d: pytest.approx(p, abs=1e-6) for d, p in want.items()}


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    w = rng.standard_normal(6) * 0.3
    y, ends = np.array([1.0, 0.0]), [np.array([2, 3]), np.array([1, 4])]
    feats = [np.array([0, 1, 2]), np.array([3, 4, 5, 0])]

    def loss(w):
        total = 0.0
        for yy, e, f in zip(y, ends, feats):
            z = [w[f[a:b]].sum() - 1.0 for a, b in zip([0, *e[:-1]], e)]
            clean = np.prod([1 - 1 / (1 + np.exp(-v)) for v in z])
            total -= np.log(1 - clean) if yy else np.log(clean)
        return total

    g = T.gradient(y, ends, feats, w, -1.0)
    for k in range(6):
        e = np.eye(6)[k] * 1e-6
        assert g[k] == pytest.approx((loss(w + e) - loss(w - e)) / 2e-6, abs=1e-5)


def test_neighbours_recall_and_contract(spark):
    d = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    x, ids = np.array(e.embedding.tolist(), np.float64), e.vec_id.to_numpy()
    got = op9_nearest_neighbours(spark, d).toPandas()
    hit = total = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, 21)) and q % 20 == 0
        s = x @ x[ids == q][0]
        assert np.allclose(part.score, [s[ids == v][0] for v in part.vec_id], atol=1e-12)
        assert list(zip(-part.score, part.vec_id)) == sorted(zip(-part.score, part.vec_id))
        order = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        hit, total = hit + len(set(order) & set(part.vec_id)), total + 20
    assert hit / total >= 0.9


def brute_recall(rows, k=20):
    """Recall of result rows (query_id, vec_id) against vectors {id: vector}."""
    def of(vectors, got):
        ids = np.array(sorted(vectors))
        x = np.array([vectors[i] for i in ids])
        hit = total = 0
        for q, found in got.items():
            s = x @ vectors[q]
            best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:k]
            hit, total = hit + len(set(best) & found), total + len(best)
        return hit / total

    return of(*rows)


def test_neighbours_recall_on_ten_thousand_and_a_giant(spark):
    """Five vectors near each of the given ones, and one of a thousand times their length."""
    rng = np.random.default_rng(3)
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x = np.array(e.embedding.tolist(), np.float64)
    x = np.repeat(x, 5, axis=0) + 0.05 * rng.standard_normal((5 * len(x), x.shape[1]))
    x[1] = x[1] * 1000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in Index(df).search(df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(got) == len(x) // 50 and brute_recall((dict(enumerate(x)), got)) >= 0.95


def test_neighbours_edges(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(3, [1.0, 0.0])] + [(100, [0.0, 2.0]), (101, None), (102, [0.0, 0.0]), (103, [float("nan"), 1.0]), (104, [1.0, None]), (105, [1.0]), (None, [1.0, 1.0]), (106, [-1.0, 0.5])]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, node string, q int")
    out = Index(df).search(df.where("vec_id in (0, 100, 101)")).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by[0] == list(range(1, 21)) and by[100][:2] == [106, 0] and 101 not in by
    new = spark.createDataFrame([(900, [0.5, 2.0])], "vec_id long, embedding array<double>")
    assert Index(df).search(new, k=2).orderBy("rank").first().vec_id == 100
    assert Index(df.limit(0)).search(df.limit(0)).count() == 0
