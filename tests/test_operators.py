import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgauge.functions import manifest as MF
from driftgauge.functions import text as T
from driftgauge.operators import behavior as B
from driftgauge.operators import features as X
from driftgauge.operators import metrics as M
from driftgauge.operators import models as L
from driftgauge.operators import prefix, splits
from driftgauge.sources import corpus as S


def roc_points(y, s):
    """Points by the public definition: distinct thresholds, drop where both second differences are 0."""
    order = sorted(set(s), reverse=True)
    tp = np.array([sum(1 for a, b in zip(y, s) if a == 1 and b >= t) for t in order])
    fp = np.array([sum(1 for a, b in zip(y, s) if a == 0 and b >= t) for t in order])
    keep = np.r_[True, (np.diff(fp, 2) != 0) | (np.diff(tp, 2) != 0), True] if len(tp) > 2 else np.ones(len(tp), bool)
    return [(math.inf, 0, 0), *[(t, a, b) for t, a, b, k in zip(order, tp, fp, keep) if k]]


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(1)
    rows = []
    for g in range(4):
        for i in range(120):
            y = rng.randint(0, 1)
            rows.append((g, f"s{g}-{i}", y, round(rng.random() * 0.6 + 0.3 * y, 2 if g % 2 else 1)))
    rows += [(9, "a", 1, 0.5), (9, "b", 1, 0.7), (8, "c", None, 0.1), (8, "d", 0, None), (8, "e", 0, float("nan"))]
    return rows, spark.createDataFrame(rows, "layer int, sample_id string, y int, score double")


@pytest.mark.parametrize("size", [1, 20, 100_000])
def test_roc_equals_definition(scored, size):
    rows, df = scored
    got = {}
    for r in M.roc_curve(df, ["layer"], rows=size).collect():
        got.setdefault(r.layer, []).append((r.threshold, r.tp, r.fp))
    for g in range(4):
        y, s = zip(*[(r[2], r[3]) for r in rows if r[0] == g])
        assert sorted(got[g], reverse=True) == roc_points(y, s)


def test_auroc_is_the_pairwise_share(scored):
    rows, df = scored
    got = {r.layer: r.auroc for r in M.auroc(df, ["layer"]).collect()}
    monotone = {r.layer: r.auroc for r in M.auroc(df.withColumn("score", F.exp("score")), ["layer"]).collect()}
    for g in range(4):
        pos = [r[3] for r in rows if r[0] == g and r[2] == 1]
        neg = [r[3] for r in rows if r[0] == g and r[2] == 0]
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
        assert got[g] == pytest.approx(want) == pytest.approx(monotone[g])
    assert got[9] is None  # one class


def test_thresholds(scored):
    rows, df = scored
    for r in M.quantile_threshold(df, ["layer"], 0.1).collect():
        if r.layer < 4:
            neg = [x[3] for x in rows if x[0] == r.layer and x[2] == 0]
            assert r.tau == pytest.approx(np.quantile(neg, 0.9)) and r.valid
            assert r.fpr == pytest.approx(np.mean([n >= r.tau for n in neg]))
        else:
            assert not r.valid and r.tau is None
    for r in M.quantile_threshold(df, ["layer"], 0.1, adjust=True).where("valid").collect():
        neg = [x[3] for x in rows if x[0] == r.layer and x[2] == 0]
        tau, sd = np.quantile(neg, 0.9), np.std(neg, ddof=1)
        tries = [tau + 0.001 * sd * k for k in (0, 1, 1.5, 2, 3, 5)]
        want = next((t for t in tries if np.mean([n >= t for n in neg]) <= 0.1), np.quantile(neg, 1 - 0.09))
        assert r.tau == pytest.approx(want)


def test_histogram_bins_equal_numpy(spark):
    values = [i / 50 for i in range(51)] + [-0.1, 1.1] + list(np.random.default_rng(0).random(500))
    df = spark.createDataFrame([(1, float(v)) for v in values], "k int, score double")
    got = [r["count"] for r in M.score_histogram(df, ["k"]).orderBy("bin").collect()]
    assert got == np.histogram(values, bins=50, range=(0, 1))[0].tolist()


def test_bootstrap(scored):
    _, df = scored
    taus = df.select("layer").distinct().withColumn("tau", F.lit(0.6))
    for r in M.bootstrap_ci(df, taus, ["layer"]).collect():
        assert r.lo - 1e-9 <= r.rate <= r.hi + 1e-9
    assert all(math.isnan(r.lo) for r in M.bootstrap_ci(df, taus, ["layer"], n=0).collect())


def test_ranges_do_not_change_ranks(spark):
    df = spark.range(500).selectExpr("id", "id % 3 as g")
    one = prefix.hash_rank(df, ["g"], splits.hash_order("id"), "id")
    many = prefix.hash_rank(df, ["g"], splits.hash_order("id"), "id", rows=1)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_split_sizes(spark):
    df = spark.range(103).selectExpr("id", "int(id % 10 = 0) as y")
    got = splits.stratified_split(df, {"train": 0.5, "val": 0.25, "test": 0.25}, "y", "id").groupBy("y", "split").count().collect()
    sizes = {(r.y, r.split): r["count"] for r in got}
    # 11 -> 5.5, 2.75, 2.75: both quarters take a left-over; 92 divides evenly
    assert [sizes[1, s] for s in ("train", "val", "test")] == [5, 3, 3]
    assert [sizes[0, s] for s in ("train", "val", "test")] == [46, 23, 23]
    tied = splits.stratified_split(df.where("y = 1").limit(5), {"a": 0.5, "b": 0.5}, "y", "id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in tied} == {"a": 2, "b": 3}  # the later part on ties


PY = {
    "hash": [(r"\b[0-9a-fA-F]{64}\b", "[HASH]"), (r"\b[0-9a-fA-F]{40}\b", "[HASH]"), (r"\b[0-9a-fA-F]{32}\b", "[HASH]")],
    "random": (r"\b(?=[A-Za-z0-9_-]{16,}\b)(?=.*[A-Za-z])(?=.*\d)[A-Za-z0-9_-]{16,}\b", "[RANDOM_ID]"),
}


def test_redaction_equals_python(spark):
    texts = [
        "x " + "a" * 32 + " y " + "B" * 40 + " z " + "0" * 64 + " w " + "f" * 50,
        "http://a.b/c?d=1 ftp://q.r`s 1.2.3.4:99 evil.example.com\nHKLM\\Run\\x C:\\Temp\\a.exe \\\\srv\\share cape/x/1",
        "token abcdefghijklmnop_123 and abcdefghijklmnopq\nno digits here abcdefghijklmnopqr 5",
        "größe naïve\r 1234567890abcdefgh x",
        "",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, text string")
    got = {r.id: r for r in df.select("id", T.redact_hashes(F.col("text")).alias("h"), T.redact_iocs(F.col("text")).alias("i"), T.redact_iocs(T.redact_iocs(F.col("text"))).alias("ii")).collect()}
    for i, t in enumerate(texts):
        want = t
        for p, r in PY["hash"]:
            want = re.sub(p, r, want)
        assert got[i].h == want
        assert got[i].i == got[i].ii
    assert got[5].h is None
    assert got[1].i.split() == ["[URL]", "[URL]`s", "[IP]", "[DOMAIN]", "[REGISTRY]", "[PATH]", "[PATH]", "[SANDBOX_PATH]"]
    assert got[2].i == re.sub(*PY["random"], texts[2])


def test_random_ids_equal_python_and_take_linear_time(spark):
    rng = random.Random(5)
    signs = ["a", "B", "-", "_", " ", "é", "\u0663", "\n", "1", "abcdefghijklmnop", "-abcdefghi-jklmn-", "1234567890123456", "\r", "😀"]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 12))) for _ in range(3000)] + ["", "\n\n", "1-abcdefghijklmnopqr", "é1-abcdefghijklmnopqr", "1234567890123456 a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.t for r in df.select("id", T._random_ids(F.col("text")).alias("t")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == re.sub(*PY["random"], t), t
    long = ["abcdefghijklmnopq " * 60_000, "abcdefghijklmnopq " * 60_000 + "1", "1234567890123456 " * 60_000]
    start = time.monotonic()
    out = [r.t for r in spark.createDataFrame(list(enumerate(long)), "id int, t string").select("id", T._random_ids(F.col("t")).alias("t")).orderBy("id").collect()]
    assert time.monotonic() - start < 20  # with a look ahead at each token: minutes
    assert out == [long[0], "[RANDOM_ID] " * 60_000 + "1", long[2]]


def test_sections(spark):
    rows = [(1, "pre\n## A B\nx\n\n### C\ny"), (2, "# one\nplain"), (3, "## A B\n\n## A B \nz"), (4, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {}
    for r in T.split_sections(df).collect():
        got.setdefault(r.id, []).append((r.pos, r.heading, r.block))
    assert sorted(got[1]) == [(0, "__preamble__", "pre\n"), (1, "A B", "## A B\nx\n\n"), (2, "C", "### C\ny")]
    assert got[2] == [(0, "__all__", "# one\nplain")]
    assert 4 not in got
    odd = ["", "##\n## B\nx", "##  \n## K \x1c\ny", "a\n## H  \n\n## K", "## \x0bS\u3000T\t\r\nz", "x ## no\n##no\n### $1 \\ \u2028 q\nb", "## é" + " y" * 50_000]
    want = [
        [("__all__", "")],
        [("## B", "##\n## B\nx")],
        [("## K", "##  \n## K \x1c\ny")],
        [("__preamble__", "a\n"), ("H", "## H  \n\n"), ("K", "## K")],
        [("S\u3000T", "## \x0bS\u3000T\t\r\nz")],
        [("__preamble__", "x ## no\n##no\n"), ("$1 \\ \u2028 q", "### $1 \\ \u2028 q\nb")],
        [(odd[6][3:], odd[6])],
    ]
    parts = spark.createDataFrame(list(enumerate(odd)), "id int, text string").select("id", T.sections(F.col("text")).alias("s")).orderBy("id").collect()
    assert [[(x.heading, x.block) for x in r.s] for r in parts] == want
    assert all([x.pos for x in r.s] == list(range(len(r.s))) for r in parts)
    masked = {r.id: r.text for r in T.mask_sections(df, ["A B"]).collect()}
    assert masked[1] == "pre\n## A B\n[MASKED_A_B]\n### C\ny"
    assert T.masking_variants(df).where("id = 1").count() == 18


def test_timestamps(spark):
    rows = ["1700000000", "1700000000123", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024/01/02 03:04", "2024-01-02", "20240102", "soon", "", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    got = {r.i: str(r.t) for r in df.select("i", MF.normalise_timestamp(F.col("raw")).alias("t")).collect()}
    assert got[0] == "2023-11-14 22:13:20" and got[1].startswith("2023-11-14 22:13:20.123")
    assert got[2] == "2024-01-02 03:04:05" and got[3] == "2024-01-02 01:04:05"
    assert got[4] == "2024-01-02 03:04:00" and got[5] == "2024-01-02 00:00:00"
    assert got[6] == "1970-08-23 06:15:02"  # digits are an epoch, not a date
    assert got[7] == got[8] == got[9] == "None"


def test_api_calls(spark):
    raw = [
        '{"behavior": {"processes": [{"calls": [{"api": "Open", "arguments": [{"name": "p", "value": "a"}, {"value": true}, 3], "return": 0}, {"arguments": []}, 7]}, {"calls": "x"}, 5]}}',
        '{"behavior": {"processes": [{"calls": [{"api": "R", "return": true}], "file_activities": {"read_files": ["f", ""]}}], "summary": {"regkey_opened": ["k"]}}, "network": {"dns": [{"request": "d"}, {}], "tcp": [{"dst": "1.1.1.1", "dport": 80}]}}',
        '{"entry_points": [{"apis": [{"api_name": "E", "args": ["1"], "ret_val": "2"}]}]}',
        "[1]",
        "{broken",
        '{"behavior": {"processes": []}}',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "sample_id int, raw string")
    p = B.parsed(df)
    calls = B.extract_api_calls(p).collect()
    assert [tuple(r) for r in calls] == [(0, 0, 0, "Open", ["a", "True", "3"], ""), (1, 0, 0, "R", [], "True")]
    out = {r.sample_id: r for r in B.to_entry_points(p).collect()}
    assert set(out) == {0, 1, 2}
    assert out[2].apis[0].api_name == "E" and out[0].file_access is None and out[0].network_events is None
    assert out[1].file_access[0].path == "f" and out[1].registry_access[0].event == "opened" and out[1].network_events.dns == ["d"]
    assert B.rejected(df).first()[0] == 2


def test_newton_finds_the_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 4))
    y = (x[:, 0] - x[:, 1] + rng.standard_normal(300) > 0).astype(int)
    w, b = L.newton_logreg(x, y, 1.0)
    s = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (1 - y).sum()))
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(w + x.T @ (s * (p - y))).max() < 1e-6 and abs((s * (p - y)).sum()) < 1e-6
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w1, b1 = L.newton_logreg(z, y, 1.0)
    df = spark.createDataFrame([(i, int(a), [float(v) for v in r]) for i, (a, r) in enumerate(zip(y, x))], "sample_id int, y int, features array<double>")
    got = np.array([r.score for r in L.fit_logreg(df).score(df).orderBy("sample_id").collect()])
    assert np.abs(got - 1 / (1 + np.exp(-(z @ w1 + b1)))).max() < 1e-3


def test_char_wb_and_windows(spark):
    df = spark.createDataFrame([(1, "Ab c"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: sorted(r.g) for r in df.select("id", X.grams(F.col("text"), "char_wb", (3, 5)).alias("g")).where("g is not null").collect()}
    assert got[1] == sorted([" ab", "ab ", " ab ", " c "]) and got[2] == []
    w = spark.createDataFrame([(1, list("abcdefghij")), (2, [])], "id int, w array<string>")
    rows = [(r.id, r.chunk, r.start, "".join(r.window)) for r in T.token_windows(w, "w", 4, 1).orderBy("id", "chunk").collect()]
    assert rows == [(1, 0, 0, "abcd"), (1, 1, 3, "defg"), (1, 2, 6, "ghij")]
    assert X.layer_numbers([-1, 2, 2, 4], 4) == [4, 2] and X.view_label([2, 3, 4]) == "L2-L4"
    with pytest.raises(ValueError):
        X.layer_numbers([0], 4)


def test_manifest_formats(spark, tmp_path):
    files = {
        "a.csv": "sha256;First_Seen\nx;2024-01-02\n", "b.csv": "sha256,first_seen\nx,2024-01-02\n", "c.tsv": "sha256\tfirst_seen\nx\t2024-01-02\n",
        "d.jsonl": '{"sha256": "x", "first_seen": "2024-01-02"}\n7\n', "e.json": '[{"sha256": "x", "first_seen": "2024-01-02"}, 3]', "f.json": '{"items": [{"sha256": "x", "first_seen": "2024-01-02"}]}',
        "g.json": '{"sha256": "x", "first_seen": "2024-01-02"}',
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
        rows = S.read_manifest(spark, str(tmp_path / name))
        got = rows.select(MF.coalesce_aliases(rows, MF.ID_KEYS).alias("i"), MF.normalise_timestamp(MF.coalesce_aliases(rows, MF.TIMESTAMP_KEYS)).alias("t")).collect()
        assert [(r.i, str(r.t)) for r in got] == [("x", "2024-01-02 00:00:00")], name


def test_reports_and_split_spec(spark, tmp_path):
    (tmp_path / "black").mkdir()
    (tmp_path / "black" / "AB.md").write_bytes(b"hello \xff")
    (tmp_path / "black" / "empty.md").write_bytes(b"")
    (tmp_path / "black" / "ab.label").write_text("0")
    r = S.read_reports(spark, str(tmp_path)).collect()
    assert [(x.sample_id, x.size_bytes) for x in r] == [("ab", 7)] and r[0].text.startswith("hello ")
    assert S.read_sidecars(spark, str(tmp_path)).first().sidecar == "0"
    spec = tmp_path / "spec.json"
    spec.write_text('{"docs": [{"path": "p", "label": 1}, {"path": "q", "label": 0}], "folds": [{"name": "f", "train_ids": [0], "test_ids": [1]}]}')
    docs, folds = S.read_split_spec(spark, str(spec))
    assert docs.count() == 2 and sorted((x.fold, x.split, x.doc_id) for x in folds.collect()) == [("f", "test", 1), ("f", "train", 0)]
    spec.write_text('{"docs": [{"path": "p", "label": 1}], "folds": {"g": {"train_indices": [0]}}}')
    assert [(x.fold, x.split, x.doc_id) for x in S.read_split_spec(spark, str(spec))[1].collect()] == [("g", "train", 0)]


def test_large_groups_are_fitted_too(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, n in ((1, 240), (None, 200), (3, 30)):
        x = rng.normal(size=(n, 3))
        y = (x[:, 0] + rng.normal(size=n) > 0).astype(int)
        rows += [(g, i, ("train", "train", "val", "test")[i % 4], int(y[i]), x[i].tolist()) for i in range(n)]
    rows += [(4, i, ("train", "val")[i % 2], 1, [0.0, 1.0, 2.0]) for i in range(80)]
    df = spark.createDataFrame(rows, "layer int, sample_id long, split string, y int, features array<double>")
    want = {(r.layer, r.sample_id): r for r in L.grouped_logreg(df, ["layer"]).collect()}
    out = L.grouped_logreg(df, ["layer"], max_train=50)
    got = {(r.layer, r.sample_id): r for r in out.collect()}
    assert out.columns == ["layer", "sample_id", "split", "y", "c", "score"] and got.keys() == want.keys()
    for k, r in got.items():
        assert (r.split, r.y) == (want[k].split, want[k].y)
        assert np.allclose(np.array([r.c, r.score], float), np.array([want[k].c, want[k].score], float), atol=0.01, equal_nan=True)
    scores = L.cv_scores(df.where("layer = 1"), ["layer"], k=2, max_train=50)
    assert scores.count() == 240


def test_text_baseline_over_sparse_vectors(spark):
    docs = [(i, i % 2, f"{'bad grub' if i % 2 else 'good day'} word{i % 7} and more w{i}") for i in range(60)] + [(60, 0, None), (61, 1, "")]
    df = spark.createDataFrame(docs, "sample_id long, y int, text string")
    train, test = df.where("sample_id % 3 > 0"), df.where("sample_id % 3 = 0")
    from driftgauge.operators import features as X

    weights = X.tfidf(train, df.select("sample_id", "text"), "sample_id")
    rows = {r.sample_id: r.features for r in L.text_features(weights, df.select("sample_id", "y"), "sample_id").collect()}
    assert len(rows) == 62 and rows[60].numNonzeros() == 0 and len({v.size for v in rows.values()}) == 1
    assert abs(rows[1].norm(2) - 1) < 1e-9
    got = {r.sample_id: r.score for r in L.text_baseline(train, test, "sample_id").collect()}
    assert all((got[i] > 0.5) == bool(y) for i, y, _ in docs if i in got and i < 60)
