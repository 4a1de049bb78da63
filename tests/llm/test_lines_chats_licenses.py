import random
import re

import duckdb

from driftgauge.llm import line_dedup
from driftgauge.llm.chat_format import ORACLE as CHAT_SQL
from driftgauge.llm.chat_format import render_chats
from driftgauge.llm.license_scan import TEMPLATES, Scanner, patience, rising, scan_licenses, words
from driftgauge.llm.line_dedup import ORACLE, ORACLE_WORDS, dedup_lines, op1_line_dedup_words

P = "The first sentence of a passage has some words. The second one goes on for a while. A third ends it all here now."


def brute(rows):
    """Runs as the docstring tells it, by lists of lines."""
    import re

    def parts(t):
        return [x for x in re.split(r"(?<=\n)|(?<=[.!?] )", t)]

    docs = []
    for d, t in rows:
        ps, lines = parts(t), []
        for i, x in enumerate(ps):
            b = x.strip(" \t\r\n")
            if b and (not lines or lines[-1][1] != b):
                lines.append([i, b, b.count(" ") + 1])
        docs.append((d, ps, lines))
    seen, out = set(), {}
    spans = []
    for d, ps, ls in docs:
        for p in range(len(ls)):
            for n in (3, 9, 27):
                if p + n <= len(ls) and sum(x[2] for x in ls[p : p + n]) >= 15:
                    spans.append((d, p, n, tuple(x[1] for x in ls[p : p + n])))
            if ls[p][2] >= 25:
                spans.append((d, p, 1, (ls[p][1],)))
    gone = {}
    for d, p, n, c in sorted(spans, key=lambda s: s[:2]):
        if c in seen:
            gone.setdefault(d, set()).update(range(p, p + n))
        seen.add(c)
    for d, ps, ls in docs:
        cut = set()
        for p in gone.get(d, ()):
            end = ls[p + 1][0] if p + 1 < len(ls) else len(ps)
            cut |= set(range(ls[p][0], end))
        out[d] = "".join(x for i, x in enumerate(ps) if i not in cut)
    return out


def test_line_dedup_equals_brute_force(spark, sf):
    rows = [
        (1, f"Alone here. {P} Tail one."), (2, f"Other words stand before it. {P} Another tail."), (3, P), (4, "x. y. z."), (5, "x. y. z."),
        (6, "Say it. " * 40), (7, "Say it. Now go on. Do come back soon. " * 30), (8, "w " * 30 + "end"), (9, "w " * 30 + "end"), (10, ""), (11, "\n\n \n"), (12, f"{P}\n\n{P}"), (13, "a\x1eb. " + P), (14, "long. " * 3000),
    ]
    verse, steps = "".join(f"Go {i}!\n" for i in range(30)), "".join(f"w{i}\n" for i in range(60))
    uneven = "one two three four five six seven eight nine ten eleven twelve\n" + "".join(f"x{i} y{i}\n" for i in range(12))
    rows += [(20, f"Before.\n{verse}"), (21, f"Other.\n{verse}More then."), (22, f"{steps}Tail"), (23, f"Head\n{steps}"), (24, uneven), (25, f"Lead.\n{uneven}Close."), (26, "Go 1!\nGo 2!\nGo 3!\nGo 4!"), (27, " ".join(f"v{i}!" for i in range(51))), (28, "Odd. " + " ".join(f"v{i}!" for i in range(51)))]
    rows += [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, _id string")
    got = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    want = brute(rows)
    assert {d for d in got if got[d] != want[d]} == set()
    assert P not in got[2] and P in got[1] and got[4] == got[5]
    assert got[21] == "Other.\nMore then." and got[23] == "Head\n" and got[25] == "Lead.\nClose." and got[26] != "" and got[28] == "Odd. "
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    # the SQL marks cuts with a character that text 13 holds
    assert {r[0]: r[1] for r in con.execute(ORACLE).fetchall() if r[0] != 13} == {d: t for d, t in want.items() if d != 13}


def test_line_dedup_finds_runs_of_short_lines(spark):
    verse = "".join(f"Go {i}!\n" for i in range(20))
    rows = [(1, f"Before it.\n{verse}"), (2, f"Other.\n{verse}Then more."), (3, "Go 1!\nGo 2!\nGo 3!\n"), (4, "w " * 13 + "a.\n" + "v " * 13 + "b."), (5, "w " * 13 + "a.\n" + "v " * 13 + "b."), (6, "Say it. Now go on. Do come back soon. " * 30), (7, P), (8, P)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(df, run_words=25).collect()}
    assert got == dict(rows) | {2: "Other.\nThen more.", 5: "", 6: got[6], 8: ""} and len(got[6]) < 100
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert {r[0]: r[1] for r in con.execute(ORACLE_WORDS).fetchall()} == got


def test_line_dedup_words_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert {tuple(r) for r in op1_line_dedup_words(spark, d).collect()} == set(con.execute(ORACLE_WORDS).fetchall())


def test_line_dedup_makes_fingerprints_and_windows_once(spark, sf, monkeypatch):
    plans, stored = [], line_dedup.stored

    def noted(df, *names):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, *names)

    monkeypatch.setattr(line_dedup, "stored", noted)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for words in (None, 25):
        plans.clear()
        dedup_lines(docs, run_words=words)
        made = [re.sub(r"#\d+L?|_\d+", "", x).strip(" +-:") for p in plans for x in p.splitlines() if "Generate " in x]
        assert made and len(made) == len(set(made))


def test_line_dedup_of_shared_stretches_equals_brute_force(spark):
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choices("abcdefgh", k=n)) + "\n"
    # line lengths about the bounds of 15 and 25 words, and of windows of 3, 9 and 27 lines
    kinds = [[1], [1, 2], [1, 1, 1, 6], [4, 5, 6], [1, 14, 15], [2, 24, 25, 26], [1, 1, 1, 1, 25], list(range(1, 30))]
    pool = [[line(rng.choice(k)) for _ in range(rng.choice([1, 2, 3, 4, 9, 10, 26, 27, 28, 60]))] for k in kinds for _ in range(12)]
    rows = []
    for i in range(300):
        text = []
        for _ in range(rng.randint(0, 4)):
            part = rng.choice(pool)
            a = rng.randrange(len(part))
            text += part[a : rng.randint(a, len(part))] + [line(rng.randint(1, 4)) for _ in range(rng.randint(0, 2))]
        rows.append((i, "".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert {d: (t, got[d]) for d, t in brute(rows).items() if t != got[d]} == {} and got != dict(rows)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    words = {r.doc_id: r.text for r in dedup_lines(df, run_words=25).collect()}
    assert {r[0]: r[1] for r in con.execute(ORACLE_WORDS).fetchall()} == words and words != got


def test_line_dedup_words_compares_spans_as_numbers(spark):
    # array_distinct compares structs each with all before it
    lines = spark.sql("SELECT array(9, 20, 3) AS wc")
    codes = line_dedup._with_sums(lines, 25).select(line_dedup._run_spans(25).alias("c"))
    assert codes.schema["c"].dataType.simpleString() == "array<bigint>"
    assert {(c >> 32, c & 255) for c in codes.first().c if c is not None} == {(0, 2), (0, 3)}


def test_line_dedup_edge_rows(spark):
    rows = [(1, P), (1, P), (None, P), (None, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as runs_deleted", "2 as k1")
    got = sorted(((r.doc_id, r.text, r.k1) for r in dedup_lines(df).collect()), key=str)
    assert got == sorted([(None, P, 2), (None, None, 2), (1, "", 2), (1, "", 2), (2, None, 2)], key=str)
    assert dedup_lines(df.limit(0)).count() == 0


def test_chats(spark):
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 0, "user", "z"), (5, 0, "user", "z"),
        (6, None, None, None), (6, 0, "user", "q"), (6, 0, "user", "q"), (7, 3, "user", "a"), (7, 9, "assistant", "b"), (7, 11, "user", "d"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv: (r.n_turns, r.rendered) for r in render_chats(df.selectExpr("*", "1 as n", "2 as size")).collect()}
    assert set(got) == {3, 4, 6, 7}
    assert got[6] == (2, "<|unknown|>\n<|end|>\n<|user|>\nq<|end|>\n")
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    assert {r[0]: r[1:] for r in con.execute(CHAT_SQL).fetchall()} == got
    assert render_chats(df.limit(0)).count() == 0
    assert "documents" in ORACLE


def test_patience():
    assert rising([(0, 3), (1, 1), (2, 2), (3, 0), (4, 4)]) == [(1, 1), (2, 2), (4, 4)]
    a, b = "x a b c y d e z".split(), "a b q c d d e".split()
    got = patience(a, b)
    assert all(a[i] == b[j] for i, j in got) and got == sorted(got) and len({j for _, j in got}) == len(got)
    assert len(got) == 5
    assert patience(list("abcabc"), list("abcabc")) == [(i, i) for i in range(6)]
    assert patience([], ["a"]) == [] and patience(["a"] * 3000, ["a"] * 3000)[-1] == (2999, 2999)


def test_licenses_that_stand_twice(spark):
    grant, plain = TEMPLATES["mit-grant"], "Plain words stand here and there. "
    texts = [plain + grant + ". " + plain, plain + grant + ". " + plain + grant + ". " + plain, f"{grant}. " * 5, (plain * 300 + grant + ". ") * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(df).collect() if r.license == "mit-grant"}
    assert [(got[d].coverage, len(got[d].places)) for d in range(4)] == [(1.0, 1), (1.0, 2), (1.0, 5), (1.0, 2)]
    for d, t in enumerate(texts):
        assert all(words(t)[p.begin : p.end] == words(grant) for p in got[d].places)


def test_real_licenses_are_held():
    scan = Scanner(TEMPLATES, 0.8)
    for name in ("mit-full", "bsd-2-clause", "bsd-3-clause", "isc", "mpl-2.0-notice", "lgpl-3.0-notice", "agpl-3.0-notice", "cc-by-4.0"):
        assert (name, 1.0) in {x[:2] for x in scan(f"Copyright (c) someone.\n{TEMPLATES[name]}\nMore.")}


def test_licenses(spark):
    rows = [(1, "Code.\nReleased under the MIT license, friend."), (2, "Licensed under the Apache\nLicense,  Version 2.0!"), (3, "license"), (4, None), (5, ""), (6, "the " * 20_000), (None, "Licensed under CC BY-NC 4.0."), (1, "Released under the MIT License.")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, coverage double")
    got = sorted(((r.doc_id, r.license, r.coverage) for r in scan_licenses(df).collect()), key=str)
    assert got == sorted([(1, "mit", 1.0), (1, "mit", 1.0), (2, "apache-2.0", 1.0), (None, "cc-by-nc-4.0", 1.0)], key=str)
    assert words("The GNU-GPL, v3.0.") == ["the", "gnu-gpl", "v3.0"]
    assert scan_licenses(df.limit(0)).count() == 0
    assert scan_licenses(df, {"t": "  "}).count() == 0


def test_license_coverage_equals_brute_force(spark):
    import random

    rng = random.Random(6)
    vocabulary = [f"word{k}" for k in range(30)]
    templates = spark.createDataFrame([("a", " ".join(rng.choices(vocabulary, k=40))), ("b", " ".join(rng.choices(vocabulary, k=25))), ("none", None)], "name string, text string")
    known = {r["name"]: words(r.text) for r in templates.collect() if r.text}
    docs = []
    for i in range(60):
        t = list(known["ab"[i % 2]])
        for _ in range(rng.choice([0, 2, 5, 9])):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], ["other"], [rng.choice(vocabulary), t[k]]])
        docs.append((i, " ".join(["before"] * rng.randint(0, 5) + t + ["after"] * rng.randint(0, 5))))

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for w in x:
            new = [0]
            for j, v in enumerate(y):
                new.append(row[j] + 1 if w == v else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    want = {(d, n): lcs(words(t), w) for d, t in docs for n, w in known.items()}
    want = {k: v for k, v in want.items() if v >= 0.8 * len(known[k[1]])}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.license): r.n_words for r in scan_licenses(df, templates).collect()} == want


def test_license_words_that_lie_scattered():
    scan = Scanner(TEMPLATES, 0.8)
    far = "Released " + "x " * 3000 + "under " + "y " * 3000 + "the " + "z " * 2000 + "MIT license"
    assert [x[0] for x in scan(far)] == [] and [x[0] for x in scan("so. Released under the MIT License. ok")] == ["mit"]
