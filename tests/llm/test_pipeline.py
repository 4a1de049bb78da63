"""The pipeline against a brute-force version, stage by stage on each stage's own input."""

from test_lines_chats_licenses import brute
from test_models_and_leaks import edit_search
from test_near_dedup import classes
from test_tokens import check_packing

import corpus_pipeline as P
from driftgauge.llm import decontamination as D
from driftgauge.llm.toxicity import Scorer, fitted


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"] and P.ORACLE_SQL is None
    stage = dict(P.STAGES)

    def step(name, df):
        out = P.stored(stage[name](spark, df, sf), name)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        return out

    score = Scorer(*fitted(spark, docs, sf))
    clean = step("toxicity", docs)
    assert texts(clean) == {d: t for d, t in texts(docs).items() if score(t or "")[0] < 0.7}

    lines = step("line_dedup", clean)
    assert texts(lines) == brute(sorted(texts(clean).items()))
    assert lines.where("n_chars <> length(text)").count() <= clean.where("n_chars <> length(text)").count()

    near = step("near_dedup", lines)
    rows = sorted(texts(lines).items())
    # of equal texts without a word the first stays
    blank = {t: d for d, t in reversed(rows) if not (t or "").split()}
    assert set(texts(near)) == {int(d) for d, c in classes(rows) if d == c and ((t := dict(rows)[int(d)]) not in blank or blank[t] == int(d))}

    items = [D.plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    free = step("decontamination", near)
    gone = set(texts(near)) - set(texts(free))
    for d, t in texts(near).items():
        low = D.plain(t)
        exact = any(i in low for i in items)
        assert not exact or d in gone
        if d in gone and not exact:
            assert any(edit_search(i, low) <= int(0.06 * len(i)) for i in items)

    check_packing(list(texts(free).items()), step("packing", free).collect())


def test_run_keeps_odd_rows(spark, sf):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a text without an id", "en", "s", 3), (3, "x " * 20_000, "en", "s", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    out = odd
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, out, sf)
    assert {r.doc_id for r in out.collect()} == {1, 2, 3, None}
    empty = odd.limit(0)
    for name, stage in P.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_columns_of_any_name_stay(spark, sf):
    names = ["toxicity", "Offending", "lines_deleted", "runs_deleted", "k1", "k2", "_row", "t1", "t2", "_toxicity_0", "id", "comp", "_cuts"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    for n, c in enumerate(names):
        docs = docs.withColumn(c, (docs.doc_id * 100 + n).cast("string" if n % 2 else "double"))
    out = docs
    for _, stage in P.STAGES[:-1]:
        out = P.stored(stage(spark, out, sf))
        assert out.dtypes == docs.dtypes
    rows = out.collect()
    assert rows and all(float(r[c]) == r.doc_id * 100 + n for r in rows for n, c in enumerate(names))
    assert P.packing(spark, out, sf).count() >= len(rows)
