"""Registered queries against their SQL on rows that the given tables rarely hold."""

import math

import duckdb
import pytest

import __spark_entry__ as E


@pytest.fixture
def equal(spark, tmp_path):
    """Writes a table and compares the query with its SQL over it."""

    def check(name, table, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        want = con.execute(E.oracle_sql()[name]).fetchall()
        got = [tuple(r) for r in E.queries()[name](spark, str(tmp_path)).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        return got

    return check


def test_pages_without_a_known_word(equal):
    urls = ["https://example.org/es.html", "https://www.example.org/en/1", "", "///", None]
    got = dict(equal("j9_mean_word_vectors", "pages", list(enumerate(urls)), "page_id long, url string"))
    assert got[0] == "" and got[1] != ""


@pytest.mark.parametrize("name", ["t1_redact_hashes", "t2_redact_strong_ids", "t3_redact_iocs", "t4_ablation_conditions"])
def test_ids_beside_letters_beyond_ascii(equal, name):
    texts = ["osado laesmentementeción 7 x", "ñlaesmentementeci7 x", "der schachtzheitenachlichä a1 b", "é" + "0a" * 16 + "é " + "0b" * 32 + "ü", "é" + "0c" * 25 + "ß 1", "éhttp://a.b/cü d 10.0.0.1ñ evil.topé", "abcdefghijklmnop ٣ q", "--abcdefghijklmno-1-- z", None, ""]
    equal(name, "documents", [(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_encoder_reads_a_text_once(spark, tmp_path):
    """Conditions that leave a text as it is share its windows, and neither counts of groups nor samples of rows encode again."""
    from pyspark.sql import functions as F

    from driftgauge.operators import features as X
    from driftgauge.plans import jobs as J

    seen, inner = spark.sparkContext.accumulator(0), X.hash_encoder(2, 2)

    def encoder(token_lists):
        seen.add(len(token_lists))
        return inner(token_lists)

    rows = [(i, i % 2, f"{'bad' if i % 3 else 'good'} word{i % 5}" + (f" {'0' * 40}" if i < 10 else "")) for i in range(40)]
    reports = spark.createDataFrame(rows, "sample_id long, y int, text string")
    split = reports.select("sample_id", F.element_at(F.array(F.lit("train"), F.lit("train"), F.lit("val"), F.lit("test")), (F.floor(F.col("sample_id") / 2) % 4 + 1).cast("int")).alias("split"))
    assert J.identifier_ablation_layers(reports, split, encoder).count() == 6
    assert seen.value == 50


def test_hash_encoder_is_sums_of_signs():
    import zlib

    from driftgauge.operators import features as X

    got = X.hash_encoder(3, 2)([["a", "b", "a"], ["é"], []])
    for tokens, own in zip([["a", "b", "a"], ["é"], []], got, strict=True):
        assert own.tolist() == [[sum(1.0 if zlib.crc32(f"{k}:{h}:{t}".encode()) & 1 else -1.0 for t in tokens) for h in range(3)] for k in range(2)]


@pytest.mark.parametrize("analyzer", ["word", "char_wb"])
def test_tfidf_counts_within_rows(spark, analyzer):
    """Grams of a document are shuffled once, and counts of an id with two rows are added up."""
    from driftgauge.operators import features as X

    long = "x" * 150
    docs = [(1, f"aa bb aa é {long}"), (2, "bb cc"), (3, f"dd aa {long}"), (4, None), (5, "")]
    split = docs[:3] + [(6, "aa"), (6, "bb aa")]
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    how = {"analyzer": "char_wb", "ngram": (2, 4)} if analyzer == "char_wb" else {}
    out = lambda rows: X.tfidf(frame(rows), frame(rows), "id", **how)
    got = out(docs)
    assert "hashpartitioning(id" in (plan := got._jdf.queryExecution().executedPlan().toString()) and not any("gram" in x.split(")")[0] for x in plan.split("hashpartitioning(id")[1:])
    whole = {(r.id, r.gram): r.tfidf for r in out(docs[:3] + [(6, "aa bb aa")]).collect()}
    two = {(r.id, r.gram): r.tfidf for r in out(split).collect()}
    idf = {g: math.log(5 / (1 + len({i for i, x in whole if x == g}))) + 1 for _, g in whole}
    counts = {(r.id, r.gram): r.tf for r in X.gram_counts(frame(docs[:3] + [(6, "aa bb aa")]), "id", **how).collect()}
    for i in {i for i, _ in counts}:
        norm = math.sqrt(sum((n * idf[g]) ** 2 for (j, g), n in counts.items() if j == i))
        for (j, g), n in counts.items():
            if j == i:
                assert whole[j, g] == pytest.approx(n * idf[g] / norm)
    if analyzer == "char_wb":  # n documents are rows
        assert set(two) == set(whole)
    else:
        assert two.keys() == whole.keys() and two[6, "aa"] > two[6, "bb"]


def test_masking_report_sums_sections(spark):
    """No text is shuffled, and sums over sections are counts of the variants' texts."""
    from driftgauge.functions import text as T
    from driftgauge.plans import jobs as J

    h = "0a" * 16
    texts = [
        f"pre {h}\n## Network Activity\nGET http://a.example/x\r  10.0.0.7:80\n\n## Executed Commands  \nC:\\Temp\\a.exe {h}",
        f"## Summary Statistics\n## Network Activity {h}\nx\n### DNS Requests\nevil.top\x85HKLM\\Soft\\Run\n## Network Activity\n漢字 é_1",
        f"no heading HKLM\\A\n{h}", "## Process Tree", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "sample_id long, text string").coalesce(1)
    out = J.masking_report(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = T.count_indicators(T.token_deltas(T.masking_variants(df), ["sample_id"])).select(*out.columns)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert out.where("md5 > 0 and url > 0").count() > 0


def test_json_reports_share_folders(spark, sf, tmp_path, monkeypatch):
    """A file for each conversation, and a folder for about a hundred of them, not for each."""
    from driftgauge.plans import job_queries as Q

    monkeypatch.setattr(Q, "scratch", lambda spark: f"{tmp_path}/reports")
    n = E.queries()["s2_read_json_reports"](spark, sf).count()
    assert n > 0 and len(list(tmp_path.glob("reports/folder=*/*.txt"))) == n
    assert len(list(tmp_path.glob("reports/folder=*"))) < n


def test_trees_are_grown_by_tasks_of_bounded_size(spark):
    """Files of few bytes hold many rows: tasks follow the rows, not the files."""
    from pyspark.sql import functions as F

    from driftgauge.operators import models as L

    rows = L._dealt(spark.range(20_000).select(F.col("id").alias("sample_id")).coalesce(1)).rdd.glom().map(lambda x: [r[0] for r in x]).collect()
    assert len(rows) == 4 and max(map(len, rows)) < 6_000 and all(r == sorted(r) for r in rows)
