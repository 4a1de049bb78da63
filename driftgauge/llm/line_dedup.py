"""Line dedup: winnowed line hashes find repeated runs, later ones are deleted.

Words are counted as blanks plus one. A *line* is a physical line, cut further behind each ``". "``, ``"! "`` and ``"? "``
so that a passage inside a paragraph is seen too. Lines are compared without outer
white space. A piece without a word, or equal to the line before it, belongs to that
line and shares its fate, so a word said a hundred times in a row is one line.

A run is any number of lines that a *window* covers: one line of ``long_words``, or 3, 9 or
27 neighbours that hold ``min_words`` words together. Any passage of over 50 words holds
one, be it a paragraph, or a list, verse or code in lines of a word or two. A window whose
whole content stands already at an earlier place, by (doc_id, place), is deleted. Earlier
places may be in the same document and may overlap the run, so a passage repeated over and
over leaves one copy. Nothing shorter is ever deleted.

1. Winnowing: of the two pairs of neighbours in each such three lines the pair with the
   smaller hash is the fingerprint, so equal runs share a fingerprint at the same place
   (the guarantee of winnowing), while a line is in few of them. Each long line, and each
   window of 9 or 27 that isn't all of shorter ones, is a fingerprint of its own; the first
   long line of three stands for them too, in place of a pair.
2. Fingerprints are joined by content; the places (document, line) of those that occur
   more than once go back to their documents.
3. Extension: from each such place the match is extended to the windows around it, to the
   left and to the right of a pair, and to the next ones as long as these have repeated
   fingerprints too. Content hashes (two, of independent line hashes) tell each window's
   first place, so the union of later ones is the whole of each maximal repeated run.
4. Those whose content has an earlier place merge into runs and are cut out.

With ``run_words`` windows are of 1 or 3 lines, and a run is also any number of lines that
hold so many words together (op1_line_dedup_words). Then winnowing
is over all threes, and two neighbours that hold ``run_words`` are a fingerprint too: equal
runs hold equal threes, or are two lines or one. The shortest such spans, from each
line forwards and backwards, join the threes and long lines in step 3.

Texts are read twice and moved once, to be cut; lines are moved only as hashes, and
never per pair of places, so a passage of n copies makes n rows. Lines, fingerprints and
windows are made once and stored until the runs are known; they are deleted before texts move.

Nulls: a null text stays null with no lines. Rows alike in id and text are one
document and get the same result each. A null id orders before all others; documents
that share an id are in the order in which Spark reads them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, doc_key, stored, table

CUT = "\x1e"
ENDS = ("\n", ". ", "! ", "? ")
BLANK = " \t\r\n"


def pieces(text: Column) -> Column:
    """The lines of a text; joined they are the text again."""
    marked = reduce(lambda t, e: F.replace(t, F.lit(e), F.lit(e + CUT)), ENDS, text)
    exact = F.split(text, "(?<=\\n)|(?<=[.!?] )", -1)
    return F.when(F.contains(text, F.lit(CUT)), exact).otherwise(F.split(marked, CUT, -1))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once for use inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lines(text: Column) -> Column:
    """struct<l: array<struct<pos, h1, h2, wc>>, n>: piece indexes, hashes and words of the lines, and the pieces' number."""

    def line(bare: Column, i: Column) -> Column:
        words = F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(" "), F.lit(""))) + 1
        return F.struct(i.alias("pos"), F.xxhash64(bare).alias("h1"), F.hash(bare).alias("h2"), F.when(bare == "", 0).otherwise(words).alias("wc"))

    def fresh(u: Column) -> Column:
        return F.filter(u, lambda x, i: (i == 0) | (x["h1"] != F.get(u, i - 1)["h1"]))

    def whole(parts: Column) -> Column:
        bare = F.transform(parts, lambda x: F.btrim(x, F.lit(BLANK)))  # once, as lambdas repeat what they hold
        worded = F.filter(F.transform(bare, line), lambda u: u["wc"] > 0)
        return F.struct(_let(worded, fresh).alias("l"), F.size(parts).alias("n"))

    return _let(pieces(text), whole)


def _words_of_three(i: Column) -> Column:
    """Words of three lines from i on; null near the end."""
    return F.get("wc", i) + F.get("wc", i + 1) + F.get("wc", i + 2)


def _two(i: Column) -> Column:
    return F.xxhash64(F.get("h1", i), F.get("h1", i + 1))


def _threes(x: str, step: int, of) -> Column:
    """What ``of`` makes of three neighbours of a column at a distance of ``step``; also at the end, where some are null."""
    return F.transform(x, lambda v, i: of(v, F.get(x, i + step), F.get(x, i + 2 * step)))


def _sum(a: Column, b: Column, c: Column) -> Column:
    return a + b + c


def _shifted(x: str, k: int, kind: str) -> Column:
    """x[i + k] at i, null outside."""
    moved = F.slice(x, k + 1, F.size(x)) if k >= 0 else F.concat(F.array_repeat(F.lit(None).cast(kind), -k), x)
    return F.coalesce(moved, F.array().cast(f"array<{kind}>")).alias(f"{x}_{k}")


def _choice(i: Column, min_words: int) -> Column:
    """The pair that winnowing takes of three lines from i on; null where they hold too few words."""
    return F.when(_words_of_three(i) >= min_words, F.when(_two(i) <= _two(i + 1), i).otherwise(i + 1))


def _fingerprints(base: DataFrame, min_words: int, long_words: int) -> DataFrame:
    """(d, p, h, m): pairs of lines chosen by winnowing, and whole windows of 1, 9 and 27 lines at p; m holds the bits of the ``COVERED``
    windows that each stands for: three lines to the left and right of a pair, or with a long line as their first such one; and a window itself.

    What reaches over many lines is made of arrays by threes, the rest is decided line by line: lambdas are interpreted, rows compiled.
    """
    short = F.array_min("t3") < min_words  # where every three lines hold enough, longer windows add nothing
    a = base.select("d", "h1", "wc").withColumn("t3", _threes("wc", 1, _sum))
    a = a.withColumns({"t9": F.when(short, _threes("t3", 3, _sum)), "low3": F.when(short, _threes("t3", 1, F.least)), "h3": F.when(short, _threes("h1", 1, F.xxhash64))})
    a = a.withColumns({"h9": _threes("h3", 3, F.xxhash64), "low": _threes("t9", 1, F.least)}).withColumn("low9", _threes("low", 3, F.least))
    beside = {("wc", "int"): range(-2, 3), ("h1", "long"): range(-1, 3), ("t9", "int"): (0, 9, 18), ("h9", "long"): (0, 9, 18), ("low3", "int"): (0, 3, 4), ("low9", "int"): (0, 9, 10)}
    rows = a.select("d", F.posexplode(F.arrays_zip(*[_shifted(x, k, kind) for (x, kind), ks in beside.items() for k in ks])).alias("p", "x"))
    at = lambda x, k: F.col("x")[f"{x}_{k}"]
    bit = lambda which, b: F.when(which, b).otherwise(0)

    long = lambda k: at("wc", k) >= long_words
    enough = lambda k: _sum(*[at("wc", k + j) for j in range(3)]) >= min_words
    plain = lambda k: enough(k) & (F.greatest(*[at("wc", k + j) for j in range(3)]) < long_words)
    two = lambda k: F.xxhash64(at("h1", k), at("h1", k + 1))
    pair = bit(plain(0) & (two(0) <= two(1)), 1) + bit(plain(-1) & (two(-1) > two(0)), 2)
    alone = 8 + bit(enough(0), 1) + bit(enough(-1) & ~long(-1), 2) + bit(enough(-2) & ~long(-2) & ~long(-1), 4)
    one = F.when(long(0), F.struct(F.xxhash64(F.lit(13), at("h1", 0)).alias("h"), alone.alias("m"))).when(pair > 0, F.struct(two(0).alias("h"), pair.alias("m")))
    # whole windows, if any shorter ones in them hold too few words
    fewer = lambda low, *ks: F.least(*[at(low, k) for k in ks]) < min_words
    nine = F.when((at("t9", 0) >= min_words) & fewer("low3", 0, 3, 4), F.struct(at("h9", 0).alias("h"), F.lit(16).alias("m")))
    enough_many = _sum(at("t9", 0), at("t9", 9), at("t9", 18)) >= min_words
    many = F.when(enough_many & fewer("low9", 0, 9, 10), F.struct(F.xxhash64(at("h9", 0), at("h9", 9), at("h9", 18)).alias("h"), F.lit(32).alias("m")))
    return rows.select("d", "p", F.explode(F.array(one, nine, many)).alias("f")).where("f is not null").select("d", "p", "f.h", "f.m")


#: The bits of a fingerprint: where, from its place on, the windows begin that it stands for, and their lines.
COVERED = {1: (0, 3), 2: (-1, 3), 4: (-2, 3), 8: (0, 1), 16: (0, 9), 32: (0, 27)}


def _covered() -> Column:
    """struct<p, n> of a window that a fingerprint (p, m) stands for, one for each row; null for the other bits."""
    window = lambda by, n: F.struct((F.col("p") + by).alias("p"), F.lit(n).alias("n"))
    return F.explode(F.array(*[F.when(F.col("m").bitwiseAND(b) > 0, window(by, n)) for b, (by, n) in COVERED.items()]))


def _span(p: Column, n: Column) -> Column:
    """struct<a, b, w1, w2>: the pieces of n lines from p on, and two hashes of their content."""
    return F.struct(
        F.get("pos", p).alias("a"),
        (F.coalesce(F.get("pos", p + n), F.col("n")) - 1).alias("b"),
        F.xxhash64(F.slice("h1", p + 1, n)).alias("w1"),
        F.xxhash64(F.lit(7), F.slice("h2", p + 1, n)).alias("w2"),
    )


def _selected(long_words: int, run_words: int) -> Column:
    """Fingerprints for runs of ``run_words``: three lines of few words can be part of a run, and a run can be two lines or one."""
    places = F.concat(F.transform("wc", lambda _x, i: _choice(i, 0)), F.transform("wc", lambda x, i: F.when(x + F.get("wc", i + 1) >= run_words, i)))
    places = F.array_distinct(F.filter(places, lambda p: p.isNotNull()))
    alone = F.filter(F.transform("wc", lambda x, i: F.when(x >= min(long_words, run_words), F.xxhash64(F.lit(13), F.get("h1", i)))), lambda h: h.isNotNull())
    return F.concat(F.transform(places, _two), alone)


def _code(p: Column, n: Column) -> Column:
    """(p, n) in one number: array_distinct compares numbers by hash, but each struct with all before it."""
    return F.shiftleft(p.cast("long"), 32) + n


def _steps(run_words: int) -> list[int]:
    return [1 << b for b in reversed(range(run_words.bit_length()))]


def _with_sums(df: DataFrame, run_words: int) -> DataFrame:
    """The words of 1, 2, 4, ... lines from each on, as columns sum1, sum2, ...; null near the end."""
    df = df.withColumn("sum1", F.col("wc"))
    for k in _steps(run_words)[-2::-1]:
        df = df.withColumn(f"sum{k}", F.transform(f"sum{k // 2}", lambda v, i: v + F.get(f"sum{k // 2}", i + k // 2)))
    return df


def _run_spans(run_words: int) -> Column:
    """Codes of the shortest spans of ``run_words`` words that begin or end at each line."""

    def reach(i: Column, way: int) -> Column:
        """struct<m, t>: how many lines hold fewer words at the most, and these words, by halving steps."""

        def further(s: Column, k: int) -> Column:
            first = i + s["m"] if way > 0 else i - s["m"] - (k - 1)
            return _let(s["t"] + F.get(f"sum{k}", first), lambda t: F.when(t < run_words, F.struct((s["m"] + k).alias("m"), t.alias("t"))).otherwise(s))

        none = F.struct(F.lit(0).alias("m"), F.lit(0).alias("t"))
        return reduce(lambda state, k: _let(state, lambda s: further(s, k)), _steps(run_words), none)

    def ahead(_x: Column, i: Column) -> Column:
        return _let(reach(i, 1)["m"], lambda m: F.when(i + m < F.size("wc"), _code(i, m + 1)))

    def behind(_x: Column, i: Column) -> Column:
        # a span that has enough words without its last line isn't a forward span
        return _let(reach(i, -1), lambda s: F.when((s["m"] > 0) & (i >= s["m"]) & (s["t"] - F.get("wc", i) + F.get("wc", i - s["m"]) >= run_words), _code(i - s["m"], s["m"] + 1)))

    return F.concat(F.transform("wc", ahead), F.transform("wc", behind))


def _spans(min_words: int, long_words: int, run_words: int) -> Column:
    """Every three lines with ``min_words`` words, every line with ``long_words`` and the spans of ``run_words``."""
    three = F.transform("wc", lambda _x, i: F.when(_words_of_three(i) >= min_words, _code(i, F.lit(3))))
    alone = F.transform("wc", lambda x, i: F.when(x >= long_words, _code(i, F.lit(1))))
    found = F.filter(F.array_distinct(F.concat(three, alone, _run_spans(run_words))), lambda c: c.isNotNull())
    found = F.transform(found, lambda c: F.struct(F.shiftright(c, 32).cast("int").alias("p"), c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("n")))
    return F.transform(found, lambda s: _span(s["p"], s["n"]))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 15, long_words: int = 25, run_words: int | None = None) -> DataFrame:
    """(k1, k2, a, b): the pieces a..b of each run to delete."""
    base = docs.select(*doc_key(id_col, text_col), F.col(id_col).alias("_id"), _lines(F.col(text_col)).alias("u"))
    base = stored(base.select(F.monotonically_increasing_id().alias("d"), "k1", "k2", "_id", *[F.col(f"u.l.{c}").alias(c) for c in ("pos", "h1", "h2", "wc")], "u.n"), "lines")

    # rows alike in id and text stand for one document, the first of them
    one = base.groupBy("k1", "k2").agg(F.min("d").alias("d")).select("d")
    if run_words is None:
        chosen = _fingerprints(base, min_words, long_words)
    else:
        chosen = base.select("d", F.explode(_selected(long_words, run_words)).alias("h"))
    chosen = stored(chosen, "fingerprints")  # both sides of the join need them
    twice = chosen.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    again = chosen.join(twice, "h")
    near = base.drop("k1", "k2").join(one, "d")
    if run_words is None:
        places = again.select("d", _covered().alias("w")).where("w is not null").groupBy("d").agg(F.collect_list("w").alias("places"))
        windows = F.transform("places", lambda w: _span(w["p"], w["n"]))
    else:
        places = again.select("d").distinct()
        near = _with_sums(near, run_words)
        windows = _spans(min_words, long_words, run_words)
    spans = stored(near.join(places, "d").select("d", "_id", F.inline(windows)), "spans")  # here too
    discard(chosen)
    where = F.struct("_id", "d", "a")
    first = spans.groupBy("w1", "w2").agg(F.min(where).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    later = spans.join(first, ["w1", "w2"]).where(where > F.col("first")).select("d", "a", "b")

    order = Window.partitionBy("d").orderBy("a", "b")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce((F.col("a") > F.max("b").over(before) + 1).cast("int"), F.lit(1))
    runs = later.withColumn("new", fresh).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("d", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    out = stored(runs.join(base.select("d", "k1", "k2"), "d").select("k1", "k2", "a", "b"), "runs")
    discard(spans)
    discard(base)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 15, long_words: int = 25, run_words: int | None = None) -> DataFrame:
    """``docs`` with repeated runs cut out of the text.

    Every row and column stays; added are ``lines_deleted`` (pieces cut)
    and ``runs_deleted`` (ranges ``a``..``b`` of ``pieces`` of the old text). Columns
    of ``docs`` with these names are replaced.
    """
    docs = docs.drop("lines_deleted", "runs_deleted")
    runs = repeated_runs(docs, id_col, text_col, min_words, long_words, run_words)
    cuts = runs.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_cuts"), F.sum(F.col("b") - F.col("a") + 1).alias("_n"))
    k1, k2 = doc_key(id_col, text_col)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), k1, k2)
    joined = keyed.join(cuts, ["k1", "k2"], "left")
    text = F.col("_row")[text_col]

    def outside(cut: Column) -> Column:
        kept = F.filter(pieces(text), lambda _x, i: ~F.exists(cut, lambda v: i.between(v["a"], v["b"])))
        return F.array_join(kept, "")

    clean = F.when(F.col("_cuts").isNull(), text).otherwise(_let(F.col("_cuts"), outside))
    return joined.select(
        *[clean.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns],
        F.coalesce("_n", F.lit(0)).cast("long").alias("lines_deleted"),
        F.coalesce("_cuts", F.array().cast("array<struct<a:int,b:int>>")).alias("runs_deleted"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str, run_words: int | None = None) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), run_words=run_words)
    return out.select("doc_id", "text", "lines_deleted", F.size("runs_deleted").cast("long").alias("n_runs"))


def op1_line_dedup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 25 words over any number of lines are cut too."""
    return op1_line_dedup(spark, sf_dir, run_words=25)


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(replace(replace(replace(replace(text, chr(10), chr(10)||chr(30)), '. ', '. '||chr(30)), '! ', '! '||chr(30)), '? ', '? '||chr(30)), chr(30)) AS ps FROM documents),
x AS (SELECT doc_id, unnest(ps) AS x, unnest(range(len(ps))) AS pos FROM d),
u AS (SELECT doc_id, pos, trim(x, ' '||chr(9)||chr(10)||chr(13)) AS l, CASE WHEN trim(x, ' '||chr(9)||chr(10)||chr(13)) = '' THEN 0 ELSE len(trim(x, ' '||chr(9)||chr(10)||chr(13))) - len(replace(trim(x, ' '||chr(9)||chr(10)||chr(13)), ' ', '')) + 1 END AS wc FROM x),
u2 AS (SELECT *, lag(l) OVER (PARTITION BY doc_id ORDER BY pos) AS l0 FROM u WHERE wc > 0),
n0 AS (SELECT doc_id, len(ps) AS n FROM d),
v AS (SELECT doc_id, pos, l, wc, coalesce(lead(pos) OVER o, n) - 1 AS fin, row_number() OVER o - 1 AS p, 0 AS e FROM u2 JOIN n0 USING (doc_id) WHERE l IS DISTINCT FROM l0 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
s3 AS (SELECT doc_id, p, p + 2 AS q, wc + lead(wc) OVER o + lead(wc, 2) OVER o AS words, [l, lead(l) OVER o, lead(l, 2) OVER o] AS c FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
s9 AS (SELECT doc_id, p, count(*) OVER nine AS n9, sum(wc) OVER nine AS w9, list(l) OVER nine AS c9, count(*) OVER many AS n27, sum(wc) OVER many AS w27, list(l) OVER many AS c27 FROM v
 WINDOW nine AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING), many AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 26 FOLLOWING)),
s AS (SELECT doc_id, p, q, c FROM s3 WHERE words >= 15 UNION ALL SELECT doc_id, p, p, [l] FROM v WHERE wc >= 25 UNION ALL SELECT doc_id, p, p + 8, c9 FROM s9 WHERE n9 = 9 AND w9 >= 15 UNION ALL SELECT doc_id, p, p + 26, c27 FROM s9 WHERE n27 = 27 AND w27 >= 15),
later AS (SELECT doc_id, p, q FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY doc_id, p) AS rn FROM s) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, q + 1)) AS p FROM later),
gp AS (SELECT g.doc_id, g.p, v.pos, v.fin FROM gone g JOIN v USING (doc_id, p)),
isl AS (SELECT doc_id, min(pos) AS a, max(fin) AS b, max(fin) - min(pos) + 1 AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM gp) GROUP BY doc_id, g),
kept AS (SELECT x.doc_id, string_agg(x.x, '' ORDER BY x.pos) AS t FROM x WHERE NOT EXISTS (SELECT 1 FROM isl WHERE isl.doc_id = x.doc_id AND x.pos BETWEEN isl.a AND isl.b) GROUP BY 1),
n AS (SELECT doc_id, sum(n) AS n, count(*) AS r FROM isl GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.t, '') END AS text, coalesce(n.n, 0)::BIGINT AS lines_deleted, coalesce(n.r, 0)::BIGINT AS n_runs
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_RUNS = """
w AS (SELECT doc_id, p, l, wc, sum(wc) OVER (PARTITION BY doc_id ORDER BY p) AS e, sum(wc) OVER (PARTITION BY doc_id ORDER BY p) - wc AS s FROM v),
f AS (SELECT doc_id, p, p + count(*) OVER r - 1 AS q, sum(wc) OVER r AS words, list(l) OVER r AS c FROM w WINDOW r AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN 0 PRECEDING AND 24 FOLLOWING)),
b AS (SELECT doc_id, min(p) OVER r AS p, p AS q, sum(wc) OVER r AS words, list(l) OVER r AS c FROM w WINDOW r AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 24 PRECEDING AND 0 FOLLOWING)),
sr AS (SELECT * FROM s UNION SELECT doc_id, p, q, c FROM f WHERE words >= 25 UNION SELECT doc_id, p, q, c FROM b WHERE words >= 25),
later AS"""

#: The rule with ``run_words``: windows of 1 and 3 lines, and the spans of 25 words.
ORACLE_WORDS = ORACLE.replace(" UNION ALL SELECT doc_id, p, p + 8, c9 FROM s9 WHERE n9 = 9 AND w9 >= 15 UNION ALL SELECT doc_id, p, p + 26, c27 FROM s9 WHERE n27 = 27 AND w27 >= 15", "").replace("\nlater AS", _RUNS).replace("FROM s) WHERE rn > 1", "FROM sr) WHERE rn > 1")
