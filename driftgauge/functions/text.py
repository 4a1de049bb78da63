"""Text expressions: identifiers to placeholders, section masks, counts.

Patterns run in Java with Unicode classes (``U``) and unix line ends (``d``). A null text
stays null; counts of a null text are null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns and placeholders, in the order in which they apply.
HASH_RULES = [
    (r"(?Ud)\b[0-9a-fA-F]{64}\b", "[HASH]"),
    (r"(?Ud)\b[0-9a-fA-F]{40}\b", "[HASH]"),
    (r"(?Ud)\b[0-9a-fA-F]{32}\b", "[HASH]"),
]
ID_RULES = [
    (r"(?Ud)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "[ID]"),
    (r"(?Ud)\b[0-9a-fA-F]{48,}\b", "[ID]"),
]
URL = r"(?iuUd)\b(?:https?|ftp)://[^\s`|<>)]+"
IPV4 = r"(?Ud)\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?\b"
REGISTRY = r"(?iuUd)\b(?:HKEY_LOCAL_MACHINE|HKEY_CURRENT_USER|HKEY_CLASSES_ROOT|HKEY_USERS|HKLM|HKCU|HKCR|HKU)\\[^\s`|]+"
WINDOWS_PATH = r"(?iuUd)(?:(?:[A-Za-z]:|%[A-Za-z0-9_]+%)\\[^\s`|]+|\\\\[A-Za-z0-9_.-]+\\[^\s`|]+)"
IOC_RULES = [
    (URL, "[URL]"),
    (IPV4, "[IP]"),
    (
        r"(?iuUd)\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+"
        r"(?:com|net|org|biz|info|ru|cn|top|xyz|site|online|io|co|uk|de|jp|kr|br|in|us|cc|me|pro|pw|club|live|shop|dev|app)\b",
        "[DOMAIN]",
    ),
    (REGISTRY, "[REGISTRY]"),
    (WINDOWS_PATH, "[PATH]"),
    (r"(?iuUd)\b(?:CAPE|Cuckoo|sandbox|analysis|sample|malware|benign|cape_report_malware|cape_reports_benign)[\\/][^\s`|]+", "[SANDBOX_PATH]"),
]
#: A long run of such signs is a random id if a letter and a digit follow in its line, from its first sign on.
RANDOM_ID = r"\b[A-Za-z0-9_-]{16,}\b"
# Indicators and their patterns.
INDICATORS = {
    "sha256": r"(?iuUd)\b[0-9a-fA-F]{64}\b",
    "md5": r"(?iuUd)\b[0-9a-fA-F]{32}\b",
    "url": URL,
    "ipv4": IPV4,
    "registry": REGISTRY,
    "windows_path": WINDOWS_PATH,
}
# Groups of section headings.
SECTION_GROUPS = {
    "commands": ["Executed Commands"],
    "suspicious": ["Suspicious Activities"],
    "file_ops": ["File Operations"],
    "registry_ops": ["Registry Operations"],
    "network": ["Network Activity", "Network Connections", "DNS Requests", "HTTP Requests", "TLS Connections"],
    "process": ["Process Timeline", "Process Tree"],
    "other": ["Other Activities"],
    "metadata": ["Summary Statistics", "File Extensions Observed", "Registry Hive Activity"],
}


#: A word's edge where only ASCII signs make words; Java's own \b also takes other letters.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _ascii(pattern: str) -> str:
    """``pattern`` with digits, blanks and words of ASCII alone, as Python's re.ASCII and RE2 read it."""
    for a, b in (("(?iuUd)", "(?iud)"), ("(?sUd)", "(?sd)"), ("(?Ud)", "(?d)"), (r"\b", _EDGE), (r"_\d-", "_0-9-"), (r"\d", "[0-9]"), (r"[^\s", r"[^\t\n\f\r ")):
        pattern = pattern.replace(a, b)
    return pattern


#: What a text must hold for a rule to find anything; placeholders hold none of it, so no rule makes it.
_NEEDS = [(HASH_RULES + ID_RULES, r"[0-9a-fA-F]{32}|[0-9a-fA-F]-[0-9a-fA-F]{4}-")] + [
    ([rule], need) for rule, need in zip(IOC_RULES, ["://", r"(?U)\d\.\d", r"\.[0-9\p{L}]", r"\\", r"\\", r"[\\/]"], strict=True)
]


def _apply(text: Column, rules: list[tuple[str, str]], ascii: bool = False) -> Column:
    """The rules in turn, each only where its need is met: most texts hold few of the identifiers."""

    def where_needed(own: list[tuple[str, str]], need: str) -> Callable[[Column], Column]:
        made = lambda t: reduce(lambda t, r: F.regexp_replace(t, _ascii(r[0]) if ascii else r[0], r[1]), own, t)
        return lambda t: F.when(t.rlike(need), made(t)).otherwise(t)

    for some, need in _NEEDS:
        if own := [r for r in some if r in rules]:
            text = _let(text, where_needed(own, need))
    return text


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for use in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _random_ids(text: Column, ascii: bool = False) -> Column:
    """Random ids to placeholders, in time that grows with a line's length alone.

    Ids can begin up to the last digit and the last letter of a line, whichever comes first.
    The line is read up to there, with the run it stands in; what begins behind it, where
    that run has no more digits (or letters), is no id.
    """
    kind = _ascii if ascii else str
    last_digit = r"(?Ud)(?=[A-Za-z0-9_-]{16})\b(?![A-Za-z_-]*+[^A-Za-z0-9_\d-]?\z)"
    last_letter = r"(?Ud)(?=[A-Za-z0-9_-]{16})\b(?![0-9_-]*+[^A-Za-z0-9_-]?\z)"

    def ends(line: Column) -> Column:
        upto = lambda p: F.length(F.regexp_extract(line, kind(p), 0))
        return F.struct(line.alias("t"), upto(r"(?sUd)\A.*\d").alias("digit"), upto(r"(?sd)\A.*[A-Za-z]").alias("letter"))

    def cut(e: Column) -> Column:
        q = F.least(e["digit"], e["letter"])
        run = F.regexp_extract(F.substr(e["t"], q + 1), r"(?sd)\A[A-Za-z0-9_-]*.?", 0)
        return F.struct(e["t"].alias("t"), q.alias("q"), (e["digit"] < e["letter"]).alias("by_digit"), (q + F.length(run)).alias("n"))

    def marked(c: Column) -> Column:
        live = F.left(c["t"], c["n"])
        new = F.when(c["by_digit"], F.regexp_replace(live, kind(last_digit + RANDOM_ID), "[RANDOM_ID]")).otherwise(F.regexp_replace(live, kind(last_letter + RANDOM_ID), "[RANDOM_ID]"))
        return F.when(c["q"] > 0, F.concat(new, F.substr(c["t"], c["n"] + 1))).otherwise(c["t"])

    def redacted(line: Column) -> Column:
        return F.when(line.rlike("[A-Za-z0-9_-]{16}"), _let(_let(ends(line), cut), marked)).otherwise(line)

    lines = lambda t: F.array_join(F.transform(F.split(t, "\n", -1), redacted), "\n")
    return _let(text, lambda t: F.when(t.rlike("[A-Za-z0-9_-]{16}"), lines(t)).otherwise(t))


def redact_hashes(text: Column, ascii: bool = False) -> Column:
    """As all redactions: ``ascii`` takes words, digits and blanks of ASCII alone, so that an id ends before an accented letter."""
    return _apply(text, HASH_RULES, ascii)


def redact_strong_ids(text: Column, ascii: bool = False) -> Column:
    return _apply(text, HASH_RULES + ID_RULES, ascii)


def redact_iocs(text: Column, ascii: bool = False) -> Column:
    return _random_ids(_apply(text, HASH_RULES + ID_RULES + IOC_RULES, ascii), ascii)


#: Named text transforms; users may add their own Column -> Column.
CONDITIONS: dict[str, Callable[[Column], Column]] = {
    "with_hash": lambda t: t,
    "without_hash": redact_hashes,
    "without_strong_ids": redact_strong_ids,
    "without_iocs": redact_iocs,
}
#: The same with words, digits and blanks of ASCII alone.
ASCII_CONDITIONS: dict[str, Callable[[Column], Column]] = {n: f if n == "with_hash" else partial(f, ascii=True) for n, f in CONDITIONS.items()}


def ablation_conditions(df: DataFrame, text: str = "text", conditions: dict | None = None) -> DataFrame:
    """One row per document and condition, with the transformed text."""
    made = [F.struct(F.lit(n).alias("condition"), f(F.col(text)).alias("_t")) for n, f in (conditions or CONDITIONS).items()]
    out = df.withColumn("_c", F.explode_outer(F.array(*made)))
    return out.select(*[F.col("_c._t").alias(text) if c == text else F.col(c) for c in df.columns], F.col("_c.condition").alias("condition"))


def ablation_texts(df: DataFrame, text: str = "text", conditions: dict | None = None) -> DataFrame:
    """As ``ablation_conditions`` with a row per document and different text, and ``conditions``, the list of those that give it."""
    made = F.array(*[F.struct(F.lit(n).alias("condition"), f(F.col(text)).alias("_t")) for n, f in (conditions or CONDITIONS).items()])

    def grouped(m: Column) -> Column:
        same = lambda t: F.transform(F.filter(m, lambda x: x["_t"].eqNullSafe(t)), lambda x: x["condition"])
        return F.transform(F.array_distinct(F.transform(m, lambda x: x["_t"])), lambda t: F.struct(t.alias("_t"), same(t).alias("conditions")))

    out = df.withColumn("_c", F.explode_outer(_let(made, grouped)))
    return out.select(*[F.col("_c._t").alias(text) if c == text else F.col(c) for c in df.columns], F.col("_c.conditions").alias("conditions"))


# White space, a heading, and a line's end, as Python's regular expressions and strings have them.
_BLANK = r"[\s\x1c-\x1f]"
_HEADING = rf"^##+{_BLANK}+(.+?){_BLANK}*$"
_LINE = r"[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*"
#: A heading and all that stands before the next one.
_BLOCK = rf"(?mUd){_HEADING}(?s:.*?)(?={_HEADING}|\z)"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{_BLANK}+|{_BLANK}+\z", "")


def sections(text: Column) -> Column:
    """array<struct<pos, heading, block>>: the sections of a Markdown text, which joined are the text.

    ``__preamble__`` stands before the first heading; a text without headings is ``__all__``.
    """
    blocks = F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(0))
    titles = F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(1))
    # the blocks reach to the end, so what they leave stands in front
    front = F.length(text) - F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b))
    named = F.zip_with(titles, blocks, lambda h, b: F.struct(_strip(h).alias("heading"), b.alias("block")))
    none = F.struct(F.lit("__all__").alias("heading"), text.alias("block"))
    before = F.struct(F.lit("__preamble__").alias("heading"), F.left(text, front).alias("block"))
    parts = F.when(F.size(blocks) == 0, F.array(none)).when(front > 0, F.concat(F.array(before), named)).otherwise(named)
    return F.when(text.isNotNull(), F.transform(parts, lambda s, i: F.struct(i.alias("pos"), s["heading"].alias("heading"), s["block"].alias("block"))))


def split_sections(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per section: pos, heading, block in place of the text."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.inline(sections(F.col(text))))


def _hidden(headings: list[str]) -> Callable[[Column], Column]:
    """Of a section with one of the headings: its heading line, and a mark."""
    marks = F.create_map(*[F.lit(x) for h in headings for x in (h, f"$1\n[MASKED_{'_'.join(h.upper().split(' '))}]\n")])
    return lambda s: F.regexp_replace(s["block"], F.lit(rf"(?s)\A({_LINE}).*"), F.element_at(marks, s["heading"]))


def masked(parts: Column, headings: list[str]) -> Column:
    """The text again; of sections with the given headings the heading line stays, and a mark."""
    hidden = _hidden(headings)
    return F.array_join(F.transform(parts, lambda s: F.when(s["heading"].isin(headings), hidden(s)).otherwise(s["block"])), "")


def mask_sections(df: DataFrame, headings: list[str], text: str = "text") -> DataFrame:
    return df.withColumn(text, masked(sections(F.col(text)), headings))


def _raw_and_redacted(df: DataFrame, text: str, made: Callable[[Column], Column]) -> DataFrame:
    """``_raw`` and ``_red``: what ``made`` gives for the sections of the text, and of the redacted text."""
    return df.withColumns({"_raw": made(sections(F.col(text))), "_red": made(_let(redact_iocs(F.col(text)), sections))})


def masking_variants(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per document and variant: original, redacted, each section group masked in both."""
    rows = _raw_and_redacted(df, text, lambda parts: parts)
    made = {"original": F.col(text), "redact_ioc_identifiers": F.array_join(F.transform("_red", lambda s: s["block"]), "")}
    for group, headings in SECTION_GROUPS.items():
        made[f"mask_{group}"] = masked(F.col("_raw"), headings)
        made[f"redact_ioc_mask_{group}"] = masked(F.col("_red"), headings)
    rows = rows.withColumn("_v", F.explode_outer(F.array(*[F.struct(F.lit(n).alias("variant"), t.alias("t")) for n, t in made.items()])))
    return rows.select(*[F.col("_v.t").alias(text) if c == text else F.col(c) for c in df.columns], F.col("_v.variant").alias("variant"))


def masking_counts(df: DataFrame, counters: dict[str, Callable[[Column], Column]], text: str = "text") -> DataFrame:
    """``counters`` of all masking variants in place of the text, and ``original``, those of the text as it is.

    Every section is counted as it is, redacted and masked, and the variants are sums: what is counted must not reach over a line's end.
    """
    every = [h for headings in SECTION_GROUPS.values() for h in headings]
    hidden = _hidden(every)
    per = lambda t: F.struct(*[f(t).cast("long").alias(n) for n, f in counters.items()])

    def counted(parts: Column) -> Column:
        return F.transform(parts, lambda s: F.struct(s["heading"].alias("heading"), per(s["block"]).alias("own"), F.when(s["heading"].isin(every), _let(hidden(s), per)).alias("hid")))

    def total(parts: str, headings: list[str]) -> Column:
        of = lambda s, n: F.when(s["heading"].isin(headings), s["hid"][n]).otherwise(s["own"][n])
        return F.struct(*[F.aggregate(parts, F.lit(0).cast("long"), lambda a, s: a + of(s, n)).alias(n) for n in counters])  # noqa: B023

    made = {"original": total("_raw", []), "redact_ioc_identifiers": total("_red", [])}
    for group, headings in SECTION_GROUPS.items():
        made[f"mask_{group}"], made[f"redact_ioc_mask_{group}"] = total("_raw", headings), total("_red", headings)
    keep = [c for c in df.columns if c != text]
    rows = _raw_and_redacted(df, text, counted).select(*keep, F.array(*[F.struct(F.lit(n).alias("variant"), t.alias("c")) for n, t in made.items()]).alias("_v"))
    # not ``explode``: for that Spark first asks whether the array has elements, which computes all of it once more
    rows = rows.select(*keep, F.col("_v")[0]["c"].alias("original"), F.explode_outer("_v").alias("_v"))
    return rows.select(*keep, "original", "_v.variant", "_v.c.*")


#: How often each indicator stands in a text.
INDICATOR_COUNTS: dict[str, Callable[[Column], Column]] = {n: lambda t, p=p: F.regexp_count(t, F.lit(p)).cast("long") for n, p in INDICATORS.items()}


def count_indicators(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns({n: f(F.col(text)) for n, f in INDICATOR_COUNTS.items()})


# What counts as an indicator, and as a token.
IOC_PATTERNS = [r"(?Ud)\b(?:\d{1,3}\.){3}\d{1,3}\b", r"(?Ud)https?://[^\s]+", r"(?Ud)\b[a-fA-F0-9]{32,64}\b"]
TOKEN = r"(?Ud)[A-Za-z0-9_]+|[一-鿿]|[^\s]"


def ioc_count(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in IOC_PATTERNS])


def ioc_coverage(df: DataFrame, text: str = "text") -> DataFrame:
    """``ioc_count`` and ``ioc_coverage``: hits per hundred characters, at most 1."""
    n = ioc_count(F.col(text))
    return df.withColumns({"ioc_count": n.cast("long"), "ioc_coverage": F.least(n / F.greatest(F.length(text) / 100, F.lit(1.0)), F.lit(1.0))})


def approx_tokens(text: Column) -> Column:
    """ASCII words, CJK characters and other single signs."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def token_deltas(variants: DataFrame, keys: list[str], text: str = "text", base: str = "original") -> DataFrame:
    """``approx_tokens`` of each variant and the difference to the original's."""
    rows = variants.withColumn("approx_tokens", approx_tokens(F.col(text)))
    original = F.max(F.when(F.col("variant") == base, F.col("approx_tokens"))).over(Window.partitionBy(*keys))
    return rows.withColumn("token_delta", F.col("approx_tokens") - original)


def token_windows(df: DataFrame, tokens: str, max_tokens: int = 512, stride: int = 128, cap: int = 50) -> DataFrame:
    """One row per window of ``max_tokens`` with ``stride`` tokens of overlap: chunk, start, window.

    A stride of max_tokens or more means no overlap. At most ``cap`` windows are the
    feature's own limit; no tokens, no window.
    """
    step = max_tokens - stride if 0 <= stride < max_tokens else max_tokens
    n = F.size(tokens)
    count = F.least(F.greatest(F.ceil((n - max_tokens) / step).cast("int") + 1, F.lit(1)), F.lit(cap))
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: k * step))
    keep = [c for c in df.columns if c != tokens]
    rows = df.select(*keep, tokens, F.posexplode(starts).alias("chunk", "start"))
    return rows.select(*keep, "chunk", "start", F.slice(tokens, F.col("start") + 1, F.lit(max_tokens)).alias("window"))
