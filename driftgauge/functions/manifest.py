"""Expressions over manifest rows: aliases, timestamps, labels and path metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column aliases, the first match wins.
TIMESTAMP_KEYS = ["first_seen", "first_seen_utc", "first_seen_at", "first_seen_time", "timestamp", "time", "datetime", "date", "submitted_at", "created_at", "report_time"]
ID_KEYS = ["sha256", "sha_256", "sha-256", "sample_id", "id", "hash", "file_hash", "Malware SHA-256"]
PATH_KEYS = ["md_path", "markdown_path", "report_path", "path", "filepath"]
#: Formats tried after ISO.
FORMATS = ["yyyy-MM-dd H:m:s", "yyyy-MM-dd H:m", "yyyy-M-d", "yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy/M/d", "yyyy-MM-dd'T'H:m:s.SSSSSS", "yyyy-MM-dd'T'H:m:s"]


def coalesce_aliases(df: DataFrame, aliases: list[str]) -> Column:
    """The first alias, in any case, whose value isn't null or blank, as a string."""
    known = {c.lower(): c for c in df.columns}
    values = [F.col(f"`{known[a.lower()]}`").cast("string") for a in aliases if a.lower() in known]
    kept = [F.when(F.trim(v) != "", v) for v in values]
    return F.coalesce(*kept) if kept else F.lit(None).cast("string")


def normalise_timestamp(value: Column) -> Column:
    """UTC time without zone: digits are epoch seconds (13 digits or more milliseconds), else ISO or ``FORMATS``; null if none fits."""
    text = F.trim(value.cast("string"))
    number = F.try_to_number(text, F.lit("9" * 18)).cast("long")
    epoch = F.when(F.length(text) >= 13, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))
    iso = F.regexp_replace(F.regexp_replace(text, "/", "-"), "[zZ]$", "+00:00")
    shape = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?([+-]\d{2}:?\d{2})?)?$"
    parsed = F.when(iso.rlike(shape), F.regexp_replace(iso, ",", ".").try_cast("timestamp"))
    tried = F.coalesce(parsed, *[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS])
    utc = F.when(text.rlike(r"^\d+$"), F.when(F.length(text) <= 18, epoch)).otherwise(tried)
    return F.to_utc_timestamp(utc, F.current_timezone()).cast("timestamp_ntz")


VOCABULARIES = {
    "plain": ({"malicious", "black"}, {"benign", "white"}),
    "wide": ({"malicious", "black", "malware"}, {"benign", "white", "goodware"}),
}


def infer_label(path: Column, sidecar: Column | None = None, vocab: str = "plain") -> Column:
    """1 or 0 from a side-car value or else from the parts of a path; null is unlabelled.

    With the wide vocabulary an unreadable side-car leaves the row unlabelled, with the
    plain one the path still counts.
    """
    bad, good = VOCABULARIES[vocab]
    parts = F.split(F.lower(path), r"[/\\]")
    has = lambda names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in sorted(names)]))
    by_path = F.when(has({"unknown"}), F.lit(None)).when(has(bad), 1).when(has(good), 0)
    if sidecar is None:
        return by_path.cast("int")
    value = F.trim(sidecar).try_cast("int")
    read = F.when(value.isin(0, 1), value)
    if vocab == "wide":
        return F.when(sidecar.isNotNull(), read).otherwise(by_path).cast("int")
    return F.coalesce(read, by_path).cast("int")


def filter_window(df: DataFrame, start, end, exclude: list[str], hash_col: str = "sha256", family: str = "family", ts: str = "first_seen") -> DataFrame:
    """Rows with a hash and a family that isn't excluded, seen from start to end, both inclusive."""
    name = F.trim(F.col(family).cast("string"))
    named = (F.trim(F.col(hash_col).cast("string")) != "") & (name != "") & ~F.lower(name).isin([e.lower() for e in exclude])
    return df.where(named & F.col(ts).between(F.lit(start), F.lit(end)))


def path_metadata(df: DataFrame, path: str = "path", text: str = "text", keywords: list[str] | None = None) -> DataFrame:
    """``path_family`` (first part that holds a keyword, else Unknown), ``path_date`` and ``text_length``."""
    words = keywords or ["family", "trojan", "ransom", "worm", "backdoor"]
    parts = F.split(F.col(path), "/")
    hit = F.get(F.filter(parts, lambda p: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(p), w))), F.lit(0))
    date = F.regexp_extract(path, r"(\d{4}[-/]\d{2}[-/]\d{2})", 1)
    return df.withColumns({"path_family": F.coalesce(hit, F.lit("Unknown")), "path_date": F.when(date != "", F.replace(date, F.lit("/"), F.lit("-"))), "text_length": F.length(text).cast("long")})
