"""API calls and side effects from nested sandbox reports.

A report is a JSON object; ``calls``, ``arguments`` and return values vary in type, so
leaves are read as variants. A level of the wrong type is skipped, a report that isn't
an object is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

API = "array<struct<api_name:string,args:array<string>,ret_val:string>>"


def _list(v: Column, path: str) -> Column:
    """The array of variants at a path, or null."""
    return F.try_variant_get(v, path, "array<variant>")


def _text(v: Column) -> Column:
    """A leaf as Python shows it: True, False, None, else its text."""
    kind = F.schema_of_variant(v)
    plain = F.try_variant_get(v, "$", "string")
    return F.when(v.isNull() | F.is_variant_null(v), "None").when(kind == "BOOLEAN", F.initcap(plain)).otherwise(plain)


def _falsy(v: Column) -> Column:
    plain = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    kind = F.schema_of_variant(v)
    return v.isNull() | F.is_variant_null(v) | (plain == "") | ((kind == "BOOLEAN") & (plain == "false")) | ((kind != "STRING") & (number == 0))


def _argument(a: Column) -> Column:
    value = F.try_variant_get(a, "$.value", "variant")
    named = F.try_variant_get(a, "$.name", "string").isNotNull() | value.isNotNull()
    return F.when(named, _text(value)).otherwise(_text(a))


def parsed(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """``report`` as a variant; malformed JSON and anything but an object is dropped."""
    rows = reports.withColumn("report", F.try_parse_json(raw))
    return rows.where(F.schema_of_variant("report").startswith("OBJECT"))


def rejected(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """One row: the number of reports that ``parsed`` drops."""
    v = F.try_parse_json(raw)
    return reports.agg(F.count_if(v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))).alias("n_rejected"))


def api_calls(report: Column) -> Column:
    """array<struct<process, call, api_name, args, ret_val>>, in report order, without a shuffle."""

    def of_call(c: Column, p: Column, i: Column) -> Column:
        args = F.coalesce(_list(c, "$.arguments"), F.array().cast("array<variant>"))
        ret = F.try_variant_get(c, "$.return", "variant")
        return F.struct(
            p.alias("process"), i.alias("call"), F.try_variant_get(c, "$.api", "string").alias("api_name"), F.transform(args, _argument).alias("args"), F.when(_falsy(ret), "").otherwise(_text(ret)).alias("ret_val")
        )

    def of_process(x: Column, p: Column) -> Column:
        calls = F.coalesce(_list(x, "$.calls"), F.array().cast("array<variant>"))
        return F.transform(calls, lambda c, i: of_call(c, p, i))

    every = F.flatten(F.transform(F.coalesce(_list(report, "$.behavior.processes"), F.array().cast("array<variant>")), of_process))
    return F.filter(every, lambda c: F.coalesce(c["api_name"], F.lit("")) != "")


def extract_api_calls(df: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """One row per call: process, call, api_name, args, ret_val."""
    return df.select(id_col, F.inline(api_calls(F.col("report"))))


def _events(report: Column, fields: dict[str, str], base: str) -> Column:
    def of(field: str, event: str) -> Column:
        values = F.coalesce(_list(report, f"{base}.{field}"), F.array().cast("array<variant>"))
        return F.transform(F.filter(values, lambda v: ~_falsy(v)), lambda v: F.struct(F.lit(event).alias("event"), _text(v).alias("path")))

    return F.concat(*[of(f, e) for f, e in fields.items()])


# Report fields and the events they stand for.
FILE_FIELDS = {"read_files": "read", "write_files": "write", "delete_files": "delete"}
REGISTRY_FIELDS = {"regkey_read": "read", "regkey_written": "written", "regkey_deleted": "deleted", "regkey_opened": "opened"}


def file_access(report: Column) -> Column:
    processes = F.coalesce(_list(report, "$.behavior.processes"), F.array().cast("array<variant>"))
    return F.flatten(F.transform(processes, lambda p: _events(p, FILE_FIELDS, "$.file_activities")))


def registry_access(report: Column) -> Column:
    return _events(report, REGISTRY_FIELDS, "$.behavior.summary")


def dns_queries(report: Column) -> Column:
    rows = F.transform(F.coalesce(_list(report, "$.network.dns"), F.array().cast("array<variant>")), lambda d: F.try_variant_get(d, "$.request", "string"))
    return F.filter(rows, lambda q: F.coalesce(q, F.lit("")) != "")


def tcp_traffic(report: Column) -> Column:
    rows = F.coalesce(_list(report, "$.network.tcp"), F.array().cast("array<variant>"))
    rows = F.transform(rows, lambda t: F.struct(F.try_variant_get(t, "$.dst", "string").alias("server"), F.try_variant_get(t, "$.dport", "int").alias("port")))
    return F.filter(rows, lambda t: F.coalesce(t["server"], F.lit("")) != "")


def extract_file_access(df: DataFrame, id_col: str = "sample_id") -> DataFrame:
    return df.select(id_col, F.inline(file_access(F.col("report"))))


def extract_registry_access(df: DataFrame, id_col: str = "sample_id") -> DataFrame:
    return df.select(id_col, F.inline(registry_access(F.col("report"))))


def extract_network(df: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """(id, kind, server, port): dns queries and tcp connections."""
    dns = df.select(id_col, F.lit("dns").alias("kind"), F.explode(dns_queries(F.col("report"))).alias("server"), F.lit(None).cast("int").alias("port"))
    tcp = df.select(id_col, F.lit("tcp").alias("kind"), F.inline(tcp_traffic(F.col("report"))))
    return dns.unionByName(tcp)


def to_entry_points(df: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """One nested row per report with API calls; empty parts are null. Reports in target form pass through."""
    bare = lambda calls: F.transform(calls, lambda c: F.struct(c["api_name"].alias("api_name"), c["args"].alias("args"), c["ret_val"].alias("ret_val")))
    given = F.try_variant_get("report", "$.entry_points[0].apis", API)
    none = lambda a: F.when(F.size(a) > 0, a)
    network = F.struct(none(dns_queries(F.col("report"))).alias("dns"), none(tcp_traffic(F.col("report"))).alias("traffic"))
    out = df.select(
        id_col,
        F.coalesce(given, bare(api_calls(F.col("report")))).alias("apis"),
        none(file_access(F.col("report"))).alias("file_access"),
        none(registry_access(F.col("report"))).alias("registry_access"),
        F.when((F.size(dns_queries(F.col("report"))) > 0) | (F.size(tcp_traffic(F.col("report"))) > 0), network).alias("network_events"),
    )
    return out.where(F.size("apis") > 0)
