"""Syslog: RFC 5424, RFC 3164, and whatever else begins with a priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import LineParser, actor, endpoint, event, group, groups, let, metadata, syslog_severity

# The headers of the two RFCs.
NEW = r"^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(-|(?:\[[^\]]*\])+)\s*(.*)$"
OLD = r"^<(\d+)>([A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+):\s*(.*)$"
ELEMENT, PARAMETER = r"\[([^\s\]]+)([^\]]*)\]", r'(\S+?)="([^"]*)"'


def _structured(elements: Column) -> Column:
    """The parameters of structured data as a map of `element.parameter`; of equal names the first one counts."""
    found = lambda e, n: F.regexp_extract_all(e, F.lit(PARAMETER), F.lit(n))
    named = lambda e, p: F.struct(F.concat(F.regexp_extract(e, ELEMENT, 1), F.lit("."), p["k"]).alias("key"), p["v"].alias("value"))
    pairs = F.flatten(F.transform(F.regexp_extract_all(elements, F.lit(ELEMENT), F.lit(0)), lambda e: F.transform(F.arrays_zip(found(e, 1).alias("k"), found(e, 2).alias("v")), lambda p: named(e, p))))
    first = let(pairs, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, 1, i), lambda q: q["key"] == p["key"])))
    return F.coalesce(F.map_from_entries(first), F.create_map().cast("map<string,string>"))


def _of(n: Column, o: Column) -> Column:
    line = F.col("data")
    new, old = n.isNotNull(), o.isNotNull()
    part, was = lambda i: group(n, i), lambda i: group(o, i)
    priority = F.coalesce(part(1), was(1)).try_cast("int")
    # a year-less date is of the year the line arrived in; two blanks before the day become one
    dated = F.concat(F.year("arrived").cast("string"), F.lit(" "), F.regexp_replace(was(2), r"\s+", " "))
    time = F.coalesce(F.try_to_timestamp(part(3)), F.try_to_timestamp(dated, F.lit("yyyy MMM d HH:mm:ss")))
    known = new | old
    meta = F.map_concat(_structured(part(8)), metadata(parser=F.lit("syslog"), facility=F.when(known, F.shiftright(priority, 3)), msgid=part(7), format=F.when(new, "rfc5424").when(old, "rfc3164").otherwise("generic")))
    return event(
        time=time, severity=F.when(known, syslog_severity(priority.bitwiseAND(F.lit(7)))).otherwise(1), class_uid=6001, category_uid=6, class_name="syslog", category_name="application",
        message=F.coalesce(part(9), was(5), line), actor=actor(None, F.coalesce(part(5), was(4)), part(6)), src=endpoint(None, None, F.coalesce(part(4), was(3))), dst=endpoint(), meta=meta,
    )


def _event() -> Column:
    new = F.transform(groups(F.col("data"), NEW, 9), lambda p: F.nullif(p, F.lit("-")))
    return let(new, lambda n: let(F.when(n.isNull(), groups(F.col("data"), OLD, 5)), lambda o: _of(n, o)))


parse = LineParser(_event)
