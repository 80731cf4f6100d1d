"""JSON of any shape, and text of none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import LineParser, actor, endpoint, event, let, metadata, word_severity

# Names under which such lines keep time, severity, message and user.
TIMES = ("timestamp", "time", "@timestamp", "eventTime", "datetime", "date")
SEVERITIES = ("severity", "level", "priority", "sev")
MESSAGES = ("message", "msg", "description", "text", "event")
USERS = ("user", "username", "user_name")
CUT = 1000


def _fields() -> Column:
    """A JSON object's members as a map, null for other lines."""
    valid = F.trim("data").startswith("{") & F.try_parse_json("data").isNotNull()
    return F.when(valid, F.from_json("data", "map<string,string>"))


def _of(m: Column) -> Column:
    line = F.col("data")
    first = lambda names: F.coalesce(*(m[n] for n in names))
    time = F.coalesce(*(F.coalesce(F.try_to_timestamp(m[n]), F.timestamp_millis(m[n].try_cast("bigint"))) for n in TIMES))
    scalars = F.map_filter(m, lambda k, v: v.isNotNull() & ~v.startswith("{") & ~v.startswith("["))
    is_json = m.isNotNull()
    text = F.when(F.length(line) > CUT, F.concat(F.substring(line, 1, CUT), F.lit("..."))).otherwise(line)
    return event(
        time=time, severity=F.when(is_json, word_severity(first(SEVERITIES))).otherwise(1), class_uid=1000, category_uid=0, class_name="generic", category_name="system",
        message=F.when(is_json, F.coalesce(first(MESSAGES), line)).otherwise(text), actor=actor(first(USERS)), src=endpoint(F.coalesce(m["src_ip"], m["source_ip"])), dst=endpoint(F.coalesce(m["dst_ip"], m["dest_ip"])),
        meta=F.map_concat(F.map_filter(F.coalesce(scalars, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("parser", "format")), metadata(parser=F.lit("generic"), format=F.when(is_json, "json").otherwise("unknown"))), error=F.when(line.isNull() | (F.trim(line) == ""), "empty line"),
    )


parse = LineParser(lambda: let(_fields(), _of))
