"""Common Event Format: seven fields between pipes, then an extension of key=value pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import LineParser, actor, cef_severity, endpoint, event, group, groups, let, text_or_null

# Fixed value: the form of the header.
HEADER = r"^CEF:(\d+)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"
#: A value runs until the next key or the end.
PAIR = r"(\w+)=(.*?)(?=\s+\w+=|$)"


def _extension(text: Column) -> Column:
    """The pairs as a map; of equal keys the last one counts."""

    def of(pairs: Column) -> Column:
        last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
        return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value"))))

    found = lambda n: F.regexp_extract_all(text, F.lit(PAIR), F.lit(n))
    return let(F.arrays_zip(found(1).alias("k"), F.transform(found(2), lambda v: F.trim(v)).alias("v")), of)


def _of(g: Column, ext: Column) -> Column:
    part = lambda n: group(g, n)
    x = lambda k: text_or_null(ext[k])
    number = lambda c: c.try_cast("int")
    when = F.coalesce(x("rt"), x("end")).try_cast("bigint")
    meta = F.map_concat(
        F.transform_keys(ext, lambda k, v: F.concat(F.lit("cef."), k)),
        F.create_map(F.lit("parser"), F.lit("cef"), *(y for n, i in (("device_vendor", 2), ("device_product", 3), ("device_version", 4), ("signature_id", 5)) for y in (F.lit(n), F.coalesce(part(i), F.lit(""))))),
    )
    return event(
        time=F.timestamp_millis(when), severity=cef_severity(number(part(7))), class_uid=9999, category_uid=99,
        class_name=part(6), category_name="unknown", message=part(6),
        actor=actor(F.coalesce(x("suser"), x("duser")), x("sproc")), src=endpoint(x("src"), number(x("spt")), x("shost"), x("smac")), dst=endpoint(x("dst"), number(x("dpt")), x("dhost"), x("dmac")),
        meta=meta, error=F.when(g.isNull(), "not a CEF line"),
    )


parse = LineParser(lambda: let(groups(F.col("data"), HEADER, 8), lambda g: let(_extension(F.coalesce(group(g, 8), F.lit(""))), lambda ext: _of(g, ext))))
