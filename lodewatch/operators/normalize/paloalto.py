"""Palo Alto firewall CSV."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import LineParser, action_severity, actor, endpoint, event, let, metadata, text_or_null

LEAST_FIELDS = 10


def _of(f: Column) -> Column:
    field = lambda i: text_or_null(F.trim(F.get(f, F.lit(i))))
    number = lambda c: c.try_cast("int")
    first = F.get(F.filter(f, lambda x: F.trim(x) != ""), F.lit(0))
    message = F.concat_ws(" ", F.concat(F.lit("Type: "), field(3)), F.concat(F.lit("Action: "), field(30)), F.concat(F.lit("App: "), field(28)))
    return event(
        time=F.try_to_timestamp(first, F.lit("yyyy/MM/dd HH:mm:ss")), severity=action_severity(field(30)), class_uid=4001, category_uid=4, class_name="network_activity", category_name="network", message=message,
        actor=actor(), src=endpoint(field(7), number(field(9))), dst=endpoint(field(8), number(field(10))), meta=metadata(parser=F.lit("paloalto"), vendor=F.lit("paloalto"), subtype=field(4), application=field(28), action=field(30)),
        error=F.when(f.isNull() | (F.size(f) < LEAST_FIELDS), "too few fields"),
    )


parse = LineParser(lambda: let(F.split(F.regexp_replace("data", ",+$", ""), ","), _of))
