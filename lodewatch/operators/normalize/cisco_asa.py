"""Cisco ASA: %ASA-severity-id: message, with the addresses of connections built and torn down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import LineParser, actor, endpoint, event, group, groups, let, metadata, syslog_severity

# Fixed value: the form of the header.
HEADER = r"%ASA-(\d)-(\d+):\s*(.+)"
ADDRESS = r"(\S+?):([\d.]+)/(\d+)(?: \(([\d.]+)/(\d+)\))?"
CONNECTION = rf"(Built|Teardown) (?:inbound |outbound )?(\w+) connection (\d+) for {ADDRESS} to {ADDRESS}"


def _of(h: Column, c: Column) -> Column:
    line = F.col("data")
    head, part = lambda n: group(h, n), lambda n: group(c, n)
    return event(
        time=F.lit(None).cast("timestamp"), severity=F.when(h.isNotNull(), syslog_severity(head(1).try_cast("int"))).otherwise(1), class_uid=4001, category_uid=4, class_name="network_activity", category_name="network",
        message=F.coalesce(head(3), line), actor=actor(), src=endpoint(F.coalesce(part(7), part(5)), F.coalesce(part(8), part(6)).try_cast("int")), dst=endpoint(F.coalesce(part(12), part(10)), F.coalesce(part(13), part(11)).try_cast("int")),
        meta=metadata(parser=F.lit("cisco-asa"), vendor=F.lit("cisco"), messageId=head(2), protocol=F.lower(part(2)), action=F.lower(part(1)), connection_id=part(3)),
    )


parse = LineParser(lambda: let(groups(F.col("data"), HEADER, 3), lambda h: let(groups(F.col("data"), CONNECTION, 13), lambda c: _of(h, c))))
