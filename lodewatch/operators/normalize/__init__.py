"""Vendor log lines to events: detection, one parser for each vendor, and the split of what can't be parsed.

Every parser is an expression over (raw_id, data, arrived, tenant_id, vendor, metadata), so it serves batch and streaming
frames alike. Its event has parse_error, null where the line was understood.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cef, cisco_asa, cloudtrail, generic, paloalto, syslog, windows
from .common import LineParser, detect_vendor

__all__ = ["PARSERS", "LineParser", "dead_letters", "detect_vendor", "flatten_events", "good_rows", "normalize", "parse_report", "register_parser", "replay_dead_letters"]

Parser = Callable[[DataFrame], DataFrame]
PARSERS: dict[str, Parser] = {
    "cef": cef.parse,
    "cisco:asa": cisco_asa.parse,
    "aws:cloudtrail": cloudtrail.parse,
    "paloalto:firewall": paloalto.parse,
    "syslog:rfc5424": syslog.parse,
    "syslog:rfc3164": syslog.parse,
    "syslog": syslog.parse,
    "windows:eventlog": windows.parse,
    "json": generic.parse,
    "unknown": generic.parse,
}


def register_parser(vendor: str, parser: Parser) -> None:
    """Makes a parser of the user's serve a vendor key."""
    PARSERS[vendor] = parser


def normalize(raw: DataFrame, parsers: dict[str, Parser] | None = None, carry: str | None = None) -> DataFrame:
    """All lines as events with vendor and parse_error; a vendor without a parser goes to the generic one.

    One scan and one expression: a line's vendor chooses the parser whose expression is worked out, and no other is. A parser that is a
    function of a DataFrame (not a LineParser) has a scan of its own, for its vendors. Without a generic parser, lines of other vendors are left out.
    carry: a column of `raw` that stays beside the event; only a LineParser can carry one.
    """
    table = parsers or PARSERS
    known = raw.withColumn("vendor", F.coalesce("vendor_type", detect_vendor(F.col("data"))))
    vendors: dict[Parser, list[str]] = {}
    for v, p in table.items():
        vendors.setdefault(p, []).append(v)
    own = {p: vs for p, vs in vendors.items() if isinstance(p, LineParser)}
    apart = {p: vs for p, vs in vendors.items() if p not in own}
    out = None
    if own:
        event, catches = None, generic.parse in own
        for p, vs in own.items():
            if p is not generic.parse:
                event = F.when(F.col("vendor").isin(*vs), p.event()) if event is None else event.when(F.col("vendor").isin(*vs), p.event())
        if catches:
            event = generic.parse.event() if event is None else event.otherwise(generic.parse.event())
        here = ~F.col("vendor").isin(*(v for vs in apart.values() for v in vs)) if catches and apart else F.lit(True) if catches else F.col("vendor").isin(*(v for vs in own.values() for v in vs))
        # through a generator, so that no filter on an event's columns works the expression out a second time
        out = known.where(here).select(*([carry] if carry else []), F.inline(F.array(event)))
    for p, vs in apart.items():
        found = p(known.where(F.col("vendor").isin(*vs)))
        out = found if out is None else out.unionByName(found)
    # what all lines get
    added = F.map_concat(
        F.create_map(F.lit("originalIngestionTime"), F.col("arrived").cast("string")),
        F.when(F.map_contains_key("metadata", "vendor"), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("detectedVendor"), F.col("vendor"))),
    )
    return out.withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, v: ~k.isin("originalIngestionTime", "detectedVendor")), added))


def good_rows(normalized: DataFrame) -> DataFrame:
    return normalized.where("parse_error is null").drop("parse_error")


def dead_letters(normalized: DataFrame) -> DataFrame:
    """(id, raw_event, error_message, error_type, failed_at, retry_count, error_context) of the lines that failed."""
    return normalized.where("parse_error is not null").select(
        F.sha2(F.concat_ws("|", "raw_id", "raw_data"), 256).alias("id"), "raw_id", F.col("raw_data").alias("raw_event"), F.col("parse_error").alias("error_message"), F.lit("ParseError").alias("error_type"),
        F.col("arrived").alias("failed_at"), F.lit(0).alias("retry_count"), F.create_map(F.lit("vendor"), F.col("vendor"), F.lit("tenant"), F.coalesce("tenant_id", F.lit(""))).alias("error_context"), "tenant_id",
    )


def replay_dead_letters(letters: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(events that parse now, letters that still fail with retry_count one higher); letters at `most` retries stay as they are."""
    due = letters.where(F.col("retry_count") < most)
    raw = lambda rows: rows.select("raw_id", F.col("raw_event").alias("data"), F.col("failed_at").alias("arrived"), "tenant_id", F.lit(None).cast("string").alias("vendor_type"), F.create_map().cast("map<string,string>").alias("metadata"), F.struct(*due.columns).alias("_letter"))
    apart = {v: p for v, p in PARSERS.items() if not isinstance(p, LineParser)}
    theirs = detect_vendor(F.col("raw_event")).isin(*apart)
    # a letter goes through its parser, so that nothing is parsed a second time and joined
    again = normalize(raw(due.where(~theirs) if apart else due), {v: p for v, p in PARSERS.items() if v not in apart}, "_letter")
    failed = again.where("parse_error is not null").select("_letter.*", F.col("parse_error").alias("_error"))
    good = good_rows(again.drop("_letter"))
    if apart:  # such a parser gives no letter back: letters are found by their id
        more = normalize(raw(due.where(theirs)).drop("_letter"), apart)
        bad = more.where("parse_error is not null").select(F.sha2(F.concat_ws("|", "raw_id", "raw_data"), 256).alias("id"), F.col("parse_error").alias("_error")).dropDuplicates(["id"])
        failed, good = failed.unionByName(due.where(theirs).join(bad, "id")), good.unionByName(good_rows(more))
    still = failed.withColumn("retry_count", F.col("retry_count") + 1).withColumn("error_message", F.col("_error")).drop("_error")
    still = still.withColumn("error_context", F.map_concat(F.map_filter("error_context", lambda k, v: k != "last_retry"), F.create_map(F.lit("last_retry"), F.col("retry_count").cast("string"))))
    return good, still.unionByName(letters.where(F.col("retry_count") >= most))


def parse_report(normalized: DataFrame) -> DataFrame:
    """(vendor, parsed, failed)."""
    return normalized.groupBy("vendor").agg(F.count_if(F.col("parse_error").isNull()).alias("parsed"), F.count_if(F.col("parse_error").isNotNull()).alias("failed"))


def flatten_events(df: DataFrame) -> DataFrame:
    """The flat columns of the warm and cold tiers; metadata as JSON, a missing tenant is `default`."""
    return df.select(
        "time", F.coalesce("tenant_id", F.lit("default")).alias("tenant_id"), "severity", "class_uid", "class_name", "category_uid", "category_name",
        F.col("actor.user").alias("actor_user_uid"), F.col("actor.user").alias("actor_user_name"), F.col("src_endpoint.ip").alias("src_endpoint_ip"), F.col("src_endpoint.port").alias("src_endpoint_port"),
        F.col("dst_endpoint.ip").alias("dst_endpoint_ip"), F.col("dst_endpoint.port").alias("dst_endpoint_port"), "message",
        (F.col("raw_data") if "raw_data" in df.columns else F.lit(None).cast("string")).alias("raw_data"),
        (F.col("threat_info.reputation_score") if "threat_info" in df.columns else F.lit(None).cast("int")).alias("threat_reputation"),
        (F.col("ueba_score") if "ueba_score" in df.columns else F.lit(None)).cast("float").alias("ueba_score"), F.to_json("metadata").alias("metadata"),
    )
