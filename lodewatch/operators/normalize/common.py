"""What parsers share: vendor detection, severity maps, endpoints, and the event's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY_MAP = "map<string,string>"
# Fixed values in this module: the marks of vendors' lines, and the severities of words, numbers and actions.


def detect_vendor(line: Column) -> Column:
    """The first that fits; null and empty lines are unknown."""
    t = F.trim(line)
    return (
        F.when(line.isNull() | (t == ""), "unknown")
        .when(t.startswith("CEF:"), "cef")
        .when(t.startswith("{") & t.contains('"eventVersion"') & t.contains('"awsRegion"'), "aws:cloudtrail")
        .when(t.startswith("<Event") & t.contains('xmlns="http://schemas.microsoft.com/win'), "windows:eventlog")
        .when(t.contains("%ASA-"), "cisco:asa")
        .when((t.contains("TRAFFIC") | t.contains("THREAT") | t.contains("CONFIG")) & (F.size(F.split(F.regexp_replace(t, ",+$", ""), ",")) > 20), "paloalto:firewall")
        .when(t.rlike(r"^<\d+>\d+\s+\S"), "syslog:rfc5424")
        .when(t.rlike(r"^<\d+>[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"), "syslog:rfc3164")
        .when(t.rlike(r"^<\d+>"), "syslog")
        .when(t.startswith("{") & t.endswith("}"), "json")
        .otherwise("unknown")
    )


def _ranges(n: Column, *steps: tuple[int, int], otherwise: int) -> Column:
    """Severity of the first upper bound that n doesn't exceed."""
    out = None
    for bound, severity in steps:
        out = F.when(n <= bound, severity) if out is None else out.when(n <= bound, severity)
    return out.otherwise(otherwise)


def cef_severity(n: Column) -> Column:
    """0 to 10, upward."""
    return F.when(n.isNull(), 1).otherwise(_ranges(n, (1, 1), (3, 2), (5, 3), (7, 4), otherwise=5))


def syslog_severity(n: Column) -> Column:
    """0 (emergency) to 7 (debug), downward; also those of firewalls that use syslog's."""
    return F.when(n.isNull(), 1).otherwise(_ranges(n, (1, 5), (2, 4), (3, 4), (4, 3), (5, 2), otherwise=1))


def windows_severity(level: Column) -> Column:
    """1 critical, 2 error, 3 warning, 4 information, others verbose; none is information."""
    return F.when(level == 1, 5).when(level == 2, 4).when(level == 3, 3).when(level.isNull() | (level == 4), 1).otherwise(2)


def word_severity(word: Column) -> Column:
    w = F.lower(word)
    return (
        F.when(w.isin("critical", "fatal", "emergency"), 5).when(w.isin("high", "error", "alert"), 4).when(w.isin("medium", "warning", "warn"), 3).when(w.isin("low", "notice"), 2).otherwise(1)
    )


def action_severity(action: Column) -> Column:
    a = F.lower(action)
    return F.when(a.isin("deny", "drop", "reset-both", "reset-client", "reset-server"), 4).when(a == "alert", 3).when(a == "allow", 1).otherwise(2)


def text_or_null(c: Column) -> Column:
    return F.when(c != "", c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Stands between a line's groups; a line that holds it itself is taken apart group by group.
_MARK = "\x1f"


def groups(line: Column, pattern: str, n: int) -> Column:
    """The array of a pattern's groups 1 to n, empty ones as null; null where the line doesn't fit. The pattern runs once.

    The line is rewritten to its groups with marks between them, which are then split.
    """
    whole = rf"^[\s\S]*?(?:{pattern})[\s\S]*\z"
    marked = F.regexp_replace(line, whole, "".join(f"{_MARK}${i}" for i in range(1, n + 1)))
    parts = let(marked, lambda m: F.when(m.startswith(_MARK), F.slice(F.split(m, _MARK), 2, n)))
    one_by_one = F.when(line.rlike(pattern), F.array(*(F.regexp_extract(line, pattern, i) for i in range(1, n + 1))))
    return F.transform(F.when(line.contains(_MARK), one_by_one).otherwise(parts), lambda p: F.nullif(p, F.lit("")))


def group(found: Column, n: int) -> Column:
    """Group n of the array, null where it isn't there."""
    return F.get(found, F.lit(n - 1))


def endpoint(ip: Column | None = None, port: Column | None = None, host: Column | None = None, mac: Column | None = None) -> Column:
    """An endpoint, null if it has neither address nor name."""
    none = F.lit(None).cast("string")
    ip, host, mac = (c if c is not None else none for c in (ip, host, mac))
    port = (port if port is not None else F.lit(None)).cast("int")
    made = F.struct(ip.alias("ip"), port.alias("port"), host.alias("hostname"), mac.alias("mac"))
    return F.when(ip.isNotNull() | host.isNotNull(), made)


def actor(user: Column | None = None, process: Column | None = None, session: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(*((c if c is not None else none).alias(n) for n, c in (("user", user), ("process", process), ("session", session))))


def metadata(**pairs: Column) -> Column:
    """A map of what isn't null."""
    full = F.create_map(*(x for k, c in pairs.items() for x in (F.lit(k), c.cast("string")))) if pairs else F.create_map().cast(EMPTY_MAP)
    return F.map_filter(full, lambda k, v: v.isNotNull())


def event(
    *, time: Column, severity: Column, class_uid: Column | int, category_uid: Column | int, class_name: Column | str, category_name: Column | str, message: Column,
    actor: Column, src: Column, dst: Column, meta: Column, error: Column | None = None,
) -> Column:
    """The event as a struct, with its fields in one order for all parsers. A line without a time of its own has that of its arrival."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    col = F.col
    return F.struct(
        col("raw_id").alias("raw_id"), F.sha2(F.concat_ws("|", "raw_id", "data"), 256).alias("uuid"), F.coalesce(time, col("arrived")).alias("time"), col("tenant_id").alias("tenant_id"), severity.cast("int").alias("severity"), lit(class_uid).cast("int").alias("class_uid"),
        lit(category_uid).cast("int").alias("category_uid"), lit(class_name).alias("class_name"), lit(category_name).alias("category_name"), actor.alias("actor"), src.alias("src_endpoint"), dst.alias("dst_endpoint"),
        message.alias("message"), col("data").alias("raw_data"), let(meta, lambda m: F.map_concat(F.map_filter(col("metadata"), lambda k, v: ~F.map_contains_key(m, k)), m)).alias("metadata"), col("vendor").alias("vendor"), col("arrived").alias("arrived"),
        (error if error is not None else F.lit(None).cast("string")).alias("parse_error"),
    )


class LineParser:
    """A parser as an expression: event() is the struct of a line (raw_id, data, arrived, tenant_id, vendor, metadata). Called, it parses all lines of a table."""

    def __init__(self, make: Callable[[], Column]):
        self._make, self._made = make, (None, None)

    def event(self) -> Column:
        """The expression, put together once for a Spark context."""
        context = SparkContext._active_spark_context
        if self._made[0] is not context or context is None:
            self._made = (context, self._make())
        return self._made[1]

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.select(F.inline(F.array(self.event())))
