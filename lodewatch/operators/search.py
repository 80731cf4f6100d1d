"""Searches: tenant, time range, predicate, statistics, sorting, limits and pages, as one DataFrame plan."""

from __future__ import annotations

import base64
import json
import operator
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodewatch.functions.times import resolve_time
from lodewatch.sources.moves import Store

DEFAULT_LIMIT, MOST_ROWS = 100, 10_000
FUNCTIONS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "dcount": F.count_distinct}


def for_tenant(df: DataFrame, tenant: str) -> DataFrame:
    """The tenant's rows; the value is a literal, never text of a query. An empty tenant is an error."""
    if not tenant or not tenant.strip():
        raise ValueError("a tenant is required")
    return df.where(F.col("tenant_id") == F.lit(tenant))


def in_range(df: DataFrame, earliest: datetime, latest: datetime, column: str = "time") -> DataFrame:
    """Both ends count."""
    return df.where(F.col(column).between(F.lit(earliest).cast(df.schema[column].dataType), F.lit(latest).cast(df.schema[column].dataType)))


def _number(value):
    """value as a number if it is or looks like one."""
    if isinstance(value, str):
        try:
            return float(value) if "." in value or "e" in value.lower() else int(value)
        except ValueError:
            return None
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) else None


_OPERATORS = {"=": operator.eq, "==": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def compare(field: str, op: str, value, df: DataFrame | None = None) -> Column:
    """field op value with = == != > < >= <= contains; numbers and numeric-looking text are numbers, and nulls match nothing.

    Text against a number is read as one where it is one; other text only differs. With df, whose column's type is then known, a value
    that can't be of that type only differs, too, so no comparison is an error. Comparisons of numbers reach the scan.
    """
    c, number = F.col(field), _number(value)
    if op == "contains":
        return F.contains(c.cast("string"), F.lit(str(value)))
    with_op = _OPERATORS[op]
    differs = c.isNotNull() if op == "!=" else F.lit(False)
    kind = df.select(c).schema[0].dataType if df is not None else None
    if isinstance(kind, T.NumericType):
        return with_op(c, F.lit(number)) if number is not None else differs
    if kind is not None and not isinstance(kind, T.StringType):
        v = F.lit(str(value)).try_cast(kind) if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)) else F.lit(None)
        return F.coalesce(with_op(c, v), differs) if isinstance(kind, T.AtomicType) else differs
    if number is None:
        return with_op(c, F.lit(value))
    as_number = F.coalesce(with_op(c.cast("string").try_cast("double"), F.lit(float(number))), differs)
    # the type is a constant, so only one of the two is left when the plan is made
    return as_number if kind is not None else F.when(F.typeof(c) == "string", as_number).otherwise(with_op(c, F.lit(number)))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def aggregates(stats: list) -> list[Column]:
    """From (function, field) or (function, field, alias); the default alias is function_field, and count of * counts rows."""
    out = []
    for fn, field, *alias in stats:
        name = alias[0] if alias else f"{fn}_{'all' if field == '*' else field.replace('.', '_')}"
        out.append((F.count(F.lit(1)) if field == "*" else FUNCTIONS[fn](F.col(field))).alias(name))
    return out


def stats(df: DataFrame, functions: list, by: list[str] | None = None) -> DataFrame:
    """Global or grouped statistics, one flat row for each group."""
    return df.groupBy(*by).agg(*aggregates(functions)) if by else df.agg(*aggregates(functions))


def sort(df: DataFrame, *fields: str) -> DataFrame:
    """`-field` sorts descending; nulls come last either way."""
    return df.orderBy(*(F.desc_nulls_last(f[1:]) if f.startswith("-") else F.asc_nulls_last(f) for f in fields))


def search(
    df: DataFrame, tenant: str, earliest: str | datetime | None = None, latest: str | datetime | None = None, where: Column | str | None = None, functions: list | None = None,
    by: list[str] | None = None, order: list[str] | None = None, head: int | None = None, as_of: datetime | None = None,
) -> DataFrame:
    """source, range, where, stats, sort, head. Without a range, the last 24 hours before as_of; head counts if positive."""
    if head is not None and (head < 0 or head > MOST_ROWS):
        raise ValueError(f"head must be from 0 to {MOST_ROWS}")
    if as_of is None:
        as_of = datetime.utcnow() if not isinstance(latest, datetime) else latest
    start = resolve_time(earliest, as_of) if earliest is not None else as_of - timedelta(hours=24)
    out = in_range(for_tenant(df, tenant), start, resolve_time(latest, as_of) if latest is not None else as_of)
    if where is not None:
        out = out.where(F.expr(where) if isinstance(where, str) else where)
    if functions:
        out = stats(out, functions, by)
    if order:
        out = sort(out, *order)
    return out.limit(head) if head else out


# ---------------------------------------------------------------- pages


def clamp(size: int) -> int:
    return max(1, min(MOST_ROWS, size))


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("time"), F.asc_nulls_last("uuid"))


def page(df: DataFrame, offset: int, size: int, more: bool = False) -> DataFrame:
    """Rows offset to offset + size of the newest-first order; with more, one row further tells whether there is a next page."""
    return newest_first(df).offset(max(0, offset)).limit(clamp(size) + more)


def page_after(df: DataFrame, last_time: datetime, last_id: str, size: int) -> DataFrame:
    """The page after the row (last_time, last_id): a filter, so it costs the same however deep the page lies."""
    t = F.lit(last_time).cast(df.schema["time"].dataType)
    return newest_first(df.where((F.col("time") < t) | ((F.col("time") == t) & (F.col("uuid") > last_id)))).limit(clamp(size))


def encode_cursor(last_id: str | None, last_time: str | None, offset: int) -> str:
    return base64.b64encode(json.dumps({"lastId": last_id, "lastTimestamp": last_time, "offset": offset}).encode()).decode()


def decode_cursor(cursor: str | None) -> dict:
    """What encode_cursor was given; anything else is the first page."""
    try:
        found = json.loads(base64.b64decode(cursor or "", validate=True))
        return {"lastId": found.get("lastId"), "lastTimestamp": found.get("lastTimestamp"), "offset": int(found.get("offset", 0))}
    except (ValueError, TypeError, AttributeError):
        return {"lastId": None, "lastTimestamp": None, "offset": 0}


def newest_page(spark: SparkSession, path: str, tenant: str, size: int, cursor: str | None = None, where: Column | None = None) -> tuple[list, str | None]:
    """(rows, cursor of the next page or None) of a tenant's rows in a tier that is partitioned by day, newest first.

    Days are read from the newest on, one at a time, until the page is full; a cursor knows its day, so the next page begins there and
    no later day is read again. A page's rows, MOST_ROWS at most, are at the driver.
    """
    after, rows, size = _day_cursor(cursor), [], clamp(size)
    days = sorted((n.partition("=")[2] for n in Store(spark, path).names(path) if n.startswith("event_date=") and not n.endswith("__")), reverse=True)
    table = for_tenant(spark.read.parquet(path), tenant)
    for day in days:
        if after and day > after["day"]:
            continue
        own = table.where(F.col("event_date") == F.lit(day).cast("date"))
        if where is not None:
            own = own.where(where)
        if after and day == after["day"]:
            t = F.lit(after["time"]).cast(table.schema["time"].dataType)
            own = own.where((F.col("time") < t) | ((F.col("time") == t) & (F.col("uuid") > after["id"])))
        rows += newest_first(own).limit(size + 1 - len(rows)).collect()
        if len(rows) > size:
            last = rows[size - 1]
            found = {"day": str(last["event_date"]), "time": last["time"].isoformat(sep=" "), "id": last["uuid"]}
            return rows[:size], base64.b64encode(json.dumps(found).encode()).decode()
    return rows, None


def _day_cursor(cursor: str | None) -> dict | None:
    try:
        found = json.loads(base64.b64decode(cursor or "", validate=True))
        return {k: str(found[k]) for k in ("day", "time", "id")}
    except (ValueError, TypeError, KeyError):
        return None
