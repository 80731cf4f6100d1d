"""Canned event and alert queries, text search, upserts."""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewatch.operators.search import for_tenant, in_range, page


def events_where(df: DataFrame, tenant: str, condition: Column, offset: int = 0, size: int = 100) -> DataFrame:
    """A tenant's events under a condition, newest first."""
    return page(for_tenant(df, tenant).where(condition), offset, size)


def find_by_ids(df: DataFrame, tenant: str, ids: DataFrame) -> DataFrame:
    """The tenant's events with one of the ids (column uuid)."""
    return for_tenant(df, tenant).join(ids.select("uuid").distinct(), "uuid", "left_semi")


#: Letters, marks and digits of all scripts, and the underscore.
WORD = r"\p{L}\p{M}\p{N}_"


def tokens(c: Column) -> Column:
    """Runs of WORD characters, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(c.cast("string"), F.lit(""))), f"[^{WORD}]+"), "")


def query_words(query: str) -> list[str]:
    """The same of a search's words."""
    return "".join(x if x == "_" or unicodedata.category(x)[0] in "LMN" else " " for x in query.lower()).split()


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 3 else 1 if len(term) <= 5 else 2


def text_search(df: DataFrame, query: str, fields: dict[str, float]) -> DataFrame:
    """Rows with a word within edit distance 0, 1 or 2 (by length) of a query word; score: the best field's boost times words found.

    Each field is cut into words once, and each distinct word of it is compared once with every query word of about its length.
    """
    terms = query_words(query)
    if not terms:
        return df.withColumn("score", F.lit(0.0)).where(F.lit(False))
    names = {f: f"_words_{i}" for i, f in enumerate(fields)}
    words = df.withColumns({n: F.array_distinct(tokens(F.col(f))) for f, n in names.items()})
    near = lambda t, w: F.length(t).between(len(w) - edits_allowed(w), len(w) + edits_allowed(w)) & (F.levenshtein(t, F.lit(w), edits_allowed(w)) >= 0)
    has = lambda n, w: F.exists(n, lambda t: near(t, w)).cast("int")
    found = [sum((has(names[f], w) for w in terms), F.lit(0)) * F.lit(boost) for f, boost in fields.items()]
    score = F.greatest(*found) if len(found) > 1 else found[0]
    return words.withColumn("score", score.cast("double")).where("score > 0").drop(*names.values())


#: The fields of an event that are searched, and what they count.
EVENT_FIELDS = {"message": 2.0, "category_name": 1.0, "class_name": 1.0, "actor_user": 1.0, "src_hostname": 1.0, "dst_hostname": 1.0}


def search_events(df: DataFrame, tenant: str, query: str, offset: int = 0, size: int = 100) -> DataFrame:
    """A page of a tenant's flat events that hold a query's words in any of EVENT_FIELDS, newest first; fields that the rows lack hold nothing."""
    own = for_tenant(df, tenant)
    return page(text_search(own, query, {f: b for f, b in EVENT_FIELDS.items() if f in own.columns}), offset, size)


def token_index(df: DataFrame, key: str, field: str) -> DataFrame:
    """(token, key, n): write it sorted by token, and repeated searches read a few of its files instead of every text."""
    return df.select(F.col(key), F.explode(tokens(F.col(field))).alias("token")).groupBy("token", key).agg(F.count("*").alias("n"))


def highlight(c: Column, terms: list[str], size: int = 150, pieces: int = 3) -> Column:
    """Up to `pieces` fragments of `size` characters that hold a term as a whole word, with terms in <em>; terms are taken literally."""
    either = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    fragments = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length(c) - 1).cast("int")), F.lit(size)), lambda i: F.substring(c, i + 1, F.lit(size)))
    held = F.filter(fragments, lambda x: x.rlike(rf"(?iu)(?<![{WORD}])({either})(?![{WORD}])"))
    return F.transform(F.slice(held, 1, pieces), lambda x: F.regexp_replace(x, rf"(?iu)(?<![{WORD}])({either})(?![{WORD}])", "<em>$1</em>"))


def to_event_struct(df: DataFrame) -> DataFrame:
    """(event, extra): the flat event as one struct, and columns that have no place in it as a map of text."""
    placed = ("uuid", "time", "tenant_id", "severity", "class_uid", "category_uid", "class_name", "category_name", "message")
    nested = {"actor_user", "src_ip", "dst_ip", "dst_port"}
    rest = [c for c in df.columns if c not in placed and c not in nested]
    event = F.struct(
        *placed, F.struct(F.col("actor_user").alias("user")).alias("actor"), F.struct(F.col("src_ip").alias("ip")).alias("src_endpoint"), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port")).alias("dst_endpoint")
    )
    return df.select(event.alias("event"), F.create_map(*(x for c in rest for x in (F.lit(c), F.col(c).cast("string")))).alias("extra"))


# ---------------------------------------------------------------- alerts


def find_alerts(alerts: DataFrame, tenant: str, severity: int | None = None, status: str | None = None, start: datetime | None = None, end: datetime | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    if offset < 0 or not 0 < limit <= 10_000:
        raise ValueError("offset must not be negative, and limit from 1 to 10000")
    out = for_tenant(alerts, tenant)
    if severity is not None:
        out = out.where(F.col("severity") == severity)
    if status is not None:
        out = out.where(F.col("status") == status)
    if start is not None and end is not None:
        out = in_range(out, start, end)
    return out.orderBy(F.desc_nulls_last("time"), "id").offset(offset).limit(limit)


def alert_by_id(alerts: DataFrame, tenant: str, alert_id: str) -> DataFrame:
    """The tenant's alert of this id; another tenant's isn't found."""
    return for_tenant(alerts, tenant).where(F.col("id") == F.lit(alert_id)).limit(1)


def alert_events(alerts: DataFrame, events: DataFrame, keep_missing: bool = True) -> DataFrame:
    """(alert_id, position, event_id, message, severity): an alert's events of its own tenant, in order; missing ones are null or left out."""
    each = alerts.select(F.col("id").alias("alert_id"), "tenant_id", F.posexplode("event_ids").alias("position", "event_id"))
    own = events.select(F.col("uuid").alias("event_id"), "tenant_id", "message", "severity")
    return each.join(own, ["event_id", "tenant_id"], "left" if keep_missing else "inner").select("alert_id", "position", "event_id", "message", "severity")


def upsert(base: DataFrame, updates: DataFrame, key: str, newest: str) -> DataFrame:
    """One row for each key: the one that is newest, and of equally new ones the update."""
    both = base.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(newest), F.desc("_new")))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_new")


def acknowledge(alerts: DataFrame, tenant: str, ids: list[str], by: str, at: datetime) -> DataFrame:
    """The table with the tenant's alerts of these ids acknowledged; an id that isn't the tenant's raises."""
    wanted = (F.col("tenant_id") == tenant) & F.col("id").isin(*ids)
    there = alerts.where(wanted).select("id").distinct().count()
    if there < len(set(ids)):
        raise LookupError("no such alert of this tenant")
    return alerts.withColumns(
        {
            "status": F.when(wanted, "acknowledged").otherwise(F.col("status")),
            "acknowledged_at": F.when(wanted, F.lit(at).cast(alerts.schema["acknowledged_at"].dataType)).otherwise(F.col("acknowledged_at")),
            "acknowledged_by": F.when(wanted, by).otherwise(F.col("acknowledged_by")),
        }
    )
