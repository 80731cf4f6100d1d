"""Column functions shared by operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address formats.
IPV4 = r"^((25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})$"
IPV6 = r"^([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$"
MAC = r"^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"
# Names under which rules know the event's fields.
FIELD_ALIASES = {
    "event_type": "class_uid", "class_uid": "class_uid", "category": "category_uid", "category_uid": "category_uid", "severity": "severity", "tenant_id": "tenant_id", "message": "message",
    "user": "actor.user", "username": "actor.user", "process": "actor.process", "process_name": "actor.process",
    "source_ip": "src_endpoint.ip", "src_ip": "src_endpoint.ip", "sourceip": "src_endpoint.ip",
    "source_port": "src_endpoint.port", "src_port": "src_endpoint.port", "sourceport": "src_endpoint.port",
    "source_hostname": "src_endpoint.hostname", "src_hostname": "src_endpoint.hostname",
    "dest_ip": "dst_endpoint.ip", "dst_ip": "dst_endpoint.ip", "destination_ip": "dst_endpoint.ip", "destip": "dst_endpoint.ip",
    "dest_port": "dst_endpoint.port", "dst_port": "dst_endpoint.port", "destination_port": "dst_endpoint.port", "destport": "dst_endpoint.port",
    "dest_hostname": "dst_endpoint.hostname", "dst_hostname": "dst_endpoint.hostname",
    "outcome": "metadata.outcome", "result": "metadata.outcome",
}
#: Where a flat event row keeps them; what has no place there is null.
FLAT_PLACES = {
    "actor.user": "actor_user", "actor.process": "class_name", "src_endpoint.ip": "src_ip", "dst_endpoint.ip": "dst_ip", "dst_endpoint.port": "dst_port", "metadata.outcome": "outcome",
    "src_endpoint.port": None, "src_endpoint.hostname": None, "dst_endpoint.hostname": None,
}
LEVELS = {"informational": 1, "info": 1, "low": 2, "medium": 3, "high": 4, "critical": 5}


def is_valid_ip(c: Column) -> Column:
    return F.coalesce(c.rlike(IPV4) | c.rlike(IPV6), F.lit(False))


def is_valid_mac(c: Column) -> Column:
    return F.coalesce(c.rlike(MAC), F.lit(False))


def resolve_field(name: str, flat: bool = False) -> Column:
    """The event column of a rule's field name, by alias, without regard to case and outer blanks; an unknown name is null.

    flat: the event is a flat row, of which `bytes_out` can be named, too. Else `metadata.x` reads the map.
    """
    path = FIELD_ALIASES.get(name.strip().lower())
    if flat:
        path = FLAT_PLACES.get(path, path) if path else "bytes_out" if name.strip().lower() == "bytes_out" else None
    if path is None:
        return F.lit(None).cast("string")
    head, _, rest = path.partition(".")
    return F.col("metadata")[rest] if head == "metadata" else F.col(path)


def matches_value(c: Column, value) -> Column:
    """Numbers are compared as doubles, else trimmed strings without case; null only equals null."""
    if value is None:
        return c.isNull()
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.coalesce(c.cast("string").try_cast("double") == float(value), F.lit(False))
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return F.coalesce(F.lower(F.trim(c.cast("string"))) == F.lit(text.strip().lower()), F.lit(False))


def selection_predicate(selection: dict | None, flat: bool = False) -> Column:
    """All of field = value; a list stands for any of its values; nothing to select selects everything."""
    out = F.lit(True)
    for field, value in (selection or {}).items():
        c = resolve_field(field, flat)
        one = F.lit(False)
        for v in value if isinstance(value, list) else [value]:
            one = one | matches_value(c, v)
        out = out & one
    return out


def level_to_severity(c: Column) -> Column:
    out = F.lit(3)
    for level, n in LEVELS.items():
        out = F.when(F.lower(c) == level, n).otherwise(out)
    return out


def tier_of(time: Column, as_of: datetime, hot_days: int = 7, warm_days: int = 90) -> Column:
    """hot, warm or cold by whole days of age."""
    age = F.datediff(F.lit(as_of.date()), F.to_date(time))
    return F.when(age < hot_days, "hot").when(age < warm_days, "warm").otherwise("cold")


def is_known_safe(ip: Column) -> Column:
    """Private networks 10/8, 172.16/12, 192.168/16, and 127.0.0.1."""
    second = F.split_part(ip, F.lit("."), F.lit(2)).try_cast("int")
    return ip.rlike(IPV4) & (ip.startswith("10.") | ip.startswith("192.168.") | (ip.startswith("172.") & second.between(16, 31)) | (ip == "127.0.0.1"))
