"""Windows event XML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import LineParser, actor, endpoint, event, let, metadata, windows_severity

ROW = """System struct<EventID: string, Level: int, Computer: string, Channel: string, Provider: struct<_Name: string>, TimeCreated: struct<_SystemTime: string>>,
EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>"""


def _of(row: Column, d: Column) -> Column:
    """d: the event's data that have a name and a value."""

    def x(path: str) -> Column:
        out = row["System"]
        for name in path.split("."):
            out = out[name]
        return out

    last = lambda *names: F.get(F.transform(F.reverse(F.filter(d, lambda y: y["_Name"].isin(*names))), lambda y: y["_VALUE"]), F.lit(0))
    own = F.filter(d, lambda y, i: ~F.exists(F.slice(d, i + 2, F.size(d)), lambda e: e["_Name"] == y["_Name"]))
    data = F.map_from_entries(F.transform(own, lambda y: F.struct(y["_Name"].alias("key"), y["_VALUE"].alias("value"))))
    meta = F.map_concat(F.coalesce(data, F.create_map().cast("map<string,string>")), metadata(parser=F.lit("windows-event"), vendor=F.lit("microsoft"), eventId=x("EventID"), channel=x("Channel"), provider=x("Provider._Name")))
    return event(
        time=F.try_to_timestamp(x("TimeCreated._SystemTime")), severity=windows_severity(x("Level")), class_uid=3001, category_uid=3, class_name="windows_event", category_name="system",
        message=F.concat(F.lit("Windows Event "), F.coalesce(x("EventID"), F.lit("unknown")), F.lit(" from "), F.coalesce(x("Channel"), F.lit("unknown"))),
        actor=actor(last("SubjectUserName", "TargetUserName"), last("ProcessName", "NewProcessName"), last("LogonId")), src=endpoint(None, None, x("Computer")), dst=endpoint(), meta=meta,
        error=F.when(row.isNull() | x("EventID").isNull(), "not a Windows event"),
    )


def _data(row: Column) -> Column:
    return F.filter(row["EventData"]["Data"], lambda y: y["_Name"].isNotNull() & y["_VALUE"].isNotNull())


parse = LineParser(lambda: let(F.from_xml("data", ROW), lambda row: let(_data(row), lambda d: _of(row, d))))
