"""AWS CloudTrail records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import LineParser, actor, endpoint, event, let, metadata

RECORD = """eventTime string, eventName string, eventSource string, eventType string, eventID string, requestID string, awsRegion string, recipientAccountId string, sourceIPAddress string, userAgent string,
errorCode string, errorMessage string, resources array<struct<ARN: string>>,
userIdentity struct<userName: string, principalId: string, arn: string, sessionContext: struct<sessionIssuer: struct<userName: string>>>"""


def _of(record: Column) -> Column:
    def r(path: str) -> Column:
        out = record
        for name in path.split("."):
            out = out[name]
        return out

    code = r("errorCode")
    severity = F.when(code.rlike("AccessDenied|Unauthorized"), 4).when(code.isNotNull(), 3).when(r("eventName").rlike("^(Delete|Terminate|Modify|Update)"), 2).otherwise(1)
    message = F.concat(F.coalesce(r("eventName"), F.lit("unknown")), F.lit(" on "), F.coalesce(r("eventSource"), F.lit("unknown")), F.when(code.isNotNull(), F.concat(F.lit(" - Error: "), code, F.lit(" ("), F.coalesce(r("errorMessage"), F.lit("")), F.lit(")"))).otherwise(""))
    return event(
        time=F.try_to_timestamp(r("eventTime")), severity=severity, class_uid=3005, category_uid=3, class_name=r("eventName"), category_name="cloud", message=message,
        actor=actor(F.coalesce(r("userIdentity.userName"), r("userIdentity.principalId"), r("userIdentity.arn")), r("userAgent"), r("userIdentity.sessionContext.sessionIssuer.userName")),
        src=endpoint(r("sourceIPAddress")), dst=endpoint(),
        meta=metadata(parser=F.lit("cloudtrail"), eventId=r("eventID"), eventType=r("eventType"), region=r("awsRegion"), accountId=r("recipientAccountId"), requestId=r("requestID"), resourceCount=F.when(r("resources").isNotNull(), F.size(r("resources")))),
        error=F.when(record.isNull() | r("eventName").isNull(), "not a CloudTrail record"),
    )


parse = LineParser(lambda: let(F.from_json("data", RECORD), _of))
