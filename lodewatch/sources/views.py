"""The event model over the given tables: events, indicators, tenants, alerts and vendor log lines derived from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2024, 1, 31)
STATUSES = ("open", "acknowledged", "in_progress", "resolved", "false_positive")

EVENTS_SQL = """
SELECT CAST(event_id AS STRING) AS uuid, ts AS time, CONCAT('tenant-', CAST(user_id % 4 AS STRING)) AS tenant_id,
  CASE WHEN event_type='error' AND value >= 100 THEN 5 WHEN event_type='error' THEN 4 WHEN event_type='purchase' THEN 3 WHEN event_type='signup' THEN 2 ELSE 1 END AS severity,
  CASE WHEN event_type IN ('error','signup') THEN 3002 ELSE 4001 END AS class_uid,
  CASE WHEN event_type IN ('error','signup') THEN 3 ELSE 4 END AS category_uid,
  CASE WHEN event_type IN ('error','signup') THEN 'authentication' ELSE 'network' END AS category_name,
  event_type AS class_name, CASE WHEN event_type='error' THEN 'failure' ELSE 'success' END AS outcome,
  CONCAT('user-', CAST(user_id AS STRING)) AS actor_user,
  CONCAT('10.0.', CAST(user_id % 4 AS STRING), '.', CAST(user_id % 16 AS STRING)) AS src_ip,
  CONCAT('203.0.113.', CAST(k % 64 AS STRING)) AS dst_ip, k AS dst_port, CAST(ROUND(value * 1000000) AS BIGINT) AS bytes_out,
  CONCAT('loc-', CAST(event_id % 7 AS STRING)) AS src_location, CONCAT('dev-', CAST(event_id % 5 AS STRING)) AS device_id,
  (event_type='purchase' AND k >= 95) AS privilege_escalation,
  CONCAT(event_type, ' by user-', CAST(user_id AS STRING), ' on port ', CAST(k AS STRING)) AS message
FROM (SELECT *, CAST({json} AS INT) AS k FROM {source}) e
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat row for each event of the `events` table."""
    return spark.sql(EVENTS_SQL.format(json="get_json_object(props, '$.k')", source="{events}"), events=table(spark, sf_dir, "events"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as nested events; the flat columns that have a place there are gone."""
    e = flat_events(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    meta = {"outcome": "outcome", "status": "outcome", "bytes_transferred": "bytes_out", "src_location": "src_location", "device_id": "device_id", "privilege_escalation": "privilege_escalation"}
    nothing = lambda kind: F.lit(None).cast(kind)
    return e.select(
        "uuid", "time", "tenant_id", "severity", "class_uid", "category_uid", "class_name", "category_name",
        F.struct(F.col("actor_user").alias("user"), F.col("class_name").alias("process"), F.col("uuid").alias("session")).alias("actor"),
        F.struct(F.col("src_ip").alias("ip"), nothing("int").alias("port"), nothing("string").alias("hostname"), nothing("string").alias("mac")).alias("src_endpoint"),
        F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"), nothing("string").alias("hostname"), nothing("string").alias("mac")).alias("dst_endpoint"),
        "message",
        F.create_map(*(x for k, c in meta.items() for x in (F.lit(k), text(c)))).alias("metadata"),
    )


def threat_intel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators: every third of the addresses that events go to; a domain for every fifth class and user, a hash for every seventh."""
    ips = flat_events(spark, sf_dir).select("dst_ip").distinct().withColumn("n", F.split_part("dst_ip", F.lit("."), F.lit(4)).cast("int")).where("n % 3 = 0")
    category = lambda n: F.element_at(F.array(*(F.lit(x) for x in ("botnet", "malware", "phishing", "scanner"))), F.col(n) % 4 + 1)
    row = lambda indicator, kind: (indicator.alias("indicator"), F.lit(kind).alias("kind"), (F.col("n") * 7 % 101).cast("int").alias("reputation"), category("n").alias("category"))
    users = flat_events(spark, sf_dir).select(F.split_part("actor_user", F.lit("-"), F.lit(2)).cast("int").alias("n")).distinct()
    domains = users.where("n % 5 = 0").select(*row(F.concat(F.lit("host-"), F.col("n").cast("string"), F.lit(".example.net")), "domain"))
    hashes = users.where("n % 7 = 0").select(*row(F.sha2(F.concat(F.lit("file-"), F.col("n").cast("string")), 256), "hash"))
    return ips.select(*row(F.col("dst_ip"), "ip")).unionByName(domains).unionByName(hashes)


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each tenant that has events, and one archived."""
    own = flat_events(spark, sf_dir).select("tenant_id").distinct().unionByName(spark.sql("SELECT 'tenant-4' AS tenant_id"))
    n = F.split_part("tenant_id", F.lit("-"), F.lit(2)).cast("int")
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), n + 1)
    return own.select(
        F.col("tenant_id").alias("id"), F.concat(F.lit("Tenant "), n.cast("string")).alias("name"), pick("active", "suspended", "provisioning", "active", "archived").alias("status"),
        F.lit(10000).alias("max_eps"), pick(7, 14, 21, 90, 90).alias("retention_days"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("updated_at"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert for each event of severity 4 or more; its events are its own, the next one and one that is missing."""
    e = flat_events(spark, sf_dir).where("severity >= 4")
    n = F.col("uuid").cast("long")
    return e.select(
        F.concat(F.lit("alert-"), "uuid").alias("id"), "time", "tenant_id", "severity", F.concat(F.lit("Alert on "), "class_name").alias("title"), F.col("message").alias("description"),
        F.lit("rule-severity").alias("rule_id"), F.array("uuid", (n + 1).cast("string"), F.lit("missing")).alias("event_ids"),
        F.element_at(F.array(*(F.lit(s) for s in STATUSES)), (n % 5).cast("int") + 1).alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("acknowledged_at"), F.lit(None).cast("string").alias("acknowledged_by"),
    )


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vendor line for each event, by event id mod 9: (raw_id, data, arrived, tenant_id, vendor_type, metadata) and what it was made from."""
    e = flat_events(spark, sf_dir).withColumn("n", F.col("uuid").cast("long")).withColumn("ms", F.unix_millis(F.col("time").cast("timestamp")))
    t = lambda fmt: f"date_format(time, \"{fmt}\")"
    line = F.expr(f"""
CASE CAST(n % 9 AS INT)
WHEN 0 THEN concat('CEF:0|Acme|Shield|1.0|', class_uid, '|', class_name, '|', severity * 2, '|rt=', ms, ' src=', src_ip, ' spt=4000 dst=', dst_ip, ' dpt=', dst_port, ' suser=', actor_user, ' sproc=', class_name, ' msg=', message)
WHEN 1 THEN concat('%ASA-', 6 - severity, '-302013: Built outbound TCP connection ', uuid, ' for outside:', dst_ip, '/', dst_port, ' (', dst_ip, '/', dst_port, ') to inside:', src_ip, '/4000 (', src_ip, '/4000)')
WHEN 2 THEN concat('{{"eventVersion":"1.08","eventTime":"', {t("yyyy-MM-dd'T'HH:mm:ss'Z'")}, '","eventName":"', initcap(class_name), 'Object","eventSource":"s3.amazonaws.com","awsRegion":"us-east-1","sourceIPAddress":"', src_ip, '","userAgent":"cli","eventID":"', uuid, '","userIdentity":{{"userName":"', actor_user, '","principalId":"p"}}', if(severity >= 4, ',"errorCode":"AccessDenied","errorMessage":"no"', ''), ',"resources":[{{"ARN":"a"}},{{"ARN":"b"}}]}}')
WHEN 3 THEN concat({t("yyyy/MM/dd HH:mm:ss")}, ',serial,seq,TRAFFIC,end,x,y,', src_ip, ',', dst_ip, ',4000,', dst_port, ',a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,', class_name, ',r,', if(severity >= 4, 'deny', 'allow'))
WHEN 4 THEN concat('<', 8 * 4 + (6 - severity), '>1 ', {t("yyyy-MM-dd'T'HH:mm:ss'Z'")}, ' host-', n % 10, ' app ', n, ' ID1 [meta@1 user="', actor_user, '" port="', dst_port, '"] ', message)
WHEN 5 THEN concat('<', 8 * 4 + (6 - severity), '>', {t('MMM d HH:mm:ss')}, ' host-', n % 10, ' app: ', message)
WHEN 6 THEN concat('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="Audit"/><EventID>', 4000 + class_uid % 1000, '</EventID><Level>', severity, '</Level><TimeCreated SystemTime="', {t("yyyy-MM-dd'T'HH:mm:ss'Z'")}, '"/><Computer>host-', n % 10, '</Computer><Channel>Security</Channel></System><EventData><Data Name="SubjectUserName">', actor_user, '</Data><Data Name="NewProcessName">', class_name, '</Data><Data Name="Empty"/><Data Name="LogonId">', uuid, '</Data></EventData></Event>')
WHEN 7 THEN concat('{{"timestamp":"', {t("yyyy-MM-dd'T'HH:mm:ss'Z'")}, '","severity":"', CASE severity WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' ELSE 'info' END, '","message":"', message, '","user":"', actor_user, '","n":', n, ',"nested":{{"a":1}}}}')
ELSE concat('noise ', message) END""")
    return e.select(
        F.col("uuid").alias("raw_id"), line.alias("data"), F.col("time").cast("timestamp").alias("arrived"), "tenant_id", F.lit(None).cast("string").alias("vendor_type"),
        F.create_map(F.lit("ingest"), F.lit("test")).alias("metadata"), "n",
    )
