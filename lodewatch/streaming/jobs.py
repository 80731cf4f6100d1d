"""Streams: sources, watermarks, windowed rules, behaviour scores in keyed state, and sinks that don't repeat themselves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lodewatch.operators import detect, enrich, normalize
from lodewatch.operators.ueba import ALPHA, BETA, MOST_DEVICES, MOST_LOCATIONS, remember
from lodewatch.schema import EVENT, RAW
from lodewatch.streaming import topics

DISORDER = "5 seconds"


def json_stream(spark: SparkSession, schema: StructType, servers: str, topic: str, group: str | None = None, kind: str = "kafka") -> DataFrame:
    """A topic of JSON rows from its earliest offsets: of Kafka (whose package must be on the class path), or with kind `topic` of a folder `servers` (see `topics`)."""
    if kind == "topic":
        topics.register(spark)
        reader = spark.readStream.format("topic").option("path", servers).option("topic", topic)
    else:
        reader = spark.readStream.format(kind).option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
        reader = reader.option("kafka.group.id", group) if group else reader
    return reader.load().select(F.from_json(F.col("value").cast("string"), schema).alias("x")).select("x.*")


def raw_stream(spark: SparkSession, servers: str, topic: str = "raw-events", kind: str = "kafka") -> DataFrame:
    return json_stream(spark, RAW, servers, topic, kind=kind)


def event_stream(spark: SparkSession, servers: str, topic: str = "normalized-events", kind: str = "kafka") -> DataFrame:
    return json_stream(spark, EVENT, servers, topic, kind=kind)


def file_stream(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 1) -> DataFrame:
    """The same from Parquet files as they arrive, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def watermarked(df: DataFrame, disorder: str = DISORDER) -> DataFrame:
    """Event time with bounded disorder; later rows are dropped by stateful operators. A zone-less time is taken as UTC."""
    return df.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", disorder)


def rule_stream(events: DataFrame, rule: detect.Rule) -> DataFrame:
    """(rule_id, tenant_id, window_start, window_end, key, value) of one rule, as windows close; distinct counts are approximate.

    The selection is applied first, so time moves on with the rows that the rule selects.
    """
    return detect.run_rules(watermarked(events), [rule], exact=False)


def write_json(df: DataFrame, checkpoint: str, servers: str, topic: str, key: str = "id", kind: str = "kafka"):
    """Rows as JSON to a topic, of Kafka or with kind `topic` of a folder. Kafka's producer waits for all replicas, so a failed batch is sent again, not lost; a folder has each batch once."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))
    if kind == "topic":
        topics.register(df.sparkSession)
        name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
        return rows.writeStream.format("topic").option("path", servers).option("topic", topic).option("writer", name).option("checkpointLocation", checkpoint).trigger(processingTime="60 seconds")
    writer = rows.writeStream.format(kind).option("kafka.bootstrap.servers", servers).option("topic", topic)
    return writer.option("kafka.acks", "all").option("kafka.enable.idempotence", "true").option("kafka.compression.type", "lz4").option("checkpointLocation", checkpoint).trigger(processingTime="60 seconds")


def put_batch(batch: DataFrame, number: int, path: str, query: str, time: str = "time") -> None:
    """Writes a batch to path/batch=<query>-<number>/day=...: the same batch again replaces itself, so nothing of the table is read and rows may have any keys or none."""
    batch.withColumn("day", F.to_date(time)).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={query}-{number:012d}")


def write_batches(df: DataFrame, path: str, checkpoint: str, time: str = "time"):
    """Every batch of a stream once, whatever breaks: by the numbers that the checkpoint gives batches. Another checkpoint is another stream."""
    query = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    return df.writeStream.foreachBatch(lambda batch, number: put_batch(batch, number, path, query, time)).option("checkpointLocation", checkpoint)


def once(df: DataFrame, path: str, key: str, time: str = "time") -> None:
    """Appends the rows whose key isn't in the table yet: a batch that is run again adds nothing, under another checkpoint either.

    Rows without a key are kept apart by all their columns. The table is partitioned by day, and only the days that the batch's rows fall into are looked through, so a batch costs
    the same however long the table's history is. Rows without a time have a partition of their own.
    """
    spark = df.sparkSession
    known = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null-"), F.sha2(F.to_json(F.struct(*df.columns)), 256)))
    rows = df.withColumns({"row_key": known, "day": F.to_date(time)}).dropDuplicates(["row_key"]).persist()
    try:
        days = [r["day"] for r in rows.select("day").distinct().collect()]  # a batch's few days
        if not days:
            return
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        new = rows
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            there = F.col("day").isin([d for d in days if d is not None])
            there = there | F.col("day").isNull() if None in days else there
            new = rows.join(spark.read.schema(rows.schema).parquet(path).where(there).select("row_key"), "row_key", "left_anti")
        new.write.mode("append").partitionBy("day").parquet(path)
    finally:
        rows.unpersist()


def write_once(df: DataFrame, path: str, checkpoint: str, key: str = "id", time: str = "time"):
    return df.writeStream.foreachBatch(lambda batch, _: once(batch, path, key, time)).option("checkpointLocation", checkpoint)


def write_normalized(raw: DataFrame, events_path: str, letters_path: str, checkpoint: str):
    """Raw lines normalised batch by batch: good rows to one table, dead letters to another."""

    def write(batch: DataFrame, _: int) -> None:
        done = normalize.normalize(batch).persist()
        try:
            once(normalize.good_rows(done), events_path, "uuid")
            once(normalize.dead_letters(done), letters_path, "id", "failed_at")
        finally:
            done.unpersist()

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


# ---------------------------------------------------------------- behaviour in state

SCORED = "uuid string, time timestamp, tenant_id string, actor_user string, ueba_score double"
NUMBERS = "m double, s double, lm double, ls double, n long, last_seen timestamp"
#: A profile is forgotten when events are so much newer than its last; rows later than LATE are left out of scoring.
EXPIRES_MS, LATE = 90 * 24 * 3600 * 1000, "1 day"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _before(x: np.ndarray, taken: np.ndarray, m: float, s: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Means and deviations before each of a user's values, from (m, s), and those after the last; values not taken age nothing.

    As in ueba: running sums scaled by BETA^-n, in runs short enough for doubles.
    """
    means, stds, v = np.empty(len(x)), np.empty(len(x)), s * s
    for a in range(0, len(x), RUN):
        own, on = x[a : a + RUN], taken[a : a + RUN].astype(float)
        k = np.cumsum(on) - on
        power = BETA**k
        shifted = lambda values: np.concatenate([[0.0], np.cumsum(values)])
        sums = shifted(on * own / (power * BETA))
        mean = power * (m + ALPHA * sums[:-1])
        added = shifted(on * ALPHA * BETA**2 * (own - mean) ** 2 / (power * BETA))
        means[a : a + RUN], stds[a : a + RUN] = mean, np.sqrt(power * (v + added[:-1]))
        end = BETA ** on.sum()
        m, v = end * (m + ALPHA * sums[-1]), end * (v + added[-1])
    return means, stds, m, float(np.sqrt(v))


RUN = 1024


def _scored(rows: pd.DataFrame, numbers: tuple, places: dict, devices: dict) -> tuple[pd.DataFrame, tuple]:
    """Rows of one user in time order, each against the profile before it; places and devices take the new ones in."""
    m, s, lm, ls, n, _ = numbers
    volume = rows["bytes_out"].fillna(0).to_numpy(float) / 1e6
    login = (rows["category_name"] == "authentication").to_numpy()
    means, stds, m, s = _before(volume, volume > 0, m, s)
    login_means, login_stds, lm, ls = _before(np.ones(len(rows)), login, lm, ls)
    off = lambda value, mean, std: np.abs(np.divide(value - mean, std, out=np.zeros(len(rows)), where=std != 0))
    new = lambda known, column, most: np.array([remember(known, x, most) for x in rows[column].astype(object).where(rows[column].notna(), None)], bool)
    failed = login & (rows["outcome"] == "failure").to_numpy()
    score = 0.3 * (off(volume, means, stds) > 3) + 0.2 * (off(1.0, login_means, login_stds) > 3) + 0.2 * new(places, "src_location", MOST_LOCATIONS)
    score = score + 0.15 * new(devices, "device_id", MOST_DEVICES) + 0.3 * rows["privilege_escalation"].fillna(False).to_numpy(bool) + 0.15 * failed
    return rows.assign(ueba_score=np.minimum(1.0, score)), (m, s, lm, ls, n + len(rows), rows["time"].iloc[-1])


class Scores(StatefulProcessor):
    """A user's profile: its numbers as a value, places and devices as lists, and a timer that ends it EXPIRES_MS of event time after the last event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", NUMBERS)
        self.places, self.devices = handle.getListState("places", "x string"), handle.getListState("devices", "x string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["time", "uuid"])
        numbers = self.numbers.get() if self.numbers.exists() else (0.0, 1.0, 0.0, 1.0, 0, None)
        known = [dict.fromkeys(x[0] for x in state.get()) if state.exists() else {} for state in (self.places, self.devices)]
        scored, after = _scored(own, tuple(numbers), *known)
        self.numbers.update(after)
        for state, values in zip((self.places, self.devices), known):
            state.put([(x,) for x in values])
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(max(int(after[-1].timestamp() * 1000) + EXPIRES_MS, timerValues.getCurrentWatermarkInMs() + 1))
        yield scored[["uuid", "time", "tenant_id", "actor_user", "ueba_score"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.numbers, self.places, self.devices):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def score_stream(events: DataFrame) -> DataFrame:
    """Scores of flat events by (tenant, user): each against the profile in state, which then takes it in and expires after EXPIRES_MS of event time.

    State is in RocksDB, so it needn't fit in memory; the session's state store is set to it, as typed state has no other.
    """
    events.sparkSession.conf.set(STORE, ROCKSDB)
    rows = watermarked(events.where(F.col("actor_user").isNotNull()), LATE)
    return rows.groupBy("tenant_id", "actor_user").transformWithStateInPandas(Scores(), SCORED, "Append", "EventTime")


def detection_job(events: DataFrame, intel: DataFrame, alerts_path: str, scored_path: str, checkpoint: str, threshold: float = 0.7):
    """Events with threat intelligence (a stream-static join) scored by behaviour; scores and alerts go to tables of their own."""
    known = enrich.enrich_threat_intel(events, intel, "dst_ip")
    scored = score_stream(known)

    query = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            put_batch(kept, number, scored_path, query)
            alerts = kept.where(F.col("ueba_score") >= threshold).withColumn("id", F.sha2(F.concat_ws("|", F.lit("ueba"), "tenant_id", "uuid"), 256))
            put_batch(alerts, number, alerts_path, query)
        finally:
            kept.unpersist()

    return scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

