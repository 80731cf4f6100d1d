import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodewatch.operators import detect, ueba
from lodewatch.schema import EVENT, RAW
from lodewatch.sources import views
from lodewatch.streaming import jobs, topics


def drain(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert not q.isActive
    return q


def ordered_files(df, path, n=3):
    df = df.withColumn("time", F.col("time").cast("timestamp"))
    bounds = df.approxQuantile("t", [i / n for i in range(n + 1)], 0.0)
    for i in range(n):
        part = df.where((F.col("t") >= bounds[i]) & ((F.col("t") < bounds[i + 1]) | F.lit(i == n - 1)))
        part.drop("t").coalesce(1).write.mode("append").parquet(path)
    return df.drop("t").schema


def test_scores_in_state_are_those_of_the_batch(spark, sf, tmp_path):
    e = views.flat_events(spark, sf)
    schema = ordered_files(e.withColumn("t", F.unix_millis(F.col("time").cast("timestamp")).cast("double")), str(tmp_path / "in"))
    drain(jobs.write_once(jobs.score_stream(jobs.file_stream(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "cp"), "uuid"))
    got = {r["uuid"]: round(r["ueba_score"], 6) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["uuid"]: round(r["ueba_score"], 6) for r in ueba.score_history(e).collect()}
    assert got == want


def test_rule_on_a_stream_and_late_rows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(str(i), start + timedelta(seconds=i), "t", 3002, 3, "failure", "1.1.1.1") for i in range(10)] + [("far", start + timedelta(hours=2), "t", 3002, 3, "failure", "2.2.2.2")]
    kind = "uuid string, time timestamp, tenant_id string, class_uid int, category_uid int, outcome string, src_ip string"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    rule = next(r for r in detect.load_rules() if r.id == "brute-force")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        found = jobs.rule_stream(jobs.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema), rule)
        drain(found.withColumn("id", F.concat_ws("|", "rule_id", "tenant_id", "window_start")).writeStream.foreachBatch(lambda b, _: jobs.once(b, out, "id", "window_start")).option("checkpointLocation", cp))
        return spark.read.parquet(out).collect()

    assert [(r["key"], r["value"]) for r in run()] == [("1.1.1.1", 10)]
    late = [("late", start + timedelta(seconds=5), "t", 3002, 3, "failure", "1.1.1.1"), ("end", start + timedelta(hours=9), "t", 3002, 3, "failure", "2.2.2.2")]
    spark.createDataFrame(late, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert [(r["key"], r["value"]) for r in run()] == [("1.1.1.1", 10)]


def test_normalising_a_stream_twice_adds_nothing(spark, sf, tmp_path):
    raw = views.raw_logs(spark, sf).drop("n").limit(200).withColumn("data", F.when(F.col("raw_id").cast("long") % 9 == 0, F.lit("CEF:cut")).otherwise(F.col("data")))
    raw.write.parquet(str(tmp_path / "in"))
    for cp in ("cp1", "cp2"):
        stream = jobs.file_stream(spark, str(tmp_path / "in"), raw.schema)
        drain(jobs.write_normalized(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / cp)))
    good, bad = spark.read.parquet(str(tmp_path / "good")).count(), spark.read.parquet(str(tmp_path / "bad")).count()
    assert good + bad == 200 and bad > 0


def test_detection_job(spark, sf, tmp_path):
    e = views.flat_events(spark, sf).withColumn("time", F.col("time").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), e.schema)
    drain(jobs.detection_job(stream, views.threat_intel(spark, sf), str(tmp_path / "alerts"), str(tmp_path / "scored"), str(tmp_path / "cp"), 0.6))
    assert spark.read.parquet(str(tmp_path / "scored")).count() == e.count()
    assert spark.read.parquet(str(tmp_path / "alerts")).count() > 0


def test_a_profile_expires(spark, tmp_path):
    kind = "uuid string, time timestamp, tenant_id string, actor_user string, bytes_out long, category_name string, outcome string, src_location string, device_id string, privilege_escalation boolean"
    row = lambda i, day, user: (i, datetime(2024, 1, 1) + timedelta(days=day), "t", user, 1, "network", "success", "here", "mine", False)
    (tmp_path / "in").mkdir()
    scored = jobs.score_stream(jobs.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema))
    for n, rows in enumerate(([row("a", 0, "u"), row("b", 1, "u")], [row("c", 200, "v")], [row("d", 201, "v"), row("e", 202, "u")])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(jobs.write_once(scored, str(tmp_path / "out"), str(tmp_path / "cp"), "uuid"))
    got = {r["uuid"]: round(r["ueba_score"], 2) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": 0.35, "b": 0.0, "c": 0.35, "d": 0.0, "e": 0.35}  # u's profile was gone by then


def topic_rows(spark, root, name):
    return sorted(json.loads(line)["value"] for f in spark.sparkContext.wholeTextFiles(f"{root}/{name}/partition=*/*.jsonl").values().collect() for line in f.split("\n") if line)


def test_a_topic_is_written_once_and_read_from_where_it_was_left(spark, sf, tmp_path):
    """Lines written in batches, normalised through the topic, stopped, added to and started again; a batch that is sent again adds nothing."""
    root, sent = str(tmp_path / "broker"), 0
    raw = views.raw_logs(spark, sf).drop("n").limit(120).persist()
    columns = [f.name for f in RAW.fields]
    for n in range(2):
        raw.where(F.col("raw_id").cast("long") % 2 == n).select(*(c for c in raw.columns)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.file_stream(spark, str(tmp_path / "in"), raw.schema).select(*(F.col(c) if c in raw.columns else F.lit(None).cast(RAW[c].dataType).alias(c) for c in columns))
        writer = jobs.write_json(stream, str(tmp_path / "cp-out"), root, "raw-events", "raw_id", kind="topic").option("partitions", "3")
        drain(writer)
        sent = raw.where(F.col("raw_id").cast("long") % 2 <= n).count()
        assert len(topic_rows(spark, root, "raw-events")) == sent
        drain(jobs.write_batches(jobs.raw_stream(spark, root, kind="topic"), str(tmp_path / "read"), str(tmp_path / "cp-in"), "arrived"))
        got = spark.read.parquet(str(tmp_path / "read"))
        assert got.count() == got.select("raw_id").distinct().count() == sent
    want = {(r["raw_id"], r["data"]) for r in raw.collect()}
    assert {(r["raw_id"], r["data"]) for r in got.collect()} == want
    # the last batch again, as after a driver that broke off before the checkpoint had it
    commits = tmp_path / "cp-out" / "commits"
    last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (commits / f".{last.name}.crc").unlink(missing_ok=True)
    drain(writer)
    assert len(topic_rows(spark, root, "raw-events")) == sent


def test_a_writer_that_broke_off_while_it_moved_files(tmp_path):
    options = {"path": str(tmp_path), "topic": "t", "writer": "w", "partitions": "2"}
    writer = topics.Writer(options, ["key", "value"])
    first = [writer.write(iter([(f"k{i}", f"v{i}") for i in range(k, k + 5)])) for k in (0, 5)]
    moved, real = [], topics.Folder(options).fs

    class Breaks:
        def __getattr__(self, name):
            if name == "move" and len(moved) == 2:
                raise OSError("broken off")
            if name == "move":
                moved.append(name)
            return getattr(real, name)

    folder, made = topics.Folder(options), topics.Folder.__init__

    def init(self, o):
        made(self, o)
        self.fs = Breaks()

    topics.Folder.__init__ = init
    try:
        with pytest.raises(OSError):
            writer.commit(first, 0)
    finally:
        topics.Folder.__init__ = made
    again = [writer.write(iter([(f"k{i}", f"v{i}") for i in range(k, k + 5)])) for k in (0, 5)]
    writer.commit(again, 0)
    writer.commit([writer.write(iter([(None, "last")]))], 1)
    reader = topics.Reader(options)
    end = reader.latestOffset()
    got = [row for part in reader.partitions({}, end) for row in reader.read(part)]
    assert sorted(v for _, v, _, _ in got) == sorted([*(f"v{i}" for i in range(10)), "last"]) and sum(end.values()) == 11
    assert [(p, o) for _, _, p, o in got] == [(p, o) for p in sorted(int(x) for x in end) for o in range(end[str(p)])]
    assert not reader.partitions(end, reader.latestOffset()) and not [n for n in folder.names("_aside") if n.endswith(".jsonl")]


def test_events_and_alerts_through_topics(spark, sf, tmp_path):
    """Events of a topic scored in state, and alerts of a rule sent to another."""
    root = str(tmp_path / "broker")
    e = views.events(spark, sf).limit(50)
    typed = e.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in e.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT.fields))
    typed.coalesce(1).write.parquet(str(tmp_path / "in"))
    drain(jobs.write_json(jobs.file_stream(spark, str(tmp_path / "in"), typed.schema), str(tmp_path / "cp1"), root, "normalized-events", "uuid", kind="topic"))
    alerts = jobs.event_stream(spark, root, kind="topic").where("severity >= 2").select(F.sha2("uuid", 256).alias("id"), "uuid", "severity")
    drain(jobs.write_json(alerts, str(tmp_path / "cp2"), root, "alerts", kind="topic"))
    want = {r["uuid"] for r in typed.where("severity >= 2").collect()}
    assert {json.loads(x)["uuid"] for x in topic_rows(spark, root, "alerts")} == want and want


def test_a_batch_again_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([(None, datetime(2024, 1, 1)), (None, datetime(2024, 1, 1)), ("a", None)], "id string, time timestamp")
    for number in (0, 1, 1, 0):
        jobs.put_batch(rows, number, str(tmp_path / "out"), "q")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    for _ in range(2):  # by key, rows without one by all their columns
        jobs.once(rows, str(tmp_path / "keyed"), "id")
    assert sorted(str(r["id"]) for r in spark.read.parquet(str(tmp_path / "keyed")).collect()) == ["None", "a"]


def test_state_is_that_of_the_batch_after_a_restart_with_late_rows(spark, tmp_path):
    """Two users, three runs; rows more than a day late are left out by the stream, and so by the batch it is held against."""
    kind = "uuid string, time timestamp, tenant_id string, actor_user string, bytes_out long, category_name string, outcome string, src_location string, device_id string, privilege_escalation boolean"
    r, start = random.Random(9), datetime(2024, 1, 1)
    row = lambda i, minute: (f"{i:04d}", start + timedelta(minutes=minute), "t", r.choice("uv"), r.choice([0, 10**6, 5 * 10**8, None]), r.choice(["network", "authentication"]), r.choice(["success", "failure"]), r.choice(["here", "there", None]), str(r.randrange(30)), r.random() < 0.1)
    parts = [[row(i, i) for i in range(300)], [row(300 + i, 4000 + i) for i in range(300)], [row(900, 10), *(row(600 + i, 4300 + i) for i in range(50))]]
    (tmp_path / "in").mkdir()
    scored = jobs.score_stream(jobs.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema))
    for rows in parts:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(jobs.write_batches(scored, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = {x["uuid"]: round(x["ueba_score"], 6) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    kept = spark.createDataFrame([x for p in parts for x in p if x[0] != "0900"], kind)
    assert got == {x["uuid"]: round(x["ueba_score"], 6) for x in ueba.score_history(kept).collect()}
