"""Profiles of users with long histories, against the recursive SQL twins."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodewatch.operators import ueba
from lodewatch.plans import catalog
from lodewatch.sources import views


def plain(rows):
    return sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.fixture(scope="module")
def long_histories(tmp_path_factory):
    """User 1: 4,000 events, every twentieth a login. User 2: 500 logins, then 450 others. User 3: two events. No user: one."""
    kinds = [(1, "signup" if i % 20 == 0 else "view") for i in range(4000)] + [(2, "signup" if i < 500 else "view") for i in range(950)] + [(3, "signup"), (3, "view"), (None, "view")]
    start, n = datetime(2024, 1, 1), range(len(kinds))
    columns = {"event_id": list(n), "ts": [start + timedelta(minutes=i) for i in n], "user_id": [u for u, _ in kinds], "event_type": [k for _, k in kinds], "value": [(0.0 if i < 3000 and i % 3 else 1.0 + i * 7 % 50) for i in n], "props": [f'{{"k": {i % 97}}}' for i in n]}
    path = tmp_path_factory.mktemp("histories")
    pq.write_table(pa.table(columns, schema=pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])), path / "events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["u_ewma", "u_score_history", "u_rule_score", "u_alerts"])
def test_every_event_counts(spark, long_histories, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{long_histories}/events.parquet' WHERE user_id IS NOT NULL")
    found = catalog.QUERIES[name](spark, long_histories)
    want = con.sql(catalog.ORACLE_SQL[name])
    got = [r for r in found.select(*want.columns).collect() if r.asDict().get("uuid") != "4952" and r.asDict().get("actor_user", "") is not None]
    assert plain(got) == plain(want.fetchall())
    if name == "u_ewma":
        logins = {r["actor_user"]: (r["avg_logins"], r["std_logins"]) for r in found.collect()}
        assert logins["user-1"][0] > 0.999 and logins["user-2"] == (1.0, 0.0)


def plain_history(rows):
    """By the definition, event by event: (m, s, lm, ls, new place, new device) before each."""
    a, out, at = 2 / 31, {}, {}
    for user, time, uuid, v, kind, place, device in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        m, s, lm, ls, places, devices = at.get(user, (0.0, 1.0, 0.0, 1.0, {}, {}))
        out[uuid] = (m, s, lm, ls, ueba.remember(places, place, ueba.MOST_LOCATIONS), ueba.remember(devices, device, ueba.MOST_DEVICES))
        if v > 0:
            new = a * v + (1 - a) * m
            m, s = new, math.sqrt(a * (v - new) ** 2 + (1 - a) * s * s)
        if kind == "authentication":
            new = a + (1 - a) * lm
            lm, ls = new, math.sqrt(a * (1 - new) ** 2 + (1 - a) * ls * ls)
        at[user] = (m, s, lm, ls, places, devices)
    return out, at


@pytest.mark.parametrize("bits", [(10, 10), (2, 1)])
def test_pieces_give_what_the_definition_gives(spark, monkeypatch, bits):
    """A user with most events, more places than are kept and none at all, repeated times, and values from tiny to huge; pieces of 1,024 and of 4 events."""
    monkeypatch.setattr(ueba, "PIECE_BITS", bits[0])
    monkeypatch.setattr(ueba, "PART_BITS", bits[1])
    r, start = random.Random(3), datetime(2024, 1, 1)
    users = ["hot"] * 4 + ["b", "c"]
    rows = [(r.choice(users), start + timedelta(minutes=i // 3), f"{i:05d}", r.choice([0.0, 1e-5, 0.5, 3.0, 900.0, 1e6]), r.choice(["authentication", "network"]), r.choice([None, *map(str, range(80 if i % 2 else 5))]), str(r.randrange(12))) for i in range(5000)]
    rows += [("none", start, f"n{i}", 0.0, "network", None, None) for i in range(3)]
    df = spark.createDataFrame([("t", u, t, i, int(v * 1e6), k, p, d) for u, t, i, v, k, p, d in rows], "tenant_id string, actor_user string, time timestamp, uuid string, bytes_out long, category_name string, src_location string, device_id string").repartition(7)
    want, end = plain_history(rows)
    for x in ueba._with_profiles(df).collect():
        m, s, lm, ls, place, device = want[x["uuid"]]
        assert [x["_p"]["m"], x["_p"]["s"], x["_q"]["m"], x["_q"]["s"]] == pytest.approx([m, s, lm, ls], rel=1e-9, abs=1e-9)
        assert (x["_new_place"], x["_new_device"]) == (place, device)
    for x in ueba.build_profiles(df).collect():
        m, s, lm, ls, places, devices = end[x["actor_user"]]
        assert [x["avg_volume"], x["std_volume"], x["avg_logins"], x["std_logins"]] == pytest.approx([m, s, lm, ls], rel=1e-9, abs=1e-9)
        assert x["known_locations"] == sorted(p for p in places if p is not None) and x["known_devices"] == sorted(d for d in devices if d is not None)


def test_one_user_is_many_tasks(spark):
    """200,000 events of one user: the joins and windows go by pieces, and no Python runs where places are few."""
    df = spark.range(200_000).select(F.lit("t").alias("tenant_id"), F.lit("u").alias("actor_user"), F.timestamp_seconds("id").alias("time"), F.col("id").cast("string").alias("uuid"), (F.col("id") % 1000 * 1000).alias("bytes_out"), F.lit("network").alias("category_name"), (F.col("id") % 7).cast("string").alias("src_location"), F.lit("d").alias("device_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ueba._with_profiles(df)
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and "Arrow" not in found._jdf.queryExecution().executedPlan().toString()
        tasks = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("_p.s")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 4 and max(tasks) < 100_000 and sum(tasks) == 200_000


def test_events_without_a_user_pass_and_the_pattern_feature_is_zero(spark, long_histories):
    scored = ueba.score_history(views.flat_events(spark, long_histories)).collect()
    assert [r["ueba_score"] for r in scored if r["actor_user"] is None] == [None] and len(scored) == 4953
    assert {r["f7"] for r in scored if r["actor_user"] is not None} == {0.0}
