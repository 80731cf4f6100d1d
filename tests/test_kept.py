"""Kept rollups, pages by day, and sealed manifests: what is read, and what shows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lodewatch.operators import aggregate, search
from lodewatch.sources import moves, seals, tiers, views


def test_a_rollup_reads_new_events_and_the_days_asked_for(spark, sf, tmp_path):
    e, root = views.flat_events(spark, sf).withColumn("score", F.lit(2.0)), str(tmp_path / "rollup")
    parts = [e.where(F.col("uuid").cast("long") % 3 == k) for k in range(3)]
    for k in (0, 1, 2, 1):
        aggregate.add_to_rollup(parts[k], root, f"n{k}")
    keys = ["event_hour", "tenant_id", "category_name", "severity"]
    got = aggregate.read_rollup(spark, root, keys)
    want = aggregate.merge_rollup(aggregate.rollup_state(e), keys)
    plain = lambda df: sorted(map(str, df.select(*keys, "event_count", "unique_users", "unique_src_ips", "avg_score").collect()))
    assert plain(got) == plain(want)
    some = aggregate.read_rollup(spark, root, keys, date(2024, 1, 3), date(2024, 1, 3))
    assert plain(some) == plain(want.where("to_date(event_hour) = '2024-01-03'"))
    assert "PartitionFilters: [isnotnull(event_day" in some._jdf.queryExecution().executedPlan().toString()


def test_pages_read_the_days_they_need(spark, tmp_path, monkeypatch):
    rows = [(f"{i:04d}", datetime(2024, 1, 1 + i // 100, i % 24, i % 3), "t" if i % 10 else "other") for i in range(1000)]
    df = spark.createDataFrame(rows, "uuid string, time timestamp, tenant_id string")
    tiers.write_tier(df, str(tmp_path), "hot")
    want = [r["uuid"] for r in search.newest_first(df.where("tenant_id = 't'")).collect()]
    read = []
    real = search.newest_first
    monkeypatch.setattr(search, "newest_first", lambda df: (read.append(1), real(df))[1])
    got, cursor, days = [], None, []
    while True:
        read.clear()
        page, cursor = search.newest_page(spark, str(tmp_path / "hot"), "t", 80, cursor)
        got += [r["uuid"] for r in page]
        days.append(len(read))
        if cursor is None:
            break
    assert got == want and max(days) <= 2
    assert search.newest_page(spark, str(tmp_path / "hot"), "nobody", 5) == ([], None)
    assert [r["uuid"] for r in search.newest_page(spark, str(tmp_path / "hot"), "t", 3, "not a cursor", F.col("uuid") < "0150")[0]] == [u for u in want if u < "0150"][:3]


def test_seals_show_edits_and_cuts(spark, tmp_path):
    path = str(tmp_path / "hot")
    df = spark.createDataFrame([(datetime(2024, 1, 1 + i % 3), "t", i) for i in range(30)], "time timestamp, tenant_id string, n int")
    tiers.write_tier(df.where("n < 20"), str(tmp_path), "hot", "append")
    seals.seal(seals.contents(spark, path)).write.parquet(str(tmp_path / "m1"))
    first = spark.read.parquet(str(tmp_path / "m1"))
    tiers.write_tier(df.where("n >= 20"), str(tmp_path), "hot", "append")
    assert seals.audit(first, seals.contents(spark, path)).count() == 0  # new files are no violation
    seals.seal(seals.contents(spark, path), first).write.parquet(str(tmp_path / "m2"))
    second = spark.read.parquet(str(tmp_path / "m2"))
    head, now = seals.head(second), seals.contents(spark, path)
    assert second.count() == now.count() > first.count() and seals.audit(second, now, head).count() == 0
    assert sorted(map(tuple, first.select("file", "seal").collect())) == sorted(map(tuple, second.where("n = 1").select("file", "seal").collect()))
    one = second.where("n = 1").orderBy("file").first()["file"]
    shown = lambda m, h=None: {(r["file"], r["violation"]) for r in seals.audit(m, now, h).collect()}
    edited = second.withColumn("size", F.when(F.col("file") == one, F.col("size") + 1).otherwise(F.col("size")))
    assert (one, "manifest") in shown(edited)
    folder = one.rpartition("/")[0]
    assert {(f, "manifest") for f in [r["file"] for r in second.where((F.col("folder") == folder) & (F.col("n") > 1)).collect()]} <= shown(second.where(F.col("file") != one))
    assert shown(second.where("n = 1")) == set() and shown(second.where("n = 1"), head) == {("*", "manifest")}
    moves.Store(spark, path).edit(one)  # a byte changes, the size doesn't
    assert {(r["file"], r["violation"]) for r in seals.audit(second, seals.contents(spark, path), head).collect()} == {(one, "changed")}


def test_bytes_of_tenants_come_from_folders(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 1 + i % 3, 1), ["a", "b=c/d", None][i % 3], i) for i in range(30)], "time timestamp, tenant_id string, n int")
    tiers.write_tier(df, str(tmp_path), "cold")
    found = {r["tenant_id"]: (r["files"], r["bytes"]) for r in seals.tenant_bytes(spark, str(tmp_path / "cold")).collect()}
    assert set(found) == {"a", "b=c/d", None} and sum(b for _, b in found.values()) == sum(p.stat().st_size for p in (tmp_path / "cold").rglob("part-*.parquet"))
    with pytest.raises(FileNotFoundError):
        tiers.read_tiers(spark, str(tmp_path / "none"), datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3))
