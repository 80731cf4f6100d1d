from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodewatch.functions import columns, times
from lodewatch.operators import aggregate, detect, enrich, normalize, search, tenants, ueba
from lodewatch.operators import events as canned
from lodewatch.sources import ingest, moves, tiers

NOW = datetime(2024, 1, 31)


def test_times():
    assert times.resolve_time("-7d", NOW) == datetime(2024, 1, 24)
    assert times.resolve_time("2024-01-02 03:04:05", NOW) == datetime(2024, 1, 2, 3, 4, 5)
    assert times.last("last 2 m", NOW)[0] == datetime(2023, 12, 2)
    assert [times.timeframe(x) for x in ("5m", "30s", "1h", "7", None, "x")] == ["5 minutes", "30 seconds", "1 hours", "7 minutes", "5 minutes", "5 minutes"]
    assert times.tiers_for_range(datetime(2023, 1, 1), NOW, NOW) == ["hot", "warm", "cold"]
    assert times.tiers_for_range(datetime(2024, 1, 30), NOW, NOW) == ["hot"]


def test_tenant_is_required_and_never_text_of_a_query(spark):
    df = spark.createDataFrame([("a",), ("b",)], "tenant_id string")
    with pytest.raises(ValueError):
        search.for_tenant(df, " ")
    assert search.for_tenant(df, "a' OR '1'='1").count() == 0


def test_limits_and_cursors():
    assert [search.clamp(n) for n in (0, -1, 20_000, 5)] == [1, 1, 10_000, 5]
    c = search.encode_cursor("x", "2024", 7)
    assert search.decode_cursor(c)["offset"] == 7
    assert search.decode_cursor("?!") == search.decode_cursor("") == {"lastId": None, "lastTimestamp": None, "offset": 0}


def test_merge_of_partial_aggregates(spark):
    kind = "severity int, n long, total long, low int, high int"
    a, b = spark.createDataFrame([(3, 10, 100, 10, 100)], kind), spark.createDataFrame([(3, 5, 50, 5, 150), (4, 5, 1, None, None)], kind)
    got = {r["severity"]: r for r in aggregate.merge_aggregates([a, b], ["severity"]).collect()}
    assert (got[3]["n"], got[3]["total"], got[3]["low"], got[3]["high"], got[3]["mean"]) == (15, 150, 5, 150, 10)
    assert got[4]["low"] is None


def test_conditions_of_rules():
    assert detect.parse_condition("sum(bytes_out) by src_ip > 1073741824") == {"function": "sum", "of": "bytes_out", "by": "src_ip", "above": 1073741824}
    assert detect.parse_condition(None)["above"] == 5
    r = detect.parse_rule({"title": "t", "detection": {"condition": "count() by src_ip > 3 sliding", "timeframe": "10m"}})
    assert (r.window_type, r.size, r.slide) == ("sliding", "10 minutes", "300 seconds")
    with pytest.raises(ValueError):
        detect.parse_rule({"title": "t"})
    assert [x.id for x in detect.load_rules()] == ["brute-force", "exfiltration", "port-scan"]


def test_selection(spark):
    df = spark.createDataFrame([(3002, " Failure "), (3002, None), (1, "failure")], "class_uid int, outcome string")
    chosen = lambda s: df.where(columns.selection_predicate(s, flat=True)).count()
    assert (chosen({"class_uid": 3002, "outcome": "failure"}), chosen({}), chosen(None), chosen({"class_uid": [1, 3002]}), chosen({"nothing": "x"})) == (1, 3, 3, 3, 0)


def test_addresses(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("256.1.1.1",), ("::1",), (None,), ("172.20.0.1",), ("172.40.0.1",)], "ip string")
    assert [r[0] for r in df.select(columns.is_valid_ip(F.col("ip"))).collect()] == [True, False, False, False, True, True]
    assert [bool(r[0]) for r in df.select(columns.is_known_safe(F.col("ip"))).collect()] == [False, False, False, False, True, False]


def test_odd_lines_do_not_stop_a_job(spark):
    lines = [None, "", "CEF:broken", "{not json", "<34>", "%ASA-", "<Event xmlns=\"http://schemas.microsoft.com/win\"><x", "x" * 3000, "<13>Feb  5 01:02:03 h tag: m"]
    raw = spark.createDataFrame([(str(i), x, datetime(2024, 2, 6), "t", None, {}) for i, x in enumerate(lines)], "raw_id string, data string, arrived timestamp, tenant_id string, vendor_type string, metadata map<string,string>")
    got = {r["raw_id"]: r for r in normalize.normalize(raw).collect()}
    assert len(got) == len(lines)
    assert got["2"]["parse_error"] and got["0"]["parse_error"] and got["6"]["parse_error"]
    assert got["7"]["message"].endswith("...") and len(got["7"]["message"]) == 1003
    assert got["8"]["time"] == datetime(2024, 2, 5, 1, 2, 3) and got["8"]["severity"] == 2


def test_last_of_equal_extension_keys_counts(spark):
    raw = spark.createDataFrame([("1", "CEF:0|v|p|1|9|name|7|src=1.1.1.1 msg=a b src=2.2.2.2", NOW, "t", None, {})], "raw_id string, data string, arrived timestamp, tenant_id string, vendor_type string, metadata map<string,string>")
    r = normalize.normalize(raw).first()
    assert (r["src_endpoint"]["ip"], r["metadata"]["cef.msg"], r["severity"], r["dst_endpoint"]) == ("2.2.2.2", "a b", 4, None)


def test_acknowledge_needs_the_tenants_own_alert(spark):
    a = spark.createDataFrame([("1", "t", "open", None, None)], "id string, tenant_id string, status string, acknowledged_at timestamp, acknowledged_by string")
    with pytest.raises(LookupError):
        canned.acknowledge(a, "other", ["1"], "ann", NOW)
    assert canned.acknowledge(a, "t", ["1"], "ann", NOW).first()["status"] == "acknowledged"


def test_a_tier_written_again_is_the_same(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 1, d), "t", d) for d in (1, 2, 3)], "time timestamp, tenant_id string, n int")
    for _ in range(2):
        tiers.write_tier(df, str(tmp_path), "hot")
    assert spark.read.parquet(str(tmp_path / "hot")).count() == 3
    plan = tiers.read_tiers(spark, str(tmp_path), datetime(2024, 1, 2), datetime(2024, 1, 3), datetime(2024, 1, 4))
    assert plan.count() == 2 and "PartitionFilters: [isnotnull(event_date" in plan._jdf.queryExecution().toString()


LINE = "raw_id string, data string, arrived timestamp, tenant_id string, vendor_type string, metadata map<string,string>"


def test_all_parsers_share_one_scan(spark, tmp_path):
    raw = spark.createDataFrame([("1", "<34>", NOW, "t", None, {}), ("2", "%ASA-4-1: x", NOW, "t", "mine", {})], LINE)
    raw.write.parquet(str(tmp_path / "raw"))
    stored = spark.read.parquet(str(tmp_path / "raw"))
    assert normalize.normalize(stored)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {r["raw_id"]: r for r in normalize.normalize(stored).collect()}
    assert (got["1"]["metadata"]["format"], got["1"]["message"], got["1"]["severity"]) == ("generic", "<34>", 1) and got["2"]["metadata"]["parser"] == "generic"
    table = {**normalize.PARSERS, "mine": lambda df: normalize.PARSERS["cisco:asa"](df).drop("_line", "_event")}
    got = {r["raw_id"]: r for r in normalize.normalize(stored, table).collect()}
    assert len(got) == 2 and (got["2"]["message"], got["2"]["metadata"]["vendor"]) == ("x", "cisco")


def tier_rows(spark, days, extra=0):
    return spark.createDataFrame([(datetime(2024, 1, d, 1 + i), "t", d * 10 + i) for d in days for i in range(2 + extra)], "time timestamp, tenant_id string, n int")


def test_a_second_migration_into_a_month_keeps_the_first(spark, tmp_path):
    root, seen = str(tmp_path), []
    for days, as_of in ((range(1, 4), datetime(2024, 1, 10)), (range(4, 8), datetime(2024, 1, 12)), ((2,), datetime(2024, 1, 12))):
        tiers.write_tier(tier_rows(spark, days, extra=int(len(days) == 1)), root, "hot", "append")
        tiers.migrate_hot_to_warm(spark, root, as_of, drop=False)  # broken off before the source went
        report = tiers.migrate_hot_to_warm(spark, root, as_of).first()
        seen.append((report["moved"], report["source_rows"], report["same"]))
    assert seen == [(0, 6, True), (0, 4, True), (0, 3, True)]
    late = [20, 21, 22]  # equal rows that arrive later are rows of their own
    assert sorted(r["n"] for r in spark.read.parquet(f"{root}/warm").collect()) == sorted([*(d * 10 + i for d in range(1, 6) for i in (0, 1)), *late])
    assert sorted(r["n"] for r in spark.read.parquet(f"{root}/hot").collect()) == [60, 61, 70, 71]
    assert not list((tmp_path / "hot" / "event_date=2024-01-02").glob("*.parquet")) and tiers.migrate_hot_to_warm(spark, root, datetime(2024, 1, 12)).first()["source_rows"] == 0
    tiers.migrate_warm_to_cold(spark, root, datetime(2024, 4, 3))
    assert spark.read.parquet(f"{root}/cold").count() + spark.read.parquet(f"{root}/warm").count() == 13 and spark.read.parquet(f"{root}/cold").count() == 11
    assert tiers.expire_partitions(spark, root, datetime(2024, 1, 14), 7) == ["2024-01-06"] or not (tmp_path / "hot" / "event_date=2024-01-06").exists()


@pytest.mark.parametrize("step", ["planned", "staged cold", "staged warm", "committed", "published", "removing"])
def test_a_migration_that_breaks_off_anywhere(spark, tmp_path, monkeypatch, step):
    """From warm, where younger rows of the same files are written anew: before the next run readers see every row once, and after it, too."""
    root, want = str(tmp_path), sorted([*range(10, 40, 10), *range(11, 41, 10)] * 2)
    for _ in range(2):
        tiers.write_tier(tier_rows(spark, (1, 2, 3)), root, "warm", "append")

    def stop(at):
        if at == step:
            raise InterruptedError

    if step == "removing":
        monkeypatch.setattr(moves.Move, "drop", lambda self: (self.store.remove(next(iter(self.reads().collect()))["file"]), stop("removing")))
    with pytest.raises(InterruptedError):
        tiers.migrate(spark, root, "warm", "cold", datetime(2024, 4, 1, 15), 90, reached=stop)
    monkeypatch.undo()
    everything = lambda: sorted(r["n"] for r in tiers.read_tiers(spark, root, datetime(2024, 1, 1), datetime(2024, 1, 9), datetime(2024, 4, 1, 15)).collect())
    assert everything() == want
    tiers.migrate_warm_to_cold(spark, root, datetime(2024, 4, 1, 15))
    assert everything() == want
    assert sorted(r["n"] for r in spark.read.parquet(f"{root}/cold").collect()) == [10, 10, 11, 11, 20, 20, 21, 21]
    assert sorted(r["n"] for r in spark.read.parquet(f"{root}/warm").collect()) == [30, 30, 31, 31]
    assert tiers.migrate_warm_to_cold(spark, root, datetime(2024, 4, 1, 15)).first()["source_rows"] == 0 and moves.moves(spark, root) == []


def test_tiers_of_a_range_go_by_whole_days():
    noon = datetime(2024, 1, 31, 12)
    at = lambda day, hour: datetime(2024, 1, day, hour)
    assert times.tiers_for_range(at(24, 13), at(24, 20), noon) == ["warm"] and times.tiers_for_range(at(25, 0), at(25, 1), noon) == ["hot"]
    assert times.tiers_for_range(at(24, 23), at(25, 0), noon) == ["hot", "warm"] and times.tiers_for_range(at(9, 0), at(8, 0), noon) == []


def test_checksums_do_not_cancel_out(spark):
    kind = "a string, b int"
    two = lambda *xs: spark.createDataFrame([(x, 1) for x in xs], kind)
    assert not tiers.verify_migration(two("x", "x", "z"), two("y", "y", "z"), ["a", "b"]).first()["same"]
    assert tiers.verify_migration(two("x", "x", "z"), two("z", "x", "x"), ["a", "b"]).first()["same"] and tiers.verify_migration(two(), two(), ["a", "b"]).first()["same"]


def test_known_places_go_first_in_first_out():
    known = {}
    assert [ueba.remember(known, x, 2) for x in "abacab"] == [True, True, False, True, True, True] and list(known) == ["a", "b"]


def test_terms_are_marked_literally(spark):
    df = spark.createDataFrame([("I like c++ and C, (so) do cats",)], "t string")
    mark = lambda *terms: df.select(canned.highlight(F.col("t"), list(terms))).first()[0]
    assert mark("c++") == ["I like <em>c++</em> and C, (so) do cats"] and mark("(") == ["I like c++ and C, <em>(</em>so) do cats"] or mark("c++")[0].count("<em>c++</em>") == 1


def test_log_files_and_indicators_are_read(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    got = ingest.read_raw_logs(spark, str(tmp_path / "a.log"), "t").collect()
    assert [r["data"] for r in got] == ["one", "two"] and {r["tenant_id"] for r in got} == {"t"} and len({r["raw_id"] for r in got}) == 2
    (tmp_path / "i.csv").write_text("indicator,kind,reputation,category\n1.2.3.4,ip,80,botnet\n,ip,1,x\n")
    known = enrich.read_indicators(spark, str(tmp_path / "i.csv"))
    df = spark.createDataFrame([("1.2.3.4",), ("8.8.8.8",), (None,)], "ip string")
    assert [(r["reputation"], r["is_threat"]) for r in enrich.enrich_threat_intel(df, known, "ip").collect()] == [(80, True), (0, False), (None, False)]


def test_a_tenants_whole_history_is_folded_in_linear_time(spark):
    slots = spark.range(40_000).select(F.lit("t").alias("tenant_id"), F.timestamp_seconds(F.col("id")).alias("time"))
    got = tenants.quota_audit(slots.unionByName(slots.where("id % 2 = 0")), 10, 1.0)
    assert got.count() == 40_000 and got.where("refused").count() > 5_000


def test_a_token_of_two_tenants_is_nobodys(spark):
    tokens = spark.createDataFrame([("a", "t"), ("a", "t"), ("b", "t"), ("b", "u")], "token string, tenant_id string")
    asked = spark.createDataFrame([("Splunk a",), ("Splunk b",)], "authorization string")
    assert sorted(str(r["tenant_id"]) for r in ingest.tenant_from_token(asked, tokens).collect()) == ["None", "t"]


def test_octets_may_have_leading_zeros(spark):
    df = spark.createDataFrame([("010.001.02.255",), ("1.2.3.0256",)], "ip string")
    assert [r[0] for r in df.select(columns.is_valid_ip(F.col("ip"))).collect()] == [True, False]
