"""Queries on copies of their tables, and what their plans read."""

from pyspark.sql import functions as F

from lodewatch.llm import quality
from lodewatch.llm.common import Stored
from lodewatch.operators import detect, normalize, ruleindex, textindex
from lodewatch.plans import catalog
from lodewatch.sources import views


def test_a_row_in_place_of_another_is_noticed_where_rows_stand_several_times(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    last = e.agg(F.max("event_id")).first()[0] + 1
    e.unionByName(e.withColumn("event_id", F.col("event_id") + last)).write.parquet(f"{tmp_path}/events.parquet")
    found = catalog.QUERIES["t_verify_differing"](spark, str(tmp_path))
    n = 2 * e.count()
    assert {(r["side"], r["source_rows"], r["copy_rows"], r["same"]) for r in found.where("side <> 'short'").collect()} == {("copy", n, n, True), ("doubled", n, n, False)}
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def _letters(spark, n):
    rows = [(f"id-{i}", f"CEF:{i}") for i in range(n)]
    raw = spark.createDataFrame(rows, "raw_id string, data string").select("*", F.lit("2024-01-01").cast("timestamp").alias("arrived"), F.lit("t").alias("tenant_id"), F.lit(None).cast("string").alias("vendor_type"), F.create_map().cast("map<string,string>").alias("metadata"))
    return normalize.dead_letters(normalize.normalize(raw))


def test_a_replay_parses_once_and_keeps_equal_letters(spark, tmp_path):
    _letters(spark, 3).unionByName(_letters(spark, 2)).write.parquet(str(tmp_path / "letters"))
    letters = spark.read.parquet(str(tmp_path / "letters"))
    good, still = normalize.replay_dead_letters(letters.where("retry_count < 3"))
    assert sorted((r["raw_id"], r["retry_count"], r["error_context"]["vendor"], r["error_context"]["last_retry"]) for r in still.collect()) == [(f"id-{i}", 1, "cef", "1") for i in (0, 0, 1, 1, 2)]
    assert good.count() == 0 and "Join" not in still._jdf.queryExecution().executedPlan().toString()


def test_letters_of_a_parser_of_tables_are_found_by_their_id(spark, monkeypatch):
    letters = _letters(spark, 2).unionByName(_letters(spark, 1)).localCheckpoint()
    whole = normalize.PARSERS["cef"]
    monkeypatch.setitem(normalize.PARSERS, "cef", lambda df: whole(df))
    assert sorted((r["raw_id"], r["retry_count"]) for r in normalize.replay_dead_letters(letters)[1].collect()) == [("id-0", 1), ("id-0", 1), ("id-1", 1)]


def test_rules_of_all_windows_side_by_side_share_one_matching(spark, sf):
    e = views.flat_events(spark, sf)
    rules = [
        detect.Rule("a", "t", {"user": "user-1"}, above=0, size="1 days"), detect.Rule("b", "t", {"user": ["user-2", "user-3"], "severity": [1, 2.0]}, "dcount", "dst_port", above=0, size="1 days"),
        detect.Rule("c", "t", {"outcome": "success"}, "sum", "bytes_out", "user", 0, size="12 hours"), detect.Rule("d", "t", {}, "count", "user", above=3, size="6 hours"),
    ]
    found = ruleindex.run_many_rules(e, rules)
    assert sorted(map(str, found.collect())) == sorted(map(str, detect.run_rules(e, rules).collect()))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_the_quality_fit_brings_only_what_is_not_zero_to_the_driver(spark, sf, monkeypatch):
    found, real = [], quality.arrow_map
    monkeypatch.setattr(quality, "arrow_map", lambda *xs: found.append(real(*xs)) or found[-1])
    stored = Stored(spark)
    stored.drop = lambda *tables: None  # for the plan to run again
    quality.train_quality(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(50), stored)
    sent = [c for c, kind in found[-1].dtypes if kind == "binary"]
    assert 0 < found[-1].agg(F.sum(sum(F.octet_length(c) for c in sent))).first()[0] < 50 * quality.BUCKETS * 4 / 2


def test_words_of_one_beginning_share_their_variants(spark, tmp_path, monkeypatch):
    df = spark.range(60).select("id", F.concat(F.lit("abcdefg"), F.col("id").cast("string"), F.lit(" (x)")).alias("text"))
    for most, rows in ((1_000, 1), (25, 3)):
        monkeypatch.setattr(textindex, "TOKENS_A_ROW", most)
        root = str(tmp_path / str(most))
        textindex.write_index(df, "id", ["text"], root, buckets=8)
        assert spark.read.parquet(f"{root}/variants").count() == rows * len(textindex.variants("abcdefg", 2)) + len(textindex.variants("x", 0))
        assert {r["key"] for r in textindex.search_index(spark, root, "abcdefg", {"text": 1.0}).collect()} == set(range(60))
