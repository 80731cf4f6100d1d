"""The posting index against a scan, in all scripts, and what a search reads of it."""

import random
import re

from pyspark.sql import functions as F

from lodewatch.operators import events as canned
from lodewatch.operators import search, textindex

TEXTS = [(1, "die größe zählt", "a"), (2, "Die GRÖSSE, die Größen", None), (3, None, "größe größe"), (4, "", ""), (5, "ελληνικά слово 漢字 ne\u0301e", "x_1"), (6, "ab abc abcd abcde abcdef abcdefg abcdefgh xbcdefgh abcdefghij", "q"), (7, "x" * 50_000 + " end", "end"), (8, "word " * 3000, "word")]
FIELDS = {"text": 2.0, "other": 1.0}


def test_an_index_finds_what_a_scan_finds(spark, tmp_path):
    r = random.Random(2)
    more = [(100 + i, " ".join("".join(r.choice("abä") for _ in range(r.randrange(1, 12))) for _ in range(8)), None) for i in range(150)]
    df = spark.createDataFrame(TEXTS + more, "id int, text string, other string").repartition(3)
    root = str(tmp_path / "index")
    textindex.write_index(df, "id", list(FIELDS), root, buckets=16)
    queries = ["größe", "GRÖßE zählt", "слово", "漢字", "ab", "abc", "abcdef abcdefgh", "bcdefghi", "xabcdefghij", "x", "née", "word end", "nothing", "", "word word", "aä", "abäab", "bäbäbäba", "ääääääääää", "x_1"]
    for q in queries:
        want = {(x["id"], x["score"]) for x in canned.text_search(df, q, FIELDS).select("id", "score").collect()}
        got = {(x["key"], x["score"]) for x in textindex.search_index(spark, root, q, FIELDS).collect()} if q else set()
        assert got == want, q
    assert {x["id"] for x in canned.text_search(df, "größe", FIELDS).collect()} == {1, 2, 3}


def test_a_search_reads_a_few_buckets(spark, tmp_path):
    df = spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    root = str(tmp_path / "index")
    textindex.write_index(df, "id", ["text"], root, buckets=64)
    word = df.where("id = 2999").first()["text"]
    found = textindex.search_index(spark, root, word[:9] + "-" + word[:-1], {"text": 1.0})
    assert [r["key"] for r in found.collect()] == [2999]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", found._jdf.queryExecution().executedPlan().toString())
    plan = textindex.near_tokens(spark, root, word)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(variant" in plan


def test_words_of_one_neighbourhood_share_a_variant():
    r = random.Random(4)

    def edited(w, n):
        for _ in range(n):
            i, kind = r.randrange(len(w) + 1), r.randrange(3)
            w = w[:i] + r.choice("abc") * (kind != 0) + w[i + (kind != 1) :]
        return w

    for _ in range(5000):
        w = "".join(r.choice("abc") for _ in range(r.randrange(3, 14)))
        d = canned.edits_allowed(w)
        t = edited(w, d)
        assert not t or textindex.variants(w, d) & textindex.variants(t, d)


def test_marks_end_at_whole_words_of_any_script(spark):
    df = spark.createDataFrame([("Maß, Maßes maß größe\u0301",)], "t string")
    assert df.select(canned.highlight(F.col("t"), ["maß", "größe"])).first()[0] == ["<em>Maß</em>, Maßes <em>maß</em> größe\u0301"]


def test_comparisons_are_never_errors_and_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, "7", True), (2, "seven", False), (3, None, None), (7, "7.0", True)], "n long, t string, b boolean")
    count = lambda *xs: df.where(search.compare(*xs, df=df)).count()
    assert [count("t", "=", "7"), count("t", "!=", 7), count("t", "<", "8"), count("n", "=", "seven"), count("n", "!=", "seven"), count("b", "=", "true"), count("b", ">", 3), count("b", "!=", "x")] == [2, 1, 2, 0, 4, 2, 0, 3]
    assert df.where(search.compare("t", "=", "7")).count() == 2
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert "GreaterThan(n,3)" in stored.where(search.compare("n", ">", "3"))._jdf.queryExecution().executedPlan().toString()
