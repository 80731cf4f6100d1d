"""A posting index over text fields, with look-ups of words that are nearly the same.

root/postings: (token, field, key, n), root/variants: (variant, tokens), both in folders by a hash bucket and sorted within. A variant is what is left
of a token's first PREFIX characters after up to two deletions: words within an edit distance of d share one with at most d
deletions on either side. So a search computes the few variants of its words, reads their buckets, verifies the tokens found by their
edit distance, and reads the postings' buckets of those that pass; no text is read again and no word compared with all others.
"""

from __future__ import annotations

import zlib
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewatch.operators.events import edits_allowed, query_words, tokens

PREFIX = 7
#: Tokens in a row of variants.
TOKENS_A_ROW = 1_000


def variants(word: str, deletions: int) -> set[str]:
    """What is left of the word's beginning after up to `deletions` deletions."""
    head = word[:PREFIX]
    return {"".join(c for i, c in enumerate(head) if i not in gone) for n in range(min(deletions, len(head)) + 1) for gone in combinations(range(len(head)), n)}


def variants_of(token: Column) -> Column:
    """The same of a column, for every distance at which a query word can ask for it: two deletions from four characters on, one from two."""
    head = F.substring(token, 1, PREFIX)
    less = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.lit(PREFIX))))
    once = less(head)
    twice = F.flatten(F.transform(once, less))
    return F.array_distinct(F.when(F.length(token) >= 4, F.concat(F.array(head), once, twice)).when(F.length(token) >= 2, F.concat(F.array(head), once)).otherwise(F.array(head)))


def _bucket(c: Column, buckets: int) -> Column:
    return (F.crc32(c.cast("binary")) % buckets).cast("int")


def _write(df: DataFrame, path: str, by: str, buckets: int) -> None:
    # a frequent token's rows may be many: a bucket is dealt to as many tasks as it needs
    rows = df.withColumn("bucket", _bucket(F.col(by), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", by)
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_index(df: DataFrame, key: str, fields: list[str], root: str, buckets: int = 64) -> None:
    """Indexes text fields by token: rows with equal keys are one. Null and empty texts have no tokens."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields)))
    split = df.select(F.col(key).alias("key"), each.alias("x")).select("key", "x.field", F.explode(tokens(F.col("x.text"))).alias("token"))
    _write(split.groupBy("token", "field", "key").agg(F.count("*").alias("n")), f"{root}/postings", "token", buckets)
    words = df.sparkSession.read.parquet(f"{root}/postings").select("token").distinct().withColumn("head", F.substring("token", 1, PREFIX))
    # tokens of one beginning have the same variants and go with them together, a bounded number a row
    part = F.expr(f"(row_number() over (partition by head order by token) - 1) div {TOKENS_A_ROW}")
    heads = words.withColumn("part", part).groupBy("head", "part").agg(F.collect_list("token").alias("tokens"))
    _write(heads.select(F.explode(variants_of(F.col("head"))).alias("variant"), "tokens"), f"{root}/variants", "variant", buckets)
    df.sparkSession.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{root}/about")


def _within(df: DataFrame, by: str, values: list[str], buckets: int) -> DataFrame:
    wanted = sorted({zlib.crc32(v.encode()) % buckets for v in values})
    return df.where(F.col("bucket").isin(wanted) & F.col(by).isin(values))


def near_tokens(spark: SparkSession, root: str, query: str) -> DataFrame:
    """(term, times, token): the index's tokens within the edit distance that each word of a query allows; times: how often the query has the word."""
    buckets = spark.read.parquet(f"{root}/about").first()["buckets"]
    terms = query_words(query)
    asked = [(v, t, terms.count(t), edits_allowed(t)) for t in dict.fromkeys(terms) for v in sorted(variants(t, edits_allowed(t)))]
    found = _within(spark.read.parquet(f"{root}/variants"), "variant", [a[0] for a in asked], buckets)
    table = spark.createDataFrame(asked, "variant string, term string, times int, allowed int")
    found = found.join(F.broadcast(table), "variant").select("term", "times", "allowed", F.explode("tokens").alias("token"))
    return found.where(F.levenshtein("token", "term") <= F.col("allowed")).select("term", "times", "token").distinct()


def search_index(spark: SparkSession, root: str, query: str, fields: dict[str, float]) -> DataFrame:
    """(key, score) as text_search() gives it: the best field's boost times the query words that it holds."""
    buckets = spark.read.parquet(f"{root}/about").first()["buckets"]
    near = near_tokens(spark, root, query)
    wanted = [r["bucket"] for r in near.select(_bucket(F.col("token"), buckets).alias("bucket")).distinct().collect()]  # `buckets` at most
    boosts = spark.createDataFrame(list(fields.items()), "field string, boost double")
    rows = spark.read.parquet(f"{root}/postings").where(F.col("bucket").isin(wanted)).join(near, "token").join(F.broadcast(boosts), "field")
    each = rows.groupBy("key", "field", "boost", "term").agg(F.first("times").alias("times"))
    return each.groupBy("key", "field").agg((F.sum("times") * F.first("boost")).alias("score")).groupBy("key").agg(F.max("score").alias("score"))
