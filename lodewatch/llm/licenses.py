"""License scans by diagonal voting, in DataFrame and SQL functions only.

All rolling word k-gram hashes of the documents are joined with the k-gram positions of license templates; hits with one
offset (document position minus template position) lie on a diagonal and vote for it. A word put in or left out moves the
rest by one, so a diagonal is merged with those at most NEAR beside it: what counts is how many different k-grams of the
template they hold, and as each stands within NEAR words of where the diagonal wants it, they follow one another and the
span is as long as the template. Of neighbouring diagonals the best is kept, and its span is verified on the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored

K = 2
#: How far merged diagonals may lie from the middle one; the share of a template that a span must hold, as k-grams and as words.
NEAR, LEAST = 3, 0.8
#: Rows with spans to verify are sent to all executors up to this number (16 bytes each), else the texts are shuffled to them.
BROADCAST_ROWS = 1_000_000
#: Fixed phrases: every place of one counts.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Passages of public license texts and notices, single sentences and whole ones; a span of one gives its label.
PASSAGES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is "
        "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
        "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all "
        "copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "isc",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license "
        "2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or "
        "implied see the license for the specific language governing permissions and limitations under the license",
        "apache",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a "
        "particular purpose see the gnu general public license for more details",
        "gpl-3",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "mpl",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled "
        "binary for any purpose commercial or non commercial and by any means",
        "unlicense",
    ),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def license_words(text: Column) -> Column:
    """Words of a text: A-Z folded, runs of digits, letters and whatever lies beyond ASCII. Null counts as empty."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def grams(words: Column) -> Column:
    """Hash of each run of K words: every word is hashed once, and the hashes of neighbours are combined."""
    n = F.size(words)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    runs = hashed
    for j in range(1, K):
        runs = F.zip_with(F.slice(runs, 1, F.greatest(n - j, F.lit(0))), F.slice(hashed, j + 1, F.greatest(n - j, F.lit(0))), lambda a, b: F.shiftleft(a, 7).bitwiseXOR(F.shiftrightunsigned(a, 57)).bitwiseXOR(b))
    return F.when(n >= K, runs).otherwise(F.array().cast("array<bigint>"))


def template_table(spark: SparkSession) -> DataFrame:
    """(template, label, phrase, words): a few dozen rows."""
    rows = [(i, label, i < len(PHRASES), text.split()) for i, (text, label) in enumerate((*PHRASES, *PASSAGES))]
    return spark.createDataFrame(rows, "template int, label string, phrase boolean, words array<string>")


def template_grams(spark: SparkSession) -> DataFrame:
    """(template, label, phrase, of, place, gram): of is a template's number of k-grams. A thousand rows or so."""
    return template_table(spark).select("template", "label", "phrase", (F.size("words") - K + 1).alias("of"), F.posexplode(grams(F.col("words"))).alias("place", "gram"))


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each row of `docs`.

    n_base counts the places of PHRASES, first_word and last_word are the least and greatest start (words from 0, null without
    any). labels also holds those of PASSAGES found; both lists are distinct, sorted and joined by commas, empty without any.
    score is the largest share of a template found, 1 for a phrase. Null and empty texts have no words; rows with equal
    or null ids stay rows of their own; other columns are left out; an empty table gives no rows.
    """
    return _report(license_spans(docs, text, key), key)


def license_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Spans (row_id, doc_id, text_hash, n_words, template, label, phrase, start, end, share), and for every row one with a null template."""
    spark = docs.sparkSession
    stored = Stored(spark)
    marker = F.lit(0).cast("long")
    same_row = (F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), *same_row, license_words(F.col(text)).alias("words"))
    hashed = rows.select("row_id", "doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(marker), grams(F.col("words")))).alias("at", "gram"))
    none = spark.range(1).select(F.lit(None).cast("int").alias("template"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("phrase"), F.lit(1).alias("of"), F.lit(0).alias("place"), marker.alias("gram"))
    hits = hashed.join(F.broadcast(template_grams(spark).unionByName(none)), "gram").where("(at = 0) = (template is null)")
    one = ["row_id", "doc_id", "text_hash", "n_words", "template", "label", "phrase", "of"]
    # a diagonal holds each place of a template once, so its places are no more than the template has
    diagonals = hits.groupBy(*one, (F.col("at") - 1 - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))
    diagonals = stored.put(diagonals, "diagonals")  # the texts are scanned once for phrases and passages
    known = F.col("template").isNull() | F.col("phrase")
    exact = diagonals.where(known & (F.col("template").isNull() | (F.size("places") == F.col("of"))))
    exact = exact.select(*one, F.col("diagonal").cast("long").alias("start"), (F.col("diagonal") + F.col("of") + K - 1).cast("long").alias("end"), F.lit(1.0).alias("share"))
    near = Window.partitionBy("row_id", "template").orderBy("diagonal").rangeBetween(-NEAR, NEAR)
    merged = diagonals.where(~known).select(
        *one, "diagonal", F.size(F.array_distinct(F.flatten(F.collect_list("places").over(near)))).alias("held"), (F.min("first").over(near) - 1).cast("long").alias("start"), (F.max("last").over(near) - 1 + K).cast("long").alias("end")
    )
    found = merged.withColumn("share", F.col("held") / F.col("of")).where(F.col("share") >= LEAST)
    best = F.row_number().over(Window.partitionBy("row_id", "template", "run").orderBy(F.desc("share"), F.expr("end - start"), "diagonal"))
    line = Window.partitionBy("row_id", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > NEAR, F.lit(True))
    runs = found.withColumn("run", F.sum(apart.cast("int")).over(line)).withColumn("_best", best).where("_best = 1")
    spans = stored.put(exact.unionByName(runs.select(*one, "start", "end", "share")), "spans")
    return spans.where(known).drop("of").unionByName(_verified(spans.where(~known).drop("of"), docs.select(*same_row, F.col(text).alias("text")), stored))


def _verified(spans: DataFrame, docs: DataFrame, stored: Stored) -> DataFrame:
    """Spans in whose words at least LEAST of the template's stand in its order, as their longest common subsequence; share becomes that, if it is less."""
    keys = stored.put(spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "keys")
    few = keys.count() <= BROADCAST_ROWS
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["text_hash"] == F.col("_hash"))
    held = docs.join(F.broadcast(keys) if few else keys, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), license_words(F.col("text")).alias("_words"))
    template = F.broadcast(template_table(docs.sparkSession).select(F.col("template").alias("_template"), F.col("words").alias("_wanted")))
    own = spans.join(held, spans["doc_id"].eqNullSafe(held["_id"]) & (spans["text_hash"] == held["_hash"])).join(template, F.col("template") == F.col("_template"))
    own = own.withColumn("_span", F.slice("_words", F.col("start").cast("int") + 1, F.greatest(F.lit(1), (F.col("end") - F.col("start")).cast("int"))))

    in_order = F.size(_common("_wanted", F.col("_span"))) / F.size("_wanted")
    return own.withColumn("share", F.least("share", in_order)).where(F.col("share") >= LEAST).select(*spans.columns)


def _common(wanted: str, span: Column) -> Column:
    """An array as long as the longest common subsequence: its k-th element is the least place in the span at which one of k words can end.

    A word of the template at a place p can follow what ends before p, and so ends one word more at p; its places are taken from the last,
    so it is used once.
    """

    def taken(ends, p):
        k = F.size(F.filter(ends, lambda e: e < p))
        return F.concat(F.slice(ends, F.lit(1), k), F.array(p), F.slice(ends, k + 2, F.size(ends)))

    def step(ends, word):
        places = F.filter(F.transform(span, lambda x, i: F.when(x == word, i + 1)), lambda p: p.isNotNull())
        return F.aggregate(F.reverse(places), ends, taken)

    return F.aggregate(wanted, F.array().cast("array<int>"), step)


def _report(spans: DataFrame, key: str) -> DataFrame:
    base, real = F.col("phrase"), F.col("template").isNotNull()
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    out = spans.groupBy("row_id", "doc_id", "text_hash", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(real).alias("labels"),
        F.coalesce(F.max(F.when(real, F.col("share"))), F.lit(0.0)).alias("score"),
    )
    return out.drop("row_id", "text_hash").withColumnRenamed("doc_id", key)
