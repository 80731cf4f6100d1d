"""PII by patterns and information-theoretic sanitisation, in DataFrame and SQL functions only.

Patterns find the protected entities: e-mail and IP addresses, card and phone numbers. Other words may reveal an entity as
well: the pointwise mutual information of a term and an entity, estimated from the documents of the corpus they stand in,
relative to the entity's own information, is the share of it that the term discloses (1: whoever reads the term knows the
entity). Terms that disclose more of an entity than a threshold are spans, too, of kind `term`, wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored

#: Kinds in order, and their patterns. Runs are possessive and start where a run starts (or where the last match ended), which
#: finds the same matches as the plain patterns without going over a long run again for each of its characters.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
#: Documents that a term must share with an entity.
LEAST_SHARED = 3
#: Terms of a corpus are looked up by broadcast up to this number, else by a shuffle.
BROADCAST_TERMS = 200_000
_WORD = r"[\p{L}\p{N}]+"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a run of digits passes the check: from the right, every second digit is doubled and its digits are added."""
    back = F.reverse(digits)
    value = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    return F.aggregate(places, F.lit(0), lambda sum_, i: sum_ + F.coalesce(F.when(i % 2 == 0, doubled(i)).otherwise(value(i)), F.lit(0))) % 10 == 0


def _holds(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    parts_ok = F.forall(F.split(match, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) < 3) | F.forall(
        F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    )
    n = F.length(digits)
    return (
        (kind == "email")
        | ((kind == "ip") & parts_ok)
        | F.when((kind == "card") & n.between(16, 19), _luhn(digits)).otherwise(False)
        | ((kind == "phone") & n.between(8, 15))
    )


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, kind, start, end, entity) for docs (doc_id, text_hash, text), in code points.

    Leftmost, non-overlapping matches of each kind; those that fail the kind's test are dropped. Equal rows are reported once.
    """
    text = F.col("text")
    asks = {"email": text.contains("@"), "ip": text.contains("."), "card": text.rlike("[0-9][\\x20-]?[0-9]"), "phone": text.contains("+")}
    digit = text.rlike("[0-9]")
    found = []
    for kind, pattern in KINDS.items():
        may = asks[kind] if kind == "email" else asks[kind] & digit
        matches = F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        between = F.when(may, F.split(text, pattern, -1))
        found.append(F.struct(F.lit(kind).alias("kind"), matches.alias("matches"), between.alias("between")))
    each = docs.select("doc_id", "text_hash", F.explode(F.array(*found)).alias("x")).where("size(x.matches) > 0").select("doc_id", "text_hash", "x.*")
    parts = each.select(
        "doc_id", "text_hash", "kind", F.posexplode(F.transform("matches", lambda m, i: F.struct(m.alias("entity"), F.length(F.get("between", i)).alias("gap")))).alias("i", "m")
    ).select("doc_id", "text_hash", "kind", "i", "m.entity", "m.gap")
    once = parts.groupBy("doc_id", "text_hash", "kind", "i").agg(*(F.first(c).alias(c) for c in ("entity", "gap")))
    line = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("entity")
    placed = once.withColumn("end", F.sum(F.col("gap") + size).over(line)).withColumn("start", F.col("end") - size)
    return placed.where(_holds(F.col("kind"), F.col("entity"))).select("doc_id", "text_hash", "kind", "start", "end", "entity")


def _words(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, term): each row's distinct words, in small letters."""
    found = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    return docs.select(*keys, F.explode(F.array_distinct(F.transform(found, F.lower))).alias("term"))


def _placed_words(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, end) of every word that is in its row's array `telling`, placed within its row, so that nothing is shuffled.

    Words are cut into about as many runs as a run has words; what a run starts at is added to the places in it. Other words
    are measured but make no rows.
    """
    keys = ("doc_id", "text_hash", "telling")
    words, gaps = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), F.split("text", _WORD, -1)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    # each explode keeps what it is given from being worked out again for every element of what follows
    once = lambda df, *xs: df.select(*keys, F.explode(F.array(F.struct(*xs))).alias("x")).select(*keys, "x.*")
    own = once(docs, words.alias("words"), gaps.alias("gaps")).where(F.size("words") > 0)
    sized = once(own, "words", F.transform("words", lambda w, i: F.length(F.get("gaps", i)) + F.length(w)).alias("steps"), F.ceil(F.sqrt(F.size("words"))).cast("int").alias("per"))
    first = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / F.col("per")).cast("int"))
    sums = once(sized, "words", "steps", "per", F.transform(first, lambda c: total(F.slice("steps", c * F.col("per") + 1, F.col("per")))).alias("sums"))
    part = lambda xs, c: F.slice(xs, c * F.col("per") + 1, F.col("per"))
    runs = sums.select(*keys, F.explode(F.transform("sums", lambda _, c: F.struct(part("words", c).alias("words"), part("steps", c).alias("steps"), total(F.slice("sums", F.lit(1), c)).alias("from")))).alias("x")).select(*keys, "x.*")
    told = F.filter(F.transform("words", lambda w, i: F.struct(F.lower(w).alias("term"), F.length(w).alias("size"), i.alias("i"))), lambda x: F.array_contains("telling", x["term"]))
    placed = F.transform(told, lambda x: F.struct(x["size"].alias("size"), (F.col("from") + total(F.slice("steps", F.lit(1), x["i"] + 1))).alias("end")))
    return runs.select(*keys, F.explode(placed).alias("x")).select("doc_id", "text_hash", (F.col("x.end") - F.col("x.size")).alias("start"), F.col("x.end").alias("end"))


def telling_terms(docs: DataFrame, found: DataFrame, threshold: float, stored: Stored) -> DataFrame:
    """(term) of the terms that disclose at least `threshold` of an entity.

    With N documents, PMI(t, e) = log(N n(t, e) / (n(t) n(e))) and the entity's information is log(N / n(e)); n counts
    documents of the whole corpus, wherever in them t and e stand. Terms that share fewer than LEAST_SHARED documents with
    an entity say nothing about it. Rows of one id and text are one document in all counts. As n(t, e) <= n(e), a telling term stands in n(e)^threshold N^(1 - threshold) documents
    at most: more frequent ones are left out before they are paired.
    """
    rows = docs.groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"))
    n = rows.count()
    again = stored.put(rows.where("times > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "times"), "again")
    pairs = found.select("doc_id", "text_hash", "entity").distinct()
    most = F.pow(F.col("n_entity"), F.lit(threshold)) * F.pow(F.lit(float(n)), F.lit(1 - threshold)) * (1 + 1e-9)
    n_entity = pairs.groupBy("entity").agg(F.count("*").alias("n_entity")).where((F.col("n_entity") >= LEAST_SHARED) & (F.col("n_entity") < n)).withColumn("most", most)
    shared = stored.put(pairs.join(n_entity, "entity"), "shared")
    highest = shared.agg(F.max("most")).first()[0] or 0.0
    keys = shared.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    of_key = docs["doc_id"].eqNullSafe(keys["_id"]) & (docs["text_hash"] == keys["_hash"])
    holding = stored.put(_words(docs.join(keys, of_key, "left_semi"), "doc_id", "text_hash").distinct(), "holding")
    terms = stored.put(holding.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n").between(LEAST_SHARED, highest)).select("term"), "terms")
    candidates = terms.count()
    few = candidates <= BROADCAST_TERMS
    if candidates:
        # every word is counted before the candidates are looked up, so what goes on grows with the vocabulary
        n_term = _words(docs).groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") >= LEAST_SHARED)
        if not again.isEmpty():
            repeated = docs.join(again, docs["doc_id"].eqNullSafe(again["_id"]) & (docs["text_hash"] == again["_hash"])).drop("times")
            each = _words(repeated, "doc_id", "text_hash").groupBy("doc_id", "text_hash", "term").agg((F.count("*") - 1).alias("more"))
            more = each.groupBy("term").agg(F.sum("more").alias("more"))
            n_term = n_term.join(more, "term", "left").select("term", (F.col("n_term") - F.coalesce("more", F.lit(0))).alias("n_term"))
        n_term = n_term.join(F.broadcast(terms) if few else terms, "term").where(F.col("n_term") <= highest)
    else:
        n_term = terms.withColumn("n_term", F.lit(0).cast("long"))
    n_term = stored.put(n_term, "n_term")
    left, right = shared, holding.join(F.broadcast(n_term) if few else n_term, "term").withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    both = left.join(right, left["doc_id"].eqNullSafe(right["_id"]) & (left["text_hash"] == right["_hash"]) & (right["n_term"] <= left["most"]))
    joint = both.groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= LEAST_SHARED)
    share = F.log(n * F.col("n_both") / (F.col("n_term") * F.col("n_entity"))) / F.log(n / F.col("n_entity"))
    out = stored.put(joint.where(share >= threshold).select("term").distinct(), "telling")
    stored.drop(shared, holding, terms, n_term, again)
    return out


def disclosing_terms(docs: DataFrame, found: DataFrame, threshold: float, stored: Stored) -> DataFrame:
    """(doc_id, text_hash, start, end) of all places of the telling terms, but for those inside an entity."""
    telling = telling_terms(docs, found, threshold, stored)
    n = telling.count()
    if not n:
        return found.select("doc_id", "text_hash", "start", "end").limit(0)
    known = F.broadcast(telling) if n <= BROADCAST_TERMS else telling
    # a row's telling terms are no more than its distinct words
    told = _words(docs, "doc_id", "text_hash").join(known, "term").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("term").alias("telling"))
    told = stored.put(told, "places")
    each = _placed_words(docs.join(told, docs["doc_id"].eqNullSafe(told["_id"]) & (docs["text_hash"] == told["_hash"])))
    places = each.groupBy("doc_id", "text_hash", "start", "end").agg(F.lit(1).alias("term"))
    both = places.unionByName(found.select("doc_id", "text_hash", "start", "end", F.lit(0).alias("term")))
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covered = F.coalesce(F.max(F.when(F.col("term") == 0, F.col("end"))).over(before) >= F.col("end"), F.lit(False))
    out = both.withColumn("covered", covered).where("term = 1 and not covered").select("doc_id", "text_hash", "start", "end")
    return stored.put(out, "telling")


def find_spans(docs: DataFrame, text: str, key: str, threshold: float, stored: Stored) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, text_hash, text of every row; spans: doc_id, text_hash, kind, start, end)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = stored.put(entities(rows), "entities")
    terms = disclosing_terms(rows, found, threshold, stored)
    # a term inside an entity is covered by it
    spans = found.select("doc_id", "text_hash", "kind", "start", "end").unionByName(terms.select("doc_id", "text_hash", F.lit(TERM).alias("kind"), "start", "end"))
    return rows, stored.put(spans, "spans")


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def scan_pii(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.9) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term), one row for each row of `docs`.

    spans are kind:start:end in code points, the end exclusive, by kind as in KINDS and then `term`, then by start, joined by
    commas; base_sha256 is over those of KINDS alone. Null and empty texts have none; rows with null ids and repeated rows
    stay; other columns are left out; an empty table gives no rows.
    """
    stored = Stored(docs.sparkSession)
    rows, spans = find_spans(docs, text, key, threshold, stored)
    order = F.create_map(*(x for i, k in enumerate((*KINDS, TERM)) for x in (F.lit(k), F.lit(i))))
    text_of = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    listed = F.array_sort(F.collect_list(F.struct(order[F.col("kind")].alias("order"), "start", "end", "kind")))
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in (*KINDS, TERM)]
    by_row = spans.groupBy("doc_id", "text_hash").agg(*counts, listed.alias("all"))
    by_row = by_row.withColumn("base_text", text_of(F.filter("all", lambda x: x["kind"] != TERM))).withColumn("spans", text_of(F.col("all"))).drop("all")
    keys = rows.select("doc_id", "text_hash")
    joined = keys.join(by_row, _same_row(keys, by_row), "left")
    count = lambda k: F.coalesce(by_row[f"n_{k}"], F.lit(0)).cast("long").alias(f"n_{k}")
    return joined.select(
        keys["doc_id"].alias(key), *(count(k) for k in KINDS),
        F.sha2(F.coalesce(by_row["base_text"], F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce(by_row["spans"], F.lit("")).alias("spans"), count(TERM),
    )


def sanitise(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.9) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, e.g. [email]: entities are generalised so, terms removed so.

    Overlapping spans become one, named after the first. All columns stay, and texts without spans are as they were.
    """
    stored = Stored(docs.sparkSession)
    _, spans = find_spans(docs, text, key, threshold, stored)
    line = Window.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    parted = spans.withColumn("new", F.coalesce(F.max("end").over(line) <= F.col("start"), F.lit(True)).cast("int"))
    runs = parted.withColumn("run", F.sum("new").over(Window.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("end"), "kind")))
    merged = runs.groupBy("doc_id", "text_hash", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind"))
    listed = merged.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
    listed = stored.put(listed, "cuts")
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[key].alias("doc_id"), F.xxhash64(docs[text]).alias("text_hash"))
    joined = keyed.join(listed, _same_row(keyed, listed), "left")
    whole, cuts = F.col("row")[text], F.col("cuts")
    kept = F.transform(cuts, lambda x, i: F.concat(_between(whole, F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)["end"]), x["start"]), F.lit("["), x["kind"], F.lit("]")))
    tail = F.substring(whole, F.element_at(cuts, -1)["end"].cast("int") + 1, F.length(whole))
    clean = F.when(cuts.isNull(), whole).otherwise(F.concat(F.array_join(kept, ""), tail))
    return joined.select(*((clean if c == text else F.col("row")[c]).alias(c) for c in docs.columns))


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start.cast("int") + 1, (end - start).cast("int"))
