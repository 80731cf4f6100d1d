"""A Merkle manifest of a table: leaves, subroots of groups, the root, and an audit of every row's inclusion proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, numbered

#: Levels of the tree that one pass works out: 2^10 neighbouring nodes are together in a window.
LEVELS = 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(columns: list[Column]) -> Column:
    """Hex SHA-256 over the values in order: `-` for null, else their length in UTF-8 bytes, `:` and the value as text."""
    one = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.sha2(F.concat(*(one(c) for c in columns)), 256)


def _levels(nodes: DataFrame) -> DataFrame:
    """nodes (g, i, n, h, ...) with `path`, the steps of LEVELS levels, and `top`, the node they lead to (on rows where i % 2^LEVELS = 0).

    One shuffle brings the 2^LEVELS nodes of a block together, and all windows share it and its order. At level k the rows with
    i % 2^k = 0 hold the nodes, so a sibling stands 2^k rows further on or back; a level counts while the group has more than one node there.
    A step is L or R and the sibling to the left or right, N for the last of an odd run, and empty where the tree has ended.
    """
    w = Window.partitionBy("g", "block").orderBy("i")
    rows = nodes.withColumn("block", F.shiftright("i", LEVELS)).withColumn("node", F.col("h"))
    for k in range(LEVELS):
        size = 1 << k
        rows = rows.withColumns({"after": F.lead("node", size).over(w), "before": F.lag("node", size).over(w)})
        first, counts, second = F.col("i") % size == 0, F.col("n") > size, F.shiftright("i", k) % 2 == 1
        step = F.when(~counts, "").when(second, F.concat(F.lit("L"), "before")).otherwise(F.coalesce(F.concat(F.lit("R"), "after"), F.lit("N")))
        up = F.when(~counts, F.col("node")).otherwise(F.sha2(F.concat("node", F.coalesce("after", F.lit(""))), 256))
        rows = rows.withColumns({f"step{k}": F.when(first, step), "node": F.when(first & ~second, up)})
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = [F.last(f"step{k}", ignorenulls=True).over(back) for k in range(LEVELS)]
    return rows.withColumn("path", F.filter(F.array(*steps), lambda s: s != "")).withColumnRenamed("node", "top").drop("after", "before", *(f"step{k}" for k in range(LEVELS)))


def _tree(nodes: DataFrame, stored: Stored) -> tuple[DataFrame, list[DataFrame]]:
    """(roots (g, h), tables of each pass's nodes from the second on) of nodes (g, i, n, h)."""
    passes = []
    while True:
        tops = _levels(nodes).where(F.col("i") % (1 << LEVELS) == 0)
        tops = tops.select("g", F.shiftright("i", LEVELS).alias("i"), F.ceil(F.col("n") / (1 << LEVELS)).cast("long").alias("n"), F.col("top").alias("h"))
        nodes = stored.put(tops, "nodes")
        if nodes.where("n > 1").isEmpty():
            return nodes.select("g", "h"), passes
        passes.append(nodes)


def _paths(passes: list[DataFrame], stored: Stored) -> DataFrame | None:
    """(g, i, above): the steps from each node of the second pass to its root; None if there is one pass only."""
    above = None
    for nodes in reversed(passes):
        own = _levels(nodes)
        if above is not None:
            own = own.join(above.withColumnRenamed("i", "block"), ["g", "block"], "left").withColumn("path", F.concat("path", F.coalesce("above", F.array().cast("array<string>"))))
        above = stored.put(own.select("g", "i", F.col("path").alias("above")), "paths")
    return above


def merkle_audit(df: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "lang", changed: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of a table.

    A row's leaf hashes `columns`; leaves of a group ascend by `key`, and every two neighbours become their hash, the last of
    an odd run by itself, until one is left: the subroot. Subroots in the order of `group` (bytewise) give the root in the same way.
    `changed` says what stands in some columns at the time of the audit, null where nothing has changed; the root that follows from
    the changed leaf and the proof is compared with the root.

    Null keys come first in their group and null groups form one group, the first; rows of one key are ordered by their leaves, so equal rows have
    equal leaves and proofs of their own. Empty texts are values, null ones are not. An empty table gives no rows. Columns
    that aren't named are ignored. No text leaves the scan: what is shuffled are hashes, by ranges of (group, key), then by blocks of 2^10.
    """
    stored = Stored(df.sparkSession)
    changed = changed or {}
    now = [F.coalesce(changed[c], F.col(c)) if c in changed else F.col(c) for c in columns]
    differs = F.lit(False)
    for c, value in changed.items():
        differs = differs | value.isNotNull()
    leaves = df.select(F.col(group).alias("g"), F.col(key).alias("k"), leaf_hash([F.col(c) for c in columns]).alias("h"), F.when(differs, leaf_hash(now)).alias("found"))
    leaves = stored.put(numbered(stored.put(leaves, "leaves"), stored, ["g"], ["g", "k", "h"]), "numbered")
    if leaves.isEmpty():
        return df.sparkSession.createDataFrame([], f"{key} {dict(df.dtypes)[key]}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    # null and present groups apart in a text that is equal only to itself, so that joins and windows need no special case
    named = F.coalesce(F.concat(F.lit("="), F.col("g").cast("string")), F.lit("-"))
    nodes = leaves.withColumn("g", named)
    subroots, passes = _tree(nodes, stored)
    above = _paths(passes, stored)
    order = F.when(F.col("g") != "-", F.substr("g", F.lit(2)))
    tops = numbered(stored.put(subroots.select(order.alias("value"), "g", "h"), "tops"), stored, [], ["value"])
    tops = stored.put(tops.select(F.lit("").alias("g"), "i", "n", "h", F.col("g").alias("own")), "tops")
    roots, root_passes = _tree(tops, stored)
    root_paths = _paths(root_passes, stored)
    ends = _with_above(_levels(tops), root_paths).join(roots.withColumnRenamed("h", "root"), "g")
    ends = stored.put(ends.select(F.col("own").alias("g"), F.col("h").alias("subroot"), F.col("path").alias("to_root"), "root"), "ends")
    rows = _with_above(_levels(nodes), above).join(ends, "g").withColumn("path", F.concat("path", "to_root"))
    sibling = lambda s: F.substr(s, F.lit(2))
    side = lambda s, where: F.when(F.left(s, F.lit(1)) == where, sibling(s)).otherwise("")
    folded = F.aggregate("path", F.coalesce("found", "h"), lambda have, s: F.sha2(F.concat(side(s, "L"), have, side(s, "R")), 256))
    rows = rows.withColumns({"proof_sha256": F.sha2(F.array_join(F.transform("path", sibling), ""), 256), "folded_root": folded})
    return rows.select(F.col("k").alias(key), F.col("h").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _with_above(rows: DataFrame, above: DataFrame | None) -> DataFrame:
    """Rows of _levels() with the steps above their blocks added to their paths."""
    if above is None:
        return rows
    return rows.join(above.withColumnRenamed("i", "block"), ["g", "block"]).withColumn("path", F.concat("path", "above"))
