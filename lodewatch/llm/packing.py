"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Pieces of one length are interchangeable, so a piece is its length and its rank among those. Lengths are taken in bands from
the longest on. A round range-sorts the bins by gap and sweeps over both orders, twice: down, to find the pieces that can be
served (as a length comes up, it may take any larger gap that isn't taken; where none is, the surplus waits for a later
round), and up, to find their successors: as gaps grow, the pieces that fit arrive, and each gap serves as many of those that
wait as its bins have room for. Ranks settle who gets which bin: the bins of a gap are ranked, too, and take the ranks served
there in order. Then the gaps shrink by what was put in, and the next round begins. When a round places too little, bins
are opened for what is left.

The sweeps are a few window functions over sorted runs of equal lengths and gaps (a run is split where it has too many rows
for a task), of which there are `size` and a thousand at most, whatever the input. Bins and pieces are rows of tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored, arrow_map
from .tokens import id_pieces

#: Runs are split into parts of this share of all rows, or of LEAST_PART rows if that is more.
PART_SHARE, LEAST_PART = 1_000, 1_000
#: No bins are opened in a round that places this share of what was left.
ENOUGH = 0.3
_BINS = "bin long, gap int, ranks array<bigint>, offsets array<int>"


def band_ends(size: int) -> list[int]:
    """Upper ends of the bands of lengths, longest first: size / 1 to size / 8, of which a new bin holds 1 to 8, then quarters."""
    ends = [size // k for k in range(1, 9)]
    while ends[-1] > 1:
        ends.append(max(1, ends[-1] // 4))
    return sorted({e for e in ends if e > 0}, reverse=True)


def _parts(n: Column, total: int) -> Column:
    """Into how many parts a run of n rows is split."""
    return F.ceil(n / max(LEAST_PART, total // PART_SHARE)).cast("int")


def _dealt(rows: DataFrame, run: str, total: int, *by: str) -> DataFrame:
    """Adds the part of its run that a row belongs to."""
    parts = rows.groupBy(run).agg(_parts(F.count("*"), total).alias("_parts"))
    return rows.join(F.broadcast(parts), run).withColumn("_part", F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int")).drop("_parts")


def sweep(lengths: DataFrame, gaps: DataFrame, hi: int) -> DataFrame:
    """Whom a round serves. Rows of side 0: (length, used), pieces served; of side 1: (gap, part, slots, first, used), for each run
    of bins how many pieces it serves, and the number of the first of them in the order of lengths.

    lengths: (length, n), the pieces left, none longer than hi. gaps: (gap, part, n), runs of n bins; a bin has room for
    gap / hi of them, or for one that fits.
    """
    slots = F.greatest(F.lit(1), F.expr(f"gap div {hi}")).cast("int")
    none = F.lit(None).cast("int")
    both = lengths.select(F.col("length").alias("fits"), F.lit(0).alias("side"), none.alias("gap"), none.alias("part"), none.alias("slots"), "n").unionByName(
        gaps.select(F.least("gap", F.lit(hi)).alias("fits"), F.lit(1).alias("side"), "gap", "part", slots.alias("slots"), (F.col("n") * slots).alias("n"))
    )
    down = Window.orderBy(F.desc("fits"), F.desc("side"), F.desc("gap"), F.desc("part"))
    up = Window.orderBy("fits", "side", "gap", "part")
    sums = lambda side, by: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    # the pieces for which there was no gap, down to a length; then those served
    short = both.withColumn("want", sums(0, down) - sums(1, down))
    short = short.withColumn("short", F.greatest(F.lit(0), F.max("want").over(down.rowsBetween(Window.unboundedPreceding, 0))))
    chosen = short.withColumn("n", F.when(F.col("side") == 0, F.col("n") - F.col("short") + F.coalesce(F.lag("short").over(down), F.lit(0))).otherwise(F.col("n")))
    # served up to a gap: all room so far, but for what stood empty while nothing waited
    room = chosen.withColumns({"come": sums(0, up), "room": sums(1, up)})
    served = room.withColumn("served", F.col("room") + F.least(F.lit(0), F.min(F.when(F.col("side") == 1, F.col("come") - F.col("room"))).over(up.rowsBetween(Window.unboundedPreceding, 0))))
    served = served.withColumn("first", F.coalesce(F.max(F.when(F.col("side") == 1, F.col("served"))).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    used = F.when(F.col("side") == 0, F.col("n")).otherwise(F.col("served") - F.col("first"))
    return served.select("side", F.col("fits").alias("length"), "gap", "part", "slots", "first", used.alias("used")).where("used > 0")


def _filled(pieces: list[tuple[int, int, int]], runs: list[tuple[int, int, int, int, int]], size: int):
    """Puts the pieces that a run of bins serves into its bins, in the order of the bins' ranks.

    pieces: (length, rank, n) in the order in which they are served; runs: (gap, part, slots, first, used).
    """
    length, rank, n = np.array(pieces, np.int64).T
    begin = np.cumsum(n) - n
    gap, part, slots, first, used = np.array(sorted(runs), np.int64).T
    width = int(part.max()) + 2
    keys = gap * width + part + 1

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            gap, part, own = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("gap", "_part", "_rank"))
            key = np.where(part + 1 < width, gap * width + part + 1, -1)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            count = np.where(keys[at] == key, np.clip(used[at] - own * slots[at], 0, slots[at]), 0)
            ends = np.cumsum(count)
            number = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[at] + own * slots[at] - ends + count, count)
            which = np.searchsorted(begin, number, "right") - 1
            sums = np.concatenate([[0], np.cumsum(length[which])])
            put = sums[ends] - sums[ends - count]
            offsets = sums[:-1] + np.repeat(size - gap - sums[ends - count], count)
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(x)) for x in (rank[which] + number - begin[which], offsets.astype(np.int32))]
            return pa.RecordBatch.from_arrays([batch.column("bin"), pa.array((gap - put).astype(np.int32)), *lists], ["bin", "gap", "ranks", "offsets"])

        return run

    return make


def fill_bins(spark: SparkSession, counts: dict[int, int], size: int, stored: Stored) -> list[DataFrame]:
    """The rounds: tables of bins, with the ranks (in the order of lengths) put into each in that round, and their offsets.

    What comes to the driver are the runs that a round serves.
    """
    lengths, rank = sorted(counts), 0
    following = {}  # the rank of the next piece of each length
    for k in lengths:
        following[k], rank = rank, rank + counts[k]
    left, bins, tables, opened = dict(counts), spark.createDataFrame([], "bin long, gap int"), [], 0
    ends = band_ends(size)

    def take(served: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        out = [(k, following[k], n) for k, n in served]
        for k, n in served:
            following[k] += n
            left[k] -= n
        return out

    for hi, lo in zip(ends, [*ends[1:], 0]):
        own = [k for k in lengths if lo < k <= hi]
        while before := sum(left[k] for k in own):
            able = _dealt(bins.where(F.col("gap") > lo), "gap", opened, "bin").withColumn("_rank", F.row_number().over(Window.partitionBy("gap", "_part").orderBy("bin")) - 1)
            gaps = able.groupBy("gap", F.col("_part").alias("part")).agg(F.count("*").alias("n"))
            waiting = spark.createDataFrame([(k, left[k]) for k in own if left[k]], "length int, n long")
            found = sweep(waiting, gaps, hi).collect() if opened else []
            pieces = take(sorted((r["length"], r["used"]) for r in found if r["side"] == 0))
            runs = [(r["gap"], r["part"], r["slots"], r["first"], r["used"]) for r in found if r["side"] == 1]
            served = sum(n for _, _, n in pieces)
            rest = before - served
            if rest and served < ENOUGH * before:  # bins for what is left, as few as can hold it
                more = max(-(-rest // (size // (lo + 1))), -(-sum(k * left[k] for k in own) // size))
                room = min(rest, more * (size // hi))
                runs.append((size, -1, size // hi, served, room))
                new = []
                for k in own:
                    new.append((k, min(left[k], room)))
                    room -= new[-1][1]
                pieces += take([x for x in new if x[1]])
                able = able.unionByName(spark.range(more).select((F.col("id") + opened).alias("bin"), F.lit(size).alias("gap"), F.lit(-1).alias("_part"), F.col("id").cast("int").alias("_rank")))
                opened += more
            idle = bins.where(F.col("gap") <= lo).select("bin", "gap", F.array().cast("array<bigint>").alias("ranks"), F.array().cast("array<int>").alias("offsets"))
            tables.append(stored.put(arrow_map(able, _filled(pieces, runs, size), _BINS).unionByName(idle), "bins"))
            bins = tables[-1].where("gap > 0").select("bin", "gap")
    return tables


def pack_pieces(pieces: DataFrame, size: int, stored: Stored) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` from 1 to size. `pieces` must be stable, as a stored table is."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `size` rows at most
    rounds = fill_bins(spark, counts, size, stored)
    if not rounds:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    dealt = _dealt(pieces, "length", sum(counts.values()), *pieces.columns)
    before = Window.orderBy("length", "_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*pieces.columns)) - 1
    ranked = dealt.withColumn("_own", own).join(F.broadcast(parts), ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_own"))
    places = stored.again(rounds).select("bin", F.explode(F.arrays_zip("ranks", "offsets")).alias("x")).select("bin", F.col("x.ranks").alias("_rank"), F.col("x.offsets").alias("_offset"))
    return ranked.join(places, "_rank").select(*pieces.columns, F.col("bin").alias("sequence_id"), F.col("_offset").cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every text's tokens placed in sequences of `size`.

    A text is its ids and a closing id 0; only a longer one than `size` is cut. Null and empty texts hold the closing id
    alone. Repeated rows are packed each for itself; ties are broken by the whole row; an empty table gives no rows;
    columns other than key and text are left out, whatever their names.
    """
    stored = Stored(docs.sparkSession)
    pieces = stored.put(id_pieces(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), tokenizer, size), "pieces")
    return pack_pieces(pieces, size, stored).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
