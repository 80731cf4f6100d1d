"""Near-duplicate vectors: spherical k-means cells, and blocked cosine products within cells.

Two unit vectors with cosine >= t are at most r = sqrt(2 - 2t) apart. If the other one's cell is j, then x lies at most r
beyond the plane halfway between its own centre i and centre j: x.(c_i - c_j) <= r |c_i - c_j|. So every vector visits, besides
its own cell, all cells for which that holds, and no pair is lost; each vector counts its links where it is at home.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, arrow_map, components

#: Rows that the centres are fitted on at most (the first by hash of their class), rows meant for a cell, centres at most (four
#: rows of the sample each), rows of a block.
FIT_ROWS, CELL_ROWS, MOST_CELLS, BLOCK_ROWS = 20_000, 2_000, 5_000, 2_000


def spherical_kmeans(unit: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Unit centres: the first vectors spread by farthest choice from a few, then means of the closest vectors, made unit again."""
    if not len(unit):
        return np.zeros((1, unit.shape[1] if unit.ndim == 2 else 1))
    k = max(1, min(k, len(unit)))
    centres = unit[np.random.default_rng(5).choice(len(unit), k, replace=False)]
    for _ in range(rounds):
        near = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def clean_vectors(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, dim, unit, usable): the vector in double precision divided by its length, as bytes.

    Not usable, with a null `unit`: null labels, and vectors that are null, empty, zero or hold null or non-finite parts.
    """

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            unit, dim = [], []
            for v, ok in zip(batch.column("v").to_pylist(), batch.column("label").is_valid().to_pylist()):
                x = np.array(v, np.float64) if ok and v and None not in v else np.zeros(0)
                size = math.sqrt(float(x @ x)) if len(x) and np.isfinite(x).all() else 0.0
                if len(x) and not (math.isfinite(size) and size > 1e-150):  # beyond the squares' range: scale first
                    top = np.abs(x).max() if np.isfinite(x).all() else 0.0
                    x = x / top if top > 0 else x
                    size = math.sqrt(float(x @ x)) if top > 0 else 0.0
                unit.append((x / size).tobytes() if size > 0 else None)
                dim.append(len(x) if size > 0 else None)
            return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(dim, pa.int32()), pa.array(unit, pa.binary())], ["vec_id", "label", "dim", "unit"])

        return run

    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, label)}
    rows = df.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return arrow_map(rows, make, f"vec_id {kinds[key]}, label {kinds[label]}, dim int, unit binary")


def _visits(centres: dict[int, np.ndarray], reach: float):
    """Adds the cells of each vector: its own first, then those that it visits."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            cells: list = [None] * len(dims)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                own = centres[int(d)]
                for part in np.array_split(at, -(-len(at) // 256)):
                    near = _vectors(batch.column("unit").take(pa.array(part))) @ own.T
                    home = near.argmax(1)
                    gaps = np.sqrt(np.maximum(2 - 2 * (own[home] @ own.T), 0))  # between unit centres
                    open_to = near[np.arange(len(part)), home][:, None] - near <= (reach + 1e-9) * gaps + 1e-7
                    open_to[np.arange(len(part)), home] = False
                    for row, h, o in zip(part, home, open_to):
                        cells[row] = [int(h), *np.flatnonzero(o).tolist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

        return run

    return make


def _compare(least: float):
    """Within a block pair: for each vector at home its number of links, and a spanning forest of the links found."""

    def run(pdf):
        import pandas as pd

        left = pdf[pdf["side"] == 0]
        right = pdf[pdf["side"] == 1]
        counts, links = [], []
        if len(left) and len(right):
            x = np.frombuffer(b"".join(left["unit"]), np.float64).reshape(len(left), -1)
            y = np.frombuffer(b"".join(right["unit"]), np.float64).reshape(len(right), -1)
            a, b, copies = left["vec_id"].to_numpy(np.int64), right["vec_id"].to_numpy(np.int64), right["copies"].to_numpy(np.int64)
            ids = np.unique(np.concatenate([a, b]))
            a_at, b_at, part = np.searchsorted(ids, a), np.searchsorted(ids, b), np.arange(len(ids))
            for s in range(0, len(a), 512):
                near = (x[s : s + 512] @ y.T >= least) & (a[s : s + 512, None] != b[None])
                n = near @ copies
                for r in np.flatnonzero(n):
                    counts.append((int(a[s + r]), int(n[r])))
                    met = np.append(b_at[near[r]], a_at[s + r])
                    own, first = np.unique(part[met], return_index=True)
                    if len(own) > 1:  # the links that join parts so far apart make a spanning forest
                        links += [(int(a[s + r]), int(w)) for w in ids[met[first]] if w != a[s + r]]
                        part[np.isin(part, own)] = own[0]
        rows = [(v, n, None, None) for v, n in counts] + [(None, None, v, w) for v, w in links]
        return pd.DataFrame(rows, columns=["vec_id", "n", "a", "b"]).astype({c: "Int64" for c in ("vec_id", "n", "a", "b")})

    return run


def near_vectors(df: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row a vector; links are pairs of equal label and length with cosine >= least.

    Vectors that are null, empty, zero or hold null or non-finite parts, and those with a null label, are linked with
    nothing. Equal vectors of a label are one class with a multiplicity, so copies aren't expanded into pairs. Ids may be of
    any type with an order; rows of one id with several vectors count each for itself. Rows with a null id have a null
    component and are kept. Other columns are left out; an empty table gives no rows.
    """
    spark = df.sparkSession
    stored = Stored(spark)
    rows = stored.put(clean_vectors(df, key, vector, label), "vectors")
    usable = rows.where("vec_id is not null and unit is not null")
    classes = usable.groupBy("label", "dim", "unit").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # a class has a number of its own, as an id may stand for several vectors; it is stored, so it stays
    reps = stored.put(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    dims = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).collect()}
    sample = reps.orderBy(F.xxhash64("rep")).limit(FIT_ROWS).select("dim", "unit").collect()
    centres = {}
    for d, n in dims.items():
        own = [np.frombuffer(r["unit"], np.float64) for r in sample if r["dim"] == d]
        k = min(MOST_CELLS, -(-n // CELL_ROWS))
        centres[d] = spherical_kmeans(np.array(own), k) if own else np.eye(1, d)
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    placed = stored.put(arrow_map(reps, _visits(centres, reach), reps.schema.simpleString()[7:-1].replace(",", ", ").replace(":", " ") + ", cells array<int>"), "placed")

    # blocks: homes of a cell in `own` blocks by hash; all that are at home in it or visit it in `all` blocks
    at_home = placed.select("label", "dim", F.col("cells")[0].alias("cell"), "rep", "copies", "unit")
    inside = placed.select("label", "dim", F.explode("cells").alias("cell"), "rep", "copies", "unit")
    keys = ["label", "dim", "cell"]
    sizes = at_home.groupBy(keys).agg(F.count("*").alias("homes")).join(inside.groupBy(keys).agg(F.count("*").alias("everyone")), keys)
    sizes = sizes.select(*keys, F.expr(f"(homes + {BLOCK_ROWS - 1}) div {BLOCK_ROWS}").alias("own"), F.expr(f"(everyone + {BLOCK_ROWS - 1}) div {BLOCK_ROWS}").alias("all"))
    left = at_home.join(sizes, keys).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("own"))).withColumn("j", F.explode(F.expr("sequence(0L, all - 1)"))).withColumn("side", F.lit(0))
    right = inside.join(sizes, keys).withColumn("j", F.pmod(F.xxhash64("rep"), F.col("all"))).withColumn("i", F.explode(F.expr("sequence(0L, own - 1)"))).withColumn("side", F.lit(1))
    picked = [*keys, "i", "j", "side", F.col("rep").alias("vec_id"), "copies", "unit"]
    found = left.select(picked).unionByName(right.select(picked)).groupBy(*keys, "i", "j").applyInPandas(_compare(least), "vec_id long, n long, a long, b long")
    found = stored.put(found, "found")
    links = components(found.where("a is not null").select("a", "b"), stored)
    counts = found.where("vec_id is not null").groupBy(F.col("vec_id").alias("rep")).agg(F.sum("n").alias("n"))
    linked = stored.put(reps.join(links.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "label", "dim", "unit", "least", "copies", F.coalesce("component", "rep").alias("component")), "linked")
    # stored, so that a hot component can be split where it is joined
    smallest = stored.put(linked.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    by_class = stored.put(
        linked.join(counts, "rep", "left").join(smallest, "component").select("label", "dim", "unit", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "by_class",
    )
    linked = usable.join(by_class, ["label", "dim", "unit"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("vec_id is null or unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(rest)
    return out.select(F.col("vec_id").alias(key), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
