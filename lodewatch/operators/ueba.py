"""Behaviour scores: each event against its user's profile before it, then the profile with it.

Input: flat events. Profiles are exponentially weighted (alpha 2/31) over every event of a user: values that aren't positive
age nothing, so no number of latest rows would do. An event takes (1, m, m^2, s^2) to the next by a linear map, so a run of
events is one map as well, of five numbers. A user's history, in order over all partitions, is cut in pieces of 2^PIECE_BITS events; the maps of
pieces follow from running sums, their products from a scan of the pieces, and the profile before each event from its piece's
start and running sums again. So one user's events are many tasks' work, and no step goes row by row in Python.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewatch.sources.shared import Scratch, in_order

ALPHA = 2.0 / 31
ANOMALY, MOST_LOCATIONS, MOST_DEVICES = 0.7, 50, 20
USER = ("tenant_id", "actor_user")


def volume() -> Column:
    return F.coalesce(F.col("bytes_out").cast("double") / 1e6, F.lit(0.0))


def login() -> Column:
    return F.when(F.col("category_name") == "authentication", 1.0).otherwise(0.0)


def remember(known: dict, x, most: int) -> bool:
    """Whether x is new to the known places, which then take it in; of more than `most`, the one that came first goes."""
    if x in known:
        return False
    known[x] = None
    if len(known) > most:
        del known[next(iter(known))]
    return True


#: Events of a user that are one piece, and pieces that are one part of the scan, as powers of two. Sums within a piece are scaled by BETA^-n, so a piece must be short enough for doubles.
PIECE_BITS, PART_BITS = 10, 10
BETA = 1 - ALPHA
_BEFORE = ("_p", "_q", "_new_place", "_new_device")


def _power(n: Column) -> Column:
    return F.pow(F.lit(BETA), n)


def _map(b, m, v0, v1, v2, logins) -> Column:
    """What a run of events does to a profile: m -> m + b m0, s^2 -> v0 + v1 m0 + v2 m0^2 + b s0^2, logins more."""
    return F.struct(b.alias("b"), m.alias("m"), v0.alias("v0"), v1.alias("v1"), v2.alias("v2"), logins.alias("logins"))


def _then(f: Column, g: Column) -> Column:
    """The map of one run and then another."""
    return _map(
        f["b"] * g["b"], g["m"] + g["b"] * f["m"], g["v0"] + g["v1"] * f["m"] + g["v2"] * f["m"] * f["m"] + g["b"] * f["v0"],
        g["v1"] * f["b"] + 2 * g["v2"] * f["m"] * f["b"] + g["b"] * f["v1"], g["v2"] * f["b"] * f["b"] + g["b"] * f["v2"], f["logins"] + g["logins"],
    )


def _same() -> Column:
    return _map(F.lit(1.0), *(F.lit(0.0),) * 4, F.lit(0).cast("long"))


def _profile(f: Column, start_m: Column, start_v: Column) -> Column:
    return F.struct((f["m"] + f["b"] * start_m).alias("m"), (f["v0"] + f["v1"] * start_m + f["v2"] * start_m * start_m + f["b"] * start_v).alias("v"), f["logins"].alias("logins"))


def _running(rows: DataFrame) -> DataFrame:
    """Adds, for each row, its count of positive values within its piece before it (_k), and the mean that they have from nothing (_m)."""
    before = Window.partitionBy(*USER, "_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_k", F.coalesce(F.sum((F.col("_v") > 0).cast("long")).over(before), F.lit(0)))
    scaled = F.when(F.col("_v") > 0, F.col("_v") / _power(F.col("_k") + 1))
    return rows.withColumn("_m", F.coalesce(F.sum(scaled).over(before), F.lit(0.0)) * ALPHA * _power(F.col("_k")))


def _piece_maps(rows: DataFrame) -> DataFrame:
    """(user, _piece, map) of every piece."""
    taken, k, d = F.col("_v") > 0, F.col("_k"), F.col("_v") - F.col("_m")
    sums = _running(rows).groupBy(*USER, "_piece").agg(
        F.coalesce(F.sum(F.when(taken, d * d / _power(k + 1))), F.lit(0.0)).alias("q"), F.coalesce(F.sum(F.when(taken, d)), F.lit(0.0)).alias("d"), F.count_if(taken).alias("n"),
        F.coalesce(F.sum(F.when(taken, F.col("_v") / _power(k + 1))), F.lit(0.0)).alias("x"), F.sum(F.col("_l").cast("long")).alias("logins"),
    )
    b = _power(F.col("n"))
    return sums.select(*USER, "_piece", _map(b, ALPHA * b * F.col("x"), ALPHA * BETA**2 * b * F.col("q"), -2 * ALPHA * BETA * b * F.col("d"), BETA * b * (1 - b), F.col("logins")).alias("map"))


def _starts(pieces: DataFrame, by: list[str], key: str, start: Column) -> DataFrame:
    """(by, key, profile): the profile before each piece of a group, from the one that the group starts with. Groups are arrays of pieces, folded by expressions."""
    state = F.struct(start.alias("now"), F.array().cast("array<struct<key: bigint, profile: struct<m: double, v: double, logins: bigint>>>").alias("out"))

    def step(acc, x):
        out = F.concat(acc["out"], F.array(F.struct(x[key].alias("key"), acc["now"].alias("profile"))))
        now, f = acc["now"], x["map"]
        after = _profile(f, now["m"], now["v"])
        return F.struct(F.struct(after["m"].alias("m"), after["v"].alias("v"), (now["logins"] + f["logins"]).alias("logins")).alias("now"), out.alias("out"))

    gathered = pieces.groupBy(*by, *(["start"] if "start" in pieces.columns else [])).agg(F.array_sort(F.collect_list(F.struct(key, "map"))).alias("pieces"))
    found = gathered.select(*by, F.explode(F.aggregate("pieces", state, step, lambda acc: acc["out"])).alias("x"))
    return found.select(*by, F.col("x.key").alias(key), F.col("x.profile").alias("profile"))


def _piece_starts(maps: DataFrame) -> DataFrame:
    """(user, _piece, profile): a scan of the pieces' maps in parts of 2^PART_BITS pieces."""
    maps = maps.withColumn("_part", F.shiftright("_piece", PART_BITS))
    whole = maps.groupBy(*USER, "_part").agg(F.array_sort(F.collect_list(F.struct("_piece", "map"))).alias("pieces"))
    whole = whole.select(*USER, "_part", F.aggregate("pieces", _same(), lambda acc, x: _then(acc, x["map"])).alias("map"))
    new = F.struct(F.lit(0.0).alias("m"), F.lit(1.0).alias("v"), F.lit(0).cast("long").alias("logins"))
    parts = _starts(whole, [*USER], "_part", new).withColumnRenamed("profile", "start")
    return _starts(maps.join(parts, [*USER, "_part"]), [*USER, "_part"], "_piece", F.col("start")).drop("_part")


def _arrivals(rows: DataFrame, value: str, most: int) -> DataFrame:
    """(user, value, _at) of the rows whose value is none of the user's last `most` arrivals: those that a list of that length, first in first out, takes in.

    For users with no more values than that these are the first rows of each. Only the others' changes of value are gone through in order, batch by batch.
    """
    first = rows.groupBy(*USER, F.col(value).alias("value")).agg(F.min("_at").alias("_at"))
    many = first.groupBy(*USER).count().where(F.col("count") > most).select(*USER)
    if many.isEmpty():
        return first
    own = rows.join(many, [*USER], "left_semi").select(*USER, F.col(value).alias("value"), "_at")
    own = own.withColumn("_last", F.lag(F.struct("value")).over(Window.partitionBy(*USER).orderBy("_at"))).where("_last is null or not (_last.value <=> value)").drop("_last")

    def run(batches):
        user, known = None, {}
        for batch in batches:
            keep = []
            for i, (tenant, name, x) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                if (tenant, name) != user:
                    user, known = (tenant, name), {}
                if remember(known, x, most):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    changes = own.repartition(*USER).sortWithinPartitions(*USER, "_at").mapInArrow(run, own.schema)
    return first.join(many, [*USER], "left_anti").unionByName(changes)


def _known(arrivals: DataFrame, most: int, name: str) -> DataFrame:
    """(user, name): the values that the list holds at the end, its last `most` arrivals, in order of their names."""
    latest = arrivals.withColumn("_n", F.row_number().over(Window.partitionBy(*USER).orderBy(F.desc("_at")))).where(F.col("_n") <= most)
    return latest.groupBy(*USER).agg(F.array_sort(F.collect_list("value")).alias(name))


def _ordered(own: DataFrame, scratch: Scratch) -> DataFrame:
    rows = in_order(own.withColumns({"_v": volume(), "_l": login()}), scratch, [*USER, "time", "uuid"])
    return rows.withColumn("_piece", F.shiftright("_at", PIECE_BITS))


def _profiles(rows: DataFrame, extra: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Adds the profiles _p and _q, structs (m, s) of volumes and logins, before each row of _ordered(), and the columns of `extra` by piece."""
    starts = scratch.put(_piece_starts(scratch.put(_piece_maps(rows), "maps")), "starts")
    if extra is not None:
        starts = starts.join(extra, [*USER, "_piece"], "left")
    rows = _running(rows.join(starts, [*USER, "_piece"]))
    before = Window.partitionBy(*USER, "_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    m = F.col("_m") + _power(F.col("_k")) * F.col("profile.m")
    rows = rows.withColumn("_mean", m)
    # with the mean before it known, an event adds ALPHA BETA^2 (x - m)^2 to what is left of the variance
    added = F.when(F.col("_v") > 0, ALPHA * BETA**2 * F.pow(F.col("_v") - F.col("_mean"), F.lit(2.0)) / _power(F.col("_k") + 1))
    rows = rows.withColumns({"_var": _power(F.col("_k")) * (F.col("profile.v") + F.coalesce(F.sum(added).over(before), F.lit(0.0))), "_logins": F.col("profile.logins") + F.coalesce(F.sum(F.col("_l").cast("long")).over(before), F.lit(0))})
    return rows.withColumns({"_p": F.struct(F.col("_mean").alias("m"), F.sqrt(F.greatest("_var", F.lit(0.0))).alias("s")), "_q": _login_profile(F.col("_logins"))})


def _login_profile(n: Column) -> Column:
    """After n logins, each of which counts 1."""
    b = _power(n)
    return F.struct((1 - b).alias("m"), F.sqrt(b + BETA * b * (1 - b)).alias("s"))


_SCRATCH_COLUMNS = ("_v", "_l", "_at", "_piece", "_k", "_m", "_mean", "_var", "_logins", "profile", "_places", "_devices")


def _with_profiles(own: DataFrame) -> DataFrame:
    """Adds _p and _q before each row, and whether its place and its device are new."""
    scratch = Scratch(own.sparkSession)
    rows = _ordered(own, scratch)
    by_piece = lambda c, most, name: _arrivals(rows, c, most).groupBy(*USER, F.shiftright("_at", PIECE_BITS).alias("_piece")).agg(F.collect_list("_at").alias(name))  # noqa: E731  at most a piece's rows
    new = by_piece("src_location", MOST_LOCATIONS, "_places").join(by_piece("device_id", MOST_DEVICES, "_devices"), [*USER, "_piece"], "full")
    there = lambda name: F.coalesce(F.array_contains(name, F.col("_at")), F.lit(False))
    out = _profiles(rows, scratch.put(new, "arrivals"), scratch).withColumns({"_new_place": there("_places"), "_new_device": there("_devices")})
    return out.drop(*_SCRATCH_COLUMNS)


def _deviation(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std == 0, 0.0).otherwise(F.abs((value - mean) / std))


def features(df: DataFrame, profile: Column | None = None, logins: Column | None = None, place: Column | None = None, device: Column | None = None) -> DataFrame:
    """Adds f0 to f9; profile and logins are structs (m, s) before the event, by default those of a new user.

    place and device say whether the event's are new; by default they are if the user's earlier events have none alike.
    """
    new = F.struct(F.lit(0.0).alias("m"), F.lit(1.0).alias("s"))
    p, q = profile if profile is not None else new, logins if logins is not None else new
    seen = lambda c: F.row_number().over(Window.partitionBy(*USER, c).orderBy("time", "uuid")) == 1
    return df.withColumns(
        {
            "f0": F.hour("time"), "f1": F.dayofweek("time") - 1, "f2": volume(),
            "f3": _deviation(volume(), p["m"], p["s"]), "f4": _deviation(F.lit(1.0), q["m"], q["s"]),
            "f5": place if place is not None else seen("src_location"), "f6": device if device is not None else seen("device_id"), "f7": F.lit(0.0), "f8": F.col("privilege_escalation"),
            "f9": (F.col("category_name") == "authentication") & (F.col("outcome") == "failure"),
        }
    )


def rule_score() -> Column:
    """From f3 to f9, at most 1."""
    part = lambda on, w: F.when(on, w).otherwise(0.0)
    return F.least(F.lit(1.0), part(F.col("f3") > 3, 0.3) + part(F.col("f4") > 3, 0.2) + part(F.col("f5"), 0.2) + part(F.col("f6"), 0.15) + part(F.col("f8"), 0.3) + part(F.col("f9"), 0.15))


def score_history(df: DataFrame) -> DataFrame:
    """Every event with its score against the profile before it; events without a user pass with a null score."""
    own, rest = df.where(F.col("actor_user").isNotNull()), df.where(F.col("actor_user").isNull())
    scored = features(_with_profiles(own), *(F.col(c) for c in _BEFORE)).withColumn("ueba_score", rule_score()).drop(*_BEFORE)
    return scored.unionByName(rest.withColumn("ueba_score", F.lit(None).cast("double")), allowMissingColumns=True)


def build_profiles(df: DataFrame) -> DataFrame:
    """(tenant_id, actor_user, avg_volume, std_volume, avg_logins, std_logins, event_count, last_seen, known_locations, known_devices).

    Every row counts. Known places are the last MOST_LOCATIONS and MOST_DEVICES to come in, in order of their names.
    """
    own = df.where(F.col("actor_user").isNotNull()).select(*USER, "time", "uuid", "bytes_out", "category_name", "src_location", "device_id")
    scratch = Scratch(df.sparkSession)
    rows = _ordered(own, scratch)
    maps = scratch.put(_piece_maps(rows), "maps")
    parts = maps.withColumn("_part", F.shiftright("_piece", PART_BITS))
    joined = lambda df, by, key: df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(key, "map"))).alias("all")).select(*by, F.aggregate("all", _same(), lambda acc, x: _then(acc, x["map"])).alias("map"))
    whole = joined(joined(parts, [*USER, "_part"], "_piece"), [*USER], "_part")
    end, q = _profile(F.col("map"), F.lit(0.0), F.lit(1.0)), _login_profile(F.col("map.logins"))
    folded = whole.select(*USER, end["m"].alias("avg_volume"), F.sqrt(F.greatest(end["v"], F.lit(0.0))).alias("std_volume"), q["m"].alias("avg_logins"), q["s"].alias("std_logins"))
    counts = rows.groupBy(*USER).agg(F.count("*").alias("event_count"), F.max("time").alias("last_seen"))
    places, devices = _known(_arrivals(rows, "src_location", MOST_LOCATIONS), MOST_LOCATIONS, "known_locations"), _known(_arrivals(rows, "device_id", MOST_DEVICES), MOST_DEVICES, "known_devices")
    found = folded.join(counts, [*USER]).join(places, [*USER], "left").join(devices, [*USER], "left")
    return scratch.put(found.select(*USER, "avg_volume", "std_volume", "avg_logins", "std_logins", "event_count", "last_seen", "known_locations", "known_devices"), "profiles")


def profile_of(profiles: DataFrame, tenant: str, user: str) -> DataFrame:
    """The profile of a tenant's user."""
    return profiles.where((F.col("tenant_id") == F.lit(tenant)) & (F.col("actor_user") == F.lit(user)))


def put_profiles(profiles: DataFrame, new: DataFrame) -> DataFrame:
    """The table with new profiles in place of those of the same users."""
    return profiles.join(new.select(*USER).distinct(), [*USER], "left_anti").unionByName(new)


def delete_profiles(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """The table without the profiles of these (tenant_id, actor_user)."""
    return profiles.join(users.select(*USER).distinct(), [*USER], "left_anti")


def profiles_exist(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """(tenant_id, actor_user, exists) of the users asked for, each once."""
    known = profiles.select(*USER).distinct().withColumn("exists", F.lit(True))
    return users.select(*USER).distinct().join(known, [*USER], "left").select(*USER, F.coalesce("exists", F.lit(False)).alias("exists"))


def live_profiles(profiles: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    """Profiles seen within the last `days`."""
    return profiles.where(F.col("last_seen") >= F.lit(as_of).cast(profiles.schema["last_seen"].dataType) - F.expr(f"interval {days} days"))


def ueba_alerts(scored: DataFrame, threshold: float = ANOMALY) -> DataFrame:
    """Alerts for scores from the threshold on: severity 5 from 0.9, 4 from 0.8, else 3."""
    s = F.col("ueba_score")
    return scored.where(s >= threshold).select(
        F.sha2(F.concat_ws("|", F.lit("ueba"), "tenant_id", "uuid"), 256).alias("id"), "uuid", "time", "tenant_id", F.when(s >= 0.9, 5).when(s >= 0.8, 4).otherwise(3).alias("severity"),
        F.concat(F.lit("Anomalous behaviour of "), "actor_user").alias("title"), F.format_string("score %.2f", s).alias("description"), "ueba_score",
    )


def score_with_model(df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """Adds ueba_score from f0 to f9: predict(frame of features), clamped to 0..1, 0 where it fails; without a model the rule score."""
    if predict is None:
        return df.withColumn("ueba_score", rule_score())
    names = [f"f{i}" for i in range(10)]

    @F.pandas_udf("double")
    def scored(batches: pd.DataFrame) -> pd.Series:
        try:
            return pd.Series(predict(batches[names].astype(float))).astype(float).fillna(0.0).clip(0.0, 1.0)
        except Exception:  # a model's failure must not stop the job: such events score 0
            return pd.Series(0.0, index=batches.index)

    return df.withColumn("ueba_score", scored(F.struct(*(F.col(n).cast("double").alias(n) for n in names))))
