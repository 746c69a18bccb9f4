"""Circles, rotations, spread, drops and the context of a death."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.norm import distance
from matchlake.operators.mates import nearest_mates, still_up
from matchlake.operators.spatial import near_in_space_and_time
from matchlake.operators.temporal import asof

M, KEYS = "match_id", ["match_id", "account_id"]

#: Accounts times circles that are compared at once.
AT_ONCE = 1 << 18


def zone_play(roster: DataFrame, phases: DataFrame, track: DataFrame, zones: DataFrame, max_lag: float) -> DataFrame:
    """Membership of every account at a phase's announcement and close, and its state and place against the circle at the close.

    phases: match_id, idx, phase, phase_kind, t_s, members (array of accounts); the later of several events of one kind wins.
    track: its samples with alive and riding. The sample nearest the close counts, or the announcement without a close. A circle
    with a radius of zero is a placeholder. A phase nobody could judge (no sample near it and not named) gives no row.
    """
    p = phases.groupBy(M, "phase", "phase_kind").agg(F.max_by(F.struct("t_s", "members"), "idx").alias("p"))
    at = p.groupBy(M, "phase").agg(*[F.max(F.when(F.col("phase_kind") == k, F.col("p"))).alias(k) for k in ("announce", "close")])
    at = at.withColumn("t_s", F.coalesce("close.t_s", "announce.t_s"))
    named = lambda k: F.array_contains(F.col(k)["members"], F.col("account_id"))
    times = [F.col(f"{k}.t_s").alias(f"{k}_t") for k in ("announce", "close")] + [named(k).alias(f"in_at_{k}") for k in ("announce", "close")]
    rows = at.join(roster.select(*KEYS), M).select(*KEYS, "phase", *times, "t_s")
    real = zones.withColumns({c: F.when(F.col("zr") > 0, F.col(c)) for c in ("zx", "zy")})
    circle = asof(at.select(M, "phase", "t_s"), real, [M], "t_s", ["idx", "zx", "zy", "zr"], "backward", ["idx"], prefix="z_")
    circle = circle.select(M, "phase", *[F.col(f"z_{c}").alias(c) for c in ("zx", "zy", "zr")])
    placed = asof(rows, track, KEYS, "t_s", ["idx", "x", "y", "alive", "riding"], "nearest", ["idx"], max_lag).join(circle, [M, "phase"], "left")
    centre = distance(F.col("s_x"), F.col("s_y"), F.col("zx"), F.col("zy"))
    seen = F.col("s_x").isNotNull() | F.coalesce("in_at_announce", F.lit(False)) | F.coalesce("in_at_close", F.lit(False))
    state = [F.col("s_alive").alias("alive"), (F.col("s_riding").isNotNull() & F.col("s_x").isNotNull()).alias("in_vehicle")]
    shown = ["phase", "announce_t", "close_t", "in_at_announce", "in_at_close"]
    return placed.where(seen).select(*KEYS, *shown, *state, centre.alias("to_centre"), (F.col("zr") - centre).alias("to_edge"), F.col("s_lag").alias("sample_lag"))


def blue_dwell(track: DataFrame, cap: float = 15.0) -> DataFrame:
    """Seconds in the closing zone: of each sample inside, alive and landed the time to the next, cap at most. Null for accounts that never landed."""
    ahead = F.lead("t_s").over(Window.partitionBy(*KEYS).orderBy("t_s", "idx")) - F.col("t_s")
    t = track.withColumn("_d", ahead)
    inside = F.when(F.col("in_blue") & F.col("alive") & (F.col("t_s") >= F.col("land_t")), F.least("_d", F.lit(cap)))
    return t.groupBy(*KEYS).agg(F.when(F.max("land_t").isNotNull(), F.coalesce(F.sum(inside), F.lit(0))).alias("blue_s"))


def _first_inside(samples: pa.Table, circles: pa.Table) -> pa.Table:
    """Per account of samples (by first sights: times, places, landing) the sum of lags and the number of circles that it was seen in."""
    circles = circles.sort_by("announced")
    announced, zx, zy, zr = (circles.column(c).to_numpy() for c in ("announced", "zx", "zy", "zr"))
    code = samples.column("account_id").combine_chunks().dictionary_encode()
    account, names = code.indices.to_numpy(zero_copy_only=False), code.dictionary
    t, land, x, y = (samples.column(c).to_numpy() for c in ("t", "land", "x", "y"))
    order = np.lexsort((t, account))
    begin = np.searchsorted(account[order], np.arange(len(names) + 1))
    lag, n = np.zeros(len(names)), np.zeros(len(names), np.int64)
    # accounts by their last sample, so that a block meets only circles announced by then
    by_end = np.argsort(t[order[begin[1:] - 1]], kind="stable") if len(names) else np.arange(0)
    at = 0
    while at < len(by_end):
        block = by_end[at : at + max(1, AT_ONCE // max(1, len(announced)))]
        at += len(block)
        until = np.searchsorted(announced, t[order[begin[block + 1] - 1]].max(), "right")
        seen = np.zeros((len(block), until), bool)
        for rank in range((begin[block + 1] - begin[block]).max()):
            has = np.flatnonzero(begin[block] + rank < begin[block + 1])
            s = order[begin[block[has]] + rank]
            px, py, pt = x[s][:, None] - zx[:until], y[s][:, None] - zy[:until], t[s][:, None]
            new = (np.sqrt(px * px + py * py) <= zr[:until]) & (announced[:until] <= pt) & ~seen[has]
            seen[has] |= new
            lag[block[has]] += np.where(new, pt - np.maximum(announced[:until], land[s][:, None]), 0).sum(1)
            n[block[has]] += new.sum(1)
    got = np.flatnonzero(n)
    match = samples.column("match_id").slice(0, 1).take(pa.array(np.zeros(len(got), np.int64))) if len(samples) else samples.column("match_id")
    return pa.table({"match_id": match, "account_id": names.take(pa.array(got)), "rotate_lag_s": lag[got] / n[got], "n_circles": n[got]})


def rotate_lag(track: DataFrame, circles: DataFrame, landings: DataFrame, parts: int = 8) -> DataFrame:
    """Mean time from a circle's announcement (or the landing, if later) until the account is first seen alive inside it.

    A match's accounts are dealt to parts, which meet all its circles a block at a time: no pair of both is a row, and what is shuffled and held is
    linear in samples and circles. The comparisons themselves are as many as accounts' samples times circles announced by then.
    """
    num = lambda c, a: F.col(c).cast("double").alias(a)
    c = circles.select(F.col(M).alias("circle_match"), "idx", num("t_s", "announced"), num("zx", "zx"), num("zy", "zy"), num("zr", "zr")).dropna(subset=["circle_match", "announced", "zx", "zy", "zr"]).distinct().drop("idx")
    c = c.withColumn("circle_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    seen = track.where("alive").join(landings.select(*KEYS, "land_t"), KEYS).where("t_s >= land_t").select(*KEYS, num("t_s", "t"), num("land_t", "land"), num("x", "x"), num("y", "y")).dropna()
    seen = seen.withColumn("part", F.pmod(F.xxhash64("account_id"), F.lit(parts)).cast("int"))
    kinds = ", ".join(f"{k} {track.schema[k].dataType.simpleString()}" for k in KEYS)

    return seen.groupBy(M, "part").cogroup(c.groupBy("circle_match", "circle_part")).applyInArrow(_first_inside, f"{kinds}, rotate_lag_s double, n_circles bigint")


def teammate_spread(track: DataFrame, roster: DataFrame, max_lag: float, near: float = 10_000.0) -> DataFrame:
    """Per account the mean over its samples of the distance to its nearest teammate (its sample nearest in time), and the share within near."""
    own = track.where("alive").select(*KEYS, "idx", "t_s", "x", "y").join(roster.select(*KEYS, "team_id"), KEYS)
    placed = nearest_mates(own, own.withColumns({"until": F.lit(None).cast("double"), "rides": F.lit(False)}), max_lag)
    known = placed.where("d is not null").groupBy(*KEYS)
    return known.agg(F.count("*").alias("n_samples"), F.avg("d").alias("teammate_dist_avg"), (F.count_if(F.col("d") <= near).cast("double") / F.count("*")).alias("teammate_near_pct"))


def hot_drop(landings: DataFrame, radius: float, within: float) -> DataFrame:
    """How many first landings of other teams lie within radius and time of each account's own; landings meet only in cells of space and time."""
    own = landings.select(*KEYS, "team_id", "land_t", "land_x", "land_y")
    near = near_in_space_and_time(own, own, [M], ("land_x", "land_y"), "land_t", radius, within, within)
    n = near.where("team_id <> o_team_id").groupBy(*KEYS).agg(F.count("*").alias("hot_drop_n"))
    return landings.select(*KEYS).join(n, KEYS, "left").select(*KEYS, F.coalesce("hot_drop_n", F.lit(0)).alias("hot_drop_n"))


def early_combat(hits: DataFrame, until: float) -> DataFrame:
    """First blow dealt or taken, and damage dealt and taken up to a time."""
    legs = hits.select(M, "account_id", "t_s", F.col("damage").alias("dealt"), F.lit(0).cast(hits.schema["damage"].dataType).alias("taken")).unionByName(hits.select(M, F.col("victim_id").alias("account_id"), "t_s", F.lit(0).cast(hits.schema["damage"].dataType).alias("dealt"), F.col("damage").alias("taken")))
    early = lambda c: F.sum(F.when(F.col("t_s") <= until, F.col(c)).otherwise(0))
    return legs.groupBy(*KEYS).agg(F.min(F.when(F.col("t_s") >= 0, F.col("t_s"))).alias("first_engage_s"), early("dealt").alias("dmg_dealt_early"), early("taken").alias("dmg_taken_early"))


def early_items(deltas: DataFrame, landings: DataFrame, until: float, weapon_slots: int = 2) -> DataFrame:
    """First equip of a weapon slot and pickups up to a time after landing."""
    rows = deltas.join(landings.select(*KEYS, "land_t"), KEYS, "left")
    return rows.groupBy(*KEYS).agg(F.min(F.when((F.col("op") == "equip") & (F.col("slot") < weapon_slots), F.col("t_s"))).alias("first_weapon_s"), F.count_if((F.col("op") == "add") & (F.col("t_s") >= F.col("land_t")) & (F.col("t_s") <= F.col("land_t") + until)).alias("early_pickups_n"))


def strategy_metrics(roster: DataFrame, *parts: DataFrame) -> DataFrame:
    """Every account of the roster with all metrics, null where not measured; parts have a row an account and meet in one grouping, so none is broadcast."""
    out = roster.select(*KEYS).withColumn("_of_roster", F.lit(True))
    for p in parts:
        out = out.unionByName(p.dropna(subset=KEYS), allowMissingColumns=True)
    metrics = [F.first(c, ignorenulls=True).alias(c) for c in out.columns if c not in KEYS]
    return out.groupBy(*KEYS).agg(*metrics).where("_of_roster").drop("_of_roster")


def death_context(kills: DataFrame, roster: DataFrame, track: DataFrame, deaths: DataFrame, max_lag: float) -> DataFrame:
    """Per death the distance to the nearest living teammate, how many live, whether the victim rode, and the age of its own sample."""
    up = still_up(kills, roster, deaths)
    samples = track.select(*KEYS, "t_s", "idx", "x", "y", F.col("riding").isNotNull().alias("rides")).join(roster.select(*KEYS, "team_id"), KEYS)
    samples = samples.join(deaths.select(*KEYS, F.col("death_t").alias("until")), KEYS, "left")
    none = F.lit(None).cast("double")
    placed = nearest_mates(up.select(M, "team_id", F.col("victim_id").alias("account_id"), "idx", "t_s", none.alias("x"), none.alias("y")), samples, max_lag)
    placed = placed.select(M, "idx", F.col("account_id").alias("victim_id"), F.col("s_lag").cast(kills.schema["t_s"].dataType).alias("sample_lag"), F.col("s_rides").alias("in_vehicle"), F.col("d").alias("nearest_teammate"))
    return up.select(M, "idx", "victim_id", "teammates_alive").join(placed, [M, "idx", "victim_id"])
