"""Where a team's members are at given moments, in one pass over the team's samples.

A probe isn't multiplied by its team: samples and probes of a team are dealt to bins of time, a sample also to a neighbouring bin that
it can reach. In a bin all samples, sorted by account and time, are searched for all moments at once. What is shuffled is linear in
samples and probes, and a bin holds a team for some multiples of the reach, however long the match.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEAM = ["match_id", "team_id"]

#: Moments times accounts that are searched at once, and bins' length as a multiple of the reach.
AT_ONCE, BIN = 1 << 20, 4


def _searcher(max_lag: float) -> Callable[[pa.Table], pa.Table]:
    def search(table: pa.Table) -> pa.Table:
        is_probe = table.column("is_probe").to_numpy()
        code = table.column("account_id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        t, idx, x, y = (table.column(c).to_numpy() for c in ("t", "idx", "x", "y"))
        until = np.where(np.isnan(u := table.column("until").to_numpy()), np.inf, u)
        rides = table.column("rides").to_numpy()
        # whole numbers in place of times, so that account and time are one exact key
        moment = np.unique(t, return_inverse=True)[1].astype(np.int64)
        n_moments = int(moment.max()) + 1
        samples = np.flatnonzero(~is_probe)
        samples = samples[np.lexsort((idx[samples], moment[samples], code[samples]))]
        key = code[samples] * n_moments + moment[samples]
        accounts = np.unique(code[samples])
        begin, end = np.searchsorted(code[samples], accounts, "left"), np.searchsorted(code[samples], accounts, "right")
        probes = np.flatnonzero(is_probe)
        found = {c: np.full(len(probes), np.nan) for c in ("s_x", "s_y", "s_lag", "d")}
        s_rides = np.zeros(len(probes), bool)
        step = max(1, AT_ONCE // max(1, len(accounts)))
        for at in range(0, len(probes) if len(accounts) else 0, step):
            p = probes[at : at + step]
            want = accounts[None, :] * n_moments + moment[p][:, None]
            last, first = np.searchsorted(key, want, "right") - 1, np.searchsorted(key, want, "left")
            behind = np.where(last >= begin, t[p][:, None] - t[samples[np.maximum(last, 0)]], np.inf)
            ahead = np.where(first < end, t[samples[np.minimum(first, len(samples) - 1)]] - t[p][:, None], np.inf)
            best = samples[np.clip(np.where(behind <= ahead, last, first), 0, len(samples) - 1)]
            lag = np.minimum(behind, ahead)
            seen, own = lag <= max_lag, accounts[None, :] == code[p][:, None]
            rows, cols = np.nonzero(own & seen)
            mine = best[rows, cols]
            for c, v in (("s_x", x[mine]), ("s_y", y[mine]), ("s_lag", lag[rows, cols])):
                found[c][at + rows] = v
            s_rides[at + rows] = rides[mine]
            # without a place of its own the probe is where its account's sample is
            px = np.where(np.isnan(x[p]), found["s_x"][at : at + step], x[p])
            py = np.where(np.isnan(y[p]), found["s_y"][at : at + step], y[p])
            away = np.hypot(x[best] - px[:, None], y[best] - py[:, None])
            mates = seen & ~own & (until[best] > t[p][:, None])
            away = np.where(mates, away, np.inf).min(1)
            found["d"][at : at + step] = np.where(np.isinf(away), np.nan, away)
        out = {c: table.column(c).take(pa.array(probes)) for c in ("match_id", "account_id", "idx")}
        return pa.table(out | {c: pa.array(v, from_pandas=True) for c, v in found.items()} | {"s_rides": pa.array(s_rides)})

    return search


def nearest_mates(probes: DataFrame, samples: DataFrame, max_lag: float) -> DataFrame:
    """match_id, account_id and idx of every probe; s_x, s_y, s_lag and s_rides of its account's sample nearest in time; d, the distance to the nearest teammate.

    probes: match_id, team_id, account_id, idx, t_s, x, y (null: where its account's sample is); samples also until (the time from which its account doesn't
    count as a teammate, null: never) and rides. A teammate's place is that of its sample nearest in time, the earlier at equal
    distance, the last in the order of idx at equal times. Samples over max_lag away don't count; without any the values are null.
    """
    length = BIN * max_lag
    bin_of = lambda t: F.floor(t / length).cast("long")
    t = F.col("t_s").cast("double")

    def rows(df: DataFrame, is_probe: bool, until: Column, rides: Column) -> DataFrame:
        return df.select(*TEAM, "account_id", F.col("idx").cast("bigint").alias("idx"), t.alias("t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), until.alias("until"), rides.alias("rides"), F.lit(is_probe).alias("is_probe"))

    p = rows(probes.where("t_s is not null"), True, F.lit(None).cast("double"), F.lit(False)).withColumn("_bin", bin_of(F.col("t")))
    s = rows(samples.where("t_s is not null and x is not null and y is not null"), False, F.col("until").cast("double"), F.coalesce("rides", F.lit(False)))
    s = s.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("t") - max_lag), bin_of(F.col("t") + max_lag))))
    kinds = {c: probes.schema[c].dataType.simpleString() for c in ("match_id", "account_id")}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", idx bigint, s_x double, s_y double, s_lag double, d double, s_rides boolean"
    return p.unionByName(s).groupBy(*TEAM, "_bin").applyInArrow(_searcher(max_lag), schema)


def still_up(kills: DataFrame, roster: DataFrame, deaths: DataFrame) -> DataFrame:
    """match_id, idx, victim_id, team_id, t_s of kills of the roster's accounts and teammates_alive, how many others of the team live on after that moment.

    Deaths of a team are counted up to each kill by a window over the two alone.
    """
    team = roster.select(*TEAM, "account_id").join(deaths, ["match_id", "account_id"], "left")
    size = team.groupBy(*TEAM).agg(F.count("*").alias("n_team"))
    own = team.withColumnsRenamed({"account_id": "victim_id", "death_t": "own_death"})
    k = kills.select("match_id", "idx", "victim_id", "t_s").join(own, ["match_id", "victim_id"])
    fallen = team.where("death_t is not null").select(*TEAM, F.col("death_t").alias("t_s"), F.lit(1).alias("died"))
    both = k.withColumn("died", F.lit(0)).unionByName(fallen, allowMissingColumns=True)
    so_far = Window.partitionBy(*TEAM).orderBy("t_s").rangeBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("n_fallen", F.sum("died").over(so_far)).where("died = 0").join(size, TEAM)
    others = F.col("n_fallen") - F.coalesce((F.col("own_death") <= F.col("t_s")).cast("int"), F.lit(0))
    return counted.select("match_id", "idx", "victim_id", "team_id", "t_s", (F.col("n_team") - 1 - others).alias("teammates_alive"))
