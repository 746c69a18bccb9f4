"""Findings: what stands out in a squad's rates, its fights and its deaths, by key and strongest first.

Each kind is one projection over a table with a row for each key: its findings are an array of structs
that is exploded, so a key costs one row and no join. Wording is left to who shows them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.norm import rate
from matchlake.operators.careers import FIGHT_RANGES, RANGES

#: Rows that a finding must rest on, and the least gap between two rates.
LEAST, GAP = 8, 0.1

Finding = tuple[str, Column, Column, Column, Column]


def _tone(good: Column, bad: Column) -> Column:
    return F.when(good, "good").when(bad, "bad").otherwise("neutral")


def _pct(part: str, total: str) -> Column:
    return rate(F.col(part), F.col(total))


def _lopsided(pct: Column) -> Column:
    return F.abs(pct - 0.5) * 2


def _ranked(rows: DataFrame, key: str, found: Sequence[Finding]) -> DataFrame:
    """key, id, n, strength, tone and place of the findings that hold and rest on LEAST rows or more."""
    structs = [F.when(when, F.struct(F.lit(i).alias("id"), n.cast("long").alias("n"), strength.cast("double").alias("strength"), tone.alias("tone"))) for i, n, strength, tone, when in found]
    each = rows.select(key, F.explode(F.array(*structs)).alias("f")).where("f is not null").select(key, "f.*").where(F.col("n") >= LEAST)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("strength").desc(), "id"))
    return each.withColumn("place", place)


def _band_findings(won: str, lost: str, bands: Sequence[tuple], factor: float, name: str) -> list[Finding]:
    """The band (columns won_0, lost_0, ...) with the least share won among those of LEAST rows, if that is under a half."""
    held = lambda i: F.col(f"{won}_{i}") + F.col(f"{lost}_{i}")
    shares = [F.when(held(i) >= LEAST, F.struct((F.col(f"{won}_{i}") / held(i)).alias("share"), F.lit(i).alias("band"), held(i).alias("n"))) for i in range(len(bands))]
    worst = F.array_min(F.filter(F.array(*shares), lambda x: x.isNotNull()))
    return [(name, worst["n"], (0.5 - worst["share"]) * factor, F.lit("bad"), F.coalesce(worst["share"] < 0.5, F.lit(False)))]


def squad_findings(rows: DataFrame, key: str) -> DataFrame:
    """rows: made, made_converted, taken, taken_converted, deaths, third_partied, knocked_first, early, to_bot, we_killed_0 and we_died_0 to _4,
    and first_deaths, an array of (died_first, matches) of the squad's members."""
    made, taken = _pct("made_converted", "made"), _pct("taken_converted", "taken")
    gap, both = made - taken, made.isNotNull() & taken.isNotNull()
    alike = F.abs(gap) < 0.05
    of_deaths = lambda c: _pct(c, "deaths")
    died = F.col("deaths") > 0
    shares = F.transform(F.filter("first_deaths", lambda x: x["matches"] >= LEAST), lambda x: x["died_first"] / x["matches"])
    spread = F.array_max(shares) - F.array_min(shares)
    all_matches = F.aggregate(F.filter("first_deaths", lambda x: x["matches"] >= LEAST), F.lit(0).cast("long"), lambda a, x: a + x["matches"])
    busiest = F.greatest(*[F.col(f"we_killed_{i}") + F.col(f"we_died_{i}") for i in range(len(RANGES))])
    found = [
        ("knock-conversion", F.col("made") + F.col("taken"), F.when(alike, 0.25).otherwise(F.abs(gap) * 2), F.when(alike, "neutral").otherwise(_tone(gap > 0, gap <= 0)), both),
        ("knock-survival", F.col("taken"), _lopsided(taken) * 0.8, F.lit("neutral"), taken.isNotNull()),
        ("third-party", F.col("deaths"), of_deaths("third_partied") * 1.5, _tone(F.lit(False), of_deaths("third_partied") > 0.25), died),
        ("knocked-first", F.col("deaths"), F.lit(0.4), F.lit("neutral"), died),
        ("early-deaths", F.col("deaths"), of_deaths("early"), _tone(F.lit(False), of_deaths("early") > 0.35), died),
        ("no-bot-deaths", F.col("deaths"), F.lit(0.15), F.lit("good"), F.col("to_bot") == 0),
        ("first-death", all_matches, spread * 1.2, F.lit("neutral"), (F.size(shares) >= 2) & (spread > 0.1)),
        *_band_findings("we_killed", "we_died", RANGES, 2.0, "worst-range"),
        ("busiest-range", busiest, F.lit(0.3), F.lit("neutral"), F.lit(True)),
    ]
    return _ranked(rows, key, found)


def engagement_findings(rows: DataFrame, key: str) -> DataFrame:
    """rows: fights, first, ahead_first, not_first, ahead_not_first, deadly, first_ours, third_partied, ours_only, theirs_only, neither, we_killed_0 and
    we_died_0 to _3, and members, an array of (fights, damage_taken_avg)."""
    first, later = _pct("ahead_first", "first"), _pct("ahead_not_first", "not_first")
    gap = first - later
    share, third = _pct("first_ours", "deadly"), _pct("third_partied", "fights")
    decided = F.col("ours_only") + F.col("theirs_only")
    ours = rate(F.col("ours_only"), decided)
    known = F.filter("members", lambda m: m["fights"] >= LEAST)
    hurt = F.array_sort(F.transform(known, lambda m: F.struct(m["damage_taken_avg"].alias("d"), m["fights"].alias("fights"))))
    low, high = F.get(hurt, 0), F.get(hurt, F.size(hurt) - 1)
    uneven = (F.size(hurt) >= 2) & (high["d"] > low["d"] * 1.25)
    found = [
        ("first-hit-advantage", F.col("first") + F.col("not_first"), F.abs(gap) * 1.5, _tone(gap > 0, gap <= 0), F.coalesce(F.abs(gap) > GAP, F.lit(False))),
        ("first-hit-share", F.col("deadly"), _lopsided(share), _tone(share > 0.55, share < 0.45), share.isNotNull()),
        ("engagement-third-party", F.col("fights"), third * 1.2, _tone(F.lit(False), third > 0.25), third.isNotNull()),
        ("one-sided-fights", decided, _lopsided(ours), _tone(ours > 0.55, ours < 0.45), decided >= LEAST),
        ("undecided-fights", F.col("fights"), F.lit(0.2), F.lit("neutral"), (F.col("fights") >= LEAST) & (F.col("neither") > 0)),
        *_band_findings("we_killed", "we_died", FIGHT_RANGES, 1.8, "engagement-worst-range"),
        ("damage-taken-spread", high["fights"] + low["fights"], F.least(F.lit(1.0), high["d"] / F.greatest(F.lit(1.0), low["d"]) - 1), F.lit("neutral"), F.coalesce(uneven, F.lit(False))),
    ]
    return _ranked(rows, key, found)


def death_findings(rows: DataFrame, key: str) -> DataFrame:
    """rows: deaths, alone, with_mates, isolated (of those with a living teammate) and third_partied."""
    isolated, third = _pct("isolated", "with_mates"), _pct("third_partied", "deaths")
    found = [
        ("died-alone", F.col("deaths"), F.lit(0.3), F.lit("neutral"), F.col("deaths") > 0),
        ("died-isolated", F.col("with_mates"), isolated, _tone(F.lit(False), isolated > 0.3), isolated.isNotNull()),
        ("death-third-party", F.col("deaths"), third * 1.3, _tone(F.lit(False), third > 0.25), third.isNotNull()),
    ]
    return _ranked(rows, key, found)
