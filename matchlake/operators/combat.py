"""Damage, kills, accuracy and engagements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.norm import distance
from matchlake.operators.temporal import gap_segments, ranked_attach

M = "match_id"


def kill_events(kills: DataFrame, older: DataFrame | None = None) -> DataFrame:
    """Kills with seq in file order and the flags of suicide and team kill; rows without a victim are dropped.

    older: kills of the first shape, which lack the maker of the knock, the finisher and the assistants; those are null, and assists empty.
    """
    rows = kills if older is None else kills.unionByName(older, allowMissingColumns=True)
    rows = rows.where("victim_id is not null")
    seq = F.row_number().over(Window.partitionBy(M).orderBy("idx")) - 1
    suicide = F.coalesce(F.col("account_id") == F.col("victim_id"), F.lit(False))
    if "assists" in rows.columns:
        rows = rows.withColumn("assists", F.coalesce("assists", F.array().cast(rows.schema["assists"].dataType)))
    return rows.withColumn("seq", seq).withColumn("is_suicide", suicide).withColumn("is_team_kill", F.coalesce(F.col("team_id") == F.col("victim_team"), F.lit(False)) & ~suicide)


def knock_events(knocks: DataFrame) -> DataFrame:
    return knocks.withColumn("seq", F.row_number().over(Window.partitionBy(M).orderBy("idx")) - 1)


def revives(rows: DataFrame) -> DataFrame:
    """Revives per reviver."""
    return rows.groupBy(M, F.col("reviver_id").alias("account_id")).agg(F.count("*").alias("n_revives"))


def hits(damage: DataFrame) -> DataFrame:
    """Attributed damage to others, over zero, with both places known."""
    return damage.where("account_id is not null and victim_id is not null and account_id <> victim_id and damage > 0 and x is not null and vx is not null")


def unattributed(damage: DataFrame) -> DataFrame:
    """Damage without an attacker per victim, and the part of it from the closing zone."""
    return damage.where("account_id is null").groupBy(M, "victim_id").agg(F.sum("damage").alias("unattributed_damage"), F.sum(F.when(F.col("category") == "damage_bluezone", F.col("damage"))).alias("blue_damage"))


def player_combat(kills: DataFrame, knocks: DataFrame, damage: DataFrame, bot: Column) -> DataFrame:
    """Kills, knocks (all and of humans; bot says whether victim_id is one) and damage dealt per account; its last death in file order."""
    k = kills.where("account_id <> victim_id").groupBy(M, "account_id").agg(F.count("*").alias("kills"), F.count_if(~bot).alias("kills_human"))
    n = knocks.where("account_id <> victim_id").groupBy(M, "account_id").agg(F.count("*").alias("knocks"), F.count_if(~bot).alias("knocks_human"))
    d = damage.where("account_id <> victim_id").groupBy(M, "account_id").agg(F.sum("damage").alias("damage_dealt"))
    died = kills.groupBy(M, F.col("victim_id").alias("account_id")).agg(F.max_by(F.struct(F.col("t_s").alias("died_t"), F.col("account_id").alias("killed_by")), "idx").alias("x")).select(M, "account_id", "x.*")
    keys = [M, "account_id"]
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("kills", "kills_human", "knocks", "knocks_human", "damage_dealt")}
    return k.join(n, keys, "full_outer").join(d, keys, "full_outer").join(died, keys, "full_outer").withColumns(zero)


def accuracy(attacks: DataFrame, damage: DataFrame, throwables: DataFrame, by: Sequence[str] = (M, "account_id")) -> DataFrame:
    """Shots, shots that landed, hits and damage of attacks; damage counts for the attack of its id and attacker that came before it in the file."""
    shots = attacks.join(throwables.select(M, "attack_id").distinct(), [M, "attack_id"], "left_anti")
    own = shots.select(M, "attack_id", "account_id", F.col("idx").alias("shot_idx"), *[c for c in by if c not in (M, "account_id")])
    keys = [M, "attack_id", "account_id"]
    landed = own.join(damage.select(*keys, "idx", "damage", "is_head", "on_knocked"), keys).where("idx > shot_idx").groupBy(*keys, "shot_idx").agg(F.count("*").alias("h"), F.count_if("is_head").alias("hd"), F.count_if("on_knocked").alias("dn"), F.sum("damage").alias("dm"))
    all_shots = own.join(landed, [*keys, "shot_idx"], "left")
    return all_shots.groupBy(*by).agg(F.count("*").alias("shots"), F.count("h").alias("shots_landed"), F.coalesce(F.sum("h"), F.lit(0)).alias("hit_events"), F.coalesce(F.sum("dn"), F.lit(0)).alias("dbno_hit_events"), F.coalesce(F.sum("hd"), F.lit(0)).alias("headshot_events"), F.coalesce(F.sum("dm"), F.lit(0)).alias("damage"))


def reported_totals(ends: DataFrame) -> DataFrame:
    """Shots and hits per account out of nested statistics (stats: array of account_id and its array of shots and hits), in one or more rows a match."""
    rows = ends.select(M, F.explode("stats").alias("s")).select(M, "s.account_id", F.explode("s.stats").alias("w"))
    return rows.groupBy(M, "account_id").agg(F.sum("w.shots").alias("shots"), F.sum("w.hits").alias("hits"))


def longest_kill(kills: DataFrame) -> DataFrame:
    return kills.groupBy(M, "account_id").agg(F.coalesce(F.max(F.when(F.col("distance") > 0, F.col("distance"))), F.lit(0.0)).alias("longest_kill_cm"))


def participant_updates(roster: DataFrame, combat: DataFrame, longest: DataFrame, landings: DataFrame, first_samples: DataFrame, bots: DataFrame | None = None) -> DataFrame:
    """roster with combat totals, the longest kill and where each account landed: its landing, else its first sample.

    bots: what telemetry says of is_bot, which counts before the roster's own is_bot.
    """
    keys = [M, "account_id"]
    joined = roster.join(combat, keys, "left").join(longest, keys, "left").join(landings, keys, "left").join(first_samples, keys, "left")
    if bots is not None:
        joined = joined.join(bots.select(*keys, F.col("is_bot").alias("_said")), keys, "left").withColumn("is_bot", F.coalesce("_said", "is_bot")).drop("_said")
    return joined.withColumn("x0", F.coalesce("land_x", "first_x")).withColumn("y0", F.coalesce("land_y", "first_y")).drop("land_x", "land_y", "first_x", "first_y")


def tracer_hits(hit_rows: DataFrame, roster: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Hits of the given kinds whose two ends are both in the roster."""
    r = roster.select(M, "account_id")
    return hit_rows.where(F.col("category").isin(*kinds)).join(r, [M, "account_id"], "left_semi").join(r.withColumnRenamed("account_id", "victim_id"), [M, "victim_id"], "left_semi")


def paired(rows: DataFrame) -> DataFrame:
    """Rows between two teams with the teams in order (team_a < team_b) and whether the actor is on the first."""
    return rows.where("team_id is not null and victim_team is not null and team_id <> victim_team").withColumns({"team_a": F.least("team_id", "victim_team"), "team_b": F.greatest("team_id", "victim_team"), "is_a": F.col("team_id") < F.col("victim_team")})


def segments(blows: DataFrame, gap: float, tie: Sequence[str] = ("idx",)) -> DataFrame:
    """Blows (hits and knocks between teams) with the segment of their pair of teams."""
    return gap_segments(paired(blows), [M, "team_a", "team_b"], "t_s", gap, tie)


def segment_spans(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy(M, "team_a", "team_b", "segment").agg(F.min("t_s").alias("t_start"), F.max("t_s").alias("t_end"))


def attach_kills(kills: DataFrame, spans: DataFrame, knocks: DataFrame, gap: float, slack: float = 0.002) -> DataFrame:
    """Kills between teams with their segment: inside its span; else the segment of the victim's latest knock by the same side; else the last that ended at most gap ago."""
    k = paired(kills).withColumnRenamed("t_s", "kill_t")
    n = paired(knocks).select(M, "team_a", "team_b", "victim_id", F.col("t_s").alias("knock_t"))
    linked = k.join(n, [M, "team_a", "team_b", "victim_id"]).where(F.col("knock_t") <= F.col("kill_t") + slack).groupBy(M, "idx").agg(F.max("knock_t").alias("knock_t"))
    k = k.join(linked, [M, "idx"], "left")
    t = F.col("kill_t")
    rules = [(t >= F.col("t_start") - slack) & (t <= F.col("t_end") + slack), (F.col("knock_t") >= F.col("t_start") - slack) & (F.col("knock_t") <= F.col("t_end") + slack), (F.col("t_end") <= t) & (t - F.col("t_end") <= gap)]
    return ranked_attach(k, spans, [M, "team_a", "team_b"], rules, [M, "idx"], [F.col("t_end").desc(), F.col("segment").desc()])


def centres(segmented_hits: DataFrame) -> DataFrame:
    """Mean of both ends of all hits of a segment."""
    n = 2 * F.count("*")
    return segmented_hits.groupBy(M, "team_a", "team_b", "segment").agg(((F.sum("x") + F.sum("vx")) / n).alias("cx"), ((F.sum("y") + F.sum("vy")) / n).alias("cy"))


def third_parties(fights: DataFrame, radius: float) -> DataFrame:
    """Fights (match_id, seq, team_a, team_b, t_start, t_end, cx, cy) with the team of the earliest other fight that shares exactly one team, overlaps in time and is within radius."""
    side = F.explode(F.array("team_a", "team_b")).alias("shared")
    a = fights.select(M, "seq", "team_a", "team_b", "t_start", "t_end", "cx", "cy", side)
    o = fights.select(M, side, F.col("seq").alias("o_seq"), F.col("team_a").alias("o_a"), F.col("team_b").alias("o_b"), F.col("t_start").alias("o_start"), F.col("t_end").alias("o_end"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    both = a.join(o, [M, "shared"]).where("seq <> o_seq and o_start <= t_end and o_end >= t_start and not (o_a = team_a and o_b = team_b)").where(distance(F.col("cx"), F.col("cy"), F.col("ox"), F.col("oy")) <= radius)
    outsider = F.when(F.col("o_a") == F.col("shared"), F.col("o_b")).otherwise(F.col("o_a"))
    return both.groupBy(M, "seq").agg(F.min_by(outsider, F.struct("o_start", "o_seq")).alias("third_party_team_id"))


def engagements(segmented: DataFrame, attached: DataFrame) -> DataFrame:
    """One row per segment with seq, span, hits, damage, knocks and kills of each side and its first hit. segmented has kind hit or knock."""
    keys = [M, "team_a", "team_b", "segment"]
    hit, a = F.col("kind") == "hit", F.col("is_a")
    away = distance(F.col("x"), F.col("y"), F.col("vx"), F.col("vy"))
    sides = {f"{n}_{s}": agg(own) for s, own in (("a", a), ("b", ~a)) for n, agg in (("hits", lambda w: F.count_if(hit & w)), ("dmg", lambda w: F.coalesce(F.sum(F.when(hit & w, F.col("damage"))), F.lit(0))), ("knocks", lambda w: F.count_if(~hit & w)))}
    g = segmented.groupBy(*keys).agg(F.min("t_s").alias("t_start"), F.max("t_s").alias("t_end"), *[c.alias(n) for n, c in sides.items()], F.min_by(F.struct(F.col("team_id").alias("first_hit_team"), F.col("account_id").alias("first_hit_account"), away.alias("first_hit_range")), F.when(hit, F.struct("t_s", "idx"))).alias("f"), F.min(F.when(hit, away)).alias("min_range"))
    k = attached.where("rule is not null").groupBy(*keys).agg(F.count_if("is_a").alias("kills_a"), F.count_if(~F.col("is_a")).alias("kills_b"))
    joined = g.join(k, keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("kills_a", "kills_b")})
    seq = F.row_number().over(Window.partitionBy(M).orderBy("t_start", "team_a", "team_b", "segment")) - 1
    return joined.select(M, seq.alias("seq"), "team_a", "team_b", "segment", "t_start", "t_end", *sides, "f.*", "min_range", "kills_a", "kills_b")


def engagement_participants(segmented: DataFrame, attached: DataFrame) -> DataFrame:
    """What every account did and took in each segment."""
    keys = [M, "team_a", "team_b", "segment"]
    hit = F.col("kind") == "hit"
    zero, no = F.lit(0), F.lit(False)
    legs = [
        segmented.select(*keys, "account_id", "team_id", hit.cast("int").alias("hd"), zero.alias("ht"), F.when(hit, F.col("damage")).alias("dd"), F.lit(None).alias("dt"), (~hit).cast("int").alias("kn"), zero.alias("ki"), no.alias("wk"), no.alias("di")),
        segmented.select(*keys, F.col("victim_id").alias("account_id"), F.col("victim_team").alias("team_id"), zero.alias("hd"), hit.cast("int").alias("ht"), F.lit(None).alias("dd"), F.when(hit, F.col("damage")).alias("dt"), zero.alias("kn"), zero.alias("ki"), (~hit).alias("wk"), no.alias("di")),
        attached.where("rule is not null").select(*keys, "account_id", "team_id", zero.alias("hd"), zero.alias("ht"), F.lit(None).alias("dd"), F.lit(None).alias("dt"), zero.alias("kn"), F.lit(1).alias("ki"), no.alias("wk"), no.alias("di")),
        attached.where("rule is not null").select(*keys, F.col("victim_id").alias("account_id"), F.col("victim_team").alias("team_id"), zero.alias("hd"), zero.alias("ht"), F.lit(None).alias("dd"), F.lit(None).alias("dt"), zero.alias("kn"), zero.alias("ki"), no.alias("wk"), F.lit(True).alias("di")),
    ]
    rows = legs[0]
    for leg in legs[1:]:
        rows = rows.unionByName(leg)
    total = lambda c: F.coalesce(F.sum(c), zero)
    return rows.groupBy(*keys, "account_id", "team_id").agg(total("hd").alias("hits_dealt"), total("ht").alias("hits_taken"), total("dd").alias("damage_dealt"), total("dt").alias("damage_taken"), total("kn").alias("knocks"), total("ki").alias("kills"), F.bool_or("wk").alias("was_knocked"), F.bool_or("di").alias("died"))
