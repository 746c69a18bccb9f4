"""Reviews over derived tables: who fights how, deaths in context, circles, strategy rows and what to keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.norm import mean, rate
from matchlake.operators.quantiles import exact_quantiles
from matchlake.operators.temporal import asof

M = "match_id"
#: A difference of rates that counts, seconds before a death to begin at, a close teammate, days.
MIN_GAP, LEAD_IN_S, NEAR_CM, AT_RISK_DAYS = 0.1, 15, 10_000.0, 10
#: Strategy measures, each with the column (or expression) it is taken from.
BEHAVIOUR = {
    "blue": "CASE WHEN survived_s > 0 THEN blue_s / survived_s * 100 END",
    "blue_damage": "blue_damage",
    "rotate": "rotate_lag_s",
    "mate_distance": "teammate_dist_avg_cm / 100",
    "mate_near": "teammate_near_pct * 100",
    "hot_drop": "hot_drop_n",
    "first_fight": "first_engage_s",
    "early_damage": "dmg_dealt_early",
    "first_weapon": "first_weapon_s",
    "pickups": "early_pickups_n",
    "ride": "ride_distance",
}


def engagement_players(participants: DataFrame) -> DataFrame:
    """Per account: fights, mean damage dealt and taken, the share that ended knocked or dead."""
    n = F.count("*")
    return participants.groupBy("account_id").agg(n.alias("fights"), mean(F.col("damage_dealt")).alias("damage_dealt_avg"), mean(F.col("damage_taken")).alias("damage_taken_avg"), rate(F.count_if("was_knocked"), n).alias("knocked"), rate(F.count_if("died"), n).alias("died"))


def match_engagements(fights: DataFrame, participants: DataFrame, keys: Sequence[str] = (M, "team_a", "team_b", "segment")) -> DataFrame:
    """Fights with the accounts in them, sorted; a fight holds two teams, which bounds the list."""
    members = participants.groupBy(*keys).agg(F.sort_array(F.collect_set("account_id")).alias("accounts"))
    return fights.join(members, list(keys), "left")


def fights_for(fights: DataFrame, accounts: DataFrame, keys: Sequence[str] = (M, "team_a", "team_b", "segment")) -> DataFrame:
    """One row per fight and account in it, seen from the account's side; accounts: keys, account_id, team_id."""
    we_are_a = F.col("team_id") == F.col("team_a")
    ours = {f"{what}_{side}": F.when(we_are_a, F.col(f"{what}_{x}")).otherwise(F.col(f"{what}_{y}")) for what in ("kills", "knocks") for side, x, y in (("ours", "a", "b"), ("theirs", "b", "a"))}
    rows = fights.join(accounts.select(*keys, "account_id", "team_id"), list(keys))
    return rows.select(M, "seq", "account_id", "t_start", "t_end", F.when(we_are_a, F.col("team_b")).otherwise(F.col("team_a")).alias("opponent_team"), *[c.alias(n) for n, c in ours.items()])


def death_review(deaths: DataFrame, circles: DataFrame, fights: DataFrame) -> DataFrame:
    """Deaths with the state of the last circle that closed before them and the last fight begun before them in which their account died.

    deaths: match_id, account_id, idx, t_s and more; circles: match_id, account_id, phase, close_t_s, in_circle (a null
    close is no close); fights: match_id, account_id, seq, t_start, damage_dealt, damage_taken, third_party_team_id of
    participants that died. Both look-ups are one union and one window per account.
    """
    closed = circles.where("close_t_s is not null").select(M, "account_id", F.col("close_t_s").alias("t_s"), "phase", "in_circle")
    begun = fights.select(M, "account_id", F.col("t_start").alias("t_s"), "seq", "damage_dealt", "damage_taken", "third_party_team_id")
    placed = asof(deaths, closed, [M, "account_id"], "t_s", ["phase", "in_circle"], tie=["phase"], prefix="circle_").drop("circle_t_s", "circle_lag", "circle_phase")
    found = asof(placed, begun, [M, "account_id"], "t_s", ["seq", "damage_dealt", "damage_taken", "third_party_team_id"], tie=["seq"], prefix="fight_").drop("fight_t_s", "fight_lag")
    return found.withColumnRenamed("circle_in_circle", "in_circle")


def death_rates(reviewed: DataFrame, circles: DataFrame, near_cm: float = NEAR_CM) -> DataFrame:
    """One row of rates. What was not measured (null) is in neither half: the denominator shrinks.

    reviewed also needs teammates_alive, nearest_cm and knocked_first; circles alive_at_close.
    """
    alive = F.col("teammates_alive")
    known = F.count_if(F.col("in_circle").isNotNull())
    r = reviewed.agg(
        F.count("*").alias("deaths"),
        rate(F.count_if(alive == 0), F.count(alive)).alias("alone"),
        rate(F.count_if((alive > 0) & (F.col("nearest_cm") > near_cm)), F.count_if(alive > 0)).alias("isolated"),
        rate(F.count("fight_third_party_team_id"), F.count("*")).alias("third_partied"),
        rate(F.count_if("knocked_first"), F.count("*")).alias("knocked_first"),
        rate(F.count_if(~F.col("in_circle")), known).alias("outside_at_death"),
        F.count_if(F.col("fight_seq").isNull()).alias("outside_any_fight"),
    )
    b = circles.where("alive_at_close and in_circle is not null").agg(rate(F.count_if(~F.col("in_circle")), F.count("*")).alias("outside_baseline"))
    return r.crossJoin(F.broadcast(b))  # one row each


def circle_comparison(rates: DataFrame, min_gap: float = MIN_GAP) -> DataFrame:
    """gap and whether it is one; both null if a rate is missing."""
    gap = F.col("outside_at_death") - F.col("outside_baseline")
    return rates.withColumn("gap", gap).withColumn("different", F.abs(gap) >= min_gap)


def death_tags(rows: DataFrame, far_m: float = 100.0, lead_in_s: int = LEAD_IN_S) -> DataFrame:
    """rows with tags, in a fixed order, and replay_from_s; null flags make no tag."""
    far = F.when(F.coalesce(F.col("alone"), F.lit(False)), None).when(F.col("nearest_m") > far_m, F.format_string("%d m from the squad", F.floor(F.col("nearest_m") + 0.5)))
    said = [F.when(F.col("third_partied"), "third-partied"), F.when(F.col("knocked_first"), "knocked first"), F.when(F.col("alone"), "last one up"), far, F.when(F.col("in_vehicle"), "in a vehicle"), F.when(F.col("killer_is_bot"), "to a bot")]
    return rows.withColumn("tags", F.array_compact(F.array(*said))).withColumn("replay_from_s", F.greatest(F.lit(0), F.floor(F.col("t_s") - lead_in_s + 0.5)))


def strategy_rows(metrics: DataFrame, participants: DataFrame, key: str | None = None, value=None) -> DataFrame:
    """Measures beside the result of their participant; of one account or match if key is given."""
    rows = metrics.join(participants, [M, "account_id"])
    return rows if key is None else rows.where(F.col(key) == value)


def behaviour(rows: DataFrame) -> DataFrame:
    """The measures of BEHAVIOUR, null where not measured."""
    return rows.select(M, "account_id", *[F.expr(e).alias(n) for n, e in BEHAVIOUR.items()])


def squad_strategy(rows: DataFrame, metric: str, least: int = 2) -> DataFrame:
    """Matches in which at least `least` tracked accounts of one team played, with their values by account and the mean of those that have one."""
    g = rows.where("tracked").groupBy(M, "team_id").agg(F.countDistinct("account_id").alias("n_players"), F.sort_array(F.collect_list(F.struct("account_id", metric))).alias("players"), mean(F.col(metric)).alias("squad_mean"))
    return g.where(F.col("n_players") >= least)


def zone_play_summary(rows: DataFrame, place_max: int | None = None) -> DataFrame:
    """Per phase and side (squad or lobby) how many of the living were inside at the announcement and at the close, and the median distance to the edge.

    rows: phase, is_squad, is_bot, win_place, alive_at_close, in_at_announce, in_at_close, edge_cm.
    """
    lobby = ~F.col("is_squad") & ~F.col("is_bot")
    side = F.col("is_squad") | (lobby if place_max is None else lobby & (F.col("win_place") <= place_max))
    count = lambda c, n: [F.count_if(F.col(c)).alias(f"{n}_in"), F.count(c).alias(f"{n}_n")]
    keys = ["phase", "is_squad"]
    judged = rows.where(F.col("alive_at_close") & side)
    counts = judged.groupBy(*keys).agg(*count("in_at_announce", "announce"), *count("in_at_close", "close"))
    middle = exact_quantiles(judged, keys, ["edge_cm"], [0.5])
    return counts.join(middle, keys).withColumn("median_edge_m", F.get("q_edge_cm", 0) / 100).drop("q_edge_cm", "n_edge_cm")


def match_zone_play(rows: DataFrame, wanted: Column) -> DataFrame:
    """Rows that are wanted, with the last phase of their match over all rows."""
    return rows.withColumn("max_phase", F.max("phase").over(Window.partitionBy(M))).where(wanted)


def sort_rows(rows: DataFrame, col: str, descending: bool = False, n: int | None = None) -> DataFrame:
    """rows by col, nulls last in both directions; with n a top-n report."""
    ordered = rows.orderBy(F.col(col).desc_nulls_last() if descending else F.col(col).asc_nulls_last())
    return ordered if n is None else ordered.limit(n)


def at_risk(matches: DataFrame, now: Column, days: int = AT_RISK_DAYS, n: int = 5) -> DataFrame:
    """The n oldest matches without telemetry that are over `days` old."""
    return matches.where(F.col("telemetry_key").isNull() & (F.col("played_at") < now - F.make_dt_interval(F.lit(days)))).orderBy("played_at", M).limit(n)


def prune_candidates(matches: DataFrame, now: Column, retention_days: int, version: int) -> DataFrame:
    """Matches whose raw telemetry may go: old enough, parsed, and by the current version; none for 0 days."""
    old = F.lit(retention_days > 0) & (F.col("played_at") < now - F.make_dt_interval(F.lit(retention_days)))
    return matches.where(old & F.col("telemetry_key").isNotNull() & F.col("parsed_at").isNotNull() & (F.col("parser_version") == version))
