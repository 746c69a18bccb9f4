"""Careers, sessions, feeds, reviews and baselines over results and derived tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.norm import IMAGE_SCALE, display_name, mean, rate, world_size
from matchlake.operators.quantiles import exact_quantiles
from matchlake.operators.spatial import near_in_space_and_time
from matchlake.operators.temporal import gap_segments, long_gap_segments, ranged

#: Buckets of placements, bands of kill distances and of a fight's first blow (in metres), the best places that count.
PLACES = (("#1", 1, 1), ("2-5", 2, 5), ("6-10", 6, 10), ("11-25", 11, 25), ("26+", 26, 1 << 30))
RANGES = (("0-10", 0, 10), ("10-50", 10, 50), ("50-100", 50, 100), ("100-200", 100, 200), ("200+", 200, 1e9))
FIGHT_RANGES = (("0-25", 0, 25), ("25-75", 25, 75), ("75-150", 75, 150), ("150+", 150, 1e9))
TOP = 10
#: Columns of results that are only added up.
SUMMED = (
    "kills", "kills_human", "knocks", "knocks_human", "assists", "headshot_kills", "revives", "damage_dealt", "survived_s",
    "walk_m", "ride_m", "shots_fired", "shots_hit", "road_kills", "vehicle_destroys", "team_kills",
)


def player_cards(results: DataFrame) -> DataFrame:
    return results.groupBy("account_id", "tracked").agg(F.count("*").alias("matches"), F.max("played_on").alias("last_seen"))


def career_stats(results: DataFrame) -> DataFrame:
    """All accounts at once: one aggregate and its ratios. Kills of humans alone are the plain ones where they aren't known; nulls count as 0."""
    human = F.coalesce("kills_human", "kills")
    total = lambda c: F.coalesce(F.sum(human if c == "kills_human" else F.col(c)), F.lit(0))
    n, place = F.count("*").alias("matches"), F.col("win_place")
    counted = [F.count_if(place == 1).alias("wins"), F.count_if(place <= TOP).alias("top10")]
    best = [mean(place).alias("avg_place"), F.min(place).alias("best_place"), F.coalesce(F.max("longest_kill"), F.lit(0.0)).alias("longest_kill")]
    g = results.groupBy("account_id").agg(n, *counted, *best, *[total(c).alias(c) for c in SUMMED])
    per = {"avg_damage": "damage_dealt", "avg_survived_s": "survived_s", "kd": "kills", "kd_human": "kills_human", "win_rate": "wins"}
    g = g.withColumns({a: rate(F.col(c), F.col("matches")) for a, c in per.items()})
    shares = {"accuracy": rate(F.col("shots_hit"), F.col("shots_fired")), "headshot_rate": rate(F.col("headshot_kills"), F.col("kills"))}
    return g.withColumns({a: F.coalesce(c, F.lit(0.0)) for a, c in shares.items()})


def player_matches(results: DataFrame, names: DataFrame, n: int, before: Column | None = None) -> DataFrame:
    """The newest n matches of every account before a cursor (played_on, match_id), with whether the roster won and the killer's name.

    results: account_id, match_id, team_id, played_on, win_place, killer_id and more; names: account_id, name, is_bot.
    """
    won = results.groupBy("match_id", "team_id").agg((F.min("win_place") == 1).alias("roster_won"))
    older = results if before is None else results.where(F.struct("played_on", "match_id") < before)
    page = recent(older, "account_id", [F.col("played_on").desc(), F.col("match_id").desc(), "team_id", "kills", "damage_dealt"], n)
    killers = names.select(F.col("account_id").alias("killer_id"), F.col("name").alias("killed_by"), F.col("is_bot").alias("killed_by_is_bot"))
    return page.join(won, ["match_id", "team_id"]).join(killers, "killer_id", "left")


def recent(results: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key, numbered from 1."""
    return results.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("pos") <= n)


def weapon_table(kills: DataFrame, shots: DataFrame) -> DataFrame:
    """Kill figures and accuracy per account and weapon, whichever of both there is."""
    k = kills.groupBy("account_id", "weapon").agg(F.count("*").alias("kills"), F.max("distance").alias("longest"), mean(F.when(F.col("distance") > 0, F.col("distance"))).alias("mean_distance"))
    s = shots.groupBy("account_id", "weapon").agg(F.sum("shots").alias("shots"), F.sum("landed").alias("landed"))
    both = k.join(s, ["account_id", "weapon"], "full_outer")
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("kills", "shots", "landed")}).withColumn("accuracy", rate(F.col("landed"), F.col("shots")))


def bucketed(value: Column, buckets: Sequence[tuple], closed: bool = True) -> Column:
    """The bucket's name; with closed both ends belong to it, else only the lower."""
    top = lambda b: value <= b if closed else value < b
    return reduce(lambda e, b: e.when((value >= b[1]) & top(b[2]), F.lit(b[0])), buckets, F.when(F.lit(False), F.lit("")))


def histogram(rows: DataFrame, key: str, value: Column, buckets: Sequence[tuple], closed: bool = True) -> DataFrame:
    """One column per bucket, so empty ones are there with 0."""
    b = bucketed(value, buckets, closed)
    return rows.groupBy(key).agg(*[F.count_if(b == name).alias(f"n_{i}") for i, (name, *_) in enumerate(buckets)], F.count("*").alias("total"))


def nemeses(kills: DataFrame, n: int | None = None) -> DataFrame:
    """Per account and opponent how often each killed the other, and when last; bots (killer_is_bot, victim_is_bot) and suicides don't count.

    With n only the n opponents that killed the account most often, then those it killed most often, then by id.
    """
    k = kills.where("account_id <> victim_id")
    a = k.where("not victim_is_bot").groupBy("account_id", F.col("victim_id").alias("opponent")).agg(F.count("*").alias("killed"), F.max("match_id").alias("l1"))
    b = k.where("not killer_is_bot").groupBy(F.col("victim_id").alias("account_id"), F.col("account_id").alias("opponent"))
    b = b.agg(F.count("*").alias("killed_by"), F.max("match_id").alias("l2"))
    j = a.join(b, ["account_id", "opponent"], "full_outer")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("killed", "killed_by")]
    both = j.select("account_id", "opponent", *counts, F.greatest("l1", "l2").alias("last_seen"))
    order = [F.col("killed_by").desc(), F.col("killed").desc(), F.col("opponent")]
    return both if n is None else recent(both, "account_id", order, n).drop("pos")


def latest(rows: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def timeseries(results: DataFrame, since: Column | None = None) -> DataFrame:
    """Per account and day: matches, sums of kills, damage and survival, mean place, kills a match and accuracy; 0 where nothing is known."""
    rows = results if since is None else results.where(F.col("played_on") >= since)
    sums = [F.sum(c).cast("double").alias(a) for c, a in (("kills", "kills"), ("damage_dealt", "damage"), ("survived_s", "survived_s"))]
    ratios = [mean(F.col("win_place")).alias("win_place"), rate(F.sum("kills"), F.count("*")).alias("kd"), rate(F.sum("shots_hit"), F.sum("shots_fired")).alias("accuracy")]
    g = rows.groupBy("account_id", "played_on").agg(F.count("*").alias("matches"), *sums, *ratios)
    return g.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("kills", "damage", "survived_s", "win_place", "kd", "accuracy")})


def sessions(rows: DataFrame, keys: Sequence[str], t: str, gap: float, tie: Sequence[str], duration: str | None = None) -> DataFrame:
    """Runs of matches no more than gap apart, with best place, wins and kills; session 0 is the newest.

    With duration, the length of a match in t's unit, also span: from the first match's beginning to the last one's end.
    """
    place = F.min("win_place").alias("best_place"), F.count_if(F.col("win_place") == 1).alias("wins"), F.coalesce(F.sum("kills"), F.lit(0)).alias("kills")
    length = F.coalesce(F.max_by(duration, F.struct(t, *tie)), F.lit(0)) if duration else None
    span = [(F.max(t) - F.min(t) + length).alias("span")] if duration else []
    s = gap_segments(rows, keys, t, gap, tie).groupBy(*keys, "segment").agg(F.count("*").alias("n"), F.min(t).alias("began"), F.max(t).alias("ended"), *place, *span)
    return s.withColumn("session", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("segment").desc())) - 1).drop("segment")


def current_session(rows: DataFrame, keys: Sequence[str], t: str, gap: float, tie: Sequence[str], duration: str) -> DataFrame:
    """Each key's newest session."""
    return sessions(rows, keys, t, gap, tie, duration).where("session = 0").drop("session")


def squad_sessions(results: DataFrame, gap: float = 3 * 3600.0) -> DataFrame:
    """A row per evening of all tracked players together, newest first by evening (0, 1, ...): matches no more than gap seconds apart.

    results: tracked participants in matches that count, with match_id, played_at, win_place, kills, kills_human, death_t (null: survived), damage_dealt.
    A match counts once however many took part; its place is the best of theirs, 0 if unknown. Evenings are cut over ranges of time,
    so no task sorts all matches. places has an evening's places, newest first.
    """
    human = F.coalesce("kills_human", "kills", F.lit(0))
    by_match = results.groupBy("match_id", "played_at").agg(
        F.coalesce(F.min("win_place"), F.lit(0)).alias("place"), F.sum(human).alias("kills"), F.count("death_t").alias("deaths"), F.coalesce(F.sum(F.col("damage_dealt").cast("double")), F.lit(0.0)).alias("damage")
    )
    cut = long_gap_segments(by_match.withColumn("_t", F.unix_micros("played_at") / 1e6), "_t", gap, ["match_id"])
    newest = F.sort_array(F.collect_list(F.struct("played_at", "match_id", "place")), asc=False)
    place = F.col("place")
    counts = [F.count_if(place == 1).alias("wins"), F.count_if((place >= 1) & (place <= TOP)).alias("top10")]
    sums = [F.sum(c).alias(c) for c in ("kills", "deaths", "damage")]
    evenings = cut.groupBy("segment").agg(
        F.min("played_at").alias("started"), F.max("played_at").alias("ended"), F.count("*").alias("matches"), F.min(place).alias("best_place"), *counts, *sums, F.transform(newest, lambda m: m["place"]).alias("places")
    )
    last = evenings.agg(F.max("segment").alias("_last"))  # one row
    return evenings.crossJoin(F.broadcast(last)).withColumn("evening", F.col("_last") - F.col("segment")).drop("segment", "_last")


def overview(results: DataFrame, day: Column, days: int, measures: Sequence[str] = ("kills", "damage_dealt", "survived_s")) -> DataFrame:
    """Per account its career, the last days up to a day and as many before them, in one aggregate: matches, wins, means of the measures and their change."""
    spans = {
        "career": F.lit(True),
        "now": (F.col("played_on") > F.date_sub(day, days)) & (F.col("played_on") <= day),
        "before": (F.col("played_on") > F.date_sub(day, 2 * days)) & (F.col("played_on") <= F.date_sub(day, days)),
    }
    aggs = [F.max("played_on").alias("last_seen")]
    for span, w in spans.items():
        aggs += [F.count_if(w).alias(f"n_{span}"), F.count_if(w & (F.col("win_place") == 1)).alias(f"wins_{span}")]
        aggs += [rate(F.sum(F.when(w, F.col(m))), F.count_if(w)).alias(f"{m}_{span}") for m in measures]
    g = results.groupBy("account_id").agg(*aggs)
    return g.withColumns({f"{m}_change": F.col(f"{m}_now") - F.col(f"{m}_before") for m in measures})


def match_feed(matches: DataFrame, results: DataFrame, wanted: Column, n: int) -> DataFrame:
    """The newest n matches with a wanted participant, then those participants: the limit comes before the join."""
    keys = results.where(wanted)
    page = matches.join(keys.select("match_id"), "match_id", "left_semi").orderBy(F.col("played_on").desc(), F.col("match_id").desc()).limit(n)
    got = keys.join(F.broadcast(page.select("match_id")), "match_id").groupBy("match_id").agg(F.sort_array(F.collect_list("account_id")).alias("accounts"))  # a page of n rows
    return page.join(got, "match_id")


def scoreboard(results: DataFrame, shown: Sequence[str] = ("kills", "assists", "damage_dealt", "survived_s", "is_bot", "tracked")) -> DataFrame:
    """Rosters of every match by rank, with totals and their participants as structs in order of kills (most first) and id."""
    member = F.struct((-F.col("kills")).alias("_order"), "account_id", *shown)
    members = F.transform(F.sort_array(F.collect_list(member)), lambda m: m.dropFields("_order"))
    g = results.groupBy("match_id", "team_id").agg(F.min("win_place").alias("rank"), F.sum("kills").alias("team_kills"), members.alias("participants"))
    return g.withColumn("won", F.col("rank") == 1)


def kill_feed(kills: DataFrame, names: DataFrame, include_bots: bool = True) -> DataFrame:
    """Kills in order with the names of victim, killer, the one who knocked and the finisher, and of the assistants.

    kills: match_id, idx, victim_id, account_id, maker_id, finisher_id, assists (array of ids), distance, victim_is_bot;
    names: match_id, account_id, name. A distance that isn't over zero is null; an assistant without a name keeps its id.
    """
    rows = kills if include_bots else kills.where("not victim_is_bot")
    for c, a in (("account_id", "killer"), ("victim_id", "victim"), ("maker_id", "maker"), ("finisher_id", "finisher")):
        rows = rows.join(names.select("match_id", F.col("account_id").alias(c), F.col("name").alias(a)), ["match_id", c], "left")
    helped = kills.select("match_id", "idx", F.posexplode("assists").alias("pos", "account_id")).join(names, ["match_id", "account_id"], "left")
    named = F.struct("pos", F.coalesce("name", F.col("account_id").cast("string")).alias("name"))
    helpers = helped.groupBy("match_id", "idx").agg(F.transform(F.sort_array(F.collect_list(named)), lambda x: x["name"]).alias("helpers"))
    seq = F.row_number().over(Window.partitionBy("match_id").orderBy("idx")) - 1
    distance_m = F.when(F.col("distance") > 0, F.col("distance") / 100).alias("distance_m")
    joined = rows.join(helpers, ["match_id", "idx"], "left")
    return joined.select("match_id", "idx", seq.alias("seq"), "killer", "victim", "maker", "finisher", F.coalesce("helpers", F.array().cast("array<string>")).alias("helpers"), distance_m)


def third_party_deaths(kills: DataFrame, radius: float, within: float) -> DataFrame:
    """Deaths with whether a third team killed close by shortly before, counted per team of the victim; kills meet only in cells of space and time."""
    own = kills.select("match_id", "idx", "t_s", "team_id", "victim_team", "x", "y")
    near = near_in_space_and_time(own, own.drop("victim_team"), ["match_id"], ("x", "y"), "t_s", radius, within, 0)
    third = near.where("o_team_id <> team_id and o_team_id <> victim_team and o_idx <> idx").select("match_id", "idx").distinct().withColumn("third", F.lit(True))
    return kills.join(third, ["match_id", "idx"], "left").groupBy("victim_team").agg(F.count("*").alias("deaths"), F.count("third").alias("third_party"))


def death_causes(kills: DataFrame, knocks: DataFrame) -> DataFrame:
    """Causes per account, not exclusive: knocked before, outright, early, to a bot."""
    k = knocks.select("match_id", "victim_id").distinct().withColumn("knocked", F.lit(True))
    d = kills.join(k, ["match_id", "victim_id"], "left")
    return d.groupBy(F.col("victim_id").alias("account_id")).agg(F.count("*").alias("deaths"), F.count("knocked").alias("knocked_first"), F.count_if(F.col("knocked").isNull()).alias("outright"), F.count_if(F.col("t_s") < 21_600).alias("early"), F.count_if(F.col("account_id") % 10 == 0).alias("to_bot"))


def knock_conversion(knocks: DataFrame, kills: DataFrame) -> DataFrame:
    """Per account the knocks it made on humans and those it took, with how many became a kill by the kill's maker_id."""
    by = lambda df, who, name: df.groupBy(F.col(who).alias("account_id")).agg(F.count("*").alias(name))
    human, known = kills.where("not victim_is_bot and maker_id is not null"), kills.where("maker_id is not null")
    parts = [
        by(knocks.where("not victim_is_bot"), "account_id", "made"),
        by(human, "maker_id", "made_converted"),
        by(knocks, "victim_id", "taken"),
        by(known, "victim_id", "taken_converted"),
    ]
    j = reduce(lambda a, b: a.join(b, "account_id", "full_outer"), parts).fillna(0)
    return j.withColumns({f"{s}_rate": rate(F.col(f"{s}_converted"), F.col(s)) for s in ("made", "taken")})


def range_bands(kills: DataFrame, ours: Column, theirs: Column) -> DataFrame:
    """Per band of the distance in metres (over zero) the kills for us and against us; every band has a row."""
    rows = kills.where((F.col("distance") > 0) & (ours | theirs))
    b = bucketed(F.col("distance") / 100, RANGES, closed=False)
    g = rows.groupBy(b.alias("band")).agg(F.count_if(ours).alias("we_killed"), F.count_if(theirs).alias("we_died"))
    # as many rows as there are bands
    bands = kills.sparkSession.createDataFrame([(n,) for n, *_ in RANGES], "band string")
    return F.broadcast(bands).join(g, "band", "left").fillna(0)


def zone_deaths(results: DataFrame) -> DataFrame:
    """Deaths by the zone, which have no killer and are in no other count."""
    return results.where(F.lower("death_type") == "byzone").groupBy("account_id").agg(F.count("*").alias("zone_deaths"))


def first_deaths(rows: DataFrame) -> DataFrame:
    """Who dies first among two or more of a match; accounts without a death come last."""
    w = Window.partitionBy("match_id")
    n = rows.withColumn("n", F.count("*").over(w)).withColumn("pos", F.row_number().over(w.orderBy(F.col("death_t").asc_nulls_last(), "account_id")))
    return n.where("n >= 2 and pos = 1 and death_t is not null").groupBy("account_id").agg(F.count("*").alias("first_deaths"))


def engagement_review(fights: DataFrame) -> DataFrame:
    """Per team: fights, results, and how the side that hit first fares; fights without a hit are in neither half."""
    legs = fights.select("match_id", "seq", F.explode(F.array(*[F.struct(F.col(f"team_{s}").alias("team_id"), F.col(f"kills_{s}").alias("ours"), F.col(f"kills_{o}").alias("theirs"), F.col("first_hit_team"), F.col("first_hit_range")) for s, o in (("a", "b"), ("b", "a"))])).alias("l")).select("match_id", "l.*")
    won, lost, first = F.col("ours") > F.col("theirs"), F.col("ours") < F.col("theirs"), F.col("first_hit_team") == F.col("team_id")
    return legs.groupBy("team_id").agg(F.count("*").alias("fights"), F.count_if(won).alias("won"), F.count_if(lost).alias("lost"), F.count_if(~won & ~lost).alias("even"), F.count_if(first).alias("hit_first"), F.count_if(first & won).alias("hit_first_won"), F.count_if(~first & won).alias("hit_second_won"), rate(F.count_if(first & won), F.count_if(first)).alias("first_win_rate"))


def strategy_baseline(rows: DataFrame, key: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Quartiles and number of known values of each metric."""
    return exact_quantiles(rows, key, metrics, (0.25, 0.5, 0.75))


def contrast_by_placement(rows: DataFrame, key: str, metric: str, n: int = 10, least: int = 4) -> DataFrame:
    """The mean of a metric in the n best and n worst placed rows, all that tie with the last included; null for fewer than least rows."""
    w = Window.partitionBy(key)
    r = rows.withColumn("_up", F.row_number().over(w.orderBy("win_place"))).withColumn("_down", F.row_number().over(w.orderBy(F.col("win_place").desc()))).withColumn("_n", F.count("*").over(w))
    half = F.least(F.lit(n), F.floor(F.col("_n") / 2))
    cut = r.withColumn("_hi", F.max(F.when(F.col("_up") == half, F.col("win_place"))).over(w)).withColumn("_lo", F.max(F.when(F.col("_down") == half, F.col("win_place"))).over(w))
    best, worst = F.when(F.col("win_place") <= F.col("_hi"), F.col(metric)), F.when(F.col("win_place") >= F.col("_lo"), F.col(metric))
    g = cut.groupBy(key).agg(F.max("_n").alias("n"), mean(best).alias("best"), F.count(best).alias("n_best"), mean(worst).alias("worst"), F.count(worst).alias("n_worst"))
    return g.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in ("best", "worst")})


def merged_weapons(rows: DataFrame) -> DataFrame:
    return rows.groupBy("weapon").agg(F.sum("kills").alias("kills"), F.max("longest").alias("longest"), rate(F.sum(F.col("mean_distance") * F.col("kills")), F.sum(F.when(F.col("mean_distance").isNotNull(), F.col("kills")))).alias("mean_distance"), rate(F.sum("landed"), F.sum("shots")).alias("accuracy"))


def circle_gaps(rows: DataFrame, min_gap: float = 0.08, min_n: int = 15) -> DataFrame:
    """Phases where the squad's rate is over min_gap behind the lobby's; rows: phase, is_squad, inside."""
    g = rows.groupBy("phase").agg(*[c for s, w in (("squad", F.col("is_squad")), ("lobby", ~F.col("is_squad"))) for c in (F.count_if(w).alias(f"n_{s}"), rate(F.count_if(w & F.col("inside")), F.count_if(w)).alias(f"pct_{s}"))])
    return g.where((F.col("n_squad") >= min_n) & (F.col("pct_lobby") - F.col("pct_squad") >= min_gap)).withColumn("gap", F.col("pct_lobby") - F.col("pct_squad"))


def compared(rows: DataFrame, key: str, axes: Sequence[str], inverted: Sequence[str] = ()) -> DataFrame:
    """Each axis as a share of the best in the group; smaller is better on inverted ones."""
    w = Window.partitionBy(key)
    scaled = {f"s_{a}": (F.coalesce(F.min(a).over(w).cast("double") / F.nullif(F.col(a).cast("double"), F.lit(0.0)), F.lit(0.0)) if a in inverted else F.coalesce(F.col(a).cast("double") / F.nullif(F.max(a).over(w).cast("double"), F.lit(0.0)), F.lit(0.0))) for a in axes}
    return rows.withColumns(scaled)


def freshness(rows: DataFrame, now: Column) -> DataFrame:
    lag = F.unix_seconds(now) - F.unix_seconds("last_polled_at")
    return rows.agg(F.max(lag).alias("stalest_s"), F.min(lag).alias("freshest_s"), F.count_if(F.col("last_polled_at").isNull()).alias("never_polled"))


def folded_alerts(checks: DataFrame) -> DataFrame:
    """Runs of consecutive failed checks per kind: opened, last seen, number, and when a good check resolved them.

    checks: kind, t_s, idx, ok. Windows cover ranges of (kind, time); a range hands on its number of good checks and the first of them,
    so a kind with most of all rows is spread over tasks.
    """
    w = Window.partitionBy("kind", "_range").orderBy("t_s", "idx")
    good = F.when(F.col("ok"), F.col("t_s"))
    r = ranged(checks.select("kind", "t_s", "idx", "ok"), ["kind", "t_s", "idx"])
    # what is ahead is looked up in the turned order: a frame that ends with the key is summed anew for each row
    turned = Window.partitionBy("kind", "_range").orderBy(F.col("t_s").desc(), F.col("idx").desc())
    r = r.withColumn("_run", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.min(good).over(turned.rowsBetween(Window.unboundedPreceding, -1)))
    # a row for each range and kind in it
    of_range = r.groupBy("kind", "_range").agg(F.count_if("ok").alias("n_ok"), F.min(good).alias("first_ok"))
    along = Window.partitionBy("kind").orderBy("_range")
    before = F.coalesce(F.sum("n_ok").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    later = F.min("first_ok").over(Window.partitionBy("kind").orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_later")
    joined = r.where("not ok").join(of_range.select("kind", "_range", before, later), ["kind", "_range"])
    runs = joined.groupBy("kind", (F.col("_before") + F.col("_run")).alias("_run"))
    return runs.agg(F.min("t_s").alias("opened"), F.max("t_s").alias("last_seen"), F.count("*").alias("observations"), F.max(F.coalesce("_next", "_later")).alias("resolved")).drop("_run")


def alert_events(checks: DataFrame, open_alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each check does to its kind's alert (open, refresh or resolve), and the alerts that are open after all checks.

    checks: kind, t_s, idx, ok; open_alerts: kind, opened, n, the alerts open before them, at most one a kind. As in folded_alerts windows
    cover ranges of (kind, time). A range's summary is the run of failures at its end and whether a good check lies before it; summaries add up from
    the left: those without a good check lengthen the run that comes in.
    """
    w = Window.partitionBy("kind", "_range").orderBy("t_s", "idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    bad = ~F.col("ok")
    r = ranged(checks.select("kind", "t_s", "idx", "ok"), ["kind", "t_s", "idx"]).withColumn("_n", F.row_number().over(w))
    r = r.withColumns({"_good": F.coalesce(F.max(F.when(F.col("ok"), F.col("_n"))).over(so_far), F.lit(0)), "_was_ok": F.lag("ok").over(w)})
    # failures in a row up to and with this check, and the first of them, as far as this range knows
    r = r.withColumn("_failed", (F.col("_n") - F.col("_good")).cast("bigint")).withColumn("_since", F.last(F.when(bad & F.coalesce("_was_ok", F.lit(True)), F.col("t_s")), ignorenulls=True).over(so_far))
    last = F.max_by(F.struct("_failed", "_since", "_good"), F.struct("t_s", "idx"))
    ends = r.groupBy("kind", "_range").agg(last.alias("e")).select("kind", "_range", F.col("e._failed").alias("tail"), F.when(F.col("e._failed") > 0, F.col("e._since")).alias("since"), (F.col("e._good") > 0).alias("has_ok"))
    came = open_alerts.select("kind", F.lit(-1).alias("_range"), F.col("n").alias("tail"), F.col("opened").alias("since"), F.lit(False).alias("has_ok"))
    along = Window.partitionBy("kind").orderBy("_range")
    up_to = lambda *k: Window.partitionBy(*k).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.unionByName(came).withColumn("group", F.count_if("has_ok").over(up_to("kind")))
    ends = ends.withColumns({"tail": F.sum("tail").over(up_to("kind", "group")), "since": F.first("since", ignorenulls=True).over(up_to("kind", "group"))})
    carried = ends.select("kind", "_range", F.coalesce(F.lag("tail").over(along), F.lit(0)).alias("_tail"), F.lag("since").over(along).alias("_came"))
    r = r.join(carried, ["kind", "_range"]).withColumn("_whole", F.col("_good") == 0)
    r = r.withColumns({"failed": F.col("_failed") + F.when(F.col("_whole"), F.col("_tail")).otherwise(0), "since": F.when(F.col("_whole") & (F.col("_tail") > 0), F.col("_came")).otherwise(F.col("_since"))})
    # before a good check: what the check before it left, or what came into the range
    before = {"_failed_before": F.coalesce(F.lag("failed").over(w), "_tail"), "_since_before": F.when(F.col("_n") == 1, F.col("_came")).otherwise(F.lag("since").over(w))}
    r = r.withColumns(before).where(bad | (F.col("_failed_before") > 0))
    event = F.when(F.col("ok"), "resolve").when(F.col("_failed_before") > 0, "refresh").otherwise("open")
    n = F.when(F.col("ok"), F.col("_failed_before")).otherwise(F.col("failed"))
    events = r.select("kind", "idx", event.alias("event"), F.when(F.col("ok"), F.col("_since_before")).otherwise(F.col("since")).alias("opened"), F.col("t_s").alias("last_seen"), n.alias("observations"))
    still = ends.groupBy("kind").agg(F.max_by(F.struct("since", "tail"), "_range").alias("e")).where("e.tail > 0").select("kind", F.col("e.since").alias("opened"), F.col("e.tail").alias("n"))
    return events, still


def due(rows: DataFrame, now: int, base: int, cap: int) -> DataFrame:
    """Rows whose wait, doubled by each failure up to cap, is over."""
    return rows.where(F.lit(now) - F.col("last_s") >= F.least(F.lit(base) * F.pow(F.lit(2), F.col("failures")), F.lit(cap)))


def merged_entities(old: DataFrame, new: DataFrame, key: str, owned: Sequence[str]) -> DataFrame:
    """Insert or update: columns that the source owns take the new value if there is one, all others stay."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in owned])
    j = old.join(n, key, "full_outer")
    return j.select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in owned else F.col(c) for c in old.columns if c != key])


def new_ids(seen: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return seen.select(key).distinct().join(known.select(key), key, "left_anti")


def match_summary(participants: DataFrame) -> DataFrame:
    """Per match its players, teams and bots."""
    return participants.groupBy("match_id").agg(F.count("*").alias("start_players"), F.count_distinct("team_id").alias("start_teams"), F.count_if("is_bot").alias("bot_count"))


def modes_played(matches: DataFrame) -> DataFrame:
    """The modes that matches were played in, the most frequent first."""
    return matches.where("game_mode <> ''").groupBy("game_mode").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "game_mode")


def maps_played(matches: DataFrame) -> DataFrame:
    """The maps that matches were played on, with their name for readers, size and the share of the image that they fill."""
    name = F.col("map_name")
    return matches.select("map_name").distinct().select("map_name", display_name(name).alias("display"), world_size(name).alias("world_size"), F.lit(IMAGE_SCALE).alias("image_scale")).orderBy("map_name")


def archive_stats(participants: DataFrame) -> DataFrame:
    """Per type of match: rows, matches, first and last day, share of bots. participants: match_id, match_type, played_on, is_bot."""
    return participants.groupBy("match_type").agg(
        F.count("*").alias("rows_in"), F.count_distinct("match_id").alias("matches"), F.min("played_on").alias("first"), F.max("played_on").alias("last"), rate(F.count_if("is_bot"), F.count("*")).alias("bot_share")
    )


def backlog(matches: DataFrame, now: Column, wait_s: int = 3600) -> DataFrame:
    """One row: matches that wait for over wait_s seconds to be parsed, those that failed, and since when the oldest waits. matches: fetched_at, parsed_at, parse_error."""
    waits = F.col("parsed_at").isNull() & F.col("parse_error").isNull()
    late = F.col("fetched_at") < now - F.make_dt_interval(secs=F.lit(wait_s))
    return matches.agg(F.count_if(waits & late).alias("unparsed"), F.count_if(F.col("parse_error").isNotNull()).alias("errors"), F.min(F.when(waits, F.col("fetched_at"))).alias("oldest"))


def stale_versions(matches: DataFrame, head: int) -> DataFrame:
    """Matches to derive again: parsed by an older version, and their telemetry is still there. matches: parsed_at, parser_version, telemetry_key."""
    return matches.where(F.col("parsed_at").isNotNull() & F.col("telemetry_key").isNotNull() & (F.col("parser_version") < head))
