"""Driver queries over inventories, reviews, retention and streams, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchlake.operators import inventory, reviews
from matchlake.operators.rounds import shared_folder
from matchlake.plans import timeline
from matchlake.plans.timeline import M, W, engagements, of
from matchlake.plans.view import EV, RES, events, results, results_by_player
from matchlake.sources.files import profile_schema
from matchlake.streaming import fights, jobs

Q: dict = {}
SQL: dict = {}
R = f"WITH {RES}"
_ENGAGED, _MEMBERS = timeline.SQL["d17_engagements"], timeline.SQL["d18_engagement_participants"]


def over(table, sql: str | None):
    def add(f):
        Q[f.__name__] = lambda spark, sf: f(table(spark, sf))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def timed(spark, sf):
    """Events with milliseconds and an item."""
    return events(spark, sf).withColumn("t_ms", F.col("t_s") * 1000).withColumn("item", F.col("idx") % 2)


def _deaths(e):
    return of(e, "kill").groupBy("match_id", F.col("victim_id").alias("account_id")).agg(F.max("t_ms").alias("death_ms"))


# --- inventories

_T = f"WITH {EV}, tm AS (SELECT *, t_s * 1000 AS t_ms, idx % 2 AS item FROM ev)"


@over(timed, None)
def f1_placed_items(e):
    op = F.expr("CASE kind WHEN 'landing' THEN 'equip' WHEN 'kill' THEN 'unequip' WHEN 'knock' THEN 'attach' WHEN 'position' THEN 'detach' ELSE 'destroy' END")
    rows = e.select(*M, "idx", "t_ms", op.alias("op"), F.when(~F.col("kind").isin("knock", "position"), (F.col("idx") % 3).cast("int") * 2).alias("slot"), F.col("item").cast("string").alias("item"), F.lit("scope").alias("child"), F.when(F.col("kind") == "position", F.array(F.lit("scope"))).alias("before"))
    return inventory.placed(rows)


@over(timed, f"""{_T}, d AS (SELECT match_id, victim_id AS account_id, max(t_s) * 1000 AS death_ms FROM ev WHERE kind = 'kill' GROUP BY 1, 2) SELECT match_id, account_id,
count(*) AS n, count(*) FILTER (t_ms > death_ms) AS n_late FROM tm LEFT JOIN d USING (match_id, account_id) WHERE kind = 'position' GROUP BY 1, 2""")
def f2_before_death(e):
    return inventory.before_death(of(e, "position"), _deaths(e)).groupBy(*M).agg(F.count("*").alias("n"), F.count_if("late").alias("n_late"))


@over(timed, f"""{_T} SELECT match_id, account_id, idx FROM tm a WHERE kind = 'knock' AND NOT EXISTS (SELECT 1 FROM tm b WHERE b.kind = 'hit' AND
b.match_id = a.match_id AND b.account_id = a.account_id AND b.item = a.item AND abs(b.t_ms - a.t_ms) <= 3600000)""")
def f3_trunk_pickups(e):
    return inventory.trunk_pickups(of(e, "knock"), of(e, "hit"), 3_600_000).select(*M, "idx")


@over(timed, f"""{_T} SELECT match_id, account_id, idx FROM tm a WHERE kind = 'landing' AND NOT EXISTS (SELECT 1 FROM tm b WHERE b.kind = 'hit' AND
b.match_id = a.match_id AND b.account_id = a.account_id AND b.item = a.item AND b.idx % 3 = a.idx % 3 AND abs(b.t_ms - a.t_ms) <= 7200000)""")
def f4_unequips(e):
    e = e.withColumn("slot", F.col("idx") % 3)
    return inventory.unequips(of(e, "landing"), of(e, "hit"), 7_200_000).select(*M, "idx")


def _stacks(e):
    op = F.expr("CASE kind WHEN 'landing' THEN 'set' WHEN 'hit' THEN 'remove' ELSE 'add' END")
    rows = e.withColumn("op", op).withColumn("quantity", inventory.quantity(F.col("op"), F.col("idx") % 5))
    return inventory.stacks(rows).select(*M, "item", "idx", "t_ms", "stack")


_ST = f"""{_T}, o AS (SELECT *, CASE kind WHEN 'landing' THEN idx % 5 WHEN 'hit' THEN -coalesce(nullif(idx % 5, 0), 1) ELSE coalesce(nullif(idx % 5, 0), 1) END AS change, sum(CASE WHEN kind = 'landing' THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, account_id, item ORDER BY idx ROWS UNBOUNDED PRECEDING) AS epoch FROM tm),
s AS (SELECT *, sum(change) OVER w AS total FROM o WINDOW w AS (PARTITION BY match_id, account_id, item, epoch ORDER BY idx ROWS UNBOUNDED PRECEDING)),
st AS (SELECT match_id, account_id, item, idx, t_ms, CAST(total - least(0, min(total) OVER (PARTITION BY match_id, account_id, item, epoch ORDER BY idx ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS stack FROM s)"""


@over(timed, f"{_ST} SELECT * FROM st")
def f5_stacks(e):
    return _stacks(e)


@over(timed, f"""{_T}, b AS (SELECT idx, list_sort([CAST(idx % 3 AS VARCHAR), CAST(idx % 2 AS VARCHAR), '1']) AS b FROM tm) SELECT idx,
array_to_string(list_sort(CASE WHEN idx % 2 = 0 THEN list_append(b, '1') ELSE list_concat(b[1:list_position(b, '1') - 1], b[list_position(b, '1') + 1:]) END), ',')
AS attached FROM b""")
def f6_reattached(e):
    before = F.array_sort(F.array((F.col("idx") % 3).cast("string"), (F.col("idx") % 2).cast("string"), F.lit("1")))
    rows = e.select("idx", before.alias("b"))
    return rows.select("idx", F.array_join(inventory.reattached(F.col("b"), F.lit("1"), F.col("idx") % 2 == 0), ",").alias("attached"))


_CAP = "CASE slot * 10 + level " + " ".join(f"WHEN {s * 10 + n} THEN {cap}" for (s, n), cap in inventory.ARMOR_MAX.items()) + " END"


@over(timed, f"""{_T}, r AS (SELECT match_id, account_id, idx, 5 + idx % 2 AS slot, CASE kind WHEN 'landing' THEN 'equip' WHEN 'kill' THEN 'off' ELSE 'hit' END AS op, 1 + idx % 3 AS lv, CAST(damage AS DOUBLE) AS damage FROM tm WHERE kind IN ('landing', 'kill', 'hit')),
c AS (SELECT *, count(*) FILTER (op <> 'hit') OVER w AS change, last_value(CASE WHEN op <> 'hit' THEN op END IGNORE NULLS) OVER w AS state, last_value(CASE WHEN op <> 'hit' THEN lv END IGNORE NULLS) OVER w AS level FROM r WINDOW w AS (PARTITION BY match_id, account_id, slot ORDER BY idx ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, {_CAP} AS cap, CASE WHEN damage > 0 THEN damage / (1 - CASE level WHEN 1 THEN 0.3 WHEN 2 THEN 0.4 ELSE 0.55 END::DOUBLE) ELSE 40 END AS loss FROM c WHERE op = 'hit' AND state = 'equip')
SELECT match_id, account_id, idx, slot, CAST(row_number() OVER w AS INTEGER) AS hit_no, round(greatest(0, cap - sum(loss) OVER w), 4) AS remaining FROM h WINDOW w AS (PARTITION BY match_id, account_id, slot, change ORDER BY idx ROWS UNBOUNDED PRECEDING)""")
def f7_armour_hits(e):
    op = F.expr("CASE kind WHEN 'landing' THEN 'equip' WHEN 'kill' THEN 'off' ELSE 'hit' END")
    rows = of(e, "landing", "kill", "hit").select(*M, "idx", (5 + F.col("idx") % 2).alias("slot"), op.alias("op"), F.concat(F.lit("X_Lv"), (1 + F.col("idx") % 3).cast("string")).alias("item"), F.col("damage").cast("double").alias("damage"))
    return inventory.armour_hits(rows).select(*M, "idx", "slot", "hit_no", F.round("remaining", 4).alias("remaining"))


@over(timed, f"""{_ST}, n AS (SELECT *, lead(t_ms) OVER (PARTITION BY match_id, account_id, item ORDER BY t_ms, idx) AS nxt, max(t_ms) OVER (PARTITION BY match_id)
AS fin FROM st), ticks AS (SELECT unnest(range(0, 86400001, 21600000)) AS at_ms) SELECT match_id, account_id, item, stack, at_ms FROM n JOIN ticks ON at_ms >= t_ms AND
(nxt IS NULL OR at_ms < nxt) AND at_ms <= fin WHERE stack <> 0""")
def f8_snapshots(e):
    return inventory.snapshots(_stacks(e), ["item"], "stack", 21_600_000)


def _deltas(e):
    """Landings put armour on, knocks attach, a seventh of the positions takes off, the others pick up; hits wear armour, kills end it."""
    kind = F.expr("CASE WHEN kind = 'landing' THEN 'LogItemEquip' WHEN kind = 'knock' THEN 'LogItemAttach' WHEN kind = 'position' AND idx % 7 = 0 THEN 'LogItemUnequip' WHEN kind = 'position' THEN 'LogItemPickup' END")
    slot = (5 + F.col("idx") % 2).cast("int")
    named = F.concat(F.lit("X"), slot.cast("string"), F.lit("_Lv2"))
    rows = of(e, "landing", "knock", "position").select(*M, "idx", "t_ms", kind.alias("kind"), named.alias("item"), (F.col("idx") % 4).alias("stack"), slot.alias("slot"), F.lit("scope").alias("child"), F.array().cast("array<string>").alias("attached"))
    last = of(e, "kill").groupBy("match_id", F.col("victim_id").alias("account_id")).agg(F.max("t_ms").alias("death_ms"), F.max_by("idx", F.struct("t_ms", "idx")).alias("idx"))
    hits = of(e, "hit").select("match_id", F.col("victim_id").alias("account_id"), "idx", "t_ms", slot.alias("slot"), "damage")
    return inventory.deltas(rows, last, hits)


_DELTAS = f"""{_T}, de AS (SELECT match_id, victim_id AS account_id, max(t_ms) AS death_ms, arg_max(idx, t_ms * 100000000 + idx) AS idx FROM tm WHERE kind = 'kill' GROUP BY 1, 2),
it AS (SELECT tm.match_id, tm.account_id, tm.idx, t_ms, CASE WHEN kind = 'landing' THEN 'equip' WHEN kind = 'knock' THEN 'attach' WHEN tm.idx % 7 = 0 THEN 'unequip' ELSE 'add' END AS op, CAST(5 + tm.idx % 2 AS INTEGER) AS slot
  FROM tm LEFT JOIN de USING (match_id, account_id) WHERE kind IN ('landing', 'knock', 'position') AND (death_ms IS NULL OR t_ms <= death_ms)),
wr AS (SELECT *, lag(op) OVER (PARTITION BY match_id, account_id, slot ORDER BY idx) = 'equip' AS held FROM it WHERE op <> 'add'),
off AS (SELECT match_id, account_id, idx, slot, CASE WHEN op = 'equip' THEN 'equip' ELSE 'off' END AS op, CAST(NULL AS DOUBLE) AS damage, t_ms FROM wr WHERE op <> 'attach' UNION ALL SELECT match_id, account_id, idx, unnest([5, 6]), 'off', NULL, death_ms FROM de
  UNION ALL SELECT tm.match_id, victim_id, tm.idx, CAST(5 + tm.idx % 2 AS INTEGER), 'hit', CAST(damage AS DOUBLE), t_ms FROM tm LEFT JOIN de ON de.match_id = tm.match_id AND de.account_id = victim_id WHERE kind = 'hit' AND (death_ms IS NULL OR t_ms <= death_ms)),
st2 AS (SELECT *, count(*) FILTER (op <> 'hit') OVER w AS change, last_value(CASE WHEN op <> 'hit' THEN op END IGNORE NULLS) OVER w AS state FROM off WINDOW w AS (PARTITION BY match_id, account_id, slot ORDER BY idx ROWS UNBOUNDED PRECEDING)),
hh AS (SELECT *, CASE slot WHEN 5 THEN 150.0 ELSE 235.0 END AS cap, sum(CASE WHEN damage > 0 THEN damage / 0.6::DOUBLE ELSE 40 END) OVER (PARTITION BY match_id, account_id, slot, change ORDER BY idx ROWS UNBOUNDED PRECEDING) AS lost FROM st2 WHERE op = 'hit' AND state = 'equip'),
dl AS (SELECT match_id, account_id, idx, t_ms, op, NULL AS slot, 'X' || slot || '_Lv2' AS item, CASE WHEN idx % 4 = 0 THEN 1 ELSE idx % 4 END AS quantity FROM it WHERE op = 'add'
  UNION ALL SELECT match_id, account_id, idx, t_ms, op, CASE WHEN op <> 'attach' OR held THEN slot END, 'X' || slot || '_Lv2', NULL FROM wr UNION ALL SELECT match_id, account_id, idx, death_ms, 'clear', NULL, NULL, NULL FROM de
  UNION ALL SELECT match_id, account_id, idx, t_ms, 'armour_hit', slot, 'X' || slot || '_Lv2', CAST(round_even(greatest(0, cap - lost) / cap * 100, 0) AS BIGINT) FROM hh)"""


@over(timed, f"{_DELTAS} SELECT * FROM dl")
def f1_inventory_deltas(e):
    return _deltas(e).drop("attached")


@over(timed, f"""{_DELTAS}, ro AS (SELECT match_id, account_id, min(team_id) AS team_id FROM ev GROUP BY 1, 2), pl AS (SELECT *, dense_rank()
OVER (PARTITION BY match_id ORDER BY team_id, account_id) - 1 AS player FROM ro) SELECT match_id, player, CAST(least(floor(t_ms / 2000.0), 65535) AS INTEGER) AS tick,
idx, op, slot, item, quantity FROM dl JOIN pl USING (match_id, account_id)""")
def e3_replay_inventory(e):
    return inventory.replay_inventory(_deltas(e), timeline.roster(e), 2000)


@over(timed, f"""{_ST}, d AS (SELECT match_id, victim_id AS account_id, max(t_ms) AS death_ms FROM tm WHERE kind = 'kill' GROUP BY 1, 2) SELECT match_id, account_id,
item, arg_max(stack, st.t_ms * 100000000 + idx) AS stack, death_ms AS at_ms FROM st JOIN d USING (match_id, account_id) WHERE st.t_ms <= death_ms GROUP BY 1, 2, 3,
5 HAVING arg_max(stack, st.t_ms * 100000000 + idx) <> 0""")
def f9_held_at_death(e):
    return inventory.held_at_death(_stacks(e), _deaths(e), ["item"], "stack")


def _seen(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderpriority", "o_orderkey", "o_orderdate")
    return o.select(F.col("o_orderpriority").alias("job"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate").cast("timestamp")).alias("seen_at"))


@over(_seen, "SELECT o_orderpriority AS job, CAST(epoch(TIMESTAMP '2000-01-01') - epoch(max(o_orderdate) FILTER (o_orderkey % 3 > 0)) AS BIGINT) AS age_s FROM orders GROUP BY 1")
def h1_heartbeat_age(rows):
    return jobs.heartbeat_age(rows, F.lit("2000-01-01").cast("timestamp"))


# --- reviews


@over(events, f"""WITH p AS ({_MEMBERS}) SELECT account_id, count(*) AS fights, sum(damage_dealt) / count(*) AS damage_dealt_avg, sum(damage_taken) / count(*)
AS damage_taken_avg, count(*) FILTER (was_knocked) / count(*) AS knocked, count(*) FILTER (died) / count(*) AS died FROM p GROUP BY 1""")
def g25_engagement_players(e):
    return reviews.engagement_players(timeline.d18_engagement_participants(None, None, e))


@over(events, f"""WITH f AS ({_ENGAGED}), p AS ({_MEMBERS}), a AS (SELECT match_id, team_a, team_b, segment, list_sort(list(DISTINCT account_id)) AS accounts FROM
p GROUP BY 1, 2, 3, 4) SELECT match_id, seq, t_start, array_to_string(accounts, ',') AS accounts FROM f LEFT JOIN a USING (match_id, team_a, team_b, segment)""")
def g26_match_engagements(e):
    both = reviews.match_engagements(engagements(e), timeline.d18_engagement_participants(None, None, e))
    return both.select("match_id", "seq", "t_start", F.array_join(F.col("accounts").cast("array<string>"), ",").alias("accounts"))


@over(events, f"""WITH f AS ({_ENGAGED}), p AS ({_MEMBERS}) SELECT match_id, seq, account_id, t_start, t_end, CASE WHEN team_id = team_a THEN
team_b ELSE team_a END AS opponent_team, CASE WHEN team_id = team_a THEN kills_a ELSE kills_b END AS kills_ours, CASE WHEN team_id = team_a THEN
kills_b ELSE kills_a END AS kills_theirs, CASE WHEN team_id = team_a THEN knocks_a ELSE knocks_b END AS knocks_ours, CASE WHEN team_id = team_a THEN
knocks_b ELSE knocks_a END AS knocks_theirs FROM f JOIN p USING (match_id, team_a, team_b, segment)""")
def c24_fights_for(e):
    return reviews.fights_for(engagements(e), timeline.d18_engagement_participants(None, None, e))


def _reviewed(e):
    deaths = of(e, "kill").select("match_id", F.col("victim_id").alias("account_id"), "idx", "t_s", F.when(F.col("idx") % 5 > 0, F.col("idx") % 4).alias("teammates_alive"), F.col("x").alias("nearest_cm"), (F.col("idx") % 3 == 0).alias("knocked_first"))
    fights = of(e, "landing").select(*M, F.col("idx").alias("seq"), F.col("t_s").alias("t_start"), F.col("damage").cast("double").alias("damage_dealt"), F.col("distance").alias("damage_taken"), F.when(F.col("idx") % 4 == 0, F.col("team_id")).alias("third_party_team_id"))
    return reviews.death_review(deaths, _circles(e), fights)


def _circles(e):
    return of(e, "knock").select(*M, F.col("idx").alias("phase"), F.when(F.col("idx") % 3 > 0, F.col("t_s")).alias("close_t_s"), F.when(F.col("idx") % 4 > 0, F.col("idx") % 2 == 0).alias("in_circle"), (F.col("idx") % 7 > 0).alias("alive_at_close"))


_REVIEW = f"""{W}, circles AS (SELECT match_id, account_id, idx AS phase, CASE WHEN idx % 3 > 0 THEN t_s END AS close_t_s, CASE WHEN idx % 4 > 0 THEN idx % 2 = 0 END AS in_circle, idx % 7 > 0 AS alive_at_close FROM knocks),
d AS (SELECT match_id, victim_id AS account_id, idx, t_s, CASE WHEN idx % 5 > 0 THEN idx % 4 END AS teammates_alive, x AS nearest_cm, idx % 3 = 0 AS knocked_first FROM kills),
cl AS (SELECT d.idx, arg_max(coalesce(CAST(in_circle AS VARCHAR), '-'), (close_t_s, phase)) AS c FROM d JOIN circles USING (match_id, account_id) WHERE close_t_s <= t_s GROUP BY 1),
fi AS (SELECT d.idx, arg_max(l.idx, (l.t_s, l.idx)) AS fight_seq FROM d JOIN landings l USING (match_id, account_id) WHERE l.t_s <= d.t_s GROUP BY 1),
rv AS (SELECT d.*, CASE c WHEN 'true' THEN true WHEN 'false' THEN false END AS in_circle, fight_seq, CAST(l.damage AS DOUBLE) AS fight_damage_dealt, CASE WHEN fight_seq % 4 = 0 THEN l.team_id END AS fight_third_party_team_id FROM d LEFT JOIN cl USING (idx) LEFT JOIN fi USING (idx) LEFT JOIN landings l ON l.idx = fight_seq)"""


@over(events, f"{_REVIEW} SELECT match_id, account_id, idx, in_circle, fight_seq, fight_damage_dealt, fight_third_party_team_id FROM rv")
def g27_death_review(e):
    return _reviewed(e).select(*M, "idx", "in_circle", "fight_seq", "fight_damage_dealt", "fight_third_party_team_id")


@over(events, f"""{_REVIEW}, b AS (SELECT count(*) FILTER (NOT in_circle) / count(*) AS outside_baseline FROM circles WHERE alive_at_close AND in_circle IS NOT NULL),
r AS (SELECT count(*) AS deaths, count(*) FILTER (teammates_alive = 0) / count(teammates_alive) AS alone, count(*) FILTER (teammates_alive > 0 AND nearest_cm > 10000) / count(*) FILTER (teammates_alive > 0) AS isolated, count(fight_third_party_team_id) / count(*) AS third_partied, count(*) FILTER (knocked_first) / count(*) AS knocked_first, count(*) FILTER (NOT in_circle) / count(in_circle) AS outside_at_death, count(*) FILTER (fight_seq IS NULL) AS outside_any_fight FROM rv)
SELECT r.*, b.*, outside_at_death - outside_baseline AS gap, abs(outside_at_death - outside_baseline) >= 0.1 AS different FROM r, b""")
def g38_circle_comparison(e):
    return reviews.circle_comparison(reviews.death_rates(_reviewed(e), _circles(e)))


@over(events, f"""{W} SELECT idx, array_to_string(list_filter([CASE WHEN idx % 2 = 0 THEN 'third-partied' END, CASE WHEN idx % 3 = 0 THEN 'knocked first' END, CASE WHEN idx % 5 = 0 THEN 'last one up' END, CASE WHEN idx % 5 > 0 AND x / 100 > 100 THEN CAST(CAST(floor(x / 100 + 0.5) AS BIGINT) AS VARCHAR) || ' m from the squad' END, CASE WHEN idx % 7 = 0 THEN 'in a vehicle' END, CASE WHEN idx % 11 = 0 THEN 'to a bot' END], lambda t: t IS NOT NULL), '; ') AS tags, greatest(0, t_s - 15) AS replay_from_s FROM kills""")
def g39_death_tags(e):
    flag = lambda n: F.col("idx") % n == 0
    rows = of(e, "kill").select("idx", "t_s", flag(2).alias("third_partied"), flag(3).alias("knocked_first"), F.when(F.col("idx") % 5 < 4, flag(5)).alias("alone"), (F.col("x") / 100).alias("nearest_m"), flag(7).alias("in_vehicle"), flag(11).alias("killer_is_bot"))
    return reviews.death_tags(rows).select("idx", F.array_join("tags", "; ").alias("tags"), "replay_from_s")


_MET = """met AS (SELECT match_id, account_id, max(CAST(damage_dealt AS DOUBLE)) AS rotate_lag_s, max(kills) AS hot_drop_n FROM res GROUP BY 1, 2),
who AS (SELECT match_id, account_id, min(win_place) AS win_place, min(team_id) AS team_id, bool_or(tracked) AS tracked FROM res GROUP BY 1, 2)"""


def _metrics(r):
    met = r.groupBy(*M).agg(F.max(F.col("damage_dealt").cast("double")).alias("rotate_lag_s"), F.max("kills").alias("hot_drop_n"))
    return met, r.groupBy(*M).agg(F.min("win_place").alias("win_place"), F.min("team_id").alias("team_id"), F.bool_or("tracked").alias("tracked"))


@over(results_by_player, f"{R}, {_MET} SELECT match_id, account_id, rotate_lag_s, hot_drop_n, win_place FROM met JOIN who USING (match_id, account_id) WHERE tracked")
def g28_strategy_rows(r):
    return reviews.strategy_rows(*_metrics(r), "tracked", True).select(*M, "rotate_lag_s", "hot_drop_n", "win_place")


@over(results_by_player, f"""{R}, {_MET} SELECT match_id, team_id % 2 AS team_id, count(DISTINCT account_id) AS n_players,
string_agg(account_id || ':' || CAST(hot_drop_n AS VARCHAR), ',' ORDER BY account_id) AS players, sum(hot_drop_n) / count(hot_drop_n) AS squad_mean FROM met JOIN
who USING (match_id, account_id) WHERE tracked GROUP BY 1, 2 HAVING n_players >= 2""")
def g29_squad_strategy(r):
    rows = reviews.strategy_rows(*_metrics(r)).withColumn("team_id", F.col("team_id") % 2)
    named = F.transform("players", lambda p: F.concat_ws(":", p["account_id"].cast("string"), p["hot_drop_n"].cast("string")))
    return reviews.squad_strategy(rows, "hot_drop_n").withColumn("players", F.array_join(named, ","))


def _zone(r):
    return r.select("match_id", F.col("team_id").alias("phase"), F.col("tracked").alias("is_squad"), "is_bot", "win_place", (F.col("kills") % 5 > 0).alias("alive_at_close"), F.when(F.col("assists") > 0, F.col("kills") % 2 == 0).alias("in_at_announce"), F.when(F.col("kills") > 5, F.col("assists") % 2 == 0).alias("in_at_close"), F.col("damage_dealt").cast("double").alias("edge_cm"))


@over(results, f"""{R} SELECT team_id AS phase, tracked AS is_squad, count(*) FILTER (assists > 0 AND kills % 2 = 0) AS announce_in, count(*) FILTER (assists > 0)
AS announce_n, count(*) FILTER (kills > 5 AND assists % 2 = 0) AS close_in, count(*) FILTER (kills > 5) AS close_n, quantile_cont(CAST(damage_dealt AS DOUBLE), 0.5)
/ 100 AS median_edge_m FROM res WHERE kills % 5 > 0 AND (tracked OR (NOT is_bot AND win_place <= 5)) GROUP BY 1, 2""")
def g31_zone_play_summary(r):
    return reviews.zone_play_summary(_zone(r), 5)


@over(results, f"""{R} SELECT match_id, account_id, team_id AS phase, count(*) AS n, max(max_phase) AS max_phase FROM (SELECT *, max(team_id) OVER (PARTITION BY match_id)
AS max_phase FROM res) WHERE tracked GROUP BY 1, 2, 3""")
def g32_match_zone_play(r):
    rows = reviews.match_zone_play(r.withColumn("phase", F.col("team_id")), F.col("tracked"))
    return rows.groupBy(*M, "phase").agg(F.count("*").alias("n"), F.max("max_phase").alias("max_phase"))


#: What the measures are taken from, by the same rule in Spark and SQL.
_MEASURED = {
    "blue_s": "CAST(kills * 3 AS DOUBLE)",
    "blue_damage": "CAST(damage_dealt AS DOUBLE)",
    "rotate_lag_s": "CASE WHEN assists > 0 THEN CAST(kills + 1 AS DOUBLE) END",
    "teammate_dist_avg_cm": "CASE WHEN assists > 1 THEN CAST(kills * 50 AS DOUBLE) END",
    "teammate_near_pct": "CASE WHEN assists > 1 THEN CAST(kills / 64.0 AS DOUBLE) END",
    "hot_drop_n": "kills % 4",
    "first_engage_s": "CASE WHEN kills % 3 > 0 THEN CAST(kills * 9 AS DOUBLE) END",
    "dmg_dealt_early": "CAST(kills % 6 AS DOUBLE)",
    "first_weapon_s": "CASE WHEN kills % 5 > 0 THEN CAST(kills % 50 AS DOUBLE) END",
    "early_pickups_n": "kills % 11",
    "ride_distance": "CAST(assists * 100 AS DOUBLE)",
}
_WANTED = {
    "blue": "CASE WHEN survived_s > 0 THEN blue_s / survived_s * 100 END", "blue_damage": "blue_damage", "rotate": "rotate_lag_s", "mate_distance": "teammate_dist_avg_cm / 100", "mate_near": "teammate_near_pct * 100",
    "hot_drop": "hot_drop_n", "first_fight": "first_engage_s", "early_damage": "dmg_dealt_early", "first_weapon": "first_weapon_s", "pickups": "early_pickups_n", "ride": "ride_distance",
}


@over(results, f"""{R}, ms AS (SELECT account_id, survived_s, {', '.join(f'{x} AS {c}' for c, x in _MEASURED.items())} FROM res)
SELECT account_id, {', '.join(f'round(avg({x}), 4) AS {c}, count({x}) AS n_{c}' for c, x in _WANTED.items())} FROM ms GROUP BY 1""")
def g34_behaviour(r):
    found = reviews.behaviour(r.select("match_id", "account_id", "survived_s", *[F.expr(x).alias(c) for c, x in _MEASURED.items()]))
    return found.groupBy("account_id").agg(*[f for c in reviews.BEHAVIOUR for f in (F.round(F.avg(c), 4).alias(c), F.count(c).alias(f"n_{c}"))])


@over(events, f"""{W}, d AS (SELECT account_id, max(t_s) AS landed FROM landings GROUP BY 1), a AS (SELECT DISTINCT account_id FROM ev) SELECT account_id, landed FROM
a LEFT JOIN d USING (account_id) ORDER BY landed DESC NULLS LAST, account_id""")
def g41_sort_rows(e):
    landed = of(e, "landing").groupBy("account_id").agg(F.max("t_s").alias("landed"))
    return reviews.sort_rows(e.select("account_id").distinct().join(landed, "account_id", "left"), "landed", True)


def _matches(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderstatus")
    key = F.col("o_orderkey")
    return o.select(key.alias("match_id"), F.col("o_orderdate").cast("timestamp").alias("played_at"), F.when(key % 3 > 0, key).alias("telemetry_key"), F.when(F.col("o_orderstatus") != "P", key).alias("parsed_at"), (key % 4).alias("parser_version"))


@over(_matches, """SELECT o_orderkey AS match_id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 10 DAY ORDER BY o_orderdate,
o_orderkey LIMIT 5""")
def h3_at_risk(m):
    return reviews.at_risk(m, F.lit("1998-01-01").cast("timestamp")).select("match_id")


@over(_matches, """SELECT o_orderkey AS match_id FROM orders WHERE o_orderkey % 3 > 0 AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 90 DAY AND
o_orderstatus <> 'P' AND o_orderkey % 4 = 3""")
def h4_prune_candidates(m):
    return reviews.prune_candidates(m, F.lit("1998-01-01").cast("timestamp"), 90, 3).select("match_id")


@over(events, f"""WITH {EV}, v AS (SELECT kind, json_extract_string(props, '$.k') AS v FROM ev WHERE json_extract_string(props, '$.k') IS NOT NULL) SELECT kind,
'k' AS path, count(*) AS n, count(DISTINCT v) AS n_values FROM v GROUP BY kind""")
def h7_profile_schema(e):
    return profile_schema(e.select("kind", F.try_parse_json("props").alias("ev")), shared_folder(e.sparkSession)).select("kind", "path", "n", "n_values")


# --- streams, run over all that the table holds


def _stream(spark, sf):
    """The events table as a stream; a pattern, as a single file can't be one by its name."""
    known = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(known).parquet(f"{sf}/events.parquet*")


def _scratch(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


_OVER = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@over(_stream, f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g), a AS (SELECT user_id, session, min(ts) AS started,
max(ts) AS ended, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, epoch_us(started) AS started, epoch_us(ended) AS ended, n FROM
a WHERE ended + INTERVAL 3 HOUR <= {_OVER}""")
def s4_live_sessions(rows):
    live = jobs.live_sessions(rows.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", "3 hours", "1 hour")
    out = jobs.drained(live, _scratch(rows.sparkSession))
    return out.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n")


def _blows(rows):
    """The stream's blows and kills between teams, in whole seconds as in the view."""
    victim, team = (F.col("user_id") + 1 + F.col("event_id") % 7), F.col("user_id") % 4
    kind = F.expr("CASE event_type WHEN 'click' THEN 'hit' WHEN 'error' THEN 'knock' ELSE 'kill' END")
    both = rows.where("event_type in ('click', 'error', 'purchase')").where(team != victim % 4)
    return both.select(
        F.col("ts").cast("date").cast("string").alias("match_id"), F.least(team, victim % 4).alias("team_a"), F.greatest(team, victim % 4).alias("team_b"), kind.alias("kind"),
        F.col("event_id").alias("idx"), victim.alias("victim_id"), F.col("value").cast("decimal(18, 2)").alias("damage"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"),
    )


_SEGMENTS, _ATTACHED = (x.replace(str(timeline.GAP), "1200") for x in (timeline._SEG, timeline._ATT))


@over(_stream, f"""{W}, {_SEGMENTS}, {_ATTACHED}, wm AS (SELECT max(epoch(CAST(match_id AS DATE)) + t_s) - 3600 AS now FROM ev WHERE kind IN ('hit', 'knock', 'kill') AND team_id <> victim_team)
SELECT match_id, team_a, team_b, 'fight' AS event, segment, NULL AS idx, NULL AS rule, min(t_s) AS began, max(t_s) AS ended, count(*) FILTER (kind = 'hit') AS hits, count(*) FILTER (kind = 'knock') AS knocks,
  CAST(coalesce(sum(damage) FILTER (kind = 'hit'), 0) AS DOUBLE) AS damage FROM seg, wm GROUP BY 1, 2, 3, 5, now HAVING epoch(CAST(match_id AS DATE)) + max(t_s) + 1200 < now
UNION ALL SELECT k.match_id, k.team_a, k.team_b, 'kill', a.segment, k.idx, a.rule, NULL, NULL, NULL, NULL, NULL FROM xk k CROSS JOIN wm LEFT JOIN att a USING (idx) WHERE epoch(CAST(k.match_id AS DATE)) + k.t_s + 1200 < now""")
def s5_live_segments(rows):
    spark = rows.sparkSession
    with jobs.state_in_rocksdb(spark):
        found = jobs.drained(fights.live_fights(_blows(rows), "ts", 1200, "1 hour", 0.0), _scratch(spark))
    of_day = lambda c: (F.floor(F.col(c) / 1_000_000) % 86_400).alias(c)
    return found.select("match_id", "team_a", "team_b", "event", "segment", "idx", "rule", of_day("began"), of_day("ended"), "hits", "knocks", F.round("damage", 2).alias("damage"))


@over(_stream, """WITH c AS (SELECT event_type AS kind, event_id AS idx, epoch_us(ts) AS t_s, event_id % 3 = 0 AS ok FROM events), r AS (SELECT *, count(*) FILTER (ok)
OVER (PARTITION BY kind ORDER BY t_s, idx ROWS UNBOUNDED PRECEDING) AS run FROM c), a AS (SELECT kind, run, count(*) AS n, bool_or(NOT ok) AS any FROM
r WHERE NOT ok GROUP BY 1, 2), x AS (SELECT kind, max(run) AS top FROM r GROUP BY 1) SELECT a.kind, CAST(count(*) AS BIGINT) AS opened, CAST(sum(n) - count(*) AS BIGINT)
AS refreshed, count(*) FILTER (a.run < x.top) AS resolved FROM a JOIN x USING (kind) GROUP BY 1""")
def s6_live_alerts(rows):
    spark, out = rows.sparkSession, _scratch(rows.sparkSession)
    checks = rows.select(F.col("event_type").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_s"), F.col("event_id").alias("idx"), (F.col("event_id") % 3 == 0).alias("ok"))
    jobs.live_alerts(checks, out, f"{out}-state").awaitTermination()
    n = lambda e: F.count_if(F.col("event") == e)
    return spark.read.schema(jobs.ALERT).parquet(f"{out}/events").groupBy("kind").agg(n("open").alias("opened"), n("refresh").alias("refreshed"), n("resolve").alias("resolved"))


@over(_stream, f"WITH {EV} SELECT team_id, kind, count(*) AS n FROM ev GROUP BY 1, 2")
def s3_stream_bins(rows):
    """Per match first, so that of one that arrives again only what changes is added."""
    spark, out = rows.sparkSession, _scratch(rows.sparkSession)
    view = rows.selectExpr("CAST(CAST(ts AS DATE) AS STRING) AS match_id", "CAST(ts AS DATE) AS match_day", "CAST(user_id % 4 AS INT) AS team_id", "CASE event_type WHEN 'click' THEN 'hit' WHEN 'error' THEN 'knock' WHEN 'purchase' THEN 'kill' WHEN 'view' THEN 'position' ELSE 'landing' END AS kind")
    jobs.stream_bins(view, lambda e: e.groupBy("match_id", "team_id", "kind").agg(F.count("*").alias("n")), ["team_id", "kind"], out, f"{out}-state").awaitTermination()
    return jobs.total_bins(spark, out, ["team_id", "kind"])
