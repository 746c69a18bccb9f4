"""Driver queries over participants' results and the event view, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlake.functions import norm
from matchlake.operators import careers, findings, tracks
from matchlake.plans.timeline import _ATT, _ENG, _SEG, W, engagements, of
from matchlake.plans.view import DEATHS, EV, RES, ROSTER, events, results

Q: dict = {}
SQL: dict = {}
R = f"WITH {RES}"


def over(table, sql: str | None):
    def add(f):
        Q[f.__name__] = lambda spark, sf: f(table(spark, sf))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def order_rows(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet")


def customers(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet")




@over(results, f"{R} SELECT account_id, tracked, count(*) AS matches, CAST(max(played_on) AS STRING) AS last_seen FROM res GROUP BY 1, 2")
def g1_player_cards(r):
    return careers.player_cards(r).withColumn("last_seen", F.col("last_seen").cast("string"))


#: Columns of results that the tables don't have, by the same rule in Spark and SQL.
MORE = {
    "kills_human": "CASE WHEN match_id % 5 > 0 THEN kills - kills % 3 END",
    "knocks": "kills % 7",
    "knocks_human": "CASE WHEN match_id % 5 > 0 THEN kills % 6 END",
    "headshot_kills": "kills % 4",
    "revives": "match_id % 3",
    "walk_m": "survived_s * 2",
    "ride_m": "survived_s % 900",
    "shots_fired": "CASE WHEN match_id % 4 > 0 THEN kills * 9 END",
    "shots_hit": "CASE WHEN match_id % 4 > 0 THEN kills * 2 END",
    "road_kills": "kills % 2",
    "vehicle_destroys": "match_id % 2",
    "team_kills": "account_id % 2",
    "longest_kill": "CAST(survived_s % 500 AS DOUBLE)",
    "place": "win_place * 5 - 4",
    "killer_id": "CASE WHEN win_place > 1 THEN (match_id + win_place) % 12 + 1 END",
    "death_type": "CASE match_id % 6 WHEN 0 THEN 'byZone' WHEN 1 THEN NULL ELSE 'byPlayer' END",
}
WIDE = f"{R}, wide AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in MORE.items())} FROM res)"


def wide(spark, sf):
    return results(spark, sf).withColumns({c: F.expr(x) for c, x in MORE.items()})


@over(wide, f"""{WIDE}, g AS (SELECT account_id, count(*) AS matches, count(*) FILTER (place = 1) AS wins, count(*) FILTER (place <= 10) AS top10,
CAST(sum(place) AS DOUBLE) / count(*) AS avg_place, min(place) AS best_place, max(longest_kill) AS longest_kill, CAST(sum(kills) AS BIGINT) AS kills, CAST(sum(coalesce(kills_human, kills)) AS BIGINT) AS kills_human,
CAST(sum(knocks) AS BIGINT) AS knocks, CAST(coalesce(sum(knocks_human), 0) AS BIGINT) AS knocks_human, CAST(sum(assists) AS BIGINT) AS assists, CAST(sum(headshot_kills) AS BIGINT) AS headshot_kills,
CAST(sum(revives) AS BIGINT) AS revives, CAST(sum(damage_dealt) AS DOUBLE) AS damage_dealt, CAST(sum(survived_s) AS BIGINT) AS survived_s, CAST(sum(walk_m) AS BIGINT) AS walk_m, CAST(sum(ride_m) AS BIGINT) AS ride_m,
CAST(coalesce(sum(shots_fired), 0) AS BIGINT) AS shots_fired, CAST(coalesce(sum(shots_hit), 0) AS BIGINT) AS shots_hit, CAST(sum(road_kills) AS BIGINT) AS road_kills, CAST(sum(vehicle_destroys) AS BIGINT) AS vehicle_destroys,
CAST(sum(team_kills) AS BIGINT) AS team_kills FROM wide WHERE match_type IN ('F') AND map_name = 'map1' GROUP BY 1)
SELECT *, damage_dealt / matches AS avg_damage, survived_s / matches AS avg_survived_s, kills / matches AS kd, kills_human / matches AS kd_human, wins / matches AS win_rate,
coalesce(shots_hit / nullif(shots_fired, 0), 0) AS accuracy, coalesce(headshot_kills / nullif(kills, 0), 0) AS headshot_rate FROM g""")
def g2_career_stats(r):
    scope = norm.match_scope(map_name="map1")
    stats = careers.career_stats(r.drop("win_place").withColumnRenamed("place", "win_place").where(norm.career_filter(F.col("match_type"), ("F",))).where(scope[0]))
    return stats.withColumn("damage_dealt", F.col("damage_dealt").cast("double"))


def _newest(spark, sf):
    names = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("account_id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 4 == 0).alias("is_bot"))
    return careers.player_matches(wide(spark, sf), names, 5, F.struct(F.lit("1997-01-01").cast("date"), F.lit(0).cast("bigint")))


@over(_newest, f"""{WIDE}, w AS (SELECT match_id, team_id, min(win_place) = 1 AS roster_won FROM wide GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY played_on DESC, match_id DESC, team_id, kills, damage_dealt) AS pos FROM wide WHERE played_on < DATE '1997-01-01' OR played_on = DATE '1997-01-01' AND match_id < 0 QUALIFY pos <= 5)
SELECT p.account_id, p.match_id, p.pos, p.win_place, p.kills, p.kills_human, roster_won, s_name AS killed_by, s_suppkey % 4 = 0 AS killed_by_is_bot FROM p JOIN w USING (match_id, team_id) LEFT JOIN supplier ON s_suppkey = killer_id""")
def g3_player_matches(r):
    return r.select("account_id", "match_id", "pos", "win_place", "kills", "kills_human", "roster_won", "killed_by", "killed_by_is_bot")


def _weapons(e):
    named = e.withColumn("weapon", F.concat(F.lit("w"), (F.col("idx") % 3).cast("string")))
    shots = of(named, "hit").withColumn("shots", F.lit(3)).withColumn("landed", (F.col("idx") % 4 == 0).cast("int"))
    return careers.weapon_table(of(named, "kill").withColumn("distance", F.floor("distance")), shots)


_WT = f"""{W}, k AS (SELECT account_id, 'w' || CAST(idx % 3 AS STRING) AS weapon, count(*) AS kills, CAST(max(floor(distance)) AS BIGINT) AS longest,
CAST(sum(floor(distance)) FILTER (floor(distance) > 0) AS DOUBLE) / count(*) FILTER (floor(distance) > 0) AS mean_distance FROM kills GROUP BY 1, 2),
s AS (SELECT account_id, 'w' || CAST(idx % 3 AS STRING) AS weapon, 3 * count(*) AS shots, count(*) FILTER (idx % 4 = 0) AS landed FROM hits GROUP BY 1, 2),
wt AS (SELECT account_id, weapon, coalesce(kills, 0) AS kills, longest, CASE WHEN isfinite(mean_distance) THEN mean_distance END AS mean_distance, coalesce(shots, 0)
AS shots, coalesce(landed, 0) AS landed, coalesce(landed, 0) / nullif(coalesce(shots, 0), 0) AS accuracy FROM k FULL JOIN s USING (account_id, weapon))"""


@over(events, f"{_WT} SELECT * FROM wt")
def g4_weapon_table(e):
    return _weapons(e)


@over(wide, f"""{WIDE} SELECT account_id, count(*) FILTER (place = 1) AS n_0, count(*) FILTER (place >= 2 AND place <= 5) AS n_1, count(*) FILTER (place >= 6 AND place <= 10) AS n_2,
count(*) FILTER (place >= 11 AND place <= 25) AS n_3, count(*) FILTER (place >= 26) AS n_4, count(*) AS total FROM wide GROUP BY 1""")
def g5_placement_histogram(r):
    return careers.histogram(r, "account_id", F.col("place"), careers.PLACES)


@over(events, f"""{W}, k AS (SELECT * FROM kills WHERE account_id <> victim_id), a AS (SELECT account_id, victim_id AS opponent, count(*) AS killed, max(match_id) AS l1 FROM k WHERE victim_id % 10 <> 0 GROUP BY 1, 2),
b AS (SELECT victim_id AS account_id, account_id AS opponent, count(*) AS killed_by, max(match_id) AS l2 FROM k WHERE account_id % 10 <> 0 GROUP BY 1, 2),
j AS (SELECT account_id, opponent, coalesce(killed, 0) AS killed, coalesce(killed_by, 0) AS killed_by, greatest(l1, l2) AS last_seen FROM a FULL JOIN b USING (account_id, opponent))
SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY killed_by DESC, killed DESC, opponent) <= 3""")
def g6_nemeses(e):
    bots = {"victim_is_bot": F.col("victim_id") % 10 == 0, "killer_is_bot": F.col("account_id") % 10 == 0}
    return careers.nemeses(of(e, "kill").withColumns(bots), 3)


@over(results, f"{R} SELECT account_id, arg_max(map_name, match_id * 10 + team_id) AS map_name FROM res GROUP BY 1")
def g7_latest_names(r):
    return careers.latest(r, "account_id", "map_name", F.col("match_id") * 10 + F.col("team_id"))


@over(wide, f"""{WIDE} SELECT account_id, CAST(played_on AS STRING) AS played_on, count(*) AS matches, CAST(sum(kills) AS DOUBLE) AS kills, CAST(sum(damage_dealt) AS DOUBLE) AS damage,
CAST(sum(survived_s) AS DOUBLE) AS survived_s, CAST(sum(win_place) AS DOUBLE) / count(*) AS win_place, CAST(sum(kills) AS DOUBLE) / count(*) AS kd, coalesce(CAST(sum(shots_hit) AS DOUBLE) / nullif(sum(shots_fired), 0), 0) AS accuracy
FROM wide WHERE played_on >= DATE '1993-01-01' GROUP BY 1, 2""")
def g8_timeseries(r):
    return careers.timeseries(r, F.lit("1993-01-01").cast("date")).withColumn("played_on", F.col("played_on").cast("string"))


_SES = """o AS (SELECT o_custkey AS account_id, datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS t, o_orderkey AS idx, o_orderkey % 9 + 1 AS win_place, o_orderkey % 5 AS kills FROM orders),
f AS (SELECT *, sum(CASE WHEN d > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY t, idx ROWS UNBOUNDED PRECEDING) AS seg FROM (SELECT *, t - lag(t) OVER (PARTITION BY account_id ORDER BY t, idx) AS d FROM o)),
s AS (SELECT account_id, seg, count(*) AS n, min(t) AS began, max(t) AS ended, min(win_place) AS best_place, count(*) FILTER (win_place = 1) AS wins, CAST(sum(kills) AS BIGINT) AS kills FROM f GROUP BY 1, 2),
ses AS (SELECT account_id, n, began, ended, best_place, wins, kills, row_number() OVER (PARTITION BY account_id ORDER BY seg DESC) - 1 AS session FROM s)"""


def _played(o):
    t = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    key = F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("account_id"), t.alias("t"), key.alias("idx"), (key % 9 + 1).alias("win_place"), (key % 5).alias("kills"), F.when(key % 6 > 0, key % 7).alias("lasted"))


@over(order_rows, f"WITH {_SES} SELECT * FROM ses")
def g9_sessions(o):
    return careers.sessions(_played(o), ["account_id"], "t", 120, ["idx"])


def _evenings(spark, sf):
    """Tracked participants; a match is played at an hour of its day that its id gives."""
    played = F.col("played_on").cast("timestamp") + F.make_dt_interval(hours=F.col("match_id") % 24, mins=F.col("match_id") % 60)
    rows = wide(spark, sf).where("tracked").where(norm.career_filter(F.col("match_type"), ("F",)))
    return rows.select("match_id", played.alias("played_at"), F.col("place").alias("win_place"), "kills", "kills_human", F.when(F.col("death_type").isNotNull(), F.col("survived_s")).alias("death_t"), "damage_dealt")


@over(_evenings, f"""{WIDE}, p AS (SELECT match_id, CAST(played_on AS TIMESTAMP) + to_hours(match_id % 24) + to_minutes(match_id % 60) AS played_at, min(place) AS place, sum(coalesce(kills_human, kills)) AS kills, count(death_type) AS deaths,
  sum(CAST(damage_dealt AS DOUBLE)) AS damage FROM wide WHERE tracked AND match_type = 'F' GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN played_at - lag(played_at) OVER (ORDER BY played_at, match_id) > INTERVAL 3 HOUR THEN 1 ELSE 0 END AS new FROM p),
s AS (SELECT *, sum(new) OVER (ORDER BY played_at, match_id ROWS UNBOUNDED PRECEDING) AS seg FROM c)
SELECT CAST(max(seg) OVER () - seg AS BIGINT) AS evening, * EXCLUDE (seg) FROM (SELECT seg, CAST(epoch_us(min(played_at)) AS BIGINT) AS started, CAST(epoch_us(max(played_at)) AS BIGINT) AS ended, count(*) AS matches, min(place) AS best_place,
  count(*) FILTER (place = 1) AS wins, count(*) FILTER (place BETWEEN 1 AND 10) AS top10, CAST(sum(kills) AS BIGINT) AS kills, CAST(sum(deaths) AS BIGINT) AS deaths, round(sum(damage), 2) AS damage,
  list(place ORDER BY played_at DESC, match_id DESC) AS places FROM s GROUP BY seg)""")
def g10_squad_sessions(r):
    out = careers.squad_sessions(r)
    return out.withColumns({"started": F.unix_micros("started"), "ended": F.unix_micros("ended"), "damage": F.round("damage", 2)})


@over(order_rows, f"""WITH {_SES}, e AS (SELECT account_id, arg_max(coalesce(CASE WHEN idx % 6 > 0 THEN idx % 7 END, 0), t * 100000000 + idx) AS lasted FROM o GROUP BY 1)
SELECT account_id, n, began, ended, best_place, wins, kills, ended - began + lasted AS span FROM ses JOIN e USING (account_id) WHERE session = 0""")
def g11_current_session(o):
    return careers.current_session(_played(o), ["account_id"], "t", 120, ["idx"], "lasted")


@over(results, f"""{R} SELECT account_id, pos, kills FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY played_on DESC, match_id DESC, win_place, kills,
damage_dealt) AS pos FROM res) WHERE pos <= 10""")
def g12_form(r):
    order = [F.col("played_on").desc(), F.col("match_id").desc(), F.col("win_place"), F.col("kills"), F.col("damage_dealt")]
    return careers.recent(r, "account_id", order, 10).select("account_id", "pos", "kills")


_SPANS = {"career": "true", "now": "played_on > DATE '1998-01-01' - 365 AND played_on <= DATE '1998-01-01'", "before": "played_on > DATE '1998-01-01' - 730 AND played_on <= DATE '1998-01-01' - 365"}
_MEASURES = ("kills", "damage_dealt", "survived_s")
_OVER = ", ".join(
    f"count(*) FILTER ({w}) AS n_{s}, count(*) FILTER (({w}) AND win_place = 1) AS wins_{s}, " + ", ".join(f"CAST(sum({m}) FILTER ({w}) AS DOUBLE) / nullif(count(*) FILTER ({w}), 0) AS {m}_{s}" for m in _MEASURES)
    for s, w in _SPANS.items()
)


@over(results, f"""{R}, g AS (SELECT account_id, CAST(max(played_on) AS STRING) AS last_seen, {_OVER} FROM res WHERE tracked GROUP BY 1) SELECT *,
{', '.join(f'{m}_now - {m}_before AS {m}_change' for m in _MEASURES)} FROM g""")
def g13_overview(r):
    return careers.overview(r.where("tracked"), F.lit("1998-01-01").cast("date"), 365).withColumn("last_seen", F.col("last_seen").cast("string"))


@over(results, f"""{R}, m AS (SELECT DISTINCT match_id, played_on FROM res), page AS (SELECT * FROM m WHERE EXISTS (SELECT 1 FROM res r WHERE r.match_id = m.match_id AND
tracked) ORDER BY played_on DESC, match_id DESC LIMIT 20) SELECT p.match_id, CAST(p.played_on AS STRING) AS played_on, list_sort(list(r.account_id)) AS accounts FROM
page p JOIN res r ON r.match_id = p.match_id AND r.tracked GROUP BY 1, 2""")
def g14_match_feed(r):
    return careers.match_feed(r.select("match_id", "played_on").distinct(), r, F.col("tracked"), 20).withColumn("played_on", F.col("played_on").cast("string"))


@over(results, f"""{R}, m AS (SELECT *, row_number() OVER (PARTITION BY match_id, team_id ORDER BY kills DESC, account_id, assists, damage_dealt, survived_s) AS pos FROM res)
SELECT match_id, team_id, min(win_place) AS rank, CAST(sum(kills) AS BIGINT) AS team_kills, min(win_place) = 1 AS won,
list(concat_ws('/', account_id, kills, assists, survived_s, is_bot, tracked) ORDER BY pos) AS participants FROM m GROUP BY 1, 2""")
def g15_scoreboard(r):
    shown = ("account_id", "kills", "assists", "survived_s", "is_bot", "tracked")
    return careers.scoreboard(r).withColumn("participants", F.transform("participants", lambda m: F.concat_ws("/", *[m[c].cast("string") for c in shown])))


_NAME = "CASE WHEN {0} % 7 > 0 THEN 'p' || CAST({0} AS STRING) END"


@over(events, f"""{W}, r AS (SELECT match_id, account_id FROM ev GROUP BY 1, 2), n AS (SELECT match_id, account_id, 'p' || CAST(account_id AS STRING) AS name FROM r WHERE account_id % 7 > 0),
k AS (SELECT *, CASE WHEN idx % 3 > 0 THEN account_id END AS maker_id, CASE WHEN idx % 4 > 0 THEN victim_id END AS finisher_id, CASE WHEN idx % 2 = 0 THEN [account_id, victim_id] ELSE [] END AS assists FROM kills WHERE victim_id % 10 <> 0),
h AS (SELECT match_id, idx, list(coalesce(name, CAST(a AS STRING)) ORDER BY pos) AS helpers FROM (SELECT match_id, idx, unnest(assists) AS a, generate_subscripts(assists, 1) AS pos FROM k) LEFT JOIN (SELECT match_id, account_id AS a, name FROM n) USING (match_id, a) GROUP BY 1, 2)
SELECT k.match_id, k.idx, row_number() OVER (PARTITION BY k.match_id ORDER BY k.idx) - 1 AS seq, a.name AS killer, v.name AS victim, m.name AS maker, f.name AS finisher, coalesce(helpers, []) AS helpers, CASE WHEN distance - 5 > 0 THEN (distance - 5) / 100 END AS distance_m
FROM k LEFT JOIN n a ON a.match_id = k.match_id AND a.account_id = k.account_id LEFT JOIN n v ON v.match_id = k.match_id AND v.account_id = k.victim_id LEFT JOIN n m ON m.match_id = k.match_id AND m.account_id = k.maker_id
LEFT JOIN n f ON f.match_id = k.match_id AND f.account_id = k.finisher_id LEFT JOIN h ON h.match_id = k.match_id AND h.idx = k.idx""")
def g16_kill_feed(e):
    names = e.select("match_id", "account_id").distinct().where("account_id % 7 > 0").withColumn("name", F.concat(F.lit("p"), F.col("account_id").cast("string")))
    more = {
        "maker_id": F.when(F.col("idx") % 3 > 0, F.col("account_id")),
        "finisher_id": F.when(F.col("idx") % 4 > 0, F.col("victim_id")),
        "assists": F.when(F.col("idx") % 2 == 0, F.array("account_id", "victim_id")).otherwise(F.array().cast("array<bigint>")),
        "victim_is_bot": F.col("victim_id") % 10 == 0,
        "distance": F.col("distance") - 5,
    }
    return careers.kill_feed(of(e, "kill").withColumns(more), names, include_bots=False)


@over(events, f"""{W} SELECT k.victim_team, count(*) AS deaths, count(*) FILTER (EXISTS (SELECT 1 FROM kills o WHERE o.match_id = k.match_id AND o.idx <> k.idx AND
o.team_id <> k.team_id AND o.team_id <> k.victim_team AND o.t_s <= k.t_s AND k.t_s - o.t_s <= 1800 AND sqrt((o.x-k.x)*(o.x-k.x)+(o.y-k.y)*(o.y-k.y)) <= 200000))
AS third_party FROM kills k GROUP BY 1""")
def g17_third_party(e):
    return careers.third_party_deaths(of(e, "kill"), 200_000, 1800)


@over(events, f"""{W}, n AS (SELECT DISTINCT match_id, victim_id FROM knocks) SELECT k.victim_id AS account_id, count(*) AS deaths, count(n.victim_id) AS knocked_first,
count(*) - count(n.victim_id) AS outright, count(*) FILTER (t_s < 21600) AS early, count(*) FILTER (k.account_id % 10 = 0) AS to_bot FROM kills k LEFT JOIN
n ON n.match_id = k.match_id AND n.victim_id = k.victim_id GROUP BY 1""")
def g18_death_causes(e):
    return careers.death_causes(of(e, "kill"), of(e, "knock"))


_CONV = """n AS (SELECT account_id, count(*) AS made FROM knocks WHERE victim_id % 10 <> 0 GROUP BY 1), mc AS (SELECT account_id, count(*) AS made_converted FROM kills WHERE victim_id % 10 <> 0 AND idx % 3 > 0 GROUP BY 1),
tk AS (SELECT victim_id AS account_id, count(*) AS taken FROM knocks GROUP BY 1), tc AS (SELECT victim_id AS account_id, count(*) AS taken_converted FROM kills WHERE idx % 3 > 0 GROUP BY 1),
conv AS (SELECT account_id, coalesce(made, 0) AS made, coalesce(made_converted, 0) AS made_converted, coalesce(taken, 0) AS taken, coalesce(taken_converted, 0) AS taken_converted FROM n FULL JOIN mc USING (account_id) FULL JOIN tk USING (account_id) FULL JOIN tc USING (account_id))"""


@over(events, f"{W}, {_CONV} SELECT *, made_converted / nullif(made, 0) AS made_rate, taken_converted / nullif(taken, 0) AS taken_rate FROM conv")
def g19_knock_conversion(e):
    made = e.withColumns({"victim_is_bot": F.col("victim_id") % 10 == 0, "maker_id": F.when(F.col("idx") % 3 > 0, F.col("account_id"))})
    return careers.knock_conversion(of(made, "knock"), of(made, "kill"))


@over(events, f"""{W}, {ROSTER}, {DEATHS}, r AS (SELECT match_id, account_id, death_t, count(*) OVER (PARTITION BY match_id) AS n, row_number()
OVER (PARTITION BY match_id ORDER BY death_t NULLS LAST, account_id) AS pos FROM roster LEFT JOIN deaths USING (match_id, account_id) WHERE account_id % 10 = 0) SELECT
account_id, count(*) AS first_deaths FROM r WHERE n >= 2 AND pos = 1 AND death_t IS NOT NULL GROUP BY 1""")
def g20_first_deaths(e):
    seen = e.where("account_id % 10 = 0").select("match_id", "account_id").distinct()
    return careers.first_deaths(seen.join(tracks.final_deaths(of(e, "kill")), ["match_id", "account_id"], "left"))


@over(events, f"""{W}, b AS (SELECT *, CASE WHEN distance / 10 < 10 THEN '0-10' WHEN distance / 10 < 50 THEN '10-50' WHEN distance / 10 < 100 THEN '50-100' WHEN distance / 10 < 200 THEN '100-200' ELSE '200+' END AS band FROM kills WHERE distance > 0)
SELECT band, count(account_id) FILTER (account_id % 10 = 0) AS we_killed, count(account_id) FILTER (victim_id % 10 = 0) AS we_died FROM (VALUES ('0-10'), ('10-50'), ('50-100'), ('100-200'), ('200+')) v(band) LEFT JOIN b USING (band) GROUP BY 1""")
def g21_range_bands(e):
    return careers.range_bands(of(e, "kill").withColumn("distance", F.col("distance") * 10), F.col("account_id") % 10 == 0, F.col("victim_id") % 10 == 0)


@over(wide, f"{WIDE} SELECT account_id, count(*) AS zone_deaths FROM wide WHERE lower(death_type) = 'byzone' GROUP BY 1")
def g22_zone_deaths(r):
    return careers.zone_deaths(r)


_LEG = f"""{W}, {_SEG}, {_ATT}, {_ENG}, legs AS (SELECT team_a AS team_id, kills_a AS ours, kills_b AS theirs, first_hit_team, first_hit_range FROM eng UNION ALL SELECT
team_b, kills_b, kills_a, first_hit_team, first_hit_range FROM eng)"""


@over(events, f"""{_LEG} SELECT team_id, count(*) AS fights, count(*) FILTER (ours > theirs) AS won, count(*) FILTER (ours < theirs) AS lost, count(*)
FILTER (ours = theirs) AS even, count(*) FILTER (first_hit_team = team_id) AS hit_first, count(*) FILTER (first_hit_team = team_id AND ours > theirs) AS hit_first_won,
count(*) FILTER (first_hit_team <> team_id AND ours > theirs) AS hit_second_won, count(*) FILTER (first_hit_team = team_id AND ours > theirs) / nullif(count(*)
FILTER (first_hit_team = team_id), 0) AS first_win_rate FROM legs GROUP BY 1""")
def g23_engagement_review(e):
    return careers.engagement_review(engagements(e))


@over(events, f"""{W}, {_SEG}, {_ATT}, {_ENG} SELECT team_a, count(*) FILTER (first_hit_range >= 0 AND first_hit_range / 100 < 25) AS n_0, count(*) FILTER (first_hit_range / 100 >= 25 AND first_hit_range / 100 < 75) AS n_1,
count(*) FILTER (first_hit_range / 100 >= 75 AND first_hit_range / 100 < 150) AS n_2, count(*) FILTER (first_hit_range / 100 >= 150) AS n_3, count(*) AS total FROM eng GROUP BY 1""")
def g24_engagement_bands(e):
    return careers.histogram(engagements(e), "team_a", F.col("first_hit_range") / 100, careers.FIGHT_RANGES, closed=False)


@over(results, f"{R} SELECT map_name, " + ", ".join(f"[round(quantile_cont({m}, 0.25), 4), round(quantile_cont({m}, 0.5), 4), round(quantile_cont({m}, 0.75), 4)] AS q_{m}, count({m}) AS n_{m}" for m in ("kills", "survived_s")) + " FROM res WHERE NOT is_bot AND NOT tracked GROUP BY 1")
def g30_strategy_baseline(r):
    out = careers.strategy_baseline(r.where("not is_bot and not tracked"), ["map_name"], ["kills", "survived_s"])
    return out.withColumns({c: F.transform(c, lambda x: F.round(x, 4)) for c in ("q_kills", "q_survived_s")})


@over(results, f"""{R}, r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY win_place) AS up, row_number()
OVER (PARTITION BY account_id ORDER BY win_place DESC) AS down, count(*) OVER (PARTITION BY account_id) AS cn FROM res), c AS (SELECT *, max(win_place)
FILTER (up = least(10, cn // 2)) OVER (PARTITION BY account_id) AS hi, max(win_place) FILTER (down = least(10, cn // 2)) OVER (PARTITION BY account_id) AS lo FROM r)
SELECT account_id, max(cn) AS n, CASE WHEN max(cn) >= 4 THEN CAST(sum(kills) FILTER (win_place <= hi) AS DOUBLE) / count(*) FILTER (win_place <= hi) END AS best, count(*)
FILTER (win_place <= hi) AS n_best, CASE WHEN max(cn) >= 4 THEN CAST(sum(kills) FILTER (win_place >= lo) AS DOUBLE) / count(*) FILTER (win_place >= lo) END AS worst,
count(*) FILTER (win_place >= lo) AS n_worst FROM c GROUP BY 1""")
def g33_contrast_by_placement(r):
    return careers.contrast_by_placement(r, "account_id", "kills")


@over(events, f"""{_WT} SELECT weapon, CAST(sum(kills) AS BIGINT) AS kills, max(longest) AS longest, round(sum(mean_distance * kills) / sum(kills)
FILTER (mean_distance IS NOT NULL), 6) AS mean_distance, CAST(sum(landed) AS DOUBLE) / sum(shots) AS accuracy FROM wt GROUP BY 1""")
def g35_merge_weapons(e):
    return careers.merged_weapons(_weapons(e)).withColumn("mean_distance", F.round("mean_distance", 6))


@over(events, f"""WITH {EV}, g AS (SELECT CAST(floor(t_s / 3600) AS INTEGER) AS phase, account_id % 10 = 0 AS s, idx % 3 = 0 AS i FROM ev), h AS (SELECT phase, count(*)
FILTER (s) AS n_squad, count(*) FILTER (s AND i) / nullif(count(*) FILTER (s), 0) AS pct_squad, count(*) FILTER (NOT s) AS n_lobby, count(*) FILTER (NOT s AND i)
/ nullif(count(*) FILTER (NOT s), 0) AS pct_lobby FROM g GROUP BY 1) SELECT *, pct_lobby - pct_squad AS gap FROM h WHERE n_squad >= 15 AND pct_lobby - pct_squad >= 0.01""")
def g36_circle_gaps(e):
    rows = e.select(F.floor(F.col("t_s") / 3600).cast("int").alias("phase"), (F.col("account_id") % 10 == 0).alias("is_squad"), (F.col("idx") % 3 == 0).alias("inside"))
    return careers.circle_gaps(rows, 0.01)


_BANDS = ", ".join(f"count(*) FILTER (idx % 5 = {i} AND account_id % 3 = 0) AS we_killed_{i}, count(*) FILTER (idx % 5 = {i} AND account_id % 3 > 0) AS we_died_{i}" for i in range(5))
_KEYED = f"""k AS (SELECT *, account_id % 30 AS squad FROM kills), f AS (SELECT squad, list({{'died_first': d, 'matches': m}}) AS first_deaths FROM (SELECT squad, account_id, count(*) FILTER (idx % 3 = 0) AS d, count(*) AS m FROM k GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT squad, count(*) FILTER (idx % 2 = 0) AS made, count(*) FILTER (idx % 6 = 0) AS made_converted, count(*) FILTER (idx % 2 > 0) AS taken, count(*) FILTER (idx % 10 = 1) AS taken_converted, count(*) AS deaths,
count(*) FILTER (idx % 7 < 2) AS third_partied, count(*) FILTER (idx % 2 = 0) AS knocked_first, count(*) FILTER (t_s < 30000) AS early, count(*) FILTER (victim_id % 50 = 0) AS to_bot, {_BANDS} FROM k GROUP BY 1)"""


def _tone(good: str, bad: str) -> str:
    return f"CASE WHEN {good} THEN 'good' WHEN {bad} THEN 'bad' ELSE 'neutral' END"


def _findings_sql(rows: str, key: str, found: list[tuple[str, str, str, str, str]]) -> str:
    parts = " UNION ALL ".join(f"SELECT {key}, '{i}' AS id, CAST({n} AS BIGINT) AS n, CAST({strength} AS DOUBLE) AS strength, {tone} AS tone FROM {rows} WHERE {when}" for i, n, strength, tone, when in found)
    return f"u AS ({parts}) SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY strength DESC, id) AS place FROM u WHERE n >= 8"


def _worst(bands: int) -> str:
    one = ", ".join(f"CASE WHEN we_killed_{i} + we_died_{i} >= 8 THEN {{'share': we_killed_{i} / (we_killed_{i} + we_died_{i}), 'band': {i}, 'n': we_killed_{i} + we_died_{i}}} END" for i in range(bands))
    return f"list_sort(list_filter([{one}], lambda x: x IS NOT NULL))[1]"


_MT, _TT = "(made_converted / nullif(made, 0))", "(taken_converted / nullif(taken, 0))"
_FD = "list_transform(list_filter(first_deaths, lambda x: x.matches >= 8), lambda x: x.died_first / x.matches)"
_SQUAD = [
    ("knock-conversion", "made + taken", f"CASE WHEN abs({_MT} - {_TT}) < 0.05 THEN 0.25 ELSE abs({_MT} - {_TT}) * 2 END", f"CASE WHEN abs({_MT} - {_TT}) < 0.05 THEN 'neutral' WHEN {_MT} > {_TT} THEN 'good' ELSE 'bad' END", f"{_MT} IS NOT NULL AND {_TT} IS NOT NULL"),
    ("knock-survival", "taken", f"abs({_TT} - 0.5) * 2 * 0.8", "'neutral'", f"{_TT} IS NOT NULL"),
    ("third-party", "deaths", "third_partied / deaths * 1.5", _tone("false", "third_partied / deaths > 0.25"), "deaths > 0"),
    ("knocked-first", "deaths", "0.4", "'neutral'", "deaths > 0"),
    ("early-deaths", "deaths", "early / deaths", _tone("false", "early / deaths > 0.35"), "deaths > 0"),
    ("no-bot-deaths", "deaths", "0.15", "'good'", "to_bot = 0"),
    ("first-death", "list_sum(list_transform(list_filter(first_deaths, lambda x: x.matches >= 8), lambda x: x.matches))", f"(list_max({_FD}) - list_min({_FD})) * 1.2", "'neutral'", f"len({_FD}) >= 2 AND list_max({_FD}) - list_min({_FD}) > 0.1"),
    ("worst-range", f"{_worst(5)}.n", f"(0.5 - {_worst(5)}.share) * 2", "'bad'", f"{_worst(5)}.share < 0.5"),
    ("busiest-range", "greatest(" + ", ".join(f"we_killed_{i} + we_died_{i}" for i in range(5)) + ")", "0.3", "'neutral'", "true"),
]


@over(events, f"{W}, {_KEYED}, r AS (SELECT * FROM w JOIN f USING (squad)), {_findings_sql('r', 'squad', _SQUAD)}")
def g37_squad_findings(e):
    k = of(e, "kill").withColumn("squad", F.col("account_id") % 30)
    c = lambda x: F.count_if(F.expr(x))
    names = {"made": "idx % 2 = 0", "made_converted": "idx % 6 = 0", "taken": "idx % 2 > 0", "taken_converted": "idx % 10 = 1", "third_partied": "idx % 7 < 2", "knocked_first": "idx % 2 = 0", "early": "t_s < 30000", "to_bot": "victim_id % 50 = 0"}
    bands = [c(f"idx % 5 = {i} and account_id % 3 {o} 0").alias(f"{a}_{i}") for i in range(5) for a, o in (("we_killed", "="), ("we_died", ">"))]
    rows = k.groupBy("squad").agg(F.count("*").alias("deaths"), *[c(x).alias(a) for a, x in names.items()], *bands)
    members = k.groupBy("squad", "account_id").agg(c("idx % 3 = 0").alias("died_first"), F.count("*").alias("matches"))
    first = members.groupBy("squad").agg(F.collect_list(F.struct("died_first", "matches")).alias("first_deaths"))
    return findings.squad_findings(rows.join(first, "squad"), "squad")


_FIGHT_BANDS = ", ".join(f"CAST(sum(kills_a) FILTER ({w}) AS BIGINT) AS we_killed_{i}, CAST(sum(kills_b) FILTER ({w}) AS BIGINT) AS we_died_{i}" for i, w in enumerate(("first_hit_range / 100 < 2000", "first_hit_range / 100 >= 2000 AND first_hit_range / 100 < 4000", "first_hit_range / 100 >= 4000 AND first_hit_range / 100 < 5000", "first_hit_range / 100 >= 5000")))
_FIRST, _LATER = "(ahead_first / nullif(first, 0))", "(ahead_not_first / nullif(not_first, 0))"
_SHARE, _OURS = "(first_ours / nullif(deadly, 0))", "(ours_only / nullif(ours_only + theirs_only, 0))"
_HURT = "list_sort(list_transform(list_filter(members, lambda m: m.fights >= 8), lambda m: {'d': m.damage_taken_avg, 'fights': m.fights}))"
_FIGHT = [
    ("first-hit-advantage", "first + not_first", f"abs({_FIRST} - {_LATER}) * 1.5", _tone(f"{_FIRST} > {_LATER}", "true"), f"abs({_FIRST} - {_LATER}) > 0.1"),
    ("first-hit-share", "deadly", f"abs({_SHARE} - 0.5) * 2", _tone(f"{_SHARE} > 0.55", f"{_SHARE} < 0.45"), f"{_SHARE} IS NOT NULL"),
    ("engagement-third-party", "fights", "third_partied / fights * 1.2", _tone("false", "third_partied / fights > 0.25"), "fights > 0"),
    ("one-sided-fights", "ours_only + theirs_only", f"abs({_OURS} - 0.5) * 2", _tone(f"{_OURS} > 0.55", f"{_OURS} < 0.45"), "ours_only + theirs_only >= 8"),
    ("undecided-fights", "fights", "0.2", "'neutral'", "fights >= 8 AND neither > 0"),
    ("engagement-worst-range", f"{_worst(4)}.n", f"(0.5 - {_worst(4)}.share) * 1.8", "'bad'", f"{_worst(4)}.share < 0.5"),
    ("damage-taken-spread", f"{_HURT}[-1].fights + {_HURT}[1].fights", f"least(1, {_HURT}[-1].d / greatest(1, {_HURT}[1].d) - 1)", "'neutral'", f"len({_HURT}) >= 2 AND {_HURT}[-1].d > {_HURT}[1].d * 1.25"),
]


@over(events, f"""{W}, {_SEG}, {_ATT}, {_ENG}, w AS (SELECT team_a AS squad, count(*) AS fights, count(*) FILTER (first_hit_team = team_a) AS first, count(*) FILTER (first_hit_team = team_a AND kills_a > kills_b) AS ahead_first,
count(*) FILTER (first_hit_team <> team_a) AS not_first, count(*) FILTER (first_hit_team <> team_a AND kills_a > kills_b) AS ahead_not_first, count(*) FILTER (kills_a + kills_b > 0) AS deadly, count(*) FILTER (kills_a + kills_b > 0 AND first_hit_team = team_a) AS first_ours,
count(*) FILTER (seq % 3 = 0) AS third_partied, count(*) FILTER (kills_a > 0 AND kills_b = 0) AS ours_only, count(*) FILTER (kills_a = 0 AND kills_b > 0) AS theirs_only, count(*) FILTER (kills_a + kills_b = 0) AS neither, {_FIGHT_BANDS} FROM eng GROUP BY 1),
m AS (SELECT squad, list({{'fights': n, 'damage_taken_avg': d}}) AS members FROM (SELECT team_a AS squad, team_b, count(*) AS n, CAST(sum(hits_b) AS DOUBLE) / count(*) AS d FROM eng GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT * FROM w JOIN m USING (squad)), {_findings_sql('r', 'squad', _FIGHT)}""")
def g37_engagement_findings(e):
    f = engagements(e).withColumnRenamed("team_a", "squad")
    c = lambda x: F.count_if(F.expr(x))
    ours = "first_hit_team = squad"
    names = {
        "first": ours, "ahead_first": f"{ours} and kills_a > kills_b", "not_first": "first_hit_team <> squad", "ahead_not_first": "first_hit_team <> squad and kills_a > kills_b",
        "deadly": "kills_a + kills_b > 0", "first_ours": f"kills_a + kills_b > 0 and {ours}", "third_partied": "seq % 3 = 0", "ours_only": "kills_a > 0 and kills_b = 0", "theirs_only": "kills_a = 0 and kills_b > 0", "neither": "kills_a + kills_b = 0",
    }
    m = F.col("first_hit_range") / 100
    inside = [m < 2000, (m >= 2000) & (m < 4000), (m >= 4000) & (m < 5000), m >= 5000]
    bands = [F.sum(F.when(w, F.col(s))).alias(f"{a}_{i}") for i, w in enumerate(inside) for a, s in (("we_killed", "kills_a"), ("we_died", "kills_b"))]
    rows = f.groupBy("squad").agg(F.count("*").alias("fights"), *[c(x).alias(a) for a, x in names.items()], *bands)
    hurt = f.groupBy("squad", "team_b").agg(F.count("*").alias("fights"), norm.mean(F.col("hits_b")).alias("damage_taken_avg"))
    members = hurt.groupBy("squad").agg(F.collect_list(F.struct("fights", "damage_taken_avg")).alias("members"))
    return findings.engagement_findings(rows.join(members, "squad"), "squad")


_DEATH = [
    ("died-alone", "deaths", "0.3", "'neutral'", "deaths > 0"),
    ("died-isolated", "with_mates", "isolated / with_mates", _tone("false", "isolated / with_mates > 0.3"), "with_mates > 0"),
    ("death-third-party", "deaths", "third_partied / deaths * 1.3", _tone("false", "third_partied / deaths > 0.25"), "deaths > 0"),
]


@over(events, f"""{W}, r AS (SELECT victim_id AS account_id, count(*) AS deaths, count(*) FILTER (idx % 4 = 0) AS alone, count(*) FILTER (idx % 4 > 0) AS with_mates,
count(*) FILTER (idx % 4 = 1) AS isolated, count(*) FILTER (idx % 5 = 0) AS third_partied FROM kills GROUP BY 1), {_findings_sql('r', 'account_id', _DEATH)}""")
def g37_death_findings(e):
    names = {"alone": "idx % 4 = 0", "with_mates": "idx % 4 > 0", "isolated": "idx % 4 = 1", "third_partied": "idx % 5 = 0"}
    rows = of(e, "kill").groupBy(F.col("victim_id").alias("account_id")).agg(F.count("*").alias("deaths"), *[F.count_if(F.expr(x)).alias(a) for a, x in names.items()])
    return findings.death_findings(rows, "account_id")


@over(results, f"""{R}, c AS (SELECT account_id, map_name, CAST(sum(kills) AS BIGINT) AS kills, min(win_place) AS place FROM res GROUP BY 1, 2) SELECT *,
kills::DOUBLE / max(kills) OVER w AS s_kills, min(place) OVER w / place AS s_place FROM c WINDOW w AS (PARTITION BY map_name)""")
def g40_compare_players(r):
    c = r.groupBy("account_id", "map_name").agg(F.sum("kills").alias("kills"), F.min("win_place").alias("place"))
    return careers.compared(c, "map_name", ["kills", "place"], ["place"])


@over(results, f"{R} SELECT game_mode, count(*) AS n FROM res WHERE game_mode <> '' GROUP BY 1")
def g42_modes_played(r):
    return careers.modes_played(r)


_MAPS = (("map0", "Baltic_Main", "Erangel", 816000), ("map1", "Savage_Main", "Sanhok", 408000), ("map2", "summerland_main", "Karakin", 204000), ("map3", "Heaven_Main", "Haven", 102000), ("map4", "New_Main", "New_Main", 816000))


@over(results, f"{R}, m(map_name, code, display, size) AS (VALUES {', '.join(str(x) for x in _MAPS)}) SELECT DISTINCT code AS map_name, display, size AS world_size, CAST(0.99609375 AS DOUBLE) AS image_scale FROM res JOIN m USING (map_name)")
def g42_maps_played(r):
    code = F.create_map(*[F.lit(x) for n, c, *_ in _MAPS for x in (n, c)])
    return careers.maps_played(r.withColumn("map_name", code[F.col("map_name")])).withColumn("image_scale", F.col("image_scale").cast("double"))


@over(results, f"""{R} SELECT match_type, count(*) AS rows_in, count(DISTINCT match_id) AS matches, CAST(min(played_on) AS STRING) AS first, CAST(max(played_on)
AS STRING) AS last, count(*) FILTER (is_bot) / count(*) AS bot_share FROM res GROUP BY 1""")
def g43_archive_stats(r):
    return careers.archive_stats(r).withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


@over(order_rows, """SELECT max(epoch(TIMESTAMP '2000-01-01') - epoch(t))::BIGINT AS stalest_s, min(epoch(TIMESTAMP '2000-01-01') - epoch(t))::BIGINT AS freshest_s,
count(*) FILTER (t IS NULL) AS never_polled FROM (SELECT CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate END AS t FROM orders)""")
def h1_freshness(o):
    return careers.freshness(o.select(F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderdate").cast("timestamp")).alias("last_polled_at")), F.lit("2000-01-01").cast("timestamp"))


@over(order_rows, """SELECT count(*) FILTER (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-01-01') AS unparsed, count(*) FILTER (o_orderstatus = 'P') AS errors,
CAST(min(o_orderdate) FILTER (o_orderstatus = 'O') AS STRING) AS oldest FROM orders""")
def h2_backlog(o):
    status, at = F.col("o_orderstatus"), F.col("o_orderdate").cast("timestamp")
    matches = o.select(at.alias("fetched_at"), F.when(status == "F", at).alias("parsed_at"), F.when(status == "P", "broken").alias("parse_error"))
    return careers.backlog(matches, F.lit("1997-01-01 01:00:00").cast("timestamp")).withColumn("oldest", F.col("oldest").cast("timestamp_ntz").cast("string"))


@over(order_rows, "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 3 < 2 AND o_orderkey % 5 > 0")
def h5_stale_versions(o):
    key = F.col("o_orderkey")
    matches = o.select(key, F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("parsed_at"), (F.col("o_custkey") % 3).alias("parser_version"), F.when(key % 5 > 0, key).alias("telemetry_key"))
    return careers.stale_versions(matches, 2).select("o_orderkey")


@over(events, f"""WITH {EV}, c AS (SELECT kind, epoch(CAST(match_id AS DATE))::BIGINT + t_s AS t_s, idx, idx % 3 = 0 AS ok FROM ev), r AS (SELECT *, sum(CASE WHEN ok THEN
1 ELSE 0 END) OVER (PARTITION BY kind ORDER BY t_s, idx ROWS UNBOUNDED PRECEDING) AS run, min(CASE WHEN ok THEN t_s END) OVER (PARTITION BY kind ORDER BY t_s,
idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM c) SELECT kind, min(t_s) AS opened, max(t_s) AS last_seen, count(*) AS observations, max(nx)
AS resolved FROM r WHERE NOT ok GROUP BY kind, run""")
def h6_fold_alerts(e):
    at = F.unix_date(F.col("match_id").cast("date")).cast("bigint") * 86_400 + F.col("t_s")
    return careers.folded_alerts(e.select("kind", at.alias("t_s"), "idx", (F.col("idx") % 3 == 0).alias("ok")))


@over(order_rows, "SELECT o_orderkey FROM orders WHERE 4000 - datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) >= least(100 * pow(2, o_orderkey % 6), 2000)")
def h8_due(o):
    rows = o.select("o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("last_s"), (F.col("o_orderkey") % 6).alias("failures"))
    return careers.due(rows, 4000, 100, 2000).select("o_orderkey")


@over(order_rows, "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def a7_new_match_ids(o):
    return careers.new_ids(o, o.where("o_orderstatus = 'F'"), "o_custkey")


@over(customers, """WITH n AS (SELECT c_custkey + 100 AS c_custkey, c_name || 'x' AS c_name FROM customer) SELECT c_custkey, coalesce(n.c_name, c.c_name) AS c_name,
CAST(c.c_nationkey AS INTEGER) AS c_nationkey FROM customer c FULL JOIN n USING (c_custkey)""")
def a10_upsert_entities(c):
    new = c.select((F.col("c_custkey") + 100).alias("c_custkey"), F.concat("c_name", F.lit("x")).alias("c_name"))
    return careers.merged_entities(c.select("c_custkey", "c_name", "c_nationkey"), new, "c_custkey", ["c_name"])


@over(results, f"{R} SELECT match_id, count(*) AS start_players, count(DISTINCT team_id) AS start_teams, count(*) FILTER (is_bot) AS bot_count FROM res GROUP BY 1")
def a13_match_summary(r):
    return careers.match_summary(r)
