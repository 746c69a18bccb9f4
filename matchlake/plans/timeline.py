"""Driver queries over the event view: tracks, combat, engagements, zones and places, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.functions import norm
from matchlake.operators import combat, rounds, spatial, temporal, tracks, zone
from matchlake.plans.view import DEATHS, EV, KINDS, LANDED, ROSTER, events

GAP, LAG = 1800, 3600
W = f"WITH {EV}, {KINDS}"
M = ["match_id", "account_id"]
Q: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = lambda spark, sf: f(spark, sf, events(spark, sf))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def of(e: DataFrame, *kinds: str) -> DataFrame:
    return e.where(F.col("kind").isin(*kinds))


def roster(e: DataFrame) -> DataFrame:
    return e.groupBy(*M).agg(F.min("team_id").alias("team_id"))


def landed(e: DataFrame) -> DataFrame:
    return tracks.first_landings(of(e, "landing")).join(roster(e), M)


def dbl(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


# --- normalisation


@query(f"""WITH {EV} SELECT idx, CAST(least(greatest(x, 0), 816000 - 1) / 816000 * 256 AS INTEGER) - CASE WHEN CAST(least(greatest(x, 0), 816000 - 1)
/ 816000 * 256 AS INTEGER) > least(greatest(x, 0), 816000 - 1) / 816000 * 256 THEN 1 ELSE 0 END AS cell, CAST(round_even(x / 816000 * 65535, 0) AS INTEGER) AS q,
(['N','NE','E','SE','S','SW','W','NW'])[CAST(((CAST(floor((degrees(atan2(vx - x, -(vy - y))) + 22.5) / 45) AS INTEGER) % 8) + 8) % 8 AS INTEGER) + 1] AS bearing,
CAST(least(floor(t_s * 1000 / 500.0), 65535) AS INTEGER) AS tick, least(100.0, greatest(0.0, 60 - CAST(damage AS DOUBLE))) AS health FROM ev""")
def b_geometry(spark: SparkSession, sf: str, e: DataFrame) -> DataFrame:
    return e.select("idx", norm.grid_cell(F.col("x"), 816000).alias("cell"), norm.quantise_u16(F.col("x"), 816000).alias("q"), norm.bearing(F.col("vx") - F.col("x"), F.col("vy") - F.col("y")).alias("bearing"), norm.tick(F.col("t_s"), 500).alias("tick"), norm.health_after(F.lit(60.0), -F.col("damage").cast("double")).alias("health"))


@query(f"WITH {EV} SELECT kind, count(*) AS n FROM ev WHERE kind NOT IN ('hit', 'kill', 'knock') GROUP BY kind")
def b26_unknown_events(spark, sf, e):
    known = spark.createDataFrame([("hit",), ("kill",), ("knock",)], "kind string")
    return e.join(F.broadcast(known), "kind", "left_anti").groupBy("kind").agg(F.count("*").alias("n"))  # three rows


@query(f"WITH {EV} SELECT idx, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM ev WHERE kind = 'hit'")
def a3_project_kind(spark, sf, e):
    return of(e, "hit").select("idx", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


# --- tracks


@query(f"WITH {EV} SELECT match_id, arg_min(idx, idx) AS first_idx, arg_min(t_s, idx) AS t_s, arg_min(account_id, idx) AS account_id FROM ev GROUP BY match_id")
def c1_match_meta(spark, sf, e):
    return tracks.match_meta(e.withColumn("first_idx", F.col("idx")), ["first_idx", "t_s", "account_id"])


@query(f"WITH {EV} SELECT match_id, account_id, team_id, idx, t_s FROM ev QUALIFY row_number() OVER (PARTITION BY match_id, account_id ORDER BY idx) = 1")
def c2_roster(spark, sf, e):
    return tracks.roster(e).select(*M, "team_id", "idx", "t_s")


@query(f"""WITH RECURSIVE {EV}, h AS (SELECT match_id, account_id, idx, CAST(damage AS DOUBLE) % 100 AS health, kind = 'hit' AS heal, row_number() OVER (PARTITION BY match_id, account_id ORDER BY t_s, idx) AS n FROM ev WHERE kind IN ('position', 'hit')),
f AS (SELECT match_id, account_id, idx, n, true AS keep, health AS last FROM h WHERE n = 1 UNION ALL SELECT h.match_id, h.account_id, h.idx, h.n, NOT heal OR abs(health - last) >= 5, CASE WHEN NOT heal OR abs(health - last) >= 5 THEN health ELSE last END
  FROM f JOIN h ON h.match_id = f.match_id AND h.account_id = f.account_id AND h.n = f.n + 1)
SELECT match_id, account_id, idx FROM f WHERE keep""")
def c4_heal_thinned(spark, sf, e):
    health = (F.col("damage").cast("double") % 100).alias("health")
    return tracks.heal_thinned(of(e, "position", "hit").select(*M, "t_s", "idx", (F.col("kind") == "hit").alias("is_heal"), health)).select(*M, "idx")


@query(f"""WITH {EV}, v AS (SELECT match_id, account_id, idx, CASE kind WHEN 'landing' THEN 'v' || CAST(idx % 3 AS STRING) WHEN 'kill' THEN '' END AS vehicle_id FROM ev)
SELECT match_id, account_id, idx, nullif(last_value(vehicle_id IGNORE NULLS) OVER (PARTITION BY match_id, account_id ORDER BY idx ROWS UNBOUNDED PRECEDING), '')
AS riding FROM v""")
def c5_vehicle_asof(spark, sf, e):
    v = F.when(F.col("kind") == "landing", F.concat(F.lit("v"), (F.col("idx") % 3).cast("string"))).when(F.col("kind") == "kill", F.lit(""))
    return tracks.vehicle_asof(e.withColumn("vehicle_id", v)).select(*M, "idx", "riding")


@query(f"""WITH {EV} SELECT match_id, account_id, idx, t_s FROM (SELECT *, lead(t_s) OVER (PARTITION BY match_id, account_id ORDER BY t_s, idx) - t_s AS d FROM ev)
WHERE d IS NULL OR d >= 600""")
def c6_compacted(spark, sf, e):
    return temporal.compacted(e, M, "t_s", 600, ["idx"]).select(*M, "idx", "t_s")


@query(f"{W}, {DEATHS}, {LANDED} SELECT l.match_id, l.account_id, land_t, land_x, land_y, death_t FROM landed l LEFT JOIN deaths USING (match_id, account_id)")
def c7_landings_and_deaths(spark, sf, e):
    return tracks.first_landings(of(e, "landing")).join(tracks.final_deaths(of(e, "kill")), M, "left")


@query(f"{W}, {DEATHS} SELECT match_id, account_id, idx, death_t IS NULL OR t_s < death_t AS alive FROM positions LEFT JOIN deaths USING (match_id, account_id)")
def c8_resolve_alive(spark, sf, e):
    return tracks.resolve_alive(of(e, "position"), tracks.final_deaths(of(e, "kill"))).select(*M, "idx", "alive")


_NEAR = """b AS (SELECT p.match_id, p.account_id, p.idx, p.t_s, s.t_s AS bt, s.idx AS bi FROM {probe} p ASOF LEFT JOIN {sample}s_last s ON p.match_id = s.match_id AND p.account_id = s.account_id AND p.t_s >= s.t_s),
a AS (SELECT p.idx, s.t_s AS at_, s.idx AS ai FROM {probe} p ASOF LEFT JOIN {sample}s_first s ON p.match_id = s.match_id AND p.account_id = s.account_id AND p.t_s <= s.t_s)"""
_ENDS = ", ".join(f"{k}s_last AS (SELECT match_id, account_id, t_s, max(idx) AS idx FROM {k}s GROUP BY 1, 2, 3), {k}s_first AS (SELECT match_id, account_id, t_s, min(idx) AS idx FROM {k}s GROUP BY 1, 2, 3)" for k in ("position", "hit"))
_N = _NEAR.format(probe="kills", sample="position")


@query(f"""{W}, {_ENDS}, {_N}, m AS (SELECT *, bt IS NOT NULL AND (at_ IS NULL OR t_s - bt <= at_ - t_s) AS back FROM b JOIN a USING (idx)) SELECT match_id, account_id,
idx, CASE WHEN lag <= {LAG} THEN s END AS s_idx, CASE WHEN lag <= {LAG} THEN lag END AS s_lag FROM (SELECT *, CASE WHEN back THEN bi ELSE ai END AS s, CASE WHEN back THEN
t_s - bt ELSE at_ - t_s END AS lag FROM m)""")
def c9_nearest_in_time(spark, sf, e):
    probes, samples = of(e, "kill").select(*M, "idx", "t_s"), of(e, "position").select(*M, "t_s", "idx")
    return temporal.asof(probes, samples, M, "t_s", ["idx"], "nearest", ["idx"], LAG).select(*M, "idx", "s_idx", "s_lag")


@query(f"{W}, {_ENDS}, {_N} SELECT match_id, account_id, idx, bi AS s_idx FROM b")
def c10_snap_asof(spark, sf, e):
    return temporal.asof(of(e, "kill").select(*M, "idx", "t_s"), of(e, "position").select(*M, "t_s", "idx"), M, "t_s", ["idx"], "backward", ["idx"]).select(*M, "idx", "s_idx")


_INTERP = f"""{W}, {_ENDS}, {_N}, p AS (SELECT b.*, a.at_, pb.x AS bx, pa.x AS ax FROM b JOIN a USING (idx) LEFT JOIN positions pb ON pb.idx = b.bi LEFT JOIN
positions pa ON pa.idx = a.ai) SELECT match_id, account_id, idx, round(CASE WHEN bt IS NULL THEN {{first}} WHEN at_ IS NULL OR at_ <= bt THEN bx ELSE bx + (ax - bx)
* (t_s - bt) / (at_ - bt) END, 3) AS at_x FROM p"""


@query(_INTERP.format(first="ax"))
def c11_interpolated(spark, sf, e):
    out = temporal.interpolated(of(e, "kill").select(*M, "idx", "t_s"), of(e, "position"), M, "t_s", ["x"], tie=["idx"])
    return out.select(*M, "idx", F.round("at_x", 3).alias("at_x"))


@query(_INTERP.format(first="NULL"))
def c12_position_at(spark, sf, e):
    return tracks.position_at(of(e, "kill").select(*M, "idx", "t_s"), of(e, "position")).select(*M, "idx", F.round("at_x", 3).alias("at_x"))


@query(f"""{W}, {_ENDS}, {_N}, {DEATHS}, p AS (SELECT b.*, a.at_, pb.x AS bx, pa.x AS ax FROM b JOIN a USING (idx) LEFT JOIN positions pb ON pb.idx = b.bi LEFT JOIN positions pa ON pa.idx = a.ai),
up AS (SELECT p.* FROM p LEFT JOIN deaths d ON d.match_id = p.match_id AND d.account_id = p.account_id WHERE death_t IS NULL OR p.t_s < death_t)
SELECT k.idx AS probe_id, p.idx, p.t_s, round(p.x, 3) AS x FROM up k JOIN positions p ON p.match_id = k.match_id AND p.account_id = k.account_id AND p.t_s BETWEEN k.t_s - {LAG} AND k.t_s
UNION ALL SELECT idx, NULL, t_s, round(CASE WHEN at_ IS NULL OR at_ <= bt THEN bx ELSE bx + (ax - bx) * (t_s - bt) / (at_ - bt) END, 3) FROM up WHERE bt IS NOT NULL""")
def c13_trail(spark, sf, e):
    probes = of(e, "kill").withColumn("probe_id", F.col("idx"))
    out = tracks.trail(probes, of(e, "position"), tracks.final_deaths(of(e, "kill")), LAG)
    return out.select("probe_id", "idx", "t_s", F.round("x", 3).alias("x"))


@query(f"""{W}, k AS (SELECT match_id, count(*) AS n_kills FROM kills WHERE t_s <= 43200 GROUP BY 1),
c AS (SELECT match_id, t_s AS spawn_t, CASE WHEN idx % 4 > 0 THEN t_s + 600 + idx % 900 END AS land_t, CASE WHEN idx % 4 = 1 THEN t_s + 3000 END AS looted_t FROM landings),
d AS (SELECT match_id, count(*) FILTER (spawn_t <= 43200 AND (land_t IS NULL OR land_t > 43200)) AS n_falling, count(*) FILTER (land_t <= 43200 AND NOT coalesce(looted_t <= 43200, false)) AS n_landed, count(*) FILTER (looted_t <= 43200) AS n_looted FROM c GROUP BY 1),
s AS (SELECT match_id, idx % 20 AS v, max(t_s) AS seen FROM positions WHERE t_s <= 43200 GROUP BY 1, 2), v AS (SELECT match_id, count(*) AS n_vehicles, max(43200 - seen) AS oldest_s FROM s WHERE 43200 - seen <= {LAG} GROUP BY 1)
SELECT match_id, coalesce(n_kills, 0) AS n_kills, coalesce(n_falling, 0) AS n_falling, coalesce(n_landed, 0) AS n_landed, coalesce(n_looted, 0) AS n_looted, coalesce(n_vehicles, 0) AS n_vehicles, oldest_s
FROM k FULL JOIN d USING (match_id) FULL JOIN v USING (match_id)""")
def c14_world_state(spark, sf, e):
    t, i = F.col("t_s"), F.col("idx")
    crates = of(e, "landing").select("match_id", t.alias("spawn_t"), F.when(i % 4 > 0, t + 600 + i % 900).alias("land_t"), F.when(i % 4 == 1, t + 3000).alias("looted_t"))
    vehicles = of(e, "position").select("match_id", (i % 20).alias("vehicle_id"), "t_s")
    return tracks.world_state(of(e, "kill"), crates, vehicles, 43200, LAG)


@query(f"""{W}, g AS (SELECT match_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(y*y) AS syy, sum(x*y) AS sxy, arg_min(x, idx) AS fx, arg_min(y, idx) AS fy, arg_max(x, idx) AS lx, arg_max(y, idx) AS ly FROM positions GROUP BY 1),
h AS (SELECT *, 0.5 * atan2(2 * (sxy/n - sx/n*(sy/n)), (sxx/n - sx/n*(sx/n)) - (syy/n - sy/n*(sy/n))) AS a FROM g), s AS (SELECT *, CASE WHEN (lx - fx) * cos(a) + (ly - fy) * sin(a) < 0 THEN -1.0 ELSE 1.0 END AS f FROM h),
l AS (SELECT match_id, n, sx/n AS cx, sy/n AS cy, cos(a) * f AS dx, sin(a) * f AS dy FROM s),
r AS (SELECT *, (0 - cx) / nullif(dx, 0) AS xa, (816000 - cx) / nullif(dx, 0) AS xb, (0 - cy) / nullif(dy, 0) AS ya, (816000 - cy) / nullif(dy, 0) AS yb FROM l),
e AS (SELECT *, greatest(least(xa, xb), least(ya, yb)) AS i, least(greatest(xa, xb), greatest(ya, yb)) AS o FROM r)
SELECT match_id, n, round(cx, 3) + 0.0 AS cx, round(cy, 3) + 0.0 AS cy, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy, CASE WHEN i <= o THEN round(cx + i * dx, 2) + 0.0 END AS x0, CASE WHEN i <= o THEN round(cy + i * dy, 2) + 0.0 END AS y0,
CASE WHEN i <= o THEN round(cx + o * dx, 2) + 0.0 END AS x1, CASE WHEN i <= o THEN round(cy + o * dy, 2) + 0.0 END AS y1 FROM e""")
def c15_plane_path(spark, sf, e):
    digits = {"cx": 3, "cy": 3, "dx": 6, "dy": 6, "x0": 2, "y0": 2, "x1": 2, "y1": 2}
    return tracks.plane_path(of(e, "position"), 816_000).withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in digits.items()})


@query(f"WITH {EV} SELECT match_id, idx, kind FROM (SELECT *, lag(kind) OVER (PARTITION BY match_id ORDER BY idx) AS p FROM ev) WHERE p IS NULL OR p <> kind")
def c16_change_points(spark, sf, e):
    return temporal.change_points(e, ["match_id"], ["idx"], ["kind"]).select("match_id", "idx", "kind")


_VEH = """v AS (SELECT match_id, account_id, idx % 2 AS vehicle_id, idx, t_s, CASE kind WHEN 'position' THEN 'ride' ELSE 'leave' END AS kind FROM
ev WHERE kind IN ('position', 'kill'))"""


@query(f"""WITH {EV}, {_VEH} SELECT match_id, account_id, vehicle_id, idx, t_s, CASE WHEN nk = 'leave' THEN nt END AS close_t FROM (SELECT *, lead(kind) OVER w AS nk,
lead(t_s) OVER w AS nt FROM v WINDOW w AS (PARTITION BY match_id, account_id, vehicle_id ORDER BY idx)) WHERE kind = 'ride'""")
def c18_rides(spark, sf, e):
    v = of(e, "position", "kill").select(*M, (F.col("idx") % 2).alias("vehicle_id"), "idx", "t_s", F.when(F.col("kind") == "position", "ride").otherwise("leave").alias("kind"))
    return tracks.rides(v).drop("kind")


_RZ = """z AS (SELECT match_id, team_id AS uid, idx, t_s, CASE kind WHEN 'landing' THEN 'warning' WHEN 'kill' THEN 'activating' ELSE 'deactivating' END AS state FROM
ev WHERE kind IN ('landing', 'kill', 'knock')), d AS (SELECT match_id, max(t_s) AS duration FROM ev GROUP BY 1)"""


@query(f"""WITH {EV}, {_RZ}, p AS (SELECT *, sum(CASE WHEN state = 'warning' THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, uid ORDER BY idx ROWS UNBOUNDED PRECEDING)
AS epoch FROM z), l AS (SELECT match_id, uid, CAST(epoch AS BIGINT) AS epoch, min(t_s) FILTER (state = 'warning') AS warned, min(t_s) FILTER (state = 'activating')
AS started, min(t_s) FILTER (state = 'deactivating') AS ended FROM p WHERE epoch > 0 GROUP BY 1, 2, 3) SELECT match_id, uid, epoch, warned, started, coalesce(ended,
duration) AS ended FROM (SELECT *, max(epoch) OVER (PARTITION BY match_id, uid) AS m FROM l) JOIN d USING (match_id) WHERE ended IS NOT NULL OR epoch = m""")
def c19_red_zones(spark, sf, e):
    z = of(e, "landing", "kill", "knock").select("match_id", F.col("team_id").alias("uid"), "idx", "t_s", F.when(F.col("kind") == "landing", "warning").when(F.col("kind") == "kill", "activating").otherwise("deactivating").alias("state"))
    return tracks.red_zones(z, e.groupBy("match_id").agg(F.max("t_s").alias("duration")))


@query(f"""WITH RECURSIVE {EV}, {KINDS}, near AS (SELECT l.match_id, l.idx AS land_idx, s.idx AS spawn_idx, sqrt((l.x-s.x)*(l.x-s.x)+(l.y-s.y)*(l.y-s.y)) AS d FROM landings l JOIN kills s ON s.match_id = l.match_id AND s.idx < l.idx
  AND abs(l.x - s.x) <= 50000 AND abs(l.y - s.y) <= 50000),
want AS (SELECT match_id, land_idx, list(spawn_idx ORDER BY d, spawn_idx) AS c, row_number() OVER (PARTITION BY match_id ORDER BY land_idx) AS n FROM near WHERE d <= 50000 GROUP BY 1, 2),
turn AS (SELECT match_id, n, land_idx, c[1] AS spawn_idx, [c[1]] AS taken FROM want WHERE n = 1
  UNION ALL SELECT match_id, n, land_idx, got, CASE WHEN got IS NULL THEN taken ELSE list_append(taken, got) END FROM (SELECT w.match_id, w.n, w.land_idx, t.taken, list_filter(w.c, lambda x: NOT list_contains(t.taken, x))[1] AS got
    FROM turn t JOIN want w ON w.match_id = t.match_id AND w.n = t.n + 1))
SELECT l.match_id, l.idx AS land_idx, l.t_s AS land_t, t.spawn_idx, s.t_s AS spawn_t FROM landings l LEFT JOIN turn t ON t.match_id = l.match_id AND t.land_idx = l.idx LEFT JOIN kills s ON s.match_id = l.match_id AND s.idx = t.spawn_idx""")
def c20_care_packages(spark, sf, e):
    return tracks.care_packages(of(e, "kill"), of(e, "landing"))


@query(f"""{W}, n AS (SELECT h.match_id, h.team_id, h.idx, h.t_s, c.idx AS crate_idx, sqrt((h.x - c.x) * (h.x - c.x) + (h.y - c.y) * (h.y - c.y)) AS d FROM hits h JOIN
landings c ON h.match_id = c.match_id AND h.team_id = c.team_id), b AS (SELECT * FROM n WHERE d < 100000 QUALIFY row_number() OVER (PARTITION BY match_id, team_id,
idx ORDER BY d, crate_idx) = 1) SELECT match_id, team_id, crate_idx, min(t_s) AS looted_t, count(*) AS n_pickups FROM b GROUP BY 1, 2, 3""")
def c21_crate_loot(spark, sf, e):
    return tracks.crate_loot(of(e, "hit"), of(e, "landing"), ["match_id", "team_id"], 100_000)


@query(f"WITH {EV} SELECT match_id, victim_id AS item_id, CAST(sum(greatest(idx % 3, 1)) AS BIGINT) AS n, min(idx) AS first_pos FROM ev GROUP BY 1, 2")
def c22_crate_contents(spark, sf, e):
    return tracks.crate_contents(e.select("match_id", F.col("victim_id").alias("item_id"), (F.col("idx") % 3).alias("stack"), F.col("idx").alias("pos")), ["match_id"])


@query(f"""{W} SELECT match_id, account_id, idx, CAST(sum(damage) OVER p AS DOUBLE) AS total_damage, count(*) OVER p AS total_hits FROM
hits WINDOW p AS (PARTITION BY match_id, account_id) QUALIFY row_number() OVER (PARTITION BY match_id, account_id ORDER BY t_s DESC, idx DESC) <= 3""")
def c23_damage_log(spark, sf, e):
    return dbl(tracks.damage_log(of(e, "hit"), M, 3).select(*M, "idx", "total_damage", "total_hits"), "total_damage")


@query(f"""{W} SELECT k.match_id, k.account_id, k.idx AS probe_id, (SELECT min(h.t_s) FROM hits h WHERE h.match_id = k.match_id AND h.account_id = k.account_id AND
h.t_s > k.t_s + 1) AS next_t, (SELECT max(h.t_s) FROM hits h WHERE h.match_id = k.match_id AND h.account_id = k.account_id AND h.t_s < k.t_s - 1) AS prev_t FROM kills k""")
def c25_step_fight(spark, sf, e):
    return tracks.step_fight(of(e, "kill").withColumn("probe_id", F.col("idx")), of(e, "hit").withColumn("t_start", F.col("t_s")), M, 1)


# --- combat


@query(f"""{W} SELECT match_id, idx, row_number() OVER (PARTITION BY match_id ORDER BY idx) - 1 AS seq, account_id = victim_id AS is_suicide, team_id = victim_team AND account_id <> victim_id AS is_team_kill,
CASE WHEN idx % 3 > 0 AND idx % 5 > 0 THEN account_id END AS maker_id, CASE WHEN idx % 3 > 0 THEN [account_id, team_id] ELSE [] END AS assists FROM kills WHERE idx % 11 > 0""")
def d1_kill_events(spark, sf, e):
    k = of(e, "kill").withColumn("victim_id", F.when(F.col("idx") % 11 > 0, F.col("victim_id")))
    newer = k.where("idx % 3 > 0").withColumn("maker_id", F.when(F.col("idx") % 5 > 0, F.col("account_id"))).withColumn("assists", F.array("account_id", F.col("team_id").cast("bigint")))
    return combat.kill_events(newer, k.where("idx % 3 = 0")).select("match_id", "idx", "seq", "is_suicide", "is_team_kill", "maker_id", "assists")


@query(f"{W} SELECT match_id, idx, victim_id, row_number() OVER (PARTITION BY match_id ORDER BY idx) - 1 AS seq FROM knocks")
def d2_knock_events(spark, sf, e):
    return combat.knock_events(of(e, "knock")).select("match_id", "idx", "victim_id", "seq")


@query(f"{W} SELECT match_id, account_id, count(*) AS n_revives FROM landings GROUP BY 1, 2")
def d3_revives(spark, sf, e):
    return combat.revives(of(e, "landing").withColumnRenamed("account_id", "reviver_id"))


@query(f"{W} SELECT match_id, idx, CAST(damage AS DOUBLE) AS damage FROM hits WHERE account_id <> victim_id AND damage > 0")
def d4_hits(spark, sf, e):
    return dbl(combat.hits(of(e, "hit")).select("match_id", "idx", "damage"), "damage")


@query(f"""{W} SELECT match_id, victim_id, CAST(sum(damage) AS DOUBLE) AS unattributed_damage, CAST(sum(damage) FILTER (idx % 2 = 0) AS DOUBLE) AS blue_damage FROM
hits WHERE idx % 3 = 0 GROUP BY 1, 2""")
def d5_unattributed(spark, sf, e):
    d = of(e, "hit").withColumn("account_id", F.when(F.col("idx") % 3 != 0, F.col("account_id"))).withColumn("category", F.when(F.col("idx") % 2 == 0, "damage_bluezone").otherwise("damage_gun"))
    return dbl(combat.unattributed(d), "unattributed_damage", "blue_damage")


@query(f"""{W}, k AS (SELECT match_id, account_id, count(*) AS kills, count(*) FILTER (victim_id % 10 <> 0) AS kills_human FROM kills GROUP BY 1, 2), n AS (SELECT match_id, account_id, count(*) AS knocks, count(*) FILTER (victim_id % 10 <> 0) AS knocks_human FROM knocks GROUP BY 1, 2), d AS (SELECT match_id, account_id, CAST(sum(damage) AS DOUBLE) AS damage_dealt FROM hits GROUP BY 1, 2),
x AS (SELECT match_id, victim_id AS account_id, arg_max(t_s, idx) AS died_t, arg_max(account_id, idx) AS killed_by FROM kills GROUP BY 1, 2)
SELECT match_id, account_id, coalesce(kills, 0) AS kills, coalesce(kills_human, 0) AS kills_human, coalesce(knocks, 0) AS knocks, coalesce(knocks_human, 0) AS knocks_human, coalesce(damage_dealt, 0) AS damage_dealt, died_t, killed_by FROM k FULL JOIN n USING (match_id, account_id) FULL JOIN d USING (match_id, account_id) FULL JOIN x USING (match_id, account_id)""")
def d6_player_combat(spark, sf, e):
    return dbl(combat.player_combat(of(e, "kill"), of(e, "knock"), of(e, "hit"), F.col("victim_id") % 10 == 0), "damage_dealt")


def _accuracy(e, by):
    attacks = of(e, "position").select("match_id", "account_id", "idx", (F.col("idx") % 50).alias("attack_id"), F.concat(F.lit("w"), (F.col("idx") % 3).cast("string")).alias("weapon"))
    damage = of(e, "hit").select("match_id", "account_id", "idx", (F.col("idx") % 50).alias("attack_id"), "damage", (F.col("idx") % 4 == 0).alias("is_head"), (F.col("idx") % 5 == 0).alias("on_knocked"))
    thrown = of(e, "landing").select("match_id", (F.col("idx") % 50).alias("attack_id"))
    return dbl(combat.accuracy(attacks, damage, thrown, by), "damage")


def _accuracy_sql(extra: str) -> str:
    return f"""{W}, t AS (SELECT DISTINCT match_id, idx % 50 AS attack_id FROM landings), s AS (SELECT match_id, account_id, idx, idx % 50 AS attack_id, 'w' || CAST(idx % 3 AS STRING) AS weapon FROM positions p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.match_id = p.match_id AND t.attack_id = p.idx % 50)),
l AS (SELECT s.idx, count(*) AS h, count(*) FILTER (h.idx % 4 = 0) AS hd, count(*) FILTER (h.idx % 5 = 0) AS dn, sum(damage) AS dm FROM s JOIN hits h ON h.match_id = s.match_id AND h.account_id = s.account_id AND h.idx % 50 = s.attack_id AND h.idx > s.idx GROUP BY s.idx)
SELECT match_id, account_id{extra}, count(*) AS shots, count(h) AS shots_landed, CAST(coalesce(sum(h), 0) AS BIGINT) AS hit_events, CAST(coalesce(sum(dn), 0) AS BIGINT) AS dbno_hit_events, CAST(coalesce(sum(hd), 0) AS BIGINT) AS headshot_events, CAST(coalesce(sum(dm), 0) AS DOUBLE) AS damage FROM s LEFT JOIN l USING (idx) GROUP BY match_id, account_id{extra}"""


@query(_accuracy_sql(""))
def d7_attack_hit_join(spark, sf, e):
    return _accuracy(e, ("match_id", "account_id"))


@query(_accuracy_sql(", weapon"))
def d8_participant_weapons(spark, sf, e):
    return _accuracy(e, ("match_id", "account_id", "weapon"))


@query(f"WITH {EV} SELECT match_id, account_id, CAST(sum(idx % 9) AS BIGINT) AS shots, CAST(sum(idx % 4) AS BIGINT) AS hits FROM ev GROUP BY 1, 2")
def d9_reported_totals(spark, sf, e):
    used = F.struct((F.col("idx") % 9).alias("shots"), (F.col("idx") % 4).alias("hits"))
    return combat.reported_totals(e.select("match_id", F.array(F.struct("account_id", F.array(used).alias("stats"))).alias("stats")))


@query(f"{W} SELECT match_id, account_id, coalesce(max(CASE WHEN distance > 50 THEN distance END), 0) AS longest_kill_cm FROM kills GROUP BY 1, 2")
def d10_longest_kill(spark, sf, e):
    return combat.longest_kill(of(e, "kill").withColumn("distance", F.when(F.col("distance") > 50, F.col("distance")).otherwise(-1.0)))


@query(f"""{W}, {ROSTER}, {LANDED}, f AS (SELECT match_id, account_id, arg_min(x, idx) AS first_x, arg_min(y, idx) AS first_y FROM positions GROUP BY 1, 2),
k AS (SELECT match_id, account_id, max(distance) AS longest_kill_cm, count(*) AS kills FROM kills GROUP BY 1, 2) SELECT r.match_id, r.account_id, r.team_id,
coalesce(r.account_id IN (SELECT account_id FROM kills x WHERE x.match_id = r.match_id AND x.account_id % 4 = 0), false) OR (r.account_id % 5 = 0 AND
r.account_id NOT IN (SELECT account_id FROM kills x WHERE x.match_id = r.match_id)) AS is_bot, kills, longest_kill_cm, coalesce(land_x, first_x) AS x0, coalesce(land_y,
first_y) AS y0 FROM roster r LEFT JOIN landed l USING (match_id, account_id) LEFT JOIN f USING (match_id, account_id) LEFT JOIN k USING (match_id, account_id)""")
def d11_participant_updates(spark, sf, e):
    first = of(e, "position").groupBy(*M).agg(F.min_by(F.struct(F.col("x").alias("first_x"), F.col("y").alias("first_y")), "idx").alias("f")).select(*M, "f.*")
    own = roster(e).withColumn("is_bot", F.col("account_id") % 5 == 0)
    said = of(e, "kill").select(*M, (F.col("account_id") % 4 == 0).alias("is_bot")).distinct()
    kills = of(e, "kill").groupBy(*M).agg(F.count("*").alias("kills"))
    return combat.participant_updates(own, kills, combat.longest_kill(of(e, "kill")), tracks.first_landings(of(e, "landing")).drop("land_t"), first, said)


@query(f"""{W}, {ROSTER} SELECT h.match_id, h.idx FROM hits h JOIN roster a ON a.match_id = h.match_id AND a.account_id = h.account_id JOIN
roster b ON b.match_id = h.match_id AND b.account_id = h.victim_id WHERE h.idx % 3 < 2""")
def d12_tracer_hits(spark, sf, e):
    return combat.tracer_hits(of(e, "hit").withColumn("category", (F.col("idx") % 3).cast("string")), roster(e), ("0", "1")).select("match_id", "idx")


_PAIR = """blows AS (SELECT *, least(team_id, victim_team) AS team_a, greatest(team_id, victim_team) AS team_b, team_id < victim_team AS is_a FROM
ev WHERE kind IN ('hit', 'knock') AND team_id <> victim_team)"""
_SEG = f"""{_PAIR}, flagged AS (SELECT *, CASE WHEN t_s - lag(t_s) OVER w > {GAP} THEN 1 ELSE 0 END AS new FROM blows WINDOW w AS (PARTITION BY match_id, team_a, team_b ORDER BY t_s, idx)),
seg AS (SELECT *, CAST(sum(new) OVER (PARTITION BY match_id, team_a, team_b ORDER BY t_s, idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM flagged),
spans AS (SELECT match_id, team_a, team_b, segment, min(t_s) AS t_start, max(t_s) AS t_end FROM seg GROUP BY 1, 2, 3, 4)"""
_ATT = f"""xk AS (SELECT *, least(team_id, victim_team) AS team_a, greatest(team_id, victim_team) AS team_b, team_id < victim_team AS is_a FROM kills WHERE team_id <> victim_team),
xl AS (SELECT k.idx, max(n.t_s) AS knock_t FROM xk k JOIN knocks n ON n.match_id = k.match_id AND n.victim_id = k.victim_id AND least(n.team_id, n.victim_team) = k.team_a AND greatest(n.team_id, n.victim_team) = k.team_b AND n.team_id <> n.victim_team AND n.t_s <= k.t_s GROUP BY k.idx),
xr AS (SELECT k.*, knock_t, segment, t_start, t_end, CASE WHEN k.t_s BETWEEN t_start AND t_end THEN 1 WHEN knock_t BETWEEN t_start AND t_end THEN 2 WHEN t_end <= k.t_s AND k.t_s - t_end <= {GAP} THEN 3 END AS rule FROM xk k LEFT JOIN xl USING (idx) JOIN spans s ON s.match_id = k.match_id AND s.team_a = k.team_a AND s.team_b = k.team_b),
att AS (SELECT * FROM xr WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY idx ORDER BY rule, t_end DESC, segment DESC) = 1)"""
_KEY = "match_id, team_a, team_b, segment"


def _segmented(e):
    return combat.segments(of(e, "hit", "knock"), GAP)


def _attached(e):
    return combat.attach_kills(of(e, "kill"), combat.segment_spans(_segmented(e)), of(e, "knock"), GAP, 0)


@query(f"WITH {EV}, {_SEG} SELECT match_id, idx, team_a, team_b, segment FROM seg")
def d13_gap_segments(spark, sf, e):
    return _segmented(e).select("match_id", "idx", "team_a", "team_b", "segment")


@query(f"{W}, {_SEG}, {_ATT} SELECT k.match_id, k.idx, a.rule, a.segment FROM xk k LEFT JOIN att a USING (idx)")
def d14_attach_kills(spark, sf, e):
    return _attached(e).select("match_id", "idx", "rule", "segment")


_ENG = f"""g AS (SELECT {_KEY}, min(t_s) AS t_start, max(t_s) AS t_end, {", ".join(f"count(*) FILTER (kind = 'hit' AND {c}) AS hits_{s}, CAST(coalesce(sum(damage) FILTER (kind = 'hit' AND {c}), 0) AS DOUBLE) AS dmg_{s}, count(*) FILTER (kind = 'knock' AND {c}) AS knocks_{s}" for s, c in (("a", "is_a"), ("b", "NOT is_a")))},
arg_min(team_id, t_s * 100000000 + idx) FILTER (kind = 'hit') AS first_hit_team, arg_min(account_id, t_s * 100000000 + idx) FILTER (kind = 'hit') AS first_hit_account, arg_min(sqrt((x-vx)*(x-vx)+(y-vy)*(y-vy)), t_s * 100000000 + idx) FILTER (kind = 'hit') AS first_hit_range, min(sqrt((x-vx)*(x-vx)+(y-vy)*(y-vy))) FILTER (kind = 'hit') AS min_range FROM seg GROUP BY {_KEY}),
kk AS (SELECT {_KEY}, count(*) FILTER (is_a) AS kills_a, count(*) FILTER (NOT is_a) AS kills_b FROM att GROUP BY {_KEY}),
eng AS (SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY t_start, team_a, team_b, segment) - 1 AS seq, team_a, team_b, segment, t_start, t_end, hits_a, dmg_a, knocks_a, hits_b, dmg_b, knocks_b, first_hit_team, first_hit_account, first_hit_range, min_range, coalesce(kills_a, 0) AS kills_a, coalesce(kills_b, 0) AS kills_b FROM g LEFT JOIN kk USING ({_KEY}))"""


def engagements(e):
    return dbl(combat.engagements(_segmented(e), _attached(e)), "dmg_a", "dmg_b")


@query(f"{W}, {_SEG}, {_ATT}, {_ENG} SELECT * FROM eng")
def d17_engagements(spark, sf, e):
    return engagements(e)


_CEN = f"cen AS (SELECT {_KEY}, (sum(x) + sum(vx)) / (2 * count(*)) AS cx, (sum(y) + sum(vy)) / (2 * count(*)) AS cy FROM seg WHERE kind = 'hit' GROUP BY {_KEY})"


@query(f"WITH {EV}, {_SEG}, {_CEN} SELECT match_id, team_a, team_b, segment, round(cx, 3) AS cx, round(cy, 3) AS cy FROM cen")
def d16_centres(spark, sf, e):
    return combat.centres(of(_segmented(e), "hit")).withColumns({"cx": F.round("cx", 3), "cy": F.round("cy", 3)})


@query(f"""{W}, {_SEG}, {_CEN}, f AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY t_start, team_a, team_b, segment) - 1 AS seq FROM spans JOIN cen USING ({_KEY})),
p AS (SELECT a.match_id, a.seq, CASE WHEN b.team_a IN (a.team_a, a.team_b) THEN b.team_b ELSE b.team_a END AS out_team, b.t_start * 100000 + b.seq AS k FROM f a JOIN f b ON a.match_id = b.match_id AND a.seq <> b.seq AND (CAST(b.team_a IN (a.team_a, a.team_b) AS INT) + CAST(b.team_b IN (a.team_a, a.team_b) AS INT)) = 1 AND b.t_start <= a.t_end AND b.t_end >= a.t_start AND sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)) <= 100000)
SELECT match_id, seq, arg_min(out_team, k) AS third_party_team_id FROM p GROUP BY 1, 2""")
def d15_third_parties(spark, sf, e):
    seq = F.row_number().over(temporal.Window.partitionBy("match_id").orderBy("t_start", "team_a", "team_b", "segment")) - 1
    s = _segmented(e)
    f = combat.segment_spans(s).join(combat.centres(of(s, "hit")), ["match_id", "team_a", "team_b", "segment"]).withColumn("seq", seq)
    return combat.third_parties(f, 100_000)


@query(f"""{W}, {_SEG}, {_ATT}, legs AS (
SELECT {_KEY}, account_id, team_id, (kind = 'hit')::INT AS hd, 0 AS ht, CASE WHEN kind = 'hit' THEN damage END AS dd, NULL AS dt, (kind = 'knock')::INT AS kn, 0 AS ki, false AS wk, false AS di FROM seg UNION ALL
SELECT {_KEY}, victim_id, victim_team, 0, (kind = 'hit')::INT, NULL, CASE WHEN kind = 'hit' THEN damage END, 0, 0, kind = 'knock', false FROM seg UNION ALL
SELECT {_KEY}, account_id, team_id, 0, 0, NULL, NULL, 0, 1, false, false FROM att UNION ALL SELECT {_KEY}, victim_id, victim_team, 0, 0, NULL, NULL, 0, 0, false, true FROM att)
SELECT {_KEY}, account_id, team_id, CAST(sum(hd) AS BIGINT) AS hits_dealt, CAST(sum(ht) AS BIGINT) AS hits_taken, CAST(coalesce(sum(dd), 0) AS DOUBLE) AS damage_dealt, CAST(coalesce(sum(dt), 0) AS DOUBLE) AS damage_taken, CAST(sum(kn) AS BIGINT) AS knocks, CAST(sum(ki) AS BIGINT) AS kills, bool_or(wk) AS was_knocked, bool_or(di) AS died FROM legs GROUP BY {_KEY}, account_id, team_id""")
def d18_engagement_participants(spark, sf, e):
    return dbl(combat.engagement_participants(_segmented(e), _attached(e)), "damage_dealt", "damage_taken")


@query(f"""WITH {EV}, {_PAIR}, s AS (SELECT t_s - lag(t_s) OVER (PARTITION BY match_id, team_a, team_b ORDER BY t_s, idx) AS d FROM blows), gaps(gap) AS (VALUES (300),
(1800), (7200)) SELECT gap, count(*) FILTER (d IS NULL OR d > gap) AS n_segments FROM s, gaps GROUP BY gap""")
def d19_gap_sweep(spark, sf, e):
    return temporal.gap_sweep(combat.paired(of(e, "hit", "knock")), ["match_id", "team_a", "team_b"], "t_s", (300, 1800, 7200), ["idx"])


# --- zones and drops


@query(f"""{W}, {DEATHS}, {LANDED}, s AS (SELECT p.*, idx % 3 = 0 AS in_blue, death_t IS NULL OR t_s < death_t AS alive, land_t, lead(t_s) OVER (PARTITION BY match_id,
account_id ORDER BY t_s, idx) - t_s AS d FROM positions p LEFT JOIN deaths USING (match_id, account_id) LEFT JOIN landed USING (match_id, account_id)) SELECT match_id,
account_id, CASE WHEN max(land_t) IS NOT NULL THEN CAST(coalesce(sum(least(d, 900)) FILTER (in_blue AND alive AND t_s >= land_t AND d IS NOT NULL), 0) + 900 * count(*)
FILTER (in_blue AND alive AND t_s >= land_t AND d IS NULL) AS DOUBLE) END AS blue_s FROM s GROUP BY 1, 2""")
def d21_blue_dwell(spark, sf, e):
    t = tracks.resolve_alive(of(e, "position"), tracks.final_deaths(of(e, "kill"))).withColumn("in_blue", F.col("idx") % 3 == 0).join(landed(e).select(*M, "land_t"), M, "left")
    return dbl(zone.blue_dwell(t, 900.0), "blue_s")


@query(f"""{W}, {DEATHS}, {LANDED}, c AS (SELECT match_id, idx AS circle, t_s AS announced, x AS zx, y AS zy FROM knocks), i AS (SELECT p.match_id, p.account_id,
c.circle, min(p.t_s) - min(greatest(announced, land_t)) AS lag FROM positions p LEFT JOIN deaths d USING (match_id, account_id) JOIN
landed l ON l.match_id = p.match_id AND l.account_id = p.account_id JOIN c ON c.match_id = p.match_id WHERE (death_t IS NULL OR p.t_s < death_t) AND
p.t_s >= greatest(announced, land_t) AND sqrt((p.x-zx)*(p.x-zx)+(p.y-zy)*(p.y-zy)) <= 300000 GROUP BY 1, 2, 3) SELECT match_id, account_id, sum(lag) / count(*)
AS rotate_lag_s, count(*) AS n_circles FROM i GROUP BY 1, 2""")
def d22_rotate_lag(spark, sf, e):
    circles = of(e, "knock").select("match_id", "idx", "t_s", F.col("x").alias("zx"), F.col("y").alias("zy"), F.lit(300_000.0).alias("zr"))
    return zone.rotate_lag(tracks.resolve_alive(of(e, "position"), tracks.final_deaths(of(e, "kill"))), circles, landed(e))


@query(f"""{W}, {LANDED} SELECT a.match_id, a.account_id, count(*) FILTER (a.team_id <> b.team_id AND abs(a.land_t - b.land_t) <= 14400 AND
sqrt((a.land_x-b.land_x)*(a.land_x-b.land_x)+(a.land_y-b.land_y)*(a.land_y-b.land_y)) <= 200000) AS hot_drop_n FROM landed a JOIN
landed b ON a.match_id = b.match_id GROUP BY 1, 2""")
def d24_hot_drop(spark, sf, e):
    return zone.hot_drop(landed(e), 200_000, 14_400)


@query(f"""{W}, l AS (SELECT match_id, account_id, t_s, damage AS dealt, CAST(0 AS DECIMAL(18,2)) AS taken FROM hits UNION ALL SELECT match_id, victim_id, t_s, 0,
damage FROM hits) SELECT match_id, account_id, min(t_s) AS first_engage_s, CAST(sum(CASE WHEN t_s <= 43200 THEN dealt ELSE 0 END) AS DOUBLE) AS dmg_dealt_early,
CAST(sum(CASE WHEN t_s <= 43200 THEN taken ELSE 0 END) AS DOUBLE) AS dmg_taken_early FROM l GROUP BY 1, 2""")
def d25_early_combat(spark, sf, e):
    return dbl(zone.early_combat(of(e, "hit"), 43_200), "dmg_dealt_early", "dmg_taken_early")


@query(f"""{W}, {LANDED}, d AS (SELECT match_id, account_id, t_s, CASE WHEN kind = 'kill' THEN 'equip' ELSE 'add' END AS op, idx % 4 AS slot FROM
ev WHERE kind IN ('kill', 'hit')) SELECT d.match_id, d.account_id, min(t_s) FILTER (op = 'equip' AND slot < 2) AS first_weapon_s, count(*) FILTER (op = 'add' AND
t_s >= land_t AND t_s <= land_t + 7200) AS early_pickups_n FROM d LEFT JOIN landed USING (match_id, account_id) GROUP BY 1, 2""")
def d26_early_items(spark, sf, e):
    d = of(e, "kill", "hit").select(*M, "t_s", F.when(F.col("kind") == "kill", "equip").otherwise("add").alias("op"), (F.col("idx") % 4).alias("slot"))
    return zone.early_items(d, landed(e), 7_200)


_CTX = f"""{W}, {ROSTER}, {DEATHS}, v AS (SELECT k.match_id, k.idx, k.victim_id, k.t_s, r.team_id FROM kills k JOIN roster r ON r.match_id = k.match_id AND r.account_id = k.victim_id),
near AS (SELECT q.match_id, q.k, q.account_id, p.x, p.y, p.idx % 3 = 0 AS rides, abs(p.t_s - q.t_s) AS lag FROM (SELECT v.match_id, v.idx AS k, v.t_s, r.account_id FROM v JOIN roster r ON r.match_id = v.match_id AND r.team_id = v.team_id) q JOIN positions p ON p.match_id = q.match_id AND p.account_id = q.account_id
  QUALIFY row_number() OVER (PARTITION BY q.k, q.account_id ORDER BY abs(p.t_s - q.t_s), CASE WHEN p.t_s <= q.t_s THEN 0 ELSE 1 END, CASE WHEN p.t_s <= q.t_s THEN -p.idx ELSE p.idx END) = 1),
ok AS (SELECT * FROM near WHERE lag <= {LAG}),
mate AS (SELECT v.idx, count(*) AS n, min(sqrt((o.x-m.x)*(o.x-m.x)+(o.y-m.y)*(o.y-m.y))) AS d FROM v JOIN roster r ON r.match_id = v.match_id AND r.team_id = v.team_id AND r.account_id <> v.victim_id LEFT JOIN deaths dd ON dd.match_id = v.match_id AND dd.account_id = r.account_id LEFT JOIN ok o ON o.k = v.idx AND o.account_id = v.victim_id LEFT JOIN ok m ON m.k = v.idx AND m.account_id = r.account_id WHERE death_t IS NULL OR death_t > v.t_s GROUP BY v.idx)
SELECT v.match_id, v.idx, v.victim_id, o.lag AS sample_lag, coalesce(o.rides, false) AS in_vehicle, coalesce(n, 0) AS teammates_alive, d AS nearest_teammate FROM v LEFT JOIN mate USING (idx) LEFT JOIN ok o ON o.k = v.idx AND o.account_id = v.victim_id"""


@query(_CTX)
def d28_death_context(spark, sf, e):
    return zone.death_context(of(e, "kill"), roster(e), of(e, "position").withColumn("riding", F.when(F.col("idx") % 3 == 0, "v")), tracks.final_deaths(of(e, "kill")), LAG)


@query(f"""{W}, {ROSTER}, {DEATHS}, up AS (SELECT p.match_id, p.account_id, p.idx, p.t_s, p.x, p.y, r.team_id FROM positions p JOIN roster r USING (match_id, account_id) LEFT JOIN deaths USING (match_id, account_id) WHERE death_t IS NULL OR p.t_s < death_t),
n AS (SELECT a.match_id, a.account_id, a.idx, abs(b.t_s - a.t_s) AS lag, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM up a JOIN up b ON a.match_id = b.match_id AND a.team_id = b.team_id AND a.account_id <> b.account_id
  QUALIFY row_number() OVER (PARTITION BY a.idx, b.account_id ORDER BY abs(b.t_s - a.t_s), CASE WHEN b.t_s <= a.t_s THEN 0 ELSE 1 END, CASE WHEN b.t_s <= a.t_s THEN -b.idx ELSE b.idx END) = 1),
m AS (SELECT match_id, account_id, idx, min(d) AS d FROM n WHERE lag <= {LAG} GROUP BY 1, 2, 3)
SELECT match_id, account_id, count(*) AS n_samples, round(avg(d), 3) AS teammate_dist_avg, count(*) FILTER (d <= 10000) / count(*) AS teammate_near_pct FROM m GROUP BY 1, 2""")
def d23_teammate_spread(spark, sf, e):
    t = tracks.resolve_alive(of(e, "position"), tracks.final_deaths(of(e, "kill")))
    return zone.teammate_spread(t, roster(e), LAG).withColumn("teammate_dist_avg", F.round("teammate_dist_avg", 3))


@query(f"""{W}, {ROSTER}, {DEATHS}, pe AS (SELECT match_id, CAST(floor(t_s / 21600) AS INTEGER) AS phase, idx % 2 = 0 AS early, arg_max(t_s, idx) AS t, arg_max([account_id, victim_id], idx) AS members FROM knocks GROUP BY 1, 2, 3),
ph AS (SELECT match_id, phase, max(t) FILTER (early) AS announce_t, max(t) FILTER (NOT early) AS close_t, any_value(members) FILTER (early) AS am, any_value(members) FILTER (NOT early) AS cm FROM pe GROUP BY 1, 2), pt AS (SELECT *, coalesce(close_t, announce_t) AS t FROM ph),
ci AS (SELECT pt.match_id, phase, arg_max({{'x': k.x, 'y': k.y, 'r': CASE WHEN k.idx % 5 > 0 THEN 200000.0 ELSE 0 END}}, k.t_s * 100000000 + k.idx) AS c FROM pt JOIN kills k ON k.match_id = pt.match_id AND k.t_s <= t GROUP BY 1, 2),
ro AS (SELECT r.account_id, pt.* FROM pt JOIN roster r USING (match_id)),
ne AS (SELECT ro.match_id, ro.account_id, ro.phase, p.idx, p.x, p.y, p.t_s, abs(p.t_s - t) AS lag FROM ro JOIN positions p ON p.match_id = ro.match_id AND p.account_id = ro.account_id
  QUALIFY row_number() OVER (PARTITION BY ro.match_id, ro.account_id, ro.phase ORDER BY abs(p.t_s - t), CASE WHEN p.t_s <= t THEN 0 ELSE 1 END, CASE WHEN p.t_s <= t THEN -p.idx ELSE p.idx END) = 1),
nd AS (SELECT ne.*, death_t IS NULL OR t_s < death_t AS alive FROM ne LEFT JOIN deaths USING (match_id, account_id) WHERE lag <= {LAG}),
al AS (SELECT ro.*, nd.alive, nd.idx AS s_idx, nd.lag, list_contains(am, ro.account_id) AS in_at_announce, list_contains(cm, ro.account_id) AS in_at_close, CASE WHEN c.r > 0 THEN sqrt((nd.x-c.x)*(nd.x-c.x)+(nd.y-c.y)*(nd.y-c.y)) END AS to_centre
  FROM ro LEFT JOIN nd USING (match_id, account_id, phase) LEFT JOIN ci USING (match_id, phase))
SELECT match_id, account_id, phase, announce_t, close_t, in_at_announce, in_at_close, alive, coalesce(s_idx % 3 = 0, false) AS in_vehicle, round(to_centre, 3) AS to_centre, round(200000 - to_centre, 3) AS to_edge, lag AS sample_lag
FROM al WHERE s_idx IS NOT NULL OR coalesce(in_at_announce, false) OR coalesce(in_at_close, false)""")
def d20_zone_play(spark, sf, e):
    kind = F.when(F.col("idx") % 2 == 0, "announce").otherwise("close")
    phases = of(e, "knock").withColumn("phase", F.floor(F.col("t_s") / 21600).cast("int")).withColumn("phase_kind", kind).withColumn("members", F.array("account_id", "victim_id"))
    radius = F.when(F.col("idx") % 5 > 0, F.lit(200_000.0)).otherwise(F.lit(0.0))
    zones = of(e, "kill").select("match_id", "t_s", "idx", F.col("x").alias("zx"), F.col("y").alias("zy"), radius.alias("zr"))
    track = tracks.resolve_alive(of(e, "position"), tracks.final_deaths(of(e, "kill"))).withColumn("riding", F.when(F.col("idx") % 3 == 0, "v"))
    return zone.zone_play(roster(e), phases, track, zones, LAG).withColumns({c: F.round(c, 3) for c in ("to_centre", "to_edge")})


@query(f"""WITH blue AS ({SQL["d21_blue_dwell"]}), lagged AS ({SQL["d22_rotate_lag"]}), hot AS ({SQL["d24_hot_drop"]}), early AS ({SQL["d25_early_combat"]}), items AS ({SQL["d26_early_items"]}), mates AS ({SQL["d23_teammate_spread"]}), {EV}, {ROSTER}
SELECT match_id, account_id, n_samples, teammate_dist_avg, teammate_near_pct, blue_s, rotate_lag_s, n_circles, hot_drop_n, first_engage_s, dmg_dealt_early, dmg_taken_early, first_weapon_s, early_pickups_n
FROM roster LEFT JOIN blue USING (match_id, account_id) LEFT JOIN lagged USING (match_id, account_id) LEFT JOIN hot USING (match_id, account_id) LEFT JOIN early USING (match_id, account_id) LEFT JOIN items USING (match_id, account_id) LEFT JOIN mates USING (match_id, account_id)""")
def d27_strategy_metrics(spark, sf, e):
    names = ("d21_blue_dwell", "d22_rotate_lag", "d24_hot_drop", "d25_early_combat", "d26_early_items", "d23_teammate_spread")
    return zone.strategy_metrics(roster(e), *[Q[n](spark, sf) for n in names])


# --- places and exports


@query(f"""{W} SELECT p.match_id, dense_rank() OVER (PARTITION BY p.match_id ORDER BY p.team_id, p.account_id) - 1 AS player, idx, CAST(floor(t_s * 1000 / 2000.0) AS INTEGER) AS tick,
CAST(round_even(x / 816000 * 65535, 0) AS INTEGER) AS qx, CAST(round_even(y / 816000 * 65535, 0) AS INTEGER) AS qy, CAST(least(greatest(round_even(CAST(damage AS DOUBLE) - 20, 0), 0), 255) AS INTEGER) AS hp,
CAST(CASE WHEN damage > 20 THEN 1 ELSE 0 END + CASE WHEN idx % 5 = 0 THEN 4 ELSE 0 END + CASE WHEN idx % 7 = 0 THEN 8 ELSE 0 END + CASE WHEN idx % 10 = 0 THEN 64 ELSE 0 END AS INTEGER) AS flags FROM positions p""")
def e1_replay_positions(spark, sf, e):
    i, health = F.col("idx"), F.col("damage").cast("double") - 20
    kind = F.when(i % 2 == 0, "WheeledVehicle").otherwise("TransportAircraft")
    flags = norm.sample_flags(health, F.lit(False), i % 5 == 0, kind, i % 7 == 0, F.lit(False), F.lit(1.0))
    return spatial.replay_positions(of(e, "position").withColumn("health", health).withColumn("flags", norm.flag_mask(**flags)), 816_000, 2000)


_TICK = "CAST(least(floor(t_s / 2.0), 65535) AS INTEGER) AS tick"


@query(f"""{W}, u AS (SELECT match_id, idx, t_s, 'kill' AS event, account_id, victim_id, distance AS range_cm, NULL AS x, NULL AS y, NULL AS vehicle_id, NULL AS phase, NULL AS members FROM kills
UNION ALL SELECT match_id, idx, t_s, 'knock', account_id, victim_id, NULL, NULL, NULL, NULL, NULL, NULL FROM knocks
UNION ALL SELECT match_id, idx, t_s, 'revive', account_id, victim_id, NULL, NULL, NULL, NULL, NULL, NULL FROM hits WHERE idx % 5 = 0
UNION ALL SELECT match_id, idx, t_s, 'crate', NULL, NULL, NULL, x, y, NULL, NULL, NULL FROM landings
UNION ALL SELECT match_id, idx, t_s, 'ride', account_id, NULL, NULL, NULL, NULL, idx % 3, NULL, NULL FROM positions WHERE idx % 2 = 0
UNION ALL SELECT match_id, idx, t_s, 'leave', account_id, NULL, NULL, NULL, NULL, idx % 3, NULL, NULL FROM positions WHERE idx % 2 > 0
UNION ALL SELECT match_id, idx, t_s, 'phase', NULL, NULL, NULL, NULL, NULL, NULL, idx % 9, CAST(account_id AS VARCHAR) || ',' || CAST(victim_id AS VARCHAR) FROM hits WHERE idx % 5 = 1)
SELECT * EXCLUDE (t_s), {_TICK} FROM u""")
def e2_replay_events(spark, sf, e):
    i, at = F.col("idx"), ("match_id", "idx", "t_s")
    members = F.concat_ws(",", F.col("account_id").cast("string"), F.col("victim_id").cast("string")).alias("members")
    hits, positions = of(e, "hit"), of(e, "position").select(*at, "account_id", (i % 3).alias("vehicle_id"))
    kinds = {
        "kill": of(e, "kill").select(*at, "account_id", "victim_id", F.col("distance").alias("range_cm")),
        "knock": of(e, "knock").select(*at, "account_id", "victim_id"),
        "revive": hits.where(i % 5 == 0).select(*at, "account_id", "victim_id"),
        "crate": of(e, "landing").select(*at, "x", "y"),
        "ride": positions.where(i % 2 == 0),
        "leave": positions.where(i % 2 > 0),
        "phase": hits.where(i % 5 == 1).select(*at, (i % 9).alias("phase"), members),
    }
    return spatial.replay_events(2000, **kinds).drop("t_s")


@query(f"""WITH {EV}, f AS (SELECT match_id, idx, kind, min(idx) OVER (PARTITION BY match_id, kind) AS m FROM ev) SELECT match_id, idx, kind, dense_rank()
OVER (PARTITION BY match_id ORDER BY m, kind) - 1 AS kind_id FROM f""")
def e4_intern(spark, sf, e):
    return spatial.interned(e.select("match_id", "idx", "kind"), "kind", ["match_id"], "idx")


_OBS = """obs AS (SELECT 'm' AS map_name, kind, CAST(account_id % 20 AS STRING) AS account, CASE team_id WHEN 0 THEN 'solo' WHEN 1 THEN '' ELSE 'squad' END AS mode,
'official' AS match_type, match_id AS day, CAST(floor(x / 816000 * 16) AS INTEGER) AS gx, CAST(floor(y / 816000 * 16) AS INTEGER) AS gy FROM ev WHERE kind IN ('kill',
'landing'))"""
_BINS = f"""{_OBS}, bins AS (SELECT map_name, kind, a.a AS account, m.m AS mode, match_type, day, gx, gy, count(*) AS n FROM obs, (SELECT 1 AS one) o,
LATERAL (SELECT unnest(list_distinct([account, ''])) AS a) a, LATERAL (SELECT unnest(list_distinct([mode, ''])) AS m) m GROUP BY ALL)"""


def _bins(e):
    mode = F.when(F.col("team_id") == 0, "solo").when(F.col("team_id") == 1, "").otherwise("squad")
    obs = of(e, "kill", "landing").select(F.lit("m").alias("map_name"), "kind", (F.col("account_id") % 20).cast("string").alias("account"), mode.alias("mode"), F.lit("official").alias("match_type"), F.col("match_id").alias("day"), "x", "y")
    return spatial.heat_bins(obs, 816_000, 16)


@query(f"WITH {EV}, {_BINS} SELECT * FROM bins")
def e5_heat_bins(spark, sf, e):
    return _bins(e)


@query(f"WITH {EV} SELECT match_id, count(*) FILTER (idx % 3 > 0) AS n_used, count(*) FILTER (idx % 3 = 0) AS n_skipped FROM ev WHERE kind = 'position' GROUP BY 1")
def e6_movement(spark, sf, e):
    return spatial.movement(of(e, "position"), norm.is_in_play((F.col("idx") % 3).cast("double")))


@query(f"""WITH {EV}, {_BINS}, s AS (SELECT kind, gx, gy, n FROM bins UNION ALL SELECT kind, gx, gy, -n FROM bins WHERE day <= '2024-01-10' UNION ALL SELECT kind, gx, gy,
n FROM bins WHERE day = '2024-01-10' AND kind = 'kill') SELECT kind, gx, gy, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1, 2, 3 HAVING sum(n) > 0""")
def e7_merged_bins(spark, sf, e):
    b = _bins(e)
    return spatial.merged_bins(b, b.where("day <= '2024-01-10'"), b.where("day = '2024-01-10' and kind = 'kill'"), ["kind", "gx", "gy"])


@query(f"""WITH {EV}, {_OBS}, b AS (SELECT day AS match_id, kind, gx, gy, count(*) AS n FROM obs GROUP BY ALL), old AS (SELECT * FROM b WHERE kind = 'kill'), new AS (SELECT * FROM b WHERE kind = 'landing'),
s AS (SELECT gx, gy, -n AS n FROM old WHERE match_id >= '2024-01-05' UNION ALL SELECT gx, gy, n FROM new WHERE match_id >= '2024-01-05'), d AS (SELECT gx, gy, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1, 2 HAVING sum(n) <> 0)
SELECT 'delta' AS what, gx, gy, n, NULL AS match_id FROM d UNION ALL SELECT DISTINCT 'refused', NULL, NULL, NULL, match_id FROM new WHERE match_id >= '2024-01-05' AND match_id NOT IN (SELECT match_id FROM old WHERE match_id < '2024-01-20')""")
def e7_contributions(spark, sf, e):
    """Kills were counted and landings come in their place from a day on; of the later days the ledger has lost what was counted."""
    b = _bins(e).where("account = '' and mode = ''").groupBy(F.col("day").alias("match_id"), "kind", "gx", "gy").agg(F.sum("n").alias("n"))
    old, new = b.where("kind = 'kill'"), b.where("kind = 'landing' and match_id >= '2024-01-05'")
    deltas = spatial.contribution_deltas(old, new, new, ["gx", "gy"]).withColumn("what", F.lit("delta"))
    refused = spatial.unknown_contributions(new, e.select("match_id").distinct(), old.where("match_id < '2024-01-20'")).withColumn("what", F.lit("refused"))
    return deltas.unionByName(refused, allowMissingColumns=True)


@query(f"""WITH {EV}, {_BINS}, s AS (SELECT kind, gx, gy, n FROM bins UNION ALL SELECT kind, gx, gy, -n FROM bins WHERE day IN ('2024-01-01', '2024-01-02')) SELECT kind,
gx, gy, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1, 2, 3 HAVING sum(n) > 0""")
def e8_delete_matches(spark, sf, e):
    b = _bins(e)
    return spatial.merged_bins(b, b.where("day in ('2024-01-01', '2024-01-02')"), b.where("false"), ["kind", "gx", "gy"])


@query(f"""WITH {EV}, {_BINS}, c AS (SELECT gx, gy, CAST(sum(n) AS BIGINT) AS n FROM bins WHERE kind = 'kill' AND account = '' AND mode = '' AND
day >= '2024-01-05' GROUP BY 1, 2) SELECT *, max(n) OVER () AS peak, CAST(sum(n) OVER () AS BIGINT) AS total FROM c""")
def e9_heatmap(spark, sf, e):
    return spatial.heatmap(_bins(e), "kill", since="2024-01-05", mode="")


def _box(depth: int, src: str) -> str:
    for i in range(depth):
        src = f"(SELECT gx, gy, avg(v) OVER (PARTITION BY gx ORDER BY gy RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM (SELECT gx, gy, avg(v) OVER (PARTITION BY gy ORDER BY gx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM {src}))"
    return src


@query(f"""WITH {EV}, {_BINS}, c AS (SELECT gx, gy, sum(n) AS n FROM bins WHERE kind = 'kill' AND account = '' AND mode = '' GROUP BY 1, 2),
d AS (SELECT CAST(a.i AS INTEGER) AS gx, CAST(b.i AS INTEGER) AS gy, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM range(16) a(i), range(16) b(i) LEFT JOIN c ON c.gx = a.i AND
c.gy = b.i), s AS (SELECT * FROM {_box(3, 'd')}) SELECT gx, gy, round(v, 6) AS v, round(sqrt(v / max(v) OVER ()), 6) AS shade FROM s""")
def e10_density(spark, sf, e):
    c = _bins(e).where("kind = 'kill' and account = '' and mode = ''").groupBy("gx", "gy").agg(F.sum("n").alias("n"))
    return spatial.density(c, 16, 1).select("gx", "gy", F.round("v", 6).alias("v"), F.round("shade", 6).alias("shade"))


_NAMED = """named AS (SELECT e.*, 'm' AS map_name, n_name AS name FROM ev e JOIN nation ON n_nationkey = (CAST(floor(x / 204000) AS INTEGER) + CAST(floor(y / 204000)
AS INTEGER) + CAST(idx % 2 AS INTEGER)) % 25)"""
_GAZ = f"""{_NAMED}, cn AS (SELECT map_name, CAST(floor(x / 816000 * 16) AS INTEGER) AS gx, CAST(floor(y / 816000 * 16) AS INTEGER) AS gy, name, count(*) AS support,
min(idx) AS first FROM named GROUP BY 1, 2, 3, 4), gaz AS (SELECT map_name, gx, gy, name, support, CAST(total AS BIGINT) AS total FROM (SELECT *, sum(support)
OVER (PARTITION BY map_name, gx, gy) AS total FROM cn QUALIFY row_number() OVER (PARTITION BY map_name, gx, gy ORDER BY support DESC, first, name) = 1)
WHERE support >= 5 AND support >= 0.5 * total)"""


def _gazetteer(spark, sf, e):
    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", F.col("n_name").alias("name"))
    key = (F.floor(F.col("x") / 204_000).cast("int") + F.floor(F.col("y") / 204_000).cast("int") + (F.col("idx") % 2).cast("int")) % 25
    return spatial.gazetteer(e.withColumn("map_name", F.lit("m")).join(n, key == F.col("n_nationkey")), 816_000, 16, 5, 0.5)


@query(f"WITH {EV}, {_GAZ} SELECT * FROM gaz")
def e11_gazetteer(spark, sf, e):
    return _gazetteer(spark, sf, e)


@query(f"""{W}, {_GAZ}, pl AS (SELECT name, gx * 51000.0 + 25500 AS px, gy * 51000.0 + 25500 AS py, support FROM gaz), d AS (SELECT l.idx AS point_id, name, support, px, py, l.x - px AS dx, l.y - py AS dy, sqrt((l.x-px)*(l.x-px)+(l.y-py)*(l.y-py)) AS d FROM landings l, pl), b AS (SELECT * FROM d WHERE d <= 150000 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, support DESC, name, px, py) = 1)
SELECT l.idx AS point_id, CASE WHEN d <= 20000 THEN name END AS name, name AS nearest, d, CASE WHEN d IS NOT NULL THEN (['N','NE','E','SE','S','SW','W','NW'])[CAST(((CAST(floor((degrees(atan2(dx, 0 - dy)) + 22.5) / 45) AS INTEGER) % 8) + 8) % 8 AS INTEGER) + 1] END AS bearing FROM landings l LEFT JOIN b ON b.point_id = l.idx""")
def e12_label_points(spark, sf, e):
    places = _gazetteer(spark, sf, e).select("name", (F.col("gx") * 51_000.0 + 25_500).alias("px"), (F.col("gy") * 51_000.0 + 25_500).alias("py"), "support")
    return spatial.label_points(of(e, "landing").select(F.col("idx").alias("point_id"), "x", "y"), places, 20_000, 150_000)


_DROPS = """res2 AS (SELECT match_id, team_id, min(account_id) AS win_place, CAST(count(*) AS BIGINT) AS kills, max(t_s) AS survived_s, list_sort(list_distinct(list('p' || CAST(account_id % 5 AS STRING)))) AS names FROM kills GROUP BY 1, 2),
st AS (SELECT match_id, account_id, CASE WHEN account_id % 4 > 0 THEN max(idx) % 5 END AS hot_drop_n, CAST(min(t_s) AS DOUBLE) AS first_weapon_s FROM hits GROUP BY 1, 2), ls AS (SELECT * FROM landed LEFT JOIN st USING (match_id, account_id)),
g AS (SELECT match_id, team_id, count(*) AS n, sum(land_x) / count(*) AS x, sum(land_y) / count(*) AS y, min(land_t) AS first_t, max(hot_drop_n) AS contested, sum(first_weapon_s) / count(first_weapon_s) AS first_weapon_s FROM ls GROUP BY 1, 2),
sp AS (SELECT g.match_id, g.team_id, max(sqrt((land_x - x) * (land_x - x) + (land_y - y) * (land_y - y))) AS spread FROM g JOIN landed l ON l.match_id = g.match_id AND l.team_id = g.team_id GROUP BY 1, 2),
drops AS (SELECT g.* EXCLUDE (first_weapon_s), CASE WHEN isfinite(first_weapon_s) THEN round(first_weapon_s, 3) END AS first_weapon_s, spread, win_place AS place, kills, survived_s, names FROM g JOIN sp USING (match_id, team_id) LEFT JOIN res2 USING (match_id, team_id))"""


def _drops(e):
    killed = of(e, "kill").select("match_id", "team_id", F.col("account_id").alias("win_place"), F.lit(1).alias("kills"), F.col("t_s").alias("survived_s"), F.concat(F.lit("p"), (F.col("account_id") % 5).cast("string")).alias("name"))
    began = of(e, "hit").groupBy(*M).agg((F.max("idx") % 5).alias("h"), F.min("t_s").cast("double").alias("first_weapon_s"))
    strategy = began.withColumn("hot_drop_n", F.when(F.col("account_id") % 4 > 0, F.col("h")))
    return spatial.squad_drops(landed(e), killed, strategy).withColumn("first_weapon_s", F.round("first_weapon_s", 3))


@query(f"""{W}, {LANDED}, {_DROPS} SELECT match_id, team_id, n, round(x, 3) AS x, round(y, 3) AS y, first_t, round(spread, 3) AS spread, contested, first_weapon_s, place,
CAST(kills AS BIGINT) AS kills, survived_s, names FROM drops""")
def e13_squad_drops(spark, sf, e):
    return _drops(e).withColumns({c: F.round(c, 3) for c in ("x", "y", "spread")})


@query(f"""WITH RECURSIVE {EV}, pt AS (SELECT idx AS point_id, x, y, CAST(floor(x / 40000) AS INTEGER) AS cx, CAST(floor(y / 40000) AS INTEGER) AS cy FROM ev WHERE kind = 'landing'), ce AS (SELECT DISTINCT cx, cy FROM pt),
re AS (SELECT cx AS fx, cy AS fy, cx, cy FROM ce UNION SELECT re.fx, re.fy, ce.cx, ce.cy FROM re JOIN ce ON abs(ce.cx - re.cx) <= 1 AND abs(ce.cy - re.cy) <= 1),
na AS (SELECT fx AS cx, fy AS cy, min(CAST(cx AS VARCHAR) || ',' || CAST(cy AS VARCHAR)) AS cluster FROM re GROUP BY 1, 2) SELECT point_id, x, y, cluster FROM pt JOIN na USING (cx, cy)""")
def e14_cluster_points(spark, sf, e):
    shared = rounds.shared_folder(spark)
    return spatial.cluster_points(of(e, "landing").select(F.col("idx").alias("point_id"), "x", "y"), 40_000, shared)


@query(f"""{W}, {LANDED}, {_DROPS} SELECT CAST(team_id AS STRING) AS cluster, count(*) AS n, quantile_disc(place, 0.5) AS median_place, min(place) AS best_place, sum(survived_s) / count(survived_s) AS mean_survived_s, CAST(sum(kills) AS DOUBLE) / count(*) AS kills_per_drop,
count(contested) AS n_contested_known, count(*) FILTER (contested > 0) / nullif(count(contested), 0) AS contested_rate, quantile_disc(first_weapon_s, 0.5) AS median_first_weapon_s, count(first_weapon_s) AS n_first_weapon_known, count(*) FILTER (spread > 20000) AS n_split FROM drops GROUP BY 1""")
def e15_summarised_clusters(spark, sf, e):
    return spatial.summarised_clusters(_drops(e).withColumn("cluster", F.col("team_id").cast("string")))
