"""Joins over cells of space and time against all pairs, with rows on the cells' borders."""

import math
import random

import pytest

from matchlake.operators import careers, spatial, tracks, zone


@pytest.mark.parametrize("before,after", [(10, 10), (10, 0), (0, 7), (0, 0)])
def test_near_in_space_and_time(spark, before, after):
    r = random.Random(1)
    on = lambda size: r.choice([-size, 0, size, 2 * size, -0.5, size - 0.5, r.uniform(-3 * size, 3 * size)])
    rows = [(r.choice("ab"), i, float(on(100)), float(on(100)), int(on(10))) for i in range(150)] + [("a", 900, None, 1.0, 1), ("a", 901, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "m string, i int, x double, y double, t int")
    got = sorted((p.i, p.o_i) for p in spatial.near_in_space_and_time(df, df, ["m"], ("x", "y"), "t", 100.0, before, after).collect())
    known = [p for p in rows if None not in p]
    want = sorted((a[1], b[1]) for a in known for b in known if a[0] == b[0] and math.hypot(a[2] - b[2], a[3] - b[3]) <= 100 and -before <= b[4] - a[4] <= after)
    assert got == want and len(want) > len(known) / 2


def test_hot_drops_and_third_parties(spark):
    lands = [("m", 1, 1, 0, 0.0, 0.0), ("m", 2, 2, 60, 200.0, 0.0), ("m", 3, 2, 61, 0.0, 0.0), ("m", 4, 1, 0, 1.0, 0.0), ("n", 5, 9, 0, 0.0, 0.0), ("m", 6, 3, -60, -200.0, 0.0)]
    df = spark.createDataFrame(lands, "match_id string, account_id int, team_id int, land_t int, land_x double, land_y double")
    assert {x.account_id: x.hot_drop_n for x in zone.hot_drop(df, 200, 60).collect()} == {1: 2, 2: 2, 3: 0, 4: 1, 5: 0, 6: 1}
    kills = [("m", 1, 0, 5, 6, 0.0, 0.0), ("m", 2, 30, 1, 2, 200.0, 0.0), ("m", 3, 31, 1, 2, 0.0, 0.0), ("m", 4, 31, 1, 5, 0.0, 0.0), ("m", 5, 40, None, 2, 0.0, 0.0)]
    df = spark.createDataFrame(kills, "match_id string, idx int, t_s int, team_id int, victim_team int, x double, y double")
    assert {x.victim_team: (x.deaths, x.third_party) for x in careers.third_party_deaths(df, 200, 30).collect()} == {6: (1, 0), 2: (3, 1), 5: (1, 0)}


def test_trail_over_bins(spark):
    r = random.Random(3)
    track = [("m", r.randrange(2), i, r.choice([-10, 0, 10, 20, r.randrange(60)]), float(i), 0.0) for i in range(80)]
    probes = [(i, "m", r.randrange(3), r.choice([0, 10, 20, 30, r.randrange(70)])) for i in range(40)]
    df = spark.createDataFrame(track, "match_id string, account_id int, idx bigint, t_s int, x double, y double")
    p = spark.createDataFrame(probes, "probe_id int, match_id string, account_id int, t_s int")
    dead = spark.createDataFrame([("m", 1, 45)], "match_id string, account_id int, death_t int")
    got = sorted((x.probe_id, x.idx) for x in tracks.trail(p, df, dead, 10).collect() if x.idx is not None)
    assert got == sorted((i, s[2]) for i, _, a, t in probes for s in track if s[1] == a and t - 10 <= s[3] <= t and not (a == 1 and t >= 45))
