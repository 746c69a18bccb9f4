"""Teammates at a moment against a plain search, with ties, gaps, ends of bins and accounts without samples."""

import math
import random

import pytest

from matchlake.operators import mates, zone


def nearest(samples, account, t, lag):
    own = [s for s in samples if s[1] == account and abs(s[3] - t) <= lag]
    return min(own, key=lambda s: (abs(s[3] - t), s[3] > t, -s[4] if s[3] <= t else s[4]), default=None)


@pytest.mark.parametrize("at_once", [1 << 20, 3])
def test_death_context(spark, monkeypatch, at_once):
    monkeypatch.setattr(mates, "AT_ONCE", at_once)
    r = random.Random(4)
    team = {a: a % 3 for a in range(12)}
    samples = [("m", r.randrange(10), None, r.choice([0, 39, 40, 41, 80, r.randrange(200)]), i, float(r.randrange(900)), float(r.randrange(900)), r.random() < 0.3) for i in range(300)]
    kills = [("m", 1000 + i, r.randrange(13), r.choice([0, 40, 80, 120, r.randrange(220)])) for i in range(60)]
    deaths = {}
    for _, _, v, t in kills:
        deaths[v] = max(t, deaths.get(v, -1))
    roster = spark.createDataFrame([("m", a, t) for a, t in team.items()], "match_id string, account_id int, team_id int")
    track = spark.createDataFrame([(m, a, t, i, x, y, "v" if ride else None) for m, a, _, t, i, x, y, ride in samples], "match_id string, account_id int, t_s int, idx int, x double, y double, riding string")
    k = spark.createDataFrame(kills, "match_id string, idx int, victim_id int, t_s int")
    d = spark.createDataFrame([("m", a, t) for a, t in deaths.items()], "match_id string, account_id int, death_t int")
    got = {x.idx: x for x in zone.death_context(k, roster, track, d, 10).collect()}
    assert set(got) == {i for _, i, v, _ in kills if v in team}
    for _, i, v, t in kills:
        if v not in team:
            continue
        up = [a for a in team if team[a] == team[v] and a != v and (a not in deaths or deaths[a] > t)]
        own = nearest(samples, v, t, 10)
        near = [s for a in up if (s := nearest(samples, a, t, 10))]
        want = min((math.hypot(own[5] - s[5], own[6] - s[6]) for s in near), default=None) if own else None
        x = got[i]
        assert (x.teammates_alive, x.sample_lag, x.in_vehicle) == (len(up), abs(own[3] - t) if own else None, bool(own and own[7]))
        assert x.nearest_teammate is None if want is None else abs(x.nearest_teammate - want) < 1e-9


def test_teammate_spread(spark):
    r = random.Random(7)
    team = {a: a % 2 for a in range(7)}
    samples = [("m" if i % 5 else "n", r.randrange(7), None, r.randrange(100), i, float(r.randrange(500)), 0.0) for i in range(200)]
    track = spark.createDataFrame([(m, a, t, i, x, y, True) for m, a, _, t, i, x, y in samples], "match_id string, account_id int, t_s int, idx int, x double, y double, alive boolean")
    roster = spark.createDataFrame([(m, a, t) for a, t in team.items() for m in "mn"], "match_id string, account_id int, team_id int")
    got = {(x.match_id, x.account_id): x for x in zone.teammate_spread(track, roster, 4, 100.0).collect()}
    n = 0
    for m in "mn":
        rows = [s for s in samples if s[0] == m]
        for a in team:
            d = []
            for s in (s for s in rows if s[1] == a):
                near = [o for b in team if b != a and team[b] == team[a] and (o := nearest(rows, b, s[3], 4))]
                d += [min(math.hypot(o[5] - s[5], o[6] - s[6]) for o in near)] if near else []
            if d:
                x, n = got[m, a], n + 1
                assert x.n_samples == len(d) and abs(x.teammate_dist_avg - sum(d) / len(d)) < 1e-9 and x.teammate_near_pct == sum(v <= 100 for v in d) / len(d)
    assert n == len(got) > 10
