"""Rotations against plain Python, and metrics that meet in one grouping."""

import random

from matchlake.operators import zone

TRACK = "match_id string, account_id long, idx long, t_s long, x double, y double, alive boolean"


def test_rotate_lag(spark, monkeypatch):
    """Circles of several radii, accounts with few and many samples, matches with only one side; no pair of sample and circle is a row."""
    r = random.Random(8)
    track = [(m, a, i, r.randrange(100), float(r.randrange(90)), float(r.randrange(90)), r.random() < 0.9) for m in ("a", "b", "only samples", None) for a in range(12) for i in range(r.choice((1, 2, 25)))]
    circles = [(m, i, r.randrange(90), float(r.randrange(90)), float(r.randrange(90)), float(r.choice((0, 10, 40)))) for m in ("a", "b", "only circles", None) for i in range(30)] + [("a", 99, 1, None, 0.0, 9.0)]
    landed = [(m, a, r.randrange(60)) for m in ("a", "b", "only samples", None) for a in range(10)]
    first = {}
    for m, a, _, t, x, y, alive in sorted((x for x in track if x[0]), key=lambda s: s[3]):
        land = next((q[2] for q in landed if q[:2] == (m, a)), None)
        for n, i, announced, zx, zy, zr in circles:
            if n == m and zx is not None and alive and land is not None and t >= max(land, announced) and ((x - zx) ** 2 + (y - zy) ** 2) ** 0.5 <= zr:
                first.setdefault((m, a), {}).setdefault(i, t - max(land, announced))
    want = {k: (sum(v.values()) / len(v), len(v)) for k, v in first.items()}
    monkeypatch.setattr(zone, "AT_ONCE", 60)
    got = zone.rotate_lag(spark.createDataFrame(track, TRACK), spark.createDataFrame(circles, "match_id string, idx long, t_s long, zx double, zy double, zr double"), spark.createDataFrame(landed, "match_id string, account_id long, land_t long"))
    assert got._jdf.queryExecution().sparkPlan().toString().count("Join") == 1  # samples with landings
    assert {(x.match_id, x.account_id): (x.rotate_lag_s, x.n_circles) for x in got.collect()} == want and len(want) > 10


def test_strategy_metrics_without_joins(spark):
    roster = spark.createDataFrame([("m", 1), ("m", 2), ("m", None)], "match_id string, account_id long")
    a = spark.createDataFrame([("m", 1, 5), ("m", 3, 6), ("m", None, 7)], "match_id string, account_id long, a int")
    b = spark.createDataFrame([("m", 2, "x"), ("m", 1, None)], "match_id string, account_id long, b string")
    got = zone.strategy_metrics(roster, a, b)
    assert "Join" not in got._jdf.queryExecution().toString()
    assert {tuple(x) for x in got.collect()} == {("m", 1, 5, None), ("m", 2, None, "x"), ("m", None, None, None)} and got.columns == ["match_id", "account_id", "a", "b"]
