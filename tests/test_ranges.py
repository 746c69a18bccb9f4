"""Sequences that are cut into ranges, against plain Python: one key with most rows, ends of ranges, repeated batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from matchlake.operators import careers, temporal, tracks
from matchlake.streaming import jobs


@pytest.mark.parametrize("n", [1, 3, 40])
def test_ranges(spark, n):
    r = random.Random(n)
    rows = [(r.choice("abcc"), r.randrange(50) if r.random() < 0.95 else None, i) for i in range(400)]
    got = temporal.ranged(spark.createDataFrame(rows, "k string, t int, i int"), ["k", "t", "i"], n).collect()
    key = lambda x: (x.k, x.t is not None, x.t or 0, x.i)
    ranges = [x._range for x in sorted(got, key=key)]
    assert ranges == sorted(ranges) and len(got) == 400 and len(set(ranges)) <= n and (n < 3 or len(set(ranges)) > 1)


def test_long_gap_segments(spark):
    r = random.Random(2)
    t, rows = 0, []
    for i in range(500):
        t += r.choice([0, 1, 5, 10, 10, 11, 30])
        rows.append((t, i))
    shuffled = r.sample(rows, len(rows))
    got = {(x.t, x.i): x.segment for x in temporal.long_gap_segments(spark.createDataFrame(shuffled, "t int, i int"), "t", 10, ["i"]).collect()}
    seg, want = 0, {}
    for j, (t, i) in enumerate(rows):
        seg += j > 0 and t - rows[j - 1][0] > 10
        want[t, i] = seg
    assert got == want and seg > 50
    none = spark.createDataFrame([], "t int, i int")
    assert temporal.long_gap_segments(none, "t", 10, ["i"]).count() == 0


def test_squad_sessions(spark):
    """Evenings, one of them across midnight and longer than any range of times, with matches of several members."""
    at = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    hours = [0, 0.5, 9, 9.1, *(20 + i / 2 for i in range(60)), 60]
    rows = []
    for m, h in enumerate(hours):
        for who in range(1 + m % 3):
            rows.append((m, at(h), None if m == 1 else 1 + (m + who) % 30, m % 5, None if m % 2 else m % 4, 10.0 if who else None, 2.5 if m != 3 else None))
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "match_id long, played_at timestamp, win_place int, kills int, kills_human int, death_t double, damage_dealt double")
    got = {x.evening: x for x in careers.squad_sessions(df).collect()}
    assert sorted(got) == [0, 1, 2, 3] and [got[i].matches for i in range(4)] == [1, 60, 2, 2]
    own = [m for m in range(4, 64)]
    mine = [x for x in rows if x[0] in own]
    places = {m: min(x[2] for x in mine if x[0] == m) for m in own}
    long = got[1]
    assert (long.started, long.ended) == (at(20), at(49.5)) and long.places == [places[m] for m in reversed(own)]
    assert (long.best_place, long.wins, long.top10) == (min(places.values()), list(places.values()).count(1), sum(p <= 10 for p in places.values()))
    assert long.kills == sum(x[4] if x[4] is not None else x[3] for x in mine) and long.deaths == sum(x[5] is not None for x in mine)
    assert long.damage == sum(x[6] or 0 for x in mine) and got[3].places == [0, 1]


def plain_alerts(rows, state):
    out = []
    for kind, t, i, ok in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        opened, n = state.get(kind, (None, 0))
        if not ok:
            state[kind] = (opened if n else t, n + 1)
            out.append((kind, i, "refresh" if n else "open", state[kind][0], t, n + 1))
        elif n:
            del state[kind]
            out.append((kind, i, "resolve", opened, t, n))
    return out


@pytest.mark.parametrize("fail", [0.1, 0.5, 0.97])
def test_alerts(spark, fail):
    """One kind has nine tenths of the rows; runs of failures go on over many ranges and batches."""
    r = random.Random(5)
    state = {}
    held = spark.createDataFrame([], jobs.OPEN)
    for batch in range(3):
        rows = [("hot" if r.random() < 0.9 else r.choice("ab"), 1000 * batch + r.randrange(300), 1000 * batch + i, r.random() > fail) for i in range(300)]
        df = spark.createDataFrame(rows, "kind string, t_s bigint, idx bigint, ok boolean").repartition(3)
        events, held = careers.alert_events(df, held)
        want = plain_alerts(rows, state)
        assert sorted(tuple(x) for x in events.select("kind", "idx", "event", "opened", "last_seen", "observations").collect()) == sorted(want)
        held = spark.createDataFrame(held.collect(), jobs.OPEN)
        assert {x.kind: (x.opened, x.n) for x in held.collect()} == state
        resolved = [(kind, opened, n, t) for kind, _, event, opened, t, n in plain_alerts(rows, {}) if event == "resolve"]
        folded = careers.folded_alerts(df).collect()
        assert sum(x.observations for x in folded) == sum(not x[3] for x in rows)
        assert sorted((x.kind, x.opened, x.observations, x.resolved) for x in folded if x.resolved is not None) == sorted(resolved)


def test_live_alerts_go_on_over_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "kind string, t_s bigint, idx bigint, ok boolean"
    state, want = {}, []
    for batch in ([("a", 1, 1, False), ("b", 1, 2, True)], [("a", 2, 3, False)], [("a", 3, 4, True), ("b", 3, 5, False)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        want += plain_alerts(batch, state)
        jobs.live_alerts(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "state")).awaitTermination()
    got = spark.read.schema(jobs.ALERT).parquet(f"{out}/events")
    assert sorted(tuple(x) for x in got.select("kind", "idx", "event", "opened", "last_seen", "observations").collect()) == sorted(want)


def test_nothing_looks_ahead_to_a_keys_end(spark):
    """Spark goes through a frame that ends with the key anew for each row, so looking ahead takes the turned order."""
    rows = [("k", i, i, i % 9 == 0, "m", 1, i) for i in range(60)]
    df = spark.createDataFrame(rows, "kind string, t_s long, idx long, ok boolean, match_id string, account_id long, probe_id long")
    folded = careers.folded_alerts(df)
    near = [temporal.asof(df, df, ["kind"], "t_s", ["idx"], d, ["idx"]) for d in ("forward", "nearest")]
    between = temporal.interpolated(df, df, ["kind"], "t_s", ["idx"])
    step = tracks.step_fight(df, df.withColumnRenamed("t_s", "t_start"), ["kind"])
    assert not any("unboundedfollowing" in x._jdf.queryExecution().toString().lower() for x in (folded, *near, between, step))
    assert [(x.opened, x.last_seen, x.observations, x.resolved) for x in folded.orderBy("opened").collect()][-2:] == [(46, 53, 8, 54), (55, 59, 5, None)]
    assert {(x.t_s, x.next_t, x.prev_t) for x in step.join(df.select("probe_id", "t_s"), "probe_id").collect()} == {(i, i + 2 if i < 58 else None, i - 2 if i > 1 else None) for i in range(60)}


def test_equal_times_ahead(spark):
    """Among samples of one time ahead the first by tie is the next one, a null tie before all others."""
    probes = spark.createDataFrame([("k", 5), ("k", 6), ("k", 8)], "k string, t long")
    samples = spark.createDataFrame([("k", 6, 2), ("k", 6, 1), ("k", 7, 4), ("k", 7, None), ("k", 5, 9)], "k string, t long, i long")
    got = temporal.asof(probes, samples, ["k"], "t", ["i"], "forward", ["i"]).collect()
    assert {(x.t, x.s_t, x.s_i) for x in got} == {(5, 5, 9), (6, 6, 1), (8, None, None)}
    later = temporal.asof(probes.where("t = 6").withColumn("t", F.lit(7).cast("long")), samples, ["k"], "t", ["i"], "forward", ["i"]).collect()
    assert [(x.s_t, x.s_i) for x in later] == [(7, None)]
