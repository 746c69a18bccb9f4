"""Fights of a stream against the batch operators over the same events."""

import datetime as dt
import random

from pyspark.sql import functions as F

from matchlake.operators import combat
from matchlake.streaming import fights, jobs

EPOCH = dt.datetime(2026, 1, 1)


def events(seed, n):
    r, t, out = random.Random(seed), 0.0, []
    for i in range(n):
        t += r.choice([0, 0.001, 1, 5, 20, 20.001, 21, 60])
        a = r.randrange(3)
        b = (a + 1 + r.randrange(2)) % 3
        out.append((r.choice("mn"), i, round(t, 3), r.choice(["hit", "hit", "knock", "kill", "kill"]), a, b, r.randrange(6) * 3 + b, 1.5))
    return out


SCHEMA = "match_id string, idx bigint, t_s double, kind string, team_id int, victim_team int, victim_id bigint, damage double"


def batch(spark, rows, gap, slack):
    e = spark.createDataFrame(rows, SCHEMA)
    blows = combat.segments(e.where("kind <> 'kill'"), gap)
    spans = combat.segment_spans(blows)
    kills = combat.attach_kills(e.where("kind = 'kill'"), spans, e.where("kind = 'knock'"), gap, slack)
    n = {tuple(x)[:4]: (x.t_start, x.t_end, x.hits, x.knocks) for x in blows.groupBy("match_id", "team_a", "team_b", "segment").agg(F.min("t_s").alias("t_start"), F.max("t_s").alias("t_end"), F.count_if(F.col("kind") == "hit").alias("hits"), F.count_if(F.col("kind") == "knock").alias("knocks")).collect()}
    return n, {x.idx: (x.rule, x.segment) for x in kills.select("idx", "rule", "segment").collect()}


def test_settle_in_any_steps(spark):
    """However often it looks, the result is that of the batch operators."""
    rows, gap, slack = events(3, 600), 20, 0.002
    want, attached = batch(spark, rows, gap, slack)
    us = lambda t: round(t * 1e6)
    r = random.Random(1)
    got, kills, most = {}, {}, 0
    for key in {k[:3] for k in want} | {(x[0], min(x[4:6]), max(x[4:6])) for x in rows}:
        own = [x for x in rows if (x[0], min(x[4:6]), max(x[4:6])) == key]
        held, i, now = fights.Held([], [], [], [], 0), 0, 0
        while now < us(rows[-1][2] + 100):
            now += us(r.choice([1, 5, 30, 200]))
            while i < len(own) and us(own[i][2]) < now + us(15):  # rows come up to 15 seconds before the watermark reaches them
                _, idx, t, kind, _, _, victim, damage = own[i]
                held = held._replace(kills=[*held.kills, (us(t), idx, victim)]) if kind == "kill" else held._replace(blows=[*held.blows, (us(t), idx, kind, damage, victim)])
                i += 1
            out, held, again = fights.settle(held, now, us(gap), us(slack))
            assert again is None or again >= now
            most = max(most, len(held.spans))
            for x in out:
                if x["event"] == "kill":
                    kills[x["idx"]] = (x["rule"], x["segment"])
                else:
                    got[*key, x["segment"]] = (x["began"] / 1e6, x["ended"] / 1e6, x["hits"], x["knocks"])
        assert again is None and not held.blows and not held.kills
    assert got == want and kills == attached and {x[0] for x in kills.values()} == {1, 2, 3, None} and most < 10


def test_live_fights(spark, tmp_path):
    """A real stream in several batches: all that has passed the watermark, and nothing else."""
    rows, gap = events(5, 400), 20
    want, attached = batch(spark, rows, gap, 0.002)
    src = str(tmp_path / "in")
    found = None
    for i in range(0, 400, 100):
        made = [(*x, EPOCH + dt.timedelta(seconds=x[2])) for x in rows[i : i + 100]]
        spark.createDataFrame(made, SCHEMA + ", ts timestamp").coalesce(1).write.mode("append").parquet(src)
        live = spark.readStream.schema(SCHEMA + ", ts timestamp").parquet(src)
        with jobs.state_in_rocksdb(spark):
            found = jobs.drained(fights.live_fights(combat.paired(live), "ts", gap, "30 seconds"), str(tmp_path / "out"))
    now = rows[-1][2] - 30
    base = round((EPOCH - dt.datetime(1970, 1, 1)).total_seconds())
    got = {(x.match_id, x.team_a, x.team_b, x.segment): (round(x.began / 1e6 - base, 3), round(x.ended / 1e6 - base, 3), x.hits, x.knocks) for x in found.where("event = 'fight'").collect()}
    assert got == {k: v for k, v in want.items() if v[1] + gap < now} and len(got) > 40
    when = {x[1]: x[2] for x in rows}
    kills = {x.idx: (x.rule, x.segment) for x in found.where("event = 'kill'").collect()}
    assert kills == {i: v for i, v in attached.items() if when[i] + gap + 0.002 < now} and len(kills) > 50
    total = fights.with_kills(found).agg(F.sum("kills")).first()[0]
    assert total == sum((x.match_id, x.team_a, x.team_b, x.segment) in got for x in found.where("event = 'kill' and rule is not null").collect())
