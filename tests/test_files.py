"""Files of hand-made events: reading, bad files, flattening, replacing, and the streaming import."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from matchlake.operators import inventory
from matchlake.sources import files
from matchlake.streaming import jobs


def who(account, **more):
    return {"accountId": account, "name": account.upper(), "teamId": 1, "type": "user", "health": 90.0, "location": {"x": 10.0, "y": -5.0, "z": 0.0}} | more


EVENTS = [
    {"_T": "LogMatchStart", "_D": "2026-01-01T00:00:02.1234567Z", "common": {"isGame": 0}},
    {"_T": "LogPlayerPosition", "_D": "2026-01-01T00:00:01Z", "character": who("a"), "common": {"isGame": 0.10000000149011612}},
    {"_T": "logplayertakedamage", "_D": "2026-01-01T00:00:03Z", "attacker": None, "victim": {"character": who("b")}, "damage": 0},
    {"_T": "LogPlayerTakeDamage", "_D": "2026-01-01T00:00:03Z", "attacker": who("a", location=None), "victim": who("b"), "damage": 12.5, "damageTypeCategory": "Damage_Gun"},
    {"_T": "LogPhaseChange", "_D": "nonsense", "phase": 2, "playersInWhiteCircle": ["a", "b"], "common": {"isGame": 1.5}},
    {"_T": "LogItemAttach", "_D": "2026-01-01T00:00:04Z", "character": who("a"), "parentItem": {"itemId": "gun", "attachedItems": ["z", "s"]}, "childItem": {"itemId": "m"}},
    {"_T": "LogArmorDestroy", "_D": "2026-01-01T00:00:05Z", "victim": who("b"), "item": {"itemId": "Vest_Lv2", "subCategory": "Vest"}},
    {"_T": "LogGameStatePeriodic", "_D": "2026-01-01T00:00:06Z", "gameState": {"safetyZoneRadius": 5.0, "numAliveTeams": 3}},
    {"_T": "LogWhatever"},
]


def land(folder, **matches):
    folder.mkdir(exist_ok=True)
    for name, content in matches.items():
        text = content if isinstance(content, str) else json.dumps(content)
        if name.endswith("_gz"):
            (folder / f"{name[:-3]}.json.gz").write_bytes(gzip.compress(text.encode()))
        else:
            (folder / f"{name}.json").write_text(text)


def test_telemetry(spark, tmp_path):
    land(tmp_path / "in", m1=EVENTS, m2_gz=EVENTS[:2], m3={"not": "a list"}, m4="{broken", m5=[])
    raw = files.raw_files(spark, str(tmp_path / "in"))
    ev = files.telemetry(raw).cache()
    assert {r.match_id: r.n for r in ev.groupBy("match_id").agg(F.count("*").alias("n")).collect()} == {"m1": 9, "m2": 2}
    assert {(r.match_id, r.reason) for r in files.bad_files(raw).collect()} == {("m3", "not a list"), ("m4", "not JSON")}
    one = ev.where("match_id = 'm1'")
    assert [r.idx for r in files.time_sorted(one).orderBy("seq").collect()] == [4, 8, 1, 0, 2, 3, 5, 6, 7]
    got = {(r.idx, r.role, r.account_id, r.x) for r in files.positions(one).collect()}
    assert got == {(1, "character", "a", 10.0), (2, "victim", "b", 10.0), (3, "attacker", "a", 0.0), (3, "victim", "b", 10.0)}
    assert [(r.phase, r.members, r.ts) for r in files.phases(one).collect()] == [(2, ["a", "b"], None)]
    items = {r.idx: r for r in files.item_events(one).collect()}
    assert items[5].item == "gun" and items[5].attached == ["s", "z"] and items[5].child == "m" and items[6].account_id == "b"
    assert [(r.account_id, r.victim_id, r.damage, r.category) for r in files.replay_hits(one).collect()] == [("a", "b", 12.5, "damage_gun")]
    assert [(r.blue_r, r.alive_teams, r.white_r) for r in files.replay_zones(one).collect()] == [(5.0, 3, None)]
    prof = {(r.kind, r.path): r for r in files.profile_schema(one, f"file://{tmp_path}/shared").collect()}
    assert prof["logphasechange", "playersInWhiteCircle[]"].n == 2 and prof["logphasechange", "playersInWhiteCircle[]"]["values"] == ["a", "b"]
    assert prof["logplayertakedamage", "victim.character.location.x"].n == 1


def test_red_zones_and_tables(spark, tmp_path):
    zone = {"zoneType": "RedZone", "zoneState": "Warning", "uniqueId": 7, "position": {"x": 1.0, "y": 2.0}, "horizontalRadius": 3.0}
    land(tmp_path / "in", m1=[{"_T": "LogSpecialZoneInCharacters", "_D": "2026-01-01T00:00:06Z", "zoneInfo": zone}, {"_T": "LogSpecialZoneInCharacters"}])
    found = files.replay_red_zones(files.read_telemetry(spark, str(tmp_path / "in"))).orderBy("idx").collect()
    assert [(r.zone_type, r.state, r.uid, r.x, r.y, r.r) for r in found] == [("RedZone", "warning", 7, 1.0, 2.0, 3.0), (None,) * 6]
    bins = spark.createDataFrame([("m", 1, 5), ("m", 2, 6), ("n", 1, 7)], "map_name string, gx int, n int")
    files.write_table(bins, f"{tmp_path}/bins", "map_name")
    read = spark.read.parquet(f"{tmp_path}/bins")
    assert sorted((r.map_name, r.gx, r.n) for r in read.collect()) == [("m", 1, 5), ("m", 2, 6), ("n", 1, 7)]
    assert {f.rpartition("map_name=")[2][0] for f in read.inputFiles()} == {"m", "n"}


def test_matches(spark, tmp_path):
    person = lambda i, account, kills: {"type": "participant", "id": i, "attributes": {"stats": {"playerId": account, "name": f"n{kills}", "kills": kills, "DBNOs": 1, "damageDealt": 2.5}}}
    doc = {
        "data": {"id": "m1", "attributes": {"mapName": "X", "duration": 1800, "createdAt": "2026-01-01T00:00:00Z", "isCustomMatch": False, "shardId": "s"}},
        "included": [person("p1", "a", 1), person("p2", "b", 2), person("p3", "a", 3), person("p4", "c", 4), {"type": "roster", "id": "r", "attributes": {"won": "true", "stats": {"rank": 1, "teamId": 7}}, "relationships": {"participants": {"data": [{"id": "p1"}, {"id": "p2"}, {"id": "p3"}]}}}, {"type": "asset", "id": "t", "attributes": {"url": "http://x/t.json"}}],
    }
    land(tmp_path / "in", m1=doc, m2="[]", m3="oops")
    t = files.read_matches(spark, str(tmp_path / "in"))
    assert [(r.match_id, r.map_name, r.duration_s, r.is_custom_match, r.telemetry_url) for r in t["matches"].collect()] == [("m1", "X", 1800, False, "http://x/t.json")]
    assert {(r.account_id, r.team_id, r.kills, r.dbnos, r.damage_dealt) for r in t["participants"].collect()} == {("a", 7, 3, 1, 2.5), ("b", 7, 2, 1, 2.5)}
    assert [(r.team_id, r.rank, r.won) for r in t["rosters"].collect()] == [(7, 1, True)]
    assert {(r.account_id, r.name, r.shard) for r in t["accounts"].collect()} == {("a", "n3", "s"), ("b", "n2", "s")}
    known = spark.createDataFrame([("m1",)], "match_id string")
    assert {r.match_id for r in files.unimported(spark, str(tmp_path / "in"), known).collect()} == {"m2", "m3"}
    land(tmp_path / "who", list={"data": [{"id": "a", "attributes": {"name": "A"}, "relationships": {"matches": {"data": [{"id": "m1"}, {"id": "m2"}]}}}, {"id": "b", "attributes": {"name": "B"}}]})
    assert {tuple(r) for r in files.read_player_listing(spark, str(tmp_path / "who")).collect()} == {("a", "A", "m1"), ("a", "A", "m2"), ("b", "B", None)}


def test_replaced_matches(spark, tmp_path):
    day = lambda n: dt.date(2026, 1, n)
    rows = lambda *x: spark.createDataFrame(x, "match_id string, v int, match_day date")
    at = f"{tmp_path}/t"
    read = lambda: {(r.match_id, r.v, r.match_day) for r in spark.read.parquet(at).collect()}
    files.replace_matches(rows(("a", 1, day(1)), ("a", 2, day(1)), ("b", 3, day(1)), ("c", 4, day(2))), rows(("a", 0, day(1)), ("b", 0, day(1)), ("c", 0, day(2))), at)
    untouched = {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "match_day=2026-01-02").iterdir()}
    files.replace_matches(rows(("a", 9, day(1))).where("v < 0"), rows(("a", 0, day(1))), at)
    assert read() == {("b", 3, day(1)), ("c", 4, day(2))}
    for _ in range(2):  # a repeated run
        files.replace_matches(rows(("a", 5, day(1))), rows(("a", 0, day(1))), at)
        assert read() == {("a", 5, day(1)), ("b", 3, day(1)), ("c", 4, day(2))}
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "match_day=2026-01-02").iterdir()} == untouched
    # the last match of a day goes
    files.replace_matches(rows(("c", 0, day(2))).where("false"), rows(("c", 0, day(2))), at)
    assert read() == {("a", 5, day(1)), ("b", 3, day(1))} and not list((tmp_path / "t-staged").iterdir())


def test_streamed_import(spark, tmp_path):
    inbox, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    land(tmp_path / "in", m1=EVENTS, m2=EVENTS[:2], m3="{broken")
    jobs.stream_matches(spark, inbox, out, state).awaitTermination()
    land(tmp_path / "in", m4=EVENTS[:3])
    land(tmp_path / "in", m2_gz=EVENTS)  # comes under another name, but the match is known
    jobs.stream_matches(spark, inbox, out, state).awaitTermination()
    events = spark.read.parquet(f"{out}/events")
    assert {tuple(r) for r in events.groupBy("match_id").agg(F.count("*").alias("n")).collect()} == {("m1", 9), ("m2", 2), ("m4", 3)}
    assert {str(r.match_day) for r in events.select("match_day").distinct().collect()} == {"2026-01-01"}
    expected = spark.createDataFrame([("m1",), ("m9",), ("m8",), ("m3",)], "match_id string")
    report = jobs.import_report(spark, out, expected).first()
    assert report.asDict() == {"seen": 5, "ingested": 3, "failed": 1, "known": 1, "missing": 2}
    assert jobs.import_report(spark, out).first().missing == 0


def test_derived_again(spark, tmp_path):
    src, out, state = str(tmp_path / "ev"), str(tmp_path / "out"), str(tmp_path / "state")
    day = lambda n: dt.date(2026, 1, n)
    schema = "match_id string, match_day date, v int"
    put = lambda *x: spark.createDataFrame(x, schema).write.mode("append").parquet(src)
    count = lambda e: e.groupBy("match_id", "v").agg(F.count("*").alias("n"))
    run = lambda: jobs.stream_bins(spark.readStream.schema(schema).parquet(src), count, ["v"], out, state).awaitTermination()
    put(("a", day(1), 1), ("a", day(1), 2), ("b", day(1), 1), ("c", day(2), 7))
    run()
    assert {tuple(r) for r in jobs.total_bins(spark, out, ["v"]).collect()} == {(1, 2), (2, 1), (7, 1)}
    stamp = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "out" / "totals").rglob("part-*")}
    before = stamp()
    put(("a", day(1), 1))
    run()
    assert {tuple(r) for r in jobs.total_bins(spark, out, ["v"]).collect()} == {(1, 3), (2, 1), (7, 1)}
    after = stamp()
    assert len(set(before) - set(after)) == 1, "one cell changed, so one folder is written"
    whole = jobs.touched_events(spark, f"{out}/bronze", spark.createDataFrame([("a", day(1))], "match_id string, match_day date"))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert whole.count() == 3 and "PartitionFilters: [" in plan and "match_day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # a batch that is repeated changes nothing
    deltas = spark.createDataFrame([(1, 5)], "v int, n bigint")
    for _ in range(2):
        jobs.add_to_totals(deltas, f"{out}/totals", ["v"], 77)
        assert {tuple(r) for r in jobs.total_bins(spark, out, ["v"]).collect()} == {(1, 8), (2, 1), (7, 1)}
    # what was counted of c is lost: refused, and nothing changes
    files.remove(spark, f"{out}/ledger/match_day=2026-01-02")
    put(("c", day(2), 7))
    with pytest.raises(Exception, match="isn't known: c"):
        run()
    assert {tuple(r) for r in jobs.total_bins(spark, out, ["v"]).collect()} == {(1, 8), (2, 1), (7, 1)}


def test_slots(spark):
    rows = [
        (0, "equip", 0, "gun", None, []), (1, "equip", 0, "rifle", None, []), (2, "attach", None, "gun", "scope", []),
        (3, "unequip", 0, "rifle", None, []), (4, "detach", None, "bow", "sight", ["sight", "sight"]), (5, "unequip", 0, "gun", None, ["scope"]),
        (6, "equip", 6, "vest", None, None), (7, "destroy", 6, "vest", None, None), (8, "equip", None, "odd", None, None), (9, "clear", None, None, None, None),
    ]
    df = spark.createDataFrame([("m", "a", i, i, *r) for i, *r in rows], "match_id string, account_id string, idx long, t_ms long, op string, slot int, item string, child string, before array<string>")
    got = {r.idx: (r.slot, r.attached, r.loose) for r in inventory.placed(df).collect()}
    assert got == {0: (0, [], -1), 1: (1, [], -1), 2: (0, ["scope"], 0), 3: (1, [], 1), 4: (None, ["sight"], 1), 5: (0, ["scope"], 1), 6: (6, [], -1), 7: (6, [], 0), 9: (None, [], 0)}


def test_stacks_follow_each_step(spark):
    import random

    r = random.Random(3)
    rows = [("m", "a", str(r.randrange(3)), i, r.choice(["add", "remove", "remove", "set"]), r.randrange(4)) for i in range(400)]
    held, want = {}, []
    for _, _, item, i, op, q in rows:
        held[item] = q if op == "set" else held.get(item, 0) + q if op == "add" else max(0, held.get(item, 0) - q)
        want.append((i, held[item]))
    df = spark.createDataFrame(rows, "match_id string, account_id string, item string, idx int, op string, quantity int")
    assert sorted((x.idx, x.stack) for x in inventory.stacks(df).collect()) == want
