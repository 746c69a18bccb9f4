"""Folds and iterations that SQL doesn't express, against plain Python."""

import random

from matchlake.operators import inventory, spatial, tracks


def test_heal_thinned(spark):
    r = random.Random(1)
    rows = [("m", a, i, i // 2, r.random() < 0.8, float(r.randrange(100))) for a in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "match_id string, account_id bigint, idx bigint, t_s bigint, is_heal boolean, health double")
    want = set()
    for a in range(3):
        last = None
        for _, _, i, _, heal, health in sorted((x for x in rows if x[1] == a), key=lambda x: (x[3], x[2])):
            if not heal or last is None or abs(health - last) >= 5:
                want.add((a, i))
                last = health
    assert {(x.account_id, x.idx) for x in tracks.heal_thinned(df).collect()} == want


def test_care_packages(spark, tmp_path):
    spawns = [("m", 1, 0, 0.0, 0.0), ("m", 2, 0, 0.0, 0.0), ("m", 9, 9, 5.0, 5.0)]
    lands = [("m", 3, 5, 10.0, 0.0), ("m", 4, 6, 0.0, 0.0), ("m", 5, 7, 0.0, 0.0), ("m", 10, 9, 9e9, 0.0)]
    cols = "match_id string, idx bigint, t_s bigint, x double, y double"
    got = tracks.care_packages(spark.createDataFrame(spawns, cols), spark.createDataFrame(lands, cols), f"file://{tmp_path}").collect()
    assert {(x.land_idx, x.spawn_idx) for x in got} == {(3, 1), (4, 2), (5, None), (10, None)}


def test_greedy_claims(spark, tmp_path):
    """Chains of claims that wait for each other, ties and matches apart, against the plain greedy; nothing but the result stays."""
    r = random.Random(9)
    pairs = [("chain", i, j, float(abs(i - j))) for i in range(8) for j in range(max(0, i - 2), i + 1)] + [("none", 1, 1, 0.0)]
    pairs += [(m, i, j, float(r.randrange(4))) for m in "ab" for i in range(40) for j in r.sample(range(30), r.randrange(4))]
    want = set()
    for m in {p[0] for p in pairs}:
        taken = set()
        for i in sorted({p[1] for p in pairs if p[0] == m}):
            free = sorted((d, j) for k, x, j, d in pairs if k == m and x == i and j not in taken)
            if free:
                taken.add(free[0][1])
                want.add((m, i, free[0][1]))
    df = spark.createDataFrame(pairs, "m string, i int, j int, d double")
    got = tracks.greedy_claims(df, ["m"], "i", "j", "d", f"file://{tmp_path}")
    assert {tuple(x) for x in got.collect()} == want and len(got.collect()) == len(want)
    assert [x.name[:11] for x in tmp_path.iterdir()] == ["claims-kept"]
    assert tracks.greedy_claims(df.where("false"), ["m"], "i", "j", "d", f"file://{tmp_path}").count() == 0


def test_cluster_points(spark, tmp_path):
    r = random.Random(4)
    pts = [(i, r.random() * 3000, r.random() * 3000) for i in range(220)]
    cell = {i: (int(x // 100), int(y // 100)) for i, x, y in pts}
    todo, label = set(cell.values()), {}
    while todo:
        group, edge = set(), [todo.pop()]
        while edge:
            c = edge.pop()
            group.add(c)
            near = {(c[0] + i, c[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & todo
            todo -= near
            edge += near
        label |= {c: min(f"{a},{b}" for a, b in group) for c in group}
    got = spatial.cluster_points(spark.createDataFrame(pts, "point_id bigint, x double, y double"), 100.0, f"file://{tmp_path}").collect()
    assert {x.point_id: x.cluster for x in got} == {i: label[c] for i, c in cell.items()}


def no_call_a_key(df):
    """The plan has no call for each key; batches of three rows, so that keys go on over several."""
    return "FlatMapGroups" not in df._jdf.queryExecution().toString()


def test_heal_thinned_by_batches(spark):
    r = random.Random(2)
    rows = [(m, a, i, i, r.random() < 0.8, float(r.randrange(20)) if r.random() < 0.97 else None) for m in ("m", None) for a in (1, 2, None) for i in range(r.randrange(1, 12))]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "match_id string, account_id bigint, idx bigint, t_s bigint, is_heal boolean, health double")
    want, last = set(), {}
    for m, a, i, _, heal, health in rows:
        health = float("nan") if health is None else health
        if not heal or (m, a) not in last or abs(health - last[m, a]) >= 5:
            want.add((m, a, i))
            last[m, a] = health
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = tracks.heal_thinned(df)
        assert no_call_a_key(got) and {(x.match_id, x.account_id, x.idx) for x in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_placed_by_batches(spark):
    """A second main weapon, an attachment that stays with its item, an unequip where the item is held, a clear; accounts apart."""
    acts = [("equip", 0, "a", []), ("equip", 0, "b", []), ("attach", None, "b", []), ("unequip", 0, "b", ["s"]), ("attach", None, "b", []), ("detach", None, "a", ["s"]), ("clear", None, None, None), ("unequip", 0, "a", [])]
    want = [(0, [], -1), (1, [], -1), (1, ["s"], 0), (1, ["s"], 1), (None, ["s"], 1), (None, [], 1), (None, [], 0), (0, [], 1)]
    rows = [("m", a, i, i, op, slot, item, "s", before) for a in range(50) for i, (op, slot, item, before) in enumerate(acts)]
    df = spark.createDataFrame(random.Random(3).sample(rows, len(rows)), "match_id string, account_id bigint, idx bigint, t_ms bigint, op string, slot int, item string, child string, before array<string>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = inventory.placed(df)
        assert no_call_a_key(got) and {(x.account_id, x.idx): (x.slot, x.attached, x.loose) for x in got.collect()} == {(a, i): w for a in range(50) for i, w in enumerate(want)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_care_packages_in_a_crowd(spark):
    """Many spawns and landings at few and at many places, ties and gaps, against the plain greedy; no rounds, no pairs."""
    r = random.Random(5)
    rows = [(m, i, i, r.random() < 0.5, float(r.randrange(*span)), float(r.randrange(*span))) for m, span in (("a", (0, 400)), ("b", (-3, 3)), ("c", (0, 4000))) for i in range(400)]
    rows += [("a", 900, 1, True, None, 5.0), ("a", 901, 1, False, 5.0, None), (None, 1, 1, True, 0.0, 0.0), (None, 2, 1, False, 0.0, 0.0)]
    want, free = {}, []
    for m, i, _, is_spawn, x, y in rows:
        if is_spawn:
            free.append((m, i, x, y))
            continue
        near = [(((x - s[2]) ** 2 + (y - s[3]) ** 2) ** 0.5, s[1], s) for s in free if s[0] == m and m and None not in (x, s[2]) and None not in (y, s[3])]
        best = min([n for n in near if n[0] <= 50], default=None)
        want[m, i] = best and best[1]
        if best:
            free.remove(best[2])
    df = spark.createDataFrame(rows, "match_id string, idx bigint, t_s bigint, is_spawn boolean, x double, y double")
    got = tracks.care_packages(df.where("is_spawn"), df.where("not is_spawn"), within=50.0)
    assert "Join" not in got._jdf.queryExecution().toString()
    assert {(x.match_id, x.land_idx): x.spawn_idx for x in got.collect()} == want


def test_crate_loot(spark):
    """Crowds and far places, ties and places with several crates, against all pairs; pickups meet crates by squares only."""
    r = random.Random(6)
    rows = [(m, i, i, r.random() < 0.5, float(r.choice((r.randrange(40), r.randrange(-600, 600)))), float(r.randrange(60))) for m in "ab" for i in range(300)]
    rows += [("a", 900, 1, True, None, 5.0), ("a", 901, 1, False, 5.0, None)]
    want = {}
    for m, i, t, is_crate, x, y in rows:
        near = [(((x - c[4]) ** 2 + (y - c[5]) ** 2) ** 0.5, c[1]) for c in rows if c[3] and c[0] == m and None not in (x, y, c[4])] if not is_crate else []
        d, crate = min(near, default=(100, None))
        if d < 100:
            first, n = want.get((m, crate), (t, 0))
            want[m, crate] = (min(first, t), n + 1)
    df = spark.createDataFrame(rows, "match_id string, idx bigint, t_s bigint, is_crate boolean, x double, y double")
    got = tracks.crate_loot(df.where("not is_crate"), df.where("is_crate"), ["match_id"], 100.0)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert all("gx" in x for x in plan.splitlines() if "Join" in x)
    assert {(x.match_id, x.crate_idx): (x.looted_t, x.n_pickups) for x in got.collect()} == want
