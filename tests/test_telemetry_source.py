"""The streaming source against whole parses: cuts at any place, bad files, kinds pushed down, bounded memory."""

import gzip
import json
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from matchlake.sources import files, telemetry_source
from test_files import EVENTS, land


def cut(text, r):
    while text:
        n = r.randrange(1, 9)
        yield text[:n]
        text = text[n:]


def test_elements_at_any_cut():
    r = random.Random(1)
    for _ in range(150):
        value = r.choice([[], [1], [12, -3.5e2, "a\"],[", {"x": [1, {"y": "}é"}]}, None, True], EVENTS, [[], [[]], {}]])
        text = r.choice(["", "  \n"]) + json.dumps(value, indent=r.choice([None, 1])) + r.choice(["", "\n "])
        got = list(telemetry_source.elements(cut(text, r)))
        assert [v for v, _ in got] == value and all(json.loads(t) == v for v, t in got)


@pytest.mark.parametrize("text,why", [("", "not JSON"), ("{}", "not a list"), ("7", "not a list"), ("{broken", "not JSON"), ("[1,", "not JSON"), ("[1 2]", "not JSON"), ("[1,]", "not JSON"), ("[1]x", "not JSON"), ("[", "not JSON"), ('[{"a":', "not JSON")])
def test_bad_texts(text, why):
    with pytest.raises(telemetry_source.Bad, match=why):
        list(telemetry_source.elements(cut(text, random.Random(2))))


def test_memory_is_that_of_a_chunk():
    """Some 120 MB of text in one array, made as it is read."""

    def chunks():
        yield "["
        for i in range(3000):
            yield ",".join(json.dumps({"_T": "x", "n": j, "pad": "p" * 300}) for j in range(120)) + ("," if i < 2999 else "]")

    tracemalloc.start()
    n = sum(1 for _ in telemetry_source.elements(chunks()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 360_000 and peak < 12 << 20


def test_source(spark, tmp_path):
    land(tmp_path / "in", m1=EVENTS, m2_gz=EVENTS[:2], m3={"not": "a list"}, m4="{broken", m5=[], m6=json.dumps(EVENTS)[:-20])
    (tmp_path / "in" / "m7.json.gz").write_bytes(gzip.compress(json.dumps(EVENTS).encode())[:-40])
    rows = telemetry_source.stream_telemetry(spark, str(tmp_path / "in"))
    whole = files.telemetry(files.raw_files(spark, f"{tmp_path}/in/m[12345]*")).select("match_id", "idx", "kind", F.to_json("ev").alias("ev"))
    read = rows.where("error is null").select("match_id", "idx", "kind", F.to_json(F.parse_json("ev")).alias("ev"))
    assert sorted(map(tuple, read.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    assert {tuple(x) for x in telemetry_source.failed_files(rows).collect()} == {("m3", "not a list"), ("m4", "not JSON"), ("m6", "not JSON"), ("m7", "not JSON")}
    loose = telemetry_source.stream_telemetry(spark, f"file://{tmp_path}/in/m6.json", strict=False)
    assert loose.where("error is null").count() == len(EVENTS) - 1 and loose.where("error is not null").count() == 1


def test_kinds_are_pushed_down(spark, tmp_path):
    land(tmp_path / "in", m1=EVENTS, m2_gz=EVENTS[:3], m4="{broken")
    rows = telemetry_source.stream_telemetry(spark, str(tmp_path / "in"))
    some = rows.where("kind in ('logplayertakedamage', 'logheal') and idx >= 2")
    assert {(x.match_id, x.idx) for x in some.collect()} == {("m1", 2), ("m1", 3), ("m2", 2)}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "kind" not in plan.split("Filter", 1)[-1].split("\n")[0] and "idx" in plan.split("Filter", 1)[-1].split("\n")[0], plan
    one = telemetry_source.TelemetryReader({"path": f"{tmp_path}/in/m1.json"})
    assert list(one.pushFilters([telemetry_source.EqualTo(("kind",), "logheal"), telemetry_source.In(("idx",), (1,))])) == [telemetry_source.In(("idx",), (1,))]
    assert one.kinds == {"logheal"} and not list(one.read(one.partitions()[0]))


def test_read_telemetry(spark, tmp_path):
    land(tmp_path / "in", m1=EVENTS, m2_gz=EVENTS[:2], m4="{broken")
    ev = files.read_telemetry(spark, str(tmp_path / "in"))
    whole = files.telemetry(files.raw_files(spark, str(tmp_path / "in")))
    assert ev.columns == whole.columns and dict(ev.dtypes)["idx"] == dict(whole.dtypes)["idx"]
    shown = lambda df: sorted((tuple(x) for x in df.withColumn("ev", F.to_json("ev")).collect()), key=repr)
    assert shown(ev) == shown(whole)
    hits = files.read_telemetry(spark, str(tmp_path / "in"), "logplayertakedamage")
    assert {x.kind for x in hits.collect()} == {"logplayertakedamage"}
