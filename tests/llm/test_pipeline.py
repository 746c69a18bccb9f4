"""The pipeline against a plain version, stage by stage."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from matchlake.llm import sentencepiece_codec

from test_operators import brute_classes, brute_contaminated, brute_fingerprint, prose


def test_pipeline(spark, tmp_path):
    passage = prose(900, 45)
    texts = [prose(i, 90) + "\nfooter line of all\n" + prose(1000 + i, 40) for i in range(30)] + [prose(50, 80), prose(50, 80), "too short", None, "", prose(60, 60) + " " + passage, " ".join(["same words again and again"] * 30)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, prose(70, 70), None, None, 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, prose(901, 30))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def fine(t):
        w = (t or "").split()
        n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = len({j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})
        return len(w) >= 20 and 100 * again <= 30 * len(w)

    kept = [(d, t) for d, t, *_ in rows if fine(t)]
    own = defaultdict(set)
    for d, t in kept:
        for x in t.split("\n"):
            own[x.strip().lower()].add(d)
    least = {k: min(x for x in v if x is not None) for k, v in own.items() if len(k) >= 10 and len(v) > 1}
    kept = [(d, "\n".join(x for x in t.split("\n") if least.get(x.strip().lower(), d) == d)) for d, t in kept]
    classes = {d: c for d, _, c in brute_classes([(d, brute_fingerprint(t)) for d, t in kept])}
    kept = [(d, t) for d, t in kept if d is None or classes[d] == d]
    gone = {d for d, _ in brute_contaminated(kept, [(1, passage), (2, prose(901, 30))])}
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_file())
    want = sorted(((d, list(memoryview(codec.encode(t)).cast("i"))) for d, t in kept if d not in gone), key=repr)
    before = _tables(spark)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=repr) == want
    # of the two equal documents the second loses its only line, and stays as the one empty document
    assert len(want) == 33 and all(r.round_trip for r in got.collect())
    assert len(_tables(spark) - before) == 1, "of all tables in the shared folder only the result's stays"
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and not re.search("limit", str(corpus_pipeline.ORACLE_SQL))


def _tables(spark):
    from pathlib import Path

    from matchlake.llm._common import shared_dir

    return {str(p.parent) for p in Path(shared_dir(spark).removeprefix("file://")).rglob("_SUCCESS")}


def test_stages_leave_each_other_alone(spark):
    """A stage's rows can be read after any other stage has run on other rows."""
    docs = lambda k: spark.createDataFrame([(i, prose(k + i, 60) + "\nthe same line in all of them\n" + prose(k + 50 + i, 30), "en", "s", 1) for i in range(12)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    a = corpus_pipeline.lines(spark, docs(0), "")
    n = a.count()
    b = corpus_pipeline.quality_rules(spark, docs(500), "")
    c = corpus_pipeline.near_duplicates(spark, docs(900), "")
    assert (a.count(), b.count(), c.count(), n) == (12, 12, 12, 12)


def test_stages_on_odd_tables(spark, tmp_path):
    """Every stage with no rows, and with nulls, repeated ids, a long text and columns that clash with the operators' own."""
    spark.createDataFrame([(1, prose(901, 30))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, mark bigint, kept boolean, fp int, doc int, words int, _hash int"
    more = ("r", 1, False, 2, 3, 4, 5)
    long = prose(7, 30_000)
    rows = [(i, prose(i, 80), "en", "s", 1, *more) for i in range(12)] + [(3, prose(300, 80), None, "s", 1, *more), (4, prose(4, 80), "en", "s", 1, *more)]
    rows += [(None, prose(400, 80), None, None, None, *more), (None, prose(401, 80), None, None, None, *more), (50, long, "en", "s", 1, *more), (51, None, "en", "s", 1, *more)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.where("false"), str(tmp_path))
        assert empty.count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if name == corpus_pipeline.STAGES[-1][0]:
            assert len(got) == len(rows) and all(r.round_trip for r in got)
            continue
        assert out.columns == docs.columns == empty.columns and all(tuple(r)[5:] == more for r in got), name
        ids = [r.doc_id for r in got]
        assert ids.count(None) == 2 and 50 in ids and next(r for r in got if r.doc_id == 50).text == long, name
        assert ids.count(3) == 2 and ids.count(4) == (1 if "near" in name else 2), name


def test_workers_without_the_package(tmp_path):
    """A session started elsewhere, with the package on the driver's path alone: tasks get all they need from the driver."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    home = str(Path(corpus_pipeline.__file__).parent)
    script = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(i, "some words of text %d here" % i) for i in range(9)], "doc_id bigint, text string")
def seen(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("matchlake") is not None] * b.num_rows)], ["there"])
assert not any(r.there for r in docs.select("doc_id").mapInArrow(seen, "there boolean").collect())
sys.path.insert(0, {home!r})
from matchlake.llm import order_minhash, resample, sentencepiece_codec, simhash
both = sentencepiece_codec.round_trip(docs, ["doc_id"]).collect()
assert len(both) == 9 and all(r.round_trip for r in both)
assert sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).where("decoded = _row.text").count() == 9
assert simhash.simhash_classes(docs).count() == 9 and resample.resampled(docs, docs).count() == 9
print("all done")
"""
    (tmp_path / "run.py").write_text(script)
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=600)
    assert "all done" in out.stdout, out.stderr[-3000:]
