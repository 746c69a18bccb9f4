"""Exact quantiles against Spark's own percentile: ties, nulls, small and large groups, sketches that are coarse."""

import random

import pytest

from matchlake.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_quantiles(spark, accuracy):
    r = random.Random(accuracy)
    rows = [("hot", r.choice([1, 2, 2, 3, r.randrange(10**6)]), r.gauss(0, 1)) for _ in range(6000)]
    rows += [("ties", 5, 1.0)] * 500 + [("two", 1, 0.0), ("two", 4, None), ("one", None, -0.5), (None, 7, 2.0), (None, 8, 4.0)] + [(f"k{i}", r.randrange(3), r.random()) for i in range(40) for _ in range(i)]
    df = spark.createDataFrame(rows, "k string, a int, b double").repartition(5)
    at = (0.0, 0.25, 0.5, 0.61, 0.75, 1.0)
    got = {x.k: x for x in exact_quantiles(df, ["k"], ["a", "b"], at, accuracy).collect()}
    of = ", ".join(map(str, at))
    want = {x.k: x for x in df.groupBy("k").agg(*[f for v in "ab" for f in (_percentile(v, of), _count(v))]).collect()}
    assert set(got) == set(want)
    for k in want:
        for v in "ab":
            assert got[k][f"n_{v}"] == want[k][f"n_{v}"]
            a, b = got[k][f"q_{v}"], want[k][f"q_{v}"]
            assert (a is None) == (b is None) and (a is None or max(abs(x - y) for x, y in zip(a, b, strict=True)) < 1e-9), (k, v, a, b)
    whole = exact_quantiles(df, [], ["b"], [0.5], accuracy).first()
    assert abs(whole.q_b[0] - df.selectExpr("percentile(b, 0.5)").first()[0]) < 1e-12 and whole.n_b == df.where("b is not null").count()
    assert exact_quantiles(df.where("false"), ["k"], ["a"], [0.5]).count() == 0


def _percentile(v, of):
    from pyspark.sql import functions as F

    return F.expr(f"percentile({v}, array({of}))").alias(f"q_{v}")


def _count(v):
    from pyspark.sql import functions as F

    return F.count(v).alias(f"n_{v}")
