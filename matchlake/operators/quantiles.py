"""Exact quantiles of large groups, without a group's values in one place.

A mergeable sketch gives two values around each quantile. One pass counts what is below them, and only the values between
go through a sort, once each with their number. So memory and shuffle follow the sketch's width, not the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's greatest error of rank, as one in so many.
ACCURACY = 10_000


def exact_quantiles(rows: DataFrame, keys: Sequence[str], values: Sequence[str], at: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """keys and for each of values n_VALUE, how many aren't null, and q_VALUE, its quantiles at the given shares.

    Between two values a quantile is interpolated linearly, as Spark's percentile does; without a value it is null.
    """
    keys, span = list(keys), range(len(at))
    # wider than the sketch's error on both sides; groups that are too small for that are taken between their ends
    shares = [min(1.0, max(0.0, p + side * 4 / accuracy)) for p in at for side in (-1, 1)]
    given = rows.select(*keys, *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    sketched = []
    for i in range(len(values)):
        v = f"_v{i}"
        sketched += [F.count(v).alias(f"_n{i}"), F.min(v).alias(f"_min{i}"), F.max(v).alias(f"_max{i}"), F.percentile_approx(v, shares, accuracy).alias(f"_s{i}")]
    s = given.groupBy(*keys).agg(*sketched)
    bounds = []
    for i in range(len(values)):
        small = F.col(f"_n{i}") <= 3 * accuracy
        low = F.array(*[F.when(small, F.col(f"_min{i}")).otherwise(F.get(f"_s{i}", 2 * j)) for j in span])
        high = F.array(*[F.when(small, F.col(f"_max{i}")).otherwise(F.get(f"_s{i}", 2 * j + 1)) for j in span])
        bounds += [low.alias(f"_low{i}"), high.alias(f"_high{i}")]
    s = s.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_n{i}" for i in range(len(values))], *bounds)
    same = [given[k].eqNullSafe(s[f"_k_{k}"]) for k in keys]
    placed = given.join(s.drop(*[f"_n{i}" for i in range(len(values))]), same).drop(*[f"_k_{k}" for k in keys]) if keys else given.crossJoin(F.broadcast(s))  # one row
    pairs = [(i, j) for i in range(len(values)) for j in span]
    below = placed.groupBy(*keys).agg(*[F.count_if(F.col(f"_v{i}") < F.get(f"_low{i}", j)).alias(f"b{i}_{j}") for i, j in pairs])
    inside = [F.when((F.col(f"_v{i}") >= F.get(f"_low{i}", j)) & (F.col(f"_v{i}") <= F.get(f"_high{i}", j)), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_v{i}").alias("v"))) for i, j in pairs]
    counted = placed.select(*keys, F.explode(F.array_compact(F.array(*inside))).alias("x")).groupBy(*keys, "x.i", "x.j", "x.v").agg(F.count("*").alias("m"))
    up = Window.partitionBy(*keys, "i", "j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("_upto", F.sum("m").over(up))
    # the two values around each quantile, as ranks from 0
    said = s.select(*[F.col(f"_k_{k}").alias(k) for k in keys], *[f"_n{i}" for i in range(len(values))])
    known = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), ((F.col(f"_n{i}") - 1) * F.lit(float(at[j]))).alias("rank"), F.col(f"b{i}_{j}").alias("below")) for i, j in pairs]
    joined_below = _on(said, below, keys).select(*keys, F.explode(F.array(*known)).alias("w")).select(*keys, "w.*")
    near = _on(counted, joined_below, [*keys, "i", "j"])
    rank, upto = F.col("rank"), F.col("below") + F.col("_upto")
    ends = near.groupBy(*keys, "i", "j").agg(F.min(F.when(upto > F.floor(rank), F.col("v"))).alias("a"), F.min(F.when(upto > F.ceil(rank), F.col("v"))).alias("b"), F.first("rank").alias("rank"))
    part = F.col("rank") - F.floor("rank")
    value = F.when(part == 0, F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b"))
    each = [F.transform(F.sort_array(F.collect_list(F.when(F.col("i") == i, F.struct("j", value.alias("q"))))), lambda x: x["q"]).alias(f"_q{i}") for i in range(len(values))]
    got = _on(said, ends.groupBy(*keys).agg(*each), keys, "left")
    out = []
    for i, v in enumerate(values):
        out += [F.when(F.col(f"_n{i}") > 0, F.col(f"_q{i}")).alias(f"q_{v}"), F.col(f"_n{i}").alias(f"n_{v}")]
    return got.select(*keys, *out)


def _on(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys of which nulls equal each other; of the two, a's keys stay."""
    if not keys:
        return a.crossJoin(F.broadcast(b))  # one row each
    other = b.withColumnsRenamed({k: f"_o_{k}" for k in keys})
    return a.join(other, [a[k].eqNullSafe(other[f"_o_{k}"]) for k in keys], how).drop(*[f"_o_{k}" for k in keys])
