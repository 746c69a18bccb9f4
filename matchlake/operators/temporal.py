"""Time-based building blocks: as-of joins, gap segments, ranked attachment, change points, pairing.

An as-of join is one union and one window per key: it shuffles both sides once by
the key and sorts, where a range join would compare pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _both(probes: DataFrame, samples: DataFrame, keys: Sequence[str], t: str, carry: Sequence[str]) -> DataFrame:
    """Probes and samples in one frame; _p holds a probe's columns, _s a sample's time and carried ones."""
    sample = samples.where(F.col(t).isNotNull()).select(*keys, F.col(t).alias("_t"), F.lit(0).alias("_o"), F.struct(F.col(t).alias("t"), *carry).alias("_s"))
    kind = sample.schema["_s"].dataType.simpleString()
    probe = probes.select(*keys, F.col(t).alias("_t"), F.struct(*probes.columns).alias("_p"))
    pk = probe.schema["_p"].dataType.simpleString()
    sample = sample.withColumn("_p", F.lit(None).cast(pk))
    probe = probe.withColumn("_s", F.lit(None).cast(kind)).withColumn("_o", F.lit(1))
    return sample.unionByName(probe)


def _ahead(keys: Sequence[str], tie: Sequence[str]) -> WindowSpec:
    """From the key's end to the row, of equal times samples first: the last sample is the next one. In the order of time the frame would be gone through anew for each row."""
    return Window.partitionBy(*keys).orderBy(F.col("_t").desc(), F.col("_o"), *[F.col("_s")[c].desc() for c in tie]).rowsBetween(Window.unboundedPreceding, 0)


def asof(probes: DataFrame, samples: DataFrame, keys: Sequence[str], t: str, carry: Sequence[str], direction: str = "backward", tie: Sequence[str] = (), max_lag: float | None = None, prefix: str = "s_") -> DataFrame:
    """Every probe with the sample of its key that is the last at or before it (backward), the first at or after it (forward) or the nearest of both.

    At an equal distance the earlier sample wins; among samples of one time the last (backward) or first (forward)
    in the order of tie, which must be carried. Beyond max_lag nothing is joined. Adds prefix + t, prefix + carried columns and prefix + lag.
    """
    both = _both(probes, samples, keys, t, carry)
    back = Window.partitionBy(*keys).orderBy(F.col("_t"), F.col("_o"), *[F.col("_s")[c] for c in tie]).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _ahead(keys, tie)
    before = F.last("_s", ignorenulls=True).over(back) if direction != "forward" else None
    after = F.last("_s", ignorenulls=True).over(ahead) if direction != "backward" else None
    if direction == "nearest":
        found = both.withColumn("_b", before).withColumn("_a", after).where("_p is not null")
        nearer = F.col("_b").isNotNull() & (F.col("_a").isNull() | (F.col("_t") - F.col("_b")["t"] <= F.col("_a")["t"] - F.col("_t")))
        found = found.withColumn("_m", F.when(nearer, F.col("_b")).otherwise(F.col("_a")))
    else:
        found = both.withColumn("_m", before if direction == "backward" else after).where("_p is not null")
    lag = F.abs(F.col("_t") - F.col("_m")["t"])
    ok = F.lit(True) if max_lag is None else lag <= max_lag
    return found.select("_p.*", F.when(ok, F.col("_m")["t"]).alias(f"{prefix}{t}"), *[F.when(ok, F.col("_m")[c]).alias(f"{prefix}{c}") for c in carry], F.when(ok, lag).alias(f"{prefix}lag"))


def interpolated(probes: DataFrame, samples: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], clamp: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """Every probe with the values between the samples around it, linear in time; at the ends clamped, or null before the first sample without clamp."""
    both = _both(probes, samples, keys, t, [*values, *tie])
    back = Window.partitionBy(*keys).orderBy(F.col("_t"), F.col("_o"), *[F.col("_s")[c] for c in tie]).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _ahead(keys, tie)
    found = both.withColumn("_b", F.last("_s", ignorenulls=True).over(back)).withColumn("_a", F.last("_s", ignorenulls=True).over(ahead)).where("_p is not null")
    b, a = F.col("_b"), F.col("_a")
    span = a["t"] - b["t"]
    at = lambda c: F.when(b.isNull(), a[c] if clamp else F.lit(None)).when(a.isNull() | (span <= 0), b[c]).otherwise(b[c] + (a[c] - b[c]) * (F.col("_t") - b["t"]) / span)
    return found.select("_p.*", *[at(c).alias(f"at_{c}") for c in values])


def gap_segments(rows: DataFrame, keys: Sequence[str], t: str, gap: float, tie: Sequence[str] = ()) -> DataFrame:
    """rows with segment (0, 1, ... per key): a new one begins where the time since the row before is over gap."""
    w = Window.partitionBy(*keys).orderBy(t, *tie)
    since = F.col(t) - F.lag(t).over(w)
    return rows.withColumn("_new", F.when(since > gap, 1).otherwise(0)).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def range_ends(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """One row with _ends, the greatest keys (structs; nulls are least) of at most n ranges of about equal size, in order.

    They come from a sort of the keys alone and are held by the driver, so that every use of the ranges sees the same.
    """
    dealt = rows.select(key.alias("key")).repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("task")).agg(F.max("key").alias("key"))
    ends = dealt.agg(F.sort_array(F.collect_list("key")).alias("_ends"))
    return rows.sparkSession.createDataFrame(ends.collect(), ends.schema)


def range_of(ends: str, key: Column, n: int) -> Column:
    """The number (0, 1, ...) of the range that a key lies in, by halving."""
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, n).bit_length()))])
    return F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get(ends, at + step - 1) < key, at + step).otherwise(at))


def ranged(rows: DataFrame, order: Sequence[str], n: int | None = None) -> DataFrame:
    """rows with _range (0, 1, ...): ranges in the order of the columns, so that no window need hold a key with most of the rows; nulls come first."""
    key = F.struct(*[F.col(c) for c in order])
    n = n or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.crossJoin(F.broadcast(range_ends(rows, key, n))).withColumn("_range", range_of("_ends", key, n)).drop("_ends")  # one row


def long_gap_segments(rows: DataFrame, t: str, gap: float, tie: Sequence[str] = ()) -> DataFrame:
    """rows with segment as of gap_segments, for one sequence without a key: ranges of it are cut each on its own and then joined.

    Of a range only its first and last time and its number of cuts go on: a row for each range.
    """
    w = Window.partitionBy("_range").orderBy(t, *tie)
    cut = F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(False)).cast("int")
    inner = ranged(rows, [t, *tie]).withColumn("_cut", cut).withColumn("_inner", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = inner.groupBy("_range").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.max("_inner").alias("cuts"))
    along = Window.orderBy("_range")
    apart = F.coalesce(F.col("first") - F.lag("last").over(along) > gap, F.lit(False)).cast("int")
    ends = ends.withColumn("here", apart + F.coalesce(F.lag("cuts").over(along), F.lit(0)))
    ends = ends.select("_range", F.sum("here").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("_base"))
    return inner.join(F.broadcast(ends), "_range").withColumn("segment", F.col("_base") + F.col("_inner")).drop("_range", "_cut", "_inner", "_base")


def gap_sweep(rows: DataFrame, keys: Sequence[str], t: str, gaps: Sequence[float], tie: Sequence[str] = ()) -> DataFrame:
    """gap, n_segments: how many segments each gap would give; one pass over the rows, counted before the gaps are listed."""
    since = F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t, *tie))
    counts = rows.select(since.alias("d")).agg(*[F.count_if(F.col("d").isNull() | (F.col("d") > g)).alias(f"g{i}") for i, g in enumerate(gaps)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gap"), F.col(f"g{i}").alias("n_segments")) for i, g in enumerate(gaps)])).alias("x")).select("x.*")


def ranked_attach(left: DataFrame, right: DataFrame, keys: Sequence[str], rules: Sequence[Column], left_id: Sequence[str], prefer: Sequence[Column]) -> DataFrame:
    """left with the one row of right (equal keys) that fits the first rule that any fits, the best by prefer; rule is its number, null if none fits."""
    rule = F.coalesce(*[F.when(r, F.lit(i + 1)) for i, r in enumerate(rules)])
    fits = left.join(right, list(keys)).withColumn("rule", rule).where("rule is not null")
    best = fits.withColumn("_n", F.row_number().over(Window.partitionBy(*left_id).orderBy("rule", *prefer))).where("_n = 1")
    extra = [c for c in right.columns if c not in keys]
    return left.join(best.select(*left_id, "rule", *extra), list(left_id), "left")


def compacted(track: DataFrame, keys: Sequence[str], t: str, within: float, tie: Sequence[str] = ()) -> DataFrame:
    """The last row of every chain of rows less than within apart."""
    w = Window.partitionBy(*keys).orderBy(t, *tie)
    ahead = F.lead(t).over(w) - F.col(t)
    return track.withColumn("_d", ahead).where(F.col("_d").isNull() | (F.col("_d") >= within)).drop("_d")


def change_points(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows whose values differ from those of the row before; the first row of a key counts as changed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.lag(F.struct(*values)).over(w).eqNullSafe(F.struct(*values))
    return rows.withColumn("_same", same).where("not _same").drop("_same")


def open_close(rows: DataFrame, keys: Sequence[str], order: Sequence[str], is_open: Column, is_close: Column, t: str) -> DataFrame:
    """Openings with the close that directly follows: an opening that another one follows has none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.where(is_open | is_close).withColumn("_open", is_open)
    paired = marked.withColumn("_next_open", F.lead("_open").over(w)).withColumn("_next_t", F.lead(t).over(w))
    return paired.where("_open").withColumn("close_t", F.when(~F.col("_next_open"), F.col("_next_t"))).drop("_open", "_next_open", "_next_t")


def epochs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column) -> DataFrame:
    """rows with epoch: the number of starts so far; rows before the first start are dropped."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("epoch", F.sum(starts.cast("int")).over(w)).where("epoch > 0")


_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def folded(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], inputs: Sequence[str], start: Callable[[], Callable], outputs: dict[str, str]) -> DataFrame:
    """rows with outputs, which a function of inputs makes row by row in the order; start gives a new function for each key.

    outputs names a type each, or the column whose type it has. Keys follow each other in sorted partitions that are read in batches: neither is a
    key held, nor is there a call for each key, so many small keys cost what their rows cost.
    """
    kinds = {c: rows.schema[k].dataType.simpleString() if k in rows.columns else k for c, k in outputs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for b in batches:
            made = []
            for key, values in zip(zip(*[b.column(c).to_pylist() for c in keys]), zip(*[b.column(c).to_pylist() for c in inputs])):
                if step is None or key != last:
                    last, step = key, start()
                made.append(step(*values))
            types = [b.schema.field(k).type if k in b.schema.names else _ARROW[k] for k in outputs.values()]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([m[i] for m in made], t) for i, t in enumerate(types)]], [*b.schema.names, *outputs])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", `{c}` {k}" for c, k in kinds.items())
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def top_per(rows: DataFrame, keys: Sequence[str], order: Sequence, n: int = 1) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
