"""Helpers that several operators share: tables in the shared folder, streamed neighbour groups, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing document id where ids are ordered: after every real one.
NO_ID = (1 << 63) - 1

#: Rows of one key that a streaming task holds before it passes them on as undecided.
HELD_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session, as in tests, may go without it and gets a temporary one.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="matchlake-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


#: Where materialize writes; the shared folder itself outside of scratch().
_INTO: ContextVar[str | None] = ContextVar("into", default=None)


def _written(df: DataFrame, folder: str, label: str) -> DataFrame:
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    # tables of texts are smaller than by the default codec
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    return _written(df, _INTO.get() or shared_dir(df.sparkSession), label)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is materialized inside goes to one folder, which is deleted at the end; the given function writes a table that stays.

    For tables that nothing needs once a result is written. A result made of them must be kept before the end.
    """
    outer = _INTO.get() or shared_dir(spark)
    folder = f"{outer}/{label}-{uuid.uuid4().hex}"
    token = _INTO.set(folder)
    try:
        yield lambda df: _written(df, outer, f"{label}-kept")
    finally:
        _INTO.reset(token)
        remove(spark, folder)


@contextmanager
def written_below(folder: str) -> Iterator[None]:
    """What is materialized inside goes to folder, which stays."""
    token = _INTO.set(folder)
    try:
        yield
    finally:
        _INTO.reset(token)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(df: DataFrame, *names: str) -> DataFrame:
    """df as columns _row (a struct of all its columns) and _NAME for each of names.

    Whatever the other columns are called, they can't clash with an operator's own.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[F.col(f"`{n}`").alias(f"_{n}") for n in names])


def unpacked(df: DataFrame, source: DataFrame, **replaced: Column) -> DataFrame:
    """The columns of source out of _row, some of them replaced."""
    return df.select(*[(replaced[c] if c in replaced else F.col("_row")[c]).alias(c) for c in source.columns])


def _marker(keys: list[str], doc: str, held_rows: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, undecided = None, None

        def out(table: pa.Table, begin: np.ndarray, end: np.ndarray, is_open: np.ndarray):
            docs, size = table.column(doc).to_numpy(), end - begin
            is_first = docs == np.repeat(docs[begin], size)
            last, opened = np.repeat(docs[end - 1], size), np.repeat(is_open, size) & is_first
            keep = np.repeat(docs[begin] != docs[end - 1], size) | opened
            more = {"least_doc": np.repeat(docs[begin], size), "last_doc": last, "is_first": is_first, "is_open": opened}
            for name, x in more.items():
                table = table.append_column(name, pa.array(x))
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            cols = [table.column(k).to_numpy() for k in keys]
            change = np.zeros(len(table), bool)
            change[0] = True
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(change)
            undecided = undecided or tuple(c[0] for c in cols)
            cut, grown = int(starts[-1]), None
            if len(table) - cut > held_rows:
                cut, grown = len(table), tuple(c[cut] for c in cols)
            if cut:
                begin = starts[starts < cut]
                is_open = np.logical_and.reduce([c[begin] == u for c, u in zip(cols, undecided)])
                is_open[-1] |= grown is not None
                yield from out(table.slice(0, cut), begin, np.append(begin[1:], cut), is_open)
            undecided = grown or undecided
            held = table.slice(cut) if cut < len(table) else None
        if held is not None:
            yield from out(held, np.zeros(1, int), np.full(1, len(held)), np.ones(1, bool))

    return mark


def shared_groups(df: DataFrame, keys: list[str], doc: str, *then: str, held_rows: int = HELD_ROWS) -> DataFrame:
    """The rows of df whose keys are found under two or more values of doc, the least of them (least_doc) and whether it is the row's (is_first).

    Keys and doc are non-null longs. Rows are range-partitioned by keys and doc
    and sorted by both (and by then, if given), so a key with a third of all rows is dealt over many
    tasks. Each task streams its sorted rows and decides every group that lies
    inside it. The groups at its two ends may go on in a neighbour: there only the
    rows of the least doc that the task has seen are open, all others have a
    lesser one before them. Open groups number two a task at most (and one for
    every held_rows rows), which bounds the table that is broadcast to decide them.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    order = [*keys, doc]
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order, *then).sortWithinPartitions(*order, *then)
    marked = materialize(dealt.mapInArrow(_marker(keys, doc, held_rows), f"{fields}, least_doc bigint, last_doc bigint, is_first boolean, is_open boolean"), "groups")
    still = marked.where("is_open").drop("is_first", "is_open")
    ends = still.groupBy(*keys).agg(F.min(doc).alias("_least"), F.max("last_doc").alias("_most")).where("_least < _most")
    decided = still.join(F.broadcast(ends), keys).withColumn("is_first", F.col(doc) == F.col("_least")).withColumn("least_doc", F.col("_least"))
    inside = marked.where("not is_open").join(F.broadcast(ends), keys, "left").withColumn("least_doc", F.least("least_doc", "_least"))
    return inside.select(*decided.columns).drop("last_doc", "_least", "_most").unionByName(decided.drop("last_doc", "_least", "_most"))


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of non-null longs to (node, root), root being the least node reachable; nodes without edges are absent.

    Alternates the large-star and small-star steps: each links every node of a
    neighbourhood to its least member, until the edges form stars. Minima come from
    partial aggregation and the joins are plain equi-joins that AQE can split, so
    a hub with very many neighbours is neither collected nor expanded into pairs.
    Every round is written to the shared folder; only whether all are stars reaches
    the driver.
    """

    def are_stars(e: DataFrame) -> bool:
        """Every node is linked to one lesser node at most, and is none that others are linked to."""
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("hub")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("hub")))
        degree = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("hub").alias("hub"))
        return not degree.agg(F.max((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("hub") > 0))).alias("odd")).first()["odd"]

    e = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        e = materialize(large.join(low, "u").select(F.explode(ends).alias("x")).select("x.*").where("u != v").distinct(), "edges")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
