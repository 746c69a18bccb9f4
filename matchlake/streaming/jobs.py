"""Streaming jobs: each new match once, tables derived again when a match grows, live sessions, fights and alerts.

Inside a match the file's order counts, so late events don't patch results: the match is derived again
and its rows replaced. Tables have folders by day, and a batch that is repeated after a failure
leaves them as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from matchlake.operators.careers import alert_events
from matchlake.operators.spatial import contribution_deltas, unknown_contributions
from matchlake.sources.files import DAY, events_of, exists, match_of, of_parts, remove, replace_matches, replace_parts
from matchlake.sources.telemetry_source import failed_files, stream_telemetry


ARRIVED = "path string, modificationTime timestamp, length bigint, content binary"


def with_day(events: DataFrame) -> DataFrame:
    """events with match_day, the day (UTC) of their match's first time that can be read; 1970-01-01 for a match without any."""
    first = events.groupBy("match_id").agg(F.min("ts").alias("_first"))
    day = F.coalesce(F.timestamp_millis(F.unix_millis("_first")).cast("date"), F.lit("1970-01-01").cast("date"))
    return events.join(first, "match_id").withColumn(DAY, day).drop("_first")


def stream_matches(spark: SparkSession, landing: str, out: str, checkpoint: str, per_batch: int = 1000) -> StreamingQuery:
    """Reads telemetry files that arrive in landing into out/events, a folder for each day, and what can't be read into out/bad; a match that is there is not read again.

    Runs over all that has landed and stops; run again it goes on from there. A batch learns the names of its files only, whose contents are
    streamed from them; out/files says of each file what became of it.
    """
    # contents aren't read for a selection without them
    names = spark.readStream.schema(ARRIVED).format("binaryFile").option("maxFilesPerTrigger", per_batch).load(landing).select("path")

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.select("path", match_of(F.col("path")).alias("match_id")).persist()
        known = spark.createDataFrame([], "match_id string")
        if exists(spark, f"{out}/files"):
            # the folder of a repeated batch must not hide its own matches
            known = spark.read.parquet(f"{out}/files").where((F.col("batch") != number) & (F.col("state") == "ingested")).select("match_id")
        new = batch.groupBy("match_id").agg(F.min("path").alias("path")).join(known, "match_id", "left_anti")
        paths = [r["path"] for r in new.collect()]  # per_batch at most
        arrived = f"{out}/arrived/batch={number}"
        stream_telemetry(spark, *paths).write.mode("overwrite").parquet(arrived)
        rows = spark.read.parquet(arrived)
        failed = failed_files(rows)
        failed.write.mode("overwrite").parquet(f"{out}/bad/batch={number}")
        events = with_day(events_of(rows)).withColumn("ev", F.to_json("ev"))
        replace_matches(events, events.select("match_id", DAY).distinct(), f"{out}/events")
        state = F.when(F.col("p").isNull(), "known").when(F.col("reason").isNotNull(), "failed").otherwise("ingested")
        told = batch.join(new.select(F.col("path").alias("p")), F.col("path") == F.col("p"), "left").join(failed, "match_id", "left")
        told.select("path", "match_id", state.alias("state")).write.mode("overwrite").parquet(f"{out}/files/batch={number}")
        remove(spark, arrived)
        batch.unpersist()

    return names.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def import_report(spark: SparkSession, out: str, expected: DataFrame | None = None) -> DataFrame:
    """One row: files seen, of those ingested, failed and known before, and the expected matches (match_id) that no file has come for."""
    files = spark.read.parquet(f"{out}/files")
    n = lambda state: F.count_if(F.col("state") == state)
    counts = files.agg(F.count("*").alias("seen"), n("ingested").alias("ingested"), n("failed").alias("failed"), n("known").alias("known"))
    late = files.select("match_id").limit(0) if expected is None else expected.select("match_id").distinct().join(files.select("match_id"), "match_id", "left_anti")
    return counts.crossJoin(late.agg(F.count("*").alias("missing")))  # one row each


def touched_events(spark: SparkSession, bronze: str, touched: DataFrame, by: str = DAY) -> DataFrame:
    """All events of the touched matches, out of the folders of their days alone."""
    days = [r[by] for r in touched.select(by).distinct().collect()]  # the days of a batch
    return of_parts(spark, bronze, days, by).drop("batch").join(touched, ["match_id", by], "left_semi")


def stream_derive(events: DataFrame, derived: dict[str, Callable[[DataFrame], DataFrame]], out: str, checkpoint: str, by: str = DAY, then: Callable[[int, DataFrame], None] | None = None) -> StreamingQuery:
    """Keeps every event in out/bronze and derives the tables again for the matches of each batch, over all their events.

    events: match_id, the day their match belongs to and more. Bronze has folders by day and batch, derived tables by day, so a batch reads and writes those of its days
    only, and one that is repeated changes nothing. A failure stops the query; the checkpoint makes the next run repeat the batch. then gets each batch's
    number and matches before their tables are replaced.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark, bronze = batch.sparkSession, f"{out}/bronze"
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by, "batch").parquet(bronze)
        touched = spark.read.parquet(bronze).where(F.col("batch") == number).select("match_id", by).distinct().persist()
        whole = touched_events(spark, bronze, touched, by)
        if then:
            then(number, touched)
        for name, make in derived.items():
            rows = make(whole)
            replace_matches(rows if by in rows.columns else rows.join(touched, "match_id"), touched, f"{out}/{name}", by)
        touched.unpersist()

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Folders of a table of totals: a batch rewrites those that its cells lie in.
PARTS = 64


def add_to_totals(deltas: DataFrame, path: str, keys: list[str], number: int, parts: int = PARTS) -> None:
    """Adds deltas (keys and n) to a table of totals; only the folders of their cells are read and written, and cells that fall to zero go.

    A folder's rows say which batch changed them last, so a batch that is repeated is not added twice.
    """
    spark = deltas.sparkSession
    deltas = deltas.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).withColumn("batch", F.lit(number)).persist()
    touched = {r["part"] for r in deltas.select("part").distinct().collect()}  # parts at most
    rows = deltas
    if exists(spark, path):
        known = of_parts(spark, path, sorted(touched), "part")
        touched -= {r["part"] for r in known.where(F.col("batch") == number).select("part").distinct().collect()}
        rows = known.select(*deltas.columns).unionByName(deltas)
    summed = rows.where(F.col("part").isin(sorted(touched))).groupBy(*keys, "part").agg(F.sum("n").alias("n"), F.max("batch").alias("batch"))
    if touched:
        # an emptied cell stays as zero, for the batch's number
        replace_parts(summed.withColumn("batch", F.lit(number)), path, "part", sorted(touched))
    deltas.unpersist()


def stream_bins(events: DataFrame, bins: Callable[[DataFrame], DataFrame], keys: list[str], out: str, checkpoint: str, by: str = DAY) -> StreamingQuery:
    """Counts (match_id, keys, n) as totals over all matches: of a match that arrives again only the cells that change are touched.

    out/ledger has each match's contribution and out/counted the matches that are in the totals. A match that was counted but has no contribution there is refused.
    """

    def change(number: int, touched: DataFrame) -> None:
        spark = touched.sparkSession
        new = bins(touched_events(spark, f"{out}/bronze", touched, by))
        days = [r[by] for r in touched.select(by).distinct().collect()]
        ledger = of_parts(spark, f"{out}/ledger", days, by) if exists(spark, f"{out}/ledger") else new.limit(0)
        if exists(spark, f"{out}/counted"):
            counted = spark.read.parquet(f"{out}/counted").where(F.col("batch") != number)
            refused = unknown_contributions(touched, counted, ledger).limit(5).collect()
            if refused:
                raise ValueError(f"counted before, but the contribution isn't known: {', '.join(str(r[0]) for r in refused)}")
        add_to_totals(contribution_deltas(ledger, new, touched, keys), f"{out}/totals", keys, number)
        touched.select("match_id").write.mode("overwrite").parquet(f"{out}/counted/batch={number}")

    return stream_derive(events, {"ledger": bins}, out, checkpoint, by, change)


def total_bins(spark: SparkSession, out: str, by: list[str]) -> DataFrame:
    return spark.read.parquet(f"{out}/totals").groupBy(*by).agg(F.sum("n").alias("n")).where("n > 0")


def live_sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions per key: start, end (of the last row, not of the wait after it) and number of rows; one is given out when the watermark has passed it."""
    w = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w"))
    return w.agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n")).drop("w")


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which stateful processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


ALERT = "kind string, idx bigint, event string, opened bigint, last_seen bigint, observations bigint"
OPEN = "kind string, opened bigint, n bigint"


def live_alerts(checks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """What each check (kind, t_s, idx, ok) does to its kind's alert, into out/events: open, refresh or resolve.

    Open alerts, two numbers a kind, are kept in out/open under the batch's number and read by the next; a batch that is repeated
    writes the same folders again.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(OPEN).parquet(f"{out}/open/version={number - 1}") if number else spark.createDataFrame([], OPEN)
        events, still = alert_events(batch, before)
        events.write.mode("overwrite").parquet(f"{out}/events/version={number}")
        still.write.mode("overwrite").parquet(f"{out}/open/version={number}")

    return checks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heartbeat_age(rows: DataFrame, now: Column) -> DataFrame:
    """Per job the seconds since its last sign of life; null for one that never gave any."""
    return rows.groupBy("job").agg((F.unix_seconds(now) - F.unix_seconds(F.max("seen_at"))).alias("age_s"))


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a table, waits for its end and reads the table."""
    spark = stream.sparkSession
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(f"{path}").awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
