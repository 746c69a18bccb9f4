"""The supplied tables seen as a game's: one projection, read by Spark and by SQL alike.

A day of events is a match, users are accounts in four teams, and the kinds of events
are hits, knocks, kills, positions and landings; line items with their orders are the
participants' results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENT = [
    "CAST(CAST(ts AS DATE) AS STRING) AS match_id", "event_id AS idx", "CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS t_s", "user_id AS account_id", "CAST(user_id % 4 AS INT) AS team_id",
    "CASE event_type WHEN 'click' THEN 'hit' WHEN 'error' THEN 'knock' WHEN 'purchase' THEN 'kill' WHEN 'view' THEN 'position' ELSE 'landing' END AS kind",
    "user_id + 1 + event_id % 7 AS victim_id", "CAST((user_id + 1 + event_id % 7) % 4 AS INT) AS victim_team", "CAST((event_id * 7919) % 8160 * 100 AS DOUBLE) AS x", "CAST((event_id * 104729) % 8160 * 100 AS DOUBLE) AS y",
    "CAST(((event_id + 13) * 7919) % 8160 * 100 AS DOUBLE) AS vx", "CAST(((event_id + 13) * 104729) % 8160 * 100 AS DOUBLE) AS vy", "CAST(value AS DECIMAL(18, 2)) AS damage", "value AS distance", "props",
]
RESULT = [
    "l_orderkey AS match_id", "l_suppkey AS account_id", "l_linenumber AS team_id", "l_linenumber AS win_place", "CAST(l_quantity AS BIGINT) AS kills", "CAST(l_extendedprice AS DECIMAL(18, 2)) AS damage_dealt", "CAST(l_quantity * 30 AS BIGINT) AS survived_s",
    "CAST(floor(l_discount * 100 + 0.5) AS INT) AS assists", "l_returnflag = 'R' AS is_bot", "CAST(o_orderdate AS DATE) AS played_on", "o_orderstatus AS match_type", "o_orderpriority AS game_mode", "CONCAT('map', CAST(o_custkey % 5 AS STRING)) AS map_name", "l_partkey % 40 AS weapon", "l_suppkey % 10 = 0 AS tracked",
]

#: Bytes of Parquet of results for a task; sorted and hashed in memory they take some tens of times that.
TASK_BYTES = 8 << 20


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr(*EVENT)


def tasks(spark: SparkSession, sf: str) -> int | None:
    """Over how many tasks results are dealt, a task for each TASK_BYTES of their files; None if that isn't more than the session's cores anyway."""
    files = [spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{t}.parquet") for t in ("lineitem", "orders")]
    n = sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for p in files) // TASK_BYTES + 1
    return n if n > spark.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """df over n tasks by the keys; with None as Spark deals it."""
    return df if n is None else df.repartition(n, *keys)


def results(spark: SparkSession, sf: str) -> DataFrame:
    n = tasks(spark, sf)
    items = dealt(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"), n, "l_orderkey")
    orders = dealt(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"), n, "o_orderkey")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).selectExpr(*RESULT)


def results_by_player(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(results(spark, sf), tasks(spark, sf), "match_id", "account_id")


EV = f"ev AS (SELECT {', '.join(EVENT)} FROM events)"
RES = f"res AS (SELECT {', '.join(RESULT)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
KINDS = ", ".join(f"{k}s AS (SELECT * FROM ev WHERE kind = '{k}')" for k in ("hit", "knock", "kill", "position", "landing"))
ROSTER = "roster AS (SELECT match_id, account_id, min(team_id) AS team_id FROM ev GROUP BY match_id, account_id)"
DEATHS = "deaths AS (SELECT match_id, victim_id AS account_id, max(t_s) AS death_t FROM kills GROUP BY 1, 2)"
LANDED = "landed AS (SELECT match_id, account_id, arg_min(t_s, idx) AS land_t, arg_min(x, idx) AS land_x, arg_min(y, idx) AS land_y, min(team_id) AS team_id FROM landings GROUP BY 1, 2)"
