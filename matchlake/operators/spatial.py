"""Heat bins, places, drops, clusters and exported tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.norm import bearing, distance, grid_cell, quantise_u16, tick
from matchlake.operators.rounds import rounds


def replay_positions(track: DataFrame, world: int, tick_ms: int) -> DataFrame:
    """Quantised samples ordered by player: team, then account. Health is rounded into a byte; flags is the mask of the sample's flags."""
    player = F.dense_rank().over(Window.partitionBy("match_id").orderBy("team_id", "account_id")) - 1
    hp = F.least(F.greatest(F.bround("health"), F.lit(0)), F.lit(255)).cast("int")
    place = [quantise_u16(F.col(c), world).alias(f"q{c}") for c in ("x", "y")]
    return track.select("match_id", player.alias("player"), "idx", tick(F.col("t_s"), tick_ms).alias("tick"), *place, hp.alias("hp"), F.col("flags").bitwiseAND(F.lit(255)).alias("flags"))


def replay_events(tick_ms: int, **kinds: DataFrame) -> DataFrame:
    """Rows of several kinds in one frame with their tick; columns that a kind lacks are null."""
    out = None
    for kind, df in kinds.items():
        rows = df.withColumn("event", F.lit(kind)).withColumn("tick", tick(F.col("t_s"), tick_ms))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def interned(df: DataFrame, column: str, keys: list[str], order: str) -> DataFrame:
    """df with column_id: 0, 1, ... per key in order of first sight."""
    first = F.min(order).over(Window.partitionBy(*keys, column))
    return df.withColumn("_f", first).withColumn(f"{column}_id", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_f", column)) - 1).drop("_f")


def heat_bins(observations: DataFrame, world: int, grid: int) -> DataFrame:
    """Counts per cell for {account, all} x {mode, all}; an observation without an account or mode counts once."""
    both = lambda c: F.array_distinct(F.array(F.col(c), F.lit("")))
    cells = observations.select("map_name", "kind", "match_type", "day", grid_cell(F.col("x"), world, grid).alias("gx"), grid_cell(F.col("y"), world, grid).alias("gy"), F.explode(both("account")).alias("account"), "mode")
    return cells.withColumn("mode", F.explode(both("mode"))).groupBy("map_name", "kind", "account", "mode", "match_type", "day", "gx", "gy").agg(F.count("*").alias("n"))


def movement(samples: DataFrame, in_play) -> DataFrame:
    """Samples in play, and per match how many were skipped."""
    return samples.groupBy("match_id").agg(F.count_if(in_play).alias("n_used"), F.count_if(~F.coalesce(in_play, F.lit(False))).alias("n_skipped"))


def merged_bins(current: DataFrame, old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """current - old + new, without cells that fall to zero."""
    signed = current.select(*keys, "n").unionByName(old.select(*keys, (-F.col("n")).alias("n"))).unionByName(new.select(*keys, "n"))
    return signed.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")


def unknown_contributions(replaced: DataFrame, counted: DataFrame, ledger: DataFrame) -> DataFrame:
    """Matches to replace that were counted before but whose contribution isn't in the ledger: what to take back isn't known, so they are to be refused."""
    again = replaced.select("match_id").distinct().join(counted.select("match_id"), "match_id", "left_semi")
    return again.join(ledger.select("match_id"), "match_id", "left_anti")


def contribution_deltas(ledger: DataFrame, new: DataFrame, replaced: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n, by how much each cell changes when the replaced matches' contributions become the new ones; cells that don't change have no row.

    ledger and new: match_id, keys, n.
    """
    old = ledger.join(replaced.select("match_id").distinct(), "match_id", "left_semi").select(*keys, (-F.col("n")).alias("n"))
    return new.select(*keys, "n").unionByName(old).groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")


KINDS = ("kill", "death", "knock", "landing", "movement", "hit", "vehicle")


def heatmap(bins: DataFrame, kind: str, accounts: list[str] | None = None, since=None, until=None, **equal) -> DataFrame:
    """Cells of one kind with the largest and the total count; without accounts the rows for all are read."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    rows = bins.where((F.col("kind") == kind) & F.col("account").isin(*(accounts or [""])))
    for c, v in equal.items():
        rows = rows.where(F.col(c) == v)
    rows = rows.where(F.col("day") >= since) if since else rows
    rows = rows.where(F.col("day") < until) if until else rows
    cells = rows.groupBy("gx", "gy").agg(F.sum("n").alias("n"))
    total = cells.agg(F.max("n").alias("peak"), F.sum("n").alias("total"))
    return cells.crossJoin(F.broadcast(total))  # total is a single row


def density(bins: DataFrame, grid: int, radius: int, passes: int = 3) -> DataFrame:
    """Box mean over a dense grid, along both axes, several times; v is the root of the share of the peak."""
    spark = bins.sparkSession
    cells = spark.range(grid * grid).select((F.col("id") % grid).cast("int").alias("gx"), F.floor(F.col("id") / grid).cast("int").alias("gy"))
    d = cells.join(bins, ["gx", "gy"], "left").select("gx", "gy", F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("v"))
    for _ in range(passes):
        for along, across in (("gx", "gy"), ("gy", "gx")):
            d = d.withColumn("v", F.avg("v").over(Window.partitionBy(across).orderBy(along).rangeBetween(-radius, radius)))
    peak = d.agg(F.max("v").alias("peak"))
    return d.crossJoin(F.broadcast(peak)).select("gx", "gy", "v", F.sqrt(F.col("v") / F.nullif("peak", F.lit(0.0))).alias("shade"))  # peak is a single row


def gazetteer(sightings: DataFrame, world: int, grid: int, min_support: int = 5, min_purity: float = 0.6, excluded: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent name per cell with its support and purity; of equal names the one seen first."""
    cell = sightings.where(~F.col("name").isin(*excluded)) if excluded else sightings
    cell = cell.select("map_name", grid_cell(F.col("x"), world, grid).alias("gx"), grid_cell(F.col("y"), world, grid).alias("gy"), "name", "idx")
    n = cell.groupBy("map_name", "gx", "gy", "name").agg(F.count("*").alias("support"), F.min("idx").alias("first"))
    w = Window.partitionBy("map_name", "gx", "gy")
    top = n.withColumn("total", F.sum("support").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.col("support").desc(), "first", "name"))).where("_n = 1")
    return top.where((F.col("support") >= min_support) & (F.col("support") >= min_purity * F.col("total"))).select("map_name", "gx", "gy", "name", "support", "total")


def label_points(points: DataFrame, places: DataFrame, within: float, reach: float) -> DataFrame:
    """Points (point_id, x, y) with the nearest place (name, px, py, support) at most reach away, its bearing, and its name if within reach of a name.

    Both sides are dealt to squares of reach, a place to its own and the eight around it, so the join has an equal key.
    """
    at = lambda c: F.floor(F.col(c) / reach).cast("int")
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    p = places.withColumn("cx", at("px")).withColumn("cy", at("py")).withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step))
    p = p.select("name", "px", "py", "support", (F.col("cx") + F.col("_i")).alias("cx"), (F.col("cy") + F.col("_j")).alias("cy"))
    d = distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))
    near = points.withColumn("cx", at("x")).withColumn("cy", at("y")).join(p, ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= reach)
    best = near.groupBy("point_id").agg(F.min_by(F.struct("name", "d", (F.col("x") - F.col("px")).alias("dx"), (F.col("y") - F.col("py")).alias("dy")), F.struct("d", -F.col("support"), "name", "px", "py")).alias("b"))
    return points.join(best, "point_id", "left").select("point_id", F.when(F.col("b.d") <= within, F.col("b.name")).alias("name"), F.col("b.name").alias("nearest"), F.col("b.d").alias("d"), bearing(F.col("b.dx"), F.col("b.dy")).alias("bearing"))


def near_in_space_and_time(rows: DataFrame, others: DataFrame, keys: Sequence[str], places: Sequence[str], t: str, radius: float, before: float, after: float, prefix: str = "o_") -> DataFrame:
    """Pairs of rows and others of equal keys, at most radius apart, the other at most before earlier and after later; the others' columns get the prefix.

    Both sides are dealt to cubes of radius, radius and the time between before and after, the others to every cube that can reach
    theirs, so a pair meets in one cube and rows farther off never do.
    """
    x, y = places
    cell = lambda c, size: F.floor(F.col(c) / size).cast("long")
    long = max(before + after, 1e-9)
    o = others.select(*[F.col(c).alias(c if c in keys else f"{prefix}{c}") for c in others.columns])
    steps = {"_x": (x, radius, (-1, 0, 1)), "_y": (y, radius, (-1, 0, 1))}
    for name, (c, size, around) in steps.items():
        o = o.withColumn(name, F.explode(F.array(*[cell(f"{prefix}{c}", size) + i for i in around])))
    # a row at time r is reached by others in [r - before, r + after]
    reach = F.sequence(F.floor((F.col(f"{prefix}{t}") - after) / long).cast("long"), F.floor((F.col(f"{prefix}{t}") + before) / long).cast("long"))
    o = o.withColumn("_t", F.explode(reach))
    near = rows.withColumns({"_x": cell(x, radius), "_y": cell(y, radius), "_t": cell(t, long)}).join(o, [*keys, "_x", "_y", "_t"]).drop("_x", "_y", "_t")
    lag = F.col(f"{prefix}{t}") - F.col(t)
    return near.where((lag >= -before) & (lag <= after) & (distance(F.col(x), F.col(y), F.col(f"{prefix}{x}"), F.col(f"{prefix}{y}")) <= radius))


def squad_drops(landings: DataFrame, results: DataFrame, strategy: DataFrame) -> DataFrame:
    """One row per match and team: mean landing, its spread, first landing, what became of the team and how it began.

    results: match_id, team_id, name, win_place, kills, survived_s; strategy: match_id, account_id, hot_drop_n, first_weapon_s, which may
    lack accounts. contested is the most landings of others near any member, null if none is known.
    """
    keys = ["match_id", "team_id"]
    rows = landings.join(strategy.select("match_id", "account_id", "hot_drop_n", "first_weapon_s"), ["match_id", "account_id"], "left")
    mean = lambda c: (F.sum(c) / F.count(c)).alias(c)
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), mean("land_x"), mean("land_y"), F.min("land_t").alias("first_t"), F.collect_list(F.struct("land_x", "land_y")).alias("m"), F.max("hot_drop_n").alias("contested"), mean("first_weapon_s")
    )
    spread = F.array_max(F.transform("m", lambda p: distance(p["land_x"], p["land_y"], F.col("x"), F.col("y"))))
    g = g.withColumnsRenamed({"land_x": "x", "land_y": "y"}).withColumn("spread", spread).drop("m")
    best = F.min("win_place").alias("place"), F.sum("kills").alias("kills"), F.max("survived_s").alias("survived_s")
    r = results.groupBy(*keys).agg(*best, F.sort_array(F.collect_set("name")).alias("names"))
    return g.join(r, keys, "left")


def cluster_points(points: DataFrame, snap: float, shared: str) -> DataFrame:
    """Points (point_id, x, y) with cluster: occupied squares of side snap that touch, also at a corner, form one; its name is the least square's key as text.

    Work is done on squares, not points. Labels are passed to neighbours by an equal-key join until none changes; a pointer jump to the label's
    own label makes the rounds few. Every round is written below shared, and all but the last labels are removed.
    """
    placed = points.withColumn("cx", F.floor(F.col("x") / snap).cast("int")).withColumn("cy", F.floor(F.col("y") / snap).cast("int"))
    key = F.concat_ws(",", "cx", "cy")
    with rounds(points.sparkSession, shared, "clusters") as (kept, stays):
        cells = kept(placed.select("cx", "cy").distinct().withColumn("cell", key).withColumn("label", key))
        step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        while True:
            sent = cells.withColumn("s", F.explode(step)).select((F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), "label").groupBy("cx", "cy").agg(F.min("label").alias("heard"))
            heard = cells.join(sent, ["cx", "cy"]).select("cx", "cy", "cell", "label", F.least("label", "heard").alias("new"))
            own = heard.select(F.col("cell").alias("new"), F.col("new").alias("next"))
            now = kept(heard.join(own, "new").select("cx", "cy", "cell", F.col("label").alias("was"), F.least("new", "next").alias("label")))
            cells = now.drop("was")
            if now.where("was <> label").isEmpty():
                labels = stays(cells.select("cx", "cy", F.col("label").alias("cluster")))
                return placed.join(labels, ["cx", "cy"]).drop("cx", "cy")


#: Fixed value: members that land farther than this from their squad's centre make it a split drop (in centimetres).
SPLIT = 20_000.0


def summarised_clusters(rows: DataFrame) -> DataFrame:
    """Per cluster: number, lower median and best place, mean survival, kills per drop, the share contested among those where it is known,
    the lower median of the time of the first weapon, and how many squads were split. rows: squad_drops with cluster."""
    middle = lambda c: F.expr(f"percentile_disc(0.5) within group (order by {c})")
    known, n = F.count("contested"), F.count("*")
    return rows.groupBy("cluster").agg(
        n.alias("n"),
        middle("place").cast("long").alias("median_place"),
        F.min("place").alias("best_place"),
        (F.sum("survived_s").cast("double") / F.count("survived_s")).alias("mean_survived_s"),
        (F.sum("kills").cast("double") / n).alias("kills_per_drop"),
        known.alias("n_contested_known"),
        (F.count_if(F.col("contested") > 0).cast("double") / F.nullif(known, F.lit(0))).alias("contested_rate"),
        middle("first_weapon_s").alias("median_first_weapon_s"),
        F.count("first_weapon_s").alias("n_first_weapon_known"),
        F.count_if(F.col("spread") > SPLIT).alias("n_split"),
    )
