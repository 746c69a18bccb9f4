"""Telemetry, match and listing files as tables; tables whose rows are replaced match by match.

Files are JSON, gzipped or plain; the name up to the first dot is the match. A file
that can't be read as what it should be goes to bad_files, and never stops the rest.
Telemetry is streamed out of its files (telemetry_source); match files and listings are one row each until
they are exploded.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.functions.norm import parse_ts
from matchlake.operators.rounds import rounds
from matchlake.sources.telemetry_source import stream_telemetry

#: The figures of a participant in a match file.
STATS = (
    "DBNOs",
    "assists",
    "boosts",
    "damageDealt",
    "deathType",
    "headshotKills",
    "heals",
    "killPlace",
    "killStreaks",
    "kills",
    "longestKill",
    "name",
    "playerId",
    "revives",
    "rideDistance",
    "roadKills",
    "swimDistance",
    "teamKills",
    "timeSurvived",
    "vehicleDestroys",
    "walkDistance",
    "weaponsAcquired",
    "winPlace",
)
TEXTS, FRACTIONS = ("deathType", "name", "playerId"), ("damageDealt", "longestKill", "rideDistance", "swimDistance", "walkDistance", "timeSurvived")
#: The column by which tables of matches are put into folders.
DAY = "match_day"
MATCH = {"shard": "shardId", "map_name": "mapName", "game_mode": "gameMode", "match_type": "matchType", "season_state": "seasonState", "title_id": "titleId", "is_custom_match": "isCustomMatch", "duration_s": "duration", "played_at": "createdAt"}


def of(v: str | Column, *paths: str, kind: str = "string") -> Column:
    """The first path that the variant has, as kind; null where it is of another kind."""
    return F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])


def match_of(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"([^/.]+)[^/]*$", 1)


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """match_id, value: whole files."""
    return spark.read.text(path, wholetext=True).select(match_of(F.col("_metadata.file_name")).alias("match_id"), "value")


def _list(value: str) -> Column:
    return F.try_variant_get(F.try_parse_json(value), "$", "array<variant>")


def _event(kind: str | Column) -> list[Column]:
    return [kind, parse_ts(of("ev", "$._D")).alias("ts"), of("ev", "$.common.isGame", kind="double").alias("is_game"), F.col("ev")]


def telemetry(raw: DataFrame) -> DataFrame:
    """match_id, idx (place in the file, the order that counts), kind (lower case), ts, is_game and ev, the event itself, out of whole files."""
    rows = raw.select("match_id", F.posexplode(_list("value")).alias("idx", "ev"))
    return rows.select("match_id", "idx", *_event(F.lower(of("ev", "$._T")).alias("kind")))


def bad_files(raw: DataFrame) -> DataFrame:
    """match_id and reason of files that hold no list of events."""
    return raw.where(_list("value").isNull()).select("match_id", F.when(F.try_parse_json("value").isNull(), "not JSON").otherwise("not a list").alias("reason"))


def events_of(rows: DataFrame) -> DataFrame:
    """The columns of telemetry() out of rows of the streaming source."""
    read = rows.where("error is null").select("match_id", F.col("idx").cast("int").alias("idx"), "kind", F.try_parse_json("ev").alias("ev"))
    return read.select("match_id", "idx", *_event(F.col("kind")))


def read_telemetry(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    """The events of the files below path, of the given kinds only if there are any, streamed from the files; a file that is no list has none."""
    rows = stream_telemetry(spark, path)
    return events_of(rows.where(F.col("kind").isin(*kinds)) if kinds else rows)


def time_sorted(events: DataFrame) -> DataFrame:
    """events with seq, their rank by time in the match; equal times keep the file's order, times that can't be read come first."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("match_id").orderBy(F.col("ts").asc_nulls_first(), "idx")) - 1)


def character(role: str) -> Column:
    """A role's account, team, kind, health and place; a character may be wrapped in another, and a place left out is the origin."""
    at = lambda field, kind="string": of("ev", f"$.{role}.character.{field}", f"$.{role}.{field}", kind=kind)
    return F.struct(
        at("accountId").alias("account_id"), at("name").alias("name"), at("teamId", "int").alias("team_id"), at("type").alias("type"), at("health", "double").alias("health"), at("isInBlueZone", "boolean").alias("in_blue"),
        *[F.coalesce(at(f"location.{c}", "double"), F.lit(0.0)).alias(c) for c in ("x", "y", "z")],
    )


#: Which characters of which events show where they are.
ROLES = {
    "logplayerposition": ("character",),
    "logparachutelanding": ("character",),
    "logplayerattack": ("attacker",),
    "logplayertakedamage": ("attacker", "victim"),
    "logplayermakegroggy": ("attacker", "victim"),
    "logplayerkillv2": ("victim", "killer", "finisher", "dBNOMaker"),
    "logplayerkill": ("victim", "killer"),
    "logplayerrevive": ("reviver", "victim"),
    "logheal": ("character",),
    "logvehicleride": ("character",),
    "logvehicleleave": ("character",),
}


def positions(events: DataFrame) -> DataFrame:
    """One sample per event and character in it: match_id, idx, ts, kind, role and the character's columns. Characters without an account give none."""
    by_kind = F.create_map(*[x for k, roles in ROLES.items() for x in (F.lit(k), F.array(*map(F.lit, roles)))])
    roles = sorted({r for x in ROLES.values() for r in x})
    said = F.array(*[F.struct(F.lit(r).alias("role"), character(r).alias("c")) for r in roles])
    rows = events.where(F.col("kind").isin(*ROLES)).withColumn("_roles", by_kind[F.col("kind")])
    return rows.select("match_id", "idx", "ts", "kind", "_roles", F.explode(said).alias("s")).where("array_contains(_roles, s.role) and s.c.account_id is not null").select("match_id", "idx", "ts", "kind", "s.role", "s.c.*")


def phases(events: DataFrame) -> DataFrame:
    """match_id, idx, ts, phase, is_game and the accounts in the white circle at every change of phase."""
    rows = events.where("kind = 'logphasechange'")
    return rows.select("match_id", "idx", "ts", of("ev", "$.phase", kind="int").alias("phase"), "is_game", of("ev", "$.playersInWhiteCircle", kind="array<string>").alias("members"))


def item_events(events: DataFrame) -> DataFrame:
    """match_id, idx, ts, kind, account_id and what item events say: item, stack, category, sub_category, attached, parent, child, owner."""
    rows = events.where("kind like 'logitem%' or kind = 'logarmordestroy'")
    account = F.when(F.col("kind") == "logarmordestroy", of("ev", "$.victim.accountId")).otherwise(of("ev", "$.character.accountId"))
    parent = of("ev", "$.parentItem.itemId")
    attached = F.array_sort(F.coalesce(of("ev", "$.parentItem.attachedItems", "$.item.attachedItems", kind="array<string>"), F.array().cast("array<string>")))
    return rows.select("match_id", "idx", "ts", "kind", account.alias("account_id"), F.coalesce(parent, of("ev", "$.item.itemId")).alias("item"), of("ev", "$.item.stackCount", kind="bigint").alias("stack"), of("ev", "$.item.category").alias("category"), of("ev", "$.item.subCategory").alias("sub_category"), attached.alias("attached"), of("ev", "$.childItem.itemId").alias("child"), of("ev", "$.ownerCharacter.accountId", "$.owner.accountId").alias("owner"))


def replay_zones(events: DataFrame) -> DataFrame:
    """The circles at every periodic state: blue and white centre and radius, and who is left."""
    at = lambda p, kind="double": of("ev", f"$.gameState.{p}", kind=kind)
    return events.where("kind = 'loggamestateperiodic'").select("match_id", "idx", "ts", at("safetyZonePosition.x").alias("blue_x"), at("safetyZonePosition.y").alias("blue_y"), at("safetyZoneRadius").alias("blue_r"), at("poisonGasWarningPosition.x").alias("white_x"), at("poisonGasWarningPosition.y").alias("white_y"), at("poisonGasWarningRadius").alias("white_r"), at("numAlivePlayers", "int").alias("alive_players"), at("numAliveTeams", "int").alias("alive_teams"))


def replay_red_zones(events: DataFrame) -> DataFrame:
    at = lambda p, kind="double": of("ev", f"$.zoneInfo.{p}", kind=kind)
    return events.where("kind = 'logspecialzoneincharacters'").select("match_id", "idx", "ts", at("zoneType", "string").alias("zone_type"), F.lower(at("zoneState", "string")).alias("state"), at("uniqueId", "bigint").alias("uid"), at("position.x").alias("x"), at("position.y").alias("y"), at("horizontalRadius").alias("r"))


def replay_hits(events: DataFrame) -> DataFrame:
    rows = events.where("kind = 'logplayertakedamage'").select("match_id", "idx", "ts", character("attacker").alias("a"), character("victim").alias("v"), of("ev", "$.damage", kind="double").alias("damage"), F.lower(of("ev", "$.damageTypeCategory")).alias("category"), of("ev", "$.damageCauserName").alias("causer"))
    return rows.where("a.account_id is not null and v.account_id is not null").select("match_id", "idx", "ts", F.col("a.account_id").alias("account_id"), F.col("v.account_id").alias("victim_id"), "damage", "category", "causer", F.col("a.x").alias("x"), F.col("a.y").alias("y"), F.col("v.x").alias("vx"), F.col("v.y").alias("vy"))


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()


def match_tables(raw: DataFrame) -> dict[str, DataFrame]:
    """matches, rosters, participants and accounts out of match files (match_id, value).

    A participant's team is that of the roster that names it; those that no roster names are left out. Of an account
    that appears again in a match the last one counts.
    """
    doc = raw.select(F.try_parse_json("value").alias("d")).select(of("d", "$.data.id").alias("match_id"), "d", of("d", "$.included", kind="array<variant>").alias("included")).where("match_id is not null")
    asset = F.filter("included", lambda x: of(x, "$.type") == "asset")
    fields = [of("d", f"$.data.attributes.{v}", kind="boolean" if k.startswith("is_") else "int" if k.endswith("_s") else "string").alias(k) for k, v in MATCH.items()]
    matches = doc.select("match_id", *[parse_ts(c).alias("played_at") if n == "played_at" else c for n, c in zip(MATCH, fields)], of(F.get(asset, 0), "$.attributes.URL", "$.attributes.url").alias("telemetry_url"))
    parts = doc.select("match_id", F.posexplode("included").alias("pos", "x")).withColumn("type", of("x", "$.type"))
    rosters = parts.where("type = 'roster'").select("match_id", of("x", "$.attributes.stats.teamId", kind="int").alias("team_id"), of("x", "$.attributes.stats.rank", kind="int").alias("rank"), (F.lower(of("x", "$.attributes.won")) == "true").alias("won"), of("x", "$.relationships.participants.data", kind="array<variant>").alias("members"))
    named = rosters.select("match_id", "team_id", F.explode("members").alias("m")).select("match_id", "team_id", of("m", "$.id").alias("pid"))
    kind = lambda s: "string" if s in TEXTS else "double" if s in FRACTIONS else "int"
    stats = [of("x", f"$.attributes.stats.{s}", kind=kind(s)).alias("account_id" if s == "playerId" else _snake(s)) for s in STATS]
    people = parts.where("type = 'participant'").select("match_id", "pos", of("x", "$.id").alias("pid"), *stats).join(named, ["match_id", "pid"])
    cols = [c for c in people.columns if c not in ("match_id", "account_id")]
    last = people.groupBy("match_id", "account_id").agg(F.max_by(F.struct(*cols), "pos").alias("r")).select("match_id", "account_id", "r.*").drop("pos", "pid")
    accounts = last.join(matches.select("match_id", "shard", "played_at"), "match_id").groupBy("account_id").agg(F.max_by("name", F.struct("played_at", "match_id")).alias("name"), F.max_by("shard", F.struct("played_at", "match_id")).alias("shard"))
    return {"matches": matches, "rosters": rosters.drop("members"), "participants": last, "accounts": accounts}


def read_matches(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return match_tables(raw_files(spark, path))


def read_player_listing(spark: SparkSession, path: str) -> DataFrame:
    """account_id, name, match_id: the matches that listings of players name, and a row without one for players that have none."""
    data = raw_files(spark, path).select(F.explode(of(F.try_parse_json("value"), "$.data", kind="array<variant>")).alias("p"))
    named = data.select(of("p", "$.id").alias("account_id"), of("p", "$.attributes.name").alias("name"), F.explode_outer(of("p", "$.relationships.matches.data", kind="array<variant>")).alias("m"))
    return named.select("account_id", "name", of("m", "$.id").alias("match_id"))


def profile_schema(events: DataFrame, shared: str, depth: int = 6, items: int = 8, most_values: int = 40) -> DataFrame:
    """Per kind and path of a field (at most depth steps, the first items of lists): n, types, the number of its values and, if they are no more than most_values, values.

    The events are read once: each level of fields is written below shared and unnested into the next. Values are counted before any
    are listed, so a field of free text is never collected.
    """
    with rounds(events.sparkSession, shared, "profile") as (kept, stays):
        level, seen = events.select("kind", F.lit("").alias("path"), F.col("ev").alias("v")), None
        for _ in range(depth):
            fields = F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), lambda x: F.struct(F.concat_ws(".", F.nullif("path", F.lit("")), x["key"]).alias("path"), x["value"].alias("v")))
            lists = F.transform(F.slice(F.try_variant_get("v", "$", "array<variant>"), 1, items), lambda x: F.struct(F.concat("path", F.lit("[]")).alias("path"), x.alias("v")))
            level = kept(level.select("kind", F.explode(F.coalesce(fields, lists)).alias("x")).select("kind", "x.path", "x.v"))
            seen = level if seen is None else seen.unionByName(level)
            if level.isEmpty():
                break
        flat = seen.select("kind", "path", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0).alias("type"), F.try_variant_get("v", "$", "string").alias("value"))
        plain = kept(flat.groupBy("kind", "path", "type", F.when(~F.col("type").isin("OBJECT", "ARRAY"), F.col("value")).alias("value")).agg(F.count("*").alias("m")))
        total = plain.groupBy("kind", "path").agg(F.sum("m").alias("n"), F.sort_array(F.collect_set("type")).alias("types"), F.count("value").alias("n_values"))
        few = plain.where("value is not null").join(total.where(F.col("n_values") <= most_values).select("kind", "path"), ["kind", "path"]).groupBy("kind", "path").agg(F.sort_array(F.collect_set("value")).alias("values"))
        return stays(total.join(few, ["kind", "path"], "left"))


def unimported(spark: SparkSession, path: str, matches: DataFrame) -> DataFrame:
    """Files, by name only, whose match isn't there yet."""
    files = spark.read.format("binaryFile").load(path).select("path", match_of(F.col("path")).alias("match_id"))
    return files.join(matches.select("match_id"), "match_id", "left_anti")


def write_table(df: DataFrame, path: str, *by: str, mode: str = "overwrite") -> None:
    """Parquet in folders by the given columns; the folder's rows are brought together first, so each gets few files."""
    (df.repartition(*by) if by else df).write.mode(mode).partitionBy(*by).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def of_parts(spark: SparkSession, path: str, parts: Sequence[Any], by: str) -> DataFrame:
    """The rows of a table in the given partitions; the others' folders aren't read."""
    return spark.read.parquet(path).where(F.col(by).isin(list(parts)))


def replace_parts(rows: DataFrame, path: str, by: str, parts: Sequence[Any]) -> None:
    """Makes rows all that the table holds in the given partitions, which may leave some of them empty.

    Rows are staged first, as they may come from the table itself, and then overwrite their partitions alone.
    """
    spark, staged = rows.sparkSession, f"{path}-staged/{uuid.uuid4().hex}"
    rows.repartition(by).write.partitionBy(by).parquet(staged)
    new = spark.read.schema(rows.schema).parquet(staged)
    full = {r[by] for r in new.select(by).distinct().collect()}  # as many rows as parts
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    for part in parts:
        if part not in full:
            remove(spark, f"{path}/{by}={part}")
    remove(spark, staged)


def replace_matches(rows: DataFrame, touched: DataFrame, path: str, by: str = DAY) -> None:
    """Makes rows all that the table holds of the touched matches (match_id and the day each belongs to), which may be fewer rows than before, or none.

    The table has a folder for each day, and only those of the touched matches are read and written. A run that is repeated
    gives the same table.
    """
    spark = rows.sparkSession
    days = [r[by] for r in touched.select(by).distinct().collect()]  # the days of a batch
    if exists(spark, path) and days:
        others = of_parts(spark, path, days, by).join(touched.select("match_id", by), ["match_id", by], "left_anti")
        rows = others.select(*rows.columns).unionByName(rows)
    replace_parts(rows, path, by, days)
