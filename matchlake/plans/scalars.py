"""Driver queries over scalar functions: every event is given one of a function's cases by its number.

The SQL holds the wanted values as literals, written down apart from the code.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions import norm
from matchlake.plans.view import EV, events

Q: dict = {}
SQL: dict = {}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return f"'{v}'" if isinstance(v, str) else repr(v)


def _case(i: Column, values: Sequence, kind: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), i)


def over_cases(name: str, cases: Sequence[tuple], kinds: str, function: Callable[..., Column], kind: str) -> None:
    """Registers a query of how often each value comes out. A case is its arguments and the value wanted, of an SQL type."""
    n, args = len(cases), kinds.split(", ")

    def run(spark, sf: str) -> DataFrame:
        i = (F.col("idx") % n).cast("int")
        given = [F.col(f"a{j}") for j in range(len(args))]
        e = events(spark, sf).select(i.alias("i"), *[_case(i, [c[j] for c in cases], k).alias(f"a{j}") for j, k in enumerate(args)])
        return e.select("i", function(*given).alias("value")).groupBy("i", "value").agg(F.count("*").alias("n"))

    wanted = ", ".join(f"({i}, CAST({_literal(c[-1])} AS {kind}))" for i, c in enumerate(cases))
    Q[name] = run
    SQL[name] = f"WITH {EV}, wanted(i, value) AS (VALUES {wanted}) SELECT CAST(idx % {n} AS INTEGER) AS i, value, count(*) AS n FROM ev JOIN wanted ON i = idx % {n} GROUP BY 1, 2"


def _info(weapon: Column, distance: Column, finish_weapon: Column, finish_distance: Column) -> Column:
    def block(w: Column, d: Column) -> Column:
        no = F.lit(None).cast("string")
        return F.struct(w.alias("damageCauserName"), no.alias("damageTypeCategory"), no.alias("damageReason"), d.alias("distance"), F.lit(None).cast("boolean").alias("isThroughPenetrableWall"))

    info = norm.damage_info(block(weapon, distance), block(finish_weapon, finish_distance))
    return F.concat_ws(" at ", F.coalesce(info["weapon"], F.lit("none")), F.coalesce(info["distance_cm"].cast("string"), F.lit("none")))


over_cases(
    "b1_parse_ts",
    [("2024-01-05T10:20:30.1234567Z", 1704450030123), ("2024-01-05T10:20:30Z", 1704450030000), ("2024-01-05T12:20:30+02:00", 1704450030000), ("yesterday", None), (None, None)],
    "string",
    lambda s: norm.ts_ms(norm.parse_ts(s)),
    "BIGINT",
)
over_cases("b2_is_plane_phase", [(0.0, False), (0.1, True), (0.5, False), (1.0, False), (None, None)], "double", norm.is_plane_phase, "BOOLEAN")
over_cases(
    "b3_phase_kind",
    [(1.0, 0.5, "announce"), (1.0, 1.0, "close"), (3.0, 2.5, "announce"), (3.0, 3.0, "close"), (1.0, 0.1, "announce"), (1.0, None, "close")],
    "double, double",
    norm.phase_kind,
    "VARCHAR",
)
over_cases(
    "b4_is_bot",
    [("user_ai", "account.1", True), ("USER_AI", None, True), ("user", "ai.7", True), ("user", "account.2", False), (None, None, False), ("user", "mail.ai.", False)],
    "string, string",
    norm.is_bot,
    "BOOLEAN",
)
over_cases("b5_has_vehicle", [("", False), (None, False), ("WheeledVehicle", True)], "string", norm.has_vehicle, "BOOLEAN")
over_cases("b6_normalise_weapon", [("Item_Weapon_AWM_C", "weapawm_c"), ("WeapAWM_C", "weapawm_c"), ("", ""), (None, "")], "string", norm.normalise_weapon, "VARCHAR")
over_cases(
    "b7_damage_info",
    [
        ("WeapAK47_C", 12.5, "WeapM24_C", 99.0, "WeapAK47_C at 12.5"),
        (None, None, "WeapM24_C", 99.0, "WeapM24_C at 99.0"),
        ("", -1.0, "WeapM24_C", 99.0, "none at -1.0"),
        (None, None, None, None, "none at none"),
    ],
    "string, double, string, double",
    _info,
    "VARCHAR",
)
over_cases(
    "b8_packages",
    [("Uaz_Armored_C", "flare"), ("BP_BRDM_C", "flare"), ("Carapackage_FlareGun_C", "flare"), ("Carapackage_RedBox_C", "rare"), ("Carepackage_Container_C", "plain"), (None, "plain")],
    "string",
    lambda p: F.when(norm.is_flare_vehicle(p), "flare").when(norm.is_crate_rare(p), "rare").otherwise("plain"),
    "VARCHAR",
)
over_cases(
    "b9_slots",
    [("Main", "Item_Weapon_AK47_C", "0/"), ("Headgear", "Item_Head_F_01_Lv2_C", "5/2"), ("BackPack", "Item_Back_C_01_Lv3_C", "7/3"), ("Throwable", "x", "4/"), ("HandGun", "x", "2/"), ("Ammo", "x", "/"), (None, None, "/")],
    "string, string",
    lambda c, i: F.concat_ws("/", F.coalesce(norm.slot_for(c).cast("string"), F.lit("")), F.coalesce(norm.armor_level(i).cast("string"), F.lit(""))),
    "VARCHAR",
)
_MAPS = [
    ("Baltic_Main", "Erangel 816000 7968.75"),
    ("Erangel_Main", "Erangel 816000 7968.75"),
    ("Desert_Main", "Miramar 816000 7968.75"),
    ("DihorOtok_Main", "Vikendi 816000 7968.75"),
    ("Tiger_Main", "Taego 816000 7968.75"),
    ("Kiki_Main", "Deston 816000 7968.75"),
    ("Neon_Main", "Rondo 816000 7968.75"),
    ("Savage_Main", "Sanhok 408000 8000.0"),
    ("Chimera_Main", "Paramo 306000 8000.0"),
    ("Summerland_Main", "Karakin 204000 8000.0"),
    ("Range_Main", "Camp Jackal 204000 8000.0"),
    ("Heaven_Main", "Haven 102000 8000.0"),
    ("New_Main", "New_Main 816000 7968.75"),
]
over_cases(
    "b10_maps",
    _MAPS,
    "string",
    lambda m: F.concat_ws(" ", norm.display_name(m), norm.world_size(m).cast("string"), norm.to_pixels(norm.world_size(m).cast("double"), m, 8000).cast("string")),
    "VARCHAR",
)
over_cases("b13_choose_tick_ms", [(1_800_000, 100), (6_499_999, 100), (6_500_000, 1000), (9_000_000, 1000)], "bigint", norm.choose_tick_ms, "INTEGER")
over_cases(
    "b15_flags",
    [
        (80.0, False, False, "", False, 1.0, 1),
        (0.0, True, False, "", False, 1.0, 2),
        (50.0, False, True, "WheeledVehicle", True, 1.0, 77),
        (50.0, False, True, "TransportAircraft", False, 0.1, 37),
        (50.0, False, False, "WheeledVehicle", False, 1.0, 1),
        (None, None, None, None, None, None, 0),
    ],
    "double, boolean, boolean, string, boolean, double",
    lambda health, knocked, riding, vehicle, blue, game: norm.flag_mask(**norm.sample_flags(health, knocked, riding, vehicle, blue, F.lit(False), game)),
    "INTEGER",
)
over_cases(
    "b16_weapon_label",
    [
        ("WeapHK416_C", "HK416"),
        ("Item_Weapon_AWM_C", "AWM"),
        ("WeapMacheteProjectile_C", "Machete"),
        ("PlayerMale_A_C", "fists"),
        ("UltAIPawn_Base_C", "fists"),
        ("ProjMolotov_C", "molotov"),
        ("BP_FireEffectController_C", "fire"),
        ("JerrycanFire", "fire"),
        ("ProjGrenade_C", "grenade"),
        ("ProjC4_C", "C4"),
        ("WeapPanzerFaust100M_Projectile_C", "Panzerfaust"),
        ("BlueZoneBomb_EffectActor_C", "blue zone"),
        ("Dacia_A_01_v2_C", "roadkill"),
        ("BP_Motorglider_C", "roadkill"),
        ("BP_BRDM_C", "roadkill"),
        ("Snowmobile_01_C", "roadkill"),
        ("Bluezone", "Bluezone"),
        ("None", "—"),
        ("", "—"),
        (None, "—"),
    ],
    "string",
    norm.weapon_label,
    "VARCHAR",
)
over_cases(
    "b17_item_label",
    [
        ("Item_Head_F_01_Lv2_C", "Lv2 Helmet"),
        ("Item_Armor_D_01_Lv1_C", "Lv1 Vest"),
        ("Item_Back_C_01_Lv3_C", "Lv3 Backpack"),
        ("Item_Attach_Weapon_Muzzle_AR_MuzzleBrake_C", "AR Muzzle Brake"),
        ("Item_Ammo_556mm_C", "5.56mm"),
        ("Item_Ammo_300Magnum_C", "300 Magnum"),
        ("Item_Heal_FirstAid_C", "First Aid"),
        ("Item_Weapon_AK47_C", "AK47"),
        (None, "—"),
    ],
    "string",
    lambda x: norm.item_label(x, with_piece=True),
    "VARCHAR",
)
over_cases(
    "b18_labels",
    [
        ("squad-fpp", "sosnovkamilitarybase", "Squad FPP, Sosnovka Military Base"),
        ("duo", "pochinki", "Duo, Pochinki"),
        ("normal-solo-tpp", "novoplace", "Normal Solo TPP, Novoplace"),
        ("", "FerryPier", "—, Ferry Pier"),
        (None, None, "—, unnamed"),
    ],
    "string, string",
    lambda m, p: F.concat_ws(", ", norm.mode_label(m), norm.place_label(p)),
    "VARCHAR",
)
over_cases("b19_bearing", [(0.0, -1.0, "N"), (1.0, -1.0, "NE"), (1.0, 0.0, "E"), (0.0, 5.0, "S"), (-1.0, 0.0, "W"), (-1.0, -1.0, "NW"), (None, 1.0, None), (1.0, None, None)], "double, double", norm.bearing, "VARCHAR")
over_cases("b20_place_grade", [(1, "win"), (2, "top5"), (5, "top5"), (6, "top10"), (10, "top10"), (11, "rest"), (104, "rest"), (None, "rest")], "int", norm.place_grade, "VARCHAR")


def b23_kills_column(spark, sf: str) -> DataFrame:
    """Kills with and without bots."""
    kills = events(spark, sf).select("match_id", (F.col("idx") % 7).alias("kills"), F.when(F.col("idx") % 3 > 0, F.col("idx") % 5).alias("kills_human"))
    both = [F.sum(norm.kills_column(x)).alias(a) for x, a in ((True, "with_bots"), (False, "humans"))]
    return kills.groupBy("match_id").agg(*both)


Q["b23_kills_column"] = b23_kills_column
SQL["b23_kills_column"] = f"WITH {EV} SELECT match_id, CAST(sum(idx % 7) AS BIGINT) AS with_bots, CAST(sum(CASE WHEN idx % 3 > 0 THEN idx % 5 ELSE idx % 7 END) AS BIGINT) AS humans FROM ev GROUP BY 1"


def b25_name_search(spark, sf: str) -> DataFrame:
    """Customers by a part of their name, whatever its case, that are tracked or once were."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name", (F.col("c_custkey") % 3 == 0).alias("tracked"), F.when(F.col("c_custkey") % 2 == 0, F.lit(1)).alias("untracked_at"))
    found = c.where(norm.name_search(F.col("c_name"), "CUSTOMER#0000000"))
    return found.where(norm.tracked_filter(True) | norm.tracked_filter(formerly=True)).select("c_custkey", "tracked")


Q["b25_name_search"] = b25_name_search
SQL["b25_name_search"] = "SELECT c_custkey, c_custkey % 3 = 0 AS tracked FROM customer WHERE lower(c_name) LIKE '%customer#0000000%' AND (c_custkey % 3 = 0 OR c_custkey % 2 = 0)"


def b1_times_of_events(spark, sf: str) -> DataFrame:
    """Every event's own time written in several ways and read back: with seven digits, without a zone, with an offset, and one that can't be read."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    said = lambda ts: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    way = F.col("event_id") % 4
    later = said(F.col("ts") + F.make_dt_interval(hours=F.lit(2)))
    text = F.when(way == 0, F.concat(said(F.col("ts")), F.lit("9Z"))).when(way == 1, said(F.col("ts"))).when(way == 2, F.concat(later, F.lit("+02:00"))).otherwise(F.concat(F.lit("at "), said(F.col("ts"))))
    return e.select("event_id", norm.ts_ms(norm.parse_ts(text)).alias("ms"))


Q["b1_times_of_events"] = b1_times_of_events
SQL["b1_times_of_events"] = "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(epoch_us(ts) // 1000 AS BIGINT) END AS ms FROM events"


def b_states_of_events(spark, sf: str) -> DataFrame:
    """Phases, bots, vehicles and weapons named out of every event's own columns."""
    i, t = F.col("idx"), F.col("t_s")
    phase = F.floor(t / 3600).cast("double")
    game = F.when(i % 5 == 0, F.lit(0.1)).when(t % 2 == 0, phase - 0.5).otherwise(phase)
    kind = F.when(F.col("account_id") % 7 == 0, F.upper(F.concat(F.lit("user_"), F.lit("ai")))).otherwise(F.col("kind"))
    account = F.when(F.col("victim_id") % 5 == 0, F.concat(F.lit("ai."), F.col("account_id").cast("string"))).otherwise(F.col("account_id").cast("string"))
    vehicle = F.when(F.col("kind") == "position", F.lit("")).when(F.col("kind") != "hit", F.col("kind"))
    weapon = F.concat(F.when(i % 2 == 0, F.lit("Item_Weapon_")).otherwise(F.lit("Weap")), F.initcap("kind"), F.lit("_C"))
    return events(spark, sf).select(
        "idx", norm.is_plane_phase(game).alias("plane"), norm.phase_kind(phase, game).alias("phase_kind"), norm.is_bot(kind, account).alias("bot"), norm.has_vehicle(vehicle).alias("rides"),
        norm.normalise_weapon(weapon).alias("weapon"), norm.place_grade((F.col("account_id") % 14 + 1).cast("int")).alias("grade"), norm.choose_tick_ms(t * 100).alias("tick_ms"),
    )


Q["b_states_of_events"] = b_states_of_events
SQL["b_states_of_events"] = f"""WITH {EV} SELECT idx, idx % 5 = 0 AS plane, CASE WHEN idx % 5 = 0 OR t_s % 2 = 0 THEN 'announce' ELSE 'close' END AS phase_kind, account_id % 7 = 0 OR victim_id % 5 = 0 AS bot,
kind NOT IN ('position', 'hit') AS rides, 'weap' || kind || '_c' AS weapon, CASE WHEN account_id % 14 = 0 THEN 'win' WHEN account_id % 14 < 5 THEN 'top5' WHEN account_id % 14 < 10 THEN 'top10' ELSE 'rest' END AS grade,
CASE WHEN t_s * 100 < 6500000 THEN 100 ELSE 1000 END AS tick_ms FROM ev"""
