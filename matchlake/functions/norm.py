"""Scalar functions over columns: times, flags, geometry, labels, scopes and rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Game-state codes, sizes in centimetres, slots, vehicle kinds, scopes and labels.
PLANE, IN_PLAY, TOLERANCE = 0.1, 1.0, 1e-6
WORLD_SIZES = {
    "baltic_main": 816_000,
    "erangel_main": 816_000,
    "desert_main": 816_000,
    "dihorotok_main": 816_000,
    "tiger_main": 816_000,
    "kiki_main": 816_000,
    "neon_main": 816_000,
    "savage_main": 408_000,
    "chimera_main": 306_000,
    "summerland_main": 204_000,
    "range_main": 204_000,
    "heaven_main": 102_000,
}
MAP_NAMES = {
    "baltic_main": "Erangel",
    "erangel_main": "Erangel",
    "desert_main": "Miramar",
    "savage_main": "Sanhok",
    "dihorotok_main": "Vikendi",
    "summerland_main": "Karakin",
    "chimera_main": "Paramo",
    "heaven_main": "Haven",
    "tiger_main": "Taego",
    "kiki_main": "Deston",
    "neon_main": "Rondo",
    "range_main": "Camp Jackal",
}
IMAGE_SCALE = 8160 / 8192
TICK_MS, LONG_TICK_MS, TICKS = 100, 1000, 65_000
FLARE_MARKERS, RARE_MARKER = ("uaz_armored", "bp_brdm", "flaregun"), "redbox"
CAUSERS = (
    ("bluezonebomb", "blue zone"),
    ("molotov", "molotov"),
    ("jerrycanfire", "fire"),
    ("fireeffect", "fire"),
    ("projgrenade", "grenade"),
    ("projc4", "C4"),
    ("panzerfaust", "Panzerfaust"),
    ("playermale", "fists"),
    ("playerfemale", "fists"),
    ("ultaipawn", "fists"),
)
VEHICLES = ("dacia", "uaz", "buggy", "coupe", "motorbike", "rony", "mirado", "scooter", "van", "minibus", "pickup", "boat", "aquarail", "snowmobile", "motorglider", "brdm")
ARMOUR = {"Head": "Helmet", "Armor": "Vest", "Back": "Backpack"}
PLACES = {
    "sosnovkamilitarybase": "Sosnovka Military Base",
    "yasnayapolyana": "Yasnaya Polyana",
    "myltapower": "Mylta Power",
    "ferrypier": "Ferry Pier",
    "shootingrange": "Shooting Range",
}
DEFAULT_WORLD = 816000
GRID = 256
SLOTS = {"main": 0, "handgun": 2, "melee": 3, "throwable": 4, "headgear": 5, "vest": 6, "backpack": 7}
DRIVEN = ("wheeledvehicle", "floatingvehicle", "flyingvehicle")
CAREER_TYPES = ("official",)
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
NOTHING = "—"


def parse_ts(s: Column) -> Column:
    """ISO-8601 to a timestamp; further digits of a fraction are cut, naive times are UTC whatever the session's zone, bad input is null (not the epoch)."""
    zoned = F.when(F.rlike(s, F.lit(r"\d:\d\d.*(Z|z|[+-]\d\d(:?\d\d)?)$")), s).when(F.rlike(s, F.lit(r"^\d{4}-\d\d-\d\d$")), F.concat(s, F.lit("T00:00:00Z"))).otherwise(F.concat(s, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def ts_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def is_plane_phase(is_game: Column) -> Column:
    return F.abs(is_game - PLANE) < TOLERANCE


def is_in_play(is_game: Column) -> Column:
    return is_game >= IN_PLAY - TOLERANCE


def phase_kind(phase: Column, is_game: Column) -> Column:
    """announce while the state is half a phase before it (or the plane's), else close."""
    early = (F.abs(is_game - (phase - 0.5)) < TOLERANCE) | is_plane_phase(is_game)
    return F.when(F.coalesce(early, F.lit(False)), F.lit("announce")).otherwise(F.lit("close"))


def is_bot(kind: Column, account: Column) -> Column:
    return (F.coalesce(F.lower(kind), F.lit("")) == "user_ai") | F.coalesce(F.startswith(account, F.lit("ai.")), F.lit(False))


def has_vehicle(vehicle_type: Column) -> Column:
    return F.nullif(vehicle_type, F.lit("")).isNotNull()


def normalise_weapon(raw: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(raw, F.lit("")), "^Item_Weapon_", "Weap"))


def of_table(key: Column, table: dict, default: Column) -> Column:
    """The table's value of a lower-cased key, else default."""
    return F.coalesce(reduce(lambda e, kv: e.when(F.lower(key) == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), default)), default)


def damage_info(own: Column, finish: Column) -> Column:
    """The killer's damage block, or the finisher's if that one is null or empty (all of its fields are null), by one set of names.

    Blocks are structs of damageCauserName, damageTypeCategory, damageReason, distance and isThroughPenetrableWall. Empty texts are null.
    """
    fields = ("damageCauserName", "damageTypeCategory", "damageReason", "distance", "isThroughPenetrableWall")
    known = F.coalesce(*[own[x].cast("string") for x in fields]).isNotNull()
    of = lambda x: F.when(known, own[x]).otherwise(finish[x])
    text = lambda x: F.nullif(of(x), F.lit(""))
    return F.struct(
        text("damageCauserName").alias("weapon"),
        text("damageTypeCategory").alias("damage_type"),
        text("damageReason").alias("damage_reason"),
        of("distance").cast("double").alias("distance_cm"),
        of("isThroughPenetrableWall").alias("through_wall"),
    )


def is_flare_vehicle(package: Column) -> Column:
    """Whether a care package is a vehicle called by a flare."""
    low = F.lower(F.coalesce(package, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in FLARE_MARKERS])


def is_crate_rare(package: Column) -> Column:
    return F.contains(F.lower(F.coalesce(package, F.lit(""))), F.lit(RARE_MARKER))


def slot_for(category: Column) -> Column:
    """Slot number of a category; unknown ones have none."""
    return reduce(lambda e, kv: e.when(F.lower(category) == kv[0], F.lit(kv[1])), SLOTS.items(), F.when(F.lit(False), F.lit(0)))


def armor_level(item: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(item, r"_Lv(\d)", 1), F.lit("")), F.lit("9")).cast("int")


def world_size(map_name: Column) -> Column:
    return of_table(map_name, WORLD_SIZES, F.lit(DEFAULT_WORLD))


def display_name(map_name: Column) -> Column:
    return of_table(map_name, MAP_NAMES, map_name)


def image_scale(map_name: Column) -> Column:
    """The images of the largest maps are wider than the world they show."""
    return F.when(world_size(map_name) == 816_000, F.lit(IMAGE_SCALE)).otherwise(F.lit(1.0))


def to_pixels(cm: Column, map_name: Column, image_px: int) -> Column:
    return cm / world_size(map_name) * image_px * image_scale(map_name)


def grid_cell(v: Column, world: Column | int, grid: int = GRID) -> Column:
    world = F.lit(world) if isinstance(world, int) else world
    return (F.least(F.greatest(v, F.lit(0.0)), world - 1) / world * grid).cast("int")


def quantise_u16(v: Column, world: Column | int) -> Column:
    world = F.lit(world) if isinstance(world, int) else world
    return F.least(F.greatest(F.bround(v / world * 65535), F.lit(0.0)), F.lit(65535.0)).cast("int")


def dequantise_u16(q: Column, world: Column | int) -> Column:
    return q / 65535.0 * world


def tick(t_s: Column, tick_ms: int) -> Column:
    return F.least(F.greatest(F.floor(t_s * 1000 / tick_ms), F.lit(0)), F.lit(65535)).cast("int")


def choose_tick_ms(duration_ms: Column) -> Column:
    """Short ticks unless the match has more of them than 16 bits count."""
    return F.when(F.floor(duration_ms / TICK_MS) < TICKS, F.lit(TICK_MS)).otherwise(F.lit(LONG_TICK_MS))


def health_after(health: Column, change: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), health + F.coalesce(change, F.lit(0.0))))


def flag_mask(**bits: Column) -> Column:
    """Named flags to a mask, the first is bit 0."""
    parts = [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(bits.values())]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def sample_flags(health: Column, knocked: Column, in_vehicle: Column, vehicle_type: Column, in_blue: Column, in_red: Column, is_game: Column) -> dict[str, Column]:
    """The seven flags of a position sample, in the order of flag_mask's bits. Driven: in a vehicle that is driven around the map."""
    riding = F.coalesce(in_vehicle, F.lit(False))
    driven = F.lower(F.coalesce(vehicle_type, F.lit(""))).isin(*DRIVEN)
    return {"alive": health > 0, "knocked": knocked, "in_vehicle": riding, "blue_zone": in_blue, "red_zone": in_red, "plane_phase": is_plane_phase(is_game), "driving": riding & driven}


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def bearing(dx: Column, dy: Column) -> Column:
    """One of eight compass points; y grows to the south. Null if dx or dy is."""
    step = F.pmod(F.floor((F.degrees(F.atan2(dx, -dy)) + 22.5) / 45), F.lit(8)).cast("int")
    return F.when(step.isNotNull(), F.get(F.array(*[F.lit(c) for c in COMPASS]), step))


def place_grade(place: Column) -> Column:
    return F.when(place == 1, "win").when(place <= 5, "top5").when(place <= 10, "top10").otherwise("rest")


def _said(raw: Column, label: Column) -> Column:
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(NOTHING)).otherwise(label)


def weapon_label(raw: Column) -> Column:
    """Readable name of a damage causer; a vehicle is a roadkill, what isn't known keeps its tidied id."""
    low = F.lower(raw)
    ridden = low.rlike(f"^(bp_)?({'|'.join(VEHICLES)})")
    bare = raw
    for pattern in ("^Item_Weapon_", "^Weap", "_C$", "Projectile$"):
        bare = F.regexp_replace(bare, pattern, "")
    tidy = F.trim(F.translate(bare, "_", " "))
    label = reduce(lambda e, kv: e.when(F.contains(low, F.lit(kv[0])), F.lit(kv[1])), CAUSERS, F.when(raw == "None", F.lit(NOTHING)))
    return _said(raw, label.when(ridden, F.lit("roadkill")).otherwise(tidy))


def item_label(raw: Column, with_piece: bool = False) -> Column:
    """Readable name of an item: armour by its level (and piece), attachments without their category, calibres with their point."""
    bare = F.regexp_replace(F.regexp_replace(raw, "_C$", ""), "^Item_", "")
    piece, level = F.regexp_extract(bare, "^(Head|Armor|Back)_", 1), F.regexp_extract(bare, r"_Lv(\d)$", 1)
    tier = F.concat(F.lit("Lv"), level)
    if with_piece:
        tier = F.concat_ws(" ", tier, reduce(lambda e, kv: e.when(piece == kv[0], F.lit(kv[1])), ARMOUR.items(), F.when(F.lit(False), F.lit(""))))
    name = bare
    for pattern in ("^Attach_Weapon_", "^Weapon_", "^Weap", "^(Ammo|Heal|Boost|Attach)_", "^(Muzzle|Magazine|Stock|Lower|Upper|SideRail)_"):
        name = F.regexp_replace(name, pattern, "")
    name = F.regexp_replace(F.translate(name, "_", " "), "([a-z0-9])([A-Z])", "$1 $2")
    name = F.trim(F.regexp_replace(name, r"\b(\d)(\d\d)mm\b", "$1.$2mm"))
    return _said(raw, F.when((piece != "") & (level != ""), tier).otherwise(name))


def mode_label(mode: Column) -> Column:
    """Parts of a mode as words, perspectives in capitals."""
    word = lambda p: F.when(p.isin("fpp", "tpp"), F.upper(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))
    return _said(mode, F.array_join(F.transform(F.filter(F.split(mode, "-"), lambda p: p != ""), word), " "))


def place_label(raw: Column) -> Column:
    """Name of a place as printed on the map; one that isn't known gets a capital."""
    capital = F.concat(F.upper(F.substring(raw, 1, 1)), F.substring(raw, 2, 1 << 30))
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit("unnamed")).otherwise(of_table(raw, PLACES, capital))


def career_filter(match_type: Column, types=CAREER_TYPES) -> Column:
    return match_type.isin(*types)


def match_scope(map_name: str | None = None, mode: str | None = None) -> list[Column]:
    return [F.col(c) == v for c, v in (("map_name", map_name), ("game_mode", mode)) if v is not None]


def kills_column(include_bots: bool) -> Column:
    return F.col("kills") if include_bots else F.coalesce("kills_human", "kills")


def rate(n: Column, total: Column) -> Column:
    """n / total, null for an empty total."""
    return n.cast("double") / F.nullif(total.cast("double"), F.lit(0.0))


def mean(c: Column) -> Column:
    return F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0))


def name_search(name: Column, q: str) -> Column:
    return F.contains(F.lower(name), F.lit(q.lower()))


def tracked_filter(tracked: bool | None = None, formerly: bool = False) -> Column:
    """Players by whether they are tracked, or only those that no longer are (untracked_at is set)."""
    parts = [F.lit(True)] if tracked is None else [F.col("tracked") == tracked]
    if formerly:
        parts.append(~F.col("tracked") & F.col("untracked_at").isNotNull())
    return reduce(lambda a, b: a & b, parts)
