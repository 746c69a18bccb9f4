"""What players carry: effects of item events, stacks, armour and snapshots.

Rows come as match_id, account_id, idx (file order), t_ms, kind and what the kind
needs. Pairings within some milliseconds are as-of joins, stacks and armour closed
forms over windows. Only the choice of a slot depends on all that came before; it
is folded along the rows of each account in a match.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.norm import armor_level, tick
from matchlake.operators.temporal import asof, folded

KEYS = ("match_id", "account_id")
#: Windows in ms, slots of helmet and vest, what armour holds by slot and level, how much of a hit it keeps by level, the wear of a hit without damage.
PAIR_MS, DESTROY_MS, KEYFRAME_MS = 50, 100, 60_000
HELMET, VEST = 5, 6
ARMOR_MAX = {(5, 1): 80.0, (5, 2): 150.0, (5, 3): 250.0, (6, 1): 200.0, (6, 2): 235.0, (6, 3): 250.0}
MITIGATION = {1: 0.30, 2: 0.40, 3: 0.55}
NO_DAMAGE_WEAR = 40.0
REASON_SLOT = {"headshot": 5, "torsoshot": 6, "pelvisshot": 6}
ARMOR_DAMAGE = ("damage_gun", "damage_gun_penetrate_brdm", "damage_punch", "damage_melee", "damage_meleethrow")
#: The effect of each kind of event.
OPS = {
    "logitempickup": "add",
    "logitempickupfromvehicletrunk": "add",
    "logitempickupfromlootbox": "provenance",
    "logitempickupfromcarepackage": "provenance",
    "logitemdrop": "remove",
    "logitemuse": "set",
    "logitemequip": "equip",
    "logitemunequip": "unequip",
    "logitemattach": "attach",
    "logitemdetach": "detach",
    "logarmordestroy": "destroy",
}


def op_of(kind: Column) -> Column:
    """The effect of a kind of event; null for kinds that have none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in OPS.items() for x in kv]), F.lower(kind))


def quantity(op: Column, stack: Column) -> Column:
    """A missing or zero stack moves one item; a set takes zero at its word."""
    return F.when(op == "set", F.coalesce(stack, F.lit(0))).otherwise(F.coalesce(F.nullif(stack, F.lit(0)), F.lit(1)))


def before_death(rows: DataFrame, deaths: DataFrame) -> DataFrame:
    """rows with late: whether they come after their account's final death; deaths: match_id, account_id, death_ms."""
    return rows.join(deaths.select(*KEYS, "death_ms"), list(KEYS), "left").withColumn("late", F.coalesce(F.col("t_ms") > F.col("death_ms"), F.lit(False))).drop("death_ms")


def without_near(rows: DataFrame, others: DataFrame, keys: Sequence[str], within_ms: int) -> DataFrame:
    """The rows that have none of the others with equal keys within some ms before or after; a null key never has."""
    found = asof(rows, others, keys, "t_ms", [], "nearest", max_lag=within_ms, prefix="_n_")
    null_key = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    return found.where(F.col("_n_t_ms").isNull() | null_key).drop("_n_t_ms", "_n_lag")


def trunk_pickups(trunk: DataFrame, pickups: DataFrame, within_ms: int = PAIR_MS) -> DataFrame:
    """Pickups from a trunk that no plain pickup of the item accompanies."""
    return without_near(trunk, pickups, [*KEYS, "item"], within_ms)


def unequips(rows: DataFrame, destroyed: DataFrame, within_ms: int = DESTROY_MS) -> DataFrame:
    """Unequips but for those that only follow (or announce) the item's destruction in that slot."""
    return without_near(rows, destroyed, [*KEYS, "slot", "item"], within_ms)


def stacks(rows: DataFrame) -> DataFrame:
    """rows (item, op: set, add or remove, quantity) with stack, the number held after the row; never below 0.

    Since the last set the sum of changes is reflected at 0: what a removal takes too much isn't owed later.
    """
    w = Window.partitionBy(*KEYS, "item").orderBy("idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    change = F.when(F.col("op") == "remove", -F.col("quantity")).otherwise(F.col("quantity"))
    r = rows.withColumn("_epoch", F.sum((F.col("op") == "set").cast("int")).over(upto))
    e = Window.partitionBy(*KEYS, "item", "_epoch").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_sum", F.sum(change).over(e))
    return r.withColumn("stack", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(e))).drop("_epoch", "_sum")


def reattached(before: Column, child: Column, attach: Column) -> Column:
    """The sorted attachments after child came on or went off (one of it, if there are more)."""
    at = F.array_position(before, child)
    off = F.when(at > 0, F.concat(F.slice(before, F.lit(1), at.cast("int") - 1), F.slice(before, at.cast("int") + 1, F.greatest(F.size(before), F.lit(1))))).otherwise(before)
    return F.array_sort(F.when(attach, F.array_append(before, child)).otherwise(off))


def armour_hits(rows: DataFrame) -> DataFrame:
    """Hits on worn helmets and vests with hit_no, remaining and percent, the piece's estimated condition.

    rows: slot, op (equip, off or hit), item, damage. A piece counts as new when it is put on. Losses are never
    negative, so the capacity less their sum, kept at 0, is what a step by step account gives.
    """
    table = F.create_map(*[F.lit(x) for (s, n), cap in ARMOR_MAX.items() for x in (s * 10 + n, cap)])
    w = Window.partitionBy(*KEYS, "slot").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("_change", F.sum((F.col("op") != "hit").cast("int")).over(w))
    worn = F.last(F.when(F.col("op") != "hit", F.struct("op", "item")), ignorenulls=True).over(w)
    r = r.withColumn("_worn", worn).where("op = 'hit' and _worn.op = 'equip'")
    level = armor_level(F.col("_worn.item"))
    kept = F.try_element_at(F.create_map(*[F.lit(x) for kv in MITIGATION.items() for x in kv]), level)
    r = r.withColumn("_cap", F.try_element_at(table, F.col("slot") * 10 + level)).withColumn("_loss", F.when(F.col("damage") > 0, F.col("damage") / (1 - kept)).otherwise(NO_DAMAGE_WEAR)).where("_cap is not null")
    e = Window.partitionBy(*KEYS, "slot", "_change").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    left = F.greatest(F.lit(0.0), F.col("_cap") - F.sum("_loss").over(e))
    return r.select(*KEYS, "idx", "slot", F.col("_worn.item").alias("item"), F.row_number().over(e).alias("hit_no"), left.alias("remaining"), F.bround(left / F.col("_cap") * 100).cast("int").alias("percent"))


def _placing() -> Callable:
    """Begins an account: where each equip, unequip, attach, detach, destroy and clear acts, as slot, attachments after it and loose.

    loose tells the stack's part: -1 the item comes out of the pack, 1 it goes there, 0 neither.
    """

    def start() -> Callable:
        worn: dict[int, tuple] = {}

        def place(op: str, slot: int | None, item: str, before: list, after: list) -> tuple:
            own, loose = (item, tuple(before)), 0
            held = next((s for s in worn if worn[s] == own), None)
            if op == "equip":
                slot = 1 if slot == 0 and 0 in worn else slot
                worn[slot], loose = own, -1
            elif op == "unequip":
                slot, loose = slot if held is None else held, 1
                worn.pop(slot, None)
            elif op == "destroy":
                worn.pop(slot, None)
            elif op == "clear":
                worn.clear()
            else:
                slot = held
                if held is not None:
                    worn[held] = (item, tuple(after))
                else:
                    loose = 1
                return slot, after, loose
            return slot, before, loose

        return place

    return start


def placed(rows: DataFrame) -> DataFrame:
    """The effects with the slot they act on: idx, t_ms, op, slot, item, attached (after it) and loose.

    rows: op (equip, unequip, attach, detach, destroy, clear), slot (by category; null for clear, attach, detach),
    item (the parent's), child, before (attachments before). A second main weapon goes to slot 1, and an unequip
    acts where the item is held. Rows of equip, unequip and destroy without a slot have no effect.
    """
    r = rows.where("op in ('clear', 'attach', 'detach') or slot is not null")
    before = F.array_sort(F.coalesce("before", F.array().cast("array<string>")))
    r = r.select(*KEYS, F.col("idx").cast("bigint").alias("idx"), F.col("t_ms").cast("bigint").alias("t_ms"), "op", F.col("slot").cast("int").alias("slot"), "item", before.alias("before"), "child")
    r = r.withColumn("after", F.when(F.col("op").isin("attach", "detach"), reattached(F.col("before"), F.col("child"), F.col("op") == "attach")).otherwise(F.col("before")))
    done = folded(r, KEYS, [F.col("idx").asc_nulls_last()], ["op", "slot", "item", "before", "after"], _placing(), {"at": "int", "attached": "array<string>", "loose": "int"})
    return done.select(*KEYS, "idx", "t_ms", "op", F.col("at").alias("slot"), "item", "attached", "loose")


DELTA = ("match_id", "account_id", "idx", "t_ms", "op", "slot", "item", "quantity", "attached")


def deltas(items: DataFrame, deaths: DataFrame, hits: DataFrame) -> DataFrame:
    """All effects on what players carry, as one table: op is add, remove, set, provenance, equip, unequip, attach, detach, destroy, clear or armour_hit.

    items: match_id, account_id, idx, t_ms, kind (of OPS), item, stack, slot (by category), child, attached; deaths: the final ones, with
    idx and death_ms; hits: match_id, account_id (of who is hit), idx, t_ms, slot, damage. Pickups from a trunk count only without a plain
    one, unequips only without a destruction, nothing counts after an account's final death, and the death itself clears. quantity is the
    stack moved, for an armour hit what is left of the piece in percent, else null.
    """
    rows = before_death(items.withColumn("op", op_of(F.col("kind"))).where("op is not null"), deaths).where("not late").drop("late")
    trunk, plain = rows.where("lower(kind) like '%trunk'"), rows.where("lower(kind) not like '%trunk'")
    moved = plain.where("op in ('add', 'remove', 'set', 'provenance')").unionByName(trunk_pickups(trunk, plain.where("op = 'add'")))
    moved = moved.withColumn("quantity", quantity(F.col("op"), F.col("stack"))).withColumn("slot", F.lit(None).cast("int"))

    acts = plain.where("op in ('equip', 'attach', 'detach', 'destroy')").unionByName(unequips(plain.where("op = 'unequip'"), plain.where("op = 'destroy'")))
    cleared = deaths.select(*KEYS, "idx", F.col("death_ms").alias("t_ms"), F.lit("clear").alias("op"))
    acts = acts.withColumnRenamed("attached", "before").unionByName(cleared, allowMissingColumns=True)
    done = placed(acts).withColumn("quantity", F.lit(None).cast("bigint"))

    # a death takes off what is worn in both slots
    both = F.when(F.col("op") == "clear", F.array(F.lit(HELMET), F.lit(VEST))).otherwise(F.array("slot"))
    worn = done.where("op in ('equip', 'unequip', 'destroy', 'clear')").select(*KEYS, "idx", "t_ms", "op", "item", F.explode(both).alias("slot")).where(F.col("slot").isin(HELMET, VEST))
    put = worn.select(*KEYS, "idx", "slot", F.when(F.col("op") == "equip", "equip").otherwise("off").alias("op"), "item", F.lit(None).cast("double").alias("damage"))
    felt = before_death(hits, deaths).where("not late").select(*KEYS, "idx", "t_ms", F.col("slot").cast("int").alias("slot"), F.col("damage").cast("double").alias("damage"))
    worn_out = armour_hits(put.unionByName(felt.select(*KEYS, "idx", "slot", F.lit("hit").alias("op"), F.lit(None).cast("string").alias("item"), "damage")))
    worn_out = worn_out.join(felt.select(*KEYS, "idx", "t_ms"), [*KEYS, "idx"]).withColumn("op", F.lit("armour_hit")).withColumn("quantity", F.col("percent").cast("bigint"))
    worn_out = worn_out.withColumn("attached", F.lit(None).cast("array<string>"))
    return moved.select(*DELTA).unionByName(done.select(*DELTA)).unionByName(worn_out.select(*DELTA))


def replay_inventory(rows: DataFrame, roster: DataFrame, tick_ms: int) -> DataFrame:
    """deltas for a replay: by player (team, then account) and tick; a player that isn't in the roster has no row."""
    player = F.dense_rank().over(Window.partitionBy("match_id").orderBy("team_id", "account_id")) - 1
    players = roster.select(*KEYS, player.alias("player"))
    return rows.join(players, list(KEYS)).select("match_id", "player", tick(F.col("t_ms") / 1000, tick_ms).alias("tick"), "idx", "op", "slot", "item", "quantity")


def snapshots(states: DataFrame, what: Sequence[str], value: str, every_ms: int = KEYFRAME_MS) -> DataFrame:
    """Every state (value, per match, account and what) as of each multiple of every_ms up to the match's last row; at_ms is the multiple.

    A state holds from its row to the next one's, so each row lists only the multiples that it is the answer to.
    States with a null or zero value aren't held and listed nowhere.
    """
    w = Window.partitionBy(*KEYS, *what).orderBy("t_ms", "idx")
    end = F.max("t_ms").over(Window.partitionBy("match_id"))
    first = F.ceil(F.col("t_ms") / every_ms)
    last = F.when(F.col("_next").isNull(), F.floor(F.col("_end") / every_ms)).otherwise(F.ceil(F.col("_next") / every_ms) - 1)
    held = states.withColumn("_next", F.lead("t_ms").over(w)).withColumn("_end", end).withColumn("_first", first).withColumn("_last", last)
    held = held.where(f"`{value}` is not null and cast(`{value}` as string) <> '0' and _first <= _last")
    return held.select(*KEYS, *what, value, F.explode(F.transform(F.sequence("_first", "_last"), lambda n: n * every_ms)).alias("at_ms"))


def held_at_death(states: DataFrame, deaths: DataFrame, what: Sequence[str], value: str) -> DataFrame:
    """What every account held at its final death: the last state of each of what at or before it."""
    rows = states.join(deaths.select(*KEYS, "death_ms"), list(KEYS)).where("t_ms <= death_ms")
    last = rows.groupBy(*KEYS, *what).agg(F.max_by(value, F.struct("t_ms", "idx")).alias(value), F.max("death_ms").alias("at_ms"))
    return last.where(f"`{value}` is not null and cast(`{value}` as string) <> '0'")
