"""SimHash near-dedup by word similarity: exact similarity of five-word shingles.

Two texts are linked if the sum of the lesser counts of their shingles is 0.8 or
more of the sum of the greater ones; a text's class is all that links reach. Texts
of fewer than five words are one shingle.

At 0.8 fingerprints differ in about 10 of 64 bits, up to 20. Pivot tables can't find
such pairs: distances to a pivot spread by 4, so that no pair is discarded from a
radius of about 13 on, and a radius of 20 also links two in a thousand of all unrelated
pairs. So the pivot tables find what they can prune, and lists of minima the rest:

1. Texts with equal shingles are one: mark, a hash of all of them.
2. Marks whose fingerprints are equal or within two bits (pivot tables, `simhash.links`)
   are compared. That joins most groups of near copies by links linear in their rows.
3. Each mark is listed under 48 keys of four minima each. Two marks of similarity s
   share none of them with a chance of (1 - s^4)^48, 1e-11 at 0.8. Each list's members
   are compared with its central one, which has the most members in all of its lists,
   and then with that of the list's second class, which links most of a large group.
4. Members that share a list and are in different classes are compared pair by pair where
   they can be alike: two texts that share 0.8 of their shingles have one in common among
   the rarest fifth (and one more) of either, rarest by how many such members hold it.
   Of those that share such a shingle a map of 4,096 bits tells shingles that only one of
   them has, which bounds what they have in common; pairs that can't reach 0.8 are dropped
   in the join itself.

All links are verified on the shingles themselves, whatever proposed them.

Nulls and ties: a null text has no words, and all texts without words are one
class; a null id is the last choice (as is the id 2**63 - 1); rows that repeat an id are
judged by their own text; of rows equal in id and text one stays; long texts are taken
whole; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm import simhash
from matchlake.llm._common import NO_ID, components, materialize, packed, scratch, shared_groups, unpacked
from matchlake.llm.simhash import majority  # by its name, as tasks get the functions themselves and not the module

SHINGLE = 5
#: Similarity as a fraction of whole numbers, so that comparing is exact.
THRESHOLD = (4, 5)
BANDS, MINIMA = 48, 4
#: Words of 64 bits in the map of a text's shingles.
MAP = 64
#: Odd multipliers and masks of the minima, by rule.
_PICK = np.array([xxhash.xxh64_intdigest(str(i), 11) for i in range(BANDS * MINIMA)], np.uint64)
_TIMES, _FLIP = (_PICK >> np.uint64(32)).astype(np.uint32) | np.uint32(1), _PICK.astype(np.uint32)
_STEP, _AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of all runs of size words; the second, third ... occurrence of one has a hash of its own."""
    words = (text or "").lower().encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, k = xxhash.xxh64_intdigest, min(size, len(words))
    each = np.fromiter(map(digest, words), np.uint64, len(words))
    n = len(words) - k + 1
    made = each[:n].copy()
    for i in range(1, k):
        made = (made ^ (made >> np.uint64(29))) * _STEP + each[i : i + n]
    made.sort()
    first = np.concatenate(([True], made[1:] != made[:-1]))
    at = np.arange(n)
    made = made + (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64) * _AGAIN
    made.sort()
    return made


def keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band, of its number and its minima."""
    low = np.full(BANDS * MINIMA, 0xFFFFFFFF, np.uint32)
    half = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(half), 4096):
        x = (half[i : i + 4096, None] ^ _FLIP) * _TIMES
        x ^= x >> np.uint32(15)
        np.minimum(low, x.min(0), out=low)
    rows = low.reshape(BANDS, MINIMA)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def _mark(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 3)).view(np.int64))


SIGNED = "_id bigint, _hash bigint, mark bigint, fp bigint, n bigint, keys array<bigint>"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [shingles(t) for t in b.column("_text").cast(pa.large_string()).to_pylist()]
        lists = pa.array([keys(h) if len(h) else [] for h in made], pa.list_(pa.int64()))
        fps = np.array([majority(h) for h in made], np.uint64).view(np.int64)
        cols = [pa.array([_mark(h) for h in made], pa.int64()), pa.array(fps), pa.array([len(h) for h in made], pa.int64()), lists]
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_hash"), *cols], ["_id", "_hash", "mark", "fp", "n", "keys"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [shingles(t) for t in b.column("_text").cast(pa.large_string()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("mark"), pa.array([h.view(np.int64) for h in made], pa.list_(pa.int64()))], ["mark", "sh"])


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit for every shingle, at a place by its hash."""
    for b in batches:
        maps = []
        for h in b.column("sh"):
            held = np.zeros(64 * MAP, bool)
            held[(h.values.to_numpy().view(np.uint64) >> np.uint64(17)) % np.uint64(64 * MAP)] = True
            maps.append(np.packbits(held, bitorder="little").view("<i8"))
        yield pa.RecordBatch.from_arrays([b.column("mark"), pa.array(maps, pa.list_(pa.int64()))], ["mark", "map"])


def _common_at_most(s: str, t: str) -> Column:
    """A bound of the shingles that two texts share: those of s less the places of its map where t has none."""
    only = F.zip_with(f"m{s}", f"m{t}", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return F.col(f"n{s}") - F.aggregate(only, F.lit(0), lambda a, x: a + x)


def _alike(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold."""
    low, high = THRESHOLD
    side = lambda x, s: members.select(F.col("mark").alias(x), F.col("sh").alias(s))
    both = pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return materialize(both.where(high * F.col("i") >= low * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b"), "alike")


def _by_pivots(marks: DataFrame) -> DataFrame:
    """Pairs (a, b) of marks: those of one fingerprint with the least of it, and the least ones of linked fingerprints."""
    distinct = materialize(marks.groupBy("fp").agg(F.min("mark").alias("least")), "distinct")
    linked = simhash.links(distinct.select("fp"))
    side = lambda f, m: distinct.select(F.col("fp").alias(f), F.col("least").alias(m))
    across = linked.join(side("a", "ma"), "a").join(side("b", "mb"), "b").select(F.col("ma").alias("a"), F.col("mb").alias("b"))
    same = marks.join(distinct, "fp").where("mark != least").select(F.col("least").alias("a"), F.col("mark").alias("b"))
    return materialize(across.unionByName(same), "pivots")


def roots(signed: DataFrame, text_of: DataFrame) -> DataFrame:
    """(node, root) of the marks in classes of two or more. signed: SIGNED; text_of: _key, _hash, _text."""
    low, high = THRESHOLD
    one = F.min(F.struct(F.coalesce("_id", F.lit(NO_ID)).alias("_key"), "_hash")).alias("one")
    marks = materialize(signed.groupBy("mark").agg(one, F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")), "marks")
    pivoted = _by_pivots(marks.select("mark", "fp"))
    # keys that two marks or more have
    listed = materialize(shared_groups(marks.select(F.explode("keys").alias("k"), "mark", "n"), ["k"], "mark").select("k", "mark", "n"), "listed")
    asked = listed.select("mark").unionByName(pivoted.select(F.explode(F.array("a", "b")).alias("mark"))).distinct()
    wanted = marks.join(asked, "mark").select("mark", "one.*")
    texts = text_of.join(wanted, ["_key", "_hash"]).dropDuplicates(["_key", "_hash"])
    members = materialize(texts.select("mark", "_text").mapInArrow(_shingled, "mark bigint, sh array<bigint>"), "members")
    sizes_fit = high * F.least("na", "nb") >= low * F.greatest("na", "nb")
    side = lambda df, key, s, *more: df.select(key, *[F.col(c).alias(f"{c[0]}{s}") for c in ("n", "root", *more)], F.col("mark").alias(s))

    def still_split(known: DataFrame) -> DataFrame:
        rooted = listed.join(known.withColumnRenamed("node", "mark"), "mark", "left").withColumn("root", F.coalesce("root", "mark"))
        split = rooted.groupBy("k").agg((F.min("root") < F.max("root")).alias("split")).where("split").select("k")
        return materialize(rooted.join(split, "k"), "rooted")

    def alike(near: DataFrame) -> DataFrame:
        return _alike(materialize(near.select("a", "b").distinct(), "near"), members)

    found = _alike(pivoted, members)
    rooted = still_split(components(found))
    crowd = rooted.join(rooted.groupBy("k").agg(F.count("*").alias("c")), "k").groupBy("mark").agg(F.sum("c").alias("w"))
    central = rooted.join(crowd, "mark").groupBy("k").agg(F.max_by(F.struct("mark", "n", "root"), F.struct("w", "mark")).alias("x")).select("k", "x.*")
    found = found.unionByName(alike(side(central, "k", "a").join(side(rooted, "k", "b"), "k").where((F.col("ra") != F.col("rb")) & sizes_fit)))
    rooted = still_split(components(found))
    # the centre of each list's second class, so that large classes beside each other meet
    classes = rooted.join(crowd, "mark").groupBy("k", "root").agg(F.count("*").alias("c"), F.max_by(F.struct("mark", "n"), F.struct("w", "mark")).alias("x"))
    second = classes.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy(F.col("c").desc(), "root"))).where("at = 2").select("k", "root", "x.*")
    found = found.unionByName(alike(side(second, "k", "a").join(side(rooted, "k", "b"), "k").where((F.col("ra") != F.col("rb")) & sizes_fit)))
    known = components(found)
    left = still_split(known).select("mark", "n", "root").distinct()
    shingle = materialize(members.join(left, "mark").select("mark", "n", "root", F.explode("sh").alias("h")), "shingles")
    counted = shingle.join(shingle.groupBy("h").agg(F.count("*").alias("c")), "h")
    place = F.row_number().over(Window.partitionBy("mark").orderBy("c", "h"))
    rare = counted.withColumn("place", place).where(high * (F.col("place") - 1) <= (high - low) * F.col("n")).where("c > 1")
    split = rare.groupBy("h").agg((F.min("root") < F.max("root")).alias("split")).where("split").select("h")
    maps = materialize(members.join(left.select("mark"), "mark").select("mark", "sh").mapInArrow(_mapped, "mark bigint, map array<bigint>"), "maps")
    rare = materialize(rare.join(split, "h").select("h", "mark", "n", "root").join(maps, "mark"), "rare")
    can_reach = (high + low) * _common_at_most("a", "b") >= low * (F.col("na") + F.col("nb"))
    pairs = side(rare, "h", "a", "map").join(side(rare, "h", "b", "map"), "h").where((F.col("ra") < F.col("rb")) & sizes_fit & can_reach)
    more = alike(pairs)
    return known if more.isEmpty() else components(found.unionByName(more))


def chosen(classes: DataFrame) -> DataFrame:
    """(_key, _hash) of one row of each class: of the least id, and of texts under that id the one of the least hash. classes: _id, _hash, root."""
    least = F.min(F.struct(F.coalesce("_id", F.lit(NO_ID)).alias("_key"), "_hash")).alias("x")
    return classes.groupBy("root").agg(least).select("x._key", "x._hash").distinct()


def one_of_each(docs: DataFrame, one: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that chosen() names; of rows equal in id and text, one."""
    key, text = F.coalesce(F.col(f"_{id_col}"), F.lit(NO_ID)).cast("long").alias("_key"), _hash(F.col(f"_{text_col}")).alias("_hash")
    rows = packed(docs, id_col, text_col).select("_row", key, text)
    return unpacked(rows.join(one, ["_key", "_hash"], "left_semi").dropDuplicates(["_key", "_hash"]), docs)


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of near copies, the one with the smallest id; a null id comes last."""
    own = packed(docs, id_col, text_col).select(F.col(f"_{id_col}").cast("long").alias("_id"), _hash(F.col(f"_{text_col}")).alias("_hash"), F.col(f"_{text_col}").alias("_text"))
    with scratch(docs.sparkSession, "near") as kept:
        signed = materialize(own.mapInArrow(_signed, SIGNED), "signed")
        known = roots(signed, own.select(F.coalesce("_id", F.lit(NO_ID)).alias("_key"), "_hash", "_text")).withColumnRenamed("node", "mark")
        classes = signed.select("_id", "_hash", "mark").join(known, "mark", "left").select("_id", "_hash", F.coalesce("root", "mark").alias("root"))
        one = kept(chosen(classes))
    return one_of_each(docs, one, id_col, text_col)
