"""Benchmark decontamination; DataFrame functions only.

A benchmark item of n words is compared with every window of n words of every
document (the whole document if it is shorter). Texts are lower-cased and cut at
white space; shingles are five words (all words of a shorter item).

1. A similar window holds at least threshold times as many shingles of items of its
   size as such an item has. So documents' shingles are first joined with the
   benchmark's, which leaves the places where enough of them are close together.
2. There all windows of the item's size get a SimHash fingerprint, counted
   bit-sliced: 64 counters held in a few longs.
3. Fingerprints are cut into radius + 1 blocks. Two that differ in radius bits or
   fewer agree on a block, so joining on size, block number and block value
   finds all of them.
4. Those within the radius are verified: the sum of the lesser counts of all
   shingles over that of the greater ones must be threshold or more.

Items that are similar enough (0.8) differ in about 10 of 64 bits with a deviation of
3; the default radius of 20 leaves out fewer than one in a thousand of those that
just reach the threshold, and none of the exact copies (a test measures it). With so
wide a radius the blocks have three bits and select little by themselves; it is step 1
that keeps the windows few.

A table is broadcast only while its rows, counted before, hold broadcast_rows hashes or
fewer; beyond that the joins shuffle (and AQE splits hot keys). Either way the rows are
the same.

Nulls and ties: a null or empty text or item has no words and never matches; a null id
is kept as null (shared by all rows without one, and by the id 2**63 - 1); rows that
repeat an id, of a document or an item, give one row for each document and item, the best
of them; of equal windows the first is reported; texts and items of any length are taken
whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm._common import NO_ID, materialize, packed, scratch, unpacked

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 20
BROADCAST_ROWS = 1_000_000
#: White space.
SPACE, SPACES = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.lower(text), F.lit(SPACE))
    return F.when(trimmed == "", None).otherwise(F.split(trimmed, SPACES))


def _shingles(words: Column, size: int) -> Column:
    """Hashes of every run of size words; words must be a column, not an expression."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))


def _fingerprint(hashes: Column, planes: int) -> Column:
    """Bit i is set if it is in over half of the hashes. Plane j holds bit j of all 64 counters."""
    names = [f"p{j}" for j in range(planes)]

    def add(acc: Column, h: Column) -> Column:
        carry, out = h, []
        for x in names:
            out.append(acc[x].bitwiseXOR(carry).alias(x))
            carry = acc[x].bitwiseAND(carry)
        return F.struct(*out)

    def over_half(acc: Column) -> Column:
        half = F.floor(F.size(hashes) / 2).cast("long")
        more, equal = F.lit(0).cast("long"), F.lit(-1).cast("long")
        for j in reversed(range(planes)):
            limit = -F.shiftright(half, j).bitwiseAND(F.lit(1).cast("long"))
            more = more.bitwiseOR(equal.bitwiseAND(acc[names[j]]).bitwiseAND(F.bitwise_not(limit)))
            equal = equal.bitwiseAND(F.bitwise_not(acc[names[j]].bitwiseXOR(limit)))
        return more

    return F.aggregate(hashes, F.struct(*[F.lit(0).cast("long").alias(x) for x in names]), add, over_half)


def _blocks(radius: int) -> list[int]:
    """Masks of radius + 1 blocks as signed longs."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    masks = [sum(1 << b for b in range(x, y)) for x, y in zip(cuts[:-1], cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


# Arrays that are costly to make are exploded by the outer form: the plain one adds a filter on their size, which makes them twice or more.


def _blocked(df: DataFrame, fp: str, radius: int) -> DataFrame:
    each = F.array(*[F.struct(F.lit(i).alias("block"), F.col(fp).bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(_blocks(radius))])
    return df.withColumn("_b", F.explode_outer(each)).select("*", "_b.block", "_b.bits").drop("_b")


def similarity(a: Column, b: Column) -> Column:
    """Sum of lesser counts over sum of greater counts of two arrays of hashes, both columns."""
    times = lambda x, h: F.size(x) - F.size(F.array_remove(x, h))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, h: n + F.least(times(a, h), times(b, h)))
    return both / (F.size(a) + F.size(b) - both)


def _hinted(df: DataFrame, weight: Column, most: int) -> DataFrame:
    """df, to be broadcast if the sum of weight over its rows is no more than most."""
    held = df.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("x")).first()["x"]
    return F.broadcast(df) if held <= most else df


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _places(own: DataFrame, items: DataFrame, sizes: list[int], most: int) -> DataFrame:
    """doc, mark, n, k and at, the places of all shingles that items of n words have."""
    known = _hinted(items.select("n", "k", F.explode("ih").alias("h")).distinct(), F.lit(1), most)
    parts = []
    for k in sizes:
        each = own.where(F.size("words") >= k).select("doc", "mark", F.posexplode_outer(_shingles(F.col("words"), k)).alias("pos", "h"))
        parts.append(each.join(known.where(F.col("k") == k), "h").select("doc", "mark", "n", "k", "pos"))
    return _union(parts).groupBy("doc", "mark", "n", "k").agg(F.sort_array(F.collect_set("pos")).alias("at"))


def _windows(found: DataFrame, sizes: list[int], threshold: float, planes: int) -> DataFrame:
    """doc, n, size, start, hashes and fp of all windows of an item's size that hold enough of the known shingles."""
    found = found.withColumn("size", F.least("n", F.size("words")))
    need, span = F.greatest(F.lit(1), F.ceil(threshold * (F.col("n") - F.col("k") + 1) - 1e-9)).cast("int"), F.col("size") - F.col("k")
    last = lambda i: F.get(F.col("at"), i + need - 1)
    first = lambda i: F.when(last(i).isNotNull(), F.greatest(F.lit(0), last(i) - span))
    runs = F.transform("at", lambda p, i: F.struct(first(i).alias("lo"), F.least(p, F.size("words") - F.col("size")).alias("hi")))
    starts = F.array_distinct(F.flatten(F.transform(F.filter(runs, lambda r: r["lo"] <= r["hi"]), lambda r: F.sequence(r["lo"], r["hi"]))))
    kept = ("doc", "mark", "n", "k", "size")
    cut = _union([found.where(F.col("k") == k).select(*kept, _shingles(F.col("words"), k).alias("sh"), starts.alias("starts")) for k in sizes])
    windows = cut.select(*kept, "sh", F.explode_outer("starts").alias("start")).where("start is not null")
    hashes = F.slice("sh", F.col("start") + 1, F.col("size") - F.col("k") + 1)
    return windows.select("doc", "n", "size", "start", hashes.alias("hashes")).withColumn("fp", _fingerprint(F.col("hashes"), planes))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    radius: int = RADIUS,
    shingle: int = SHINGLE,
    broadcast_rows: int = BROADCAST_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """id, item id, similarity, start_word and n_words of the best window for every document and item that match."""
    items = benchmark.select(F.col(item_col).alias("item"), _words(F.col(item_text_col)).alias("iw")).where("iw is not null").withColumn("n", F.size("iw"))
    bounds = items.agg(F.max("n"), F.collect_set(F.least("n", F.lit(shingle)))).first()
    longest, sizes = (bounds[0], sorted(bounds[1])) if bounds[1] else (1, [1])
    planes = max(longest, 1).bit_length()
    sized = [items.where(F.least("n", F.lit(shingle)) == k).select("item", "n", F.lit(k).alias("k"), _shingles(F.col("iw"), k).alias("ih")) for k in sizes]
    id_of, text = F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("doc"), F.col(text_col)
    own = docs.select(id_of, F.xxhash64(text).alias("mark"), _words(text).alias("words")).where("words is not null")

    with scratch(docs.sparkSession, "decontamination") as kept:
        items = materialize(_union(sized).withColumn("ifp", _fingerprint(F.col("ih"), planes)).withColumn("i_mark", F.xxhash64("ih")).dropDuplicates(["item", "i_mark"]), "items")
        around = materialize(_places(own, items, sizes, broadcast_rows), "places")
        windows = _windows(own.join(_hinted(around, F.size("at"), broadcast_rows), ["doc", "mark"]), sizes, threshold, planes)

        wanted = _hinted(_blocked(items.select("item", "i_mark", "n", "ifp"), "ifp", radius), F.lit(1), broadcast_rows)
        differ = F.col("fp").bitwiseXOR(F.col("ifp"))
        first_block = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(i)) for i, m in enumerate(_blocks(radius))])
        near = _blocked(windows, "fp", radius).join(wanted, ["n", "block", "bits"]).where((F.bit_count(differ) <= radius) & (first_block == F.col("block")))
        hashes = _hinted(items.select("item", "i_mark", "ih"), F.size("ih"), broadcast_rows)
        near = near.join(hashes, near["item"].eqNullSafe(hashes["item"]) & (near["i_mark"] == hashes["i_mark"])).drop(hashes["item"])
        checked = near.withColumn("similarity", similarity(F.col("hashes"), F.col("ih"))).where(F.col("similarity") >= threshold)
        best = checked.groupBy("doc", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("neg"), "size")).alias("x"))
        window = F.round("x.similarity", 6).alias("similarity"), (-F.col("x.neg")).alias("start_word"), F.col("x.size").alias("n_words")
        return kept(best.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias(id_col), F.col("item").alias(item_col), *window))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, **how) -> DataFrame:
    """docs without those that hold a benchmark item; a row without an id goes if any such row does."""
    gone = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, broadcast_rows=broadcast_rows, **how).select(F.col(id_col).alias("_gone")).distinct()
    rows = packed(docs, id_col).withColumnRenamed(f"_{id_col}", "_id")
    return unpacked(rows.join(_hinted(gone, F.lit(1), broadcast_rows), F.col("_id").eqNullSafe(F.col("_gone")), "left_anti"), docs)
