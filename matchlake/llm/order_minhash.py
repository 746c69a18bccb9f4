"""Order MinHash fingerprints, sensitive to edit distance; DataFrame functions only.

A text's tokens are its runs of other characters than white space, those of over TOKEN characters cut. Every token
with its follower is a k-mer (k = 2); equal ones are told apart by their occurrence number, so a repeated k-mer weighs
as often as it occurs. Their hashes lie on a circle of 64 bits. Each of SIZE fixed points of that circle is an order of
its own: the k-mers by their way from the point. An entry takes the TAKEN first, puts them into the order they have in the text
and hashes the tuple. Texts of the same k-mers in another order thus differ, and the share of equal entries falls with every
edit. One sort of hashes and points together finds all entries, so the cost doesn't grow with their number.

Fingerprints are made before the rows are dealt. A document's neighbour by id comes from blocks of ids: bounds from a sort
of ids alone, a window in each block, and the first row of a block also in the one before, so no task sees all rows and
a text is shuffled once.

Nulls and ties: a null text is the empty string, whose entries are all equal; rows that repeat an id follow each other by
text; a null id comes last; a table of one row is its own neighbour; texts are taken whole, with a token's place below 2**30; an empty
table gives no rows; other columns pass in _row and can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm._common import packed, partitions
from matchlake.operators.temporal import range_ends, range_of

SIZE, TAKEN, TOKEN = 64, 2, 16

#: A hash's upper bits and, below, a token's place; all ones mark a point of the circle.
PLACE_BITS = 30
PLACE = (1 << PLACE_BITS) - 1

#: The points of the circle, evenly spread, in order.
POINTS = [((i << 64) // SIZE - (1 << 63) + (1 << 63) // SIZE) & ~PLACE | PLACE for i in range(SIZE)]


def entries(df: DataFrame, text: str, into: str) -> DataFrame:
    """df with the column into, the SIZE entries (32 bits each) of the column text's fingerprint."""
    own = lambda name: f"_{into}_{name}"
    at = lambda name: F.col(own(name))
    upper = lambda x: F.shiftright(x, PLACE_BITS)
    packed_as = lambda h, place: h.bitwiseAND(~PLACE).bitwiseOR(place)
    before = df.columns
    df = df.withColumn(own("token"), F.regexp_extract_all(F.col(text), F.lit(rf"([^\x20\x09-\x0D]{{1,{TOKEN}}})")))
    df = df.withColumn(own("kmer"), F.sort_array(F.transform(at("token"), lambda x, i: packed_as(F.xxhash64(x, F.get(at("token"), i + 1)), i.cast("long")))))
    # runs of equal k-mers, numbered from 0 in each
    n = F.size(at("kmer"))
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(own("run"), F.filter(every, lambda i: (i == 0) | (upper(F.get(at("kmer"), i)) != upper(F.get(at("kmer"), i - 1)))))
    df = df.withColumn(own("nth"), F.flatten(F.transform(at("run"), lambda b, r: F.sequence(F.lit(0), F.coalesce(F.get(at("run"), r + 1), n) - b - 1))))
    numbered = F.zip_with(at("kmer"), at("nth"), lambda x, nth: packed_as(F.xxhash64(upper(x), nth), x.bitwiseAND(PLACE)))
    df = df.withColumn(own("circle"), F.sort_array(F.concat(numbered, F.array(*[F.lit(p) for p in POINTS]))))
    is_point = lambda x: x.bitwiseAND(PLACE) == PLACE
    df = df.withColumn(own("only"), F.filter(at("circle"), lambda x: ~is_point(x)))
    df = df.withColumn(own("point"), F.filter(F.sequence(F.lit(0), F.size(at("circle")) - 1), lambda i: is_point(F.get(at("circle"), i))))
    k = F.size(at("only"))

    def entry(place: Column, j: Column) -> Column:
        taken = F.transform(F.sequence(F.lit(0), F.least(F.lit(TAKEN), k) - 1), lambda m: F.get(at("only"), F.pmod(place - j + m, k)))
        in_text = F.array_sort(taken, lambda a, b: (a.bitwiseAND(PLACE) - b.bitwiseAND(PLACE)).cast("int"))
        hashed = F.aggregate(in_text, F.lit(0).cast("long"), lambda h, x: F.xxhash64(h, upper(x)))
        return F.shiftright(F.shiftleft(hashed, 32), 32).cast("int")

    df = df.withColumn(into, F.when(k > 0, F.transform(at("point"), entry)).otherwise(F.array_repeat(F.lit(0), SIZE)))
    return df.select(*before, into)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal entries, 0 to 1; a and b must be columns."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(SIZE))


def digits(a: Column) -> Column:
    """Eight hex digits for each entry."""
    return F.array_join(F.transform(a, lambda x: F.right(F.lpad(F.lower(F.hex(x)), 16, "0"), F.lit(8))), "")


def with_next(df: DataFrame, id_col: str, text_col: str, *carried: str) -> DataFrame:
    """df with next, a struct of text_col and carried of the row after it by descending id; after the last row comes the first."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"))
    n_blocks = 4 * partitions(df.sparkSession)
    ends = range_ends(df, key, n_blocks)  # one row
    df = df.withColumn("_key", key).crossJoin(F.broadcast(ends))
    df = df.withColumn("_block", range_of("_ends", F.col("_key"), n_blocks))
    # the greatest row of a block follows the least of the block above
    is_first = F.get("_ends", F.col("_block")) == F.col("_key")
    own = F.struct(F.col("_block").alias("block"), F.lit(False).alias("is_copy"))
    above = F.struct(F.pmod(F.col("_block") + 1, F.size("_ends")).alias("block"), F.lit(True).alias("is_copy"))
    df = df.withColumn("_at", F.explode(F.when(is_first, F.array(own, above)).otherwise(F.array(own))))
    # copies come behind a block's own rows
    order = Window.partitionBy("_at.block").orderBy("_at.is_copy", F.desc("_key"), F.asc(text_col))
    df = df.withColumn("next", F.lead(F.struct(text_col, *carried)).over(order))
    return df.where("not _at.is_copy").drop("_key", "_ends", "_block", "_at")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, id, text, n_chars, edited, entries and edited_entries of every document and next, its neighbour's text and entries.

    The edited text has the last third replaced by the beginning of the next document's by descending id.
    """
    d = packed(docs, id_col, text_col).select("_row", F.col(f"_{id_col}").alias("id"), F.coalesce(F.col(f"_{text_col}"), F.lit("")).alias("text"))
    d = entries(d, "text", "entries")
    d = with_next(d, "id", "text", "entries").withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - cut), F.left(F.col("next.text"), cut))
    return entries(d.withColumn("edited", edited), "edited", "edited_entries")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, both fingerprints in hex, and how like the edited text and the next document are."""
    d = fingerprints(docs.select(id_col, text_col), id_col, text_col)
    return d.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digits(F.col("entries")).alias("fingerprint"),
        digits(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
        likeness(F.col("entries"), F.col("next.entries")).alias("near_next"),
    )
