"""Source divergence audit: how far each source's word use lies from that of its language's other sources.

The counts of a language are a matrix of sources by kept terms, and few of its cells are filled. It is cut into
tiles of some hundred terms. In a task a tile becomes k2-trees (k = 2, so quadtrees), one for each block of sources: a bitmap
for each level says which quadrants hold a cell. Two blocks are traversed at once, level by level. Where both
quadrants are empty, all their pairs of sources differ by the same amount in each term, so only their width is noted and
priced at the end; elsewhere the traversal goes on to the cells. Tiles' sums are added in Spark.

Counting emits a row for each source and term of some megabytes of text, and Spark adds those before the
shuffle, so a hot source or a frequent term costs one row a task.

Nulls and ties: a null text, lang or source is the empty string; every row is a document of its own, also where rows repeat an id;
equal values are ranked by the item's UTF-8 bytes; a group without terms takes part with counts of zero; a
language without kept terms has pairs of value 0 and no terms; texts are taken whole; an empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm._common import materialize, scratch

#: Documents that a kept term needs, what is added to counts, the unit of shares, listed terms a group.
MIN_DOCS, ADDED, UNIT, TOP = 30, 5, 1_000_000_000, 50

#: Terms of a tile, and cells that a tile of a language of very many sources may have.
TILE_TERMS, TILE_CELLS = 256, 1 << 22
#: Bytes of text counted at once, and pairs of quadrants opened at once.
TEXT_BYTES, OPENED = 1 << 23, 1 << 16

#: By byte: letters with A-Z lower-cased and all of UTF-8's multi-byte characters, else a blank.
_LETTER = np.frombuffer(bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)), np.uint8)


def _slices(batch: pa.RecordBatch, name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batch of about TEXT_BYTES, each with the offsets and bytes of its texts."""
    text = batch.column(name).cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(text):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + TEXT_BYTES, "right")) - 1)
        yield batch.slice(begin, end - begin), offsets[begin : end + 1] - offsets[begin], data[offsets[begin] : offsets[end]]
        begin = end


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part: counts and documents by lang, source and term; the empty term stands for the group itself."""
    for batch in batches:
        for part, offsets, data in _slices(batch, "text"):
            letters = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(offsets), pa.py_buffer(_LETTER[data]))
            words = pc.ascii_split_whitespace(letters)
            doc = np.repeat(np.arange(len(part)), np.diff(words.offsets.to_numpy()))
            coded = words.flatten().dictionary_encode()
            terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            lang, source = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
            group, group_of = np.unique(lang.indices.to_numpy().astype(np.int64) << 32 | source.indices.to_numpy(), return_inverse=True)
            in_doc, n = np.unique(doc * max(1, len(terms)) + code, return_counts=True)
            in_doc, code = np.divmod(in_doc, max(1, len(terms)))
            cell, cell_of = np.unique(group_of[in_doc] * max(1, len(terms)) + code, return_inverse=True)
            at, code = np.divmod(cell, max(1, len(terms)))
            count = np.bincount(cell_of, n, len(cell)).astype(np.int64)
            docs = np.bincount(cell_of, minlength=len(cell))
            word = terms.take(pa.array(code)).cast(pa.string())
            full = pc.not_equal(word, "")
            at = np.concatenate([at[full.to_numpy(zero_copy_only=False)], np.arange(len(group))])
            columns = {
                "lang": lang.dictionary.take(pa.array(group[at] >> 32)),
                "source": source.dictionary.take(pa.array(group[at] & 0xFFFFFFFF)),
                "term": pa.concat_arrays([word.filter(full), pa.array([""] * len(group), pa.string())]),
                "n": pa.concat_arrays([pa.array(count).filter(full), pa.array(np.zeros(len(group), np.int64))]),
                "docs": pa.concat_arrays([pa.array(docs).filter(full), pa.array(np.zeros(len(group), np.int64))]),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n and docs of all documents; every group also has a row of the empty term."""
    text, lang, source = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (text_col, lang_col, source_col))
    read = docs.select(text.alias("text"), lang.alias("lang"), source.alias("source"))
    counted = read.mapInArrow(_count_terms, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + ADDED) / total), exactly."""
    fits = count.max(initial=0) < (1 << 62) // UNIT
    return (1 + UNIT * ((count if fits else count.astype(object)) + ADDED) // total).astype(np.int64)


class Tree:
    """A k2-tree (k = 2) over the cells of a block: below[l] has, for each filled quadrant of level l, the places of its four in the next level, or -1."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, levels: int):
        code = np.zeros(len(row), np.int64)
        for bit in range(levels):
            code |= (row >> bit & 1) << (2 * bit + 1) | (col >> bit & 1) << (2 * bit)
        order = np.argsort(code)
        self.value, self.below = value[order], []
        nodes = np.unique(code >> 2 * levels)
        for level in range(1, levels + 1):
            inner = np.unique(code >> 2 * (levels - level))
            bits = np.zeros(4 * len(nodes), bool)
            bits[4 * np.searchsorted(nodes, inner >> 2) + (inner & 3)] = True
            self.below.append(np.where(bits, np.cumsum(bits) - 1, -1))
            nodes = inner
        self.root = 0 if len(row) else -1

    def child(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        if not len(self.value):
            return node
        return np.where(node < 0, -1, self.below[level][4 * np.maximum(node, 0) + quadrant])


def joint(a: Tree, b: Tree, empty_a: np.ndarray, empty_b: np.ndarray, n_cols: int, levels: int, same: bool) -> np.ndarray:
    """Sums of absolute differences over n_cols columns, of each row of a and each of b; of a block and itself only those above the diagonal.

    empty_a and empty_b are the rows' values where they have no cell.
    """
    n_a, n_b = len(empty_a), len(empty_b)
    total, width = np.zeros((n_a, n_b), np.int64), np.zeros((n_a, n_b), np.int64)
    if a.root < 0 and b.root < 0:
        return n_cols * np.abs(empty_a[:, None] - empty_b[None, :])
    if not n_cols:
        return total
    # widths of empty quadrants by level, laid over the rows at the end
    empty = [np.zeros((-(-n_a // (1 << levels - k)), -(-n_b // (1 << levels - k))), np.int64) for k in range(levels + 1)]
    one = np.zeros(1, np.int64)
    stack = [(0, one + a.root, one + b.root, one, one, one)]
    while stack:
        level, na, nb, ra, rb, c = stack.pop()
        if len(na) > OPENED:
            cut = len(na) // 2
            stack += [(level, *(x[:cut] for x in (na, nb, ra, rb, c))), (level, *(x[cut:] for x in (na, nb, ra, rb, c)))]
            continue
        if level == levels:
            va = np.where(na < 0, empty_a[ra], a.value[np.maximum(na, 0)] if len(a.value) else 0)
            vb = np.where(nb < 0, empty_b[rb], b.value[np.maximum(nb, 0)] if len(b.value) else 0)
            np.add.at(total, (ra, rb), np.abs(va - vb))
            continue
        size, opened = 1 << levels - level - 1, []
        for da in (0, 1):
            for db in (0, 1):
                for dc in (0, 1):
                    ta, tb, sa, sb, sc = a.child(level, na, 2 * da + dc), b.child(level, nb, 2 * db + dc), 2 * ra + da, 2 * rb + db, 2 * c + dc
                    inside = (sa * size < n_a) & (sb * size < n_b) & (sc * size < n_cols)
                    if same:
                        inside &= sa < sb if size == 1 else sa <= sb
                    none = inside & (ta < 0) & (tb < 0)
                    np.add.at(empty[level + 1], (sa[none], sb[none]), np.minimum(n_cols - sc[none] * size, size))
                    go = inside & ~none
                    opened.append([x[go] for x in (ta, tb, sa, sb, sc)])
        joined = [np.concatenate(x) for x in zip(*opened)]
        if len(joined[0]):
            stack.append((level + 1, *joined))
    for level, w in enumerate(empty):
        size = 1 << levels - level
        width += np.repeat(np.repeat(w, size, 0), size, 1)[:n_a, :n_b]
    return total + width * np.abs(empty_a[:, None] - empty_b[None, :])


def _tile(table: pa.Table) -> pa.Table:
    """The pairs' sums over a tile and each group's first terms in it; rows without a term list all groups of the language."""
    lang = table.column("lang")[0].as_py()
    is_group = table.column("term").is_null().to_numpy()
    groups, cells = table.filter(pa.array(is_group)), table.filter(pa.array(~is_group))
    source = np.array(groups.column("source").to_pylist(), object)
    total, n_terms, lang_total = (groups.column(x).to_numpy() for x in ("total", "n_terms", "lang_total"))
    weight = np.maximum(total + ADDED * n_terms, 1)
    word, col = np.unique(np.array([x.encode() for x in cells.column("term").to_pylist()], object), return_inverse=True)
    # filled rows and columns first, so that empty cells make up large quadrants
    at = {x: i for i, x in enumerate(source)}
    row = np.fromiter((at[x] for x in cells.column("source").to_pylist()), np.int64, len(cells))
    by_size = np.argsort(-np.bincount(row, minlength=len(source)), kind="stable")
    source, weight = source[by_size], weight[by_size]
    row = np.argsort(by_size)[row]
    n_cols = len(word)
    held, first = np.bincount(col, minlength=n_cols), np.full(n_cols, len(source))
    np.minimum.at(first, col, row)
    place = np.argsort(np.lexsort((first, -held)))[col] if n_cols else col
    p = shares(cells.column("n").to_numpy(), weight[row])
    none = shares(np.zeros(len(source), np.int64), weight)
    levels = max(1, n_cols - 1).bit_length()
    side = 1 << levels
    blocks = []
    for begin in range(0, len(source), side):
        own = (row >= begin) & (row < begin + side)
        blocks.append((begin, Tree(row[own] - begin, place[own], p[own], levels), none[begin : begin + side]))
    first_of, second_of, value = [], [], []
    for i, (begin_a, tree_a, none_a) in enumerate(blocks):
        for begin_b, tree_b, none_b in blocks[i:]:
            sums = joint(tree_a, tree_b, none_a, none_b, n_cols, levels, begin_a == begin_b)
            x, y = np.triu_indices(len(sums), 1) if begin_a == begin_b else np.divmod(np.arange(sums.size), sums.shape[1])
            first_of.append(source[begin_a + x])
            second_of.append(source[begin_b + y])
            value.append(sums[x, y])
    pairs = [np.concatenate(x) for x in (first_of, second_of, value)]
    swap = pairs[0] > pairs[1]
    q = shares(cells.column("n_lang").to_numpy(), np.maximum(lang_total[0] + ADDED * n_terms[0], 1))
    more = np.flatnonzero(p > q)
    more = more[np.lexsort((col[more], (q - p)[more], row[more]))]
    begins = np.searchsorted(row[more], np.arange(len(source)))
    more = more[np.arange(len(more)) - begins[row[more]] < TOP]
    columns = {
        "lang": [lang] * (len(pairs[0]) + len(more)),
        "part": ["pair"] * len(pairs[0]) + ["term"] * len(more),
        "source": [*np.where(swap, pairs[1], pairs[0]), *source[row[more]]],
        "item": [*np.where(swap, pairs[0], pairs[1]), *(x.decode() for x in word[col[more]])],
    }
    arrays = {k: pa.array(v, pa.string()) for k, v in columns.items()}
    return pa.table(arrays | {"value": pa.array(np.concatenate([pairs[2], (p - q)[more]]), pa.int64())})


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, tile_terms: int = TILE_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for each group the other sources of its language and the terms it uses more, farthest first."""
    with scratch(docs.sparkSession, "divergence") as kept:
        # the rows of the empty term are dealt by source
        held = Window.partitionBy("lang", "term", F.when(F.col("term") == "", F.col("source")).otherwise(""))
        counted = term_counts(docs, text_col, lang_col, source_col)
        counted = counted.withColumns({"in_docs": F.sum("docs").over(held), "n_lang": F.sum("n").over(held), "is_first": F.min("source").over(held) == F.col("source")})
        cells = materialize(counted.where((F.col("term") == "") | (F.col("in_docs") >= min_docs)).drop("docs", "in_docs"), "cells")
        # a row for each source of a language; ranks below have as many rows for each source
        of_lang = Window.partitionBy("lang")
        named = F.when(F.col("is_first") & (F.col("term") != ""), 1).otherwise(0)
        groups = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(named).alias("named"))
        groups = groups.withColumns({"n_terms": F.sum("named").over(of_lang), "lang_total": F.sum("total").over(of_lang), "n_groups": F.count("*").over(of_lang)})
        width = F.greatest(F.lit(16), F.least(F.lit(tile_terms), F.lit(TILE_CELLS) / F.col("n_groups")))
        groups = materialize(groups.withColumn("n_tiles", F.greatest(F.lit(1), F.ceil(F.col("n_terms") / width))).drop("named", "n_groups"), "sources")
        tiles_of = groups.select("lang", "n_tiles").distinct()
        placed = cells.where("term != ''").join(tiles_of, "lang").withColumn("tile", F.pmod(F.xxhash64("term"), "n_tiles"))
        listed = groups.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tiles") - 1)))
        both = placed.select("lang", "tile", "source", "term", "n", "n_lang").unionByName(listed.drop("n_tiles"), allowMissingColumns=True)
        summed = both.groupBy("lang", "tile").applyInArrow(_tile, "lang string, part string, source string, item string, value bigint")
        summed = materialize(summed.groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value")), "summed")
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
        pairs = summed.where("part = 'pair'").select("lang", "part", "value", F.explode(ways).alias("way")).select("lang", "way.source", "part", "way.item", "value")
        terms = summed.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", rank).where(F.col("rank") <= TOP)
        return kept(pairs.withColumn("rank", rank).unionByName(terms))
