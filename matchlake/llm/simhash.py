"""SimHash near-dedup with pivot distance tables.

A document's fingerprint has bit i set if more than half of its shingles' XXH64
(seed 42) have it. Fingerprints link at radius differing bits or fewer, and the
document's class is the smallest id that links reach.

Work is done on distinct fingerprints, so exact copies cost one row. The 64 bits
are cut in radius + 2 blocks; two linked fingerprints agree on at least two of
them, so each is listed once for every pair of blocks and only those that share a
list are compared. In a list, the Hamming distances to many reference fingerprints
(the pivots) form a table: by the triangle inequality, two rows that differ by
more than the radius in any coordinate are too far apart. Rows are sorted by the
first coordinate, so only a narrow band is compared; survivors are verified bit by
bit and a spanning set of links leaves the task, never all pairs.

Lists are dealt to tasks by ranges of their key and fingerprints, so a very large group
of near copies is spread over many. A list that a task doesn't see whole, or that has
over pairwise_max rows, takes a way that is linear in its rows: fingerprints within radius
bits have a midpoint within half of them (rounded up for the one, down for the other), so
all that have a midpoint are linked to the least that has it within the lesser half. Half
a radius of one makes 65 rows of each such fingerprint, of two 2,081.

Nulls and ties: a null text has no words, and so the fingerprint zero, which links
like any other; a null id takes part in links but never becomes a class id unless
no other member has one; rows that repeat an id each get their class; long texts are
taken whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm._common import components, materialize, packed, partitions, scratch

SHINGLE = 3
RADIUS = 2
PIVOTS = 32
PAIRWISE_MAX = 2048
#: Fixed value: the seed of the shingles' hash.
SEED = 42


def pivots(n: int) -> np.ndarray:
    """n reference fingerprints, by rule: hashes of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(str(i), 7) for i in range(n)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is in over half of the hashes; zero without any."""
    votes, m = np.zeros(64, np.int64), len(hashes)
    for i in range(0, m, 65_536):
        part = hashes[i : i + 65_536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > m, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    k = min(size, n)
    begin = np.concatenate(([0], ends[: n - k])).tolist()
    digest, m = xxhash.xxh64_intdigest, n - k + 1
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(begin, (ends[k - 1 :] - 1).tolist())], np.uint64, m)
    return majority(hashes)


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t, size) for t in b.column("_text").cast(pa.large_binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(made.view(np.int64))], ["_row", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE, text_col: str = "text", carried: list[str] | None = None) -> DataFrame:
    """_row (a struct of the carried columns, all if not given) and fp, the fingerprint as a signed long."""
    rows = packed(docs, text_col).select(F.struct(*[F.col("_row")[c].alias(c) for c in carried or docs.columns]).alias("_row"), F.col(f"_{text_col}").alias("_text"))
    return rows.mapInArrow(_fingerprints(size), f"_row {rows.schema['_row'].dataType.simpleString()}, fp bigint")


def _masks(radius: int) -> list[int]:
    """A mask for each pair of the radius + 2 blocks."""
    cuts = np.linspace(0, 64, radius + 3).astype(int)
    blocks = [sum(1 << i for i in range(a, b)) for a, b in zip(cuts[:-1], cuts[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def _links(radius: int, n_pivots: int, pairwise_max: int):
    references = pivots(n_pivots)

    def distances(fps: np.ndarray) -> np.ndarray:
        """The table: a fingerprint's distances to the pivots."""
        return np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)

    def couples(fps: np.ndarray, begin: np.ndarray) -> tuple[list[int], list[int]]:
        """The links of all lists of two rows, which begin at the given places."""
        a, b = fps[begin], fps[begin + 1]
        kept = np.flatnonzero(np.abs(distances(a) - distances(b)).max(1, initial=0) <= radius)
        kept = kept[np.bitwise_count(a[kept] ^ b[kept]) <= radius]
        return a[kept].tolist(), b[kept].tolist()

    def spanning(fps: np.ndarray) -> Iterator[tuple[int, int]]:
        """A spanning set of the links among distinct fingerprints."""
        table = distances(fps)
        order = np.argsort(table[:, 0], kind="stable")
        fps, table = fps[order], table[order]
        ends = np.searchsorted(table[:, 0], table[:, 0] + radius, "right")
        root = list(range(len(fps)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(len(fps)):
            near = np.arange(i + 1, ends[i])
            if len(near):
                near = near[np.abs(table[near] - table[i]).max(1) <= radius]
                for j in near[np.bitwise_count(fps[near] ^ fps[i]) <= radius].tolist():
                    a, b = find(i), find(j)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        yield int(fps[i]), int(fps[j])

    def batch(a: list[int], b: list[int | None]) -> pa.RecordBatch:
        signed = lambda x: None if x is None else int(np.uint64(x).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(list(map(signed, c)), pa.int64()) for c in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists come sorted; one may go on in the next batch. A task's first and last list and large ones are passed on row by row."""
        held: tuple | None = None
        crowded = None
        for b in batches:
            if not b.num_rows:
                continue
            t, k, f = b.column("t").to_numpy(), b.column("k").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            if held is not None:
                t, k, f = (np.concatenate(x) for x in zip(held, (t, k, f)))
            begin = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1]))))
            crowded = crowded or (t[0], k[0])
            ends = np.append(begin[1:], len(f))
            size, first = ends - begin, (t[begin] == crowded[0]) & (k[begin] == crowded[1])
            two = (size == 2) & (ends < len(f)) & ~first & (pairwise_max >= 2)
            a_out, b_out = couples(f, begin[two])
            other = ~two & ((size > 1) | first)
            for i, end in zip(begin[other].tolist(), ends[other].tolist()):
                if (t[i], k[i]) == crowded or end - i > pairwise_max:
                    crowded = (t[i], k[i])
                    a_out += f[i:end].tolist()
                    b_out += [None] * (end - i)
                elif end < len(f) and end - i > 1:
                    for x, y in spanning(f[i:end]):
                        a_out.append(x)
                        b_out.append(y)
            last = begin[-1]
            held = None if (t[last], k[last]) == crowded else (t[last:], k[last:], f[last:])
            if a_out:
                yield batch(a_out, b_out)
        if held is not None:
            yield batch(held[2].tolist(), [None] * len(held[2]))

    return run


def _ball(fp: Column, radius: int) -> Column:
    """All fingerprints within radius bits of fp."""
    bits = F.sequence(F.lit(0), F.lit(63))
    flipped = lambda x: F.transform(bits, lambda i: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    ball = F.array(fp)
    for _ in range(radius):
        ball = F.array_distinct(F.concat(ball, F.flatten(F.transform(ball, flipped))))
    return ball


def links(fps: DataFrame, radius: int = RADIUS, n_pivots: int = PIVOTS, pairwise_max: int = PAIRWISE_MAX) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that span every class."""
    signed = [m if m < 1 << 63 else m - (1 << 64) for m in _masks(radius)]
    lists = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])
    order = ["t", "k", "fp"]
    keyed = fps.select("fp", F.explode(lists).alias("x")).select("x.t", "x.k", "fp")
    dealt = keyed.repartitionByRange(partitions(fps.sparkSession), *order).sortWithinPartitions(*order)
    found = materialize(dealt.mapInArrow(_links(radius, n_pivots, pairwise_max), "a bigint, b bigint"), "links")
    crowded = found.where("b is null").select("a").distinct()
    middles = lambda r: crowded.select("a", F.explode(_ball(F.col("a"), r)).alias("z"))
    least = middles(radius // 2).groupBy("z").agg(F.min("a").alias("b"))
    return found.where("b is not null").unionByName(middles(-(-radius // 2)).join(least, "z").where("a != b").select("a", "b").distinct())


def simhash_classes(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, n_pivots: int = PIVOTS, pairwise_max: int = PAIRWISE_MAX, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (signed long) and component_id of every document."""
    with scratch(docs.sparkSession, "simhash") as kept:
        named = materialize(fingerprints(docs, size, text_col, [id_col]).select(F.col("_row")[id_col].alias("_id"), "fp"), "fingerprints")
        distinct = materialize(named.groupBy("fp").agg(F.min("_id").alias("least")), "distinct")
        roots = components(links(distinct.select("fp"), radius, n_pivots, pairwise_max))
        member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
        classes = member.join(smallest, "root").select("fp", "component_id")
        return kept(named.join(classes, "fp").select(F.col("_id").alias(id_col), "fp", "component_id"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
