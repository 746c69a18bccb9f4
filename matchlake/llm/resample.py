"""Importance resampling of documents towards a target text by hashed n-grams.

A text's separators collapse to single blanks. One overlapped scan with boundary lookarounds then gives a span for
each word: the longest run that begins there. As one blank stands between words, the shorter runs of that
word end a blank before the next spans begin, so all n-grams come from these spans. A run's CRC-32 is combined from
those of its words, since a CRC is linear over bits: what follows shifts it by a table.

Texts are scanned once: a table in the shared folder keeps each document's buckets as sorted differences of two bytes. Counts over
all documents and the target give a gain for each of the buckets, whose number bounds what reaches the driver. Scores are
sorted by range and numbered by the tasks' sizes, so the draw has no single task.

Nulls and ties: a null or empty text has no words, a weight of 0 and can't be drawn; a null id is the empty string in the
hash and comes last among equal scores; rows that repeat an id each have their own rank, fewer features first; texts are taken whole; an
empty table gives no rows, and an empty target is one without features; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, islice
from operator import methodcaller

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm._common import materialize, partitions, scratch

#: Words of a feature, buckets, percent drawn, words that a drawn document has at least, the draw's seed.
RUN, BUCKETS, PERCENT, MIN_WORDS, SEED = 3, 10_000, 5, 20, 42

#: Spans turned into features at once.
SPANS = 1 << 20
#: Bytes up to which a table shifts a CRC; what follows a longer word is computed from its bytes.
SHIFTS = 64

#: By byte: digits, letters with A-Z lower-cased and all of UTF-8's multi-byte characters, else a blank.
_WORD = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def collapsed(text: bytes) -> bytes:
    """The words of a text with single blanks between them."""
    return b" ".join(text.translate(_WORD).split())


def _shift_tables() -> np.ndarray:
    """[n][k][byte]: what a CRC's k-th byte contributes after n more bytes; CRCs of a word and of zeros behind it differ by that alone."""
    made = np.zeros((SHIFTS + 1, 4, 256), np.uint32)
    made[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    for n in range(SHIFTS):
        made[n + 1] = one[made[n] & 255] ^ made[n] >> 8
    return made


def scanner(run: int = RUN, buckets: int = BUCKETS):
    """A function from a text's bytes to its number of words and the sorted buckets of all its runs of 1 to run words."""
    spans = regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){0,%d}(?![^ ])" % (run - 1))
    tables, span = _shift_tables(), methodcaller("span")

    def joined(crc: np.ndarray, more: np.ndarray, size: np.ndarray) -> np.ndarray:
        """CRCs of runs followed by size bytes whose own CRC is more."""
        t = tables[np.minimum(size, SHIFTS)[:, None], np.arange(4)[None, :], crc[:, None] >> (8 * np.arange(4, dtype=np.uint32))[None, :] & 255]
        return np.bitwise_xor.reduce(t, 1) ^ more

    def features(s: bytes, begin: np.ndarray, n_new: int) -> np.ndarray:
        """Buckets of the runs that begin at the first n_new of begin; the last of begin is a blank past the end of the last word."""
        size = np.diff(begin)
        word = np.fromiter(map(zlib.crc32, s[begin[0] : begin[-1] - 1].split(b" ")), np.uint32, len(size))
        behind = joined(np.full(len(size), zlib.crc32(b" "), np.uint32), word, size - 1)
        out, crc = [word[:n_new]], word
        for n in range(1, run):
            crc = joined(crc[: len(size) - n], behind[n:], size[n:])
            for i in np.flatnonzero(np.maximum.reduce([size[k : len(size) - n + k] for k in range(1, n + 1)]) > SHIFTS) if len(crc) else ():
                crc[i] = zlib.crc32(s[begin[i] : begin[i + n + 1] - 1])
            out.append(crc[:n_new])
        return (np.concatenate(out) % buckets).astype("<u2")

    def scan(text: bytes) -> tuple[int, np.ndarray]:
        s, n_words, found = collapsed(text), 0, []
        flat = chain.from_iterable(map(span, spans.finditer(s, overlapped=True)))
        carried = np.zeros(0, np.int64)
        while True:
            fresh = np.fromiter(islice(flat, 2 * SPANS), np.int64)[::2]
            n_words += len(fresh)
            begin = np.concatenate([carried, fresh])
            if len(fresh) < SPANS:
                if len(begin):
                    found.append(features(s, np.append(begin, len(s) + 1), len(begin)))
                break
            # runs that begin at the last words wait for what follows
            n_new = len(begin) - run
            found.append(features(s, begin, n_new))
            carried = begin[n_new:]
        return n_words, np.sort(np.concatenate(found)) if found else np.zeros(0, "<u2")

    return scan


def _scanned(run: int, buckets: int):
    def scan_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(run, buckets)
        for b in batches:
            n_words, n_features, held = [], [], []
            for text in b.column("text").cast(pa.large_binary()):
                words, sorted_buckets = scan(text.as_py() or b"")
                n_words.append(words)
                n_features.append(len(sorted_buckets))
                held.append(np.diff(sorted_buckets, prepend=np.zeros(1, "<u2")).astype("<u2").tobytes())
            columns = [b.column("id"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "buckets"])

    return scan_all


def features(df: DataFrame, id_col: str, text_col: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, n_features and buckets (differences of the sorted buckets, two bytes each) of every row."""
    read = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(_scanned(run, buckets), f"id {kind}, n_words bigint, n_features bigint, buckets binary")


def _buckets(held: pa.Scalar) -> np.ndarray:
    return np.cumsum(np.frombuffer(held.as_buffer(), "<u2"), dtype=np.uint16)


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: a task's counts are a vector, so that it hands on a row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for held in b.column("buckets"):
                n += np.bincount(_buckets(held), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["bucket", "n"])

    return scanned.select("buckets").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: floor(1000 * ln of the bucket's smoothed share in the target over that in the documents), for each of the buckets."""
    spark = documents.sparkSession
    # a row for each bucket at most
    both = bucket_counts(documents, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(bucket_counts(target, buckets).select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    each = both.unionByName(spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).alias("s"), F.lit(0).alias("t"))).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    each = each.crossJoin(F.broadcast(each.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))))
    x = lambda name, more: (F.col(name) + more).cast("double")
    return each.select("bucket", F.floor(1000 * F.ln(x("t", 1) * x("all_s", buckets) / (x("s", 1) * x("all_t", buckets)))).alias("gain"))


def weighed(scanned: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, n_features and weight, the sum of gains over a row's features."""
    by_bucket = np.zeros(buckets, np.int64)
    for r in gain.toLocalIterator():  # a row for each bucket
        by_bucket[r["bucket"]] = r["gain"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight = [int(by_bucket[_buckets(held)].sum()) for held in b.column("buckets")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "n_words", "n_features")), pa.array(weight, pa.int64())], ["id", "n_words", "n_features", "weight"])

    kind = scanned.schema["id"].dataType.simpleString()
    return scanned.mapInArrow(weigh, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with place, 1 for the first row in order: sorted by range, each task's rows are numbered on from all before."""
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    # a task's number in the upper bits and the row's in the lower; written, as another run may deal otherwise
    dealt = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "sorted")
    task = F.shiftright("at", 33).alias("task")
    sizes = dealt.groupBy(task).agg(F.count("*").alias("n"))
    # a row for each task
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    placed = dealt.withColumn("task", task).join(F.broadcast(offsets), "task")
    return placed.withColumn("place", F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("task", "offset", "at")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """id, n_features, weight, score and rank of every document; rank is null for those that aren't drawn."""
    with scratch(docs.sparkSession, "resample") as kept:
        scanned = materialize(features(docs, id_col, text_col), "features")
        aim = materialize(features(target.withColumn("_none", F.lit(None).cast("long")), "_none", target_text_col), "target")
        rows = weighed(scanned, gains(scanned, aim))
        said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
        drawn = (F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)
        rows = rows.withColumns({"score": F.col("weight") + F.floor(-1000 * F.ln(-F.ln(drawn))), "fit": F.col("n_words") >= min_words})
        rows = numbered(rows, F.desc("fit"), F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"))
        n = rows.agg(F.count_if("fit").alias("n_fit"))  # one row
        rank = F.when(F.col("fit") & (F.col("place") <= F.floor(percent * F.col("n_fit") / 100)), F.col("place"))
        return kept(rows.crossJoin(F.broadcast(n)).select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank")))
