"""Passages that repeat across documents, by a sparse suffix array.

Of the suffixes that begin at each word only those at content-selected positions are
retained: a position whose k-gram hash is the least in some window of w positions (a
minimiser). Two copies of a passage of min_words words hold the same minimiser within
its first w positions, and from there at least head = min_words - w + 1 words in common.

1. Every suffix is retained with hashes of its head and of its context (from w - 1
   words before to min_words behind). Sorted hash ranges leave the suffixes whose head
   a second document has. Where a second document has the whole context, all of it
   repeats; such copies are done, however many they are, and one of them stands for all.
2. The others, and those that stand for copies, form the suffix array: their words are
   fetched, they are range-partitioned by them and sorted, and each is compared with its
   neighbour. The common lengths of neighbours say for any n which suffixes agree in
   their next n words; a second sort by the words before them says the same to the left.
3. So every window of min_words words over the suffix's beginning, l words to the left
   and min_words - l to the right, is compared by true words: it repeats if suffixes of
   two documents are alike on both sides. What repeats is extended to both sides by
   joining the windows of all l.
4. Suffixes with one head may be dealt to several tasks, or be too many for one to hold.
   Those at a task's ends are left open: what no neighbour there decides goes, by 128-bit
   hashes of windows, through the sorted ranges that line dedup uses, beside one row for
   each window that is decided, so that no task sees a group whole.

A word is covered exactly if it lies in a run of min_words words that two documents or
more contain. 64-bit hashes only propose suffixes (and equal contexts of min_words + w
- 1 words); rows of one context are copies.

Nulls and ties: a null text has no words; a null id is a document after all others
(shared by all rows without one, and by the id 2**63 - 1); repeats inside one document,
or in rows that repeat an id, don't count; words are split at blanks and 09-0D and
compared exactly; texts and words of any length are taken whole; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm._common import HELD_ROWS, NO_ID, materialize, partitions, scratch, shared_groups

MIN_WORDS = 50
WINDOW = 25
GRAM = 8
#: Suffixes of one head that a task compares at a time, and bytes of a suffix that ranges go by.
ARRAY_ROWS, KEY_BYTES = 20_000, 128
#: An odd factor of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any run of a text's words."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        powers = np.full(n, BASE, np.uint64)
        if n:
            powers[0] = 1
        digest = xxhash.xxh3_64_intdigest
        h = np.fromiter(map(digest, words), np.uint64, n)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64)))
        powers = np.full(n + 1, INVERSE, np.uint64)
        powers[0] = 1
        self.scale = np.cumprod(powers, dtype=np.uint64)

    def run(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * self.scale[begin])


def _slide(a: np.ndarray, size: int, best) -> np.ndarray:
    """best over every window of a, by doubling."""
    width = 1
    while 2 * width <= size:
        a = best(a[:-width], a[width:])
        width *= 2
    return best(a[: len(a) - (size - width)], a[size - width :]) if size > width else a


def minimisers(rolling: Rolling, n: int, min_words: int, window: int, gram: int) -> np.ndarray:
    """Positions whose k-gram hash is the least of a window that begins where min_words words follow."""
    starts = n - min_words + 1
    if starts < 1:
        return np.zeros(0, np.int64)
    at = np.arange(starts + window - 1)
    g = rolling.run(at, at + gram)
    least = _slide(g, window, np.minimum)
    pad = np.zeros(window - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate((pad, least, pad)), window, np.maximum) == g)


def _suffixes(min_words: int, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = min_words - window + 1
        for b in batches:
            out = []
            ids, marks, texts = b.column("_doc").to_pylist(), b.column("_mark").to_pylist(), b.column("_text").cast(pa.large_binary())
            for d, m, text in zip(ids, marks, texts):
                words = (text.as_py() or b"").split()
                n = len(words)
                if n < min_words:
                    continue
                r = Rolling(words)
                a = minimisers(r, n, min_words, window, gram)
                lo, hi = np.maximum(a - window + 1, 0), np.minimum(a + min_words, n)
                context = _mixed(r.run(lo, hi) ^ ((a - lo) * 1000 + hi - a).astype(np.uint64))
                same = np.full(len(a), d), np.full(len(a), m)
                at = a.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32)
                out.append((r.run(a, a + head).view(np.int64), context.view(np.int64), *same, *at))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["head", "context", "doc", "mark", "pos", "lo", "hi"])

    return run


RETAINED = "head bigint, context bigint, doc bigint, mark bigint, pos int, lo int, hi int"
CLASSED = f"{RETAINED}, class_lo bigint, class_hi bigint, head_lo bigint, head_hi bigint, stands boolean, open_head boolean, open_class boolean"


def _ends(begin: np.ndarray, n: int) -> np.ndarray:
    return np.append(begin[1:], n)


def _classed(held_rows: int):
    """Streams rows sorted by head, context and doc: adds the least and greatest doc of each head and context.

    The first and last head of a task, and one that held_rows rows don't hold, are open: they may go on elsewhere.
    """

    def judged(t: pa.Table, opened: list[int]) -> Iterator[pa.RecordBatch]:
        head, context, doc = (t.column(c).to_numpy() for c in ("head", "context", "doc"))
        n = len(head)
        new_head = np.append(True, head[1:] != head[:-1])
        new_class = new_head | np.append(True, context[1:] != context[:-1])
        h, c = np.flatnonzero(new_head), np.flatnonzero(new_class)
        h_of, c_of = np.cumsum(new_head) - 1, np.cumsum(new_class) - 1
        lo, hi, first = doc[c], doc[_ends(c, n) - 1], c_of[h]
        head_lo, head_hi = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
        is_open = np.isin(head[h], opened)
        edge = np.zeros(len(c), bool)
        edge[first], edge[_ends(first, len(c)) - 1] = True, True
        edge &= is_open[h_of[c]]
        asked = np.logical_or.reduceat(lo == hi, first) | is_open
        more = {"class_lo": lo[c_of], "class_hi": hi[c_of], "head_lo": head_lo[h_of], "head_hi": head_hi[h_of]}
        more |= {"stands": new_class & asked[h_of], "open_head": is_open[h_of], "open_class": edge[c_of]}
        for name, x in more.items():
            t = t.append_column(name, pa.array(x))
        yield from t.filter(pa.array((is_open | (head_lo < head_hi))[h_of])).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, going_on = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            head = t.column("head").to_numpy()
            first = head[0] if first is None else first
            cut = int(np.searchsorted(head, head[-1]))
            opened = [first] if going_on is None else [first, going_on]
            if len(t) - cut > held_rows:
                cut, going_on = len(t), head[-1]
                opened.append(going_on)
            if cut:
                yield from judged(t.slice(0, cut), opened)
            held = t.slice(cut) if cut < len(t) else None
        if held is not None:
            yield from judged(held, [held.column("head")[0].as_py()])

    return run


def _settled(known: dict[int, bool], ends: dict[tuple[int, int], tuple[int, int]]):
    """Open heads and classes as the ends of all tasks say: heads of one document go, open classes get their least and greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head, context = b.column("head").to_numpy(), b.column("context").to_numpy()
            lo, hi = b.column("class_lo").to_numpy().copy(), b.column("class_hi").to_numpy().copy()
            keep = np.ones(len(head), bool)
            for i in np.flatnonzero(b.column("open_head").to_numpy(zero_copy_only=False)).tolist():
                keep[i] = known.get(int(head[i]), False)
            for i in np.flatnonzero(b.column("open_class").to_numpy(zero_copy_only=False)).tolist():
                lo[i], hi[i] = ends[int(head[i]), int(context[i])]
            new = {"class_lo": pa.array(lo), "class_hi": pa.array(hi)}
            made = pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in b.schema.names], b.schema.names)
            yield made.filter(pa.array(keep))

    return run


CONTEXT = "right binary, left binary, doc bigint, mark bigint, pos int, last bigint, stands boolean"


def _contexts(min_words: int, window: int):
    """The words behind and, backwards, before each asked position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, mark, asked, text in zip(*(b.column(x).to_pylist() for x in ("doc", "mark", "asked")), b.column("_text").cast(pa.large_binary())):
                words, rows = text.as_py().split(), []
                for c in asked:
                    p = c["pos"]
                    left = words[max(0, p - window + 1) : p]
                    left.reverse()
                    rows.append((b" ".join(words[p : p + min_words]), b" ".join(left), doc, mark, p, c["last"], c["stands"]))
                types = pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()
                cols = [pa.array(x, t) for x, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(cols, ["right", "left", "doc", "mark", "pos", "last", "stands"])

    return run


def _common(a: list[bytes], b: list[bytes]) -> int:
    """The number of words that two texts begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _words(x: bytes) -> list[bytes]:
    return x.split(b" ") if x else []


def _alike(sorted_texts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For texts in order: the words each has in common with the one before it (-1 for the first), and its number of words."""
    common, size, before = [], [], None
    for x in sorted_texts:
        words = _words(x)
        common.append(-1 if before is None else _common(before, words))
        size.append(len(words))
        before = words
    return np.array(common), np.array(size)


FOUND = "doc bigint, mark bigint, pos int, most int, least int, first_doc bigint, h1 bigint, h2 bigint, asks boolean"
FOUND_TYPES = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()


def _array(min_words: int, window: int, array_rows: int):
    """Streams the sorted suffixes. Rows without h1 are results; those with it are windows left open (most = least = l)."""
    head = min_words - window + 1

    def batch(*cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, FOUND_TYPES)], [x.split()[0] for x in FOUND.split(", ")])

    def compared(t: pa.Table, lcp: np.ndarray, n_right: np.ndarray, starts: np.ndarray, open_first: bool, open_last: bool) -> Iterator[pa.RecordBatch]:
        n, lcp = len(t), np.append(-1, lcp[1:])
        doc, mark, pos, last, stands = (t.column(c).to_numpy() for c in ("doc", "mark", "pos", "last", "stands"))
        left = t.column("left").to_pylist()
        order = np.array(sorted(range(n), key=left.__getitem__))
        llcp, size = _alike(left[i] for i in order.tolist())
        n_left = np.empty(n, int)
        n_left[order] = size
        group = np.cumsum(starts)
        is_open = (group == group[0]) & open_first | (group == group[-1]) & open_last
        most, least, first_doc, left_open = np.full(n, -1), np.full(n, window), np.full(n, NO_ID), []
        for l in range(window):
            left_class = np.empty(n, np.int64)
            left_class[order] = np.cumsum(llcp < l)
            ok = np.flatnonzero((n_left >= l) & (n_right >= min_words - l))
            if not len(ok):
                continue
            key = (left_class * (n + 1) + np.cumsum(lcp < min_words - l))[ok]
            by = np.argsort(key, kind="stable")
            begin = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
            lo, hi = np.minimum.reduceat(doc[ok[by]], begin), np.maximum.reduceat(last[ok[by]], begin)
            size = _ends(begin, len(by)) - begin
            both = np.repeat(lo < hi, size)
            at = ok[by][both]
            most[at], least[at] = np.maximum(most[at], l), np.minimum(least[at], l)
            first_doc[at] = np.minimum(first_doc[at], np.repeat(lo, size)[both])
            # a window of an open head that repeats here stands for itself elsewhere; others ask
            one = ok[by[begin]]
            for j in np.flatnonzero(is_open[one] & (lo < hi)).tolist():
                left_open += [(int(one[j]), l, int(lo[j]), False), (int(one[j]), l, int(hi[j]), False)]
            alone = ok[by][~both]
            left_open += [(i, l, int(doc[i]), not stands[i]) for i in alone[is_open[alone]].tolist()]
        done = np.flatnonzero((most >= 0) & ~stands)
        none = [None] * len(done)
        yield batch(doc[done], mark[done], pos[done], most[done], least[done], first_doc[done], none, none, np.ones(len(done), bool))
        rights = t.column("right")
        for begin in range(0, len(left_open), 10_000):
            rows = []
            for i, l, d, asks in left_open[begin : begin + 10_000]:
                right, before = _words(rights[i].as_py()), _words(left[i])
                h = xxhash.xxh3_128_digest(b" ".join(before[:l]) + b"\n" + b" ".join(right[: min_words - l]))
                rows.append((d, int(mark[i]), int(pos[i]), l, l, None, *np.frombuffer(h, "<i8").tolist(), bool(asks)))
            yield batch(*zip(*rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, opened, before, text = None, True, None, b""
        lcp, size, starts = np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        for b in batches:
            if not b.num_rows:
                continue
            common, counts, begun = [], [], []
            for x in b.column("right").to_pylist():
                words = _words(x)
                common.append(-1 if before is None else _common(before, words))
                counts.append(len(words))
                # a head, or what the ranges go by if that is shorter, isn't cut
                begun.append(common[-1] < head and x[:KEY_BYTES] != text[:KEY_BYTES])
                before, text = words, x
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            lcp, size, starts = np.append(lcp, common), np.append(size, counts), np.append(starts, begun)
            last = np.flatnonzero(starts)
            cut = int(last[-1]) if len(last) else 0
            whole = len(held) - cut <= array_rows
            if not whole:
                cut = len(held)
            if cut:
                yield from compared(held.slice(0, cut), lcp[:cut], size[:cut], starts[:cut], opened, not whole)
                held, lcp, size, starts, opened = held.slice(cut) if cut < len(held) else None, lcp[cut:], size[cut:], starts[cut:], not whole
        if held is not None:
            yield from compared(held, lcp, size, starts, opened, True)

    return run


def _repeats(named: DataFrame, min_words: int, window: int, gram: int, held_rows: int, array_rows: int) -> DataFrame:
    """(doc, mark, a, b, first_doc): runs of words that repeat."""
    n = partitions(named.sparkSession)
    retained = materialize(named.mapInArrow(_suffixes(min_words, window, gram), RETAINED), "suffixes")
    by = ["head", "context", "doc"]
    rows = materialize(retained.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(_classed(held_rows), CLASSED), "classed")
    # open heads and classes number two and four for each task (and for every held_rows rows)
    least, most = F.min("head_lo").alias("lo"), F.max("head_hi").alias("hi")
    known = {r["head"]: r["lo"] < r["hi"] for r in rows.where("open_head").groupBy("head").agg(least, most).collect()}
    least, most = F.min("class_lo").alias("lo"), F.max("class_hi").alias("hi")
    ends = {(r["head"], r["context"]): (r["lo"], r["hi"]) for r in rows.where("open_class").groupBy("head", "context").agg(least, most).collect()}
    rows = rows.mapInArrow(_settled(known, ends), CLASSED).withColumn("whole", F.expr("class_lo < class_hi"))
    copies = rows.where("whole").select("doc", "mark", F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("class_lo").alias("first_doc"))

    one = F.struct("pos", F.when(F.col("whole"), F.col("class_hi")).otherwise(F.col("doc")).alias("last"), F.col("whole").alias("stands"))
    asked = rows.where("not whole or stands").groupBy("doc", "mark").agg(F.collect_list(one).alias("asked"))
    texts = named.join(asked, (F.col("_doc") == F.col("doc")) & (F.col("_mark") == F.col("mark"))).select("doc", "mark", "asked", "_text")
    contexts = materialize(texts.mapInArrow(_contexts(min_words, window), CONTEXT), "contexts")
    # ranges by the beginnings, as samples of them go to the driver
    keys = F.substring("right", 1, KEY_BYTES), F.substring("left", 1, KEY_BYTES // 4), F.col("doc")
    found = contexts.repartitionByRange(n, *keys).sortWithinPartitions("right", "left", "doc").mapInArrow(_array(min_words, window, array_rows), FOUND)
    found = materialize(found, "array")
    across = shared_groups(found.where("h1 is not null").drop("first_doc"), ["h1", "h2"], "doc").where("asks")
    across = across.groupBy("doc", "mark", "pos").agg(F.max("most").alias("most"), F.min("least").alias("least"), F.min("least_doc").alias("first_doc"))
    every = found.where("h1 is null").select(*across.columns).unionByName(across)
    begin, end = F.col("pos") - F.col("most"), F.col("pos") - F.col("least") + min_words
    return copies.unionByName(every.select("doc", "mark", begin.alias("a"), end.alias("b"), "first_doc"))


def repeated_passages(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    window: int = WINDOW,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_rows: int = HELD_ROWS,
    array_rows: int = ARRAY_ROWS,
) -> DataFrame:
    """id, start_word, end_word (exclusive) and first_doc_id: the passages of each document that others repeat, joined where they overlap or touch.

    first_doc_id is the smallest id that a comparison of its suffixes met, which may be the document's own: a document that
    has it too, though not always the smallest one of all.
    """
    if not gram <= min_words - window + 1 or window < 2:
        raise ValueError("needs gram <= min_words - window + 1 and window >= 2")
    doc, mark = F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("_doc"), F.xxhash64(text_col).alias("_mark")
    named = docs.select(doc, mark, F.col(text_col).alias("_text"))
    with scratch(docs.sparkSession, "passages") as kept:
        spans = _repeats(named, min_words, window, gram, held_rows, array_rows)
        w = Window.partitionBy("doc", "mark").orderBy("a", "b")
        edge = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
        islands = spans.withColumn("new", F.coalesce((F.col("a") > edge).cast("int"), F.lit(1)))
        islands = islands.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        joined = islands.groupBy("doc", "mark", "island").agg(F.min("a").alias("start_word"), F.max("b").alias("end_word"), F.min("first_doc").alias("first_doc"))
        real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
        return kept(joined.select(real("doc").alias(id_col), "start_word", "end_word", real("first_doc").alias("first_doc_id")))
