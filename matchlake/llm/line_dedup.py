"""Line dedup by sorted hash ranges, with compressed keep bitmaps.

A line's key is the line without the white space at its two ends, A-Z
lower-cased. Keys of min_chars code points or more that two or more documents
hold keep their lines only in the document with the smallest id.

Nulls and ties: a null or empty text is one empty line; a null id counts as one
document after all others (so is the id 2**63 - 1); rows that repeat an id are one
document, so a line in both copies isn't shared by that alone; texts and lines of any
length are taken whole; an empty table gives no rows; other columns pass through
untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm._common import NO_ID, materialize, packed, scratch, shared_groups, unpacked

#: The white space that is stripped and the least length of a key.
SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10


def _hasher(min_chars: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, doc, mark, pos = [], [], [], []
            for d, m, text in zip(b.column("_doc").to_pylist(), b.column("_mark").to_pylist(), b.column("_text").cast(pa.large_binary()).to_pylist()):
                for i, line in enumerate((text or b"").lower().split(b"\n")):
                    key = line.strip(SPACE)
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        doc.append(d)
                        mark.append(m)
                        pos.append(i)
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), pa.array(pos, pa.int32())], ["h1", "h2", "doc", "mark", "pos"])

    return lines


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = []
        for drop in b.column("drop").to_pylist():
            bits = np.ones(-(-(max(drop) + 1) // 8) * 8, bool)
            bits[drop] = False
            made.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("mark"), pa.array(made, pa.binary())], ["doc", "mark", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, keep) for documents that lose lines: keep is zlib over bits, one a line, lowest bit first; lines past its end stay.

    doc is the id (NO_ID for null) and mark the text's hash, which tells apart rows that share an id.
    """
    named = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("_doc"), F.xxhash64(text_col).alias("_mark"), F.col(text_col).alias("_text"))
    with scratch(docs.sparkSession, "line-dedup") as kept:
        hashed = materialize(named.mapInArrow(_hasher(min_chars), "h1 bigint, h2 bigint, doc bigint, mark bigint, pos int"), "lines")
        dropped = shared_groups(hashed, ["h1", "h2"], "doc", "mark", "pos").where("not is_first")
        bits = dropped.groupBy("doc", "mark").agg(F.collect_set("pos").alias("drop")).mapInArrow(_bitmaps, "doc bigint, mark bigint, keep binary")
        return kept(bits)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, n_lines, n_dropped = [], [], []
        for text, keep in zip(b.column("_text").cast(pa.large_binary()).to_pylist(), b.column("keep").to_pylist()):
            text = text or b""
            n_lines.append(text.count(b"\n") + 1)
            gone = 0
            if keep is not None:
                lines, bits = text.split(b"\n"), np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
                stays = [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]
                gone, text = len(lines) - len(stays), b"\n".join(stays)
            n_dropped.append(gone)
            kept.append(text)
        yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])], ["_row", "kept", "n_lines", "n_dropped", "kept_sha256"])


def _applied(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    rows = packed(docs, id_col, text_col).select(F.struct(*[F.col("_row")[c].alias(c) for c in carried]).alias("_row"), F.coalesce(F.col(f"_{id_col}"), F.lit(NO_ID)).cast("long").alias("doc"), F.xxhash64(f"_{text_col}").alias("mark"), F.col(f"_{text_col}").alias("_text"))
    joined = rows.join(bitmaps, ["doc", "mark"], "left").select("_row", "_text", "keep")
    row = joined.schema["_row"].dataType.simpleString()
    return joined.mapInArrow(_cut, f"_row {row}, kept string, n_lines bigint, n_dropped bigint, kept_sha256 string")


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines, n_dropped, kept_sha256 of every document."""
    made = _applied(docs, keep_bitmaps(docs, min_chars, id_col, text_col), id_col, text_col, [id_col])
    return made.select(F.col("_row")[id_col].alias(id_col), "n_lines", "n_dropped", "kept_sha256")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the kept lines as its text; a column n_chars, if there is one, is set to the new length."""
    made = _applied(docs, keep_bitmaps(docs, min_chars, id_col, text_col), id_col, text_col, [c for c in docs.columns if c != text_col])
    new = {text_col: F.col("kept")} | ({"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return unpacked(made, docs, **new)
