"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about frame_bytes, so one frame can
be fetched and decompressed without the others. A skippable frame at the end of a
bundle is its seek table: the compressed and decompressed size of every frame. The
index maps each record to bundle, frame and the offset inside the frame.

Of records with equal payloads of at least min_bytes the one with the smallest
page id is a response; the others are revisits without payload that name it.

Every record has an id of its own, a date and a content type. Reading goes by the index, frame by frame.

Files get a name of their own for each attempt of a task, and only those in the
index count, so a lost or repeated task leaves nothing but an unused file.

Nulls and ties: a null html is an empty payload, a null url leaves out the target
header, a null page id is never the one that others revisit while there is
another; rows that repeat the smallest id are all responses; of several equal rows
each has a record; a payload longer than a frame gets a frame of its own and is held
whole by one task; an empty table gives an empty index; other columns aren't archived.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm._common import materialize, partitions, shared_dir

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 28
#: Magic numbers of a skippable frame and of a seek table (Zstandard seekable format).
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id bigint, bundle string, frame int, offset_in_frame bigint, record_bytes bigint"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: int | None, is_revisit: bool, date: str, first_url: str | None = None) -> bytes:
    """A record with an id of its own. Pages are named by X-Page-ID, and what a revisit refers to by its url, date and X-Refers-To-Page-ID."""
    plain = lambda u: u.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + plain(url))
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {revisits}"]
        if first_url is not None:
            head.append("WARC-Refers-To-Target-URI: " + plain(first_url))
    body = b"" if is_revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The headers and body of the record at an offset, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
    begin = end + 4
    stop = begin + int(head["Content-Length"])
    return head, data[begin:stop], stop + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """Offset, compressed and decompressed size of each frame of an open bundle."""
    end = file.size()
    n, _, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    at, found = 0, []
    for small, large in struct.iter_unpack("<II", file.read_at(8 * n, end - 9 - 8 * n)):
        found.append((at, small, large))
        at += small
    return found


def _writer(folder: str, frame_bytes: int, bundle_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        packer = zstandard.ZstdCompressor(level=3)
        out, name, sizes, written, frame, held = None, "", [], 0, [], 0
        index: list[tuple] = []

        def flush():
            nonlocal frame, held, written
            if frame:
                small = packer.compress(b"".join(frame))
                out.write(small)
                sizes.append((len(small), held))
                written, frame, held = written + len(small), [], 0

        def close():
            nonlocal out
            flush()
            out.write(seek_table(sizes))
            out.close()
            out = None

        try:
            for b in batches:
                for r in b.to_pylist():
                    payload = (r["html"] or "").encode()
                    if out is None:
                        name, sizes, written = f"{uuid.uuid4().hex}.warc.zst", [], 0
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                    made = record(r["page_id"], r["url"], payload, digest, r["refers_to"], r["refers_to"] is not None, date, r["first_url"])
                    index.append((r["page_id"], f"{folder}/{name}", len(sizes), held, len(made)))
                    frame.append(made)
                    held += len(made)
                    if held >= frame_bytes:
                        flush()
                        if written >= bundle_bytes:
                            close()
                if index:
                    types = pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*index), types)], ["page_id", "bundle", "frame", "offset_in_frame", "record_bytes"])
                    index = []
            if out is not None:
                close()
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) as bundles into a folder that all executors share; returns the index. date: of all records, now by default (UTC)."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    date = date or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("x")
    copies = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(first, F.count("*").alias("n")).where("n > 1")
    copies = copies.select("sha1", F.col("x.page_id").alias("first"), F.col("x.url").alias("url_of_first"))
    again = ~F.col("page_id").eqNullSafe(F.col("first"))
    told = rows.join(copies, "sha1", "left").select("page_id", "url", "html", "sha1", F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("url_of_first")).alias("first_url"))
    return materialize(told.mapInArrow(_writer(folder, frame_bytes, bundle_bytes, date), INDEX), "warc-index")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows sorted by bundle and frame: each frame is read once, and its records at their offsets."""
    whole = zstandard.ZstdDecompressor()
    at, table, file, data = (None, None), [], None, b""
    number = lambda x: None if x is None else int(x)
    for b in batches:
        rows = []
        for x in b.to_pylist():
            if x["bundle"] != at[0]:
                if file is not None:
                    file.close()
                fs, path = pafs.FileSystem.from_uri(x["bundle"])
                file = fs.open_input_file(path)
                table = read_seek_table(file)
            if (x["bundle"], x["frame"]) != at:
                begin, small, large = table[x["frame"]]
                data, at = whole.decompress(file.read_at(small, begin), max_output_size=large), (x["bundle"], x["frame"])
            head, body, _ = parse(data, x["offset_in_frame"])
            is_revisit, page = head["WARC-Type"] == "revisit", number(head.get("X-Page-ID"))
            if page != x["page_id"]:
                raise ValueError(f"the index names page {x['page_id']} where page {page} is")
            digest = head["WARC-Payload-Digest"].removeprefix("sha1:") if is_revisit else base64.b32encode(hashlib.sha1(body).digest()).decode()
            size = int(head["X-Payload-Length"]) if is_revisit else len(body)
            rows.append((page, head.get("WARC-Target-URI"), None if is_revisit else body.decode(), size, digest, head["WARC-Type"], number(head.get("X-Refers-To-Page-ID"))))
        if rows:
            types = pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    if file is not None:
        file.close()


def read_archives(index: DataFrame) -> DataFrame:
    """Every record that the index names, by bundle, frame and offset: page_id, url, html (null for a revisit), payload_bytes, payload_digest, record_type, refers_to.

    Digests and lengths of responses are taken from the payloads that were read.
    """
    n, place = partitions(index.sparkSession), ("bundle", "frame", "offset_in_frame")
    dealt = index.select("page_id", *place).repartition(n, "bundle", "frame").sortWithinPartitions(*place)
    return dealt.mapInArrow(_reader, "page_id bigint, url string, html string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def fetch(bundle: str, frame: int, offset_in_frame: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: reads the seek table and one frame."""
    fs, path = pafs.FileSystem.from_uri(bundle)
    with fs.open_input_file(path) as f:
        at, small, large = read_seek_table(f)[frame]
        data = zstandard.ZstdDecompressor().decompress(f.read_at(small, at), max_output_size=large)
    return parse(data, offset_in_frame)[:2]
