"""Telemetry files as a data source: the elements of a JSON array are streamed, gzipped or plain, so a file needs no room in memory.

A file is a row of bytes to no task: its elements are decoded one after the other, and those of other kinds than a query asks for
are passed over while reading. Files are opened by pyarrow's file systems, so a path may be local or a URI that these know.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Bytes read from a file at once, rows and characters of a batch, and bytes of files that a task reads.
CHUNK, ROWS, CHARS, PER_TASK = 1 << 20, 2000, 1 << 22, 128 << 20
SCHEMA = "match_id string, idx bigint, kind string, ev string, error string"

NOT_JSON, NOT_A_LIST = "not JSON", "not a list"


class Bad(Exception):
    """A file that is no list of events; the argument is the reason."""


def elements(chunks: Iterator[str]) -> Iterator[tuple[object, str]]:
    """The elements of a JSON array and their text, holding little more than the longest of them."""
    decode, blank = json.JSONDecoder().raw_decode, " \t\r\n"
    text, at, ended = "", 0, False

    def more(least: int = 1) -> bool:
        nonlocal text, at, ended
        parts, got = [text[at:]], 0
        while got < least and not ended:
            chunk = next(chunks, None)
            ended = chunk is None
            parts.append(chunk or "")
            got += len(chunk or "")
        text, at = "".join(parts), 0
        return got > 0

    def peek() -> str:
        """The next character that isn't blank, or nothing at the end."""
        nonlocal at
        while True:
            while at < len(text) and text[at] in blank:
                at += 1
            if at < len(text):
                return text[at]
            if not more():
                return ""

    if peek() != "[":
        rest = text[at:] + "".join(chunks)
        try:
            json.loads(rest)
        except ValueError:
            raise Bad(NOT_JSON) from None
        raise Bad(NOT_A_LIST)
    at += 1
    first = True
    while (c := peek()) != "]" or not first:
        if not first:
            if c == "]":
                break
            if c != ",":
                raise Bad(NOT_JSON)
            at += 1
            peek()
        first = False
        while True:
            try:
                value, end = decode(text, at)
                size = end - at
                # a number may go on in what isn't read yet
                if end < len(text) and text[end] in blank + ",]" or not more():
                    break
            except ValueError:
                # twice as much each time, so that a long element isn't decoded over and over
                if not more(max(CHUNK, len(text) - at)):
                    raise Bad(NOT_JSON) from None
        yield value, text[at : at + size]
        at += size
    at += 1
    if peek():
        raise Bad(NOT_JSON)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def _characters(path: str) -> Iterator[str]:
    system, name = _opened(path)
    decoder = codecs.getincrementaldecoder("utf-8")()
    with system.open_input_stream(name, compression="gzip" if name.endswith(".gz") else None) as stream:
        try:
            while raw := stream.read(CHUNK):
                yield decoder.decode(raw)
            yield decoder.decode(b"", True)
        except (UnicodeDecodeError, OSError):
            raise Bad(NOT_JSON) from None


def _match_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".", 1)[0]


class TelemetryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.strict = options.get("strict", "true").lower() == "true"
        self.kinds: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("kind",):
                self.kinds = wanted if self.kinds is None else self.kinds & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files = []
        for path in self.paths:
            system, name = _opened(path)
            info = system.get_file_info(name)
            found = [info] if info.is_file else system.get_file_info(fs.FileSelector(name, recursive=True))
            prefix = path[: len(path) - len(name)] if path.endswith(name) and "://" in path else ""
            files += [(prefix + x.path, x.size) for x in found if x.is_file and not x.base_name.startswith((".", "_"))]
        parts, size = [], PER_TASK
        for path, n in sorted(files):
            if size + n > PER_TASK:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += n
        return [InputPartition(p) for p in parts]

    def _of_file(self, path: str) -> Iterator[tuple[int | None, str | None, str | None, str | None]]:
        if self.strict:
            # a file that breaks off gives no events at all, so it is gone through before any is given out
            try:
                for _ in elements(_characters(path)):
                    pass
            except Bad as e:
                yield None, None, None, str(e)
                return
        try:
            for i, (value, text) in enumerate(elements(_characters(path))):
                kind = value.get("_T") if isinstance(value, dict) else None
                kind = kind.lower() if isinstance(kind, str) else None
                if self.kinds is None or kind in self.kinds:
                    yield i, kind, text, None
        except Bad as e:
            yield None, None, None, str(e)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        types = pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        rows, chars = [], 0
        for path in partition.value:
            for row in self._of_file(path):
                if row[3] is not None and self.kinds is not None:
                    continue
                rows.append((_match_of(path), *row))
                chars += len(row[2] or "")
                if len(rows) == ROWS or chars >= CHARS:
                    yield batch(rows)
                    rows, chars = [], 0
        if rows:
            yield batch(rows)


class TelemetrySource(DataSource):
    """Options: path (a file or folder) or paths (a JSON list of them); strict (true: a file that breaks off gives only its error)."""

    @classmethod
    def name(cls) -> str:
        return "match_telemetry"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TelemetryReader:
        return TelemetryReader(self.options)


def stream_telemetry(spark: SparkSession, *paths: str, strict: bool = True) -> DataFrame:
    """match_id, idx (place in the file), kind (lower case), ev (the event as JSON) and error, of files or folders; a file that is no list has one row with its error."""
    spark.dataSource.register(TelemetrySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("match_telemetry").option("paths", json.dumps(paths)).option("strict", str(strict).lower()).load()


def failed_files(rows: DataFrame) -> DataFrame:
    """match_id and reason of the files that hold no list of events."""
    return rows.where("error is not null").select("match_id", F.col("error").alias("reason"))
