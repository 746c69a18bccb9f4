"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation of a text under the model's piece scores is found from left to
right. Only the positions of the last max_piece characters can still be extended, so
the search keeps those and their back pointers, and commits ids when all of them lead
back to one boundary: whenever the window is full, the back pointers are followed. The
window grows only while paths that never meet again disagree. Which pieces end at a
character comes from an Aho-Corasick automaton that runs along the text.

Before a run of word marks and around a line break (for models whose pieces don't
contain those inside) the paths always meet. What lies between two such boundaries is
searched once, whatever its length, and its committed ids are remembered; the memo is
bound by bytes. All ids come from the one search.

A character without a piece becomes its UTF-8 bytes by the model's byte pieces. The
models' files are read from the path that is given, never copied or trained.

The search finds the highest sum of scores, which is what a unigram model asks for.
The scores of a merge-based model's file are ranks instead of log probabilities; by
Zipf's law the log probability of the piece of rank r is taken as -log(r + 2). Its
ids are then the most probable segmentation and mostly, not always, that of the
merges; decoding gives the same text either way.

Nulls and ties: of equal scores the one with the longest last piece wins; a null text
has null ids and an empty text none; null ids decode to null; rows are independent, so
repeated rows and null document ids are coded like any others; an empty table gives no
rows; a text of any length is searched whole in the window; other columns pass in _row
and can't clash. Decoding gives the text back exactly, except that a word mark (U+2581)
in a text becomes a blank.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm._common import packed

MARK = "▁"
#: Bytes of each of the memo's two generations in a worker, and those that an entry takes besides its characters and ids.
MEMO_BYTES, ENTRY_BYTES = 64 << 20, 200
#: Points that a character without a piece scores below the worst piece.
UNKNOWN = 10.0


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pieces(path: str) -> dict[str, Any]:
    """A model's file as plain lists: scores (piece, score, id), the bytes of each id, and the ids of the 256 bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    scores, bytes_of, byte_ids = [], [b""] * size, [0] * 256
    for i in range(size):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            bytes_of[i] = bytes([int(piece[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            scores.append((piece, sp.get_score(i), i))
            bytes_of[i] = piece.replace(MARK, " ").encode()
    return {"scores": scores, "bytes_of": bytes_of, "byte_ids": byte_ids}


class Codec:
    def __init__(self, model: str | dict[str, Any], memo_bytes: int = MEMO_BYTES, zipf: bool | None = None):
        """model: a file's path or its pieces; zipf: take scores as ranks; by default if all of them are whole numbers from 0 down."""
        model = pieces(model) if isinstance(model, str) else model
        self.scores = {p: (score, i) for p, score, i in model["scores"]}
        self.bytes_of, self.byte_ids = model["bytes_of"], model["byte_ids"]
        if zipf or zipf is None and all(x <= 0 and x == int(x) for x, _ in self.scores.values()):
            self.scores = {p: (-math.log(2 - x), i) for p, (x, i) in self.scores.items()}
        self.longest = max(map(len, self.scores))
        self.worst = min(s for s, _ in self.scores.values()) - UNKNOWN
        #: Finds all pieces that end at a character, the longest first, as (length, score, id).
        self.ends = ahocorasick.Automaton()
        for piece, (score, i) in self.scores.items():
            self.ends.add_word(piece, (len(piece), score, i))
        self.ends.make_automaton()
        self.alone = {p for p in self.scores if len(p) == 1}
        inner = any(MARK in p.lstrip(MARK) for p in self.scores)
        broken = any("\n" in p for p in self.scores)
        lines = f"{MARK}+[^{MARK}]*|[^{MARK}]+" if broken else f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+"
        #: Cuts a text where the paths always meet.
        self.between = re.compile(r"(?s).+" if inner else lines).findall
        self.young, self.old, self.held, self.room = {}, {}, 0, memo_bytes

    def _matches(self, s: str) -> Iterator[tuple[int, tuple[int, float, int | None]]]:
        """The pieces of s by their last character; one that is no piece by itself follows what ends there, without an id."""
        if self.alone.issuperset(s):
            return self.ends.iter(s)
        return self._with_unknown(s)

    def _with_unknown(self, s: str) -> Iterator[tuple[int, tuple[int, float, int | None]]]:
        unknown = 1, self.worst, None
        lone, found = iter([i for i, c in enumerate(s) if c not in self.alone]), self.ends.iter(s)
        at = next(lone)
        for match in found:
            while at is not None and at < match[0]:
                yield at, unknown
                at = next(lone, None)
            yield match
        while at is not None:
            yield at, unknown
            at = next(lone, None)

    def search(self, s: str) -> Iterator[list[int]]:
        """Streams the ids of the best segmentation of s, boundary by boundary.

        best has the score of each boundary from the last committed one on; sizes and made have the length and id of the
        best piece into each boundary after that. Every character is the end of some match, so a new end closes the one before.
        """
        best, sizes, made, width = [0.0], [], [], self.longest
        base = last = 0
        full, none = 2 * width, -math.inf
        top, size, piece = none, 0, None
        for end, (length, score, i) in self._matches(s):
            if end != last:
                best.append(top)
                sizes.append(size)
                made.append(piece)
                top, last = none, end
                if len(sizes) == full:
                    meet = self._meeting(sizes, width)
                    if meet:
                        yield self._ids(s, base, sizes, made, meet)
                        del best[:meet], sizes[:meet], made[:meet]
                        base += meet
                    full = max(2 * width, len(sizes) + width)
            total = best[-length] + score
            if total > top:
                top, size, piece = total, length, i
        if s:
            sizes.append(size)
            made.append(piece)
            yield self._ids(s, base, sizes, made, len(sizes))

    @staticmethod
    def _meeting(sizes: list[int], width: int) -> int:
        """The boundary that all paths which can still be extended lead back to."""
        at = len(sizes)
        live = set(range(max(0, at - width + 1), at + 1))
        while len(live) > 1:
            if at in live:
                live.discard(at)
                live.add(at - sizes[at - 1])
            at -= 1
        return live.pop()

    def _ids(self, s: str, base: int, sizes: list[int], made: list, end: int) -> list[int]:
        """The ids of the path from base to end."""
        out = []
        while end:
            piece = made[end - 1]
            if piece is None:
                out += [self.byte_ids[x] for x in reversed(s[base + end - 1].encode())]
            else:
                out.append(piece)
            end -= sizes[end - 1]
        out.reverse()
        return out

    def _committed(self, s: str) -> bytes:
        """The ids between two boundaries, from the memo or searched."""
        ids = self.old.get(s)
        if ids is None:
            ids = array("i", [x for part in self.search(s) for x in part]).tobytes()
        takes = ENTRY_BYTES + len(s) + len(ids)
        if self.held + takes > self.room:
            self.old, self.young, self.held = self.young, {}, 0
        if takes <= self.room:
            self.young[s] = ids
            self.held += takes
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as native 32-bit integers."""
        if not text:
            return b""
        parts = self.between(MARK + text.replace(" ", MARK))
        out = list(map(self.young.get, parts))
        if None in out:
            for i, part in enumerate(parts):
                if out[i] is None:
                    ids = self.young.get(part)
                    out[i] = self._committed(part) if ids is None else ids
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def _lists(made: list[bytes | None]) -> pa.ListArray:
    at = [0]
    for x in made:
        at.append(at[-1] + len(x or b"") // 4)
    offsets = pa.array([None if x is None else i for x, i in zip([*made, b""], at)], pa.int32())
    values = pa.Array.from_buffers(pa.int32(), at[-1], [None, pa.py_buffer(b"".join(x or b"" for x in made))])
    return pa.ListArray.from_arrays(offsets, values)


#: Texts that a worker turns into Python strings at a time.
TEXTS = 500


def _codec(shared) -> Codec:
    """The worker's codec, made from the broadcast pieces by its first task and kept beside them for the next."""
    held = shared.value
    if "codec" not in held:
        held["codec"] = Codec(held, held["memo_bytes"])
    return held["codec"]


def _encoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            made = [None if t is None else codec.encode(t) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_row"), _lists(made)], ["_row", "ids"])

    return run


def _decoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = shared.value["bytes_of"]
        for b in batches:
            ids = b.column("ids")
            values, at, known = ids.values.to_numpy(), ids.offsets.to_numpy(), ids.is_valid().to_pylist()
            one = lambda x, y: b"".join(map(bytes_of.__getitem__, values[x:y].tolist())).decode("utf-8", "replace").removeprefix(" ")
            decoded = [one(x, y) if ok else None for x, y, ok in zip(at[:-1], at[1:], known)]
            yield pa.RecordBatch.from_arrays([b.column("_row"), ids, pa.array(decoded, pa.string())], ["_row", "ids", "decoded"])

    return run


def _both(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for whole in batches:
            for i in range(0, whole.num_rows, TEXTS):
                b = whole.slice(i, TEXTS)
                made, digests, same = [], [], []
                for text in b.column("_text").to_pylist():
                    ids = None if text is None else codec.encode(text)
                    decoded = None if ids is None else codec.decode(memoryview(ids).cast("i"))
                    made.append(ids)
                    digests.append(None if ids is None else hashlib.sha256(decoded.encode()).hexdigest())
                    same.append(decoded == text)
                cols = [b.column("_row"), _lists(made), pa.array(digests, pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, ["_row", "ids", "decoded_sha256", "round_trip"])

    return run


def _shared(docs: DataFrame, path: str | None, memo_bytes: int = 0):
    """A model's pieces, a few MB that don't grow with the data. They are broadcast as plain lists: a broadcast object of a class would need this package on the executors."""
    return docs.sparkSession.sparkContext.broadcast(pieces(path or model_file()) | {"memo_bytes": memo_bytes})


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """_row (a struct of all columns) and ids (array of int) of every row."""
    rows = packed(docs, text_col).withColumnRenamed(f"_{text_col}", "_text")
    run = _encoder(_shared(docs, path, memo_bytes))
    return rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (_row, ids) with the decoded text added."""
    run = _decoder(_shared(encoded, path))
    return encoded.mapInArrow(run, f"_row {encoded.schema['_row'].dataType.simpleString()}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, carried: list[str], path: str | None = None, text_col: str = "text", memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Encodes and decodes in one pass: _row (a struct of the carried columns, the text if there are none), ids, decoded_sha256 and whether the decoded text is the text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried or [text_col]]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    run = _both(_shared(docs, path, memo_bytes))
    return rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, ids array<int>, decoded_sha256 string, round_trip boolean")


def digest(ids: Column) -> Column:
    """16 hex digits of an array of ids."""
    return F.when(ids.isNotNull(), F.lower(F.lpad(F.hex(F.xxhash64(ids)), 16, "0")))
