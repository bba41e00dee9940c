"""Packing of token sequences by bounded-space online best-fit.

Every partition keeps a fixed number of open windows. A document's full windows are
emitted at once; what is left of it goes to the open window with the least room that
still takes it. When none does and no more may be opened, the fullest is emitted:
padded if it lacks ``slack`` tokens or fewer, else filled up with the head of the
piece, whose rest starts a new window.

The windows that are open at the end of a partition are merged: their pieces are
dealt to as many tasks as have about ``MERGED`` windows' tokens each and packed once
more; what is open then is joined end to end, and the last tokens of a task are cut
at powers of two, which need no padding.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.byte_bpe import loaded
from lathe.llm.common import saved

#: Tokens of a window, open windows of a partition, and tokens that may be padded for the sake of an uncut piece.
WINDOW, OPEN, SLACK = 1024, 64, 8
#: Id that ends each document.
END_ID = 0
#: Windows' worth of open tokens that one merging task takes.
MERGED = 4096
#: Sequences of one batch that a task hands over.
BATCH = 512

PIECE = "doc_id bigint, start bigint, length bigint, offset bigint, doc_tokens bigint"
SEQUENCES = f"sequence_id bigint, ids array<int>, pieces array<struct<{PIECE.replace(' bigint', ':bigint')}>>, is_open boolean"


class Piece:
    """``length`` ids of a document from ``start`` on."""

    __slots__ = ("doc_id", "doc_tokens", "ids", "start")

    def __init__(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:at], self.doc_tokens), Piece(self.doc_id, self.start + at, self.ids[at:], self.doc_tokens)


class OpenWindows:
    """A bounded number of windows; ``place`` and ``join`` return the windows (lists of pieces) that are finished."""

    def __init__(self, window: int = WINDOW, most: int = OPEN, slack: int = SLACK):
        self.window, self.most, self.slack = window, most, slack
        self.room: list[tuple[int, int]] = []  # sorted (room, number) of the open windows
        self.held: dict[int, list[Piece]] = {}
        self.number = 0

    def place(self, piece: Piece) -> list[list[Piece]]:
        done = []
        while len(piece.ids) >= self.window:
            head, piece = piece.cut(self.window)
            done.append([head])
        if not len(piece.ids):
            return done
        at = bisect_left(self.room, (len(piece.ids), -1))
        if at < len(self.room):  # best fit
            room, number = self.room.pop(at)
            self.held[number].append(piece)
            return done + self._keep(room - len(piece.ids), number)
        if len(self.room) == self.most:
            room, number = self.room.pop(0)
            full = self.held.pop(number)
            if room > self.slack:
                head, piece = piece.cut(room)
                full.append(head)
            done.append(full)
        self.number += 1
        self.held[self.number] = [piece]
        return done + self._keep(self.window - len(piece.ids), self.number)

    def _keep(self, room: int, number: int) -> list[list[Piece]]:
        if not room:
            return [self.held.pop(number)]
        insort(self.room, (room, number))
        return []

    def rest(self) -> list[list[Piece]]:
        """The open windows, fullest first."""
        return [self.held[number] for _, number in self.room]

    def join(self) -> list[list[Piece]]:
        """The open windows' pieces end to end in full windows; the last tokens in windows of powers of two."""
        todo = [piece for pieces in self.rest() for piece in pieces][::-1]
        left, done = sum(len(p.ids) for p in todo), []
        while left:
            room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            left, now = left - room, []
            while room:
                piece = todo.pop()
                if len(piece.ids) > room:
                    piece, after = piece.cut(room)
                    todo.append(after)
                now.append(piece)
                room -= len(piece.ids)
            done.append(now)
        return done


def _batches(windows: Iterator[tuple[list[Piece], bool]], step: int) -> Iterator[pa.RecordBatch]:
    """Windows as rows of SEQUENCES; their ids are unique by step, partition and number."""
    base, held = (step << 60) + (TaskContext.get().partitionId() << 30), []

    def batch() -> pa.RecordBatch:
        nonlocal base
        offsets = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        pieces = [p for window, _ in held for p in window]
        sizes = np.array([len(p.ids) for p in pieces], np.int64)
        counts = np.array([len(window) for window, _ in held])
        ends = np.concatenate(([0], np.cumsum(sizes)))
        first = np.concatenate(([0], np.cumsum(counts)))
        columns = [[p.doc_id for p in pieces], [p.start for p in pieces], sizes, ends[:-1] - np.repeat(ends[first[:-1]], counts), [p.doc_tokens for p in pieces]]
        names = [x.split()[0] for x in PIECE.split(", ")]
        ids = np.concatenate([p.ids for p in pieces]).astype(np.int32)
        arrays = [
            pa.array(base + np.arange(len(held))),
            pa.ListArray.from_arrays(pa.array(ends[first], pa.int32()), pa.array(ids)),
            pa.ListArray.from_arrays(offsets(counts), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)),
            pa.array([is_open for _, is_open in held], pa.bool_()),
        ]
        base += len(held)
        held.clear()
        return pa.RecordBatch.from_arrays(arrays, ["sequence_id", "ids", "pieces", "is_open"])

    for window in windows:
        held.append(window)
        if len(held) == BATCH:
            yield batch()
    if held:
        yield batch()


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, most: int = OPEN, slack: int = SLACK, merged: int = MERGED) -> DataFrame:
    """Sequences of at most ``window`` tokens (a power of two) that hold every token of every row of ``docs`` once.

    sequence_id; ids, the tokens without padding; pieces (doc_id, start, length,
    offset, doc_tokens) in order, ``start`` counting the document's tokens before the
    piece and ``offset`` the sequence's; padded_length, which is ``window`` unless the
    number of tokens is a power of two.

    A document is its text's ids and ``END_ID``; null and empty texts are that id
    alone. Rows that repeat a doc_id, or have none, are separate documents. Only
    doc_id and text are read. An empty table gives no sequences. ``tokenizer`` is the
    path of a vocabulary file that all executors have. A document is held by one task;
    the rest of a task's memory is ``most`` windows and one batch.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def windows():
            encode, held = loaded(tokenizer).encode, OpenWindows(window, most, slack)
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                    ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID))
                    for done in held.place(Piece(doc_id.as_py(), 0, ids, len(ids))):
                        yield done, False
            for left in held.rest():
                yield left, True

        return _batches(windows(), 0)

    packed = saved(rows.mapInArrow(first, SEQUENCES), "packed")
    left = packed.where("is_open")
    tokens = left.agg(F.sum(F.size("ids"))).first()[0] or 0
    tasks = -(-tokens // (merged * window)) or 1

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def windows():
            held = OpenWindows(window, most, slack)
            for batch in batches:
                for ids, pieces in zip(batch.column("ids"), batch.column("pieces")):
                    ids = ids.values.to_numpy().astype(np.uint32)
                    for p in pieces.as_py():
                        piece = Piece(p["doc_id"], p["start"], ids[p["offset"] : p["offset"] + p["length"]], p["doc_tokens"])
                        for done in held.place(piece):
                            yield done, False
            for done in held.join():
                yield done, False

        return _batches(windows(), 1)

    dealt = left.repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id").select("ids", "pieces")
    again = saved(dealt.mapInArrow(second, SEQUENCES), "packed-rest")
    used = F.size("ids")
    padded = F.when(used.bitwiseAND(used - 1) == 0, used).otherwise(window)
    return packed.where("not is_open").unionByName(again).select("sequence_id", "ids", "pieces", padded.alias("padded_length"))


def packed_pieces(sequences: DataFrame) -> DataFrame:
    """A row for each piece, with the CRC-32 of its ids as little-endian unsigned 32-bit numbers."""
    from zlib import crc32

    kind = "sequence_id bigint, doc_id bigint, start bigint, length bigint, offset bigint, doc_tokens bigint, ids_crc32 bigint"

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, pieces = batch.column("ids"), batch.column("pieces")
            packed = lists.values.to_numpy().astype("<u4")
            each = pieces.flatten()
            counts = np.diff(pieces.offsets.to_numpy())
            columns = {name: each.field(name) for name in ("doc_id", "start", "length", "offset", "doc_tokens")}
            at = np.repeat(lists.offsets.to_numpy()[:-1], counts) + columns["offset"].to_numpy()
            ends = at + columns["length"].to_numpy()
            crc = pa.array([crc32(packed[i:j]) for i, j in zip(at.tolist(), ends.tolist())], pa.int64())
            sequence = pa.array(np.repeat(batch.column("sequence_id").to_numpy(), counts), pa.int64())
            yield pa.RecordBatch.from_arrays([sequence, *columns.values(), crc], ["sequence_id", *columns, "ids_crc32"])

    return sequences.select("sequence_id", "ids", "pieces").mapInArrow(digests, kind)
