"""Bounded-space online packing of tokenized documents into windows.

A document's ids are cut at every full window; those pieces are windows of
their own. The rest of the document (shorter than a window) goes to the
fullest open window that it still fits (best fit). A task keeps at most
``open_windows`` windows open. When none fits, the fullest is emitted: if its
gap is at most ``max_gap`` it is padded, else the front of the piece fills the
gap and the remainder is placed anew. So a window emitted online is padded by
``max_gap`` at most, and memory is ``open_windows`` windows however long the
input is.

Windows still open at the end of a task are leftovers. They are written with
their ids, and merged in groups of MERGE_FAN tasks: each group's leftovers go through
the same packing, fullest first, and only its last windows are padded.

A sequence whose length is a power of two is not padded (``padded`` says to
which length the others are).

Nulls: null text counts as empty; its ids are the end id alone. A null
``doc_id`` is carried as null. Repeated ``doc_id``: every row is packed on its
own. Very long texts: cut into full windows, never held beyond one document.
Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, word_tokenizer, written

WINDOW = 2048
OPEN_WINDOWS = 128
MAX_GAP = 16
#: Tasks whose leftovers are merged together.
MERGE_FAN = 8
_MERGED = 1 << 62

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "padded long, ids binary, task long")


class Windows:
    """Open windows of one task, ordered by fill."""

    def __init__(self, window: int, room: int, max_gap: int):
        self.window, self.room, self.max_gap = window, room, max_gap
        self.fill: list[tuple[int, int]] = []  # (tokens, window), sorted
        self.content: dict[int, list] = {}
        self.made = 0

    def _open(self) -> int:
        self.made += 1
        self.content[self.made] = []
        return self.made

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> Iterator[list]:
        """Place one piece; yields the windows that this closes."""
        while True:
            n = len(ids)
            at = bisect_left(self.fill, (self.window - n + 1, 0)) - 1  # the fullest that has room
            if at >= 0:
                used, w = self.fill.pop(at)
            elif len(self.fill) < self.room:
                used, w = 0, self._open()
            else:
                used, w = self.fill.pop()
                gap = self.window - used
                if gap > self.max_gap:
                    self.content[w].append((doc, start, ids[:gap], total, used))
                    ids, start = ids[gap:], start + gap
                yield self.content.pop(w)
                continue
            self.content[w].append((doc, start, ids, total, used))
            if used + n >= self.window:
                yield self.content.pop(w)
            else:
                insort(self.fill, (used + n, w))
            return

    def rest(self) -> Iterator[list]:
        while self.fill:
            yield self.content.pop(self.fill.pop()[1])


def padded_length(n: int, window: int) -> int:
    return n if n & (n - 1) == 0 else window


class _Rows:
    """Columns of finished pieces."""

    def __init__(self, task: int, window: int, base: int, with_ids: bool):
        self.task, self.window, self.next, self.with_ids = task, window, base, with_ids
        self.rows: list[tuple] = []

    def put(self, pieces: list, leftover: bool = False) -> None:
        last = pieces[-1]
        padded = padded_length(last[4] + len(last[2]), self.window)
        for doc, start, ids, total, offset in pieces:
            raw = ids.tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset,
                              padded, raw if leftover or self.with_ids else None, self.task if leftover else None))
        self.next += 1

    def batch(self):
        import pyarrow as pa

        names = [c.split()[0] for c in PIECES.split(", ")]
        cols = list(zip(*self.rows, strict=True)) or [[]] * len(names)
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64())
                                          for n, c in zip(names, cols, strict=True)], names)
        self.rows = []
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, open_windows: int = OPEN_WINDOWS,
         max_gap: int = MAX_GAP, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, padded (length of its sequence after padding) and, if
    asked for, the piece's ids (unsigned 16-bit)."""

    def online(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        tk, end = word_tokenizer(tokenizer), np.uint16(end_id).tobytes()
        task = TaskContext.get().partitionId()
        rows, space = _Rows(task, window, task << 32, with_ids), Windows(window, open_windows, max_gap)
        for batch in batches_of(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(tk.encode(text) + end, np.uint16)
                whole = len(ids) // window * window
                for s in range(0, whole, window):
                    rows.put([(doc, s, ids[s:s + window], len(ids), 0)])
                if whole < len(ids):
                    for done in space.add(doc, whole, ids[whole:].copy(), len(ids)):
                        rows.put(done)
            yield rows.batch()
        for w in space.rest():
            rows.put(w, leftover=True)
        yield rows.batch()

    def merge(key, table):
        import pyarrow as pa

        group = key[0].as_py()
        rows, space = _Rows(0, window, _MERGED | group << 32, with_ids), Windows(window, open_windows, 0)
        table = table.sort_by([("fill", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        for doc, start, total, ids in zip(*(table[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")),
                                          strict=True):
            for done in space.add(doc, start, np.frombuffer(ids, np.uint16), total):
                rows.put(done)
        # what is open now: one run of ids, cut at every full window
        held, used = [], 0
        for w in space.rest():
            for doc, start, ids, total, _ in w:
                while len(ids):
                    take = min(len(ids), window - used)
                    held.append((doc, start, ids[:take], total, used))
                    ids, start, used = ids[take:], start + take, used + take
                    if used == window:
                        rows.put(held)
                        held, used = [], 0
        if held:
            rows.put(held)
        return pa.Table.from_batches([rows.batch()])

    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded"] + \
        ["ids"] * with_ids
    first = written(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                F.col(text_col).cast("string").alias("text")).mapInArrow(online, PIECES), "pieces")
    left = first.where("task is not null")
    fill = left.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    left = left.join(fill, "sequence_id").withColumn("group", F.expr(f"task div {MERGE_FAN}"))
    merged = left.select("group", "doc_id", "start", "doc_tokens", "sequence_id", "offset", "fill", "ids") \
        .groupBy("group").applyInArrow(merge, PIECES)
    return first.where("task is null").select(*out).unionByName(merged.select(*out))
