"""Bounded-space online packing of token ids into windows of one length.

Every partition keeps a fixed number of open windows.  A document, cut at the
window length, goes where it fits best; when none fits, the fullest window is
emitted, after its free space, if over `max_gap` ids, has been filled with the
head of the document (documents may be cut).  What is open at the end of a
partition is pushed together to one partly filled window; these leftovers are
merged over groups of partitions in the same way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.llm.storage import TEXT_BATCH, id_long, id_text, materialise
from auralake.llm.tokens import REMEMBERED, worker_tokenizer

#: Partitions whose leftovers are merged by one task.
MERGE_GROUP = 64
_PIECE = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Packer:
    """The open windows of one task; a piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, open_windows: int, max_gap: int, first_sequence: int):
        self.window, self.most, self.max_gap = window, open_windows, max_gap
        self.free: list[int] = []
        self.pieces: list[list[tuple]] = []
        self.sequence = first_sequence
        self.rows: list[tuple] = []

    def _emit(self, at: int) -> None:
        offset = 0
        for doc_id, start, ids, total in self.pieces[at]:
            crc = zlib.crc32(ids.astype("<u4", copy=False).tobytes())
            self.rows.append((doc_id, start, len(ids), crc, total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1
        del self.free[at], self.pieces[at]

    def _put(self, at: int, piece: tuple) -> None:
        self.free[at] -= len(piece[2])
        self.pieces[at].append(piece)
        if not self.free[at]:
            self._emit(at)

    def add(self, doc_id: str | None, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) > self.window:
            self._open((doc_id, start, ids[: self.window], total))
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            fitting = [f for f in self.free if f >= len(ids)]
            if fitting:
                return self._put(self.free.index(min(fitting)), (doc_id, start, ids, total))
            if len(self.free) < self.most:
                return self._open((doc_id, start, ids, total))
            fullest = self.free.index(min(self.free))
            gap = self.free[fullest]
            if gap > self.max_gap:
                self._put(fullest, (doc_id, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            else:
                self._emit(fullest)

    def _open(self, piece: tuple) -> None:
        self.free.append(self.window)
        self.pieces.append([])
        self._put(len(self.free) - 1, piece)

    def leftovers(self) -> list[tuple]:
        """Push the open windows together: full ones are emitted, the pieces of the last are returned."""
        rest = [p for at in sorted(range(len(self.free)), key=self.free.__getitem__) for p in self.pieces[at]]
        self.free, self.pieces, self.most, self.max_gap = [], [], 1, 0
        for piece in rest:
            self.add(*piece)
        last = self.pieces[0] if self.pieces else []
        self.free, self.pieces = [], []
        return last

    def taken(self) -> pd.DataFrame:
        names = [c.split()[0] for c in _PIECE.split(", ")]
        out = pd.DataFrame(self.rows, columns=names)
        self.rows = []
        return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 4096,
    open_windows: int = 64,
    max_gap: int = 32,
    end_id: int = 2,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """Pieces of all documents with their place: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Each id of a document, its end id included, lies in exactly one piece; the
    pieces of a sequence fill it from offset 0 without gaps and add up to at most
    `window`.  A null or empty text has the end id alone; rows that repeat an id
    are packed each by itself, a null id stays null.  An empty table gives no
    rows; other columns are ignored.  Sequence ids are unique, not consecutive.
    A task holds at most open_windows * window ids besides its batch, and a worker
    about 300 bytes for each of `remembered` words; fewer make it slower, not other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        encoder = worker_tokenizer(tokenizer_path, end_id, remembered)
        packer = _Packer(window, open_windows, max_gap, task << 32)
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = encoder.encode(text)
                packer.add(doc_id, 0, ids, len(ids))
            yield packer.taken().assign(ids=None, task=task)
        last = packer.leftovers()
        yield packer.taken().assign(ids=None, task=task)
        yield pd.DataFrame(
            [(d, s, len(i), 0, t, None, None, i.astype("<u4").tobytes(), task) for d, s, i, t in last],
            columns=[*(c.split()[0] for c in _PIECE.split(", ")), "ids", "task"],
        )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        packer = _Packer(window, open_windows, max_gap, (1 << 55) + (int(pdf["group"].iat[0]) << 32))
        for r in pdf.sort_values(["task", "doc_id", "start"]).itertuples():
            packer.add(r.doc_id, int(r.start), np.frombuffer(r.ids, dtype="<u4"), int(r.doc_tokens))
        for doc_id, start, ids, total in packer.leftovers():
            packer.free, packer.pieces = packer.free or [window], packer.pieces or [[]]
            packer.pieces[0].append((doc_id, start, ids, total))
        if packer.pieces:
            packer._emit(0)
        return packer.taken()

    rows = docs.select(id_text(id_col), F.col(text_col).alias("text"))
    packed = materialise(rows.mapInPandas(run, f"{_PIECE}, ids binary, task int"), "packed", TEXT_BATCH)
    names = [c.split()[0] for c in _PIECE.split(", ")]
    done = packed.filter("sequence_id IS NOT NULL").select(*names)
    rest = packed.filter("sequence_id IS NULL").withColumn("group", (F.col("task") / MERGE_GROUP).cast("long"))
    return id_long(done.unionByName(rest.groupBy("group").applyInPandas(merge, _PIECE)))
