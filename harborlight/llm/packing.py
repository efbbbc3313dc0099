"""Sum-of-squares packing of documents into fixed-length training sequences.

Each document's ids (with the end id) are cut into full windows and one remainder. A remainder goes into the fill
level that makes the sum of squared counts of partly filled windows least; the counts are kept in an array by
level. Every input partition packs on its own, so the work needs no shuffle, and a task that runs again gives the same
sequences. Windows still open at the end (or when more than OPEN_WINDOWS are open) are closed by cutting: their pieces
are laid end to end into full windows, and what is left is cut into sequences whose lengths are powers of two.

Defined cases: a null or empty text is a document of the end id alone; repeated rows and doc_ids are packed as rows of
their own; a null doc_id stays null; a very long text is encoded in one task and cut over as many windows as it fills; other columns,
whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import tokens
from .common import limit_batches, read

LENGTH = 2048
END_ID = 1
#: Most windows left open in a task before they are closed by cutting: bounds what a task holds (32 MB of ids).
OPEN_WINDOWS = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Packs ids into windows of one partition; pieces() gives finished pieces.

    A piece held back is (doc_id, start, ids as bytes of 4 each, tokens of the document).
    """

    def __init__(self, first_sequence: int, length: int = LENGTH, open_windows: int = OPEN_WINDOWS):
        self._next, self._length, self._most = first_sequence, length, open_windows
        self._count = np.zeros(length + 1, dtype=np.int64)
        self._windows: dict[int, list[list]] = {}
        self._open = 0
        self._rows: list[tuple] = []

    def _emit(self, pieces) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self._rows.append((doc, start, n, zlib.crc32(ids), total, self._next, offset))
            offset += n
        self._next += 1

    def best_level(self, size: int) -> int:
        """The level (0: a new window) whose filling by size makes the sum of squares least; ties: the fullest."""
        length, count = self._length, self._count
        change = 2 * count[size:] + 1  # what the level reached adds
        change[-1] = 0  # a full window is no longer counted
        left = 2 * count[: length + 1 - size] - 1  # what leaving the level takes away
        left[0] = 0
        change -= left
        change[1:][count[1 : length + 1 - size] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def add(self, doc, ids: bytes) -> None:
        total, full = len(ids) // 4, self._length * 4
        whole = len(ids) - len(ids) % full
        for a in range(0, whole, full):
            self._emit([(doc, a // 4, ids[a : a + full], total)])
        if whole == len(ids):
            return
        piece = (doc, whole // 4, ids[whole:], total)
        size = total - whole // 4
        level = self.best_level(size)
        if level:
            window = self._windows[level].pop()
            self._count[level] -= 1
            window.append(piece)
        else:
            window = [piece]
            self._open += 1
        if level + size == self._length:
            self._open -= 1
            self._emit(window)
        else:
            self._windows.setdefault(level + size, []).append(window)
            self._count[level + size] += 1
            if self._open > self._most:
                self.close()

    def close(self) -> None:
        """Lay the open windows' pieces end to end; cut at full windows, then at powers of two."""
        held = [p for level in sorted(self._windows, reverse=True) for window in self._windows[level] for p in window]
        self._windows.clear()
        self._count[:] = 0
        self._open = 0
        left = sum(len(p[2]) // 4 for p in held)
        room = self._next_size(left)
        sequence: list[tuple] = []
        for doc, start, ids, total in held:
            at = 0
            while at < len(ids) // 4:
                take = min(room, len(ids) // 4 - at)
                sequence.append((doc, start + at, ids[4 * at : 4 * (at + take)], total))
                at, room, left = at + take, room - take, left - take
                if not room:
                    self._emit(sequence)
                    sequence, room = [], self._next_size(left)

    def _next_size(self, left: int) -> int:
        return self._length if left >= self._length else 1 << (left.bit_length() - 1) if left else 0

    def pieces(self) -> list[tuple]:
        rows, self._rows = self._rows, []
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of a document: its place in the document and in a sequence (columns: PIECES)."""
    limit_batches(docs.sparkSession)
    path = vocabulary or tokens.vocabulary()
    end = end_id.to_bytes(4, "little")

    def run(batches):
        model = tokens.encoder(path)
        packer = Packer(TaskContext.get().partitionId() << 40, length)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, texts in tokens.text_slices(batch):
                for doc, encoded in zip(ids[a:b], model.encode(texts)):
                    packer.add(doc, encoded + end)
                yield _batch(packer.pieces())
        packer.close()
        yield _batch(packer.pieces())

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
