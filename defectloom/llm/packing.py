"""Packing documents into training windows by the sum-of-squares rule.

Every partition is packed on its own while its texts are encoded, so nothing is
shuffled. Full windows are cut off a document's front; what remains goes to
the fill level that makes the sum of squared counts of partly filled windows
smallest. Counts per level are one array, and windows of equal level are alike.

At the end of a partition the windows still open are closed from the fullest
down: the pieces of the emptiest ones are cut to fill them. The last one is
split into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectloom.llm import bpe

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Windows of ``size`` tokens, filled online.

    ``emit(pieces)`` gets each closed window's pieces, of the form
    (doc, start, ids, doc_tokens) with ``ids`` as bytes. Of levels that change
    the sum alike the lowest is taken. Where more than ``most`` windows are
    open, as when every document has just over half a window, half of them are
    closed as at the end, so memory holds ``most * size`` ids.
    """

    def __init__(self, size: int, emit: Callable[[list[tuple]], None], most: int = 4096):
        self.size, self.emit, self.most, self.n_open = size, emit, most, 0
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(size + 1)]

    def add(self, doc, ids: bytes, doc_tokens: int) -> None:
        width = 4 * self.size
        whole = len(ids) // width * width
        for at in range(0, whole, width):
            self.emit([(doc, at // 4, ids[at : at + width], doc_tokens)])
        if rest := ids[whole:]:
            self._place((doc, whole // 4, rest, doc_tokens))

    def _place(self, piece: tuple) -> None:
        size, n, count = self.size, len(piece[2]) // 4, self.count
        # the sum changes by 2 * (count[level + n] - count[level]) + 2; a new or a closed window has only one of the terms
        change = np.empty(size - n + 1)
        change[0] = count[n] + 0.5 if n < size else 0.0
        change[1 : size - n] = count[n + 1 : size] - count[1 : size - n] + 1
        change[size - n] = 0.5 - count[size - n] if n < size else 0.0
        if n < size:
            change[1:][count[1 : size - n + 1] == 0] = np.inf
        level = int(change.argmin())
        pieces = self.open[level].pop() if level else []
        if level:
            count[level] -= 1
            self.n_open -= 1
        pieces.append(piece)
        if level + n == size:
            self.emit(pieces)
            return
        self._keep(level + n, pieces)
        if self.n_open > self.most:
            for level, pieces in self._fill(self.most // 2):
                self._keep(level, pieces)

    def _keep(self, level: int, pieces: list[tuple]) -> None:
        self.count[level] += 1
        self.open[level].append(pieces)
        self.n_open += 1

    def _fill(self, keep: int) -> list[tuple[int, list[tuple]]]:
        """Fills and closes the fullest windows with pieces cut off the emptiest ones; the at most ``keep`` windows (level, pieces) that stay."""
        windows = [(level, pieces) for level in range(self.size - 1, 0, -1) for pieces in self.open[level]]
        self.open, self.n_open = [[] for _ in range(self.size + 1)], 0
        self.count[:] = 0
        loose: list[tuple] = []
        first, last = 0, len(windows) - 1
        while first <= last and last - first + 1 + bool(loose) > keep:
            level, pieces = windows[first]
            while level < self.size:
                if not loose:
                    if last == first:
                        break
                    loose = windows[last][1][::-1]
                    last -= 1
                doc, start, ids, total = loose.pop()
                take = min(4 * (self.size - level), len(ids))
                pieces.append((doc, start, ids[:take], total))
                level += take // 4
                if take < len(ids):
                    loose.append((doc, start + take // 4, ids[take:], total))
            if level < self.size:
                windows[first] = (level, pieces)
                break
            self.emit(pieces)
            first += 1
        left = windows[first : last + 1]
        return [*left, (sum(len(p[2]) // 4 for p in loose), loose[::-1])] if loose else left

    def close(self) -> None:
        """Closes all windows; the last one is split into powers of two."""
        rest = [piece for _, pieces in self._fill(1) for piece in pieces][::-1]
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            room, out = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc, start, ids, total = rest.pop()
                take = min(4 * room, len(ids))
                out.append((doc, start, ids[:take], total))
                room -= take // 4
                if take < len(ids):
                    rest.append((doc, start + take // 4, ids[take:], total))
            self.emit(out)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text: str = "text", cache_entries: int = 1_000_000) -> DataFrame:
    """Rows of pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's by the byte-level tokenizer file
    ``tokenizer`` and then ``end_id``; a null text is empty, so every row gives
    at least one piece, repeated rows each their own. Sequences have ``size``
    tokens, or a power of two; ``offset`` runs without gaps from 0. Sequence ids
    hold the partition in their upper bits, and depend on how the input is
    split, as does which level wins a tie. Memory is bounded by one document, one
    batch, and 4096 open windows. An empty table gives no rows.
    """
    path = tokenizer or bpe.default_tokenizer()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(path, cache_entries)
        end = end_id.to_bytes(4, "little")
        number = TaskContext.get().partitionId() << 36
        out: list[tuple] = []

        def emit(pieces: list[tuple]) -> None:
            nonlocal number
            offset = 0
            for doc, start, ids, total in pieces:
                out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, number, offset))
                offset += len(ids) // 4
            number += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        packer = SumOfSquares(size, emit)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc, ids in zip(part.column(0).to_pylist(), encode.encode_many([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    packer.add(doc, ids, len(ids) // 4)
                yield flush()
        packer.close()
        yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, PIECES)
