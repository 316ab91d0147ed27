"""Sum-of-squares online packing of token sequences into windows of fixed capacity.

Every document's whole windows are cut off first; its remainder goes, online, to the fill level whose
choice leaves the least sum of squared counts of partially filled windows (level array N: N[h] windows
are filled to h).  At the end of a partition the windows still open are joined and cut anew, and the
last, partial one is cut at powers of two, which need no padding.

Each input partition packs its own documents: nothing is shuffled, no state is shared, and a lost task
gives the same rows again.  sequence_id is partition * 2**32 + a running number.

Defined results: a null or empty text is a document of its end id alone; rows with equal or null doc_id
are packed each for itself; an empty table gives no rows; columns beyond the two named are ignored.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from larkspur.llm.common import as_text, release, rows_with_id
from larkspur.llm.tokens import encoder, forget

CAPACITY = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])


class SumOfSquares:
    """place(size) -> level of the window to put an item of that size in (0: a new one)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)

    def place(self, size: int) -> int:
        n, cap = self.counts, self.capacity
        # half the change of the sum of squares: level h loses a window, level h + size gains one
        change = (n[size:] - n[: cap - size + 1] + 1).astype(np.float64)
        change[n[: cap - size + 1] == 0] = np.inf
        change[0] = n[size] + 0.5 if size < cap else 0.0
        if size < cap and n[cap - size]:
            change[cap - size] = 0.5 - n[cap - size]
        h = cap - size - int(np.argmin(change[::-1]))  # of equals the fullest
        if h:
            n[h] -= 1
        if h + size < cap:
            n[h + size] += 1
        return h


class Packer:
    """Streams pieces (key, start, ids, doc_tokens) into windows; yields (key, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.levels = capacity, SumOfSquares(capacity)
        self.open: dict[int, list[list]] = {}  # level -> windows, each a list of pieces
        self.next = 0

    def _close(self, pieces) -> list[tuple]:
        out, at, number = [], 0, self.next
        self.next += 1
        for key, start, ids, total in pieces:
            out.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, at))
            at += len(ids)
        return out

    def add(self, key, ids: np.ndarray) -> list[tuple]:
        cap, total, out = self.capacity, len(ids), []
        whole = total - total % cap
        for at in range(0, whole, cap):
            out += self._close([(key, at, ids[at : at + cap], total)])
        if whole < total:
            rest = ids[whole:].copy()
            h = self.levels.place(len(rest))
            window = self.open[h].pop() if h else []
            window.append((key, whole, rest, total))
            if h + len(rest) == cap:
                out += self._close(window)
            else:
                self.open.setdefault(h + len(rest), []).append(window)
        return out

    def finish(self) -> list[tuple]:
        """Joins the open windows, fullest first, and cuts them at the capacity and the last one at powers of two."""
        pieces = [p for h in sorted(self.open, reverse=True) for w in self.open[h] for p in w]
        left = sum(len(p[2]) for p in pieces)
        self.open, self.levels, out, window, room = {}, SumOfSquares(self.capacity), [], [], 0
        for key, start, ids, total in pieces:
            while len(ids):
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                take = min(room, len(ids))
                window.append((key, start, ids[:take], total))
                start, ids, room, left = start + take, ids[take:], room - take, left - take
                if not room:
                    out += self._close(window)
                    window = []
        return out


def pack(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY, keep_encoder: bool = True) -> DataFrame:
    """One row per piece (SCHEMA) of every document's ids, with end_id appended to each document.

    A worker keeps its encoder from task to task unless keep_encoder is false, as where other stages need the memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # large lists of strings and numbers, no cycles
        packer, enc, base = Packer(capacity), encoder(vocabulary), TaskContext.get().partitionId() << 32

        def rows(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) if found else [[]] * 7
            cols[5] = [base + k for k in cols[5]]
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], schema=_ARROW)

        for b in batches:
            flat, ends = enc.encode(as_text(b.column(1)))
            found: list[tuple] = []
            for k, key in enumerate(b.column(0).to_pylist()):
                found += packer.add(key, np.append(flat[ends[k] : ends[k + 1]], np.uint32(end_id)))
            yield rows(found)
        yield rows(packer.finish())
        if not keep_encoder:
            del enc
            forget()
            release()

    return rows_with_id(docs, id_col, text_col).mapInArrow(run, SCHEMA)
