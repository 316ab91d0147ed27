"""Packing of whole pieces into few sequences: dominance reduction, then best fit of what is left.

A document of more than CAPACITY ids is cut into pieces of CAPACITY ids, of which the first may be
shorter; every other document is one piece.  A packing depends on the pieces' lengths alone, so the
instance is the table of counts of lengths: CAPACITY numbers, however many documents there are.  It is
counted by Spark, reduced and packed on the driver in bulk, and comes back as intervals: pieces number a
to b of one length go to sequences from s on, so many in each, at that offset.  The intervals are fewer
than LEVELS times the groups of sequences that best fit makes, hence bounded by the capacity too.

Reduction.  For the longest length j, let a be the longest other piece that fits beside it.  A set that
holds j is fixed for good if it dominates every other one, so that some best packing holds it:

* nothing fits beside j: {j};
* j and a fill the sequence, or only one further piece fits: {j, a}, since whatever else lay beside j
  takes a's place;
* at most two further pieces fit: {j, a}, if no two pieces that fit are longer together than a; or {j, a, b},
  b the longest that fits beside both, if no two pieces, both longer than b and shorter than a, fit
  beside j (each of any other two is then matched by a or b).

Every rule holds for as many copies of a set as there are, and is tried until none applies.  The rest
is packed by best fit in decreasing order, all pieces of one length at once.

Defined results: a null or empty text is a document of its end id alone; rows with equal or null doc_id
are packed each for itself; an empty table gives no rows; columns beyond the two named are ignored.
"""

from __future__ import annotations

import gc
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.common import arrow_map, as_text, cut, rows_with_id, ship
from larkspur.llm.tokens import encoder

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, number long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "task", "number")]])
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut_lengths(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces, in order."""
    first = total % capacity
    return [first] * bool(first) + [capacity] * (total // capacity)


class Instance:
    """Pieces of each length that are not packed yet, and the intervals of those that are."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = Counter({s: n for s, n in counts.items() if n})
        self.sizes = sorted(self.left)
        self.given: Counter[int] = Counter()  # pieces of a length that have a place
        self.sequences = 0
        self.fixed = 0  # sequences fixed by dominance
        self.intervals: list[tuple[int, int, int, int, int, int]] = []  # length, from, to, in each sequence, first sequence, offset

    def put(self, size: int, pieces: int, each: int, first: int, offset: int) -> None:
        start = self.given[size]
        self.intervals.append((size, start, start + pieces, each, first, offset))
        self.given[size] += pieces
        self.left[size] -= pieces
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def fix(self, pattern: list[int]) -> None:
        """Packs the set as often as its pieces last."""
        need = Counter(pattern)
        times = min(self.left[s] // n for s, n in need.items())
        offset = 0
        for s, n in need.items():
            self.put(s, n * times, n, self.sequences, offset)
            offset += s * n
        self.sequences += times
        self.fixed += times

    def _longest(self, most: int, without: Counter) -> int | None:
        """Longest length of at most `most` of which a piece is left beside `without`."""
        at = bisect_right(self.sizes, most)
        while at:
            at -= 1
            if self.left[self.sizes[at]] > without[self.sizes[at]]:
                return self.sizes[at]
        return None

    def _fitting(self, room: int, without: Counter, least: int = 0, most: int | None = None, enough: int = 3) -> int:
        """How many of the shortest pieces, of lengths between the two, fit together (no more than enough are counted)."""
        n, at = 0, bisect_right(self.sizes, least)
        while n < enough and at < len(self.sizes) and (most is None or self.sizes[at] < most):
            s = self.sizes[at]
            take = min(enough - n, self.left[s] - without[s], room // s)
            n, room = n + take, room - take * s
            if self.left[s] - without[s] > take:
                break
            at += 1
        return n

    def _best_pair(self, room: int, without: Counter) -> int:
        """Largest total, within the room, of two pieces."""
        best, hi = 0, bisect_right(self.sizes, room) - 1
        for lo, s in enumerate(self.sizes):
            while hi >= lo and s + self.sizes[hi] > room:
                hi -= 1
            if hi < lo:
                break
            for k in (hi, hi - 1, hi - 2):  # the nearest of which enough pieces are left
                if k >= lo and all(self.left[x] - without[x] >= n for x, n in Counter((s, self.sizes[k])).items()):
                    best = max(best, s + self.sizes[k])
                    break
        return best

    def dominant(self, j: int) -> list[int] | None:
        """A set with j that dominates all others with j, by the rules above."""
        room, one = self.capacity - j, Counter([j])
        a = self._longest(room, one)
        if a is None:
            return [j]
        fit = self._fitting(room, one)
        if a == room or fit == 1:
            return [j, a]
        if fit == 2:
            if a >= self._best_pair(room, one):
                return [j, a]
            two = Counter([j, a])
            b = self._longest(room - a, two)
            if b is not None and self._fitting(room, one, b, a, 2) < 2:
                return [j, a, b]
        return None

    def reduce(self) -> None:
        found = True
        while found:
            found = False
            for j in reversed(self.sizes.copy()):
                while self.left[j] and (pattern := self.dominant(j)):
                    self.fix(pattern)
                    found = True

    def best_fit(self) -> None:
        """Best fit in decreasing order: each piece goes to the fullest sequence that has room for it."""
        rooms: list[int] = []  # rooms of open sequences, ascending
        groups: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first sequence, number of sequences)

        def opened(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in groups:
                    insort(rooms, room)
                groups.setdefault(room, []).append((first, n))

        for s in reversed(self.sizes.copy()):
            while pieces := self.left[s]:
                at = bisect_left(rooms, s)
                if at < len(rooms):
                    room = rooms[at]
                    first, n = groups[room].pop()
                    if not groups[room]:
                        del groups[room], rooms[at]
                else:
                    room, first = self.capacity, self.sequences
                    n = -(-pieces // (room // s))
                    self.sequences += n
                each = room // s
                whole = min(n, pieces // each)
                if whole:
                    self.put(s, whole * each, each, first, self.capacity - room)
                    opened(room - each * s, first, whole)
                rest = min(pieces - whole * each, each - 1) if whole < n else 0
                if rest:
                    self.put(s, rest, rest, first + whole, self.capacity - room)
                    opened(room - rest * s, first + whole, 1)
                    whole += 1
                opened(room, first + whole, n - whole)


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> Instance:
    instance = Instance(counts, capacity)
    instance.reduce()
    instance.best_fit()
    return instance


def pieces(docs: DataFrame, text_col: str, id_col: str, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces (PIECES) of every document; `number` counts the pieces of one length in a task, from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # large lists of strings and numbers, no cycles
        enc, task = encoder(vocabulary), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for b in batches:
            flat, ends = enc.encode(as_text(b.column(1)))
            flat, ends = np.insert(flat, ends[1:], end_id), (ends + np.arange(len(ends))).tolist()
            ids = memoryview(flat.astype("<u4")).cast("B")
            rows: list[tuple] = []
            for k, name in enumerate(b.column(0).to_pylist()):
                at = ends[k]
                for piece, n in enumerate(cut_lengths(ends[k + 1] - at, capacity)):
                    rows.append((name, piece, at - ends[k], n, zlib.crc32(ids[4 * at : 4 * (at + n)]), task, seen[n]))
                    seen[n] += 1
                    at += n
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * 7, _PIECES, strict=True)], schema=_PIECES)

    return rows_with_id(docs, id_col, text_col).mapInArrow(run, PIECES)


def pack(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece (SCHEMA); sequences are numbered from 0 without gaps.

    Pieces are written once; a count for each task and length numbers the pieces of a length over all tasks,
    so that no task and no key holds all pieces of one length.
    """
    spark = docs.sparkSession
    ship(spark)
    made = cut(pieces(docs, text_col, id_col, vocabulary, end_id, capacity), "dominance-pieces")
    counted = cut(made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "dominance-counts")
    counts = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    found = sorted(solve(counts, capacity).intervals)
    table = np.array(found, np.int64).reshape(-1, 6)
    plan = spark.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = made.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("base")).alias("number"))

    def make():
        size, first, _, each, sequence, offset = plan.value.T
        starts = np.empty(len(size), [("size", np.int64), ("first", np.int64)])
        starts["size"], starts["first"] = size, first

        def place(b: pa.RecordBatch) -> pa.RecordBatch:
            length, number = b.column(3).to_numpy(), b.column(5).to_numpy()
            asked = np.empty(len(length), starts.dtype)
            asked["size"], asked["first"] = length, number
            at = np.searchsorted(starts, asked, side="right") - 1
            inside = number - first[at]
            return pa.record_batch([*b.columns[:5], pa.array(sequence[at] + inside // each[at]), pa.array(offset[at] + inside % each[at] * length)], names=[*b.schema.names[:5], "sequence_id", "offset"])

        return place

    return arrow_map(numbered, make, SCHEMA)
