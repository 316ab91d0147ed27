"""Benchmark passages in documents, also re-parameterised ones, by template windows.

Words are brought to a core (letters and digits, case folded).  Numbers, units and names (capitalised
words inside a sentence) may stand for typed placeholders.  Every window of five tokens is hashed with its
words, and, where it has placeholders and at least PLAIN_WORDS other words, once more as a template;
windows of placeholders alone are no template.  Document windows are tried against a bit table of the
benchmark's windows (a fixed size; when full it only lets more through).

An item is found in a text where windows with one slot map (one value of the item stands for one value of
the text and the reverse, the most frequent pairings first) cover at least 75 % of the item's tokens within
a stretch of the text of three times the item's length.  So some of an item's rarest windows, those without
which the others cover less, must be in the text: only these are joined by hash, and the pairs of text and
item that they give are then judged on all windows.

Result, one row per document and found item: doc_id, item_id, n_tokens (of the item), covered, similarity,
slots_changed (tokens of the item whose slot has another value in the document).

Defined results: null and empty texts, and items without words, match nothing; an item of fewer than five
tokens is found only in texts that are the same tokens altogether; rows of one doc_id (null is one too) are
judged each by itself, and the best of them counts; rows of one item_id with several texts are items of
their own; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import as_text, cut, ship
from larkspur.llm.shingles import mix

WINDOW = 5
LEAST = 0.75
#: Words of a template window that are no placeholders, at least.
PLAIN_WORDS = 2
#: A found item lies in so many consecutive pieces, each of the item's length, of a text.
STRETCH = 3
#: Pairs of windows that a task holds at once while it judges.
PAIRS = 1 << 20
#: Bits of the table by which document windows are tried.
TABLE_BITS = 1 << 25
#: Distinct words that a task keeps; beyond, it starts anew (results do not depend on it).
CACHE = 400_000
# Words taken for numbers and for units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons pound pounds ounce ounces ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur degree degrees kmh mph kw kwh watt watts volt volts".split()
NUMBER, UNIT, NAME, PLAIN = 1, 2, 3, 0
_LINE = ""
_RNG = np.random.default_rng(77)
_PLACE = _RNG.integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TYPES = _RNG.integers(1, 1 << 63, 4, dtype=np.uint64)
_WHOLE = _RNG.integers(1, 1 << 63, WINDOW, dtype=np.uint64)
_NOT_CORE = re.compile(r"[\W_]+")
_DIGITS = re.compile(r"[0-9]+(?:st|nd|rd|th)?")
_KNOWN = {**dict.fromkeys(NUMBER_WORDS, NUMBER), **dict.fromkeys(UNITS, UNIT)}
_HIT = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("h", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("slots", pa.list_(pa.int64()))])
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item", pa.int64()), ("n_tokens", pa.int64()), ("covered", pa.int64()), ("slots_changed", pa.int64())])


class _Tokens(dict):
    """word -> code; of each code: hash of its core (0: none), its kind, and whether a sentence may start after it."""

    def __init__(self):
        self.core: list[int] = []
        self.kind: list[int] = []
        self.stop: list[bool] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self.core)
        core = _NOT_CORE.sub("", word)
        low = core.lower()
        kind = NUMBER if _DIGITS.fullmatch(low) else _KNOWN.get(low, NAME if core[:1].isupper() and core[1:].islower() else PLAIN)
        self.core.append(xxhash.xxh3_64_intdigest(low) | 1 if core else 0)
        self.kind.append(kind)
        self.stop.append(word == _LINE or word[-1] in ".!?:")
        return code


def _windows(texts: list[str], tokens: _Tokens) -> tuple[np.ndarray, ...]:
    """(row, position, hash, slots, tokens of the row) of every window, both ways of hashing."""
    codes: list[int] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for k, t in enumerate(texts):
        codes += [tokens[w] for w in t.replace("\n", f" {_LINE} ").split()]
        ends[k + 1] = len(codes)
    code = np.asarray(codes, np.int64)
    core, kind, stop = np.array(tokens.core, np.uint64), np.array(tokens.kind, np.int8), np.array(tokens.stop, bool)
    core, kind = (core[code], kind[code]) if len(code) else (np.zeros(0, np.uint64), np.zeros(0, np.int8))
    starts = np.ones(len(code), bool)
    if len(code):
        starts[1:] = stop[code[:-1]]
        starts[ends[:-1][ends[:-1] < len(code)]] = True
    kind = np.where((kind == NAME) & starts, PLAIN, kind)
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    keep = core != 0
    core, kind, row = core[keep], kind[keep], row[keep]
    size = np.bincount(row, minlength=len(texts))
    first = np.cumsum(size) - size
    place = np.arange(len(row)) - first[row]
    slot = np.where(kind > 0, core.view(np.int64), 0)
    typed = np.where(kind > 0, _TYPES[kind], core)

    n = max(0, len(core) - WINDOW + 1)
    inner = place[:n] + WINDOW <= size[row[:n]]
    at = np.flatnonzero(inner)

    def hashed(x: np.ndarray) -> np.ndarray:
        h = x[:n] * _PLACE[0]
        for j in range(1, WINDOW):
            h = h + x[j : n + j] * _PLACE[j]
        return mix(h[at])

    has = np.zeros(n, np.int64)
    for j in range(WINDOW):
        has += kind[j : n + j] > 0
    usable = (has[at] > 0) & (has[at] <= WINDOW - PLAIN_WORDS)
    plain, template = hashed(core), hashed(typed)[usable]
    some = at[usable]
    short = np.flatnonzero((size > 0) & (size < WINDOW))
    whole = [mix((core[first[k] : first[k] + size[k]] * _PLACE[: size[k]]).sum(dtype=np.uint64, keepdims=True) + _WHOLE[size[k]]) for k in short]
    where = np.concatenate([at, some, first[short]])
    return row[where] if len(where) else where, place[where] if len(where) else where, np.concatenate([plain, template, *whole]), where, size, slot


def _slots(slot: np.ndarray, where: np.ndarray) -> np.ndarray:
    """(windows x WINDOW) slot values, 0 where a token is none."""
    padded = np.concatenate([slot, np.zeros(WINDOW, np.int64)])
    return padded[where[:, None] + np.arange(WINDOW)]


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(TABLE_BITS - 1)).astype(np.int64), (h >> np.uint64(39)).astype(np.int64)


def item_windows(items: DataFrame, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """(item_id, item, n_tokens, h, ipos, islots): the windows of each item as lists; item names a text among those of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_text(b.column(1))
            row, place, h, where, size, slot = _windows(texts, _Tokens())
            slots = _slots(slot, where)
            of = [np.flatnonzero(row == k) for k in range(len(texts))]
            names = [xxhash.xxh3_64_intdigest(t) >> 1 for t in texts]
            yield pa.record_batch(
                [b.column(0), pa.array(names, pa.int64()), pa.array(size), pa.array([h[o].view(np.int64) for o in of], pa.list_(pa.int64())), pa.array([place[o] for o in of], pa.list_(pa.int32())), pa.array([slots[o].ravel() for o in of], pa.list_(pa.int64()))],
                names=["item_id", "item", "n_tokens", "h", "ipos", "islots"],
            ).filter(pa.array(size > 0))

    rows = items.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").alias("t")).distinct()
    return rows.mapInArrow(run, "item_id long, item long, n_tokens long, h array<long>, ipos array<int>, islots array<long>")


def posted_windows(windows: DataFrame, least: float = LEAST) -> DataFrame:
    """(h, item_id, item): of each item the rarest windows, so many that the others cover less than `least` of its tokens.

    A text in which an item is found has one of them; windows that many items share are posted only where an
    item has no rarer ones.
    """
    each = windows.select("item_id", "item", "n_tokens", F.explode(F.arrays_zip("h", "ipos")).alias("w")).select("item_id", "item", "n_tokens", "w.h", "w.ipos")
    held = each.groupBy("h").agg(F.count(F.lit(1)).alias("times"))
    lists = each.join(held, "h").groupBy("item_id", "item", "n_tokens").agg(F.collect_list(F.struct("ipos", "h", "times")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for item_id, item, n, ws in zip(*(c.to_pylist() for c in b.columns), strict=True):
                times: dict[int, int] = {}
                for w in ws:
                    times[w["ipos"]] = max(times.get(w["ipos"], 0), w["times"])
                covered: set[int] = set()
                common = set()
                for at in sorted(times, key=lambda p: (-times[p], p)):
                    more = covered | set(range(at, min(n, at + WINDOW)))
                    if len(more) < least * n:
                        covered = more
                        common.add(at)
                out += [(w["h"], item_id, item) for w in ws if w["ipos"] not in common]
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["h", "item_id", "item"])

    return lists.mapInArrow(run, "h long, item_id long, item long").distinct()


def _table(windows: DataFrame) -> np.ndarray:
    """Bit table of the windows' hashes."""
    windows = windows.select(F.explode("h").alias("h"))
    low, high = F.col("h").bitwiseAND(F.lit(TABLE_BITS - 1)), F.expr("shiftrightunsigned(h, 39)")
    bits = windows.select(F.explode(F.array(low, high)).alias("x"))
    words = bits.groupBy(F.shiftright("x", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(x % 64 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(TABLE_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _pairs(doc_h: np.ndarray, item_h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(item window, document window) of equal hash, about PAIRS at a time."""
    order = np.argsort(doc_h, kind="stable")
    lo, hi = (np.searchsorted(doc_h[order], item_h, side) for side in ("left", "right"))
    upto = np.cumsum(hi - lo)
    begin = 0
    while begin < len(item_h):
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + PAIRS, "right")))
        n = (hi - lo)[begin:end]
        at = np.repeat(lo[begin:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield np.repeat(np.arange(begin, end), n), order[at]
        begin = end


def _slot_map(pairs: Iterator[tuple[np.ndarray, np.ndarray]], item_slots: np.ndarray, doc_slots: np.ndarray, wide: int) -> np.ndarray:
    """For each slot value of the item its one value of the document, 0 for none: the most frequent pairings first.

    Slots are numbers of values below wide, the same for both sides, 0 where a token is no slot; each value of
    the document is taken once; of equally frequent pairings that of equal values goes first.
    """
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for j, i in pairs:
        both = (item_slots[j] * wide + doc_slots[i])[(item_slots[j] > 0) & (doc_slots[i] > 0)]
        k, n = np.unique(both, return_counts=True)
        keys.append(k)
        times.append(n)
    keys, place = np.unique(np.concatenate(keys), return_inverse=True)
    times = np.bincount(place, np.concatenate(times), len(keys))
    mine, other = keys // wide, keys % wide
    ahead, taken = np.zeros(wide, np.int64), np.zeros(wide, bool)
    for p in np.lexsort((keys, mine != other, -times)).tolist():
        if not ahead[mine[p]] and not taken[other[p]]:
            ahead[mine[p]] = other[p]
            taken[other[p]] = True
    return ahead


def _covered(doc_h: np.ndarray, at: np.ndarray, doc_slots: np.ndarray, item_h: np.ndarray, ipos: np.ndarray, item_slots: np.ndarray, n_tokens: int) -> tuple[int, int]:
    """(tokens of the item covered, slots changed) by windows that keep to one slot map, in the best stretch of the document."""
    wanted = np.isin(doc_h, item_h)
    doc_h, at, doc_slots = doc_h[wanted], at[wanted], doc_slots[wanted]
    # values by number, 0 first: slot hashes are odd, so 0 is no value
    values, number = np.unique(np.concatenate([np.zeros(1, np.int64), item_slots.ravel(), doc_slots.ravel()]).view(np.uint64), return_inverse=True)
    item_slots, doc_slots = number[1 : 1 + item_slots.size].reshape(-1, WINDOW), number[1 + item_slots.size :].reshape(-1, WINDOW)
    ahead = _slot_map(_pairs(doc_h, item_h), item_slots, doc_slots, len(values))
    kept = [np.zeros(0, np.int64)]  # piece of the document, item window, changed tokens: each once
    for j, i in _pairs(doc_h, item_h):
        a, b = item_slots[j], doc_slots[i]
        told = (a > 0) & (b > 0)
        agree = (~told | (ahead[a] == b)).all(1)
        changed = ((told & (a != b)) << np.arange(WINDOW)).sum(1)
        kept.append(np.unique((((at[i] // n_tokens) * len(item_h) + j) * (1 << WINDOW) + changed)[agree]))
    found = np.unique(np.concatenate(kept))
    changed, window, piece = found % (1 << WINDOW), found // (1 << WINDOW) % len(item_h), found // (1 << WINDOW) // len(item_h)
    best = (0, 0)
    for first in np.unique(piece).tolist():
        lo, hi = np.searchsorted(piece, [first, first + STRETCH])
        tokens, changes = np.zeros((2, n_tokens + WINDOW), bool)
        for k in range(WINDOW):
            tokens[ipos[window[lo:hi]] + k] = True
            changes[(ipos[window[lo:hi]] + k)[(changed[lo:hi] >> k & 1) > 0]] = True
        best = max(best, (int(tokens[:n_tokens].sum()), -int(changes[:n_tokens].sum())))
    return best[0], -best[1]


def contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_id_col: str = "item_id", least: float = LEAST) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    known = cut(item_windows(items, item_text_col, item_id_col), "benchmark-windows")
    held = spark.sparkContext.broadcast(_table(known))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        table, tokens = held.value, _Tokens()
        for b in batches:
            if len(tokens) > CACHE:
                tokens = _Tokens()
            texts = as_text(b.column(1))
            row, place, h, where, _, slot = _windows(texts, tokens)
            x, y = _bits(h)
            hit = np.flatnonzero(table[x >> 6] >> (x & 63) & table[y >> 6] >> (y & 63) & 1)
            hit = hit[np.argsort(row[hit], kind="stable")]
            slots = _slots(slot, where[hit])
            rows, first = np.unique(row[hit], return_index=True)
            ends = np.append(first, len(hit))
            part = lambda v: [v[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]
            keys = [xxhash.xxh3_64_intdigest(texts[r]) >> 1 for r in rows]
            yield pa.record_batch(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.int64()), pa.array(part(h[hit].view(np.int64)), pa.list_(pa.int64())), pa.array(part(place[hit].astype(np.int32)), pa.list_(pa.int32())), pa.array([s.ravel() for s in part(slots)], pa.list_(pa.int64()))],
                schema=_HIT,
            )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            of = {c: b.column(k) for k, c in enumerate(b.schema.names)}
            lists = lambda c, k: of[c][k].values.to_numpy()  # noqa: E731, B023
            for k in range(b.num_rows):
                n = of["n_tokens"][k].as_py()
                covered, changed = _covered(lists("h", k), lists("at", k).astype(np.int64), lists("slots", k).reshape(-1, WINDOW), lists("ih", k), lists("ipos", k).astype(np.int64), lists("islots", k).reshape(-1, WINDOW), n)
                if covered >= least * n:
                    out.append((of["doc_id"][k].as_py(), of["item_id"][k].as_py(), of["item"][k].as_py(), n, covered, changed))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], schema=_FOUND)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))
    hits = cut(rows.mapInArrow(scan, "doc_id long, key long, h array<long>, at array<int>, slots array<long>"), "benchmark-hits").distinct()
    posted = hits.select("doc_id", "key", F.explode(F.array_distinct("h")).alias("h")).join(posted_windows(known, least), "h")
    pairs = posted.select("doc_id", "key", "item_id", "item").distinct()
    judged = (
        pairs.join(hits.withColumnsRenamed({"doc_id": "d", "key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
        .join(known.withColumnsRenamed({"item_id": "i", "item": "it", "h": "ih"}), F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item") == F.col("it")))
        .select("doc_id", "item_id", "item", "n_tokens", "h", "at", "slots", "ih", "ipos", "islots")
        .mapInArrow(judge, "doc_id long, item_id long, item long, n_tokens long, covered long, slots_changed long")
    )
    best = judged.groupBy("doc_id", "item_id", "item", "n_tokens").agg(F.max(F.struct("covered", (-F.col("slots_changed")).alias("kept"))).alias("b"))
    return best.select("doc_id", "item_id", "n_tokens", F.col("b.covered").alias("covered"), (F.col("b.covered") / F.col("n_tokens")).alias("similarity"), (-F.col("b.kept")).alias("slots_changed"))
