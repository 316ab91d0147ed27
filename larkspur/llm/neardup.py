"""MinHash near-duplicates by an inverted join of signature coordinates.

1. Every text becomes its set of 5-word shingles, a digest of the set and a signature of K minima.  Rows
   of one digest are exact copies of a set; only the smallest id of each goes on.
2. Two sets of similarity 0.75 agree in about 48 of 64 coordinates; pairs with fewer than T = 30 agreeing
   coordinates are left out (at 0.75 exactly, 3.8 pairs in ten million; fewer above), in lists of any length.  Two signatures that agree
   in T must share one of each one's K - T + 1 rarest (coordinate, value) pairs, so only these are posted;
   the order of rarity comes from counts of all pairs in a table of fixed size, and any order is right.
3. In each posting list, every member is joined with the list's most central member alone (skip merging);
   what is confirmed joins components.  Lists whose members are then in one component are done; in the
   others, the pairs of different components are joined, those of long lists block by block.  So a large group of copies costs one pair for a
   member, and no link between components is lost.
4. A candidate pair counts its agreeing coordinates, T at least, and is then confirmed on the full sets.

Defined results: texts without words have an empty set and link with nothing; a null doc_id is never
linked and has no component (kept is true); rows with equal doc_id share their component; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, drop_written, ship, sorted_side, split_join
from larkspur.llm.components import components
from larkspur.llm.shingles import COORDINATES, linked, mix, set_digest, shingle_set, signature

AGREE = 30
PREFIX = COORDINATES - AGREE + 1
PERCENT = 75
#: Cells of the table of counts by which pairs are ordered: a fixed size, whatever the input.
CELLS = 1 << 19
#: Rows of one posting list that a task gets at most, about; longer lists are split and their leaders joined.
SPLIT = 100_000
#: Members of a list from which its pairs across components are compared in blocks of BLOCK by BLOCK sets.
LONG, BLOCK = 32, 400
#: Bits of the filter by which texts of candidate pairs are read: a fixed size; when full it only lets more texts through.
FILTER_BITS = 1 << 26
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("sig", pa.binary())])
_COORDINATE = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))


def features(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, hi, lo, sig) of every row; sig is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for b in batches:
            n, hi, lo, sig = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t or b"")
                d = set_digest(s) if len(s) else (0, 0)
                n.append(len(s))
                hi.append(d[0])
                lo.append(d[1])
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.binary())], schema=_FEATURES)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long, sig binary")


def _pairs(sig: pa.Array) -> np.ndarray:
    """Hashes (rows x K) of the (coordinate, value) pairs of signatures."""
    values = np.frombuffer(b"".join(sig.to_pylist()), np.uint32).reshape(-1, COORDINATES)
    return mix(values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ _COORDINATE)


def _cell_counts(reps: DataFrame) -> np.ndarray:
    """How many pairs of all sets fall in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount((_pairs(b.column(0)) & np.uint64(CELLS - 1)).astype(np.int64).ravel(), minlength=CELLS)
        cells = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])

    sums = reps.select("sig").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return out


def _postings(reps: DataFrame, counts) -> DataFrame:
    """(bucket, salt, rep, central): each set under its PREFIX rarest pairs.

    central grows with the counts of all its pairs.  salt splits the lists that the counts show to be long
    (0 for all others), so that no task gets more than about SPLIT rows of one list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counts.value
        for b in batches:
            if not b.num_rows:
                continue
            p = _pairs(b.column(1))
            n = held[(p & np.uint64(CELLS - 1)).astype(np.int64)]
            # by count, equal counts by the pair's own hash: one order for all sets
            by_hash = np.argsort(p, axis=1)
            order = np.take_along_axis(by_hash, np.argsort(np.take_along_axis(n, by_hash, 1), axis=1, kind="stable"), 1)[:, :PREFIX]
            central = (np.log2(np.maximum(n, 1)).sum(1) * 1000).astype(np.int64)
            rep = b.column(0).to_numpy()
            parts = np.take_along_axis(n, order, 1) // SPLIT + 1
            salt = (mix(rep.astype(np.uint64))[:, None] % parts.astype(np.uint64)).astype(np.int32) + (parts > 1)
            cols = [np.take_along_axis(p, order, 1).view(np.int64).ravel(), salt.astype(np.int32).ravel(), np.repeat(rep, PREFIX), np.repeat(central, PREFIX)]
            yield pa.record_batch([pa.array(c) for c in cols], names=["bucket", "salt", "rep", "central"])

    return reps.select("rep", "sig").mapInArrow(run, "bucket long, salt int, rep long, central long")


def _lists(postings: DataFrame) -> DataFrame:
    """(bucket, salt, rep, leader, central): the members of lists of two or more sets, with the list's most central one.

    A part of a split list may be a single set, its own leader: the list's other sets are in other parts.
    One shuffle by list and a sort that puts the leader first; the lists then stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "salt", "rep", "leader", "central"]
        held: list[np.ndarray] | None = None  # first row of the last list, not yet given out
        lead = None  # (bucket, salt, leader) of the last list, if its first row is given out
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy() for c in b.columns]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            bucket, salt, rep, central = cols
            new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])])
            group = np.cumsum(new) - 1
            starts = np.flatnonzero(new)
            leader = rep[starts][group]
            size = np.bincount(group)
            keep = (size > 1)[group] | (salt > 0)
            if lead is not None and (bucket[0], salt[0]) == lead[:2]:  # a list that goes on
                leader[group == 0], keep[group == 0] = lead[2], True
            elif lead is not None:
                lead = None
            on = keep[-1]
            held = None if on else [c[-1:] for c in cols]
            lead = (bucket[-1], salt[-1], leader[-1]) if on else None
            yield pa.record_batch([pa.array(c[keep]) for c in (bucket, salt, rep, leader, central)], names=names)

    dealt = postings.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", F.desc("central"), "rep")
    return dealt.mapInArrow(run, "bucket long, salt int, rep long, leader long, central long")


def _with_both(pairs: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """Written pairs (a, b) with what one has of a and two has of b; the pairs of a b of very many are spread over tasks."""
    times = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    return split_join(pairs.join(sorted_side(one), "a"), two.join(sorted_side(times), "b"), "b", "a", "n", pairs.count())


def _agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in AGREE coordinates at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(-1, COORDINATES) for k in (2, 3))
            keep = pa.array((left == right).sum(1) >= AGREE)
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    one = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa"))
    two = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    return _with_both(pairs, one, two).select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) of the pairs (a, b) linked on their full sets; rows of one b come together, so its set is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        last, other = None, None
        for batch in batches:
            keep = []
            b, ta, tb = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for k in range(len(b)):
                if b[k] != last:
                    last, other = b[k], shingle_set(tb[k])
                keep.append(linked(shingle_set(ta[k]), other, percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    one = texts.select(F.col("rep").alias("a"), F.col("t").alias("ta"))
    two = texts.select(F.col("rep").alias("b"), F.col("t").alias("tb"))
    return _with_both(pairs, one, two).select("a", "b", "ta", "tb").mapInArrow(run, "u long, v long")


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rep, t) of the documents (rep, t) that occur in pairs, and a few others."""
    at = lambda k: F.pmod(F.xxhash64(F.lit(k), "x"), F.lit(FILTER_BITS))
    bits = pairs.select(F.explode(F.array("a", "b")).alias("x")).select(F.explode(F.array(at(0), at(1))).alias("h"))
    words = bits.groupBy(F.shiftright("h", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h % 64 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def occurs(h0: pd.Series, h1: pd.Series) -> pd.Series:
        t = held.value
        a, b = h0.to_numpy(), h1.to_numpy()
        return pd.Series((t[a >> 6] >> (a & 63) & t[b >> 6] >> (b & 63) & 1).astype(bool))

    keyed = docs.filter(F.col("rep").isNotNull()).withColumn("x", F.col("rep"))
    return keyed.filter(occurs(at(0), at(1))).select("rep", "t")


def _block_links(long_lists: DataFrame, reps: DataFrame, raw: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) between components among the members of long lists, confirmed on full sets.

    Lists that share members form a cluster.  All members outside the cluster's largest component are dealt
    into blocks that meet each other, and the blocks of that component; a task holds two blocks, counts the
    agreeing coordinates of all their pairs, compares the sets of those that agree in AGREE and are still
    apart, and gives out the edges that join them.  So no pair is ever a row, and members of one component
    are not compared.
    """
    members = cut(long_lists.select("rep", "c", "head").distinct(), "neardup-long")
    cluster = components(members.select(F.col("rep").alias("u"), F.col("head").alias("v")))
    # the smallest member of a cluster has no row in components()
    own = members.select("rep", "c").distinct().join(sorted_side(cluster), F.col("rep") == F.col("node"), "left").select("rep", "c", F.coalesce("component", "rep").alias("cluster"))
    own = cut(own, "neardup-long")
    sizes = own.groupBy("cluster", "c").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.groupBy("cluster").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    plan = total.select("cluster", F.col("top.c").alias("main"), blocks(F.col("all") - F.col("top.n")).alias("others"), blocks(F.col("top.n")).alias("mains"))
    j = own.join(sorted_side(plan), "cluster").withColumn("is_main", F.col("c") == F.col("main"))
    # blocks 0 .. others-1 hold the others, those from others on the largest component
    j = j.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int") + F.when(F.col("is_main"), F.col("others")).otherwise(0))
    partner = F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1))
    dealt = j.filter("others > 0").select("cluster", "rep", "c", "block", F.explode(partner).alias("other"))
    dealt = dealt.select("cluster", "rep", "c", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("k"))
    texts = _texts(raw, own.select(F.col("rep").alias("a"), F.col("rep").alias("b"))).join(sorted_side(reps.select("rep", "sig")), "rep")

    def compare(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable").reset_index(drop=True)
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(-1, COORDINATES)
        comp, rep, texts, out = rows["c"].to_numpy(), rows["rep"].tolist(), rows["t"].tolist(), []
        sets: dict[int, np.ndarray] = {}

        def shingled(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = shingle_set(texts[x])
            return sets[x]

        top: dict[int, int] = {}

        def find(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for x in range(len(rep)):
            for y in (np.flatnonzero(((sig[x + 1 :] == sig[x]).sum(1) >= AGREE) & (comp[x + 1 :] != comp[x])) + x + 1).tolist():
                p, q = find(int(comp[x])), find(int(comp[y]))
                if p != q and linked(shingled(x), shingled(y), percent):
                    top[p] = q
                    out.append((rep[x], rep[y]))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return dealt.join(sorted_side(texts), "rep").groupBy("cluster", "i", "k").applyInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    ship(spark)
    feat = cut(features(docs, text_col, id_col), "neardup-features")
    usable = feat.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    reps = cut(usable.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "neardup-sets")
    counts = spark.sparkContext.broadcast(_cell_counts(reps))
    raw = docs.select(F.col(f"`{id_col}`").cast("long").alias("rep"), F.col(f"`{text_col}`").cast("binary").alias("t"))

    lists = cut(_lists(_postings(reps, counts)), "neardup-lists")
    # parts of split lists: their leaders, a few for each list, meet under the most central one
    parts = lists.filter("salt > 0 and rep = leader").select("bucket", "leader", "central").distinct()
    top = parts.groupBy("bucket").agg(F.max(F.struct("central", (-F.col("leader")).alias("minus"))).alias("top")).select("bucket", (-F.col("top.minus")).alias("b"))
    tops = parts.join(sorted_side(top), "bucket").select(F.col("leader").alias("a"), "b")
    stars = cut(lists.select(F.col("rep").alias("a"), F.col("leader").alias("b")).union(tops).filter("a <> b").distinct(), "neardup-stars")
    agreeing = cut(_agreeing(stars, reps), "neardup-pairs")
    first = cut(_confirmed(agreeing, _texts(raw, agreeing), percent), "neardup-links")
    inner = cut(components(first), "neardup-components")

    # lists with members in several components: pairs across components, of long lists in blocks
    placed = cut(lists.select("bucket", "rep").distinct().join(sorted_side(inner), lists.rep == inner.node, "left").select("bucket", "rep", F.coalesce("component", "rep").alias("c")), "neardup-placed")
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("n"), F.min("rep").alias("head")).filter("c0 < c1").select("bucket", "n", "head")
    left = cut(split_join(placed, mixed, "bucket", "rep", "n", placed.count()), "neardup-open")
    short = left.filter(F.col("n") <= LONG)
    one, two = short.select("bucket", F.col("rep").alias("a"), F.col("c").alias("ca")), short.select("bucket", F.col("rep").alias("b"), F.col("c").alias("cb"))
    rest = cut(one.join(sorted_side(two), "bucket").filter("a > b and ca <> cb").select("a", "b").distinct(), "neardup-rest")
    across = cut(_agreeing(rest, reps), "neardup-pairs")
    second = cut(_confirmed(across, _texts(raw, across), percent), "neardup-links")
    third = cut(_block_links(left.filter(F.col("n") > LONG), reps, raw, percent), "neardup-links")

    # an id that comes with several sets joins them
    classes = reps.select("hi", "lo", "rep")
    several = usable.groupBy("doc_id").agg(F.min(F.struct("hi", "lo")).alias("s0"), F.max(F.struct("hi", "lo")).alias("s1")).filter("s0 <> s1").select("doc_id")
    same = usable.join(sorted_side(several), "doc_id").join(sorted_side(classes), ["hi", "lo"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    comp = components(first.union(second).union(third).union(same))
    drop_written(spark, lists, stars, agreeing, first, inner, placed, left, rest, across, second, third)
    named = classes.join(sorted_side(comp), F.col("rep") == F.col("node"), "left").select("hi", "lo", F.coalesce("component", "rep").alias("c"))
    rows = feat.join(sorted_side(named), ["hi", "lo"], "left").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id")).alias("component_id"))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
