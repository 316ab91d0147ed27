"""Dominance packing, ranked search and hard negatives against brute force, and the cases that their docstrings define."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, same
from pyspark.sql import functions as F

from larkspur.llm import dominance, hard_negatives, ranked_search
from larkspur.llm.queries import ORACLE_SQL, QUERIES
from larkspur.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
ODD = [None, "", "  a  b\n\n c ", "don't we'll, 3.14 x.y", "ÀÉ İ x́ 漢字 12345", "\n", "a\x00b", "<|endoftext|> q", "é ́b", " a ", "word " * 5000, "mega byte " * 100_000]
SCHEMA = "doc_id long, text string, length long, number long, n long, score double, query int, rank int"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing column names."""
    rows = [(k, t, 1, 2, 3, 0.5, 7, 8) for k, t in enumerate(ODD)]
    rows += [(None, "no id at all", *[None] * 6), (3, "don't we'll, 3.14 x.y", *[None] * 6), (3, "another text of one id", *[None] * 6)]
    return spark.createDataFrame(rows, SCHEMA)


# ---- packing


def _laid_out(counts: dict, capacity: int) -> dominance.Instance:
    """The solved instance, after a check that its intervals hold every piece once and lay each sequence out without gaps."""
    solved, seen, sequences = dominance.solve(counts, capacity), Counter(), defaultdict(list)
    for size, a, z, each, first, offset in solved.intervals:
        assert a == seen[size]
        seen[size] = z
        for r in range(z - a):
            sequences[first + r // each].append((offset + r % each * size, size))
    assert seen == Counter(counts) and sorted(sequences) == list(range(solved.sequences))
    for rows in sequences.values():
        at = 0
        for offset, size in sorted(rows):
            assert offset == at
            at += size
        assert at <= capacity
    return solved


def _best_fit(items: list, capacity: int) -> int:
    rooms = []
    for s in sorted(items, reverse=True):
        fitting = [k for k, r in enumerate(rooms) if r >= s]
        if fitting:
            rooms[min(fitting, key=rooms.__getitem__)] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


def _fewest(items: list, capacity: int) -> int:
    """By trying every way."""
    items, best = sorted(items, reverse=True), _best_fit(items, capacity)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= items[k]:
                left = rooms.copy()
                left.remove(r)
                go(k + 1, [*left, r - items[k]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best


def test_dominance_keeps_a_best_packing():
    rng, fixed, three = random.Random(5), 0, 0
    for _ in range(1500):
        capacity = rng.choice([10, 13, 20, 30])
        low = rng.choice([1, 2, 4, capacity // 4])
        items = [rng.randint(low, capacity) for _ in range(rng.randint(1, 9))]
        instance = dominance.Instance(Counter(items), capacity)
        instance.reduce()
        left = list(instance.left.elements())
        assert instance.sequences + (_fewest(left, capacity) if left else 0) == _fewest(items, capacity)
        fixed += instance.fixed
        three += max(Counter(s for _, a, z, each, first, _ in instance.intervals for s in range(first, first + (z - a) // each)).values(), default=0) > 2
        _laid_out(Counter(items), capacity)
    assert fixed > 2000 and three


def test_bulk_best_fit_is_best_fit():
    rng = random.Random(6)
    for _ in range(300):
        capacity = rng.choice([16, 100, 2048])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 200))]
        instance = dominance.Instance(Counter(items), capacity)
        instance.best_fit()
        assert instance.sequences == _best_fit(items, capacity)


def test_size_of_the_plan_does_not_grow_with_the_documents():
    rng = np.random.default_rng(1)
    few, many = (dominance.solve(Counter(np.clip(rng.lognormal(5.5, 1.3, n).astype(int), 1, 2048).tolist())) for n in (10**5, 10**6))
    assert len(many.intervals) < 2 * len(few.intervals) < 20_000


def _hold(rows: list, texts: list, capacity: int) -> int:
    """Checks the packing of (name, text); gives the number of sequences."""
    lib = Encoder(dominance.VOCABULARY).library
    want = Counter()
    for name, ids in zip([n for n, _ in texts], lib.encode_batch([t or "" for _, t in texts], add_special_tokens=False), strict=True):
        ids = np.array([*ids.ids, dominance.END_ID], "<u4")
        at = 0
        for piece, n in enumerate(dominance.cut_lengths(len(ids), capacity)):
            want[name, piece, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing_of_documents(spark, capacity):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    rows = dominance.pack(docs, capacity=capacity).collect()
    n = _hold(rows, [(r.doc_id, r.text) for r in docs.collect()], capacity)
    assert n <= -(-sum(r.length for r in rows) // capacity) * 1.02 + 1


def test_packing_of_edges(spark, edge):
    _hold(dominance.pack(edge.repartition(3)).collect(), [(r.doc_id, r.text) for r in edge.collect()], 2048)
    empty = dominance.pack(edge.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


# ---- ranked search


def _ranked(docs: list, items: list, k: int) -> list:
    """(item_id, rank, doc_id, score) by the formula, over all documents."""
    held = [(name, Counter(ranked_search.terms(text))) for name, text in docs]
    held = [(name, c) for name, c in held if c]
    n, total, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for name, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            w = {t: int(np.floor(1000 * np.log((2 * n + 2) / (2 * df[t] + 1)))) for t in c}
            s = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in ranked_search.terms(text) if t in c)
            if s > 0:
                scored.append((-s, ranked_search.NO_ID if name is None else name, name))
        out += [(item, rank, name, -s) for rank, (s, _, name) in enumerate(sorted(scored)[:k], 1)]
    return out


def _sorted(rows):
    return sorted(rows, key=repr)


def test_terms():
    assert ranked_search.terms("ÀB-c_9é\x7f\x00漢X,y") == ["Àb".encode(), b"c", "9é".encode(), "漢x".encode(), b"y"]
    assert ranked_search.terms(None) == ranked_search.terms(" .-\n") == []


@pytest.mark.parametrize("shard", [1 << 16, 7])
def test_wand_equals_all_scores(monkeypatch, shard):
    """Over random short documents with many ties, from heaps that go on from shard to shard."""
    rng = random.Random(9)
    for _ in range(60):
        k, words = rng.choice([1, 3, 20]), "abcdefgh"
        lists = {c: sorted(rng.sample(range(200), rng.randint(1, 150))) for c in words}
        impacts = {c: [rng.choice([1, 2, 5]) for _ in d] for c, d in lists.items()}
        want = Counter()
        for c in words:
            for d, s in zip(lists[c], impacts[c], strict=True):
                want[d] += s
        heap, names, scored = [], list(range(200)), 0
        for at in range(0, 200, min(shard, 200)):
            own = []
            for c in words:
                rows = [(d, s) for d, s in zip(lists[c], impacts[c], strict=True) if at <= d < at + shard]
                if rows:
                    own.append((*map(list, zip(*rows, strict=True)), max(s for _, s in rows)))
            scored += ranked_search.wand(own, heap, k, names)
        assert sorted(heap, reverse=True) == sorted(((s, -d) for d, s in want.items()), reverse=True)[:k]
        assert scored <= len(want)


def test_wand_skips_documents():
    rare, common = [50, 900], list(range(1000))
    heap = []
    assert ranked_search.wand([(rare, [90, 80], 90), (common, [1] * 1000, 1)], heap, 2, common) < 60
    assert sorted(heap, reverse=True) == [(91, -50), (81, -900)]


@pytest.mark.parametrize("block_bytes", [1 << 24, 900])
def test_ranked_search_of_edges(spark, edge, monkeypatch, block_bytes):
    items = spark.createDataFrame([(1, "we'll 3 a A b"), (1, "we'll 3 a A b"), (1, "word byte"), (2, None), (3, ""), (4, "---"), (5, "nowhere"), (None, "text id mega"), (6, "a " * 400)], "item_id long, text string")
    got = ranked_search.ranked(edge.repartition(3), items, block_bytes=block_bytes)
    want = _ranked([(r.doc_id, r.text) for r in edge.collect()], [(r.item_id, r.text) for r in items.collect()], 20)
    assert _sorted(map(tuple, got.collect())) == _sorted(want) and len(want) > 10
    for none in (ranked_search.ranked(edge.limit(0), items), ranked_search.ranked(edge, items.limit(0)), ranked_search.ranked(edge.filter("text IS NULL"), items)):
        assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_ranked_search_of_benchmark(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    monkeypatch.setattr(ranked_search, "SHARD", 16)
    got = QUERIES["op12_ranked_search"](spark, SF).collect()
    assert _sorted(map(tuple, got)) == _sorted(_ranked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 20))


# ---- hard negatives


def _negatives(rows: list, k: int = 5) -> list:
    """By all products, in integers."""
    rows = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (a, lab, v) in enumerate(rows):
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other == lab) for m, (i, other, w) in enumerate(rows) if m != n)
        for s, p, _ in [x for x in scored if x[2]][:k]:
            fitting = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(fitting, 1)]
    return out


ROWS = "vec_id long, embedding array<float>, label int, key long, score long, slot int"


def _found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in [(i, v, lab) for i, lab, v in rows]], ROWS).repartition(3)
    return sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **kw).collect()))


def _vectors(n, width, seed, clusters=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    return [(k, int(k * 7 % 4), (centres[k % clusters] + 0.3 * rng.normal(size=width)).astype(np.float32).tolist()) for k in range(n)]


@pytest.mark.parametrize("width", [1, 3, 20, 64])
def test_negatives_equal_all_products(spark, monkeypatch, width):
    monkeypatch.setattr(hard_negatives, "FIRST", 16)
    rows = _vectors(500, width, width)
    want = sorted(_negatives(rows))
    assert _found(spark, rows) == want and len(want) > 20


def test_negatives_of_edges(spark):
    rows = _vectors(220, 6, 3)
    rows[5], rows[6], rows[7] = (None, 1, rows[5][2]), (6, None, rows[6][2]), (7, 1, None)
    rows[8], rows[9], rows[10] = (8, 1, [float("nan")] * 6), (9, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (10, 1, [float("inf")] * 6)
    rows[11], rows[12] = (11, 1, []), (12, 0, rows[12][2][:4])
    rows += [rows[100], rows[100], rows[30], rows[31]]  # an anchor thrice, repeated rows
    rows += [(300, 2, [0.0] * 6), (400, 3, [-1.0] * 6)]
    want = sorted(_negatives(rows))
    assert _found(spark, rows) == want and {r[0] for r in want} >= {0, 100, 200}
    assert _found(spark, []) == _found(spark, [(0, 1, [1.0])]) == _found(spark, [(5, 1, [1.0]), (6, 1, [1.0])]) == []


def test_negatives_in_small_cells(spark, monkeypatch):
    rows = _vectors(900, 8, 4)
    monkeypatch.setattr(hard_negatives, "CELL", 4)
    assert _found(spark, rows) == sorted(_negatives(rows))


@pytest.mark.parametrize("scale", [2.0**20, 2.0**48])
def test_negatives_of_large_components(spark, scale):
    rows = [(i, lab, [float(np.float32(x * scale)) for x in v]) for i, lab, v in _vectors(250, 4, 5)]
    if scale < 2.0**30:
        assert _found(spark, rows) == sorted(_negatives(rows))
    else:
        with pytest.raises(Exception, match="int too (large|big)|out of|beyond"):
            _found(spark, rows)


def test_pairs_go_early():
    """On clustered vectors few pairs are left for integer products once bounds are known, and none that belongs there is lost."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * (rng.normal(size=(2000, 64)) * np.linspace(1, 0.05, 64)))
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    side = object.__new__(hard_negatives.Side)
    side.turned = (x @ turn).astype(np.float32)
    whole = np.cumsum(np.square(side.turned[:, ::-1].astype(np.float64)), axis=1)[:, ::-1]
    side.rest = np.sqrt(np.concatenate([whole, np.zeros((2000, 1))], axis=1))
    exact = x @ x.T
    least = np.sort(exact, axis=1)[:, -6]
    i, j = hard_negatives._pairs(side, side, np.ones((2000, 2000), bool), least, np.full(2000, np.inf))
    assert set(zip(*np.nonzero(exact >= least[:, None]), strict=True)) <= set(zip(i, j, strict=True))
    assert len(i) < 2000 * 8


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_hard_negatives"])
def test_against_duckdb_at_the_next_size(spark, name):
    same(QUERIES[name](spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), ORACLE_SQL[name])
