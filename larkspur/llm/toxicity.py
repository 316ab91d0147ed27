"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are the prefixes of PREFIXES letters of the case-folded words (a shorter word stands whole), which
join inflected and compound forms.  Every term that LEAST_ROWS examples hold belongs to the vocabulary;
no term is chosen by its label.  A text's vector has the weights count * log((1 + n) / (1 + df)), scaled to
length 1.  Examples lie in blocks of BLOCK, alike ones together; of each term the index keeps its largest
weight in every block.  A query's bound in a block is the product with these; blocks are searched by
falling bounds until none can reach the K-th best cosine, so the neighbours are those of a full
comparison.  Queries go through the index many at once: bounds and blocks are then matrix products, in
single precision with a margin, and what may be among the K best is worked out again in double precision.
Votes of the neighbours, weighted by cosine, are calibrated by isotonic regression over up to about
CALIBRATION_ROWS examples, each left out of its own neighbours and weighted by the rows that it stands for.

The fit takes at most about FIT_ROWS labelled rows of each label (a documented bound, chosen by a hash of
the id); every text is then scored whole.

Result per row (SCHEMA): doc_id, score, evidence (from a score of 0.5: the terms shared with neighbours of
label 1, heaviest first; else empty), neighbours (ids of examples, nearest first), cosines, similarity
(the best cosine).

Defined results: a null text counts as empty; a text without any term of the vocabulary has no neighbour
and gets the share of label 1 among such examples, or among all if there are none; null labels are not
learned from; without examples the score is 0; ties between neighbours go to the lower example number;
rows with equal or null doc_id stay rows of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import as_text, cut, release, rows_with_id, ship
from larkspur.llm.training import bounded_sample, calibrated, isotonic

FIT_ROWS = 3_000
PREFIXES = (3, 4, 5)
#: Examples that hold a term of the vocabulary at least: with one alone it joins no two texts.
LEAST_ROWS = 2
K = 9
#: Examples, evenly spaced, whose left-out votes calibrate the scores, about.
CALIBRATION_ROWS = 4000
BLOCK = 64
#: A term that fewer than 1 in RARE examples hold is rare.
RARE = 24
#: Queries that go through the index at once.
TOGETHER = 256
#: Queries whose postings are added up at once.
LISTED = 8
#: Single-precision cosines are off by far less than this.
MARGIN = 1e-4
SHOWN = 6
SCHEMA = "doc_id long, score double, evidence string, neighbours array<long>, cosines array<double>, similarity double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.string()), ("neighbours", pa.list_(pa.int64())), ("cosines", pa.list_(pa.float64())), ("similarity", pa.float64())])
#: Between words: whatever is neither letter nor digit, of any alphabet.
_BETWEEN = r"[^\pL\pN]+"
Vector = tuple[np.ndarray, np.ndarray]


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, code, names): every term of every word, one for each prefix length that the word reaches; names[code] is the term."""
    pieces = pc.utf8_split_whitespace(texts)
    chunk = pc.list_flatten(pieces).dictionary_encode()  # each distinct chunk is cut into words once
    lists = pc.split_pattern_regex(pc.utf8_lower(chunk.dictionary), _BETWEEN)
    word = pc.list_flatten(lists).dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    of = chunk.indices.to_numpy()
    n = ends[of + 1] - ends[of]
    upto = np.cumsum(n)
    at = np.repeat(ends[of] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)
    row, indices = np.repeat(pc.list_parent_indices(pieces).to_numpy(), n), word.indices.to_numpy()[at]
    size = pc.utf8_length(word.dictionary).to_numpy()
    held = [size >= (1 if n == PREFIXES[0] else n) for n in PREFIXES]
    cut_off = [pc.utf8_slice_codeunits(word.dictionary, 0, n).filter(pa.array(h)) for n, h in zip(PREFIXES, held, strict=True)]
    coded = pa.concat_arrays(cut_off).dictionary_encode()
    codes = np.full((len(size), len(PREFIXES)), -1, np.int64)
    at = 0
    for j, h in enumerate(held):
        codes[h, j] = coded.indices.to_numpy()[at : at + int(h.sum())]
        at += int(h.sum())
    flat = codes[indices].ravel()
    on = flat >= 0
    return np.repeat(row, len(PREFIXES))[on].astype(np.int64), flat[on], coded.dictionary


def _counts(texts: list[str], vocabulary: pa.Array) -> list[Vector]:
    """(term numbers, counts) of each text, by rising number; other terms than the vocabulary's are left out."""
    row, code, names = _terms(pa.array(texts, pa.string()))
    number = pc.fill_null(pc.index_in(names, value_set=vocabulary), -1).to_numpy().astype(np.int64)[code]
    wide = len(vocabulary)
    pair, n = np.unique(row[number >= 0] * wide + number[number >= 0], return_counts=True)
    ends = np.searchsorted(pair, np.arange(len(texts) + 1) * wide)
    return [(pair[a:z] - k * wide, n[a:z]) for k, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True))]


class BlockMaxIndex:
    """Example vectors (unit length, sparse) in blocks of alike ones.

    Terms that 1 in RARE examples hold at least stand in blocks, with the largest weight of each in every
    block; the others have posting lists.  A block's bound for a query is what the lists give its
    best example, plus the query's product with the block's largest weights.
    """

    def __init__(self, vectors: list[Vector], n_terms: int, block: int = BLOCK, rare: int = RARE, joined: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        """joined: (start, terms, weights) where the vectors lie one after the other already, which are then not copied."""
        self.n, self.n_terms, self.block = len(vectors), n_terms, block
        if joined is None:
            start = np.concatenate([[0], np.cumsum([len(t) for t, _ in vectors], dtype=np.int64)])
            joined = start, *(np.concatenate([v[j] for v in vectors]) if vectors else np.zeros(0, kind) for j, kind in ((0, np.int64), (1, float)))
        self.start, self.terms, self.weights = joined
        self.blocks = -(-self.n // block)
        held = np.bincount(self.terms, minlength=n_terms)
        frequent = np.flatnonzero((held > 0) & (held * rare >= self.n))
        self.frequent = len(frequent)
        self.column = np.full(n_terms, -1, np.int32)
        self.column[frequent] = np.arange(self.frequent)
        # of each block: where in it the weights of frequent terms stand, and the weights; it is spread out when it is looked at
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.most = np.zeros((self.blocks, self.frequent), np.float32)
        rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))]
        for b in range(self.blocks):
            ends = self.start[b * block : (b + 1) * block + 1]
            terms, weights = self.terms[ends[0] : ends[-1]], self.weights[ends[0] : ends[-1]].astype(np.float32)
            example, column = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends)), self.column[terms]
            on = column >= 0
            self.held.append((example[on].astype(np.int64) * self.frequent + column[on], weights[on]))
            self.most[b] = self._spread(b).max(0)
            rest.append((terms[~on].astype(np.int32), example[~on] + np.int32(b * block), weights[~on]))
        terms, example, weights = (np.concatenate(x) for x in zip(*rest, strict=True))
        order = np.argsort(terms, kind="stable")
        self.posted, self.posted_weight = example[order], weights[order]
        self.lists = np.concatenate([[0], np.cumsum(np.where(self.column < 0, held, 0))])

    def _spread(self, b: int) -> np.ndarray:
        """The weights of frequent terms in a block's examples, a row for each."""
        out = np.zeros(self.block * self.frequent, np.float32)
        at, weights = self.held[b]
        out[at] = weights
        return out.reshape(self.block, self.frequent)

    def _double(self, examples: np.ndarray, query: Vector, wide: np.ndarray) -> np.ndarray:
        """Cosines of a query with some examples in double precision; wide is an all-zero row, left all-zero."""
        wide[query[0]] = query[1]
        size = self.start[examples + 1] - self.start[examples]
        upto = np.cumsum(size)
        at = np.repeat(self.start[examples] - (upto - size), size) + np.arange(upto[-1])
        got = np.add.reduceat(wide[self.terms[at]] * self.weights[at], upto - size)
        wide[query[0]] = 0
        return got

    def search(self, queries: list[Vector], k: int, without: list[int] | None = None) -> list[Vector]:
        """For each query the k examples of highest cosine above 0: (numbers, cosines), best first, ties by number.

        without names an example that a query must not find.
        """
        out: list[Vector] = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        asked = [q for q, (t, _) in enumerate(queries) if len(t) and self.n]
        for at in range(0, len(asked), 4 * TOGETHER):
            some = asked[at : at + 4 * TOGETHER]
            cosines, wide = self._rare([queries[q] for q in some]), self._frequent([queries[q] for q in some])
            bounds = cosines.reshape(len(some), self.blocks, self.block).max(2) + wide @ self.most.T
            # by the block of the highest bound, so that queries of one group need the same blocks
            order = np.argsort(bounds.argmax(1), kind="stable")
            for lo in range(0, len(some), TOGETHER):
                part = order[lo : lo + TOGETHER]
                names = [some[p] for p in part]
                found = self._together([queries[q] for q in names], cosines[part], wide[part], bounds[part], k, None if without is None else [without[q] for q in names])
                for q, f in zip(names, found, strict=True):
                    out[q] = f
        return out

    def _rare(self, queries: list[Vector]) -> np.ndarray:
        """What the posting lists add to each query's cosine with each example."""
        wide = self.blocks * self.block
        sums = np.zeros((len(queries), wide), np.float32)
        for lo in range(0, len(queries), LISTED):
            some = queries[lo : lo + LISTED]
            row = np.repeat(np.arange(len(some)), [len(t) for t, _ in some])
            term, weight = np.concatenate([t for t, _ in some]), np.concatenate([w for _, w in some])
            size = self.lists[term + 1] - self.lists[term]
            on = size > 0
            row, term, weight, size = row[on], term[on], weight[on], size[on]
            upto = np.cumsum(size)
            at = np.repeat(self.lists[term] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)
            got = np.bincount(np.repeat(row * wide, size) + self.posted[at], np.repeat(weight, size) * self.posted_weight[at], len(some) * wide)
            sums[lo : lo + LISTED] = got.reshape(len(some), wide)
        return sums

    def _frequent(self, queries: list[Vector]) -> np.ndarray:
        wide = np.zeros((len(queries), self.frequent), np.float32)
        for q, (t, w) in enumerate(queries):
            column = self.column[t]
            wide[q, column[column >= 0]] = w[column >= 0]
        return wide

    def _together(self, queries: list[Vector], cosines: np.ndarray, wide: np.ndarray, bounds: np.ndarray, k: int, without: list[int] | None) -> Iterator[Vector]:
        n, size = len(queries), self.block
        best = np.full((n, k), -1, np.float32)  # of each query, its k best so far
        known = np.zeros((n, self.blocks), bool)

        def look(b: int, rows: np.ndarray) -> None:
            part = wide if len(rows) == n else wide[rows]
            got = cosines[rows, b * size : (b + 1) * size] + part @ self._spread(b).T
            got[:, self.n - b * size :] = -1
            if without is not None:
                for c, q in enumerate(rows):
                    if 0 <= without[q] - b * size < size:
                        got[c, without[q] - b * size] = -1
            cosines[rows, b * size : (b + 1) * size] = got
            best[rows] = np.partition(np.concatenate([best[rows], got], 1), size, 1)[:, size:]
            known[rows, b] = True

        leading = bounds.argmax(1)
        for b in np.unique(leading):
            look(int(b), np.flatnonzero(leading == b))
        for b in np.argsort(-bounds.max(0), kind="stable"):
            rows = np.flatnonzero((bounds[:, b] + MARGIN >= best.min(1)) & (bounds[:, b] > 0) & ~known[:, b])
            if len(rows):
                look(int(b), rows)
        cosines[~np.repeat(known, size, 1)] = -1
        floor = np.maximum(best.min(1), 0) - MARGIN
        row = np.zeros(self.n_terms)
        for q in range(n):
            near = np.flatnonzero(cosines[q] >= floor[q])
            exact = self._double(near, queries[q], row) if len(near) else np.zeros(0)
            top = np.lexsort((near, -np.round(exact, 9)))[:k]
            top = top[exact[top] > 0]
            yield near[top], exact[top]


@dataclass
class ToxicityModel:
    vocabulary: pa.Array
    idf: np.ndarray
    start: np.ndarray  # of each example and the end: where its terms and weights begin
    terms: np.ndarray
    weights: np.ndarray
    labels: np.ndarray
    example_ids: list[int]
    blank_score: float
    knots: tuple = field(default_factory=lambda: (np.zeros(0), np.zeros(0)))

    @cached_property
    def vectors(self) -> list[Vector]:
        return [(self.terms[a:z], self.weights[a:z]) for a, z in zip(self.start[:-1], self.start[1:], strict=True)]

    @cached_property
    def index(self) -> BlockMaxIndex:
        """Built where it is first asked for; a worker keeps it from task to task, and it does not travel."""
        made = BlockMaxIndex(self.vectors, len(self.idf), joined=(self.start, self.terms, self.weights))
        release()  # what building took
        return made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("vectors", "index")}

    def vector(self, counts: Vector) -> Vector:
        terms, n = counts
        w = n * self.idf[terms]
        on = w > 0
        return terms[on], w[on] / (np.sqrt((w * w).sum()) or 1.0)

    def votes(self, found: Vector) -> float:
        return float((found[1] * self.labels[found[0]]).sum() / found[1].sum())


def _alike(vectors: list[Vector], n_terms: int, pivots: int = 64) -> np.ndarray:
    """An order of examples that puts alike ones together: by the most similar of some evenly spaced ones."""
    if not vectors:
        return np.zeros(0, np.int64)
    chosen = np.zeros((n_terms, min(pivots, len(vectors))), np.float32)
    for p, i in enumerate(np.linspace(0, len(vectors) - 1, chosen.shape[1]).astype(int)):
        chosen[vectors[i][0], p] = vectors[i][1]
    near = np.stack([chosen[t].T @ w.astype(np.float32) for t, w in vectors])
    return np.lexsort((-near.max(1), near.argmax(1)))


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of TOGETHER rows, which bounds what a task works out at once."""
    for b in batches:
        for start in range(0, b.num_rows, TOGETHER):
            yield b.slice(start, TOGETHER)


def _vocabulary(sample: DataFrame) -> pa.Table:
    """(term, n): the terms of LEAST_ROWS rows or more, in order, and how many rows hold them: as many as a bounded sample holds."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            row, code, names = _terms(pc.fill_null(b.column(0), ""))
            rows = np.bincount(np.unique(row * len(names) + code) % max(1, len(names)), minlength=len(names))
            yield pa.record_batch([names, pa.array(rows, pa.int64())], names=["term", "n"])

    sums = sample.select("t").mapInArrow(tally, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return sums.filter(F.col("n") >= LEAST_ROWS).toArrow().sort_by("term")


def _examples(sample: DataFrame, vocabulary: pa.Array) -> pa.Table:
    """(k, y, w, t, c): id, label, weight and counts of vocabulary terms of the sampled rows, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            found = _counts(as_text(b.column(0)), vocabulary)
            cols = [pa.array([f[j].astype(np.int32) for f in found], pa.list_(pa.int32())) for j in (0, 1)]
            named = pa.array([xxhash.xxh3_64_intdigest(t.tobytes() + c.tobytes()) >> 1 for t, c in found], pa.int64())
            yield pa.record_batch([b.column(1), b.column(2), b.column(3), named, *cols], names=["k", "y", "w", "named", "t", "c"])

    rows = sample.select("t", "k", "y", "w").mapInArrow(run, "k long, y int, w double, named long, t array<int>, c array<int>")
    # put in order here: a sort by Spark would sample whole lists of terms into the driver
    return rows.toArrow().sort_by([(c, "ascending") for c in ("k", "y", "named", "w")])


def _held_out_votes(sample: DataFrame, model: ToxicityModel, step: int) -> pa.Table:
    """(i, vote) of every step-th example, found without itself; examples without neighbours have none."""
    spark = sample.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what the worker's earlier tasks have left
        m = held.value
        for b in _few(batches):
            some = b.column(0).to_pylist()
            found = m.index.search([m.vectors[i] for i in some], K, some)
            told = [(i, m.votes(f)) for i, f in zip(some, found, strict=True) if len(f[0])]
            yield pa.record_batch([pa.array([i for i, _ in told], pa.int64()), pa.array([v for _, v in told], pa.float64())], names=["i", "vote"])

    votes = spark.range(0, len(model.labels), step).mapInArrow(run, "i long, vote double").toArrow()
    held.destroy()
    return votes


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id", rows: int | None = FIT_ROWS, weight_col: str | None = None) -> ToxicityModel:
    """The model of labelled rows; weight_col tells how many rows each stands for, where they are a sample already (rows=None)."""
    ship(labelled.sparkSession)
    weight = F.lit(1.0) if weight_col is None else F.col(weight_col).cast("double")
    usable = labelled.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y"), F.col(text_col).alias("t"), weight.alias("w"))
    if rows is not None:
        usable = bounded_sample(usable, "k", "y", rows, "rate").withColumn("w", F.col("w") * F.col("rate")).drop("rate")
    sample = cut(usable, "toxicity-sample")
    known = _vocabulary(sample)
    vocabulary = known.column("term").combine_chunks()
    held = _examples(sample, vocabulary)
    ids, y, w = held.column("k").to_pylist(), held.column("y").to_numpy(), held.column("w").to_numpy()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(held.column("t")).to_numpy())]).astype(np.int64)
    terms, counts = (pc.list_flatten(held.column(c)).to_numpy() for c in ("t", "c"))
    idf = np.log((1 + len(ids)) / (1 + known.column("n").to_numpy()))
    model = ToxicityModel(vocabulary, idf, np.zeros(1, np.int64), terms[:0], np.zeros(0), np.zeros(0), [], 0.0)
    vectors = [model.vector((terms[a:z], counts[a:z])) for a, z in zip(ends[:-1], ends[1:], strict=True)]
    blank = np.array([not len(v[0]) for v in vectors], bool)
    if len(ids):
        of = blank if blank.any() else ~blank
        model.blank_score = float((y[of] * w[of]).sum() / w[of].sum())
    worded = np.flatnonzero(~blank)
    order = worded[_alike([vectors[i] for i in worded], len(idf))]
    if not len(order):
        return model
    model.start = np.concatenate([[0], np.cumsum([len(vectors[i][0]) for i in order])])
    model.terms, model.weights = np.concatenate([vectors[i][0] for i in order]), np.concatenate([vectors[i][1] for i in order])
    model.labels, model.example_ids, w = y[order].astype(float), [ids[i] for i in order], w[order]
    del held, known, vectors, terms, counts, ids, y
    release()
    votes = _held_out_votes(sample, model, max(1, len(order) // CALIBRATION_ROWS))
    at = votes.column("i").to_numpy()
    if len(at):
        model.knots = isotonic(votes.column("vote").to_numpy(), model.labels[at], w[at])
    return model


def scorer(model: ToxicityModel) -> Callable[[list[str]], list[tuple[float, str, list[int], list[float], float]]]:
    """A function of texts that gives (score, evidence, neighbours' ids, cosines, best cosine) of each."""
    index, wide = model.index, np.zeros(len(model.idf))

    def evidence(query: Vector, found: Vector) -> str:
        some = [(model.vectors[i], c) for i, c in zip(*found, strict=True) if model.labels[i]]
        total = np.bincount(np.concatenate([t for (t, _), _ in some]), np.concatenate([c * w for (_, w), c in some]), len(wide))
        shared = query[1] * total[query[0]]
        top = np.lexsort((query[0], -np.round(shared, 9)))[:SHOWN]
        return " ".join(model.vocabulary[int(query[0][j])].as_py() for j in top if shared[j] > 0)

    def score_texts(texts: list[str]) -> list[tuple[float, str, list[int], list[float], float]]:
        different = list(dict.fromkeys(texts))
        queries = [model.vector(c) for c in _counts(different, model.vocabulary)]
        got = {}
        for t, q, found in zip(different, queries, index.search(queries, K), strict=True):
            if not len(found[0]):
                got[t] = model.blank_score, "", [], [], 0.0
                continue
            score = float(np.clip(calibrated(np.array([model.votes(found)]), model.knots)[0], 0, 1))
            said = evidence(q, found) if score >= 0.5 and model.labels[found[0]].any() else ""
            got[t] = score, said, [model.example_ids[i] for i in found[0]], found[1].tolist(), float(found[1][0])
        return [got[t] for t in texts]

    return score_texts


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document (SCHEMA).  The model is bounded by FIT_ROWS and travels by broadcast."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_texts = scorer(held.value)
        for b in batches:
            out = score_texts(as_text(b.column(1)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.record_batch([b.column(0), *[pa.array(c, f.type) for c, f in zip(cols, list(_ARROW)[1:], strict=True)]], schema=_ARROW)

    return rows_with_id(docs, id_col, text_col).mapInArrow(run, SCHEMA)
