"""Ranked lexical search: WAND over document shards, shard heaps merged.

Two passes.  The first reads every text once, counts its terms and writes the postings of asked terms with
the document's length; from that table come the corpus statistics.  The second runs each item over each
shard (a bounded number of documents of one task, in order of their ids): per asked term a list of documents
and impacts and the term's largest impact in the shard.  Cursors stand at each list's next document; in order of
these, largest impacts are added up until they reach the score of the heap's last entry, which gives the
pivot: no document before it can enter the heap, so the lists before it skip there, and a document is scored only where
the pivot is the first cursor.  The heap goes on from one shard of a task to the next.  A task gives out at
most `k` rows an item; they are merged in two steps, by groups of tasks and then by item.

Items are the stated queries; they are taken in blocks of BLOCK_BYTES of text, each with its passes.
Scores are 64-bit integers but for each term's weight, which is a logarithm in doubles, rounded down.

Defined results: a null text has no terms and is not counted among the documents; an empty table or item gives
no rows; each row of documents is a document of its own, rows without doc_id come last among equal scores;
equal rows of items count once, rows of one item_id with different texts are ranked each for itself; only the named columns are read.
"""

from __future__ import annotations

import gc
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.common import cut, rows_with_id, ship

K = 20
#: Bytes of items' texts that are searched together: their terms bound what is broadcast and collected.
BLOCK_BYTES = 1 << 24
#: Documents of a shard.
SHARD = 1 << 16
#: Groups of tasks whose heaps are merged first.
MERGE = 64
#: A document id that sorts behind every other: none.
NO_ID = 1 << 63

#: Terms end at every ASCII character but digits and letters; A-Z are folded.  Bytes of longer characters are all part of terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

POSTINGS = "doc_id long, n long, codes array<int>, tfs array<int>"
_POSTINGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("codes", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
FOUND = "query int, part int, doc_id long, score long"
_FOUND = pa.schema([("query", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def wand(lists: list[tuple], heap: list[tuple], k: int, names) -> int:
    """Takes the k best of (score, -id) into the heap; lists are (documents, impacts, largest impact).  Gives the number of documents scored."""
    docs, impacts, most = zip(*lists, strict=True) if lists else ((), (), ())
    ends = [len(d) for d in docs]
    at = [0] * len(docs)
    here = [d[0] for d in docs]
    order = sorted(range(len(docs)), key=here.__getitem__)
    scored = 0
    while order:
        least, bound = 1, 0
        if len(heap) == k:  # an equal score enters only before the id of the heap's last entry; ids ascend
            least = heap[0][0] + (names[here[order[0]]] >= -heap[0][1])
        for pivot, i in enumerate(order):
            bound += most[i]
            if bound >= least:
                break
        else:
            return scored
        doc = here[order[pivot]]
        if here[order[0]] == doc:
            score = 0
            for i in order:
                if here[i] != doc:
                    break
                score += impacts[i][at[i]]
                at[i] += 1
                here[i] = docs[i][at[i]] if at[i] < ends[i] else -1
            scored += 1
            entry = (score, -names[doc])
            if len(heap) < k:
                if score > 0:
                    heappush(heap, entry)
            elif entry > heap[0]:
                heapreplace(heap, entry)
        else:
            for i in order[:pivot]:
                if here[i] < doc:
                    at[i] = bisect_left(docs[i], doc, at[i], ends[i])
                    here[i] = docs[i][at[i]] if at[i] < ends[i] else -1
        order = [i for i in order if here[i] >= 0]
        order.sort(key=here.__getitem__)
    return scored


def _postings(docs: DataFrame, asked) -> DataFrame:
    """The documents' lengths in terms and their counts of asked terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = asked.value
        for b in batches:
            n, sizes, codes, tfs = [], [0], [], []
            for text in b.column(1).to_pylist():
                found = terms(text)
                n.append(len(found))
                held = Counter(map(code.get, found))
                held.pop(None, None)
                codes += held.keys()
                tfs += held.values()
                sizes.append(len(codes))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (codes, tfs)]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), *lists], schema=_POSTINGS)

    return docs.mapInArrow(run, POSTINGS)


def _search(postings: DataFrame, model, k: int) -> DataFrame:
    """The k best documents of each query in each task (FOUND)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        n_docs, n_terms, weights, queries = model.value
        part, heaps = TaskContext.get().partitionId(), [[] for _ in queries]

        def shard(rows: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(rows).combine_chunks()
            ids, n = t.column("doc_id").to_pylist(), t.column("n").to_numpy()
            codes, tfs = (t.column(c).chunk(0) for c in ("codes", "tfs"))
            sizes = np.diff(codes.offsets.to_numpy())
            names = [NO_ID if x is None else x for x in ids]
            order = sorted(range(len(ids)), key=names.__getitem__)
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            names = [names[x] for x in order]
            m = 75 + (25 * n * n_docs) // n_terms
            code, tf, doc, m = codes.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64), np.repeat(place, sizes), np.repeat(m, sizes)
            impact = weights[code] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            by_term = np.lexsort((doc, code))
            code, doc, impact = code[by_term], doc[by_term], impact[by_term]
            starts = np.searchsorted(code, np.arange(len(weights) + 1))
            lists = {}
            for c in np.unique(code).tolist():
                a, z = starts[c], starts[c + 1]
                lists[c] = doc[a:z], impact[a:z], int(impact[a:z].max())
            for query, heap in zip(queries, heaps, strict=True):
                own = [(memoryview(lists[c][0]), memoryview(lists[c][1] * times), lists[c][2] * times) for c, times in query if c in lists and lists[c][2]]
                wand(own, heap, k, names)

        held, count = [], 0
        for b in batches:
            b = b.filter(pc.greater(b.column(1), 0))
            for at in range(0, b.num_rows, SHARD):
                some = b.slice(at, SHARD)
                if held and count + some.num_rows > SHARD:
                    shard(held)
                    held, count = [], 0
                held.append(some)
                count += some.num_rows
        if count:
            shard(held)
        rows = [(q, part, None if e[1] == -NO_ID else -e[1], e[0]) for q, heap in enumerate(heaps) for e in heap]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * 4, _FOUND, strict=True)], schema=_FOUND)

    return postings.mapInArrow(run, FOUND)


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list]:
    """Rows (item_id, text) of the items with a text, by blocks; one block is in the driver at a time."""
    named = items.filter(F.length("text") > 0).distinct()
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        yield named.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()


def _block(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    """rank and score for the items of one block; None where there is nothing to find."""
    spark = docs.sparkSession
    wanted = [Counter(terms(r.text)) for r in rows]
    names = sorted({t for w in wanted for t in w})
    code = {t: c for c, t in enumerate(names)}
    postings = cut(_postings(docs, spark.sparkContext.broadcast(code)), "ranked-postings")
    n_docs, n_terms = postings.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs or not names:
        return None
    weights = np.zeros(len(names), np.int64)
    for c, df in postings.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # one row for each term of the block
        weights[c] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    model = spark.sparkContext.broadcast((n_docs, n_terms, weights, [[(code[t], n) for t, n in w.items()] for w in wanted]))
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    found = _search(postings, model, k).withColumn("part", F.pmod("part", F.lit(MERGE)))
    for by in (["query", "part"], ["query"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).filter(F.col("rank") <= k)
    item = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(rows)], "query int, item_id long")
    return found.join(F.broadcast(item), "query").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    spark = docs.sparkSession
    ship(spark)
    docs = rows_with_id(docs, id_col, text_col)
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    found = [f for rows in _blocks(asked, block_bytes) if (f := _block(docs, rows, k)) is not None]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, found)


def oracle() -> str:
    return r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM len),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, corpus GROUP BY term),
norm AS (SELECT doc_id, 100 - 25 + (25 * n * big_n) // l AS m FROM len, corpus),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN norm USING (doc_id) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20"""
