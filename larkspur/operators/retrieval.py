"""Exact vector retrieval, fusion of ranked lists, and facet filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.vector import finite, norm
from larkspur.operators.lexical import top_k

RRF_K = 60


def unit(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): vectors scaled to length 1, so that a product is a cosine; zero vectors go.

    The length is the variable of an outer transform: a column of its own would be put in for each component and worked out as often.
    """
    raw = F.col(vec_col)
    scaled = F.transform(F.array(norm(raw)), lambda n: F.transform(raw, lambda x: x.cast("double") / n))
    return vectors.filter(norm(raw) > 0).select(F.col(id_col).alias("id"), scaled[0].alias("v"))


#: Query vectors that meet all vectors in one pass: the bound of what is collected and broadcast at a time.
QUERY_BLOCK = 4096
#: Rows and queries whose cosines a task holds at once, and candidates that it gathers before it keeps the k best.
ROWS, QUERIES, PENDING = 1024, 512, 1 << 18


def knn(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): exact k nearest by cosine of unit vectors (id long, v).

    queries is a stated set that meets all vectors in blocks of about QUERY_BLOCK: a task multiplies ROWS
    vectors with QUERIES of a block at a time and keeps k rows of each query, so only those are shuffled, and its
    memory does not grow with either table.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    spark = queries.sparkSession
    blocks = -(-queries.count() // QUERY_BLOCK)
    kind = "query_id long, doc_id long, score double"
    if not blocks:
        return top_k(spark.createDataFrame([], kind), k)

    def nearest(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, matrix = held.value
            floor = np.full(len(asked), -2.0)  # a row below the floor of a query is none of its k best
            query, doc, score, more, n_more = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), [], 0

            def settle() -> None:
                nonlocal query, doc, score, more, n_more
                query, doc, score = (np.concatenate([held, *new]) for held, new in zip((query, doc, score), zip(*more, strict=True), strict=True))
                order = np.lexsort((doc, -np.round(score, 9), query))
                query, doc, score = query[order], doc[order], score[order]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                query, doc, score, place = query[place < k], doc[place < k], score[place < k], place[place < k]
                # a margin above the rounding by which ties are told; ids decide among equals
                floor[query[place == k - 1]] = score[place == k - 1] - 1e-8
                more, n_more = [], 0

            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    ids = b.column(0).slice(at, ROWS).to_numpy()
                    rows = np.stack(b.column(1).slice(at, ROWS).to_numpy(zero_copy_only=False)).astype(float)
                    for q0 in range(0, len(asked), QUERIES):
                        cosines = rows @ matrix[:, q0 : q0 + QUERIES]
                        if exclude_self:
                            cosines[ids[:, None] == asked[None, q0 : q0 + QUERIES]] = -2
                        least = floor[q0 : q0 + QUERIES]
                        if len(ids) > k and least.min() == -2:
                            least = np.maximum(least, np.partition(cosines, len(ids) - k, 0)[len(ids) - k] - 1e-8)
                        i, q = np.nonzero((cosines >= least) & (cosines > -1.5))
                        more.append((q + q0, ids[i], cosines[i, q]))
                        n_more += len(q)
                        if n_more > PENDING + len(query):
                            settle()
                    if more and floor.min() == -2:  # the first rows give a floor to those that follow
                        settle()
            if more:
                settle()
            yield pa.record_batch([pa.array(asked[query]), pa.array(doc), pa.array(score)], names=["query_id", "doc_id", "score"])

        return vectors.select(F.col("id").cast("long"), "v").mapInArrow(run, kind)

    found = None
    for n in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).select(F.col("id").cast("long").alias("id"), "v").collect()
        if rows:
            some = nearest(spark.sparkContext.broadcast((np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows], float).T)))
            found = some if found is None else found.unionAll(some)
    return top_k(found, k)


def embedding_integrity(vectors: DataFrame, id_col: str, vec_col: str, size: int, tolerance: float = 1e-3) -> DataFrame:
    """Counts of rows, repeated ids, wrong sizes, non-finite, zero and non-unit vectors, in one pass."""
    v, n = F.col(vec_col), norm(F.col(vec_col))
    c = lambda cond, name: F.sum(F.coalesce(cond, F.lit(True)).cast("long")).alias(name)
    return vectors.agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.countDistinct(id_col)).alias("repeated_ids"), c(F.size(v) != size, "wrong_size"), c(~finite(v), "not_finite"), c(n == 0, "zero"), c(F.abs(n - 1) > tolerance, "not_unit"), (F.count(F.lit(1)) * size * 4).alias("bytes"))


def fused(lexical: DataFrame, semantic: DataFrame, k: int = RRF_K) -> DataFrame:
    """Full outer join of two ranked lists (query_id, doc_id, score, rank): native scores and ranks, RRF score, union score."""
    a = lexical.select("query_id", "doc_id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    b = semantic.select("query_id", "doc_id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    j = a.join(b, ["query_id", "doc_id"], "full_outer")
    part = lambda r: F.coalesce(1.0 / (F.lit(k) + F.col(r)), F.lit(0.0))
    both = F.col("bm25_rank").isNotNull() & F.col("vector_rank").isNotNull()
    return j.withColumns({"rrf_score": part("bm25_rank") + part("vector_rank"), "union_score": F.when(both, 0.0).otherwise(F.coalesce("bm25_score", "vector_score")), "in_both": both})


def repeated_items(lists: DataFrame, group: str = "query_id", item: str = "doc_id") -> DataFrame:
    """(group, item, n) of items that stand in a ranked list more than once: must be empty before lists are fused."""
    return lists.groupBy(group, item).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, score, n_lists) of any number of ranked lists stacked as (query_id, doc_id, rank)."""
    return lists.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.count(F.lit(1)).alias("n_lists"))


def fusion_stats(f: DataFrame) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    return f.groupBy("query_id").agg(n(F.col("bm25_rank").isNotNull()).alias("n_bm25"), n(F.col("vector_rank").isNotNull()).alias("n_vector"), F.count(F.lit(1)).alias("n_pool"), n(F.col("in_both")).alias("n_overlap"))


# facet filters ---------------------------------------------------------------------------------


def scalar_facet(asked: Column, has: Column) -> Column:
    """True if not asked for; else equality, case-sensitive, false where the product lacks the value."""
    return asked.isNull() | F.coalesce(asked == has, F.lit(False))


def multi_facet(asked: Column, has: Column) -> Column:
    """True if not asked for; else the product has all values asked for."""
    return asked.isNull() | F.coalesce(F.size(F.array_except(asked, has)) == 0, F.lit(False))


def price_facet(low: Column, high: Column, price: Column) -> Column:
    """Inclusive bounds; false where a bound is asked for and the price is missing."""
    return (low.isNull() | F.coalesce(price >= low, F.lit(False))) & (high.isNull() | F.coalesce(price <= high, F.lit(False)))


def constraints_active(*asked: Column) -> Column:
    return F.coalesce(*[a.cast("string") for a in asked]).isNotNull()


def page(df: DataFrame, id_col: str, limit: int, offset: int, **equal) -> DataFrame:
    """Rows of all the equalities given, ordered by id, one page of them."""
    for c, v in equal.items():
        df = df.filter(F.col(c) == v)
    return df.orderBy(id_col).offset(offset).limit(limit)


def capped_term_slice(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, per_term: int, always: DataFrame | None = None) -> DataFrame:
    """Ids of documents whose lower-cased text contains a term, the first per_term by id of each, and of those always in.

    terms (term) is a stated query set.  A task runs one automaton of all terms over its texts and gives out
    per_term ids of a term at most, so neither terms nor documents are paired.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    from larkspur.session import ship

    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(sorted(r["term"] for r in terms.filter("term <> ''").distinct().collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, t in enumerate(held.value):
            automaton.add_word(t, k)
        first: list[list[int]] = [[] for _ in held.value]
        if held.value:
            automaton.make_automaton()
            for b in batches:
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for k in {k for _, k in automaton.iter(text or "")}:
                        first[k] = sorted({*first[k], i})[:per_term]
        found = [(k, i) for k, ids in enumerate(first) for i in ids]
        yield pa.record_batch([pa.array([k for k, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())], names=["term", "doc_id"])

    from pyspark.sql.window import Window

    hit = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_col).alias("t")).mapInArrow(run, "term long, doc_id long")
    first = hit.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))).filter(F.col("n") <= per_term).select("doc_id")
    return (first.union(always.select("doc_id")) if always is not None else first).distinct()
