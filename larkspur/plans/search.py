"""Search queries over documents and embeddings: index, BM25, nearest vectors, fusion, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import tokens
from larkspur.operators import block_index as B
from larkspur.operators import lexical as L
from larkspur.operators import retrieval as R
from larkspur.operators import vector_index as V
from larkspur.sources.tables import table

#: The stated query sets: every benchmark item, and every row whose id is divisible by EVERY; item i goes with vector EVERY * i.
TOP_K, EVERY = 10, 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def bench_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(tokens(F.col("text")), " ").alias("query_text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unit(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % EVERY == 0)
    return R.unit(every.withColumn("query_id", F.col("vec_id").cast("long") / EVERY), "query_id", "embedding").withColumn("id", F.col("id").cast("long"))


def bm25_list(spark: SparkSession, sf_dir: str, k: int = TOP_K) -> DataFrame:
    return L.bm25_top(bench_queries(spark, sf_dir), documents(spark, sf_dir), k)


def vector_list(spark: SparkSession, sf_dir: str, k: int = TOP_K) -> DataFrame:
    return R.knn(query_vectors(spark, sf_dir), vectors(spark, sf_dir), k)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def bm25_topk(spark, sf_dir):
    return _rounded(bm25_list(spark, sf_dir), "score")


def _blocks(spark, sf_dir):
    return B.build(documents(spark, sf_dir))


def bm25_block_topk(spark, sf_dir):
    """The list of bm25_topk from a stored index of blocks, most of which are not read."""
    return _rounded(B.search(bench_queries(spark, sf_dir), _blocks(spark, sf_dir), TOP_K), "score")


def block_reads(spark, sf_dir):
    """Blocks of each query's terms, and how many of them its search reads."""
    return B.use(bench_queries(spark, sf_dir), _blocks(spark, sf_dir), TOP_K)


def knn_cosine_topk(spark, sf_dir):
    return _rounded(vector_list(spark, sf_dir), "score")


def knn_index_topk(spark, sf_dir):
    """The list of knn_cosine_topk from a partitioned index, by its exact way."""
    return _rounded(V.search(query_vectors(spark, sf_dir), V.build(vectors(spark, sf_dir)), TOP_K), "score")


def hybrid(spark, sf_dir):
    return R.fused(bm25_list(spark, sf_dir), vector_list(spark, sf_dir))


def rrf_fusion_topk(spark, sf_dir):
    f = hybrid(spark, sf_dir).withColumn("score", F.col("rrf_score"))
    return _rounded(L.top_k(f, TOP_K).select("query_id", "doc_id", "score", "rank", "bm25_rank", "vector_rank"), "score")


def hybrid_union(spark, sf_dir):
    return _rounded(hybrid(spark, sf_dir).select("query_id", "doc_id", "union_score", "bm25_score", "vector_score", "in_both"), "union_score", "bm25_score", "vector_score")


def fusion_stats(spark, sf_dir):
    return R.fusion_stats(hybrid(spark, sf_dir))


def postings_stats(spark, sf_dir):
    rows = L.token_rows(documents(spark, sf_dir), "doc_id", "text")
    p = L.postings(rows).agg(F.countDistinct("term").alias("n_terms"), F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("n_tokens"))
    return _rounded(p.crossJoin(L.corpus_stats(L.doc_stats(rows))), "avgdl")


def term_df_idf(spark, sf_dir):
    rows = L.token_rows(documents(spark, sf_dir), "doc_id", "text")
    df = L.postings(rows).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    n = L.corpus_stats(L.doc_stats(rows)).select("n_docs")
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.crossJoin(F.broadcast(n)).select("term", "df", "cf", F.round(idf, 6).alias("idf"))


def doc_length_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.size(F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))).cast("long").alias("dl"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("n_tokens"), F.min("dl").alias("min_dl"), F.max("dl").alias("max_dl"), F.round(F.avg("dl"), 6).alias("avg_dl"))


def index_integrity(spark, sf_dir):
    rows = L.token_rows(documents(spark, sf_dir), "doc_id", "text")
    return L.integrity(L.postings(rows), L.doc_stats(rows))


def bm25_candidates_union(spark, sf_dir):
    rows = L.token_rows(documents(spark, sf_dir), "doc_id", "text").select("doc_id", F.explode(F.array_distinct("tokens")).alias("term"))
    return L.query_terms(bench_queries(spark, sf_dir)).join(rows, "term").groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_candidates"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def bm25_explicit_candidates(spark, sf_dir):
    """Each query against the ten documents that follow its id."""
    q = bench_queries(spark, sf_dir)
    c = q.select("query_id", F.explode(F.sequence(F.col("query_id"), F.col("query_id") + 9)).alias("doc_id")).join(documents(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    return _rounded(L.bm25_scores(q, documents(spark, sf_dir), candidates=c), "score")


def embedding_integrity(spark, sf_dir):
    return R.embedding_integrity(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)


def embedding_document_ids(spark, sf_dir):
    """Ids on one side alone."""
    v, d = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    n = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return n(v.join(d, "id", "left_anti"), "vector_only").union(n(d.join(v, "id", "left_anti"), "document_only"))


def post_filter_search(spark, sf_dir):
    """BM25 pool of 50, then a language facet, then the best 5: the pool is cut before the filter."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    pool = bm25_list(spark, sf_dir, 50).drop("rank").join(d, "doc_id")
    kept = pool.filter(R.scalar_facet(F.lit("en"), F.col("lang")))
    return _rounded(L.top_k(kept, 5), "score")


def term_slice(spark, sf_dir):
    terms = bench_queries(spark, sf_dir).select(F.explode(F.split("query_text", " ")).alias("term")).filter("term <> ''").distinct()
    return R.capped_term_slice(documents(spark, sf_dir), terms, "doc_id", "text", 5)


def facet_filter_all(spark, sf_dir):
    """All requests against all parts at once: the requests are a small fixed table."""
    req = spark.sql("SELECT * FROM VALUES (1, 'Brand#1', CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)), (2, NULL, 'blue', NULL, 1200.0D), (3, NULL, 'red,bolt', 950.0D, 1500.0D), (4, NULL, NULL, NULL, NULL) AS r(request_id, brand, words, low, high)")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.split("p_name", " ").alias("has"), "p_retailprice")
    ok = R.scalar_facet(F.col("brand"), F.col("p_brand")) & R.multi_facet(F.split("words", ","), F.col("has")) & R.price_facet(F.col("low"), F.col("high"), F.col("p_retailprice"))
    active = R.constraints_active(F.col("brand"), F.col("words"), F.col("low"), F.col("high"))
    return p.crossJoin(F.broadcast(req)).filter(ok).groupBy("request_id", active.alias("active")).agg(F.count(F.lit(1)).alias("n_parts"), F.min("p_partkey").alias("first_part"), F.round(F.avg("p_retailprice"), 4).alias("avg_price"))


def paged_lookup(spark, sf_dir):
    return R.page(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size"), "p_partkey", 20, 10, p_size=7)


def catalog_counts(spark, sf_dir):
    from larkspur.sources.tables import catalog_mode

    c = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("p_partkey").alias("n_ids"), F.sum(F.startswith("p_brand", F.lit("Brand#1")).cast("long")).alias("n_prefixed"))
    return c.withColumn("mode", catalog_mode(F.col("n_rows"), F.col("n_prefixed"), 367172))


TOK = "coalesce(regexp_extract_all(lower(text), '[a-z0-9]+'), [])"
INDEX = f"""toks AS (SELECT doc_id, {TOK} AS t FROM documents),
dl AS (SELECT doc_id, len(t) AS dl FROM toks), cs AS (SELECT count(*) AS n, coalesce(avg(dl), 0.0) AS a FROM dl),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term)"""
ASKED = f"asked AS (SELECT DISTINCT item_id AS query_id, unnest({TOK}) AS term FROM benchmark)"
BM25 = f"""{INDEX}, {ASKED},
bm AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score
  FROM asked JOIN post USING (term) JOIN dfs USING (term) JOIN dl USING (doc_id), cs GROUP BY ALL)"""
UNIT = "vecs AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
KNN = f"""{UNIT}, cosines AS (SELECT q.id // {EVERY} AS query_id, d.id AS doc_id, list_cosine_similarity(q.v, d.v) AS score FROM vecs q, vecs d WHERE q.id % {EVERY} = 0)"""


def _top(src: str, k: int, cols: str = "query_id, doc_id, score") -> str:
    return f"(SELECT {cols}, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {src} QUALIFY rank <= {k})"


HYBRID = f"""{BM25}, {KNN}, a AS {_top("bm", TOP_K)}, b AS {_top("cosines", TOP_K)},
h AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.score AS bm25_score, b.score AS vector_score, a.rank AS bm25_rank, b.rank AS vector_rank,
  coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS score, a.rank IS NOT NULL AND b.rank IS NOT NULL AS in_both
  FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id)"""

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_block_topk, block_reads, knn_cosine_topk, knn_index_topk, rrf_fusion_topk, hybrid_union, fusion_stats, postings_stats, term_df_idf, doc_length_stats, index_integrity, bm25_candidates_union, bm25_explicit_candidates, embedding_integrity, embedding_document_ids, post_filter_search, term_slice, facet_filter_all, paged_lookup, catalog_counts)}
ORACLE_SQL = {
    "bm25_topk": f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {_top('bm', TOP_K)}",
    "bm25_block_topk": f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {_top('bm', TOP_K)}",
    "block_reads": f"""WITH {BM25}, placed AS (SELECT doc_id, (row_number() OVER (ORDER BY dl DESC, doc_id) - 1) // {B.RANGE} AS rng FROM dl),
  blk AS (SELECT term, rng, max(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS impact FROM post JOIN dl USING (doc_id) JOIN placed USING (doc_id), cs GROUP BY ALL),
  bnd AS (SELECT query_id, rng, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * impact) AS bound, count(*) AS nb FROM asked JOIN dfs USING (term) JOIN blk USING (term), cs GROUP BY ALL),
  fst AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bound DESC, rng) AS i FROM bnd),
  sc AS (SELECT query_id, doc_id, score FROM bm JOIN placed USING (doc_id) JOIN fst USING (query_id, rng) WHERE i <= {B.PROBES}),
  flo AS (SELECT query_id, CASE WHEN count(*) = {TOP_K} THEN min(score) END AS floor FROM {_top('sc', TOP_K)} GROUP BY query_id)
  SELECT query_id, CAST(sum(nb) AS BIGINT) AS n_blocks, CAST(sum(nb) FILTER (i <= {B.PROBES} OR bound + {B.SLACK} >= coalesce(floor, 0)) AS BIGINT) AS n_read FROM fst LEFT JOIN flo USING (query_id) GROUP BY query_id""",
    "knn_cosine_topk": f"WITH {KNN} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {_top('cosines', TOP_K)}",
    "knn_index_topk": f"WITH {KNN} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {_top('cosines', TOP_K)}",
    "rrf_fusion_topk": f"WITH {HYBRID} SELECT query_id, doc_id, round(score, 6) AS score, rank, bm25_rank, vector_rank FROM {_top('h', TOP_K, 'query_id, doc_id, score, bm25_rank, vector_rank')}",
    "hybrid_union": f"WITH {HYBRID} SELECT query_id, doc_id, round(CASE WHEN in_both THEN 0.0 ELSE coalesce(bm25_score, vector_score) END, 6) AS union_score, round(bm25_score, 6) AS bm25_score, round(vector_score, 6) AS vector_score, in_both FROM h",
    "fusion_stats": f"WITH {HYBRID} SELECT query_id, count(bm25_rank) AS n_bm25, count(vector_rank) AS n_vector, count(*) AS n_pool, count(*) FILTER (in_both) AS n_overlap FROM h GROUP BY query_id",
    "postings_stats": f"WITH {INDEX} SELECT count(DISTINCT term) AS n_terms, count(*) AS n_postings, CAST(sum(tf) AS BIGINT) AS n_tokens, (SELECT n FROM cs) AS n_docs, round((SELECT a FROM cs), 6) AS avgdl, (SELECT count(*) FROM dl WHERE dl = 0) AS empty_docs FROM post",
    "term_df_idf": f"WITH {INDEX} SELECT term, df, cf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, cs",
    "doc_length_stats": f"SELECT lang, count(*) AS n_docs, CAST(sum(len({TOK})) AS BIGINT) AS n_tokens, min(len({TOK})) AS min_dl, max(len({TOK})) AS max_dl, round(avg(len({TOK})), 6) AS avg_dl FROM documents GROUP BY lang",
    "index_integrity": f"WITH {INDEX} SELECT count(*) FILTER (tf <= 0) AS bad_tf, count(*) - count(DISTINCT (term, doc_id)) AS repeated_postings, (SELECT count(*) - count(DISTINCT doc_id) FROM dl) AS repeated_docs, (SELECT count(*) FROM post ANTI JOIN dl USING (doc_id)) AS unknown_docs FROM post",
    "bm25_candidates_union": f"WITH {INDEX}, {ASKED} SELECT query_id, count(DISTINCT doc_id) AS n_candidates, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM asked JOIN post USING (term) GROUP BY query_id",
    "bm25_explicit_candidates": f"WITH {BM25}, c AS (SELECT item_id AS query_id, unnest(range(item_id, item_id + 10)) AS doc_id FROM benchmark) SELECT query_id, doc_id, round(coalesce(score, 0), 6) AS score FROM c SEMI JOIN documents USING (doc_id) LEFT JOIN bm USING (query_id, doc_id)",
    "embedding_integrity": "WITH v AS (SELECT vec_id, len(embedding) AS size, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) AS s, len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) AS odd FROM embeddings) SELECT count(*) AS n_rows, count(*) - count(DISTINCT vec_id) AS repeated_ids, count(*) FILTER (size <> 64) AS wrong_size, count(*) FILTER (odd > 0) AS not_finite, count(*) FILTER (s = 0) AS zero, count(*) FILTER (abs(sqrt(s) - 1) > 1e-3) AS not_unit, count(*) * 256 AS bytes FROM v",
    "embedding_document_ids": "SELECT 'vector_only' AS side, count(*) AS n, min(vec_id) AS first_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'document_only', count(*), min(doc_id) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "post_filter_search": f"WITH {BM25}, pool AS {_top('bm', 50)}, kept AS (SELECT query_id, doc_id, score, lang FROM pool JOIN documents USING (doc_id) WHERE lang = 'en') SELECT query_id, doc_id, lang, round(score, 6) AS score, rank FROM {_top('kept', 5, 'query_id, doc_id, lang, score')}",
    "term_slice": f"WITH t AS (SELECT DISTINCT term FROM (SELECT unnest({TOK}) AS term FROM benchmark)), hit AS (SELECT doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS n FROM documents, t WHERE contains(lower(text), term)) SELECT DISTINCT doc_id FROM hit WHERE n <= 5",
    "facet_filter_all": "WITH r(request_id, brand, words, low, high) AS (VALUES (1, 'Brand#1', NULL, NULL, NULL), (2, NULL, 'blue', NULL, 1200.0), (3, NULL, 'red,bolt', 950.0, 1500.0), (4, NULL, NULL, NULL, NULL)) SELECT request_id, coalesce(brand, words, CAST(low AS VARCHAR), CAST(high AS VARCHAR)) IS NOT NULL AS active, count(*) AS n_parts, min(p_partkey) AS first_part, round(avg(p_retailprice), 4) AS avg_price FROM part, r WHERE (brand IS NULL OR coalesce(brand = p_brand, false)) AND (words IS NULL OR list_has_all(string_split(p_name, ' '), string_split(words, ','))) AND (low IS NULL OR p_retailprice >= low) AND (high IS NULL OR p_retailprice <= high) GROUP BY ALL",
    "paged_lookup": "SELECT p_partkey, p_brand, p_type, p_size FROM part WHERE p_size = 7 ORDER BY p_partkey LIMIT 20 OFFSET 10",
    "catalog_counts": "SELECT count(*) AS n_rows, count(DISTINCT p_partkey) AS n_ids, count(*) FILTER (starts_with(p_brand, 'Brand#1')) AS n_prefixed, CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) = 367172 THEN 'full' WHEN count(*) <= 32 AND count(*) = n_prefixed THEN 'fixture' ELSE 'partial' END AS mode FROM part",
}
