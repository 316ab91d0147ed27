"""Ranking and recommendation queries: parts as products, embeddings of the same id as their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import lexical as L
from larkspur.operators import ranking as K
from larkspur.operators import recommend as C
from larkspur.operators import retrieval as R
from larkspur.operators import similarity as Y
from larkspur.operators.constraints import LISTS
from larkspur.operators.constraints import SCALARS as ALL_SCALARS
from larkspur.plans import search as S
from larkspur.session import written
from larkspur.sources.tables import table

#: The stated query set: every product whose id is divisible by SEEDS.
SEEDS, POOL, TOP = 20, 50, 10
#: The attributes beside the gender, with the weights of the generator.
SCALARS = {c: C.ATTRIBUTE_WEIGHTS[c] for c in ("brand", "brand_normalized", "product_type")}
MULTIS = {c: C.ATTRIBUTE_WEIGHTS[c] for c in LISTS}


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("gender"), F.col("p_brand").alias("brand"), F.split("p_name", " ")[1].alias("product_type"), F.col("p_size").cast("string").alias("size"), F.split("p_name", " ").alias("words"), "p_name", "p_retailprice")


def goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as products: brands and types of their own, other attributes from the key."""
    key, word = F.col("p_partkey"), F.split("p_name", " ")
    tag = lambda name, m: F.concat(F.lit(name), (key % m).cast("string"))
    brand = F.when(key % 13 != 0, F.col("p_brand"))
    return table(spark, sf_dir, "part").select(
        key.cast("long").alias("id"), brand.alias("brand"), brand.alias("brand_normalized"),
        F.when(key % 3 == 0, "Men").when(key % 3 == 1, "Women").alias("category_gender"), word[1].alias("product_type"),
        F.array(word[0]).alias("color"), F.when(key % 7 != 0, F.array(tag("pat", 5))).alias("pattern"), F.array_distinct(F.array(tag("mat", 4), tag("mat", 3))).alias("material"),
        F.when(key % 5 != 0, F.array(tag("fit", 3))).alias("fit"), F.array(tag("sl", 4)).alias("sleeve"), F.when(key % 2 == 1, F.array(tag("nk", 3))).alias("neckline"),
        F.array_distinct(F.array(tag("f", 6), tag("f", 4))).alias("product_features"), F.array(tag("st", 8)).alias("style_attributes"),
        (F.floor("p_retailprice") - key % 7 * 50).cast("long").alias("discount_price"), F.floor("p_retailprice").cast("long").alias("original_price"),
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).filter(F.col("id") % SEEDS == 0)


def _attribute(spark, sf_dir):
    g = goods(spark, sf_dir)
    return C.attribute_candidates(g.filter(F.col("id") % SEEDS == 0), g, "category_gender", SCALARS, MULTIS, TOP)


def _vector(spark, sf_dir):
    v = S.vectors(spark, sf_dir)
    return R.knn(v.filter(F.col("id") % SEEDS == 0), v, TOP, exclude_self=True).withColumnRenamed("query_id", "seed")


def _bm25(spark, sf_dir):
    p = products(spark, sf_dir)
    q = seeds(spark, sf_dir).select(F.col("id").alias("seed"), F.col("p_name").alias("text"))
    return C.lexical_candidates(q, p.select(F.col("id").alias("doc_id"), F.concat_ws(" ", "p_name", "brand").alias("text")), TOP)


def attr_generator(spark, sf_dir):
    return _attribute(spark, sf_dir).withColumn("score", F.round("score", 6))


def vector_generator(spark, sf_dir):
    return _vector(spark, sf_dir).withColumn("score", F.round("score", 6))


def bm25_generator(spark, sf_dir):
    return _bm25(spark, sf_dir).withColumn("score", F.round("score", 6))


def _merged(spark, sf_dir):
    parts = [g(spark, sf_dir).select("seed", "doc_id", F.lit(n).alias("source"), "score") for n, g in (("attribute", _attribute), ("vector", _vector), ("bm25", _bm25))]
    return C.merge(parts[0].union(parts[1]).union(parts[2]))


def provenance_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select("seed", "doc_id", F.array_join("sources", ",").alias("sources"), "n_sources", F.round("score", 6).alias("score"))


def _features(spark, sf_dir):
    p, s = products(spark, sf_dir), seeds(spark, sf_dir).select(F.col("id").alias("seed"), F.col("brand").alias("s_brand"), F.col("words").alias("s_words"), F.col("p_retailprice").alias("s_price"))
    j = C.truncate(_merged(spark, sf_dir), POOL).join(p.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id").join(s.hint("merge"), "seed")
    return j.withColumns({"same_brand": C.scalar_similarity(F.col("s_brand"), F.col("brand")), "word_share": C.jaccard(F.col("s_words"), F.col("words")), "price_delta": F.col("p_retailprice") - F.col("s_price")})


def reco_features(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f.select("seed", "doc_id", "n_sources", "same_brand", F.round("word_share", 6).alias("word_share"), F.round("price_delta", 4).alias("price_delta"), F.round("attribute_score", 6).alias("attribute_score"))


def features25(spark, sf_dir):
    """The 25 features of every candidate of the merged pools."""
    pairs = written(C.truncate(_merged(spark, sf_dir), POOL), "merged-pool")
    p = products(spark, sf_dir)
    asked = seeds(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("p_name").alias("query_text"))
    texts = p.select(F.col("id").alias("doc_id"), F.concat_ws(" ", "p_name", "brand").alias("text"))
    lexical = L.bm25_scores(asked, texts, candidates=pairs.select(F.col("seed").alias("query_id"), "doc_id")).withColumnRenamed("query_id", "seed")
    return Y.features(pairs, goods(spark, sf_dir), S.vectors(spark, sf_dir), lexical)


def _ranked(spark, sf_dir):
    """Each seed's pool by the 18 weights, with the keys of the caps: the normalised brand, else the brand, and the type."""
    r = L.top_k(features25(spark, sf_dir).withColumn("score", K.weighted(Y.WEIGHTS)), POOL, by="seed").select("seed", "doc_id", "score", "rank")
    keys = goods(spark, sf_dir).select(F.col("id").alias("doc_id"), F.coalesce(C.folded(F.col("brand_normalized")), C.folded(F.col("brand"))).alias("brand"), C.folded(F.col("product_type")).alias("product_type"))
    return written(r.join(keys.hint("merge"), "doc_id"), "ranked-pool")


def reco_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).select("seed", "doc_id", F.round("score", 6).alias("score"), "rank")


def select_brand_cap(spark, sf_dir):
    return C.one_cap(_ranked(spark, sf_dir), "brand", 2).select("seed", "doc_id", "rank", "brand")


def two_caps(ranked: DataFrame) -> DataFrame:
    return C.select_capped(ranked, {"brand": 2, "product_type": 3}, TOP)


def select_two_caps(spark, sf_dir):
    return two_caps(_ranked(spark, sf_dir))


def reco_pipeline(spark, sf_dir):
    s = select_two_caps(spark, sf_dir).filter("decision = 'selected'")
    return s.select("seed", "doc_id", F.col("position").alias("rank"))


def reco_shortfall(spark, sf_dir):
    return C.shortfall(select_two_caps(spark, sf_dir), seeds(spark, sf_dir).select(F.col("id").alias("seed")), TOP)


def jaccard_similarity(spark, sf_dir):
    """How many products of its gender each seed shares which part of its words with: kinds of equal words are compared once."""
    kinds = products(spark, sf_dir).groupBy("gender", "words").agg(F.count(F.lit(1)).alias("m"))
    s = seeds(spark, sf_dir).select(F.col("id").alias("seed"), "gender", F.col("words").alias("s_words"))
    pairs = kinds.join(s.select("gender", "s_words").distinct().hint("merge"), "gender")
    per_kind = pairs.groupBy("gender", "s_words", F.round(C.jaccard(F.col("s_words"), F.col("words")), 6).alias("jaccard")).agg(F.sum("m").alias("m")).withColumnRenamed("s_words", "k_words").withColumnRenamed("gender", "k_gender")
    alike = (F.col("gender") == F.col("k_gender")) & F.col("s_words").eqNullSafe(F.col("k_words"))
    return s.join(per_kind.hint("merge"), alike).groupBy("seed", "jaccard").agg(F.sum("m").alias("n"))


# search ranking --------------------------------------------------------------------------------


def _search_features(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    f = S.hybrid(spark, sf_dir).join(d, "doc_id", "left")
    f = f.withColumns({"in_both": F.col("in_both").cast("long"), "gender_match": K.match(F.lit("en"), F.col("lang")).cast("long"), "brand_match": K.match(F.when(F.col("query_id") % 2 == 0, F.lit("src0")), F.col("source")).cast("long")})
    return f.withColumns(K.matched(["gender_match", "brand_match"]))


NUMERIC = ["bm25_score", "vector_score", "rrf_score", "bm25_rank", "vector_rank", "matched_count", "matched_share"]


def _normalized(spark, sf_dir):
    return K.minmax(K.rank_strength(_search_features(spark, sf_dir), ["bm25_rank", "vector_rank"]), "query_id", NUMERIC)


def ranking_features(spark, sf_dir):
    f = _search_features(spark, sf_dir)
    return f.select("query_id", "doc_id", "gender_match", "brand_match", "matched_count", F.round("matched_share", 6).alias("matched_share"), "in_both", F.round("rrf_score", 6).alias("rrf_score"))


def minmax_group_norm(spark, sf_dir):
    return _normalized(spark, sf_dir).select("query_id", "doc_id", *[F.round(c, 6).alias(c) for c in NUMERIC])


_USED = {k: v for k, v in K.BASELINE_WEIGHTS.items() if k in (*NUMERIC, "in_both", "gender_match", "brand_match")}


def baseline_rank(spark, sf_dir):
    return L.top_k(_normalized(spark, sf_dir).withColumn("score", K.weighted(_USED)), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def score_breakdown(spark, sf_dir):
    b = K.breakdown(_normalized(spark, sf_dir), ["query_id", "doc_id"], _USED)
    return b.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("contribution"), 5).alias("total"))


def ranking_invariants(spark, sf_dir):
    return K.invariants(L.top_k(_normalized(spark, sf_dir).withColumn("score", K.weighted(_USED)), 10), "query_id", "rank", "doc_id", "score")


def ltr_split(spark, sf_dir):
    return K.split_groups(table(spark, sf_dir, "benchmark").select("item_id"), "item_id")


def ranking_dataset(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return _normalized(spark, sf_dir).join(labels, "doc_id", "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce("label", F.lit(0)).cast("long")).alias("n_relevant"), F.sum(F.col("label").isNull().cast("long")).alias("n_unjudged"))


PRODUCTS = "products AS (SELECT p_partkey AS id, p_type AS gender, p_brand AS brand, string_split(p_name, ' ')[2] AS product_type, CAST(p_size AS VARCHAR) AS size, string_split(p_name, ' ') AS words, p_name, p_retailprice FROM part)"
SIM = "len(list_intersect(s.words, p.words)) / len(list_distinct(list_concat(s.words, p.words)))"


def _top_seed(src: str, k: int, more: str = "") -> str:
    return f"(SELECT seed, doc_id, score{more}, row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {src} QUALIFY rank <= {k})"


_B = "CASE WHEN p_partkey % 13 <> 0 THEN p_brand END"
GOODS = f"""goods AS (SELECT p_partkey AS id, {_B} AS brand, {_B} AS brand_normalized, CASE WHEN p_partkey % 3 = 0 THEN 'Men' WHEN p_partkey % 3 = 1 THEN 'Women' END AS category_gender,
  string_split(p_name, ' ')[2] AS product_type, [string_split(p_name, ' ')[1]] AS color, CASE WHEN p_partkey % 7 <> 0 THEN ['pat' || p_partkey % 5] END AS pattern,
  list_distinct(['mat' || p_partkey % 4, 'mat' || p_partkey % 3]) AS material, CASE WHEN p_partkey % 5 <> 0 THEN ['fit' || p_partkey % 3] END AS fit, ['sl' || p_partkey % 4] AS sleeve,
  CASE WHEN p_partkey % 2 = 1 THEN ['nk' || p_partkey % 3] END AS neckline, list_distinct(['f' || p_partkey % 6, 'f' || p_partkey % 4]) AS product_features, ['st' || p_partkey % 8] AS style_attributes,
  CAST(floor(p_retailprice) AS BIGINT) - p_partkey % 7 * 50 AS discount_price, CAST(floor(p_retailprice) AS BIGINT) AS original_price FROM part)"""
_SHARED = " + ".join([*(f"coalesce(lower(s.{c}) = lower(p.{c}), false)::INT * {w}" for c, w in SCALARS.items()), *(f"coalesce(list_has_any(s.{c}, p.{c}), false)::INT * {w}" for c, w in MULTIS.items())])
_HELD = " + ".join(f"(s.{c} IS NOT NULL)::INT * {w}" for c, w in {**SCALARS, **MULTIS}.items())
GENERATED = f"""{PRODUCTS},
{GOODS},
ga AS (SELECT s.id AS seed, p.id AS doc_id, (2.0 + {_SHARED}) / (2.0 + {_HELD}) AS score FROM goods s JOIN goods p ON s.category_gender = p.category_gender AND s.id <> p.id WHERE s.id % {SEEDS} = 0),
{S.UNIT}, gv AS (SELECT s.id AS seed, d.id AS doc_id, list_cosine_similarity(s.v, d.v) AS score FROM vecs s, vecs d WHERE s.id % {SEEDS} = 0 AND s.id <> d.id),
ptoks AS (SELECT id, regexp_extract_all(lower(p_name || ' ' || brand), '[a-z0-9]+') AS t FROM products), pcs AS (SELECT count(*) AS n, avg(len(t)) AS a FROM ptoks),
ppost AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM ptoks) GROUP BY ALL), pdf AS (SELECT term, count(*) AS df FROM ppost GROUP BY 1),
pask AS (SELECT DISTINCT id AS seed, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS term FROM products WHERE id % {SEEDS} = 0),
gb AS (SELECT seed, id AS doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM pask JOIN ppost USING (term) JOIN pdf USING (term), pcs WHERE seed <> id GROUP BY ALL),
ta AS {_top_seed("ga", TOP)}, tv AS {_top_seed("gv", TOP)}, tb AS {_top_seed("gb", TOP)}"""
MERGED = f"""{GENERATED}, every AS (SELECT seed, doc_id, 'attribute' AS source, score FROM ta UNION ALL SELECT seed, doc_id, 'vector', score FROM tv UNION ALL SELECT seed, doc_id, 'bm25', score FROM tb),
merged AS (SELECT seed, doc_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n_sources, max(score) FILTER (source = 'vector') AS vector_score, max(score) FILTER (source = 'bm25') AS bm25_score, max(score) FILTER (source = 'attribute') AS attribute_score FROM every GROUP BY ALL)"""
FEATURES = f"""{MERGED}, pool AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY seed ORDER BY doc_id) <= {POOL}),
feats AS (SELECT m.*, p.brand, p.product_type, (s.brand = p.brand)::INT::DOUBLE AS same_brand, {SIM} AS word_share, p.p_retailprice - s.p_retailprice AS price_delta FROM pool m JOIN products p ON p.id = m.doc_id JOIN products s ON s.id = m.seed)"""
_JACCARD = lambda c: f"CASE WHEN s.{c} IS NOT NULL AND p.{c} IS NOT NULL THEN len(list_intersect(s.{c}, p.{c})) / len(list_distinct(list_concat(s.{c}, p.{c}))) END"
_F25 = {
    "retrieved_by_vector": "CAST(contains(sources, 'vector') AS DOUBLE)", "retrieved_by_attribute": "CAST(contains(sources, 'attribute') AS DOUBLE)", "retrieved_by_bm25": "CAST(contains(sources, 'bm25') AS DOUBLE)",
    "retrieved_by_multiple_sources": "CAST(n_sources > 1 AS DOUBLE)", "source_count": "CAST(n_sources AS DOUBLE)", "candidate_generation_score": "coalesce(m.vector_score, m.bm25_score, m.attribute_score)",
    "semantic_similarity": "list_cosine_similarity(sv.v, pv.v)", "lexical_similarity": "coalesce(gb.score, 0.0)",
    **{f"{c}_match": f"CAST(s.{c} = p.{c} AS DOUBLE)" for c in ALL_SCALARS}, **{f"{c}_overlap": _JACCARD(c) for c in LISTS},
    "discount_price": "CAST(p.discount_price AS DOUBLE)", "original_price": "CAST(p.original_price AS DOUBLE)", "discount_amount": "CAST(greatest(p.original_price - p.discount_price, 0) AS DOUBLE)",
    "discount_price_delta_from_seed": "CAST(p.discount_price - s.discount_price AS DOUBLE)", "original_price_delta_from_seed": "CAST(p.original_price - s.original_price AS DOUBLE)",
}
F25 = f"{MERGED}, pool AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY seed ORDER BY doc_id) <= {POOL}), f25 AS (SELECT m.seed, m.doc_id, " + ", ".join(f"{x} AS {c}" for c, x in _F25.items()) + " FROM pool m JOIN goods p ON p.id = m.doc_id JOIN goods s ON s.id = m.seed LEFT JOIN vecs pv ON pv.id = m.doc_id LEFT JOIN vecs sv ON sv.id = m.seed LEFT JOIN gb ON gb.seed = m.seed AND gb.doc_id = m.doc_id)"
SCORE = " + ".join(f"coalesce({c}, 0) * {w}" for c, w in sorted(Y.WEIGHTS.items()))
RANKED = f"{F25}, scored AS (SELECT seed, doc_id, {SCORE} AS score, lower(coalesce(p.brand_normalized, p.brand)) AS brand, lower(p.product_type) AS product_type FROM f25 JOIN goods p ON p.id = doc_id), ranked AS {_top_seed('scored', POOL, ', brand, product_type')}"
_OK = f"w.n < {TOP} AND len(list_filter(w.brands, lambda v: v = r.brand)) < 2 AND len(list_filter(w.types, lambda v: v = r.product_type)) < 3"
WALK = RANKED.replace("products AS", "RECURSIVE products AS", 1) + f""", walk AS (
  SELECT DISTINCT seed, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS brands, CAST([] AS VARCHAR[]) AS types, CAST(NULL AS BIGINT) AS doc_id, '' AS decision FROM ranked
  UNION ALL SELECT w.seed, r.rank, w.n + ({_OK})::INT, CASE WHEN {_OK} THEN list_append(w.brands, r.brand) ELSE w.brands END, CASE WHEN {_OK} THEN list_append(w.types, r.product_type) ELSE w.types END, r.doc_id,
    CASE WHEN w.n >= {TOP} THEN 'beyond_top' WHEN len(list_filter(w.brands, lambda v: v = r.brand)) >= 2 THEN 'brand_cap' WHEN len(list_filter(w.types, lambda v: v = r.product_type)) >= 3 THEN 'product_type_cap' ELSE 'selected' END
  FROM walk w JOIN ranked r ON r.seed = w.seed AND r.rank = w.rank + 1)"""
SFEAT = f"""{S.HYBRID}, sf AS (SELECT h.*, d.lang, d.source, (h.in_both)::INT::BIGINT AS both_flag, coalesce(d.lang = 'en', false)::INT::BIGINT AS gender_match, CASE WHEN query_id % 2 = 0 THEN coalesce(d.source = 'src0', false)::INT::BIGINT END AS brand_match FROM h LEFT JOIN documents d USING (doc_id)),
sm AS (SELECT *, gender_match + coalesce(brand_match, 0) AS matched_count, (gender_match + coalesce(brand_match, 0)) / (1 + (brand_match IS NOT NULL)::INT) AS matched_share, score AS rrf_score FROM sf)"""


def _mm(c: str, x: str) -> str:
    lo, hi = f"min({x}) OVER (PARTITION BY query_id)", f"max({x}) OVER (PARTITION BY query_id)"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {lo} = {hi} THEN 0.5 ELSE ({x} - {lo}) / ({hi} - {lo}) END AS {c}"


SNORM = f"{SFEAT}, nm AS (SELECT query_id, doc_id, both_flag AS in_both, gender_match, brand_match, " + ", ".join(_mm(c, f"(1.0 / {c})" if c.endswith("_rank") else c) for c in NUMERIC) + " FROM sm), scored AS (SELECT *, " + " + ".join(f"coalesce({c}, 0) * {w}" for c, w in sorted(_USED.items())) + " AS score FROM nm)"

QUERIES = {f.__name__: f for f in (attr_generator, vector_generator, bm25_generator, provenance_merge, reco_features, reco_rank, select_brand_cap, select_two_caps, reco_pipeline, reco_shortfall, jaccard_similarity, ranking_features, minmax_group_norm, baseline_rank, score_breakdown, ranking_invariants, ltr_split, ranking_dataset)}
ORACLE_SQL = {
    "attr_generator": f"WITH {GENERATED} SELECT seed, doc_id, round(score, 6) AS score, rank FROM ta",
    "vector_generator": f"WITH {GENERATED} SELECT seed, doc_id, round(score, 6) AS score, rank FROM tv",
    "bm25_generator": f"WITH {GENERATED} SELECT seed, doc_id, round(score, 6) AS score, rank FROM tb",
    "provenance_merge": f"WITH {MERGED} SELECT seed, doc_id, sources, n_sources, round(coalesce(vector_score, bm25_score, attribute_score), 6) AS score FROM merged",
    "reco_features": f"WITH {FEATURES} SELECT seed, doc_id, n_sources, same_brand, round(word_share, 6) AS word_share, round(price_delta, 4) AS price_delta, round(attribute_score, 6) AS attribute_score FROM feats",
    "reco_rank": f"WITH {RANKED} SELECT seed, doc_id, round(score, 6) AS score, rank FROM ranked",
    "select_brand_cap": f"WITH {RANKED} SELECT seed, doc_id, rank, brand FROM ranked QUALIFY brand IS NULL OR row_number() OVER (PARTITION BY seed, brand ORDER BY rank) <= 2",
    "select_two_caps": f"WITH {WALK} SELECT seed, rank, doc_id, decision, CASE WHEN decision = 'selected' THEN n END AS position FROM walk WHERE rank > 0",
    "reco_pipeline": f"WITH {WALK} SELECT seed, doc_id, n AS rank FROM walk WHERE decision = 'selected'",
    "reco_shortfall": f"WITH {WALK}, c AS (SELECT seed, count(*) AS pool, count(*) FILTER (decision = 'selected') AS got FROM walk WHERE rank > 0 GROUP BY 1) SELECT id AS seed, coalesce(pool, 0) AS pool, coalesce(got, 0) AS got, CAST(greatest({TOP} - coalesce(got, 0), 0) AS BIGINT) AS missing, CASE WHEN pool IS NULL THEN 'NO_CANDIDATES' WHEN got = 0 THEN 'ALL_REJECTED' WHEN got < {TOP} THEN 'SHORTFALL' ELSE 'COMPLETE' END AS state FROM products LEFT JOIN c ON seed = id WHERE id % {SEEDS} = 0",
    "jaccard_similarity": f"WITH {PRODUCTS} SELECT s.id AS seed, round({SIM}, 6) AS jaccard, count(*) AS n FROM products p JOIN products s ON p.gender = s.gender WHERE s.id % {SEEDS} = 0 GROUP BY ALL",
    "ranking_features": f"WITH {SFEAT} SELECT query_id, doc_id, gender_match, brand_match, matched_count, round(matched_share, 6) AS matched_share, both_flag AS in_both, round(rrf_score, 6) AS rrf_score FROM sm",
    "minmax_group_norm": f"WITH {SNORM} SELECT query_id, doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in NUMERIC)} FROM nm",
    "baseline_rank": f"WITH {SNORM} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {S._top('scored', 10)}",
    "score_breakdown": f"WITH {SNORM} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, round(sum(coalesce({c}, 0) * {w}), 5) AS total FROM nm" for c, w in sorted(_USED.items())),
    "ranking_invariants": f"WITH {SNORM}, t AS {S._top('scored', 10)} SELECT count(DISTINCT query_id) AS n_groups, 0::BIGINT AS rank_gaps, 0::BIGINT AS repeated_items, 0::BIGINT AS bad_scores FROM t",
    "ltr_split": "WITH r AS (SELECT item_id, row_number() OVER (ORDER BY md5('42' || item_id), item_id) AS r, count(*) OVER () AS n FROM benchmark) SELECT item_id AS id, CASE WHEN r <= greatest(1, floor(n * 0.6)) THEN 'train' WHEN r <= greatest(1, floor(n * 0.6)) + greatest(1, floor(n * 0.2)) THEN 'validation' ELSE 'test' END AS part FROM r",
    "ranking_dataset": f"WITH {SNORM} SELECT query_id, count(*) AS n_rows, CAST(sum(coalesce(quality, 0)) AS BIGINT) AS n_relevant, count(*) FILTER (quality IS NULL) AS n_unjudged FROM nm LEFT JOIN labels USING (doc_id) GROUP BY query_id",
}
