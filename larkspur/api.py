"""Search and recommendation over a catalog as two calls, each a declared plan that the caller collects or writes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import block_index as B
from larkspur.operators import constraints as C
from larkspur.operators import lexical as L
from larkspur.operators import recommend as M
from larkspur.operators import retrieval as R
from larkspur.operators import similarity as Y
from larkspur.operators.ranking import weighted
from larkspur.operators.representation import structured_text
from larkspur.sources.sinks import index_tables, publish_index

_KINDS = {**dict.fromkeys(C.SCALARS, "string"), **dict.fromkeys(C.LISTS, "array<string>"), **dict.fromkeys(C.BOUNDS, "long")}


@dataclass
class Engine:
    """A catalog (id, text, the attributes and prices of the constraints), its published lexical index, and unit vectors (id, v).

    encode turns a query's text into a vector of the catalog's kind; without it, search is lexical alone.
    """

    catalog: DataFrame
    index: str
    vectors: DataFrame | None = None
    encode: Callable[[str], list[float]] | None = None
    pool: int = 50
    caps: dict[str, int] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.catalog.sparkSession

    @classmethod
    def build(cls, catalog: DataFrame, path: str, **more) -> Engine:
        """Publishes the lexical index of the catalog's texts at path."""
        rows = L.token_rows(catalog, "id", "text")
        publish_index(L.postings(rows), L.doc_stats(rows), L.corpus_stats(L.doc_stats(rows)), path)
        B.publish_blocks(B.build(catalog, "id", "text"), f"{path}/ranked")
        return cls(catalog, path, **more)

    def _request(self, filters: dict | None) -> DataFrame:
        unknown = set(filters or {}) - set(_KINDS)
        if unknown:
            raise ValueError(f"unknown filters {sorted(unknown)}")
        gender = (filters or {}).get("category_gender")
        if gender is not None and gender.strip().lower() not in C.GENDERS:
            raise ValueError(f"unknown gender {gender!r}")
        low, high = ((filters or {}).get(b) for b in C.BOUNDS)
        if low is not None and high is not None and low > high:
            raise ValueError("the lowest price is above the highest")
        schema = ", ".join(["query_id long", *[f"{C.ASKED}{c} {k}" for c, k in _KINDS.items()]])
        return self.spark.createDataFrame([(0, *[(filters or {}).get(c) for c in _KINDS])], schema)

    def _checked(self, top_k: int) -> None:
        if top_k < 1:
            raise ValueError("top_k must be 1 or more")
        if top_k > self.pool:
            raise ValueError(f"top_k must be {self.pool}, the size of the pools, or less")

    def product(self, product_id) -> DataFrame:
        return self.catalog.filter(F.col("id") == F.lit(product_id))

    def search(self, query: str, top_k: int = 10, filters: dict | None = None) -> DataFrame:
        """(doc_id, score, rank): the best of the lexical list, fused with the vectors' where queries can be encoded; filters apply to the pool."""
        if not query.strip():
            raise ValueError("blank query")
        self._checked(top_k)
        request = self._request(filters)
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query_text string")
        found = B.search(asked, B.stored(self.spark, f"{self.index}/ranked"), self.pool)
        if self.encode and self.vectors is not None:
            vector = self.spark.createDataFrame([(0, [float(x) for x in self.encode(query)])], "id long, v array<double>")
            near = R.knn(R.unit(vector, "id", "v"), self.vectors, self.pool)
            found = R.fused(found, near).withColumn("score", F.col("rrf_score"))
        kept = C.filter_candidates(found.select("query_id", "doc_id", "score"), request, self.catalog)
        return L.top_k(kept, top_k).select("doc_id", "score", "rank")

    def recommend(self, seed, top_k: int = 10, filters: dict | None = None) -> DataFrame:
        """(doc_id, score, rank): candidates alike by attributes, text and vector, by the weighted features, under the caps by brand and type."""
        self._checked(top_k)
        request, one = self._request(filters), self.product(seed)
        parts = [M.attribute_candidates(one, self.catalog, "category_gender", {c: M.ATTRIBUTE_WEIGHTS[c] for c in ("brand", "brand_normalized", "product_type")}, {c: M.ATTRIBUTE_WEIGHTS[c] for c in C.LISTS}, self.pool).withColumn("source", F.lit("attribute"))]
        # the seed's attributes alone, without its description
        asked = one.select(F.col("id").alias("query_id"), structured_text(one).alias("query_text"))
        lexical = L.index_scores(asked, *index_tables(self.spark, self.index)).filter("query_id <> doc_id")
        parts.append(L.top_k(lexical, self.pool).withColumnRenamed("query_id", "seed").withColumn("source", F.lit("bm25")))
        vectors = self.vectors if self.vectors is not None else self.spark.createDataFrame([], "id long, v array<double>")
        parts.append(R.knn(vectors.filter(F.col("id") == F.lit(seed)), vectors, self.pool, exclude_self=True).withColumnRenamed("query_id", "seed").withColumn("source", F.lit("vector")))
        rows = [p.select("seed", "doc_id", "source", "score") for p in parts]
        pairs = M.truncate(M.merge(rows[0].unionByName(rows[1]).unionByName(rows[2])), self.pool)
        kept = C.filter_candidates(pairs.withColumn("query_id", F.lit(0).cast("long")), request, self.catalog).drop("query_id")
        scored = Y.features(kept, self.catalog, vectors, lexical.withColumnRenamed("query_id", "seed")).withColumn("score", weighted(Y.WEIGHTS)).select("seed", "doc_id", "score")
        ranked = L.top_k(scored, self.pool, by="seed")
        caps = self.caps if self.caps is not None else {"brand": 2, "product_type": 3}
        key = {c: M.folded(F.col(c)) for c in caps}
        if "brand" in caps:
            key["brand"] = F.coalesce(M.folded(F.col("brand_normalized")), M.folded(F.col("brand")))
        keyed = ranked.join(self.catalog.select(F.col("id").alias("doc_id"), *[v.alias(c) for c, v in key.items()]), "doc_id")
        chosen = M.select_capped(keyed, caps, top_k).filter("decision = 'selected'")
        return chosen.join(ranked.select("doc_id", "score"), "doc_id").select("doc_id", "score", F.col("position").alias("rank"))
