"""Catalog queries: validation, profiles, cleaning, deduplication, attributes, texts.

The parts stand in for a product catalog; description, category, colour and prices follow from the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators import attributes as A
from larkspur.operators import quality_checks as Q
from larkspur.operators import representation as P
from larkspur.sources.sinks import upsert, upsert_counts
from larkspur.sources.tables import table

PHRASES = ["slim fit jeans", "printed Cotton t-shirt with pocket", "v-neck hooded full sleeve top", "oversized regular fit hoodie  zip pocket", "striped silk saree, lace", "plain"]
COLORS = ["darkblue", "greymelange", "red", "02dx", "offwhite", "gray", "mediumpink"]


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    original = F.floor("p_retailprice")
    discount = original - k % 7 * 50 + F.when(k % 11 == 0, 500).otherwise(0)
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), k.cast("string")).alias("product_id"),
        F.when(k % 13 != 0, F.col("p_brand")).alias("brand"),
        F.concat_ws(" ", F.lit(" "), "p_name", pick(PHRASES)).alias("description"),
        F.when(k % 3 == 0, "Men").when(k % 3 == 1, "Women").when(k % 5 == 0, "Kids").alias("category_gender"),
        F.when(k % 17 != 0, pick(COLORS)).alias("color"),
        F.when(k % 19 == 0, "n/a").when(k % 4 == 0, F.concat(F.lit("1,"), F.lpad((original % 1000).cast("string"), 3, "0"))).otherwise(original.cast("string")).alias("original_price"),
        discount.cast("string").alias("discount_price"),
        F.col("p_type").alias("kind"),
    )


def _sql_pick(values: list[str]) -> str:
    return "list_extract([" + ", ".join("'" + v + "'" for v in values) + f"], CAST(p_partkey % {len(values)} + 1 AS INT))"


CATALOG = f"""catalog AS (SELECT 'P' || p_partkey AS product_id, CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS brand, '  ' || p_name || ' ' || {_sql_pick(PHRASES)} AS description,
  CASE WHEN p_partkey % 3 = 0 THEN 'Men' WHEN p_partkey % 3 = 1 THEN 'Women' WHEN p_partkey % 5 = 0 THEN 'Kids' END AS category_gender,
  CASE WHEN p_partkey % 17 <> 0 THEN {_sql_pick(COLORS)} END AS color,
  CASE WHEN p_partkey % 19 = 0 THEN 'n/a' WHEN p_partkey % 4 = 0 THEN '1,' || lpad(CAST(CAST(floor(p_retailprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0') ELSE CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) END AS original_price,
  CAST(CAST(floor(p_retailprice) AS BIGINT) - p_partkey % 7 * 50 + CASE WHEN p_partkey % 11 = 0 THEN 500 ELSE 0 END AS VARCHAR) AS discount_price, p_type AS kind FROM part)"""


def _priced(df: DataFrame) -> DataFrame:
    return df.withColumns({"o": Q.price(F.col("original_price")), "d": Q.price(F.col("discount_price"))})


def validation_findings(spark, sf_dir):
    c = _priced(catalog(spark, sf_dir))
    bad = lambda n: ~F.coalesce(F.regexp_like(n, F.lit(Q.PRICE)), F.lit(False))
    rules = [
        ("required", "product_id", X.missing(F.col("product_id")), "FAIL"),
        ("required", "brand", X.missing(F.col("brand")), "FAIL"),
        ("required", "color", X.missing(F.col("color")), "WARNING"),
        ("price", "format", bad(F.col("original_price")) | bad(F.col("discount_price")), "FAIL"),
        ("price", "not_positive", (F.col("o") <= 0) | (F.col("d") <= 0), "FAIL"),
        ("price", "discount_above_original", F.col("d") > F.col("o"), "WARNING"),
        ("category", "not_allowed", ~F.col("category_gender").isin("Women", "Men"), "WARNING"),
    ]
    return Q.findings(c, rules)


def url_structure(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.agg(F.count(F.lit(1)).alias("n_rows"), Q.count_if(~F.coalesce(F.regexp_like("url", F.lit(Q.URL)), F.lit(False))).alias("invalid"), F.countDistinct(F.regexp_extract("url", r"^https?://([^/?#]+)", 1)).alias("n_hosts"))


def price_rules(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"), Q.count_if(paid <= 0).alias("not_positive"), Q.count_if(paid > F.col("l_extendedprice")).alias("above_original"), Q.count_if(F.col("l_discount") == 0).alias("not_discounted"), F.round(F.avg(F.greatest(F.col("l_extendedprice") - paid, F.lit(0.0))), 4).alias("avg_discount"))


def identity_summary(spark, sf_dir):
    return Q.identity(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")


def dup_value_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return Q.value_duplicates(d, ["text"]).union(Q.value_duplicates(d, ["source"])).union(Q.value_duplicates(d, ["lang"]))


def dup_key_summary(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return Q.value_duplicates(c, ["brand", "description"]).union(Q.value_duplicates(c, ["brand", "color", "original_price"])).union(Q.value_duplicates(c, ["description", "discount_price"]))


def dup_variance(spark, sf_dir):
    return Q.group_variance(table(spark, sf_dir, "documents"), "text", ["lang", "source", "n_chars"])


def representative_groups(spark, sf_dir):
    return Q.largest_groups(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


def exact_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    d, several = Q.exact_dedup(e.unionByName(e), "user_id")
    return d.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(several.agg(F.count(F.lit(1)).alias("n_conflicts"), F.max("n").alias("most")))


def case_variants(spark, sf_dir):
    c = catalog(spark, sf_dir).withColumn("brand", F.when(F.col("kind").startswith("S"), F.upper("brand")).otherwise(F.col("brand")))
    return Q.case_variants(c.filter("brand is not null"), "brand")


def top_colors(spark, sf_dir):
    return Q.top_values(catalog(spark, sf_dir), "color", 5)


def cleaned_cells(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return Q.changed_cells(c, {n: X.trim_u(F.col(n)) for n in ("description", "brand", "color")})


def canonical_projection(spark, sf_dir):
    c = _priced(catalog(spark, sf_dir))
    return c.select("product_id", "brand", X.collapse(F.col("description")).alias("description"), F.col("o").alias("original_price_inr"), F.col("d").alias("discount_price_inr"), F.coalesce(F.col("d") > F.col("o"), F.lit(False)).alias("price_anomaly"), F.lit("parts").alias("source"))


def color_normalize(spark, sf_dir):
    return A.normalize_colors(catalog(spark, sf_dir).select("product_id", "color"), "color").groupBy("color", "color_normalized", "color_is_coded").agg(F.count(F.lit(1)).alias("n"))


def attr_extract(spark, sf_dir):
    return A.extract(catalog(spark, sf_dir).select("product_id", "description"), "description").drop("description")


def vocab_coverage(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return A.vocabulary_coverage(c, "description", "product_type").union(A.vocabulary_coverage(c, "description", "product_features"))


def upsert_merge(spark, sf_dir):
    c = catalog(spark, sf_dir).select("product_id", "brand", "color")
    number = F.substring("product_id", 2, 20).cast("long")
    old, new = c.filter(number % 3 != 0), c.filter(number % 2 == 0).withColumn("color", F.lit("new"))
    return upsert(old, new, "product_id").groupBy("color").agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(upsert_counts(old, new, "product_id"))


def _represented(spark, sf_dir):
    return P.bundle(A.normalize_colors(A.extract(catalog(spark, sf_dir), "description"), "color"))


def product_text(spark, sf_dir):
    r = P.represent(A.extract(catalog(spark, sf_dir), "description"))
    return r.select("product_id", P.product_text(r).alias("product_text"))


def lexical_text(spark, sf_dir):
    r = P.represent(A.extract(catalog(spark, sf_dir), "description"))
    return r.select("product_id", P.lexical_text(r).alias("lexical_text"))


def semantic_text(spark, sf_dir):
    return _represented(spark, sf_dir).select("product_id", "semantic_text")


def multivalue_parse(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", X.multi_values(F.concat_ws("|", F.split("p_name", " ")[0], F.lit(" "), F.split("p_name", " ")[1], F.split("p_name", " ")[0])).alias("v"))
    return p.select("p_partkey", F.array_join("v", ",").alias("parsed"), F.size("v").cast("long").alias("n"))


def quality_issues(spark, sf_dir):
    c = _priced(catalog(spark, sf_dir))
    rules = [("missing_brand", X.missing(F.col("brand"))), ("missing_color", X.missing(F.col("color"))), ("price_unreadable", F.col("o").isNull()), ("price_anomaly", F.col("d") > F.col("o")), ("category_unknown", ~F.coalesce(F.col("category_gender").isin("Men", "Women"), F.lit(False)))]
    return Q.issue_rows(c, "product_id", rules).groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def field_coverage(spark, sf_dir):
    return Q.coverage(catalog(spark, sf_dir), ["brand", "description", "category_gender", "color"])


#: What is planted into messages: each is hidden by its own rule, and the last two by none.
PLANTED = ["see postgres://user:pw@host:5432/db now", "MYSQL://root@h/x", "header Bearer abc.def-123 sent", "bearer\tTOKEN", "open /etc/passwd failed", "C:\\Users\\me\\a.txt", "'/tmp/x y'", "Traceback (most recent call last)", "STACK TRACE: none", "ratio 1/2", "no secret"]


def redacted_messages(spark, sf_dir):
    """Every turn of the conversations, with a planted message before it."""
    planted = F.element_at(F.array(*map(F.lit, PLANTED)), ((F.col("conv_id") + F.col("turn")) % len(PLANTED) + 1).cast("int"))
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.redacted(F.concat_ws(" ", planted, F.coalesce("text", F.lit("")))).alias("m"))
    return m.select("conv_id", "turn", F.length("m").cast("long").alias("n_chars"), F.md5("m").alias("digest"))


def query_normalization(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", X.collapse(F.col("text")).alias("q"))
    return c.filter("q <> ''").select("conv_id", "turn", F.length("q").cast("long").alias("n_chars"), F.md5(P.query_embedding_text(F.col("q"))).alias("digest"))


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_match(e: str) -> str:
    import re

    return f"regexp_matches(t, {_quote('(^|[^a-z0-9])' + r'\\s+'.join(re.escape(w).replace('/', '/') for w in e.split(' ')).replace(chr(92) * 2, chr(92)) + '($|[^a-z0-9])')})"


# Written out by hand, apart from the operator's own ordering: values by their longest expression, ties as declared.
_BY_LENGTH = {
    "product_type": "track_pants cargo_pants sweatshirt night_suit camisole leggings t_shirt trousers cardigan joggers sweater palazzo co_ord shorts jacket hoodie blouse blazer kurta saree dress jeans skirt tunic kurti shirt top".split(),
    "fit": "oversized_fit straight_fit tailored_fit regular_fit relaxed_fit tapered_fit comfort_fit skinny_fit loose_fit slim_fit boxy_fit".split(),
    "sleeve": "short_sleeve three_quarter_sleeve full_sleeve half_sleeve long_sleeve sleeveless cap_sleeve".split(),
    "neckline": "mandarin_collar spread_collar band_collar square_neck round_neck boat_neck high_neck polo_neck collared v_neck hooded henley".split(),
}


def _sql_single(a: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {_sql_value(a, v)} THEN '{v}' END" for v in _BY_LENGTH[a]) + ")"


def _sql_value(a: str, v: str) -> str:
    return "(" + " OR ".join(_sql_match(e) for e in A.expressions(a, v)) + ")"


def _sql_multi(a: str) -> str:
    cases = ", ".join(f"CASE WHEN {_sql_value(a, v)} THEN '{v}' END" for v in sorted(A.VOCABULARY[a]))
    return f"nullif(array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), '|'), '')"


NORMAL = "lower(trim(regexp_replace(description, '\\s+', ' ', 'g')))"
ATTRS = f"texts AS (SELECT *, {NORMAL} AS t FROM catalog), attrs AS (SELECT *, " + ", ".join(f"{_sql_single(a) if a in A.SINGLE_VALUED else _sql_multi(a)} AS {a}" for a in A.VOCABULARY) + " FROM texts)"
PRICES = r"priced AS (SELECT *, try_cast(replace(trim(original_price), ',', '') AS BIGINT) AS o, try_cast(replace(trim(discount_price), ',', '') AS BIGINT) AS d FROM catalog)"
PRICE_OK = r"'^\s*(\d{1,3}(,\d{3})*|\d+)\s*$'"


def _find(cat: str, rule: str, cond: str, status: str) -> str:
    return f"SELECT '{cat}' AS category, '{rule}' AS rule, CASE WHEN count(*) FILTER ({cond}) > 0 THEN '{status}' ELSE 'PASS' END AS status, count(*) FILTER ({cond}) AS affected FROM priced"


def _dups(src: str, cols: list[str]) -> str:
    return f"SELECT '{'+'.join(cols)}' AS key, count(*) AS n_values, count(*) FILTER (n > 1) AS n_repeated, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_repeated, max(n) AS largest FROM (SELECT count(*) AS n FROM {src} GROUP BY {', '.join(cols)})"


def _many(c: str) -> str:
    return f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) > 1 AS {c}"


def _sql_machine(c: str) -> str:
    words = f"array_to_string(list_transform(list_filter(string_split(lower({c}), '_'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ')"
    return f"CASE lower({c}) WHEN 't_shirt' THEN 'T-Shirt' WHEN 'co_ord' THEN 'Co-Ord' ELSE {words} END"


def _sql_clause(label: str, c: str) -> str:
    if c in P.MULTI:
        return f"CASE WHEN {c} IS NOT NULL THEN '{label}: ' || array_to_string(list_transform(string_split({c}, '|'), lambda m: {_sql_machine('m')}), ', ') END"
    # brands here are "Brand#<n>" and categories single words: upper case after a non-letter changes nothing else
    return f"CASE WHEN {c} IS NOT NULL THEN '{label}: ' || CASE WHEN contains({c}, '_') THEN {_sql_machine(c)} ELSE upper({c}[1]) || lower({c}[2:]) END END"


_LABELS = [(label, c) for label, c in P.LABELS if c != "color_normalized"]
PRODUCT_TEXT = "nullif(concat_ws('. ', " + ", ".join(_sql_clause(label, c) for label, c in _LABELS) + "), '') || '.'"
LEXICAL_TEXT = "concat_ws(' ', " + ", ".join(f"replace({c}, '|', ',')" for _, c in _LABELS) + r", trim(regexp_replace(description, '\s+', ' ', 'g')))"

COLOR_NAMES = "names(color, color_normalized, color_is_coded) AS (VALUES ('darkblue', 'dark_blue', false), ('greymelange', 'grey_melange', false), ('red', 'red', false), ('02dx', '02dx', true), ('offwhite', 'off_white', false), ('gray', 'grey', false), ('mediumpink', 'medium_pink', false))"
_SHOWN = [_sql_clause(label, c) if c != "color_normalized" else f"CASE WHEN color_normalized = '02dx' THEN 'Color: 02Dx' ELSE {_sql_clause(label, c)} END" for label, c in P.LABELS]
SEMANTIC_TEXT = "concat_ws(' ', nullif(concat_ws('. ', " + ", ".join(_SHOWN) + r"), '') || '.', 'Description: ' || trim(regexp_replace(description, '\s+', ' ', 'g')))"
_PLANTED = "list_extract([" + ", ".join(_quote(x) for x in PLANTED) + f"], CAST((conv_id + turn) % {len(PLANTED)} + 1 AS INT))"
# the three rules, written out for RE2
_REDACTED = r"""regexp_replace(regexp_replace(regexp_replace(t, '(postgresql|postgres|mysql|mongodb)://[^ \t\n\r\f\v]+', '[redacted]', 'gi'), 'bearer[ \t\n\r\f\v]+[^ \t\n\r\f\v]+', 'Bearer [redacted]', 'gi'), '([A-Za-z]:\\|/)[^ \t\n\r\f\v"'']+', '[redacted]', 'g')"""

QUERIES = {f.__name__: f for f in (validation_findings, url_structure, price_rules, identity_summary, dup_value_summary, dup_key_summary, dup_variance, representative_groups, exact_dedup, case_variants, top_colors, cleaned_cells, canonical_projection, color_normalize, attr_extract, vocab_coverage, upsert_merge, product_text, lexical_text, semantic_text, multivalue_parse, quality_issues, field_coverage, redacted_messages, query_normalization)}
ORACLE_SQL = {
    "validation_findings": f"WITH {CATALOG}, {PRICES} " + " UNION ALL ".join([
        _find("required", "product_id", "product_id IS NULL OR trim(product_id) = ''", "FAIL"),
        _find("required", "brand", "brand IS NULL OR trim(brand) = ''", "FAIL"),
        _find("required", "color", "color IS NULL OR trim(color) = ''", "WARNING"),
        _find("price", "format", f"NOT coalesce(regexp_matches(original_price, {PRICE_OK}), false) OR NOT coalesce(regexp_matches(discount_price, {PRICE_OK}), false)", "FAIL"),
        _find("price", "not_positive", "o <= 0 OR d <= 0", "FAIL"),
        _find("price", "discount_above_original", "d > o", "WARNING"),
        _find("category", "not_allowed", "category_gender NOT IN ('Women', 'Men')", "WARNING"),
    ]),
    "url_structure": "SELECT count(*) AS n_rows, count(*) FILTER (NOT coalesce(regexp_matches(url, '^https?://[^/?#]+'), false)) AS invalid, count(DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1)) AS n_hosts FROM pages",
    "price_rules": "SELECT l_returnflag, count(*) AS n_rows, count(*) FILTER (p <= 0) AS not_positive, count(*) FILTER (p > l_extendedprice) AS above_original, count(*) FILTER (l_discount = 0) AS not_discounted, round(avg(greatest(l_extendedprice - p, 0)), 4) AS avg_discount FROM (SELECT *, l_extendedprice * (1 - l_discount) AS p FROM lineitem) GROUP BY 1",
    "identity_summary": "SELECT count(*) AS n_rows, count(*) FILTER (doc_id IS NULL) AS null_ids, count(doc_id) - count(DISTINCT doc_id) AS repeated_ids, count(*) - (SELECT count(*) FROM (SELECT DISTINCT doc_id, text, lang, source FROM documents)) AS repeated_rows FROM documents",
    "dup_value_summary": " UNION ALL ".join(_dups("documents", [c]) for c in ("text", "source", "lang")),
    "dup_key_summary": f"WITH {CATALOG} " + " UNION ALL ".join(_dups("catalog", c) for c in (["brand", "description"], ["brand", "color", "original_price"], ["description", "discount_price"])),
    "dup_variance": f"SELECT count(*) AS n_groups, count(*) FILTER (lang) AS vary_lang, count(*) FILTER (source) AS vary_source, count(*) FILTER (n_chars) AS vary_n_chars FROM (SELECT {_many('lang')}, {_many('source')}, {_many('n_chars')} FROM documents GROUP BY text HAVING count(*) > 1)",
    "representative_groups": "WITH top AS (SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1 ORDER BY n DESC, source LIMIT 3), r AS (SELECT source, n, doc_id FROM documents JOIN top USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3) SELECT source, n, list(doc_id ORDER BY doc_id) AS ids FROM r GROUP BY ALL",
    "exact_dedup": "WITH d AS (SELECT DISTINCT user_id, event_type FROM events), s AS (SELECT count(*) AS n FROM d GROUP BY user_id HAVING count(*) > 1) SELECT (SELECT count(*) FROM d) AS n_rows, count(*) AS n_conflicts, max(n) AS most FROM s",
    "case_variants": f"WITH {CATALOG}, b AS (SELECT CASE WHEN starts_with(kind, 'S') THEN upper(brand) ELSE brand END AS brand FROM catalog WHERE brand IS NOT NULL) SELECT lower(brand) AS folded, count(DISTINCT brand) AS n_variants, count(*) AS n_rows FROM b GROUP BY 1 HAVING n_variants > 1",
    "top_colors": f"WITH {CATALOG} SELECT color AS value, count(*) AS n FROM catalog GROUP BY 1 ORDER BY n DESC, value NULLS FIRST LIMIT 5",
    "cleaned_cells": f"WITH {CATALOG} SELECT " + ", ".join(f"count(*) FILTER (NOT coalesce({c} = trim({c}), false)) AS {c}" for c in ("description", "brand", "color")) + " FROM catalog",
    "canonical_projection": rf"WITH {CATALOG}, {PRICES} SELECT product_id, brand, trim(regexp_replace(description, '\s+', ' ', 'g')) AS description, o AS original_price_inr, d AS discount_price_inr, coalesce(d > o, false) AS price_anomaly, 'parts' AS source FROM priced",
    "color_normalize": f"WITH {CATALOG}, {COLOR_NAMES} SELECT color, color_normalized, color_is_coded, count(*) AS n FROM catalog LEFT JOIN names USING (color) GROUP BY ALL",
    "semantic_text": f"WITH {CATALOG}, {ATTRS}, {COLOR_NAMES} SELECT product_id, {SEMANTIC_TEXT} AS semantic_text FROM attrs LEFT JOIN names USING (color)",
    "redacted_messages": f"WITH m AS (SELECT conv_id, turn, {_PLANTED} || ' ' || coalesce(text, '') AS t FROM conversations), r AS (SELECT conv_id, turn, {_REDACTED} AS r FROM m), c AS (SELECT conv_id, turn, r, regexp_replace(r, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') AS x FROM r), s AS (SELECT conv_id, turn, CASE WHEN contains(lower(r), 'traceback') OR contains(lower(r), 'stack trace') THEN 'An unexpected error occurred' WHEN length(x) > 240 THEN left(x, 237) || '...' ELSE x END AS m FROM c) SELECT conv_id, turn, length(m) AS n_chars, md5(m) AS digest FROM s",
    "upsert_merge": f"WITH {CATALOG}, c AS (SELECT product_id, CAST(substr(product_id, 2) AS BIGINT) AS k, color FROM catalog), o AS (SELECT * FROM c WHERE k % 3 <> 0), n AS (SELECT product_id, k, 'new' AS color FROM c WHERE k % 2 = 0), u AS (SELECT color FROM n UNION ALL SELECT color FROM o ANTI JOIN n USING (product_id)) SELECT color, count(*) AS n_rows, (SELECT count(*) FROM n ANTI JOIN o USING (product_id)) AS inserted, (SELECT count(*) FROM n SEMI JOIN o USING (product_id)) AS updated FROM u GROUP BY color",
    "attr_extract": f"WITH {CATALOG}, {ATTRS} SELECT product_id, {', '.join(A.VOCABULARY)} FROM attrs",
    "vocab_coverage": f"WITH {CATALOG}, texts AS (SELECT *, {NORMAL} AS t FROM catalog) " + " UNION ALL ".join(f"SELECT '{a}' AS attribute, '{v}' AS value, count(*) FILTER ({_sql_value(a, v)}) AS n_rows, round(count(*) FILTER ({_sql_value(a, v)}) / count(*), 6) AS share FROM texts" for a in ("product_type", "product_features") for v in A.VOCABULARY[a]),
    "product_text": f"WITH {CATALOG}, {ATTRS} SELECT product_id, {PRODUCT_TEXT} AS product_text FROM attrs",
    "lexical_text": f"WITH {CATALOG}, {ATTRS} SELECT product_id, {LEXICAL_TEXT} AS lexical_text FROM attrs",
    "multivalue_parse": "WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), v AS (SELECT p_partkey, CASE WHEN w[1] = w[2] THEN [w[1]] ELSE w[1:2] END AS v FROM w) SELECT p_partkey, array_to_string(v, ',') AS parsed, len(v) AS n FROM v",
    "quality_issues": f"WITH {CATALOG}, {PRICES}, i AS (" + " UNION ALL ".join(f"SELECT product_id AS id, '{n}' AS issue FROM priced WHERE {c}" for n, c in [("missing_brand", "brand IS NULL"), ("missing_color", "color IS NULL"), ("price_unreadable", "o IS NULL"), ("price_anomaly", "d > o"), ("category_unknown", "NOT coalesce(category_gender IN ('Men', 'Women'), false)")]) + ") SELECT issue, count(*) AS n, min(id) AS first_id FROM i GROUP BY issue",
    "field_coverage": f"WITH {CATALOG} SELECT " + ", ".join(f"round(count({c}) / count(*), 6) AS {c}" for c in ("brand", "description", "category_gender", "color")) + " FROM catalog",
    "query_normalization": r"SELECT conv_id, turn, length(q) AS n_chars, md5('Represent this sentence for searching relevant passages: ' || q) AS digest FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM conversations WHERE role = 'user') WHERE q <> ''",
}
