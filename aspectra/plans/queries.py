"""The registered queries of the review engine, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions import text as X
from aspectra.functions.vectors import cosine_distance
from aspectra.operators import catalog, chunking, dedup, integrity, media, reviews, search, sessions
from aspectra.plans import providers
from aspectra.plans.constants import KEYWORDS, UNIT_PATTERNS
from aspectra.session import scratch_folder, ship_code, table, with_conf
from aspectra.sources import html as H

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Words of the test corpus by aspect; the product keywords hardly occur in it.
CORPUS_KEYWORDS = {"camera": ["the", "la"], "battery": ["thing", "über"], "display": ["réer", "der"], "storage": ["of the", "del"]}


def query(sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return add


def _sql_boundary(words: list[str]) -> str:
    quoted = "|".join(w.replace("'", "''") for w in words)
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])(?:{quoted})($|[^\p{{L}}\p{{N}}_])"


def _sql_hit(aspect: str, words: list[str], column: str) -> str:
    units = "".join(f" OR regexp_matches({column}, '{X.unit_pattern(u)}')" for u in UNIT_PATTERNS.get(aspect, []))
    return f"(regexp_matches({column}, '{_sql_boundary(words)}'){units})"


def _sql_tags(source: str, key: str, column: str, keywords: dict[str, list[str]]) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{a}' AS aspect FROM {source} WHERE {_sql_hit(a, w, column)}" for a, w in keywords.items())


# Vector search



@query(
    """
    WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 1),
    c AS (SELECT vec_id AS chunk_id, 'text ' || (vec_id % 40) AS chunk_text, 1 - list_cosine_similarity(embedding::DOUBLE[], q) AS d
          FROM embeddings, q WHERE label = 3 AND vec_id % 2 = 1),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY d, chunk_id) AS r FROM c) WHERE r <= 50),
    u AS (SELECT *, row_number() OVER (PARTITION BY chunk_text ORDER BY d, chunk_id) AS copy FROM f)
    SELECT chunk_id, chunk_text, round(d, 6) AS distance, CAST(row_number() OVER (ORDER BY d, chunk_id) AS INT) AS rank
    FROM u WHERE copy = 1 QUALIFY rank <= 10
    """
)
def comment_semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest comments of one product and aspect; labels stand for dims, odd ids belong to the camera."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("label = 3").orderBy("vec_id").first()
    held = vectors.select(
        F.col("vec_id").alias("chunk_id"),
        F.col("label").alias("dim_id"),
        F.when(F.col("vec_id") % 2 == 1, F.lit("dim_camera")).otherwise(F.lit("dim_display")).alias("dim_table"),
        F.concat(F.lit("text "), F.col("vec_id") % 40).alias("chunk_text"),
        "embedding",
    )
    dims = vectors.select(F.col("label").alias("dim_id"), F.col("label").alias("product_id")).distinct()
    found = search.nearest_comments(held, dims, 3, "camera", asked["embedding"] if asked else [1.0], top=10)
    return found.select("chunk_id", "chunk_text", F.round("distance", 6).alias("distance"), F.col("rank").cast("int"))


@query(
    """
    WITH q AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings GROUP BY label)
    SELECT label, vec_id, round(d, 6) AS distance, CAST(rank AS INT) AS rank FROM (
      SELECT e.label, vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], q) AS d,
        row_number() OVER (PARTITION BY e.label ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q), vec_id) AS rank
      FROM embeddings e JOIN q ON e.label = q.label) WHERE rank <= 5
    """
)
def vector_topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    found = search.nearest_per_group(vectors, asked, "label", "embedding", "q", "vec_id", 5)
    return found.select("label", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("int"))


@query(
    """
    WITH h AS (SELECT label, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 6),
    m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM h, range(1, 65) t(i) GROUP BY label, i),
    n AS (SELECT label, sqrt(sum(x * x)) + 1e-12 AS n FROM m GROUP BY label),
    q AS (SELECT label, list(x / n ORDER BY i) AS q FROM m JOIN n USING (label) GROUP BY label)
    SELECT label, vec_id, round(d, 6) AS distance, CAST(rank AS INT) AS rank FROM (
      SELECT e.label, vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], q) AS d,
        row_number() OVER (PARTITION BY e.label ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q), vec_id) AS rank
      FROM embeddings e JOIN q ON e.label = q.label) WHERE rank <= 10
    """
)
def hyde_mean_query_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's query is the unit mean of six vectors: a question and five hypothetical comments."""
    vectors = table(spark, sf_dir, "embeddings")
    six = dedup.cap_per_group(vectors, "label", ["vec_id"], 6)
    means = search.mean_vector(six, "label", "embedding")
    found = search.nearest_per_group(vectors, means, "label", "embedding", "mean", "vec_id", 10)
    return found.select("label", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("int"))


@query()
def random_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.random_rows(table(spark, sf_dir, "embeddings").where("label = 2"), 20, seed=1).select("vec_id", "label")


# Product search and lists


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), "p_type", "p_size", F.col("p_retailprice").alias("price")
    )


_TRIGRAMS = r"""list_distinct(flatten(list_transform(list_filter(string_split_regex(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: length(w) > 0),
    lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"""


@query(
    f"""
    WITH t AS (SELECT p_partkey AS product_id, p_name AS product_name, {_TRIGRAMS.format("p_name")} AS a, {_TRIGRAMS.format("'large widgets'")} AS b FROM part)
    SELECT product_id, product_name, round(s, 6) AS similarity FROM (
      SELECT *, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS s FROM t)
    WHERE s > 0.1 ORDER BY s DESC, product_id LIMIT 5
    """
)
def product_search_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_trigram(_parts(spark, sf_dir), "large widgets")
    return found.select("product_id", "product_name", F.round("similarity", 6).alias("similarity"))


@query(
    f"""
    WITH t AS (SELECT p_partkey AS k, p_name, {_TRIGRAMS.format("p_name")} AS g FROM part),
    s AS (SELECT q.k AS query_id, t.k AS product_id, len(list_intersect(q.g, t.g)) / len(list_distinct(list_concat(q.g, t.g))) AS s FROM t AS q JOIN t ON true WHERE q.k % 20 = 0)
    SELECT query_id, product_id, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, product_id) AS INT) AS rank
    FROM s WHERE s > 0.3 QUALIFY rank <= 5
    """
)
def product_search_trigram_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of every twentieth part, sought in the whole catalogue at once."""
    from aspectra.operators.trigram_index import search_trigrams

    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), "p_name")
    asked = parts.where("product_id % 20 = 0").select(F.col("product_id").alias("query_id"), F.col("p_name").alias("asked"))
    found = search_trigrams(parts, asked, "product_id", "p_name", "query_id", "asked", 0.3)
    return found.select("query_id", "product_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("int"))


@query(
    """
    WITH s AS (SELECT e.label, q.vec_id AS query_id, e.vec_id, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d FROM embeddings q JOIN embeddings e ON e.label = q.label WHERE q.vec_id % 20 = 0)
    SELECT label, query_id, vec_id, round(d, 6) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(d, 6), vec_id) AS INT) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) <= 5
    """
)
def vector_topk_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of a label to each of its vectors whose id is divisible by 20."""
    from aspectra.operators.vector_blocks import nearest_in_blocks

    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select("label", F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = nearest_in_blocks(vectors, asked, "label", "embedding", "query_id", "q", "vec_id", 5, digits=6)
    return found.select("label", "query_id", "vec_id", "distance", F.col("rank").cast("int"))


@query("SELECT p_partkey AS product_id, p_name AS product_name FROM part WHERE p_name ILIKE '%WIDGET%' ORDER BY p_name, p_partkey LIMIT 5")
def product_search_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_ilike(_parts(spark, sf_dir), "WIDGET").select("product_id", "product_name")


@query(
    """
    SELECT p_partkey AS product_id, p_brand AS brand, p_retailprice AS price FROM part
    WHERE p_brand ILIKE '%brand#1%' AND p_retailprice <= 950 AND p_retailprice > 0
    ORDER BY p_retailprice DESC NULLS FIRST, p_partkey LIMIT 20
    """
)
def list_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.list_products(_parts(spark, sf_dir), max_price=950, brand="brand#1", brand_column="brand")
    return found.select("product_id", "brand", "price")


_SPECS = {"performance": ["p_type", "p_size"], "design": ["brand", "price"]}


def _part_dims(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    parts = _parts(spark, sf_dir).withColumn("dim_id", F.col("product_id"))
    parts = parts.withColumn("p_size", F.when(F.col("p_size") > 10, F.col("p_size"))).withColumn("price", F.col("price").cast("decimal(12,2)"))
    return {aspect: parts.select("product_id", "dim_id", *columns) for aspect, columns in _SPECS.items()}


def _rendered(df: DataFrame) -> DataFrame:
    pairs = F.transform(F.map_entries("specs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return df.select("product_id", "aspect", F.array_join(F.array_sort(pairs), ";").alias("specs"))


_SQL_PERFORMANCE = "concat_ws(';', CASE WHEN p_size > 10 THEN 'p_size=' || p_size END, 'p_type=' || p_type)"
_SQL_DESIGN = "concat_ws(';', 'brand=' || p_brand, 'price=' || CAST(p_retailprice AS DECIMAL(12, 2)))"


@query(f"SELECT p_partkey AS product_id, 'performance' AS aspect, {_SQL_PERFORMANCE} AS specs FROM part WHERE p_partkey = 17")
def product_specs_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(search.specs_of(_part_dims(spark, sf_dir)["performance"], 17, "performance", _SPECS["performance"]))


@query(
    f"""
    SELECT p_partkey AS product_id, 'performance' AS aspect, {_SQL_PERFORMANCE} AS specs FROM part
    UNION ALL SELECT p_partkey, 'design', {_SQL_DESIGN} FROM part
    """
)
def product_specs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(search.all_specs(_part_dims(spark, sf_dir), _SPECS))


@query(
    """
    WITH c AS (SELECT p_partkey AS product_id, p_retailprice AS price FROM part WHERE p_retailprice <= 1000 AND p_retailprice > 0 ORDER BY p_retailprice DESC, p_partkey LIMIT 5),
    s AS (SELECT l_partkey AS product_id, avg(CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM lineitem GROUP BY l_partkey)
    SELECT c.product_id, price, round(share, 6) AS share FROM c LEFT JOIN s USING (product_id) ORDER BY share DESC NULLS LAST, price DESC, c.product_id LIMIT 3
    """
)
def purchase_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stand for comments, those of a large quantity for positive ones."""
    comments = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), (F.col("l_quantity") > 25).cast("int").alias("positive"))
    found = search.purchase_candidates(_parts(spark, sf_dir), comments, 1000)
    return found.select("product_id", "price", F.round("share", 6).alias("share"))


_CRITERIA = {a: CORPUS_KEYWORDS[a] for a in ("battery", "display", "storage")}
_SQL_CRITERIA = " + ".join(f"CAST(regexp_matches(text, '{_sql_boundary(w)}') AS INT)" for w in _CRITERIA.values())


@query(
    f"""
    WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents),
    cnt AS (SELECT w, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS q FROM tok JOIN labels USING (doc_id) WHERE quality IN (0, 1) GROUP BY w),
    tot AS (SELECT sum(p) AS p, sum(q) AS q, count(*) AS v FROM cnt),
    weight AS (SELECT w, ln((cnt.p + 1) / (tot.p + v)) - ln((cnt.q + 1) / (tot.q + v)) AS x FROM cnt, tot),
    prior AS (SELECT ln(count(*) FILTER (quality = 1)) - ln(count(*) FILTER (quality = 0)) AS x FROM labels JOIN documents USING (doc_id) WHERE text IS NOT NULL),
    score AS (SELECT doc_id, round(coalesce(sum(weight.x), 0) + any_value(prior.x), 6) AS s FROM prior, tok LEFT JOIN weight USING (w) GROUP BY doc_id),
    c AS (SELECT p_size AS product_id, max(p_retailprice) AS price FROM part GROUP BY p_size HAVING max(p_retailprice) <= 1900 ORDER BY price DESC, product_id LIMIT 5),
    m AS (SELECT CAST(doc_id % 50 + 1 AS INT) AS product_id, doc_id, {_SQL_CRITERIA} AS k FROM documents),
    a AS (SELECT product_id, CAST(sum(CASE WHEN s > 0 THEN k ELSE 0 END) AS DOUBLE) / sum(k) AS share, count(*) AS n_comments, max_by(doc_id, (s, -doc_id)) AS evidence FROM m JOIN score USING (doc_id) WHERE k > 0 GROUP BY product_id)
    SELECT product_id, price, round(share, 6) AS share, coalesce(n_comments, 0) AS n_comments, evidence FROM c LEFT JOIN a USING (product_id) ORDER BY a.share DESC NULLS LAST, price DESC, product_id LIMIT 3
    """
)
def purchase_advice_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for comments on products (parts by size); a model learnt from their labels tells which are positive."""
    from aspectra.operators.sentiment import Sentiment, advise

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sentiment = Sentiment.learn(docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"), "text", "quality")
    products = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("int").alias("product_id")).agg(F.max("p_retailprice").alias("price"))
    comments = docs.select((F.col("doc_id") % 50 + 1).cast("int").alias("product_id"), F.col("doc_id").alias("comment_id"), "text")
    found = advise(products, comments, sentiment, _CRITERIA, 1900)
    return found.select("product_id", "price", F.round("share", 6).alias("share"), "n_comments", "evidence")


# Dedup and keys

_SQL_HASH = "md5(lower(p_brand) || ' | ' || lower(p_type) || ' | ' || p_size)"
_SQL_RANKED = f"SELECT *, {_SQL_HASH} AS h, row_number() OVER (PARTITION BY {_SQL_HASH} ORDER BY length(p_name), p_partkey) AS r FROM part"


@query(f"SELECT p_partkey, p_name, 'DEV-' || upper(h[1:10]) AS id FROM ({_SQL_RANKED}) WHERE r = 1")
def hardware_dedup_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    masters, _ = dedup.elect_masters(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"], "p_name", "p_partkey")
    return masters.select("p_partkey", "p_name", "id")


@query(f"SELECT p_partkey, p_name, 'DEV-' || upper(h[1:10]) AS reference_id FROM ({_SQL_RANKED}) WHERE r > 1")
def hardware_dedup_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, others = dedup.elect_masters(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"], "p_name", "p_partkey")
    return others.select("p_partkey", "p_name", "reference_id")


@query("SELECT min(p_partkey) AS p_partkey, lower(trim(p_name)) AS name_key FROM part GROUP BY lower(trim(p_name))")
def name_dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "part").withColumn("name_key", dedup.final_name_key(F.col("p_name"), F.col("p_name")))
    return dedup.first_by(keyed.select("p_partkey", "name_key"), F.col("name_key"), ["p_partkey"])


@query("SELECT min(doc_id) AS doc_id, md5(lower(trim(text))) AS text_hash FROM documents GROUP BY lower(trim(text))")
def text_dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(dedup.final_name_key(F.col("text"), F.lit(None).cast("string"))).alias("text_hash"))
    return dedup.first_by(docs, F.col("text_hash"), ["doc_id"])


@query(
    """
    WITH f AS (SELECT min(p_partkey) AS ord, p_name FROM part WHERE p_name NOT LIKE 'small%' GROUP BY p_name),
    l AS (SELECT l_partkey, max_by(l_extendedprice, (l_orderkey, l_linenumber)) AS price FROM lineitem GROUP BY l_partkey)
    SELECT row_number() OVER (ORDER BY ord) AS product_id, p_name AS product_name, ord, price FROM f LEFT JOIN l ON l_partkey = ord
    """
)
def surrogate_star_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records, line items as links of which the last counts; small parts are loaded already."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("product_name"))
    loaded = parts.where(F.col("product_name").startswith("small")).select("product_name").distinct()
    fresh = catalog.skip_existing(parts, loaded, "product_name", "ord")
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ord"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    priced = catalog.enrich(fresh, links, "ord", ["l_orderkey", "l_linenumber"], ["price"])
    return catalog.star_load(priced, "ord").select("product_id", "product_name", "ord", "price")


@query("SELECT p_name AS product_name, max(p_partkey) AS product_id FROM part WHERE p_name IN ('large bolt', 'cold widget', 'none such') GROUP BY p_name")
def ids_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.ids_by_name(_parts(spark, sf_dir), ["large bolt", "cold widget", "none such"])


@query(
    """
    SELECT l_orderkey, l_linenumber, coalesce(p_name, 'điện thoại (id=' || l_partkey || ')') AS product_name
    FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON p_partkey = l_partkey
    """
)
def product_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("product_id"))
    return catalog.names_by_id(rows, _parts(spark, sf_dir).where("p_size > 5")).select("l_orderkey", "l_linenumber", "product_name")


@query("SELECT p_partkey, p_brand, NULL::VARCHAR AS chipset FROM part")
def payload_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.sanitize(table(spark, sf_dir, "part"), ["p_partkey", "p_brand", "chipset"])


_KEYED = "SELECT vec_id AS chunk_id, label AS dim_id, 'dim_' || (vec_id % 8) AS dim_table, vec_id % 5 AS list_index, 0 AS chunk_index FROM embeddings"
_KEYS = ["dim_id", "dim_table", "list_index", "chunk_index"]


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.col("label").alias("dim_id"),
        F.concat(F.lit("dim_"), F.col("vec_id") % 8).alias("dim_table"),
        (F.col("vec_id") % 5).alias("list_index"),
        F.lit(0).alias("chunk_index"),
    )


@query(f"SELECT min(chunk_id) AS chunk_id, dim_id, dim_table, list_index, chunk_index FROM ({_KEYED}) GROUP BY ALL")
def embedding_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_first_per_key(_keyed(spark, sf_dir), _KEYS, "chunk_id")


@query(
    f"""
    WITH k AS ({_KEYED}), e AS (SELECT DISTINCT dim_id, dim_table, list_index, chunk_index FROM k WHERE chunk_id < 100)
    SELECT min(chunk_id) AS chunk_id, dim_id, dim_table, list_index, chunk_index FROM k ANTI JOIN e USING (dim_id, dim_table, list_index, chunk_index)
    WHERE chunk_id >= 100 GROUP BY ALL
    """
)
def embedding_insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred chunks are stored already; all others arrive as one batch."""
    rows = _keyed(spark, sf_dir)
    return dedup.insert_new(rows.where("chunk_id < 100"), rows.where("chunk_id >= 100"), _KEYS, "chunk_id").select("chunk_id", *_KEYS)


@query(f"SELECT chunk_id, dim_table FROM (SELECT *, row_number() OVER (PARTITION BY dim_table ORDER BY dim_id, list_index, chunk_id) AS r FROM ({_KEYED})) WHERE r <= 30")
def embedding_cap_per_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.cap_per_group(_keyed(spark, sf_dir), "dim_table", ["dim_id", "list_index", "chunk_id"], 30).select("chunk_id", "dim_table")


@query(f"SELECT dim_table, count(*) AS n, max(chunk_id) AS max_chunk_id FROM ({_KEYED}) WHERE dim_table IN ('dim_1', 'dim_3') GROUP BY ROLLUP (dim_table)")
def embedding_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and largest chunk by table of a list, and over all of it."""
    rows = _keyed(spark, sf_dir).where(F.col("dim_table").isin("dim_1", "dim_3"))
    return rows.rollup("dim_table").agg(F.count("*").alias("n"), F.max("chunk_id").alias("max_chunk_id"))


# Reviews


@query(_sql_tags("documents", "doc_id", "text", CORPUS_KEYWORDS))
def aspect_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = reviews.tag(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", CORPUS_KEYWORDS)
    return tagged.select("doc_id", F.explode(F.map_keys("aspects")).alias("aspect"))


@query(_sql_tags("part", "p_partkey", "p_name || ' 128\u00a0GB screen ' || p_size || '\u3000Hz １２０Ｗ １２０ W'", KEYWORDS))
def aspect_tag_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units after white space beyond ASCII, and full-width digits, as scraped pages have them."""
    made = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" 128\u00a0GB screen "), "p_size", F.lit("\u3000Hz １２０Ｗ １２０ W")).alias("text"))
    return reviews.tag(made, "text").select("p_partkey", F.explode(F.map_keys("aspects")).alias("aspect"))


@query(f"SELECT aspect, count(*) AS n FROM ({_sql_tags('documents', 'doc_id', 'text', CORPUS_KEYWORDS)}) GROUP BY aspect")
def aspect_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.aspect_histogram(reviews.tag(table(spark, sf_dir, "documents").select("text"), "text", CORPUS_KEYWORDS))


_ANY = " OR ".join(_sql_hit(a, w, "text") for a, w in CORPUS_KEYWORDS.items())


@query(f"SELECT count(*) FILTER (WHERE lang <> 'fr' AND NOT ({_ANY})) AS n_unmatched, count(*) FILTER (WHERE lang = 'fr') AS n_unprocessed FROM documents")
def aspect_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French documents count as not yet processed."""
    tagged = reviews.tag(table(spark, sf_dir, "documents").select("lang", "text"), "text", CORPUS_KEYWORDS)
    return reviews.aspect_coverage(tagged.withColumn("aspects", F.when(F.col("lang") != "fr", F.col("aspects"))))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(trim(text)) >= 3")
def unclassified_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    marked = rows.withColumn("aspects", F.when(F.col("role") != "user", F.create_map(F.lit("camera"), F.lit(1))))
    return reviews.unclassified(marked, "text").select("conv_id", "turn")


_CONV_TAGS = _sql_tags("conversations", "conv_id, turn, text", "text", CORPUS_KEYWORDS)


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = reviews.tag(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", CORPUS_KEYWORDS)
    return reviews.roll_up(tagged, "conv_id", "turn", "text")


@query(f"SELECT conv_id, aspect, count(*) AS total, md5(string_agg(text, '||' ORDER BY turn, text)) AS comments_md5 FROM ({_CONV_TAGS}) GROUP BY conv_id, aspect")
def review_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir).select("conv_id", "aspect", "total", F.md5(F.array_join("comments", "||")).alias("comments_md5"))


@query(
    f"""
    SELECT o_custkey AS product_id, aspect, count(*) AS total, md5(string_agg(text, '||' ORDER BY conv_id * 1000 + turn, text)) AS comments_md5
    FROM ({_CONV_TAGS}) JOIN orders ON o_orderkey = conv_id GROUP BY ALL
    """
)
def comment_rollup_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the comments of videos; orders are videos, customers their products."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("comment_id"), "text")
    videos = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_custkey").alias("product_id"))
    tagged = reviews.with_product(reviews.tag(rows, "text", CORPUS_KEYWORDS), videos)
    rolled = reviews.roll_up(tagged, "product_id", "comment_id", "text")
    return rolled.select("product_id", "aspect", "total", F.md5(F.array_join("comments", "||")).alias("comments_md5"))


@query(
    rf"""
    SELECT conv_id, aspect, CAST(row_number() OVER (PARTITION BY conv_id, aspect ORDER BY turn, text) - 1 AS INT) AS list_index,
      md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_md5
    FROM ({_CONV_TAGS})
    """
)
def review_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews written as JSON text and parsed again."""
    written = _rolled(spark, sf_dir).select("conv_id", "aspect", F.to_json(F.struct("total", "comments")).alias("user_review"))
    parsed = reviews.explode_reviews(written, ["conv_id", "aspect"])
    return parsed.select("conv_id", "aspect", F.col("list_index").cast("int"), F.md5("chunk_text").alias("text_md5"))


@query(
    """
    WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
    n AS (SELECT *, greatest(0, CAST(ceil((len(words) - 160) / 140.0) AS INT)) AS last FROM w WHERE len(words) > 0),
    e AS (SELECT doc_id, words, unnest(range(0, last + 1)) AS i FROM n)
    SELECT doc_id, CAST(i AS INT) AS chunk_index, md5(array_to_string(words[i * 140 + 1 : i * 140 + 160], ' ')) AS chunk_md5 FROM e
    """.replace("\\\\", "\\")
)
def comment_chunks_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.window_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return chunks.select("doc_id", F.col("chunk_index").cast("int"), F.md5("chunk_text").alias("chunk_md5"))


@query()
def comment_chunks_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words stand for model tokens; providers.vocabulary_codec and compound_segmenter bring a model's own."""
    ship_code(spark)
    return chunking.recursive_chunks(table(spark, sf_dir, "conversations").select("conv_id", "text"), "conv_id", "text")


def chunk_facts(docs: DataFrame, chunks: DataFrame, key: str, text: str) -> DataFrame:
    """By document: gapless numbers, words of its text that stand in no chunk, and the largest chunk by the column n_tokens."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.replace(c, F.lit("_"), F.lit(" "))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    have = chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), F.max("chunk_index").alias("last"), F.count_distinct("chunk_index").alias("numbers"), F.max("n_tokens").alias("most"), F.array_distinct(F.flatten(F.collect_list(words(F.col("chunk_text"))))).alias("found"))
    facts = docs.select(key, words(F.col(text)).alias("wanted")).join(have, key)
    missing = F.size(F.filter(F.array_except("wanted", "found"), lambda w: F.length(w) < 60))
    return facts.select(key, ((F.col("numbers") == F.col("n_chunks")) & (F.col("last") == F.col("n_chunks") - 1)).alias("gapless"), missing.alias("missing_words"), "most")


@query(
    """
    SELECT conv_id, turn, true AS gapless, 0 AS missing_words, true AS within_limit FROM conversations WHERE regexp_matches(text, '[^[:space:]]')
    """
)
def comment_chunks_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments cut by a public vocabulary's tokens, compounds learnt from them joined: invariants of every comment's chunks."""
    import public_tokenizers

    from aspectra.operators.segment import Lexicon, learn_compounds, viterbi_segmenter

    ship_code(spark)
    comments = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("comment"), "text").where("text is not null")
    segment = viterbi_segmenter(Lexicon.of(learn_compounds(comments, "text")))
    encode, decode = providers.vocabulary_codec(public_tokenizers.path("word_bpe_49k.json"))
    counted = chunking.recursive_chunks(comments, "comment", "text", encode, decode, segment, counts="n_tokens")
    facts = chunk_facts(comments, counted, "comment", "text")
    return facts.select("comment.*", "gapless", "missing_words", (F.col("most") <= 254).alias("within_limit"))


@query(
    """
    WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM conversations)
    SELECT conv_id, turn, CAST(unnest(range(0, greatest(0, CAST(ceil((len(words) - 40) / 35.0) AS INT)) + 1)) AS INT) AS chunk_index, 64 AS dimensions, true AS unit, true AS same_as_itself
    FROM w WHERE len(words) > 0
    """
)
def comment_embed_learnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks encoded with weights learnt from all comments: invariants of every vector."""
    from aspectra.operators.encoder import learn_weights, learnt_encoder

    ship_code(spark)
    comments = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("comment"), "text")
    encoder = learnt_encoder(*learn_weights(comments, "text", 64))
    chunks = chunking.window_chunks(comments, "comment", "text", 40, 5).select("comment.*", "chunk_index", "chunk_text")
    vectors = providers.embed(chunks, ["conv_id", "turn", "chunk_index"], "chunk_text", encoder, 64)
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return vectors.select(
        "conv_id", "turn", F.col("chunk_index").cast("int"), F.size("embedding").alias("dimensions"), (F.abs(length - 1) < 1e-5).alias("unit"), (F.round(cosine_distance(F.col("embedding"), F.col("embedding")), 6) == 0).alias("same_as_itself")
    )


@query()
def comment_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks encoded by the offline encoder; how far each is from its comment's first."""
    ship_code(spark)
    keyed = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("comment"), "text")
    chunks = chunking.window_chunks(keyed, "comment", "text", 40, 5).select("comment.*", "chunk_index", "chunk_text")
    vectors = providers.embed(chunks, ["conv_id", "turn", "chunk_index"], "chunk_text", providers.hashing_encoder(64), 64)
    firsts = vectors.where("chunk_index = 0").select("conv_id", "turn", F.col("embedding").alias("first"))
    distance = F.round(cosine_distance(F.col("embedding"), F.col("first")), 6)
    return vectors.join(firsts, ["conv_id", "turn"]).select("conv_id", "turn", "chunk_index", distance.alias("distance"))


# Integrity and deletes


@query(
    """
    WITH r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'supplier' ELSE 'nobody' END AS dim_table, o_custkey AS dim_id FROM orders)
    SELECT o_orderkey, dim_table, dim_id, CASE WHEN dim_table = 'nobody' THEN 'unknown table' ELSE 'missing id' END AS reason FROM r
    WHERE dim_table = 'nobody' OR (dim_table = 'customer' AND dim_id NOT IN (SELECT c_custkey FROM customer))
      OR (dim_table = 'supplier' AND dim_id NOT IN (SELECT s_suppkey FROM supplier))
    """
)
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 3 == 0, F.lit("customer")).when(F.col("o_orderkey") % 3 == 1, F.lit("supplier")).otherwise(F.lit("nobody"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("dim_table"), F.col("o_custkey").alias("dim_id"))
    dims = {"customer": (table(spark, sf_dir, "customer"), "c_custkey"), "supplier": (table(spark, sf_dir, "supplier"), "s_suppkey")}
    return integrity.reference_violations(rows, dims).select("o_orderkey", "dim_table", "dim_id", "reason")


@query(
    """
    WITH gone AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
    SELECT 'orders' AS source, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders WHERE o_orderkey NOT IN (FROM gone)
    UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (FROM gone)
    """
)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders, items = integrity.cascade_delete(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), doomed, "o_custkey", "o_orderkey", "l_orderkey")
    count = lambda df, name, key: df.agg(F.count("*").alias("n"), F.sum(key).alias("key_sum")).select(F.lit(name).alias("source"), "n", "key_sum")
    return count(orders, "orders", "o_orderkey").unionByName(count(items, "lineitem", "l_orderkey"))


# Media

_COUNTED = """
    c AS (SELECT c_custkey, c_name, CAST(count(o_orderkey) AS BIGINT) AS n_videos, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'top-up' ELSE 'fresh' END AS phase
          FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment)
"""


@query(
    f"""
    WITH {_COUNTED}
    SELECT c_custkey, c_name, phase, n_videos,
      row_number() OVER (ORDER BY phase = 'fresh', CASE WHEN phase = 'top-up' THEN c_name END, c_custkey) AS place
    FROM c WHERE phase = 'fresh' OR n_videos < 10
    """
)
def topup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for products, orders for videos, a segment for completed ones."""
    customers = table(spark, sf_dir, "customer").withColumn("ord", F.col("c_custkey"))
    videos = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    completed = customers.where("c_mktsegment = 'MACHINERY'").select("c_name")
    return media.top_up_plan(customers, videos, completed, "c_custkey", "c_name", "ord", 10)


@query("SELECT DISTINCT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def products_with_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return media.with_videos(table(spark, sf_dir, "customer"), videos, "c_custkey", "c_name")


@query(
    """
    SELECT url, min(page_id) AS page_id FROM (SELECT page_id, regexp_replace(url, '\\?.*$', '') AS url FROM pages WHERE page_id >= 20)
    WHERE url NOT IN (SELECT regexp_replace(url, '\\?.*$', '') FROM pages WHERE page_id < 20) GROUP BY url
    """.replace("\\\\", "\\")
)
def videos_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty pages are stored already; all others arrive as one batch."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"\?.*$", "").alias("url"))
    return media.insert_if_absent(pages.where("page_id < 20").select("url").distinct(), pages.where("page_id >= 20"), "url", "page_id").select("url", "page_id")


@query(
    """
    SELECT conv_id, turn, trim(text) AS comment_text, CASE WHEN role <> 'system' THEN role END AS user_name FROM conversations WHERE text <> ''
    """
)
def info_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the comments of an info record; system turns have a blank author."""
    author = F.when(F.col("role") != "system", F.col("role")).otherwise(F.lit(" "))
    info = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(F.struct("text", author.alias("author"))).alias("comments"))
    return media.comments_of_info(info, ["conv_id", "turn"])


@query(
    r"""
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'v' || page_id WHEN page_id % 3 = 1 THEN 'w' || page_id END AS video_id FROM pages
    """
)
def url_video_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id")
    url = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?v=v"), "page_id", F.lit("&t=1")))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://youtu.be/w"), "page_id", F.lit("/")))
        .otherwise(F.lit("https://www.youtube.com/about"))
    )
    return pages.select("page_id", X.video_id(url).alias("video_id"))


_SQL_BARE = "strip_accents(replace(replace({0}, 'ß', 'ss'), 'æ', 'ae'))"
_SQL_SAFE = "lower(regexp_replace(regexp_replace({0}, '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'))"


@query(
    f"""
    SELECT page_id, {_SQL_SAFE.format("url")} AS safe, {_SQL_SAFE.format(_SQL_BARE.format("t"))} AS media_name,
      'raw/' || {_SQL_SAFE.format("url")} || '/' || coalesce(nullif({_SQL_SAFE.format("t")}, ''), 'asset') || '_audio.mp3' AS object_key
    FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)
    """
)
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"))
    key = X.object_key("raw/", F.col("url"), F.col("t"), F.lit("audio"), F.lit(".mp3"))
    return pages.select("page_id", X.safe_name(F.col("url")).alias("safe"), X.media_name(F.col("t")).alias("media_name"), key.alias("object_key"))


@query(
    f"""
    WITH t AS (SELECT doc_id, n_chars, CAST(doc_id % 120 AS INT) AS i, text, {_SQL_SAFE.format(_SQL_BARE.format("text"))} AS s FROM documents)
    SELECT doc_id, (CASE WHEN i < 100 THEN lpad(CAST(i AS VARCHAR), 2, '0') ELSE CAST(i AS VARCHAR) END) || '_' || substring(s, 1, 50) AS title,
      greatest(1, least(50, n_chars - 300)) AS results, CASE WHEN length(text) > 120 THEN substring(text, 1, 117) || '...' ELSE text END AS preview,
      md5(CASE WHEN length(text) > 3000 THEN substring(text, 1, 3000) || '…' ELSE text END) AS tool_preview_md5
    FROM t
    """
)
def media_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    title = X.safe_title((F.col("doc_id") % 120).cast("int"), F.col("text"), F.col("doc_id").cast("string"))
    return docs.select(
        "doc_id",
        title.alias("title"),
        X.clamp_results(F.col("n_chars") - 300).alias("results"),
        X.preview(F.col("text")).alias("preview"),
        F.md5(X.tool_preview(F.col("text"))).alias("tool_preview_md5"),
    )


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def unknown_video_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as found videos, larger parts as those stored."""
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("v/"), F.col("l_partkey")).alias("url"))
    known = table(spark, sf_dir, "part").where("p_size > 5").select(F.concat(F.lit("v/"), F.col("p_partkey")).alias("url"))
    return media.unknown_urls(found, known, "url").select("l_orderkey", "l_linenumber")


@query(
    """
    SELECT event_id, event_id % 4 = 0 AND event_id % 3 <> 2 AS exceeded FROM events
    """
)
def quota_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 4 == 0, F.lit(403)).otherwise(F.lit(500))
    reasons = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("quotaExceeded"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("other"), F.lit("rateLimitExceeded"))).otherwise(F.array(F.lit("forbidden")))
    return table(spark, sf_dir, "events").select("event_id", X.quota_exceeded(status, reasons).alias("exceeded"))


@query(
    r"""
    WITH w AS (SELECT p_partkey, p_size, list_transform(list_filter(string_split(p_name, ' '), lambda x: lower(x) <> 'hot'), lambda x: upper(x[1]) || lower(x[2:])) AS words FROM part)
    SELECT p_partkey, array_to_string(words, ' ') || ' Snapdragon 8 Gen ' || (p_size % 4) AS search_query_name FROM w
    """
)
def query_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    name = F.concat(F.initcap("p_name"), F.lit(" cũ 99% (8GB/256GB)"))
    return parts.select("p_partkey", providers.normalized_name(name, F.concat(F.lit("Qualcomm Snapdragon 8 Gen "), F.col("p_size") % 4)).alias("search_query_name"))


# Sessions and history


@query(
    """
    WITH s AS (SELECT *, CAST(coalesce(date_diff('microsecond', lag(ts) OVER w, ts) >= 1800000000, true) AS INT) AS started FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, CAST(sum(started) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS thread FROM s
    """
)
def session_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return sessions.session_threads(events, "user_id", "ts", "event_id").select("event_id", "user_id", "thread")


@query(
    """
    SELECT conv_id, turn, role FROM conversations JOIN (SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS last FROM conversations GROUP BY conv_id) USING (conv_id)
    WHERE last IS NULL OR turn >= last
    """
)
def last_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.last_turn(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "role")


@query(
    """
    WITH u AS (SELECT *, sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations),
    k AS (SELECT * FROM u WHERE used <= 400)
    SELECT conv_id, turn, role FROM k JOIN (SELECT conv_id, min(turn) AS start FROM k WHERE role = 'user' GROUP BY conv_id) USING (conv_id) WHERE turn >= start
    """
)
def history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    tokens = F.ceil(F.length("text") / F.lit(4)).cast("long")
    return sessions.trimmed_history(rows, "conv_id", "turn", "role", tokens, 400).select("conv_id", "turn", "role")


# Pages


@query(
    """
    SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages
    """
)
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return H.page_anchors(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "href")


_ITEM = """'<div class="product-list-item"><p class="name"><a href="/p/' || page_id || '">Phone ' || page_id || '</a></p><p class="price">' || (page_id % 7) || '.990.000 đ</p><img class="lazy" data-original="i.png"></div>'"""


@query("SELECT page_id, 'Phone ' || page_id AS product_name, '/p/' || page_id AS url, CAST((page_id % 7) * 1000000 + 990000 AS INT) AS price_vnd, 'i.png' AS image FROM pages")
def catalogue_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a product item put at its end."""
    ship_code(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.expr(_ITEM)).alias("html"))
    return H.catalogue_links(pages, "page_id", "html").select("page_id", "product_name", "url", "price_vnd", "image")


@query("SELECT page_id, 'CPU ' || page_id AS chipset, CASE WHEN page_id % 2 = 0 THEN 'G2' ELSE 'G1' END AS gpu_chip, 'USB' AS charging_port, 'USB' AS charging_port_alt FROM pages")
def html_spec_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specification table on every page; blank cells become null and the second label counts."""
    ship_code(spark)
    made = F.concat(
        F.lit('<div class="product-lightbox-content"><table><tr><td>Chipset:</td><td> CPU '), "page_id",
        F.lit("</td></tr><tr><td>Chip đồ họa (GPU)</td><td>"), F.when(F.col("page_id") % 2 == 0, F.lit(" ")).otherwise(F.lit("G1")),
        F.lit("</td></tr><tr><td>GPU</td><td>G2</td></tr><tr><td>Cổng sạc</td><td>Micro</td></tr><tr><td>Cổng sạc</td><td>USB</td></tr><tr><td>x</td></tr></table></div>"),
    )
    maps = H.spec_maps(table(spark, sf_dir, "pages").select("page_id", made.alias("html")), "page_id", "html")
    made_records = catalog.spec_records(maps.withColumn("none", F.lit(None).cast("string")), "specs", "page_id", "none", "none")
    return made_records.select(F.col("_source_url").alias("page_id"), "dim_performance.chipset", "dim_performance.gpu_chip", "dim_connectivity.charging_port", "dim_utilities.charging_port_alt")


@query("SELECT page_id, coalesce(TRY_CAST(nullif(regexp_replace(url, '[^0-9]', '', 'g'), '') AS INT), 0) AS price FROM pages")
def page_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.price_from_text(F.col("url")).alias("price"))


@query(
    r"""
    WITH s AS (SELECT page_id, trim(regexp_extract(regexp_replace(url, '\?.*$', ''), '^https?://(.+)$', 1), '/') AS slug FROM pages)
    SELECT slug, min(page_id) AS page_id FROM s WHERE slug <> '' AND NOT starts_with(slug, 'm.') GROUP BY slug
    """
)
def category_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", r"\?.*$", ""), "^https?", "https").alias("href"))
    return catalog.category_slugs(pages, "href", "page_id", "https://", "m.")


@query(
    """
    WITH f AS (SELECT o_custkey % 20 AS slug, 'u' || (o_orderkey % 97) AS url, min(o_orderkey % 40 + 1) AS page FROM orders WHERE o_orderkey % 40 + 1 <= 30 GROUP BY ALL),
    b AS (SELECT slug, page, row_number() OVER (PARTITION BY slug ORDER BY page) AS place FROM f GROUP BY slug, page)
    SELECT f.slug, f.page, f.url FROM f JOIN b ON f.slug = b.slug AND f.page = b.page WHERE place = f.page
    """
)
def paged_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored pages of a catalogue: a slug's crawl ends at its first page without news."""
    pages = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("slug"), (F.col("o_orderkey") % 40 + 1).alias("page"), F.concat(F.lit("u"), F.col("o_orderkey") % 97).alias("url"))
    return catalog.crawl_pages(pages, "slug", "page", "url", max_pages=30).select("slug", "page", "url")


# Streaming


@query(_sql_tags("conversations", "conv_id, turn, role", "text", CORPUS_KEYWORDS))
def incremental_tag_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments as a stream, tagged into an idempotent table by role, run twice from the start."""
    from aspectra.streaming.incremental import append_batches

    base = scratch_folder(spark, "tags")
    source = f"{sf_dir}/conversations.parquet"
    rows = spark.read.parquet(source)

    def tagged(batch: DataFrame) -> DataFrame:
        return reviews.tag(batch.select("conv_id", "turn", "role", "text"), "text", CORPUS_KEYWORDS).select("conv_id", "turn", "aspects", "role")

    tagged(rows).limit(0).write.partitionBy("role").parquet(f"{base}/table")
    for run in ("first", "second"):
        stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/conversations*.parquet")
        append_batches(stream, f"{base}/table", ["conv_id", "turn", "role"], "turn", f"{base}/{run}", tagged, by="role")
    made = spark.read.schema("conv_id long, turn long, aspects map<string,int>, role string").parquet(f"{base}/table")
    return made.select("conv_id", "turn", "role", F.explode(F.map_keys("aspects")).alias("aspect"))


@query(
    """
    WITH s AS (SELECT *, CAST(coalesce(date_diff('microsecond', lag(ts) OVER w, ts) >= 1800000000, true) AS INT) AS started FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    t AS (SELECT *, sum(started) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS thread FROM s)
    SELECT user_id, min_by(event_id, (ts, event_id)) AS first_event, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n
    FROM t WHERE user_id IS NOT NULL GROUP BY user_id, thread
    """
)
def expired_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream; a thread comes out when its time to live is over. A row without a user, later than all, moves the clock on."""
    from aspectra.streaming.threads import STATE_STORE, closed_threads

    base, names = scratch_folder(spark, "threads"), ["event_id", "user_id", "ts"]
    events = table(spark, sf_dir, "events").select(*names)
    events.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).selectExpr("cast(null as long) as event_id", "cast(null as long) as user_id", "ts").write.parquet(f"{base}/clock")
    stream = lambda path: spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(path)
    both = stream(f"{sf_dir}/events*.parquet").unionByName(stream(f"{base}/clock"))
    threads = closed_threads(both, "user_id", "ts", "event_id")
    with with_conf(spark, **{STATE_STORE[0].replace(".", "__"): STATE_STORE[1]}):
        write = threads.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        write.trigger(availableNow=True).start().awaitTermination()
    made = spark.read.schema(threads.schema).parquet(f"{base}/out")
    return made.select(F.col("user").alias("user_id"), F.col("first").alias("first_event"), F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n")
