"""Fingerprints, distances and neighbour search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.functions import fingerprints as fpx
from shotweave.operators import similarity
from shotweave.operators.search_index import BandIndex
from shotweave.plans.ranking import hash_uniform
from shotweave.plans.skew import lookup_join
from shotweave.session import cut_lineage, spread
from shotweave.workloads.registry import query, table

CIRCULAR_DIGIT = 5


def bits_sql(relation: str, key: str, text: str, name: str = "bits", n_bits: int = 166, digit: int = 1) -> str:
    return f"""
{name}_tok AS (
  SELECT DISTINCT {key} AS key, t FROM (
    SELECT {key}, unnest(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM {relation}) WHERE t <> ''),
{name} AS (SELECT DISTINCT key, ('0x' || substr(md5(t), {digit}, 4))::INT % {n_bits} AS bit FROM {name}_tok)"""


def fp_sql(relation: str, key: str, text: str, name: str) -> str:
    """``name(key, fp, pc)`` with the fingerprint as a bit string."""
    return bits_sql(relation, key, text, f"{name}_bits") + f""",
{name} AS (SELECT key, bitstring_agg(bit, 0, 165) AS fp, count(*) AS pc FROM {name}_bits GROUP BY key)"""


def words_sql(bits: str, n_words: int) -> str:
    columns = ", ".join(
        f"sum(CASE WHEN bit // 32 = {i} THEN 1::BIGINT << (bit % 32) ELSE 0 END)::BIGINT AS w{i}" for i in range(n_words)
    )
    return f"SELECT key, {columns}, count(*) AS popcount FROM {bits} GROUP BY key"


def document_words(spark: SparkSession, d: str, *keep: str, encodable: bool = False) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text", *keep))
    if encodable:
        docs = similarity.encodable(docs, "text")
    return similarity.fingerprint_table(docs, "doc_id", "text", *keep)


def _word_columns(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.col("words")[i].alias(f"w{i}") for i in range(fpx.KEYS_WORDS)],
                     F.col("popcount").cast("bigint").alias("popcount"))


@query("WITH" + bits_sql("documents", "doc_id", "text") + ", w AS (" + words_sql("bits", 6) + ") "
       "SELECT d.doc_id AS key, w.* EXCLUDE (key) FROM documents d LEFT JOIN w ON w.key = d.doc_id")
def fp_encode(spark, d):
    return _word_columns(document_words(spark, d), "key")


@query("""
WITH b AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS bit FROM embeddings)
SELECT vec_id, sum(CASE WHEN x > 0 THEN 1 ELSE 0 END)::BIGINT AS popcount,
       sum(CASE WHEN x > 0 AND bit < 32 THEN 1::BIGINT << bit ELSE 0 END)::BIGINT AS w0,
       sum(CASE WHEN x > 0 AND bit >= 32 THEN 1::BIGINT << (bit - 32) ELSE 0 END)::BIGINT AS w1 FROM b GROUP BY vec_id
""")
def fp_popcount(spark, d):
    signs = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    words = table(spark, d, "embeddings").select("vec_id", fpx.bits_to_words(signs, 2).alias("words"))
    return words.select("vec_id", fpx.popcount(F.col("words"), 2).cast("bigint").alias("popcount"),
                        F.col("words")[0].alias("w0"), F.col("words")[1].alias("w1"))


@query("""
SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[2]::DOUBLE AS second, 2 AS n_basic, len(embedding) AS n_rich FROM embeddings
""")
def feature_slice(spark, d):
    basic, rich = fpx.basic_features(F.col("embedding")), fpx.basic_features(F.col("embedding"), rich=True)
    return table(spark, d, "embeddings").select(
        "vec_id", basic[0].cast("double").alias("first"), basic[1].cast("double").alias("second"),
        F.size(basic).cast("bigint").alias("n_basic"), F.size(rich).cast("bigint").alias("n_rich"))


BOTH_SQL = "WITH" + bits_sql("documents", "doc_id", "text", "small") + "," + bits_sql(
    "documents", "doc_id", "text", "large", 2048, CIRCULAR_DIGIT) + """,
mixed AS (SELECT key, bit FROM small UNION ALL SELECT key, bit + 192 FROM large)"""


def _composite(spark: SparkSession, d: str, encodable: bool = False) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    if encodable:
        docs = similarity.encodable(docs, "text")
    small = fpx.encode_text(F.col("text"))
    large = fpx.encode_text(F.col("text"), fpx.CIRCULAR_BITS, fpx.CIRCULAR_WORDS, CIRCULAR_DIGIT)
    return docs.select("doc_id", fpx.concat_words(small, large).alias("words"))


@query(BOTH_SQL + """,
cells AS (SELECT key, bit // 32 AS i, sum(1::BIGINT << (bit % 32))::BIGINT AS w FROM mixed GROUP BY ALL),
keys AS (SELECT DISTINCT key FROM mixed),
full_words AS (SELECT k.key, r.i, coalesce(c.w, 0) AS w FROM keys k, range(70) r(i) LEFT JOIN cells c ON c.key = k.key AND c.i = r.i)
SELECT d.doc_id, string_agg(printf('%08X', w), '' ORDER BY i) AS packed, sum(bit_count(w)::BIGINT)::BIGINT AS popcount
FROM documents d LEFT JOIN full_words f ON f.key = d.doc_id GROUP BY d.doc_id
""")
def fp_concat(spark, d):
    words = _composite(spark, d)
    return words.select("doc_id", F.hex(fpx.words_to_bytes(F.col("words"))).alias("packed"),
                        fpx.popcount(F.col("words"), 70).cast("bigint").alias("popcount"))


def _next_pairs(words: DataFrame) -> DataFrame:
    """Every document with the one after it: an equi-join, one pair per row."""
    after = words.select((F.col("doc_id") - 1).alias("doc_id"), F.col("words").alias("next_words"))
    return words.join(after, "doc_id")


def _distance_sql(name: str, bits: str) -> str:
    return f"""{name} AS (
  SELECT doc_id, CASE WHEN a + b - c > 0 THEN 1 - c::DOUBLE / (a + b - c) END AS distance FROM (
    SELECT p.doc_id, coalesce(na.n, 0) AS a, coalesce(nb.n, 0) AS b, coalesce(s.n, 0) AS c FROM pairs p
    LEFT JOIN (SELECT key, count(*) AS n FROM {bits} GROUP BY key) na ON na.key = p.doc_id
    LEFT JOIN (SELECT key, count(*) AS n FROM {bits} GROUP BY key) nb ON nb.key = p.doc_id + 1
    LEFT JOIN (SELECT x.key, count(*) AS n FROM {bits} x JOIN {bits} y ON y.key = x.key + 1 AND y.bit = x.bit GROUP BY x.key) s
      ON s.key = p.doc_id))"""


PAIRS_SQL = """,
pairs AS (SELECT a.key AS doc_id FROM (SELECT DISTINCT key FROM small) a JOIN (SELECT DISTINCT key FROM small) b ON b.key = a.key + 1)"""


@query("WITH" + bits_sql("documents", "doc_id", "text", "small") + PAIRS_SQL + ", " + _distance_sql("r", "small") + " SELECT * FROM r")
def tanimoto_pairs(spark, d):
    words = document_words(spark, d, encodable=True).select(F.col("key").alias("doc_id"), "words")
    pairs = similarity.pair_distances(_next_pairs(cut_lineage(words)), fpx.tanimoto_keys, "words", "next_words")
    return pairs.select("doc_id", "distance")


@query(BOTH_SQL + PAIRS_SQL + ", " + _distance_sql("r", "mixed") + " SELECT * FROM r")
def tanimoto_mixed(spark, d):
    words = cut_lineage(_composite(spark, d, encodable=True))
    return similarity.pair_distances(_next_pairs(words), fpx.tanimoto_mixed, "words", "next_words").select("doc_id", "distance")


@query(BOTH_SQL + PAIRS_SQL + ", " + _distance_sql("r1", "small") + ", " + _distance_sql("r2", "large") + """
SELECT doc_id, CASE WHEN r1.distance > 0.2::DOUBLE THEN r1.distance ELSE 0.2::DOUBLE * r2.distance END AS distance
FROM r1 JOIN r2 USING (doc_id)""")
def tanimoto_conditional(spark, d):
    words = cut_lineage(_composite(spark, d, encodable=True))
    pairs = similarity.pair_distances(_next_pairs(words), fpx.tanimoto_conditional, "words", "next_words")
    return pairs.select("doc_id", "distance")


def knn_sql(queries: str, candidates: str, k: int, extra: str = "true") -> str:
    return f"""
SELECT query_id, rank, key, distance FROM (
  SELECT q.key AS query_id, c.key AS key, 1 - bit_count(q.fp & c.fp)::DOUBLE / bit_count(q.fp | c.fp) AS distance,
         row_number() OVER (PARTITION BY q.key ORDER BY 1 - bit_count(q.fp & c.fp)::DOUBLE / bit_count(q.fp | c.fp), c.key) AS rank
  FROM {queries} q, {candidates} c WHERE {extra}) WHERE rank <= {k}"""


@query("WITH" + fp_sql("documents", "doc_id", "text", "docs") + "," + fp_sql("benchmark", "item_id", "text", "items") + ",\n"
       + "near AS (" + knn_sql("items", "docs", 8) + """)
SELECT near.*, text AS smiles, quality AS label FROM near JOIN documents ON doc_id = key LEFT JOIN labels USING (doc_id)""")
def knn_topk(spark, d):
    """Few queries against the whole corpus; string and label of each neighbour are read by the keys found."""
    items = similarity.fingerprint_table(table(spark, d, "benchmark"), "item_id", "text")
    found = cut_lineage(similarity.nearest_few(items, document_words(spark, d), 8))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("smiles"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    wanted = lookup_join(labels, found.select("key").distinct(), ["key"], [], "left_semi")
    return lookup_join(docs, found, ["key"], []).join(wanted, "key", "left").select(
        "query_id", "rank", "key", "distance", "smiles", "label")


NOSELF_SQL = "WITH" + fp_sql("documents", "doc_id", "text", "docs") + knn_sql("docs", "docs", 4, "q.key <> c.key")


@query(NOSELF_SQL)
def knn_topk_noself(spark, d):
    return similarity.nearest(document_words(spark, d), None, 4)


@query("WITH" + fp_sql("documents", "doc_id", "text", "docs") + knn_sql(
    "docs", "docs", 10, "q.key <> c.key AND bit_count(q.fp & c.fp)::DOUBLE / bit_count(q.fp | c.fp) >= 0.8::DOUBLE"))
def knn_threshold(spark, d):
    return similarity.nearest(document_words(spark, d), None, 10, min_similarity=0.8)


# 16 bands of 8 rows serve queries whose last neighbour has similarity 0.81 at least; dissimilar documents rarely share a band.
BANDS, ROWS, CERTAINTY = 16, 8, 0.95


WIDE_SQL = "WITH" + bits_sql("documents", "doc_id", "text", "docs_bits", 2048, CIRCULAR_DIGIT) + """,
docs AS (SELECT key, bitstring_agg(bit, 0, 2047) AS fp, count(*) AS pc FROM docs_bits GROUP BY key)"""


@query(WIDE_SQL + knn_sql(
    "docs", "docs", 10, "q.key <> c.key AND bit_count(q.fp & c.fp)::DOUBLE / bit_count(q.fp | c.fp) >= 0.8::DOUBLE"))
def knn_threshold_wide(spark, d):
    """2048-bit fingerprints through the index on rare bits."""
    docs = similarity.encodable(spread(table(spark, d, "documents").select("doc_id", "text")), "text")
    words = fpx.encode_text(F.col("text"), fpx.CIRCULAR_BITS, fpx.CIRCULAR_WORDS, CIRCULAR_DIGIT)
    return similarity.nearest_within(docs.select(F.col("doc_id").alias("key"), words.alias("words")), None, 10, 0.8)


# 16 bands of 8 rows serve queries whose last neighbour has similarity 0.81 at least; dissimilar documents rarely share a band.
BANDS, ROWS, CERTAINTY = 16, 8, 0.95


def _lsh_sql(bands: int, rows: int, k: int, queries: str = "docs", extra: str = "q.key <> c.key") -> str:
    """Band keys from the bit with the smallest md5 per hash function; a query is served if its last neighbour is near enough."""
    reach = 1.0 - similarity.certain_similarity(bands, rows, CERTAINTY)
    sides = ["docs"] if queries == "docs" else ["docs", queries]
    prints = ",".join(fp_sql({"docs": "documents", "items": "benchmark"}[s], {"docs": "doc_id", "items": "item_id"}[s], "text", s) for s in sides)
    keys = ",".join(f"""
{s}_mins AS (SELECT key, h, min(place) AS m FROM {s}_bits JOIN orders USING (bit) GROUP BY key, h),
{s}_keys AS (SELECT key, h // {rows} AS band, string_agg(m, '-' ORDER BY h) AS bucket FROM {s}_mins GROUP BY key, h // {rows})""" for s in sides)
    return "WITH" + prints + f""",
orders AS (
  SELECT h, bit, row_number() OVER (PARTITION BY h ORDER BY md5('0:' || h || ':' || bit)) AS place
  FROM range({bands * rows}) a(h), range(166) b(bit)),{keys},
pairs AS (SELECT DISTINCT a.key AS qk, b.key AS ck FROM {queries}_keys a JOIN docs_keys b USING (band, bucket)),
near AS (
  SELECT qk AS query_id, ck AS key, 1 - bit_count(q.fp & c.fp)::DOUBLE / bit_count(q.fp | c.fp) AS distance
  FROM pairs JOIN {queries} q ON q.key = qk JOIN docs c ON c.key = ck WHERE {extra}),
served AS (SELECT query_id FROM (SELECT query_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS n FROM near)
  WHERE n = {k} AND distance <= {reach!r}::DOUBLE),
whole AS (SELECT * FROM near WHERE query_id IN (FROM served) UNION ALL
  SELECT q.key, c.key, 1 - bit_count(q.fp & c.fp)::DOUBLE / bit_count(q.fp | c.fp)
  FROM {queries} q JOIN docs c ON {extra} WHERE q.key NOT IN (FROM served))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS rank, key, distance FROM whole
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, key) <= {k}"""


def _certified(words: DataFrame) -> DataFrame:
    return similarity.nearest_lsh(words, None, 4, bands=BANDS, rows=ROWS, certainty=CERTAINTY, small_rows=0)


@query(_lsh_sql(BANDS, ROWS, 4))
def knn_lsh(spark, d):
    return _certified(document_words(spark, d))


@query(_lsh_sql(BANDS, ROWS, 4).replace("SELECT query_id, row_number()", ", found AS (SELECT query_id, row_number()", 1)
       + "), exact AS (" + knn_sql("docs", "docs", 4, "q.key <> c.key") + """)
SELECT avg((f.key IS NOT NULL)::INT::DOUBLE) AS recall FROM exact e LEFT JOIN found f USING (query_id, key)""")
def knn_lsh_recall(spark, d):
    words = cut_lineage(document_words(spark, d))
    return similarity.recall(_certified(words), similarity.nearest(words, None, 4))


@query(_lsh_sql(BANDS, ROWS, 8, "items", "true"))
def index_search(spark, d):
    """A search table made from one batch, appended to with what it lacks, and searched."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    index = BandIndex.open(spark, bands=BANDS, rows=ROWS)
    first = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    index.append(similarity.fingerprint_table(first, "doc_id", "text"))
    index.append(similarity.fingerprint_table(index.missing(docs, "doc_id"), "doc_id", "text"))
    items = similarity.fingerprint_table(table(spark, d, "benchmark"), "item_id", "text")
    return index.search(items, 8, CERTAINTY)


@query("WITH" + fp_sql("documents", "doc_id", "text", "docs") + ", top AS (" + knn_sql("docs", "docs", 1) + """)
SELECT count(*) AS queries, avg((key = query_id)::INT::DOUBLE) AS recall, avg((distance = 0)::INT::DOUBLE) AS same FROM top
""")
def self_recall(spark, d):
    return similarity.self_recall(document_words(spark, d), similarity.nearest)


def _sharded(spark: SparkSession, d: str) -> DataFrame:
    held_out = hash_uniform("shard", "key") < 0.1
    return document_words(spark, d, "source", encodable=True).withColumn(
        "shard", F.when(held_out, F.concat(F.lit("test_"), F.col("source"))).otherwise(F.col("source")))


@query("WITH" + bits_sql("documents", "doc_id", "text") + ", w AS (" + words_sql("bits", 6) + """)
SELECT source AS shard, d.doc_id AS key, w.* EXCLUDE (key) FROM documents d JOIN w ON w.key = d.doc_id
WHERE ('0x' || substr(md5('shard:' || d.doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= 0.1""")
def fp_table(spark, d):
    return _word_columns(similarity.searchable(_sharded(spark, d), "shard"), "shard", "key")


@query("WITH" + bits_sql("documents", "doc_id", "text") + ", w AS (" + words_sql("bits", 6) + """)
SELECT d.doc_id AS key, w.* EXCLUDE (key) FROM documents d LEFT JOIN w ON w.key = d.doc_id
WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)""")
def fp_incremental(spark, d):
    indexed = table(spark, d, "labels").select(F.col("doc_id").alias("key"))
    new = similarity.not_indexed(table(spark, d, "documents").select("doc_id", "text"), "doc_id", indexed)
    return _word_columns(similarity.fingerprint_table(new, "doc_id", "text"), "key")


@query("WITH" + fp_sql("documents", "doc_id", "text", "docs") + """
SELECT a.key AS doc_id, bit_count(xor(a.fp, b.fp))::BIGINT AS distance FROM docs a JOIN docs b ON b.key = a.key + 1""")
def custom_distance(spark, d):
    """A caller's own distance between fingerprints: the number of bits in which they differ."""
    def differing(a, b):
        return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, fpx.KEYS_WORDS)), F.bit_count(a[0].bitwiseXOR(b[0])))

    words = document_words(spark, d).withColumnRenamed("key", "doc_id").filter("words IS NOT NULL")
    pairs = similarity.pair_distances(_next_pairs(words.select("doc_id", "words")), differing, "words", "next_words")
    return pairs.select("doc_id", F.col("distance").cast("bigint").alias("distance"))
