"""Exact dedup by two-pass Bloom filtering (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm.registry import query, table
from shotweave.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
MAX_FILTER_WORDS = 1 << 21
HOT_GROUPS = 1000


def normal_text(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def _bloom(h: Column, words: int) -> tuple[Column, Column]:
    """Word of the filter and the three bits in it that stand for a hash."""
    word = F.pmod(h, F.lit(words))
    bits = F.lit(0).cast("long")
    for shift in (40, 46, 52):
        bit = F.shiftright(h, shift).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return word, bits


def repeated_filter(hashes: DataFrame, max_words: int = MAX_FILTER_WORDS) -> tuple[DataFrame, int]:
    """First pass: a blocked Bloom filter (64-bit words, three bits each) of the hashes seen more than once.

    ``hashes`` has one column ``h``. Copies are counted with partial sums before the shuffle, so a hash that holds a third of all rows
    sends one number per task. The filter gets 16 bits per repeated hash and never more than ``max_words`` words, which bounds
    what is broadcast (16 bytes a word); a fuller filter only lets more rows through to the exact second pass.
    """
    repeated = cut_lineage(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    words = 1024
    count = repeated.count()
    while words < max_words and words * 4 < count:
        words *= 2
    word, bits = _bloom(F.col("h"), words)
    return repeated.groupBy(word.alias("_word")).agg(F.bit_or(bits).alias("_bits")), words


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 max_words: int = MAX_FILTER_WORDS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without blanks; of equal texts the longest original, then the smallest id stays.
    The text is read once: a narrow table of ids, digests and lengths goes to the checkpoint folder. Its first pass fills the
    filter of repeated hashes. In the second pass rows that miss the filter are unique for certain and pass straight through;
    only the others shuffle. Groups with more than a thousandth of those rows (so at most 1000 of them) are joined by
    broadcast, the rest by a shuffle whose keys are all small.

    Null texts are empty; empty texts are equal to each other and to blank ones. A null id never stays while its group has
    another. Rows that repeat an id are counted one by one and share their result. Other columns are ignored; an empty
    table gives an empty result.
    """
    narrow = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(normal_text(F.col(text_col)), 256).alias("text_sha256"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("_chars"),
    )).withColumn("h", F.xxhash64("text_sha256"))
    bloom, words = repeated_filter(narrow.select("h"), max_words)
    word, bits = _bloom(F.col("h"), words)
    probed = narrow.withColumn("_word", word).join(F.broadcast(bloom), "_word", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(bits) == bits, F.lit(False))
    unique = probed.filter(~hit).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    maybe = probed.filter(hit).select("doc_id", "text_sha256", "_chars")
    best = F.max(F.struct("_chars", (-F.col("doc_id")).alias("neg")))
    groups = cut_lineage(maybe.groupBy("text_sha256").agg(
        best.alias("best"), F.count(F.lit(1)).alias("group_size")
    ).select("text_sha256", (-F.col("best.neg")).alias("keep_id"), "group_size"))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    large = F.col("group_size") * HOT_GROUPS > total
    hot = groups.filter(large)
    seen = maybe.join(F.broadcast(hot), "text_sha256", "left")
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    in_hot = seen.filter(F.col("group_size").isNotNull()).select(columns)
    rest = seen.filter(F.col("group_size").isNull()).select("doc_id", "text_sha256")
    in_cold = rest.join(groups.filter(~large), "text_sha256").select(columns)
    out = unique.unionByName(in_hot).unionByName(in_cold)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256")


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not in use."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def split_by_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id",
                 max_words: int = MAX_FILTER_WORDS) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: rows that may have an id of the one-column table ``ids``, and rows that certainly have none.

    The test is a Bloom filter of the ids, bounded as above, so neither part needs a shuffle; all columns stay.
    """
    words = 1024
    count = ids.count()
    while words < max_words and words * 4 < count:
        words *= 2
    w, b = (fresh(x, docs.columns) for x in ("_word", "_bits"))
    word, bits = _bloom(F.xxhash64(ids.columns[0]), words)
    bloom = ids.groupBy(word.alias(w)).agg(F.bit_or(bits).alias(b))
    word, bits = _bloom(F.xxhash64(docs[id_col]), words)
    probed = docs.withColumn(w, word).join(F.broadcast(bloom), w, "left")
    hit = F.coalesce(F.col(b).bitwiseAND(bits) == bits, F.lit(False))
    return probed.filter(hit).select(*docs.columns), probed.filter(~hit).select(*docs.columns)


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", max_words: int = MAX_FILTER_WORDS) -> DataFrame:
    """Rows of ``docs`` whose id is not in the one-column table ``gone``; all columns stay. Only rows that hit the filter of
    dropped ids shuffle, for an exact anti-join."""
    g = fresh("_gone", docs.columns)
    gone = cut_lineage(gone.select(F.col(gone.columns[0]).cast("long").alias(g)).distinct())
    maybe, never = split_by_ids(docs.withColumn(id_col, F.col(id_col).cast("long")), gone, id_col, max_words)
    return never.unionByName(maybe.join(gone, F.col(id_col).eqNullSafe(F.col(g)), "left_anti"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns; see :func:`exact_groups` for which those are."""
    gone = exact_groups(docs, id_col, text_col).filter("not kept").select("doc_id")
    return without(docs, gone, id_col)


@query("""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(body) DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
""")
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"))
