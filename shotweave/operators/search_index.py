"""A search table that outlives its query: bucketed Parquet that is appended to and searched without being rebuilt."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotweave.functions import fingerprints as fpx
from shotweave.operators import similarity
from shotweave.session import cut_lineage, ensure_checkpoint_dir

BUCKETS = 32
MOST_RESULTS = 64


@dataclass
class BandIndex:
    """Two bucketed tables under ``path``: ``prints`` (the indexed keys and fingerprints, by key) and ``postings`` (each distinct
    fingerprint of a batch under each of its MinHash bands, by posting).

    Layout, bands and rows are those of :func:`similarity.nearest_lsh`. A batch is written behind what is there; equal fingerprints of
    a batch are one posting with their ``most`` smallest keys, so a copy group does not make a long list. Searches join the shuffled
    queries with the postings where these lie. :meth:`open` finds the files of another session by their path.
    """

    spark: SparkSession
    path: str
    name: str
    bands: int = 16
    rows: int = 8
    n_bits: int = fpx.KEYS_BITS
    n_words: int = fpx.KEYS_WORDS
    buckets: int = BUCKETS
    most: int = MOST_RESULTS

    SCHEMAS = {"prints": ("key bigint, fp binary, pc int", "key"),
               "postings": ("posting bigint, fp binary, pc int, members array<bigint>", "posting")}

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None, **settings) -> BandIndex:
        """The index at ``path`` (default: a new folder under ``spark.checkpoint.dir``), empty if nothing is there yet. Settings must be
        those it was made with."""
        if path is None:
            ensure_checkpoint_dir(spark)
            path = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
        index = cls(spark, path, f"index_{uuid.uuid4().hex}", **settings)
        for table, (schema, by) in cls.SCHEMAS.items():
            spark.sql(f"CREATE TABLE {index.name}_{table} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
                      f"INTO {index.buckets} BUCKETS LOCATION '{path}/{table}'")
        return index

    def table(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def close(self) -> None:
        """Forget the tables' names; the files stay."""
        for table in self.SCHEMAS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")

    def _write(self, df: DataFrame, table: str) -> None:
        by = self.SCHEMAS[table][1]
        # Dealt as the buckets are, so that a batch adds one file to a bucket.
        (df.repartition(self.buckets, by).write.mode("append").format("parquet").bucketBy(self.buckets, by).sortBy(by)
         .option("path", f"{self.path}/{table}").saveAsTable(f"{self.name}_{table}"))

    def _posted(self, distinct: DataFrame) -> DataFrame:
        band_keys = similarity._band_keys(self.n_bits, self.bands, self.rows, 0)
        spread = distinct.repartition(similarity.task_slots(self.spark), "fp")
        keyed = spread.select("*", F.posexplode(band_keys("fp")).alias("_band", "_key"))
        return keyed.withColumn("posting", F.xxhash64("_band", "_key")).drop("_band", "_key")

    def missing(self, df: DataFrame, key: str) -> DataFrame:
        """Rows of ``df`` whose key is not indexed yet."""
        return df.join(self.table("prints").select(F.col("key").alias(key)), key, "left_anti")

    def append(self, prints: DataFrame) -> None:
        """Index ``prints(key, words)``. Rows without a set bit are left out; a key must not come twice."""
        encoded = similarity._encoded(prints, [])
        distinct = similarity._distinct(encoded, [similarity.GROUP], self.most)
        self._write(self._posted(distinct).select("posting", "fp", "pc", "members"), "postings")
        self._write(encoded.select("key", "fp", "pc"), "prints")

    def found(self, asked: DataFrame, k: int) -> DataFrame:
        """``fp, hits``: the first ``k`` indexed rows that share a band with each distinct fingerprint of ``asked(fp, pc)``."""
        if k > self.most:
            raise ValueError(f"the index holds {self.most} rows of a copy group")
        ask = self._posted(asked.select("fp", "pc")).select("posting", F.col("fp").alias("_q"), F.col("pc").alias("_qn"))
        pairs = ask.join(self.table("postings").hint("merge"), "posting")
        shared = fpx.shared_bits(fpx.bytes_to_words(F.col("_q"), self.n_words), fpx.bytes_to_words(F.col("fp"), self.n_words), self.n_words)
        distance = F.lit(1.0) - F.col("_both").cast("double") / (F.col("_qn") + F.col("pc") - F.col("_both"))
        near = pairs.withColumn("_both", shared).select("posting", F.col("_q").alias("fp"), distance.alias("distance"), F.explode("members").alias("key"))
        # What a list can add to a query is cut where the join left its pairs.
        order = Window.partitionBy("posting", "fp").orderBy("distance", "key")
        few = near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
        return similarity._best_rows(few.withColumn(similarity.GROUP, F.lit(0)), [similarity.GROUP], k)

    def search(self, queries: DataFrame, k: int, certainty: float = 0.95) -> DataFrame:
        """``query_id, rank, key, distance`` of the ``k`` nearest indexed rows of ``queries(key, words)``.

        As in :func:`similarity.nearest_lsh`, a query stops after the bands if its last hit is near enough; the others search the indexed
        fingerprints exactly, from the similarity the bands reached.
        """
        inner = [similarity.GROUP]
        rows = similarity._encoded(queries, [])
        asked = cut_lineage(similarity._distinct(rows, inner, 1).drop("members"))
        seen = cut_lineage(self.found(asked, k))
        served, floor = certified(k, self.bands, self.rows, certainty)
        state = seen.select(*inner, "fp", served.alias("_done"), floor.alias("floor"))
        left = cut_lineage(asked.join(state, [*inner, "fp"], "left").filter(~F.coalesce("_done", F.lit(False))).select(
            *inner, "fp", "pc", F.greatest(F.coalesce("floor", F.lit(0.0)), F.lit(0.0)).alias("floor")))
        best = seen.filter(served)
        if not left.isEmpty():
            stored = self.table("prints").select(F.lit(0).alias(similarity.GROUP), "key", "fp", "pc")
            corpus = cut_lineage(similarity._distinct(stored, inner, k))
            best = best.unionByName(similarity._exact(left, corpus, inner, k, 0.0, similarity.BLOCK_ROWS, False))
        return similarity._per_row(rows, best, inner, k, False, [])


def certified(k: int, bands: int, rows: int, certainty: float) -> tuple[Column, Column]:
    """Whether a query's ``hits`` may stand, and the similarity its search may start from."""
    last, enough = F.element_at("hits", k)["distance"], F.size("hits") >= k
    near = last <= F.lit(1.0 - similarity.certain_similarity(bands, rows, certainty))
    return F.coalesce(enough & near, F.lit(False)), F.when(enough, 1.0 - last - similarity.SLACK)
