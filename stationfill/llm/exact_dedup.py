"""Exact deduplication against a persistent digest index, in DataFrame operations only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationfill.llm.common import Scratch

#: Texts are equal after each run of these bytes becomes one space.
WHITE_RUN = r"[\x20\x09-\x0D]+"


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_RUN, " "), 256))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the SHA-256 of each normalised text as 32 bytes; a null text is empty, and equals an empty text."""
    return docs.select(F.col(doc_id).alias("doc_id"), digest_of(F.col(text)).alias("digest"))


class DigestIndex:
    """A table of the digests seen so far, bucketed and sorted by digest.

    ingest() compares a batch with it by a sort-merge anti-join and appends what is new. Each digest has one
    row: the smallest doc_id of the batch that brought it. The table stays in the warehouse between batches.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        """`buckets` (by default the session's shuffle partitions) only counts for a new table; one that exists keeps its own."""
        self.spark, self.name = spark, name
        self.buckets = self._own_buckets() or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def _own_buckets(self) -> int:
        """The bucket count that the table was made with; 0 without a table."""
        if not self.exists():
            return 0
        return int(self.spark.sql(f"DESCRIBE EXTENDED {self.name}").filter("col_name = 'Num Buckets'").first()["data_type"])

    def append(self, new: DataFrame) -> None:
        """One file a bucket: rows are dealt by the bucket's own hash before they are written."""
        (
            new.select("digest", "keep_id")
            .repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .format("parquet")
            .saveAsTable(self.name)
        )

    def compact(self) -> None:
        """One sorted file a bucket again, after many appended batches. The old table stays until the new one is whole."""
        whole = DigestIndex(self.spark, f"{self.name}_{uuid.uuid4().hex}", self.buckets)
        whole.append(self.spark.read.parquet(*self.spark.table(self.name).inputFiles()))  # as plain files, which the deal isn't left out for
        old = f"{whole.name}_old"
        self.spark.sql(f"ALTER TABLE {self.name} RENAME TO {old}")
        self.spark.sql(f"ALTER TABLE {whole.name} RENAME TO {self.name}")
        self.spark.sql(f"DROP TABLE {old}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def ingest(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """One row per row of docs: doc_id, keep_id, group_size, kept, known, digest.

        group_size counts the rows of the batch with that text. Where the index knew the text from another document
        (`known`), keep_id is that document's and no row of the batch is kept; otherwise the row with the smallest doc_id is.
        A document that the index itself holds is kept again: a batch that comes twice, as after a failure, gets the same
        answer twice. Repeated rows of one doc_id are one document: they get the same answer. A row without doc_id is kept
        if no row of its text has one and the text is new; it can't be told from another when it comes again. An empty batch
        gives no rows.
        """
        spark, scratch = self.spark, Scratch(self.spark, "digests")
        rows = scratch.save(digests(docs, doc_id, text), "rows")
        # Counted before the shuffle, so a text with a third of all rows arrives as one row per task.
        groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_size"))
        groups = scratch.save(groups, "groups")
        if not self.exists():
            self.append(groups.limit(0).withColumnRenamed("first_id", "keep_id"))
        index = spark.table(self.name)
        fresh = groups.hint("merge").join(index, "digest", "left_anti").withColumnRenamed("first_id", "keep_id")
        fresh = scratch.save(fresh, "fresh")
        again = F.coalesce(F.col("first_id") == F.col("keep_id"), F.lit(False))
        known = groups.hint("merge").join(index, "digest").select("digest", "keep_id", "group_size", (~again).alias("known"))
        found = scratch.save(known.unionByName(fresh.withColumn("known", F.lit(False)).select("digest", "keep_id", "group_size", "known")), "found")
        self.append(fresh)
        # Both sides are plain tables, so that adaptive execution can split the partition of a frequent text.
        kept = F.when(F.col("keep_id").isNull(), ~F.col("known") & F.col("doc_id").isNull()).otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)))
        answer = rows.hint("merge").join(found, "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "known", "digest")
        answer = scratch.save(answer, "answer")
        scratch.drop("rows", "groups", "fresh", "found")
        return answer


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest; of equal texts the row with the smallest doc_id is kept.

    The table comes to a new index as new data would: in batches by ascending doc_id, rows without one last, so that the
    index knows the smallest doc_id of a text before any other. group_size counts over all batches. Repeated, missing and
    empty as in DigestIndex.ingest.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "dedup")
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    number = F.col(doc_id).cast("long")
    least, most = docs.agg(F.min(number), F.max(number)).first()
    edges = [] if least is None else [least + (most - least) * k // batches for k in range(1, batches)]
    answers = []
    for k in range(len(edges) + 1):
        here = F.lit(True)
        if k:
            here = number > edges[k - 1]
        if k < len(edges):
            here = here & (number <= edges[k])
        elif k:
            here = here | number.isNull()
        answers.append(index.ingest(docs.filter(here), doc_id, text))
    rows = answers[0]
    for more in answers[1:]:
        rows = rows.unionByName(more)
    sizes = scratch.save(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size")), "sizes")
    found = rows.drop("group_size").hint("merge").join(sizes, "digest").select("doc_id", "keep_id", "group_size", "kept", "digest")
    found = scratch.save(found, "found")
    scratch.drop("sizes")
    index.drop()
    return found
