"""Exact deduplication against a persistent digest index.

The index is a table of digests, bucketed and sorted by digest. A batch is reduced to one row per digest, a sort-merge
anti-join against the index leaves the digests that are new, and these are appended under the batch's name. A later batch
meets only the index, never the texts of earlier batches. A batch that is run again under its name meets what the other
batches brought, so that a retried stage decides as it did the first time.

The number of buckets is stored beside the index; opening it with another one is an error.

Native: DataFrame functions only.

Defined results: a null text counts as empty; a null doc_id loses against any other and stays only in a group that has
no other; repeated rows (same doc_id, same text) share one decision and count separately in group_size, and of those that
keep_first_rows would keep the one whose other columns have the least digest stays; an empty table gives an empty result
and an empty index; other columns of the input are ignored or kept, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.session import materialize, path_exists, qualified, release, remove, work_path


def digest(text: Column) -> Column:
    """The 32 bytes of SHA-256 over the UTF-8 text, null as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class DigestIndex:
    """Digests seen so far, with the document that stands for each: digest BINARY, keep_id BIGINT, batch STRING."""

    SCHEMA = "digest binary, keep_id bigint, batch string"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = qualified(spark, path or work_path(spark, "digest-index"))
        self.facts = f"{self.path}.facts"
        if path_exists(spark, self.facts):
            self.buckets = spark.read.schema("buckets int").json(self.facts).first()["buckets"]
            if buckets is not None and buckets != self.buckets:
                raise ValueError(f"the index in {self.path} has {self.buckets} buckets, not {buckets}")
        else:
            if path_exists(spark, self.path):
                raise ValueError(f"{self.path} is no digest index")
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.json(self.facts)
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} ({self.SCHEMA}) USING parquet CLUSTERED BY (digest) "
                f"SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )

    def entries(self) -> DataFrame:
        """Bucketed and sorted: joins on digest read it without a shuffle."""
        return self.spark.table(self.name)

    def before(self, batch: str) -> DataFrame:
        """What other batches have brought: digest, keep_id."""
        return self.entries().where(F.col("batch") != batch).select("digest", "keep_id")

    def append(self, fresh: DataFrame, batch: str) -> None:
        """Add digests (digest, keep_id) that are new with this batch; those of an earlier run of it are there already."""
        own = self.entries().where(F.col("batch") == batch).select("digest")
        rows = fresh.select("digest", "keep_id").join(own.hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch))
        (
            rows.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.name)
        )

    def drop(self) -> None:
        """Delete the index for good."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)
        remove(self.spark, self.facts)


def groups_of(docs: DataFrame) -> DataFrame:
    """One row per distinct text: digest, keep_id (largest doc_id), group_size; copies are summed where they are read."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text")).alias("digest"))
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def decide(groups: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """digest, keep_id, group_size, fresh for the groups of a batch; fresh ones go into the index.

    groups: digest, keep_id, group_size, which is released if it is a written table. A text that another batch has brought
    keeps that batch's document.
    """
    fresh = materialize(groups.join(index.before(batch).hint("merge"), "digest", "left_anti"), "digest-fresh")
    index.append(fresh, batch)
    known = groups.drop("keep_id").join(index.before(batch).hint("merge"), "digest")
    columns = ["digest", "keep_id", "group_size"]
    decided = fresh.select(*columns, F.lit(True).alias("fresh")).unionByName(known.select(*columns, F.lit(False).alias("fresh")))
    # Written, so that what follows deals both of its sides and a large group is split at run time.
    out = materialize(decided, "digest-decisions")
    release(fresh, groups)
    return out


def mark_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept for every row, by its text's decision."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text")).alias("digest"))
    kept = F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.join(decided, "digest").select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))


def dedup_batch(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Decide on every row of a batch and add its new digests to the index.

    Returns doc_id, digest, keep_id, group_size (rows of this batch with the text), kept. Texts that an earlier batch
    has brought are dropped in favour of the earlier document.
    """
    groups = materialize(groups_of(docs), "digest-groups")
    return mark_rows(docs, decide(groups, index, batch or uuid.uuid4().hex))


def keep_first_rows(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows that stay, with all their columns: one for each text that the index did not hold before the batch."""
    counted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text")).alias("digest")).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    top = counted.groupBy("digest").agg(F.max(F.struct("doc_id", "copies")).alias("top"))
    groups = materialize(top.select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.copies").alias("group_size")), "digest-groups")
    fresh = decide(groups, index, batch or uuid.uuid4().hex).where("fresh").select("digest", "keep_id", F.col("group_size").alias("copies"))
    # The whole row is one value, so that no name of its columns can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text")).alias("digest"))
    rows = rows.join(fresh, "digest").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    once = rows.where("copies = 1").select("row")
    # Copies of one row in all but other columns: the one with the least digest, found with partial aggregation.
    many = rows.where("copies > 1").groupBy("digest").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row")).select("row")
    return once.unionByName(many).select("row.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions over all documents, which come to a new index in two batches.

    The batch of the greater doc_ids comes first, so that the index's rule (the earlier document stays) keeps the largest
    doc_id of all. Group sizes add up over the batches.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    middle = docs.agg(F.expr("min(doc_id) div 2 + max(doc_id) div 2")).first()[0] or 0
    late = F.coalesce(F.col("doc_id") > middle, F.lit(False))
    index, decided = DigestIndex(spark), None
    for batch, part in (("greater", docs.where(late)), ("lesser", docs.where(~late))):
        own = decide(materialize(groups_of(part), "digest-groups"), index, batch)
        decided = own if decided is None else decided.unionByName(own)
    # The fresh row of a digest names its document; the other batch's row repeats it.
    total = materialize(decided.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.lit(True).alias("fresh")), "digest-totals")
    index.drop()
    return mark_rows(docs, total).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
