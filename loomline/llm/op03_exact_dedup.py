"""Exact deduplication by progressive refinement.

Rows are told apart by the cheapest key first: the length of the normalised text, then a
hash of its first characters, and only the rows whose (length, prefix hash) still occurs
twice have their whole text hashed.  No text is ever shuffled: the surviving keys go to the
second scan as a bitmap of fixed size, in which a set bit costs at most a hash that was not
needed and a clear bit proves that a row is alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import flagged, materialize, survivors_bitmap

#: Characters of the normalised text that the second key covers.
PREFIX_CHARS = 64


def normalized(text: Column) -> Column:
    """Every run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # one projection for the text, so that its normal form is computed once for both keys
    return (
        docs.select(F.col(id_col).alias("doc_id"), normalized(F.col(text_col)).alias("norm"))
        .select("doc_id", "norm", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix"))
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: str = "surviving") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the smallest id of each group of equal normalised texts is kept.
    Null ids come after all others; of rows that share the smallest id exactly one is
    kept.  Null and empty texts are equal to each other (and to no text of white space,
    which normalises to one space).  Other columns are not read.  An empty table gives
    an empty result.  ``digests="surviving"`` leaves text_sha256 null where the shorter
    keys already proved a row to be alone; ``"all"`` fills it for every row.
    """
    keys = materialize(_sized(docs, id_col, text_col).select("len", "prefix"), "dedup-keys")
    by_length = keys.groupBy("len").count().where("count > 1").select("len")
    by_prefix = keys.join(materialize(by_length, "dedup-len"), "len").groupBy("len", "prefix").count().where("count > 1")

    keyed = by_prefix.select(F.xxhash64("len", "prefix").alias("key"))
    marked = flagged(_sized(docs, id_col, text_col).withColumn("key", F.xxhash64("len", "prefix")), "key", survivors_bitmap(keyed, "key"))
    digest = F.sha2(F.encode("norm", "UTF-8"), 256)
    hashed = materialize(
        marked.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.col("_held").alias("survives"),
            (digest if digests == "all" else F.when(F.col("_held"), digest)).alias("text_sha256"),
        ),
        "dedup-hashed",
    )

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = materialize(
        hashed.where("survives").groupBy("text_sha256").agg(first, F.count("*").alias("n")).where("n > 1"), "dedup-groups"
    )
    return hashed.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("row") == F.col("first.row"))).alias("kept"),
        "text_sha256",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs, digests="all")


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
