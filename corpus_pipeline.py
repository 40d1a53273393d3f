"""A corpus pipeline: toxicity, line dedup, near-dedup, mixing, packing.

Each stage works on the table that the one before it wrote.  All but the last return the
columns of ``documents``; the last returns the packing.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import materialize, release, scratch_tables
from loomline.llm.op01_toxicity import reject_toxic
from loomline.llm.op04_mixing import mixed_texts
from loomline.llm.op06_packing import pack_documents
from loomline.llm.op07_line_dedup import dedup_lines
from loomline.llm.op09_simhash import similar_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

_order: list[str] = []
_scratch: dict[str, list] = {}


def _stage(function):
    """A stage.  When it begins, what earlier stages left in the scratch folder goes: their results are written by then.

    Only tables that stages of this pipeline made are deleted, and never those of the same
    stage, so other queries of the session, and a second call, keep theirs.
    """
    name = function.__name__
    earlier = list(_order)
    _order.append(name)

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for n in earlier:
            release(_scratch.pop(n, []))
        before = scratch_tables()
        result = function(spark, docs.select(*COLUMNS), sf_dir)
        _scratch.setdefault(name, []).extend(t for t in scratch_tables() if t not in before)
        return result

    return run_stage


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the others stay as they are.

    Null texts score like empty ones; repeated rows get equal scores and stay or go together;
    rows with a null id teach nothing and are scored like any other; without labels of both
    kinds every score is the share of toxic labels; an empty table gives an empty result.
    """
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; a document of which nothing is left goes with them.

    Null and empty texts stay as they are.  Of equal runs the one with the smallest id stays,
    null ids last; rows with the same id and text are one document and keep the same text.
    """
    done = dedup_lines(docs)
    left = done.where((F.col("deleted_lines") == 0) | (F.col("text") != ""))
    return left.withColumn("n_chars", F.when(F.col("deleted_lines") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Pairs with a similarity of 0.8 or more of their five-word shingles are near-duplicates;
    SimHash finds them, and their shingles are compared.
    Rows without an id stay if their whole group has none.  Rows that share the smallest id
    stay together.
    """
    found = similar_documents(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    stay = materialize(found, "near-dedup-stay")
    return docs.join(stay.select(F.col("doc_id").alias("_id")), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often, and with those of its blocks, as the mix takes.

    Null and empty texts have no words to take and go; null sources are one source, the
    last; of rows with equal id, text and source each has its own place in the mix; an empty
    table gives an empty result.
    """
    return mixed_texts(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens.

    Null and empty texts are an end token alone; null ids and repeated rows are packed like
    any other; an empty table gives an empty result.
    """
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: A learned classifier, an iteration and pseudorandom draws: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(written)  # the input of this stage, which its written result no longer needs
        written = scratch_tables()[-1:]
    return docs
