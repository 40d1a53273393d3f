"""Schema drift over a stream of JSON documents: each micro-batch against a known schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomline.functions.types import compare_types
from loomline.sources.databases import infer_documents


def drift(batch: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """field_name, change for fields of a batch against ``known`` (field_name, type): added, missing, retyped."""
    found = infer_documents(batch, column, None).select("field_name", F.col("type").alias("now"))
    joined = known.select("field_name", F.col("type").alias("was")).join(found, "field_name", "full_outer")
    change = (
        F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "missing")
        .when(compare_types(F.col("was"), F.col("now")).isin("identical", "compatible"), None).otherwise("retyped")
    )
    return joined.withColumn("change", change).where("change is not null").select("field_name", "change")


def watch(stream: DataFrame, column: str, known: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append the drift of each micro-batch to ``sink`` (Parquet, by batch, so that a repeated batch replaces itself)."""

    def batch(df: DataFrame, number: int) -> None:
        drift(df, column, known).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
