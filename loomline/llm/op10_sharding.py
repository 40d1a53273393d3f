"""Uniform sharding with exact shard sizes, by a hypergeometric communication matrix.

The rows of a uniformly random permutation, cut into shards, fall from each part of the
input into each shard with multivariate hypergeometric counts.  So the counts are drawn
first, from the sizes of the parts alone: parts are leaves of a tree, and from the root on
each node's counts are dealt out to its children, level by level, by the tasks.  Each part
then permutes its own rows and deals them out by its counts, and each shard permutes what it
received.  Texts are not moved: their size and checksum are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.llm.common import materialize, packed, running_sum, unpacked

SEED = 20240917
#: Rows that one task ranks at once, about; a shard's permutation is made in pieces of this size.
PIECE_ROWS = 16384
#: Bits of a part's number that tell the children of a node apart, and those that tell the parts of one input task apart.
CHILD_BITS = 8
CHUNK_BITS = 33 - (PIECE_ROWS.bit_length() - 1)


def shard_sizes(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many good ones are among ``draws`` of ``good + bad``, by the exact law at any size.

    Neighbouring probabilities have simple ratios, so all that matter follow from that of the
    mode: those up to 12 standard deviations away, beyond which less is left than a double's
    last bit.  Then the distribution is inverted.
    """
    least, most = max(0, draws - bad), min(good, draws)
    if least == most:
        return least
    n = good + bad
    mode = (draws + 1) * (good + 1) // (n + 2)
    spread = int(12 * (draws * (good / n) * (bad / n) * ((n - draws) / max(1, n - 1))) ** 0.5) + 64
    k = np.arange(max(least, mode - spread), min(most, mode + spread) + 1, dtype=np.float64)
    step = np.log(good - k[:-1]) + np.log(draws - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - draws + k[:-1] + 1)
    logs = np.concatenate(([0.0], np.cumsum(step)))
    below = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(len(k) - 1, np.searchsorted(below, rng.random() * below[-1], side="right"))])


def communication_matrix(sizes: list[int], left: list[int], rng: np.random.Generator) -> np.ndarray:
    """Rows from each of some parts to each shard, if ``left`` of all their rows go to each shard."""
    left = [int(x) for x in left]
    matrix = np.zeros((len(sizes), len(left)), dtype=np.int64)
    for p, n in enumerate(sizes):
        pool, want = sum(left), int(n)
        for k, here in enumerate(left):
            pool -= here
            took = hypergeometric(rng, here, pool, want)
            matrix[p, k], want = took, want - took
        left = [a - int(b) for a, b in zip(left, matrix[p], strict=True)]
    return matrix


def _dealt(level: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        rng = np.random.default_rng([seed, level, table.column("parent")[0].as_py()])
        matrix = communication_matrix(table.column("n").to_pylist(), table.column("left")[0].as_py(), rng)
        return pa.table({"node": table.column("node"), "counts": pa.array(matrix.tolist(), pa.list_(pa.int64()))})

    return run


def drawn_counts(parts: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(node, counts) for parts (node long, n long): rows of each part that go to each shard.

    Each node of the tree has 2**CHILD_BITS children at most, so a task draws a small matrix,
    and the driver learns the number of rows and the largest node alone.
    """
    levels = [parts]
    total, last = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("node"), F.lit(0))).first()
    while last:
        last >>= CHILD_BITS
        up = levels[-1].groupBy(F.shiftright("node", CHILD_BITS).alias("node")).agg(F.sum("n").alias("n"))
        levels.append(materialize(up, "shard-tree"))
    root = parts.sparkSession.createDataFrame([(0, shard_sizes(total, shards))], "node long, counts array<long>")
    counts = root
    for level in reversed(range(len(levels) - 1)):
        children = levels[level].withColumn("parent", F.shiftright("node", CHILD_BITS))
        given = children.join(counts.select(F.col("node").alias("parent"), F.col("counts").alias("left")), "parent")
        counts = materialize(given.groupBy("parent").applyInArrow(_dealt(level, seed), "node long, counts array<long>"), "shard-counts")
    return counts


def shuffled_shards(rows: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    Every row goes to exactly one place, repeated rows too.  Columns may have any names but
    ``shard`` and ``slot``.  An empty input gives an empty result.
    """
    if {"shard", "slot"} & set(rows.columns):
        raise ValueError("the result has columns shard and slot of its own")
    columns = rows.columns
    # the numbering is written once: partition and row in it stay as they are from here on
    numbered = materialize(packed(rows).withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    # parts so small that one task can rank them, and so many that none is hot
    chunk = F.floor(F.col("_row").bitwiseAND((1 << 33) - 1) / PIECE_ROWS)
    numbered = numbered.withColumn("_part", F.shiftleft(F.shiftrightunsigned("_row", 33), CHUNK_BITS) + chunk)
    parts = materialize(numbered.groupBy(F.col("_part").alias("node")).agg(F.count("*").alias("n")), "shard-parts")
    bounds = F.transform("counts", lambda c, i: F.aggregate(F.slice("counts", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    dealt = drawn_counts(parts, shards, seed).select(F.col("node").alias("_part"), bounds.alias("_bounds"))

    chance = F.xxhash64(F.lit(seed), F.col("_row"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(chance, "_row"))
    local = numbered.withColumn("_rank", rank).join(dealt, "_part")
    placed = local.withColumn("shard", F.size(F.filter("_bounds", lambda b: b < F.col("_rank"))).cast("int"))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    done = _permute_shards(placed.drop("_part", "_rank", "_bounds"), total, shards, seed)
    return done.select(*unpacked(columns), "shard", "slot")


def _permute_shards(placed: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    """The second permutation: by random keys, whose ranges are ranked apart and then added up."""
    ranges = max(1, -(-total // (shards * PIECE_ROWS)))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col("_row")), 1)
    keyed = placed.withColumn("_key", key).withColumn("_range", F.pmod("_key", F.lit(ranges)))
    starts = running_sum(keyed.groupBy("shard", "_range").count(), "shard", "_range", "count", "_start").drop("count")
    rank = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_key", "_row"))
    return (
        keyed.withColumn("_rank", rank)
        .join(starts, ["shard", "_range"])
        .withColumn("slot", (F.col("_start") + F.col("_rank") - 1).cast("long"))
        .drop("_row", "_key", "_range", "_rank", "_start")
    )


def text_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    The law is ``rows``: counts of any two shards differ by one at most.  Null texts have
    size 1 and the checksum of the empty text; null ids are rows like any other; other
    columns are not read.  ``grown_shard`` is null: no promise holds when shards are added.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = docs.select(
        F.col(id_col).alias("doc_id"), text_size(F.col(text_col)).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    return shuffled_shards(small, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(rows: DataFrame, path: str, shards: int, seed: int = SEED) -> None:
    """Write whole rows as one folder per shard, each in slot order across its files."""
    placed = shuffled_shards(rows, shards, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
