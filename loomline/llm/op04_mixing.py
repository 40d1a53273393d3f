"""Mixing sources to target weights.

Each source's words are packed end to end into blocks of fixed length.  The slots of the
output shards draw their sources at random, so each shard's counts are multinomial; what a
source drew beyond its quota is settled with the sources that drew too little.  The j-th
slot of a source takes the block that the source's pseudorandom index permutation gives to
j modulo its number of blocks, and the blocks are joined by that index.  All of it is
DataFrame expressions, and no step gathers a source: offsets and ranks are found in small
pieces whose totals are added up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.llm.common import let, located, materialize, packed, permuted, row_key, running_sum, unpacked, word_count

SEED = 7


@dataclass(frozen=True)
class MixSettings:
    """``cycle``: weights of the sources in order of their names, repeated.  ``cap``: most epochs of a source."""

    block_words: int = 64
    shard_slots: int = 4096
    cycle: tuple[int, ...] = (1, 2, 3)
    cap: int = 3
    piece_docs: int = 2048


def source_targets(sized: DataFrame, settings: MixSettings) -> DataFrame:
    """One row per source: sid, source, source_size, weight, target, blocks, quota.

    Targets share all words by weight; a source stops at ``cap`` times its size and the
    others share the rest.  Sorted by how soon they fill up, the full sources are a prefix,
    so the common level of the others follows from running sums.
    """
    b = settings.block_words
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in settings.cycle])
    ranked = totals.withColumn("sid", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(weights, (F.pmod("sid", F.lit(len(settings.cycle))) + 1).cast("int"))
    )
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    whole = Window.partitionBy()
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("above", F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("heavy", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - settings.cap * F.col("above")) / F.col("heavy"))
        .withColumn("full", F.col("level") * F.col("weight") > settings.cap * F.col("source_size"))
        .withColumn("common", F.max(F.when(~F.col("full"), F.col("level"))).over(whole))
        .withColumn(
            "target",
            F.when(F.col("full"), (settings.cap * F.col("source_size")).cast("double")).otherwise(F.col("common") * F.col("weight")),
        )
        .withColumn("blocks", F.ceil(F.col("source_size") / b))
        .withColumn(
            "quota",
            F.when(F.col("source_size") == 0, F.lit(0)).otherwise(
                F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), settings.cap * F.col("blocks"))
            ).cast("long"),
        )
    )
    return ranked.select("sid", "source", "source_size", "weight", "target", "blocks", "quota")


def _prefix(df: DataFrame, value: str, name: str, order: str = "sid") -> DataFrame:
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def drawn_blocks(spark: SparkSession, sources: DataFrame, settings: MixSettings, seed: int = SEED) -> DataFrame:
    """The mix: one row per output slot with shard, slot, sid and block; ``sources`` is a written table."""
    slots = int(sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0])
    intervals = _prefix(sources.where("quota > 0"), "quota", "lo").select("sid", "lo", (F.col("lo") + F.col("quota")).alias("hi"))
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("slot")), F.lit(max(1, slots)))
    shard = F.floor(F.col("slot") / settings.shard_slots)
    drawn = located(
        spark.range(slots).select(F.col("id").alias("slot")).withColumn("shard", shard).withColumn("chance", chance),
        "chance", intervals, slots,
    ).select("shard", "slot", "sid")

    counts = materialize(drawn.groupBy("shard", "sid").count(), "mix-counts")
    base = running_sum(counts, "sid", "shard", "count", "base").select("shard", "sid", "base")
    settled = (
        sources.where("quota > 0").select("sid", "quota", "blocks")
        .join(counts.groupBy("sid").agg(F.sum("count").alias("drew")), "sid", "left")
        .withColumn("drew", F.coalesce("drew", F.lit(0)))
        .withColumn("over", F.greatest(F.col("drew") - F.col("quota"), F.lit(0)))
        .withColumn("lacks", F.greatest(F.col("quota") - F.col("drew"), F.lit(0)))
    )
    settled = materialize(_prefix(_prefix(settled, "over", "over_start"), "lacks", "lo"), "mix-settled")
    excess = int(settled.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0])

    within = Window.partitionBy("shard", "sid").orderBy("slot")  # at most shard_slots rows
    ranked = (
        drawn.withColumn("rank", F.row_number().over(within) - 1)
        .join(base, ["shard", "sid"])
        .withColumn("j", F.col("base") + F.col("rank"))
        .join(settled.select("sid", "quota", "blocks", "over_start"), "sid")
    )
    inside = ranked.where("j < quota").select("shard", "slot", "sid", "j", "blocks")
    takers = settled.select(
        F.col("sid"), "blocks", F.col("drew"), F.col("lo").alias("first"), "lo", (F.col("lo") + F.col("lacks")).alias("hi")
    )
    moved = located(
        ranked.where("j >= quota").select("shard", "slot", (F.col("over_start") + F.col("j") - F.col("quota")).alias("nth")),
        "nth", takers, max(1, excess),
    ).select("shard", "slot", "sid", (F.col("drew") + F.col("nth") - F.col("first")).alias("j"), "blocks")
    epoch = F.floor(F.col("j") / F.col("blocks"))
    return inside.unionByName(moved).select(
        "shard", "slot", "sid",
        permuted(F.pmod("j", F.col("blocks")), F.col("blocks"), F.xxhash64(F.lit(seed), "sid", epoch)).alias("block"),
    )


def _placed(sized: DataFrame, sources: DataFrame, settings: MixSettings, seed: int) -> DataFrame:
    """Rows with sid and ``start``, the words of their source before them, in an order made by hashing."""
    keys = ["sid", "piece", "mixed", "key_a", "key_b", "doc_id", "size"]
    pieces = max(1, -(-sized.count() // settings.piece_docs))
    mixed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key_a", "key_b"), 1)
    # equal rows are one row with a number of copies until their places are known
    groups = (
        sized.withColumn("mixed", mixed)
        .withColumn("piece", F.pmod("mixed", F.lit(pieces)))
        .join(sources.select("sid", F.col("source").alias("name")), F.col("source").eqNullSafe(F.col("name")))
        .groupBy(*keys).agg(F.count("*").alias("copies"))
    )
    groups = materialize(groups, "mix-rows")
    sums = groups.groupBy("sid", "piece").agg(F.sum(F.col("size") * F.col("copies")).alias("n"))
    starts = running_sum(sums, "sid", "piece", "n", "piece_start").select("sid", "piece", "piece_start")
    inside = Window.partitionBy("sid", "piece").orderBy("mixed", "key_a", "key_b", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        groups.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
        .join(starts, ["sid", "piece"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("start", F.col("piece_start") + F.col("before") + F.col("copy") * F.col("size"))
        .select("sid", "doc_id", "key_a", "key_b", "size", "start")
    )


def mixed_pieces(docs: DataFrame, settings: MixSettings = MixSettings(), seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(pieces, sources): each row of ``docs`` cut at block borders, with the uses of each block.

    Pieces: sid, doc_id, key_a, key_b, size, start, first (words of the row before the
    piece), words, uses.  A row without words has one piece with null words and no uses.
    """
    spark = docs.sparkSession
    b = settings.block_words
    sized = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            *row_key(id_col, text_col, source_col),
        ),
        "mix-sized",
    )
    sources = materialize(source_targets(sized, settings), "mix-sources")
    uses = drawn_blocks(spark, sources, settings, seed).groupBy("sid", "block").agg(F.count("*").alias("uses"))
    end = F.col("start") + F.col("size")
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b)))
    pieces = (
        _placed(sized, sources, settings, seed)
        .withColumn("block", F.explode_outer(blocks))
        .withColumn("from", F.greatest(F.col("start"), F.col("block") * b))
        .withColumn("words", F.least(end, (F.col("block") + 1) * b) - F.col("from"))
        .withColumn("first", F.col("from") - F.col("start"))
        .join(uses, ["sid", "block"], "left")
        .select("sid", "doc_id", "key_a", "key_b", "size", "start", "first", "words", F.coalesce("uses", F.lit(0)).alias("uses"))
    )
    return pieces, sources


def mix_documents(docs: DataFrame, settings: MixSettings = MixSettings(), seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of documents.

    Sizes are words; null and empty texts have none and are not taken.  Null sources are
    one source, the last.  Rows with equal id, text and source each have their own place.
    No row is taken more than ``cap`` times its size, and reruns agree.
    """
    pieces, sources = mixed_pieces(docs, settings, seed)
    taken = pieces.groupBy("sid", "start", "doc_id", "key_a", "key_b", "size").agg(
        F.coalesce(F.sum(F.col("words") * F.col("uses")), F.lit(0)).alias("taken"), F.count("*").alias("n_pieces"), F.count("words").alias("n_filled")
    )
    # rows without words share their place: equal ones come back as often as they came
    taken = taken.withColumn("_n", F.explode(F.sequence(F.lit(1), F.when(F.col("size") == 0, F.col("n_pieces")).otherwise(F.lit(1)))))
    return taken.join(sources, "sid").select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, settings: MixSettings = MixSettings(), seed: int = SEED) -> DataFrame:
    """The mix as documents: each row once for every epoch that takes words of it.

    The k-th copy of a row has the words of its blocks that the mix uses k times or more,
    with the white space that follows each.  Columns stay those of the input, n_chars is
    recomputed.  Needs columns doc_id, text, source and n_chars; of rows with equal id, text
    and source one stands for all, and other columns pass through whatever their names.
    """
    pieces, _ = mixed_pieces(docs, settings, seed)
    # equal rows are told apart by the place alone, so their plans are dealt out in its order
    plans = (
        pieces.where("uses > 0")
        .groupBy("key_a", "key_b", "start")
        .agg(F.array_sort(F.collect_list(F.struct("first", "words", "uses"))).alias("plan"), F.max("uses").alias("most"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"))))
        .withColumn("plan", F.filter("plan", lambda p: p["uses"] >= F.col("copy")))
        .select("key_a", "key_b", "plan")
    )
    own = ["doc_id", "text", "source", "n_chars"]
    once = packed(docs, *own).select("*", *row_key("doc_id", "text", "source")).dropDuplicates(["key_a", "key_b"])
    whole = F.expr("size(plan) > 0 and plan[0].first = 0 and aggregate(plan, 0L, (a, p) -> a + p.words) = _words")
    tokens = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*', 0)")

    def cut(t: Column) -> Column:
        part = lambda p: F.slice(t, (p["first"] + 1).cast("int"), p["words"].cast("int"))
        return F.array_join(F.flatten(F.transform("plan", part)), "")

    joined = once.join(plans, ["key_a", "key_b"]).withColumn("_words", word_count(F.col("text")))
    text = F.when(whole, F.col("text")).otherwise(let(tokens, cut))
    return joined.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*unpacked(docs.columns, *own))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
