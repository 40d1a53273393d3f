"""Helpers that the corpus operators share: scratch tables, word expressions, bijections."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space of every contract here: space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written tables: ``spark.checkpoint.dir`` where the cluster names one.

    Only where it is unset and all of Spark runs in one process (as in tests) a temporary
    folder of this machine is taken, and remembered in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("loomline.scratch.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("loomline.scratch.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts lineage durably: a lost executor costs no more than the stage that was
    running, and what was drawn or numbered in ``df`` never changes afterwards.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/loomline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch_tables() -> list[tuple[SparkSession, str]]:
    """The tables that ``materialize`` wrote and nothing released yet, in their order."""
    return list(_written)


def release(tables: list[tuple[SparkSession, str]] | None = None) -> None:
    """Delete these tables of ``scratch_tables()``, or all; call it once no result needs them."""
    for table in scratch_tables() if tables is None else tables:
        if table not in _written:
            continue
        _written.remove(table)
        session, path = table
        try:
            jvm = session.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended; the folder is scratch
            return


atexit.register(release)


@contextmanager
def passing() -> Iterator[None]:
    """Of the tables written inside, all but the last go at the end: the last holds the result, and nothing lazy may read the others."""
    before = scratch_tables()
    yield
    release([t for t in scratch_tables() if t not in before][:-1])


def packed(df: DataFrame, *keep: str) -> DataFrame:
    """Only the columns ``keep``, and all others by number in one struct ``_rest``: no name can clash with those of an operator."""
    rest = [F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(df.columns) if c not in keep]
    return df.select(*keep, F.struct(*rest, F.lit(0).alias("none")).alias("_rest"))


def unpacked(columns: list[str], *keep: str) -> list[Column]:
    """The columns of before ``packed``, in their order."""
    return [F.col(c) if c in keep else F.col("_rest").getField(f"c{i}").alias(c) for i, c in enumerate(columns)]


#: Rows of an Arrow batch, where the session leaves Spark's default of 10 000: whole texts are long.
BATCH_ROWS = 2000


def in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches small enough for texts, on both sides of the pipe; a task's end gives unused Arrow memory back."""

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def slices(batches, rows: int = 512, octets: int = 4 << 20):
    """Parts of Arrow batches with so many rows, and by their mean about so many octets, at most."""
    for batch in batches:
        step = max(1, min(rows, octets * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def running_sum(df: DataFrame, by: str, order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """``df`` (one row for each ``by`` and ``order``) with the sum of ``value`` over smaller ``order``.

    Found in stretches of ``width`` orders, whose totals are added up in the same way, so no
    task has more than ``width`` rows, or the totals of that many.
    """
    stretch = F.floor(F.col(order) / width)
    inside = Window.partitionBy(by, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    cut = df.withColumn("_stretch", stretch)
    totals = cut.groupBy(by, "_stretch").agg(F.sum(value).alias("_total")).select(by, "_stretch", F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_base"))
    return (
        cut.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(totals, [by, "_stretch"])
        .withColumn(name, F.col("_base") + F.col("_inside"))
        .drop("_stretch", "_inside", "_base")
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words, without an array of them: a word starts wherever space ends."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def row_key(*columns: str) -> list[Column]:
    """Two independent 64-bit hashes that name a row by these columns; which of them are null counts too."""
    cols = [F.col(c) for c in columns]
    none = [c.isNull() for c in cols]  # a hash passes nulls over
    return [F.xxhash64(F.lit(11), *cols, *none).alias("key_a"), F.xxhash64(F.lit(23), *cols[::-1], *none).alias("key_b")]


def permuted(index: Column, size: Column, salt: Column, rounds: int = 16) -> Column:
    """A keyed pseudorandom bijection of 0..size-1 (the swap-or-not shuffle), JVM-side.

    In each round an index x has one partner, (k - x) mod size; a bit that depends on
    the larger of both says whether they swap, so no two indices ever meet.
    """

    def step(x: Column, r: Column) -> Column:
        return let(
            F.pmod(F.pmod(F.xxhash64(salt, r, F.lit("pivot")), size) - x, size),
            lambda partner: F.when(
                F.pmod(F.xxhash64(salt, r, F.greatest(x, partner)), F.lit(2)) == 1, partner
            ).otherwise(x),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), step)


def located(df: DataFrame, value: str, intervals: DataFrame, total: int, cells: int = 4096) -> DataFrame:
    """Join each integer ``value`` in 0..total-1 to the interval [lo, hi) that holds it.

    The line is cut into equal cells, each interval is listed under the cells it touches,
    and the join is an equi-join on the cell: about ``cells`` + #intervals rows on the
    small side, and one match for each value.
    """
    width = max(1, -(-total // cells))
    listed = (
        intervals.where("hi > lo")
        .withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    )
    return (
        df.withColumn("_cell", F.floor(F.col(value) / width))
        .join(listed, "_cell")
        .where((F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi")))
        .drop("_cell", "lo", "hi")
    )


#: Bits of a survivors' bitmap: 2**22 bits are 65 536 rows of two longs, about 1 MB.
BITMAP_BITS = 1 << 22


def survivors_bitmap(keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> DataFrame:
    """(word, bits) of a bitmap that has a bit for each key; of fixed size, whatever the keys.

    A clear bit proves that a value is no key.  With far more keys than bits it rules out
    nothing, and the exact join behind it does all the work.
    """
    bit = F.pmod(F.xxhash64(column), F.lit(bits))
    return materialize(
        keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("_bits")),
        "bitmap",
    )


def may_hold(df: DataFrame, column: str, bitmap: DataFrame, bits: int = BITMAP_BITS, keep: bool = True) -> DataFrame:
    """Rows whose ``column`` may be a key of the bitmap (or, without ``keep``, surely is none)."""
    marked = flagged(df, column, bitmap, bits)
    return marked.where(F.col("_held") if keep else ~F.col("_held")).drop("_held")


def flagged(df: DataFrame, column: str, bitmap: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """``df`` with ``_held``: whether ``column`` may be a key of the bitmap; at most bits / 64 rows are broadcast."""
    bit = F.pmod(F.xxhash64(column), F.lit(bits))
    joined = df.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6)).join(F.broadcast(bitmap), "_word", "left")
    held = F.expr("coalesce(getbit(_bits, cast(_bit & 63 as int)), 0) = 1")
    return joined.withColumn("_held", held).drop("_bit", "_word", "_bits")
