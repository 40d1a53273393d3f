"""Repeated runs of lines, by a suffix array over line ids.

A line here is a sentence or the rest of a line: texts are cut after line ends and after a
full stop and space, so a passage is found whatever it was pasted behind.  Lines that
occur once cannot be part of a repeated run and leave at once, and so do stretches of
repeated lines with too few words.  A stretch that equals an earlier one as a whole is a
later copy as a whole; one of each kind goes on.

Prefix doubling ranks the windows of 1, 2, 4, ... lines at each line: a window's rank comes
from the sorted pairs of ranks of its halves.  Two windows of 2**k lines cover the ``n``
lines that make up ``min_words`` words from a line on, and their ranks order the suffixes by
these; the lines that follow order them further, as deep as is needed (see below).  In this
order neighbours have a longest common prefix, and the suffixes between two places where it
falls below d lines are an interval: all that share their first d lines.  For each suffix the
deepest interval with an earlier member is its maximal repeated run, which is deleted.

How deep is needed: if a run goes on beyond the window of the next line, then the suffix of
the next line has it too.  So a suffix is ordered by ``top`` lines, the longer of its own
window and of what reaches the end of the next line's, and overlapping runs united are the
maximal ones, however long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.llm.common import in_arrow, let, materialize, may_hold, packed, passing, row_key, survivors_bitmap, unpacked, word_count

#: A repeated run has this many words at least.
MIN_WORDS = 30
#: Bits of the sieve for single lines (4 MB), and how many of them a line that it names must leave clear.
SIEVE_BITS = 1 << 24
SPARSE = 8
#: After what a line ends.
ENDS = ("\n", ". ")
_MARK = "\x1e"
_KEY = ["key_a", "key_b"]
_PLACE = ["none", "doc_id", *_KEY, "pos"]
_CLASS = ["n", "first", "last"]


def split_lines(text: Column) -> Column:
    """The lines of a text; joined they are the text again.  Empty lines stay with the line before."""
    text = F.coalesce(text, F.lit(""))
    marked = text
    for end in ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(end + _MARK))
    marked = F.replace(marked, F.lit(_MARK + "\n"), F.lit("\n"))
    # a text that holds the mark itself is cut by a pattern, which is slower
    pattern = r"(?<=\. )(?!\n)|(?<=\n)(?!\n)"
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, pattern)).otherwise(F.split(marked, _MARK))


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line: keys of its row, doc_id, pos, line hash, words (a line without any counts as one).

    White space at either end of a line does not count.  Words end at spaces; where two
    spaces meet they are counted by a pattern.
    """
    bare = F.trim(F.replace("s", F.lit("\n"), F.lit("")))  # a line feed ends a line, so none is within
    odd = F.lit(False)
    for c in "\t\x0b\x0c\r":
        odd = odd | F.startswith("s", F.lit(c)) | F.endswith("s", F.lit(c))
    # in a projection of their own: beside the generator they would be computed for each line
    rows = docs.select(*row_key("doc_id", "text"), "doc_id", split_lines(F.col("text")).alias("lines"))
    lines = rows.select(*_KEY, "doc_id", F.posexplode("lines").alias("pos", "s"))
    lines = lines.withColumn("s", bare).withColumn("s", F.when(odd, F.btrim("s", F.lit(" \t\n\x0b\x0c\r"))).otherwise(F.col("s")))
    spaces = F.octet_length("s") - F.octet_length(F.replace("s", F.lit(" "), F.lit("")))
    words = F.when(F.contains("s", F.lit("  ")), F.greatest(word_count(F.col("s")), F.lit(1))).otherwise((spaces + 1).cast("long"))
    return lines.select(*_KEY, "doc_id", "pos", F.xxhash64("s").alias("line"), words.alias("words"))


def _islands(lines: DataFrame, min_words: int) -> DataFrame:
    """Stretches of repeated lines with ``min_words`` words or more: keys, doc_id, none, pos (of the first line), lines, n, top.

    ``n`` and ``top`` say for each line how many lines from it on make a window, and how many
    have to be told apart; 0 where too few words follow.
    """
    seen = materialize(lines.groupBy("line").count().where("count > 1").select("line"), "lines-twice")
    active = may_hold(lines, "line", survivors_bitmap(seen, "line", SIEVE_BITS), SIEVE_BITS)
    if SPARSE * seen.count() > SIEVE_BITS:
        # too full a sieve lets many single lines through: harmless, as their windows occur once, but dear
        active = active.join(seen, "line")
    active = materialize(active, "lines-active")

    active = active.repartition(*_KEY).sortWithinPartitions(*_KEY, "pos").select(*_KEY, "doc_id", "pos", "line", "words")
    kinds = {f.name: f.dataType.simpleString() for f in active.schema.fields}
    schema = f"key_a bigint, key_b bigint, doc_id {kinds['doc_id']}, pos int, lines array<bigint>, n array<int>, top array<int>"
    return materialize(in_arrow(active, _stretches(min_words), schema).withColumn("none", F.col("doc_id").isNull()), "lines-islands")


def _stretches(min_words: int):
    """Rows (keys, doc_id, pos, line, words) in their order to the stretches without a gap; rows with equal keys are one text."""

    def found(table: pa.Table) -> pa.RecordBatch:
        a, b, pos, line, words = (table.column(c).to_numpy() for c in (*_KEY, "pos", "line", "words"))
        fresh = np.ones(len(a), dtype=bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        once = fresh.copy()
        once[1:] |= pos[1:] != pos[:-1]
        rows, fresh, pos, words = np.flatnonzero(once), fresh[once], pos[once], words[once]
        fresh[1:] |= pos[1:] != pos[:-1] + 1
        begin = np.flatnonzero(fresh)
        stop = np.append(begin[1:], len(pos))
        before = np.concatenate(([0], np.cumsum(words)))
        at, end = np.arange(len(pos)), np.repeat(stop, stop - begin)
        # the first line beyond the window that begins at each line; the rest of the stretch where words are too few
        beyond = np.minimum(np.searchsorted(before, before[:-1] + min_words, side="left"), end + 1)
        enough = beyond <= end
        n = np.where(enough, beyond - at, 0)
        following = np.minimum(np.append(beyond[1:], 0), end) - at
        top = np.where(enough, np.where(at + 1 < end, np.maximum(n, following), n), 0)
        long = before[stop] - before[begin] >= min_words
        kept = np.repeat(long, stop - begin)
        first = rows[begin[long]]
        ends = pa.array(np.concatenate(([0], np.cumsum((stop - begin)[long]))), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[kept], kind)) for x, kind in ((line[rows], pa.int64()), (n, pa.int32()), (top, pa.int32()))]
        head = table.select([*_KEY, "doc_id", "pos"]).take(pa.array(first)).combine_chunks()
        return pa.RecordBatch.from_arrays([*[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in head.columns], *lists], [*_KEY, "doc_id", "pos", "lines", "n", "top"])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            a, b = (table.column(c).to_numpy() for c in _KEY)
            whole = int(np.flatnonzero((a != a[-1]) | (b != b[-1]))[-1]) + 1 if ((a != a[-1]) | (b != b[-1])).any() else 0
            rest = table.slice(whole)  # the last text may go on in the next batch
            if whole:
                yield found(table.slice(0, whole))
        if rest is not None and rest.num_rows:
            yield found(rest)

    return run


def _distinct(islands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the first of each kind of stretch, the ranges of all later ones)."""
    named = islands.withColumns({"kind_a": F.xxhash64(F.lit(1), "lines"), "kind_b": F.xxhash64(F.lit(2), F.reverse("lines"))})
    kind, place = ["kind_a", "kind_b"], F.struct(*_PLACE)
    firsts = named.groupBy(*kind).agg(F.min(place).alias("p"), F.count("*").alias("copies")).where("copies > 1").select(*kind, "p")
    told = materialize(named.join(firsts, kind, "left").withColumn("later", F.coalesce(F.col("p") != place, F.lit(False))).drop("p", *kind), "lines-kinds")
    ranges = told.where("later").select(*_KEY, F.col("pos").alias("at"), (F.col("pos") + F.size("lines") - 1).alias("at_end"))
    return told.where("not later").drop("later"), ranges


def _names(pairs: DataFrame, *columns: str) -> DataFrame:
    """Ranks of the distinct rows that occur twice or more, in their order."""
    twice = pairs.groupBy(*columns).count().where("count > 1").select(*columns)
    ordered = twice.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return materialize(ordered.withColumn("name", F.monotonically_increasing_id()), "lines-ranks")


def _suffixes(islands: DataFrame, min_words: int) -> DataFrame:
    """The suffixes whose windows may repeat: place, n, ranks of the two windows of 2**k lines that cover n lines, and the lines after."""
    line = F.posexplode(F.arrays_zip("lines", "n", "top")).alias("i", "x")
    at = islands.select(*_KEY, "doc_id", "none", F.col("pos").alias("start"), "lines", line)
    after = F.slice("lines", F.col("i") + 1 + F.col("x.n"), F.greatest(F.col("x.top") - F.col("x.n"), F.lit(0)))
    current = materialize(
        at.select("none", "doc_id", *_KEY, (F.col("start") + F.col("i")).alias("pos"), F.col("x.n").alias("n"), F.when(F.col("x.n") > 0, after).alias("tail"), F.col("x.lines").alias("name")),
        "lines-level",
    )
    found, size = None, 1
    row = Window.partitionBy(*_KEY).orderBy("pos")
    while True:
        level = current.withColumn("second", F.first("name").over(row.rangeBetween(size, size)))
        if size == 1:
            last = F.when(F.col("n") == 1, F.col("name"))
        else:
            near = F.filter(F.collect_list(F.struct("pos", "name")).over(row.rangeBetween(0, size - 1)), lambda x: x["pos"] - F.col("pos") + size == F.col("n"))  # noqa: B023
            last = F.get(near, 0)["name"]
        level = level.withColumn("last", F.when(F.col("n").between(size, 2 * size - 1), last))
        if 2 * size <= min_words:
            # a longer window is of use only at or after the start of a run that long
            longest = F.max("n").over(row.rangeBetween(-min_words, 0))
            level = materialize(level.withColumn("second", F.when(longest >= 2 * size, F.col("second"))), "lines-pairs")
        whole = level.where(F.col("last").isNotNull()).select(*_PLACE, "n", F.col("name").alias("first"), "last", "tail")
        found = whole if found is None else found.unionByName(whole)
        if 2 * size > min_words:
            return found
        pairs = level.where(F.col("second").isNotNull()).select(*_PLACE, "n", "tail", F.col("name").alias("left"), "second")
        names = _names(pairs, "left", "second")
        current = materialize(pairs.join(names, ["left", "second"]).drop("left", "second"), "lines-level")
        size *= 2


def _depths(table: pa.Table) -> np.ndarray:
    """Lines of the maximal repeated run at each suffix that has an earlier copy, else 0; suffixes in their order, whole classes."""
    rows = table.num_rows
    column = lambda c: table.column(c).to_numpy()
    n, pos = column("n").astype(np.int64), column("pos").astype(np.int64)
    same_class = np.ones(rows, dtype=bool)
    same_class[0] = False
    for c in _CLASS:
        same_class[1:] &= column(c)[1:] == column(c)[:-1]
    tails = table.column("tail").combine_chunks()
    lengths = np.diff(tails.offsets.to_numpy())
    values, width = tails.flatten().to_numpy(), int(lengths.max(initial=0))
    lines = np.zeros((rows, width), dtype=np.int64)
    filled = np.arange(width) < lengths[:, None]
    lines[filled] = values
    # the longest common prefix of each suffix with the one before it, in lines after the window
    shared = (lines[1:] == lines[:-1]) & filled[1:] & filled[:-1]
    common = np.full(rows, -1)
    common[1:] = np.where(same_class[1:], np.logical_and.accumulate(shared, axis=1).sum(axis=1) if width else 0, -1)
    place = np.empty(rows, dtype=np.int64)
    by_place = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in _PLACE]).to_numpy()
    place[by_place] = np.arange(rows)
    text = np.stack([column(c) for c in _KEY])
    best = np.zeros(rows, dtype=np.int64)
    for depth in range(width + 1):
        starts = np.flatnonzero(common < depth)  # the intervals of suffixes that share the window and so many lines more
        interval = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows)))
        first = by_place[np.minimum.reduceat(place, starts)][interval]
        apart = (text[:, first] != text).any(axis=0) | (pos >= pos[first] + n + depth)
        best = np.where((lengths >= depth) & (first != np.arange(rows)) & apart, n + depth, best)
    return best


def _runs(suffixes: DataFrame) -> DataFrame:
    """keys, at, at_end: the maximal repeated run at each suffix that has an earlier copy.

    The suffix array is dealt out in ranges.  Classes of suffixes that lie within one range
    are done there; the first and the last class of a range may go on in the next, and their
    intervals are found by aggregation, however many rows they have.
    """
    order = [*_CLASS, "tail", *_PLACE]
    kinds = {f.name: f.dataType.simpleString() for f in suffixes.schema.fields}

    def sweep(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        edge = np.zeros(table.num_rows, dtype=bool)
        for end in (0, -1):
            edge |= np.logical_and.reduce([table.column(c).to_numpy() == table.column(c)[end].as_py() for c in _CLASS])
        depth = np.zeros(table.num_rows, dtype=np.int64)
        if not edge.all():
            depth[~edge] = _depths(table.filter(pa.array(~edge)))
        keep = pa.array(edge | (depth > 0))
        out = table.append_column("depth", pa.array(np.where(edge, -1, depth), pa.int32()))
        yield from out.filter(keep).select([*order, "depth"]).combine_chunks().to_batches()

    ordered = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    swept = materialize(in_arrow(ordered.select(*order), sweep, ", ".join(f"{c} {kinds[c]}" for c in order) + ", depth int"), "lines-swept")
    edges = swept.where("depth < 0").withColumn("shared", F.explode(F.sequence(F.lit(0), F.size("tail")))).withColumn("prefix", F.slice("tail", F.lit(1), F.col("shared")))
    interval = [*_CLASS, "prefix"]
    firsts = edges.groupBy(*interval).agg(F.min(F.struct(*_PLACE)).alias("p"), F.count("*").alias("copies")).where("copies > 1")
    firsts = materialize(firsts.select(*interval, F.col("p.key_a").alias("a"), F.col("p.key_b").alias("b"), F.col("p.pos").alias("p")), "lines-firsts")
    same = (F.col("key_a") == F.col("a")) & (F.col("key_b") == F.col("b"))
    long = F.col("n") + F.col("shared")
    later = edges.join(firsts, interval).where(~same | (F.col("pos") >= F.col("p") + long)).select(*_KEY, "pos", long.alias("depth"))
    runs = swept.where("depth > 0").select(*_KEY, "pos", "depth").unionByName(later)
    return runs.select(*_KEY, F.col("pos").alias("at"), (F.col("pos") + F.col("depth") - 1).alias("at_end"))


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """key_a, key_b and ``cuts``: for each row of ``docs`` with later copies, the ranges of lines to delete.

    Earlier is a smaller doc_id, null ids last, then the place in the text.  A copy in the
    same text counts from the end of the first one on.
    """
    with passing():
        with passing():
            islands = _islands(materialize(line_table(docs), "lines"), min_words)
        firsts, copies = _distinct(islands)
        later = copies.unionByName(_runs(_suffixes(firsts, min_words)))

        # overlapping runs become one range before they are gathered, so a row gets few
        row = Window.partitionBy(*_KEY).orderBy("at", "at_end")
        reached = F.max("at_end").over(row.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.coalesce((F.col("at") > reached + 1).cast("int"), F.lit(1))
        ranges = (
            later.withColumn("opens", opens).withColumn("range", F.sum("opens").over(row))
            .groupBy(*_KEY, "range").agg(F.min("at").alias("at"), F.max("at_end").alias("at_end"))
        )
        cuts = ranges.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("at", "at_end"))).alias("cuts"))
        return materialize(cuts, "lines-cuts")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text of later copies deleted, and ``deleted_lines`` (0 if none).

    Rows with the same doc_id and text are one document and keep the same text.  Null and
    empty texts are unchanged, as is every text without a repeated run.  White space left
    at the end of a shortened text is trimmed.  An empty table gives an empty result.  Needs
    columns doc_id and text; all others pass through, whatever their names, but for one named
    ``deleted_lines``, which is replaced.
    """
    cuts = later_copies(docs.select("doc_id", "text"), min_words)
    names = [c for c in docs.columns if c != "deleted_lines"]
    columns = unpacked(names, "doc_id", "text")
    keyed = packed(docs.select(*[F.col(f"`{c}`") for c in names]), "doc_id", "text").select("*", *row_key("doc_id", "text"))
    # rows that surely have no copies pass without a shuffle of their text
    holding = survivors_bitmap(cuts, "key_a")
    left = may_hold(keyed, "key_a", holding, keep=False).select(*columns, F.lit(0).cast("long").alias("deleted_lines"))
    # the cuts grow with the input, so they are not broadcast on an estimate of their size
    held = may_hold(keyed, "key_a", holding).join(cuts.hint("merge"), _KEY, "left")
    begins = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["at_end"] + 1))
    ends = F.concat(F.transform("cuts", lambda c: c["at"]), F.array(F.lit((1 << 31) - 1)))
    spans = F.arrays_zip(begins.alias("b"), ends.alias("e"))
    rest = let(split_lines(F.col("text")), lambda x: F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(x, s["b"] + 1, F.greatest(s["e"] - s["b"], F.lit(0))))), ""))
    gone = F.aggregate("cuts", F.lit(0).cast("long"), lambda n, c: n + c["at_end"] - c["at"] + 1)
    shortened = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.rtrim(rest, F.lit(" \t\n\x0b\x0c\r")))
    cut = held.withColumn("text", shortened).withColumn("deleted_lines", F.coalesce(gone, F.lit(0).cast("long")))
    return left.unionByName(cut.select(*columns, "deleted_lines"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without later copies, deleted_lines: one row per document."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "deleted_lines")
