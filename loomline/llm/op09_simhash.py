"""Near-duplicates by SimHash with pigeonhole blocks.

Equal fingerprints are one node.  A fingerprint is cut into blocks; two that differ in at
most two bits agree on all but two blocks, so joining on every choice of agreeing blocks
finds each pair, and the Hamming distance is then verified.  Blocks that collect many
fingerprints are not joined: there each fingerprint is listed under every pair of bits that
may differ, with those two bits cleared, and linked to the smallest of its list.  That is
linear in the block, and any two on a list are at most two bits apart.  Components come
from alternating stars, written after each round.

``similar_documents`` is the same method for a similarity of word shingles instead of a
distance: wide fingerprints, blocks of bits in as many choices as that similarity needs,
distances within blocks, and an exact check of the shingles of what these link.
"""

from __future__ import annotations

from itertools import batched, combinations, islice
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from loomline.llm.common import in_arrow, materialize, may_hold, passing, release, scratch_tables, slices, survivors_bitmap

BITS = 64
SEED = 42
DISTANCE = 2
#: Shingles of a text that are hashed at once.
STEP = 1 << 13
#: Fingerprints in a block from which lists by cleared bits are cheaper than pairs.
HOT_BLOCK = 1024

#: For similar documents: words a shingle, least similarity of a pair in tenths, 64-bit parts of a fingerprint.
SIMILAR_SHINGLE = 5
TENTHS = 8
PARTS = 8
#: Of two parts, the bits that a pair may differ in: three deviations over the mean of a similarity of 0.8, and each block compares two other parts.
WIDE_DISTANCE = 32
#: Share of pairs of just that similarity that no block may hold.
MISSED = 1e-6
#: Similar sets of up to so many shingles in all differ in one, and meet by what is left without it.
SMALL_SET = 9
#: Fingerprints in a block from which it is searched node by node.
FULL_BLOCK = 1024
#: Shingles, and nodes, of a portion of a cluster that is checked at once with another.
PORTION = 1 << 17
PORTION_NODES = 512


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text as an unsigned integer; no words: zero.

    A-Z are lower-cased, words end at space, tab and carriage-return-like characters, and
    a bit is set if it is set in over half of the hashes of all shingles.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    runs = [words] if len(words) <= shingle else zip(*(islice(words, i, None) for i in range(shingle)), strict=False)
    ones, total = np.zeros(BITS, dtype=np.int64), 0
    # long texts in steps, so no more than one step of hashes is held
    for part in batched(runs, STEP):
        octets = np.array([xxh64_intdigest(x, SEED) for x in map(b" ".join, part)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprints(batches):
    for batch in slices(batches):
        made = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return in_arrow(named, _fingerprints, f"doc_id {kind}, fp long")


def block_choices(count: int) -> list[int]:
    """Masks of the bits that a pair must share: one mask for each choice of blocks left equal.

    More fingerprints take more blocks, so that chance seldom puts two under one key: the
    keys have 21 bits for up to about 2**20, then 32, 38 and 42 bits.
    """
    for blocks in (3, 4, 5, 6):
        bounds = [round(i * BITS / blocks) for i in range(blocks + 1)]
        parts = [((1 << hi) - (1 << lo)) for lo, hi in zip(bounds, bounds[1:], strict=False)]
        masks = [sum(c) for c in combinations(parts, blocks - DISTANCE)]
        if count <= 1 << (min(m.bit_count() for m in masks)) or blocks == 6:
            return masks
    raise AssertionError


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(nodes: DataFrame, count: int, hot_block: int = HOT_BLOCK) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all at most two bits apart."""
    masks = block_choices(count)
    keyed = nodes.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("choice", "key"),
    )
    sizes = keyed.groupBy("choice", "key").count().where("count > 1")
    sizes = materialize(sizes, "simhash-blocks")
    keyed = keyed.join(sizes, ["choice", "key"])
    few = keyed.where(F.col("count") <= hot_block).select("choice", "key", "fp")
    other = few.select("choice", "key", F.col("fp").alias("other"))
    pairs = (
        few.join(other, ["choice", "key"])
        .where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= DISTANCE))
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    if sizes.where(F.col("count") > hot_block).isEmpty():
        return pairs
    cleared = F.create_map(
        *[
            x
            for i, m in enumerate(masks)
            for x in (
                F.lit(i),
                F.lit([_signed(~((1 << p) | (1 << q)) & ((1 << BITS) - 1)) for p, q in combinations([k for k in range(BITS) if not m >> k & 1], 2)]),
            )
        ]
    )
    listed = (
        keyed.where(F.col("count") > hot_block)
        .select("fp", "choice", F.posexplode(cleared[F.col("choice")]).alias("nth", "mask"))
        .select("fp", "choice", "nth", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"))
    )
    hubs = materialize(
        listed.groupBy("choice", "nth", "rest").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1"), "simhash-hubs"
    )
    starred = listed.join(hubs, ["choice", "nth", "rest"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(starred.distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node it reaches.

    Large and small stars alternate until no edge moves; each round is written out, the one
    before it deleted, and the number of rounds grows with the logarithm of the longest path.
    """
    smaller = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    current = materialize(smaller, "links")
    table = scratch_tables()[-1]
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        with passing():
            large = _star(both, "v > u")
            small = _star(large, None)
            following = materialize(small, "links")
        moved = following.exceptAll(current).isEmpty() and current.exceptAll(following).isEmpty()
        release([table])
        current, table = following, scratch_tables()[-1]
        if moved:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select("v", "v").distinct().toDF("node", "root")
            )


def _star(edges: DataFrame, keep: str | None) -> DataFrame:
    """Link the neighbours of u (all larger ones, or all smaller ones) to the smallest of u and them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    least = materialize(least, "least")
    joined = edges.join(least, "u")
    if keep:
        linked = joined.where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u > v").distinct()


def named(marked: DataFrame, roots: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``marked`` (doc_id, fp) with component_id: the smallest id of the component that ``roots`` (node, root) gives its fp."""
    if nodes is None:
        nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-rooted")
    named = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-named")
    named = materialize(rooted.join(named, "root").select("fp", "component_id"), "simhash-components")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_block: int = HOT_BLOCK) -> DataFrame:
    """doc_id, fp, component_id for every row; component_id is the smallest id that links reach.

    Rows without words have fingerprint zero and are linked like any other.  Null ids have
    components but never name one, unless all ids of it are null.  Repeated rows come back
    repeated; other columns are not read; an empty table gives an empty result.
    """
    marked = materialize(fingerprints(docs, id_col, text_col), "simhash-marked")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    with passing():
        roots = components(links(nodes.select("fp"), nodes.count(), hot_block))
        return named(marked, roots, nodes)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles, as in ``fingerprint``; a text without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    runs = [words] if len(words) <= shingle else zip(*(islice(words, i, None) for i in range(shingle)), strict=False)
    return np.array(sorted({xxh64_intdigest(x, SEED) for x in map(b" ".join, runs)}), dtype=np.uint64)


def _mixed(hashes: np.ndarray, part: int) -> np.ndarray:
    x = hashes + np.uint64((part + 1) * 0x9E3779B97F4A7C15 & ((1 << BITS) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set in ``PARTS`` parts: a bit is set if it is set in over half of the mixed hashes."""
    ones = np.zeros(PARTS * BITS, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # sums of so many bits fit an octet
        step = hashes[at : at + 255]
        octets = np.stack([_mixed(step, p) for p in range(PARTS)], axis=1).view(np.uint8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def _small_keys(hashes: np.ndarray) -> np.ndarray:
    """The sum of a small set, and the sums without one of its shingles: two sets share one if one set is the other and one more.

    Less than four shingles are similar to none but equal sets, and less than five to no smaller set.
    """
    mixed = _mixed(hashes, PARTS)
    total = mixed.sum(dtype=np.uint64, keepdims=True)
    return np.concatenate([total[: 4 <= len(hashes) <= SMALL_SET], (total - mixed)[: SMALL_SET if 5 <= len(hashes) <= SMALL_SET else 0]])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, dtype=np.uint64)]).view(np.int64)))


def _set_marks(shingle: int):
    def run(batches):
        for batch in slices(batches, 256, 2 << 20):
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            nodes = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(nodes.view(np.int64)),
                    pa.array(np.array([len(s) for s in sets], dtype=np.int32)),
                    _lists([wide_fingerprint(s) for s in sets]),
                    _lists([_small_keys(s) for s in sets]),
                    _lists(sets),
                ],
                ["doc_id", "fp", "size", "wide", "small", "shingles"],
            )

    return run


def similar_masks(count: int) -> list[int]:
    """Masks of the bits that a block shares, mask i for part i mod ``PARTS``.

    A block has 64 to 128 of many fingerprints by chance.  Two sets of a similarity s have a
    cosine of 2s / (1 + s) or more, so each bit agrees with probability 1 - acos(cosine) / pi,
    and there are as many masks as leave ``MISSED`` of such pairs out.
    """
    cosine = 2 * TENTHS / (10 + TENTHS)
    width = min(40, max(8, ceil(log2(max(count, 1))) - 7))
    shared = (1 - np.arccos(cosine) / np.pi) ** width
    r = np.random.default_rng(SEED)
    bits = [r.choice(BITS, width, replace=False) for _ in range(ceil(log(MISSED) / np.log1p(-shared)))]
    return [sum(1 << int(b) for b in chosen) for chosen in bits]


def _forest(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """The least index that each of 0..count-1 reaches over the edges (a, b)."""
    least = np.arange(count)
    while True:
        x, y = least[a], least[b]
        moved = x != y
        if not moved.any():
            return least
        np.minimum.at(least, np.maximum(x, y)[moved], np.minimum(x, y)[moved])
        while not np.array_equal(after := least[least], least):
            least = after


def _near(x: np.ndarray, y: np.ndarray, free: np.ndarray, i, j: np.ndarray) -> np.ndarray:
    return free[j] | (np.bitwise_count(x[j] ^ x[i]) + np.bitwise_count(y[j] ^ y[i]) <= WIDE_DISTANCE)


def _searched(rows: np.ndarray, x: np.ndarray, y: np.ndarray, free: np.ndarray) -> tuple[list, list]:
    """Edges that connect the rows of one large block: each node that is reached is compared with those not reached yet."""
    left, queue, a, b = rows, [], [], []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        u = queue.pop()
        near = _near(x, y, free, u, left)
        if near.any():
            found = left[near]
            a.append(np.full(len(found), u))
            b.append(found)
            queue.extend(found.tolist())
            left = left[~near]
    return a, b


def _block_links(full_block: int, rows: int = 1 << 18):
    """Of rows (choice, key, fp, x, y) sorted by choice and key: pairs (a, b) that connect what is near in a block."""

    def linked(choice, key, fp, x, y):
        fresh = np.append(True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1]))
        block = np.cumsum(fresh) - 1
        sizes = np.bincount(block)
        free, starts, a, b = choice < 0, np.flatnonzero(fresh), [], []
        large = sizes > full_block
        for k in np.flatnonzero(large):
            more = _searched(np.arange(starts[k], starts[k] + sizes[k]), x, y, free)
            a += more[0]
            b += more[1]
        at = np.flatnonzero(~large[block])
        ends = (starts + sizes)[block]
        for d in range(1, full_block):
            at = at[at + d < ends[at]]
            if not len(at):
                break
            near = _near(x, y, free, at, at + d)
            a.append(at[near])
            b.append(at[near] + d)
        none = np.empty(0, dtype=np.int64)
        a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
        nodes, index = np.unique(fp[np.append(a, b)], return_inverse=True)
        least = _forest(index[: len(a)], index[len(a) :], len(nodes))
        apart = least != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[least[apart]]), pa.array(nodes[apart])], ["a", "b"])

    def run(batches):
        held, count, enough = [], 0, rows
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            count += batch.num_rows
            if count < enough:
                continue
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = int(np.argmax((whole[0] == whole[0][-1]) & (whole[1] == whole[1][-1])))  # where the last block begins
            if last:
                yield linked(*[c[:last] for c in whole])
            held = [[c[last:] for c in whole]]
            count = len(held[0][0])
            enough = max(rows, 2 * count)
        if count:
            yield linked(*[np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _checked(table: pa.Table) -> pa.Table:
    """Of the sets of one pair of portions: pairs (a, b) that connect all whose similarity suffices."""
    fp, column = table.column("fp").to_numpy(), table.column("shingles").combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    _, held, times = np.unique(column.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = times > 1
    used = shared[held]
    owner, place = np.repeat(np.arange(len(fp)), sizes)[used], (np.cumsum(shared) - 1)[held[used]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((len(fp), len(fp)), dtype=np.int64)
    for at in range(0, int(shared.sum()), 2048):
        lo, hi = np.searchsorted(place, [at, at + 2048])
        part = np.zeros((len(fp), 2048), dtype=np.float32)
        part[owner[lo:hi], place[lo:hi] - at] = 1
        common += (part @ part.T).astype(np.int64)
    a, b = np.nonzero(np.triu(common * (10 + TENTHS) >= (sizes[:, None] + sizes[None, :]) * TENTHS, 1))
    least = _forest(a, b, len(fp))
    apart = least != np.arange(len(fp))
    return pa.table({"a": fp[least[apart]], "b": fp[apart]})


def _verified(clusters: DataFrame, marked: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of one cluster (node, root) that connect all whose sets are that similar.

    A cluster is cut into portions by hash, and each pair of portions is checked by itself:
    no row is made for a pair of nodes, however large the cluster.
    """
    bitmap = survivors_bitmap(clusters, "node")
    sets = may_hold(marked.select("fp", "size", "shingles"), "fp", bitmap).dropDuplicates(["fp"])
    sets = materialize(sets.join(clusters, F.col("fp") == F.col("node")).select("root", "fp", "size", "shingles"), "simhash-sets")
    portions = F.ceil(F.greatest(F.sum("size") / PORTION, F.count("*") / PORTION_NODES)).cast("int")
    cut = sets.join(sets.groupBy("root").agg(portions.alias("portions")), "root")
    own = F.pmod(F.xxhash64("fp"), F.col("portions")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("portions") - 1), lambda p: (p != F.col("own")) | (F.col("portions") == 1))
    dealt = cut.withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "shingles")
    return materialize(dealt.groupBy("root", "i", "j").applyInArrow(_checked, "a long, b long"), "simhash-links")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, full_block: int = FULL_BLOCK) -> DataFrame:
    """doc_id, fp, component_id for every row; component_id is the smallest id that similar pairs reach.

    ``fp`` names the set of shingles.  Rows without words are one group.  Null ids have
    components but never name one, unless all ids of it are null.  Repeated rows come back
    repeated; other columns are not read; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    named_texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, fp long, size int, wide array<long>, small array<long>, shingles array<long>"
    marked = materialize(in_arrow(named_texts, _set_marks(shingle), schema), "simhash-marked")
    with passing():
        with passing():
            nodes = materialize(marked.where("size > 0").groupBy("fp").agg(F.first("size").alias("size"), F.first("wide").alias("wide"), F.first("small").alias("small")), "simhash-wide")
            part = [F.get("wide", F.lit(p)) for p in range(PARTS)]
            keys = [
                F.struct(F.lit(i).alias("choice"), part[i % PARTS].bitwiseAND(F.lit(_signed(m))).alias("key"), part[(i + 1) % PARTS].alias("x"), part[(i + 2) % PARTS].alias("y"))
                for i, m in enumerate(similar_masks(nodes.count()))
            ]
            few = F.transform("small", lambda k: F.struct(F.lit(-1).alias("choice"), k.alias("key"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))
            # a set of less than eight shingles is similar to none of ten
            keyed = nodes.select("fp", F.explode(F.when(F.col("size") < SMALL_SET - 1, few).otherwise(F.concat(few, F.array(*keys)))).alias("k"))
            blocks = keyed.select("k.choice", "k.key", "fp", "k.x", "k.y").repartition("choice", "key").sortWithinPartitions("choice", "key")
            near = in_arrow(blocks, _block_links(full_block), "a long, b long")
            clusters = materialize(components(near), "simhash-clusters")
        links = _verified(clusters, marked)
        return named(marked.select("doc_id", "fp"), components(links))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
