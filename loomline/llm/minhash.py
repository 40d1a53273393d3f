"""Near-duplicates by the Jaccard similarity of word shingles, found by MinHash and verified.

Equal sets of shingles are one node.  A node has ``BANDS`` keys of ``ROWS`` minima each, and
nodes that share a key are candidates: two of similarity s are missed with probability
(1 - s**ROWS)**BANDS, 3e-6 at 0.8.  Candidates are verified on their whole sets.  In a bucket
of many nodes, pairs are first taken with a few of its nodes only; components of what these
link are formed, and then every pair of the bucket across components is taken.  Pairs within
a component could not change it, so nothing is lost, and one large group stays linear.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from loomline.llm.common import in_arrow, materialize, may_hold, passing, slices, survivors_bitmap
from loomline.llm.op09_simhash import components, named

SEED = 42
SHINGLE = 5
#: Least similarity of a pair, in tenths.
TENTHS = 8
BANDS = 24
ROWS = 4
#: Nodes in a bucket from which pairs are first taken with ``HUBS`` of them only.
HOT_BUCKET = 64
HUBS = 4

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIXED = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEYS = ["band", "key"]


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; A-Z are lower-cased; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) <= shingle:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.array(sorted({xxh64_intdigest(x, SEED) for x in runs}), dtype=np.uint64)


def band_keys(hashes: np.ndarray, step: int = 1 << 12) -> np.ndarray:
    """One key a band from the minima of all hashes under ``BANDS * ROWS`` multiplications."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), step):  # long texts in steps, so memory stays bounded
        least = np.minimum(least, (_FACTORS[:, None] * hashes[None, i : i + step]).min(axis=1))
    mixed = (least ^ (least >> np.uint64(29))) * _MIXED
    return (mixed ^ (mixed >> np.uint64(32))).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)


def _marks(shingle: int):
    def run(batches):
        for batch in slices(batches, 256, 2 << 20):
            sets = [shingles(t, shingle) for t in batch.column(1).to_pylist()]
            nodes = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64)
            keys = [band_keys(s).view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate([*sets, np.empty(0, dtype=np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(nodes.view(np.int64)),
                    pa.array(np.diff(ends).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate([*keys, np.empty(0, dtype=np.int64)]))),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)),
                ],
                ["doc_id", "fp", "size", "bands", "shingles"],
            )

    return run


def _alike(x: Column, y: Column, tenths: int) -> Column:
    """Whether sets of these sizes can be that similar."""
    return F.least(x, y) * 10 >= F.greatest(x, y) * tenths


def _pairs(left: DataFrame, right: DataFrame, tenths: int, where: Column | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of nodes of one bucket whose sizes allow it."""
    other = right.select(*_KEYS, *[F.col(c).alias(f"other_{c}") for c in right.columns if c not in _KEYS])
    joined = left.join(other, _KEYS).where((F.col("fp") != F.col("other_fp")) & _alike(F.col("size"), F.col("other_size"), tenths))
    if where is not None:
        joined = joined.where(where)
    return joined.select(F.least("fp", "other_fp").alias("a"), F.greatest("fp", "other_fp").alias("b")).distinct()


def _verified(pairs: DataFrame, marked: DataFrame, tenths: int) -> DataFrame:
    """The pairs whose sets of shingles are that similar."""
    with passing():
        pairs = materialize(pairs, "minhash-pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("fp"))
        sets = may_hold(marked.select("fp", "shingles"), "fp", survivors_bitmap(ends, "fp"))
        sets = materialize(sets.dropDuplicates(["fp"]), "minhash-sets")
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        common = F.size(F.array_intersect("x", "y"))
        return materialize(both.where(common * (10 + tenths) >= (F.size("x") + F.size("y")) * tenths).select("a", "b"), "minhash-links")


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, tenths: int = TENTHS, hot_bucket: int = HOT_BUCKET
) -> DataFrame:
    """doc_id, fp, component_id for every row; component_id is the smallest id that similar pairs reach.

    ``fp`` names the set of shingles.  Rows without words are one group.  Null ids have
    components but never name one, unless all ids of it are null.  Repeated rows come back
    repeated; other columns are not read; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    named_texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, fp long, size int, bands array<long>, shingles array<long>"
    marked = materialize(in_arrow(named_texts, _marks(shingle), schema), "minhash-marked")
    with passing():
        nodes = marked.where("size > 0").groupBy("fp", "size").agg(F.first("bands").alias("bands"))
        keyed = nodes.select("fp", "size", F.posexplode("bands").alias(*_KEYS))
        with passing():
            keyed = materialize(keyed, "minhash-keys")
            counts = keyed.groupBy(*_KEYS).count().where("count > 1")
            keyed = materialize(keyed.join(counts, _KEYS), "minhash-buckets")
        few, hot = keyed.where(F.col("count") <= hot_bucket), keyed.where(F.col("count") > hot_bucket)
        hubs = hot.groupBy(*_KEYS, F.pmod("fp", F.lit(HUBS))).agg(F.min(F.struct("fp", "size")).alias("hub")).select(*_KEYS, "hub.fp", "hub.size")
        pairs = _pairs(few.select(*_KEYS, "fp", "size"), few.where("true").select(*_KEYS, "fp", "size"), tenths)
        found = _verified(pairs.unionByName(_pairs(hot.select(*_KEYS, "fp", "size"), hubs, tenths)).distinct(), marked, tenths)
        roots = components(found)
        if not hot.isEmpty():
            rooted = hot.join(roots, F.col("fp") == F.col("node"), "left").select(*_KEYS, "fp", "size", F.coalesce("root", "fp").alias("root"))
            rooted = materialize(rooted, "minhash-rooted")
            largest = rooted.groupBy(*_KEYS, "root").count().groupBy(*_KEYS).agg(F.max_by("root", F.struct("count", "root")).alias("main"))
            rest = rooted.join(largest, _KEYS).where("root <> main").drop("main")
            if not rest.isEmpty():
                across = _pairs(rest, rooted, tenths, F.col("root") != F.col("other_root"))
                roots = components(found.unionByName(_verified(across, marked, tenths)))
        return named(marked.select("doc_id", "fp"), roots)
