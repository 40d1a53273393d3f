"""Best-fit packing of token sequences by hierarchical residual packing.

Items are dealt out at random to small groups, each of which packs best-fit decreasing and
emits its nearly full bins.  Underfull bins rise as items to the next level, where several
groups meet, and are packed best-fit again.  Every level is written out before it is used.
"""

from __future__ import annotations

import re
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import in_arrow, materialize, slices

CAPACITY = 2048
END_ID = 0
GROUP_ITEMS = 8192
FAN_IN = 8
#: A bin with no more room than this is nearly full, and done.
SLACK = 8
#: Underfull bins that a group hands on, the emptiest first; ``None``: all of them.  More give
#: no fewer sequences: best-fit leaves at most one bin of a group half empty or more, as two
#: such would have been one, and the others can only take in such bins.  Where ``FAN_IN`` groups
#: meet, at most ``FAN_IN`` bins look for room, and if any bin of a group has room for one, its
#: emptiest has; so with ``FAN_IN`` or more of each group nothing that fits stays apart.
RISING = 64

#: The split of the byte-level vocabulary, over characters whose classes are settled.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ʯ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_PIECES = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
_SETTLED = re.compile("[\x00-\x1b\x20-ɏ‐-‧€]*")


class Encoder:
    """Token ids as little-endian 32-bit octets, the same as the tokenizer's own.

    The vocabulary splits a text into pieces and merges each by itself, so a piece is
    encoded once, by the merges of the same file, and remembered.  Texts with other characters, or with the name of a
    special token, go to the tokenizer whole.
    """

    #: Octets of pieces and ids remembered, about; then all are forgotten.
    LIMIT = 12 << 20

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # in this vocabulary an id is the rank of its merge, so the merges follow from the ids
        octet = _octets_of_letters()
        ranks = {bytes(octet[c] for c in token): i for token, i in vocab.items() if all(c in octet for c in token)}
        ranks = {k: v for k, v in ranks.items() if v < len(vocab) and k != b"<|endoftext|>"}
        self.merges = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _piece(self, piece: str) -> bytes:
        return array("I", self.merges.encode_ordinary(piece)).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]):
        """The octets of each text, one after the other."""
        known, piece = self.known, self._piece
        for text in texts:
            if not _SETTLED.fullmatch(text) or "<|" in text:
                yield self._whole(text)
                continue
            pieces = _PIECES.findall(text)
            if self.held > self.LIMIT:
                known.clear()
                self.held = 0
            for p in set(pieces).difference(known):
                known[p] = ids = piece(p)
                self.held += len(p) + len(ids) + 180  # with what the objects themselves take
            yield b"".join(map(known.__getitem__, pieces))


def _octets_of_letters() -> dict[str, int]:
    """The letters by which the vocabulary writes octets: printable ones themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _tokenized(path: str, capacity: int):
    def run(batches):
        encoder = Encoder(path)  # lives as long as the task
        for batch in slices(batches):
            ids = batch.column(0)
            at, piece, start, length, crc = [], [], [], [], []
            for row, octets in enumerate(encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                octets += END_ID.to_bytes(4, "little")
                total = len(octets) // 4
                cuts = [0, *range((total - 1) % capacity + 1, total + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(crc32(octets[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def best_fit(lengths, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each item, placed in the given order, and the fill of each bin.

    An item goes to the bin with the least room that it fits; a bit for each amount of room
    makes finding it a shift.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, offsets, fills = 0, [], [], []
    for n in lengths:
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins.append(b)
        offsets.append(fills[b])
        fills[b] += n
        if room > n:
            rooms[room - n].append(b)
            mask |= 1 << (room - n)
    return bins, offsets, fills


def _packed(capacity: int, rising: int | None):
    """Pack the items (grp, item, length) of a group; rows: item, bin, offset, fill, rises."""

    def run(key, table):
        item, length = table.column("item").to_numpy(), table.column("length").to_numpy()
        order = np.lexsort((item, -length))
        bins, offsets, fills = best_fit(length[order].tolist(), capacity)
        bins, fills = np.array(bins), np.array(fills)
        named = item[order][np.unique(bins, return_index=True)[1]]  # a bin has the name of its first item
        under = np.flatnonzero(fills < capacity - SLACK)
        rises = np.zeros(len(fills), dtype=bool)
        rises[under[np.argsort(fills[under], kind="stable")[:rising]]] = True
        return pa.table({
            "grp": pa.array(np.full(len(item), key[0].as_py()), pa.int64()), "item": pa.array(item[order], pa.int64()), "bin": pa.array(named[bins], pa.int64()),
            "offset": pa.array(offsets, pa.int64()), "fill": pa.array(fills[bins], pa.int64()), "rises": pa.array(rises[bins]),
        })

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, rising: int | None = RISING) -> DataFrame:
    """(item, sequence_id, offset) for ``items`` (item long, unique and not negative; length in 1..capacity).

    ``rising``: underfull bins that a group hands on, at least ``FAN_IN``, or ``None`` for all.
    """
    if rising is not None and rising < FAN_IN:
        raise ValueError(f"with fewer than {FAN_IN} rising bins some that fit together might not meet")
    schema = "grp long, item long, bin long, offset long, fill long, rises boolean"
    groups = max(1, -(-items.count() // GROUP_ITEMS))
    dealt = items.select(F.pmod(F.xxhash64("item"), F.lit(groups)).alias("grp"), "item", "length")
    level = materialize(dealt.groupBy("grp").applyInArrow(_packed(capacity, rising), schema), "pack-level")
    base = level.select("item", "bin", "offset")
    moves = None  # (bin, host, shift) of bins that rose, so far
    while groups > 1:
        groups = -(-groups // FAN_IN)
        risen = level.where("rises").groupBy("grp", "bin").agg(F.first("fill").alias("length"))
        risen = risen.select(F.floor(F.col("grp") / FAN_IN).alias("grp"), F.col("bin").alias("item"), "length")
        level = materialize(risen.groupBy("grp").applyInArrow(_packed(capacity, rising), schema), "pack-level")
        step = level.select(F.col("item").alias("host"), F.col("bin").alias("new_host"), F.col("offset").alias("more"))
        if moves is None:
            moves = step.select(F.col("host").alias("bin"), F.col("new_host").alias("host"), F.col("more").alias("shift"))
        else:
            moves = moves.join(step, "host", "left").select("bin", F.coalesce("new_host", "host").alias("host"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        moves = materialize(moves, "pack-moves")
    if moves is None:
        return base.select("item", F.col("bin").alias("sequence_id"), "offset")
    return base.join(moves, "bin", "left").select(
        "item", F.coalesce("host", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    ``tokenizer``: path of the vocabulary file, the same on every executor.  Null and empty
    texts are the end token alone.  Null ids and repeated rows are packed like any others;
    other columns are not read; an empty table gives an empty result.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = in_arrow(docs.select("doc_id", "text"), _tokenized(tokenizer, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = materialize(cut.withColumn("item", F.monotonically_increasing_id()), "pack-pieces")
    places = pack(pieces.where(F.col("length") < capacity).select("item", "length"), capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity).select(*columns, F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.where(F.col("length") < capacity).join(places, "item").select(*columns, "sequence_id", "offset").unionByName(full)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
