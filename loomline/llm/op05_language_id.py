"""Language identification as a mixture of languages.

A text's character trigrams are taken as drawn from a mixture of the known languages.
Expectation-maximisation estimates the proportions, and the set of languages is chosen by
a likelihood that pays for each language, so that a few loan words add none: languages are
added while that gains more than it costs, and taken away again where it costs more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import id_bucket, in_arrow, materialize, slices

#: Labelled rows, about, from which trigrams are counted; drawn by a hash of the id.
MAX_TRAINING_ROWS = 16_000
SLOTS = 1 << 13
#: Log-likelihood that a further language must gain, for each doubling of the trigrams.
PENALTY = 4.0


class Trigrams:
    """Counts of hashed trigrams over letters; whatever is no letter separates words."""

    def __init__(self) -> None:
        # letters by code point, found when first seen: 0 unknown, 1 letter, 2 other
        self.kind = np.zeros(0x110000, dtype=np.uint8)

    def counts(self, text: str) -> np.ndarray | None:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = self.kind[points]
        if not kinds.all():
            fresh = np.unique(points[kinds == 0])
            self.kind[fresh] = [1 if chr(p).isalpha() else 2 for p in fresh]
            kinds = self.kind[points]
        letter = kinds == 1
        if not letter.any():
            return None
        p = np.where(letter, points, np.uint32(32))
        padded = np.concatenate(([32], p, [32])).astype(np.uint32)
        blank = padded == 32
        padded = padded[~(blank & np.concatenate(([False], blank[:-1])))]
        with np.errstate(over="ignore"):
            h = padded[:-2] * np.uint32(0x9E3779B1) ^ padded[1:-1] * np.uint32(0x85EBCA77) ^ padded[2:] * np.uint32(0xC2B2AE3D)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
        return np.bincount(h >> np.uint32(32 - SLOTS.bit_length() + 1), minlength=SLOTS)


@dataclass
class LanguageModel:
    langs: list[str]
    probs: np.ndarray  # SLOTS x languages

    def infer(self, counts: np.ndarray) -> tuple[str, float, dict[str, float]]:
        """(language, its share, shares of the chosen set) of a text by its trigram counts."""
        used = np.flatnonzero(counts)
        n, p = counts[used].astype(np.float64), self.probs[used]
        total = n.sum()
        alone = n @ np.log(p)
        chosen = [int(alone.argmax())]
        best, theta = alone[chosen[0]], np.ones(1)
        cost = PENALTY * np.log2(1 + total)
        while len(chosen) < len(self.langs):
            # the language with the steepest gain when a little of it is mixed in
            mix = p[:, chosen] @ theta
            gain = (n / mix) @ p
            gain[chosen] = -1
            new = int(gain.argmax())
            if gain[new] <= total:
                break
            trial = [*chosen, new]
            weights, like = _em(p[:, trial], n, np.append(theta * 0.9, 0.1))
            if like - best <= cost:
                break
            chosen, theta, best = trial, weights, like
        while len(chosen) > 1:
            # a language that others have made superfluous goes again
            fits = [_em(p[:, [c for c in chosen if c != out]], n, np.full(len(chosen) - 1, 1 / (len(chosen) - 1))) for out in chosen]
            least = max(range(len(chosen)), key=lambda i: fits[i][1])
            if best - fits[least][1] > cost:
                break
            chosen = [c for i, c in enumerate(chosen) if i != least]
            theta, best = fits[least]
        shares = {self.langs[c]: float(t) for c, t in zip(chosen, theta, strict=True)}
        top = max(range(len(chosen)), key=lambda i: (theta[i], -chosen[i]))
        return self.langs[chosen[top]], float(min(1.0, theta[top])), shares


def _em(p: np.ndarray, n: np.ndarray, theta: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    total = n.sum()
    for _ in range(rounds):
        mix = p @ theta
        new = theta * ((n / mix) @ p) / total
        if np.abs(new - theta).max() < 1e-4:
            theta = new
            break
        theta = new
    return theta, float(n @ np.log(p @ theta))


def fit_languages(docs: DataFrame, may_learn: Column, max_rows: int = MAX_TRAINING_ROWS) -> LanguageModel:
    """Count trigrams of each language in a sample of the rows where ``may_learn`` holds.

    Each language gives an equal share of ``max_rows``, about, or all its rows if it has
    fewer, so that no rare language is left out.
    """
    known = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = materialize(known.groupBy("lang").count(), "lang-sizes")
    each = max_rows / max(1, sizes.count())
    kept = sizes.select("lang", (F.least(F.lit(1.0), F.lit(each) / F.col("count")) * (1 << 30)).cast("long").alias("below"))
    drawn = known.join(kept, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("below"))

    def counted(batches):
        grams, sums = Trigrams(), {}
        for batch in slices(batches):
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = grams.counts(text)
                if lang not in sums:
                    sums[lang] = np.zeros(SLOTS)
                if c is not None:
                    sums[lang] += c / max(1.0, c.sum() / 2000.0)  # no text outweighs the others
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["lang", "sums"]
            )

    # eight partial sums for each language reach the driver, whatever the input
    parts = in_arrow(drawn.select("lang", "text").repartition(8), counted, "lang string, sums binary").collect()
    langs = sorted({r["lang"] for r in parts})
    sums = np.zeros((SLOTS, len(langs)))
    for r in sorted(parts, key=lambda r: (r["lang"], r["sums"])):
        sums[:, langs.index(r["lang"])] += np.frombuffer(r["sums"])
    background = sums.sum(axis=1, keepdims=True) + 1e-3
    smooth = sums + 50.0 * background / background.sum() + 0.05
    return LanguageModel(langs, smooth / smooth.sum(axis=0, keepdims=True))


def may_learn(doc_id: Column) -> Column:
    return id_bucket(doc_id, 4) != 2


def identify(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, shares for every row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, as is every text when
    there is nothing to learn from.  Ties go to the language that sorts first.  Null ids are
    not held out; repeated rows get equal results; an empty table gives an empty result.
    """
    model = fit_languages(docs if learn_from is None else learn_from, may_learn(F.col("doc_id")))

    def told(batches):
        grams = Trigrams()
        for batch in slices(batches):
            langs, scores, shares = [], [], []
            for text in batch.column(1).to_pylist():
                c = grams.counts(text) if text and model.langs else None
                lang, score, share = model.infer(c) if c is not None else ("und", 0.0, {})
                langs.append(lang)
                scores.append(score)
                shares.append(list(share.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                ["doc_id", "lang_pred", "score", "shares"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = in_arrow(docs.select("doc_id", "text"), told, f"doc_id {kind}, lang_pred string, score double, shares map<string,double>")
    return found.withColumn("held_out", ~may_learn(F.col("doc_id")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score")
