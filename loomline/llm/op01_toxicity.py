"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: a word or word beginning belongs to it if it is rare outside toxic
training texts and follows several different words inside them, so that the vocabulary of
one text that was copied often stays out.  Each text is then a few densities and rates; the
trees are fitted on the driver to a bounded sample of labelled rows, and calibrated on
margins that every row got from trees and a lexicon that had not seen it.  Scoring is one
pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.boosting import Boosted, fit_boosted, fit_isotonic
from loomline.llm.common import id_bucket, in_arrow, slices

#: Labelled rows, about, to which the model is fitted; drawn by a hash of the id.
MAX_TRAINING_ROWS = 16_000
FOLDS = 3
#: Different terms that a worker counts before it hands them on.
MAX_COUNTED = 30_000
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7

#: Insults known beforehand, and second-person words of a few languages.
SEED_LEXICON = frozenset("idiot moron imbecile stupid dumb fool loser scum trash garbage pathetic worthless disgusting clown".split())
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer ti tú vosotros usted ustedes".split()
)
LEET = str.maketrans("013457@$!|", "oieastasil")

WORDS = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W\d_]+[0-9@$!|*.\-_]+[^\W\d_](?:[^\W\d_]|[0-9@$!|*.\-_])*")

FEATURES = (
    "log_words", "strong", "strong_density", "weak", "weak_density", "seed", "seed_density", "near_you", "you_density",
    "capitals", "punctuation", "exclamations", "symbols", "masked", "masked_hits", "distinct_hits",
)


@dataclass
class Lexicon:
    """Classes of terms: 2 strong, 1 weak.  Beginnings of words are terms that end with ``~``."""

    terms: dict[str, int] = field(default_factory=dict)

    def classify(self, word: str) -> int:
        found = self.terms.get(word, 0)
        for n in PREFIXES:
            if len(word) >= n:
                found = max(found, self.terms.get(word[:n] + "~", 0))
        return found + 4 * (word in SEED_LEXICON) + 8 * (word in SECOND_PERSON)


class Classes(dict):
    """Classes of words, found once each; emptied when it has grown large."""

    LIMIT = 60_000

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        found = self[word] = self.lexicon.classify(word)
        return found


def features(text: str, classes: Classes) -> list[float]:
    low = text.lower()
    words = WORDS.findall(low)
    kinds = [classes[w] for w in words]
    n, chars = max(1, len(words)), max(1, len(text))
    marked = [i for i, k in enumerate(kinds) if k] if any(kinds) else []
    strong = [i for i in marked if kinds[i] & 3 == 2]
    weak = [i for i in marked if kinds[i] & 3 == 1]
    seeds = [i for i in marked if kinds[i] & 4]
    you = [i for i in marked if kinds[i] & 8]
    near = 0
    if you:
        hits, j = sorted({*strong, *seeds}), 0
        for i in hits:
            while j < len(you) and you[j] < i - 5:
                j += 1
            near += j < len(you) and you[j] <= i + 5
    octets = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=128)
    masked = MASKED.findall(low) if octets[DIRT].any() else []
    unmasked = sum(classes[WORDS.sub(lambda m: m[0], re.sub(r"[^\w]|_", "", w.translate(LEET)))] & 6 > 1 for w in masked) if masked else 0
    return [
        float(np.log1p(len(words))), len(strong), len(strong) / n, len(weak), len(weak) / n, len(seeds), len(seeds) / n, near, len(you) / n,
        octets[65:91].sum() / chars, octets[33:48].sum() / chars, octets[33] / chars, octets[SYMBOLS].sum() / chars,
        len(masked) / n, unmasked, len({words[i] for i in [*strong, *seeds]}),
    ]


DIRT = np.frombuffer(b"0123456789@$!|*.-_", np.uint8).copy()
SYMBOLS = np.frombuffer(b"#*$%&|<>@^~", np.uint8).copy()


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Boosted | None
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, texts: list[str | None], classes: Classes) -> np.ndarray:
        x = np.array([features(t or "", classes) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))
        margin = self.trees.margin(x) if self.trees else np.zeros(len(x))
        return np.clip(np.interp(margin, *self.knots), 0.0, 1.0)


def _term_counts(batches):
    """(term, fold, context, toxic, texts) of rows (text, toxic, fold), counted in part: a full counter goes out and begins anew."""
    counts: Counter = Counter()
    for batch in slices(batches):
        for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = WORDS.findall((text or "").lower())
            seen = set()
            for before, word in zip(["", *words], words, strict=False):
                for term in (word, *(word[:k] + "~" for k in PREFIXES if len(word) >= k)):
                    if term not in seen:
                        seen.add(term)
                        counts[term, fold, crc32(before.encode()) & 0xFFFF if toxic else -1, toxic] += 1
            if len(counts) > MAX_COUNTED:
                yield _counted(counts)
                counts.clear()
    yield _counted(counts)


def _counted(counts: Counter) -> pa.RecordBatch:
    columns = [pa.array(values, kind) for values, kind in zip(zip(*counts, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)] if counts else [pa.array([], pa.string()), *[pa.array([], pa.int32())] * 3]
    return pa.RecordBatch.from_arrays([*columns, pa.array(counts.values(), pa.int64())], ["term", "fold", "context", "toxic", "n"])


def _lexicon(rows, held_out: int | None) -> Lexicon:
    """Terms of all folds but one; each row has lists by fold of toxic, other and context counts."""
    terms = {}
    for term, toxic, other, contexts in rows:
        a, b, c = (sum(v for f, v in enumerate(x) if f != held_out) for x in (toxic, other, contexts))
        share = a / max(1, a + b)
        if c >= 3 and share >= 0.95:
            terms[term] = 2
        elif c >= 2 and share >= 0.7:
            terms[term] = 1
    return Lexicon(terms)


def fit_toxicity(docs: DataFrame, labels: DataFrame, may_learn: Column, max_rows: int = MAX_TRAINING_ROWS) -> ToxicityModel:
    """Fit to the rows of ``labels`` (doc_id, toxic) where ``may_learn`` holds; a tie of labels is toxic.

    Of rows that share an id one teaches, so a repeated id cannot make the sample grow.
    """
    known = labels.where(may_learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, max_rows / max(1, total)))))
    # about max_rows ids at most, whatever the tables' size
    one = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = one.select("text", "toxic", F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(FOLDS)).cast("int").alias("fold"))
    counts = in_arrow(sample, _term_counts, "term string, fold int, context int, toxic int, n long")
    by_context = counts.groupBy("term", "fold", "context", "toxic").agg(F.sum("n").alias("n"))
    per_fold = lambda cond, what: F.array(*[F.coalesce(F.sum(F.when(cond & (F.col("fold") == f), what)), F.lit(0)) for f in range(FOLDS)])
    toxic = F.col("toxic") == 1
    terms = (
        by_context.groupBy("term")
        .agg(per_fold(toxic, F.col("n")).alias("a"), per_fold(~toxic, F.col("n")).alias("b"), per_fold(toxic, F.lit(1)).alias("c"),
             F.sum(F.when(toxic, F.col("n"))).alias("hits"), F.sum("n").alias("all"))
        .where("hits >= 2 and hits >= 0.6 * all and aggregate(c, 0L, (x, y) -> x + y) >= 2")
        .select("term", "a", "b", "c")
    )
    rows = [(r["term"], r["a"], r["b"], r["c"]) for r in terms.collect()]
    lexicon = _lexicon(rows, None)
    parts = [_lexicon(rows, f) for f in range(FOLDS)]

    def measured(batches):
        classes = [Classes(p) for p in parts]
        for batch in slices(batches):
            text, toxic, fold = (c.to_pylist() for c in batch.columns)
            x = [features(t or "", classes[f]) for t, f in zip(text, fold, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(fold, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["toxic", "fold", "x"])

    table = in_arrow(sample, measured, "toxic int, fold int, x array<double>").toArrow()
    y = np.array(table.column("toxic").to_pylist(), dtype=np.float64)
    fold = np.array(table.column("fold").to_pylist(), dtype=np.int64)
    x = np.array(table.column("x").to_pylist(), dtype=np.float64).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, fold, y))  # the same trees in whatever order the rows came
    x, y, fold = x[order], y[order], fold[order]
    if len(y) == 0 or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(lexicon, None, (np.array([0.0]), np.array([rate])))
    margins = np.zeros(len(y))
    for f in range(FOLDS):
        rest = fold != f
        if rest.all() or not rest.any():
            continue
        margins[~rest] = fit_boosted(x[rest], y[rest]).margin(x[~rest])
    return ToxicityModel(lexicon, fit_boosted(x, y), fit_isotonic(margins, y))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` columns doc_id and text, with ``score``: one row per row, null and empty texts too."""

    def scored(batches):
        classes = Classes(model.lexicon)
        for batch in slices(batches):
            s = model.scores(batch.column(1).to_pylist(), classes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), scored, f"doc_id {kind}, score double")


def may_learn(doc_id: Column) -> Column:
    return id_bucket(doc_id, 3) != 1


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null texts score like empty ones; null ids are not held out and teach nothing; repeated
    rows get equal scores.  Without labels, or with labels of one kind only, every score is
    the share of toxic labels.  An empty table gives an empty result.
    """
    model = fit_toxicity(docs, labels, may_learn(F.col("doc_id")))
    return score_toxicity(docs, model).select(
        "doc_id", (~may_learn(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns."""
    model = fit_toxicity(docs, labels, may_learn(F.col("doc_id")))

    def clean(batches):
        classes = Classes(model.lexicon)
        for batch in slices(batches):
            s = model.scores(batch.column(batch.schema.get_field_index("text")).to_pylist(), classes)
            yield batch.filter(pa.array(s < THRESHOLD))

    return in_arrow(docs, clean, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
