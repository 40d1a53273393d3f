"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document.  The ledger stores the measurements and one
64-bit integer with a bit for each failed rule; a policy is a mask over those bits, so new
policies, their versions and ablations are bitwise arithmetic over the ledger and never
read a text again.  All of it is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import SPACE, let, words_of

WINDOW = 5


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five which occurs twice or more in the text.

    Windows are compared by 64-bit hashes; sorting them brings equal ones together, so the
    work grows as n log n whatever the text repeats.
    """

    def covered(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def of_windows(windows: Column) -> Column:
        def starts(ordered: Column) -> Column:
            twin = lambda x, j: ((j > 0) & (F.get(ordered, j - 1)["h"] == x["h"])) | F.coalesce(
                F.get(ordered, j + 1)["h"] == x["h"], F.lit(False)
            )
            return F.array_sort(F.transform(F.filter(ordered, twin), lambda x: x["i"]))

        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            covered(let(ordered, starts))
        )

    def of_hashes(hashes: Column) -> Column:
        count = F.size(hashes) - (WINDOW - 1)
        windows = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
        return F.when(count < 2, F.lit(0).cast("long")).otherwise(let(windows, of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def measurements(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "_counts": let(
            words_of(text),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
        ),
        "n_lines": F.size(lines).cast("long"),
        "n_marks": (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long"),
    }


#: Rules by bit, as predicates over the measurements; true means the document fails.
#: A rule keeps its bit for good: a new rule takes the next one.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 5 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "exclamations": "10 * n_marks > 5 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules; a document passes if it fails none of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeats"))
STANDARD = Policy("standard", 1, tuple(RULES))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``fail_bits``; one row per input row, in one pass, no shuffle.

    Null and empty texts have zero words and fail ``few_words`` alone.  Repeated rows give
    repeated rows; other columns are not read; an empty table gives an empty ledger.
    """
    measured = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in measurements(F.col(text_col)).items()])
    measured = measured.select(
        "doc_id", "_counts.n_words", "word_chars", "n_symbols", "n_dup_lines", "_counts.n_repeat_words", "n_lines", "n_marks"
    )
    bits = sum((F.expr(p).cast("long") * F.lit(1 << b) for b, p in enumerate(RULES.values())), F.lit(0).cast("long"))
    return measured.withColumn("fail_bits", bits)


def verdict(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it rejects.

    One aggregation with a partial sum per task; its result has one row for each rule.
    """
    failed = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    ruled = F.explode(
        F.array(
            *[
                F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit"))
                for r in policy.rules
            ]
        )
    )
    return (
        book.groupBy(failed.alias("failed"))
        .count()
        .select("failed", "count", ruled.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("failing"),
            F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("only_this"),
        )
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~verdict(BASE)).alias("base_failed"),
        (verdict(BASE) & verdict(STANDARD)).alias("kept"),
        "n_lines", "n_marks", "fail_bits",
    )


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM t
), windows AS (
  SELECT r, i, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM w)
), twice AS (
  SELECT r, unnest([i, i+1, i+2, i+3, i+4]) AS p
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM twice GROUP BY r
), m AS (
  SELECT doc_id, cast(len(w) AS BIGINT) AS n_words,
         cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         cast(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         cast(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         cast(len(l) AS BIGINT) AS n_lines,
         cast(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_marks
  FROM w LEFT JOIN repeats USING (r)
), b AS (
  SELECT *, cast(
      (CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 5 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 10 * n_marks > 5 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       fail_bits = 0 AS kept, n_lines, n_marks, fail_bits
FROM b
"""
