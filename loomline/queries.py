"""The queries of the engine by name, and for each the SQL that gives the same rows.

Schema A is that of the test tables; schema B is A with fields renamed and retyped by
rules that both engines can state.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import names
from loomline.functions.types import DISPLAY, TYPE_STRUCT, compare_types, is_compatible_with, type_name
from loomline.ir import Constraint, Entity, Field, Frames, Key, local_frame  # noqa: F401
from loomline.operators import resolve
from loomline.operators.compare import Comparison, compare
from loomline.plans.config import CompareConfig, SemanticConfig
from loomline.sources.databases import from_dataframes

TABLES = sorted("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
#: Exact and normal names only, so that SQL can state every relation of the comparison.
BY_NAME = CompareConfig(semantic=SemanticConfig(enabled=False))


@lru_cache(maxsize=1)
def _pool() -> ThreadPoolExecutor:
    """Threads that wait side by side, as each table's schema takes a footer to be read."""
    return ThreadPoolExecutor(len(TABLES))


def schema_a(spark: SparkSession, sf_dir: str) -> Frames:
    tables = list(_pool().map(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), TABLES))
    source = from_dataframes(dict(zip(TABLES, tables, strict=True)), "tables")
    frames = source.frames(spark)
    return Frames("a", frames.entities, frames.fields.withColumn("nullable", F.col("field_idx") % 2 == 1))


def schema_b(a: Frames) -> Frames:
    i = F.col("field_idx")
    renamed = F.when(i % 4 == 1, F.upper("field_name")).when(i % 4 == 2, F.concat("field_name", F.lit("s"))).when(i % 4 == 3, F.concat(F.lit("x_"), "field_name")).otherwise(F.col("field_name"))
    tag = F.when((i % 3 == 1) & (F.col("type.tag") == "string"), "int64").when(F.col("type.tag") == "int32", "int64").otherwise(F.col("type.tag"))
    fields = a.fields.withColumns({"field_name": renamed, "type": F.col("type").withField("tag", tag), "nullable": F.lit(True)}).where("entity_name <> 'region'")
    return Frames("b", a.entities.where("entity_name <> 'region'"), fields)


def _compared(config: CompareConfig) -> Callable[[SparkSession, str], Comparison]:
    def run(spark: SparkSession, sf_dir: str) -> Comparison:
        a = schema_a(spark, sf_dir)
        return compare(a, schema_b(a), config)

    return run


_by_name, _full = _compared(BY_NAME), _compared(CompareConfig())


def compare_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all matches of a comparison with the default settings."""
    m = _full(spark, sf_dir).all_matches
    return m.select("entity_name", "field_name", "reason", "decision", F.round("score", 6).alias("score"), "index_a", "index_b")


def ir_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = schema_a(spark, sf_dir)
    counts = a.fields.groupBy("entity_idx").agg(F.count("*").alias("n_fields"))
    return a.entities.join(counts, "entity_idx").select("entity_idx", "entity_name", "n_fields")


def ir_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_a(spark, sf_dir).fields.select("entity_name", "field_idx", "field_name", type_name(F.col("type")).alias("type_name"), "nullable")


def ir_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_a(spark, sf_dir).fields.groupBy(type_name(F.col("type")).alias("type_name")).agg(F.count("*").alias("n"))


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field's name in A with a camel-case or renamed form of it."""
    a = schema_a(spark, sf_dir)
    b = schema_b(a).fields.select("entity_idx", "field_idx", F.col("field_name").alias("b"))
    return a.fields.join(b, ["entity_idx", "field_idx"]).select("entity_name", F.col("field_name").alias("a"), "b")


def normalize_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.initcap(F.col("entity_name")), F.initcap(F.col("b")), F.lit("-é.2Go/"))
    return _name_pairs(spark, sf_dir).select(raw.alias("raw"), names.normalize_identifier(raw).alias("normalized"))


def semantic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.initcap("entity_name"), F.initcap("a"), F.lit(".tmp Table"))
    return _name_pairs(spark, sf_dir).select(raw.alias("raw"), F.array_join(names.semantic_tokens(raw, SemanticConfig()), "|").alias("tokens"))


def singularize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.explode(F.split(F.lower(F.concat_ws("_", "entity_name", "a", "b", F.lit("categories_knives_addresses_boxes_branches_dishes_potatoes_class_status_analysis_people_days"))), "_"))
    return _name_pairs(spark, sf_dir).select(word.alias("word")).where("word <> ''").distinct().select("word", names.singular(F.col("word")).alias("singular"))


def set_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.split(F.lower(c), "_") for c in ("a", "b"))
    grams = [names.ngrams(F.lower(c), 3) for c in ("a", "b")]
    rounded = lambda c, n: F.round(c, 6).alias(n)
    return _name_pairs(spark, sf_dir).select(
        "entity_name", "a", "b", rounded(names.set_similarity(a, b, "jaccard"), "token_jaccard"), rounded(names.set_similarity(a, b, "dice"), "token_dice"),
        rounded(names.set_similarity(*grams, "jaccard"), "ngram_jaccard"), rounded(names.set_similarity(*grams, "dice"), "ngram_dice"),
    )


def fuzzy_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.lower("b")
    return _name_pairs(spark, sf_dir).select(
        "entity_name", "a", "b", *[F.round(names.fuzzy_similarity(a, b, k), 6).alias(n) for k, n in (("jaroWinkler", "jaro_winkler"), ("levenshtein", "levenshtein"), ("damerauLevenshtein", "damerau"))]
    )


def type_compatibility_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, 10 if t == "decimal" else None, 2 if t == "decimal" else None, "x" if t == "unknown" else None) for t in DISPLAY]
    types = spark.createDataFrame([(r,) for r in rows], f"t {TYPE_STRUCT}")
    pairs = types.select(F.col("t").alias("a")).join(types.select(F.col("t").alias("b")), F.lit(True))  # 16 x 16 fixed rows
    return pairs.select(F.col("a.tag").alias("from_type"), F.col("b.tag").alias("to_type"), compare_types(F.col("a"), F.col("b")).alias("verdict"), is_compatible_with(F.col("a"), F.col("b")).alias("strict"))


def match_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_name(spark, sf_dir).field_matches.select("entity_name", "field_name_a", "field_name_b", "reason", "score", "index_a", "index_b")


def exclusives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_name(spark, sf_dir).exclusives.select("entity_name", "field_name", "side", "index", "safe_to_add")


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_name(spark, sf_dir).conflicts.select("entity_name", "field_name", "conflict_type", "severity", "from_a", "from_b", "rule", "index_a", "index_b")


def unified_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _by_name(spark, sf_dir)
    return c.unified_fields.select("field_name", type_name(F.col("type")).alias("type_name"), "nullable", "origin", "state", "index_a", "index_b")


def comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _by_name(spark, sf_dir)
    return resolve.summary(c.all_matches, c.conflicts, c.exclusives)


def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _by_name(spark, sf_dir)
    m = resolve.metrics(c.all_matches, c.conflicts, c.exclusives)
    return m.select(*[F.round(n, 6).alias(n) if t == "double" else F.col(n) for n, t in m.dtypes])


def top_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.top_conflicts(_by_name(spark, sf_dir).conflicts)


def conflicts_by_type_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.conflicts_by_type_severity(_by_name(spark, sf_dir).conflicts)


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = resolve.suggest(_by_name(spark, sf_dir).conflicts)
    return s.select("id", "conflict_no", "entity_name", "field_name", "kind", "confidence", "impact", "explanation")


def auto_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = resolve.auto_decide(resolve.suggest(_by_name(spark, sf_dir).conflicts))
    return d.select("decision_id", "suggestion_id", "entity_name", "field_name", "accepted", "rationale")


def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.decision_summary(resolve.auto_decide(resolve.suggest(_by_name(spark, sf_dir).conflicts)))


QUERIES = [
    compare_matches, ir_entities, ir_fields, ir_type_histogram, normalize_identifiers, semantic_tokens, singularize_tokens, set_similarities, fuzzy_similarities,
    type_compatibility_matrix, match_fields, exclusives, conflicts, unified_fields, comparison_summary, report_metrics, top_conflicts, conflicts_by_type_severity,
    suggestions, auto_decisions, decision_summary,
]


def queries() -> dict:
    from loomline import rule_queries, source_queries  # they build on this module

    return {f.__name__: f for f in [*QUERIES, *source_queries.QUERIES, *rule_queries.QUERIES]}


_LIST = ", ".join(f"'{t}'" for t in TABLES)
_A = f"""
c AS (
  SELECT table_name AS entity, column_name AS field, cast(row_number() OVER (PARTITION BY table_name ORDER BY ordinal_position) - 1 AS INT) AS i,
    CASE data_type WHEN 'BIGINT' THEN 'Int64' WHEN 'INTEGER' THEN 'Int32' WHEN 'DOUBLE' THEN 'Float64' WHEN 'VARCHAR' THEN 'String'
      WHEN 'TIMESTAMP' THEN 'DateTime' ELSE 'Json' END AS type
  FROM information_schema.columns WHERE table_name IN ({_LIST})
), a AS (SELECT *, i % 2 = 1 AS nullable, cast(dense_rank() OVER (ORDER BY entity) - 1 AS INT) AS e FROM c
), b AS (
  SELECT entity, e, i, CASE i % 4 WHEN 1 THEN upper(field) WHEN 2 THEN field || 's' WHEN 3 THEN 'x_' || field ELSE field END AS field,
    CASE WHEN i % 3 = 1 AND type = 'String' THEN 'Int64' WHEN type = 'Int32' THEN 'Int64' ELSE type END AS type, true AS nullable
  FROM a WHERE entity <> 'region'
), p AS (SELECT a.entity, a.field AS a, b.field AS b FROM a JOIN b USING (entity, i))
"""
_N = "trim(regexp_replace(lower({0}), '[ _]+', '_', 'g'), '_')"
_CMP = _A + f""", m AS (
  SELECT a.e, a.entity, a.field AS fa, b.field AS fb, a.i AS ia, b.i AS ib, a.type AS ta, b.type AS tb, a.nullable AS na,
    CASE WHEN a.field = b.field THEN 'exact_name' ELSE 'normalized_name' END AS reason, CASE WHEN a.field = b.field THEN 1.0 ELSE 0.9 END::DOUBLE AS score
  FROM a JOIN b ON a.e = b.e AND (a.field = b.field OR {_N.format('a.field')} = {_N.format('b.field')})
), k AS (
  SELECT e, entity, fa, ia, ib, 0 AS r, 'type_incompatible' AS kind, 'high' AS severity, 'Type: ' || ta AS from_a, 'Type: ' || tb AS from_b, ta, tb, 'Types must be compatible' AS rule
  FROM m WHERE ta <> tb AND NOT (ta = 'Int32' AND tb = 'Int64')
  UNION ALL SELECT e, entity, fa, ia, ib, 1, 'nullability_mismatch', 'medium', 'Nullable: false', 'Nullable: true', ta, tb, 'Nullability must match or be compatible' FROM m WHERE NOT na
), x AS (
  SELECT entity, field, 'A' AS side, i FROM a WHERE entity <> 'region' AND NOT EXISTS (SELECT 1 FROM m WHERE m.e = a.e AND m.ia = a.i)
  UNION ALL SELECT entity, field, 'B', i FROM b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.e = b.e AND m.ib = b.i)
  UNION ALL SELECT DISTINCT entity, NULL, 'A', e FROM a WHERE entity = 'region'
), am AS (SELECT score FROM m UNION ALL SELECT DISTINCT 1.0::DOUBLE FROM b GROUP BY entity
), t AS (
  SELECT (SELECT count(*) FROM m) + (SELECT count(DISTINCT entity) FROM b) AS nm, (SELECT count(*) FROM k) AS nk, (SELECT count(*) FROM x) AS nx,
    (SELECT count(*) FROM x WHERE side = 'A') AS xa, (SELECT count(*) FROM x WHERE side = 'B') AS xb
), s AS (
  SELECT cast(row_number() OVER (ORDER BY e, ia, ib, r) - 1 AS INT) AS n, *,
    CASE WHEN kind = 'type_incompatible' THEN 'no_suggestion' ELSE 'prefer_type' END AS suggestion,
    CASE WHEN kind = 'type_incompatible' THEN 'critical' ELSE 'low' END AS impact FROM k
)
"""


def _case(tests: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in tests) + f" ELSE {other} END"


_WORDS = "string_split(lower({0}), '_')"
_GRAMS = "list_distinct([lower({0})[g:g+2] FOR g IN range(1, greatest(length({0}) - 2, 1) + 1)])"


def _set(a: str, b: str, dice: bool) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    if dice:
        return f"round(2.0 * {shared} / (len(list_distinct({a})) + len(list_distinct({b}))), 6)::DOUBLE"
    return f"round({shared} / len(list_distinct(list_concat({a}, {b})))::DOUBLE, 6)"


def _singular_sql() -> str:
    tests = [(f"word = '{k}'", f"'{v}'") for k, v in names.IRREGULAR.items()]
    cut = lambda n, more="": f"substr(word, 1, length(word) - {n})" + (f" || '{more}'" if more else "")
    tests += [
        ("length(word) < 3", "word"), ("regexp_matches(word, '[^aeiou]ies$')", cut(3, "y")), ("regexp_matches(word, '.ves$')", cut(3, "fe")),
        ("regexp_matches(word, 'sses$')", cut(2)), ("regexp_matches(word, '.xes$')", cut(2)), ("regexp_matches(word, '.[cs]hes$')", cut(2)),
        ("regexp_matches(word, '.oes$')", cut(2)), ("regexp_matches(word, '[^sui]s$')", cut(1)),
    ]
    return _case(tests, "word")


def oracle_sql() -> dict[str, str]:
    w = "WITH " + _A
    x = "WITH " + _CMP
    rate = "CASE WHEN nm + nk = 0 THEN 0 ELSE 100.0 * nk / (nm + nk) END"
    high = "(SELECT count(*) FROM k WHERE severity = 'high')"
    words, grams = [[f.format(c) for c in ("a", "b")] for f in (_WORDS, _GRAMS)]
    title = lambda c: f"upper({c}[1]) || lower({c}[2:])"
    camel = "regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    raw_id = f"' ' || {title('entity')} || {title('b')} || '-é.2Go/'"
    raw_sem = f"{title('entity')} || {title('a')} || '.tmp Table'"
    from loomline import rule_queries, source_queries

    return source_queries.oracle_sql() | rule_queries.oracle_sql() | {
        "ir_entities": w + "SELECT e AS entity_idx, entity AS entity_name, count(*) AS n_fields FROM a GROUP BY 1, 2",
        "ir_fields": w + "SELECT entity AS entity_name, i AS field_idx, field AS field_name, type AS type_name, nullable FROM a",
        "ir_type_histogram": w + "SELECT type AS type_name, count(*) AS n FROM a GROUP BY 1",
        "normalize_identifiers": w + f", q AS (SELECT {raw_id} AS raw FROM p) SELECT raw, trim(regexp_replace(lower(regexp_replace(regexp_replace(trim(raw), '[^A-Za-z0-9 ./\\\\_-]', '', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[ ./\\\\_-]+', '_', 'g'), '_') AS normalized FROM q",
        "semantic_tokens": w + f", q AS (SELECT {raw_sem} AS raw FROM p) SELECT raw, array_to_string(list_filter(string_split(regexp_replace(lower({camel.format('raw')}), '[ ._/-]+', ' ', 'g'), ' '), lambda t: t NOT IN ('', 'tbl', 'table', 'tmp', 'backup', 'bak')), '|') AS tokens FROM q",
        "singularize_tokens": w + f", q AS (SELECT DISTINCT unnest(string_split(lower(concat_ws('_', entity, a, b, 'categories_knives_addresses_boxes_branches_dishes_potatoes_class_status_analysis_people_days')), '_')) AS word FROM p) SELECT word, {_singular_sql()} AS singular FROM q WHERE word <> ''",
        "set_similarities": w + f"SELECT entity AS entity_name, a, b, {_set(*words, False)} AS token_jaccard, {_set(*words, True)} AS token_dice, {_set(*grams, False)} AS ngram_jaccard, {_set(*grams, True)} AS ngram_dice FROM p",
        "fuzzy_similarities": w + "SELECT entity AS entity_name, a, b, round(jaro_winkler_similarity(a, lower(b)), 6) AS jaro_winkler, round(1 - levenshtein(a, lower(b)) / greatest(length(a), length(b))::DOUBLE, 6) AS levenshtein, round(1 - damerau_levenshtein(a, lower(b)) / greatest(length(a), length(b))::DOUBLE, 6) AS damerau FROM p",
        "match_fields": x + "SELECT entity AS entity_name, fa AS field_name_a, fb AS field_name_b, reason, score, ia AS index_a, ib AS index_b FROM m",
        "exclusives": x + "SELECT entity AS entity_name, field AS field_name, side, i AS index, true AS safe_to_add FROM x",
        "conflicts": x + "SELECT entity AS entity_name, fa AS field_name, kind AS conflict_type, severity, from_a, from_b, rule, ia AS index_a, ib AS index_b FROM k",
        "unified_fields": x + """SELECT fa AS field_name, ta AS type_name, na AS nullable, 'BOTH' AS origin, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.e = m.e AND k.ia = m.ia AND k.ib = m.ib) THEN 'conflicted' ELSE 'matched' END AS state, ia AS index_a, ib AS index_b FROM m
          UNION ALL SELECT field, type, nullable, 'A', 'exclusive', i, NULL FROM a WHERE entity = 'region' OR NOT EXISTS (SELECT 1 FROM m WHERE m.e = a.e AND m.ia = a.i)
          UNION ALL SELECT field, type, nullable, 'B', 'exclusive', NULL, i FROM b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.e = b.e AND m.ib = b.i)""",
        "comparison_summary": x + "SELECT nm AS total_matches, nx AS total_exclusives, nk AS total_conflicts, xa AS exclusives_a, xb AS exclusives_b FROM t",
        "report_metrics": x + f"""SELECT nm AS total_matches, nx AS total_exclusives, nk AS total_conflicts, xa AS exclusives_a, xb AS exclusives_b,
          round(((SELECT sum(score) FROM m) + (SELECT count(DISTINCT entity) FROM b)) / nm, 6)::DOUBLE AS average_match_confidence, 0::BIGINT AS critical_conflicts, {high} AS high_severity_conflicts,
          round(100.0 * nm / (nm + nk), 6)::DOUBLE AS compatibility_score, round({rate}, 6)::DOUBLE AS conflict_rate, 100.0::DOUBLE AS safe_addition_rate,
          CASE WHEN {rate} > 50 THEN 'Critical' WHEN {rate} > 25 OR {high} >= 1 THEN 'High' WHEN {rate} > 10 THEN 'Medium' ELSE 'Low' END AS risk_level FROM t""",
        "top_conflicts": x + "SELECT entity AS entity_name, count(*) AS n_conflicts, CASE WHEN bool_or(severity = 'high') THEN 'high' ELSE 'medium' END AS highest_severity FROM k GROUP BY entity ORDER BY count(*) DESC, bool_or(severity = 'high') DESC, entity LIMIT 5",
        "conflicts_by_type_severity": x + "SELECT kind AS conflict_type, severity, count(*) AS n FROM k GROUP BY 1, 2",
        "suggestions": x + f"""SELECT 'sug_' || n AS id, n AS conflict_no, entity AS entity_name, fa AS field_name, suggestion AS kind, 0.9::DOUBLE AS confidence, impact,
          CASE WHEN suggestion = 'no_suggestion' THEN '{resolve.NO_WAY}' ELSE 'Use NULLABLE to accommodate both schemas' END AS explanation FROM s""",
        "auto_decisions": x + "SELECT 'auto_dec_' || (n + 1) AS decision_id, 'sug_' || n AS suggestion_id, entity AS entity_name, fa AS field_name, true AS accepted, 'Automated by rule: high_confidence_auto_accept' AS rationale FROM s",
        "decision_summary": x + "SELECT count(*) AS total, count(*) AS accepted, 0::BIGINT AS rejected, count(*) AS system_decisions, 0::BIGINT AS user_decisions FROM s",
    }
