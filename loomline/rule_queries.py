"""Queries over every rule of a comparison, and the SQL that gives the same rows.

Schema C is that of the test tables with types and constraints by rules, and schema D is C
with some names in capitals and other types, flags and constraints, so that each kind of
conflict and suggestion occurs.
"""

from __future__ import annotations

import json
import tempfile
from dataclasses import replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline import queries as base
from loomline import report
from loomline.functions import names
from loomline.functions.types import are_types_compatible, compare_types, type_name
from loomline.ir import CONSTRAINT, Frames, local_frame
from loomline.operators import resolve
from loomline.operators.compare import Comparison, best_matches, compare, prepared
from loomline.plans.config import CompareConfig, ResolutionConfig, SemanticConfig, Settings
from loomline.streaming.drift import drift

#: Exact names only, so names that differ in their case collide.
EXACT = CompareConfig(normalized_matching=False, semantic=SemanticConfig(enabled=False))
SIMILAR = replace(EXACT, similarity_matching=True)
#: (from, to, safe, note): each cast rule, the order of the rules, and casts without one.
CASTS = (
    ("Int8", "Int64", True, ""), ("TINYINT", "bigint", True, ""), ("smallint", "Int32", True, ""), ("Int32", "Int64", True, ""), ("int", "bigint", True, ""),
    ("Int64", "Float32", True, "Possible precision loss for very large integers"), ("integer", "Decimal(10, 2)", True, "Possible precision loss for very large integers"),
    ("Int64", "Int32", False, "Potential overflow if values exceed target range"), ("bigint", "int", False, "Potential overflow if values exceed target range"), ("Int32", "Int8", False, "Potential overflow if values exceed target range"),
    ("Float32", "Int64", False, "Loss of decimal precision"), ("Decimal(5, 1)", "Int32", False, "Loss of decimal precision"), ("varchar(9)", "Text", True, ""), ("Text", "varchar(9)", False, "Potential truncation of long text"),
    ("String", "Boolean", None, None), ("Date", "Int64", None, None),
)
#: (precision, scale) pairs and the verdict on going from the first to the second.
DECIMALS = ((10, 2, 12, 2, "widening_safe"), (10, 2, 10, 2, "identical"), (10, 2, 9, 2, "requires_cast"), (10, 2, 12, 1, "requires_cast"), (5, 0, 5, 3, "widening_safe"))
PRESETS = (
    ("default", "similarity_matching", "False"), ("default", "similarity_threshold", "0.7"), ("default", "semantic", "True"), ("default", "match_threshold", "0.8"), ("default", "probable_threshold", "0.55"),
    ("all_features", "similarity_matching", "True"), ("all_features", "semantic", "True"), ("minimal", "exact_matching", "True"), ("minimal", "normalized_matching", "False"), ("minimal", "check_nullability", "False"), ("minimal", "detect_collisions", "False"), ("minimal", "semantic", "False"),
    ("strict", "similarity_threshold", "0.9"), ("clamped", "similarity_threshold", "1.0"), ("conservative", "allow_risky_suggestions", "False"), ("conservative", "min_confidence", "0.7"), ("conservative", "generate_alternatives", "False"),
    ("prefer_b", "type_preference", "prefer_schema_b"), ("prefer_b", "length_preference", "prefer_schema_b"), ("again", "confidence_threshold", "0.9"), ("file", "similarity_threshold", "0.85"), ("file", "confidence_threshold", "0.5"), ("file", "decision_id_prefix", "d"), ("file", "generate_report", "False"), ("file", "generate_diff", "True"), ("file", "output_dir", "out"), ("flag", "confidence_threshold", "0.7"),
)
TOML = '[compare]\nsimilarity_threshold = 0.85\ndefault_output_dir = "out"\n[resolution]\nconfidence_threshold = 0.5\ndecision_id_prefix = "d"\n[output]\ngenerate_report = false\n'


def schema_c(spark: SparkSession, sf_dir: str) -> Frames:
    a = base.schema_a(spark, sf_dir)
    tag = F.when(F.col("type.tag") == "float64", "float32").otherwise(F.col("type.tag"))
    i = F.col("field_idx")
    return Frames("c", a.entities, _constrained(a.fields, i % 3 == 0, 10 * i).withColumn("type", F.col("type").withField("tag", tag)))


def schema_d(c: Frames) -> Frames:
    i, tag = F.col("field_idx"), F.col("type.tag")
    retyped = F.when(tag == "int64", "float32").when(tag == "float32", "int64").when((tag == "string") & (i % 2 == 0), "boolean").otherwise(tag)
    fields = _constrained(c.fields.where("entity_name <> 'region'"), i % 2 == 0, F.when(i % 5 == 0, 10 * i).otherwise(20))
    named = F.when(i % 4 == 1, F.upper("field_name")).otherwise(F.col("field_name"))
    fields = fields.withColumns({"field_name": named, "type": F.col("type").withField("tag", retyped), "nullable": i % 3 == 0})
    return Frames("d", c.entities.where("entity_name <> 'region'"), fields)


def _constrained(fields: DataFrame, unique: Column, longest: Column) -> DataFrame:
    """Unique where ``unique`` says so, and a greatest length for strings."""
    none = F.lit(None)

    def one(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("constraint_type"), value.cast("long").alias("value"), none.cast("int").alias("precision"), none.cast("int").alias("scale"), none.cast("string").alias("default_value"), none.cast("string").alias("expression"))

    both = F.array(F.when(unique, one("Unique", none)), F.when(F.col("type.tag") == "string", one("MaxLength", longest)))
    return fields.withColumn("constraints", F.filter(both, lambda x: x.isNotNull()).cast(f"array<{CONSTRAINT}>"))


def _ruled(spark: SparkSession, sf_dir: str, config: CompareConfig = EXACT) -> Comparison:
    c = schema_c(spark, sf_dir)
    return compare(c, schema_d(c), config)


def rule_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of all five rules in their order."""
    return resolve.conflict_order(_ruled(spark, sf_dir).conflicts).select("conflict_no", "entity_name", "field_name", "conflict_type", "severity", "from_a", "from_b", "rule", "index_a", "index_b")


def rule_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions of all kinds that rules make: casts, renames, types to prefer, and none."""
    s = resolve.suggest(_ruled(spark, sf_dir).conflicts)
    return s.select("id", "conflict_no", "entity_name", "field_name", "kind", "confidence", "impact", "explanation", F.array_join("evidence", "|").alias("evidence"), "args.from_type", "args.to_type", "args.warning", "args.original_name", "args.suggested_name", "args.reason", "args.preferred_type")


def safe_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions without risky ones, by kind and level of confidence."""
    return resolve.suggestion_levels(resolve.suggest(_ruled(spark, sf_dir).conflicts, ResolutionConfig.conservative()))


def suggestion_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.suggestion_levels(resolve.suggest(_ruled(spark, sf_dir).conflicts))


def _decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(conflicts, decisions): what the system accepts, and a user who rejects every risky cast of lineitem and accepts the others."""
    conflicts = _ruled(spark, sf_dir).conflicts
    suggestions = resolve.suggest(conflicts)
    mine = suggestions.where("kind = 'cast_risky'").select(F.col("id").alias("suggestion_id"), F.concat(F.lit("user_"), "no").alias("decision_id"), (F.col("entity_name") != "lineitem").alias("accepted"), F.lit("looked at").alias("rationale"), F.lit("ann").alias("username"))
    return conflicts, resolve.auto_decide(suggestions).unionByName(resolve.decide(suggestions, mine))


def rule_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, decisions = _decisions(spark, sf_dir)
    marked = resolve.mark(resolve.decisions_for(decisions, "lineitem"), ["auto_dec_1"], "applied").unionByName(resolve.decisions_for(decisions, "orders", False))
    return marked.select("decision_id", "suggestion_id", "entity_name", "field_name", "accepted", "source", "rule", "rationale", "status")


def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conflicts, decisions = _decisions(spark, sf_dir)
    counted = resolve.decision_summary(decisions).withColumn("k", F.lit(1))
    return counted.join(resolve.unresolved(conflicts, decisions).withColumn("k", F.lit(1)), "k").drop("k")


def rule_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _ruled(spark, sf_dir)
    m = resolve.metrics(c.all_matches, c.conflicts, c.exclusives)
    return m.select(*[F.round(n, 6).alias(n) if t == "double" else F.col(n) for n, t in m.dtypes])


def rule_top_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.top_conflicts(_ruled(spark, sf_dir).conflicts, by_severity=False)


def unified_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir).unified_entities.select("entity_name", "entity_type", "origin", "entity_a", "entity_b")


def rule_unified_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir).unified_fields.select("field_name", type_name(F.col("type")).alias("type_name"), "nullable", "origin", "state", "index_a", "index_b")


def match_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.match_reasons(base._by_name(spark, sf_dir).all_matches)


def similarity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by Jaro-Winkler similarity of raw names, entities too, and which of them are best for both."""
    c = _ruled(spark, sf_dir, SIMILAR)
    best = best_matches(c.field_matches, ["entity_a", "entity_b"], "index_a", "index_b").select("entity_a", "entity_b", "index_a", "index_b", F.lit(True).alias("best"))
    m = c.all_matches.join(best, ["entity_a", "entity_b", "index_a", "index_b"], "left")
    return m.select("entity_a", "entity_b", "entity_name", "field_name", "reason", F.round("score", 6).alias("score"), "index_a", "index_b", F.when(F.col("field_name").isNotNull(), F.coalesce("best", F.lit(False))).alias("best"))


def semantic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six strategies and the score of each field name of the tables with each that ends in the same words."""
    config = CompareConfig()
    a = base.schema_a(spark, sf_dir).fields.select("field_name").distinct()
    b = a.select(F.concat(F.split_part("field_name", F.lit("_"), F.lit(-1)), F.lit("Identifiers")).alias("b")).unionByName(a.select(F.concat(F.lit("x_"), "field_name", F.lit("_no")).alias("b"))).distinct()
    left = prepared(a.withColumnRenamed("field_name", "a"), "a", config).withColumnRenamed("n", "n_a")
    right = prepared(b, "b", config).withColumnRenamed("n", "n_b")
    # pairs that share a token, under the smallest
    keyed = [df.withColumn("t", F.col(f"{n}.morph")) for df, n in ((left, "n_a"), (right, "n_b"))]
    pairs = keyed[0].withColumn("k", F.explode("t")).join(keyed[1].withColumnRenamed("t", "t2").withColumn("k", F.explode("t2")), "k").where(F.array_min(F.array_intersect("t", "t2")) == F.col("k"))
    s = names.semantic_score(F.col("n_a"), F.col("n_b"), config.semantic)
    scored = pairs.select("a", "b", s.alias("s"))
    said = F.array_join(F.transform(names.score_reasons(F.col("s"), config.semantic), lambda r: r["strategy"]), ",")
    rounded = [F.round(F.col(f"s.{k}").cast("double"), 6).alias(k) for k in names.STRATEGIES]
    return scored.select("a", "b", *rounded, F.round("s.score", 6).alias("score"), "s.decision", said.alias("said"))


def cast_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = local_frame(spark, [c[:2] for c in CASTS], "a string, b string")
    return given.select("a", "b", resolve.cast_safety(F.col("a"), F.col("b")).alias("s")).select("a", "b", "s.safe", "s.note")


def decimal_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = local_frame(spark, [d[:4] for d in DECIMALS], "p1 int, s1 int, p2 int, s2 int")
    kinds = [F.struct(F.lit("decimal").alias("tag"), F.col(p).alias("precision"), F.col(s).alias("scale"), F.lit(None).cast("string").alias("original")) for p, s in (("p1", "s1"), ("p2", "s2"))]
    return given.select("*", compare_types(*kinds).alias("verdict"), are_types_compatible(*kinds).alias("compatible"))


def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of the presets, of a settings file and of a flag that goes before it."""
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "s.toml"
        path.write_text(TOML, encoding="utf-8")
        settings = Settings.load(str(path))
    made = {
        "default": CompareConfig(), "all_features": CompareConfig.all_features(), "minimal": CompareConfig.minimal(), "strict": CompareConfig.strict(), "clamped": CompareConfig().with_similarity_threshold(7.0),
        "conservative": ResolutionConfig.conservative(), "prefer_b": ResolutionConfig.prefer_schema("B"), "again": ResolutionConfig.from_json(ResolutionConfig().to_json()), "flag": settings.resolution_config(0.7),
    }

    def value(preset: str, option: str) -> object:
        if preset == "file":
            if option.startswith("generate"):
                return settings.generates(option)
            return settings.output_dir if option == "output_dir" else getattr(settings.compare_config() if option == "similarity_threshold" else settings.resolution_config(), option)
        found = made[preset]
        if option == "semantic":
            return found.semantic.enabled
        return getattr(found.semantic if option in ("match_threshold", "probable_threshold") else found, option)

    return local_frame(spark, [(p, o, str(value(p, o))) for p, o, _ in PRESETS], "preset string, option string, value string")


def _report(spark: SparkSession, sf_dir: str) -> report.Result:
    return report.Result(_ruled(spark, sf_dir))


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the JSON report and of the outputs beside it, as (part, number)."""
    r = _report(spark, sf_dir)
    j, diff, log = r.json_report(), r.diff(), r.decision_log()
    overview, broken, done = j["executive_summary"]["compatibility_overview"], j["detailed_breakdown"], j["resolution"]["summary"]
    rows = [(k, overview[k]) for k in ("total_matches", "total_exclusives", "total_conflicts", "exclusives_from_a", "exclusives_from_b")]
    rows += [("exact", broken["matches"]["exact_name_matches"]), ("normalized", broken["matches"]["normalized_matches"]), ("safe_from_a", broken["exclusives"]["safe_from_a"]), ("safe_from_b", broken["exclusives"]["safe_from_b"])]
    rows += [(f"type {k}", n) for k, n in broken["conflicts"]["by_type"].items()] + [(f"severity {k}", n) for k, n in broken["conflicts"]["by_severity"].items()]
    rows += [("suggestions", done["total_suggestions"]), ("high", done["high_confidence"]), ("medium", done["medium_confidence"]), ("accepted", done["auto_accepted"])]
    rows += [("diff matches", len(diff["matches"])), ("diff exclusives", len(diff["exclusives"])), ("diff conflicts", len(diff["conflicts"])), ("log", log["metadata"]["total_decisions"]), ("log lines", r.decision_log_markdown().count("### "))]
    return local_frame(spark, [(k, int(n)) for k, n in rows], "part string, number long")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of the Markdown report, its risk and its recommendations."""
    text = _report(spark, sf_dir).markdown().split("\n")
    head = text[text.index("### Compatibility Overview") + 2 : text.index("### Top Conflicts by Entity")]
    last = text[text.index("## Recommendations") + 2 :]
    return local_frame(spark, [(line,) for line in [*head, *last[: last.index("")]] if line], "line string")


def unified_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified schema as it is written and read again: fields by entity and origin."""
    with tempfile.TemporaryDirectory() as folder:
        written = _report(spark, sf_dir).write(folder, lambda what: what == "generate_unified_schema")
        assert [p.name for p in written] == ["unified_schema.json"]
        data = json.loads(written[0].read_text(encoding="utf-8"))
    counts: dict[tuple, int] = {}
    for e in data["entities"]:
        for f in e["fields"]:
            key = (data["schema_name"], e["entity_name"], e["origin"], f["origin"])
            counts[key] = counts.get(key, 0) + 1
    return local_frame(spark, [(*k, n) for k, n in counts.items()], "schema_name string, entity_name string, entity_origin string, field_origin string, n long")


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written decision log, read back."""
    with tempfile.TemporaryDirectory() as folder:
        written = _report(spark, sf_dir).write(folder, lambda what: what == "generate_decision_log")
        read = report.read_decisions(spark, str(written[0]))
    return read.select("decision_id", "suggestion_id", "entity_name", "field_name", "accepted", "source", "status")


def document_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of all events' documents that are new, gone or of another type than a known schema has them."""
    known = local_frame(spark, [("k", ("string", None, None, None)), ("gone", ("int64", None, None, None))], "field_name string, type struct<tag:string,precision:int,scale:int,original:string>")
    return drift(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit('{"extra": 1, '), F.substr("props", F.lit(2))).alias("doc")), "doc", known)


QUERIES = [
    rule_conflicts, rule_suggestions, safe_suggestions, suggestion_levels, rule_decisions, decision_counts, rule_metrics, rule_top_conflicts, unified_entities, rule_unified_fields, match_reasons,
    similarity_matches, semantic_scores, cast_rules, decimal_verdicts, presets, report_json, report_lines, unified_schema, decision_log, document_drift,
]

_RULES = base._A.replace(", p AS (SELECT a.entity", ", p0 AS (SELECT a.entity") + """, ca AS (
  SELECT entity, e, i, field, CASE type WHEN 'Float64' THEN 'Float32' ELSE type END AS type, i % 2 = 1 AS nullable, i % 3 = 0 AS uniq, CASE WHEN type = 'String' THEN 10 * i END AS longest FROM a
), db AS (
  SELECT entity, e, i, CASE WHEN i % 4 = 1 THEN upper(field) ELSE field END AS field, CASE WHEN type = 'Int64' THEN 'Float32' WHEN type = 'Float32' THEN 'Int64' WHEN type = 'String' AND i % 2 = 0 THEN 'Boolean' ELSE type END AS type,
    i % 3 = 0 AS nullable, i % 2 = 0 AS uniq, CASE WHEN type = 'String' THEN CASE WHEN i % 5 = 0 THEN 10 * i ELSE 20 END END AS longest FROM ca WHERE entity <> 'region'
), m AS (
  SELECT x.entity, x.e, x.field, x.i, x.type AS ta, y.type AS tb, x.nullable AS na, y.nullable AS nb, x.uniq AS ua, y.uniq AS ub, x.longest AS la, y.longest AS lb FROM ca x JOIN db y ON x.e = y.e AND x.i = y.i AND x.field = y.field
), k0 AS (
  SELECT e, entity, field, i, 0 AS stage, 0 AS r, 'type_incompatible' AS kind, 'high' AS severity, 'Type: ' || ta AS from_a, 'Type: ' || tb AS from_b, 'Types must be compatible' AS rule, ta, tb FROM m WHERE ta <> tb
  UNION ALL SELECT e, entity, field, i, 0, 1, 'nullability_mismatch', 'medium', 'Nullable: false', 'Nullable: true', 'Nullability must match or be compatible', ta, tb FROM m WHERE NOT na AND nb
  UNION ALL SELECT e, entity, field, i, 0, 2, 'constraint_mismatch', 'medium', 'Unique: ' || ua, 'Unique: ' || ub, 'Constraints must be compatible', ta, tb FROM m WHERE ua <> ub
  UNION ALL SELECT e, entity, field, i, 0, 3, 'constraint_mismatch', 'medium', 'MaxLength: ' || la, 'MaxLength: ' || lb, 'Constraints must be compatible', ta, tb FROM m WHERE la <> lb
  UNION ALL SELECT x.e, x.entity, NULL, x.i, 1, 4, 'normalization_collision', 'critical', 'Field ''' || x.field || ''' normalizes to ''' || x.field || '''', 'Field ''' || y.field || ''' normalizes to ''' || x.field || '''', 'Different fields cannot normalize to the same identifier', x.field, y.field
    FROM ca x JOIN db y ON x.e = y.e AND x.i = y.i AND x.field <> y.field
), k AS (SELECT cast(row_number() OVER (ORDER BY e, stage, i, r) - 1 AS INT) AS n, * FROM k0
), s0 AS (
  SELECT n, entity, field AS name, CASE WHEN ta = 'Int64' AND tb = 'Float32' THEN 'cast_safe' WHEN ta = 'Float32' AND tb = 'Int64' THEN 'cast_risky' ELSE 'no_suggestion' END AS kind, 0 AS o, ta, tb, NULL AS suggested FROM k WHERE r = 0
  UNION ALL SELECT n, entity, field, 'prefer_type', 0, from_a, from_b, NULL FROM k WHERE r = 1
  UNION ALL SELECT n, entity, field, 'constraint', 0, NULL, NULL, NULL FROM k WHERE r IN (2, 3)
  UNION ALL SELECT n, entity, ta, 'rename_field', 0, tb, '_a', ta || '_a' FROM k WHERE r = 4
  UNION ALL SELECT n, entity, tb, 'rename_field', 1, ta, '_b', lower(tb) || '_b' FROM k WHERE r = 4
), s AS (
  SELECT cast(row_number() OVER (ORDER BY n, o) - 1 AS INT) AS no, n, entity, name, CASE kind WHEN 'constraint' THEN 'no_suggestion' ELSE kind END AS kind, CASE WHEN kind = 'cast_risky' THEN 0.75 ELSE 0.9 END AS confidence,
    CASE kind WHEN 'cast_safe' THEN 'low' WHEN 'cast_risky' THEN 'high' WHEN 'prefer_type' THEN 'low' WHEN 'rename_field' THEN 'medium' ELSE 'critical' END AS impact, kind AS inner_kind, ta, tb, suggested,
    CASE kind WHEN 'no_suggestion' THEN 'Type incompatibility between ' || ta || ' and ' || tb || ' cannot be automatically resolved' WHEN 'constraint' THEN 'Constraint conflicts require manual resolution' WHEN 'rename_field' THEN 'Normalization collision' END AS reason
  FROM s0
), x AS (
  SELECT 'A' AS side, entity FROM ca WHERE entity = 'region' AND i = 0 UNION ALL SELECT 'A', entity FROM ca WHERE entity <> 'region' AND i % 4 = 1 UNION ALL SELECT 'B', entity FROM db WHERE i % 4 = 1
), t AS (
  SELECT (SELECT count(*) FROM m) AS fm, (SELECT count(DISTINCT entity) FROM db) AS em, (SELECT count(*) FROM k) AS nk, (SELECT count(*) FROM x) AS nx, (SELECT count(*) FROM x WHERE side = 'A') AS xa, (SELECT count(*) FROM x WHERE side = 'B') AS xb,
    (SELECT count(*) FROM k WHERE severity = 'critical') AS crit, (SELECT count(*) FROM k WHERE severity = 'high') AS high, (SELECT count(*) FROM s WHERE confidence = 0.9) AS acc
), d AS (
  SELECT 'auto_dec_' || row_number() OVER (ORDER BY no) AS decision_id, 'sug_' || no AS suggestion_id, entity AS entity_name, name AS field_name, true AS accepted, 'system' AS source, 'high_confidence_auto_accept' AS rule, 'Automated by rule: high_confidence_auto_accept' AS rationale FROM s WHERE confidence >= 0.9
  UNION ALL SELECT 'user_' || no, 'sug_' || no, entity, name, entity <> 'lineitem', 'user', 'ann', 'looked at' FROM s WHERE kind = 'cast_risky'
)
"""
_STOP = "('', 'tbl', 'table', 'tmp', 'backup', 'bak')"
_TOKENS = "list_filter(string_split(regexp_replace(lower(regexp_replace(trim({0}), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[ ._/-]+', ' ', 'g'), ' '), lambda w: w NOT IN " + _STOP + ")"
_GROUP = "CASE WHEN {0} IN ('id', 'identifier') THEN 1 WHEN {0} IN ('num', 'number', 'no') THEN 2 END"


def _forms_sql() -> str:
    """CTEs nt (name, tokens) and nf (name, sem, morph, grams) over a CTE nm (name)."""
    return (
        f", nt AS (SELECT name, {_TOKENS.format('name')} AS tokens FROM nm), nf AS (SELECT name, array_to_string(tokens, ' ') AS sem, list_transform(tokens, lambda word: {base._singular_sql()}) AS morph FROM nt), "
        "ng AS (SELECT *, list_distinct([sem[g:g+2] FOR g IN range(1, greatest(length(sem) - 2, 1) + 1)]) AS grams FROM nf)"
    )


def _score_sql(pairs: str) -> str:
    """CTEs sc (a, b, six strategies) and sd (those, score) over pairs (a, b) of names."""
    jaccard = "CASE WHEN len(x.{0}) = 0 OR len(y.{0}) = 0 THEN 0 ELSE len(list_intersect(x.{0}, y.{0})) / len(list_distinct(list_concat(x.{0}, y.{0})))::DOUBLE END"
    other = f"len(list_filter(y.morph, lambda v: ({_GROUP.format('v')}) = ({_GROUP.format('u')}) AND u <> v)) > 0"
    return (
        f", sc AS (SELECT p.a, p.b, (x.sem = y.sem)::INT::DOUBLE AS exact, (x.morph = y.morph)::INT::DOUBLE AS plural, (len(list_filter(x.morph, lambda u: {other})) > 0)::INT::DOUBLE AS synonym, {jaccard.format('morph')} AS token, "
        f"CASE WHEN x.sem = '' OR y.sem = '' THEN 0 ELSE jaro_winkler_similarity(x.sem, y.sem) END AS fuzzy, {jaccard.format('grams')} AS ngram FROM {pairs} p JOIN ng x ON x.name = p.a JOIN ng y ON y.name = p.b), "
        "sd AS (SELECT *, (0.6 * exact + 0.55 * plural + 0.7 * synonym + 0.25 * token + 0.15 * fuzzy + 0.1 * ngram) / (0.6 * exact + 0.55 * plural + 0.7 * synonym + 0.5) AS score FROM sc)"
    )


def oracle_sql() -> dict[str, str]:
    from loomline.source_queries import _values

    r = "WITH " + _RULES
    verdicts = {
        "compatible": ["string text", "date_time timestamp"],
        "widening_safe": ["int32 int64", "float32 float64", "date date_time", "date timestamp", "int32 decimal", "int64 decimal"],
        "requires_cast": ["int64 int32", "float64 float32", "date_time date", "timestamp date", "decimal int32", "decimal int64", "float32 decimal", "float64 decimal", "decimal float32", "decimal float64", "int32 float32", "int32 float64", "int64 float64", "float32 int32", "float64 int32", "float64 int64", "boolean int32", "int32 boolean"],
    }
    pairs = [(*p.split(), v) for v, ps in verdicts.items() for p in ps]
    pairs += [(b, a, v) for a, b, v in pairs if v == "compatible"]
    tags = _values([(t,) for t in "boolean int32 int64 float32 float64 decimal string text binary date time date_time timestamp json uuid unknown".split()])
    pct = "100.0 * {0} / (fm + em + nk)"
    names_sql = "WITH " + base._A + ", nm AS (SELECT entity AS name FROM a UNION SELECT field FROM a UNION SELECT field FROM b)" + _forms_sql()
    norm = base._N
    cascade = "CASE WHEN score >= 0.8 THEN '{0}' WHEN a = b THEN 'exact' WHEN " + norm.format("a") + " = " + norm.format("b") + " THEN 'norm' END"
    reason = "CASE how WHEN 'sem' THEN 'semantic' WHEN 'exact' THEN 'exact_name' WHEN 'norm' THEN 'normalized_name' END AS reason, CASE how WHEN 'sem' THEN 'match' END AS decision, round(CASE how WHEN 'sem' THEN score WHEN 'exact' THEN 1.0 ELSE 0.9 END, 6)::DOUBLE AS score"
    matches = (
        names_sql + ", pr AS (SELECT x.entity AS a, y.entity AS b FROM (SELECT DISTINCT entity FROM a) x, (SELECT DISTINCT entity FROM b) y UNION SELECT a.field, b.field FROM a, b)" + _score_sql("pr")
        + f", h AS (SELECT a, b, score, {cascade.format('sem')} AS how FROM sd), em AS (SELECT x.entity, x.e AS ea, y.e AS eb, h.* FROM (SELECT DISTINCT entity, e FROM a) x, (SELECT DISTINCT entity, e FROM b) y, h WHERE h.a = x.entity AND h.b = y.entity AND how IS NOT NULL), "
        "fm AS (SELECT em.entity, a.i AS ia, b.i AS ib, h.* FROM em JOIN a ON a.e = em.ea JOIN b ON b.e = em.eb JOIN h ON h.a = a.field AND h.b = b.field WHERE h.how IS NOT NULL) "
        f"SELECT entity AS entity_name, NULL AS field_name, {reason}, ea AS index_a, eb AS index_b FROM em UNION ALL SELECT entity, CASE how WHEN 'norm' THEN {norm.format('a')} ELSE a END, {reason}, ia, ib FROM fm"
    )
    words = "WITH " + base._A + ", fn AS (SELECT DISTINCT field AS a FROM a), fb AS (SELECT DISTINCT split_part(a, '_', -1) || 'Identifiers' AS b FROM fn UNION SELECT 'x_' || a || '_no' FROM fn), nm AS (SELECT a AS name FROM fn UNION SELECT b FROM fb)" + _forms_sql()
    words += ", pr AS (SELECT a, b FROM fn, fb, ng x, ng y WHERE x.name = a AND y.name = b AND len(list_intersect(x.morph, y.morph)) > 0)" + _score_sql("pr")
    six = ", ".join(f"round({k}, 6)::DOUBLE AS {k}" for k in names.STRATEGIES)
    said = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {k} > 0 THEN '{k}' END" for k in names.STRATEGIES) + "], lambda v: v IS NOT NULL), ',')"
    sim = "jaro_winkler_similarity({0}, {1})"
    similar = (
        r + f", es AS (SELECT x.e AS ea, y.e AS eb, x.entity, {sim.format('x.entity', 'y.entity')} AS s FROM (SELECT DISTINCT e, entity FROM ca) x, (SELECT DISTINCT e, entity FROM db) y WHERE x.entity = y.entity OR {sim.format('x.entity', 'y.entity')} >= 0.7), "
        f"fs AS (SELECT ea, eb, es.entity, x.field, x.i AS ia, y.i AS ib, {sim.format('x.field', 'y.field')} AS s, x.field = y.field AS same FROM es JOIN ca x ON x.e = ea JOIN db y ON y.e = eb WHERE x.field = y.field OR {sim.format('x.field', 'y.field')} >= 0.7), "
        "rk AS (SELECT *, row_number() OVER (PARTITION BY ea, eb, ia ORDER BY s DESC, ib) = 1 AND row_number() OVER (PARTITION BY ea, eb, ib ORDER BY s DESC, ia) = 1 AS best FROM fs) "
        "SELECT ea AS entity_a, eb AS entity_b, entity AS entity_name, NULL AS field_name, CASE WHEN s = 1 THEN 'exact_name' ELSE 'similarity' END AS reason, round(s, 6)::DOUBLE AS score, ea AS index_a, eb AS index_b, NULL::BOOLEAN AS best FROM es "
        "UNION ALL SELECT ea, eb, entity, field, CASE WHEN same THEN 'exact_name' ELSE 'similarity' END, round(s, 6)::DOUBLE, ia, ib, best FROM rk"
    )
    none = "'No automatic suggestion available - manual resolution required'"
    explained = f"CASE inner_kind WHEN 'cast_safe' THEN 'Safe widening cast from ' || ta || ' to ' || tb || ' - no data loss expected' WHEN 'cast_risky' THEN 'Narrowing or lossy cast from ' || ta || ' to ' || tb || ' - Loss of decimal precision' WHEN 'prefer_type' THEN 'Use NULLABLE to accommodate both schemas' WHEN 'rename_field' THEN 'Add suffix ''' || tb || ''' to distinguish from conflicting field ''' || ta || '''' ELSE {none} END"
    evidence = "CASE inner_kind WHEN 'cast_safe' THEN 'Source type: ' || ta || '|Target type: ' || tb || '|No data loss expected|Note: Possible precision loss for very large integers' WHEN 'cast_risky' THEN 'Source type: ' || ta || '|Target type: ' || tb || '|Warning: Loss of decimal precision' WHEN 'prefer_type' THEN ta || '|' || tb WHEN 'rename_field' THEN 'Original name: ' || name || '|Suggested name: ' || suggested || '|Reason: ' || reason ELSE 'Reason: ' || reason END"
    return {
        "compare_matches": matches,
        "type_compatibility_matrix": f"WITH v AS (SELECT * FROM (VALUES {_values(pairs)}) t(a, b, v)) SELECT x.t AS from_type, y.t AS to_type, CASE WHEN x.t = y.t THEN 'identical' ELSE coalesce(v.v, 'incompatible') END AS verdict, x.t <> 'unknown' AND (x.t = y.t OR coalesce(v.v = 'compatible', false) OR x.t || y.t IN ('int32int64', 'float32float64')) AS strict FROM (VALUES {tags}) x(t) CROSS JOIN (VALUES {tags}) y(t) LEFT JOIN v ON v.a = x.t AND v.b = y.t",
        "rule_conflicts": r + "SELECT n AS conflict_no, entity AS entity_name, field AS field_name, kind AS conflict_type, severity, from_a, from_b, rule, i AS index_a, i AS index_b FROM k",
        "rule_suggestions": r + f"SELECT 'sug_' || no AS id, n AS conflict_no, entity AS entity_name, name AS field_name, kind, confidence::DOUBLE AS confidence, impact, {explained} AS explanation, {evidence} AS evidence, CASE WHEN kind LIKE 'cast%' THEN ta END AS from_type, CASE WHEN kind LIKE 'cast%' THEN tb END AS to_type, CASE WHEN kind = 'cast_risky' THEN 'Loss of decimal precision' END AS warning, CASE WHEN kind = 'rename_field' THEN name END AS original_name, suggested AS suggested_name, reason, CASE WHEN kind = 'prefer_type' THEN 'NULLABLE' END AS preferred_type FROM s",
        "safe_suggestions": r + "SELECT CASE kind WHEN 'cast_risky' THEN 'no_suggestion' ELSE kind END AS kind, 'High' AS level, count(*) AS n FROM s GROUP BY 1",
        "suggestion_levels": r + "SELECT kind, CASE WHEN confidence >= 0.85 THEN 'High' WHEN confidence >= 0.6 THEN 'Medium' ELSE 'Low' END AS level, count(*) AS n FROM s GROUP BY 1, 2",
        "rule_decisions": r + "SELECT *, CASE WHEN decision_id = 'auto_dec_1' THEN 'applied' ELSE 'pending' END AS status FROM d WHERE entity_name = 'lineitem' UNION ALL SELECT *, 'pending' FROM d WHERE entity_name = 'orders' AND NOT accepted",
        "decision_counts": r + "SELECT count(*) AS total, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected, count(*) FILTER (source = 'system') AS system_decisions, count(*) FILTER (source = 'user') AS user_decisions, greatest(0, (SELECT nk FROM t) - count(*) FILTER (accepted))::BIGINT AS unresolved FROM d",
        "rule_metrics": r + f"SELECT fm + em AS total_matches, nx AS total_exclusives, nk AS total_conflicts, xa AS exclusives_a, xb AS exclusives_b, 1.0::DOUBLE AS average_match_confidence, crit AS critical_conflicts, high AS high_severity_conflicts, round({pct.format('(fm + em)')}, 6)::DOUBLE AS compatibility_score, round({pct.format('nk')}, 6)::DOUBLE AS conflict_rate, 100.0::DOUBLE AS safe_addition_rate, CASE WHEN crit >= 3 THEN 'Critical' WHEN crit >= 1 THEN 'High' WHEN {pct.format('nk')} > 50 THEN 'Critical' ELSE 'High' END AS risk_level FROM t",
        "rule_top_conflicts": r + "SELECT entity AS entity_name, count(*) AS n_conflicts, CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'high') THEN 'high' ELSE 'medium' END AS highest_severity FROM k GROUP BY entity ORDER BY 2 DESC, 1 LIMIT 5",
        "unified_entities": r + "SELECT DISTINCT entity AS entity_name, 'table' AS entity_type, CASE WHEN entity = 'region' THEN 'A' ELSE 'BOTH' END AS origin, e AS entity_a, CASE WHEN entity <> 'region' THEN e END AS entity_b FROM ca",
        "rule_unified_fields": r + "SELECT field AS field_name, ta AS type_name, na AS nullable, 'BOTH' AS origin, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.e = m.e AND k.i = m.i AND k.stage = 0) THEN 'conflicted' ELSE 'matched' END AS state, i AS index_a, i AS index_b FROM m UNION ALL SELECT field, type, nullable, 'A', 'exclusive', i, NULL FROM ca WHERE entity = 'region' OR i % 4 = 1 UNION ALL SELECT field, type, nullable, 'B', 'exclusive', NULL, i FROM db WHERE i % 4 = 1",
        "match_reasons": "WITH " + base._CMP + ", am2 AS (SELECT reason, score FROM m UNION ALL SELECT 'exact_name', 1.0 FROM (SELECT DISTINCT entity FROM b)) SELECT reason, count(*) AS n, round(avg(score), 6)::DOUBLE AS average_score FROM am2 GROUP BY reason",
        "similarity_matches": similar,
        "semantic_scores": words + f" SELECT a, b, {six}, round(score, 6)::DOUBLE AS score, CASE WHEN score >= 0.8 THEN 'match' WHEN score >= 0.55 THEN 'probable_match' ELSE 'no_match' END AS decision, {said} AS said FROM sd",
        "cast_rules": f"SELECT a, b, safe::BOOLEAN AS safe, note FROM (VALUES {_values([(a, b, None if s is None else str(s), n) for a, b, s, n in CASTS])}) t(a, b, safe, note)",
        "decimal_verdicts": f"SELECT *, true AS compatible FROM (VALUES {_values(DECIMALS)}) t(p1, s1, p2, s2, verdict)",
        "presets": f"SELECT * FROM (VALUES {_values(PRESETS)}) t(preset, option, value)",
        "report_json": r + "SELECT part, number::BIGINT AS number FROM (SELECT unnest(['total_matches', 'total_exclusives', 'total_conflicts', 'exclusives_from_a', 'exclusives_from_b', 'exact', 'normalized', 'safe_from_a', 'safe_from_b', 'suggestions', 'high', 'medium', 'accepted', 'diff matches', 'diff exclusives', 'diff conflicts', 'log', 'log lines']) AS part, unnest([fm + em, nx, nk, xa, xb, fm + em, 0, xa, xb, (SELECT count(*) FROM s), acc, (SELECT count(*) FROM s) - acc, acc, fm + em, nx, nk, acc, acc]) AS number FROM t) "
        "UNION ALL SELECT 'type ' || CASE kind WHEN 'type_incompatible' THEN 'TypeIncompatible' WHEN 'nullability_mismatch' THEN 'NullabilityMismatch' WHEN 'constraint_mismatch' THEN 'ConstraintMismatch' ELSE 'NormalizationCollision' END, count(*) FROM k GROUP BY kind UNION ALL SELECT 'severity ' || upper(severity[1]) || severity[2:], count(*) FROM k GROUP BY severity",
        "report_lines": r + f"SELECT unnest(['- **Matches**: ' || (fm + em), '- **Exclusives**: ' || nx || ' (' || xa || ' from A, ' || xb || ' from B)', '- **Conflicts**: ' || nk, '- **Compatibility Score**: ' || printf('%.1f', {pct.format('(fm + em)')}) || '%', '- **Safe Addition Rate**: 100.0%', '- **Conflict Rate**: ' || printf('%.1f', {pct.format('nk')}) || '%', '### Risk Assessment', '**Overall Risk Level**: 💀 **Critical**', "
        f"'- ' || crit || ' critical-severity conflict(s) detected', '- ' || high || ' high-severity conflict(s) detected', '- Conflict rate is ' || printf('%.1f', {pct.format('nk')}) || '% (above 25% threshold)', '- 💀 **CRITICAL**: Immediate manual review required before proceeding', '- 💀 Review ' || crit || ' critical-severity conflict(s) immediately', '- 🔥 Address ' || high || ' high-severity conflict(s) before auto-unification', "
        "'- ⚠️ Low compatibility score - consider manual schema alignment', '- 📄 See `decision_log.json` for complete decision history and programmatic access']) AS line FROM t UNION ALL SELECT '- 🔍 ' || (nk - acc) || ' conflict(s) remain without accepted resolutions' FROM t WHERE nk > acc",
        "unified_schema": r + ", u AS (SELECT entity, 'BOTH' AS o, 'BOTH' AS f FROM m UNION ALL SELECT entity, CASE WHEN entity = 'region' THEN 'A' ELSE 'BOTH' END, 'A' FROM ca WHERE entity = 'region' OR i % 4 = 1 UNION ALL SELECT entity, 'BOTH', 'B' FROM db WHERE i % 4 = 1) SELECT 'c_d_unified' AS schema_name, entity AS entity_name, o AS entity_origin, f AS field_origin, count(*) AS n FROM u GROUP BY 2, 3, 4",
        "decision_log": r + "SELECT decision_id, suggestion_id, entity_name, field_name, accepted, source, 'pending' AS status FROM d WHERE source = 'system'",
        "document_drift": "WITH f AS (SELECT DISTINCT unnest(json_keys(props)) AS f FROM events), u AS (SELECT f FROM f UNION SELECT 'extra') SELECT f AS field_name, CASE WHEN f = 'k' THEN 'retyped' ELSE 'added' END AS change FROM u UNION ALL SELECT 'gone', 'missing'",
    }
