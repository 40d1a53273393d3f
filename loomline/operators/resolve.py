"""Suggestions for conflicts, decisions on them, and the metrics of a comparison."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.types import type_name
from loomline.plans.config import ResolutionConfig

#: Cast rules in order; (part of from, whole from, part of to, whole to, safe, note).
CASTS = (
    ("int8 tinyint", "", "int16 int32 int64 bigint", "", True, ""),
    ("int16 smallint", "", "int32 int64 bigint", "", True, ""),
    ("int32", "int", "int64 bigint", "", True, ""),
    ("int integer", "", "float double decimal", "", True, "Possible precision loss for very large integers"),
    ("int64 bigint", "", "int32 int16 int8", "int", False, "Potential overflow if values exceed target range"),
    ("int32", "int", "int16 int8", "", False, "Potential overflow if values exceed target range"),
    ("float double decimal", "", "int", "", False, "Loss of decimal precision"),
    ("varchar", "", "text", "", True, ""),
    ("text", "", "varchar", "", False, "Potential truncation of long text"),
)
#: Confidences, and the least value of each level that reports name.
CONFIDENCE = {"high": 0.9, "medium": 0.75, "low": 0.4}
LEVELS = (("High", 0.85), ("Medium", 0.6), ("Low", 0.0))
#: Kinds of suggestions; the last two are part of the model and no rule makes them.
KINDS = ("cast_safe", "cast_risky", "rename_field", "prefer_type", "no_suggestion", "split_field", "merge_fields")
NO_WAY = "No automatic suggestion available - manual resolution required"
ORDER = ["stage", "entity_a", "entity_b", "index_a", "index_b", "rule_no"]


def numbered(df: DataFrame, column: str, *order) -> DataFrame:
    """Numbers from 0 in a given order; for relations whose size is that of a schema, not of data."""
    return df.withColumn(column, (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))


def conflict_order(conflicts: DataFrame) -> DataFrame:
    """``conflicts`` with ``conflict_no`` from 0: by pair of entities, collisions of a pair last."""
    return numbered(conflicts, "conflict_no", "entity_a", "entity_b", "stage", "index_a", "index_b", "rule_no")


def _any(text: Column, parts: str, whole: str = "") -> Column:
    test = text.isin(*whole.split()) if whole else F.lit(False)
    for p in parts.split():
        test = test | F.contains(text, F.lit(p))
    return test


def cast_safety(source: Column, target: Column) -> Column:
    """struct(safe, note), or null, by the first rule that fits the lower-cased type names."""
    source, target = F.lower(source), F.lower(target)
    case = F.when(F.lit(False), F.lit(None).cast("struct<safe:boolean,note:string>"))
    for a, a_whole, b, b_whole, safe, note in CASTS:
        case = case.when(_any(source, a, a_whole) & _any(target, b, b_whole), F.struct(F.lit(safe).alias("safe"), F.lit(note).alias("note")))
    return case


def clamped(confidence: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence.cast("double")))


def confidence_level(confidence: Column) -> Column:
    """High, Medium or Low."""
    case = F.when(F.lit(False), "")
    for name, least in LEVELS:
        case = case.when(confidence >= least, name)
    return case


def _suggestion(kind: str, confidence: float, impact: str, explanation: Column, evidence: Column, **args: Column) -> Column:
    names = ("from_type", "to_type", "warning", "original_name", "suggested_name", "reason", "preferred_type")
    given = F.struct(*[args.get(n, F.lit(None).cast("string")).alias(n) for n in names])
    return F.struct(F.lit(kind).alias("kind"), given.alias("args"), F.lit(confidence).alias("confidence"), F.lit(impact).alias("impact"), explanation.alias("explanation"), evidence.alias("evidence"))


def _nothing(reason: Column) -> Column:
    return _suggestion("no_suggestion", 0.9, "critical", F.lit(NO_WAY), F.array(F.concat(F.lit("Reason: "), reason)), reason=reason)


def collision_name(said: Column) -> Column:
    """The name in a collision's evidence, quotes of its own included."""
    return F.regexp_extract(said, "Field '(.*)' normalizes to '", 1)


@lru_cache(maxsize=16)
def _options(context: str, config: ResolutionConfig) -> tuple[Column, Column]:
    """(what the cast rules say, the suggestions for a conflict); built once per context, as that takes many calls to the JVM."""
    a, b = type_name(F.col("type_a")), type_name(F.col("type_b"))
    safety, note = F.col("safety.safe"), F.col("safety.note")
    types = F.array(F.concat(F.lit("Source type: "), a), F.concat(F.lit("Target type: "), b))
    promise = F.concat(types, F.array(F.lit("No data loss expected")), F.when(note != "", F.array(F.concat(F.lit("Note: "), note))).otherwise(F.array().cast("array<string>")))
    safe = _suggestion("cast_safe", 0.9, "low", F.concat(F.lit("Safe widening cast from "), a, F.lit(" to "), b, F.lit(" - no data loss expected")), promise, from_type=a, to_type=b)
    risky = _suggestion("cast_risky", 0.75, "high", F.concat(F.lit("Narrowing or lossy cast from "), a, F.lit(" to "), b, F.lit(" - "), note), F.concat(types, F.array(F.concat(F.lit("Warning: "), note))), from_type=a, to_type=b, warning=note)
    unfit = _nothing(F.concat(F.lit("Type incompatibility between "), a, F.lit(" and "), b, F.lit(" cannot be automatically resolved")))
    cast = F.when(safety, safe).when(~safety & F.lit(config.allow_risky_suggestions), risky).otherwise(unfit)

    named = [collision_name(F.col(c)) for c in ("from_a", "from_b")]

    def rename(name: Column, suffix: str, why: str, explanation: Column) -> Column:
        new = F.concat(F.lower(name), F.lit(suffix))
        said = F.array(F.concat(F.lit("Original name: "), name), F.concat(F.lit("Suggested name: "), new), F.lit(f"Reason: {why}"))
        return _suggestion("rename_field", 0.9, "medium", explanation, said, original_name=name, suggested_name=new, reason=F.lit(why))

    told = lambda suffix, other: F.concat(F.lit(f"Add suffix '{suffix}' to distinguish from conflicting field '"), other, F.lit("'"))
    both = [rename(named[i], suffix, "Normalization collision", told(suffix, named[1 - i])) for i, suffix in enumerate(("_a", "_b"))]
    third = rename(named[0], "_src_a", "Preserve original distinction", F.lit("Keep normalized name but add source suffix to preserve distinction"))
    renames = F.filter(F.array(*both, F.when(named[0] != F.lower(named[0]), third)), lambda x: x.isNotNull())
    flags = [F.contains(F.lower(c), F.lit("true")) for c in ("from_a", "from_b")]
    nullable = F.when(flags[0] != flags[1], _suggestion("prefer_type", 0.9, "low", F.lit("Use NULLABLE to accommodate both schemas"), F.array("from_a", "from_b"), preferred_type=F.lit("NULLABLE"))).otherwise(_nothing(F.lit("Nullability mismatch cannot be automatically resolved")))
    length = _suggestion("prefer_type", 0.75, "medium", F.lit("Use the larger length or precision"), F.array("from_a", "from_b"), preferred_type=F.lit("Larger length/precision"))
    kind = F.col("conflict_type")
    options = (
        F.when(kind == "type_incompatible", F.array(cast))
        .when(kind == "normalization_collision", renames)
        .when(kind == "nullability_mismatch", F.array(nullable))
        .when(kind == "length_mismatch", F.array(length))
        .otherwise(F.array(_nothing(F.lit("Constraint conflicts require manual resolution"))))
    )
    return cast_safety(a, b), options


def suggest(conflicts: DataFrame, config: ResolutionConfig = ResolutionConfig()) -> DataFrame:
    """One row per suggestion: id, conflict_no, entity_name, field_name, kind, args, confidence, impact, explanation, evidence."""
    safety, options = _options(conflicts.sparkSession.sparkContext.applicationId, config)
    rows = conflict_order(conflicts).select("*", safety.alias("safety")).select("conflict_no", "entity_name", "field_name", F.posexplode(options).alias("option_no", "s"))
    rows = numbered(rows, "no", "conflict_no", "option_no")
    field = F.coalesce("field_name", "s.args.original_name")
    return rows.select("no", F.concat(F.lit("sug_"), F.col("no")).alias("id"), "conflict_no", "entity_name", field.alias("field_name"), "s.*")


def auto_decide(suggestions: DataFrame, config: ResolutionConfig = ResolutionConfig()) -> DataFrame:
    """Accept what reaches the threshold; ids count the accepted ones from 1."""
    kept = suggestions.where(F.col("confidence") >= config.confidence_threshold)
    if not config.resolve_unresolvable:
        kept = kept.where("kind <> 'no_suggestion'")
    rule = "high_confidence_auto_accept"
    return numbered(kept, "decision_no", "no").select(
        F.concat(F.lit(config.decision_id_prefix + "_"), F.col("decision_no") + 1).alias("decision_id"), F.col("id").alias("suggestion_id"), "entity_name", "field_name",
        F.lit(True).alias("accepted"), F.lit("system").alias("source"), F.lit(rule).alias("rule"), F.lit(f"Automated by rule: {rule}").alias("rationale"), F.lit("pending").alias("status"),
    )


def decide(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions of users: ``decisions`` has suggestion_id, decision_id, accepted, rationale, username."""
    return suggestions.select(F.col("id").alias("suggestion_id"), "entity_name", "field_name").join(decisions, "suggestion_id").select(
        "decision_id", "suggestion_id", "entity_name", "field_name", "accepted", F.lit("user").alias("source"), F.col("username").alias("rule"), "rationale", F.lit("pending").alias("status"),
    )


def decisions_for(decisions: DataFrame, entity_name: str | None = None, accepted: bool | None = None) -> DataFrame:
    """The decisions on an entity, or the accepted or rejected ones, or both together."""
    if entity_name is not None:
        decisions = decisions.where(F.col("entity_name") == entity_name)
    return decisions if accepted is None else decisions.where(F.col("accepted") == accepted)


def mark(decisions: DataFrame, ids: list[str], status: str) -> DataFrame:
    """Set the status (applied, rejected or superseded) of some decisions."""
    return decisions.withColumn("status", F.when(F.col("decision_id").isin(ids), status).otherwise(F.col("status")))


def decision_summary(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count("*").alias("total"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"),
        F.count_if(F.col("source") == "system").alias("system_decisions"), F.count_if(F.col("source") == "user").alias("user_decisions"),
    )


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), severity)


def top_conflicts(conflicts: DataFrame, n: int = 5, by_severity: bool = True) -> DataFrame:
    """The n entities with most conflicts, by count, then by the highest severity (or by name alone)."""
    grouped = conflicts.groupBy("entity_name").agg(F.count("*").alias("n_conflicts"), F.max(F.struct(severity_rank(F.col("severity")).alias("rank"), "severity")).alias("top"))
    ordered = grouped.orderBy(F.desc("n_conflicts"), *([F.desc("top.rank")] if by_severity else []), "entity_name").limit(n)
    return ordered.select("entity_name", "n_conflicts", F.col("top.severity").alias("highest_severity"))


def conflicts_by_type_severity(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("conflict_type", "severity").agg(F.count("*").alias("n"))


def match_reasons(matches: DataFrame) -> DataFrame:
    return matches.groupBy("reason").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("average_score"))


def suggestion_levels(suggestions: DataFrame) -> DataFrame:
    return suggestions.groupBy("kind", confidence_level(F.col("confidence")).alias("level")).agg(F.count("*").alias("n"))


def unresolved(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: conflicts beyond the number of accepted decisions."""
    rows = conflicts.select(F.lit(1).alias("c"), F.lit(0).alias("d")).unionByName(decisions.where("accepted").select(F.lit(0).alias("c"), F.lit(1).alias("d")))
    return rows.agg(F.greatest(F.lit(0).cast("long"), F.coalesce(F.sum("c") - F.sum("d"), F.lit(0).cast("long"))).alias("unresolved"))


def summary(matches: DataFrame, conflicts: DataFrame, exclusives: DataFrame) -> DataFrame:
    """One row: matches, exclusives, conflicts, exclusives_a, exclusives_b."""
    rows = (
        matches.select(F.lit("m").alias("k"), F.lit(None).cast("string").alias("side"))
        .unionByName(conflicts.select(F.lit("c").alias("k"), F.lit(None).cast("string").alias("side")))
        .unionByName(exclusives.select(F.lit("e").alias("k"), "side"))
    )
    is_ = lambda k: F.col("k") == k
    return rows.agg(
        F.count_if(is_("m")).alias("total_matches"), F.count_if(is_("e")).alias("total_exclusives"), F.count_if(is_("c")).alias("total_conflicts"),
        F.count_if(is_("e") & (F.col("side") == "A")).alias("exclusives_a"), F.count_if(is_("e") & (F.col("side") == "B")).alias("exclusives_b"),
    )


def metrics(matches: DataFrame, conflicts: DataFrame, exclusives: DataFrame) -> DataFrame:
    """One row with the measures of a report and the level of risk."""
    none_s, none_d, none_b = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("boolean")
    rows = (
        matches.select(F.lit("m").alias("k"), "score", none_s.alias("side"), none_s.alias("severity"), none_b.alias("safe_to_add"))
        .unionByName(conflicts.select(F.lit("c").alias("k"), none_d.alias("score"), none_s.alias("side"), "severity", none_b.alias("safe_to_add")))
        .unionByName(exclusives.select(F.lit("e").alias("k"), none_d.alias("score"), "side", none_s.alias("severity"), "safe_to_add"))
    )
    count = lambda c: F.count_if(c)
    kind = lambda k: F.col("k") == k
    counted = rows.agg(
        count(kind("m")).alias("total_matches"), count(kind("e")).alias("total_exclusives"), count(kind("c")).alias("total_conflicts"),
        count(kind("e") & (F.col("side") == "A")).alias("exclusives_a"), count(kind("e") & (F.col("side") == "B")).alias("exclusives_b"),
        count(kind("e") & F.col("safe_to_add")).alias("safe"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_match_confidence"),
        count(F.col("severity") == "critical").alias("critical_conflicts"), count(F.col("severity") == "high").alias("high_severity_conflicts"),
    )
    m, c, e = F.col("total_matches"), F.col("total_conflicts"), F.col("total_exclusives")
    share = lambda part, whole, empty: F.when(whole == 0, F.lit(empty)).otherwise(100.0 * part / whole)
    rated = counted.select(
        "*", share(m, m + c, 100.0).alias("compatibility_score"), share(c, m + c, 0.0).alias("conflict_rate"), share(F.col("safe"), e, 100.0).alias("safe_addition_rate"),
    ).drop("safe")
    crit, high, rate = F.col("critical_conflicts"), F.col("high_severity_conflicts"), F.col("conflict_rate")
    risk = F.when(crit >= 3, "Critical").when(crit >= 1, "High").when(rate > 50, "Critical").when((rate > 25) | (high >= 1), "High").when(rate > 10, "Medium").otherwise("Low")
    return rated.withColumn("risk_level", risk)
