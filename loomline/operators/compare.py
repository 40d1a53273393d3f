"""Matching, exclusives, conflicts and unification of two schemas, as lazy DataFrames.

Every row carries the indices of its entities and fields, so the order of a result is a
sort over them, and pairs of entities never mix.
"""

from __future__ import annotations

import uuid
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import names
from loomline.functions.types import compare_types, type_name
from loomline.ir import CONSTRAINT, Frames
from loomline.plans.config import CompareConfig, SemanticConfig

PAIR = ["entity_a", "entity_b"]
#: Rows up to which a relation of a comparison is held as a local one.
LOCAL_ROWS = 20_000
#: Candidate pairs up to which names are scored without a job.
LOCAL_PAIRS = 20_000


def _context() -> str:
    return SparkContext._active_spark_context.applicationId


# Building an expression costs thousands of calls to the JVM, and Columns never change: each
# is built once per context and settings.


@lru_cache(maxsize=64)
def _forms(context: str, name: str, sem: SemanticConfig) -> tuple[Column, Column, Column]:
    tokens = names.semantic_tokens(F.col(name), sem) if sem.enabled else F.array().cast("array<string>")
    n = F.struct(
        F.col(name).alias("raw"), names.normalize_identifier(F.col(name)).alias("norm"), F.array_join("_tokens", " ").alias("sem"),
        F.col("_morph").alias("morph"), names.synonym_groups(F.col("_morph"), sem).alias("groups"),
    )
    return tokens, names.morph_tokens(F.col("_tokens"), sem), n


@lru_cache(maxsize=64)
def _score(context: str, sem: SemanticConfig) -> Column:
    return names.semantic_score(F.col("n_a"), F.col("n_b"), sem)


def prepared(df: DataFrame, name: str, config: CompareConfig) -> DataFrame:
    """``df`` with ``n``: the normal forms of a name, each made once per name, before any pairing."""
    tokens, morph, n = _forms(_context(), name, config.semantic)
    return df.select("*", tokens.alias("_tokens")).select("*", morph.alias("_morph")).select(*df.columns, n.alias("n"))


@lru_cache(maxsize=64)
def _keys(context: str, name: str, config: CompareConfig) -> Column:
    """The keys of which a matching pair shares one.

    Raw and normal name; for semantic matches tokens and synonym groups, or, where these do
    not bound the score, letters, as without a common one all measured evidence is 0; for
    similar names their letters likewise.
    """
    n, none = F.col(name), F.array().cast("array<string>")
    parts = [F.array(F.concat(F.lit("r:"), n["raw"]), F.concat(F.lit("n:"), n["norm"]))]
    marked = lambda mark, values: F.transform(values, lambda v: F.concat(F.lit(mark), v))
    letters = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    everything = config.similarity_matching and config.similarity_threshold <= 0
    if config.semantic.enabled:
        parts.append(F.when(F.size(n["morph"]) == 0, F.array(F.lit("e"))).otherwise(none))
        if config.semantic.fewest_shared_tokens() > 0:
            parts.append(marked("t:", n["morph"]))
            parts.append(marked("s:", F.transform(n["groups"], lambda g: F.split_part(g, F.lit(":"), F.lit(1)))))
        else:
            parts.append(marked("m:", letters(n["sem"])))
        least = config.semantic.probable_threshold if config.semantic.allow_probable_as_match else config.semantic.match_threshold
        everything = everything or least <= 0
    if config.similarity_matching:
        parts.append(marked("c:", letters(n["raw"])))
    if everything:  # settings under which each pair matches
        parts.append(F.array(F.lit("*")))
    return F.array_distinct(F.concat(*parts))


def candidates(a: DataFrame, b: DataFrame, scope: list[str], config: CompareConfig) -> DataFrame:
    """Pairs of rows of ``a`` (columns ending in _a) and ``b`` that may match, each once.

    An equi-join on the keys of both names.  A pair may share several keys and is taken under
    the smallest of them, so nothing has to be made distinct.
    """
    first = F.array_min(F.array_intersect("_ks_a", "_ks_b")) == F.col("_k")
    sides = []
    for df, side in ((a, "a"), (b, "b")):
        keyed = df.select("*", _keys(_context(), f"n_{side}", config).alias(f"_ks_{side}"))
        sides.append(keyed.select("*", F.explode(f"_ks_{side}").alias("_k")))
    return sides[0].join(sides[1], [*scope, "_k"]).where(first).drop("_k", "_ks_a", "_ks_b")


@lru_cache(maxsize=64)
def _reasons(context: str, config: CompareConfig) -> Column:
    """struct(reason, score, decision): the first test that holds, null if none does."""
    a, b = F.col("n_a"), F.col("n_b")
    none = F.lit(None).cast("string")

    def found(kind: str, score: Column, decision: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("reason"), score.cast("double").alias("score"), decision.alias("decision"))

    tests = []
    if config.semantic.enabled:
        accepted = ["match", "probable_match"] if config.semantic.allow_probable_as_match else ["match"]
        s = F.col("sem_score")
        tests.append(F.when(s["decision"].isin(accepted), found("semantic", s["score"], s["decision"])))
    if config.exact_matching:
        tests.append(F.when(a["raw"] == b["raw"], found("exact_name", F.lit(1.0))))
    if config.normalized_matching:
        tests.append(F.when(a["norm"] == b["norm"], found("normalized_name", F.lit(0.9))))
    if config.similarity_matching:
        near = names.jaro_winkler_similarity(a["raw"], b["raw"])
        tests.append(F.when(near >= config.similarity_threshold, found("similarity", near)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("struct<reason:string,score:double,decision:string>")


def _matched(pairs: DataFrame, config: CompareConfig) -> DataFrame:
    if config.semantic.enabled:
        pairs = pairs.select("*", _score(_context(), config.semantic).alias("sem_score"))
    found = pairs.select("*", _reasons(_context(), config).alias("m")).where("m is not null")
    shown = F.when(F.col("m.reason") == "normalized_name", F.col("n_a.norm")).otherwise(F.col("n_a.raw"))
    return found.select("*", shown.alias("name"), "m.reason", "m.score", "m.decision")


def _side(df: DataFrame, side: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else f"{c}_{side}") for c in df.columns])


def local_candidates(a: DataFrame, b: DataFrame, named: DataFrame | None, config: CompareConfig) -> DataFrame | None:
    """``candidates`` of two local relations as a local relation, or None if there are too many.

    The same join on the same keys, by pandas: the planner computes a projection of a local
    relation while it plans, so small schemas are matched without a job.
    """
    tables, keyed = [], []
    for df, side in ((a, "a"), (b, "b")):
        table = df.select("*", _keys(_context(), f"n_{side}", config).alias("_ks")).toArrow()
        keys = table.column("_ks").combine_chunks()
        rows = pd.DataFrame({side: np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy(zero_copy_only=False)), "k": keys.flatten().to_numpy(zero_copy_only=False)})
        if named is not None:
            rows[f"entity_{side}"] = table.column(f"entity_{side}").to_numpy()[rows[side]]
        tables.append(table.drop_columns(["_ks", *([] if named is None else [f"entity_{side}"])]))
        keyed.append(rows)
    scope = None if named is None else named.toArrow()
    if scope is None:
        pairs = keyed[0].merge(keyed[1], on="k")
    else:
        place = pd.DataFrame({"p": np.arange(scope.num_rows), "entity_a": scope.column("entity_a").to_numpy(), "entity_b": scope.column("entity_b").to_numpy()})
        pairs = place.merge(keyed[0], on="entity_a").merge(keyed[1], on=["entity_b", "k"])
    which = ["a", "b"] if scope is None else ["p", "a", "b"]
    pairs = pairs[which].drop_duplicates()
    if len(pairs) > LOCAL_PAIRS:
        return None
    parts = [t.take(pa.array(pairs[w].to_numpy())) for w, t in zip(which, tables if scope is None else [scope, *tables], strict=True)]
    names = [n for t in parts for n in t.column_names]
    return a.sparkSession.createDataFrame(pa.Table.from_arrays([c for t in parts for c in t.columns], names=names))


def match_entities(a: Frames, b: Frames, config: CompareConfig, local: bool = False) -> DataFrame:
    """entity_a, entity_b, entity_name, reason, decision, score; many to many.  ``local``: both are local relations."""
    left = _side(prepared(a.entities, "entity_name", config), "a")
    right = _side(prepared(b.entities, "entity_name", config), "b")
    pairs = local_candidates(left, right, None, config) if local else None
    found = _matched(candidates(left, right, [], config) if pairs is None else pairs, config)
    return found.select(F.col("entity_idx_a").alias("entity_a"), F.col("entity_idx_b").alias("entity_b"), F.col("name").alias("entity_name"), "reason", "decision", "score")


def match_fields(pairs: DataFrame, a: Frames, b: Frames, config: CompareConfig, local: bool = False) -> DataFrame:
    """Matches of fields within each matched pair of entities, with the types and flags of both."""
    left = _side(prepared(a.fields, "field_name", config).drop("entity_name"), "a").withColumnRenamed("entity_idx_a", "entity_a")
    right = _side(prepared(b.fields, "field_name", config).drop("entity_name"), "b").withColumnRenamed("entity_idx_b", "entity_b")
    named = pairs.select(*PAIR, "entity_name")
    compared = local_candidates(left, right, named, config) if local else None
    if compared is None:
        compared = candidates(named.join(left, "entity_a"), named.select(*PAIR).join(right, "entity_b"), PAIR, config)
    return _matched(compared, config).select(
        *PAIR, "entity_name", F.col("name").alias("field_name"), "reason", "decision", "score", F.col("field_idx_a").alias("index_a"), F.col("field_idx_b").alias("index_b"),
        "field_name_a", "field_name_b", "type_a", "type_b", "nullable_a", "nullable_b", "constraints_a", "constraints_b",
    )


@lru_cache(maxsize=64)
def _findings(context: str, config: CompareConfig) -> Column:
    """What the rules find in a matched pair of fields, as an array."""
    none = F.lit(None)

    def finding(order: int, kind: str, severity: str, a: Column, b: Column, rule: str) -> Column:
        return F.struct(F.lit(order).alias("rule_no"), F.lit(kind).alias("conflict_type"), F.lit(severity).alias("severity"), a.alias("from_a"), b.alias("from_b"), F.lit(rule).alias("rule"))

    tests = []
    if config.check_type_compatibility:
        bad = compare_types(F.col("type_a"), F.col("type_b")) == "incompatible"
        said = [F.concat(F.lit("Type: "), type_name(F.col(t))) for t in ("type_a", "type_b")]
        tests.append(F.when(bad, finding(0, "type_incompatible", "high", *said, "Types must be compatible")))
    if config.check_nullability:
        said = [F.concat(F.lit("Nullable: "), F.col(c).cast("string")) for c in ("nullable_a", "nullable_b")]
        tests.append(F.when(~F.col("nullable_a") & F.col("nullable_b"), finding(1, "nullability_mismatch", "medium", *said, "Nullability must match or be compatible")))
    if config.check_constraints:
        unique = [F.exists(F.coalesce(F.col(c), F.array().cast(f"array<{CONSTRAINT}>")), lambda x: x["constraint_type"] == "Unique") for c in ("constraints_a", "constraints_b")]
        length = [F.get(F.filter(c, lambda x: x["constraint_type"] == "MaxLength"), 0)["value"] for c in ("constraints_a", "constraints_b")]
        said = [F.concat(F.lit("Unique: "), u.cast("string")) for u in unique]
        tests.append(F.when(unique[0] != unique[1], finding(2, "constraint_mismatch", "medium", *said, "Constraints must be compatible")))
        said = [F.concat(F.lit("MaxLength: "), v.cast("string")) for v in length]
        tests.append(F.when(length[0] != length[1], finding(3, "constraint_mismatch", "medium", *said, "Constraints must be compatible")))
    if not tests:
        tests = [F.when(F.lit(False), finding(0, "", "", none.cast("string"), none.cast("string"), ""))]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def conflicts(matches: DataFrame, config: CompareConfig) -> DataFrame:
    """The rules over each matched pair of fields."""
    found = matches.select("*", F.explode(_findings(_context(), config)).alias("c"))
    return found.select(*PAIR, "entity_name", "field_name_a", F.col("field_name_a").alias("field_name"), "c.*", "index_a", "index_b", "type_a", "type_b", F.lit(0).alias("stage")).drop("field_name_a")


def _unmatched(pairs: DataFrame, matches: DataFrame, frames: Frames, side: str) -> DataFrame:
    """Fields of one side that no field of the other matches, in each pair of entities."""
    own = frames.fields.select(F.col("entity_idx").alias(f"entity_{side}"), F.col("field_idx").alias(f"index_{side}"), F.col("field_name"), "type", "nullable")
    return pairs.select(*PAIR, "entity_name").join(own, f"entity_{side}").join(matches, [*PAIR, f"index_{side}"], "left_anti").withColumnRenamed(f"index_{side}", "index").withColumn("side", F.lit(side.upper()))


def collisions(unmatched: DataFrame) -> DataFrame:
    """Normal names that different unmatched names of both sides share, by the first two of them."""
    row = F.struct(F.col("side"), F.col("index"), F.col("field_name").alias("name"))
    grouped = unmatched.groupBy(*PAIR, "entity_name", names.normalize_identifier(F.col("field_name")).alias("norm")).agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.count_distinct("field_name").alias("n")
    )
    first, second = F.get("rows", 0), F.get("rows", 1)
    said = lambda x: F.concat(F.lit("Field '"), x["name"], F.lit("' normalizes to '"), F.col("norm"), F.lit("'"))
    return grouped.where((F.col("n") >= 2) & (first["side"] != second["side"])).select(
        *PAIR, "entity_name", F.lit(None).cast("string").alias("field_name"), F.lit(4).alias("rule_no"), F.lit("normalization_collision").alias("conflict_type"),
        F.lit("critical").alias("severity"), said(first).alias("from_a"), said(second).alias("from_b"),
        F.lit("Different fields cannot normalize to the same identifier").alias("rule"), first["index"].alias("index_a"), second["index"].alias("index_b"),
        F.lit(None).cast(unmatched.schema["type"].dataType).alias("type_a"), F.lit(None).cast(unmatched.schema["type"].dataType).alias("type_b"), F.lit(1).alias("stage"),
    )


class Comparison:
    """The relations of a comparison, each planned when it is first asked for.

    ``all_matches`` has one row per matched entity (field null) or field.
    """

    def __init__(self, a: Frames, b: Frames, config: CompareConfig = CompareConfig()) -> None:
        self.a, self.b, self.config = a, b, config
        self._held: list[DataFrame] = []

    def _kept(self, df: DataFrame) -> DataFrame:
        """A relation that is used many times, computed once: as a local relation while it is small, persisted beyond.

        Plans over a local relation are short, and most of a small comparison's time is planning.
        A persisted one has a number of its own, so that no later comparison takes it for its
        own, even where a catalog has changed between the two.
        """
        if self.small:
            rows = df.limit(LOCAL_ROWS + 1).toArrow()
            if rows.num_rows <= LOCAL_ROWS:
                return df.sparkSession.createDataFrame(rows)
        held = df.withColumn("_run", F.lit(uuid.uuid4().hex)).persist()
        self._held.append(held)
        return held.drop("_run")

    @cached_property
    def small(self) -> bool:
        """Whether both schemas are so small that matches are worth collecting."""
        return all(f.fields.select("field_idx").limit(LOCAL_ROWS + 1).toArrow().num_rows <= LOCAL_ROWS for f in (self.a, self.b))

    @cached_property
    def entity_matches(self) -> DataFrame:
        return self._kept(match_entities(self.a, self.b, self.config, self.small))

    @cached_property
    def field_matches(self) -> DataFrame:
        return self._kept(match_fields(self.entity_matches, self.a, self.b, self.config, self.small))

    @cached_property
    def all_matches(self) -> DataFrame:
        e = self.entity_matches.select(*PAIR, "entity_name", F.lit(None).cast("string").alias("field_name"), "reason", "decision", "score", F.col("entity_a").alias("index_a"), F.col("entity_b").alias("index_b"))
        f = self.field_matches.select(*PAIR, "entity_name", "field_name", "reason", "decision", "score", "index_a", "index_b")
        return e.unionByName(f)

    @cached_property
    def _only(self) -> dict[str, DataFrame]:
        slim = self.field_matches.select(*PAIR, "index_a", "index_b")
        return {"a": _unmatched(self.entity_matches, slim, self.a, "a"), "b": _unmatched(self.entity_matches, slim, self.b, "b")}

    @cached_property
    def conflicts(self) -> DataFrame:
        found = conflicts(self.field_matches, self.config)
        if self.config.detect_collisions:
            found = found.unionByName(collisions(self._only["a"].unionByName(self._only["b"])))
        return found

    @cached_property
    def _alone(self) -> DataFrame:
        """Entities that no entity of the other side matches."""
        alone = []
        for frames, side in ((self.a, "a"), (self.b, "b")):
            left = frames.entities.join(self.entity_matches.select(F.col(f"entity_{side}").alias("entity_idx")), "entity_idx", "left_anti")
            alone.append(left.select("entity_idx", "entity_name", "entity_type", F.lit(side.upper()).alias("side")))
        return alone[0].unionByName(alone[1])

    @cached_property
    def exclusives(self) -> DataFrame:
        none = F.lit(None)
        fields = self._only["a"].unionByName(self._only["b"]).select(*PAIR, "entity_name", "field_name", "side", "index", F.lit(True).alias("safe_to_add"))
        return fields.unionByName(
            self._alone.select(none.cast("int").alias("entity_a"), none.cast("int").alias("entity_b"), "entity_name", none.cast("string").alias("field_name"), "side", F.col("entity_idx").alias("index"), F.lit(True).alias("safe_to_add"))
        )

    @cached_property
    def unified_fields(self) -> DataFrame:
        """The definition of A holds; whether a match is in conflict follows from its indices."""
        none, whole = F.lit(None), self._alone
        bad = self.conflicts.where("stage = 0").select(*PAIR, "index_a", "index_b").distinct().withColumn("bad", F.lit(True))
        both = self.field_matches.join(bad, [*PAIR, "index_a", "index_b"], "left").select(
            *PAIR, F.col("field_name_a").alias("field_name"), F.col("type_a").alias("type"), F.col("nullable_a").alias("nullable"), F.lit("BOTH").alias("origin"),
            F.when(F.col("bad"), "conflicted").otherwise("matched").alias("state"), "index_a", "index_b", F.lit(0).alias("part"),
        )
        parts = [both]
        for side, part in (("a", 1), ("b", 2)):
            own = self._only[side]
            other = "b" if side == "a" else "a"
            parts.append(own.select(*PAIR, "field_name", "type", "nullable", F.lit(side.upper()).alias("origin"), F.lit("exclusive").alias("state"), F.col("index").alias(f"index_{side}"), none.cast("int").alias(f"index_{other}"), F.lit(part).alias("part")))
            frames = self.a if side == "a" else self.b
            lonely = frames.fields.join(whole.where(F.col("side") == side.upper()).select("entity_idx"), "entity_idx")
            parts.append(lonely.select(F.col("entity_idx").alias(f"entity_{side}"), none.cast("int").alias(f"entity_{other}"), "field_name", "type", "nullable", F.lit(side.upper()).alias("origin"), F.lit("exclusive").alias("state"), F.col("field_idx").alias(f"index_{side}"), none.cast("int").alias(f"index_{other}"), F.lit(part).alias("part")))
        fields = parts[0]
        for p in parts[1:]:
            fields = fields.unionByName(p)
        return fields

    @cached_property
    def unified_entities(self) -> DataFrame:
        merged = self.entity_matches.join(self.a.entities.select(F.col("entity_idx").alias("entity_a"), F.col("entity_name").alias("own"), "entity_type"), "entity_a")
        return merged.select(*PAIR, F.col("own").alias("entity_name"), "entity_type", F.lit("BOTH").alias("origin")).unionByName(
            self._alone.select(F.when(F.col("side") == "A", F.col("entity_idx")).alias("entity_a"), F.when(F.col("side") == "B", F.col("entity_idx")).alias("entity_b"), "entity_name", "entity_type", F.col("side").alias("origin"))
        )

    def release(self) -> None:
        """Let go of the kept matches; results that are read later compute them again."""
        while self._held:
            self._held.pop().unpersist()


def compare(a: Frames, b: Frames, config: CompareConfig = CompareConfig()) -> Comparison:
    return Comparison(a, b, config)


def best_matches(matches: DataFrame, scope: list[str], a: str, b: str) -> DataFrame:
    """One to one: the pairs that are the best of both their sides, ties to smaller indices."""
    from pyspark.sql.window import Window

    rank = lambda own, other: F.row_number().over(Window.partitionBy(*scope, own).orderBy(F.desc("score"), other))
    return matches.withColumn("_a", rank(a, b)).withColumn("_b", rank(b, a)).where("_a = 1 and _b = 1").drop("_a", "_b")
