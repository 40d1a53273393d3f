"""Native types of each engine as ordered rules, evaluated on the driver or as one Column."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.types import TYPE_STRUCT, CanonicalType


class Rule(NamedTuple):
    """``how``: is, or has (as a substring).  ``args``: where a decimal's digits come from (both, one)."""

    how: str
    names: str
    tag: str
    precision: int | None = None
    scale: int | None = None
    args: str | None = None


class Engine(NamedTuple):
    """``cut``: a pattern from which a native type is cut off before it is looked up."""

    cut: str
    rules: tuple[Rule, ...]
    unknown: str = "{}"


def _is(names: str, tag: str, *rest) -> Rule:
    return Rule("is", names, tag, *rest)


def _has(names: str, tag: str, *rest) -> Rule:
    return Rule("has", names, tag, *rest)


#: What each engine's types become; the first rule that fits holds.
ENGINES: dict[str, Engine] = {
    "mysql": Engine(r"[( ].*", (
        Rule("full", "tinyint(1)", "boolean"), _is("bool boolean", "boolean"), _is("tinyint smallint mediumint int integer", "int32"), _is("bigint", "int64"),
        _is("float", "float32"), _is("double real", "float64"), _is("decimal numeric", "decimal", 10, 0, "both"), _is("char varchar", "string"),
        _is("text tinytext mediumtext longtext", "text"), _is("binary varbinary blob tinyblob mediumblob longblob", "binary"),
        _is("date", "date"), _is("time", "time"), _is("datetime", "date_time"), _is("timestamp", "timestamp"), _is("json", "json"),
    )),
    "postgres": Engine(r"[( ].*", (
        _is("boolean bool", "boolean"), _is("smallint int2 integer int int4", "int32"), _is("bigint int8", "int64"), _is("real float4", "float32"),
        _is("double float8", "float64"), _is("decimal numeric", "decimal", 38, 10, "both"), _is("char character varchar", "string"), _is("text", "text"),
        _is("bytea", "binary"), _is("date", "date"), _is("time", "time"), _is("timestamp", "date_time"), _is("timestamptz", "timestamp"),
        _is("json jsonb", "json"), _is("uuid", "uuid"),
    )),
    "sqlite": Engine(r"[( ].*", (
        _is("integer int", "int64"), _is("real float double", "float64"), _is("text varchar char", "text"), _is("blob", "binary"),
        _is("numeric decimal", "decimal", 38, 10), _is("boolean bool", "boolean"), _is("date", "date"), _is("datetime timestamp", "date_time"),
    )),
    "ddl": Engine(r"\(.*", (
        _is("int integer smallint mediumint", "int32"), _is("bigint long", "int64"), _is("float real", "float32"), _is("double", "float64"),
        _is("decimal numeric", "decimal", 10, 2), _is("boolean bool", "boolean"), _is("char varchar text nvarchar nchar", "string"),
        _is("clob longtext mediumtext", "text"), _is("blob binary varbinary", "binary"), _is("date", "date"), _is("time", "time"),
        _is("datetime timestamp", "timestamp"), _is("json", "json"), _is("uuid", "uuid"),
    ), "upper:{}"),
    "sqlite_catalog": Engine("", (
        _has("int", "int64"), _has("text clob", "text"), _has("char", "string"), _has("blob", "binary"), _has("real floa doub", "float64"),
        _has("numeric decimal", "decimal", 10, 2), _is("date", "date"), _has("time", "date_time"), _has("bool", "boolean"),
    )),
    "mysql_catalog": Engine(r"[( ].*", (
        Rule("full", "tinyint(1)", "boolean"), _is("tinyint smallint mediumint int integer year", "int32"), _is("bigint", "int64"), _is("float", "float32"),
        _is("double real", "float64"), _is("decimal numeric", "decimal", 10, 0, "one"), _is("char varchar enum set", "string"),
        _is("text tinytext mediumtext longtext", "text"), _is("binary varbinary blob tinyblob mediumblob longblob", "binary"), _is("date", "date"),
        _is("time", "time"), _is("datetime", "date_time"), _is("timestamp", "timestamp"), _is("json", "json"),
    ), "lower:{}"),
    "postgres_catalog": Engine(r"\(.*", (
        _is("smallint integer smallserial serial", "int32"), _is("bigint bigserial", "int64"), _is("real", "float32"), _is("double precision", "float64"),
        _is("numeric decimal", "decimal", 10, 0, "one"), _is("money", "decimal", 19, 2), Rule("is", "character varying|varchar|character|char|citext", "string"), _is("text", "text"),
        _is("bytea", "binary"), _is("boolean", "boolean"), _is("date", "date"), Rule("is", "time|time without time zone", "time"),
        Rule("is", "timestamp|timestamp without time zone", "date_time"), Rule("is", "timestamp with time zone|timestamptz", "timestamp"), _is("json jsonb", "json"), _is("uuid", "uuid"),
    ), "lower:{}"),
    "bson": Engine("", (
        _is("boolean", "boolean"), _is("int32", "int32"), _is("int64", "int64"), _is("double", "float64"), _is("decimal128", "decimal", 34, 0),
        _is("string objectid", "string"), _is("binary", "binary"), _is("datetime", "date_time"), _is("timestamp", "timestamp"), _is("object array", "json"),
    )),
    "sqlserver": Engine(r"\((?!max\)).*", (
        _is("bit", "boolean"), _is("tinyint smallint int", "int32"), _is("bigint", "int64"), _is("decimal numeric", "decimal", 18, 0, "one"),
        _is("money smallmoney", "decimal", 19, 4), _is("real", "float32"), _is("float", "float64"), _is("varchar(max) nvarchar(max) text ntext", "text"),
        _is("char varchar nchar nvarchar", "string"), _is("binary varbinary varbinary(max) image", "binary"), _is("date", "date"), _is("time", "time"),
        _is("datetime datetime2 smalldatetime datetimeoffset", "date_time"), _is("uniqueidentifier", "uuid"), _is("json xml", "json"),
    ), "SQL Server type: {}"),
    "spark": Engine(r"[(<].*", (
        _is("boolean", "boolean"), _is("tinyint smallint int", "int32"), _is("bigint", "int64"), _is("float", "float32"), _is("double", "float64"),
        _is("decimal", "decimal", 10, 0, "both"), _is("string varchar char", "string"), _is("binary", "binary"), _is("date", "date"), _is("time", "time"),
        _is("timestamp_ntz", "date_time"), _is("timestamp", "timestamp"), _is("struct array map variant", "json"),
    )),
}
ENGINES["postgresql"] = ENGINES["postgres"]

#: Firebird's numeric type codes.
FIREBIRD = {9: "float64", 10: "float32", 11: "float64", 12: "date", 13: "time", 14: "string", 23: "boolean", 27: "float64", 35: "date_time", 37: "string", 40: "string"}
FIREBIRD_INTEGERS = {7: "int32", 8: "int32", 16: "int64"}


def _names(rule: Rule) -> list[str]:
    single = rule.names == "double precision" or rule.how == "full"
    return [rule.names] if single else re.split(r"\|", rule.names) if "|" in rule.names else rule.names.split(" ")


def _digits(native: str, rule: Rule) -> tuple[int | None, int | None]:
    found = re.search(r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", native)
    if rule.args and found and found[2]:
        return int(found[1]), int(found[2])
    return (int(found[1]), 0) if rule.args == "one" and found else (rule.precision, rule.scale)


def canonical(engine: str, native: str) -> CanonicalType:
    """The canonical type of ``native``; engines that are not known give unknown types."""
    if engine not in ENGINES:
        return CanonicalType("unknown", original=native)
    cut, rules, unknown = ENGINES[engine]
    low = native.lower().strip()
    base = re.sub(cut, "", low) if cut else low
    for rule in rules:
        names = _names(rule)
        fits = any(n in low for n in names) if rule.how == "has" else low.startswith(rule.names) if rule.how == "full" else base in names
        if fits:
            return CanonicalType(rule.tag, *(_digits(low, rule) if rule.tag == "decimal" else ()))
    if engine == "postgres_catalog" and low.endswith("[]"):
        return CanonicalType("unknown", original=low)
    style = {"upper:{}": native.upper(), "lower:{}": base if engine == "mysql_catalog" else low}
    empty = "NONE" if engine == "sqlite_catalog" and not native else None
    return CanonicalType("unknown", original=empty or style.get(unknown) or unknown.format(native))


def canonical_column(engine: str, native: Column) -> Column:
    """``canonical`` as one CASE expression, for catalogs read as DataFrames."""
    cut, rules, unknown = ENGINES[engine]
    low = F.lower(F.trim(native))
    base = F.regexp_replace(low, cut, "") if cut else low
    none = F.lit(None).cast("int")

    def struct(tag: str, p: Column = none, s: Column = none, original: Column | None = None) -> Column:
        return F.struct(F.lit(tag).alias("tag"), p.cast("int").alias("precision"), s.cast("int").alias("scale"), (F.lit(None).cast("string") if original is None else original).alias("original"))

    case = None
    for rule in rules:
        names = _names(rule)
        if rule.how == "has":
            fits = F.lit(False)
            for n in names:
                fits = fits | F.contains(low, F.lit(n))
        else:
            fits = low.startswith(rule.names) if rule.how == "full" else base.isin(names)
        if rule.tag == "decimal" and rule.args:
            both, one = r"\(\s*(\d+)\s*,\s*(\d+)\s*\)", r"\(\s*(\d+)\s*\)"
            default = struct("decimal", F.lit(rule.precision), F.lit(rule.scale))
            if rule.args == "one":
                default = F.when(low.rlike(one), struct("decimal", F.regexp_extract(low, one, 1), F.lit(0))).otherwise(default)
            value = F.when(low.rlike(both), struct("decimal", F.regexp_extract(low, both, 1), F.regexp_extract(low, both, 2))).otherwise(default)
        else:
            value = struct(rule.tag, F.lit(rule.precision), F.lit(rule.scale))
        case = F.when(fits, value) if case is None else case.when(fits, value)
    style = {"upper:{}": F.upper(native), "lower:{}": base if engine == "mysql_catalog" else low}
    original = style.get(unknown, F.concat(F.lit(unknown.replace("{}", "")), native))
    if engine == "sqlite_catalog":
        original = F.when(native == "", "NONE").otherwise(original)
    return case.otherwise(struct("unknown", original=original)).cast(TYPE_STRUCT)


def firebird_type(code: int, sub_type: int | None = None, precision: int | None = None, scale: int | None = None) -> CanonicalType:
    """Integers with a negative scale are decimals; blobs of subtype 1 are text."""
    if code in FIREBIRD_INTEGERS:
        return CanonicalType("decimal", precision, -scale) if (scale or 0) < 0 else CanonicalType(FIREBIRD_INTEGERS[code])
    if code in (45, 261):
        return CanonicalType("text" if sub_type == 1 else "binary")
    return CanonicalType(FIREBIRD[code]) if code in FIREBIRD else CanonicalType("unknown", original=f"Firebird type code: {code}")
