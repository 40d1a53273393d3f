"""Queries over sources, type maps and names, and the SQL that gives the same rows.

Files and databases are made from the schema of the test tables by rules that SQL can state,
read by the loaders, and compared with what the rules say.
"""

from __future__ import annotations

import json
import sqlite3
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline import queries as base
from loomline.functions import names
from loomline.functions.typemaps import canonical_column
from loomline.functions.types import CanonicalType, type_name
from loomline.ir import Source, local_frame
from loomline.plans.config import SemanticConfig
from loomline.sources import databases, files

#: DDL types and what the DDL reader makes of them.
DDL_TYPES = (
    ("VARCHAR(64)", "String"), ("INT", "Int32"), ("DECIMAL(8,1)", "Decimal(10, 2)"), ("DOUBLE PRECISION", "Float64"), ("TEXT", "String"), ("TIMESTAMP", "Timestamp"),
    ("JSON", "Json"), ("UUID", "Uuid"), ("BLOB", "Binary"), ("DATE", "Date"), ("TINYINT", "Unknown(TINYINT)"), ("BIGINT", "Int64"), ("LONGTEXT", "Text"),
)
JSON_VALUES = ((1, "Int64"), (2.5, "Float64"), ("x", "String"), (True, "Boolean"), (None, "String"), ([1], "Json"), ({"a": 1}, "Json"), (2**63, "String"))
MYSQL_TYPES = (("bigint", "Int64"), ("varchar(9)", "String"), ("decimal(12,3)", "Decimal(12, 3)"), ("tinyint(1)", "Boolean"), ("datetime", "DateTime"), ("enum('a','b')", "String"), ("year", "Int32"), ("longblob", "Binary"))
SQLITE_TYPES = (("INTEGER", "Int64"), ("TEXT", "Text"), ("DECIMAL(10,2)", "Decimal(10, 2)"), ("REAL", "Float64"), ("VARCHAR(20)", "String"), ("BLOB", "Binary"), ("DATE", "Date"), ("DATETIME", "DateTime"), ("BOOLEAN", "Boolean"))
#: (engine, native type, canonical type) as each map is specified.
NATIVE_TYPES = (
    ("mysql", "TINYINT(1)", "Boolean"), ("mysql", "tinyint(4)", "Int32"), ("mysql", "mediumint", "Int32"), ("mysql", "BIGINT(20)", "Int64"), ("mysql", "float", "Float32"), ("mysql", "double", "Float64"),
    ("mysql", "decimal(12,3)", "Decimal(12, 3)"), ("mysql", "decimal(12)", "Decimal(10, 0)"), ("mysql", "char(3)", "String"), ("mysql", "mediumtext", "Text"), ("mysql", "varbinary(9)", "Binary"),
    ("mysql", "date", "Date"), ("mysql", "time", "Time"), ("mysql", "datetime", "DateTime"), ("mysql", "timestamp", "Timestamp"), ("mysql", "json", "Json"), ("mysql", "geometry", "Unknown(geometry)"),
    ("postgres", "bool", "Boolean"), ("postgres", "int2", "Int32"), ("postgres", "int8", "Int64"), ("postgres", "real", "Float32"), ("postgres", "double precision", "Float64"), ("postgres", "numeric", "Decimal(38, 10)"),
    ("postgres", "numeric(7,2)", "Decimal(7, 2)"), ("postgres", "varchar(10)", "String"), ("postgres", "text", "Text"), ("postgres", "bytea", "Binary"), ("postgres", "timestamp with time zone", "DateTime"),
    ("postgres", "timestamptz", "Timestamp"), ("postgres", "jsonb", "Json"), ("postgres", "uuid", "Uuid"), ("sqlite", "INT", "Int64"), ("sqlite", "varchar(9)", "Text"), ("sqlite", "decimal(5,1)", "Decimal(38, 10)"),
    ("sqlite", "blob", "Binary"), ("sqlite", "timestamp", "DateTime"), ("sqlite_catalog", "POINT", "Int64"), ("sqlite_catalog", "CLOB", "Text"), ("sqlite_catalog", "NCHAR(5)", "String"), ("sqlite_catalog", "DOUBLE", "Float64"),
    ("sqlite_catalog", "", "Unknown(NONE)"), ("sqlite_catalog", "BOOL", "Boolean"), ("mysql_catalog", "decimal(12)", "Decimal(12, 0)"), ("mysql_catalog", "year", "Int32"), ("mysql_catalog", "set('a')", "String"),
    ("postgres_catalog", "timestamp with time zone", "Timestamp"), ("postgres_catalog", "character varying", "String"), ("postgres_catalog", "numeric", "Decimal(10, 0)"), ("postgres_catalog", "money", "Decimal(19, 2)"),
    ("postgres_catalog", "citext", "String"), ("postgres_catalog", "inet", "Unknown(inet)"), ("sqlserver", "nvarchar(max)", "Text"), ("sqlserver", "nvarchar(20)", "String"), ("sqlserver", "money", "Decimal(19, 4)"),
    ("sqlserver", "datetimeoffset", "DateTime"), ("sqlserver", "uniqueidentifier", "Uuid"), ("sqlserver", "bit", "Boolean"), ("sqlserver", "xml", "Json"), ("bson", "objectid", "String"), ("bson", "decimal128", "Decimal(34, 0)"),
    ("bson", "object", "Json"), ("bson", "int32", "Int32"), ("bson", "regex", "Unknown(regex)"), ("spark", "array<float>", "Json"), ("spark", "decimal(5,1)", "Decimal(5, 1)"), ("spark", "timestamp_ntz", "DateTime"), ("spark", "timestamp", "Timestamp"),
)
#: (rule, input, result) of functions that run on the driver.
CONNECTIONS = (
    ("engine", "mariadb://u@h/d", "mysql"), ("engine", "postgresql://h/d", "postgres"), ("engine", "mssql://h/d", "sqlserver"), ("engine", "mongo://h/d", "mongodb"), ("engine", "mongodb+srv://h/d", "mongodb+srv"), ("engine", "oracle://h", "error"), ("engine", "no scheme", "error"),
    ("database", "mongodb://h:1/shop?x=1", "shop"), ("database", "mongodb+srv://u:p@h/db", "db"), ("database", "mongodb://h", "error"),
    ("safe", "users_2", "True"), ("safe", "$x", "True"), ("safe", "1a", "False"), ("safe", "a;b", "False"), ("safe", "a" * 65, "False"),
    ("trigger", "CREATE TRIGGER t BEFORE UPDATE ON x", "BEFORE UPDATE"), ("trigger", "create trigger t instead of delete on x", "INSTEAD OF DELETE"), ("trigger", "nothing", "UNKNOWN UNKNOWN"),
    ("firebird trigger", "1", "BEFORE INSERT"), ("firebird trigger", "4", "AFTER UPDATE"), ("firebird trigger", "114", "AFTER INSERT OR UPDATE OR DELETE"), ("firebird trigger", "9", "UNKNOWN UNKNOWN"),
    ("firebird type", "8/0/9/-2", "Decimal(9, 2)"), ("firebird type", "16/0/0/0", "Int64"), ("firebird type", "261/1/0/0", "Text"), ("firebird type", "261/0/0/0", "Binary"), ("firebird type", "37/0/0/0", "String"), ("firebird type", "99/0/0/0", "Unknown(Firebird type code: 99)"),
)


def _tables(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, list[str]]]:
    """(number, name, columns) of the test tables."""
    rows = base.schema_a(spark, sf_dir).fields.select("entity_idx", "entity_name", "field_idx", "field_name").collect()
    made: dict[tuple[int, str], list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.entity_idx, r.field_idx)):
        made.setdefault((r.entity_idx, r.entity_name), []).append(r.field_name)
    return [(e, name, columns) for (e, name), columns in made.items()]


def _fields(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """The fields of some sources with one entity each."""
    unique = F.exists("constraints", lambda c: c["constraint_type"] == "Unique").alias("is_unique")
    everything = Source("all", "files", [e for s in sources for e in s.entities])
    return everything.frames(spark).fields.select("entity_name", "field_idx", "field_name", type_name(F.col("type")).alias("type_name"), "nullable", unique)


def ddl_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a DDL text with comments, quotes, sized columns named key and index, and table-level constraints."""
    text = ["-- one table, and another (with, brackets)\n"]
    for e, name, columns in _tables(spark, sf_dir):
        parts = []
        for i, column in enumerate(columns):
            column = {1: "key", 2: "index"}.get(i, f"`{column}`" if i % 2 else column)
            flags = " PRIMARY KEY" if i == 0 else (" NOT NULL" if i % 3 == 1 else "") + (" UNIQUE" if i % 4 == 2 else "")
            parts.append(f"  {column} {DDL_TYPES[(i + e) % len(DDL_TYPES)][0]}{flags}")
        parts += [f"KEY idx_{name} ({columns[0]})", f"CONSTRAINT fk_{name} FOREIGN KEY ({columns[0]}) REFERENCES region (r_regionkey)", "CHECK (1 > 0)"]
        text.append(f'create table if not exists "{name}" (\n' + ",\n".join(parts) + "\n); /* done; */")
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "tables.ddl"
        path.write_text("\n".join(text), encoding="utf-8")
        return _fields(spark, [files.load_file(str(path))])


def ddl_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a DDL text: composite primary keys and table-level unique and foreign keys."""
    text = "".join(
        f"CREATE TABLE {name} ({', '.join(f'{c} INT' for c in columns)}, PRIMARY KEY ({', '.join(columns[:2])}), UNIQUE KEY u_{name} ({columns[-1]}), FOREIGN KEY ({columns[0]}) REFERENCES region (r_regionkey));"
        for _, name, columns in _tables(spark, sf_dir)
    )
    keys = Source("ddl", "sql", files.parse_ddl(text)).key_frame(spark)
    return keys.select("entity_idx", "key_type", F.array_join("field_names", ",").alias("field_names"), F.col("metadata")["referenced_table"].alias("referenced_table"), F.col("metadata")["referenced_columns"].alias("referenced_columns"))


def csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:
        sources = []
        for _, name, columns in _tables(spark, sf_dir):
            path = Path(folder) / f"{name}.CSV"
            path.write_text(",".join(f'"{c}, quoted"' if i % 2 else c for i, c in enumerate(columns)) + "\n1\n", encoding="utf-8")
            sources.append(files.load_file(str(path)))
        return _fields(spark, sources)


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:
        sources = []
        for e, name, columns in _tables(spark, sf_dir):
            row = {c: JSON_VALUES[(i + e) % len(JSON_VALUES)][0] for i, c in enumerate(columns)}
            path = Path(folder) / f"{name}.json"
            path.write_text(json.dumps([row, {"other": 1}] if e % 2 else row), encoding="utf-8")
            sources.append(files.load_file(str(path)))
        return _fields(spark, sources)


def xml_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of a record and attributes; elements that close themselves are none."""
    with tempfile.TemporaryDirectory() as folder:
        sources = []
        for _, name, columns in _tables(spark, sf_dir):
            inner = "".join(f"<{c}/>" if i % 5 == 4 else f"<{c}>v</{c}>" for i, c in enumerate(columns))
            path = Path(folder) / f"{name}.xml"
            path.write_text(f'<rows><record no="1">{inner}</record><record no="2"/></rows>', encoding="utf-8")
            sources.append(files.load_file(str(path)))
        return _fields(spark, sources)


def url_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format, safety and fetched form of every url; each different url is judged once."""

    @F.udf("struct<format:string,safe:boolean,fetched:string>", useArrow=True)
    def judged(url: str) -> dict:
        try:
            kind = files.url_format(url)
        except files.UnsupportedFormat:
            kind = None
        try:
            files.check_url(url)
            safe = True
        except files.SourceError:
            safe = False
        return {"format": kind, "safe": safe, "fetched": files.export_url(url)}

    i = F.col("page_id")
    url = (
        F.when(i % 10 == 7, F.concat(F.lit("https://docs.google.com/spreadsheets/d/K"), i, F.lit("/edit#gid=0")))
        .when(i % 10 == 8, F.concat(F.lit("http://172."), i % 40, F.lit(".0.1/a.json")))
        .when(i % 10 == 9, F.concat(F.lit("ftp://"), i, F.lit(".example.org/a.xml")))
        .otherwise(F.concat("url", F.when(i % 4 == 0, F.lit(".csv?x=1")).when(i % 4 == 1, F.lit(".DDL")).otherwise(F.lit(""))))
    )
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", url.alias("url"))
    rules = pages.select("url").distinct().withColumn("j", judged("url"))
    return pages.join(rules, "url").select("page_id", "j.format", "j.safe", "j.fetched")


def native_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = local_frame(spark, [(e, n) for e, n, _ in NATIVE_TYPES], "engine string, native string")
    parts = [given.where(F.col("engine") == e).select("engine", "native", type_name(canonical_column(e, F.col("native"))).alias("type_name")) for e in dict.fromkeys(e for e, *_ in NATIVE_TYPES)]
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    return made


def connection_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection strings, database names, identifiers, triggers and type codes."""

    def told(rule: str, given: str) -> str:
        try:
            if rule == "engine":
                return databases.parse_connection(given)[0]
            if rule == "database":
                return databases.database_name(given)
            if rule == "safe":
                return str(databases.is_safe_identifier(given))
            if rule == "firebird type":
                return databases.firebird_native(given).name
            return " ".join(databases.trigger_event(given) if rule == "trigger" else databases.firebird_trigger(int(given)))
        except files.SourceError:
            return "error"

    return local_frame(spark, [(r, g, told(r, g)) for r, g, _ in CONNECTIONS], "rule string, given string, result string")


def catalog_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows of columns, in any order, as fields."""
    i, e = F.col("field_idx"), F.col("entity_idx")
    native = F.get(F.array(*[F.lit(n) for n, _ in MYSQL_TYPES]), (i + e) % len(MYSQL_TYPES))
    rows = base.schema_a(spark, sf_dir).fields.select(F.col("entity_name").alias("table_name"), F.col("field_name").alias("column_name"), (i + 1).alias("ordinal_position"), native.alias("native_type"), F.when(i % 2 == 1, "YES").otherwise("NO").alias("is_nullable"))
    found = databases.catalog_frames(rows.orderBy(F.desc("column_name")), "mysql", "shop").fields
    return found.select("entity_idx", "entity_name", "field_idx", "field_name", type_name(F.col("type")).alias("type_name"), "nullable")


def catalog_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite keys gathered from catalog rows of single columns."""
    i = F.col("field_idx")
    rows = base.schema_a(spark, sf_dir).fields.where("field_idx < 3").select(
        F.col("entity_name").alias("table_name"), "field_name", i,
        F.explode(F.filter(F.array(F.when(i < 2, F.lit("PRIMARY KEY")), F.when(i > 0, F.lit("FOREIGN KEY")), F.when(i == 1, F.lit("UNIQUE"))), lambda k: k.isNotNull())).alias("constraint_type"),
    )
    foreign = F.col("constraint_type") == "FOREIGN KEY"
    keys = rows.select(
        "table_name", F.concat_ws("_", F.split_part("constraint_type", F.lit(" "), F.lit(1)), "table_name").alias("constraint_name"), "constraint_type", F.col("field_name").alias("column_name"),
        F.when(F.col("constraint_type") == "PRIMARY KEY", 2 - i).otherwise(i).alias("ordinal_position"), F.when(foreign, F.lit("region")).alias("referenced_table_name"), F.when(foreign, F.concat(F.lit("r"), i)).alias("referenced_column_name"),
    )
    return databases.grouped_keys(keys).select("table_name", "constraint_name", "key_type", F.array_join("field_names", ",").alias("field_names"), "referenced_table", F.array_join("referenced_fields", ",").alias("referenced_fields"))


def catalog_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole catalog as a schema: indexes, views, routines and triggers, as (kind, owner, name, detail)."""
    a = base.schema_a(spark, sf_dir).fields.where("field_idx < 2")
    i, lit = F.col("field_idx"), F.lit
    table = F.col("entity_name").alias("table_name")
    once = a.where("field_idx = 0")
    rows = {
        "columns": a.select(table, F.col("field_name").alias("column_name"), (i + 1).alias("ordinal_position"), lit("integer").alias("native_type"), lit("NO").alias("is_nullable")),
        "indexes": a.select(table, F.concat(lit("ix_"), "entity_name").alias("index_name"), lit("NO").alias("is_unique"), F.col("field_name").alias("column_name"), (2 - i).alias("ordinal_position"), lit("x > 0").alias("filter_condition")),
        "views": once.select(F.concat(lit("v_"), "entity_name").alias("view_name"), F.concat(lit("SELECT "), "field_name").alias("definition"), F.when(F.length("entity_name") % 2 == 0, "YES").otherwise("NO").alias("is_materialized")),
        "routines": once.select(F.concat(lit("p_"), "entity_name").alias("routine_name"), lit("FUNCTION").alias("routine_type"), lit("BEGIN END").alias("definition"), lit("integer").alias("return_type")),
        "triggers": once.select(F.concat(lit("t_"), "entity_name").alias("trigger_name"), table, lit("AFTER").alias("timing"), lit("DELETE").alias("event"), lit("x").alias("definition")),
    }
    s = databases.catalog_source("postgres", "shop", rows)
    shown = [("index", e.entity_name, x.index_name, f"{x.index_type} {','.join(x.field_names)} {x.filter_condition}") for e in s.entities for x in e.indexes]
    shown += [("view", None, v.view_name, f"{v.definition} {v.is_materialized}") for v in s.views]
    shown += [("routine", None, p.name, f"{p.procedure_type} {p.return_type}") for p in s.stored_procedures]
    shown += [("trigger", t.table_name, t.trigger_name, f"{t.timing} {t.event}") for t in s.triggers]
    return local_frame(spark, shown, "kind string, owner string, name string, detail string")


def sqlite_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from an SQLite file: (kind, owner, name, detail)."""
    with tempfile.TemporaryDirectory() as folder:
        path = str(Path(folder) / "shop.db")
        db = sqlite3.connect(path)
        for e, name, columns in _tables(spark, sf_dir):
            typed = [f'"{c}" {SQLITE_TYPES[(i + e) % len(SQLITE_TYPES)][0]}{" NOT NULL" if i % 3 == 1 else ""}' for i, c in enumerate(columns)]
            foreign = "" if name == "region" else f', FOREIGN KEY ("{columns[0]}") REFERENCES region(r_regionkey)'
            db.execute(f'CREATE TABLE "{name}" ({", ".join(typed)}, PRIMARY KEY ({", ".join(reversed(columns[:2]))}){foreign})')
            db.execute(f'CREATE UNIQUE INDEX "ux_{name}" ON "{name}" ("{columns[1]}", "{columns[0]}")')
            db.execute(f'CREATE VIEW "v_{name}" AS SELECT "{columns[0]}" FROM "{name}"')
            db.execute(f'CREATE TRIGGER "t_{name}" AFTER UPDATE ON "{name}" BEGIN SELECT 1; END')
        db.commit()
        db.close()
        s = databases.load_database(spark, f"sqlite://{path}")
    shown = [("field", e.entity_name, f.field_name, f"{f.canonical_type.name} {f.nullable}") for e in s.entities for f in e.fields]
    shown += [("key", e.entity_name, k.key_type, ",".join(k.field_names) + (f" {k.metadata['referenced_table']}" if k.key_type == "foreign" else "")) for e in s.entities for k in e.keys]
    shown += [("index", e.entity_name, x.index_name, f"{x.index_type} {','.join(x.field_names)}") for e in s.entities for x in e.indexes]
    shown += [("view", None, v.view_name, ",".join(v.field_names)) for v in s.views] + [("trigger", t.table_name, t.trigger_name, f"{t.timing} {t.event}") for t in s.triggers]
    return local_frame(spark, shown, "kind string, owner string, name string, detail string")


def doc_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON documents with quoted numbers, nulls, nested, mixed, missing and extended values, over all events."""
    i = F.col("event_id")
    text = F.concat(
        F.lit('{"n": '), i, F.lit(', "zip": "0'), i, F.lit('", "flag": "true", "real": 1.5, "ok": true, "none": null, "_id": {"$oid": "5f"}, "at": {"$date": "2020-01-01T00:00:00Z"}, "obj": {"x": 1}, "arr": [1], "mix": '),
        F.when(i % 2 == 0, "1").otherwise('"a"'), F.when(i % 3 == 0, ', "some": 7').otherwise(""), F.lit(', "maybe": '), F.when(i % 5 == 0, "null").otherwise("2"), F.lit("}"),
    )
    found = databases.infer_documents(spark.read.parquet(f"{sf_dir}/events.parquet").select(text.alias("doc")), "doc", None)
    return found.select("field_name", type_name(F.col("type")).alias("type_name"), "nullable", "seen", "nulls")


def ir_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema written as JSON and read again."""
    made = Source("shop", "test", [
        base.Entity(name, "table", [base.Field(c, CanonicalType("decimal", i + 1, i) if i % 4 == 3 else CanonicalType("unknown", original=c) if i % 4 == 2 else CanonicalType("int64"), i % 2 == 0, [base.Constraint("MaxLength", i)], {"n": i}) for i, c in enumerate(columns)], [base.Key("primary", columns[:1])])
        for _, name, columns in _tables(spark, sf_dir)
    ])
    again = Source.from_json(made.to_json())
    rows = [(e.entity_name, f.field_name, f.canonical_type.name, f.nullable, f.constraints[0].value, f.metadata["n"], e.keys[0].field_names == [e.fields[0].field_name]) for e in again.entities for f in e.fields]
    return local_frame(spark, rows, "entity_name string, field_name string, type_name string, nullable boolean, max_length long, noted long, keyed boolean")


def word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems, Spanish singulars and exceptions of the words of part names with endings."""
    endings = F.array(*[F.lit(x) for x in ("", "s", "ing", "ed", "er", "ly", "ción", "dad", "mente")])
    words = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).where("w <> ''").distinct()
    word = words.select(F.explode(F.transform(endings, lambda x: F.concat("w", x))).alias("word")).distinct()
    spared = SemanticConfig(plural_exceptions=("reds", "blues"))
    return word.select(
        "word", names.stemmed(F.col("word")).alias("stem_en"), names.stemmed(F.col("word"), "es").alias("stem_es"), names.singular(F.col("word"), "es").alias("singular_es"),
        F.get(names.morph_tokens(F.array("word"), spared), 0).alias("spared"), F.get(names.morph_tokens(F.array("word"), SemanticConfig(stemming=True)), 0).alias("both"),
    )


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two words, of the default groups and of regions, are synonyms."""
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.lower("r_name").alias("w"))
    words = local_frame(spark, [(w,) for w in ("id", "identifier", "num", "number", "no")], "w string").unionByName(regions).distinct()
    groups = names.synonym_groups(F.array("w"), SemanticConfig())
    made = words.select("w", groups.alias("g"), F.lit(1).alias("k"))  # ten words
    other = made.select(F.col("w").alias("w2"), F.col("g").alias("g2"), "k")
    return made.join(other, "k").select(F.col("w").alias("a"), F.col("w2").alias("b"), names.has_synonym(F.col("g"), F.col("g2")).alias("synonym"))


def similar_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part names whose letter trigrams are similar, by an equi-join on the rarest trigrams that any such pair must share."""
    least = 0.3
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lower("p_name").alias("name")).where("name is not null").distinct()
    grams = parts.select("name", F.explode(names.ngrams(F.col("name"), 3)).alias("gram"))
    ranked = grams.join(grams.groupBy("gram").count(), "gram").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("count", "gram"))).alias("g"))
    # of two sets with a Jaccard similarity of t each must share one of its first n - ceil(t n) + 1 elements
    first = F.slice("g", F.lit(1), (F.size("g") - F.ceil(F.size("g") * F.lit(least)) + 1).cast("int"))
    sets = ranked.select("name", F.transform("g", lambda x: x["gram"]).alias("set"), F.transform(first, lambda x: x["gram"]).alias("first"))
    left = sets.select("name", "set", F.col("first").alias("f"), F.explode("first").alias("key"))
    right = sets.select(F.col("name").alias("other"), F.col("set").alias("other_set"), F.col("first").alias("other_f"), F.explode("first").alias("key"))
    # a pair is taken under the smallest of the keys that it shares
    pairs = left.join(right, "key").where((F.col("name") < F.col("other")) & (F.array_min(F.array_intersect("f", "other_f")) == F.col("key")))
    score = names.set_similarity(F.col("set"), F.col("other_set"), "jaccard")
    return pairs.select("name", "other", score.alias("score")).where(F.col("score") >= least).select("name", "other", F.round("score", 6).alias("score"))


QUERIES = [
    ddl_fields, ddl_keys, csv_fields, json_fields, xml_fields, url_sources, native_types, connection_rules, catalog_fields, catalog_keys, catalog_source, sqlite_catalog,
    doc_inference, ir_roundtrip, word_forms, synonyms, similar_part_names,
]


def _values(rows) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)


def _pick(types, shift: str = "i + e") -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for _, t in types) + f"][({shift}) % {len(types)} + 1]"


def oracle_sql() -> dict[str, str]:
    w = "WITH " + base._A
    first = "(SELECT field FROM a x WHERE x.e = a.e AND x.i = {})"
    stem = lambda suffixes: base._case([("strlen(word) < 4", "word"), *[(f"ends_with(word, '{s}') AND strlen(word) > {len(s.encode()) + 2}", f"left(word, length(word) - {len(s)})") for s in suffixes]], "word")
    stemmed = stem(("ing", "ed", "er", "ly"))
    url = "CASE page_id % 10 WHEN 7 THEN 'https://docs.google.com/spreadsheets/d/K' || page_id || '/edit#gid=0' WHEN 8 THEN 'http://172.' || (page_id % 40) || '.0.1/a.json' WHEN 9 THEN 'ftp://' || page_id || '.example.org/a.xml' ELSE url || CASE page_id % 4 WHEN 0 THEN '.csv?x=1' WHEN 1 THEN '.DDL' ELSE '' END END"
    grams = "list_distinct([w[g:g+2] FOR g IN range(1, greatest(length(w) - 2, 1) + 1)])"
    return {
        "ddl_fields": w + f"SELECT entity AS entity_name, i AS field_idx, CASE i WHEN 1 THEN 'key' WHEN 2 THEN 'index' ELSE field END AS field_name, {_pick(DDL_TYPES)} AS type_name, NOT (i = 0 OR i % 3 = 1) AS nullable, i % 4 = 2 AS is_unique FROM a",
        "ddl_keys": w + f", k AS (SELECT DISTINCT e, {first.format(0)} AS f0, {first.format(1)} AS f1, (SELECT field FROM a x WHERE x.e = a.e ORDER BY x.i DESC LIMIT 1) AS fl FROM a) SELECT e AS entity_idx, 'primary' AS key_type, f0 || ',' || f1 AS field_names, NULL AS referenced_table, NULL AS referenced_columns FROM k UNION ALL SELECT e, 'unique', fl, NULL, NULL FROM k UNION ALL SELECT e, 'foreign', f0, 'region', 'r_regionkey' FROM k",
        "csv_fields": w + "SELECT entity AS entity_name, i AS field_idx, CASE WHEN i % 2 = 1 THEN field || ', quoted' ELSE field END AS field_name, 'String' AS type_name, true AS nullable, false AS is_unique FROM a",
        "json_fields": w + f"SELECT entity AS entity_name, i AS field_idx, field AS field_name, {_pick(JSON_VALUES)} AS type_name, (i + e) % 8 = 4 AS nullable, false AS is_unique FROM a",
        "xml_fields": w + ", x AS (SELECT entity, e, -1 AS i, 'no_attr' AS field FROM a GROUP BY entity, e UNION ALL SELECT entity, e, i, field FROM a WHERE i % 5 <> 4) SELECT entity AS entity_name, cast(row_number() OVER (PARTITION BY e ORDER BY i) - 1 AS INT) AS field_idx, field AS field_name, 'String' AS type_name, true AS nullable, false AS is_unique FROM x",
        "url_sources": f"WITH q AS (SELECT page_id, {url} AS url FROM pages), r AS (SELECT *, lower(split_part(url, '?', 1)) AS path, lower(regexp_extract(url, '^[^:]*://([^/?#:]*)', 1)) AS host FROM q) SELECT page_id, CASE WHEN page_id % 10 = 7 OR ends_with(path, '.csv') THEN 'csv' WHEN ends_with(path, '.json') THEN 'json' WHEN ends_with(path, '.xml') THEN 'xml' WHEN ends_with(path, '.sql') OR ends_with(path, '.ddl') THEN 'sql' END AS format, regexp_matches(url, '^https?://') AND NOT regexp_matches(host, '^(localhost|127\\.0\\.0\\.1|::1)$|^(10|192\\.168|169\\.254|172\\.(1[6-9]|2[0-9]|3[01]))\\.') AS safe, CASE WHEN page_id % 10 = 7 THEN 'https://docs.google.com/spreadsheets/d/K' || page_id || '/export?format=csv' ELSE url END AS fetched FROM r",
        "native_types": f"SELECT * FROM (VALUES {_values(NATIVE_TYPES)}) t(engine, native, type_name)",
        "connection_rules": f"SELECT * FROM (VALUES {_values(CONNECTIONS)}) t(rule, given, result)",
        "catalog_fields": w + f"SELECT e AS entity_idx, entity AS entity_name, i AS field_idx, field AS field_name, {_pick(MYSQL_TYPES)} AS type_name, i % 2 = 1 AS nullable FROM a",
        "catalog_keys": w + f", k AS (SELECT DISTINCT entity, {first.format(0)} AS f0, {first.format(1)} AS f1, {first.format(2)} AS f2 FROM a) SELECT entity AS table_name, 'PRIMARY_' || entity AS constraint_name, 'primary' AS key_type, f1 || ',' || f0 AS field_names, NULL AS referenced_table, '' AS referenced_fields FROM k UNION ALL SELECT entity, 'UNIQUE_' || entity, 'unique', f1, NULL, '' FROM k UNION ALL SELECT entity, 'FOREIGN_' || entity, 'foreign', concat_ws(',', f1, f2), 'region', CASE WHEN f2 IS NULL THEN 'r1' ELSE 'r1,r2' END FROM k",
        "catalog_source": w + f", k AS (SELECT DISTINCT entity, {first.format(0)} AS f0, {first.format(1)} AS f1 FROM a) SELECT 'index' AS kind, entity AS owner, 'ix_' || entity AS name, 'regular ' || f1 || ',' || f0 || ' x > 0' AS detail FROM k UNION ALL SELECT 'view', NULL, 'v_' || entity, 'SELECT ' || f0 || CASE WHEN length(entity) % 2 = 0 THEN ' True' ELSE ' False' END FROM k UNION ALL SELECT 'routine', NULL, 'p_' || entity, 'function integer' FROM k UNION ALL SELECT 'trigger', entity, 't_' || entity, 'AFTER DELETE' FROM k",
        "sqlite_catalog": w + f", k AS (SELECT DISTINCT entity, {first.format(0)} AS f0, {first.format(1)} AS f1 FROM a) SELECT 'field' AS kind, entity AS owner, field AS name, {_pick(SQLITE_TYPES)} || CASE WHEN i < 2 OR i % 3 = 1 THEN ' False' ELSE ' True' END AS detail FROM a UNION ALL SELECT 'key', entity, 'primary', f1 || ',' || f0 FROM k UNION ALL SELECT 'key', entity, 'unique', f1 || ',' || f0 FROM k UNION ALL SELECT 'key', entity, 'foreign', f0 || ' region' FROM k WHERE entity <> 'region' UNION ALL SELECT 'index', entity, 'ux_' || entity, 'unique ' || f1 || ',' || f0 FROM k UNION ALL SELECT 'view', NULL, 'v_' || entity, f0 FROM k UNION ALL SELECT 'trigger', entity, 't_' || entity, 'AFTER UPDATE' FROM k",
        "doc_inference": """WITH d AS (SELECT event_id, json_object('n', event_id, 'zip', '0' || event_id, 'flag', 'true', 'real', 1.5::DOUBLE, 'ok', true, 'none', NULL, 'obj', {'x': 1}, 'arr', [1]) AS j FROM events),
          k AS (SELECT event_id, j, unnest(json_keys(j)) AS f FROM d), t AS (SELECT event_id, f, json_type(j, '$.' || f) AS t FROM k
            UNION ALL SELECT event_id, 'mix', CASE WHEN event_id % 2 = 0 THEN 'BIGINT' ELSE 'VARCHAR' END FROM events UNION ALL SELECT event_id, '_id', 'OID' FROM events UNION ALL SELECT event_id, 'at', 'DATE' FROM events
            UNION ALL SELECT event_id, 'some', 'BIGINT' FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'maybe', CASE WHEN event_id % 5 = 0 THEN 'NULL' ELSE 'BIGINT' END FROM events),
          g AS (SELECT f, CASE WHEN t IN ('UBIGINT', 'BIGINT') THEN 'int64' WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'NULL' THEN NULL ELSE t END AS tag FROM t),
          m AS (SELECT f, list_sort(list(DISTINCT tag) FILTER (tag IS NOT NULL)) AS tags, count(*) AS seen, count(*) FILTER (tag IS NULL) AS nulls FROM g GROUP BY f)
          SELECT f AS field_name, CASE WHEN tags IS NULL OR len(tags) = 0 THEN 'Unknown(null)' WHEN len(tags) > 1 THEN 'Unknown(mixed: ' || array_to_string(tags, ', ') || ')' ELSE CASE tags[1] WHEN 'int64' THEN 'Int64' WHEN 'string' THEN 'String' WHEN 'OID' THEN 'String' WHEN 'DATE' THEN 'DateTime' WHEN 'BOOLEAN' THEN 'Boolean' WHEN 'DOUBLE' THEN 'Float64' ELSE 'Json' END END AS type_name,
            nulls > 0 OR seen < (SELECT count(*) FROM events) AS nullable, seen, nulls FROM m""",
        "ir_roundtrip": w + "SELECT entity AS entity_name, field AS field_name, CASE i % 4 WHEN 3 THEN 'Decimal(' || (i + 1) || ', ' || i || ')' WHEN 2 THEN 'Unknown(' || field || ')' ELSE 'Int64' END AS type_name, i % 2 = 0 AS nullable, i::BIGINT AS max_length, i::BIGINT AS noted, true AS keyed FROM a",
        "word_forms": f"WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part), q AS (SELECT DISTINCT w || x AS word FROM w, (VALUES (''), ('s'), ('ing'), ('ed'), ('er'), ('ly'), ('ción'), ('dad'), ('mente')) t(x) WHERE w <> ''), s AS (SELECT word, {base._singular_sql()} AS one FROM q) SELECT word, {stemmed} AS stem_en, {stem(('ción', 'dad', 'mente'))} AS stem_es, CASE WHEN strlen(word) >= 3 AND ends_with(word, 's') THEN left(word, length(word) - 1) ELSE word END AS singular_es, CASE WHEN word IN ('reds', 'blues') THEN word ELSE one END AS spared, {stemmed.replace('word', 'one')} AS both FROM s",
        "synonyms": "WITH g AS (SELECT * FROM (VALUES ('id', 1), ('identifier', 1), ('num', 2), ('number', 2), ('no', 2)) t(w, g)), q AS (SELECT w, g FROM g UNION SELECT lower(r_name), NULL FROM region) SELECT x.w AS a, y.w AS b, coalesce(x.g = y.g AND x.w <> y.w, false) AS synonym FROM q x, q y",
        "similar_part_names": f"WITH q AS (SELECT DISTINCT lower(p_name) AS w FROM part WHERE p_name IS NOT NULL), g AS (SELECT w, {grams} AS s FROM q), p AS (SELECT x.w AS name, y.w AS other, len(list_intersect(x.s, y.s)) AS n, len(list_distinct(list_concat(x.s, y.s))) AS m FROM g x JOIN g y ON x.w < y.w) SELECT name, other, round(n / m::DOUBLE, 6) AS score FROM p WHERE n / m::DOUBLE >= 0.3",
    }
