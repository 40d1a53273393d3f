"""Schemas of databases: connection strings, catalogs read as DataFrames, SQLite, documents, Spark tables."""

from __future__ import annotations

import re
import sqlite3

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.typemaps import canonical, canonical_column, firebird_type
from loomline.functions.types import CanonicalType
from loomline.ir import Entity, Field, Frames, Index, Key, Procedure, Source, Trigger, View
from loomline.sources.files import SourceError

ALIASES = {"sqlite": "sqlite", "mysql": "mysql", "mariadb": "mysql", "postgresql": "postgres", "postgres": "postgres", "mongodb": "mongodb", "mongo": "mongodb", "mongodb+srv": "mongodb+srv", "sqlserver": "sqlserver", "mssql": "sqlserver", "firebird": "firebird"}
JDBC = {"mysql": "jdbc:mysql://", "postgres": "jdbc:postgresql://", "sqlserver": "jdbc:sqlserver://", "firebird": "jdbc:firebirdsql://"}


def parse_connection(text: str) -> tuple[str, str]:
    """(engine, the rest) of ``engine://rest``."""
    engine, sep, rest = text.partition("://")
    if not sep:
        raise SourceError("missing '://' in the connection string")
    if engine.lower() not in ALIASES:
        raise SourceError(f"unsupported engine {engine}")
    return ALIASES[engine.lower()], rest


def database_name(uri: str) -> str:
    """The database of a document store's uri: after the host's slash, up to options."""
    found = re.match(r"[^/]+/([^?]+)", uri.split("://", 1)[-1])
    if not found:
        raise SourceError("no database in the connection string")
    return found[1]


def is_safe_identifier(name: str) -> bool:
    return re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]{0,63}", name) is not None


def trigger_event(sql: str) -> tuple[str, str]:
    """(timing, event) by the first words that a trigger's text contains."""
    up = sql.upper()
    timing = next((t for t in ("BEFORE", "AFTER", "INSTEAD OF") if t in up), "UNKNOWN")
    return timing, next((e for e in ("INSERT", "UPDATE", "DELETE") if e in up), "UNKNOWN")


#: Trigger codes of one engine, as (timing, event); even codes are AFTER.
_EVENTS = {1: "INSERT", 3: "UPDATE", 5: "DELETE", 17: "INSERT OR UPDATE", 25: "INSERT OR DELETE", 27: "UPDATE OR DELETE", 113: "INSERT OR UPDATE OR DELETE"}


def firebird_trigger(code: int) -> tuple[str, str]:
    after = code % 2 == 0
    event = _EVENTS.get(code - after)
    return (("AFTER" if after else "BEFORE"), event) if event else ("UNKNOWN", "UNKNOWN")


def load_sqlite(path: str) -> Source:
    """Tables, keys, indexes, views and triggers of an SQLite file."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        named = db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall()
        entities = []
        for (table,) in named:
            if not is_safe_identifier(table):
                raise SourceError(f"unsafe table name {table}")
            columns = db.execute(f'PRAGMA table_info("{table}")').fetchall()
            fields = [Field(c[1], canonical("sqlite_catalog", c[2] or ""), not (c[3] or c[5])) for c in columns]
            primary = [c[1] for c in sorted((c for c in columns if c[5]), key=lambda c: c[5])]
            keys = [Key("primary", primary)] if primary else []
            indexes = []
            for _, name, unique, origin, *_ in db.execute(f'PRAGMA index_list("{table}")').fetchall():
                if name.startswith("sqlite_autoindex"):
                    continue
                parts = [r[2] for r in db.execute(f'PRAGMA index_info("{name}")').fetchall()]
                if unique:
                    keys.append(Key("unique", parts))
                indexes.append(Index(name, "unique" if unique else "regular", parts))
            for r in db.execute(f'PRAGMA foreign_key_list("{table}")').fetchall():
                keys.append(Key("foreign", [r[3]], {"referenced_table": r[2], "referenced_column": r[4]}))
            entities.append(Entity(table, "table", fields, keys, indexes))
        views = []
        for name, sql in db.execute("SELECT name, sql FROM sqlite_master WHERE type = 'view' ORDER BY name").fetchall():
            views.append(View(name, sql, [r[1] for r in db.execute(f'PRAGMA table_info("{name}")').fetchall()]))
        triggers = [Trigger(n, t, *trigger_event(s or ""), s) for n, t, s in db.execute("SELECT name, tbl_name, sql FROM sqlite_master WHERE type = 'trigger' ORDER BY name").fetchall()]
    except sqlite3.Error as e:
        raise SourceError(str(e)) from e
    finally:
        db.close()
    return Source(re.split(r"[/\\]", path)[-1].rsplit(".", 1)[0], "sqlite", entities, views, [], triggers)


#: The catalog queries, one of each kind for the whole schema; all engines give the columns of ``CATALOG_COLUMNS``.
CATALOG_COLUMNS = {
    "columns": "table_name string, column_name string, ordinal_position int, native_type string, is_nullable string",
    "keys": "table_name string, constraint_name string, constraint_type string, column_name string, ordinal_position int, referenced_table_name string, referenced_column_name string",
    "indexes": "table_name string, index_name string, is_unique string, column_name string, ordinal_position int, filter_condition string",
    "views": "view_name string, definition string, is_materialized string",
    "routines": "routine_name string, routine_type string, definition string, return_type string",
    "triggers": "trigger_name string, table_name string, timing string, event string, definition string",
}
_SCHEMA = {"mysql": "DATABASE()", "postgres": "'public'", "sqlserver": "'dbo'"}
_NATIVE = {
    "mysql": "c.column_type",
    "postgres": "CASE WHEN c.data_type = 'ARRAY' THEN ltrim(c.udt_name, '_') || '[]' WHEN c.data_type = 'USER-DEFINED' THEN c.udt_name WHEN c.numeric_precision IS NOT NULL AND c.data_type = 'numeric' THEN c.data_type || '(' || c.numeric_precision || ',' || c.numeric_scale || ')' ELSE c.data_type END",
    "sqlserver": "c.data_type + CASE WHEN c.character_maximum_length = -1 THEN '(max)' WHEN c.data_type IN ('decimal', 'numeric') THEN '(' + CAST(c.numeric_precision AS varchar) + ',' + CAST(c.numeric_scale AS varchar) + ')' ELSE '' END",
}


def _standard(engine: str) -> dict[str, str]:
    """The queries over the standard's information_schema."""
    schema = _SCHEMA[engine]
    keys = (
        "SELECT k.table_name, k.constraint_name, t.constraint_type, k.column_name, k.ordinal_position, {table} AS referenced_table_name, {column} AS referenced_column_name "
        "FROM information_schema.table_constraints t JOIN information_schema.key_column_usage k "
        "ON k.constraint_schema = t.constraint_schema AND k.constraint_name = t.constraint_name AND k.table_name = t.table_name {more} "
        f"WHERE t.table_schema = {schema} AND t.constraint_type IN ('PRIMARY KEY', 'UNIQUE', 'FOREIGN KEY')"
    )
    # the referenced column is the one at the same place of the key referred to
    by_place = (
        "LEFT JOIN information_schema.referential_constraints r ON r.constraint_schema = t.constraint_schema AND r.constraint_name = t.constraint_name "
        "LEFT JOIN information_schema.key_column_usage u ON u.constraint_schema = r.unique_constraint_schema AND u.constraint_name = r.unique_constraint_name AND u.ordinal_position = k.{place}"
    )
    place = {"postgres": "position_in_unique_constraint", "sqlserver": "ordinal_position"}.get(engine)
    own = engine == "mysql"
    return {
        "columns": f"SELECT c.table_name, c.column_name, c.ordinal_position, {_NATIVE[engine]} AS native_type, c.is_nullable FROM information_schema.columns c "
        f"JOIN information_schema.tables b ON b.table_schema = c.table_schema AND b.table_name = c.table_name WHERE c.table_schema = {schema} AND b.table_type = 'BASE TABLE'",
        "keys": keys.format(table="k.referenced_table_name" if own else "u.table_name", column="k.referenced_column_name" if own else "u.column_name", more="" if own else by_place.format(place=place)),
        "views": f"SELECT table_name AS view_name, view_definition AS definition, 'NO' AS is_materialized FROM information_schema.views WHERE table_schema = {schema}",
        "routines": f"SELECT routine_name, routine_type, routine_definition AS definition, data_type AS return_type FROM information_schema.routines WHERE routine_schema = {schema}",
        "triggers": f"SELECT trigger_name, event_object_table AS table_name, action_timing AS timing, event_manipulation AS event, action_statement AS definition FROM information_schema.triggers WHERE trigger_schema = {schema}",
    }


CATALOG_SQL = {
    "mysql": _standard("mysql") | {
        "indexes": "SELECT s.table_name, s.index_name, CASE WHEN s.non_unique = 0 THEN 'YES' ELSE 'NO' END AS is_unique, s.column_name, s.seq_in_index AS ordinal_position, NULL AS filter_condition FROM information_schema.statistics s WHERE s.table_schema = DATABASE() AND s.non_unique = 1",
    },
    "postgres": _standard("postgres") | {
        "indexes": "SELECT t.relname AS table_name, i.relname AS index_name, CASE WHEN x.indisunique THEN 'YES' ELSE 'NO' END AS is_unique, a.attname AS column_name, p.n AS ordinal_position, pg_get_expr(x.indpred, x.indrelid) AS filter_condition "
        "FROM pg_index x JOIN pg_class i ON i.oid = x.indexrelid JOIN pg_class t ON t.oid = x.indrelid JOIN pg_namespace s ON s.oid = t.relnamespace CROSS JOIN LATERAL unnest(x.indkey) WITH ORDINALITY AS p(attnum, n) "
        "JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = p.attnum WHERE s.nspname = 'public' AND NOT x.indisprimary",
        "views": "SELECT viewname AS view_name, definition, 'NO' AS is_materialized FROM pg_views WHERE schemaname = 'public' UNION ALL SELECT matviewname, definition, 'YES' FROM pg_matviews WHERE schemaname = 'public'",
    },
    "sqlserver": _standard("sqlserver") | {
        "indexes": "SELECT t.name AS table_name, i.name AS index_name, CASE WHEN i.is_unique = 1 THEN 'YES' ELSE 'NO' END AS is_unique, c.name AS column_name, x.key_ordinal AS ordinal_position, i.filter_definition AS filter_condition "
        "FROM sys.indexes i JOIN sys.tables t ON t.object_id = i.object_id JOIN sys.index_columns x ON x.object_id = i.object_id AND x.index_id = i.index_id JOIN sys.columns c ON c.object_id = i.object_id AND c.column_id = x.column_id "
        "WHERE i.is_primary_key = 0 AND i.name IS NOT NULL AND SCHEMA_NAME(t.schema_id) = 'dbo'",
        "triggers": "SELECT g.name AS trigger_name, t.name AS table_name, CASE WHEN g.is_instead_of_trigger = 1 THEN 'INSTEAD OF' ELSE 'AFTER' END AS timing, e.type_desc AS event, OBJECT_DEFINITION(g.object_id) AS definition FROM sys.triggers g JOIN sys.tables t ON t.object_id = g.parent_id JOIN sys.trigger_events e ON e.object_id = g.object_id",
    },
    # native_type: code/subtype/precision/scale, as firebird_native reads them
    "firebird": {
        "columns": "SELECT TRIM(r.RDB$RELATION_NAME) AS table_name, TRIM(r.RDB$FIELD_NAME) AS column_name, r.RDB$FIELD_POSITION AS ordinal_position, f.RDB$FIELD_TYPE || '/' || COALESCE(f.RDB$FIELD_SUB_TYPE, 0) || '/' || COALESCE(f.RDB$FIELD_PRECISION, 0) || '/' || COALESCE(f.RDB$FIELD_SCALE, 0) AS native_type, "
        "CASE WHEN r.RDB$NULL_FLAG = 1 THEN 'NO' ELSE 'YES' END AS is_nullable FROM RDB$RELATION_FIELDS r JOIN RDB$FIELDS f ON f.RDB$FIELD_NAME = r.RDB$FIELD_SOURCE JOIN RDB$RELATIONS t ON t.RDB$RELATION_NAME = r.RDB$RELATION_NAME WHERE t.RDB$SYSTEM_FLAG = 0 AND t.RDB$VIEW_BLR IS NULL",
        "keys": "SELECT TRIM(c.RDB$RELATION_NAME) AS table_name, TRIM(c.RDB$CONSTRAINT_NAME) AS constraint_name, TRIM(c.RDB$CONSTRAINT_TYPE) AS constraint_type, TRIM(s.RDB$FIELD_NAME) AS column_name, s.RDB$FIELD_POSITION AS ordinal_position, TRIM(u.RDB$RELATION_NAME) AS referenced_table_name, TRIM(v.RDB$FIELD_NAME) AS referenced_column_name "
        "FROM RDB$RELATION_CONSTRAINTS c JOIN RDB$INDEX_SEGMENTS s ON s.RDB$INDEX_NAME = c.RDB$INDEX_NAME LEFT JOIN RDB$REF_CONSTRAINTS r ON r.RDB$CONSTRAINT_NAME = c.RDB$CONSTRAINT_NAME LEFT JOIN RDB$RELATION_CONSTRAINTS u ON u.RDB$CONSTRAINT_NAME = r.RDB$CONST_NAME_UQ "
        "LEFT JOIN RDB$INDEX_SEGMENTS v ON v.RDB$INDEX_NAME = u.RDB$INDEX_NAME AND v.RDB$FIELD_POSITION = s.RDB$FIELD_POSITION WHERE c.RDB$CONSTRAINT_TYPE IN ('PRIMARY KEY', 'UNIQUE', 'FOREIGN KEY')",
        "indexes": "SELECT TRIM(i.RDB$RELATION_NAME) AS table_name, TRIM(i.RDB$INDEX_NAME) AS index_name, CASE WHEN i.RDB$UNIQUE_FLAG = 1 THEN 'YES' ELSE 'NO' END AS is_unique, TRIM(s.RDB$FIELD_NAME) AS column_name, s.RDB$FIELD_POSITION AS ordinal_position, CAST(NULL AS VARCHAR(1)) AS filter_condition FROM RDB$INDICES i JOIN RDB$INDEX_SEGMENTS s ON s.RDB$INDEX_NAME = i.RDB$INDEX_NAME LEFT JOIN RDB$RELATION_CONSTRAINTS c ON c.RDB$INDEX_NAME = i.RDB$INDEX_NAME WHERE c.RDB$CONSTRAINT_TYPE IS NULL AND i.RDB$SYSTEM_FLAG = 0",
        "views": "SELECT TRIM(RDB$RELATION_NAME) AS view_name, RDB$VIEW_SOURCE AS definition, 'NO' AS is_materialized FROM RDB$RELATIONS WHERE RDB$SYSTEM_FLAG = 0 AND RDB$VIEW_BLR IS NOT NULL",
        "routines": "SELECT TRIM(RDB$PROCEDURE_NAME) AS routine_name, 'PROCEDURE' AS routine_type, RDB$PROCEDURE_SOURCE AS definition, CAST(NULL AS VARCHAR(1)) AS return_type FROM RDB$PROCEDURES WHERE RDB$SYSTEM_FLAG = 0",
        "triggers": "SELECT TRIM(RDB$TRIGGER_NAME) AS trigger_name, TRIM(RDB$RELATION_NAME) AS table_name, CAST(RDB$TRIGGER_TYPE AS VARCHAR(10)) AS timing, '' AS event, RDB$TRIGGER_SOURCE AS definition FROM RDB$TRIGGERS WHERE RDB$SYSTEM_FLAG = 0 AND RDB$RELATION_NAME IS NOT NULL",
    },
}
ENGINE_MAPS = {"mysql": "mysql_catalog", "postgres": "postgres_catalog", "sqlite": "sqlite_catalog", "sqlserver": "sqlserver", "mongodb": "bson", "spark": "spark"}


def read_catalog(spark: SparkSession, connection: str, what: str = "columns") -> DataFrame:
    """One catalog query over JDBC; the engine's driver must be on Spark's class path."""
    engine, rest = parse_connection(connection)
    if engine not in CATALOG_SQL:
        raise SourceError(f"no catalog query for {engine}")
    return spark.read.format("jdbc").option("url", JDBC[engine] + rest).option("query", CATALOG_SQL[engine][what]).load()


def catalog_frames(columns: DataFrame, engine: str, source_name: str) -> Frames:
    """Frames from catalog rows: table_name, column_name, ordinal_position, native_type, is_nullable (YES or NO).

    Entities are numbered by name and fields by position, in tables of a schema's size.
    """
    tables = columns.select(F.col("table_name").alias("entity_name")).distinct()
    entities = tables.withColumn("entity_idx", (F.row_number().over(Window.orderBy("entity_name")) - 1).cast("int")).withColumn("entity_type", F.lit("table"))
    place = (F.row_number().over(Window.partitionBy("table_name").orderBy("ordinal_position")) - 1).cast("int")
    fields = columns.withColumn("field_idx", place).join(entities, F.col("table_name") == F.col("entity_name")).select(
        "entity_idx", "entity_name", "field_idx", F.col("column_name").alias("field_name"),
        canonical_column(ENGINE_MAPS[engine], F.col("native_type")).alias("type"), (F.upper("is_nullable") == "YES").alias("nullable"),
        F.array().cast("array<struct<constraint_type:string,value:bigint,precision:int,scale:int,default_value:string,expression:string>>").alias("constraints"),
    )
    return Frames(source_name, entities.select("entity_idx", "entity_name", "entity_type"), fields)


def grouped_keys(keys: DataFrame) -> DataFrame:
    """One row per constraint, its columns in order, from catalog rows of single columns."""
    item = F.struct("ordinal_position", "column_name", "referenced_column_name")
    gathered = keys.groupBy("table_name", "constraint_name", "constraint_type").agg(F.array_sort(F.collect_set(item)).alias("c"), F.first("referenced_table_name", ignorenulls=True).alias("referenced_table"))
    return gathered.select(
        "table_name", "constraint_name", F.lower(F.regexp_extract("constraint_type", r"^(\w+)", 1)).alias("key_type"),
        F.transform("c", lambda x: x["column_name"]).alias("field_names"), "referenced_table", F.transform("c", lambda x: x["referenced_column_name"]).alias("referenced_fields"),
    )


def firebird_native(text: str) -> CanonicalType:
    """The type of ``code/subtype/precision/scale``."""
    code, sub_type, precision, scale = map(int, text.split("/"))
    return firebird_type(code, sub_type, precision, scale)


def catalog_source(engine: str, name: str, rows: dict[str, DataFrame]) -> Source:
    """A schema from the rows of the catalog queries by kind; each is collected once and has a schema's size.

    Tables come by name and fields, keys and indexes by position.  ``rows`` may lack kinds
    that an engine has not.
    """
    got = {k: [r.asDict() for r in df.toDF(*[c.lower() for c in df.columns]).collect()] for k, df in rows.items() if k != "keys"}
    native = firebird_native if engine == "firebird" else lambda t: canonical(ENGINE_MAPS[engine], t)
    entities: dict[str, Entity] = {}
    for c in sorted(got["columns"], key=lambda c: (c["table_name"], c["ordinal_position"])):
        entity = entities.setdefault(c["table_name"], Entity(c["table_name"], "table"))
        entity.fields.append(Field(c["column_name"], native(c["native_type"]), c["is_nullable"].upper() == "YES"))
    keys = [r.asDict() for r in grouped_keys(rows["keys"]).collect()] if "keys" in rows else []
    order = {"primary": 0, "unique": 1, "foreign": 2}
    for k in sorted(keys, key=lambda k: (order[k["key_type"]], k["constraint_name"])):
        if k["table_name"] in entities:
            refers = {"referenced_table": k["referenced_table"], "referenced_columns": ", ".join(k["referenced_fields"])} if k["key_type"] == "foreign" else {}
            entities[k["table_name"]].keys.append(Key(k["key_type"], k["field_names"], refers))
    parts: dict[tuple, list] = {}
    for i in sorted(got.get("indexes", []), key=lambda i: (i["table_name"], i["index_name"], i["ordinal_position"])):
        parts.setdefault((i["table_name"], i["index_name"], i["is_unique"], i["filter_condition"]), []).append(i["column_name"])
    for (table, index, unique, condition), columns in parts.items():
        if table in entities:
            entities[table].indexes.append(Index(index, "unique" if unique == "YES" else "regular", columns, condition))
    views = [View(v["view_name"], v["definition"], [], v["is_materialized"] == "YES") for v in sorted(got.get("views", []), key=lambda v: v["view_name"])]
    routines = [Procedure(p["routine_name"], (p["routine_type"] or "PROCEDURE").lower(), p["definition"], [], p["return_type"]) for p in sorted(got.get("routines", []), key=lambda p: p["routine_name"])]
    triggers = []
    for t in sorted(got.get("triggers", []), key=lambda t: (t["trigger_name"], t["event"])):
        timing, event = firebird_trigger(int(t["timing"])) if engine == "firebird" else (t["timing"], t["event"])
        triggers.append(Trigger(t["trigger_name"], t["table_name"], timing, event, t["definition"]))
    return Source(name, engine, list(entities.values()), views, routines, triggers)


#: Type tags of a value, by its type as a variant, and of values that extended JSON writes as an object of one key.
VARIANT_TAGS = {"VOID": "null", "BOOLEAN": "boolean", "BIGINT": "int64", "DOUBLE": "double", "STRING": "string"}
EXTENDED_TAGS = {
    "oid": "objectid", "date": "datetime", "timestamp": "timestamp", "binary": "binary", "numberInt": "int32", "numberLong": "int64", "numberDouble": "double", "numberDecimal": "decimal128",
    "regularExpression": "regex", "code": "javascript", "symbol": "symbol", "undefined": "undefined", "minKey": "minkey", "maxKey": "maxkey", "dbPointer": "dbpointer",
}


def variant_tag(kind: Column) -> Column:
    """The tag for the type of a variant, as ``schema_of_variant`` writes it; decimals are how a variant holds plain fractions, and so doubles."""
    tag = F.when(kind.isNull(), "null")
    for name, said in VARIANT_TAGS.items():
        tag = tag.when(kind == name, said)
    table = F.create_map(*[F.lit(x) for pair in EXTENDED_TAGS.items() for x in pair])
    tag = tag.when(kind.startswith("OBJECT<"), F.coalesce(table[F.regexp_extract(kind, r"^OBJECT<`?\$(\w+)`?: ", 1)], F.lit("object")))
    return tag.when(kind.startswith("DECIMAL") | (kind == "FLOAT"), "double").when(kind.startswith("ARRAY"), "array").otherwise(F.lower(kind))


def infer_documents(docs: DataFrame, column: str, sample_size: int | None = 100) -> DataFrame:
    """Fields of JSON documents: field_name, type, nullable, seen, nulls.

    The first ``sample_size`` documents (1 to 10 000) or, for None, all of them.  A field of
    several types is unknown, and one that is null or missing somewhere is nullable.
    """
    if sample_size is not None:
        if not 1 <= sample_size <= 10_000:
            raise SourceError("the sample must have 1 to 10000 documents")
        docs = docs.limit(sample_size)
    # the documents are read once: each has one row with its first field, or one without a field
    entries = docs.select(F.posexplode_outer(F.try_parse_json(column).cast("map<string,variant>")).alias("pos", "field_name", "value"))
    tagged = entries.select("pos", "field_name", F.schema_of_variant("value").alias("kind")).select("pos", "field_name", variant_tag(F.col("kind")).alias("tag"))
    counted = tagged.groupBy("field_name").agg(
        F.array_sort(F.collect_set(F.when(F.col("tag") != "null", F.col("tag")))).alias("tags"), F.count("*").alias("seen"), F.count_if(F.col("tag") == "null").alias("nulls"),
        F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("documents"),
    )
    total = F.sum("documents").over(Window.partitionBy())  # one row for each field
    grouped = counted.withColumn("total", total).where("field_name is not null")
    unknown = lambda text: F.struct(F.lit("unknown").alias("tag"), F.lit(None).cast("int").alias("precision"), F.lit(None).cast("int").alias("scale"), text.alias("original"))
    kind = F.when(F.size("tags") == 1, canonical_column("bson", F.get("tags", 0))).when(F.size("tags") == 0, unknown(F.lit("null"))).otherwise(unknown(F.concat(F.lit("mixed: "), F.array_join("tags", ", "))))
    return grouped.select("field_name", kind.alias("type"), ((F.col("nulls") > 0) | (F.col("seen") < F.col("total"))).alias("nullable"), "seen", "nulls")


def from_dataframes(tables: dict[str, DataFrame], source_name: str = "spark") -> Source:
    """The schemas of DataFrames, in the given order; nothing is read but the schemas."""
    entities = []
    for name, df in tables.items():
        fields = [Field(f.name, canonical("spark", f.dataType.simpleString()), f.nullable) for f in df.schema.fields]
        entities.append(Entity(name, "table", fields))
    return Source(source_name, "spark", entities)


def load_spark_catalog(spark: SparkSession, database: str | None = None) -> Source:
    found = sorted(t.name for t in spark.catalog.listTables(database))
    return from_dataframes({t: spark.table(f"{database}.{t}" if database else t) for t in found}, database or "default")


def load_documents(docs: dict[str, DataFrame], column: str, name: str, sample_size: int | None = 100) -> Source:
    """A document store's schema from DataFrames with a column of JSON text, one for each collection; ``_id`` is the key where it occurs."""
    entities = []
    for collection, df in sorted(docs.items()):
        found = infer_documents(df, column, sample_size).orderBy("field_name").collect()
        fields = [Field(r.field_name, CanonicalType(*r.type), r.nullable) for r in found]
        keys = [Key("primary", ["_id"])] if any(f.field_name == "_id" for f in fields) else []
        entities.append(Entity(collection, "collection", fields, keys))
    return Source(name, "mongodb", entities)


def load_database(spark: SparkSession, connection: str) -> Source:
    """The whole schema behind a connection string; engines other than SQLite need their JDBC driver on Spark's class path."""
    engine, rest = parse_connection(connection)
    if engine == "sqlite":
        return load_sqlite(rest)
    if engine in CATALOG_SQL:
        return catalog_source(engine, re.split(r"[/\\]", rest)[-1].split("?")[0], {kind: read_catalog(spark, connection, kind) for kind in CATALOG_SQL[engine]})
    if engine.startswith("mongodb"):
        raise SourceError("no driver for document stores is bundled: give their documents to load_documents")
    raise SourceError(f"no connector for {engine}")
