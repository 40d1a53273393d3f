"""The schema engine against fixed expectations, and its queries against SQL."""

from __future__ import annotations

import json
import math
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from loomline import queries as Q
from loomline.functions import names
from loomline.functions.typemaps import ENGINES, canonical, canonical_column, firebird_type
from loomline.functions.types import CanonicalType, compare_types, type_name
from loomline.ir import Constraint, Entity, Field, Source
from loomline.operators import resolve
from loomline.operators.compare import best_matches, compare
from loomline.plans.config import CompareConfig, ResolutionConfig, SemanticConfig, Settings
from loomline.sources import databases, files

DATA = "/root/testdata/sf0.001"
T = CanonicalType


def source(name: str, **entities) -> Source:
    """entity=[(field, type, nullable, constraints...)]"""
    return Source(name, "test", [Entity(e, fields=[Field(f[0], T(f[1]), len(f) > 2 and f[2], list(f[3:])) for f in fs]) for e, fs in entities.items()])


def counts(spark, a: Source, b: Source, config: CompareConfig = CompareConfig()) -> tuple[int, int, int]:
    c = compare(a.frames(spark), b.frames(spark), config)
    return c.all_matches.count(), c.exclusives.count(), c.conflicts.count()


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_queries_equal_sql(spark, name):
    got = Q.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(str([r[c] for c in columns]) for r in got.collect())
    con = duckdb.connect()
    for t in Q.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(Q.oracle_sql()[name])
    order = [want.columns.index(c) for c in columns]
    assert rows and rows == sorted(str([r[i] for i in order]) for r in want.fetchall())


def test_scenarios(spark):
    u = [("id", "int32"), ("email", "string"), ("name", "string", True), ("created_at", "timestamp"), ("is_active", "boolean")]
    assert counts(spark, source("a", users=u), source("b", users=u)) == (6, 0, 0)
    a = source("a", users=[("id", "int32"), ("email", "string")], posts=[("id", "int32"), ("title", "string")])
    b = source("b", users=[("id", "int32"), ("email", "string"), ("phone", "string", True), ("avatar_url", "string", True)], comments=[("id", "int32"), ("content", "string")])
    assert counts(spark, a, b) == (3, 4, 0)
    a = source("a", products=[("id", "int32"), ("price", "float64"), ("name", "string"), ("stock", "int32"), ("is_available", "boolean")])
    b = source("b", products=[("id", "string"), ("price", "string"), ("name", "text"), ("stock", "int64"), ("is_available", "string")])
    assert counts(spark, a, b) == (6, 0, 3)
    f = [("id", "int32"), ("email", "string"), ("name", "string")]
    assert counts(spark, source("a", users=f), source("b", users=[f[0], (*f[1], True), (*f[2], True)])) == (4, 0, 2)
    a = source("a", users=[("email", "string", False, Constraint("Unique"), Constraint("MaxLength", 255)), ("username", "string", False, Constraint("Unique"))])
    b = source("b", users=[("email", "string", False, Constraint("MaxLength", 100)), ("username", "string")])
    assert counts(spark, a, b) == (3, 0, 3)
    assert counts(spark, source("a", users=[("id", "int32"), ("FirstName", "string")]), source("b", users=[("id", "int32"), ("first_name", "int32")])) == (3, 0, 1)
    a, b = source("a", UserTable=[("userId", "int32"), ("firstName", "string"), ("lastName", "string")]), source("b", user_table=[("user_id", "int32"), ("first_name", "string"), ("last_name", "string")])
    assert counts(spark, a, b) == (4, 0, 0)
    c = compare(source("a", users=[("id", "int32"), ("email", "string"), ("password", "string")]).frames(spark), source("b", users=[("id", "int32"), ("email", "string"), ("phone", "string")]).frames(spark))
    assert (c.unified_entities.count(), c.unified_fields.count()) == (1, 4)


def test_collisions_and_renames(spark):
    off = CompareConfig(normalized_matching=False, semantic=SemanticConfig(enabled=False))
    c = compare(source("a", users=[("FirstName", "string")]).frames(spark), source("b", users=[("first_name", "string")]).frames(spark), off)
    found = c.conflicts.collect()
    assert [(r.conflict_type, r.severity, r.from_a) for r in found] == [("normalization_collision", "critical", "Field 'FirstName' normalizes to 'first_name'")]
    made = [r.args.suggested_name for r in resolve.suggest(c.conflicts).orderBy("no").collect()]
    assert made == ["firstname_a", "first_name_b", "firstname_src_a"]


SCORES = [
    ("User", "users", 0.9625), ("UserProfile", "user_profile", 1.0), ("user_table", "users_tbl", 0.9625), ("order_num", "order_no", 0.8212), ("user_id", "user_identifier", 0.7965),
    ("sales_order", "order_sales", 0.7709), ("order_date", "orderDateTime", 0.7364), ("id", "identifier", 0.6817), ("email", "emailAddress", 0.5676), ("adress", "address", 0.3886),
    ("email", "e_mail", 0.3650), ("telephone", "phone", 0.2168), ("price", "unit_price", 0.4550), ("movies", "movie", 0.4400), ("users", "sessions", 0.1975), ("user", "product", 0.1393), ("tbl", "tmp", 0.6970),
]


def test_scores(spark):
    from loomline.operators.compare import prepared

    df = spark.createDataFrame([(a, b, s) for a, b, s in SCORES], "a string, b string, want double")
    config = CompareConfig()
    left = prepared(df, "a", config).withColumnRenamed("n", "n_a")
    both = prepared(left, "b", config).withColumnRenamed("n", "n_b")
    for r in both.select("a", "b", "want", names.semantic_score(F.col("n_a"), F.col("n_b"), SemanticConfig()).alias("s")).collect():
        assert math.isclose(r.s.score, r.want, abs_tol=1e-4), (r.a, r.b, r.s)


def test_blocking_loses_no_match(spark):
    import random

    r = random.Random(1)
    pool = ["user", "users", "id", "identifier", "order", "orders", "no", "num", "tmp", "tbl", "date", "Time", "price"]
    sides = []
    for n in "ab":
        fields = sorted({"_".join(r.choice(pool) for _ in range(r.randint(1, 3))) for _ in range(60)})
        sides.append(source(n, t=[(f, "string") for f in fields]).frames(spark))
    from dataclasses import replace

    from loomline.operators import compare as module

    probable = replace(CompareConfig(), semantic=SemanticConfig(allow_probable_as_match=True))
    loose = replace(probable, semantic=replace(probable.semantic, weight_token=0.0))
    for config in (CompareConfig(), probable, loose, CompareConfig.all_features(), replace(CompareConfig.all_features(), semantic=SemanticConfig(enabled=False))):
        found = []
        for keys in (module._keys, lambda *_: F.array(F.lit("*"))):
            own, module._keys = module._keys, keys
            try:
                c = compare(*sides, config)
                found.append({(x.index_a, x.index_b, round(x.score, 9)) for x in c.field_matches.collect()})
            finally:
                module._keys = own
        assert found[0] == found[1] and len(found[0]) > 30
    assert best_matches(c.field_matches, ["entity_a", "entity_b"], "index_a", "index_b").count() <= 60


def test_names(spark):
    column = lambda f, x: spark.createDataFrame([(v,) for v in x], "x string").select(f(F.col("x"))).collect()
    ids = {"FirstName": "first_name", " user-name ": "user_name", "a__b": "a_b", "X.y/z": "x_y_z", "userID2Go": "user_id2_go", "café": "caf", "_a_": "a"}
    assert [r[0] for r in column(names.normalize_identifier, ids)] == list(ids.values())
    plural = {"categories": "category", "knives": "knife", "addresses": "address", "boxes": "box", "branches": "branch", "potatoes": "potato", "class": "class", "status": "status", "analysis": "analysis", "people": "person", "movies": "movy", "wolves": "wolfe", "buses": "buse", "days": "day", "as": "as"}
    assert [r[0] for r in column(names.singular, plural)] == list(plural.values())
    assert [r[0] for r in column(lambda c: names.singular(c, "es"), ["usuarios", "es"])] == ["usuario", "es"]
    assert [r[0] for r in column(names.stemmed, ["running", "used", "loader", "quickly", "red"])] == ["runn", "used", "load", "quick", "red"]
    tokens = [r[0] for r in column(lambda c: names.semantic_tokens(c, SemanticConfig()), ["Straße_naïveTable", "tbl", "OrderÉtat"])]
    assert tokens == [["strasse", "naive"], [], ["order", "etat"]]
    assert names.damerau_levenshtein("ca", "abc") == 2 and names.damerau_levenshtein("ab", "ba") == 1
    assert math.isclose(names.jaro_winkler("martha", "marhta"), 0.961111, abs_tol=1e-6)


def test_types(spark):
    pairs = [("int64", "float32", "incompatible"), ("float32", "int64", "incompatible"), ("boolean", "int64", "incompatible"), ("int32", "int64", "widening_safe"), ("string", "text", "compatible"), ("int64", "int32", "requires_cast")]
    for a, b, want in pairs:
        got = spark.range(1).select(compare_types(*[F.struct(F.lit(t).alias("tag"), *[F.lit(None).cast("int").alias(c) for c in ("precision", "scale")], F.lit(None).cast("string").alias("original")) for t in (a, b)])).first()[0]
        assert got == want, (a, b)
    assert T("decimal", 10, 2).name == "Decimal(10, 2)" and T("unknown", original="X").name == "Unknown(X)"
    assert T.from_json({"type": "decimal", "precision": 5, "scale": 1}).to_json() == {"type": "decimal", "precision": 5, "scale": 1}


MAPS = [
    ("mysql", "TINYINT(1)", "Boolean"), ("mysql", "decimal(12,3)", "Decimal(12, 3)"), ("mysql", "decimal(12)", "Decimal(10, 0)"), ("postgres", "timestamp with time zone", "DateTime"),
    ("postgres", "numeric", "Decimal(38, 10)"), ("sqlite", "varchar(9)", "Text"), ("ddl", "TEXT", "String"), ("ddl", "TINYINT", "Unknown(TINYINT)"), ("ddl", "DECIMAL(8,1)", "Decimal(10, 2)"),
    ("sqlite_catalog", "POINT", "Int64"), ("sqlite_catalog", "", "Unknown(NONE)"), ("sqlite_catalog", "DECIMAL(10,2)", "Decimal(10, 2)"), ("sqlite_catalog", "DATETIME", "DateTime"),
    ("mysql_catalog", "decimal(12)", "Decimal(12, 0)"), ("mysql_catalog", "enum('a')", "String"), ("postgres_catalog", "timestamp with time zone", "Timestamp"), ("postgres_catalog", "numeric(7,2)", "Decimal(7, 2)"),
    ("postgres_catalog", "double precision", "Float64"), ("postgres_catalog", "int4[]", "Unknown(int4[])"), ("sqlserver", "nvarchar(max)", "Text"), ("sqlserver", "money", "Decimal(19, 4)"),
    ("sqlserver", "hierarchyid", "Unknown(SQL Server type: hierarchyid)"), ("bson", "objectid", "String"), ("bson", "decimal128", "Decimal(34, 0)"), ("spark", "array<float>", "Json"), ("spark", "timestamp_ntz", "DateTime"), ("spark", "decimal(5,1)", "Decimal(5, 1)"),
]


def test_type_maps(spark):
    for engine, native, want in MAPS:
        assert canonical(engine, native).name == want, (engine, native)
    for engine in ENGINES:
        own = [(n, w) for e, n, w in MAPS if e == engine]
        if own:
            df = spark.createDataFrame(own, "n string, want string")
            for r in df.select("n", "want", type_name(canonical_column(engine, F.col("n"))).alias("got")).collect():
                assert r.got == r.want, (engine, r)
    assert firebird_type(8, scale=-2, precision=9).name == "Decimal(9, 2)" and firebird_type(261, 1).name == "Text" and firebird_type(99).name == "Unknown(Firebird type code: 99)"
    assert canonical("oracle", "X").name == "Unknown(X)"


def test_cast_rules(spark):
    cases = [("Int64", "Float32", "safe"), ("Float32", "Int64", "Loss of decimal precision"), ("bigint", "int", "Potential overflow if values exceed target range"), ("int8", "bigint", "safe"), ("varchar", "text", "safe"), ("text", "varchar", "Potential truncation of long text"), ("String", "Boolean", None)]
    df = spark.createDataFrame([c[:2] for c in cases], "a string, b string")
    got = [r[0] for r in df.select(resolve.cast_safety(F.col("a"), F.col("b"))).collect()]
    assert [g and ("safe" if g.safe else g.note) for g in got] == [c[2] for c in cases]


def test_files_and_golden_report(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a/users.csv").write_text("id,name,email,age,active\n1,A,a@x,3,true\n")
    person = {"id": 1, "name": "A", "email": "a@x", "age": 3, "active": True, "score": 1.5}
    (tmp_path / "b/users.json").write_text(json.dumps([person, person]))
    a, b = files.load_file(str(tmp_path / "a/users.csv")), files.load_file(str(tmp_path / "b/users.json"))
    assert [f.field_name for f in b.entities[0].fields] == list(person) and a.entities[0].fields[0].nullable
    from loomline.report import Result

    r = Result(compare(a.frames(spark), b.frames(spark)))
    m = r.metrics
    assert (m["total_matches"], m["total_exclusives"], m["total_conflicts"], m["risk_level"]) == (6, 1, 3, "High")
    text = r.markdown()
    for line in ("- **Compatibility Score**: 66.7%", "**Overall Risk Level**: 🔥 **High**", "- Conflict rate is 33.3% (above 25% threshold)", "| users | 3 | 🔥 High |", "| users | active | semantic_match | 1.00 | 4 | 4 |",
                 "| users | score | B | ✅ Yes | 5 |", '- **Kind**: NoSuggestion { reason: "Type incompatibility between String and Boolean cannot be automatically resolved" }', "- **Suggestion**: sug_2 (users::active)", "- 🔥 Address 3 high-severity conflict(s) before auto-unification"):
        assert line in text.split("\n"), line
    written = r.write(str(tmp_path / "out"), lambda _: True)
    assert [p.name for p in written] == ["unified_schema.json", "diff.json", "decision_log.json", "report.md", "report.json"]
    assert len(json.loads(written[0].read_text())["entities"][0]["fields"]) == 6
    strict = Result(compare(a.frames(spark), b.frames(spark)), ResolutionConfig(resolve_unresolvable=False))
    assert strict.decisions == [] and "3 conflict(s) remain" in strict.markdown()

    from loomline.cli import main

    assert main(["compare", "--source-a", str(tmp_path / "a/users.csv"), "--source-b", f"file:{tmp_path}/b/users.json", "--out", str(tmp_path / "cli")]) == 0
    assert main(["load", "--source", str(tmp_path / "none.txt")]) == 1
    assert main(["generate-config", "--out", str(tmp_path / "c.toml")]) == 0
    assert Settings.load(str(tmp_path / "c.toml")).resolution_config().decision_id_prefix == "auto_dec"


def test_xml_ddl_and_urls(tmp_path):
    xml = "<users><record id='1'><id>1</id><name>A</name><x/></record><record><email>e</email></record></users>"
    assert files.xml_fields(xml) == ["id_attr", "id", "name", "email"]
    ddl = """-- note (a, b)
    CREATE TABLE users (id INT PRIMARY KEY, name VARCHAR(9) NOT NULL, email TEXT UNIQUE, created_at TIMESTAMP);
    create table if not exists `posts` (id INT, user_id INT NOT NULL, d DOUBLE PRECISION, PRIMARY KEY (id), FOREIGN KEY (user_id) REFERENCES users(id));"""
    users, posts = files.parse_ddl(ddl)
    assert [(f.field_name, f.canonical_type.name, f.nullable) for f in users.fields] == [("id", "Int32", False), ("name", "String", False), ("email", "String", True), ("created_at", "Timestamp", True)]
    assert users.fields[2].constraints[0].constraint_type == "Unique" and posts.keys[0].field_names == ["id"] and [f.canonical_type.name for f in posts.fields] == ["Int32", "Int32", "Float64"]
    assert files.url_format("http://x/a.CSV?b=1") == "csv" and files.export_url("https://docs.google.com/spreadsheets/d/K/edit") == "https://docs.google.com/spreadsheets/d/K/export?format=csv"
    for bad in ("http://localhost/a.csv", "http://172.20.1.1/a.csv", "ftp://x/a.csv"):
        with pytest.raises(files.SourceError):
            files.check_url(bad)
    got = files.load_url("http://x.org/t.csv", fetch=lambda url: b"p,q\n")
    assert (got.source_name, got.source_type, len(got.entities[0].fields)) == ("remote:http://x.org/t.csv", "remote_csv", 2)
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(files.EmptyData):
        files.load_file(str(tmp_path / "e.json"))


def test_databases(spark, tmp_path):
    path = str(tmp_path / "shop.db")
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE users (id INTEGER PRIMARY KEY, n TEXT NOT NULL, p DECIMAL(10,2)); CREATE TABLE orders (id INTEGER PRIMARY KEY, user_id INTEGER REFERENCES users(id)); CREATE UNIQUE INDEX ix ON users(n); CREATE VIEW v AS SELECT id FROM users; CREATE TRIGGER t AFTER INSERT ON users BEGIN SELECT 1; END;")
    db.close()
    got = databases.load_database(spark, f"sqlite://{path}")
    users = got.find_entity("users")
    assert [f.canonical_type.name for f in users.fields] == ["Int64", "Text", "Decimal(10, 2)"] and {k.key_type for k in users.keys} == {"primary", "unique"}
    assert got.find_entity("orders").keys[1].metadata["referenced_table"] == "users" and got.views[0].field_names == ["id"] and (got.triggers[0].timing, got.triggers[0].event) == ("AFTER", "INSERT")
    assert Source.from_json(got.to_json()).to_json() == got.to_json()
    columns = spark.createDataFrame([("t", "b", 2, "varchar(3)", "YES"), ("t", "a", 1, "bigint", "NO")], "table_name string, column_name string, ordinal_position int, native_type string, is_nullable string")
    frames = databases.catalog_frames(columns, "mysql", "m")
    assert [(r.field_name, r.type.tag, r.nullable) for r in frames.fields.orderBy("field_idx").collect()] == [("a", "int64", False), ("b", "string", True)]
    keys = spark.createDataFrame([("t", "fk", "FOREIGN KEY", "y", 2, "u", "q"), ("t", "fk", "FOREIGN KEY", "x", 1, "u", "p")], "table_name string, constraint_name string, constraint_type string, column_name string, ordinal_position int, referenced_table_name string, referenced_column_name string")
    assert tuple(databases.grouped_keys(keys).first())[2:] == ("foreign", ["x", "y"], "u", ["p", "q"])
    assert databases.parse_connection("mariadb://u@h/d") == ("mysql", "u@h/d") and databases.database_name("mongodb://h:1/shop?x=1") == "shop"
    assert databases.firebird_trigger(18) == ("AFTER", "INSERT OR UPDATE") and not databases.is_safe_identifier("1a;")
    docs = spark.createDataFrame([('{"a": 1, "b": "x", "c": null}',), ('{"a": 2.5, "b": "y", "c": null, "d": [1]}',)], "j string")
    found = {r.field_name: (r.t, r.nullable) for r in databases.infer_documents(docs, "j").select("field_name", type_name(F.col("type")).alias("t"), "nullable").collect()}
    assert found == {"a": ("Unknown(mixed: double, int64)", False), "b": ("String", False), "c": ("Unknown(null)", True), "d": ("Json", True)}


def test_drift(spark, tmp_path):
    from loomline.streaming.drift import watch

    docs = spark.createDataFrame([('{"a": 1, "n": true}',), ('{"a": 2}',)], "j string")
    docs.write.parquet(str(tmp_path / "in"))
    known = databases.infer_documents(spark.createDataFrame([('{"a": "x", "z": 1}',)], "j string"), "j").select("field_name", "type")
    watch(spark.readStream.schema("j string").parquet(str(tmp_path / "in")), "j", known, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert {(r.field_name, r.change) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", "retyped"), ("n", "added"), ("z", "missing")}
