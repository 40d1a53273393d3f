"""The schema model: plain records with a JSON form, and the DataFrames that operators work on."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from loomline.functions.types import TYPE_STRUCT, CanonicalType

IR_VERSION = "1.0.0"

CONSTRAINT = "struct<constraint_type:string,value:bigint,precision:int,scale:int,default_value:string,expression:string>"
ENTITY_SCHEMA = "entity_idx int, entity_name string, entity_type string"
FIELD_SCHEMA = f"entity_idx int, entity_name string, field_idx int, field_name string, type {TYPE_STRUCT}, nullable boolean, constraints array<{CONSTRAINT}>"
KEY_SCHEMA = "entity_idx int, key_type string, field_names array<string>, metadata map<string,string>"
INDEX_SCHEMA = "entity_idx int, index_name string, index_type string, field_names array<string>, filter_condition string"


def _shaped(value: object, kind: DataType) -> object:
    """Tuples of structs as dicts, as Arrow takes them."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return {f.name: _shaped(v, f.dataType) for f, v in zip(kind.fields, value, strict=True)}
    if isinstance(kind, ArrayType):
        return [_shaped(v, kind.elementType) for v in value]
    return list(value.items()) if isinstance(kind, MapType) else value


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of a few rows that the planner knows: what is computed from it alone needs no job."""
    kind = StructType.fromDDL(schema)
    columns = [pa.array([_shaped(r[i], f.dataType) for r in rows], a.type) for i, (f, a) in enumerate(zip(kind.fields, to_arrow_schema(kind), strict=True))]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=to_arrow_schema(kind)))


def _filled(data: dict) -> dict:
    """Without empty lists and maps and absent values, as the JSON form omits them."""
    return {k: v for k, v in data.items() if v not in (None, [], {}, ())}


@dataclass
class Constraint:
    """MaxLength, MinLength, Precision, Unique, DefaultValue or Check."""

    constraint_type: str
    value: object = None
    precision: int | None = None
    scale: int | None = None
    expression: str | None = None

    def to_json(self) -> dict:
        return {"constraint_type": self.constraint_type} | _filled({"value": self.value, "precision": self.precision, "scale": self.scale, "expression": self.expression})

    def as_row(self) -> tuple:
        default = self.constraint_type == "DefaultValue"
        return (self.constraint_type, self.value if isinstance(self.value, int) and not default else None, self.precision, self.scale, json.dumps(self.value) if default else None, self.expression)


@dataclass
class Field:
    field_name: str
    canonical_type: CanonicalType
    nullable: bool = False
    constraints: list[Constraint] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)

    def to_json(self) -> dict:
        head = {"field_name": self.field_name, "canonical_type": self.canonical_type.to_json(), "nullable": self.nullable}
        return head | _filled({"constraints": [c.to_json() for c in self.constraints], "metadata": self.metadata})


@dataclass
class Key:
    """primary, unique or foreign."""

    key_type: str
    field_names: list[str]
    metadata: dict = field(default_factory=dict)

    def to_json(self) -> dict:
        return {"key_type": self.key_type, "field_names": self.field_names} | _filled({"metadata": self.metadata})


@dataclass
class Index:
    """regular, unique, fulltext or spatial."""

    index_name: str
    index_type: str
    field_names: list[str]
    filter_condition: str | None = None
    metadata: dict = field(default_factory=dict)

    def to_json(self) -> dict:
        head = {"index_name": self.index_name, "index_type": self.index_type, "field_names": self.field_names}
        return head | _filled({"filter_condition": self.filter_condition, "metadata": self.metadata})


@dataclass
class View:
    view_name: str
    definition: str | None = None
    field_names: list[str] = field(default_factory=list)
    is_materialized: bool = False
    metadata: dict = field(default_factory=dict)

    def to_json(self) -> dict:
        return {"view_name": self.view_name, "is_materialized": self.is_materialized} | _filled({"definition": self.definition, "field_names": self.field_names, "metadata": self.metadata})


@dataclass
class Procedure:
    name: str
    procedure_type: str
    definition: str | None = None
    parameters: list[str] = field(default_factory=list)
    return_type: str | None = None

    def to_json(self) -> dict:
        return {"name": self.name, "procedure_type": self.procedure_type} | _filled({"definition": self.definition, "parameters": self.parameters, "return_type": self.return_type})


@dataclass
class Trigger:
    trigger_name: str
    table_name: str
    timing: str
    event: str
    definition: str | None = None

    def to_json(self) -> dict:
        return {"trigger_name": self.trigger_name, "table_name": self.table_name, "timing": self.timing, "event": self.event} | _filled({"definition": self.definition})


@dataclass
class Entity:
    entity_name: str
    entity_type: str = "table"
    fields: list[Field] = field(default_factory=list)
    keys: list[Key] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)

    def find_field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.field_name == name), None)

    def to_json(self) -> dict:
        parts = {k: [x.to_json() for x in getattr(self, k)] for k in ("fields", "keys", "indexes")}
        return {"entity_name": self.entity_name, "entity_type": self.entity_type} | _filled(parts | {"metadata": self.metadata})


@dataclass
class Source:
    source_name: str
    source_type: str
    entities: list[Entity] = field(default_factory=list)
    views: list[View] = field(default_factory=list)
    stored_procedures: list[Procedure] = field(default_factory=list)
    triggers: list[Trigger] = field(default_factory=list)
    ir_version: str = IR_VERSION
    metadata: dict = field(default_factory=dict)

    def find_entity(self, name: str) -> Entity | None:
        return next((e for e in self.entities if e.entity_name == name), None)

    def to_dict(self) -> dict:
        lists = {k: [x.to_json() for x in getattr(self, k)] for k in ("views", "stored_procedures", "triggers")}
        head = {"source_name": self.source_name, "source_type": self.source_type, "entities": [e.to_json() for e in self.entities]}
        return head | _filled(lists) | {"ir_version": self.ir_version} | _filled({"metadata": self.metadata})

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Source:
        d = json.loads(text)

        def read_field(f: dict) -> Field:
            return Field(f["field_name"], CanonicalType.from_json(f["canonical_type"]), f.get("nullable", False), [Constraint(**c) for c in f.get("constraints", [])], f.get("metadata", {}))

        def read_entity(e: dict) -> Entity:
            return Entity(e["entity_name"], e.get("entity_type", "table"), [read_field(f) for f in e.get("fields", [])], [Key(**k) for k in e.get("keys", [])], [Index(**i) for i in e.get("indexes", [])], e.get("metadata", {}))

        return Source(
            d["source_name"], d["source_type"], [read_entity(e) for e in d.get("entities", [])], [View(**v) for v in d.get("views", [])],
            [Procedure(**p) for p in d.get("stored_procedures", [])], [Trigger(**t) for t in d.get("triggers", [])], d.get("ir_version", IR_VERSION), d.get("metadata", {}),
        )

    def frames(self, spark: SparkSession) -> Frames:
        entities = [(i, e.entity_name, e.entity_type) for i, e in enumerate(self.entities)]
        fields = [
            (i, e.entity_name, j, f.field_name, f.canonical_type.as_row(), f.nullable, [c.as_row() for c in f.constraints])
            for i, e in enumerate(self.entities) for j, f in enumerate(e.fields)
        ]
        return Frames(self.source_name, local_frame(spark, entities, ENTITY_SCHEMA), local_frame(spark, fields, FIELD_SCHEMA))

    def key_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, k.key_type, k.field_names, {a: str(b) for a, b in k.metadata.items()}) for i, e in enumerate(self.entities) for k in e.keys]
        return local_frame(spark, rows, KEY_SCHEMA)

    def index_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, x.index_name, x.index_type, x.field_names, x.filter_condition) for i, e in enumerate(self.entities) for x in e.indexes]
        return local_frame(spark, rows, INDEX_SCHEMA)


@dataclass
class Frames:
    """A schema as two relations: entities, and fields with their entity and place."""

    source_name: str
    entities: DataFrame
    fields: DataFrame
