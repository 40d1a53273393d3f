"""Canonical types, their names, and the two compatibility relations, as data and as Columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE_STRUCT = "struct<tag:string,precision:int,scale:int,original:string>"

#: Tags of the wire format and their display names.
DISPLAY = {
    "boolean": "Boolean", "int32": "Int32", "int64": "Int64", "float32": "Float32", "float64": "Float64", "decimal": "Decimal",
    "string": "String", "text": "Text", "binary": "Binary", "date": "Date", "time": "Time", "date_time": "DateTime",
    "timestamp": "Timestamp", "json": "Json", "uuid": "Uuid", "unknown": "Unknown",
}

#: Ordered pairs by verdict; equal types are identical, absent pairs incompatible.
COMPATIBLE = {("string", "text"), ("text", "string"), ("date_time", "timestamp"), ("timestamp", "date_time")}
WIDENING = {("int32", "int64"), ("float32", "float64"), ("date", "date_time"), ("date", "timestamp"), ("int32", "decimal"), ("int64", "decimal")}
CAST = {
    ("int64", "int32"), ("float64", "float32"), ("date_time", "date"), ("timestamp", "date"), ("decimal", "int32"), ("decimal", "int64"),
    ("float32", "decimal"), ("float64", "decimal"), ("decimal", "float32"), ("decimal", "float64"),
    ("int32", "float32"), ("int32", "float64"), ("int64", "float64"), ("float32", "int32"), ("float64", "int32"), ("float64", "int64"),
    ("boolean", "int32"), ("int32", "boolean"),
}
STRICT = COMPATIBLE | {("int32", "int64"), ("float32", "float64")}


@dataclass(frozen=True)
class CanonicalType:
    tag: str
    precision: int | None = None
    scale: int | None = None
    original: str | None = None

    def __post_init__(self) -> None:
        if self.tag not in DISPLAY:
            raise ValueError(f"unknown type tag {self.tag!r}")

    @property
    def name(self) -> str:
        if self.tag == "decimal":
            return f"Decimal({self.precision}, {self.scale})"
        return f"Unknown({self.original})" if self.tag == "unknown" else DISPLAY[self.tag]

    def to_json(self) -> dict:
        extra = {"decimal": {"precision": self.precision, "scale": self.scale}, "unknown": {"original_type": self.original}}
        return {"type": self.tag} | extra.get(self.tag, {})

    @staticmethod
    def from_json(data: dict) -> CanonicalType:
        return CanonicalType(data["type"], data.get("precision"), data.get("scale"), data.get("original_type"))

    def as_row(self) -> tuple:
        return (self.tag, self.precision, self.scale, self.original)


def type_name(t: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in DISPLAY.items() for x in pair])
    return (
        F.when(t["tag"] == "decimal", F.format_string("Decimal(%d, %d)", t["precision"], t["scale"]))
        .when(t["tag"] == "unknown", F.concat(F.lit("Unknown("), F.coalesce(t["original"], F.lit("")), F.lit(")")))
        .otherwise(named[t["tag"]])
    )


def _listed(a: Column, b: Column, pairs: set) -> Column:
    return F.concat_ws(">", a["tag"], b["tag"]).isin(sorted(f"{x}>{y}" for x, y in pairs))


def compare_types(a: Column, b: Column) -> Column:
    """identical, compatible, widening_safe, requires_cast or incompatible, from ``a`` to ``b``."""
    decimals = (a["tag"] == "decimal") & (b["tag"] == "decimal")
    wider = (a["precision"] <= b["precision"]) & (a["scale"] <= b["scale"])
    return (
        F.when(a.eqNullSafe(b), "identical")
        .when(decimals, F.when(wider, "widening_safe").otherwise("requires_cast"))
        .when(_listed(a, b, COMPATIBLE), "compatible")
        .when(_listed(a, b, WIDENING), "widening_safe")
        .when(_listed(a, b, CAST), "requires_cast")
        .otherwise("incompatible")
    )


def are_types_compatible(a: Column, b: Column) -> Column:
    return compare_types(a, b) != "incompatible"


def is_compatible_with(a: Column, b: Column) -> Column:
    """The stricter relation: no decimal widening, no casts, and an unknown type fits nothing."""
    return (a["tag"] != "unknown") & (a.eqNullSafe(b) | _listed(a, b, STRICT))
