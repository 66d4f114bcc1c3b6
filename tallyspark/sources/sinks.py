"""Rows and their schemas as JSON, written by Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, MapType, StructType


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON document per row in the column ``value``; nulls are kept as such."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def emit_rows(rows: DataFrame, folder: str) -> None:
    json_lines(rows).write.mode("overwrite").text(folder)


_TYPES = {"string": "string", "boolean": "boolean", "double": "number", "float": "number", "date": "string", "timestamp": "string"}


def json_schema(schema, title: str) -> dict:
    """JSON Schema (2020-12) of a row: every column is a property; nullable ones may also be null, the others are required, no further ones are allowed."""

    def kind(t) -> dict:
        if isinstance(t, StructType):
            return {"type": "object", "properties": {f.name: either(f) for f in t.fields}, "required": [f.name for f in t.fields if not f.nullable], "additionalProperties": False}
        if isinstance(t, ArrayType):
            return {"type": "array", "items": kind(t.elementType)}
        if isinstance(t, MapType):
            return {"type": "object", "additionalProperties": kind(t.valueType)}
        return {"type": "number" if isinstance(t, DecimalType) and t.scale else _TYPES.get(t.typeName(), "integer")}

    def either(field) -> dict:
        own = kind(field.dataType)
        return {**own, "type": [own["type"], "null"]} if field.nullable else own

    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": title, **kind(schema)}


def emit_json_schema(rows: DataFrame, folder: str, name: str) -> None:
    """The JSON Schema of ``rows``, beside what ``emit_rows`` writes."""
    text = json.dumps(json_schema(rows.schema, name), indent=2)
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.json")


def emit_schema(rows: DataFrame, folder: str, name: str) -> None:
    """The schema of ``rows`` as one JSON document."""
    rows.sparkSession.createDataFrame([(rows.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.schema.json")
