"""Schemas in short notation: `i64`, `str?`, `dec(10,2)`, `struct(i64, str?)`; a question mark says nullable."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The short name of each type without parameters.
NAMES = {
    T.BooleanType: "bool", T.ByteType: "i8", T.ShortType: "i16", T.IntegerType: "i32", T.LongType: "i64", T.FloatType: "fp32", T.DoubleType: "fp64", T.StringType: "str", T.BinaryType: "vbin", T.DateType: "date",
    T.TimestampNTZType: "precision_timestamp(6)", T.TimestampType: "precision_timestamp_tz(6)", T.YearMonthIntervalType: "iyear", T.DayTimeIntervalType: "iday(6)",
}


def type_name(t: T.DataType) -> str:
    if isinstance(t, T.DecimalType):
        return f"dec({t.precision},{t.scale})"
    if isinstance(t, T.StructType):
        return f"struct({', '.join(field(f.dataType, f.nullable) for f in t.fields)})"
    if isinstance(t, T.ArrayType):
        return f"list({field(t.elementType, t.containsNull)})"
    if isinstance(t, T.MapType):
        return f"map({field(t.keyType, False)}, {field(t.valueType, t.valueContainsNull)})"
    if isinstance(t, T.CharType):
        return f"fchar({t.length})"
    if isinstance(t, T.VarcharType):
        return f"vchar({t.length})"
    return NAMES.get(type(t), t.simpleString())


def field(t: T.DataType, nullable: bool) -> str:
    return type_name(t) + "?" * nullable


def schema_of(df: DataFrame) -> list[str]:
    """The schema of a DataFrame, one entry a column; declared types and lengths are read from the column's metadata."""
    out = []
    for f in df.schema.fields:
        text = f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", "")
        name = f.metadata.get("plankton.type") or re.sub(r"^(var)?char", lambda m: "vchar" if m[1] else "fchar", text) or type_name(f.dataType)
        out.append(name + "?" * f.nullable)
    return out
