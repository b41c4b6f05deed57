"""Reading tables and literal rows, writing, and views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import declared
from ..operators.rows import Invalid
from .scratch import Scratch

FORMATS = ("parquet", "orc", "csv", "json", "text")
OUTPUTS = ("modified_records", "no_output")


def read_files(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Files as a table; csv and json need a schema, as types are declared and never guessed."""
    if fmt not in FORMATS:
        raise Invalid(f"no file format {fmt}")
    if fmt in ("csv", "json") and schema is None:
        raise Invalid(f"{fmt} files need a declared schema")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_named(spark: SparkSession, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A table or view; with a schema, its columns must be declared so."""
    df = spark.table(name)
    if schema is not None:
        check_schema(df, schema)
    return df


def check_schema(df: DataFrame, schema: T.StructType) -> None:
    """The same types in the same order, and no null where none is declared."""
    if len(df.schema) != len(schema):
        raise Invalid(f"{len(schema)} columns are declared and there are {len(df.schema)}")
    for have, want in zip(df.schema.fields, schema.fields, strict=True):
        if have.dataType != want.dataType:
            raise Invalid(f"{want.name} is declared as {want.dataType.simpleString()} and is {have.dataType.simpleString()}")
        if have.nullable and not want.nullable:
            raise Invalid(f"{want.name} is declared required and may be null")


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A table of literal rows with a declared schema; the rows do not decide it."""
    return spark.createDataFrame(list(rows), schema)


def expression_rows(spark: SparkSession, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """A table of rows of expressions over no columns."""
    one = spark.range(1)
    out = None
    for r in rows:
        part = one.select(*[c.alias(n) for n, c in r.items()])
        out = part if out is None else out.unionAll(part)
    return out


def write(df: DataFrame, table: str, *, output: str = "no_output", create: bool = False, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Inserts rows into a table, or creates it from them.

    Returns no rows (`no_output`) or the rows written (`modified_records`), in
    either case with the input's schema.  create with a schema needs an input
    that matches it.  Rows that are asked for are computed once into a stored
    table in the shared folder, from which they are inserted and returned: an
    input that reads the table it writes to does not see its own rows.
    """
    if output not in OUTPUTS:
        raise Invalid(f"no output mode {output}")
    if schema is not None:
        check_schema(df, schema)
    shape = df.schema
    if output == "modified_records":
        df = declared(Scratch(df.sparkSession, "write").keep(df, "rows"), shape)
    if create:
        df.write.format(fmt).saveAsTable(table)
    else:
        df.write.insertInto(table)
    return df if output == "modified_records" else df.where(F.lit(False))


def update(df: DataFrame, condition: Column, **new: Column) -> DataFrame:
    """The rows after an update: where the condition is true, the named columns have new values of their own type."""
    if unknown := [c for c in new if c not in df.columns]:
        raise Invalid(f"no column {unknown[0]}")
    return df.select(*[F.when(condition, new[c].cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])


def create_table(spark: SparkSession, name: str, schema: T.StructType, *, fmt: str = "parquet") -> DataFrame:
    """Defines an empty table; the result has no column and no row."""
    spark.catalog.createTable(name, schema=schema, source=fmt)
    return spark.createDataFrame([], T.StructType([]))


def create_view(df: DataFrame, name: str) -> DataFrame:
    """Defines a view; the result has no column and no row."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.createDataFrame([], T.StructType([]))
