"""Cells: one value of an untyped column with its storage class.

A cell is ``struct<k, i, d, s, b>`` with k one of integer, real, text, blob; a null struct is SQL NULL. Typed
columns are lifted into the same form, so every heuristic and transform has one input type. Expressions are
SQL templates in which ``{c}`` stands for the cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = T.StructType([T.StructField("k", T.StringType()), T.StructField("i", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("b", T.BinaryType())])
DDL = "struct<k:string,i:bigint,d:double,s:string,b:binary>"

#: Declared type names under which a text that parses as a timestamp counts as one.
TIME_DECLARED = ("DATE", "DATETIME", "TIMESTAMP")


def _cell(kind: str, member: str, value: Column) -> Column:
    parts = {"i": F.lit(None).cast("bigint"), "d": F.lit(None).cast("double"), "s": F.lit(None).cast("string"), "b": F.lit(None).cast("binary")}
    parts[member] = value
    return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("k"), *[parts[m].alias(m) for m in "idsb"]))


def integer(value: Column) -> Column:
    return _cell("integer", "i", value.cast("bigint"))


def real(value: Column) -> Column:
    return _cell("real", "d", value.cast("double"))


def text(value: Column) -> Column:
    return _cell("text", "s", value.cast("string"))


def blob(value: Column) -> Column:
    """An empty blob stays a blob: it is not NULL."""
    return _cell("blob", "b", value.cast("binary"))


def lift(df: DataFrame, column: str) -> Column:
    """A typed column as cells: numbers and booleans as numbers, binary as blob, everything else as text."""
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return integer(value.cast("int") if isinstance(kind, T.BooleanType) else value)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return real(value)
    if isinstance(kind, T.BinaryType):
        return blob(value)
    return value if kind == CELL else text(F.to_json(value) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else value)


def sql(template: str, cell: str = "c") -> Column:
    """A template over a cell column."""
    return F.expr(template.replace("{c}", cell))


#: A cell as text: numbers in decimal, blobs decoded.
TEXT_OF = "CASE {c}.k WHEN 'integer' THEN cast({c}.i AS string) WHEN 'real' THEN cast({c}.d AS string) WHEN 'text' THEN {c}.s WHEN 'blob' THEN cast({c}.b AS string) END"
#: The number of a numeric cell.
NUMBER_OF = "CASE {c}.k WHEN 'integer' THEN cast({c}.i AS double) WHEN 'real' THEN {c}.d END"
#: Text shown for an offending value.
BAD_TEXT = f"coalesce({TEXT_OF}, 'NULL')"
#: A preview cell of at most 40 characters.
PREVIEW = f"CASE WHEN {{c}} IS NULL THEN 'NULL' WHEN {{c}}.k = 'blob' THEN concat('<', octet_length({{c}}.b), ' bytes>') WHEN length({TEXT_OF}) > 40 THEN concat(left({TEXT_OF}, 40), '…') ELSE {TEXT_OF} END"


def max_text_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column that has a value: (column, max_len) in characters, in one pass."""
    longest = [F.max(F.length(sql(TEXT_OF, f"`{c}`"))).alias(c) for c in columns]
    row = df.agg(*longest)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("max_len")) for c in columns])).alias("x")).select("x.*").where("max_len is not null")
