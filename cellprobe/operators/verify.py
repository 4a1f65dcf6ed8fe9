"""Proof that a written table equals its transformed source: by key, or by value multiset without one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellprobe.functions import jsons

EXAMPLES = 20


def int_equals_double(i: str, d: str) -> Column:
    """Equal only if the double is that very integer: no rounding beyond 2^53."""
    return F.expr(f"coalesce({d} = floor({d}) AND {d} >= -9223372036854775808D AND {d} < 9223372036854775808D AND try_cast({d} AS bigint) = {i}, false)")


def _number_kinds(a: T.DataType, b: T.DataType) -> tuple[bool, bool]:
    ints = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return isinstance(a, ints) and isinstance(b, (T.FloatType, T.DoubleType)), isinstance(b, ints) and isinstance(a, (T.FloatType, T.DoubleType))


def matches(left: str, right: str, a: T.DataType, b: T.DataType, json: bool = False) -> Column:
    """Whether two values are the same: NULL is NULL, NaN is NaN, JSON by meaning, numbers exactly."""
    x, y = F.col(left), F.col(right)
    int_double, double_int = _number_kinds(a, b)
    if int_double or double_int:
        i, d = (left, right) if int_double else (right, left)
        return (x.isNull() & y.isNull()) | (x.isNotNull() & y.isNotNull() & int_equals_double(f"`{i}`", f"`{d}`"))
    if json:
        return jsons.canonical(x).eqNullSafe(jsons.canonical(y))
    return x.eqNullSafe(y)


def sort_key(column: str, kind: T.DataType, json: bool = False) -> Column:
    """A tagged text that is the same for values that match; NULL has a key too."""
    c = F.col(f"`{column}`")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        key = F.concat(F.lit("n:"), c.cast("string"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (d >= -(2.0**63)) & (d < 2.0**63)
        key = F.concat(F.lit("n:"), F.when(whole, F.expr(f"cast(try_cast(`{column}` AS bigint) AS string)")).otherwise(d.cast("string")))
    elif isinstance(kind, T.BinaryType):
        key = F.concat(F.lit("b:"), F.hex(c))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        key = F.concat(F.lit("j:"), F.to_json(c))
    elif json:
        key = F.concat(F.lit("j:"), jsons.canonical(c))
    else:
        key = F.concat(F.lit("s:"), c.cast("string"))
    return F.coalesce(key, F.lit("null"))


@dataclass
class TableResult:
    table: str
    source_rows: int
    target_rows: int
    mismatches: dict[str, int] = field(default_factory=dict)
    missing: int = 0
    extra: int = 0
    ordered: bool = True
    examples: list[dict] = field(default_factory=list)
    reason: str = ""

    def total(self) -> int:
        return sum(self.mismatches.values()) + self.missing + self.extra

    def passed(self) -> bool:
        return self.source_rows == self.target_rows and not self.total()


def keyed_compare(expected: DataFrame, actual: DataFrame, keys: list[str], jsonb: tuple[str, ...] = ()) -> DataFrame:
    """Full outer join on the key (NULL equals NULL), with a flag ``bad_<column>`` and the side(s) present."""
    own = [c for c in expected.columns if c not in keys]
    left = expected.select(*[F.col(f"`{c}`").alias(f"e_{c}") for c in expected.columns], F.lit(True).alias("_e"))
    right = actual.select(*[F.col(f"`{c}`").alias(f"a_{c}") for c in expected.columns], F.lit(True).alias("_a"))
    on = [F.col(f"e_{k}").eqNullSafe(F.col(f"a_{k}")) for k in keys]
    flags = [(F.col("_e") & F.col("_a") & ~matches(f"e_{c}", f"a_{c}", expected.schema[c].dataType, actual.schema[c].dataType, c in jsonb)).alias(f"bad_{c}") for c in own]
    return left.join(right, on, "full_outer").select("*", *[F.coalesce(f, F.lit(False)).alias(f"bad_{c}") for f, c in zip(flags, own, strict=True)])


def keyed_counts(expected: DataFrame, actual: DataFrame, keys: list[str], jsonb: tuple[str, ...] = ()) -> DataFrame:
    """One row: missing, extra, and mismatches by column."""
    both = keyed_compare(expected, actual, keys, jsonb)
    own = [c for c in expected.columns if c not in keys]
    return both.agg(F.count_if(F.col("_a").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("extra"), *[F.count_if(f"bad_{c}").alias(f"bad_{c}") for c in own])


def multiset_difference(expected: DataFrame, actual: DataFrame, column: str, jsonb: bool = False) -> DataFrame:
    """(key, expected_count, actual_count) of values that occur unequally often on the two sides."""
    count = lambda df, name: df.groupBy(sort_key(column, df.schema[column].dataType, jsonb).alias("key")).agg(F.count(F.lit(1)).alias(name))
    both = count(expected, "e").join(count(actual, "a"), "key", "full_outer")
    return both.select("key", F.coalesce("e", F.lit(0)).alias("expected_count"), F.coalesce("a", F.lit(0)).alias("actual_count")).where("expected_count <> actual_count")


def examples(both: DataFrame, keys: list[str], column: str, most: int = EXAMPLES) -> list[dict]:
    """The first mismatches of a column by key, at most ``most``."""
    rows = both.where(f"`bad_{column}`").orderBy(*[f"e_{k}" for k in keys]).limit(most)
    return [{"column": column, "key": [r[f"e_{k}"] for k in keys], "expected": str(r[f"e_{column}"]), "actual": str(r[f"a_{column}"])} for r in rows.collect()]


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Row numbers from 0 in key order, for reports."""
    return df.withColumn("row_number", F.row_number().over(Window.orderBy(*keys)) - 1)


def verify_table(table: str, expected: DataFrame, actual: DataFrame, keys: list[str], jsonb: tuple[str, ...] = ()) -> TableResult:
    """Counts first; where they are equal, every value."""
    result = TableResult(table, expected.count(), actual.count())
    if result.source_rows != result.target_rows:
        result.reason = "row counts differ"
        return result
    own = [c for c in expected.columns if c not in keys]
    if keys:
        row = keyed_counts(expected, actual, keys, jsonb).first()
        result.missing, result.extra = row["missing"], row["extra"]
        result.mismatches = {c: row[f"bad_{c}"] for c in own if row[f"bad_{c}"]}
        both = keyed_compare(expected, actual, keys, jsonb)
        for c in result.mismatches:
            result.examples += examples(both, keys, c)
        return result
    result.ordered, result.reason = False, "no usable primary key: values are compared as a multiset for each column"
    for c in expected.columns:
        diff = multiset_difference(expected, actual, c, c in jsonb)
        wrong = diff.agg(F.sum(F.abs(F.col("expected_count") - F.col("actual_count"))).alias("n")).first()["n"]
        if wrong:
            result.mismatches[c] = -(-wrong // 2)
            result.examples += [{"column": c, **r.asDict()} for r in diff.orderBy("key").limit(EXAMPLES).collect()]
    return result


def report(results: list[TableResult]) -> str:
    lines = []
    for r in results:
        state = "OK" if r.passed() else "MISMATCH"
        lines.append(f"{r.table}: {state} ({r.source_rows} source rows, {r.target_rows} target rows{'; ' + r.reason if r.reason else ''})")
        lines += [f"  {c}: {n} mismatched value(s)" for c, n in r.mismatches.items()]
        lines += [f"  missing {r.missing}, extra {r.extra}"] if r.missing or r.extra else []
        lines += [f"    {e}" for e in r.examples[:EXAMPLES]]
    bad = sum(not r.passed() for r in results)
    return "\n".join([*lines, f"{len(results)} table(s) verified, {bad} with mismatches"])
