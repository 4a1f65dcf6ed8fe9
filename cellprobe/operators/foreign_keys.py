"""Key containment, foreign keys inferred by name, and rows that break a key."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellprobe.plans.config import ForeignKey


def containment(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """One row (violations, non_null) of ``column NOT IN (SELECT key ...)``.

    NULL in the parent's key makes every NOT IN unknown and so leaves no violation; ``violating_rows`` is the
    stricter count. One equality join against the parent's distinct keys, and one aggregate.
    """
    keys = parent.select(F.col(key).alias("_key")).where("_key is not null").distinct().withColumn("_hit", F.lit(True))
    joined = child.select(F.col(column).alias("_key")).where("_key is not null").groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).join(keys, "_key", "left")
    counted = joined.select(F.when(F.col("_hit").isNull(), F.col("_n")).otherwise(0).alias("_missing"), "_n", F.lit(False).alias("_null"))
    nulls = parent.select(F.lit(0).cast("bigint").alias("_missing"), F.lit(0).cast("bigint").alias("_n"), F.col(key).isNull().alias("_null"))
    sums = counted.union(nulls).agg(F.sum("_missing").alias("_missing"), F.sum("_n").alias("_n"), F.max("_null").alias("_null"))
    return sums.select(F.when(F.col("_null"), F.lit(0)).otherwise(F.coalesce("_missing", F.lit(0))).cast("bigint").alias("violations"), F.coalesce("_n", F.lit(0)).cast("bigint").alias("non_null"))


def violating_rows(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the child whose key, none of it NULL, is not in the parent."""
    filled = child.where(F.forall(F.array(*[F.col(c).isNotNull() for c in columns]), lambda x: x))
    wanted = parent.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    same = [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(columns)]
    return filled.join(wanted, same, "left_anti")


def base_name(column: str) -> str | None:
    """What a key column's name says it refers to: ``user_id`` and ``userId`` to user."""
    m = re.fullmatch(r"(.+?)_?id", column, re.I | re.S)
    return m[1] if m else None


def matching_table(base: str, tables: list[str]) -> str | None:
    """The table of that name, or of its plural, whatever the case."""
    by_lower = {t.lower(): t for t in tables}
    low = base.lower()
    plurals = [low, low + "s", low + "es"] + ([low[:-1] + "ies"] if low.endswith("y") and len(low) > 1 else [])
    return next((by_lower[p] for p in plurals if p in by_lower), None)


def candidates(tables: dict[str, dict]) -> list[tuple[str, str, str, str]]:
    """(table, column, referred table, its key) by name alone.

    ``tables``: name -> {"columns": [(name, key_seq)], "foreign_keys": [[column, ...], ...]}.
    """
    keys = {name: [c for c, seq in t["columns"] if seq > 0] for name, t in tables.items()}
    out = []
    for name, table in tables.items():
        declared = {c for fk in table.get("foreign_keys", []) for c in fk}
        for column, seq in table["columns"]:
            base = base_name(column)
            if seq > 0 or column in declared or base is None:
                continue
            ref = matching_table(base, list(tables))
            if ref and ref.lower() != name.lower() and len(keys[ref]) == 1:
                out.append((name, column, ref, keys[ref][0]))
    return out


def infer(tables: dict[str, dict], read: Callable[[str, str], DataFrame]) -> dict[str, list[ForeignKey]]:
    """Suggested keys: candidates of which every value, and at least one, is in the referred table.

    ``read`` gives a column of a table.
    """
    out: dict[str, list[ForeignKey]] = {}
    for name, column, ref, key in candidates(tables):
        found = containment(read(name, column), column, read(ref, key), key).first()
        if found["violations"] == 0 and found["non_null"]:
            out.setdefault(name, []).append(ForeignKey([column], ref, [key], rationale=f"{name}.{column} is named after {ref}, and all of its {found['non_null']} values are in {ref}.{key}"))
    return out
