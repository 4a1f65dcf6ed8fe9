"""profile, load and verify for a SQLite file, end to end."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from cellprobe.functions import cells
from cellprobe.operators import foreign_keys, verify
from cellprobe.operators.profile import SAMPLE_ROWS, ColumnMeta, profile
from cellprobe.operators.resolver import THRESHOLD
from cellprobe.plans import ddl
from cellprobe.plans.config import MigrationConfig, TableConfig, file_hash
from cellprobe.plans.load import read_state, transformed
from cellprobe.sources.catalog import read_catalog
from cellprobe.sources.sqlite_cells import read_table


def _plain(df: DataFrame) -> DataFrame:
    """Cells as texts by storage class, for containment: numbers of equal value are equal."""
    from pyspark.sql import functions as F

    number = f"coalesce(cast(CASE WHEN {{c}}.k = 'real' AND {{c}}.d = floor({{c}}.d) AND abs({{c}}.d) < 9e18 THEN cast({{c}}.d AS bigint) ELSE {{c}}.i END AS string), cast({{c}}.d AS string))"
    text = f"CASE WHEN {{c}}.k IN ('integer', 'real') THEN {number} ELSE {cells.TEXT_OF} END"
    return df.select(*[cells.sql(text, f"`{c}`").alias(c) for c in df.columns]) if df.columns else df.select(F.lit(1))


def profile_file(spark: SparkSession, path: str, sample: int | None = SAMPLE_ROWS, threshold: float = THRESHOLD, workers: int = 4) -> tuple[MigrationConfig, list[dict]]:
    """(document, unresolved cases). Tables are profiled side by side."""
    found = read_catalog(path)
    spec = {t.name: {"columns": [(c.name, c.key_seq) for c in t.columns], "foreign_keys": [fk.columns for fk in t.foreign_keys]} for t in found.tables}
    suggested = foreign_keys.infer(spec, lambda name, column: _plain(read_table(spark, path, name, [column])))
    config = MigrationConfig(path, file_hash(path), found.kind, skipped=[f"{n}: {why}" for n, why in found.skipped] + found.skipped_keys, filtered=found.filtered)

    def one(t):
        metas = [ColumnMeta(c.name, c.declared, c.not_null, c.key_seq) for c in t.columns]
        return t, profile(read_table(spark, path, t.name), metas, t.name, threshold, sample)

    unresolved = []
    with ThreadPoolExecutor(workers) as pool:
        for t, p in pool.map(one, found.tables):
            config.tables[t.name] = TableConfig(True, p.columns, [c.name for c in t.columns], t.foreign_keys, suggested.get(t.name, []))
            unresolved += p.unresolved
    return config, unresolved


def verify_load(spark: SparkSession, config: MigrationConfig, root: str, state_path: str) -> list[verify.TableResult]:
    """Compares every written table with its source, transformed again."""
    database, names, out = read_state(state_path).database, ddl.table_names(config), []
    for table in sorted(names):
        t = config.tables[table]
        if not t.included():
            continue
        ids = ddl.column_names(t)
        expected = transformed(read_table(spark, config.source, table), t)
        actual = spark.read.parquet(f"{root}/{database}/{names[table]}")
        jsonb = tuple(ids[c] for c in t.included() if t.columns[c].target_type == "jsonb")
        # A transform can make two keys of the source equal, so only keys that are stored as they were pair up rows.
        key = t.primary_key()
        kept = not any(t.columns[c].transform for c in key)
        out.append(verify.verify_table(table, expected, actual, [ids[c] for c in key] if kept else [], jsonb))
    return out
