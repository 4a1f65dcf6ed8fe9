"""Loading: gates, state, resume, transactional table writes, key checks.

The target is a folder of Parquet tables ``<root>/<database>/<table>``. Spark's committer makes a table appear
whole (``_SUCCESS``) or not at all, so a table without that mark is written anew.
"""

from __future__ import annotations

import datetime
import json
import os
import re
import tempfile
import threading
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellprobe.functions import transforms
from cellprobe.operators.foreign_keys import violating_rows
from cellprobe.operators.resolver import THRESHOLD
from cellprobe.plans import ddl
from cellprobe.plans.config import MigrationConfig, TableConfig, drifted
from cellprobe.sources.catalog import backticked

_LOCK = threading.Lock()


def database_name(source: str, now: datetime.datetime | None = None) -> str:
    """``base_YYYYMMDD_HHMMSS``: lower case, other characters as ``_``, never a leading digit, at most 63."""
    stamp = (now or datetime.datetime.now(datetime.UTC)).strftime("_%Y%m%d_%H%M%S")
    base = re.sub(r"[^a-z0-9_]+", "_", Path(source).stem.lower()).strip("_") or "db"
    base = f"db_{base}" if base[0].isdigit() else base
    return base[: 63 - len(stamp)] + stamp


@dataclass
class State:
    database: str = ""
    completed: list[str] = field(default_factory=list)
    fks_applied: bool = False


def read_state(path: str) -> State:
    if not os.path.exists(path):
        return State()
    with open(path, encoding="utf-8") as f:
        return State(**json.load(f))


def update_state(path: str, change: Callable[[State], None]) -> State:
    """Reads, changes and replaces the file in one step."""
    with _LOCK:
        state = read_state(path)
        change(state)
        fd, new = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".state-")
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(asdict(state), f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(new, path)
        return state


def gate(config: MigrationConfig, threshold: float = THRESHOLD, force: bool = False, check_source: bool = True) -> list[str]:
    """Reasons against a load; none with ``force``."""
    if force:
        return []
    reasons = ["the source has changed since it was profiled"] if check_source and drifted(config) else []
    for name, t in sorted(config.tables.items()):
        for c in t.included() if t.include else []:
            cc = t.columns[c]
            if not cc.reviewed and (cc.needs_review or cc.confidence < threshold):
                reasons.append(f"{name}.{c}: not reviewed (confidence {cc.confidence:.2f})")
    return reasons


def transformed(df: DataFrame, table: TableConfig) -> DataFrame:
    """The typed columns of a table of cells under their target names; a value that can't be had fails the job."""
    ids = ddl.column_names(table)
    out = []
    for c in table.included():
        cc = table.columns[c]
        source = backticked(c)
        value = transforms.loaded(cc.transform, cc.target_type, source)
        if cc.not_null or cc.primary_key_seq > 0:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"{c} must not be NULL")).cast(df.sparkSession.range(0).select(F.lit(None).cast(transforms.SPARK_TYPES.get(cc.target_type.split('(')[0], 'string'))).schema[0].dataType)).otherwise(value)
        out.append(value.alias(ids[c], metadata={"source": c, "target_type": cc.target_type, "primary_key_seq": cc.primary_key_seq}))
    return df.select(*out)


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether the writer's mark is there, on whatever file system the path names."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def load(spark: SparkSession, config: MigrationConfig, read: Callable[[str], DataFrame], root: str, state_path: str, *, force: bool = False, resume: bool = False, threshold: float = THRESHOLD, check_source: bool = True, on_table: Callable[[str, int], None] = lambda *_: None) -> dict[str, int]:
    """Rows written by table. Tables come in order of name; keys are checked after all tables are there."""
    ddl.validate(config)
    against = gate(config, threshold, force, check_source)
    if against:
        raise PermissionError("; ".join(against))
    state = read_state(state_path) if resume else State()
    if not state.database:
        state = update_state(state_path, lambda s: s.__dict__.update(asdict(State(database_name(config.source)))))
    names, rows = ddl.table_names(config), {}
    for table in sorted(names):
        t = config.tables[table]
        if not t.included() or table in state.completed:
            continue
        path = f"{root}/{state.database}/{names[table]}"
        if resume and _finished(spark, path) and not spark.read.parquet(path).isEmpty():
            update_state(state_path, lambda s, n=table: s.completed.append(n))
            continue
        seen = F.count(F.lit(1)).alias("rows")
        from pyspark.sql import Observation

        observation = Observation(f"load {table}")
        transformed(read(table), t).observe(observation, seen).write.mode("overwrite" if resume else "errorifexists").parquet(path)
        rows[table] = observation.get["rows"]
        update_state(state_path, lambda s, n=table: s.completed.append(n))
        on_table(table, rows[table])
    broken = broken_keys(spark, config, lambda t: spark.read.parquet(f"{root}/{state.database}/{names[t]}"))
    if broken:
        raise ValueError("; ".join(f"{t}({', '.join(c)}): {n} row(s) refer to nothing" for (t, c), n in broken.items()))
    update_state(state_path, lambda s: setattr(s, "fks_applied", True))
    return rows


def broken_keys(spark: SparkSession, config: MigrationConfig, target: Callable[[str], DataFrame]) -> dict[tuple[str, tuple[str, ...]], int]:
    """Rows of the written tables that break a declared key, by table and columns."""
    out = {}
    for table, fk in ddl._valid_keys(config):
        own, ref = ddl.column_names(config.tables[table]), ddl.column_names(config.tables[fk.ref_table])
        n = violating_rows(target(table), [own[c] for c in fk.columns], target(fk.ref_table), [ref[c] for c in fk.ref_columns]).count()
        if n:
            out[table, tuple(fk.columns)] = n
    return out
