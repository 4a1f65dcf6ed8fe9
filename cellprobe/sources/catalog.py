"""Metadata of a SQLite file: tables, columns, keys, collations, and which tables are the system's."""

from __future__ import annotations

import contextlib
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from cellprobe.plans.config import ForeignKey
from cellprobe.sources import collation

# --- Fixed values -------------------------------------------------------------------------------------
SPATIALITE_TABLES = {"spatial_ref_sys", "geometry_columns", "spatialite_history"}
# ------------------------------------------------------------------------------------------------------


@dataclass
class Column:
    name: str
    declared: str
    not_null: bool = False
    key_seq: int = 0


@dataclass
class Table:
    name: str
    columns: list[Column]
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    collations: dict[str, str] = field(default_factory=dict)


@dataclass
class Catalog:
    tables: list[Table]
    skipped: list[tuple[str, str]] = field(default_factory=list)
    skipped_keys: list[str] = field(default_factory=list)
    filtered: list[str] = field(default_factory=list)
    kind: str = "sqlite"


@contextlib.contextmanager
def connect(path: str) -> Iterator[sqlite3.Connection]:
    """A read-only connection."""
    db = sqlite3.connect(f"{Path(path).absolute().as_uri()}?mode=ro", uri=True)
    try:
        yield db
    finally:
        db.close()


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def backticked(name: str) -> str:
    """A name for Spark SQL."""
    return "`" + name.replace("`", "``") + "`"


def is_geodatabase(names: list[str]) -> bool:
    return any(n.startswith("GDB_") for n in names)


def is_spatialite(names: list[str]) -> bool:
    return {n.lower() for n in names} >= SPATIALITE_TABLES


def split_system(names: list[str]) -> tuple[list[str], list[str]]:
    """(kept, filtered): GDB_ tables always go; st_ tables where the file is a geodatabase or spatial."""
    spatial = is_geodatabase(names) or is_spatialite(names)
    gone = [n for n in names if n.startswith("GDB_") or spatial and n.lower().startswith("st_")]
    return [n for n in names if n not in set(gone)], gone


def _columns(db: sqlite3.Connection, table: str) -> list[Column]:
    return [Column(name, declared, bool(not_null), key) for _, name, declared, not_null, _, key in db.execute(f"PRAGMA table_info({quoted(table)})")]


def _foreign_keys(db: sqlite3.Connection, table: str, single_key) -> tuple[list[ForeignKey], list[str]]:
    """Keys in the order in which they first come, composite ones whole; an unnamed target is the parent's one key."""
    found: dict[int, list] = {}
    for number, seq, ref, own, to, on_update, on_delete, _ in db.execute(f"PRAGMA foreign_key_list({quoted(table)})"):
        found.setdefault(number, []).append((seq, ref, own, to, on_update, on_delete))
    out, skipped = [], []
    for parts in found.values():
        parts.sort()
        ref, targets = parts[0][1], [p[3] for p in parts]
        if None in targets:
            key = single_key(ref) if len(targets) == 1 else None
            if key is None:
                skipped.append(f"{table}: key to {ref} names no column, and {ref} has no single-column primary key")
                continue
            targets = [key]
        out.append(ForeignKey([p[2] for p in parts], ref, targets, on_delete=parts[0][5], on_update=parts[0][4]))
    return out, skipped


def read_catalog(path: str) -> Catalog:
    """Everything the file declares. Virtual tables of unknown modules are skipped; any other error is one."""
    with connect(path) as db:
        listed = [r for r in db.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        create = dict(listed)
        kept, filtered = split_system([n for n, _ in listed])
        tables, skipped, by_name = [], [], {}
        for name in kept:
            try:
                by_name[name] = _columns(db, name)
            except sqlite3.OperationalError as e:
                if "no such module:" not in str(e):
                    raise
                skipped.append((name, str(e)))
        keys: dict[str, str | None] = {}

        def single_key(table: str) -> str | None:
            if table not in keys:
                own = [c.name for c in _columns(db, table) if c.key_seq > 0]
                keys[table] = own[0] if len(own) == 1 else None
            return keys[table]

        skipped_keys = []
        for name, columns in by_name.items():
            fks, lost = _foreign_keys(db, name, single_key)
            skipped_keys += lost
            tables.append(Table(name, columns, fks, collation.parse(create[name] or "")))
        kind = "esri_geodatabase" if is_geodatabase(list(create)) else "spatialite" if is_spatialite(list(create)) else "sqlite"
        return Catalog(tables, skipped, skipped_keys, filtered, kind)
