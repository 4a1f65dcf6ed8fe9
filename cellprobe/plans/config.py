"""The migration document: decisions for every column, keys, fingerprint; kept as YAML."""

from __future__ import annotations

import dataclasses
import hashlib
from dataclasses import dataclass, field

import yaml

VERSION = 1
DROP = "__drop__"


@dataclass
class ForeignKey:
    columns: list[str]
    ref_table: str
    ref_columns: list[str]
    on_delete: str = ""
    on_update: str = ""
    rationale: str = ""


@dataclass
class ColumnConfig:
    declared_type: str
    target_type: str
    transform: str = ""
    confidence: float = 0.0
    source: str = ""
    rationale: str = ""
    reviewed: bool = False
    needs_review: bool = False
    primary_key_seq: int = 0
    not_null: bool = False
    original: dict | None = None


@dataclass
class TableConfig:
    include: bool = True
    columns: dict[str, ColumnConfig] = field(default_factory=dict)
    column_order: list[str] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    suggested_foreign_keys: list[ForeignKey] = field(default_factory=list)

    def included(self) -> list[str]:
        """Columns that go to the target, in order."""
        return [c for c in self.column_order if self.columns[c].target_type != DROP]

    def primary_key(self) -> list[str]:
        keyed = [(self.columns[c].primary_key_seq, c) for c in self.included() if self.columns[c].primary_key_seq > 0]
        return [c for _, c in sorted(keyed)]


@dataclass
class MigrationConfig:
    source: str
    source_hash: str = ""
    source_kind: str = "sqlite"
    tables: dict[str, TableConfig] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)
    filtered: list[str] = field(default_factory=list)
    version: int = VERSION


def file_hash(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def drifted(config: MigrationConfig) -> bool:
    """Whether the source has changed since it was profiled."""
    return file_hash(config.source) != config.source_hash


def save(config: MigrationConfig, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(dataclasses.asdict(config), f, sort_keys=False, allow_unicode=True)


def load(path: str) -> MigrationConfig:
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    if raw.get("version") != VERSION:
        raise ValueError(f"config version {raw.get('version')!r} is not {VERSION}")
    tables = {}
    for name, t in raw.pop("tables").items():
        keys = {k: [ForeignKey(**x) for x in t.pop(k)] for k in ("foreign_keys", "suggested_foreign_keys")}
        tables[name] = TableConfig(columns={c: ColumnConfig(**x) for c, x in t.pop("columns").items()}, **keys, **t)
    return MigrationConfig(tables=tables, **raw)


#: Fields of an answer, and the decision's fields that they set.
ANSWERS = {"type": "target_type", "target_type": "target_type", "transform": "transform", "rationale": "rationale"}


def apply_answers(config: MigrationConfig, answers: dict[str, dict]) -> None:
    """Merges ``table.column`` -> fields (the last dot parts them) into the document, as human decisions.

    A new type without a transform clears the transform that went with the old one. Whether the profile asked for a
    review stays on record. Nothing changes if an answer names an unknown column or field.
    """
    for key, fields in answers.items():
        table, dot, column = key.rpartition(".")
        if not dot or table not in config.tables or column not in config.tables[table].columns:
            raise KeyError(f"no column {key!r}")
        if unknown := sorted(set(fields) - set(ANSWERS)):
            raise ValueError(f"{key}: no field {unknown[0]!r} in an answer; there are {', '.join(ANSWERS)}")
    for key, fields in answers.items():
        table, _, column = key.rpartition(".")
        found, new = config.tables[table].columns[column], {ANSWERS[k]: v or "" for k, v in fields.items()}
        if new.get("target_type", found.target_type) != found.target_type:
            new.setdefault("transform", "")
        for name, value in new.items():
            setattr(found, name, value)
        found.source, found.reviewed = "human_override", True
