"""Review of decisions by a person: a state that persists each answer at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cellprobe.functions import cells
from cellprobe.operators.profile import sample_rows
from cellprobe.plans.config import ColumnConfig, MigrationConfig

PREVIEW_ROWS = 30


class Review:
    """``persist`` is called after every change."""

    def __init__(self, config: MigrationConfig, persist: Callable[[MigrationConfig], None] = lambda _: None):
        self.config, self.persist, self.outcome = config, persist, "open"

    def summary(self) -> dict[str, tuple[int, int]]:
        """Table -> (columns that need review, auto-approved ones)."""
        return {n: (sum(c.needs_review and not c.reviewed for c in t.columns.values()), sum(not c.needs_review for c in t.columns.values())) for n, t in self.config.tables.items()}

    def flagged(self, table: str) -> list[str]:
        t = self.config.tables[table]
        return [c for c in t.column_order if t.columns[c].needs_review and not t.columns[c].reviewed]

    def next_flagged(self, table: str, column: str | None, step: int = 1) -> str | None:
        """The next flagged column after ``column`` (before it with step -1), round and round."""
        order, flagged = self.config.tables[table].column_order, self.flagged(table)
        if not flagged:
            return None
        at = order.index(column) if column in order else (-1 if step > 0 else len(order))
        ring = [order[(at + step * i) % len(order)] for i in range(1, len(order) + 1)]
        return next((c for c in ring if c in flagged), None)

    def decide(self, table: str, column: str, target: str, transform: str = "") -> ColumnConfig:
        """A human decision; what was suggested first is kept."""
        c = self.config.tables[table].columns[column]
        if c.original is None:
            c.original = {"target_type": c.target_type, "transform": c.transform, "confidence": c.confidence, "source": c.source}
        c.target_type, c.transform, c.source, c.confidence = target, transform, "human_override", 1.0
        c.reviewed, c.needs_review = True, False
        self.persist(self.config)
        return c

    def finish(self) -> None:
        for t in self.config.tables.values():
            for c in t.columns.values():
                c.reviewed = True
        self.outcome = "finished"
        self.persist(self.config)

    def cancel(self) -> None:
        self.outcome = "cancelled"


def preview(df: DataFrame, rows: int = PREVIEW_ROWS, seed: int = 17) -> DataFrame:
    """Random rows of a table of cells as short texts."""
    return sample_rows(df, rows, seed).select(*[cells.sql(cells.PREVIEW, f"`{c}`").alias(c) for c in df.columns])
