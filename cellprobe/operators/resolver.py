"""Arbitration between findings, and summaries of samples and of decisions."""

from __future__ import annotations

from typing import Protocol

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellprobe.operators.heuristics import Finding

THRESHOLD = 0.9
#: Hundredths of confidence within which two findings are too close to call.
MARGIN = 2


def _hundredths(confidence: float) -> int:
    return int(confidence * 100 + 0.5)


def decide(findings: list[Finding], threshold: float = THRESHOLD) -> tuple[Finding | None, bool]:
    """(best finding, whether a person must look).

    The first of equally confident findings is the best. A runner-up within the margin asks for review if it
    wants another type or transform; a third finding never does.
    """
    if not findings:
        return None, True
    ranked = sorted(findings, key=lambda f: -f.confidence)  # stable
    best = ranked[0]
    if best.confidence < threshold:
        return best, True
    if len(ranked) > 1:
        other = ranked[1]
        close = _hundredths(best.confidence) - _hundredths(other.confidence) <= MARGIN
        if close and (best.suggested_type, best.transform) != (other.suggested_type, other.transform):
            return best, True
    return best, False


def value_frequency(values: DataFrame, value: str, position: str, most: int = 10) -> DataFrame:
    """(value, cnt) of the ``most`` most frequent values; ties in order of first position."""
    counted = values.groupBy(value).agg(F.count(F.lit(1)).alias("cnt"), F.min(position).alias("_first"))
    return counted.orderBy(F.desc("cnt"), "_first").limit(most).select(value, "cnt")


def sample_summary(samples: list[str], most: int = 10) -> list[str]:
    """Lines ``value (xN)`` of the most frequent samples and one that counts the rest."""
    counts: dict[str, int] = {}
    for s in samples:
        counts[s] = counts.get(s, 0) + 1
    ranked = sorted(counts.items(), key=lambda kv: -kv[1])
    lines = [f"{v} (x{n})" for v, n in ranked[:most]]
    return lines + ([f"... and {len(ranked) - most} more distinct value(s)"] if len(ranked) > most else [])


class Resolver(Protocol):
    """What settles columns that the profile could not."""

    def resolve(self, cases: list[dict]) -> None: ...


class FileResolver:
    """Writes unresolved cases to a YAML report."""

    def __init__(self, path: str):
        self.path = path

    def resolve(self, cases: list[dict]) -> None:
        with open(self.path, "w", encoding="utf-8") as f:
            yaml.safe_dump({"unresolved": [{**c, "samples": sample_summary(c.get("samples", []))} for c in cases]}, f, sort_keys=False, allow_unicode=True)
