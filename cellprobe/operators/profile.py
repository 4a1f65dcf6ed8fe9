"""Profiling: one grouped aggregate a table for all heuristics, a second for checks over every row."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellprobe.functions import cells, jsons, transforms
from cellprobe.functions import temporal as t
from cellprobe.operators.heuristics import COUNTERS, GEO_COUNTERS, Finding, declared_varchar, findings, varchar_finding
from cellprobe.operators.resolver import THRESHOLD, decide
from cellprobe.plans.config import DROP, ColumnConfig
from cellprobe.sources.catalog import backticked

SAMPLE_ROWS = 500
VIOLATION_CONFIDENCE, PASSTHROUGH_CONFIDENCE = 0.40, 0.99


@dataclass(frozen=True)
class ColumnMeta:
    name: str
    declared: str
    not_null: bool = False
    key_seq: int = 0


@dataclass
class Profile:
    columns: dict[str, ColumnConfig]
    unresolved: list[dict] = field(default_factory=list)


def sample_rows(df: DataFrame, n: int = SAMPLE_ROWS, seed: int = 17) -> DataFrame:
    """Exactly n random rows (fewer if there are fewer): a bounded top-n by a random number."""
    return df.orderBy(F.rand(seed)).limit(n)


def sample_nonnull(df: DataFrame, column: str, n: int = SAMPLE_ROWS, seed: int = 17) -> DataFrame:
    return sample_rows(df.where(F.col(f"`{column}`").isNotNull()).select(f"`{column}`"), n, seed)


def as_cells(df: DataFrame) -> DataFrame:
    """Every column as cells, under the same names."""
    return df.select(*[cells.lift(df, c).alias(c) for c in df.columns])


def counters(df: DataFrame) -> DataFrame:
    """A row for each column of a table of cells: (pos, counters). The table is read once, in long form."""
    names = df.columns
    long = df.select(F.posexplode(F.array(*[F.col(f"`{c}`") for c in names])).alias("pos", "c"))
    long = long.withColumn("geo", F.when(cells.sql("{c}.k = 'text' AND {c}.s LIKE '%{%' AND {c}.s LIKE '%coordinates%'"), jsons.geojson(F.col("c.s"))).otherwise(F.lit(False)))
    every = {**COUNTERS, **{k: v.replace("{geo}", "geo") for k, v in GEO_COUNTERS.items()}}
    return long.groupBy("pos").agg(*[cells.sql(e).alias(k) for k, e in every.items()])


def _counts(df: DataFrame) -> dict[str, dict]:
    found = {df.columns[r["pos"]]: r.asDict() for r in counters(df).collect()}
    return {c: found.get(c) or dict.fromkeys([*COUNTERS, *GEO_COUNTERS], 0) for c in df.columns}


def fallback_declared(declared: str) -> str:
    d = declared.upper()
    for parts, target in ((("INT",), "integer"), (("BLOB",), "bytea"), (("REAL", "FLOA", "DOUB"), "double precision")):
        if any(p in d for p in parts):
            return target
    return "text"


def fallback(declared: str, c: dict) -> str:
    """Target of a column without findings, from the storage classes seen."""
    timed = declared.upper().split("(")[0].strip() in cells.TIME_DECLARED
    if c["n_real"]:
        return "double precision"
    if c["n_int"]:
        return "bigint" if c["int_beyond_int4"] else "integer"
    if timed and c["n_text"] and not c["iso_bad"]:
        return "timestamptz"
    if c["n_blob"]:
        return "bytea"
    return "text" if c["n_text"] else fallback_declared(declared)


def storage_misfit(target: str) -> Column | None:
    """Cells whose storage class an untransformed column of that target can't take; None: any class goes."""
    taken = {"smallint": ("integer",), "integer": ("integer",), "bigint": ("integer",), "double precision": ("integer", "real"), "real": ("integer", "real"), "numeric": ("integer", "real"), "bytea": ("blob",)}.get(target)
    if target == "timestamptz":
        return cells.sql(f"{{c}} IS NOT NULL AND NOT ({{c}}.k = 'text' AND ({t.of(t.PARSE, '{c}.s')}) IS NOT NULL)")
    if taken is None:
        return None
    return F.col("c").isNotNull() & ~F.col("c.k").isin(*taken)


@dataclass(frozen=True)
class Check:
    """A decision that every row must bear out."""

    column: str
    transform: str
    target: str
    reject_null: bool = False


def violation(check: Check) -> Column:
    """Whether the cell ``c`` contradicts the decision; never NULL."""
    bad = ~transforms.fits(check.transform, check.target)
    if check.transform:
        bad = bad | transforms.error(check.transform)
        if check.reject_null:
            bad = bad | transforms.value(check.transform).isNull()
    else:
        misfit = storage_misfit(check.target)
        bad = bad | (misfit if misfit is not None else F.lit(False))
        if check.reject_null:
            bad = bad | F.col("c").isNull()
    return F.coalesce(bad, F.lit(True))


def full_table_check(df: DataFrame, checks: list[Check]) -> DataFrame:
    """(column, violations, bad_value): one scan for all pending columns; bad_value is the least offending text.

    Columns with the same decision share one expression; the plan grows with the kinds of decisions and not
    with the columns.
    """
    kinds = sorted({(c.transform, c.target, c.reject_null) for c in checks})
    entries = [F.struct(F.lit(c.column).alias("column"), F.lit(kinds.index((c.transform, c.target, c.reject_null))).alias("kind"), F.col(backticked(c.column)).alias("c")) for c in checks]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    parts = [(F.col("kind") == i, violation(Check("", *kind))) for i, kind in enumerate(kinds)]
    bad = functools.reduce(lambda rest, part: F.when(part[0], part[1]).otherwise(rest), parts, F.lit(False))
    return long.withColumn("bad", bad).groupBy("column").agg(F.count_if("bad").alias("violations"), F.min(F.when(F.col("bad"), cells.sql(cells.BAD_TEXT))).alias("bad_value"))


def profile(df: DataFrame, metas: list[ColumnMeta], table: str = "t", threshold: float = THRESHOLD, sample: int | None = SAMPLE_ROWS) -> Profile:
    """Decisions for the columns of a table of cells; ``sample=None`` infers from every row.

    Auto-approved decisions are checked against every row either way. A column without a value in a full
    sample is looked at again by its values alone.
    """
    looked = df if sample is None else sample_rows(df, sample)
    counts = _counts(looked)
    if sample is not None:
        for m in metas:
            if not counts[m.name]["n"]:
                counts[m.name] = _counts(sample_nonnull(df, m.name, sample))[m.name]
    lengths = {n for m in metas if (n := declared_varchar(m.declared)) is not None}
    longest = {}
    if len(lengths) > 1:
        wanted = [m.name for m in metas if declared_varchar(m.declared) is not None]
        longest = {r["column"]: r["max_len"] for r in cells.max_text_lengths(df, wanted).collect()}
    out, pending, unresolved = {}, {}, []

    def unclear(m: ColumnMeta, reason: str, found: list[Finding] = ()) -> None:
        told = [{"heuristic": f.heuristic, "suggested_type": f.suggested_type, "confidence": f.confidence, "rationale": f.rationale} for f in found]
        unresolved.append({"table": table, "column": m.name, "declared_type": m.declared, "samples": [], "reason": reason, "findings": told})

    for m in metas:
        c = counts[m.name]
        found = findings(c, m.name, m.declared)
        extra = varchar_finding(m.declared, lengths, longest.get(m.name))
        found += [extra] if extra else []
        reject = m.not_null or m.key_seq > 0
        if not found:
            target = fallback(m.declared, c)
            out[m.name] = ColumnConfig(m.declared, target, "", PASSTHROUGH_CONFIDENCE, "heuristic:default_passthrough", "no heuristic has a say; the storage class decides", primary_key_seq=m.key_seq, not_null=m.not_null)
            if target not in ("text", "varchar"):
                pending[m.name] = Check(m.name, "", target, reject)
            continue
        best, review = decide(found, threshold)
        out[m.name] = _column(m, best, review)
        if review:
            unclear(m, f"confidence {best.confidence:.2f} is below {threshold:.2f}, or heuristics disagree", found)
        elif best.suggested_type != DROP and (best.transform or not best.suggested_type.startswith(("text", "varchar"))):
            pending[m.name] = Check(m.name, best.transform, best.suggested_type, reject)
    if pending:
        by_name = {m.name: m for m in metas}
        for r in full_table_check(df, list(pending.values())).collect():
            if r["violations"]:
                cc = out[r["column"]]
                cc.confidence, cc.needs_review = VIOLATION_CONFIDENCE, True
                cc.rationale += f"; but {r['violations']} of all rows can't become {cc.target_type}, such as {r['bad_value']!r}"
                unclear(by_name[r["column"]], cc.rationale)
    if unresolved:
        shown = list(dict.fromkeys(u["column"] for u in unresolved))
        texts = looked.limit(SAMPLE_ROWS if sample is None else sample).select(*[cells.sql(cells.BAD_TEXT, backticked(c)).alias(f"c{i}") for i, c in enumerate(shown)]).collect()
        for u in unresolved:
            u["samples"] = [v for r in texts if (v := r[shown.index(u["column"])]) is not None]
    return Profile(out, unresolved)


def _column(m: ColumnMeta, best: Finding, review: bool) -> ColumnConfig:
    return ColumnConfig(m.declared, best.suggested_type, best.transform, best.confidence, f"heuristic:{best.heuristic}", best.rationale, needs_review=review, primary_key_seq=m.key_seq, not_null=m.not_null)
