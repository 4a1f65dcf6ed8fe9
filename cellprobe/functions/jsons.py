"""Strict JSON: validity, GeoJSON shape, and a canonical form with exact numbers, as Arrow UDFs.

Spark's own parser takes trailing text and refuses repeated keys; JSON proper is the other way round. This is
the one place of the profiling engine that runs Python.
"""

from __future__ import annotations

import json
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType, StringType


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


class _Number(str):
    """A number as written."""


def _load(text: str | None):
    if text is None:
        raise ValueError("null")
    return json.loads(text, parse_constant=_refuse, parse_float=_Number, parse_int=_Number)


def is_valid(text: str | None) -> bool:
    try:
        _load(text)
    except (ValueError, RecursionError):
        return False
    return True


def is_geojson(text: str | None) -> bool:
    """A JSON object with the keys ``type`` and ``coordinates``."""
    try:
        found = _load(text)
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and {"type", "coordinates"} <= found.keys()


def _written(x) -> str:
    if isinstance(x, _Number):
        try:
            return str(Fraction(str(x))) if len(x) < 400 and abs(int(x.lower().partition("e")[2] or 0)) < 400 else str(x)
        except ValueError:
            return str(x)
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_written(x[k])}" for k in sorted(x)) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_written, x)) + "]"
    return json.dumps(x)


def canonical_text(text: str | None) -> str | None:
    """Sorted keys, exact numbers, no white space; what is no JSON stays as it is."""
    try:
        return _written(_load(text))
    except (ValueError, RecursionError):
        return text


@arrow_udf(BooleanType())
def _valid(texts: pa.Array) -> pa.Array:
    return pa.array([is_valid(x.as_py()) for x in texts], pa.bool_())


@arrow_udf(BooleanType())
def _geo(texts: pa.Array) -> pa.Array:
    return pa.array([is_geojson(x.as_py()) for x in texts], pa.bool_())


@arrow_udf(StringType())
def _canonical(texts: pa.Array) -> pa.Array:
    return pa.array([canonical_text(x.as_py()) for x in texts], pa.string())


def valid(text: Column) -> Column:
    return _valid(text)


def geojson(text: Column) -> Column:
    return _geo(text)


def canonical(text: Column) -> Column:
    return _canonical(text)
