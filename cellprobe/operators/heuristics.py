"""Type-inference heuristics as counters of one aggregate plus a pure decision on the counters.

``COUNTERS`` are SQL templates over a cell, the same for every column, so all heuristics of all columns are
one grouped aggregate. Whether a heuristic applies depends on the declared type and the column's name alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from cellprobe.functions import temporal as t
from cellprobe.functions.cells import NUMBER_OF, TEXT_OF
from cellprobe.functions.transforms import COMMA_NUMBER, PLAIN_NUMBER, SENTINELS, UUID, UUID_PARTS

# --- Fixed values: windows of plausible values --------------------------------------------------------
EPOCH_SECONDS = (946684800, 2051222400)
EXCEL_SERIALS = (36526, 49310)
JULIAN_DAYS = (1721425.5, 2816787.5)
INT4 = (-(2**31), 2**31 - 1)
ESRI_TYPES = {"int32": ("integer", "esri_typename"), "float32": ("double precision", "esri_typename"), "float64": ("double precision", "esri_typename"), "geometryblob": ("__drop__", "drop_column")}
MAX_VARCHAR = 10_485_760
# ------------------------------------------------------------------------------------------------------

_TEXT, _S = "{c}.k = 'text'", "{c}.s"
_FILLED = f"{_TEXT} AND {_S} <> ''"
_NO_COMMAS = "replace({c}.s, ',', '')"
_NUM = NUMBER_OF
_YMD_TEXT = f"({TEXT_OF})"


def _epoch_counter(scale: int) -> str:
    low, high = (x * scale for x in EPOCH_SECONDS)
    return f"count_if({{c}}.k = 'integer' AND {{c}}.i BETWEEN {low} AND {high})"


#: By name: an aggregate over the cells of one column.
COUNTERS: dict[str, str] = {
    "n": "count({c})",
    "n_int": "count_if({c}.k = 'integer')",
    "n_real": "count_if({c}.k = 'real')",
    "n_text": f"count_if({_TEXT})",
    "n_blob": "count_if({c}.k = 'blob')",
    "int_beyond_int4": f"count_if({{c}}.k = 'integer' AND {{c}}.i NOT BETWEEN {INT4[0]} AND {INT4[1]})",
    "filled": f"count_if({_FILLED})",
    "max_len": f"max(length({TEXT_OF}))",
    "not_int01": "count_if({c} IS NOT NULL AND NOT ({c}.k = 'integer' AND {c}.i IN (0, 1)))",
    "not_text01": f"count_if({{c}} IS NOT NULL AND NOT ({_TEXT} AND {_S} IN ('0', '1')))",
    "comma": f"count_if({_FILLED} AND {_S} RLIKE '{COMMA_NUMBER}')",
    "comma_bad": f"count_if({_FILLED} AND NOT ({_S} RLIKE '{COMMA_NUMBER}' OR {_S} RLIKE '{PLAIN_NUMBER}'))",
    "number_point": f"count_if({_FILLED} AND contains({_S}, '.'))",
    "comma_big": f"count_if({_FILLED} AND {_S} RLIKE '{COMMA_NUMBER}' AND NOT contains({_S}, '.') AND coalesce(try_cast({_NO_COMMAS} AS bigint) NOT BETWEEN {INT4[0]} AND {INT4[1]}, true))",
    "day_first_bad": f"count_if({_TEXT} AND ({t.of(t.PARSE_DAY_FIRST, _S)}) IS NULL)",
    "day_first_proven": f"count_if({_TEXT} AND day({t.of(t.PARSE_DAY_FIRST, _S)}) > 12)",
    "excel": f"count_if(({_NUM}) BETWEEN {EXCEL_SERIALS[0]} AND {EXCEL_SERIALS[1]})",
    "iso_bad": f"count_if({_FILLED} AND ({t.of(t.PARSE, _S)}) IS NULL)",
    "iso_time": f"count_if({_FILLED} AND ({t.of(t.PARSE, _S)}) IS NOT NULL AND NOT ({t.of(t.WALL_MIDNIGHT, _S)}))",
    "julian": f"count_if(({_NUM}) BETWEEN {JULIAN_DAYS[0]}D AND {JULIAN_DAYS[1]}D)",
    "plain_bad": f"count_if({_FILLED} AND NOT {_S} RLIKE '{PLAIN_NUMBER}')",
    "leading_zero": f"count_if({_FILLED} AND {_S} RLIKE '^-?0[0-9]')",
    "fraction": f"count_if({_FILLED} AND {_S} RLIKE '{PLAIN_NUMBER}' AND try_cast({_S} AS double) <> floor(try_cast({_S} AS double)))",
    "plain_big": f"count_if({_FILLED} AND {_S} RLIKE '{PLAIN_NUMBER}' AND try_cast({_S} AS double) NOT BETWEEN {INT4[0]}D AND {INT4[1]}D)",
    "sentinel": f"count_if({_TEXT} AND lower({_S}) IN ({', '.join(repr(x) for x in SENTINELS)}))",
    "number_text": f"count_if({_TEXT} AND ({_S} RLIKE '{COMMA_NUMBER}' OR {_S} RLIKE '{PLAIN_NUMBER}'))",
    "number_text_big": f"count_if({_TEXT} AND ({_S} RLIKE '{COMMA_NUMBER}' OR {_S} RLIKE '{PLAIN_NUMBER}') AND NOT contains({_S}, '.') AND coalesce(try_cast({_NO_COMMAS} AS bigint) NOT BETWEEN {INT4[0]} AND {INT4[1]}, true))",
    "epoch_seconds": _epoch_counter(1),
    "epoch_millis": _epoch_counter(1000),
    "epoch_micros": _epoch_counter(1000000),
    "uuid_bad": f"count_if({_FILLED} AND NOT {_S} RLIKE '{UUID}')",
    "uuid_list_bad": f"count_if({_FILLED} AND NOT forall({UUID_PARTS}, p -> p RLIKE '{UUID}'))",
    "uuid_list_multi": f"count_if({_FILLED} AND size({UUID_PARTS}) > 1)",
    "ymd_bad": f"count_if({{c}} IS NOT NULL AND NOT ({{c}}.k IN ('text', 'integer') AND ({t.of(t.PARSE_YYYYMMDD, _YMD_TEXT)}) IS NOT NULL))",
}
#: Counters that need the strict JSON check; ``{geo}`` stands for a boolean column that holds it.
GEO_COUNTERS = {"geojson_bad": f"count_if({_FILLED} AND NOT {{geo}})"}


@dataclass(frozen=True)
class Finding:
    suggested_type: str
    confidence: float
    rationale: str
    transform: str = ""
    heuristic: str = ""


Counts = Mapping[str, int | None]


@dataclass(frozen=True)
class Heuristic:
    name: str
    applies: Callable[[str, str], bool]  # column name, declared type
    evaluate: Callable[[Counts, str, str], Finding | None]


REGISTRY: list[Heuristic] = []


def heuristic(name: str, applies: Callable[[str, str], bool]):
    """Registers a decision; findings come in the order of registration."""

    def register(evaluate):
        REGISTRY.append(Heuristic(name, applies, evaluate))
        return evaluate

    return register


def _has(*parts: str) -> Callable[[str], bool]:
    return lambda declared: any(p in declared.upper() for p in parts)


_textual, _numeric = _has("TEXT", "CHAR"), _has("INT", "REAL", "FLOA", "DOUB")
_id_name = re.compile(r"_?id\Z", re.I)
_date_name = re.compile("date", re.I)
_time_name = re.compile(r"(_at|_time|_date)\Z|^last_", re.I)


def _int_or_big(big: int | None) -> str:
    return "bigint" if big else "integer"


@heuristic("boolean01", lambda name, d: (_has("INT")(d) or _textual(d)) and not _id_name.search(name))
def _boolean(c: Counts, name: str, declared: str) -> Finding | None:
    if not c["n"]:
        return None
    if _textual(declared):
        return None if c["not_text01"] else Finding("boolean", 0.88, "every value is the text 0 or 1", "int_to_bool")
    return None if c["not_int01"] else Finding("boolean", 0.55, "every value is 0 or 1", "int_to_bool")


@heuristic("comma_formatted_number", lambda name, d: True)
def _comma(c: Counts, name: str, declared: str) -> Finding | None:
    if not c["comma"] or c["comma_bad"]:
        return None
    if c["number_point"]:
        return Finding("double precision", 0.95, "numbers with thousands separators and fractions", "strip_commas_float")
    return Finding(_int_or_big(c["comma_big"]), 0.95, "numbers with thousands separators", "strip_commas")


@heuristic("day_first_date", lambda name, d: _textual(d) and bool(_date_name.search(name)))
def _day_first(c: Counts, name: str, declared: str) -> Finding | None:
    if c["day_first_bad"] or not c["day_first_proven"]:
        return None
    return Finding("timestamptz", 0.90, "day-first dates, some with a day above 12", "dayfirst_to_timestamptz")


@heuristic("esri_typename_mapping", lambda name, d: d.lower() in ESRI_TYPES)
def _esri(c: Counts, name: str, declared: str) -> Finding | None:
    kind, transform = ESRI_TYPES[declared.lower()]
    return Finding(kind, 0.99, f"geodatabase type {declared}", transform)


@heuristic("excel_serial_date", lambda name, d: _numeric(d) and bool(_time_name.search(name)))
def _excel(c: Counts, name: str, declared: str) -> Finding | None:
    numbers = c["n_int"] + c["n_real"]
    if not numbers or 2 * c["excel"] < numbers:
        return None
    return Finding("timestamptz", 0.85, "spreadsheet serial dates", "excel_serial_to_timestamptz")


@heuristic("geojson_text", lambda name, d: _textual(d))
def _geojson(c: Counts, name: str, declared: str) -> Finding | None:
    if not c["filled"] or c.get("geojson_bad") != 0:
        return None
    return Finding("jsonb", 0.90, "GeoJSON objects", "text_to_jsonb")


@heuristic("iso8601_timestamp", lambda name, d: _has("TEXT", "CHAR", "DATE", "TIME")(d))
def _iso(c: Counts, name: str, declared: str) -> Finding | None:
    if not c["filled"] or c["iso_bad"]:
        return None
    if c["iso_time"]:
        return Finding("timestamptz", 0.90, "timestamps in a known layout", "iso8601_to_timestamptz")
    return Finding("date", 0.90, "dates in a known layout, all at midnight", "iso8601_to_date")


@heuristic("esri_julian_day", lambda name, d: d.lower() == "realdate")
def _julian(c: Counts, name: str, declared: str) -> Finding | None:
    numbers = c["n_int"] + c["n_real"]
    if not numbers or c["julian"] != numbers:
        return None
    return Finding("date", 0.90, "Julian day numbers", "julian_day_to_date")


@heuristic("numeric_text", lambda name, d: _textual(d))
def _numeric_text(c: Counts, name: str, declared: str) -> Finding | None:
    if not c["filled"] or c["n"] != c["n_text"] or c["plain_bad"] or c["leading_zero"]:
        return None
    if c["fraction"]:
        return Finding("double precision", 0.85, "numbers with fractions, as text", "numeric_text_to_double")
    return Finding(_int_or_big(c["plain_big"]), 0.90, "whole numbers, as text", "numeric_text_to_integer")


@heuristic("sentinel_null", lambda name, d: _numeric(d))
def _sentinel(c: Counts, name: str, declared: str) -> Finding | None:
    numbers = c["n_int"] + c["n_real"] + c["number_text"]
    if not numbers or not c["sentinel"] or c["n_text"] != c["sentinel"] + c["number_text"]:
        return None
    if c["n_real"] or c["number_point"]:
        return Finding("double precision", 0.85, "numbers and words for a missing value", "nullif_sentinels")
    return Finding(_int_or_big(c["int_beyond_int4"] + c["number_text_big"]), 0.85, "whole numbers and words for a missing value", "nullif_sentinels")


def _epoch(counter: str, transform: str):
    def evaluate(c: Counts, name: str, declared: str) -> Finding | None:
        if not c["n_int"] or 2 * c[counter] < c["n_int"]:
            return None
        return Finding("timestamptz", 0.85, f"{transform.rpartition('_')[2]} since 1970", transform)

    heuristic(transform, lambda name, d: _has("INT")(d) and bool(_time_name.search(name)))(evaluate)


_epoch("epoch_seconds", "unix_epoch_seconds")
_epoch("epoch_micros", "unix_epoch_micros")
_epoch("epoch_millis", "unix_epoch_millis")


@heuristic("uuid_format", lambda name, d: _textual(d))
def _uuid(c: Counts, name: str, declared: str) -> Finding | None:
    if not c["filled"] or c["uuid_bad"]:
        return None
    return Finding("uuid", 0.90, "UUIDs", "uuid_format")


@heuristic("uuid_list", lambda name, d: _textual(d))
def _uuid_list(c: Counts, name: str, declared: str) -> Finding | None:
    if not c["filled"] or c["uuid_list_bad"] or not c["uuid_list_multi"]:
        return None
    return Finding("uuid[]", 0.90, "lists of UUIDs", "uuid_list_format")


@heuristic("yyyymmdd_date", lambda name, d: _has("INT", "TEXT", "CHAR")(d) and bool(_date_name.search(name)))
def _ymd(c: Counts, name: str, declared: str) -> Finding | None:
    if not c["n"] or c["ymd_bad"]:
        return None
    return Finding("date", 0.95, "eight-digit calendar dates", "yyyymmdd_to_date")


def declared_varchar(declared: str) -> int | None:
    """N of VARCHAR(N)."""
    m = re.fullmatch(r"\s*VARCHAR\s*\(\s*(\d+)\s*\)\s*", declared, re.I)
    return int(m[1]) if m else None


def varchar_finding(declared: str, lengths: set[int], longest: int | None) -> Finding | None:
    """Keeps a VARCHAR's length, widened to the longest value, if the table's lengths are not all the same."""
    n = declared_varchar(declared)
    if n is None or len(lengths) < 2:
        return None
    n = max(n, longest or 0)
    kind = "text" if n > MAX_VARCHAR else f"varchar({n})"
    return Finding(kind, 0.50, "declared length, widened to the longest value", "", "varchar_length_preservation")


def findings(counts: Counts, name: str, declared: str) -> list[Finding]:
    """What all applicable heuristics find, in registration order."""
    out = []
    for h in REGISTRY:
        if h.applies(name, declared) and (f := h.evaluate(counts, name, declared)):
            out.append(Finding(f.suggested_type, f.confidence, f.rationale, f.transform, h.name))
    return out
