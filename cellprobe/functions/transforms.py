"""The 21 named transforms, each a pair of expressions: the value, and whether the input is an error.

NULL is a legitimate value (NULL in, or an empty text for some transforms), so an error is told apart from it;
``loaded`` raises it. Values are exact or an error: integers never pass through double.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellprobe.functions import jsons
from cellprobe.functions import temporal as t
from cellprobe.functions.cells import TEXT_OF, sql

# --- Fixed values -------------------------------------------------------------------------------------
SENTINELS = ("unknown", "n/a", "na", "none", "null", "missing", "-")
#: Days from 1970-01-01 of the first of January -4712; seconds of the largest timestamp that Spark holds.
FIRST_DAY, LAST_SECOND = -2440550, 9223372036854
EXCEL_EPOCH_DAY = -25569
JULIAN_EPOCH = 2440588
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\\z"
UUID_BARE = r"^[0-9a-fA-F]{32}\\z"
PLAIN_NUMBER = r"^-?\\d+(\\.\\d+)?\\z"
COMMA_NUMBER = r"^-?\\d{1,3}(,\\d{3})+(\\.\\d+)?\\z"
# ------------------------------------------------------------------------------------------------------

_FLOAT = r"^[+-]?((\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?|(?i:inf|infinity|nan))\\z"
_SENTINEL_LIST = ", ".join(f"'{x}'" for x in SENTINELS)


@dataclass(frozen=True)
class Transform:
    """``value`` and ``error`` are SQL templates over a cell; ``type`` is the value's Spark type."""

    type: str
    value: str
    error: str


def _int(s: str) -> str:
    return rf"CASE WHEN {s} RLIKE '^[+-]?[0-9]+\\z' THEN try_cast({s} AS bigint) END"


def _float(s: str) -> str:
    """A double of Go's grammar, NULL if out of range."""
    return rf"CASE WHEN {s} RLIKE '{_FLOAT}' THEN CASE WHEN {s} RLIKE '(?i)inf|nan' THEN cast(regexp_replace({s}, '(?i)^([+-]?)(inf|infinity)\\z', '$1Infinity') AS double) WHEN abs(try_cast({s} AS double)) = double('Infinity') THEN NULL ELSE try_cast({s} AS double) END END"


#: A double cell as an exact integer, if it is one.
_WHOLE = "CASE WHEN {c}.d = floor({c}.d) AND {c}.d >= -9223372036854775808D AND {c}.d < 9223372036854775808D THEN try_cast({c}.d AS bigint) END"
_NUMERIC = "{c}.k IN ('integer', 'real')"
_D = "CASE {c}.k WHEN 'integer' THEN cast({c}.i AS double) WHEN 'real' THEN {c}.d END"


def _pair(type_: str, value: str, empty_is_null: bool = False) -> Transform:
    """An error is an input that is not NULL whose value is NULL."""
    missing = "{c} IS NOT NULL AND NOT ({c}.k = 'text' AND {c}.s = '')" if empty_is_null else "{c} IS NOT NULL"
    return Transform(type_, value, f"{missing} AND ({value}) IS NULL")


def _by_class(integer: str = "NULL", real: str = "NULL", text: str = "NULL", blob: str = "NULL") -> str:
    return f"CASE {{c}}.k WHEN 'integer' THEN {integer} WHEN 'real' THEN {real} WHEN 'text' THEN {text} WHEN 'blob' THEN {blob} END"


def _epoch(unit: int) -> str:
    """Units a second -> timestamp; the value is truncated to units, and must name a year from -4712 on."""
    low, high = FIRST_DAY * 86400 * unit, LAST_SECOND * unit
    whole = f"CASE {{c}}.k WHEN 'integer' THEN {{c}}.i WHEN 'real' THEN CASE WHEN NOT isnan({{c}}.d) AND {{c}}.d >= {low}D AND {{c}}.d <= {min(high, 9223372036854774784)}D THEN try_cast({{c}}.d AS bigint) END END"
    made = "timestamp_millis(try_cast({v} AS bigint))" if unit == 1000 else "timestamp_micros({v})"
    return f"CASE WHEN ({whole}) BETWEEN {low} AND {min(high, 2**63 - 1)} THEN {made.replace('{v}', '(' + whole + ')')} END"


_SECONDS = f"CASE WHEN {_NUMERIC} AND NOT isnan({_D}) AND ({_D}) >= {FIRST_DAY * 86400}D AND ({_D}) <= {LAST_SECOND}D THEN timestamp_micros(CASE {{c}}.k WHEN 'integer' THEN {{c}}.i * 1000000 ELSE try_cast(floor({{c}}.d) AS bigint) * 1000000 + try_cast(round(({{c}}.d - floor({{c}}.d)) * 1e6) AS bigint) END) END"
_DAYS = f"CASE WHEN isnan({_D}) THEN 0 WHEN ({_D}) > 2147483647 THEN 2147483647 WHEN ({_D}) < -2147483647 THEN -2147483647 ELSE try_cast(({_D}) AS bigint) END"
_PART = f"CASE WHEN isnan({_D}) OR abs({_D}) = double('Infinity') THEN 0D ELSE ({_D}) - CASE WHEN ({_D}) >= 0 THEN floor({_D}) ELSE ceil({_D}) END END"
_EXCEL_SECONDS = f"(({_DAYS}) + {EXCEL_EPOCH_DAY})"
_EXCEL = f"CASE WHEN {_NUMERIC} AND {_EXCEL_SECONDS} BETWEEN {FIRST_DAY} AND 106751990 THEN timestamp_micros({_EXCEL_SECONDS} * 86400000000 + try_cast(({_PART}) * 86400000000D AS bigint)) END"
_JULIAN = f"CASE WHEN {_NUMERIC} AND abs({_D}) <= 2149923647 THEN date_from_unix_date(try_cast(floor(({_D}) + 0.5D) - {JULIAN_EPOCH} AS int)) END"
_BOOL = _by_class("{c}.i <> 0", f"({_WHOLE}) <> 0", "CASE {c}.s WHEN '1' THEN true WHEN '0' THEN false END")
_UUID = rf"CASE WHEN {{c}}.s RLIKE '{UUID}' THEN lower({{c}}.s) WHEN {{c}}.s RLIKE '{UUID_BARE}' THEN lower(regexp_replace({{c}}.s, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})\\z', '$1-$2-$3-$4-$5')) END"
UUID_PARTS = "split(replace({c}.s, '\\\\␀', char(0)), char(0))"
_LIST = rf"CASE WHEN {{c}}.k = 'text' AND {{c}}.s <> '' AND forall({UUID_PARTS}, p -> p RLIKE '{UUID}') THEN transform({UUID_PARTS}, p -> lower(p)) END"
_NUMBER_TEXT = f"coalesce(cast({_int("replace({c}.s, ',', '')")} AS double), {_float("replace({c}.s, ',', '')")})"
_NO_SENTINEL = f"{{c}}.k = 'text' AND lower({{c}}.s) IN ({_SENTINEL_LIST})"
_SENTINEL_NUMBER = f"CASE WHEN {_NO_SENTINEL} THEN NULL ELSE {_by_class('cast({c}.i AS double)', '{c}.d', f"CASE WHEN {{c}}.s RLIKE '{COMMA_NUMBER}' OR {{c}}.s RLIKE '{PLAIN_NUMBER}' THEN {_NUMBER_TEXT} END")} END"
_INT_TEXT = rf"CASE WHEN {{c}}.s RLIKE '^[+-]?[0-9]+(\\.0*)?\\z' THEN try_cast(regexp_extract({{c}}.s, '^([+-]?[0-9]+)', 1) AS bigint) END"

TRANSFORMS: dict[str, Transform] = {
    "": Transform("string", TEXT_OF, "false"),
    "esri_typename": Transform("string", TEXT_OF, "false"),
    "strip_commas": _pair("bigint", _by_class("{c}.i", _WHOLE, _int("replace({c}.s, ',', '')"))),
    "strip_commas_float": _pair("double", _by_class("cast({c}.i AS double)", "{c}.d", _float("replace({c}.s, ',', '')"))),
    "unix_epoch_seconds": _pair("timestamp", _SECONDS),
    "unix_epoch_millis": _pair("timestamp", _epoch(1000)),
    "unix_epoch_micros": _pair("timestamp", _epoch(1000000)),
    "iso8601_to_timestamptz": _pair("timestamp", f"CASE WHEN {{c}}.k = 'text' THEN {t.of(t.PARSE, '{c}.s')} END"),
    "iso8601_to_date": _pair("date", f"CASE WHEN {{c}}.k = 'text' AND ({t.of(t.PARSE, '{c}.s')}) IS NOT NULL AND ({t.of(t.WALL_MIDNIGHT, '{c}.s')}) THEN {t.of(t.WALL_DATE, '{c}.s')} END"),
    "int_to_bool": _pair("boolean", _BOOL),
    "text_to_jsonb": _pair("string", f"CASE WHEN json_valid_strict({TEXT_OF}) AND {{c}}.k IN ('text', 'blob') THEN {TEXT_OF} END"),
    "julian_day_to_date": _pair("date", _JULIAN),
    "yyyymmdd_to_date": _pair("date", f"CASE WHEN {{c}}.k IN ('text', 'integer') THEN {t.of(t.PARSE_YYYYMMDD, '(' + TEXT_OF + ')')} END"),
    "numeric_text_to_integer": _pair("bigint", _by_class("{c}.i", _WHOLE, _INT_TEXT), True),
    "numeric_text_to_double": _pair("double", _by_class("cast({c}.i AS double)", "{c}.d", _float("{c}.s")), True),
    "excel_serial_to_timestamptz": _pair("timestamp", _EXCEL),
    "dayfirst_to_timestamptz": _pair("timestamp", f"CASE WHEN {{c}}.k = 'text' THEN {t.of(t.PARSE_DAY_FIRST, '{c}.s')} END"),
    "uuid_format": _pair("string", f"CASE WHEN {{c}}.k = 'text' THEN {_UUID} END", True),
    "uuid_list_format": _pair("array<string>", _LIST, True),
    "nullif_sentinels": Transform("double", _SENTINEL_NUMBER, f"{{c}} IS NOT NULL AND NOT ({_NO_SENTINEL}) AND ({_SENTINEL_NUMBER}) IS NULL"),
    "nullif_empty": Transform("string", f"nullif({TEXT_OF}, '')", "false"),
    "drop_column": Transform("string", "cast(NULL AS string)", "true"),
}
#: The exact integer form of ``nullif_sentinels``, for integer targets.
SENTINEL_INTEGER = Transform("bigint", f"CASE WHEN {_NO_SENTINEL} THEN NULL ELSE {_by_class('{c}.i', _WHOLE, _int("replace({c}.s, ',', '')"))} END", "false")
#: What an untransformed cell is for a typed target.
PLAIN_VALUES = {"smallint": "{c}.i", "integer": "{c}.i", "bigint": "{c}.i", "double precision": _D, "real": _D, "numeric": _D, "bytea": "{c}.b", "boolean": _BOOL}

SPARK_TYPES = {"text": "string", "smallint": "smallint", "integer": "int", "bigint": "bigint", "boolean": "boolean", "double precision": "double", "real": "float", "numeric": "double", "date": "date", "timestamptz": "timestamp", "jsonb": "string", "bytea": "binary", "uuid": "string", "uuid[]": "array<string>"}
INT_RANGES = {"smallint": 2**15, "integer": 2**31, "bigint": 2**63}


def transform(name: str) -> Transform:
    """The transform of that name; an unknown name is an error when the plan is built."""
    if name not in TRANSFORMS:
        raise KeyError(f"unknown transform {name!r}")
    return TRANSFORMS[name]


def value(name: str, cell: str = "c") -> Column:
    template = transform(name).value
    if "json_valid_strict" in template:
        valid = jsons.valid(sql(TEXT_OF, cell)) & sql("{c}.k IN ('text', 'blob')", cell)
        return F.when(valid, sql(TEXT_OF, cell))
    return sql(template, cell)


def error(name: str, cell: str = "c") -> Column:
    """True where the input is an error; never NULL."""
    if name == "text_to_jsonb":
        return F.col(cell).isNotNull() & value(name, cell).isNull()
    return F.coalesce(sql(transform(name).error, cell), F.lit(False))


def typed(name: str, target: str, cell: str = "c") -> Column:
    """The value in the Spark type of a target type."""
    base = target.split("(")[0]
    kind = SPARK_TYPES.get(base, "string")
    if name == "nullif_sentinels" and base in INT_RANGES:
        out = sql(SENTINEL_INTEGER.value, cell)
    elif name in ("", "esri_typename") and base in PLAIN_VALUES:
        out = sql(PLAIN_VALUES[base], cell)
    elif name in ("", "esri_typename") and base in ("timestamptz", "date"):
        out = sql(t.of(t.PARSE, "{c}.s"), cell)
    else:
        out = value(name, cell)
    return out if kind in ("array<string>",) else out.try_cast(kind)


def fits(name: str, target: str, cell: str = "c") -> Column:
    """Whether the transformed value is in the range of the target; NULL fits."""
    base = target.split("(")[0]
    out = value(name, cell) if name not in ("", "esri_typename") else None
    if base in INT_RANGES:
        number = sql("{c}.i", cell) if out is None else out
        most = INT_RANGES[base]
        return F.coalesce((number >= F.lit(-most)) & (number <= F.lit(most - 1)), F.lit(True))
    if base in ("date", "timestamptz") and out is not None:
        return F.coalesce(F.year(out).between(-4712, 5874897 if base == "date" else 294276), F.lit(True))
    if base == "varchar":
        return F.coalesce(F.length(sql(TEXT_OF, cell)) <= int(target.split("(")[1].rstrip(")")), F.lit(True))
    return F.lit(True)


def loaded(name: str, target: str, cell: str = "c") -> Column:
    """The typed value for a load; an erroneous or unfitting input fails the job."""
    message = F.concat(F.lit(f"{name or 'passthrough'} cannot turn into {target}: "), F.coalesce(sql(TEXT_OF, cell), F.lit("NULL")))
    return F.when(error(name, cell) | ~fits(name, target, cell), F.raise_error(message).cast(SPARK_TYPES.get(target.split("(")[0], "string"))).otherwise(typed(name, target, cell))
