"""What a value would become under another target type, and which types a column could take."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellprobe.functions import cells, jsons, transforms
from cellprobe.operators.heuristics import EPOCH_SECONDS, EXCEL_SERIALS, JULIAN_DAYS

# --- Fixed values -------------------------------------------------------------------------------------
TYPES = ("text", "smallint", "integer", "bigint", "real", "double precision", "numeric", "boolean", "date", "timestamptz", "jsonb", "bytea", "uuid", "uuid[]")
# ------------------------------------------------------------------------------------------------------
_RESULT = "struct<display:string,transform:string,valid:boolean>"


def numeric_affinity(declared: str) -> bool:
    """Whether SQLite gives a column of that declared type a numeric affinity."""
    d = declared.upper()
    if "INT" in d:
        return True
    return not (any(p in d for p in ("CHAR", "CLOB", "TEXT", "BLOB")) or not d)


def _result(display: Column, transform: str, valid: Column) -> Column:
    ok = F.coalesce(valid, F.lit(False))
    return F.struct(F.when(ok, display).otherwise(F.col("v")).alias("display"), F.when(ok, F.lit(transform)).otherwise("").alias("transform"), ok.alias("valid")).cast(_RESULT)


def _first(*options: tuple[Column, Column]) -> Column:
    """The value of the first condition that holds."""
    return functools.reduce(lambda rest, o: F.when(o[0], o[1]).otherwise(rest), reversed(options), _result(F.col("v"), "", F.lit(False)))


def _dates(target: str) -> Column:
    number = F.expr(transforms._float("v"))
    spell = lambda name, cell: F.date_format(transforms.value(name, cell), "yyyy-MM-dd" if target == "date" else "yyyy-MM-dd'T'HH:mm:ss'Z'")
    out = []
    if target == "timestamptz":
        for scale, name in ((1, "unix_epoch_seconds"), (1000, "unix_epoch_millis"), (1000000, "unix_epoch_micros")):
            low, high = (x * scale for x in EPOCH_SECONDS)
            out.append(((number == F.floor(number)) & number.between(low, high), name, "n"))
        out.append((number.between(*EXCEL_SERIALS), "excel_serial_to_timestamptz", "n"))
        texts = ("iso8601_to_timestamptz", "dayfirst_to_timestamptz")
    else:
        out.append((number.between(*JULIAN_DAYS), "julian_day_to_date", "n"))
        texts = ("iso8601_to_date", "yyyymmdd_to_date")
    out += [(transforms.value(name, "t").isNotNull(), name, "t") for name in texts]
    return _first(*[(F.coalesce(ok, F.lit(False)), _result(spell(name, cell), name, F.lit(True))) for ok, name, cell in out])


def preview(values: DataFrame, value: str, target: str, declared: str = "") -> DataFrame:
    """Adds ``preview``: struct (display, transform, valid) of a text column under a target type. 'NULL' stays NULL."""
    df = values.withColumn("v", F.col(value))
    df = df.withColumn("t", cells.text(F.col("v"))).withColumn("n", cells.real(F.expr(transforms._float("v"))))
    base = target.split("(")[0]
    if base in transforms.INT_RANGES:
        text = F.col("v")
        if numeric_affinity(declared):
            text = F.when(F.col("v").rlike("[eE]"), F.coalesce(F.expr("cast(try_cast(v AS decimal(38,0)) AS string)"), F.col("v"))).otherwise(F.col("v"))
        df = df.withColumn("t", cells.text(text))
        number = transforms.value("numeric_text_to_integer", "t")
        most = transforms.INT_RANGES[base]
        shown = F.when(F.col("v") == "", F.lit("NULL")).otherwise(number.cast("string"))
        result = _result(shown, "numeric_text_to_integer", (F.col("v") == "") | (number >= F.lit(-most)) & (number <= F.lit(most - 1)))
    elif base in ("real", "double precision", "numeric"):
        number = F.expr(transforms._float("v"))
        plain = F.expr("cast(cast(try_cast(v AS decimal(38,17)) AS string) AS string)")
        shown = F.when(number == F.floor(number), F.concat(F.format_string("%.0f", number), F.lit(".0"))).otherwise(F.coalesce(F.regexp_replace(plain, r"0+\z", ""), number.cast("string")))
        result = _result(shown, "", number.isNotNull())
    elif base == "boolean":
        flag = transforms.value("int_to_bool", "t")
        result = _result(flag.cast("string"), "int_to_bool", flag.isNotNull())
    elif base in ("date", "timestamptz"):
        result = _dates(base)
    elif base == "uuid":
        result = _result(F.col("v"), "uuid_format", F.expr(f"v RLIKE '{transforms.UUID}'"))
    elif base == "uuid[]":
        result = _result(F.col("v"), "uuid_list_format", F.col("v").isNotNull() & transforms.value("uuid_list_format", "t").isNotNull())
    elif base == "jsonb":
        result = _result(F.col("v"), "text_to_jsonb", jsons.valid(F.col("v")))
    else:
        result = _result(F.col("v"), "", F.lit(True))
    null = F.struct(F.lit("NULL").alias("display"), F.lit("").alias("transform"), F.lit(True).alias("valid")).cast(_RESULT)
    return df.withColumn("preview", F.when(F.col("v").isNull() | (F.col("v") == "NULL"), null).otherwise(result)).drop("v", "t", "n")


def type_support(values: DataFrame, value: str, target: str, declared: str = "") -> DataFrame:
    """One row (valid, transform): whether every value is valid under the type, and the one transform for all, if there is one."""
    p = preview(values, value, target, declared).select("preview.*")
    used = F.collect_set(F.when(F.col("display") != "NULL", F.col("transform")))
    return p.agg(F.coalesce(F.bool_and("valid"), F.lit(True)).alias("valid"), used.alias("_used")).select("valid", F.when(F.col("valid") & (F.size("_used") <= 1), F.coalesce(F.try_element_at("_used", F.lit(1)), F.lit(""))).alias("transform"))


def valid_types(values: DataFrame, value: str, current: str, declared: str = "") -> list[str]:
    """The current type and every other that all values are valid under."""
    return [t for t in TYPES if t == current or type_support(values, value, t, declared).first()["valid"]]


def choose(values: DataFrame, value: str, current: str, current_transform: str, target: str, declared: str = "") -> str:
    """The transform for a chosen type: that of the same type stays; else the one that serves all values."""
    if target == current:
        return current_transform
    row = type_support(values, value, target, declared).first()
    if not row["valid"] or row["transform"] is None:
        raise ValueError(f"no single transform makes {target} of every value")
    return row["transform"]
