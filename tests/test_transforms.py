"""Case tables of transforms: input cell -> value, or an error."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellprobe.functions import cells, jsons, transforms

ERROR = object()
UTC = datetime.datetime


def cell(v):
    kind = {int: "integer", float: "real", str: "text", bytes: "blob"}.get(type(v))
    return None if v is None else (kind, v if kind == "integer" else None, v if kind == "real" else None, v if kind == "text" else None, v if kind == "blob" else None)


CASES = {
    "strip_commas": [("1,234", 1234), ("-5", -5), ("9223372036854775807", 2**63 - 1), ("9223372036854775808", ERROR), (" 12 ", ERROR), ("1.5", ERROR), (7, 7), (2.0, 2), (1.5, ERROR), (float("nan"), ERROR), (1e300, ERROR), (b"x", ERROR), (None, None)],
    "strip_commas_float": [("1,234.5", 1234.5), ("12d", ERROR), ("1e400", ERROR), (3, 3.0), (2.5, 2.5), ("1e3", 1000.0)],
    "unix_epoch_seconds": [(0, UTC(1970, 1, 1)), (1.5, UTC(1970, 1, 1, 0, 0, 1, 500000)), ("0", ERROR), (2**63 - 1, ERROR), (float("inf"), ERROR)],
    "unix_epoch_millis": [(1500, UTC(1970, 1, 1, 0, 0, 1, 500000)), (1500.9, UTC(1970, 1, 1, 0, 0, 1, 500000)), (2**63 - 1, ERROR)],
    "unix_epoch_micros": [(1, UTC(1970, 1, 1, 0, 0, 0, 1))],
    "iso8601_to_timestamptz": [("2021-03-04T05:06:07Z", UTC(2021, 3, 4, 5, 6, 7)), ("2021-03-04T05:06:07.25+02:00", UTC(2021, 3, 4, 3, 6, 7, 250000)), ("4/1/2006 3:04:05 PM", UTC(2006, 4, 1, 15, 4, 5)), ("4/1/2006 3:04:05 pm", ERROR), ("Sep 27, 2021", UTC(2021, 9, 27)), ("27 September 2021", UTC(2021, 9, 27)), ("2021-9-7", ERROR), ("2021-02-30", ERROR), ("2021-03-04\n", ERROR)],
    "iso8601_to_date": [("2021-03-04", datetime.date(2021, 3, 4)), ("2021-03-04T00:00:00+05:00", datetime.date(2021, 3, 4)), ("2021-03-04 00:00:01", ERROR), ("4/1/2006 12:00:00 AM", datetime.date(2006, 4, 1))],
    "int_to_bool": [("1", True), ("0", False), ("2", ERROR), ("", ERROR), (2, True), (0, False), (1.0, True), (0.5, ERROR)],
    "text_to_jsonb": [('{"a": 1, "a": 2}', '{"a": 1, "a": 2}'), ("{} x", ERROR), ("NaN", ERROR), ("01", ERROR), (b"[1]", "[1]"), (5, ERROR)],
    "julian_day_to_date": [(2459215.5, datetime.date(2021, 1, 1)), (2440588, datetime.date(1970, 1, 1)), ("x", ERROR)],
    "yyyymmdd_to_date": [(20210228, datetime.date(2021, 2, 28)), ("20210230", ERROR), ("2021022", ERROR)],
    "numeric_text_to_integer": [("2124037125711300644", 2124037125711300644), ("1998.0", 1998), ("1998.", 1998), ("1998.5", ERROR), ("", None), (" 5", ERROR)],
    "numeric_text_to_double": [("1.5", 1.5), ("", None), ("x", ERROR)],
    "excel_serial_to_timestamptz": [(44197, UTC(2021, 1, 1)), (44197.5, UTC(2021, 1, 1, 12)), (float("nan"), UTC(1899, 12, 30)), ("44197", ERROR)],
    "dayfirst_to_timestamptz": [("27/3/2018", UTC(2018, 3, 27)), ("2/3/2018 1:02:03 PM", UTC(2018, 3, 2, 13, 2, 3)), ("2/3/2018 13:02:03", UTC(2018, 3, 2, 13, 2, 3)), ("3/27/2018", ERROR)],
    "uuid_format": [("D0EF5A6E-0000-1111-2222-333344445555", "d0ef5a6e-0000-1111-2222-333344445555"), ("d0ef5a6e000011112222333344445555", "d0ef5a6e-0000-1111-2222-333344445555"), ("", None), ("x", ERROR)],
    "uuid_list_format": [("d0ef5a6e-0000-1111-2222-333344445555\\␀D0EF5A6E-0000-1111-2222-333344445556", ["d0ef5a6e-0000-1111-2222-333344445555", "d0ef5a6e-0000-1111-2222-333344445556"]), ("a\0b", ERROR), ("", None)],
    "nullif_sentinels": [("Unknown", None), ("N/A", None), ("-", None), ("1,234", 1234.0), (5, 5.0), ("abc", ERROR), ("", ERROR)],
    "nullif_empty": [("", None), ("a", "a")],
    "drop_column": [("a", ERROR), (None, ERROR)],
    "": [(5, "5"), (b"", ""), (None, None)],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    rows = [(i, cell(v)) for i, (v, _) in enumerate(CASES[name])]
    df = spark.createDataFrame(rows, f"n int, c {cells.DDL}")
    got = {r.n: (r.v, r.e) for r in df.select("n", transforms.value(name).alias("v"), transforms.error(name).alias("e")).collect()}
    for i, (source, want) in enumerate(CASES[name]):
        value, failed = got[i]
        assert failed == (want is ERROR), (name, source)
        if want is not ERROR:
            assert value == want, (name, source)


def test_every_transform_has_cases():
    assert set(CASES) | {"esri_typename"} == set(transforms.TRANSFORMS) and len(transforms.TRANSFORMS) == 22


def test_unknown_transform():
    with pytest.raises(KeyError):
        transforms.transform("no_such")


def test_load_fails_on_error(spark):
    df = spark.createDataFrame([(cell("x"),)], f"c {cells.DDL}")
    with pytest.raises(Exception, match="cannot turn into"):
        df.select(transforms.loaded("strip_commas", "integer")).collect()
    with pytest.raises(Exception, match="cannot turn into"):
        spark.createDataFrame([(cell(2**40),)], f"c {cells.DDL}").select(transforms.loaded("", "integer")).collect()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-(2**64), 2**64).map(str), st.integers(-(2**64), 2**64).map("{:,}".format), st.text(max_size=8)), min_size=1, max_size=60))
def test_integers_are_exact_or_an_error(spark, texts):
    df = spark.createDataFrame([(i, cell(t)) for i, t in enumerate(texts)], f"n int, c {cells.DDL}")
    for r in df.select("n", "c.s", transforms.value("strip_commas").alias("v"), transforms.error("strip_commas").alias("e")).collect():
        plain = texts[r.n].replace(",", "")
        try:
            want = int(plain) if plain.isascii() and plain.strip() == plain and "_" not in plain else None
        except ValueError:
            want = None
        want = want if want is not None and -(2**63) <= want < 2**63 else None
        assert r.v == want and r.e == (want is None)


def test_canonical_json():
    assert jsons.canonical_text('{"b": 1.50, "a": [1e2, null]}') == jsons.canonical_text('{"a":[100,null],"b":15e-1}')
    assert jsons.canonical_text("no json") == "no json"
    assert not jsons.is_valid("1 2") and jsons.is_valid('{"a":1,"a":2}') and not jsons.is_valid("NaN")


def test_preview(spark):
    df = spark.createDataFrame([(cell("x" * 41),), (cell(b"ab"),), (None,)], f"c {cells.DDL}")
    assert [r[0] for r in df.select(cells.sql(cells.PREVIEW)).collect()] == ["x" * 40 + "…", "<2 bytes>", "NULL"]


def test_max_lengths_count_characters(spark):
    df = spark.createDataFrame([(cell("héé"), None)], f"a {cells.DDL}, b {cells.DDL}")
    assert [tuple(r) for r in cells.max_text_lengths(df, ["a", "b"]).collect()] == [("a", 3)]


def test_lift(spark):
    df = spark.range(1).select(F.lit(1.5).alias("d"), F.lit(True).alias("b"), F.lit(b"x").alias("y"), F.lit(None).cast("string").alias("n"))
    row = df.select(*[cells.lift(df, c).alias(c) for c in df.columns]).first()
    assert (row.d.k, row.b.i, row.y.b, row.n) == ("real", 1, bytearray(b"x"), None)
