"""Heuristics, arbitration, profiles, keys, verification, DDL, load."""

import datetime
import json
import sqlite3

import pytest
from hypothesis import given
from hypothesis import strategies as st
from test_transforms import cell

from cellprobe import cli, migrate
from cellprobe.functions import cells
from cellprobe.operators import foreign_keys, picker, verify
from cellprobe.operators.heuristics import REGISTRY, Finding
from cellprobe.operators.profile import ColumnMeta, profile
from cellprobe.operators.resolver import decide, sample_summary
from cellprobe.plans import config, ddl, load
from cellprobe.plans.review import Review
from cellprobe.sources import catalog, collation

NAMES = ["boolean01", "comma_formatted_number", "day_first_date", "esri_typename_mapping", "excel_serial_date", "geojson_text", "iso8601_timestamp", "esri_julian_day", "numeric_text", "sentinel_null", "unix_epoch_seconds", "unix_epoch_micros", "unix_epoch_millis", "uuid_format", "uuid_list", "yyyymmdd_date"]
UUIDS = [f"d0ef5a6e-0000-1111-2222-{i:012d}" for i in range(3)]

#: column name, declared type, values -> target, source of the decision, needs review
COLUMNS = [
    ("creation_date", "INTEGER", [20210101, 20201231], "date", "yyyymmdd_date", False),
    ("logged_at", "TEXT", ["4/1/2006 3:04:05 PM"], "timestamptz", "iso8601_timestamp", False),
    ("month_name_date", "TEXT", ["Sep 27, 2021"], "date", "iso8601_timestamp", False),
    ("day_first_date", "TEXT", ["27/3/2018", "2/3/2018"], "timestamptz", "day_first_date", False),
    ("epoch_at", "INTEGER", [1700000000], "timestamptz", "unix_epoch_seconds", True),
    ("epoch_millis_at", "INTEGER", [1700000000000], "timestamptz", "unix_epoch_millis", True),
    ("excel_date", "REAL", [44197.5], "timestamptz", "excel_serial_date", True),
    ("station", "TEXT", UUIDS, "uuid", "uuid_format", False),
    ("stations", "TEXT", [UUIDS[0] + "\\␀" + UUIDS[1]], "uuid[]", "uuid_list", False),
    ("year_founded", "TEXT", ["1998.0", "2001"], "integer", "numeric_text", False),
    ("postal_code", "TEXT", ["07030", "00501"], "text", "default_passthrough", False),
    ("total", "TEXT", ["1,698", "5"], "integer", "comma_formatted_number", False),
    ("boundary", "TEXT", ['{"coordinates": [1], "type": "Point"}'], "jsonb", "geojson_text", False),
    ("fips", "INTEGER", [5, "Unknown"], "integer", "sentinel_null", True),
    ("flag", "INTEGER", [0, 1], "boolean", "boolean01", True),
    ("active", "CHAR(1)", ["0", "1"], "integer", "numeric_text", True),
    ("qty", "INTEGER", [1, 2, "lots-of-it"], "integer", "default_passthrough", True),
    ("big", "INTEGER", [-9007199254740992], "bigint", "default_passthrough", False),
    ("mixed", "NUMERIC", [18, 21.35], "double precision", "default_passthrough", False),
    ("pic", "BLOB", [b"", b"x"], "bytea", "default_passthrough", False),
    ("nothing", "DATETIME", [None], "text", "default_passthrough", False),
    ("shape", "geometryblob", [b"x"], "__drop__", "esri_typename_mapping", False),
    ("opened", "realdate", [2459215.5], "date", "esri_julian_day", False),
]


def test_registry():
    assert [h.name for h in REGISTRY] == NAMES


def test_profile(spark):
    n = max(len(c[2]) for c in COLUMNS)
    rows = [tuple(cell(c[2][i]) if i < len(c[2]) else None for c in COLUMNS) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c[0]}` {cells.DDL}" for c in COLUMNS))
    found = profile(df, [ColumnMeta(c[0], c[1]) for c in COLUMNS]).columns
    got = [(c[0], found[c[0]].target_type, found[c[0]].source.removeprefix("heuristic:"), found[c[0]].needs_review) for c in COLUMNS]
    assert got == [(c[0], *c[3:]) for c in COLUMNS]
    assert found["qty"].confidence == 0.40


def test_full_table_beats_the_sample(spark):
    df = spark.createDataFrame([(cell(f"{i * 1000:,}"),) for i in range(1, 60)] + [(cell("soon"),)], f"amount {cells.DDL}")
    found = profile(df.coalesce(1), [ColumnMeta("amount", "TEXT")], sample=20).columns["amount"]
    assert found.target_type in ("integer", "text") and (found.needs_review or found.target_type == "text")


def test_decide():
    f = lambda kind, c, t="": Finding(kind, c, "", t)
    assert decide([]) == (None, True)
    assert decide([f("a", 0.89)])[1] and not decide([f("a", 0.9)])[1]
    assert decide([f("a", 0.9), f("b", 0.88)])[1] and not decide([f("a", 0.95), f("b", 0.9)])[1]
    assert decide([f("a", 0.9, "x"), f("b", 0.9, "x")])[0].suggested_type == "a"
    assert not decide([f("a", 0.9), f("a", 0.9), f("b", 0.89)])[1]


def test_sample_summary():
    assert sample_summary(list("aab")) == ["a (x2)", "b (x1)"]
    assert sample_summary([str(i) for i in range(12)])[-1] == "... and 2 more distinct value(s)"


def test_containment_of_null(spark):
    child, parent = spark.createDataFrame([(1,), (2,), (None,)], "a int"), spark.createDataFrame([(1,), (None,)], "b int")
    assert tuple(foreign_keys.containment(child, "a", parent, "b").first()) == (0, 2)
    assert tuple(foreign_keys.containment(child, "a", parent.where("b is not null"), "b").first()) == (1, 2)
    assert tuple(foreign_keys.containment(child, "a", parent.limit(0), "b").first()) == (2, 2)
    assert foreign_keys.violating_rows(child, ["a"], parent, ["b"]).count() == 1


def test_verify_finds_one_changed_cell(spark):
    df = spark.createDataFrame([(i, f"v{i % 5}", float(i)) for i in range(50)], "k int, s string, d double")
    bad = df.selectExpr("k", "CASE WHEN k = 7 THEN 'x' ELSE s END AS s", "d")
    assert verify.verify_table("t", df, df, ["k"]).passed()
    result = verify.verify_table("t", df, bad, ["k"])
    assert result.mismatches == {"s": 1} and result.examples[0]["key"] == [7]
    assert verify.verify_table("t", df, df, []).passed()
    assert verify.verify_table("t", df, bad, []).mismatches == {"s": 1}
    assert not verify.verify_table("t", df, bad.limit(49), ["k"]).passed()


def test_integer_equals_double_exactly(spark):
    df = spark.createDataFrame([(2**53 + 1, float(2**53)), (2**53, float(2**53)), (5, 5.5), (1, float("nan"))], "i long, d double")
    assert [r[0] for r in df.select(verify.int_equals_double("i", "d")).collect()] == [False, True, False, False]


@given(st.lists(st.text(min_size=1, max_size=90), min_size=1, max_size=20, unique=True))
def test_identifiers(names):
    out = ddl.unique_names(names)
    assert len(set(out)) == len(out) and all(len(n.encode()) <= 63 for n in out) and out == ddl.unique_names(names)


def test_collations():
    sql = """CREATE TABLE t (a TEXT COLLATE NOCASE, b TEXT DEFAULT 'COLLATE NOCASE', "c d" TEXT CHECK (x COLLATE RTRIM = 1), -- e TEXT COLLATE NOCASE
      f TEXT COLLATE 'rtrim', PRIMARY KEY (a COLLATE NOCASE))"""
    assert collation.parse(sql) == {"a": "NOCASE", "b": "BINARY", "c d": "BINARY", "f": "RTRIM"}
    assert collation.parse("CREATE VIRTUAL TABLE v USING fts5(a)") == {}


def test_database_name():
    now = datetime.datetime(2021, 2, 3, 4, 5, 6)
    assert load.database_name("/x/My File-1.db", now) == "my_file_1_20210203_040506"
    assert load.database_name("1" * 80 + ".db", now).startswith("db_1") and len(load.database_name("a" * 90, now)) == 63


def test_picker(spark):
    values = spark.createDataFrame([("1",), ("0",)], "x string")
    assert picker.valid_types(values, "x", "text") == ["text", "smallint", "integer", "bigint", "real", "double precision", "numeric", "boolean", "jsonb", "bytea"]
    assert picker.choose(values, "x", "text", "", "boolean") == "int_to_bool"
    with pytest.raises(ValueError, match="no single transform"):
        picker.choose(values, "x", "text", "", "uuid")


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.executescript("""CREATE TABLE cities(id INTEGER PRIMARY KEY, name TEXT COLLATE NOCASE);
            CREATE TABLE visits(id INTEGER PRIMARY KEY, city_id INTEGER NOT NULL REFERENCES cities, paid TEXT, pic BLOB);
            CREATE TABLE pairs(a INTEGER, b INTEGER, PRIMARY KEY (a, b));
            CREATE TABLE GDB_Items(x); CREATE TABLE st_things(x);""")
        db.executemany("INSERT INTO cities VALUES (?, ?)", [(i, f"c{i}") for i in range(5)])
        db.executemany("INSERT INTO visits VALUES (?, ?, ?, ?)", [(i, i % 5, f"{i * 1234567:,}" if i > 1 else "1,000", b"" if i % 2 else None) for i in range(1, 40)])
        db.executemany("INSERT INTO pairs VALUES (?, ?)", [(i, j) for i in range(3) for j in range(3)])
    return path


def test_catalog(database):
    found = catalog.read_catalog(database)
    assert [t.name for t in found.tables] == ["cities", "pairs", "visits"] and found.filtered == ["GDB_Items", "st_things"]
    assert found.kind == "esri_geodatabase" and found.tables[0].collations["name"] == "NOCASE"
    assert found.tables[2].foreign_keys[0].ref_columns == ["id"]
    assert [c.key_seq for c in found.tables[1].columns] == [1, 2]


def test_profile_load_verify(spark, database, tmp_path):
    doc, _ = migrate.profile_file(spark, database)
    path = str(tmp_path / "c.yaml")
    review = Review(doc, lambda c: config.save(c, path))
    review.finish()
    doc = config.load(path)
    assert not config.drifted(doc)
    from cellprobe.sources.sqlite_cells import read_table

    read = lambda t: read_table(spark, database, t)
    state, root = str(tmp_path / "state"), str(tmp_path / "out")
    assert load.load(spark, doc, read, root, state) == {"cities": 5, "pairs": 9, "visits": 39}
    results = migrate.verify_load(spark, doc, root, state)
    assert all(r.passed() for r in results), verify.report(results)
    assert load.load(spark, doc, read, root, state, resume=True) == {}
    with open(state) as f:
        assert json.load(f)["fks_applied"]
    with sqlite3.connect(database) as db:
        db.execute("UPDATE visits SET paid = '9,999' WHERE id = 3")
    assert config.drifted(doc)
    with pytest.raises(PermissionError):
        load.load(spark, doc, read, root, str(tmp_path / "s2"))
    assert not all(r.passed() for r in migrate.verify_load(spark, doc, root, state))
    assert "CREATE TABLE" in ddl.dry_run(doc) and "FOREIGN KEY" in ddl.dry_run(doc)
    assert cli.main(["load", path, "--dry-run"]) == 0


def document():
    columns = {"id": config.ColumnConfig("INTEGER", "bigint", primary_key_seq=1, confidence=1.0), "on": config.ColumnConfig("INTEGER", "boolean", "int_to_bool", 0.5, needs_review=True), "old": config.ColumnConfig("TEXT", config.DROP, confidence=0.4)}
    other = config.TableConfig(columns={"id": config.ColumnConfig("INTEGER", "bigint", primary_key_seq=1, confidence=1.0)}, column_order=["id"])
    return config.MigrationConfig("x", tables={"a.b": config.TableConfig(columns=columns, column_order=list(columns)), "c": other})


def test_answers():
    doc = document()
    config.apply_answers(doc, {"a.b.on": {"type": "integer"}})
    on = doc.tables["a.b"].columns["on"]
    assert (on.target_type, on.transform, on.source, on.reviewed, on.needs_review) == ("integer", "", "human_override", True, True)
    config.apply_answers(doc, {"a.b.on": {"type": "boolean", "transform": "int_to_bool", "rationale": "said so"}})
    assert (on.target_type, on.transform, on.rationale) == ("boolean", "int_to_bool", "said so")
    config.apply_answers(doc, {"a.b.on": {"type": "boolean"}})
    assert on.transform == "int_to_bool"
    before = (on.target_type, on.transform)
    for wrong, error in (({"a.b.on": {"type": "text"}, "a.b.no": {"type": "text"}}, KeyError), ({"a.b.on": {"type": "text", "kind": "x"}}, ValueError)):
        with pytest.raises(error):
            config.apply_answers(doc, wrong)
        assert (on.target_type, on.transform) == before


def test_gate_passes_over_dropped_columns():
    doc = document()
    assert [r.split(":")[0] for r in load.gate(doc, check_source=False)] == ["a.b.on"]
    doc.tables["a.b"].columns["on"].reviewed = True
    assert load.gate(doc, check_source=False) == []


def test_keys_that_the_target_lacks():
    doc = document()
    key = lambda own, table, ref: ddl.invalid_reason(doc, "a.b", config.ForeignKey([own], table, [ref]))
    assert key("on", "c", "id") == ""
    assert '"a.b"."old"' in key("old", "c", "id") and '"c"."x"' in key("on", "c", "x") and '"gone"' in key("on", "gone", "id")
    doc.tables["c"].include = False
    assert '"c"' in key("on", "c", "id")


def test_report_shows_samples_and_findings(spark, tmp_path):
    import yaml

    from cellprobe.operators.resolver import FileResolver

    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,) for x in [0, 1, 1, 1, 0, 1]], "v int").select(cells.integer(F.col("v")).alias("flag"))
    cases = profile(df, [ColumnMeta("flag", "INTEGER")], "t").unresolved
    FileResolver(str(tmp_path / "r.yaml")).resolve(cases)
    told = yaml.safe_load((tmp_path / "r.yaml").read_text())["unresolved"]
    assert told and all(case["samples"] == ["1 (x4)", "0 (x2)"] and case["findings"] and case["table"] == "t" for case in told)


def test_transformed_keys_are_compared_as_multisets(spark, tmp_path):
    path = str(tmp_path / "k.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t(day TEXT PRIMARY KEY, v INTEGER)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [("2021-01-02", 1), ("Jan 2, 2021", 2), ("2021-01-03", 3)])
    columns = {"day": config.ColumnConfig("TEXT", "date", "iso8601_to_date", 1.0, reviewed=True, primary_key_seq=1), "v": config.ColumnConfig("INTEGER", "bigint", confidence=1.0, reviewed=True)}
    doc = config.MigrationConfig(path, config.file_hash(path), tables={"t": config.TableConfig(columns=columns, column_order=["day", "v"])})
    from cellprobe.sources.sqlite_cells import read_table

    state, root = str(tmp_path / "state"), str(tmp_path / "out")
    assert load.load(spark, doc, lambda t: read_table(spark, path, t), root, state) == {"t": 3}
    (result,) = migrate.verify_load(spark, doc, root, state)
    assert result.passed() and not result.ordered


def test_flags_that_exclude_each_other(capsys):
    with pytest.raises(SystemExit) as stop:
        cli.main(["load", "x.yaml", "--verify", "--noverify"])
    assert stop.value.code == 2 and "exclude" in capsys.readouterr().err


def test_cells_of_every_storage_class_in_key_order(spark, tmp_path):
    from cellprobe.sources.sqlite_cells import read_ordered, read_table

    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t(k, v)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [("b", 1), (2, 2.5), (b"x", None), (10, b"\x00"), (1.5, "t"), ("a", 2**62)])
    got = read_table(spark, path, "t", ["v"]).collect()
    plain = lambda x: tuple(bytes(y) if isinstance(y, bytearray) else y for y in x) if x else None
    assert sorted(str(plain(r.v)) for r in got) == sorted(str(x) for x in [("integer", 1, None, None, None), ("real", None, 2.5, None, None), None, ("blob", None, None, None, b"\x00"), ("text", None, None, "t", None), ("integer", 2**62, None, None, None)])
    keys = [r.k for r in read_ordered(spark, path, "t", ["k"]).collect()]
    assert [next(x for x in tuple(k)[1:] if x is not None) for k in keys] == [1.5, 2, 10, "a", "b", b"x"]
