"""Queries of the profiling, decision, transform and verification operators, with their DuckDB counterparts.

Each query runs the library's own operator over whole tables; each oracle computes the same from the tables
by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellprobe.functions import cells, jsons, transforms
from cellprobe.operators import foreign_keys, picker, resolver, verify
from cellprobe.operators.heuristics import ESRI_TYPES, Finding, declared_varchar, varchar_finding
from cellprobe.operators.profile import Check, ColumnMeta, as_cells, counters, full_table_check, profile, storage_misfit
from cellprobe.plans import ddl
from cellprobe.plans.config import ColumnConfig, MigrationConfig, TableConfig
from cellprobe.plans.review import Review

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Scans, projections, aggregates, limits -----------------------------------------------------------


@query("scan_project", "SELECT o_orderkey, o_orderstatus FROM orders")
def scan_project(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", "o_orderstatus")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@query("count_rows", " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in _TABLES))
def count_rows(spark, d):
    parts = [_table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tbl"), "n") for t in _TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("ordered_scan", "SELECT n_name, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS row_number FROM nation")
def ordered_scan(spark, d):
    return verify.numbered(_table(spark, d, "nation"), ["n_nationkey"]).select("n_name", "row_number")


@query("sample_topk", "SELECT o_orderkey FROM orders ORDER BY sha1(CAST(o_orderkey AS VARCHAR)) LIMIT 500")
def sample_topk(spark, d):
    """The sampling operator with a hash for the random number, so that the result can be checked."""
    return _table(spark, d, "orders").select("o_orderkey").orderBy(F.sha1(F.col("o_orderkey").cast("string"))).limit(500)


@query("nonnull_sample", "SELECT event_id, nullif(event_type, 'click') AS event_type FROM events WHERE nullif(event_type, 'click') IS NOT NULL ORDER BY sha1(CAST(event_id AS VARCHAR)) LIMIT 500")
def nonnull_sample(spark, d):
    e = _table(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("event_type"))
    return e.where("event_type is not null").orderBy(F.sha1(F.col("event_id").cast("string"))).limit(500)


@query("max_text_length", "SELECT 'text' AS \"column\", max(length(text)) AS max_len FROM documents UNION ALL SELECT 'source', max(length(source)) FROM documents UNION ALL SELECT 'n_chars', max(length(CAST(n_chars AS VARCHAR))) FROM documents")
def max_text_length(spark, d):
    c = as_cells(_table(spark, d, "documents").select("text", "source", "n_chars"))
    return cells.max_text_lengths(c, c.columns).withColumn("max_len", F.col("max_len").cast("bigint"))


def _mixed(spark, d) -> DataFrame:
    """Cells of four storage classes and NULL."""
    e, k = _table(spark, d, "events"), F.col("event_id") % 5
    return e.select("event_id", F.when(k == 0, cells.integer(F.col("event_id"))).when(k == 1, cells.real(F.col("event_id") + 0.5)).when(k == 2, cells.text(F.col("event_type"))).when(k == 3, cells.blob(F.encode("event_type", "UTF-8"))).alias("c"))


@query("storage_class_profile", "SELECT CASE event_id % 5 WHEN 0 THEN 'integer' WHEN 1 THEN 'real' WHEN 2 THEN 'text' WHEN 3 THEN 'blob' ELSE 'null' END AS storage, count(*) AS n FROM events GROUP BY 1")
def storage_class_profile(spark, d):
    row = counters(_mixed(spark, d).select("c").withColumn("x", F.col("c")).select("c"))
    total = _table(spark, d, "events").agg(F.count(F.lit(1)).alias("total"))
    kinds = row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("storage"), F.col(c).alias("n")) for k, c in (("integer", "n_int"), ("real", "n_real"), ("text", "n_text"), ("blob", "n_blob"))])).alias("x")).select("x.*")
    nulls = _mixed(spark, d).where("c is null").agg(F.count(F.lit(1)).alias("n")).select(F.lit("null").alias("storage"), "n")
    return kinds.union(nulls).where("n > 0")


@query("value_frequency_top10", "SELECT p_brand AS value, count(*) AS cnt FROM part GROUP BY 1 ORDER BY cnt DESC, min(p_partkey) LIMIT 10")
def value_frequency_top10(spark, d):
    return resolver.value_frequency(_table(spark, d, "part").select(F.col("p_brand").alias("value"), "p_partkey"), "value", "p_partkey")


@query("exists_probe", "SELECT count(*) > 0 AS found FROM (SELECT 1 FROM orders WHERE o_totalprice > 1e12 LIMIT 1)")
def exists_probe(spark, d):
    return _table(spark, d, "orders").where("o_totalprice > 1e12").limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


@query("name_filter", "SELECT n_name FROM nation WHERE NOT (n_name ILIKE 'nation_1%')")
def name_filter(spark, d):
    return _table(spark, d, "nation").select("n_name").where(~F.col("n_name").ilike("nation_1%"))


@query("preview_grid", "SELECT doc_id, CASE WHEN text IS NULL THEN 'NULL' WHEN length(text) > 40 THEN left(text, 40) || '…' ELSE text END AS shown FROM documents")
def preview_grid(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", cells.text(F.col("text")).alias("c")).select("doc_id", cells.sql(cells.PREVIEW).alias("shown"))


# --- Keys ---------------------------------------------------------------------------------------------

_KEYS = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id"), ("lineitem", "l_partkey", "supplier", "s_suppkey"))


@query("fk_containment", " UNION ALL ".join(f"SELECT '{t}.{c}' AS child, (SELECT count(*) FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {r})) AS violations, (SELECT count({c}) FROM {t}) AS non_null" for t, c, r, k in _KEYS))
def fk_containment(spark, d):
    out = None
    for t, c, r, k in _KEYS:
        row = foreign_keys.containment(_table(spark, d, t), c, _table(spark, d, r), k).select(F.lit(f"{t}.{c}").alias("child"), "violations", "non_null")
        out = row if out is None else out.union(row)
    return out


@query("fk_containment_null_parent", "SELECT count(*) FILTER (l_partkey NOT IN (SELECT nullif(s_suppkey, 1) FROM supplier)) AS violations, count(l_partkey) AS non_null FROM lineitem")
def fk_containment_null_parent(spark, d):
    parent = _table(spark, d, "supplier").select(F.nullif("s_suppkey", F.lit(1).cast("bigint")).alias("k"))
    return foreign_keys.containment(_table(spark, d, "lineitem"), "l_partkey", parent, "k")


_NAMED = {
    "users": {"columns": [("user_id", 1), ("city_id", 0), ("name", 0)], "foreign_keys": []},
    "cities": {"columns": [("id", 1), ("countryId", 0)], "foreign_keys": []},
    "country": {"columns": [("id", 1)], "foreign_keys": []},
    "visits": {"columns": [("id", 1), ("user_id", 0), ("city_id", 0), ("box_id", 0)], "foreign_keys": [["city_id"]]},
    "boxes": {"columns": [("a", 1), ("b", 2)], "foreign_keys": []},
}


@query("fk_name_candidates", "SELECT * FROM (VALUES ('users', 'city_id', 'cities', 'id'), ('cities', 'countryId', 'country', 'id'), ('visits', 'user_id', 'users', 'user_id')) t(child, child_column, parent, parent_key)")
def fk_name_candidates(spark, d):
    return spark.createDataFrame(foreign_keys.candidates(_NAMED), "child string, child_column string, parent string, parent_key string")


@query("fk_violation_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_partkey)")
def fk_violation_rows(spark, d):
    return foreign_keys.violating_rows(_table(spark, d, "lineitem"), ["l_partkey"], _table(spark, d, "supplier"), ["s_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


# --- Heuristics: the counters that each decides on ----------------------------------------------------


def _counted(values: DataFrame, **names: str) -> DataFrame:
    """Chosen counters, under given names, of the one column of ``values``."""
    return counters(values).select(*[F.col(c).alias(n) for n, c in names.items()])


def _heuristic(name: str, table: str, cell: Callable[[], Column], oracle: str, **names: str) -> None:
    @query(f"heur_{name}", oracle)
    def run(spark, d):
        return _counted(_table(spark, d, table).select(cell().alias("c")), **names)


def _text(sql: str) -> Callable[[], Column]:
    return lambda: cells.text(F.expr(sql))


def _int(sql: str) -> Callable[[], Column]:
    return lambda: cells.integer(F.expr(sql))


def _real(sql: str) -> Callable[[], Column]:
    return lambda: cells.real(F.expr(sql))


_heuristic("boolean01_int", "labels", _int("quality + CASE WHEN doc_id % 50 = 7 THEN 1 ELSE 0 END"), "SELECT count(*) AS n, count(*) FILTER (quality + CASE WHEN doc_id % 50 = 7 THEN 1 ELSE 0 END NOT IN (0, 1)) AS bad FROM labels", n="n", bad="not_int01")
_heuristic("boolean01_text", "labels", _text("cast(toxic AS string)"), "SELECT count(toxic) AS n, count(*) FILTER (toxic NOT IN (0, 1)) AS bad FROM labels", n="n", bad="not_text01")
_heuristic("comma", "orders", _text("format_number(cast(o_totalprice AS bigint), 0)"), "SELECT count(*) AS n, count(*) FILTER (trunc(o_totalprice) >= 1000) AS comma, 0::BIGINT AS bad, 0::BIGINT AS points FROM orders", n="n", comma="comma", bad="comma_bad", points="number_point")
_heuristic("dayfirst", "orders", _text("date_format(o_orderdate, 'd/M/yyyy')"), "SELECT count(*) AS n, 0::BIGINT AS bad, count(*) FILTER (day(o_orderdate) > 12) AS proven FROM orders", n="n", bad="day_first_bad", proven="day_first_proven")
_heuristic("iso8601", "events", _text("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"), "SELECT count(*) AS n, 0::BIGINT AS bad, count(*) FILTER (strftime(ts, '%H:%M:%S') <> '00:00:00') AS timed FROM events", n="n", bad="iso_bad", timed="iso_time")
_heuristic("yyyymmdd", "orders", _text("CASE WHEN o_orderkey % 100 = 3 THEN '20210230' ELSE date_format(o_orderdate, 'yyyyMMdd') END"), "SELECT count(*) AS n, count(*) FILTER (o_orderkey % 100 = 3) AS bad FROM orders", n="n", bad="ymd_bad")
_SECOND = "unix_seconds(cast(ts AS timestamp))"
_heuristic("epoch_s", "events", _int(_SECOND), "SELECT count(*) AS n, count(*) FILTER (epoch(ts)::BIGINT BETWEEN 946684800 AND 2051222400) AS ok FROM events", n="n_int", ok="epoch_seconds")
_heuristic("epoch_ms", "events", _int("unix_millis(cast(ts AS timestamp))"), "SELECT count(*) AS n, count(*) FILTER (epoch_ms(ts) BETWEEN 946684800000 AND 2051222400000) AS ok FROM events", n="n_int", ok="epoch_millis")
_heuristic("epoch_us", "events", _int("unix_micros(cast(ts AS timestamp))"), "SELECT count(*) AS n, count(*) FILTER (epoch_us(ts) BETWEEN 946684800000000 AND 2051222400000000) AS ok FROM events", n="n_int", ok="epoch_micros")
_heuristic("excel", "orders", _int("datediff(o_orderdate, DATE'1899-12-30')"), "SELECT count(*) AS n, count(*) FILTER (date_diff('day', DATE '1899-12-30', o_orderdate::DATE) BETWEEN 36526 AND 49310) AS ok FROM orders", n="n_int", ok="excel")
_heuristic("julian", "orders", _real("datediff(o_orderdate, DATE'1970-01-01') + 2440587.5"), "SELECT count(*) AS n, count(*) FILTER (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 2440587.5 BETWEEN 1721425.5 AND 2816787.5) AS ok FROM orders", n="n_real", ok="julian")
_heuristic("geojson", "events", _text("concat('{\"type\":\"Point\",', CASE WHEN event_id % 10 = 4 THEN '' ELSE '\"coordinates\":' END, CASE WHEN event_id % 10 = 4 THEN '\"k\":1}' ELSE '[1,2]}' END)"), "SELECT count(*) AS filled, count(*) FILTER (event_id % 10 = 4) AS bad FROM events", filled="filled", bad="geojson_bad")
_heuristic("numeric_text", "part", _text("CASE WHEN p_partkey % 20 = 1 THEN concat('0', p_size) WHEN p_partkey % 20 = 2 THEN concat(p_size, '.5') ELSE cast(p_size AS string) END"), "SELECT count(*) AS filled, 0::BIGINT AS bad, count(*) FILTER (p_partkey % 20 = 1) AS leading_zero, count(*) FILTER (p_partkey % 20 = 2) AS fraction FROM part", filled="filled", bad="plain_bad", leading_zero="leading_zero", fraction="fraction")
_heuristic("sentinel", "part", lambda: F.when(F.expr("p_partkey % 7 = 0"), cells.text(F.lit("N/A"))).when(F.expr("p_partkey % 7 = 1"), cells.text(F.col("p_size").cast("string"))).otherwise(cells.integer(F.col("p_size"))), "SELECT count(*) FILTER (p_partkey % 7 = 0) AS sentinel, count(*) FILTER (p_partkey % 7 = 1) AS number_text, count(*) FILTER (p_partkey % 7 > 1) AS n_int FROM part", sentinel="sentinel", number_text="number_text", n_int="n_int")
_UUID_SQL = "concat(substr(md5(cast({k} AS string)), 1, 8), '-', substr(md5(cast({k} AS string)), 9, 4), '-', substr(md5(cast({k} AS string)), 13, 4), '-', substr(md5(cast({k} AS string)), 17, 4), '-', substr(md5(cast({k} AS string)), 21, 12))"
_UUID_DUCK = "(substr(md5({k}::VARCHAR), 1, 8) || '-' || substr(md5({k}::VARCHAR), 9, 4) || '-' || substr(md5({k}::VARCHAR), 13, 4) || '-' || substr(md5({k}::VARCHAR), 17, 4) || '-' || substr(md5({k}::VARCHAR), 21, 12))"
_part_uuid, _part_uuid_duck = _UUID_SQL.format(k="p_partkey"), _UUID_DUCK.format(k="p_partkey")
_heuristic("uuid", "part", _text(f"CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE {_part_uuid} END"), "SELECT count(*) AS filled, count(*) FILTER (p_partkey % 9 = 0) AS bad FROM part", filled="filled", bad="uuid_bad")
_heuristic("uuid_list", "part", _text(f"CASE WHEN p_partkey % 3 = 0 THEN concat({_part_uuid}, '\\\\␀', {_part_uuid}) ELSE {_part_uuid} END"), "SELECT count(*) AS filled, 0::BIGINT AS bad, count(*) FILTER (p_partkey % 3 = 0) AS multi FROM part", filled="filled", bad="uuid_list_bad", multi="uuid_list_multi")


@query("heur_esri_type", "SELECT * FROM (VALUES ('int32', 'integer', 'esri_typename'), ('float32', 'double precision', 'esri_typename'), ('float64', 'double precision', 'esri_typename'), ('geometryblob', '__drop__', 'drop_column')) t(declared, target, transform)")
def heur_esri_type(spark, d):
    return spark.createDataFrame([(k, *v) for k, v in ESRI_TYPES.items()], "declared string, target string, transform string")


_DECLARED = (("VARCHAR(45)", 10), ("varchar(100)", 120), ("VARCHAR(20000000)", 5), ("TEXT", 9))


@query("heur_varchar_len", "SELECT * FROM (VALUES ('VARCHAR(45)', 'varchar(45)'), ('varchar(100)', 'varchar(120)'), ('VARCHAR(20000000)', 'text')) t(declared, target)")
def heur_varchar_len(spark, d):
    lengths = {n for declared, _ in _DECLARED if (n := declared_varchar(declared)) is not None}
    found = [(declared, f.suggested_type) for declared, longest in _DECLARED if (f := varchar_finding(declared, lengths, longest))]
    return spark.createDataFrame(found, "declared string, target string")


# --- Decisions ----------------------------------------------------------------------------------------

_FINDINGS = (
    ("t", "a", 0, "boolean", "int_to_bool", 0.88), ("t", "a", 1, "integer", "numeric_text_to_integer", 0.90),
    ("t", "b", 0, "date", "yyyymmdd_to_date", 0.95), ("t", "b", 1, "integer", "numeric_text_to_integer", 0.90),
    ("t", "c", 0, "boolean", "int_to_bool", 0.55),
    ("t", "d", 0, "uuid", "uuid_format", 0.90), ("t", "d", 1, "uuid", "uuid_format", 0.90), ("t", "d", 2, "text", "", 0.89),
)


@query(
    "decide",
    "WITH f(tbl, col, ord, suggested_type, transform, confidence) AS (VALUES " + ", ".join(f"('{a}', '{b}', {o}, '{s}', '{t}', {c}::DOUBLE)" for a, b, o, s, t, c in _FINDINGS) + """),
    r AS (SELECT *, row_number() OVER w AS rk, lead(suggested_type) OVER w AS ns, lead(transform) OVER w AS nt, lead(confidence) OVER w AS nc FROM f WINDOW w AS (PARTITION BY tbl, col ORDER BY confidence DESC, ord))
    SELECT tbl AS "table", col AS "column", suggested_type, transform, confidence,
           confidence < 0.9 OR coalesce(round(confidence * 100) - round(nc * 100) <= 2 AND (suggested_type <> ns OR transform <> nt), false) AS needs_review
    FROM r WHERE rk = 1""",
)
def decide(spark, d):
    by_column: dict[tuple[str, str], list[Finding]] = {}
    for table, column, _, target, transform, confidence in sorted(_FINDINGS, key=lambda f: f[:3]):
        by_column.setdefault((table, column), []).append(Finding(heuristic="h", suggested_type=target, transform=transform, confidence=confidence, rationale=""))
    rows = [(*at, best.suggested_type, best.transform, best.confidence, review) for at, found in by_column.items() for best, review in [resolver.decide(found)]]
    return spark.createDataFrame(rows, "table string, column string, suggested_type string, transform string, confidence double, needs_review boolean")


@query("full_table_check", "SELECT 'price' AS \"column\", count(*) FILTER (o_orderkey % 1000 = 1) AS violations, CASE WHEN count(*) FILTER (o_orderkey % 1000 = 1) > 0 THEN 'lots' END AS bad_value FROM orders UNION ALL SELECT 'day', 0, NULL")
def full_table_check_query(spark, d):
    o = _table(spark, d, "orders")
    price = F.when(F.col("o_orderkey") % 1000 == 1, F.lit("lots")).otherwise(F.format_number(F.col("o_totalprice").cast("bigint"), 0))
    df = o.select(cells.text(price).alias("price"), cells.text(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"))
    return full_table_check(df, [Check("price", "strip_commas", "bigint"), Check("day", "yyyymmdd_to_date", "date", True)])


@query("fits_target", "SELECT o_orderkey, o_orderkey * 10 BETWEEN -32768 AND 32767 AS fits_smallint, o_orderkey * 1000000 BETWEEN -2147483648 AND 2147483647 AS fits_integer FROM orders")
def fits_target(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", cells.integer(F.col("o_orderkey") * 10).alias("s"), cells.integer(F.col("o_orderkey") * 1000000).alias("i"))
    return o.select("o_orderkey", transforms.fits("", "smallint", "s").alias("fits_smallint"), transforms.fits("", "integer", "i").alias("fits_integer"))


@query("storage_mismatch", "SELECT event_id, event_id % 5 NOT IN (0, 4) AS misfits FROM events")
def storage_mismatch(spark, d):
    return _mixed(spark, d).select("event_id", F.coalesce(storage_misfit("integer"), F.lit(False)).alias("misfits"))


# --- Transforms ---------------------------------------------------------------------------------------


def _transform(name: str, table: str, key: str, cell: Callable[[], Column], expected: str, kind: str | None = None) -> None:
    @query(f"xform_{name or 'passthrough'}", f"SELECT {key}, {expected} AS value FROM {table}")
    def run(spark, d):
        df = _table(spark, d, table).select(key, cell().alias("c"))
        value = transforms.value(name)
        return df.select(key, (value.cast(kind) if kind else value).alias("value"))


_transform("", "part", "p_partkey", _text("p_name"), "p_name")
_transform("esri_typename", "part", "p_partkey", _int("p_size"), "p_size::VARCHAR")
_transform("strip_commas", "orders", "o_orderkey", _text("format_number(cast(o_totalprice AS bigint), 0)"), "trunc(o_totalprice)::BIGINT")
_transform("strip_commas_float", "part", "p_partkey", _text("concat(format_number(p_size * 1000, 0), '.25')"), "p_size * 1000 + 0.25::DOUBLE")
_transform("unix_epoch_seconds", "events", "event_id", _int(_SECOND), "date_trunc('second', ts)", "timestamp_ntz")
_transform("unix_epoch_millis", "events", "event_id", _int("unix_millis(cast(ts AS timestamp))"), "date_trunc('millisecond', ts)", "timestamp_ntz")
_transform("unix_epoch_micros", "events", "event_id", _int("unix_micros(cast(ts AS timestamp))"), "ts", "timestamp_ntz")
_transform("iso8601_to_timestamptz", "events", "event_id", _text("CASE event_id % 3 WHEN 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') ELSE date_format(ts, 'M/d/yyyy h:mm:ss a') END"), "date_trunc('second', ts)", "timestamp_ntz")
_transform("iso8601_to_date", "orders", "o_orderkey", _text("CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'MMM d, yyyy') ELSE date_format(o_orderdate, 'd MMMM yyyy') END"), "o_orderdate::DATE")
_transform("int_to_bool", "labels", "doc_id", _text("cast(quality AS string)"), "quality = 1")
_transform("text_to_jsonb", "events", "event_id", _text("CASE WHEN event_id % 6 = 0 THEN concat(props, ' x') ELSE props END"), "CASE WHEN event_id % 6 <> 0 THEN props END")
_transform("julian_day_to_date", "orders", "o_orderkey", _real("datediff(o_orderdate, DATE'1970-01-01') + 2440587.5"), "o_orderdate::DATE")
_transform("yyyymmdd_to_date", "orders", "o_orderkey", _int("cast(date_format(o_orderdate, 'yyyyMMdd') AS bigint)"), "o_orderdate::DATE")
_transform("numeric_text_to_integer", "orders", "o_orderkey", _text("concat(o_orderkey + 2124037125711300644, CASE WHEN o_orderkey % 2 = 0 THEN '.00' ELSE '' END)"), "o_orderkey + 2124037125711300644")
_transform("numeric_text_to_double", "part", "p_partkey", _text("CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN '12d' ELSE concat(p_size, '.5') END"), "CASE WHEN p_partkey % 5 > 1 THEN p_size + 0.5::DOUBLE END")
_transform("excel_serial_to_timestamptz", "orders", "o_orderkey", _real("datediff(o_orderdate, DATE'1899-12-30') + 0.25D"), "o_orderdate::DATE + INTERVAL 6 HOUR", "timestamp_ntz")
_transform("dayfirst_to_timestamptz", "orders", "o_orderkey", _text("date_format(o_orderdate, 'd/M/yyyy')"), "o_orderdate::DATE::TIMESTAMP", "timestamp_ntz")
_transform("uuid_format", "part", "p_partkey", _text(f"CASE WHEN p_partkey % 2 = 0 THEN upper({_part_uuid}) ELSE md5(cast(p_partkey AS string)) END"), _part_uuid_duck)
_transform("uuid_list_format", "part", "p_partkey", lambda: cells.text(F.expr(f"concat(upper({_part_uuid}), char(0), {_part_uuid})")), f"{_part_uuid_duck} || ',' || {_part_uuid_duck}")
QUERIES["xform_uuid_list_format"] = (lambda run: lambda spark, d: run(spark, d).withColumn("value", F.array_join("value", ",")))(QUERIES["xform_uuid_list_format"])
_transform("nullif_sentinels", "part", "p_partkey", _text("CASE WHEN p_partkey % 4 = 0 THEN 'Unknown' ELSE format_number(p_size * 100, 0) END"), "CASE WHEN p_partkey % 4 <> 0 THEN (p_size * 100)::DOUBLE END")
_transform("nullif_empty", "part", "p_partkey", _text("CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END"), "CASE WHEN p_partkey % 4 <> 0 THEN p_brand END")


@query("xform_errors", "SELECT p_partkey, p_partkey % 3 = 1 AS err FROM part")
def xform_errors(spark, d):
    text = F.expr("CASE p_partkey % 3 WHEN 0 THEN cast(NULL AS string) WHEN 1 THEN ' 12 ' ELSE '1,234' END")
    return _table(spark, d, "part").select("p_partkey", cells.text(text).alias("c")).select("p_partkey", transforms.error("strip_commas").alias("err"))


# --- Verification -------------------------------------------------------------------------------------


def _edited(orders: DataFrame) -> DataFrame:
    """Orders with some rows gone, some new, and some statuses and prices changed."""
    k = F.col("o_orderkey")
    kept = orders.where(k % 101 != 5).withColumn("o_orderstatus", F.when(k % 97 == 3, F.lit("?")).otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(k % 89 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return kept.unionByName(orders.where(k % 103 == 1).withColumn("o_orderkey", -k - 1))


@query("verify_keyed", "SELECT count(*) FILTER (o_orderkey % 101 = 5) AS missing, count(*) FILTER (o_orderkey % 103 = 1) AS extra, count(*) FILTER (o_orderkey % 101 <> 5 AND o_orderkey % 97 = 3 AND o_orderstatus <> '?') AS bad_o_orderstatus, count(*) FILTER (o_orderkey % 101 <> 5 AND o_orderkey % 89 = 2) AS bad_o_totalprice FROM orders")
def verify_keyed(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return verify.keyed_counts(o, _edited(o), ["o_orderkey"])


@query("verify_multiset", "WITH e AS (SELECT l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT CASE WHEN l_orderkey % 50 = 7 THEN 'Z' ELSE l_returnflag END AS v, count(*) AS n FROM lineitem GROUP BY 1) SELECT 's:' || coalesce(e.v, a.v) AS key, coalesce(e.n, 0) AS expected_count, coalesce(a.n, 0) AS actual_count FROM e FULL JOIN a ON e.v = a.v WHERE coalesce(e.n, 0) <> coalesce(a.n, 0)")
def verify_multiset(spark, d):
    li = _table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    changed = li.withColumn("l_returnflag", F.when(F.col("l_orderkey") % 50 == 7, F.lit("Z")).otherwise(F.col("l_returnflag")))
    return verify.multiset_difference(li, changed, "l_returnflag")


@query("verify_int_float", "SELECT o_orderkey, o_orderkey % 2 = 0 AS same FROM orders")
def verify_int_float(spark, d):
    """2^53 + k against its nearest double: only even numbers are doubles there."""
    o = _table(spark, d, "orders").select("o_orderkey", (F.lit(2**53) + F.col("o_orderkey")).alias("i"))
    return o.withColumn("d", F.col("i").cast("double")).select("o_orderkey", verify.int_equals_double("i", "d").alias("same"))


@query("json_canonical", "SELECT event_id, '{\"a\":1/2,\"k\":' || (props->>'$.k') || '}' AS canonical FROM events WHERE props->>'$.k' IS NOT NULL")
def json_canonical(spark, d):
    e = _table(spark, d, "events").where("get_json_object(props, '$.k') is not null")
    spread = F.concat(F.lit('{ "k" : '), F.get_json_object("props", "$.k"), F.lit(' , "a": 5e-1}'))
    return e.select("event_id", jsons.canonical(spread).alias("canonical"))


@query("sort_keys", "SELECT l_orderkey, l_linenumber, 'n:' || l_quantity::BIGINT AS key FROM lineitem")
def sort_keys(spark, d):
    """Whole doubles have the key of the integer."""
    li = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_quantity").cast("double").alias("q"))
    return li.select("l_orderkey", "l_linenumber", verify.sort_key("q", li.schema["q"].dataType).alias("key"))


# --- Types to pick, names, review ---------------------------------------------------------------------


@query("preview_types", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size || 'x' ELSE p_size::VARCHAR END AS display, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'numeric_text_to_integer' END AS transform, p_partkey % 3 <> 0 AS valid FROM part")
def preview_types(spark, d):
    values = _table(spark, d, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat(p_size, 'x') ELSE cast(p_size AS string) END").alias("x"))
    return picker.preview(values, "x", "smallint").select("p_partkey", "preview.*")


@query("preview_dates", "SELECT event_id, CASE event_id % 2 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts::DATE, '%Y-%m-%dT00:00:00Z') END AS display, CASE event_id % 2 WHEN 0 THEN 'unix_epoch_seconds' ELSE 'iso8601_to_timestamptz' END AS transform FROM events")
def preview_dates(spark, d):
    values = _table(spark, d, "events").select("event_id", F.expr(f"CASE event_id % 2 WHEN 0 THEN cast({_SECOND} AS string) ELSE date_format(ts, 'yyyy-MM-dd') END").alias("x"))
    return picker.preview(values, "x", "timestamptz").select("event_id", "preview.display", "preview.transform")


_PICKED = ("text", "integer", "boolean", "date", "uuid", "double precision")


@query("common_transform", "SELECT * FROM (VALUES ('text', true, ''), ('integer', true, 'numeric_text_to_integer'), ('boolean', false, NULL), ('date', false, NULL), ('uuid', false, NULL), ('double precision', true, '')) t(target, valid, transform)")
def common_transform(spark, d):
    values = _table(spark, d, "part").select(F.col("p_size").cast("string").alias("x"))
    out = None
    for t in _PICKED:
        row = picker.type_support(values, "x", t).select(F.lit(t).alias("target"), "valid", "transform")
        out = row if out is None else out.union(row)
    return out


@query("identifier_disambiguate", "WITH n AS (SELECT n_regionkey AS scope, repeat('x', 50 + CAST(n_nationkey AS INTEGER) % 12) || n_name AS name FROM nation) SELECT scope, name, CASE WHEN count(*) OVER (PARTITION BY scope, substr(name, 1, 63)) = 1 THEN substr(name, 1, 63) ELSE substr(name, 1, 54) || '_' || substr(sha1(name), 1, 8) END AS identifier FROM n")
def identifier_disambiguate(spark, d):
    """Names of a schema are few: they are made on the driver, for each scope."""
    rows = _table(spark, d, "nation").selectExpr("n_regionkey AS scope", "concat(repeat('x', CAST(50 + n_nationkey % 12 AS INT)), n_name) AS name")
    by_scope: dict[int, list[str]] = {}
    for r in rows.collect():
        by_scope.setdefault(r.scope, []).append(r.name)
    made = [(scope, n, i) for scope, names in by_scope.items() for n, i in zip(names, ddl.unique_names(names), strict=True)]
    return spark.createDataFrame(made, f"scope {rows.schema['scope'].dataType.simpleString()}, name string, identifier string")


_DECISIONS = [("t1", "a", 0, True), ("t1", "b", 1, False), ("t1", "c", 2, True), ("t1", "d", 3, True), ("t2", "a", 0, False), ("t2", "b", 1, True)]
_DECISIONS_SQL = "WITH r(tbl, col, ordinal, needs_review) AS (VALUES " + ", ".join(f"('{t}', '{c}', {o}, {str(n).lower()})" for t, c, o, n in _DECISIONS) + ")"


def _review() -> Review:
    config = MigrationConfig("x")
    for table, column, _, flagged in _DECISIONS:
        t = config.tables.setdefault(table, TableConfig())
        t.columns[column] = ColumnConfig("TEXT", "text", needs_review=flagged)
        t.column_order.append(column)
    return Review(config)


@query("review_summary", _DECISIONS_SQL + ' SELECT tbl AS "table", count(*) FILTER (needs_review) AS needs_review_count, count(*) FILTER (NOT needs_review) AS auto_approved_count FROM r GROUP BY 1')
def review_summary(spark, d):
    return spark.createDataFrame([(t, *n) for t, n in _review().summary().items()], "table string, needs_review_count long, auto_approved_count long")


@query("flagged_navigation", _DECISIONS_SQL + ', f AS (SELECT * FROM r WHERE needs_review) SELECT tbl AS "table", col AS "column", coalesce(lead(col) OVER w, first_value(col) OVER w2) AS next_column, coalesce(lag(col) OVER w, last_value(col) OVER w2) AS previous_column FROM f WINDOW w AS (PARTITION BY tbl ORDER BY ordinal), w2 AS (PARTITION BY tbl ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)')
def flagged_navigation(spark, d):
    review = _review()
    rows = [(t, c, review.next_flagged(t, c), review.next_flagged(t, c, -1)) for t in review.config.tables for c in review.flagged(t)]
    return spark.createDataFrame(rows, "table string, column string, next_column string, previous_column string")


@query("distinct_lengths", "SELECT true AS differ")
def distinct_lengths(spark, d):
    rows = spark.createDataFrame([(declared_varchar(x),) for x, _ in _DECLARED], "n int")
    return rows.agg((F.count_distinct("n") > 1).alias("differ"))


# --- Whole operators over whole tables ----------------------------------------------------------------


@query("verify_table", "SELECT count(*) AS source_rows, count(*) AS target_rows, 'o_totalprice' AS \"column\", count(*) FILTER (o_orderkey % 97 = 3) AS mismatches FROM orders")
def verify_table(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 97 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    found = verify.verify_table("orders", o, changed, ["o_orderkey"])
    return spark.createDataFrame([(found.source_rows, found.target_rows, c, n) for c, n in found.mismatches.items()], "source_rows long, target_rows long, column string, mismatches long")


@query("verify_table_unkeyed", "SELECT 'l_returnflag' AS \"column\", count(*) FILTER (l_orderkey % 50 = 7) AS mismatches FROM lineitem")
def verify_table_unkeyed(spark, d):
    li = _table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    changed = li.withColumn("l_returnflag", F.when(F.col("l_orderkey") % 50 == 7, F.lit("Z")).otherwise(F.col("l_returnflag")))
    found = verify.verify_table("lineitem", li, changed, [])
    return spark.createDataFrame(list(found.mismatches.items()), "column string, mismatches long")


_INFERRED = {"orders": {"columns": [("id", 1), ("customer_id", 0), ("part_id", 0)]}, "customer": {"columns": [("id", 1)]}, "part": {"columns": [("id", 1)]}}
_INFERRED_SQL = "SELECT 'orders' AS child, '{c}_id' AS child_column, '{c}' AS parent, 'id' AS parent_key WHERE NOT EXISTS (SELECT 1 FROM orders WHERE {v} IS NOT NULL AND {v} NOT IN (SELECT {k} FROM {c}))"


@query("fk_infer", _INFERRED_SQL.format(c="customer", v="o_custkey", k="c_custkey") + " UNION ALL " + _INFERRED_SQL.format(c="part", v="(o_orderkey + 100000000)", k="p_partkey"))
def fk_infer(spark, d):
    names = {"orders": ("o_orderkey AS id", "o_custkey AS customer_id", "o_orderkey + 100000000 AS part_id"), "customer": ("c_custkey AS id",), "part": ("p_partkey AS id",)}
    found = foreign_keys.infer(_INFERRED, lambda name, column: _table(spark, d, name).selectExpr(*names[name]).select(column))
    return spark.createDataFrame([(t, fk.columns[0], fk.ref_table, fk.ref_columns[0]) for t, fks in found.items() for fk in fks], "child string, child_column string, parent string, parent_key string")


@query("profile_table", "SELECT 'o_orderstatus' AS \"column\", 'text' AS target_type, '' AS transform, false AS needs_review UNION ALL SELECT 'o_flag', 'boolean', 'int_to_bool', bool_and(o_orderkey % 2 IN (0, 1)) FROM orders UNION ALL SELECT 'order_date', 'date', 'yyyymmdd_to_date', false")
def profile_table(spark, d):
    o = _table(spark, d, "orders").select("o_orderstatus", (F.col("o_orderkey") % 2).alias("o_flag"), F.date_format("o_orderdate", "yyyyMMdd").cast("bigint").alias("order_date"))
    metas = [ColumnMeta("o_orderstatus", "TEXT"), ColumnMeta("o_flag", "INTEGER"), ColumnMeta("order_date", "INTEGER")]
    found = profile(as_cells(o), metas, "orders", sample=None).columns
    return spark.createDataFrame([(c, x.target_type, x.transform, x.needs_review) for c, x in found.items()], "column string, target_type string, transform string, needs_review boolean")
