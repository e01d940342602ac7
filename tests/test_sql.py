"""The SQL front end: results against DuckDB, and what it rejects."""

import os

import duckdb
import pytest

from tidemill.functions.types import SchemaError, validate_schema
from tidemill.queries import ORACLE, QUERIES
from tidemill.sql.expressions import SqlError
from tidemill.sql.program import Program

SLOW = [n for n in QUERIES if n.startswith("delta_") or n == "versioned_sink"]


def rows(cursor_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: float(v) if hasattr(v, "as_tuple") else v
    return sorted((tuple(norm(r[i]) for i in order) for r in cursor_rows), key=str)


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, small, db, name):
    got = QUERIES[name](spark, small)
    want = db.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), names)


@pytest.mark.parametrize("name", ["delta_aggregate", "delta_join_full_residual", "versioned_sink"])
def test_changelog_query(spark, small, db, name):
    test_query(spark, small, db, name)


@pytest.mark.parametrize("name", ["self_join", "delta_self_join"])
def test_self_joins_take_the_events_of_all_users(spark, small, db, name):
    test_query(spark, small, db, name)
    got = QUERIES[name](spark, small)
    users = spark.read.parquet(f"{small}/events.parquet").groupBy("user_id").count().filter("count > 9")
    first = "first_id" if "first_id" in got.columns else "event_id"
    joined = spark.read.parquet(f"{small}/events.parquet").join(got.select(got[first].alias("event_id")).distinct(), "event_id")
    assert joined.select("user_id").distinct().count() == users.count() > 10


def test_changes_of_a_join_are_folded_without_shuffling_its_pairs(spark, small):
    plan = QUERIES["delta_self_join"](spark, small)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join")]
    assert above.count("HashAggregate") == 2 and "Exchange" not in above


def test_joins_on_whole_tables(spark, small):
    orders, customers, suppliers = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("orders", "customer", "supplier"))
    inner = QUERIES["join_inner"](spark, small)
    assert inner.count() == orders.count()
    assert inner.select("c_custkey").distinct().count() == orders.select("o_custkey").distinct().count()
    assert QUERIES["join_right"](spark, small).select("c_custkey").distinct().count() == customers.count()
    assert QUERIES["pipeline_supplier_returns"](spark, small).count() == suppliers.count()


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("join_")])
def test_joins_leave_rows_to_compare(spark, small, name):
    assert not QUERIES[name](spark, small).isEmpty()


T = "sequence(start => 0)"
REJECTED = [
    "SELECT 1", "INSERT INTO discard() SELECT value FROM plain_table", f"INSERT INTO discard() SELECT ALL value FROM {T}", f"INSERT INTO discard() SELECT DISTINCT ON (value) value FROM {T}", f"INSERT INTO discard() SELECT value FROM {T} ORDER BY value",
    f"INSERT INTO discard() SELECT value FROM {T} LIMIT 3", f"INSERT INTO discard() SELECT abs(value) AS a FROM {T}", f"INSERT INTO discard() SELECT CURRENT_TIMESTAMP AS a FROM {T}", f"INSERT INTO discard() SELECT COUNT(*) AS n FROM {T}",
    f"INSERT INTO discard() SELECT COUNT(DISTINCT value) AS n FROM {T} GROUP BY value", f"INSERT INTO discard() SELECT SUM(value) OVER () AS n FROM {T}", f"INSERT INTO discard() SELECT a.value FROM {T} AS a CROSS JOIN {T} AS b",
    f"INSERT INTO discard() SELECT a.value FROM {T} AS a JOIN {T} AS b ON a.value < b.value", f"INSERT INTO discard() SELECT a.value FROM {T} AS a NATURAL JOIN {T} AS b", f"INSERT INTO discard() SELECT a.value FROM {T} AS a JOIN {T} AS b USING (value)",
    f"INSERT INTO discard() SELECT value, value FROM {T}", f"INSERT INTO discard() SELECT value FROM {T} INTERSECT SELECT value FROM {T}", f"INSERT INTO discard() SELECT value FROM {T} WHERE value IN (SELECT value FROM {T})",
    f"INSERT INTO discard() SELECT value FROM {T} WHERE EXISTS (SELECT value FROM {T})", f"INSERT INTO discard() WITH a AS (SELECT value FROM {T}) SELECT value FROM {T}", f"INSERT INTO discard() WITH RECURSIVE a AS (SELECT value FROM {T}) SELECT value FROM a",
    "INSERT INTO discard() SELECT value FROM sequence(0)", "INSERT INTO discard() SELECT value FROM sequence(start => 0, start => 1)", "INSERT INTO discard() SELECT value FROM sequence()", "INSERT INTO discard() SELECT value FROM sequence(begin => 0)",
    f"INSERT INTO discard() SELECT a.value FROM {T} AS a ASOF JOIN {T} AS b MATCH_CONDITION (a.value = b.value)", f"INSERT INTO discard() SELECT a.value FROM {T} AS a ASOF JOIN {T} AS b MATCH_CONDITION (b.value <= a.value)",
    f"INSERT INTO discard() SELECT SUM(CAST(value AS DOUBLE)) AS s FROM {T} GROUP BY value", f"INSERT INTO discard() SELECT CAST(value AS DOUBLE) AS g FROM {T} GROUP BY CAST(value AS DOUBLE)", f"INSERT INTO discard() SELECT value AS __diff FROM {T}", f"INSERT INTO discard() SELECT value FROM {T} WHERE value",
    f"INSERT INTO discard() SELECT value FROM {T}; SELECT 1", f"INSERT INTO nowhere() SELECT value FROM {T}", f"INSERT INTO discard() SELECT value FROM {T} FOR UPDATE", f"INSERT INTO discard() SELECT value, 1 AS b FROM {T} UNION ALL SELECT value FROM {T}",
]


@pytest.mark.parametrize("sql", REJECTED)
def test_rejected(spark, tmp_path, sql):
    state = tmp_path / "state"
    with pytest.raises(Exception) as e:
        Program.parse(sql).start(spark, str(state))
    assert not state.exists(), e


def test_identity_ignores_formatting_and_credentials(spark, tmp_path, monkeypatch):
    def ident(sql):
        p = Program.parse(sql)
        plan, _, scans = p.lowered(spark)
        return p.identity(plan, scans)

    monkeypatch.setenv("PLACE", str(tmp_path / "a.sqlite"))
    a = ident("INSERT INTO sqlite(path => env('PLACE'), table => 't') SELECT value FROM sequence(start => 3)")
    b = ident("insert into sqlite(table => 't', path => '/elsewhere')\n select VALUE -- note\n from sequence(start => 3)")
    assert a == b
    assert a != ident("INSERT INTO sqlite(path => '/x', table => 't') SELECT value FROM sequence(start => 4)")
    assert a != ident("INSERT INTO sqlite(path => '/x', table => 'u') SELECT value FROM sequence(start => 3)")
    monkeypatch.delenv("PLACE")
    with pytest.raises(SqlError, match="PLACE"):
        Program.parse("INSERT INTO sqlite(path => env('PLACE'), table => 't') SELECT value FROM sequence(start => 3)").start(spark, str(tmp_path / "s"))


def test_sequences_reach_the_largest_value(spark):
    got = Program.parse("INSERT INTO discard() SELECT CAST(s.value % 2 AS BIGINT) AS parity, COUNT(*) AS n, MIN(s.value) AS lo, MAX(s.value) AS hi FROM sequence(start => 18446744073709551500) AS s GROUP BY s.value % 2").snapshot(spark)
    assert sorted((r[0], r[1], int(r[2]), int(r[3])) for r in got.collect()) == [(0, 58, 2**64 - 116, 2**64 - 2), (1, 58, 2**64 - 115, 2**64 - 1)]


def test_asof_tie_is_an_error_only_where_it_shows(spark):
    from tidemill.operators.asof import asof_join

    l = spark.createDataFrame([(1, 5)], "g long, t long")
    r = spark.createDataFrame([(1, 3, "a"), (1, 3, "b"), (1, 4, "c"), (1, 4, "c")], "g2 long, t2 long, v string")
    assert [x["v"] for x in asof_join(l, r, ">=", ("t", "t2"), [("g", "g2")]).collect()] == ["c"]
    with pytest.raises(Exception, match="several right rows"):
        asof_join(l.selectExpr("g", "t - 2 AS t"), r, ">=", ("t", "t2"), [("g", "g2")]).collect()


def test_schema_rules(spark):
    for bad in ("m map<string,int>", "i interval day to second", "__x int", "s struct<a:int,a:int>"):
        with pytest.raises((SchemaError, Exception)):
            validate_schema(spark.createDataFrame([], bad).schema)
    validate_schema(spark.createDataFrame([], "a array<struct<x:decimal(38,2),y:binary>>, t timestamp_ntz").schema)
