"""The library's queries over the test tables, one for each operator facet, and the same in DuckDB SQL.

Money columns are doubles in the tables and whole cents here, as sums and extremes are exact."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.changes import expanded, folded, with_diff
from .functions.storage import Folder, checkpoint_dir, checkpointed
from .functions.types import DIFF, ORD
from .operators.aggregates import Call
from .plans.batch import evaluate
from .plans.delta import MemoryState, step
from .plans.nodes import Aggregate, AsOfJoin, Distinct, EquiJoin, Filter, Node, RunningEventCount, Scan, Select, UnionAll
from .sinks.relational import VersionedSink
from .sources.cdc import decoded, envelopes, updates
from .sql.program import Program

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def register(name: str, plan: Node, tables: tuple[str, ...], oracle: str) -> None:
    """A query that is a plan over tables."""
    QUERIES[name] = lambda spark, sf_dir: evaluate(plan, read(spark, sf_dir, *tables))
    QUERIES[name].__name__ = name
    ORACLE[name] = oracle


def register_sql(name: str, sql: str, oracle: str, rows: int = 1000) -> None:
    """A query in the library's SQL; {t} stands for a table's parquet scan."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = sql
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            text = text.replace("{" + t + "}", f"parquet(path => '{sf_dir}/{t}.parquet')")
        return Program.parse("INSERT INTO discard() " + text).snapshot(spark, rows)

    run.__name__ = name
    QUERIES[name], ORACLE[name] = run, oracle


def cents(c: str) -> str:
    return f"CAST(round({c} * 100) AS bigint)"


S = lambda *columns: tuple((c, c) if isinstance(c, str) else c for c in columns)
ORDERS, CUSTOMER, LINEITEM, PART, EVENTS, NATION, REGION, SUPPLIER = (Scan(t) for t in ("orders", "customer", "lineitem", "part", "events", "nation", "region", "supplier"))

# -- select, filter, expressions -------------------------------------------------------------

register("scan_projection", Select(LINEITEM, S("l_orderkey", "l_linenumber")), ("lineitem",), "SELECT l_orderkey, l_linenumber FROM lineitem")
register(
    "select_extend", Select(Select(ORDERS, S("o_orderkey", ("amount", cents("o_totalprice")))), (("lane", "CASE WHEN amount >= 20000000 THEN 'priority' ELSE 'standard' END"),), True), ("orders",),
    "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS amount, CASE WHEN round(o_totalprice * 100) >= 20000000 THEN 'priority' ELSE 'standard' END AS lane FROM orders",
)
register(
    "filter_kleene", Filter(Select(EVENTS, S("event_id", "event_type", "user_id")), "NOT (event_type = 'click' AND (user_id > 50 OR CAST(NULL AS boolean))) OR event_type IS NULL"), ("events",),
    "SELECT event_id, event_type, user_id FROM events WHERE NOT (event_type = 'click' AND (user_id > 50 OR CAST(NULL AS BOOLEAN))) OR event_type IS NULL",
)
register(
    "filter_null_predicate", Filter(Select(ORDERS, S("o_orderkey", "o_orderstatus")), "CASE WHEN o_orderstatus = 'O' THEN CAST(NULL AS boolean) ELSE o_orderkey BETWEEN 100 AND 5000 END"), ("orders",),
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE CASE WHEN o_orderstatus = 'O' THEN CAST(NULL AS BOOLEAN) ELSE o_orderkey BETWEEN 100 AND 5000 END",
)
register_sql(
    "int_div_mod", "SELECT l_orderkey, l_linenumber, (l_orderkey - 30000) / 7 AS d, (l_orderkey - 30000) % 7 AS m, -l_linenumber AS neg FROM {lineitem}",
    "SELECT l_orderkey, l_linenumber, CAST(trunc((l_orderkey - 30000) / 7) AS BIGINT) AS d, (l_orderkey - 30000) % 7 AS m, -l_linenumber AS neg FROM lineitem",
)
register_sql(
    "try_cast_case", "SELECT event_id, TRY_CAST(props AS BIGINT) AS bad, TRY_CAST(CAST(event_id AS VARCHAR) AS BIGINT) AS good, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS code FROM {events}",
    "SELECT event_id, TRY_CAST(props AS BIGINT) AS bad, TRY_CAST(CAST(event_id AS VARCHAR) AS BIGINT) AS good, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS code FROM events",
)
register_sql(
    "decimal_compare", "SELECT o_orderkey FROM {orders} WHERE CAST(o_totalprice AS DECIMAL(18,2)) >= CAST(150000 AS DECIMAL(18,2)) AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' AND o_orderstatus IN ('O', 'F') AND o_orderpriority LIKE '%-%'",
    "SELECT o_orderkey FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) >= 150000 AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' AND o_orderstatus IN ('O', 'F') AND o_orderpriority LIKE '%-%'",
)

# -- unions, distinct ------------------------------------------------------------------------

register_sql("union_all", "SELECT n_nationkey AS k, n_name AS name FROM {nation} UNION ALL SELECT r_regionkey, r_name FROM {region}", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
register_sql("union_distinct", "SELECT o_custkey AS k FROM {orders} UNION SELECT c_custkey FROM {customer}", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
register_sql(
    "union_by_name_all", "SELECT c_custkey AS k, c_name AS name FROM {customer} UNION ALL BY NAME SELECT s_name AS name, s_nationkey AS nation FROM {supplier}",
    "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL BY NAME SELECT s_name AS name, s_nationkey AS nation FROM supplier",
)
register_sql(
    "union_by_name", "SELECT n_regionkey AS k, n_nationkey % 3 AS g FROM {nation} UNION BY NAME SELECT n_nationkey % 3 AS g, n_regionkey AS k FROM {nation}",
    "SELECT n_regionkey AS k, n_nationkey % 3 AS g FROM nation UNION BY NAME SELECT n_nationkey % 3 AS g, n_regionkey AS k FROM nation",
)
register("select_distinct", Distinct(Select(ORDERS, S("o_custkey", "o_orderstatus"))), ("orders",), "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")

# -- aggregates ------------------------------------------------------------------------------

STATS = (Call("n", "count_star"), Call("n_amount", "count", "amount"), Call("revenue", "sum", "amount"), Call("average", "avg", "amount"), Call("smallest", "min", "amount"), Call("largest", "max", "amount"))
PRICED = Select(LINEITEM, S("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", ("amount", cents("l_extendedprice"))))
register(
    "group_count_sum_avg_min_max", Aggregate(Filter(PRICED, "l_returnflag <> 'A'"), S("l_returnflag", "l_linestatus"), STATS), ("lineitem",),
    """SELECT l_returnflag, l_linestatus, count(*) AS n, count(amount) AS n_amount, CAST(sum(amount) AS BIGINT) AS revenue, CAST(sum(amount) AS DOUBLE) / count(amount) AS average, min(amount) AS smallest, max(amount) AS largest
    FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount FROM lineitem WHERE l_returnflag <> 'A') GROUP BY ALL""",
)
register(
    "group_high_cardinality", Aggregate(PRICED, S("l_orderkey"), (Call("n", "count_star"), Call("revenue", "sum", "amount"), Call("last_ship", "max", "l_shipdate"))), ("lineitem",),
    "SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue, max(l_shipdate) AS last_ship FROM lineitem GROUP BY ALL",
)
register("group_no_calls", Aggregate(ORDERS, S("o_orderpriority", ("late", "o_orderkey % 2 = 0"))), ("orders",), "SELECT DISTINCT o_orderpriority, o_orderkey % 2 = 0 AS late FROM orders")
register_sql("group_by_all", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, MIN(o_orderdate) AS first_day FROM {orders} GROUP BY ALL", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_orderdate) AS first_day FROM orders GROUP BY ALL")
register_sql("having", "SELECT o_custkey, COUNT(*) AS n, MAX(o_orderkey) AS last FROM {orders} GROUP BY o_custkey HAVING COUNT(*) > 10 AND MIN(o_orderkey) > 100", "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY ALL HAVING count(*) > 10 AND min(o_orderkey) > 100")
register_sql("pipe_aggregate", "SELECT * FROM {events} |> WHERE user_id > 10 |> AGGREGATE COUNT(*) AS n, MIN(ts) AS first_ts GROUP BY event_type", "SELECT event_type, count(*) AS n, min(ts) AS first_ts FROM events WHERE user_id > 10 GROUP BY ALL")

# -- joins -----------------------------------------------------------------------------------

_L = Select(ORDERS, S("o_orderkey", "o_custkey", ("total", cents("o_totalprice"))))
_R = Select(CUSTOMER, S("c_custkey", "c_mktsegment", ("balance", cents("c_acctbal"))))
#: Customers of all segments but one, so that orders too are left without a partner in outer and anti joins.
_SOME = Filter(_R, "c_mktsegment <> 'BUILDING'")
_LS = "(SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS total FROM orders) l"
_RS = "(SELECT c_custkey, c_mktsegment, CAST(round(c_acctbal * 100) AS BIGINT) AS balance FROM customer{}) r"
for _name, _kind, _sql, _side in (
    ("join_inner", "inner", "INNER", _R), ("join_left", "left", "LEFT", _SOME), ("join_right", "right", "RIGHT", _R), ("join_full", "full", "FULL", _SOME), ("join_left_semi", "left_semi", "SEMI", _SOME), ("join_left_anti", "left_anti", "ANTI", _SOME),
):
    for _tail, _residual in (("", None), ("_residual", "total > balance * 20")):
        _from = f"{_LS} {_sql} JOIN {_RS.format(' WHERE c_mktsegment <> ' + repr('BUILDING') if _side is _SOME else '')} ON o_custkey = c_custkey{' AND ' + _residual if _residual else ''}"
        register(_name + _tail, EquiJoin(_L, _side, _kind, (("o_custkey", "c_custkey"),), None, "l.total > r.balance * 20" if _residual else None), ("orders", "customer"), f"SELECT * FROM {_from}")
for _kind in ("semi", "anti"):
    # a residual with the aliases' names in a literal
    register(
        f"join_right_{_kind}_residual", EquiJoin(_L, _R, f"right_{_kind}", (("o_custkey", "c_custkey"),), None, "l.total > r.balance * 40 AND r.c_mktsegment <> 'l. or r.'"), ("orders", "customer"),
        f"SELECT * FROM {_RS.format('')} {_kind.upper()} JOIN {_LS} ON o_custkey = c_custkey AND total > balance * 40",
    )
    register_sql(f"join_right_{_kind}", f"SELECT c_custkey, c_name FROM {{orders}} AS o RIGHT {_kind.upper()} JOIN {{customer}} AS c ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'", f"SELECT c_custkey, c_name FROM customer {_kind.upper()} JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
register_sql(
    "self_join", "WITH e AS (SELECT event_id, user_id, event_type FROM {events}) SELECT a.event_id AS first_id, b.event_id AS second_id FROM e AS a JOIN e AS b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type <> b.event_type",
    "SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type <> b.event_type",
)
register(
    "join_large", Aggregate(EquiJoin(PRICED, Select(PART, S("p_partkey", "p_brand")), "inner", (("l_partkey", "p_partkey"),)), S("p_brand"), (Call("n", "count_star"), Call("revenue", "sum", "amount"))), ("lineitem", "part"),
    "SELECT p_brand, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
)

# -- ASOF ------------------------------------------------------------------------------------

_BUY = Select(Filter(EVENTS, "event_type = 'purchase'"), S("event_id", "user_id", "ts"))
#: One right row for each user and time, as several would be an error.
_VIEW = Aggregate(Filter(EVENTS, "event_type = 'view'"), (("view_user", "user_id"), ("view_ts", "ts")), (Call("view_id", "min", "event_id"),))
_VIEWS = "(SELECT user_id AS view_user, ts AS view_ts, min(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)"
for _name, _op in (("asof_backward_inclusive", ">="), ("asof_backward_strict", ">"), ("asof_forward_inclusive", "<="), ("asof_forward_strict", "<")):
    register(_name, AsOfJoin(_BUY, _VIEW, _op, ("ts", "view_ts"), (("user_id", "view_user"),)), ("events",), f"SELECT event_id, user_id, ts, view_user, view_ts, view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN {_VIEWS} v ON b.user_id = v.view_user AND b.ts {_op} v.view_ts")
_ANY = Aggregate(Filter(EVENTS, "event_type = 'view'"), (("view_ts", "ts"),), (Call("view_id", "min", "event_id"),))
register("asof_global", AsOfJoin(_BUY, _ANY, ">=", ("ts", "view_ts")), ("events",), "SELECT event_id, user_id, ts, view_ts, view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN (SELECT ts AS view_ts, min(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON b.ts >= v.view_ts")
register_sql(
    "asof_sql", "SELECT b.event_id, v.view_ts FROM (SELECT event_id, user_id, ts FROM {events} WHERE event_type = 'purchase') AS b ASOF JOIN (SELECT user_id, ts AS view_ts, COUNT(*) AS n FROM {events} WHERE event_type = 'view' GROUP BY user_id, ts) AS v MATCH_CONDITION (b.ts >= v.view_ts) USING (user_id)",
    "SELECT event_id, view_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN " + _VIEWS + " v ON b.user_id = v.view_user AND b.ts >= v.view_ts",
)

# -- sequences, counts -----------------------------------------------------------------------

register_sql(
    "sequence_leap_years", "WITH years AS (SELECT CAST(sequence.value AS BIGINT) AS y FROM sequence(start => 1600)) SELECT y, y / 100 AS century, CASE WHEN y % 400 = 0 THEN 'by 400' WHEN y % 100 = 0 THEN 'none' ELSE 'by 4' END AS rule FROM years WHERE y % 4 = 0",
    "SELECT range AS y, range // 100 AS century, CASE WHEN range % 400 = 0 THEN 'by 400' WHEN range % 100 = 0 THEN 'none' ELSE 'by 4' END AS rule FROM range(1600, 2600) WHERE range % 4 = 0",
)
register("running_event_count", RunningEventCount(EVENTS, ("event_id",)), ("events",), "SELECT row_number() OVER (ORDER BY event_id) AS event_count FROM events")

# -- changelogs ------------------------------------------------------------------------------


#: Pairs of a join that are folded in one partition.
PAIRS = 1 << 20


def _parts(spark: SparkSession, plan: EquiJoin, tables: dict[str, DataFrame]) -> int:
    """Partitions for a join's pairs, by their number over whole tables but for the residual."""
    left, right = (
        evaluate(x, tables).groupBy(*(F.expr(k[i]).alias(f"k{j}") for j, k in enumerate(plan.keys))).agg(F.count(F.lit(1)).cast("double").alias(f"n{i}")) for i, x in enumerate(plan.inputs)
    )
    n = left.join(right, [f"k{j}" for j in range(len(plan.keys))]).agg(F.sum(F.col("n0") * F.col("n1"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n / PAIRS) + 1)


def folded_changes(spark: SparkSession, plan: Node, batches: list[dict[str, DataFrame]], like: dict[str, DataFrame]) -> DataFrame:
    """The relation that the plan's changes build up over some batches."""
    state, out = MemoryState(spark), []
    if isinstance(plan, EquiJoin) and plan.kind == "inner":
        # a join's pairs are many more than its rows: not written or shuffled, but made again from the rows where they are read
        parts = _parts(spark, plan, like)
        for b in batches:
            out.append(step(plan, b, state, lambda n: like[n].limit(0), parts))
            state.commit()
        state.once.close_at_exit()
        return expanded(folded(out))
    for b in batches:
        out.append(state.once(step(plan, b, state, lambda n: like[n].limit(0))))
        state.commit()
    got = checkpointed(expanded(folded(out)))
    state.close()
    return got


def changing(df: DataFrame, key: str) -> list[DataFrame]:
    """df's rows as three batches: two thirds; the rest and some retracted; some of those back."""
    d = lambda x, n: with_diff(x).withColumn(DIFF, F.lit(n).cast("long"))
    k = F.col(key)
    return [
        d(df.filter(k % 3 != 0), 1),
        d(df.filter(k % 3 == 0), 1).unionByName(d(df.filter((k % 3 != 0) & (k % 5 == 0)), -1)),
        d(df.filter((k % 3 != 0) & (k % 10 == 0)), 1).unionByName(d(df.filter(k % 21 == 0), -1)),
    ]


#: What remains of a table after changing(), in SQL.
def remaining(k: str) -> str:
    return f"({k} % 21 <> 0 AND ({k} % 3 = 0 OR {k} % 5 <> 0 OR {k} % 10 = 0))"


def register_changes(name: str, plan: Node, keys: dict[str, str], oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = read(spark, sf_dir, *keys)
        parts = {t: changing(df, keys[t]) for t, df in tables.items()}
        return folded_changes(spark, plan, [{t: p[i] for t, p in parts.items()} for i in range(3)], tables)

    run.__name__ = name
    QUERIES[name], ORACLE[name] = run, oracle


_O, _C, _E = (f"(SELECT * FROM {t} WHERE {remaining(k)})" for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("events", "event_id")))
register_changes("delta_distinct", Distinct(Select(ORDERS, S("o_custkey", "o_orderstatus"))), {"orders": "o_orderkey"}, f"SELECT DISTINCT o_custkey, o_orderstatus FROM {_O}")
register_changes(
    "delta_aggregate", Aggregate(Select(ORDERS, S("o_custkey", ("amount", cents("o_totalprice")))), S("o_custkey"), STATS), {"orders": "o_orderkey"},
    f"SELECT o_custkey, count(*) AS n, count(amount) AS n_amount, CAST(sum(amount) AS BIGINT) AS revenue, CAST(sum(amount) AS DOUBLE) / count(amount) AS average, min(amount) AS smallest, max(amount) AS largest FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS amount FROM {_O}) GROUP BY ALL",
)
register_changes("delta_union", UnionAll((Select(ORDERS, S(("k", "o_custkey"))), Select(CUSTOMER, S(("k", "c_custkey"))))), {"orders": "o_orderkey", "customer": "c_custkey"}, f"SELECT o_custkey AS k FROM {_O} UNION ALL SELECT c_custkey FROM {_C}")
_DL, _DR = Select(ORDERS, S("o_orderkey", "o_custkey", ("total", cents("o_totalprice")))), Select(CUSTOMER, S("c_custkey", "c_mktsegment", ("balance", cents("c_acctbal"))))
_DO = f"(SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS total FROM {_O}) l {{}} JOIN (SELECT c_custkey, c_mktsegment, CAST(round(c_acctbal * 100) AS BIGINT) AS balance FROM {_C}) r ON o_custkey = c_custkey{{}}"
for _name, _kind, _sql, _residual in (("delta_join_inner", "inner", "INNER", ""), ("delta_join_left", "left", "LEFT", ""), ("delta_join_full_residual", "full", "FULL", "total > balance * 20"), ("delta_join_left_semi", "left_semi", "SEMI", ""), ("delta_join_left_anti_residual", "left_anti", "ANTI", "total > balance * 20")):
    register_changes(_name, EquiJoin(_DL, _DR, _kind, (("o_custkey", "c_custkey"),), None, "l.total > r.balance * 20" if _residual else None), {"orders": "o_orderkey", "customer": "c_custkey"}, f"SELECT * FROM {_DO.format(_sql, ' AND ' + _residual if _residual else '')}")
register_changes("delta_asof", AsOfJoin(_BUY, _VIEW, ">=", ("ts", "view_ts"), (("user_id", "view_user"),)), {"events": "event_id"}, f"SELECT event_id, user_id, ts, view_user, view_ts, view_id FROM (SELECT * FROM {_E} WHERE event_type = 'purchase') b ASOF LEFT JOIN (SELECT user_id AS view_user, ts AS view_ts, min(event_id) AS view_id FROM {_E} WHERE event_type = 'view' GROUP BY ALL) v ON b.user_id = v.view_user AND b.ts >= v.view_ts")
register_changes("delta_self_join", EquiJoin(Select(EVENTS, S("event_id", "user_id")), Select(EVENTS, S(("other_id", "event_id"), ("other_user", "user_id"))), "inner", (("user_id", "other_user"),), None, "l.event_id < r.other_id"), {"events": "event_id"}, f"SELECT a.event_id, a.user_id, b.event_id AS other_id, b.user_id AS other_user FROM {_E} a JOIN {_E} b ON a.user_id = b.user_id AND a.event_id < b.event_id")


_CAPTURED = T.StructType([T.StructField("o_orderkey", T.LongType(), False), T.StructField("o_custkey", T.LongType()), T.StructField("o_orderstatus", T.StringType())])


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders")["orders"].select(*_CAPTURED.names)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0")
def cdc_decode_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture: a snapshot of all rows, then deletions of some."""
    t = captured(spark, sf_dir)
    rows = envelopes(t, "r").unionByName(envelopes(t.filter("o_orderkey % 7 = 0"), "d"))
    return expanded(folded([decoded(rows, _CAPTURED).drop(ORD)]))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'O' THEN 'shipped' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def cdc_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come by c events, an update of every open order, and deletions of those in part."""
    t = captured(spark, sf_dir)
    open_ = t.filter("o_orderstatus = 'O'")
    moved = updates(open_, open_.withColumn("o_orderstatus", F.lit("shipped")), "o_orderkey")
    rows = envelopes(t, "c").unionByName(moved).unionByName(envelopes(t.filter("o_orderstatus = 'P'"), "d"))
    return expanded(folded([decoded(rows, _CAPTURED, snapshot=False).drop(ORD)]))


_WIRED = T.StructType([T.StructField("o_orderkey", T.LongType(), False), T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_totalprice", T.DecimalType(15, 2)), T.StructField("day", T.DateType())])


@query("SELECT o_orderkey, o_orderdate, CAST(o_totalprice AS DECIMAL(15, 2)) AS o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice < 200000")
def cdc_wire_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture with schema parts and values as on the wire: all rows, then deletions of the dear ones."""
    t = read(spark, sf_dir, "orders")["orders"]
    t = t.select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), F.col("o_totalprice").cast("decimal(15,2)").alias("o_totalprice"), F.col("o_orderdate").cast("date").alias("day"))
    rows = envelopes(t, "r", _WIRED).unionByName(envelopes(t.filter("o_totalprice >= 200000"), "d", _WIRED))
    return expanded(folded([decoded(rows, _WIRED).drop(ORD)]))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL")
def mysql_cdc_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program over a capture's files, snapshot and then deletions, into versioned files; their view."""
    t, root = captured(spark, sf_dir), f"{checkpoint_dir(spark)}/capture-{uuid.uuid4().hex}"
    folder = Folder(spark, root)
    folder.create("shop.orders.schema.json", _CAPTURED.json())
    program = Program.parse(f"INSERT INTO doris(connection => '{root}/out', table => 'totals') SELECT o_custkey, COUNT(*) AS n FROM mysql_cdc(connection => '{root}', table => 'shop.orders') GROUP BY o_custkey")
    running = None
    for part in (envelopes(t, "r"), envelopes(t.filter("o_orderstatus = 'F'"), "d")):
        part.write.mode("append").text(f"{root}/shop.orders")
        running = running or program.start(spark, f"{root}/state")
        running.advance()
    got = checkpointed(VersionedSink(spark, f"{root}/out/totals").current().drop("__id"))
    folder.delete()
    return got


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY ALL")
def versioned_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate's changes delivered to versioned files, one batch twice, and its current view."""
    t = read(spark, sf_dir, "orders")
    plan = Aggregate(ORDERS, S("o_custkey"), (Call("n", "count_star"),))
    path = f"{checkpoint_dir(spark)}/versioned-{uuid.uuid4().hex}"
    sink, state = VersionedSink(spark, path), MemoryState(spark)
    d = lambda x, n: with_diff(x).withColumn(DIFF, F.lit(n).cast("long"))
    for i, b in enumerate((d(t["orders"], 1), d(t["orders"].filter("o_orderkey % 4 = 0"), -1))):
        out = state.once(step(plan, {"orders": b}, state, lambda n: t[n].limit(0)))
        state.commit()
        sink.deliver(out, i)
        sink.deliver(out, i)
    got = checkpointed(sink.current().drop("__id"))
    state.close()
    Folder(spark, path).delete()
    return got


# -- whole pipelines -------------------------------------------------------------------------

register_sql(
    "pipeline_enrichment", "WITH orders AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM {orders}), customers AS (SELECT c_custkey, c_mktsegment FROM {customer}) SELECT orders.o_orderkey, orders.o_custkey, customers.c_mktsegment FROM orders JOIN customers ON orders.o_custkey = customers.c_custkey WHERE orders.o_orderstatus = 'F'",
    "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'",
)
register_sql(
    "pipeline_supplier_returns",
    """WITH sold AS (SELECT l_suppkey, COUNT(*) AS n_sold, SUM(CAST(l_quantity AS BIGINT)) AS units FROM {lineitem} GROUP BY l_suppkey),
    returned AS (SELECT l_suppkey AS suppkey, COUNT(*) AS n_returned FROM {lineitem} WHERE l_returnflag = 'R' AND CAST(l_quantity AS BIGINT) > 45 GROUP BY l_suppkey)
    SELECT s.s_suppkey, sold.n_sold, sold.units, returned.n_returned, CASE WHEN returned.n_returned IS NULL THEN 'clean' WHEN returned.n_returned * 25 > sold.n_sold THEN 'watch' ELSE 'usual' END AS grade
    FROM {supplier} AS s LEFT JOIN sold ON s.s_suppkey = sold.l_suppkey LEFT JOIN returned ON s.s_suppkey = returned.suppkey""",
    """SELECT s_suppkey, n_sold, units, n_returned, CASE WHEN n_returned IS NULL THEN 'clean' WHEN n_returned * 25 > n_sold THEN 'watch' ELSE 'usual' END AS grade FROM supplier
    LEFT JOIN (SELECT l_suppkey, count(*) AS n_sold, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units FROM lineitem GROUP BY ALL) ON s_suppkey = l_suppkey
    LEFT JOIN (SELECT l_suppkey AS k, count(*) AS n_returned FROM lineitem WHERE l_returnflag = 'R' AND CAST(l_quantity AS BIGINT) > 45 GROUP BY ALL) ON s_suppkey = k""",
)
register_sql(
    "pipeline_region_calendar",
    """WITH placed AS (SELECT o.o_orderkey, o.o_orderpriority, c.c_nationkey FROM {orders} AS o JOIN {customer} AS c ON o.o_custkey = c.c_custkey WHERE o.o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'),
    urgent AS (SELECT r.r_name, placed.o_orderkey FROM placed JOIN {nation} AS n ON placed.c_nationkey = n.n_nationkey JOIN {region} AS r ON n.n_regionkey = r.r_regionkey WHERE placed.o_orderpriority LIKE '1-%' OR placed.o_orderpriority LIKE '2-%')
    SELECT r_name, COUNT(*) AS n, MIN(o_orderkey) AS first_order, MAX(o_orderkey) AS last_order FROM urgent GROUP BY r_name HAVING COUNT(*) > 5""",
    """SELECT r_name, count(*) AS n, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND (o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%') GROUP BY ALL HAVING count(*) > 5""",
)
register_sql(
    "pipeline_click_to_signup",
    """WITH clicks AS (SELECT user_id, ts AS clicked, COUNT(*) AS at_once FROM {events} WHERE event_type = 'click' GROUP BY user_id, ts),
    later AS (SELECT e.event_id, e.event_type, c.clicked FROM {events} AS e ASOF JOIN clicks AS c MATCH_CONDITION (e.ts > c.clicked) ON e.user_id = c.user_id WHERE e.event_type <> 'click')
    SELECT event_type, COUNT(*) AS n, COUNT(clicked) AS n_after_click, MAX(clicked) AS last_click FROM later GROUP BY event_type""",
    """SELECT event_type, count(*) AS n, count(clicked) AS n_after_click, max(clicked) AS last_click FROM (SELECT * FROM events WHERE event_type <> 'click') e
    ASOF LEFT JOIN (SELECT DISTINCT user_id, ts AS clicked FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts > c.clicked GROUP BY ALL""",
)
