"""Changelog forms against naive bags after every batch, and restarts."""

import base64
import json
import random
from collections import Counter

import pytest
from bags import asof, fold, grouped, joined
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.changes import ChangeError, consolidated, data, expanded, folded, prefix_checked, valid_change
from tidemill.functions.types import DIFF, ORD
from tidemill.operators.aggregates import Call
from tidemill.plans.delta import MemoryState, step
from tidemill.plans.nodes import Aggregate, AsOfJoin, Distinct, EquiJoin, Filter, RunningEventCount, Scan, Select, UnionAll

KV = "k long, v long"


def change(spark, events, schema=KV):
    return spark.createDataFrame([(*r, n) for r, n in events], f"{schema}, {DIFF} long")


def bag(df):
    return Counter({tuple(r[c] for c in data(df)): r[DIFF] for r in df.collect()})


def run(spark, plan, batches, schemas):
    """The folded output after each batch."""
    state, out = MemoryState(spark), Counter()
    empty = lambda n: spark.createDataFrame([], schemas[n])
    for b in batches:
        got = state.once(step(plan, {n: change(spark, e, schemas[n]) for n, e in b.items() if e}, state, empty).drop(ORD))
        state.commit()
        for row, n in bag(got).items():
            out[row] += n
            assert out[row] >= 0
        yield +out
    state.close()


N = None


def generated(seed, sides, row, batches=6, events=8):
    """Batches of random events that never retract a row that isn't there."""
    rng, live, out = random.Random(seed), {s: Counter() for s in sides}, []
    for _ in range(batches):
        got = {s: [] for s in sides}
        for _ in range(events):
            s = rng.choice(sides)
            there = [r for r, n in live[s].items() if n]
            if there and rng.random() < 0.4:
                r = rng.choice(sorted(there, key=str))
                n = -rng.randint(1, live[s][r])
            else:
                r, n = row(rng), rng.randint(1, 3)
            live[s][r] += n
            got[s].append((r, n))
        out.append(got)
    return out


@pytest.mark.parametrize(("kind", "residual"), [("inner", None), ("left", "l.v > r.v"), ("full", "l.v > r.v"), ("full", None), ("left_semi", "l.v > r.v"), ("left_anti", None)])
def test_joins(spark, kind, residual):
    plan = EquiJoin(Scan("l"), Select(Scan("r"), (("k2", "k"), ("v2", "v"))), kind, (("k", "k2"),), None, residual.replace("r.v", "r.v2") if residual else None)
    batches = generated(len(kind), ("l", "r"), lambda rng: (rng.choice([1, 1, 2, 3, N]), rng.randint(0, 9)))
    seen = {"l": [], "r": []}
    for b, got in zip(batches, run(spark, plan, batches, {"l": KV, "r": KV}), strict=True):
        for s in seen:
            seen[s] += b[s]
        assert got == joined(fold(seen["l"]), fold(seen["r"]), kind, (lambda l, r: l[1] > r[1]) if residual else (lambda l, r: True))


def test_asof(spark):
    def row(rng):
        g, at = rng.choice([1, 1, 2, N]), rng.choice([*range(0, 12), N])
        return g, at, None if at is None else 100 * (g or 0) + at  # one row for each group and order

    batches = generated(8, ("l", "r"), row)
    for op in (">=", "<"):
        plan = AsOfJoin(Scan("l"), Select(Scan("r"), (("g2", "g"), ("at2", "at"), ("id2", "id"))), op, ("at", "at2"), (("g", "g2"),))
        seen = {"l": [], "r": []}
        for b, got in zip(batches, run(spark, plan, batches, {"l": "g long, at long, id long", "r": "g long, at long, id long"}), strict=True):
            for s in seen:
                seen[s] += b[s]
            assert got == asof(fold(seen["l"]), fold(seen["r"]), op)


def test_residuals_of_right_joins_keep_their_literals(spark):
    from tidemill.operators.joins import join

    left = spark.createDataFrame([(1, "small.x"), (2, "r.v")], "k long, v string")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, w string")
    assert [tuple(r) for r in join(left, right, "right_semi", [("k", "k")], None, "l.v = 'small.x'").collect()] == [(1, "a")]
    assert sorted(tuple(r) for r in join(left, right, "right_anti", [("k", "k")], None, "l.v = 'r.v' AND r.w = 'b'").collect()) == [(1, "a"), (3, "c")]


def test_event_count_overflow_is_an_error(spark):
    from tidemill.operators.counting import running_event_count

    assert sorted(r[0] for r in running_event_count(spark.range(2), ["id"], (1 << 63) - 3).collect()) == [(1 << 63) - 2, (1 << 63) - 1]
    with pytest.raises(Exception, match="more events"):
        running_event_count(spark.range(3), ["id"], (1 << 63) - 3).collect()


def test_aggregate_random_and_batch_invariance(spark):
    rng, live, events = random.Random(5), Counter(), []
    while len(events) < 120:
        row, n = (rng.choice("AB"), rng.choice([N, 1, 2, 3])), rng.choice([-2, -1, 1, 2])
        if live[row] + n >= 0:
            live[row] += n
            events.append((row, n))
    calls = (Call("n", "count_star"), Call("nv", "count", "v"), Call("s", "sum", "v"), Call("a", "avg", "v"), Call("lo", "min", "v"), Call("hi", "max", "v"))
    plan = Aggregate(Scan("t"), (("d", "d"),), calls)
    for size in (10, 120):
        parts = [events[i : i + size] for i in range(0, len(events), size)]
        seen = []
        for p, got in zip(parts, run(spark, plan, [{"t": p} for p in parts], {"t": "d string, v long"}), strict=True):
            seen += p
            assert got == grouped(fold(seen))


def test_aggregates_keep_accumulators_and_not_rows(spark):
    """Without MIN and MAX the state has a row for each group, whatever its input rows."""
    plan = Aggregate(Scan("t"), (("k", "k"),), (Call("n", "count_star"), Call("s", "sum", "v"), Call("a", "avg", "v")))
    state = MemoryState(spark)
    for b in ([((k % 3, k), 1) for k in range(60)], [((0, k), -1) for k in range(0, 60, 3)], [((1, 10**18), 9), ((1, 10**18), -8)]):
        out = state.once(step(plan, {"t": change(spark, b)}, state, lambda n: spark.createDataFrame([], KV)))
        state.commit()
    assert sum(df.count() for df in state.relations.values()) == 2
    assert bag(out) == {(1, 20, 590, 29.5): -1, (1, 21, 590 + 10**18, (590 + 10**18) / 21): 1}
    state.close()


def test_distinct_keeps_zeros_of_either_sign_apart(spark):
    batches = [{"t": [((-0.0,), 1), ((0.0,), 2)]}, {"t": [((0.0,), -1)]}, {"t": [((0.0,), -1)]}]
    got = [sorted(str(r[0]) for r in g) for g in _floats(spark, batches)]
    assert got == [["-0.0", "0.0"], ["-0.0", "0.0"], ["-0.0"]]


def _floats(spark, batches):
    state, out = MemoryState(spark), Counter()
    for b in batches:
        d = state.once(step(Distinct(Scan("t")), {"t": change(spark, b["t"], "v double")}, state, lambda n: spark.createDataFrame([], "v double")))
        state.commit()
        for r in d.collect():
            out[str(r["v"])] += r[DIFF]
        yield [(k,) for k, n in out.items() if n > 0]


def test_retraction_of_what_is_not_there_is_an_error(spark):
    for plan in (Distinct(Scan("t")), Aggregate(Scan("t"), (("k", "k"),), (Call("n", "count_star"),))):
        with pytest.raises(Exception, match="retracted more often"):
            list(run(spark, plan, [{"t": [((1, 2), 1)]}, {"t": [((1, 2), -2)]}], {"t": KV}))


def test_stateless_and_event_count(spark):
    plan = UnionAll((Filter(Scan("t"), "v > 1"), Select(Scan("t"), (("k", "v"), ("v", "k")))))
    got = list(run(spark, plan, [{"t": [((1, 2), 3)]}, {"t": [((1, 2), -1), ((5, 0), 1)]}], {"t": KV}))
    assert got[-1] == {(1, 2): 2, (2, 1): 2, (0, 5): 1}
    got = list(run(spark, RunningEventCount(Scan("t"), ("k",)), [{"t": [((1, 2), 3), ((2, 2), -1)]}, {"t": [((3, 2), 1)]}], {"t": KV}))
    assert got[-1] == {(1,): 1, (2,): 1, (3,): 1}


def test_change_rules(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, -1, 1)], f"v long, {DIFF} long, {ORD} long")
    assert prefix_checked(df).count() == 2
    with pytest.raises(Exception, match="retracted"):
        prefix_checked(df.selectExpr("v", f"-{DIFF} AS {DIFF}", ORD)).collect()
    with pytest.raises(ChangeError):
        valid_change(spark.range(1))
    with pytest.raises(Exception, match="null or 0"):
        valid_change(spark.createDataFrame([(1, 0)], f"v long, {DIFF} long")).collect()
    both = folded([spark.createDataFrame([(1, 2)], f"v long, {DIFF} long"), spark.createDataFrame([(1, -1), (2, 1)], f"v long, {DIFF} long")])
    assert sorted(r["v"] for r in expanded(both).collect()) == [1, 2]
    assert consolidated(both).count() == 2


# -- whole programs --------------------------------------------------------------------------

ORDERS = T.StructType([T.StructField("order_id", T.LongType(), False), T.StructField("store", T.LongType()), T.StructField("status", T.StringType()), T.StructField("amount", T.LongType())])
SALES = "SELECT store, COUNT(*) AS n, SUM(amount) AS s, AVG(amount) AS a, MIN(amount) AS lo, MAX(amount) AS hi FROM postgres_cdc(connection => '{}', table => 'sales.orders', publication => 'p') WHERE status = 'paid' GROUP BY store"


@pytest.fixture
def capture(tmp_path):
    (tmp_path / "sales.orders").mkdir()
    (tmp_path / "sales.orders.schema.json").write_text(ORDERS.json())

    def put(n, *events):
        row = lambda r: None if r is None else dict(zip(ORDERS.names, r, strict=True))
        (tmp_path / "sales.orders" / f"{n:04d}.json").write_text("\n".join(json.dumps({"payload": {"op": op, "before": row(b), "after": row(a)}}) for op, b, a in events))

    return tmp_path, put


def table(path, name):
    import sqlite3

    con = sqlite3.connect(path)
    try:
        return sorted(r[2:] for r in con.execute(f'SELECT * FROM "{name}"'))
    finally:
        con.close()


@pytest.mark.parametrize("crash", ["state", "sink"])
def test_program_survives_crashes(spark, capture, crash):
    from tidemill.sql.program import Program

    root, put = capture
    db = str(root / "out.sqlite")
    program = Program.parse(f"INSERT INTO sqlite(path => '{db}', table => 'sales') " + SALES.format(root))
    put(1, ("r", None, (1, 11, "paid", 10)), ("r", None, (2, 11, "new", 5)), ("r", None, (3, 12, "paid", 7)))
    p = program.start(spark, str(root / "state"))
    assert p.advance() and table(db, "sales") == [(11, 1, 10, 10.0, 10, 10), (12, 1, 7, 7.0, 7, 7)]
    put(2, ("u", (2, 11, "new", 5), (2, 11, "paid", 5)), ("u", (3, 12, "paid", 7), (3, 12, "refunded", 7)))

    def fail(point):
        if point == crash:
            raise RuntimeError("crash")

    p.between = fail
    with pytest.raises(Exception, match="crash"):
        p.advance()
    p = program.start(spark, str(root / "state"))
    p.advance()
    assert table(db, "sales") == [(11, 2, 15, 7.5, 5, 10)]
    assert not p.advance()
    other = Program.parse(program.sql.replace("'paid'", "'new'"))
    with pytest.raises(Exception, match="another program"):
        other.start(spark, str(root / "state"))


def test_envelopes_that_do_not_fit_are_errors(spark):
    from tidemill.sources.cdc import decoded

    good = {"order_id": 1, "store": 2, "status": "x", "amount": 3}
    for payload in ({"op": "t", "before": None, "after": None}, {"op": "c", "before": None, "after": {"order_id": 1}}, {"op": "d", "before": None, "after": good}, {"op": "c", "before": None, "after": good | {"order_id": None}}, {"op": "c", "before": None, "after": good | {"amount": "three"}}):
        with pytest.raises(Exception):  # noqa: B017  raised in the executor
            decoded(spark.createDataFrame([(json.dumps({"payload": payload}),)], "value string"), ORDERS).collect()
    with pytest.raises(Exception, match="phase"):
        decoded(spark.createDataFrame([(json.dumps({"payload": {"op": "c", "before": None, "after": good}}),)], "value string"), ORDERS, snapshot=True).collect()


TYPED = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("day", T.DateType()), T.StructField("at", T.TimestampNTZType()), T.StructField("price", T.DecimalType(15, 2)), T.StructField("raw", T.BinaryType())])


def test_values_on_the_wire_round_trip_and_drift_is_an_error(spark):
    import base64
    import datetime
    from decimal import Context, Decimal

    from tidemill.sources.cdc import decoded, envelopes

    rows = [(1, datetime.date(1969, 12, 30), datetime.datetime(2024, 2, 29, 1, 2, 3, 456789), Decimal("-12.34"), b"\x00a"), (2, None, None, None, None), (3, datetime.date(2024, 1, 1), datetime.datetime(1969, 1, 1), Decimal("0.05"), b"")]
    df = spark.createDataFrame(rows, TYPED)
    got = decoded(envelopes(df, "c", TYPED), TYPED).drop(ORD)
    assert sorted((tuple(r) for r in got.collect()), key=str) == [(*r, 1) for r in rows]
    wide = T.StructType([T.StructField("d", T.DecimalType(38, 10))])
    for x in ("-99999999999999999999999999.9999999999", "0.0000000001", "12345678901234567890.5", "-1"):
        n = int(Context(prec=60).scaleb(Decimal(x), 10))
        text = base64.b64encode(n.to_bytes((n.bit_length() + 8) // 8, "big", signed=True)).decode()
        head = envelopes(spark.createDataFrame([(None,)], wide), "c", wide).first()[0].replace('"d":null', f'"d":"{text}"')
        assert decoded(spark.createDataFrame([(head,)], "value string"), wide).first()["d"] == Decimal(x)
    other = [T.StructType([*TYPED.fields[:3], T.StructField("price", T.DecimalType(15, 3)), TYPED[4]]), T.StructType([T.StructField("id", T.LongType()), *TYPED.fields[1:]]), T.StructType(TYPED.fields[:4]), T.StructType([*TYPED.fields[:4], T.StructField("raw", T.StringType())])]
    for declared in other:
        with pytest.raises(Exception, match="schema has changed|declared columns"):
            decoded(envelopes(df, "c", TYPED), declared).collect()


def test_envelopes_are_parsed_once_whatever_their_columns(spark):
    """A row with more columns makes the plan longer, not its parsing more frequent."""
    from tidemill.sources.cdc import decoded, envelopes

    def parses(columns):
        schema = T.StructType([T.StructField(f"c{i}", T.DecimalType(15, 2)) for i in range(columns)])
        rows = envelopes(spark.range(3).select(*(F.col("id").cast("decimal(15,2)").alias(f"c{i}") for i in range(columns))), "r", schema)
        plan = decoded(rows, schema)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("from_json"), plan.count("get_json_object"), plan.count("unbase64")

    (a, b, c), few = parses(6), parses(2)
    assert (a, b) == few[:2] and a <= 12 and few[2] <= c <= 12


def test_lines_with_other_schema_texts_are_judged_by_themselves(spark):
    from decimal import Context, Decimal

    from tidemill.sources.cdc import decoded, envelopes

    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("d", T.DecimalType(38, 2))])
    empty = envelopes(spark.createDataFrame([(0, None)], schema), "c", schema).first()[0]
    line = lambda i, x: empty.replace('"id":0', f'"id":{i}').replace('"d":null', f'"d":"{x}"')
    got = lambda *lines: sorted(tuple(r)[:2] for r in decoded(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), schema).collect())
    one = line(1, "AQ==")
    head, tail = one.split(',"payload":')
    spaced = head.replace(": ", " :  ") + ', "payload" : ' + tail.replace('"id":1', '"id":2')
    swapped = '{"payload":' + tail[:-1].replace('"id":1', '"id":3') + "," + head[1:] + "}"
    plain = '{"payload":{"before":null,"after":{"id":4,"d":0.01},"op":"c"}}'
    for first in (one, swapped):
        assert got(first, *(x for x in (one, spaced, swapped, plain) if x != first)) == [(i, Decimal("0.01")) for i in (1, 2, 3, 4)]
    for bad, why in ((one.replace('"scale": "2"', '"scale": "3"'), "schema has changed"), (head + ',"payload":"x","ts_ms":1}', "no envelope")):
        with pytest.raises(Exception, match=why):
            got(one, bad)
    # of more than 8 and 16 bytes, as far as 38 digits go
    wide = [10**38 - 1, 1 - 10**38, 2**64 - 1, -(2**64), 2**63, -(2**63), -1]
    text = lambda n, size: base64.b64encode(n.to_bytes(size, "big", signed=True)).decode()
    assert got(*(line(i, text(n, size)) for i, (n, size) in enumerate((n, size) for n in wide for size in (16, 24)))) == [(i, Decimal(wide[i // 2]).scaleb(-2, Context(prec=60))) for i in range(14)]
    with pytest.raises(Exception):  # noqa: B017  raised in the executor
        got(one, line(1, text(2**127 + 1, 24)))


def test_records_without_rows(spark):
    from tidemill.sources.cdc import decoded

    got = lambda *lines, **kw: decoded(spark.createDataFrame([(x,) for x in lines], "value string"), ORDERS, **kw).count()
    note = lambda kind: json.dumps({"payload": {"aggregate_type": "Initial Snapshot", "type": kind}})
    assert got('{"payload": {"ts_ms": 5}}', note("STARTED"), note("COMPLETED"), None, "null") == 0
    for bad, kw in ((("not json",), {}), ((note("ABORTED"),), {}), (('{"payload": {"x": 1}}',), {}), ((None,), {"tombstones": False}), (("null",), {"tombstones": False})):
        with pytest.raises(Exception, match="no envelope|notification|tombstone"):
            decoded(spark.createDataFrame([(x,) for x in bad], "value string"), ORDERS, **kw).collect()
    row = {"order_id": 1, "store": 2, "status": "x", "amount": 3}
    for op, marker, good in (("r", "true", 1), ("r", "last", 1), ("c", "false", 1), ("r", "false", 0), ("c", "true", 0), ("c", "incremental", 0)):
        line = json.dumps({"payload": {"op": op, "before": None, "after": row, "source": {"snapshot": marker}}})
        if good:
            assert got(line) == 1
        else:
            with pytest.raises(Exception, match="marker"):
                decoded(spark.createDataFrame([(line,)], "value string"), ORDERS).collect()


@pytest.mark.parametrize("end", ["event", "marker", "notification"])
def test_snapshot_rows_after_its_end_are_errors(spark, capture, end):
    from tidemill.sql.program import Program

    root, put = capture
    db, folder = str(root / "out.sqlite"), root / "sales.orders"
    program = Program.parse(f"INSERT INTO sqlite(path => '{db}', table => 'sales') " + SALES.format(root))
    p = program.start(spark, str(root / "state"))
    put(1, ("r", None, (1, 11, "paid", 10)), ("r", None, (2, 11, "paid", 5)))
    assert p.advance() and p.state.number("sealed-" + next(iter(p.sources))) == 0
    if end == "event":
        put(2, ("d", (1, 11, "paid", 10), None))
    elif end == "marker":
        row = dict(zip(ORDERS.names, (3, 11, "paid", 1), strict=True))
        (folder / "0002.json").write_text(json.dumps({"payload": {"op": "r", "before": None, "after": row, "source": {"snapshot": "last"}}}))
    else:
        (folder / "0002.json").write_text(json.dumps({"payload": {"aggregate_type": "Initial Snapshot", "type": "COMPLETED"}}))
    assert p.advance()
    before = table(db, "sales")
    put(3, ("r", None, (4, 11, "paid", 2)))
    with pytest.raises(Exception, match="after the end of the snapshot"):
        program.start(spark, str(root / "state")).advance()
    assert table(db, "sales") == before
    put(3, ("c", None, (4, 11, "paid", 2)))
    again = program.start(spark, str(root / "state"))
    again.advance()
    assert table(db, "sales") != before


def test_late_snapshot_rows_within_a_batch(spark):
    from tidemill.sources.cdc import sealed

    line = lambda op: json.dumps({"payload": {"op": op, "before": None, "after": {}}})
    rows = lambda *ops: spark.createDataFrame([(i, line(op)) for i, op in enumerate(ops)], "n int, value string")
    assert not sealed(rows("r", "r"), ["n"], False) and sealed(rows("r", "c"), ["n"], False)
    with pytest.raises(ValueError, match="after the end"):
        sealed(rows("r", "c", "r"), ["n"], False)
    with pytest.raises(ValueError, match="after the end"):
        sealed(rows("r"), ["n"], True)


def test_table_sinks_delete_the_oldest_copies_in_statements_of_many_rows(spark, tmp_path, monkeypatch):
    from tidemill.sinks.relational import SinkError, SqliteSink

    monkeypatch.setattr(SqliteSink, "ROWS", 3)
    path = str(tmp_path / "t.sqlite")
    sink = SqliteSink(path, "t")
    sink.deliver(change(spark, [((1, k), 2) for k in range(5)]), 0)
    ids = lambda: dict(_ids(path))
    first = ids()
    sink.deliver(change(spark, [((1, k), -1) for k in range(4)] + [((2, 0), 4)]), 1)
    after = ids()
    assert {r: (min(x), max(x)) for r, x in first.items() if r[1] != 4 and r[0] == 1} == {r: (min(first[r]), x[0]) for r, x in after.items() if r[1] != 4 and r[0] == 1}
    assert all(len(after[(1, k)]) == 1 for k in range(4)) and len(after[(1, 4)]) == 2 and len(after[(2, 0)]) == 4
    sink.deliver(change(spark, [((9, 9), 1)]), 1)  # delivered before
    assert ids() == after
    with pytest.raises(SinkError, match="more often"):
        sink.deliver(change(spark, [((1, 0), -2), ((1, 1), -1)]), 2)
    assert ids() == after


def _ids(path):
    import sqlite3

    con, out = sqlite3.connect(path), {}
    for i, k, v in con.execute("SELECT __id, k, v FROM t ORDER BY __id"):
        out.setdefault((k, v), []).append(i)
    con.close()
    return out
