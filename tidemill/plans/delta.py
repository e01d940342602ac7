"""Changelog evaluation: the change of a plan's relation from the changes of its sources.

Filter, select and union pass changes on. For each other operator the relations of its inputs are
kept as state. With K the keys that the inputs' changes touch (rows for distinct, groups for an
aggregate, equality keys for joins), the change is op(new state on K) minus op(old state on K): right
for every join kind, residuals and historical ASOF matches included, at a cost of the touched keys.
An inner join takes two terms instead: left rows whose weight changes with all right rows, and the
others with right rows whose weight changes. A pair is in one term at most and comes once, with its net
weight, so pairs needn't be brought together: what is shuffled grows with the rows, not with the pairs. Rows with a NULL key match nothing and need no state. An aggregate keeps accumulators instead of
rows: a group's weight, and the count and the sum of each argument; for MIN and MAX the values of
the argument with their weights.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.changes import WAS, consolidated, data, difference, q, versions, with_diff
from ..functions.storage import Work
from ..functions.types import DIFF, ORD
from ..operators.aggregates import Accumulators
from ..operators.counting import running_event_count
from ..operators.joins import join
from .batch import PlanError, apply
from .nodes import Aggregate, AsOfJoin, Distinct, EquiJoin, Filter, Node, RunningEventCount, Scan, Select, UnionAll


class State(Protocol):
    """Relations by name, as of before this batch; changes become part of them when it commits."""

    def old(self, name: str, like: DataFrame, keys: DataFrame | None) -> DataFrame: ...

    def add(self, name: str, change: DataFrame, keys: list[str]) -> None: ...

    def number(self, name: str) -> int: ...

    def put_number(self, name: str, value: int) -> None: ...

    def once(self, df: DataFrame) -> DataFrame: ...


class MemoryState:
    """State within a session, for tests and small programs; close() removes its tables."""

    def __init__(self, spark: SparkSession) -> None:
        self.relations: dict[str, DataFrame] = {}
        self.numbers: dict[str, int] = {}
        self._new: dict[str, DataFrame] = {}
        self.once = Work(spark)

    def old(self, name, like, keys):
        df = self.relations.get(name)
        return with_diff(like).drop(ORD).limit(0) if df is None else df

    def add(self, name, change, keys):
        before = self.relations.get(name)
        change = change.drop(ORD, *keys)
        self._new[name] = change if before is None else before.unionByName(change)

    def number(self, name):
        return self.numbers.get(name, 0)

    def put_number(self, name, value):
        self.numbers[name] = value

    def close(self) -> None:
        self.once.close()

    def commit(self) -> None:
        for name, df in self._new.items():
            self.relations[name] = self.once(consolidated(df, name))
        self._new = {}


def _keyed(df: DataFrame, exprs: list[str]) -> DataFrame:
    return df.select("*", *(F.expr(e).alias(f"__k{i}") for i, e in enumerate(exprs)))


def _touched(df: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """Rows of df (with __k columns) whose keys are among keys; NULL agrees with NULL."""
    on = F.lit(True)
    d, k = df.alias("d"), keys.alias("k")
    for i in range(n):
        on = on & F.col(f"d.__k{i}").eqNullSafe(F.col(f"k.__k{i}"))
    return d.join(k, on, "left_semi")


def step(plan: Node, changes: dict[str, DataFrame], state: State, empty: Callable[[str], DataFrame], dealt: int = 0) -> DataFrame:
    """The plan's change for this batch. changes: by source, with __diff; empty: a source's columns
    without rows, for sources that haven't changed. dealt: if not 0, into how many partitions the sides
    of inner joins are dealt by their keys, so that the changes of several batches lie side by side."""
    done: dict[Node, DataFrame] = {}
    place: dict[Node, str] = {}

    def run(n: Node) -> DataFrame:
        if n in done:
            return done[n]
        if isinstance(n, Scan):
            df = changes.get(n.source)
            df = with_diff(empty(n.source)) if df is None else df
            done[n] = df.select(*(n.columns or data(df)), *(c for c in (DIFF, ORD) if c in df.columns))
            return done[n]
        deltas = [run(x) for x in n.inputs]
        name = place.setdefault(n, f"{len(place):04d}-{type(n).__name__.lower()}")
        if isinstance(n, (Filter, Select)):
            out = apply(n, deltas)
        elif isinstance(n, UnionAll):
            out = apply(n, [d.drop(ORD) for d in deltas])
        elif isinstance(n, RunningEventCount):
            order = [ORD] if ORD in deltas[0].columns else list(n.order)
            events = state.once(deltas[0])
            total = state.number(name)
            out = with_diff(running_event_count(events, order, total))
            state.put_number(name, total + events.count())
        elif isinstance(n, Aggregate) and (acc := Accumulators.of(deltas[0], list(n.keys), list(n.calls), n.strict)):
            out = accumulated(acc, name, deltas[0].drop(ORD))
        else:
            out = stateful(n, name, [state.once(consolidated(d.drop(ORD), signed=True)) for d in deltas])
        done[n] = out
        return out

    def accumulated(acc: Accumulators, name: str, delta: DataFrame) -> DataFrame:
        slim = state.once(acc.slim(delta))
        s = [q(k) for k in acc.keys]
        ks = [f"__k{i}" for i in range(len(s))]
        keys = state.once(_keyed(slim, s).select(*ks).distinct())

        def touched(own: str, like: DataFrame) -> DataFrame:
            before = _touched(_keyed(state.old(own, like, keys), s), keys, len(s)).drop(*ks)
            return consolidated(before, name)

        change = acc.summed(slim)
        old = state.once(touched(f"{name}-sums", change))
        new = state.once(acc.added(old, change))
        state.add(f"{name}-sums", _keyed(state.once(difference(with_diff(new), with_diff(old))), s), ks)
        ends_old, ends_new = [], []
        for i, a in enumerate(acc.extremes):
            change = state.once(acc.values(slim, a))
            before = touched(f"{name}-values{i}", change)
            state.add(f"{name}-values{i}", _keyed(change, s), ks)
            ends_old.append(acc.ends(before, a))
            ends_new.append(acc.ends(consolidated(before.unionByName(change), name), a))
        return difference(with_diff(acc.rendered(new, ends_new)), with_diff(acc.rendered(old, ends_old)))

    def stateful(n: Node, name: str, deltas: list[DataFrame]) -> DataFrame:
        if isinstance(n, Distinct):
            sides = [data(deltas[0])]
            sides = [[q(c) for c in sides[0]]]
        elif isinstance(n, Aggregate):
            sides = [[e for _, e in n.keys]]
        elif isinstance(n, (EquiJoin, AsOfJoin)):
            sides = [[a for a, _ in n.keys], [b for _, b in n.keys]]
        else:
            raise PlanError(f"{type(n).__name__} has no changelog form")
        m = len(sides[0])
        keyed = [_keyed(d, s) for d, s in zip(deltas, sides, strict=True)]
        ks = [f"__k{i}" for i in range(m)]
        keys = keyed[0].select(*ks)
        for k in keyed[1:]:
            keys = keys.unionByName(k.select(*ks))
        keys = state.once(keys.distinct()) if m else None
        inner = isinstance(n, EquiJoin) and n.kind == "inner"
        old, new = [], []
        for i, (d, s) in enumerate(zip(deltas, sides, strict=True)):
            own = f"{name}-{i}"
            before = _keyed(state.old(own, d, keys), s)
            before = consolidated((_touched(before, keys, m) if m else before).drop(*ks), name)
            state.add(own, _keyed(d, s), ks)
            old.append(before)
            new.append(state.once(versions(before, d, name)) if inner else consolidated(before.unionByName(d), name))
        if inner:
            return pairs(n, *new)
        return difference(with_diff(apply(n, new)), with_diff(apply(n, old)))

    def pairs(n: EquiJoin, left: DataFrame, right: DataFrame) -> DataFrame:
        """The change of an inner join from the versions of its sides."""
        names = list(n.names) if n.names else [*(c for c in data(left) if c != WAS), *(c for c in data(right) if c != WAS)]
        m = len(data(left)) - 1
        left, right = (df.select(*(F.col(q(c)) for c in data(df) if c != WAS), WAS, DIFF) for df in (left, right))
        if dealt:
            left, right = (df.repartition(dealt, *(F.expr(k[i]) for k in n.keys)) for i, df in enumerate((left, right)))
        moves = F.col(WAS) != F.col(DIFF)
        both = lambda l, r: join(l, r, n.kind, list(n.keys), [*names[:m], "__was_l", *names[m:], "__was_r"], n.residual)
        out = both(left.filter(moves), right).unionByName(both(left.filter(~moves), right.filter(moves)))
        out = out.withColumn(DIFF, F.col(DIFF) - F.col("__was_l") * F.col("__was_r"))
        return out.filter(F.col(DIFF) != 0).drop("__was_l", "__was_r")

    return run(plan)
