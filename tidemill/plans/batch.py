"""Snapshot evaluation: a plan over whole relations becomes one DataFrame, which Catalyst optimises."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import relational as rel
from ..operators.aggregates import aggregate
from ..operators.asof import asof_join
from ..operators.counting import running_event_count
from ..operators.joins import join
from .nodes import Aggregate, AsOfJoin, Distinct, EquiJoin, Filter, Node, RunningEventCount, Scan, Select, UnionAll


class PlanError(ValueError):
    """A plan can't be evaluated."""


def apply(node: Node, inputs: list[DataFrame]) -> DataFrame:
    """One operator over the results of its inputs, plain or weighted."""
    if isinstance(node, Filter):
        return rel.where(inputs[0], node.predicate)
    if isinstance(node, Select):
        return (rel.extend if node.extend else rel.project)(inputs[0], list(node.columns))
    if isinstance(node, UnionAll):
        parts = rel.aligned(inputs) if node.mode == "position" else rel.aligned_by_name(inputs, node.same_width) if node.mode == "name" else inputs
        return rel.union_all(parts)
    if isinstance(node, Distinct):
        return rel.distinct(inputs[0])
    if isinstance(node, Aggregate):
        return aggregate(inputs[0], list(node.keys), list(node.calls), node.strict)
    if isinstance(node, EquiJoin):
        return join(inputs[0], inputs[1], node.kind, list(node.keys), list(node.names) if node.names else None, node.residual)
    if isinstance(node, AsOfJoin):
        return asof_join(inputs[0], inputs[1], node.op, node.order, list(node.keys), list(node.names) if node.names else None)
    if isinstance(node, RunningEventCount):
        return running_event_count(inputs[0], list(node.order))
    raise PlanError(f"{type(node).__name__} can't be applied")


def evaluate(node: Node, sources: dict[str, DataFrame]) -> DataFrame:
    """The relation of a plan over its sources."""
    done: dict[Node, DataFrame] = {}

    def run(n: Node) -> DataFrame:
        if n not in done:
            if isinstance(n, Scan):
                if n.source not in sources:
                    raise PlanError(f"source {n.source} is missing")
                df = sources[n.source]
                done[n] = df.select(*n.columns) if n.columns else df
            else:
                done[n] = apply(n, [run(x) for x in n.inputs])
        return done[n]

    return run(node)
