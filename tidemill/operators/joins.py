"""Equality joins with residual predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.changes import data, q, weighted, with_diff
from ..functions.types import DIFF, indexable
from .relational import OperatorError

KINDS = {
    "inner": "inner", "left": "left", "right": "right", "full": "full", "left_semi": "left_semi", "left_anti": "left_anti", "right_semi": "left_semi", "right_anti": "left_anti",
}


def validate(left: DataFrame, right: DataFrame, kind: str, keys: list[tuple[str, str]], residual: str | None) -> None:
    if kind not in KINDS:
        raise OperatorError(f"join kind {kind} is not supported")
    if not keys:
        raise OperatorError("a join needs an equality between its inputs")
    for a, b in keys:
        x, y = left.select(F.expr(a).alias("x")).schema["x"].dataType, right.select(F.expr(b).alias("x")).schema["x"].dataType
        if x != y:
            raise OperatorError(f"join keys {a} and {b} differ in type: {x.simpleString()} and {y.simpleString()}")
        if not indexable(x):
            raise OperatorError(f"a join key can't be {x.simpleString()}")
    if residual is not None:
        t = left.alias("l").join(right.alias("r"), F.lit(True)).select(F.expr(residual).alias("x")).schema["x"].dataType
        if t not in (T.BooleanType(), T.NullType()):
            raise OperatorError(f"a residual needs a Boolean, not {t.simpleString()}")


def join(left: DataFrame, right: DataFrame, kind: str, keys: list[tuple[str, str]], names: list[str] | None = None, residual: str | None = None) -> DataFrame:
    """left joined with right on keys (expressions of either side) and the residual, an expression
    over l.* and r.*. names: of all columns, left's first; for semi and anti joins of their side's.
    NULL keys match nothing. A matched pair has the product of its weights."""
    validate(left, right, kind, keys, residual)
    heavy = weighted(left) or weighted(right)
    if heavy:
        left, right = with_diff(left), with_diff(right)
    # keys of either side under names of their own, so that equal names on both sides are no clash
    l = left.select("*", *(F.expr(a).alias(f"__l{i}") for i, (a, _) in enumerate(keys))).alias("l")
    r = right.select("*", *(F.expr(b).alias(f"__r{i}") for i, (_, b) in enumerate(keys))).alias("r")
    on = F.expr(" AND ".join([f"l.__l{i} = r.__r{i}" for i in range(len(keys))] + ([f"({residual})"] if residual else [])))
    semi = KINDS[kind] in ("left_semi", "left_anti")
    one = "r" if kind.startswith("right_") else "l"  # the side that a semi or anti join keeps
    both = r.join(l, on, KINDS[kind]) if one == "r" else l.join(r, on, KINDS[kind])
    own = right if one == "r" else left
    cols = [f"{one}.{q(c)}" for c in data(own)] + ([] if semi else [f"r.{q(c)}" for c in data(right)])
    names = names or [*data(own), *([] if semi else data(right))]
    if len(names) != len(cols) or len(set(names)) != len(names):
        raise OperatorError("output names repeat or don't fit")
    out = [F.col(c).alias(n) for c, n in zip(cols, names, strict=True)]
    if heavy:
        d = F.col(f"{one}.{DIFF}") if semi else F.coalesce(F.col(f"l.{DIFF}"), F.lit(1)) * F.coalesce(F.col(f"r.{DIFF}"), F.lit(1))
        out.append(d.cast("long").alias(DIFF))
    return both.select(*out)
