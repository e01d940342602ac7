"""Filter, select, union and distinct."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.changes import consolidated, data, q, weighted
from ..functions.types import DIFF, ORD


class OperatorError(ValueError):
    """An operator can't be applied to its inputs."""


def _technical(df: DataFrame) -> list[str]:
    return [c for c in (DIFF, ORD) if c in df.columns]


def as_column(e: str | Column) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def where(df: DataFrame, predicate: str | Column) -> DataFrame:
    """Rows for which the predicate is true; it must be Boolean."""
    p = as_column(predicate)
    if (t := df.select(p.alias("p")).schema["p"].dataType) not in (T.BooleanType(), T.NullType()):
        raise OperatorError(f"a filter needs a Boolean, not {t.simpleString()}")
    return df.filter(p)


def project(df: DataFrame, columns: list[tuple[str, str | Column]]) -> DataFrame:
    """New columns from expressions; weights stay, also with no column at all."""
    names = [n for n, _ in columns]
    if len(set(names)) != len(names):
        raise OperatorError("output names repeat")
    return df.select(*(as_column(e).alias(n) for n, e in columns), *_technical(df))


def extend(df: DataFrame, columns: list[tuple[str, str | Column]]) -> DataFrame:
    """Further columns, all from the original ones."""
    if taken := {n for n, _ in columns} & set(df.columns):
        raise OperatorError(f"{sorted(taken)[0]} exists")
    return project(df, [(c, F.col(q(c))) for c in data(df)] + columns)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows of inputs with the same columns in the same order."""
    first = [(f.name, f.dataType) for f in parts[0].schema if f.name not in (DIFF, ORD)]
    for p in parts[1:]:
        if [(f.name, f.dataType) for f in p.schema if f.name not in (DIFF, ORD)] != first:
            raise OperatorError("a union needs inputs with the same columns")
    if any(weighted(p) for p in parts):
        parts = [p if weighted(p) else p.withColumn(DIFF, F.lit(1).cast("long")) for p in parts]
        parts = [p.select(*(F.col(q(c)) for c, _ in first), DIFF) for p in parts]
    return reduce(DataFrame.union, parts)


def aligned(parts: list[DataFrame]) -> list[DataFrame]:
    """Inputs of a positional SQL union: the first's names, common types."""
    width = len(data(parts[0]))
    if any(len(data(p)) != width for p in parts):
        raise OperatorError("branches of a union differ in width")
    common = reduce(DataFrame.union, (p.select(*(F.col(q(c)) for c in data(p))) for p in parts)).schema
    return [p.select(*(F.col(q(c)).cast(f.dataType).alias(n) for c, f, n in zip(data(p), common, data(parts[0]), strict=True)), *_technical(p)) for p in parts]


def aligned_by_name(parts: list[DataFrame], same_width: bool = False) -> list[DataFrame]:
    """Inputs of a SQL union BY NAME: missing columns are NULL."""
    names = list(dict.fromkeys(c for p in parts for c in data(p)))
    if same_width and len({len(data(p)) for p in parts}) > 1:
        raise OperatorError("branches of UNION DISTINCT BY NAME differ in width")
    common = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.select(*(F.col(q(c)) for c in data(p))) for p in parts)).schema
    return [p.select(*((F.col(q(n)) if n in data(p) else F.lit(None)).cast(common[n].dataType).alias(n) for n in names), *_technical(p)) for p in parts]


def distinct(df: DataFrame) -> DataFrame:
    """One copy of each row that is there."""
    if not weighted(df):
        return df.distinct()
    return consolidated(df, "distinct").withColumn(DIFF, F.lit(1).cast("long"))
