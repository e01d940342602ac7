"""Grouped COUNT, SUM, AVG, MIN and MAX over plain and weighted rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.changes import consolidated, nonnegative, q, weighted
from ..functions.types import DIFF, UINT64, indexable, is_float, is_integral
from .relational import OperatorError, as_column

FUNCTIONS = ("count_star", "count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Call:
    """One aggregate: its output name, its function and its argument (none for COUNT(*))."""

    name: str
    function: str
    argument: str | None = None


def _typed(df: DataFrame, e: str | Column) -> T.DataType:
    return df.select(as_column(e).alias("x")).schema["x"].dataType


def validate(df: DataFrame, keys: list[tuple[str, str]], calls: list[Call], strict: bool = True) -> None:
    """Errors for what the model has no exact result for. Not strict: floats are let through."""
    if not keys:
        raise OperatorError("an aggregate needs a group key")
    names = [n for n, _ in keys] + [c.name for c in calls]
    if len(set(names)) != len(names):
        raise OperatorError("output names repeat")
    for name, e in keys:
        if strict and is_float(_typed(df, e)):
            raise OperatorError(f"{name}: a group key can't hold floats")
    for c in calls:
        if c.function not in FUNCTIONS or (c.argument is None) != (c.function == "count_star"):
            raise OperatorError(f"{c.function} is not supported")
        if c.argument is None or c.function == "count":
            continue
        t = _typed(df, c.argument)
        if c.function in ("sum", "avg") and not is_integral(t) and (strict or not isinstance(t, T.NumericType)):
            raise OperatorError(f"{c.name}: {c.function} of {t.simpleString()} is not supported")
        if c.function in ("min", "max") and strict and not indexable(t):
            raise OperatorError(f"{c.name}: {c.function} of {t.simpleString()} is not supported")


def aggregate(df: DataFrame, keys: list[tuple[str, str]], calls: list[Call], strict: bool = True) -> DataFrame:
    """A row for each group: its keys and calls. Weighted input gives weighted output.

    Arguments are worked out once and shared among calls. Sums are kept as decimals of 38 digits
    where a 64-bit sum could overflow on the way, and narrowed with an error if they don't fit.
    """
    validate(df, keys, calls, strict)
    arguments = list(dict.fromkeys(c.argument for c in calls if c.argument is not None))
    place = {a: f"__a{i}" for i, a in enumerate(arguments)}
    types = {a: _typed(df, a) for a in arguments}
    heavy = weighted(df)
    slim = df.select(*(as_column(e).alias(n) for n, e in keys), *(as_column(a).alias(place[a]) for a in arguments), *([DIFF] if heavy else []))
    if heavy and any(c.function in ("min", "max") for c in calls):
        slim = consolidated(slim, "aggregate")
    w = F.col(DIFF) if heavy else None
    summed = {c.argument for c in calls if c.function == "sum"}

    def count(a: str | None) -> Column:
        if heavy:
            got = F.sum(w) if a is None else F.sum(F.when(F.col(place[a]).isNotNull(), w).otherwise(F.lit(0).cast("long")))
            return nonnegative(got, "aggregate")
        return F.count(F.lit(1)) if a is None else F.count(F.col(place[a]))

    def total(a: str, wide: bool) -> Column:
        x = F.col(place[a])
        if is_float(types[a]) or isinstance(types[a], T.DecimalType) and types[a] != UINT64:
            return F.sum(x * w) if heavy else F.sum(x)
        if heavy or wide or types[a] == UINT64:
            x = x.cast("decimal(20,0)")
            return F.sum((x * w.cast("decimal(18,0)")).cast("decimal(38,0)")) if heavy else F.sum(x.cast("decimal(38,0)"))
        return F.sum(x.cast("long"))  # an overflow is an error under ANSI

    def column(c: Call) -> Column:
        a = c.argument
        if c.function in ("count_star", "count"):
            return count(a)
        if c.function in ("min", "max"):
            return (F.min if c.function == "min" else F.max)(F.col(place[a]))
        there = count(a) > 0
        if c.function == "sum":
            got, t = total(a, False), types[a]
            narrow = t if not is_integral(t) else UINT64 if t == UINT64 else T.LongType()
            return F.when(there, got.cast(narrow)) if is_integral(t) else F.when(there, got)
        # the sum as a double over the count; a sum that is asked for too has been checked already
        return F.when(there, total(a, a not in summed).cast("double") / count(a).cast("double"))

    group = slim.groupBy(*(F.col(q(n)) for n, _ in keys))
    own = [F.sum(w).alias("__w")] if heavy else []
    if not own and not calls:
        return slim.select(*(F.col(q(n)) for n, _ in keys)).distinct()
    out = group.agg(*(column(c).alias(c.name) for c in calls), *own)
    if not heavy:
        return out
    out = out.withColumn("__w", nonnegative(F.col("__w"), "aggregate")).filter("__w > 0").drop("__w")
    return out.withColumn(DIFF, F.lit(1).cast("long"))


class Accumulators:
    """The state of an aggregate over weighted rows: for each group its weight (__w), and for each
    argument the weight of its values that aren't null (__c) and their sum (__s). Columns are the keys
    and these; MIN and MAX are read off the values of their argument."""

    def __init__(self, df: DataFrame, keys: list[tuple[str, str]], calls: list[Call]):
        self.given, self.calls, self.keys = keys, calls, [n for n, _ in keys]
        self.arguments = list(dict.fromkeys(c.argument for c in calls if c.argument is not None))
        self.types = {a: _typed(df, a) for a in self.arguments}
        self.sums = [a for a in self.arguments if any(c.argument == a and c.function in ("sum", "avg") for c in calls)]
        self.extremes = [a for a in self.arguments if any(c.argument == a and c.function in ("min", "max") for c in calls)]

    @staticmethod
    def of(df: DataFrame, keys: list[tuple[str, str]], calls: list[Call], strict: bool) -> Accumulators | None:
        """None where sums wouldn't be exact, or groups not be told apart by equality: floats."""
        validate(df, keys, calls, strict)
        acc = Accumulators(df, keys, calls)
        exact = all(is_integral(acc.types[a]) for a in acc.sums) and not any(is_float(acc.types[a]) for a in acc.extremes)
        return acc if exact and not any(is_float(_typed(df, e)) for _, e in keys) else None

    def _at(self, a: str) -> int:
        return self.arguments.index(a)

    def slim(self, df: DataFrame) -> DataFrame:
        return df.select(*(as_column(e).alias(n) for n, e in self.given), *(as_column(a).alias(f"__a{i}") for i, a in enumerate(self.arguments)), F.col(DIFF))

    def _totals(self, df: DataFrame, columns: list[Column]) -> DataFrame:
        return df.groupBy(*(F.col(q(n)) for n in self.keys)).agg(*columns)

    def summed(self, slim: DataFrame) -> DataFrame:
        w = F.col(DIFF)
        counts = [F.sum(F.when(F.col(f"__a{i}").isNotNull(), w).otherwise(F.lit(0).cast("long"))).alias(f"__c{i}") for i in range(len(self.arguments))]
        sums = [F.coalesce(F.sum((F.col(f"__a{self._at(a)}").cast("decimal(20,0)") * w.cast("decimal(18,0)")).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"__s{self._at(a)}") for a in self.sums]
        return self._totals(slim, [F.sum(w).alias("__w"), *counts, *sums])

    def added(self, old: DataFrame, change: DataFrame) -> DataFrame:
        """The accumulators after a change; groups that are empty then are gone."""
        names = [c for c in change.columns if c not in self.keys]
        kept = [nonnegative(F.sum(c), "aggregate").alias(c) if c[2] in "wc" else F.sum(c).cast("decimal(38,0)").alias(c) for c in names]
        return self._totals(old.select(*change.columns).unionByName(change), kept).filter("__w > 0")

    def values(self, slim: DataFrame, a: str) -> DataFrame:
        at = slim.select(*(F.col(q(n)) for n in self.keys), F.col(f"__a{self._at(a)}").alias("__v"), F.col(DIFF)).filter(F.col("__v").isNotNull())
        return consolidated(at, signed=True)

    def ends(self, values: DataFrame, a: str) -> DataFrame:
        i = self._at(a)
        return self._totals(values, [F.min("__v").alias(f"__lo{i}"), F.max("__v").alias(f"__hi{i}")])

    def rendered(self, acc: DataFrame, ends: list[DataFrame]) -> DataFrame:
        """The rows that the aggregate gives for these groups."""
        out = acc
        for n, end in enumerate(ends):
            e = end.select(*(F.col(q(k)).alias(f"__j{i}") for i, k in enumerate(self.keys)), *(c for c in end.columns if c not in self.keys))
            on = F.lit(True)
            for i, k in enumerate(self.keys):
                on = on & F.col(q(k)).eqNullSafe(F.col(f"__j{i}"))
            out = out.join(e, on, "left").drop(*(f"__j{i}" for i in range(len(self.keys))))
        cols = [F.col(q(k)) for k in self.keys]
        for c in self.calls:
            i = None if c.argument is None else self._at(c.argument)
            if c.function == "count_star":
                x = F.col("__w")
            elif c.function == "count":
                x = F.col(f"__c{i}")
            elif c.function in ("min", "max"):
                x = F.col(f"__{'lo' if c.function == 'min' else 'hi'}{i}")
            elif c.function == "sum":
                t = self.types[c.argument]
                x = F.when(F.col(f"__c{i}") > 0, F.col(f"__s{i}").cast(UINT64 if t == UINT64 else T.LongType()))
            else:
                x = F.when(F.col(f"__c{i}") > 0, F.col(f"__s{i}").cast("double") / F.col(f"__c{i}").cast("double"))
            cols.append(x.alias(c.name))
        return out.select(*cols)
