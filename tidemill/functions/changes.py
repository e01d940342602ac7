"""Weighted rows: a relation is a DataFrame whose column __diff counts the copies of each row, and a
change one whose __diff may be negative. A DataFrame without __diff has one copy of each row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .types import DIFF, ORD, is_float


#: Copies of a row before a change.
WAS = "__was"


def q(name: str) -> str:
    """A column name as one identifier, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def data(df: DataFrame) -> list[str]:
    """The columns that are no technical ones."""
    return [c for c in df.columns if c not in (DIFF, ORD)]


def weighted(df: DataFrame) -> bool:
    return DIFF in df.columns


def with_diff(df: DataFrame) -> DataFrame:
    return df if weighted(df) else df.withColumn(DIFF, F.lit(1).cast("long"))


def _identity(df: DataFrame, c: str) -> Column:
    """A grouping key under which floats agree only if they print alike, so that zeros of either sign
    are two values."""
    t = df.schema[c].dataType
    return F.to_json(F.struct(F.col(q(c)))) if is_float(t) and not isinstance(t, (T.FloatType, T.DoubleType)) else F.col(q(c)).cast("string") if is_float(t) else F.col(q(c))


def _summed(df: DataFrame, cols: list[str], sums: list[str]) -> DataFrame:
    """One row for each distinct row of cols, with the sums of others."""
    floats = [c for c in cols if is_float(df.schema[c].dataType)]
    totals = [F.sum(s).alias(s) for s in sums]
    if not floats:
        return df.groupBy(*(F.col(q(c)) for c in cols)).agg(*totals)
    keys = [_identity(df, c).alias(f"__g{i}") for i, c in enumerate(cols)]
    firsts = [F.first(F.col(q(c))).alias(c) for c in cols]
    return df.groupBy(*keys).agg(*firsts, *totals).select(*(F.col(q(c)) for c in cols), *sums)


def consolidated(df: DataFrame, what: str = "relation", signed: bool = False) -> DataFrame:
    """One row for each distinct row, with its summed weight, and none for a weight of 0. Unless
    signed, a negative weight is an error: a row was retracted that is not there."""
    df = with_diff(df)
    out = _summed(df, data(df), [DIFF])
    if not signed:
        out = out.withColumn(DIFF, nonnegative(F.col(DIFF), what))
    return out.filter(F.col(DIFF) != 0)


def versions(before: DataFrame, change: DataFrame, what: str = "relation") -> DataFrame:
    """The distinct rows of a relation before or after a change: __was and __diff count their copies."""
    both = before.withColumn(WAS, F.col(DIFF)).unionByName(change.withColumn(WAS, F.lit(0).cast("long")))
    out = _summed(both, data(before), [DIFF, WAS])
    return out.withColumn(DIFF, nonnegative(F.col(DIFF), what)).filter((F.col(DIFF) != 0) | (F.col(WAS) != 0))


def nonnegative(w: Column, what: str) -> Column:
    """w, or an error where it is negative."""
    return F.when(w < 0, F.raise_error(F.lit(f"{what}: a row was retracted more often than it was there")).cast("long")).otherwise(w)


def expanded(df: DataFrame) -> DataFrame:
    """The copies of weighted rows as rows."""
    cols = data(df)
    return df.select(*(F.col(q(c)) for c in cols), F.explode(F.sequence(F.lit(1), F.col(DIFF).cast("int"))).alias("__copy")).drop("__copy")


def negated(df: DataFrame) -> DataFrame:
    return df.withColumn(DIFF, -F.col(DIFF))


def difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """The change that turns old into new."""
    return consolidated(new.unionByName(negated(old)), signed=True)


def folded(changes: list[DataFrame]) -> DataFrame:
    """The relation that a list of changes builds up."""
    return consolidated(reduce(DataFrame.unionByName, (c.drop(ORD) for c in changes)))


def prefix_checked(df: DataFrame, what: str = "change") -> DataFrame:
    """df (with __diff and __ord), with an error if a row's copies fall below 0 at any event: order is
    part of a change. Rows of one value are summed in order; other values are independent."""
    cols = [F.col(q(c)) for c in data(df)]
    w = Window.partitionBy(*cols).orderBy(ORD).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__sum", nonnegative(F.sum(DIFF).over(w), what)).filter(F.col("__sum") >= 0).drop("__sum")


class ChangeError(ValueError):
    """A change breaks the rules of the data model."""


def valid_change(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """df, with errors for a null or zero __diff, and for other columns than schema's."""
    if not weighted(df):
        raise ChangeError("a change needs __diff")
    if schema is not None and [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in df.schema if f.name not in (DIFF, ORD)]:
        raise ChangeError("the change has other columns than its relation")
    bad = F.col(DIFF).isNull() | (F.col(DIFF) == 0)
    return df.withColumn(DIFF, F.when(bad, F.raise_error(F.lit("__diff is null or 0")).cast("long")).otherwise(F.col(DIFF)))
