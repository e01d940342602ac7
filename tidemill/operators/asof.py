"""ASOF join: for each left row the nearest right row in order, among those with equal keys.

The right side is reduced to one candidate for each (keys, order); both sides are put in one sequence,
and a window carries the last candidate along. So there is no range join, and no pair that isn't a
result. Long sequences (no keys, or few) are cut into ranges of the order: windows run within ranges,
and each range starts from the last candidate before it, found among one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.changes import data, q, weighted
from ..functions.types import DIFF, indexable
from .relational import OperatorError

#: Comparison of left with right, to (backward, the right row may have the same order).
DIRECTIONS = {">=": (True, True), ">": (True, False), "<=": (False, True), "<": (False, False)}


def validate(left: DataFrame, right: DataFrame, op: str, order: tuple[str, str], keys: list[tuple[str, str]]) -> None:
    if op not in DIRECTIONS:
        raise OperatorError(f"an ASOF condition can't be {op}")
    for a, b in [*keys, order]:
        x, y = left.select(F.expr(a).alias("x")).schema["x"].dataType, right.select(F.expr(b).alias("x")).schema["x"].dataType
        if x != y or not indexable(x):
            raise OperatorError(f"{a} and {b} can't be compared in an ASOF join: {x.simpleString()} and {y.simpleString()}")


def _number(c: Column, t: T.DataType) -> Column | None:
    """An order as a double, for finding ranges; None for types that have none."""
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp").cast("double")
    if isinstance(t, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    return c.cast("double") if isinstance(t, T.NumericType) else None


def asof_join(left: DataFrame, right: DataFrame, op: str, order: tuple[str, str], keys: list[tuple[str, str]], names: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """All left rows with the columns of their right row, or NULLs. Copies of a right row are one;
    different rows of the same keys and order are an error where they would be chosen. NULL keys and
    orders match nothing. `ranges`: pieces of a sequence; by default 1 with keys, and without keys as
    many as there are shuffle partitions."""
    validate(left, right, op, order, keys)
    spark = left.sparkSession
    backward, inclusive = DIRECTIONS[op]
    lcols, rcols = data(left), data(right)
    k = [f"__k{i}" for i in range(len(keys))]
    lrow = left.select(F.struct(*(F.col(q(c)).alias(f"c{i}") for i, c in enumerate(lcols)), *([F.col(DIFF)] if weighted(left) else [])).alias("__left"), *(F.expr(a).alias(n) for n, (a, _) in zip(k, keys, strict=True)), F.expr(order[0]).alias("__o"))
    rrow = right.filter(F.col(DIFF) > 0) if weighted(right) else right
    rrow = rrow.select(F.struct(*(F.col(q(c)).alias(f"c{i}") for i, c in enumerate(rcols))).alias("r"), *(F.expr(b).alias(n) for n, (_, b) in zip(k, keys, strict=True)), F.expr(order[1]).alias("__o"))
    known = F.col("__o").isNotNull()
    for n in k:
        known = known & F.col(n).isNotNull()
    rtype = rrow.schema["r"].dataType
    one = rrow.filter(known).groupBy(*k, "__o").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    one = one.select(*k, "__o", F.struct(F.col("lo").alias("r"), (F.col("lo") != F.col("hi")).alias("tie")).alias("__right"))
    if ranges is None:
        ranges = 1 if keys else int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = _number(F.col("__o"), one.schema["__o"].dataType)
    bounds: list[float] = []
    if ranges > 1 and number is not None:
        bounds = sorted(set(one.select(number.alias("x")).approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
    # a right row stands before the left rows of its order if it may be chosen by them
    side = (0 if inclusive else 2)
    seq = lrow.filter(known).select(*k, "__o", "__left", F.lit(None).cast(one.schema["__right"].dataType).alias("__right"), F.lit(1).alias("__s"))
    seq = seq.unionByName(one.select(*k, "__o", F.lit(None).cast(lrow.schema["__left"].dataType).alias("__left"), "__right", F.lit(side).alias("__s")))
    way = (lambda c: F.col(c).asc()) if backward else (lambda c: F.col(c).desc())
    if bounds:
        piece = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < number)).cast("int")
        seq = seq.withColumn("__p", piece)
    part = [*k, "__p"] if bounds else k
    w = Window.partitionBy(*part).orderBy(way("__o"), F.col("__s").asc()).rowsBetween(Window.unboundedPreceding, 0)
    met = seq.withColumn("__right", F.last("__right", ignorenulls=True).over(w)).filter(F.col("__left").isNotNull())
    if bounds:
        number = _number(F.col("__o"), one.schema["__o"].dataType)
        pick = F.max_by if backward else F.min_by
        edge = one.withColumn("__p", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < number)).cast("int")).groupBy(*part).agg(pick("__right", "__o").alias("__edge"))
        every = edge.select(*k).distinct().withColumn("__p", F.explode(F.array(*map(F.lit, range(len(bounds) + 1))))) if k else spark.range(len(bounds) + 1).select(F.col("id").cast("int").alias("__p"))
        before = Window.partitionBy(*k).orderBy(way("__p")).rowsBetween(Window.unboundedPreceding, -1)
        carried = every.join(edge, part, "left").withColumn("__edge", F.last("__edge", ignorenulls=True).over(before))
        met = met.join(carried, part, "left").withColumn("__right", F.coalesce("__right", "__edge"))
    chosen = F.when(F.col("__right.tie"), F.raise_error(F.lit("ASOF join: several right rows at the chosen order")).cast(rtype)).otherwise(F.col("__right.r"))
    met = met.select("__left", chosen.alias("r"))
    out = met.unionByName(lrow.filter(~F.coalesce(known, F.lit(False))).select("__left", F.lit(None).cast(rtype).alias("r")))
    names = names or [*lcols, *rcols]
    if len(names) != len(lcols) + len(rcols) or len(set(names)) != len(names):
        raise OperatorError("output names repeat or don't fit")
    cols = [F.col(f"__left.c{i}") for i in range(len(lcols))] + [F.col(f"r.c{i}") for i in range(len(rcols))]
    return out.select(*(c.alias(n) for c, n in zip(cols, names, strict=True)), *([F.col(f"__left.{DIFF}").alias(DIFF)] if weighted(left) else []))
