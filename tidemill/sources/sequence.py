"""Generated sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import UINT64, UINT64_MAX


def sequence(spark: SparkSession, start: int = 0, count: int | None = None) -> DataFrame:
    """`value` UInt64 from start on, count rows or up to the largest value, generated in parallel."""
    if not 0 <= start <= UINT64_MAX:
        raise ValueError("a sequence starts between 0 and 2 ** 64 - 1")
    left = UINT64_MAX - start + 1
    n = left if count is None else min(count, left)
    if n >= 1 << 63:
        raise ValueError("an unbounded sequence needs a count for each batch")
    return spark.range(n).select((F.lit(str(start)).cast(UINT64) + F.col("id")).cast(UINT64).alias("value"))
