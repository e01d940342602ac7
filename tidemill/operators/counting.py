"""Running event count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import checkpointed


def running_event_count(df: DataFrame, order: list[str], start: int = 0, name: str = "event_count") -> DataFrame:
    """The total after each event, one row an event whatever its weight: start + 1, start + 2, ...

    Events are sorted in ranges; a range counts its own, and starts from the sum of those before it,
    so that no task sees all events."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = df.select(*order).repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id())
    cut = cut.sortWithinPartitions(*order).withColumn("__i", F.monotonically_increasing_id() % F.lit(1 << 33))
    cut = checkpointed(cut.select("__p", "__i"))  # ranges are found by sampling: both uses must see the same
    sizes = cut.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    total = F.col("__before").cast("decimal(20,0)") + F.col("__i") + 1 + F.lit(start)  # narrowed with an error
    fits = F.when(total > (1 << 63) - 1, F.raise_error(F.lit("event count: more events than 64 bits count")).cast("long")).otherwise(total.cast("long"))
    return cut.join(before, "__p").select(fits.alias(name))
