"""Mixing sources to target weights (operator 7): systematic sampling, with DataFrame functions only.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and share the words of
all documents; no target exceeds 3 times its source's words, and what is above that is reshared by
weight. That is water filling: sorted by (3 * words / weight) the capped sources are a prefix.

Sampling: a document of a source is expected target / words times (at most 3 times). The documents
of a source stand in the order of size and doc_id (null last); the prefix sum of the expected copies plus one offset
of the source crosses integers, and a document is taken once for each that it crosses. By size, so
that words taken differ from the target by no more than about the largest documents.

Prefix sums in two levels, so that a source with a third of all rows is no single task: documents
are counted in buckets of (source, size), those of many documents cut into ranges of the id; the
buckets' counts are summed within the source, and documents only within their bucket. The order, and
so what is taken, doesn't depend on the buckets.

Null text: no words, target share 0 words. Null source: a source of its own, the last. Repeated
rows are documents of their own; null doc_ids come last among equal sizes, ties of both by a hash of
the text. Empty and very long texts count their words like any. An empty table gives an empty result.
Other columns are passed on as one struct, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import kept
from .words import WORD

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A target's most, as a multiple of its source's words.
MOST = 3
#: Documents in a bucket, about.
BUCKET = 4_000


def _unit(key) -> F.Column:
    """A number in [0, 1) from a string."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def source_targets(sized: DataFrame) -> DataFrame:
    """For each source (s, none): words, target, expected copies of a document, offset."""
    w = Window.orderBy("none", "s")
    src = sized.groupBy("s", "none").agg(F.sum("size").alias("words"))
    place = (F.row_number().over(w) - 1) % len(WEIGHTS)
    src = src.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in WEIGHTS)), (place + 1).cast("int")))
    src = src.withColumn("cap", F.col("words").cast("double") * MOST)
    up = Window.orderBy(F.col("cap") / F.col("weight"), "none", "s")
    src = src.select(
        "*",
        F.sum("words").over(Window.partitionBy()).cast("double").alias("all"),
        F.sum("weight").over(Window.partitionBy()).alias("weights"),
        F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("weight_before"),
    )
    level = (F.col("all") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    # the level if all before a source are capped and it is not: greatest where that holds first
    src = src.withColumn("level", F.when(F.col("cap") >= level * F.col("weight"), level))
    src = src.withColumn("level", F.max("level").over(Window.partitionBy()))
    src = src.withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))))
    return src.select(
        "s", "none", "words", "target",
        F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0).alias("rate"),
        _unit(F.concat(F.lit("mix:"), F.col("none").cast("string"), F.col("s"))).alias("offset"),
    )


def copies(docs: DataFrame, keep: list[str], bucket: int = BUCKET) -> DataFrame:
    """For each row of docs (doc_id, source, text and the columns `keep`): size, words and target of
    its source, and how often it is taken."""
    sized = docs.select(
        *keep,
        F.col("doc_id").alias("__id"), F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("__tie"),
    )
    # sizes are worked out once for all counts, and once more with rows that are too large to keep
    if keep == ["doc_id"]:
        sized = slim = kept(sized)
    else:
        slim = kept(sized.select("__id", "s", "none", "size", "__tie"))
    # bounds of the ids in the (source, size) groups that are too large for a bucket
    group = ["s", "none", "size"]
    groups = slim.groupBy(*group).agg(F.count("*").alias("in_group"))
    cuts = -(-(groups.agg(F.max("in_group")).first()[0] or 1) // bucket)
    if cuts > 1:
        large = groups.filter(F.col("in_group") > bucket).select(*group)
        at = F.percentile_approx("__id", [k / cuts for k in range(1, cuts)], max(10_000, 10 * cuts))
        large = slim.join(F.broadcast(large), group).groupBy(*group).agg(at.alias("bounds"))
        below = F.size(F.filter(F.coalesce("bounds", F.array().cast("array<bigint>")), lambda x: x < F.col("__id")))
        # rows without an id stand last, in any order
        part = F.when(F.col("__id").isNull(), cuts + F.pmod("__tie", F.lit(cuts))).otherwise(below)
        deal = lambda d: d.join(F.broadcast(large), group, "left").withColumn("part", part.cast("long")).drop("bounds")
    else:
        deal = lambda d: d.withColumn("part", F.lit(0).cast("long"))
    sized, slim = deal(sized), deal(slim)
    key = [*group, "part"]
    offsets = slim.groupBy(*key).agg(F.count("*").alias("in_bucket"))
    before = Window.partitionBy("s", "none").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    offsets = offsets.join(source_targets(slim), ["s", "none"]).drop("in_bucket")
    ranked = sized.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("__id").asc_nulls_last(), "__tie")))
    out = ranked.join(offsets, key)
    place = F.col("before") + F.col("at")
    crossed = lambda x: F.floor(F.col("rate") * x + F.col("offset"))
    return out.withColumn("__copies", crossed(place) - crossed(place - 1))


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target of its source, taken words."""
    out = copies(docs.select("doc_id", "source", "text"), ["doc_id"])
    return out.select("doc_id", "size", F.col("words").alias("source_size"), "target", (F.col("__copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: none, once or several times each, with their columns."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    out = copies(docs.select("doc_id", "source", "text", row), ["__row"])
    return out.filter("__copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__i")).select("__row.*")


#: The same in SQL.
SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS none,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
src AS (SELECT s, none, sum(size)::BIGINT AS words FROM sized GROUP BY ALL),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY none, s) - 1) % 3]::DOUBLE AS weight, 3.0::DOUBLE * words AS cap FROM src),
levels AS (
  SELECT *, (sum(words) OVER () - coalesce(sum(cap) OVER up, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS lv
  FROM weighed WINDOW up AS (ORDER BY cap / weight, none, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT s, none, words, least(cap, coalesce((SELECT max(lv) FROM levels WHERE cap >= lv * weight) * weight, cap))::DOUBLE AS target,
         ('0x' || substr(md5('mix:' || none::VARCHAR || s), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM levels),
ranked AS (
  SELECT d.doc_id, d.size, t.words, t.target, t.u, CASE WHEN t.words > 0 THEN t.target / t.words ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.s, d.none ORDER BY d.size, d.doc_id) AS pos
  FROM sized d JOIN targets t ON d.s = t.s AND d.none = t.none)
SELECT doc_id, size::BIGINT AS size, words::BIGINT AS source_size, target,
       ((floor(rate * pos + u) - floor(rate * (pos - 1) + u)) * size)::BIGINT AS taken
FROM ranked
"""
