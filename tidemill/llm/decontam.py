"""Benchmark decontamination (operator 1): spaced-seed hashing, with DataFrame functions only.

Words are lower-cased (A-Z). A mask looks at six
positions of a short span and ignores those between. For each mask the hashes of all placements in benchmark items are joined with those of all placements in
documents; a hit fixes how the item lies along the document. Around the hit all windows of WINDOW
words of that alignment are compared word by word, and one with at most SLACK differing words is an
overlap. The two masks are such that any WINDOW words with up to SLACK substitutions hold a clean
placement of one of them: within that tolerance no overlap is missed. Items of fewer than WINDOW
words are one window: with at most one substitution from LEAST words on, and with none below. An
item that is shorter than the masks is looked for by one hash of all its words.

Seeds are broadcast as (seed, position, item, its length), the items' words are joined with the hits only. A benchmark of
at most BLOCK seeds (about 40 MB) is broadcast, and documents are streamed against it, only hits are
shuffled. Beyond that, seeds and positions are shuffled and joined, and the hits with the documents.

A document is known by (doc_id, hash of its text): repeated rows share a verdict. Items with the same
words are compared once and reported each by its item_id; texts that share an id are compared one by
one. Null, empty or very short texts hold what fits in them; very long ones are handled position by
position. Null items are ignored. Ties of windows count once: matched is the largest. An empty
benchmark contaminates nothing, empty documents give no rows. Other columns are passed on, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh
from .words import WORD

#: Looked-at positions of each mask.
MASKS = ((0, 1, 4, 6, 7, 8), (0, 1, 2, 4, 5, 6))
WINDOW, SLACK = 13, 2
#: From so many words on an item that is shorter than WINDOW may have one substitution.
LEAST, SHORT_SLACK = 10, 1
#: Seeds that are broadcast.
BLOCK = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hashed(text: str) -> F.Column:
    """The hashes of a text's words."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, masks: list[tuple[int, ...]], *keep: str) -> DataFrame:
    """For each position `at` of the word hashes h and each mask that fits there: the seed, a hash
    of the words that the mask looks at (and of the mask)."""
    span = min(m[-1] for m in masks)
    at = df.select(*keep, "h", F.explode(F.when(F.size("h") > span, F.sequence(F.lit(0), F.size("h") - (span + 1)))).alias("at"))
    one = lambda k, m: F.when(F.col("at") + m[-1] < F.size("h"), F.xxhash64(F.lit(k), *(F.get("h", F.col("at") + o) for o in m)))
    return at.select(*keep, "h", "at", F.explode(F.array(*(one(k, m) for k, m in enumerate(masks)))).alias("seed")).filter("seed IS NOT NULL")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document (doc_id, th: its text's hash) and item that overlap: matched, the most equal
    words of a window."""
    items = benchmark.select("item_id", _hashed("text").alias("ih")).filter(F.size("ih") > 0)
    items = items.withColumn("item", F.xxhash64("ih"))
    texts = items.select("item", F.col("ih").alias("h"), F.size("ih").alias("il")).dropDuplicates(["item"])
    span = MASKS[1][-1]
    lengths = sorted(r["il"] for r in texts.filter(F.col("il") <= span).select("il").distinct().collect())  # at most `span`
    masks = [*MASKS, *(tuple(range(n)) for n in lengths)]
    seeds = _seeds(texts.filter(F.col("il") > span), masks[:2], "item", "il")
    for n in lengths:
        whole = F.xxhash64(F.lit(masks.index(tuple(range(n)))), *(F.get("h", F.lit(o)) for o in range(n)))
        seeds = seeds.unionByName(texts.filter(F.col("il") == n).select("item", "il", "h", F.lit(0).alias("at"), whole.alias("seed")))
    seeds = seeds.select("seed", F.col("at").alias("iat"), "item", "il")
    th = F.xxhash64("text").alias("th")
    placed = _seeds(docs.select("doc_id", th, _hashed("text").alias("h")), masks, "doc_id", "th")
    # dh starts at the item's first word, or the document's if the item reaches before it
    skip = (F.col("iat") - F.col("at")).alias("skip")
    along = lambda skip: F.slice("h", F.greatest(-skip, F.lit(0)) + 1, F.col("il"))
    key = ["doc_id", "th", "item", "il", "skip"]
    # no lambdas up to the aggregate: they would end the generated stage between the positions and
    # the join, and a stage's end holds all rows of a document, each with its array
    if seeds.count() <= BLOCK:
        found = placed.join(F.broadcast(seeds), "seed").select("doc_id", "th", "item", "il", skip, along(F.col("iat") - F.col("at")).alias("dh"))
        hit = found.groupBy(*key).agg(F.first("dh").alias("dh"))
    else:
        found = placed.select("doc_id", "th", "at", "seed").join(seeds, "seed").select("doc_id", "th", "item", "il", skip).distinct()
        text = docs.select(F.col("doc_id").alias("__id"), th.alias("__th"), _hashed("text").alias("h")).dropDuplicates(["__id", "__th"])
        hit = found.join(text, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))).select(*key, along(F.col("skip")).alias("dh"))
    hit = hit.join(texts.select("item", F.col("h").alias("ih")), "item")
    skip = F.greatest("skip", F.lit(0))
    same = F.transform(F.col("ih"), lambda x, i: F.when(F.get("dh", F.when(i >= skip, i - skip)) == x, 1).otherwise(0))
    hit = hit.select("doc_id", "th", "item", same.alias("same"), F.least(F.size("ih"), F.lit(WINDOW)).alias("w"))
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("w") + 1), lambda s: F.aggregate(F.slice("same", s, F.col("w")), F.lit(0), lambda a, x: a + x))
    hit = hit.select("doc_id", "th", "item", F.array_max(sums).alias("matched"), "w")
    hit = hit.filter(F.col("matched") >= F.col("w") - F.when(F.col("w") < LEAST, 0).when(F.col("w") < WINDOW, SHORT_SLACK).otherwise(SLACK))
    hit = hit.groupBy("doc_id", "th", "item").agg(F.max("matched").alias("matched"))
    return hit.join(items.select("item", "item_id"), "item").groupBy("doc_id", "th", "item_id").agg(F.max("matched").alias("matched"))


def _by_document(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = overlaps(docs, benchmark).groupBy("doc_id", "th")
    return found.agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("matched").alias("matched"), F.count("*").alias("n_items"))


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_items that overlap, their item_ids, matched (most equal words in a
    window, 0 without an overlap), contaminated."""
    found = _by_document(docs, benchmark).withColumnRenamed("doc_id", "__id")
    slim = docs.select("doc_id", F.xxhash64("text").alias("th"))
    out = slim.join(found, slim["doc_id"].eqNullSafe(found["__id"]) & (slim["th"] == found["th"]), "left")
    return out.select(
        slim["doc_id"], F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.concat_ws(",", F.transform("item_ids", lambda x: x.cast("string"))).alias("item_ids"),
        F.coalesce("matched", F.lit(0)).cast("long").alias("matched"), F.col("n_items").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without an overlap, with their own columns."""
    known, th = fresh(docs, "__id"), fresh(docs, "__th")
    found = overlaps(docs, benchmark).select(F.col("doc_id").alias(known), F.col("th").alias(th)).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col(known)) & (F.xxhash64(docs["text"]) == F.col(th)), "left_anti")


def _key(mask: tuple[int, ...], k: int) -> str:
    return f"'{k}:' || " + " || ' ' || ".join(f"h[p + {o}]" for o in mask)


#: The same in SQL, on the words themselves.
SQL = rf"""
WITH d AS (SELECT doc_id, md5(text) AS th, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS h FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS h FROM benchmark),
ip AS (SELECT item_id, h, unnest(range(1, len(h) + 1)) AS p FROM i WHERE len(h) > {MASKS[1][-1]}),
dp AS (SELECT doc_id, th, h, unnest(range(1, len(h) + 1)) AS p FROM (SELECT DISTINCT * FROM d)),
ik AS (SELECT item_id, h, p, unnest([{", ".join(_key(m, k) for k, m in enumerate(MASKS))}]) AS k FROM ip),
dk AS (SELECT doc_id, th, h, p, unnest([{", ".join(_key(m, k) for k, m in enumerate(MASKS))}]) AS k FROM dp),
short AS (SELECT item_id, h, len(h) AS n FROM i WHERE len(h) BETWEEN 1 AND {MASKS[1][-1]}),
hit AS (
  SELECT DISTINCT dk.doc_id, dk.th, dk.h AS dh, ik.item_id, ik.h AS ih, dk.p - ik.p AS diag FROM dk JOIN ik ON dk.k = ik.k
  UNION SELECT dp.doc_id, dp.th, dp.h, short.item_id, short.h, dp.p - 1 FROM dp JOIN short ON dp.h[dp.p : dp.p + short.n - 1] = short.h),
eq AS (
  SELECT doc_id, th, item_id, least(len(ih), {WINDOW}) AS w,
         list_transform(range(1, len(ih) + 1), lambda x: CASE WHEN x + diag >= 1 AND dh[x + diag] = ih[x] THEN 1 ELSE 0 END) AS same FROM hit),
best AS (
  SELECT doc_id, th, item_id, w, list_max(list_transform(range(1, len(same) - w + 2), lambda s: list_sum(same[s:s + w - 1]))) AS matched FROM eq),
f AS (
  SELECT doc_id, th, item_id, max(matched) AS matched FROM best
  WHERE matched >= w - CASE WHEN w < {LEAST} THEN 0 WHEN w < {WINDOW} THEN {SHORT_SLACK} ELSE {SLACK} END GROUP BY ALL),
g AS (SELECT doc_id, th, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids, max(matched) AS matched FROM f GROUP BY ALL)
SELECT d.doc_id, coalesce(g.n_items, 0)::BIGINT AS n_items, coalesce(g.item_ids, '') AS item_ids, coalesce(g.matched, 0)::BIGINT AS matched, g.n_items IS NOT NULL AS contaminated
FROM d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.th = g.th
"""
