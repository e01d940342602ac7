"""Line dedup (operator 9): site-relative frequency, with DataFrame functions only.

The lines of a page are what its block tags and line ends separate, without tags, trimmed; blank
ones are none. Within a host, the pages that contain a line are divided by the pages of the host; a
line above RATIO is boilerplate of that host and dropped from all its pages. Hosts of fewer than
LEAST_PAGES pages keep all.

Counting: a page counts a line once; (host, line) counts are pre-aggregated before the shuffle, so a
host with a third of all pages, or a line on all of them, is no hot key. The boilerplate of a host is
at most (lines per page / RATIO) hashes, so it is kept as one array; pages are joined with it on
(host, salt), the salt from the page's id.

Lines are known by 64-bit hashes, which are not verified: two lines of a host share one with a chance
of 3e-8 among a million.

Null url: the host ''. Null or empty html: no lines. Very long pages are split whole, in their row.
Null page_ids and repeated rows are pages of their own; a line at exactly the ratio stays. An empty
table gives an empty result. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATIO = 0.5
LEAST_PAGES = 4
SALTS = 64

#: Tags that end a line. Scripts, styles and comments are no text.
BLOCK = "address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|li|main|nav|ol|p|pre|section|table|title|tr|ul"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
BREAK = rf"(?i)</?(?:{BLOCK})(?:[\s/][^>]*)?>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines_of(html: str) -> F.Column:
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), HIDDEN, ""), BREAK, "\n"), TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f\v"))), lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """For each host with boilerplate: drop, the hashes of its lines. pages: host and lines."""
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"))
    seen = pages.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
    seen = seen.groupBy("host", "line").agg(F.count("*").alias("with_line")).filter(F.col("with_line") >= least_pages * ratio)
    often = seen.join(hosts, "host").filter((F.col("pages") >= least_pages) & (F.col("with_line") > ratio * F.col("pages")))
    return often.groupBy("host").agg(F.collect_list("line").alias("drop"))


def without_boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Per page: page_id, host, n_lines, kept (the lines that stay, in order)."""
    cut = pages.select("page_id", host_of("url").alias("host"), lines_of("html").alias("lines"))
    drop = boilerplate(cut, ratio, least_pages)
    salted = drop.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("page_id", F.size("lines")), F.lit(SALTS)).cast("int"))
    out = cut.join(salted, ["host", "salt"], "left")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), F.xxhash64(x))))
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))


def line_report(pages: DataFrame) -> DataFrame:
    """Per page: page_id, host, n_lines, n_dropped, kept_sha256 of the kept lines joined by \\n."""
    out = without_boilerplate(pages)
    return out.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), F.sha2(F.concat_ws("\n", "kept"), 256).alias("kept_sha256"))


#: The same in SQL, on the lines themselves.
SQL = rf"""
WITH p AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host,
         list_filter(list_transform(string_split(
           regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', '', 'g'), '{BREAK}', chr(10), 'g'), '{TAG}', '', 'g'), chr(10)),
           lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11))), lambda x: x <> '') AS lines
  FROM pages),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
l AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY ALL),
b AS (SELECT host, list(line) AS cut FROM l JOIN h USING (host) WHERE pages >= {LEAST_PAGES} AND n > {RATIO} * pages GROUP BY host),
k AS (SELECT page_id, host, lines, CASE WHEN cut IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(cut, x)) END AS kept FROM p LEFT JOIN b USING (host))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
"""
