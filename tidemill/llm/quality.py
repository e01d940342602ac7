"""Quality rules (operator 10): suffix-array repetition.

For each text a suffix array over its words is built by prefix doubling, for a whole chunk of
texts at once: ranks are salted by text, and only suffixes that still tie are sorted again. Longest
common prefixes of neighbours come from the saved ranks by binary lifting. The LCP intervals give
the maximal repeated substrings; the union of their spans and the longest of them are limited.

Nulls and empty texts have no words and fail the base rule. A very long text is a chunk of its own,
with arrays of about 30 times its bytes. Null doc_ids and repeated rows are judged one by one; ties
among repeats are all counted. An empty table gives an empty result. Other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, lean
from .words import Chunk, chunks, covered, hash_words, mix

#: Repeats shorter than this many words don't count towards the covered fraction.
MIN_REPEAT = 6
#: Largest covered fraction, and longest repeat in words, of a text that stays.
MAX_COVERED, MAX_LONGEST = 0.3, 64
#: Base rule: fewest words, and most words in repeated 3-word windows in percent.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SYMBOL = np.zeros(256, np.int64)
SYMBOL[list(b"#*$%&|<>")] = 1

VERDICT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField("n_covered", T.LongType()), T.StructField("longest_repeat", T.LongType()), T.StructField("n_repeats", T.LongType())]
)


def longest_repeats(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word the length in words of the longest string that starts there and also starts
    elsewhere in the same text: the greater LCP with its neighbours in the suffix array."""
    n = len(h)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    end = np.searchsorted(doc, doc, side="right") if n < 4096 else np.repeat(np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1, np.diff(np.concatenate([[0], np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1])))
    key = mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    sa = np.argsort(key, kind="stable")
    sk = key[sa]
    rank = np.empty(n, np.int64)
    heads = np.flatnonzero(np.append(True, sk[1:] != sk[:-1]))
    sizes = np.diff(np.append(heads, n))
    rank[sa] = np.repeat(heads, sizes)
    levels, step = [rank], 1
    tied = np.repeat(sizes > 1, sizes)  # by place in sa
    first = tied.copy()
    while tied.any():
        at = np.flatnonzero(tied)
        pos = sa[at]
        nxt = pos + step
        second = np.where(nxt < end[pos], rank[np.minimum(nxt, n - 1)] + 1, 0)
        k = rank[pos] * (n + 1) + second
        o = np.argsort(k, kind="stable")
        pos, k = pos[o], k[o]
        sa[at] = pos  # a group keeps its places, as its rank leads the key
        new = np.append(True, k[1:] != k[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(k)))
        rank = rank.copy()
        rank[pos] = np.repeat(at[heads], sizes)
        levels.append(rank)
        tied = np.zeros(n, bool)
        tied[at] = np.repeat(sizes > 1, sizes)
        step *= 2
    same = np.flatnonzero(first[1:] & first[:-1] & (levels[0][sa[1:]] == levels[0][sa[:-1]]))
    a, b = sa[same], sa[same + 1]
    lcp = np.zeros(len(a), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        ok = (x < end[a]) & (y < end[b])
        ok[ok] = levels[j][x[ok]] == levels[j][y[ok]]
        lcp[ok] += 1 << j
    np.maximum.at(longest, a, lcp)
    np.maximum.at(longest, b, lcp)
    return longest


def maximal_repeats(longest: np.ndarray, doc: np.ndarray, least: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each occurrence of a repeat that can't be extended to either side."""
    grown = np.zeros(len(longest), bool)
    grown[1:] = (longest[:-1] == longest[1:] + 1) & (doc[:-1] == doc[1:])
    at = np.flatnonzero((longest >= least) & ~grown)
    return at, longest[at]


def judged(c: Chunk) -> dict[str, np.ndarray]:
    """The verdict's columns for each text of a chunk."""
    per = lambda x, m: np.add.reduceat(np.append(x, 0), np.minimum(m[:-1], len(x))) * (m[1:] > m[:-1])
    wb = c.word_bounds()
    n_words = np.diff(wb)
    letters = ((c.data & 0xC0) != 0x80) & ~np.isin(c.data, np.array([0x20, *range(0x09, 0x0E)], np.uint8))
    out = {"n_words": n_words, "word_chars": per(letters.astype(np.int64), c.offsets), "n_symbols": per(SYMBOL[c.data], c.offsets)}
    raw, dup = c.data.tobytes(), np.zeros(c.n, np.int64)
    for i, (a, b) in enumerate(zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), strict=True)):
        lines = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
        dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    longest = longest_repeats(hash_words(c), c.doc)
    n = len(longest)
    at = np.flatnonzero(longest >= 3)
    out["n_repeat_words"] = per(covered(n, at, at + 3).astype(np.int64), wb)
    at, size = maximal_repeats(longest, c.doc)
    out["n_covered"] = per(covered(n, at, at + size).astype(np.int64), wb)
    out["n_repeats"] = np.bincount(c.doc[at], minlength=c.n) if n else np.zeros(c.n, np.int64)
    top = np.zeros(c.n, np.int64)
    np.maximum.at(top, c.doc, longest)
    out["longest_repeat"] = top
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n_words)
    out["kept"] = ~out["base_failed"] & (out["n_covered"] <= MAX_COVERED * n_words) & (top <= MAX_LONGEST)
    return out


def _judge(text_col: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judged(c) for c in chunks(b.column(text_col))]
            cols = {f.name: np.concatenate([g[f.name] for g in got]) if got else np.zeros(0) for f in VERDICT}
            arrays = [pa.array(cols[f.name], pa.bool_() if f.dataType == T.BooleanType() else pa.int64()) for f in VERDICT]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(arrays, VERDICT.names)], [*b.schema.names, name])

    return run


def judge(docs: DataFrame, text: str = "text", name: str = "__quality") -> DataFrame:
    """docs with a struct column of this name, the verdict on each text. One narrow pass over the
    rows: no shuffle; memory is bounded by one Arrow batch and the arrays of one chunk."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, VERDICT)])
    return lean(docs).mapInArrow(_judge(docs.columns.index(text), name), schema)


def quality_report(docs: DataFrame) -> DataFrame:
    """A row per document with the verdict's columns."""
    return judge(docs.select("doc_id", "text")).select("doc_id", "__quality.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is to stay, with their own columns."""
    name = fresh(docs, "__quality")
    return judge(docs, name=name).filter(F.col(f"{name}.kept")).select(*(F.col(f"`{c}`") for c in docs.columns))
