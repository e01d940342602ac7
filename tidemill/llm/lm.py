"""LM scoring (operator 3): log-frequency Bloom filters of quantised n-gram counts.

Tokens are the words of a text (A-Z lower-cased) and one end; the end also stands before the first
word. Training documents are those whose crc32(doc_id as text) mod 10 is not 0.

Counting: blocks of documents ask segments of the hash range for their distinct words and word pairs,
and send the counts in their own training texts along. A segment sums what it gets: the exact counts
of all words and word pairs of its range. A count c is stored as level 1 + floor(log2(c)): an n-gram
of level j is put into the segment's filter as j items (n-gram, 1) .. (n-gram, j). An item has bits
in two 64-bit words, and BITS bits of filter. The segment probes its filter for all that was asked,
and the blocks get levels, and the words' exact counts, back in the order asked.

Every n-gram is stored, whatever its count and the corpus: segments grow in number with the input,
not in size, and one with more items than FILTER_BYTES hold has several filters, each of a range. So
the filters are in the segments' tasks and the questions come to them; together they grow with the
corpus, which rules a broadcast out. What is broadcast is the model's few scalars.

Scoring: a count is read by probing level after level until one is missing. With q(c) the lowest count
of a level and Q(c) the highest,

    P(w | h) = M * q(h w) / (Q(h) + F * V) + (1 - M) * P(w),    P(w) = (1 - U) * q(w) / Z,

where Z is the sum of q over the vocabulary of V words, M the mass of word pairs that were counted at
least twice, and U that of the S words counted once: the probability of all unknown words, of which
there are taken to be S, so that each has U / S. F is the filters' rate of false positives, from
their fill: F * V is how many words seem to follow any h. As the q(h w) of an h sum to Q(h) at most,
all words' probabilities sum to at most 1 (with false positives: in expectation over the filters'
hashes). After an unknown word P(w) alone counts.

The exact base score needs each token's exact count, as the segments return it.

Null and empty text: only the end. Very long texts: whole, in the block that they are in. Null
doc_id: trained on, not held out. Repeated rows count and are scored one by one; ties of hashes among
n-grams (64 bits) would share a count. An empty table gives an empty result. Other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import counted, cuts, packed, uncounted, unpacked
from .shared import SETTLE, Written, free, kept, lean
from .words import _ODD, Chunk, chunks, hash_words, mix

FILTER_BYTES, BITS, PROBES = 32 << 20, 32, 4
#: Bytes of text in a block, and in a segment's share of text.
BLOCK, SEGMENT = 8 << 20, 12 << 20
FOLDS = 10
LEVELS = 48

END = mix(np.array([0x656E64], np.uint64))[0]
REPORT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's tokens, each text's words and then its end, and the text of each."""
    h = hash_words(c)
    doc = np.concatenate([c.doc, np.arange(c.n)])
    order = np.argsort(doc, kind="stable")  # ends come after the words of their text
    return np.concatenate([h, np.full(c.n, END, np.uint64)])[order], doc[order]


def pairs(h: np.ndarray) -> np.ndarray:
    """For each token the hash of the token before it (an end before the first) and itself. Chunks
    begin with a text, so what stands before each text is an end."""
    before = np.append(END, h[:-1])
    return mix(before * _ODD[300] + h * _ODD[301])


# -- model -----------------------------------------------------------------------------------


@dataclass
class Model:
    """The scalars of the model."""

    n: int  # training tokens
    vocabulary: int
    ends: int  # training texts
    pair_mass: float  # M
    unknown: float  # U / S
    known_total: float  # Z / (1 - U)
    false_rate: float = 0.0  # F

    @property
    def norm(self) -> float:
        return math.log10(self.n + 0.1 * (self.vocabulary + 1))


def model(spectrum: dict[tuple[int, int], tuple[int, int]], ends: int, false_rate: float = 0.0) -> Model:
    """The model from how many n-grams (kind, floor(log2(count))) there are, and their counts' sum."""
    words = {j: x for (kind, j), x in spectrum.items() if kind == 0}
    n, vocabulary, once = sum(t for _, t in words.values()), sum(a for a, _ in words.values()), words.get(0, (0, 0))[0]
    u = min(max(once / max(n, 1), 1 / (n + 1)), 0.999)
    z = sum(a * 2.0**j for j, (a, _) in words.items())
    again = sum(t for (kind, j), (_, t) in spectrum.items() if kind == 1 and j > 0)
    return Model(n, vocabulary, ends, min(again / max(n, 1), 0.999), u / max(once, 1), z / (1 - u) if z else 1.0, false_rate)


# -- filter ----------------------------------------------------------------------------------


def item(h: np.ndarray, kind: int, level: int, size: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of the filter, and bits in it, of (n-gram, level): the first or the second."""
    x = mix(h ^ _ODD[400 + 64 * (2 * kind + side) + level])
    at = ((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
    y = mix(x)
    bits = np.zeros(len(h), np.uint64)
    for k in range(PROBES):
        bits |= np.uint64(1) << ((y >> np.uint64(6 * k)) & np.uint64(63))
    return at.astype(np.int64), bits


def _probed(words: np.ndarray, h: np.ndarray, kind: int) -> np.ndarray:
    out = np.zeros(len(h), np.int64)
    left = np.arange(len(h))
    for j in range(1, LEVELS):
        if not len(left):
            break
        for side in (0, 1):
            at, bits = item(h[left], kind, j, len(words), side)
            left = left[(words[at] & bits) == bits]
        out[left] = j
    return out


def _rate(words: np.ndarray) -> float:
    """Of n-grams without an item, the part that a filter seems to hold."""
    return float(((np.bitwise_count(words) / 64) ** PROBES).mean() ** 2)


def filtered(h: np.ndarray, n: np.ndarray, kind: int, filter_bytes: int) -> tuple[np.ndarray, int, float]:
    """The levels of n-grams (sorted hashes h, counts n, 0 where only asked for) as filters of about
    filter_bytes at most give them, each filter of a range of hashes; the filters' 64-bit words, and
    these times the rate of false positives."""
    true = np.frexp(n.astype(float))[1].astype(np.int64)
    of = (np.cumsum(true) - true) * BITS // (8 * filter_bytes)
    heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    out, size, rate = np.zeros(len(h), np.uint8), 0, 0.0
    for a, b in zip(heads, [*heads[1:], len(h)], strict=True):
        words = np.zeros(max(1, -(-int(true[a:b].sum()) * BITS // 64)), np.uint64)
        for j in range(1, int(true[a:b].max()) + 1):
            for side in (0, 1):
                np.bitwise_or.at(words, *item(h[a:b][true[a:b] >= j], kind, j, len(words), side))
        out[a:b] = _probed(words, h[a:b], kind)
        size, rate = size + len(words), rate + len(words) * _rate(words)
    return out, size, rate


# -- scoring ---------------------------------------------------------------------------------


def scored(m: Model, h: np.ndarray, lv: np.ndarray, pl: np.ndarray) -> np.ndarray:
    """log10 P of each token, from its level and that of its pair with the token before it."""
    p1 = np.where(lv > 0, 2.0 ** (lv - 1) / m.known_total, m.unknown)
    most = 2.0**lv - 1  # the highest count of the level
    before = np.append(m.ends, most[:-1])
    before[np.append(True, h[:-1] == END)] = m.ends
    seen = np.where(pl > 0, 2.0 ** (pl - 1), 0.0)
    # after an unknown token, a pair that the filter holds can only be a false positive
    both = m.pair_mass * np.minimum(seen, before) / (before + m.false_rate * m.vocabulary + 1e-9) + (1 - m.pair_mass) * p1
    return np.log10(np.where(before > 0, both, p1))


ASKED = "seg int, block int, kind int, body binary, counts binary"
#: Rows of block -1 hold what the model's scalars follow from; those of level -1 the filters' words and rate.
ANSWERED = "seg int, block int, kind int, counts binary, levels binary, level long, types long, tokens long, rate double"


def _ask(segments: int):
    """A block's distinct words (kind 0) and pairs (kind 1), and their counts in its training texts."""

    def run(table: pa.Table) -> pa.Table:
        held, trained = [], []
        for col, out in zip(table.column("text").chunks, table.column("held_out").chunks, strict=True):
            skip = out.to_numpy(zero_copy_only=False).astype(bool)
            for c in chunks(col, lower=True):
                h, doc = tokens(c)
                held.append((h, pairs(h)))
                trained.append(~skip[c.first + doc])
        weights, block, rows = np.concatenate(trained), table.column("block")[0].as_py(), []
        for kind in (0, 1):
            u, inv = np.unique(np.concatenate([x[kind] for x in held]), return_inverse=True)
            n = np.bincount(inv, weights=weights, minlength=len(u)).astype(np.int64)
            cut = cuts(u, segments)
            rows += [(k, block, kind, packed(u[cut[k] : cut[k + 1]]), counted(n[cut[k] : cut[k + 1]])) for k in range(segments) if cut[k + 1] > cut[k]]
        return _table(rows, ASKED)

    return run


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], _ARROW[t]) for i, (name, t) in enumerate(fields)})


def _answer(filter_bytes: int):
    """A segment's levels, and total counts of words, for each block in the order that it asked."""

    def run(table: pa.Table) -> pa.Table:
        seg, rows = table.column("seg")[0].as_py(), []
        kinds = table.column("kind").to_numpy()
        for kind in np.unique(kinds).tolist():
            t = table.filter(pa.array(kinds == kind))
            arrays = [unpacked(b) for b in t.column("body").to_pylist()]
            n = np.concatenate([uncounted(b) for b in t.column("counts").to_pylist()])
            cut = np.cumsum([0, *map(len, arrays)])
            u, inv = np.unique(np.concatenate(arrays), return_inverse=True)
            total = np.bincount(inv, weights=n).astype(np.int64)  # sums stay below 2 ** 53
            level, size, rate = filtered(u, total, kind, filter_bytes)
            for block, a, b in zip(t.column("block").to_pylist(), cut[:-1], cut[1:], strict=True):
                rows.append((seg, block, kind, None if kind else counted(total[inv[a:b]]), zlib.compress(level[inv[a:b]].tobytes(), 1), None, None, None, None))
            true = np.frexp(total.astype(float))[1] - 1
            rows += [(seg, -1, kind, None, None, j, int((true == j).sum()), int(total[true == j].sum()), None) for j in np.unique(true[total > 0]).tolist()]
            rows.append((seg, -1, kind, None, None, -1, size, 0, rate))
        return _table(rows, ANSWERED)

    return run


def _score(sent):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        m: Model = sent.value
        order = np.argsort(answers.column("seg").to_numpy(), kind="stable")
        kinds = answers.column("kind").to_numpy()[order]
        counts, levels = answers.column("counts").to_pylist(), answers.column("levels").to_pylist()
        c_of = np.concatenate([uncounted(counts[k]) for k in order[kinds == 0].tolist()])
        level_of = [np.frombuffer(b"".join(zlib.decompress(levels[k]) for k in order[kinds == kind].tolist()), np.uint8) for kind in (0, 1)]
        parts = []
        for col in docs.column("text").chunks:
            for c in chunks(col, lower=True):
                parts.append((c.n, *tokens(c)))
        word = np.unique(np.concatenate([h for _, h, _ in parts]), return_inverse=True)[1]
        pair = np.unique(np.concatenate([pairs(h) for _, h, _ in parts]), return_inverse=True)[1]
        log_c = np.log10(c_of + 0.1)
        n_tokens, n_known, base, score, at = [], [], [], [], 0
        for n, h, doc in parts:
            k, p = word[at : at + len(h)], pair[at : at + len(h)]
            at += len(h)
            n_tokens.append(np.bincount(doc, minlength=n))
            n_known.append(np.bincount(doc, weights=c_of[k] > 0, minlength=n))
            base.append(np.bincount(doc, weights=log_c[k], minlength=n) - n_tokens[-1] * m.norm)
            score.append(np.bincount(doc, weights=scored(m, h, level_of[0][k].astype(np.int64), level_of[1][p].astype(np.int64)), minlength=n))
        size = np.concatenate(n_tokens)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(size, pa.int64()), "n_known": pa.array(np.concatenate(n_known).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(size), m.n), pa.int64()), "base_score": pa.array(np.concatenate(base)), "score": pa.array(np.concatenate(score)),
            }
        )

    return run


def lm_report(docs: DataFrame, filter_bytes: int = FILTER_BYTES, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A filter
    has filter_bytes at most, and there are as many as all n-grams need."""
    spark = docs.sparkSession
    docs = lean(docs).select("doc_id", "text")
    size, ends = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~held_out())).first()
    n, segments = max(1, -(-size // block)), max(4, -(-size // SEGMENT))
    # blocks and segments are dealt by their number: hashing them would put several in one task
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block")
    dealt = docs.select(at, "doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).repartitionById(n, F.col("block"))
    asked = dealt.groupBy("block").applyInArrow(_ask(segments), ASKED)
    answers = asked.repartitionById(segments, F.col("seg")).groupBy("seg").applyInArrow(_answer(filter_bytes), ANSWERED)
    with Written(answers, "answers") as answers:
        free(spark, SETTLE)  # the shuffles up to the answers
        rows = answers.filter("block < 0").groupBy("kind", "level").agg(*(F.sum(c).alias(c) for c in ("types", "tokens", "rate"))).collect()  # at most 2 * LEVELS
        fill = [r for r in rows if r["level"] < 0]
        false_rate = sum(r["rate"] for r in fill) / max(1, sum(r["types"] for r in fill))
        sent = spark.sparkContext.broadcast(model({(r["kind"], r["level"]): (r["types"], r["tokens"]) for r in rows if r["level"] >= 0}, ends, false_rate))
        answers = answers.filter("block >= 0").select("seg", "block", "kind", "counts", "levels").repartitionById(n, F.col("block"))
        return kept(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(sent), REPORT))
