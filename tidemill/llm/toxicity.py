"""Toxicity (operator 5): noisy-channel deobfuscation, then a score of the restored text.

A character trigram model is counted over the letters of all documents. In each text, words that look
obfuscated (leet characters or separators between letters, leet characters at either end, a letter
three times or more, three letters or more spaced out by at most three characters) become a lattice: what each character may stand
for, runs that may collapse, separators and leet characters at an end that may vanish. The Viterbi path under the model and the channel's costs is the restored word.

Restored and plain words give features: hashes of the word and of its beginnings. A logistic
regression over the features with the largest evidence is fitted on a bounded sample of labelled
rows: at most SAMPLE, those with the smallest hash of doc_id, never rows whose
crc32(doc_id) mod 5 is 0. Labels, lang, source and doc_id are no inputs of a score.

Null and empty texts have no features and get the model's prior; very long ones are read whole, word
by word. Null doc_ids are scored and not fitted on. Ties of evidence are broken by the feature's hash.
Empty documents give no rows. Other columns are not looked at, whatever their names. Repeated rows are scored one by
one. Labels for absent documents, and null labels, are ignored; without any label of both kinds all
scores are the share of toxic labels (0 without labels). All passes are narrow but for the counts of the
sample's features.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .words import CHUNK, LOWER, SPACE, _ODD, _TABLE, Chunk, chunks, mix

#: Bounds of the fit: labelled rows, and features of the model.
SAMPLE, FEATURES = 15_000, 2_000
#: A feature needs so many toxic documents of the sample.
LEAST = 4
PREFIXES = (4, 6, 8)
SCORE = "doc_id long, held_out boolean, score double, predicted int"

LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = True
LETTER[0x80:] = True
#: What a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c"}
SEPARATORS = "-_.*~'`,:;/"
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in (*LEET, *SEPARATORS)]] = True

_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LEET]] = True

#: Classes of characters: 0 word bound, 1..26 letters, 27 any other.
KINDS = 28


def _class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[0x80:] = 27


# -- character model -------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(KINDS**3, np.int64)
    for b in batches:
        for c in chunks(b.column(0), lower=True):
            k = _CLASS[np.concatenate([[32, 32], c.data, [32]]).astype(np.uint8)]
            tri = (k[:-2] * KINDS + k[1:-1]) * KINDS + k[2:]
            total += np.bincount(tri, minlength=KINDS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["tri", "n"])


class CharModel:
    """-ln of smoothed trigram probabilities; its size is fixed."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(KINDS, KINDS, KINDS).astype(float)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + KINDS)
        p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
        p3 = (tri + 10 * p2[None]) / (tri.sum(2, keepdims=True) + 10)
        self.cost = -np.log(p3)
        self.rows = self.cost.tolist()

    @staticmethod
    def of(docs: DataFrame) -> CharModel:
        """Counted over all texts; what reaches the driver is at most KINDS ** 3 counts."""
        rows = lean(docs).select("text").mapInArrow(_count, "tri long, n long").groupBy("tri").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(KINDS**3)
        for r in rows:
            counts[r["tri"]] = r["n"]
        return CharModel(counts)


def restore(token: str, model: CharModel) -> str:
    """The most likely word behind an obfuscated token."""
    runs: list[list] = []
    for c in token:
        if runs and runs[-1][0] == c:
            runs[-1][1] += 1
        else:
            runs.append([c, 1])
    letters = [k for k, (c, _) in enumerate(runs) if c not in LEET and c.isalpha()]
    first, last = (letters[0], letters[-1]) if letters else (0, len(runs) - 1)
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for i, (c, r) in enumerate(runs):
        if c in LEET:
            options = [(x * k, 1.0 + 0.3 * (k - 1)) for x in LEET[c] for k in range(1, min(r, 2) + 1)]
            if c in "!|" or not first <= i <= last:
                options.append(("", 1.5))
        elif c.isalpha():
            options = [(c, 0.0)] if r == 1 else [(c * 2, 0.0), (c, 2.0)] if r == 2 else [(c, 0.0), (c * 2, 0.2)]
        else:
            options = [("", 0.0)]
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, text) in states.items():
            for out, extra in options:
                x, y, total = a, b, cost + extra
                for o in out:
                    k = _class(o)
                    total += model.rows[x][y][k]
                    x, y = y, k
                if (x, y) not in new or total < new[x, y][0]:
                    new[x, y] = (total, text + out)
        states = new
    return min(((cost + model.rows[a][b][0], text) for (a, b), (cost, text) in states.items()))[1]


def suspects(c: Chunk, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> list[tuple[int, str]]:
    """Obfuscated tokens of a lower-cased chunk as (text in chunk, token), in order. starts, ends
    and doc are of its runs of letters."""
    n = len(starts)
    if not n:
        return []
    data, size = c.data, ends - starts
    same = doc[1:] == doc[:-1]
    gap = starts[1:] - ends[:-1]
    odd, blank = (np.concatenate([[0], np.cumsum(x)]) for x in (~(_GAP | SPACE)[data], SPACE[data]))
    near = same & (odd[starts[1:]] == odd[ends[:-1]])
    blanks = blank[starts[1:]] > blank[ends[:-1]]
    leet = near & ~blanks
    spaced = near & (gap <= 3) & blanks & (size[1:] == 1) & (size[:-1] == 1)
    chain = np.zeros(n + 1, bool)  # spaced runs count from two links on
    if n > 2:
        ok = spaced[:-1] & spaced[1:]
        chain[: n - 2] |= ok
        chain[1 : n - 1] |= ok
    linked = np.append(leet, False) | chain[:n]
    linked[n - 1] = False
    triple = np.zeros(len(data) + 1, np.int64)
    if len(data) > 2:
        triple[3:] = np.cumsum((data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & LETTER[data[2:]] & (data[2:] < 0x80))
        triple[len(data)] = triple[len(data)]
    stretched = triple[ends] > triple[np.minimum(starts + 2, len(data))]
    # a token extends over the characters of LEET that touch its letters
    at, plain = np.arange(len(data)), ~_LEET[data]
    low = np.append(-1, np.maximum.accumulate(np.where(plain, at, -1)))[starts] + 1
    high = np.append(np.minimum.accumulate(np.where(plain, at, len(data))[::-1])[::-1], len(data))[ends]
    low, high = np.maximum(low, c.offsets[doc]), np.minimum(high, c.offsets[doc + 1])
    touched = (low < starts) | (high > ends)
    heads = np.flatnonzero(~np.append(False, linked[:-1]))
    tails = np.append(heads[1:], n) - 1
    marked = np.add.reduceat((linked | stretched | touched).astype(np.int64), heads) > 0
    raw, out = data.tobytes(), []
    for h, t in zip(heads[marked].tolist(), tails[marked].tolist(), strict=True):
        token = raw[int(low[h]) : int(high[t])].decode("utf-8", "replace")
        out.append((int(doc[h]), "".join(token.split()) if t - h > 1 else token))
    return out


# -- features --------------------------------------------------------------------------------


def _feature_hashes(body: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words (their bytes in a row, and their sizes) and of their beginnings, with the
    word that each is of."""
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    pos = np.arange(at[-1]) - np.repeat(at[:-1], size)
    val = _TABLE[((pos & 63) << 8) | body]
    every = np.arange(len(size))
    hashes, of = [mix(np.add.reduceat(val, at[:-1]) + size.astype(np.uint64) * _ODD[1])], [every]
    for k in PREFIXES:
        longer = size > k
        if longer.any():
            part = np.add.reduceat(np.where(pos < k, val, np.uint64(0)), at[:-1])[longer]
            hashes.append(mix(part + np.uint64(k) * _ODD[2]))
            of.append(every[longer])
    return np.concatenate(hashes), np.concatenate(of)


class Restorer:
    """Features of chunks; restored tokens are remembered within a task."""

    def __init__(self, model: CharModel, remembered: int = 50_000):
        self.model, self.known, self.most = model, {}, remembered

    def word(self, token: str) -> str:
        if (got := self.known.get(token)) is None:
            got = restore(token, self.model)
            if len(self.known) < self.most:
                self.known[token] = got
        return got

    def features(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Feature hashes of a lower-cased chunk, and the text that each is of."""
        inside = LETTER[c.data]
        edge = np.zeros(len(c.data) + 1, bool)
        edge[c.offsets] = True
        before = np.append(False, inside[:-1]) & ~edge[:-1]
        after = np.append(inside[1:], False) & ~edge[1:]
        starts = np.flatnonzero(inside & ~before)
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        ends = np.flatnonzero(inside & ~after) + 1
        doc = np.searchsorted(c.offsets, starts, side="right") - 1
        h, of = _feature_hashes(c.data[inside], ends - starts)
        docs = [doc[of]]
        hashes = [h]
        fixed = [(d, w.encode()) for d, t in suspects(c, starts, ends, doc) if (w := self.word(t))]
        if fixed:
            h, of = _feature_hashes(np.frombuffer(b"".join(w for _, w in fixed), np.uint8), np.array([len(w) for _, w in fixed]))
            hashes.append(h)
            docs.append(np.array([d for d, _ in fixed])[of])
        return np.concatenate(hashes), np.concatenate(docs)


def _evidence(model: CharModel):
    """(toxic, text) rows to partial document counts of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(model)
        for b in batches:
            toxic = b.column(0).to_numpy(zero_copy_only=False)
            seen = []
            for c in chunks(b.column(1), lower=True):
                h, d = r.features(c)
                o = np.lexsort((d, h))
                h, d = h[o], d[o]
                new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
                seen.append((h[new], toxic[c.first + d[new]]))
            h, t = (np.concatenate(x) for x in zip(*seen, strict=True)) if seen else (np.zeros(0, np.uint64), np.zeros(0))
            u, inv = np.unique(h, return_inverse=True)
            n1 = np.bincount(inv, weights=t, minlength=len(u)).astype(np.int64)
            n = np.bincount(inv, minlength=len(u))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n1), pa.array(n)], ["feature", "n1", "n"])

    return run


def _present(model: CharModel, chosen: np.ndarray):
    """(toxic, text) rows to (toxic, indexes of the chosen features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(model)
        for b in batches:
            rows: list[list[int]] = []
            for c in chunks(b.column(1), lower=True):
                rows += [x.tolist() for x in _found(r, c, chosen)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int64()))], ["toxic", "found"])

    return run


def _found(r: Restorer, c: Chunk, chosen: np.ndarray) -> list[np.ndarray]:
    h, d = r.features(c)
    k = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
    ok = chosen[k] == h if len(chosen) else np.zeros(len(h), bool)
    pairs = np.unique(d[ok] * (len(chosen) + 1) + k[ok]) if ok.any() else np.zeros(0, np.int64)
    cut = np.searchsorted(pairs // (len(chosen) + 1), np.arange(c.n + 1))
    return [pairs[a:b] % (len(chosen) + 1) for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Classifier:
    """The fitted model: the character model, feature hashes in order, weights and bias."""

    def __init__(self, model: CharModel, chosen: np.ndarray, weights: np.ndarray, bias: float):
        self.model, self.chosen, self.weights, self.bias = model, chosen, weights, bias

    def scores(self, r: Restorer, c: Chunk) -> np.ndarray:
        z = np.array([self.bias + self.weights[x].sum() for x in _found(r, c, self.chosen)])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(rows: list[list[int]], y: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """L2 logistic regression by Nesterov's gradient method, on binary features."""
    who = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    what = np.array([j for r in rows for j in r], np.int64)
    w, b, n = np.zeros(k), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), len(y)
    step = 4.0 * n / max(n, np.bincount(who, minlength=n).max() * n * 0.25 + n)
    v, vb = w.copy(), b
    for i in range(400):
        z = vb + np.bincount(who, weights=v[what], minlength=n)
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        w2 = v - step * (np.bincount(what, weights=g[who], minlength=k) / n + 2e-4 * v)
        b2 = vb - step * g.mean()
        m = i / (i + 3)
        v, vb, w, b = w2 + m * (w2 - w), b2 + m * (b2 - b), w2, b2
    return w, b


def held_out(doc_id: str, folds: int) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Character counts over all documents; the classifier on at most `sample` labelled rows."""
    model = CharModel.of(docs)
    lab = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out("doc_id", 5)).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    lab = lab.orderBy(F.xxhash64("doc_id")).limit(sample)
    train = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id").select("toxic", "text")  # at most `sample` ids
    stats = lab.agg(F.sum("toxic"), F.count("*")).first()
    n1, n = stats[0] or 0.0, stats[1]
    if not n1 or n1 == n:
        p = min(max(n1 / n if n else 0.0, 1e-9), 1 - 1e-9)
        return Classifier(model, np.zeros(0, np.uint64), np.zeros(0), math.log(p / (1 - p)))
    ev = train.mapInArrow(_evidence(model), "feature long, n1 long, n long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    rate = (F.col("n1") + 0.5 * n1 / n) / (F.col("n") + 0.5)
    best = ev.filter(F.col("n1") >= LEAST).select("feature", (F.col("n1") * F.log(rate * (n / n1))).alias("gain"))
    top = best.orderBy(F.desc("gain"), "feature").limit(FEATURES).collect()
    chosen = np.sort(np.array([r["feature"] for r in top], np.int64).view(np.uint64))
    got = train.mapInArrow(_present(model, chosen), "toxic double, found array<long>").collect()
    weights, bias = _logistic([r["found"] for r in got], np.array([r["toxic"] for r in got]), len(chosen)) if len(chosen) else (np.zeros(0), math.log(n1 / (n - n1)))
    return Classifier(model, chosen, weights, bias)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. One narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # KINDS ** 3 costs and FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        r = Restorer(own.model)
        for b in batches:
            s = np.concatenate([own.scores(r, c) for c in chunks(b.column(2), CHUNK, lower=True)]) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return lean(docs).select("doc_id", held_out("doc_id", 5).alias("held_out"), "text").mapInArrow(run, SCORE)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
