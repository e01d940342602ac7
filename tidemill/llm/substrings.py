"""Substring dedup (operator 8): a log-structured index of window fingerprints.

A window is WINDOW consecutive words of one document. Documents come in batches, in the order of
doc_id. Within a batch they are dealt into blocks, ranges of doc_id of a bounded size; a block sends
the sorted distinct fingerprints of its windows, cut into segments (ranges of fingerprints), to the
segments' tasks. There they are merged with the sorted immutable runs of earlier batches: a key that
agrees (56 bits of a hash of the words) is verified by 24 bits of a second, independent hash of the
same words. What comes back to a block is one bit for each fingerprint that it sent: seen earlier or
not. The block then cuts the words covered by windows that are not the first of their kind. A batch's
fingerprints become a new run, and runs of similar size are compacted.

The index lives in its folder: a manifest names its runs, and each batch or compaction writes a new
run first and then commits the next version by a rename that fails if it exists. A new session opens
it where the last commit left it. vacuum() alone deletes runs. Segments are split in two as the index
grows, so that a task has a bounded part of it; older runs are cut as they are read.

A block sends a fingerprint once however often it occurs, so a passage in a third of all documents
is no hot key, and no group larger than a block or a segment is held in a task.

Order: by (doc_id, start); rows with the same doc_id and start are none earlier than the other, so
repeated rows of one doc_id lose the same words. Null doc_ids come last, among themselves by a hash
of the text. Null or empty text: no words. Texts shorter than a window keep everything; very long
ones are cut whole, in their block. Ties are broken by doc_id and start alone. An empty table gives an
empty result, and adds an empty run. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codec import cuts, packed, unpacked
from .shared import SETTLE, Versions, free, kept, lean, remove, scratch, text_bytes
from .words import _ODD, chunks, covered, grams, hash_words, mix

WINDOW = 20
#: Bytes of text in a block, and in a segment's share of text.
BLOCK, SEGMENT = 16 << 20, 16 << 20
#: Seconds that folders no version names are kept for.
GRACE = 24 * 3600
#: Runs within this factor in size are compacted.
SIMILAR = 2.0
REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string"

_CHECK = np.uint64(0xFF)


# -- fingerprints ----------------------------------------------------------------------------


def fingerprints(h: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of word hashes h: 56 bits of one hash and 8 of another, 16 more bits of that one,
    and the first word."""
    g, at = grams(h, doc, window)
    if not len(at):
        return g, np.zeros(0, np.uint16), at
    other = np.zeros(len(h) - window + 1, np.uint64)
    x = mix(h + _ODD[100])
    for j in range(window):
        other += x[j : j + len(other)] * _ODD[200 + j]
    other = mix(other[at])
    return (g & ~_CHECK) | (other & _CHECK), (other >> np.uint64(8)).astype(np.uint16), at


def distinct(fp: np.ndarray, ex: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct fingerprints in order, in their two parts, and the place of each among them."""
    order = np.lexsort((ex, fp))
    s, e = fp[order], ex[order]
    head = np.append(True, (s[1:] != s[:-1]) | (e[1:] != e[:-1]))[: len(s)]
    at = np.empty(len(s), np.int64)
    at[order] = np.cumsum(head) - 1
    return s[head], e[head], at


def _body(fp: np.ndarray, ex: np.ndarray) -> bytes:
    return packed(fp) + ex.astype("<u2").tobytes()


def _parts(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    fp = unpacked(body)
    return fp, np.frombuffer(body, "<u2", len(fp), len(body) - 2 * len(fp))


def _joined(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fingerprints of several rows one after another, and where each row begins."""
    got = [_parts(b) for b in bodies]
    return np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got]), np.cumsum([0, *(len(x) for x, _ in got)])


def _windows(table: pa.Table, window: int):
    """Of a block's texts, in order of okey: word bounds, and the windows' fingerprints and starts (by
    word in the block)."""
    order = np.argsort(table.column("okey").to_numpy(), kind="stable")
    col = table.column("text").take(pa.array(order))
    got, bounds, base = [], [0], 0
    for chunk in col.chunks:
        for c in chunks(chunk):
            f, e, a = fingerprints(hash_words(c), c.doc, window)
            got.append((f, e, a + base))
            bounds += (c.word_bounds()[1:] + base).tolist()
            base += len(c.starts)
    fp, ex, at = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64))
    return order, col, np.array(bounds), fp, ex, at


SENT = "seg int, block int, body binary"


def _cut_up(u: np.ndarray, e: np.ndarray, segments: int, block: int) -> pa.Table:
    """Rows of SENT of sorted distinct fingerprints."""
    cut = cuts(u, segments)
    full = np.flatnonzero(np.diff(cut)).tolist()
    return pa.table({"seg": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int32()), "body": pa.array([_body(u[cut[k] : cut[k + 1]], e[cut[k] : cut[k + 1]]) for k in full], pa.binary())})


def _send(segments: int, window: int):
    def run(table: pa.Table) -> pa.Table:
        _, _, _, fp, ex, _ = _windows(table, window)
        u, e, _ = distinct(fp, ex)
        return _cut_up(u, e, segments, table.column("block")[0].as_py())

    return run


def _split(segments: int):
    """Rows of a run of fewer segments, cut anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column(2).to_pylist():
                yield from _cut_up(*_parts(body), segments, -1).to_batches()

    return run


def _merge(keep_run: bool):
    """A segment's fingerprints: bits for each block (block >= 0), the new run (block -2). Runs of
    history come with block -1."""

    def run(table: pa.Table) -> pa.Table:
        seg = table.column("seg")[0].as_py()
        rows = sorted(zip(table.column("block").to_pylist(), table.column("body").to_pylist(), strict=True), key=lambda r: r[0])
        fp, ex, at = _joined([b for _, b in rows])
        order = np.lexsort((ex, fp))  # stable: blocks are in order of doc_id, history first
        s, e = fp[order], ex[order]
        earlier = np.zeros(len(fp), bool)
        earlier[order[1:]] = (s[1:] == s[:-1]) & (e[1:] == e[:-1])
        out = [(seg, block, np.packbits(earlier[a:b]).tobytes()) for (block, _), a, b in zip(rows, at[:-1], at[1:], strict=True) if block >= 0]
        if keep_run:
            new = order[~earlier[order] & (order >= at[sum(block < 0 for block, _ in rows)])]
            if len(new):
                out.append((seg, -2, _body(fp[new], ex[new])))
        return pa.table({"seg": pa.array([x for x, _, _ in out], pa.int32()), "block": pa.array([x for _, x, _ in out], pa.int32()), "body": pa.array([x for _, _, x in out], pa.binary())})

    return run


def _together(table: pa.Table) -> pa.Table:
    """A segment's rows of several runs as one."""
    u, e, _ = distinct(*_joined(table.column("body").to_pylist())[:2])
    return pa.table({"seg": table.column("seg")[:1].combine_chunks().cast(pa.int32()), "block": pa.array([-1], pa.int32()), "body": pa.array([_body(u, e)], pa.binary())})


def _cut(segments: int, window: int):
    def run(docs: pa.Table, bits: pa.Table) -> pa.Table:
        order, col, bounds, fp, ex, at = _windows(docs, window)
        u, _, inv = distinct(fp, ex)
        cut = cuts(u, segments)
        seen = np.zeros(len(u), bool)
        for seg, body in zip(bits.column("seg").to_pylist(), bits.column("body").to_pylist(), strict=True):
            n = cut[seg + 1] - cut[seg]
            seen[cut[seg] : cut[seg + 1]] = np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)
        text = np.searchsorted(bounds, at, side="right") - 1
        okey = docs.column("okey").to_numpy()[order]
        # the first of a kind in the block by (okey, start in its text)
        rank = np.cumsum(np.append(0, okey[1:] != okey[:-1])) if len(okey) else okey
        place = rank[text] * (int(bounds[-1]) + 1) + (at - bounds[text])
        first = np.full(len(u), np.iinfo(np.int64).max)
        np.minimum.at(first, inv, place)
        gone = seen[inv] | (place > first[inv])
        out = covered(int(bounds[-1]), at[gone], at[gone] + window)
        ids = docs.column("doc_id").take(pa.array(order))
        n_words, removed, digest = np.diff(bounds), [], []
        for i, t in enumerate(col.to_pylist()):
            words = (t or "").encode().split()
            o = out[bounds[i] : bounds[i + 1]]
            k = int(o.sum())
            removed.append(k)
            stay = [w for w, x in zip(words, o.tolist(), strict=True) if not x] if k else words
            digest.append(hashlib.sha256(b" ".join(stay)).hexdigest())
        return pa.table({"doc_id": ids.combine_chunks(), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    return run


# -- index -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Run:
    """Fingerprints of some batches: its folder, its bytes, and how many segments it is cut into."""

    folder: str
    size: int
    segments: int


class FingerprintIndex:
    """Runs of fingerprints of the documents seen so far, under a path that driver and executors
    share. `segments`: of a new index, for a first batch of about so many times SEGMENT bytes."""

    def __init__(self, spark: SparkSession, path: str, segments: int = 4, window: int = WINDOW):
        self.spark, self.path, self.segments, self.window = spark, path.rstrip("/"), segments, window
        self.versions = Versions(spark, self.path)
        self.seen, self.runs, self.version = 0, [], self.versions.newest()
        if self.version:
            got = self.versions.read(self.version)
            if got["window"] != window:
                raise ValueError(f"the index has windows of {got['window']} words")
            self.segments, self.seen, self.runs = got["segments"], got["seen"], [Run(**r) for r in got["runs"]]

    def _commit(self, runs: list[Run], seen: int) -> None:
        body = {"window": self.window, "segments": self.segments, "seen": seen, "runs": [asdict(r) for r in runs]}
        self.version = self.versions.commit(self.version, body)
        self.runs, self.seen = runs, seen

    def _bytes(self, path: str) -> int:
        return self.versions.fs.getContentSummary(self.versions.at(path)).getLength()

    def _read(self, runs: list[Run]) -> DataFrame | None:
        """The rows of some runs, cut into the index's segments."""
        out = None
        for n in sorted({r.segments for r in runs}):
            df = self.spark.read.schema(SENT).parquet(*(f"{self.path}/{r.folder}" for r in runs if r.segments == n)).withColumn("block", F.lit(-1))
            df = df if n == self.segments else df.mapInArrow(_split(self.segments), SENT)
            out = df if out is None else out.unionByName(df)
        return out

    def history(self) -> DataFrame | None:
        return self._read(self.runs)

    def _blocks(self, docs: DataFrame, size: int, block: int) -> tuple[DataFrame, int]:
        """docs as (block, okey, doc_id, text); blocks are ranges of okey in order."""
        n = max(1, -(-size // block))
        text = F.coalesce("text", F.lit(""))
        okey = F.coalesce(F.col("doc_id"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text), 3))
        slim = docs.select("doc_id", text.alias("text"), okey.alias("okey"))
        bounds = sorted({int(x) for x in slim.approxQuantile("okey", [k / n for k in range(1, n)], 0.2 / n)}) if n > 1 else []
        step = max(1, round(len(bounds) ** 0.5))
        rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
        longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs)) if xs else F.array().cast("array<long>")
        tops, below = longs([r[-1] for r in rows]), F.array(*(longs(r) for r in rows)) if rows else F.array(F.array().cast("array<long>"))
        # bounds that are less than okey, counted in two steps
        high = F.size(F.filter(tops, lambda x: x < F.col("okey")))
        low = F.coalesce(F.size(F.filter(F.get(below, F.col("__high")), lambda x: x < F.col("okey"))), F.lit(0))
        low = F.when(F.col("__high") < len(rows), low).otherwise(0)
        at = slim.withColumn("__high", high).withColumn("block", (F.col("__high") * step + low).cast("int"))
        # dealt by their number: hashing them would put several in one task
        return at.select("block", "okey", "doc_id", "text").repartitionById(len(bounds) + 1, F.col("block")), len(bounds) + 1

    def dedup(self, docs: DataFrame, append: bool = True, block: int = BLOCK) -> DataFrame:
        """REPORT rows of a batch of documents, all of which come after those in the index. With
        append their fingerprints become a run, and runs are compacted; Conflict if another writer
        has appended meanwhile, and this batch has to be asked again."""
        size = text_bytes(docs)
        while self.segments * SEGMENT < self.seen + size:
            self.segments *= 2
        segments = self.segments
        dealt, blocks = self._blocks(docs, size, block)
        sent = dealt.groupBy("block").applyInArrow(_send(segments, self.window), SENT)
        if (old := self.history()) is not None:
            sent = sent.unionByName(old)
        merged = sent.repartitionById(segments, F.col("seg")).groupBy("seg").applyInArrow(_merge(append), SENT)
        folder = f"batch-{uuid.uuid4().hex}"
        merged.withColumn("kind", F.when(F.col("block") >= 0, "bits").otherwise("run")).write.partitionBy("kind").parquet(f"{self.path}/{folder}")
        there = lambda name: self.versions.fs.exists(self.versions.at(name))
        if append:
            run = f"{folder}/kind=run"
            self._commit([*self.runs, *([Run(run, self._bytes(run), segments)] if there(run) else [])], self.seen + size)
            self.compact()
        free(self.spark, SETTLE)  # the shuffles up to the bits
        bits = f"{folder}/kind=bits"
        bits = self.spark.read.schema(SENT).parquet(f"{self.path}/{bits}") if there(bits) else self.spark.createDataFrame([], SENT)
        bits = bits.repartitionById(blocks, F.col("block"))
        return dealt.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(_cut(segments, self.window), REPORT)

    def compact(self) -> None:
        """Merge the newest runs while the last is at least 1 / SIMILAR of the one before it."""
        while len(self.runs) > 1 and self.runs[-1].size * SIMILAR >= self.runs[-2].size:
            two, folder = self.runs[-2:], f"run-{uuid.uuid4().hex}"
            both = self._read(two).repartitionById(self.segments, F.col("seg"))
            both.groupBy("seg").applyInArrow(_together, SENT).write.parquet(f"{self.path}/{folder}")
            self._commit([*self.runs[:-2], Run(folder, self._bytes(folder), self.segments)], self.seen)

    def vacuum(self, keep: int = 2, grace: float = GRACE) -> None:
        """Delete runs that none of the last `keep` versions names, and what writers and results that
        have been read left behind, if last written more than `grace` seconds ago."""
        named = {r["folder"].split("/")[0] for k in range(max(1, self.version - keep + 1), self.version + 1) for r in self.versions.read(k)["runs"]}
        self.versions.sweep(("",), lambda name: name.startswith(("batch-", "run-")) and name not in named, grace)


#: Shares of the documents in the batches of the report.
BATCHES = (0.125, 0.25)


def substring_report(docs: DataFrame, window: int = WINDOW, batches: tuple[float, ...] = BATCHES, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 of the words that stay. The documents go
    through an index of their own in batches that end at the given shares of the doc_ids."""
    spark = docs.sparkSession
    docs = lean(docs).select("doc_id", "text")
    index = FingerprintIndex(spark, scratch(spark, "fingerprints"), max(4, -(-text_bytes(docs) // SEGMENT)), window)
    ends = sorted({int(x) for x in docs.select("doc_id").na.drop().approxQuantile("doc_id", list(batches), 0.01)}) if batches else []
    out: list[DataFrame] = []
    low: int | None = None
    for end in ends:
        part = docs.filter(F.col("doc_id") <= end) if low is None else docs.filter((F.col("doc_id") > low) & (F.col("doc_id") <= end))
        out.append(index.dedup(part, block=max(block, 1)))
        low = end
    rest = docs if low is None else docs.filter((F.col("doc_id") > low) | F.col("doc_id").isNull())
    last = index.dedup(rest, append=False, block=block)
    for df in out:
        last = last.unionByName(df)
    last = kept(last)
    remove(spark, index.path)
    return last
