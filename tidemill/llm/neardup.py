"""MinHash near-dedup (operator 4): bottom-k sketches from one hash function.

A document's set is its distinct 5-word shingles (A-Z lower-cased); a shorter text is one shingle, a
text without words has none and links with nothing. Documents link if 100 * |A & B| >= 75 * |A | B|;
groups are the connected components.

1. One pass computes each document's set size, fingerprint of its set, and the K smallest hashes.
   Documents with equal sets are one class, represented once whatever their number.
2. Inverted lists of retained values. Two linked sets share at least `shared_at_least` retained values
   (exactly for small sets; for larger ones but for a chance of 1e-9 a pair), so with values ordered by
   frequency, rare first, it is enough to look at the first (shared - that + 1) shared values of each
   class: frequent passages drop out of the lists of all documents that are not mostly made of them.
3. Overlaps, never all pairs of a list. First each list is compared with its most central class: the
   one whose retained values are in most sketches, as an original's are and an edit's are not. What
   links is joined up, and pairs inside a component need no comparison. Of a list's other classes,
   those are dropped that no class of the list can link with: an intersection is no larger than the
   number of a set's elements that are in another set here, which bounds the size of a partner. Where
   more than MANY are left in a list, central ones among them lead again, twice as many each time, LEADS
   times at most. The rest of a short list is compared pair by pair. Long lists led by one component make
   a group, in which a set is known by what sets it apart: the elements that are in it or in most sets of
   the group, not both. Sets differ by what is in one of their odd ones only, so each has its share of the
   odd elements that a link needs in common. Where that is none, both link with the least odd set,
   which is compared with those. Others meet by prefixes: with odd elements in one order, rare first, the
   first one that two linked sets share comes early in both, as the others that they must share come
   after it. So edits that classes have in common bring them together, and neither what a whole group
   shares nor, mostly, edits at one place do. Their common odd elements are counted.
4. Candidates are filtered by the union-sketch estimate, and confirmed on full sets.

A group that has a centre costs about its size. Copies that are all nearly close enough, without any that
others link with, or that have edits in common, have common odd elements in their prefixes: pairs of these
are looked at one by one, that no link is lost, and still grow with the square of the group.

Skew: lists are counted with map-side aggregation and joined with sort-merge joins that AQE can
split; confirmation is salted. Nothing but counts reaches the driver. State between rounds is
written to the shared folder.

Null text: empty. Very long texts: sketched and confirmed whole, one text at a time in a task. An
empty table gives empty results. Repeated rows share their class; ties of frequency or centrality
change which pairs are compared, never the result. Rows with the same doc_id and different texts are
different documents with that id. Null doc_ids are larger than all others as representatives. Other
columns are passed on, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import Steps, free, fresh, kept, lean
from .words import Chunk, chunks, grams, hash_words, mix

SHINGLE = 5
#: Retained hashes of a set.
K = 64
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 75
SALTS = 64
#: A list of so many classes is long, and so many that remain in it are many.
BIG, MANY = 24, 1024
#: Times that central classes lead again.
LEADS = 3
#: Parts of the hash range in which elements are counted, to bound intersections.
PARTS = 64

_C1, _C2 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _binomial_below(n: int, p: float, most: float) -> int:
    """The largest t such that fewer than t of n come with a chance of at most `most`."""
    total, t = 0.0, 0
    while True:
        total += math.comb(n, t) * p**t * (1 - p) ** (n - t)
        if total > most:
            return t
        t += 1


#: Of the K smallest of a union of linked sets, as many at least are in both, but for 1e-9.
SURE = _binomial_below(K, PERCENT / 100, 1e-9)


def shared_at_least(n: int) -> int:
    """Retained values that a set of size n shares with any set that it links with."""
    if n > K:
        return SURE
    # sets of up to K elements are retained whole; a partner may have n / 0.75, of which K are
    return max(1, min(-(-PERCENT * n // 100), math.floor(K - n / 3), SURE if n * 100 > PERCENT * K else n))


def shingle_sets(c: Chunk) -> list[np.ndarray]:
    """The set of each text of a (lower-cased) chunk: sorted distinct shingle hashes."""
    h = hash_words(c)
    g, at = grams(h, c.doc, SHINGLE)
    cut = np.searchsorted(c.doc[at], np.arange(c.n + 1)) if len(at) else np.zeros(c.n + 1, np.int64)
    wb, out = c.word_bounds(), []
    for i in range(c.n):
        a, b = cut[i], cut[i + 1]
        if b > a:
            out.append(np.unique(g[a:b]))
        elif wb[i + 1] > wb[i]:  # fewer words than a shingle: all of them as one
            w = h[wb[i] : wb[i + 1]]
            out.append(grams(w, np.zeros(len(w), np.int64), len(w))[0] ^ np.uint64(len(w)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> np.uint64:
    """A fingerprint of a set."""
    x = np.array([mix(s ^ _C1).sum(dtype=np.uint64), mix(s ^ _C2).sum(dtype=np.uint64)], np.uint64)
    return mix(x[:1] ^ mix(x[1:] + np.uint64(len(s))))[0]


SKETCH = "doc_id long, cls long, n long, sketch array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cls, n, flat, at = [], [], [], [0]
        for c in chunks(b.column(1), lower=True):
            for s in shingle_sets(c):
                cls.append(class_of(s))
                n.append(len(s))
                flat.append(s[:K])
                at.append(at[-1] + len(flat[-1]))
        values = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array(np.array(n, np.int64)), lists], ["doc_id", "cls", "n", "sketch"])


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose union sketch lets them be linked. Columns a, b, na, nb, sa, sb."""
    for b in batches:
        na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
        sa, sb = (b.column(k).values.to_numpy(zero_copy_only=False).view(np.uint64) for k in (4, 5))
        oa, ob = (b.column(k).offsets.to_numpy() for k in (4, 5))
        ok = np.zeros(b.num_rows, bool)
        for i in range(b.num_rows):
            x, y = sa[oa[i] : oa[i + 1]], sb[ob[i] : ob[i + 1]]
            both = np.sort(np.concatenate([x, y]))
            twice = both[1:] == both[:-1]
            union = len(both) - int(twice.sum())
            if na[i] <= K and nb[i] <= K:
                ok[i] = 100 * (len(both) - union) >= PERCENT * union
            elif 100 * min(na[i], nb[i]) >= PERCENT * max(na[i], nb[i]):
                # of the K smallest of the union, those in both
                first = np.cumsum(np.append(True, ~twice)) <= K
                ok[i] = int((twice & first[1:]).sum()) >= SURE
        keep = pa.array(ok)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, b, text) sorted by (a, salt, b not null): a null b brings the text of a. Links."""
    leader, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        links: list[tuple[int, int]] = []
        for c in chunks(batch.column(3), lower=True):
            for i, s in enumerate(shingle_sets(c)):
                x, y = a[c.first + i], b[c.first + i]
                if y is None:
                    leader, own = x, s
                elif leader == x:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if both and 100 * both >= PERCENT * (len(own) + len(s) - both):
                        links.append((x, y))
                else:
                    raise RuntimeError(f"class {x} has no text")
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])


def _with_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, text) rows whose text is of the class."""
    for b in batches:
        got = [class_of(s) for c in chunks(b.column(1), lower=True) for s in shingle_sets(c)]
        keep = pa.array(np.array(got, np.uint64).view(np.int64) == b.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["cls", "text"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, text) rows to rows (cls, value) of whole sets."""
    for b in batches:
        cls = b.column(0).to_numpy()
        for c in chunks(b.column(1), lower=True):
            sets = shingle_sets(c)
            own = np.repeat(cls[c.first : c.first + c.n], [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate(sets).view(np.int64))], ["cls", "value"])


def _labelled(links: DataFrame, step: Steps) -> DataFrame:
    """Connected components of links (a, b): cls, comp (its smallest cls). Smallest labels spread over
    links and through labels' own labels, so rounds grow with the logarithm of a path."""
    both = step(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = step(both.groupBy(F.col("a").alias("cls")).agg(F.least(F.col("cls"), F.min("b")).alias("comp")))
    while True:
        near = both.join(label.select(F.col("cls").alias("b"), "comp"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        new = label.join(near, "cls").select("cls", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = label.select(F.col("cls").alias("comp"), F.col("comp").alias("up"))
        new = step(new.join(up, "comp").select("cls", "old", F.least("comp", "up").alias("comp")))
        changed = new.agg(F.max(F.col("old") != F.col("comp"))).first()[0]
        label = new.select("cls", "comp")
        if not changed:
            return label


def _merged(label: DataFrame, links: DataFrame, step: Steps) -> DataFrame:
    """Components (cls, comp) after more links (a, b): only what they join is labelled anew."""
    of = lambda x: label.select(F.col("cls").alias(x), F.col("comp").alias(f"c{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    up = _labelled(step(ends.filter("a != b")), step).select(F.col("cls").alias("comp"), F.col("comp").alias("up"))
    every = label.union(up.select(F.col("comp").alias("cls"), "comp")).distinct()
    return step(every.join(up, "comp", "left").select("cls", F.coalesce("up", "comp").alias("comp")))


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cls and n of docs; cls, component_id and the class that is kept, of all classes that link
    with another)."""
    with Steps(docs.sparkSession, "near") as step:
        sk, group = _near_duplicates(docs, step)
        return kept(sk.select("doc_id", "cls", "n")), kept(group)


def _near_duplicates(docs: DataFrame, step: Steps) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    slim = lean(docs).select("doc_id", "text")
    sk = step(slim.mapInArrow(_sketch, SKETCH))
    classes = step(sk.filter("n > 0").groupBy("cls", "n").agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")))

    # classes that share enough values with others to link: rare values first, and how many to look at
    value = classes.select("cls", F.explode("sketch").alias("value"))
    often = value.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    need = F.element_at(F.array(*(F.lit(shared_at_least(n)) for n in range(1, K + 2))), F.least("n", F.lit(K + 1)).cast("int"))
    shared = value.join(often, "value").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))  # at most K values
    shared = shared.join(classes.select("cls", "n", need.alias("need")), "cls").filter(F.size("v") >= F.col("need"))
    central = F.aggregate("v", F.lit(0.0), lambda t, x: t + F.log2(x["df"]))
    member = step(shared.select("cls", "n", central.alias("central"), F.col("v.value").alias("held"), (F.size("v") - F.col("need") + 1).alias("first")))
    held = member.select("cls", "n", "central", "first", F.posexplode("held").alias("pos", "value"))
    inside = F.col("pos") < F.col("first")
    lead = held.groupBy("value").agg(F.count(F.when(inside, 1)).alias("m"), F.max(F.struct("central", "cls", "n")).alias("lead")).filter("m > 1")
    left = step(held.filter(inside).join(lead, "value").select("value", "cls", "n", "central", F.col("lead.cls").alias("a"), F.col("lead.n").alias("na")))

    # texts of these classes
    who = member.join(classes.select("cls", F.col("rep").alias("doc_id")), "cls").select("cls", "doc_id")
    texts = slim.join(who, slim["doc_id"].eqNullSafe(who["doc_id"])).select("cls", "text")
    texts = step(texts.mapInArrow(_with_class, "cls long, text string").dropDuplicates(["cls"]))
    prefix = member.select("cls", F.slice("held", F.lit(1), F.col("first")).alias("prefix"))

    pairs = left.filter((F.col("a") != F.col("cls")) & _sizes("na", "n")).select("a", F.col("cls").alias("b")).distinct()
    label, common, turn = _labelled(_linked(pairs, classes, texts, step), step), None, 0
    while True:
        open_ = left.join(label, "cls", "left").select("value", "cls", "n", "central", F.coalesce("comp", "cls").alias("comp"), "a")
        several = open_.groupBy("value", "comp").agg(F.count("*").alias("c"), F.max("a").alias("a")).groupBy("value").agg(F.sum("c").alias("m"), F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("top"), F.max("a").alias("a"))
        several = several.filter("comps > 1").join(label.select(F.col("cls").alias("a"), F.col("comp").alias("g")), "a", "left")
        several = several.select("value", (F.col("m") >= BIG).alias("big"), F.col("top.comp").alias("main"), F.coalesce("g", "a").alias("g"))
        open_ = step(open_.join(several, "value"))
        if open_.isEmpty():
            break
        if common is None:
            element = step(_shared_elements(open_.filter("big").select("cls").distinct(), texts))
            common = step(_in_common(element))
            sets = step(element.groupBy("cls").agg(F.collect_list("value").alias("held")))
        # no intersection has more than s elements, and so no partner more than `upto`
        at = open_.join(common, "cls", "left").withColumn("s", F.when(F.col("big"), F.coalesce("s", F.lit(0))).otherwise(F.col("n")))
        at = at.withColumn("upto", F.floor((100 + PERCENT) * F.col("s") / PERCENT) - F.col("n")).filter(100 * F.col("s") >= PERCENT * F.col("n"))
        mover = step(_movers(at))
        many = mover.filter("big").groupBy("value").agg(F.count("*").alias("m")).filter(F.col("m") > MANY).select("value")
        led = None if turn == LEADS or many.isEmpty() else step(many)
        few = (lambda d: d) if led is None else (lambda d: d.join(led, "value", "left_anti"))
        # those that remain in a short list with all that bounds allow; a pair only in the first list that it shares
        mine = mover.filter("not big").join(prefix, "cls").select("value", *(F.col(c).alias(f"{c}_a") for c in ("cls", "comp", "n", "upto", "prefix")))
        theirs = at.filter("not big").join(prefix, "cls")
        one_way = (F.col("comp") == F.col("main")) | (F.col("cls_a") < F.col("cls"))
        once = F.array_min(F.array_intersect("prefix_a", "prefix")) == mine["value"]
        pairs = mine.join(theirs, (mine["value"] == theirs["value"]) & (F.col("comp_a") != F.col("comp")) & one_way & _allowed() & once)
        pairs = pairs.select(F.col("cls_a").alias("a"), F.col("cls").alias("b"))
        # those in long ones by what sets them apart from most in lists with leaders of one component
        moves = few(mover).filter("big").select("g", "cls").distinct().withColumn("moves", F.lit(True))
        now = few(at).filter("big").select("g", "cls", "comp", "n", "upto").distinct().join(moves, ["g", "cls"], "left").withColumn("moves", F.coalesce("moves", F.lit(False)))
        odd = step(_apart(step(now.join(sets, "cls"))))
        pairs = pairs.union(_nearest(odd)).union(_meeting(odd, step))
        if led is not None:  # of many, central ones lead
            lead = mover.join(led, "value").groupBy("value", F.pmod(F.xxhash64("cls", F.lit(turn)), F.lit(1 << turn)).alias("slot")).agg(F.max(F.struct("central", "cls", "comp", "n", "upto", "counts")).alias("l"))
            lead = step(lead.select("value", *(F.col(f"l.{c}").alias(f"{c}_a") for c in ("cls", "comp", "n", "upto", "counts"))))
            theirs = at.join(led, "value")
            more = lead.join(theirs, (lead["value"] == theirs["value"]) & (F.col("comp_a") != F.col("comp")) & _allowed() & _by_parts())
            pairs = pairs.union(more.select(F.col("cls_a").alias("a"), F.col("cls").alias("b")).distinct())
        label = _merged(label, _linked(pairs, classes, texts, step), step)
        free(spark)
        if led is None:
            break
        # what has led has met all others
        left = step(at.join(led, "value").join(lead.select("value", F.col("cls_a").alias("cls")), ["value", "cls"], "left_anti").select("value", "cls", "n", "central", "a"))
        turn += 1
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "cls")).alias("first")  # null ids come last
    component = label.join(classes, "cls").groupBy("comp").agg(first).select("comp", F.col("first.rep").alias("component_id"), F.col("first.cls").alias("keeper"))
    return sk, label.join(component, "comp").select("cls", "component_id", "keeper")


def _sizes(a: str, b: str) -> F.Column:
    """Sets of these sizes may link."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _allowed() -> F.Column:
    """A class with n_a and upto_a and one with n and upto may link."""
    return _sizes("n_a", "n") & (F.col("n") <= F.col("upto_a")) & (F.col("n_a") <= F.col("upto"))


def _by_parts() -> F.Column:
    """Counts by parts of the hash range allow a link. Lists that aren't long have none."""
    both = F.aggregate(F.zip_with("counts_a", "counts", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    return F.coalesce((100 + PERCENT) * both >= PERCENT * (F.col("n_a") + F.col("n")), F.lit(True))


def _movers(at: DataFrame) -> DataFrame:
    """The classes outside their list's largest component that bounds allow a partner there in another
    component: bounds of all classes of about one size (in steps of under 1 %) at once."""
    low = F.expr("greatest(0, int(floor(log2(n))) - 7)")
    band = at.withColumn("low", low).withColumn("band", F.expr("shiftright(n, low)"))
    room = band.groupBy("value", "low", "band").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("upto").alias("far"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    room = room.select(F.col("value").alias("v"), "least", "most", "far", "c0", "c1")
    fits = (F.col("least") <= F.col("upto")) & (F.col("n") <= F.col("far")) & (100 * F.col("most") >= PERCENT * F.col("n")) & (100 * F.col("n") >= PERCENT * F.col("least"))
    return at.filter(F.col("comp") != F.col("main")).join(room, (F.col("value") == F.col("v")) & fits & ((F.col("c0") != F.col("comp")) | (F.col("c1") != F.col("comp"))), "left_semi")


def _shared_elements(who: DataFrame, texts: DataFrame) -> DataFrame:
    """The elements of these classes' sets that are in several of them: cls, value, df. What is in no
    other set is in no intersection."""
    value = texts.join(who, "cls").select("cls", "text").mapInArrow(_elements, "cls long, value long")
    return value.join(value.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "value").select("cls", "value", "df")


def _in_common(element: DataFrame) -> DataFrame:
    """Per class: s, how many of the set's elements are in another of these sets, and the counts of these
    by parts of the hash range."""
    part = element.select("cls", F.pmod("value", F.lit(PARTS)).alias("part"))
    counts = [F.count_if(F.col("part") == k).cast("int").alias(f"p{k}") for k in range(PARTS)]
    by = part.groupBy("cls").agg(F.count("*").alias("s"), *counts)
    return by.select("cls", "s", F.array(*(f"p{k}" for k in range(PARTS))).alias("counts"))


def _apart(now: DataFrame) -> DataFrame:
    """What sets the classes (g, cls, comp, n, upto, moves, held) of a group g apart: `odd`, elements that are
    in a set or in most sets of the group, not both, and `far`. Two sets differ by as many elements as are in
    one of their odd ones only, so they link if they share (far + far) / (200 + 2 * PERCENT) odd ones."""
    often = now.select("g", F.explode("held").alias("value")).groupBy("g", "value").agg(F.count("*").alias("df"))
    size = now.groupBy("g").agg(F.count("*").alias("m"))
    most = often.join(size, (often["g"] == size["g"]) & (2 * F.col("df") > F.col("m"))).groupBy(often["g"]).agg(F.collect_list("value").alias("most"))
    both = now.join(most, "g", "left").withColumn("most", F.coalesce("most", F.array().cast("array<long>")))
    both = both.withColumn("odd", F.concat(F.array_except("held", "most"), F.array_except("most", "held")))
    # elements that no other set has are odd too
    far = (100 + PERCENT) * (F.size("odd") + F.col("n") - F.size("held")) - (100 - PERCENT) * F.col("n")
    return both.select("g", "cls", "comp", "n", "upto", "moves", "odd", far.alias("far"))


def _nearest(odd: DataFrame) -> DataFrame:
    """Pairs (a, b) of each group's least odd class with those that it links with whatever they share. Two
    that link whatever they share both link with it."""
    first = odd.groupBy("g").agg(F.min(F.struct("far", "cls", "comp")).alias("f")).select("g", "f.*")
    first = first.select("g", *(F.col(c).alias(f"{c}_a") for c in ("far", "cls", "comp")))
    near = odd.join(first, (odd["g"] == first["g"]) & (F.col("far_a") + F.col("far") <= 0) & (F.col("comp_a") != F.col("comp")))
    return near.select(F.col("cls_a").alias("a"), F.col("cls").alias("b")).distinct()


def _meeting(odd: DataFrame, step: Steps) -> DataFrame:
    """Pairs (a, b) in different components of a group, one of which moves, that share enough odd elements:
    the first one, rare first, has enough others after it in both, and all are counted."""
    value = odd.withColumn("value", F.explode("odd")).drop("odd")
    often = value.groupBy("g", "value").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("g", "cls")
    at = F.row_number().over(own.orderBy("df", "value"))
    ranked = value.join(often, ["g", "value"]).withColumn("rest", F.count("*").over(own) - at + 1)
    # an element suits partners that are no farther than its slack; those of a class that stays are movers
    ranked = ranked.withColumn("slack", 2 * (100 + PERCENT) * F.col("rest") - F.col("far")).drop("rest", "df")
    least = odd.groupBy("g").agg(F.min("far").alias("of_all"), F.min(F.when(F.col("moves"), F.col("far"))).alias("of_movers"))
    early = ranked.join(least, (ranked["g"] == least["g"]) & (F.col("slack") >= F.when(F.col("moves"), F.col("of_all")).otherwise(F.col("of_movers"))))
    early = step(early.select(ranked["g"], "value", "cls", "comp", "n", "upto", "moves", "far", "slack"))
    x = early.filter("moves").select(*(F.col(c).alias(f"{c}_a") for c in ("g", "value", "cls", "comp", "n", "upto", "far", "slack")))
    enough = (F.col("slack_a") >= F.col("far")) & (F.col("slack") >= F.col("far_a")) & (F.col("far_a") + F.col("far") > 0)
    one_way = ~F.col("moves") | (F.col("cls_a") < F.col("cls"))
    meet = x.join(early, (F.col("g_a") == F.col("g")) & (F.col("value_a") == F.col("value")) & (F.col("comp_a") != F.col("comp")) & one_way & enough & _allowed())
    pairs = step(meet.select("g", F.col("cls_a").alias("a"), F.col("cls").alias("b")).distinct())
    of = lambda x: odd.select("g", F.col("cls").alias(x), F.col("far").alias(f"far_{x}"), F.col("odd").alias(f"odd_{x}"))
    both = pairs.join(of("a"), ["g", "a"]).join(of("b"), ["g", "b"])
    return both.filter(2 * (100 + PERCENT) * F.size(F.array_intersect("odd_a", "odd_b")) >= F.col("far_a") + F.col("far_b")).select("a", "b").distinct()


def _linked(pairs: DataFrame, classes: DataFrame, texts: DataFrame, step: Steps) -> DataFrame:
    """Those of the pairs (a, b) that link: by the union sketch, then on full sets."""
    of = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    maybe = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "na", "nb", "sa", "sb")
    maybe = step(maybe.mapInArrow(_estimate, "a long, b long").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")))
    b = maybe.join(texts.withColumnRenamed("cls", "b"), "b").select("a", "salt", "b", "text")
    a = maybe.select("a", "salt").distinct().join(texts.withColumnRenamed("cls", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    dealt = b.union(a).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
    return step(dealt.mapInArrow(_confirm, "a long, b long"))


def neardup_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id that it is linked with over any
    number of steps), kept (doc_id is component_id)."""
    sk, group = near_duplicates(docs)
    same = sk.filter("n > 0").groupBy("cls", "n").agg(F.min("doc_id").alias("rep"))
    same = same.join(group, "cls", "left").select("cls", "n", F.coalesce("component_id", "rep").alias("component_id"))
    out = sk.select("doc_id", "cls", "n").join(same, ["cls", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull())
    )


def _passing(column: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for c in chunks(b.column(column), lower=True) for s in shingle_sets(c)]
            cls = pa.array(np.array([class_of(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64), mask=np.array([not len(s) for s in sets], bool))
            yield pa.RecordBatch.from_arrays([*b.columns, cls], [*b.schema.names, name])

    return run


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, with its own columns: that with the group's smallest doc_id. Of
    repeated rows one stays; documents without words are in no group and all stay."""
    sk, group = near_duplicates(docs)
    first = sk.filter("n > 0").groupBy("cls", "n").agg(F.min("doc_id").alias("rep")).join(group, "cls", "left")
    cls, at, rep, same = (fresh(docs, f"__near_{x}") for x in ("cls", "at", "rep", "same"))
    stay = first.filter(F.col("keeper").isNull() | (F.col("keeper") == F.col("cls"))).select(F.col("rep").alias(rep), F.col("cls").alias(same))
    classed = lean(docs).mapInArrow(_passing(docs.columns.index("text"), cls), T.StructType([*docs.schema.fields, T.StructField(cls, T.LongType())]))
    words = classed.join(stay, classed["doc_id"].eqNullSafe(F.col(rep)) & (F.col(cls) == F.col(same)), "left_semi")
    one = words.withColumn(at, F.row_number().over(Window.partitionBy("doc_id", cls).orderBy(F.lit(1)))).filter(F.col(at) == 1)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return one.select(*own).union(classed.filter(F.col(cls).isNull()).select(*own))
