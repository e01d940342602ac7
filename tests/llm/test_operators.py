"""The training-data operators against brute force, on documents with all the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import chat, codec, decontam, lines, lm, mixing, neardup, quality, sharding, substrings, template, toxicity, words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tok(t):
    return WORD.findall((t or "").encode())


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, repeats, nulls,
    empty and long texts, ties, repeated rows, non-ASCII blanks."""
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(n))
    base, passage = text(120), text(60)
    out = [(i, text(rng.randint(1, 160))) for i in range(60)]
    out += [(100 + i, base) for i in range(12)]
    for i in range(40):
        w = base.split()
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append((200 + i, " ".join(w)))
    out += [(300 + i, text(30) + passage + text(20)) for i in range(25)]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "one"), (405, "a b c d e"), (406, "A B C D E"), (407, "x " * 300), (408, ("line of words here\n" * 40)), (409, text(4000)), (410, "    é"), (411, "# $ % & | < > * end")]
    out += [(100, base), (500, text(80)), (500, text(80))]
    rng.shuffle(out)
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "c", None]), len(t or "")) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, cls long, n string, text_ string, value long"
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_words_are_the_contracts():
    t = ["a  b\tc", "", "é x\x0by", None, "z" * 200 + " " + "z" * 199 + "y", "end "]
    import pyarrow as pa

    for size in (4, 1 << 20):
        got = []
        for c in words.chunks(pa.array(t), size):
            raw = c.data.tobytes()
            ws = [(c.first + d, raw[a:b]) for a, b, d in zip(c.starts, c.ends, c.doc, strict=True)]
            assert len({h for h in words.hash_words(c).tolist()}) == len({w for _, w in ws})
            got += ws
        assert got == [(i, w) for i, x in enumerate(t) for w in tok(x)]


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_packed_hashes_come_back(xs, segments):
    h = np.unique(np.array(xs, np.uint64))
    assert (codec.unpacked(codec.packed(h)) == h).all()
    cut = codec.cuts(h, segments)
    assert sum(np.diff(cut)) == len(h) and (np.diff(cut) >= 0).all()
    n = (h % np.uint64(700)).astype(np.int64)
    assert (codec.uncounted(codec.counted(n)) == n).all()


# -- 10 --------------------------------------------------------------------------------------


def test_quality_against_brute_force(docs, rows, empty):
    got = defaultdict(list)
    for r in quality.quality_report(docs).collect():
        got[r.doc_id].append(r)
    for i, t, *_ in rows:
        w = tok(t)
        three = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {j for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        ls = [x for x in (t or "").encode().split(b"\n") if tok(x.decode())]
        n, longest, cov = len(w), 0, set()
        if n <= 700:
            order = sorted(range(n), key=lambda k: w[k:])
            lcp = [next((j for j in range(n) if max(a, b) + j >= n or w[a + j] != w[b + j]), n) for a, b in zip(order, order[1:], strict=False)]
            m = dict.fromkeys(range(n), 0)
            for a, b, x in zip(order, order[1:], lcp, strict=False):
                m[a], m[b] = max(m[a], x), max(m[b], x)
            longest = max(m.values(), default=0)
            cov = {j for k, x in m.items() if x >= quality.MIN_REPEAT for j in range(k, k + x)}
        failed = n < 50 or 100 * len(rep) > 50 * n
        want = (n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), len(rep), failed)
        hits = [r for r in got[i] if (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want]
        assert hits, (i, want, got[i])
        if n <= 700:
            assert any((r.longest_repeat, r.n_covered) == (longest, len(cov)) for r in hits)
            assert any(r.kept == (not failed and len(cov) <= quality.MAX_COVERED * n and longest <= quality.MAX_LONGEST) for r in hits)
    assert quality.quality_report(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for x in got.values() for r in x)


# -- 7 ---------------------------------------------------------------------------------------


def test_mixing_meets_targets_in_any_bucketing(docs, rows, empty):
    for bucket in (mixing.BUCKET, 7):
        out = mixing.copies(docs.select("doc_id", "source", "text"), ["doc_id"], bucket).collect()
        by = defaultdict(list)
        for r in out:
            by[(r.none, r.s)].append(r)
        words_of = Counter()
        for _, t, _, s, _ in rows:
            words_of[(s is None, s or "")] += len(tok(t))
        total = sum(words_of.values())
        assert math.isclose(sum(x[0].target for x in by.values()), total)
        for k, x in by.items():
            assert x[0].words == words_of[k] and x[0].target <= 3 * x[0].words + 1e-6
            assert all(0 <= r["__copies"] <= 3 for r in x)
            assert abs(sum(r["__copies"] * r.size for r in x) - x[0].target) <= 2 * max(r.size for r in x)
        order = sorted(by)
        level = {k: by[k][0].target / w for k, w in zip(order, (5, 2, 1, 5, 2, 1), strict=False) if by[k][0].target < 3 * by[k][0].words - 1e-6}
        assert max(level.values()) - min(level.values()) < 1e-6 * max(level.values())
    a, b = (sorted(map(tuple, mixing.mix_report(docs).collect())) for _ in range(2))
    assert a == b
    assert mixing.mix_report(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_mixing_takes_the_same_in_any_bucketing(spark):
    """In the order of (source, size, doc_id), as by the SQL."""
    rng = random.Random(5)
    rows = [(i, rng.choice("abc"), "w " * rng.choice([0, 3, 3, 3, 4, 40, 41])) for i in rng.sample(range(10_000), 600)]
    df = spark.createDataFrame([*rows, (None, "a", "w w w"), (None, "a", "w w w")], "doc_id long, source string, text string").repartition(3)
    one, many = (sorted(((r.s, r.size, r["__id"] is None, r["__id"] or 0, r["__copies"]) for r in mixing.copies(df, ["doc_id"], b).collect()), key=str) for b in (mixing.BUCKET, 7))
    assert one == many
    by = defaultdict(list)
    for s, size, none, i, n in sorted(one):
        by[s].append(n)
    rate = {r.s: (r.rate, r.offset) for r in mixing.copies(df, ["doc_id"]).select("s", "rate", "offset").distinct().collect()}
    for s, x in by.items():
        rt, u = rate[s]
        want = [math.floor(rt * k + u) - math.floor(rt * (k - 1) + u) for k in range(1, len(x) + 1)]
        assert [a for a, b in zip(x, want, strict=True) if a != b] == [] or s == "a" and sum(x) == sum(want)


# -- 1 ---------------------------------------------------------------------------------------


def test_masks_leave_no_tolerated_substitutions_out():
    from itertools import combinations

    for w, slack in [(decontam.WINDOW, decontam.SLACK)] + [(n, decontam.SHORT_SLACK) for n in range(decontam.LEAST, decontam.WINDOW)]:
        for miss in combinations(range(w), slack):
            assert any(all(p + o not in miss for o in m) for m in decontam.MASKS for p in range(w - m[-1]))


def test_decontamination(spark, docs, rows, empty):
    rng = random.Random(3)
    item = [f"Item{k}" for k in range(30)]
    bench = [(1, " ".join(item)), (2, "short item of five words"), (3, None), (4, ""), (5, " ".join(f"s{k}" for k in range(10))), (5, "x " * 20), (6, " ".join(f"t{k}" for k in range(8))), (7, "short item of five words"), (8, "lone")]
    cases = {900: (item, 1), 901: (item[:10], 0), 902: (item[5:18], 1), 903: ([x if k not in (3, 9) else "zz" for k, x in enumerate(item[:13])], 1), 904: ([x if k % 4 else "zz" for k, x in enumerate(item)], 0), 905: ([f"s{k}" for k in range(10)], 1), 906: ([f"S{k}" if k != 4 else "q" for k in range(10)], 1), 907: (["Short", "item", "of", "five", "words"], 1), 908: (["short", "item", "of", "six", "words"], 0), 909: ([f"T{k}" for k in range(8)], 1), 910: ([f"t{k}" if k != 4 else "q" for k in range(8)], 0), 911: (["lone"], 1)}
    more = [(i, " ".join(["pre", *rng.choices("abc", k=5), *w, "post"]), "en", "a", 0, 1, "x", "y", 2) for i, (w, _) in cases.items()]
    both = docs.unionByName(spark.createDataFrame(more, docs.schema)).unionByName(spark.createDataFrame(more[:1], docs.schema))
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.decontamination_report(both, b).collect()}
    for i, (_, hit) in cases.items():
        assert got[i].contaminated == bool(hit), i
    assert (got[907].item_ids, got[907].n_items, got[907].matched) == ("2,7", 2, 5) and got[911].matched == 1
    assert got[407].contaminated and sum(r.contaminated for r in got.values()) == 1 + sum(h for _, h in cases.values())
    clean = decontam.clean(both, b)
    assert clean.columns == docs.columns and clean.count() == both.count() - 2 - sum(h for _, h in cases.values())
    assert decontam.clean(both, b.limit(0)).count() == both.count()
    assert decontam.decontamination_report(empty, b).count() == 0
    old, decontam.BLOCK = decontam.BLOCK, 10
    try:  # a benchmark that is too large to be broadcast
        assert {r.doc_id for r in decontam.decontamination_report(both, b).collect() if r.contaminated} == {i for i, r in got.items() if r.contaminated}
    finally:
        decontam.BLOCK = old


def test_decontamination_by_items_that_share_an_id(spark):
    """They seed the document at the same place, and only one of them overlaps it."""
    item = [f"w{k}" for k in range(13)]
    wrong = [x if k in decontam.MASKS[0] else f"v{k}" for k, x in enumerate(item)]
    doc = spark.createDataFrame([(1, " ".join(item))], "doc_id long, text string")
    for i in (1, None):
        for texts in ((item, wrong), (wrong, item)):
            bench = spark.createDataFrame([(i, " ".join(t)) for t in texts], "item_id long, text string").coalesce(1)
            got = decontam.decontamination_report(doc, bench).collect()[0]
            assert got.contaminated and got.n_items == 1 and got.matched == 13
            assert decontam.clean(doc, bench).count() == 0


# -- 4 ---------------------------------------------------------------------------------------


def shingles(t):
    w = [x.lower() for x in tok(t)]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows))


def test_near_duplicates_against_brute_force(spark, docs, rows, empty):
    assert sorted(map(tuple, neardup.neardup_report(docs).collect())) == components(rows)
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    groups = {c for i, n, c, _ in components(rows) if n}
    assert Counter(r.doc_id for r in kept.collect() if tok(r.text))[100] == 1
    assert {r.doc_id for r in kept.collect() if tok(r.text)} == groups
    assert sum(not tok(r.text) for r in kept.collect()) == 3
    assert neardup.neardup_report(empty).count() == 0 and neardup.deduplicated(empty).count() == 0
    assert neardup.neardup_report(docs.filter("doc_id = 403")).collect()[0].component_id == 403


@pytest.mark.parametrize("many", [(4, 6), (4, 1024)])
def test_near_duplicates_in_a_large_group_of_varied_copies(spark, many):
    """Long lists, with members that link with few others, in several rounds."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in rng.sample(range(100), rng.choice([0, 1, 1, 2, 3, 4, 6, 9, 14])):
            w[k] = f"v{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old = neardup.BIG, neardup.MANY
    neardup.BIG, neardup.MANY = many
    try:
        assert sorted(map(tuple, neardup.neardup_report(df).collect())) == components(rows)
    finally:
        neardup.BIG, neardup.MANY = old


def test_pairs_of_varied_copies_do_not_grow_with_the_square(spark, monkeypatch):
    """Copies that mostly link with none: pairs that reach the sketches stay near the number of links."""
    rng, seen, linked = random.Random(3), [], neardup._linked

    def counting(pairs, classes, texts, step):
        pairs = step(pairs)
        links = linked(pairs, classes, texts, step)
        seen.append((pairs.count(), links.count()))
        return links

    monkeypatch.setattr(neardup, "_linked", counting)
    rows = []
    for i in range(1000):
        w = [f"w{k}" for k in range(150)]
        for k in rng.sample(range(150), rng.randrange(11)):
            w[k] = f"v{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.neardup_report(df).collect())) == components(rows)
    pairs, links = map(sum, zip(*seen[1:], strict=True))
    assert pairs <= 1000 + links  # 4,057 pairs for 184 links, when all pairs of a list were bounded by parts only


def test_fewer_copies_without_an_original_meet_by_what_sets_them_apart(spark, monkeypatch):
    """Nearly close enough, with edits of their own."""
    rng, seen = random.Random(4), []

    class Counting(neardup.Steps):
        def __call__(self, df):
            out = super().__call__(df)
            if {"a", "b"} <= set(out.columns):
                seen.append(out.count())
            return out

    monkeypatch.setattr(neardup, "Steps", Counting)
    rows = []
    for i in range(600):
        w = [f"w{k}" for k in range(150)]
        for k in rng.sample(range(150), rng.randrange(4, 8)):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.neardup_report(df).collect())) == components(rows)
    assert max(seen) <= 4000, seen  # 3,113, and 9,841 by prefixes of full sets


# -- 8 ---------------------------------------------------------------------------------------


def test_substrings_against_brute_force(docs, rows, empty):
    first, want = {}, Counter()
    for i, t, *_ in rows:
        w = tok(t)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, (i, k)), (i, k))
    for i, t, *_ in rows:
        w = tok(t)
        gone = {j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] < (i, k) for j in range(k, k + 20)}
        want[(i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())] += 1
    for batches, block in (((), substrings.BLOCK), ((0.3, 0.5, 0.7), 4000)):
        assert Counter(map(tuple, substrings.substring_report(docs, batches=batches, block=block).collect())) == want
    assert substrings.substring_report(empty).count() == 0


def test_index_compacts_runs_and_opens_again(spark, tmp_path, docs, rows, monkeypatch):
    """Batch by batch through new index objects, with segments that split: as in one go."""
    monkeypatch.setattr(substrings, "SEGMENT", 6_000)
    known = docs.filter("doc_id IS NOT NULL")
    want = {tuple(r) for r in substrings.substring_report(known).collect()}
    got, segments = set(), []
    for low, high in ((0, 30), (30, 60), (60, 101), (101, 110), (110, 220), (220, 10**6)):
        index = substrings.FingerprintIndex(spark, str(tmp_path / "index"), 1)
        got |= {tuple(r) for r in index.dedup(docs.filter(f"doc_id >= {low} AND doc_id < {high}")).collect()}
        segments.append(index.segments)
    assert got == want and len(index.runs) <= 4 and segments[0] < segments[-1]
    h = [x for r in index.history().collect() for x in zip(*(p.tolist() for p in substrings._parts(bytes(r.body))), strict=True)]
    assert len(h) == len(set(h)) > 0
    late, again = (substrings.FingerprintIndex(spark, str(tmp_path / "index")) for _ in range(2))
    again.dedup(docs.limit(0))
    with pytest.raises(sharding.Conflict):
        late.dedup(docs.limit(0))
    again.vacuum(keep=1, grace=0)
    assert {p.name for p in (tmp_path / "index").iterdir()} - {"manifest"} == {r.folder.split("/")[0] for r in again.runs}
    assert sum(again.history().toPandas()["body"].map(lambda b: len(substrings._parts(bytes(b))[0]))) == len(h)


def test_fingerprints_that_agree_in_part_are_told_apart():
    fp, ex = np.array([5, 5, 5, 9], np.uint64), np.array([2, 1, 2, 0], np.uint16)
    u, e, at = substrings.distinct(fp, ex)
    assert u.tolist() == [5, 5, 9] and e.tolist() == [1, 2, 0] and at.tolist() == [1, 0, 1, 2]
    import pyarrow as pa

    row = lambda block, k: {"seg": 0, "block": block, "body": substrings._body(fp[k : k + 1], ex[k : k + 1])}
    schema = pa.schema([("seg", pa.int32()), ("block", pa.int32()), ("body", pa.binary())])
    out = substrings._merge(True)(pa.Table.from_pylist([row(-1, 0), row(0, 1), row(1, 2), row(2, 1)], schema)).to_pylist()
    assert [np.unpackbits(np.frombuffer(r["body"], np.uint8))[0] for r in out if r["block"] >= 0] == [0, 1, 1]
    assert [substrings._parts(r["body"])[1].tolist() for r in out if r["block"] == -2] == [[1]]


# -- 3 ---------------------------------------------------------------------------------------


def out_of(i, n):
    return zlib.crc32(str(i).encode()) % n == 0


def test_lm_against_brute_force(docs, rows, empty):
    c = Counter()
    for i, t, *_ in rows:
        if not out_of(i, 10):
            c.update([*(x.lower() for x in tok(t)), None])
    n, z = sum(c.values()), math.log10(sum(c.values()) + 0.1 * (len(c) + 1))
    want = Counter()
    for i, t, *_ in rows:
        w = [*(x.lower() for x in tok(t)), None]
        want[(i, out_of(i, 10), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10(c[x] + 0.1) - z for x in w), 6))] += 1
    got = lm.lm_report(docs, block=4000).collect()
    assert Counter((*r[:5], round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.lm_report(empty).count() == 0


def lm_counts(rows):
    """Words, pairs and texts of the training documents, each by count; None is the end."""
    one, two, ends = Counter(), Counter(), 0
    for i, t, *_ in rows:
        if not out_of(i, 10):
            w = [*(x.lower() for x in tok(t)), None]
            one.update(w)
            two.update(zip([None, *w[:-1]], w, strict=True))
            ends += 1
    return one, two, ends


def lm_model(one, two, ends):
    """The formula of the docstring, on exact counts: a probability of a word after another."""
    low = lambda c: 2 ** (c.bit_length() - 1)
    n, once = sum(one.values()), sum(c == 1 for c in one.values())
    u, m, z = once / n, sum(c for c in two.values() if c > 1) / n, sum(map(low, one.values()))

    def p(h, w):
        p1 = (1 - u) * low(one[w]) / z if one[w] else u / once
        top = ends if h is None else 2 * low(one[h]) - 1 if one[h] else 0
        return m * (low(two[h, w]) if two[h, w] else 0) / top + (1 - m) * p1 if top else p1

    return p, u


def test_lm_score_against_brute_force(docs, rows):
    p, _ = lm_model(*lm_counts(rows))
    want = defaultdict(list)
    for i, t, *_ in rows:
        w = [*(x.lower() for x in tok(t)), None]
        want[i].append(sum(math.log10(p(h, x)) for h, x in zip([None, *w[:-1]], w, strict=True)))
    for r in lm.lm_report(docs, block=4000).collect():
        assert any(abs(r.score - x) <= 0.005 * r.n_tokens for x in want[r.doc_id]), r  # F * V is above 0


def test_lm_probabilities_sum_to_one_at_most(rows):
    import pyarrow as pa

    one, two, ends = lm_counts(rows)
    hash_of = {w: lm.END if w is None else lm.hash_words(next(words.chunks(pa.array([w.decode()]))))[0] for w in one}
    vocab, h = list(one), np.array([hash_of[w] for w in one])
    spectrum = defaultdict(lambda: (0, 0))
    for kind, counts in ((0, one), (1, two)):
        for c in counts.values():
            a, t = spectrum[kind, c.bit_length() - 1]
            spectrum[kind, c.bit_length() - 1] = a + 1, t + c
    p, u = lm_model(one, two, ends)
    # the levels of all pairs as filters give them
    contexts = [None, *random.Random(5).sample(vocab, 60), b"never seen"]
    pairs = {}
    for x in contexts:
        before = hash_of.get(x, lm.mix(np.array([99], np.uint64))[0])
        pairs[x] = lm.pairs(np.stack([np.full(len(h), before), h], 1).ravel())[1::2]
    every = np.concatenate([*pairs.values()])
    count = np.array([two[x, w] for x in contexts for w in vocab])
    u_, first = np.unique(every, return_index=True)
    level, size, rate = lm.filtered(u_, count[first], 1, lm.FILTER_BYTES)
    m = lm.model(spectrum, ends, rate / size)
    unknown = lm.mix(np.array([1234567], np.uint64))[0]
    for x in contexts:
        lv = np.array([one[w].bit_length() for w in vocab])
        own = one[x].bit_length()
        tokens = np.stack([np.full(len(h), hash_of.get(x, unknown)), h], 1).ravel()
        got = 10 ** lm.scored(m, tokens, np.stack([np.full(len(h), own), lv], 1).ravel(), np.stack([np.zeros(len(h), np.int64), level[np.searchsorted(u_, pairs[x])]], 1).ravel())[1::2]
        weight = 1 if x == b"never seen" else 1 - m.pair_mass
        total = got.sum() + weight * u
        assert 0.3 <= total <= 1.02
        assert abs(got.sum() - sum(p(x, w) for w in vocab)) <= 0.02


def test_lm_keeps_every_ngram_whatever_a_filter_holds(docs):
    """Filters too small for the n-grams grow in number: scores stay those of one filter for all."""
    key = lambda r: (r.doc_id, r.n_tokens, r.base_score)
    one, many = (sorted(lm.lm_report(docs, filter_bytes=b, block=4000).collect(), key=key) for b in (lm.FILTER_BYTES, 300))
    assert [key(r) for r in one] == [key(r) for r in many]
    assert all(abs(a.score - b.score) <= 0.02 * abs(a.score) + 0.5 for a, b in zip(one, many, strict=True))


def test_lm_filters_hold_all_counts():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    n = rng.choice([0, 1, 1, 1, 2, 3, 9, 1000], len(h))
    true = np.frexp(n.astype(float))[1]
    for size in (lm.FILTER_BYTES, 3000):
        got, words64, rate = lm.filtered(h, n, 1, size)
        assert (got >= true).all() and (got > true).mean() < 0.01
        assert words64 * 64 >= true.sum() * lm.BITS and 0 < rate < 0.01 * words64


# -- 5 ---------------------------------------------------------------------------------------


def test_restoring_obfuscated_words(spark):
    text = "such an idiot and a moron and a stupid loser with trash all over the idiot moron stupid loser trash " * 3
    m = toxicity.CharModel.of(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    for t, want in (("1d10t", "idiot"), ("id-i.ot", "idiot"), ("$tup1d", "stupid"), ("mooorooon", "moron"), ("l0ser", "loser"), ("tr@sh", "trash")):
        assert toxicity.restore(t, m) == want


def test_viterbi_finds_the_best_of_all_readings(spark):
    """Against every reading of a token's lattice."""
    from itertools import product

    m = toxicity.CharModel.of(spark.createDataFrame([(1, "such an idiot and a moron with less tools all over the good book " * 5)], "doc_id long, text string"))
    rng = random.Random(9)

    def cost(text):
        a, b, total = 0, 0, 0.0
        for x in [*map(toxicity._class, text), 0]:
            total += m.rows[a][b][x]
            a, b = b, x
        return total

    for _ in range(150):
        token = "".join(rng.choice("idotlsmn013$@!-.") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randint(1, 6)))
        runs = [(c, len(list(g))) for c, g in groupby(token)]
        letters = [k for k, (c, _) in enumerate(runs) if c.isalpha()]
        first, last = (letters[0], letters[-1]) if letters else (0, len(runs) - 1)
        options = []
        for k, (c, r) in enumerate(runs):
            if c in toxicity.LEET:
                o = [(x * j, 1.0 + 0.3 * (j - 1)) for x in toxicity.LEET[c] for j in (1, 2) if j <= r]
                options.append([*o, ("", 1.5)] if c in "!|" or not first <= k <= last else o)
            elif c.isalpha():
                options.append([(c, 0.0)] if r == 1 else [(c * 2, 0.0), (c, 2.0)] if r == 2 else [(c, 0.0), (c * 2, 0.2)])
            else:
                options.append([("", 0.0)])
        price = {}
        for path in product(*options):
            text = "".join(t for t, _ in path)
            price[text] = min(price.get(text, math.inf), sum(x for _, x in path) + cost(text))
        assert price[toxicity.restore(token, m)] <= min(price.values()) + 1e-6, token


def test_obfuscation_at_ends_and_by_wider_spacing_is_decoded(spark):
    import pyarrow as pa

    text = "such an idiot and a bitch and a dumbass and an asshole with a fat pig all over the asshole dumbass bitch idiot " * 4
    m = toxicity.CharModel.of(spark.createDataFrame([(1, text)], "doc_id long, text string"))

    def decoded(t):
        seen = []
        r = toxicity.Restorer(m)
        word = r.word
        r.word = lambda token: seen.append(word(token)) or seen[-1]
        r.features(next(words.chunks(pa.array([t, "x"]), lower=True)))
        return seen

    for t, want in (("a dumba55", "dumbass"), ("asshol3 he", "asshole"), ("an !diot", "idiot"), ("8itch", "bitch"), ("(an idiot!)", "idiot"), ("i  d  i  o  t", "idiot"), ("i - d - i - o - t", "idiot"), ("p i g", "pig"), ("i----d----i----o----t", "idiot")):
        assert want in decoded(t), (t, decoded(t))
    assert decoded("a fat pig") == [] and decoded("such - an - idiot") == []


def test_toxicity_learns_and_generalises(spark, empty):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = rng.choices(vocab, k=40)
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["moron", "m0r0n", "idiot", "1d1ot", "i d i o t", "morooon"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(2000, None), (2001, ""), (None, "moron")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity_report(df, spark.createDataFrame([*labels, (3000, 1), (5, None)], "doc_id long, toxic int")).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    test = [i for i, _ in labels if out_of(i, 5)]
    assert all(got[i].held_out == out_of(i, 5) for i, _ in labels)
    assert sum(got[i].predicted == (i % 4 == 0) for i in test) >= 0.95 * len(test)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity_report(df, none).count() == len(rows) and toxicity.toxicity_report(empty, none).count() == 0


# -- 2 ---------------------------------------------------------------------------------------


@given(st.text(max_size=40).map(lambda s: s) | st.lists(st.sampled_from([*template.CONTROL, "\\", "<", "|", "x"]), max_size=8).map("".join))
@settings(max_examples=200, deadline=None)
def test_escaping_is_reversible_and_leaves_no_control_string(s):
    e = template.escape(s)
    assert template.unescape(e) == s
    assert not any(c in e for c in template.CONTROL)


def test_template_language():
    t = template.Template("{% set x = 'a' ~ 1 ~ 1 %}{% for m in messages %}{% if loop.first %}[{% endif %}{{ m.role | upper }}{% if not loop.last %},{% else %}]{% endif %}{% endfor %}{{ x }}")
    assert t.render([{"role": "u"}, {"role": "v"}])[0] == "[U,V]a11"
    folded = template.Template("{% if 1 == 2 %}no{% elif true %}yes{% endif %}{{ 'a' | upper }}{{ 1 + 2 }}")
    assert folded.tree == [template.Out(template.Const("yesA3"))]
    text, spans = template.Template("{% for m in messages %}<{% generation %}{{ m['text'] }}{% endgeneration %}>{% endfor %}").render([{"text": "ab"}, {"text": "é"}])
    assert text == "<ab><é>" and [text[a:b] for a, b in spans] == ["ab", "é"]
    for bad in ("{{ 3 | length }}", "{% set x 1 %}", "{{ x = 1 }}", "{{ x.__class__ | nope }}", "{% for %}", "{{ f(1) }}", "{% if x %}", "{{ 1 + }}", "{% endfor %}", "{{ 'a' + 1 }}"):
        with pytest.raises(template.TemplateError):
            template.Template(bad)
    with pytest.raises(template.TemplateError):
        template.Template("{{ messages.__class__ }}").render([])
    for bad in ("{% for x in 3 %}{% endfor %}", "{% for x in none %}{% endfor %}", "{{ n | length }}", "{{ n < 'a' }}", "{{ 1 in n }}"):
        with pytest.raises(template.TemplateError):
            template.Template(bad).render([], n=3)


def test_chat_round_trip(spark):
    convs = {1: [("user", "hi </s>"), ("assistant", "<|end|>\\ ok"), ("assistant", "")], None: [("user", None), (None, "x")], 7: [("system", "s")] + [("assistant", f"t{k} [INST]") for k in range(300)]}
    rows = [(c, k, r, t) for c, ts in convs.items() for k, (r, t) in enumerate(ts)] + [(8, None, "user", "a"), (8, 0, "user", "b"), (8, 0, "user", "b")]
    convs[8] = [("user", "a"), ("user", "b"), ("user", "b")]
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "conv_id long, turn long, role string, text string")
    convs[-1] = [("user", chat.CONTROL_TEXT), ("assistant", chat.CONTROL_TEXT)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, ts in convs.items():
        loss = "".join(t or "" for r, t in ts if r == "assistant")
        want[c] = (len(ts), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in ts)), len(loss), sha(loss))
    got = {r.conv_id: tuple(r)[1:5] for r in chat.chat_report(df).collect()}
    assert got == want
    pieces = chat.format_conversations(df, piece=200).collect()
    assert len(pieces) > len(convs)
    cut = {r.conv_id: tuple(r)[1:5] for r in chat.chat_digest(df, piece=200).collect()}
    assert cut == {c: v for c, v in want.items() if c != -1}
    assert chat.chat_report(df.limit(0)).count() == 1


# -- 9, 6 ------------------------------------------------------------------------------------


def test_line_dedup(spark):
    page = lambda i, host, *ls: (i, f"https://{host}/p{i}", "<html><script>x</script>" + "".join(f"<p>{x}</p>" for x in ls), "extra")
    rows = [page(i, "A.example.com:80", "menu", f"own {i}", "menu") for i in range(10)] + [page(20 + i, "b.org", "menu", f"b {i}") for i in range(2)] + [page(30 + i, "c.org", *(["rare"] if i < 5 else []), "all") for i in range(10)]
    rows += [(90, None, "<p>x</p>", ""), (91, "https://b.org/", None, ""), (92, "https://b.org/", "", ""), page(0, "a.example.com", "menu", "own 0", "menu")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = [(r.page_id, r.host, r.kept) for r in lines.without_boilerplate(df).collect()]
    kept = {i: k for i, _, k in got}
    assert len(got) == len(rows) and kept[3] == ["own 3"] and kept[20] == ["menu", "b 0"]
    assert kept[30] == ["rare"] and kept[39] == [] and kept[90] == ["x"] and kept[91] == kept[92] == []
    assert lines.line_report(df.limit(0)).count() == 0


def test_shards_hold_every_row_and_merge_by_tiers(spark, tmp_path, docs, rows, empty):
    store = sharding.ShardStore(spark, str(tmp_path / "store"), small=20_000, target=150_000, fanout=3)
    for k in range(7):
        store.append(docs.filter(f"doc_id % 7 = {k} OR {k} = 0 AND doc_id IS NULL"))
        before = store.manifest()
        store.compact()
        assert not store.plan(store.manifest()["shards"])
    now = store.manifest()
    assert now["version"] > 7 and len(now["shards"]) < 7
    assert sorted(map(str, store.read().drop("__shard").collect())) == sorted(map(str, docs.collect()))
    with pytest.raises(sharding.Conflict):
        store.commit(now["version"] - 1, now["schema"], [])
    assert store.version() == now["version"] and before
    with pytest.raises(ValueError, match="other columns"):
        store.append(docs.select("doc_id"))
    store.append(empty)
    assert len(store.manifest()["shards"]) == len(now["shards"])
    # sizes, tiers and rows, by brute force over the files
    for x in store.manifest()["shards"]:
        at = tmp_path / "store" / "shards" / x.name
        assert (at.stat().st_size, spark.read.parquet(str(at)).count()) == (x.size, x.rows) and x.rows
    small = Counter(0 if x.size < 20_000 else 1 if x.size < 60_000 else 2 for x in store.manifest()["shards"] if x.size < 75_000)
    assert all(n < 3 for n in small.values())
    got = Counter((r.doc_id, r.text_sha256) for r in sharding.shard_report(docs).collect())
    assert got == Counter((i, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, t, *_ in rows)
    assert sharding.shard_report(empty).count() == 0


def test_shards_survive_other_writers_and_readers(spark, tmp_path, docs):
    """A compaction between an append's files and its commit, and under an open reader; leftovers."""
    store, other = (sharding.ShardStore(spark, str(tmp_path / "s"), small=20_000, target=150_000, fanout=2) for _ in range(2))
    store.append(docs.filter("doc_id < 100"))
    store.append(docs.filter("doc_id BETWEEN 100 AND 250"))
    reader, want = store.read(), docs.filter("doc_id <= 250").count()
    moved = store._moved

    def slow(tmp):
        got = moved(tmp)
        store._moved = moved
        other.compact()
        other.vacuum()
        return got

    store._moved = slow
    store.append(docs.filter("doc_id > 250"))
    assert reader.count() == want and store.read().count() == docs.filter("doc_id IS NOT NULL").count()
    (tmp_path / "s" / "tmp-crashed").mkdir()
    (tmp_path / "s" / "tmp-crashed" / "part-0.parquet").write_bytes(b"x")
    store.vacuum()
    assert (tmp_path / "s" / "tmp-crashed").exists()
    store.vacuum(keep=1, grace=0)
    assert not (tmp_path / "s" / "tmp-crashed").exists()
    assert {f.name for f in (tmp_path / "s" / "shards").glob("*.parquet")} == {x.name for x in store.manifest()["shards"]}
    assert store.read().count() == docs.filter("doc_id IS NOT NULL").count()


def test_null_ids_long_texts_and_names_that_clash(spark):
    """Rows without an id, one very long text, and columns named like those inside the operators."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    near, long_ = text(90), text(60_000)
    rows = [(None, near), (None, near), (3, near + " more"), (None, None), (5, long_), (6, ""), (7, text(80)), (8, long_ + " end")]
    names = ["__near_cls", "__near_at", "__near_rep", "__near_same", "__id", "__th", "__row", "__copies", "__i", "__shard", "__shard_arrival", "__quality", "h", "at", "seed", "size", "block", "cls", "n", "value"]
    df = spark.createDataFrame([(*r, "s", *range(len(names))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    near_ = {(r.doc_id, r.component_id, r.kept) for r in neardup.neardup_report(df).collect()}
    assert near_ == {(None, 3, False), (None, None, True), (3, 3, True), (5, 5, True), (6, 6, True), (7, 7, True), (8, 5, False)}
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == {3: 1, 5: 1, 6: 1, 7: 1, None: 1}
    bench = spark.createDataFrame([(1, " ".join(near.split()[20:50])), (2, " ".join(long_.split()[30_000:30_020]))], "item_id long, text string")
    clean = decontam.clean(df, bench)
    assert clean.columns == df.columns and Counter(r.doc_id for r in clean.collect()) == {None: 1, 6: 1, 7: 1}
    assert Counter((r.doc_id, r.n_items) for r in decontam.decontamination_report(df, bench).collect()) == {(None, 1): 2, (3, 1): 1, (None, 0): 1, (5, 1): 1, (6, 0): 1, (7, 0): 1, (8, 1): 1}
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and mixed.count() == 8  # one source takes all its words
    good = quality.keep_good(df)
    assert good.columns == df.columns and {r.doc_id for r in good.collect()} >= {None, 3, 7}
    assert Counter((r.doc_id, r.n_removed) for r in substrings.substring_report(df).collect()) == {(3, 0): 1, (None, 90): 2, (None, 0): 1, (5, 0): 1, (6, 0): 1, (7, 0): 1, (8, 60_000): 1}
    scored = lm.lm_report(df).collect()
    assert len(scored) == 8 and not any(r.held_out for r in scored if r.doc_id is None)
    shards = sharding.shard_report(df).collect()
    assert Counter(r.doc_id for r in shards) == Counter(i for i, _ in rows) and {r.merges_due for r in shards} == {0}
    labels = spark.createDataFrame([(3, 1), (7, 0), (None, 1)], "doc_id long, toxic long")
    assert toxicity.toxicity_report(df, labels).count() == 8


# -- pipeline --------------------------------------------------------------------------------


def test_pipeline(spark, docs, small, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality rules", "near-dedup", "decontamination", "mixing", "sharding"]
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    d, sizes = base, [base.count()]
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, d, small).write.parquet(str(tmp_path / str(k)))
        d = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or d.columns == base.columns
        sizes.append(d.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[4] == sizes[5]
    assert P.run(spark, small).count() > 0
