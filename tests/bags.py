"""Relations as Python bags, worked out naively: what changelogs are compared with."""

from collections import Counter, defaultdict


def fold(events):
    out = Counter()
    for row, n in events:
        out[row] += n
        assert out[row] >= 0
    return +out


def joined(left, right, kind, keep=lambda l, r: True):
    out, met_l, met_r = Counter(), set(), set()
    for l, a in left.items():
        for r, b in right.items():
            if l[0] is not None and l[0] == r[0] and keep(l, r):
                met_l.add(l)
                met_r.add(r)
                if kind in ("inner", "left", "right", "full"):
                    out[l + r] += a * b
    for l, a in left.items():
        if kind in ("left", "full") and l not in met_l:
            out[l + (None,) * 2] += a
        if kind == "left_semi" and l in met_l or kind == "left_anti" and l not in met_l:
            out[l] += a
    if kind in ("right", "full"):
        for r, b in right.items():
            if r not in met_r:
                out[(None,) * 2 + r] += b
    return out


def asof(left, right, op):
    ok = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b}[op]
    out = Counter()
    for l, n in left.items():
        near = [r for r in right if None not in (l[0], l[1], r[0], r[1]) and l[0] == r[0] and ok(l[1], r[1])]
        best = max(near, key=lambda r: r[1] if op[0] == ">" else -r[1]) if near else (None,) * 3
        assert sum(r[1] == best[1] for r in near) <= 1
        out[l + best] += n
    return out


def grouped(rows):
    """count, count of value, sum, average, least and greatest value by department."""
    groups = defaultdict(list)
    for (k, v), n in rows.items():
        groups[k] += [v] * n
    out = Counter()
    for k, vs in groups.items():
        known = [v for v in vs if v is not None]
        out[(k, len(vs), len(known), sum(known) if known else None, sum(known) / len(known) if known else None, min(known, default=None), max(known, default=None))] += 1
    return out
