"""A plain Python evaluator of the algebra: rows are dicts, an unbound variable is None or absent."""

from collections import Counter


def compatible(a, b):
    return all(a.get(v) is None or b.get(v) is None or a[v] == b[v] for v in a.keys() & b.keys())


def merged(a, b):
    return {v: a.get(v) if a.get(v) is not None else b.get(v) for v in {**a, **b}}


def join(left, right):
    return [merged(a, b) for a in left for b in right if compatible(a, b)]


def left_join(left, right, names):
    out = []
    for a in left:
        found = [merged(a, b) for b in right if compatible(a, b)]
        out += found or [{**dict.fromkeys(names), **a}]
    return out


def exists(left, right, negate=False):
    return [a for a in left if any(compatible(a, b) for b in right) != negate]


def minus(left, right):
    shares = lambda a, b: any(a.get(v) is not None and b.get(v) is not None for v in a.keys() & b.keys())
    return [a for a in left if not any(compatible(a, b) and shares(a, b) for b in right)]


def bag(rows, names):
    return Counter(tuple(r.get(v) for v in names) for r in rows)


def merge(*inputs, names):
    out = Counter()
    for rows in inputs:
        out |= bag(rows, names)
    return out
