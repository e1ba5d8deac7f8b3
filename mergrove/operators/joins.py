"""Joins of solution sequences.

Two rows are compatible when they agree on every variable that both bind.  Where all shared variables are
certainly bound that is an equi-join, for which the planner picks the strategy.  Certainly bound variables stay
equi-keys when others may be unbound.  If none is certain, pairs of rows are told apart by the set of shared variables
that both bind: for each such set there is an equi-join on it.  Only rows that have no bound variable in common meet
without keys, and of those every pair is a match.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sparql_text import common_vars
from .solution import Solution, fresh

#: Up to so many uncertain variables every set of them has a join of its own; with more, rows that bind them all are
#: joined by equality, and the rest by condition.
MOST_SETS_OF = 4

#: Bytes up to which a side that the caller has flagged as small is sent to all tasks.
MAX_BROADCAST = 256 << 20

INNER, LEFT, SEMI, ANTI = "inner", "left", "left_semi", "left_anti"


def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions) if conditions else F.lit(True)


def align(left: Solution, right: Solution) -> tuple[Solution, Solution, list[str]]:
    """The shared variables, held alike on both sides."""
    shared = common_vars(left.public, right.columns)
    mixed = set()
    for v in shared:
        if (v in left.nt) != (v in right.nt):
            mixed.add(v)
        elif v not in left.nt and type(left.type(v)) is not type(right.type(v)) and {left.type(v).typeName(), right.type(v).typeName()} & {"string", "boolean", "timestamp_ntz", "timestamp", "date", "binary"}:
            mixed.add(v)
    return left.as_nt(frozenset(mixed)), right.as_nt(frozenset(mixed)), shared


def _pairs(left: Solution, right: Solution, shared: list[str]) -> list[tuple[str, Column, Column]]:
    return [(v, F.col(left.columns[v][0]), F.col(c)) for v in shared for c in right.columns[v]]


def _match(left: Solution, right: Solution, shared: list[str], certain: set[str], minus: bool, extra: Column | None) -> Column:
    """The compatibility condition; with ``minus`` also that some shared variable is bound on both sides."""
    same, loose = [], []
    for v, a, b in _pairs(left, right, shared):
        same.append((a == b) if v in certain else (a == b) | a.isNull() | b.isNull())
        loose.append(a.isNotNull() & b.isNotNull())
    out = _all(same)
    if minus and not certain:
        out = out & reduce(lambda x, y: x | y, loose)
    return out if extra is None else out & extra


def _bound(s: Solution, shared: list[str], side: str) -> Column:
    return _all([F.col(c).isNotNull() for v in shared for c in (s.columns[v][:1] if side == "left" else s.columns[v])])


def _small(df: DataFrame) -> bool:
    """Whether a side that a caller calls small is, by Catalyst's estimate; if not (or unknown) the planner decides alone."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= MAX_BROADCAST


def matched(left: Solution, right: Solution, how: str, minus: bool = False, extra: Column | None = None, hint: str = "") -> DataFrame:
    """``left`` joined with ``right`` (both aligned) by compatibility; ``extra`` is a further condition."""
    shared = common_vars(left.public, right.columns)
    right_df = right.df.hint("broadcast") if hint == "right" and _small(right.df) else right.df
    left_df = left.df.hint("broadcast") if hint == "left" and how == INNER and _small(left.df) else left.df
    if not shared:
        if how == INNER and extra is None:
            return left_df.crossJoin(right_df)
        return left_df.join(right_df, F.lit(True) if extra is None else extra, how)
    certain = {v for v in shared if v not in left.maybe and v not in right.maybe}
    if certain:
        return left_df.join(right_df, _match(left, right, shared, certain, minus, extra), how)
    if len(shared) <= MOST_SETS_OF:
        return _by_sets(left, right, shared, how, minus, extra)
    equal = _all([a == b for _, a, b in _pairs(left, right, shared)])
    equal = equal if extra is None else equal & extra
    loose = _match(left, right, shared, set(), minus, extra)
    full_l, full_r = _bound(left, shared, "left"), _bound(right, shared, "right")
    lb, ln = left.df.where(full_l), left.df.where(~full_l)
    rb, rn = right.df.where(full_r), right.df.where(~full_r)
    if how == ANTI:
        return lb.join(rb, equal, ANTI).join(rn, loose, ANTI).union(ln.join(right.df, loose, ANTI))
    if how == SEMI:
        return (
            lb.join(rb, equal, SEMI)
            .union(lb.join(rb, equal, ANTI).join(rn, loose, SEMI))
            .union(ln.join(right.df, loose, SEMI))
        )
    inner = lb.join(rb, equal, INNER).union(lb.join(rn, loose, INNER)).union(ln.join(right.df, loose, INNER))
    if how == INNER:
        return inner
    return inner.union(_padded(matched(left, right, ANTI, minus, extra), right))


def _padded(alone: DataFrame, right: Solution) -> DataFrame:
    """Left rows without a match, beside an unbound right side."""
    return alone.select(*alone.columns, *[F.lit(None).cast(right.df.schema[c].dataType).alias(c) for c in right.df.columns])


def _by_sets(left: Solution, right: Solution, shared: list[str], how: str, minus: bool, extra: Column | None) -> DataFrame:
    """The join as one for each set of variables that a pair of rows has in common; a pair has just one such set."""
    sets = [c for k in range(len(shared), -1, -1) for c in combinations(shared, k)]
    own = {v: F.col(left.columns[v][0]) for v in shared}
    theirs = {v: [F.col(c) for c in right.columns[v]] for v in shared}
    more = [] if extra is None else [extra]
    common = []
    for chosen in sets[:-1]:
        test = list(more)
        for v in shared:
            a, bs = own[v], theirs[v]
            if v not in chosen:
                test.append(a.isNull() | _all([b.isNull() for b in bs]))
            elif len(bs) == 1:
                test.append(a == bs[0])
            else:  # hidden uses: the first that is bound is the key, the others agree or are unbound
                test += [a == F.coalesce(*bs), *[(a == b) | b.isNull() for b in bs]]
        common.append(_all(test))
    # a left row that binds just ``chosen`` has nothing in common with right rows that bind none of it
    apart = []
    for chosen in [] if minus else sets:
        mine = _all([own[v].isNotNull() if v in chosen else own[v].isNull() for v in shared])
        apart.append((mine, right.df.where(_all([b.isNull() for v in chosen for b in theirs[v]]))))
    if how in (INNER, LEFT):
        parts = [left.df.join(right.df, test, INNER) for test in common]
        parts += [left.df.where(mine).crossJoin(others) if extra is None else left.df.where(mine).join(others, extra, INNER) for mine, others in apart]
        parts += [_padded(_by_sets(left, right, shared, ANTI, minus, extra), right)] if how == LEFT else []
        return reduce(DataFrame.union, parts)
    found, rest = [], left.df
    tests = [(test, right.df) for test in common]
    tests += [(mine, others.limit(1)) if extra is None else (mine & extra, others) for mine, others in apart]  # any partner will do
    for test, others in tests:
        found.append(rest.join(others, test, SEMI))
        rest = rest.join(others, test, ANTI)
    return rest if how == ANTI else reduce(DataFrame.union, found)


def join(left: Solution, right: Solution, how: str = INNER, extra: Column | None = None, hint: str = "") -> Solution:
    """Join or OPTIONAL: left's variables, then right's others.  Expects aligned sides."""
    shared = common_vars(left.public, right.columns)
    df = matched(left, right, how, extra=extra, hint=hint)
    columns, out, done = dict(left.columns), [], set()
    maybe = set(left.maybe)
    for v in shared:
        if v in left.maybe and v in right.public:
            # an unbound left variable takes the value that the right shows
            new = fresh(v)
            out.append(F.coalesce(F.col(left.columns[v][0]), F.col(right.columns[v][0])).alias(new))
            columns[v] = (new, *left.columns[v][1:])
            if how == INNER and v not in right.maybe:
                maybe.discard(v)
        done.update(right.columns[v])
    for v, cs in right.columns.items():
        if v not in shared:
            public_right = v in right.public
            columns[v] = (*cs, *columns.get(v, ())) if public_right else (*columns.get(v, ()), *cs)
            if v in right.maybe or how == LEFT:
                maybe.add(v)
    public = tuple(dict.fromkeys((*left.public, *right.public)))
    used = list(dict.fromkeys(c for cs in columns.values() for c in cs if c in df.columns))
    df = df.select(*used, *out)
    return Solution(df, public, columns, frozenset(maybe), left.nt | right.nt)


def exists(left: Solution, right: Solution, negate: bool = False, extra: Column | None = None, hint: str = "") -> Solution:
    """Left rows with (``negate``: without) a compatible right row."""
    df = matched(left, right, ANTI if negate else SEMI, extra=extra, hint=hint)
    return Solution(df, left.public, left.columns, left.maybe, left.nt)


def minus(left: Solution, right: Solution, extra: Column | None = None, hint: str = "") -> Solution:
    """Left rows that no right row with a common bound variable agrees with; left itself if no variable is shared."""
    if not common_vars(left.public, right.columns):
        return left
    df = matched(left, right, ANTI, minus=True, extra=extra, hint=hint)
    return Solution(df, left.public, left.columns, left.maybe, left.nt)
