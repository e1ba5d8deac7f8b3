"""Union, Merge and Distinct of solution sequences."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sparql_text import merge_vars
from .solution import Solution, fresh


def _aligned(inputs: list[Solution], needed: frozenset[str]) -> tuple[list[DataFrame], Solution]:
    """Each input with the columns of all, by name, and the solution that their union will be."""
    public = tuple(merge_vars(*[s.public for s in inputs]))
    names = [*public, *[v for v in merge_vars(*[list(s.columns) for s in inputs]) if v in needed and v not in public]]
    types = lambda v: {s.type(v).simpleString() for s in inputs if s.has(v) and v not in s.nt}
    wide = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    mixed = frozenset(v for v in names if any(v in s.nt for s in inputs if s.has(v)) or (len(types(v)) > 1 and not types(v) <= wide))
    inputs = [s.as_nt(mixed & frozenset(s.columns)) for s in inputs]
    columns = {v: (fresh(v),) for v in names}
    frames = []
    for s in inputs:
        kind = {v: next(o.type(v) for o in inputs if o.has(v)) for v in names}
        frames.append(s.df.select(*[(s.col(v) if s.has(v) else F.lit(None).cast(kind[v])).alias(columns[v][0]) for v in names]))
    maybe = frozenset(v for v in names if any(not s.has(v) or v in s.maybe for s in inputs))
    return frames, Solution(frames[0], public, columns, maybe, mixed)


def _with(s: Solution, df: DataFrame) -> Solution:
    return Solution(df, s.public, s.columns, s.maybe, s.nt)


def union(inputs: list[Solution], needed: frozenset[str] = frozenset()) -> Solution:
    """All rows of all inputs, variables matched by name."""
    frames, out = _aligned(inputs, needed)
    return _with(out, reduce(DataFrame.union, frames))


#: Up to so many inputs Merge counts side by side.
MOST_COUNTS = 16
#: Copies of a row are made in runs of so many, so that no array holds more.
RUN = 4096


def _copies(df: DataFrame, n: str) -> DataFrame:
    """Each row ``n`` times: first one row a run, then the runs' own copies."""
    run, k = fresh("run"), fresh("k")
    runs = df.withColumn(run, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / RUN))))
    return runs.withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(RUN).cast("long"), F.col(n) - F.col(run) * RUN)))).drop(run, k, n)


def merge(inputs: list[Solution], needed: frozenset[str] = frozenset()) -> Solution:
    """Each row as often as in the input that has it most often: counts per input, then their maximum, then copies.

    Counting is map-side combined, so a row repeated any number of times moves once a task.
    """
    frames, out = _aligned(inputs, needed)
    names = [c for cs in out.columns.values() for c in cs]
    src, n = fresh("src"), fresh("n")
    if not names:
        counts = reduce(DataFrame.union, [f.agg(F.count("*").alias(n)) for f in frames]).agg(F.max(n).alias(n))
        return _with(out, _copies(counts.where(F.col(n) > 0), n))
    tagged = reduce(DataFrame.union, [f.withColumn(src, F.lit(i)) for i, f in enumerate(frames)])
    if len(frames) <= MOST_COUNTS:  # a count for each input, in one exchange
        each = [fresh("n") for _ in frames]
        counts = tagged.groupBy(*names).agg(*[F.count_if(F.col(src) == i).alias(c) for i, c in enumerate(each)])
        counts = counts.select(*names, (F.greatest(*each) if len(each) > 1 else F.col(each[0])).alias(n))
    else:
        counts = tagged.groupBy(*names, src).agg(F.count("*").alias(n)).groupBy(*names).agg(F.max(n).alias(n))
    return _with(out, _copies(counts, n))


def distinct(s: Solution) -> Solution:
    """No row twice, hidden columns included (a join above may tell such rows apart)."""
    return _with(s, s.df.distinct() if s.df.columns else s.df.limit(1))


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its first equal in the batch; and those firsts."""
    codes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        try:
            own = column.dictionary_encode("encode").indices.to_numpy()
        except pa.ArrowNotImplementedError:  # nested values
            met: dict = {}
            own = np.array([met.setdefault(repr(x), len(met)) for x in column.to_pylist()])
        codes = np.unique(codes * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    _, first, at = np.unique(codes, return_index=True, return_inverse=True)
    return first[at], np.sort(first)


def windowed_distinct(s: Solution, window: int) -> Solution:
    """Drops a row equal to one of the last ``window`` rows kept before it in its partition; bounded memory, no shuffle.

    Rows are numbered column by column; only rows that a batch has not shown yet are looked at one by one.  While
    nothing leaves the window, what a batch keeps is its rows' first showings that the window lacks.
    """
    schema = s.df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: deque = deque()
        seen: set = set()
        for batch in batches:
            equal, firsts = _numbers(batch)
            rows = list(zip(*[c.take(pa.array(firsts)).to_pylist() for c in batch.columns]))
            value = dict(zip(firsts.tolist(), map(repr, rows)))
            keep = np.zeros(batch.num_rows, bool)
            new = [i for i, x in value.items() if x not in seen]
            if len(order) + len(new) <= window:
                keep[new] = True
                order.extend(value[i] for i in new)
                seen.update(value[i] for i in new)
            else:
                for i, first in enumerate(equal.tolist()):
                    x = value[first]
                    if x not in seen:
                        keep[i] = True
                        if len(order) == window:
                            seen.discard(order.popleft())
                        order.append(x)
                        seen.add(x)
            yield batch.filter(pa.array(keep))

    if not schema.fields:
        return _with(s, s.df.limit(1))
    return _with(s, s.df.mapInArrow(run, schema))
