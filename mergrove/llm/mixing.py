"""Mixing sources to target weights by Pfair scheduling.

Each source's rows form blocks.  With ``w`` a source's share of all weights, block ``j`` (from 1) may not run before its
release ``floor((j - 1) / w)`` and must run before its deadline ``ceil(j / w)``; each slot runs the released block with
the earliest deadline.  Then after any number of slots ``t`` a source has run more than ``w * t - 1`` and fewer than
``w * t + 1`` blocks for as long as it lasts.  Shares are exact fractions of the weights given, not rounded to any frame,
so the bound holds at every length.  No row is dropped or repeated: when a source has run out, its slots stay empty and
the others keep their shares of each other.

The schedule is cut into segments that tasks work out independently.  Where one ends at slot ``t``, each source has at
most one block whose window spans ``t``; :func:`crossing` picks those that run before it, so that both sides can keep all
deadlines.  (A whole Pfair schedule does exist, so such a choice does.)  Within a segment the rule is earliest
deadline first, which keeps the deadlines of any set of blocks for which that is possible.

Rows are numbered within their source without gathering a source anywhere: a digest of the key deals them into
ranges, the ranges are counted, and each range is sorted by itself.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import written


def whole(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the ratios of the weights (floats count for the binary fractions they are)."""
    if any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("weights are positive and finite")
    exact = {n: Fraction(w) for n, w in weights.items()}
    scale = math.lcm(*(f.denominator for f in exact.values()))
    out = {n: int(f * scale) for n, f in exact.items()}
    common = math.gcd(*out.values())
    return {n: w // common for n, w in out.items()}


def temperature(counts: Mapping[str, int], alpha: float = 0.5) -> dict[str, float]:
    """Weights between natural (1) and equal (0) shares."""
    return {n: math.sqrt(c) if alpha == 0.5 else float(c) ** alpha for n, c in counts.items()}


def window(j: int, w: int, total: int) -> tuple[int, int]:
    """Release and deadline of block ``j`` of a source with ``w`` of ``total`` shares."""
    return (j - 1) * total // w, -(-j * total // w)


def longest(weights: Mapping[str, int]) -> int:
    """The length in slots that no window exceeds."""
    return sum(weights.values()) // min(weights.values(), default=1) + 2


def crossing(weights: list[int], t: int) -> set[int]:
    """Of the sources with a block whose window spans slot ``t``, those that run it before ``t``.

    For every b > t, the blocks that must run in [t, b) are no more than its slots; for every a < t, those that must
    run in [a, t) neither.  Both kinds of demand are nested, so a greedy choice meets them: as deadlines
    come, take what each demands from the earliest releases, then fill up with the earliest releases.
    """
    total = sum(weights)
    done = [w * t // total for w in weights]
    spanning = [(i, *window(done[i] + 1, w, total)) for i, w in enumerate(weights) if w * t % total]
    free = t - sum(done)
    chosen: set[int] = set()
    ready: list[tuple[int, int]] = []
    spanning.sort(key=lambda x: (x[2], x[0]))
    for at, (i, release, deadline) in enumerate(spanning):
        heapq.heappush(ready, (release, i))
        if at + 1 < len(spanning) and spanning[at + 1][2] == deadline:
            continue
        # blocks that must run between t and this deadline, those chosen so far left out
        due = sum(max(0, w * deadline // total - d - (k in chosen)) for k, (w, d) in enumerate(zip(weights, done)))
        for _ in range(due - (deadline - t)):
            chosen.add(heapq.heappop(ready)[1])
    for _ in range(free - len(chosen)):
        chosen.add(heapq.heappop(ready)[1])
    return chosen


def schedule(weights: Mapping[str, int], blocks: Mapping[str, int], start: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int, int, int]]:
    """``(source, block, release, deadline, slot)`` of the blocks that run in slots from ``start`` to ``end`` (None: all
    that are left): earliest deadline first among the released, ties by name.  Blocks beyond a source's number leave
    their slots empty.  Segments that are to fit together are no shorter than :func:`longest`."""
    names = sorted(weights)
    w = [weights[n] for n in names]
    total = sum(w)

    def done(t: int) -> list[int]:
        early = crossing(w, t)
        return [x * t // total + (i in early) for i, x in enumerate(w)]

    first = done(start)
    last = [blocks[n] for n in names]
    if end is not None:
        last = [min(a, b) for a, b in zip(last, done(end))]
    waiting = [(window(first[i] + 1, w[i], total)[0], i, first[i] + 1) for i in range(len(names)) if first[i] < last[i]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    t = start
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window(j, w[i], total)[1], i, j))
        deadline, i, j = heapq.heappop(ready)
        if t >= (deadline if end is None else min(deadline, end)):
            raise AssertionError(f"block {j} of {names[i]} missed its deadline")
        yield names[i], j, window(j, w[i], total)[0], deadline, t
        if j < last[i]:
            heapq.heappush(waiting, (window(j + 1, w[i], total)[0], i, j + 1))
        t += 1


def slots(spark, weights: Mapping[str, int], blocks: Mapping[str, int], segment: int) -> DataFrame:
    """``(s, block, release, deadline, slot)``: the whole schedule, segment by segment in parallel.

    A segment has about ``segment`` blocks, however many of its slots are empty, and is no shorter than the longest
    window, so that no window spans two cuts.
    """
    total = sum(weights.values())
    length = max((window(blocks[n], w, total)[1] for n, w in weights.items()), default=0)
    step = max(-(-length // max(1, sum(blocks.values()) // segment)), longest(weights), 1)
    n = max(1, -(-length // step))
    shared = spark.sparkContext.broadcast((dict(weights), dict(blocks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s", "block", "release", "deadline", "slot"]
        kinds = [pa.string(), *[pa.int64()] * 4]
        for b in batches:
            for k in b.column(0).to_pylist():
                found = schedule(*shared.value, k * step, (k + 1) * step if (k + 1) * step < length else None)
                while some := list(islice(found, 1 << 16)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some), kinds)], names)

    return spark.range(0, n, 1, min(n, max(1, n // 4), 4096)).mapInArrow(run, "s string, block long, release long, deadline long, slot long")


def order_key(key: Column, row: Column) -> Column:
    """The order of rows within a source: a digest of the key (without one, of the row), which is as good as shuffled and the same in every run."""
    return F.md5(F.coalesce(key.cast("string"), row.cast("string"), F.lit("")))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, key_col: str = "doc_id", source_col: str = "source", block: int = 16,
        alpha: float = 0.5, range_rows: int = 4096, segment: int = 4096, max_sources: int = 100_000, names: tuple[str, ...] = ("block", "release", "deadline", "slot")) -> DataFrame:
    """``docs`` with four more columns: the row's block in its source (from 1), release, deadline and slot.

    ``weights`` gives each source's target weight; sources without one get the least given (no weights at all:
    ``count ** alpha``).  Sorting by slot gives the mixture.  Null sources form one source; rows with equal keys
    fall in any order next to each other, null keys go by the row's content; ``names`` are the added columns, before
    which input columns of that name stay as they are; an empty table gives an empty one.  More than ``max_sources``
    sources are refused, as their counts are held on the driver.
    """
    spark = docs.sparkSession
    cols = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    key, source = F.col(f"c{cols.index(key_col)}"), F.coalesce(F.col(f"c{cols.index(source_col)}").cast("string"), F.lit(""))
    per_source = plain.groupBy(source.alias("s")).agg(F.count("*").alias("n"))
    counts = {r.s: r.n for r in per_source.limit(max_sources + 1).collect()}
    if len(counts) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    least = min(weights.values()) if weights else 0
    given = {n: weights.get(n, least) for n in counts} if weights else temperature(counts, alpha)
    exact = whole(given) if given else {}
    table = slots(spark, exact, {n: -(-c // block) for n, c in counts.items()}, segment)
    # ranges of the digest, as many as keep a range of the largest source near range_rows
    digits = max(1, math.ceil(math.log(max([1, *counts.values()]) / range_rows, 16))) if counts else 1
    rows = plain.withColumn("s", source).withColumn("o", order_key(key, _content(plain))).withColumn("r", F.substring("o", 1, digits))
    before = Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("s", "r").agg(F.count("*").alias("n")).select("s", "r", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # each range gets the windows and slots of the blocks it has rows of; a block may end in the next range
    low, high = F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("n") - 1) / block)
    wanted = ranges.select("s", "r", "first", low.alias("low"), F.explode(F.sequence(low + 1, high + 1)).alias("block"))
    cells = F.array_sort(F.collect_list(F.struct("block", "release", "deadline", "slot"))).alias("cells")
    ranges = written(wanted.join(table, ["s", "block"]).groupBy("s", "r", "first", "low").agg(cells), "ranges")
    place = F.row_number().over(Window.partitionBy("s", "r").orderBy("o", key)) - 1
    numbered = rows.withColumn("i", place).join(ranges.withColumnsRenamed({"s": "s2", "r": "r2"}), (F.col("s") == F.col("s2")) & (F.col("r") == F.col("r2")))
    cell = F.get("cells", (F.floor((F.col("first") + F.col("i")) / block) - F.col("low")).cast("int"))
    placed = numbered.select(*[f"c{i}" for i in range(len(cols))], cell.alias("cell"))
    return placed.select(*[f"c{i}" for i in range(len(cols))], "cell.block", "cell.release", "cell.deadline", "cell.slot").toDF(*cols, *names)


def _content(plain: DataFrame) -> Column:
    """A hash of all of a row that can be hashed."""
    return F.xxhash64(*[F.col(f.name) for f in plain.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()] or [F.lit(0)])


def in_order(docs: DataFrame, partitions: int, **options) -> DataFrame:
    """The rows and columns of ``docs``, range-partitioned and sorted so that the files written from it, one after
    the other, are the mixture.

    Rows with null sources, ids or texts and repeated rows have their places like any other; columns of any names pass
    through; an empty table gives an empty one.
    """
    cols = docs.columns
    at = cols.index(options.get("key_col", "doc_id"))
    mixed = mix(docs, **options)
    plain = mixed.toDF(*[f"c{i}" for i in range(len(mixed.columns))])
    keys = [f"c{len(cols) + 3}", F.md5(F.coalesce(F.col(f"c{at}").cast("string"), F.lit("")))]
    spread = plain.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    return spread.select(*[f"c{i}" for i in range(len(cols))]).toDF(*cols)
