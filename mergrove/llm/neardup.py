"""Embedding near-duplicates: an exact metric range join.

On the unit sphere cosine >= c is Euclidean distance <= r with r = sqrt(2 - 2c).  Pivots cut the sphere into cells
(a vector's home is its nearest pivot).  A partner of x within r can only live in the cell of pivot q if
  - triangle inequality: d(x, q) - d(x, p) <= 2r, where p is x's own pivot;
  - d(x, q) <= radius of the cell of q + r;
  - x lies no farther than r beyond the plane between p and q: (d(x, q)^2 - d(x, p)^2) / 2 d(p, q) <= r.
x is copied to such cells (of lower number, so that each pair meets once), and cells join independently.  A cell's
members are dealt into chunks and its pairs of chunks are separate tasks, so a cell may be of any size.

Equal vectors are one class with a multiplicity; a task returns numbers of links and a spanning forest of them,
never pairs.  The number of pivots grows with that of the vectors, as far as a table of ``pivot_bytes`` holds them; every
task has that table.  Vectors without any structure lie within r of most cell borders; the join then compares all chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import take, written
from .components import components


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision; scaled first, so that no square overflows or vanishes."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def linked(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (unit) have at least that cosine: single precision decides unless it is close."""
    near = a.astype(np.float32) @ b.astype(np.float32).T
    margin = 1e-6 * a.shape[1] + 1e-5
    out = near >= cosine + margin
    for i, j in zip(*np.nonzero(np.abs(near - cosine) < margin)):
        out[i, j] = float(a[i] @ b[j]) >= cosine
    return out


def block_links(a: np.ndarray, b: np.ndarray, mass_a: np.ndarray, mass_b: np.ndarray, same: bool, cosine: float, step: int = 1024):
    """Links between two chunks (``same``: within one): how many each row has, by mass of the partner, and a spanning
    forest as pairs of row numbers, those of ``b`` counted on from those of ``a``."""
    n = len(a)
    count_a, count_b = np.zeros(n, np.int64), np.zeros(len(b), np.int64)
    label = np.arange(n if same else n + len(b))
    base = 0 if same else n
    edges = []
    for at in range(0, n, step):
        hit = linked(a[at : at + step], b, cosine)
        if same:
            hit[np.arange(hit.shape[0]), at + np.arange(hit.shape[0])] = False
        for i in np.flatnonzero(hit.any(1)):
            js = np.flatnonzero(hit[i])
            count_a[at + i] += mass_b[js].sum()
            if not same:
                count_b[js] += mass_a[at + i]
            groups, first = np.unique(label[base + js], return_index=True)
            for g, k in zip(groups, first):
                own = label[at + i]
                if g != own:
                    edges.append((at + i, base + js[k]))
                    label[label == max(g, own)] = min(g, own)
    return count_a, count_b, edges


def _pivots(classes: DataFrame, wanted: int, spread: int = 1024) -> np.ndarray:
    """Pivots from a bounded sample by hash: the first ``spread`` each farthest from those before, further ones as they come."""
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(max(wanted, 8 * min(wanted, spread))).select("vec").toArrow()["vec"].combine_chunks()
    points = unit(sample.flatten().to_numpy().reshape(len(sample), -1))
    chosen = [0]
    far = 2 - 2 * points @ points[0]
    while len(chosen) < min(wanted, spread, len(points)):
        k = int(far.argmax())
        if far[k] <= 1e-12:
            break
        chosen.append(k)
        far = np.minimum(far, 2 - 2 * points @ points[k])
    more = np.setdiff1d(np.arange(len(points)), chosen)[: wanted - len(chosen)] if wanted > spread else []
    return points[[*chosen, *more]]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95,
                    cell_rows: int = 4096, chunk_rows: int = 4096, pivot_bytes: int = 32 << 20) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row.

    ``n_links``: other rows linked directly; ``component_id``: smallest id reachable over links; ``kept``: whether
    that is the row's own.  Vectors that are null, empty, zero or hold null or non-finite components, and vectors of
    other lengths than a row's own, link with nothing.  Rows with a null id take no part: no links, null
    component, not kept.  Repeated rows count as separate vectors.  An empty table gives none.
    """
    rows = take(vectors, id=id_col, vec=vector_col)
    # single precision moves as it came; all arithmetic is in double
    element = "float" if rows.schema["vec"].dataType.simpleString() == "array<float>" else "double"
    rows = rows.select("id", F.col("vec").cast(f"array<{element}>").alias("vec"))
    usable = (
        F.col("id").isNotNull() & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    )
    rows = rows.select("id", F.when(F.coalesce(usable, F.lit(False)), F.col("vec")).alias("vec"))
    kind = rows.schema["id"].dataType.simpleString()
    classes = written(rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("mass")), "classes")
    lengths = [r.n for r in classes.select(F.size("vec").alias("n")).distinct().limit(1001).collect()]
    if len(lengths) > 1000:
        raise ValueError("more than 1000 different lengths of vectors")
    counts, edges = None, None
    for n in sorted(lengths):
        own = classes.where(F.size("vec") == n) if len(lengths) > 1 else classes
        c, e = _range_join(own, kind, element, cosine, cell_rows, chunk_rows, max(1, pivot_bytes // (8 * n)))
        counts, edges = (c, e) if counts is None else (counts.union(c), edges.union(e))
    if counts is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = components(edges)
    total = counts.groupBy("rep").agg(F.sum("n").alias("n"))
    info = (
        classes.join(total.withColumnRenamed("rep", "r1"), F.col("rep") == F.col("r1"), "left")
        .join(found, F.col("rep") == F.col("node"), "left")
        .select("vec", (F.col("mass") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    info = written(info, "info").withColumnRenamed("vec", "v")
    joined = rows.join(info, F.col("vec") == F.col("v"), "left")
    component = F.coalesce("component", "id")
    return joined.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _range_join(classes: DataFrame, kind: str, element: str, cosine: float, cell_rows: int, chunk_rows: int, max_pivots: int) -> tuple[DataFrame, DataFrame]:
    """``(rep, n)`` and ``(a, b)`` for ``classes(vec, rep, mass)`` of one length."""
    radius = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    n = classes.count()
    pivots = _pivots(classes, int(min(max_pivots, max(1, -(-n // cell_rows)))))
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-12))

    def near(vec: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = unit(vec.flatten().to_numpy().reshape(len(vec), -1))
        square = np.maximum(2 - 2 * x @ pivots.T, 0)
        return square, square.argmin(1)

    step = max(1, 4_000_000 // len(pivots))
    small = lambda batches: (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.full(len(pivots), -1.0)
        for b in small(batches):
            if b.num_rows:
                square, home = near(b.column(0))
                np.maximum.at(far, home, np.sqrt(square[np.arange(len(home)), home]))
        at = np.flatnonzero(far >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(far[at])], ["cell", "far"])

    size = np.zeros(len(pivots))
    for r in classes.select("vec").mapInArrow(measure, "cell int, far double").groupBy("cell").agg(F.max("far").alias("far")).collect():
        size[r.cell] = r.far

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            square, home = near(b.column(0))
            d = np.sqrt(square)
            mine = d[np.arange(len(home)), home][:, None]
            reach = (d - mine <= 2 * radius) & (d <= size + radius) & ((square - mine**2) / (2 * between[home]) <= radius)
            reach &= np.arange(len(pivots)) < home[:, None]
            away = pa.array([np.flatnonzero(x).tolist() for x in reach], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32)), away], ["vec", "rep", "mass", "home", "away"])

    placed = written(classes.select("vec", "rep", "mass").mapInArrow(assign, f"vec array<{element}>, rep {kind}, mass long, home int, away array<int>"), "placed")
    members = placed.select("vec", "rep", "mass", F.col("home").alias("cell"), F.lit(True).alias("own")).union(
        placed.select("vec", "rep", "mass", F.explode("away").alias("cell"), F.lit(False).alias("own")))
    chunks = lambda test: F.ceil(F.sum(test.cast("int")) / chunk_rows).cast("int")
    table = F.broadcast(members.groupBy("cell").agg(chunks(F.col("own")).alias("x"), chunks(~F.col("own")).alias("y")))  # a row a pivot, which all tasks have anyway
    dealt = members.join(table, "cell").where("x > 0")
    mod = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    dealt = dealt.withColumn("chunk", F.when(F.col("own"), mod(F.col("x"))).otherwise(F.col("x") + mod(F.greatest("y", F.lit(1)))))
    # chunk c meets the owned chunks up to c as the second, and if owned all later ones as the first
    last = F.when(F.col("own"), F.col("x") + F.col("y")).otherwise(F.col("x"))
    pairs = dealt.select("cell", "chunk", "vec", "rep", "mass", F.explode(F.sequence(F.lit(0), last - 1)).alias("other"))
    blocks = pairs.select("cell", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "vec", "rep", "mass")
    def solve(table: pa.Table) -> pa.Table:
        first = np.asarray(table["chunk"]) == table["lo"][0].as_py()
        same = table["lo"][0] == table["hi"][0]
        ids = table["rep"].to_numpy(zero_copy_only=False)
        mass = np.asarray(table["mass"])
        width = len(table["vec"][0])
        x = unit(np.asarray(table["vec"].combine_chunks().flatten()).reshape(-1, width))
        a, b = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
        out = [[], [], [], []]
        if len(a) and len(b):
            count_a, count_b, edges = block_links(x[a], x[b], mass[a], mass[b], same, cosine)
            both = np.r_[a, b] if not same else a
            for rows, count in ((a, count_a), (b, count_b)):
                some = np.flatnonzero(count)
                out[0] += ids[rows[some]].tolist()
                out[1] += count[some].tolist()
                out[2] += [None] * len(some)
            out[0] += [ids[both[i]] for i, _ in edges]
            out[1] += [0] * len(edges)
            out[2] += [ids[both[j]] for _, j in edges]
        arrow = table.schema.field("rep").type
        return pa.table({"rep": pa.array(out[0], arrow), "n": pa.array(out[1], pa.int64()), "other": pa.array(out[2], arrow)})

    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * len(pivots))
    found = written(blocks.repartition(parts, "cell", "lo", "hi").groupBy("cell", "lo", "hi").applyInArrow(solve, f"rep {kind}, n long, other {kind}"), "links")
    return found.where("n > 0").select("rep", "n"), found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))
