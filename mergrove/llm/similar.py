"""Near-duplicate texts: candidates by SimHash and BK-trees, decided by the Jaccard similarity of their shingle sets.

Similar texts have fingerprints some way apart: at a similarity of exactly 0.8 each bit differs with a chance of 0.15, so
that about ten of 64 do, and more than 20 in 3 of 10,000 cases (of texts unlike each other: no more than 20 in 2 of 1,000).  No blocks of
bits are then both short enough to agree on and long enough to tell texts apart, so texts are dealt to shards by what they
share.  In any fixed order of all shingles, two sets that similar have one in common among the first
``n - ceil(similarity * n) + 1`` of each; each such shingle is a shard.  Shingles that a sample finds common come last in
the order, so that they key few texts; those that still key many are dealt into several trees.

  1. In each shard a BK-tree over the fingerprints finds those within ``radius``.  What a task returns is a spanning
     forest of them, however dense they are; what the forests of all shards connect is a cluster of candidates.
  2. Clusters, and they alone, get their texts' whole sets, again in chunks that meet in pairs.  The tree's candidates
     are compared set by set where they are not yet connected, and again a spanning forest comes back.

So a group of copies of any size is never written out as pairs.  Equal sets are one node throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, input_bytes, parts_for, release, run_bounds, take, whole_runs, written
from .components import components
from .simhash import SEED, majority, near, shingle_hashes


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted hashes of a text's distinct ``width``-word shingles; a shorter text is one shingle, an empty one none."""
    return np.unique(shingle_hashes(text, width))


def node(found: np.ndarray) -> int:
    """The name of a shingle set: a signed hash of all of it."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def _small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def _common(rows: DataFrame, width: int, sample_bytes: int, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, and how many of all texts may; it has at most about ``sample_bytes`` of text."""
    fraction = min(1.0, sample_bytes / max(1, input_bytes(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            found = [shingles(t.as_py(), width) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["key"])

    held = rows.select("text").sample(fraction, 1).mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n"))
    got = held.where(F.col("n") >= least).select("key", "n").toArrow()
    keys = got["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], (got["n"].to_numpy()[order] / fraction).astype(np.int64)


class Union:
    """Groups of numbers, joined as links are found."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.root(x), self.root(y)
        self.parent[x] = y
        return x != y


def _near_pairs(prints: np.ndarray, first: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, int]]:
    """For texts of a shard: one of them and those within ``radius`` of it.  ``first`` marks a chunk that only meets the rest."""
    tree = np.arange(len(prints)) if first is None else np.flatnonzero(first)
    ask = tree if first is None else np.flatnonzero(~first)
    for asked, k in near(prints[tree], prints[ask], radius):
        yield ask[asked], int(tree[k])


def _fit(a, b, similarity: Fraction):
    """Whether sets of these sizes can be similar."""
    return np.minimum(a, b) * similarity.denominator >= np.maximum(a, b) * similarity.numerator


def candidates(sets: DataFrame, similarity: Fraction, radius: int, parts: int) -> DataFrame:
    """``(a, b)``: a spanning forest of each shard's near fingerprints of like sizes, from ``sets(node, fp, n, keys, trees)``."""
    entries = sets.select("node", "fp", "n", F.posexplode("keys").alias("at", "key"), "trees")
    entries = entries.select("key", F.get("trees", F.col("at")).cast("int").alias("trees"), "node", "fp", "n").withColumn("own", F.pmod(F.xxhash64("node"), F.col("trees")).cast("int"))
    # chunk c meets chunks 0..c: each two meet once
    dealt = entries.select("key", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("other"), "own", "node", "fp", "n")
    rows = dealt.select("key", F.greatest("own", "other").alias("hi"), F.least("own", "other").alias("lo"), "own", "node", "fp", "n")
    rows = rows.repartition(parts, "key", "hi", "lo").sortWithinPartitions("key", "hi", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, 3):
            key, hi, lo, own, names, fp, size = (c.to_numpy() for c in table.columns)
            size = size.astype(np.int64)
            prints, a, b = fp.view(np.uint64), [], []
            for s, e in run_bounds([key, hi, lo]):
                if e - s == 2 and hi[s] == lo[s]:
                    if names[s] != names[s + 1] and _fit(size[s], size[s + 1], similarity) and int(prints[s] ^ prints[s + 1]).bit_count() <= radius:
                        a.append(int(names[s]))
                        b.append(int(names[s + 1]))
                elif e - s > 1:
                    groups, mine = Union(), names[s:e].tolist()
                    for asked, k in _near_pairs(prints[s:e], None if hi[s] == lo[s] else own[s:e] == hi[s], radius):
                        for other in asked[_fit(size[s + asked], size[s + k], similarity)].tolist():
                            if groups.join(other, k):
                                a.append(mine[other])
                                b.append(mine[k])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(sets: DataFrame, similarity: Fraction, radius: int, parts: int, chunk_shingles: int) -> DataFrame:
    """``(a, b)``: links that span each group of similar sets, from ``sets(cluster, node, fp, keys)``."""
    num, den = similarity.numerator, similarity.denominator
    sizes = sets.groupBy("cluster").agg(F.ceil(F.sum(F.size("keys")) / chunk_shingles).cast("int").alias("chunks")).where("chunks > 1")
    sizes = written(sizes, "sizes")  # a table of its own, so that the join may be split where a cluster is large
    rows = sets.join(sizes, "cluster", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.select("cluster", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"), "own", "node", "fp", "keys")
    rows = rows.select("cluster", F.greatest("own", "other").alias("hi"), F.least("own", "other").alias("lo"), "own", "node", "fp", "keys")
    rows = rows.repartition(parts, "cluster", "hi", "lo").sortWithinPartitions("cluster", "hi", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, 3):
            cluster, hi, lo, own, names, fp = (c.to_numpy() for c in table.columns[:6])
            held = table.column("keys").combine_chunks()
            held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
            ends, flat = held.offsets.to_numpy(), held.values.to_numpy().view(np.uint64)
            size = np.diff(ends).astype(np.int64)
            a, b = [], []
            for s, e in run_bounds([cluster, hi, lo]):
                groups = Union()
                for asked, k in _near_pairs(fp[s:e].view(np.uint64), None if hi[s] == lo[s] else own[s:e] == hi[s], radius):
                    whole = flat[ends[s + k] : ends[s + k + 1]]
                    n = size[s + k]
                    fits = asked[_fit(size[s + asked], n, similarity) & (asked != k)]
                    for other in fits.tolist():
                        if groups.root(other) == groups.root(k):
                            continue
                        theirs = flat[ends[s + other] : ends[s + other + 1]]
                        at = np.searchsorted(whole, theirs)
                        both = int((whole[np.minimum(at, n - 1)] == theirs).sum()) if n else 0
                        if both * (num + den) >= (int(n) + len(theirs)) * num:
                            groups.join(other, k)
                            a.append(int(names[s + other]))
                            b.append(int(names[s + k]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 20,
                tree_size: int = 2048, sample_bytes: int = 8 << 20, chunk_shingles: int = 1 << 20) -> DataFrame:
    """``(id, node, rep, component)`` for every row whose id is not null: its shingle set, and the group that links reach.

    Two texts are linked when the sets of their ``width``-word shingles have a Jaccard similarity of ``similarity`` or
    more and their fingerprints differ in at most ``radius`` bits.  ``rep`` is the smallest id of the node, ``component`` a
    node of the group.  Null and empty texts equal each other and nothing else; repeated rows are equal; other columns change
    nothing; an empty table gives none.
    """
    ratio = Fraction(str(similarity))
    num, den = ratio.numerator, ratio.denominator
    if not 0 < ratio <= 1:
        raise ValueError(f"a similarity above 0 and up to 1, not {similarity}")
    spark = docs.sparkSession
    rows = take(docs, id=id_col, text=text_col).where("id is not null")
    kind = rows.schema["id"].dataType
    parts = parts_for(docs, 16 << 20)
    shared = spark.sparkContext.broadcast(_common(rows, width, sample_bytes))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, expected = shared.value
        for b in _small(batches):
            names, prints, sizes, keys, trees = [], [], [], [], []
            for t in b.column(1):
                found = shingles(t.as_py(), width)
                n = len(found)
                at = np.minimum(np.searchsorted(common, found), len(common) - 1) if len(common) else np.zeros(n, int)
                late = common[at] == found if len(common) else np.zeros(n, bool)
                wanted = n - -(-num * n // den) + 1 if n else 0
                many = np.ones(n, np.int16)
                many[late] = np.minimum(np.ceil(expected[at[late]] / tree_size), 1000)
                names.append(node(found))
                sizes.append(n)
                prints.append(np.uint64(majority(found)).view(np.int64))
                keys.append(np.r_[found[~late], found[late]][:wanted].view(np.int64))
                trees.append(np.r_[many[~late], many[late]][:wanted])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.int64()), pa.array(np.array(prints, np.int64)), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(trees, pa.list_(pa.int16()))], list(schema.names))

    fields = {"id": kind, "node": T.LongType(), "fp": T.LongType(), "n": T.IntegerType(), "keys": T.ArrayType(T.LongType()), "trees": T.ArrayType(T.ShortType())}
    schema = T.StructType([T.StructField(n, t) for n, t in fields.items()])
    marked = written(rows.mapInArrow(mark, schema), "shingles")
    nodes = written(marked.groupBy("node").agg(F.min("id").alias("rep")), "nodes")
    sets = marked.select("node", "fp", "n", "keys", "trees").dropDuplicates(["node"])
    found = written(candidates(sets, ratio, radius, parts), "candidates")
    del sets
    release(spark)
    clusters = components(found).withColumnRenamed("component", "cluster")
    wanted = written(clusters.join(nodes, "node").select("node", "cluster", "rep"), "clusters")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            keep, prints, held = [], [], []
            for i, (t, asked) in enumerate(zip(b.column(0), b.column(2).to_pylist())):
                mine = shingles(t.as_py(), width)
                if node(mine) == asked:  # ids may repeat
                    keep.append(i)
                    prints.append(np.uint64(majority(mine)).view(np.int64))
                    held.append(mine.view(np.int64))
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(1).take(at), b.column(2).take(at), pa.array(np.array(prints, np.int64)), pa.array(held, pa.list_(pa.int64()))], ["cluster", "node", "fp", "keys"])

    texts = rows.join(wanted, rows.id == wanted.rep).select("text", "cluster", "node")
    full = texts.mapInArrow(whole, "cluster long, node long, fp long, keys array<long>")
    if (marked.groupBy("id", "node").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1) > 1:  # rows that repeat
        full = full.dropDuplicates(["node"])
    full = written(full, "sets")
    del texts
    release(spark)
    groups = written(components(verified(full, ratio, radius, parts, chunk_shingles)), "components")
    discard(full)
    release(spark)
    named = nodes.join(groups, "node", "left").select(F.col("node").alias("n2"), "rep", F.coalesce("component", "node").alias("component"))
    return marked.select("id", "node").join(named, F.col("node") == F.col("n2")).select("id", "node", "rep", "component")


def _with_node(docs: DataFrame, text_at: int, width: int) -> DataFrame:
    """``docs`` with the node as a last column ``node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = pa.array([node(shingles(t.as_py(), width)) for t in b.column(text_at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, names], [*b.schema.names, "node"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("node", T.LongType())]))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, **options) -> DataFrame:
    """The rows and columns of ``docs``, one row of each group of near-duplicates: the one with its smallest id.

    Rows with a null id stay, and link nothing.  Where ids repeat, rows are known by id and shingle set, and of equal ones
    one stays.  Null and empty texts are one group; other columns pass through, clashing names included; an empty table
    gives an empty one.
    """
    names = docs.columns
    groups = written(near_groups(docs, id_col, text_col, width, **options), "groups")
    least = groups.groupBy("component").agg(F.min(F.struct("rep", "node")).alias("low"))
    first = written(least.select(F.col("low.rep").alias("id"), F.col("low.node").alias("own_node")), "first")
    release(docs.sparkSession)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = f"c{names.index(id_col)}"
    if groups.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] in (None, 1):
        return plain.join(first, F.col(own) == F.col("id"), "left_semi").union(plain.where(F.col(own).isNull())).toDF(*names)
    coded = _with_node(plain, names.index(text_col), width)
    kept = coded.join(first, (F.col(own) == F.col("id")) & (F.col("node") == F.col("own_node")), "left_semi").dropDuplicates([own, "node"])
    return kept.union(coded.where(F.col(own).isNull())).drop("node").toDF(*names)
