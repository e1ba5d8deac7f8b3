"""SimHash near-duplicates, found with BK-trees.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it set.  Fingerprints that differ
in at most ``radius`` bits are linked.  A shard's tree is a BK-tree: a child hangs on the edge labelled with its distance
to the parent, and a search follows only edges within the radius of the distance it measured.

One tree over all fingerprints would have to be gathered in one place, and its search grows with their number.  So the 64
bits are cut into ``radius + 1`` blocks, of which two linked fingerprints agree on one at least, and a shard holds those
that agree on the first bits of a block: as many bits as make a shard about ``tree_size``, the whole block where
fingerprints crowd.  Within a shard the tree does the search.  A shard that is still larger is dealt into several trees;
each of them goes to every task holding that shard's queries, so no tree is unbounded and none is searched by texts that
cannot match.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import run_bounds, take, whole_runs, written
from .components import components

BITS, SEED = 64, 42


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of a text's ``width``-word shingles, repeats included; a shorter text is one shingle, an empty one none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)].astype(">u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's ``width``-word shingles (repeats count; no word: zero)."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)`` for each row, ``fp`` the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    rows = take(docs, id=id_col, text=text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def near(values: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, int]]:
    """For each value of a BK-tree over ``values`` (distinct, perhaps none): indexes of the queries within ``radius``, and its own.

    The tree is built and searched in the same descent: a node's subtree splits by distance to the node, and
    of its queries only those follow an edge whose measured distance is within the radius of the edge's label.
    """
    todo = [(np.arange(len(values)), np.arange(len(queries)))] if len(values) else []
    while todo:
        tree, ask = todo.pop()
        node, rest = tree[0], tree[1:]
        far = np.bitwise_count(queries[ask] ^ values[node]).astype(np.int16)
        hit = far <= radius
        if hit.any():
            yield ask[hit], int(node)
        if not len(rest):
            continue
        edge = np.bitwise_count(values[rest] ^ values[node])
        order = np.argsort(edge, kind="stable")
        rest, edge = rest[order], edge[order].astype(np.int16)
        starts = np.flatnonzero(np.r_[True, edge[1:] != edge[:-1]])
        for s, e in zip(starts, np.r_[starts[1:], len(rest)]):
            follow = ask[np.abs(far - edge[s]) <= radius]
            if len(follow):
                todo.append((rest[s:e], follow))


def _forest(pairs: Iterator[tuple[np.ndarray, int]], queries: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    """Of the links, those that join two groups not yet joined: as many as values at most, however dense the links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = parent[x]
        return x

    a, b = [], []
    for asked, node in pairs:
        own = int(values[node])
        for q in queries[asked].tolist():
            if (x := root(q)) != (y := root(own)):
                parent[x] = y
                a.append(q)
                b.append(own)
    return a, b


def _block(i: int, radius: int) -> tuple[int, int]:
    """The lowest bit of block ``i`` and its number of bits."""
    cuts = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return cuts[i], cuts[i + 1] - cuts[i]


def links(prints: DataFrame, radius: int = 2, tree_size: int = 2048) -> DataFrame:
    """``(a, b)``: links that span each group of the distinct fingerprints ``prints(fp)`` at ``radius`` bits or fewer."""
    n = prints.count()
    wanted = max(0, math.ceil(math.log2(max(1, n / tree_size))))

    def first(i: int, bits: int | None):
        """The first ``bits`` of block ``i`` (None: all of it)."""
        low, size = _block(i, radius)
        bits = size if bits is None else min(bits, size)
        return F.shiftrightunsigned("fp", low + size - bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    each = range(radius + 1) if wanted else range(1)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.struct(first(i, wanted).alias("part"), first(i, None).alias("whole")) for i in each])).alias("block", "key"))
    keyed = keyed.select("fp", "block", "key.part", "key.whole")
    large = written(keyed.groupBy("block", "part").agg(F.count("*").alias("n")).where(F.col("n") > 2 * tree_size).select("block", "part", F.lit(1).alias("crowded")), "shards")
    keyed = keyed.join(large, ["block", "part"], "left").select(
        "fp", (F.col("block") * 2 + F.coalesce("crowded", F.lit(0))).alias("block"), F.when(F.col("crowded").isNull(), F.col("part")).otherwise(F.col("whole")).alias("part"))
    split = keyed.where("block % 2 = 1").groupBy("block", "part").agg(F.ceil(F.count("*") / tree_size).cast("int").alias("trees")).where("trees > 1")
    dealt = keyed.join(written(split, "trees"), ["block", "part"], "left").select("fp", "block", "part", F.coalesce("trees", F.lit(1)).alias("trees"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    # tree i is searched by the queries of chunks 0..i: each two chunks meet once
    rows = dealt.withColumn("own", chunk).select("fp", "block", "part", "own", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("other"))
    rows = rows.select("block", "part", F.greatest("own", "other").alias("hi"), F.least("own", "other").alias("lo"), "own", "fp")
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(3 * n / 200_000))
    rows = rows.repartition(parts, "block", "part", "hi", "lo").sortWithinPartitions("block", "part", "hi", "lo", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, 4):
            *keys, own, fp = (c.to_numpy() for c in table.columns)
            a, b = [], []
            for s, e in run_bounds(keys):
                if e - s == 1 or keys[2][s] != keys[3][s] and own[s] == own[e - 1]:
                    continue  # alone, or one chunk without the other
                mine, prints = own[s:e], fp[s:e].view(np.uint64)
                tree, ask = (prints, prints) if keys[2][s] == keys[3][s] else (prints[mine == keys[2][s]], prints[mine != keys[2][s]])
                x, y = _forest(near(tree, ask, radius), ask.view(np.int64), tree.view(np.int64))
                a += x
                b += y
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").where("a <> b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, tree_size: int = 2048
) -> DataFrame:
    """One row per document: ``(id, fingerprint, component_id)``.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest id reachable over links.  Null and
    empty texts have fingerprint zero and link like any other; repeated rows stay, each with its component; null
    ids are never the smallest (a component of null ids alone has a null component_id); an empty table gives none.
    """
    marked = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    found = components(links(classes.select("fp"), radius, tree_size))
    joined = classes.join(found, classes.fp == found.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    joined = written(joined, "grouped")
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = joined.join(least, "component").select(F.col("fp").alias("print"), "component_id")
    return marked.join(named, marked.fp == named.print).select(
        "id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
