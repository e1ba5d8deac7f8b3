"""Substring dedup: word sequences of a given length that occur twice, from prefix-partitioned suffix trees.

A suffix starts at each word.  Two suffixes whose first ``window`` words agree meet below a node at least that deep
of the suffix tree, so the tree's deep internal nodes are the repeats, and a stretch of neighbouring suffixes below
such nodes is a maximal repeat.

Which suffixes go where:
  1. Of a suffix's first ``window`` words the smallest-hashed run of ``ANCHOR`` words is its anchor.  It depends on the
     words alone, so suffixes that agree have equal anchors; about one word in fifteen begins one.  Only suffixes whose
     anchor occurs twice can be below a deep node.  Hashes decide here what to leave out, which loses no repeat.
  2. Suffixes are dealt by their anchor.  Neighbours mostly share it, so a stretch of them travels as one, in plain words.
     Where an anchor has more than ``crowd`` occurrences, as in a passage of very many documents, its suffixes are dealt
     by all of their first ``window`` words instead, equal ones of a batch as one.
  3. Each group grows its trees.  All suffixes begin in one group; those that agree on a prefix are split by the next
     words, and the prefix doubles, until a suffix is alone or ``window`` deep.  Words are compared themselves: numbers
     stand for them that only the group gives out.  What is still together at that depth is below a deep node.
Everything that moves is packed by partition and batch; a group's memory does not depend on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import part_bits, parts_for, release, take, written

ANCHOR = 8
#: In place of a partition: places that a batch itself has found repeated.
OWN = -1
#: In place of a partition: the texts of a batch that are as long as a window, compressed together.
TEXTS = -2
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class WordHashes(dict):
    """Hashes of words, kept as met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 7) >> 1
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 600_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


_HASHES = WordHashes()
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words: a polynomial modulo 2^64, then mixed."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers(_INVERSE, n), out=sums[1:])
    h = (sums[width:] - sums[:-width]) * _powers(_BASE, n)[: n - width + 1] + np.uint64(width)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(32))) | np.uint64(1)


def slide(x: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """Minimum (or maximum) over each ``width`` neighbours, by doubling."""
    best, have = (np.minimum if least else np.maximum), 1
    while have < width:
        step = min(have, width - have)
        x = best(x[: len(x) - step], x[step:])
        have += step
    return x


class Batch:
    """Texts' words end to end, with what tells windows and anchors."""

    def __init__(self, texts: list[list[bytes]], window: int):
        self.window, self.reach = window, window - ANCHOR + 1
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]].astype(np.int64)
        self.hashes = np.concatenate([_HASHES.of(t) for t in texts]) if texts else np.zeros(0, np.uint64)
        n = len(self.hashes)
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.grams = runs(self.hashes, ANCHOR)
        count = max(0, n - window + 1)
        # a window counts if it ends in the text in which it starts
        self.whole = self.owner[:count] == self.owner[window - 1 :] if count else np.zeros(0, bool)
        self.low = np.where(self.whole, slide(self.grams, self.reach), np.uint64(0)) if count else np.zeros(0, np.uint64)

    def anchors(self) -> np.ndarray:
        """Places of all anchors: runs that are the smallest of some window."""
        if not len(self.low):
            return np.zeros(0, np.int64)
        pad = np.zeros(self.reach - 1, np.uint64)
        high = slide(np.r_[pad, self.low, pad], self.reach, False)
        return np.flatnonzero(high == self.grams)

    def candidates(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows whose anchor is among the given ones."""
        if not len(self.low):
            return np.zeros(0, np.int64)
        marked = np.full(len(self.grams), _TOP)
        marked[anchors] = self.grams[anchors]
        return np.flatnonzero(self.whole & (slide(marked, self.reach) == self.low))


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:-1] > 0


def _pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    head = np.array([len(arrays), *[len(a) for a in arrays]], np.int64)
    return zstandard.ZstdCompressor(level=level).compress(b"".join(a.tobytes() for a in (head, *arrays)))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8).tolist()
    at, out = 8 + 8 * n, []
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


def _by_part(paths: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indexes of the paths of each partition, sorted by path and then as they were."""
    part = (paths * np.uint64(_BASE) >> np.uint64(64 - bits)).astype(np.int32)
    order = np.lexsort((paths, part))
    part = part[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
    for s, e in zip(starts, np.r_[starts[1:], len(part)] if len(part) else starts):
        yield int(part[s]), order[s:e]


def _starts(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key begins, and how often it is there."""
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, int)
    return starts, np.diff(np.r_[starts, len(sorted_keys)])


def _ask(keys: np.ndarray, places: np.ndarray, bits: int) -> tuple[list[tuple[int, bytes]], np.ndarray]:
    """Requests by partition, each anchor once with its number, and the places of those that are repeated within the batch.

    A request has the places only of anchors that are single here: the answer needs no others.
    """
    asked, repeated = [], [np.zeros(0, np.int64)]
    for part, index in _by_part(keys, bits):
        at, number = _starts(keys[index])
        repeated.append(places[index[np.repeat(number > 1, number)]])
        mine = keys[index[at]]
        several = number > 1
        asked.append((part, _pack(np.r_[mine[~several], mine[several]], places[index[np.repeat(~several, number)]].astype(np.uint32), number[several].astype(np.uint32))))
    return asked, np.concatenate(repeated)


def _answer(table: pa.Table, crowd: int) -> pa.Table:
    """For a partition: to each batch the places of anchors that another batch has too, and those anchors that are crowded."""
    got = [_unpack(b.as_py(), np.uint64, np.uint32, np.uint32) for b in table["blob"]]
    keys = np.concatenate([k for k, _, _ in got])
    numbers = np.concatenate([np.r_[np.ones(len(p), np.int64), n] for _, p, n in got])
    order = np.argsort(keys)
    at, _ = _starts(keys[order])
    distinct, total = keys[order][at], np.add.reduceat(numbers[order], at) if len(at) else numbers[:0]
    batches, out = [], []
    for batch, (mine, places, _) in zip(table["batch"].to_pylist(), got):
        here = total[np.searchsorted(distinct, mine)]
        again, crowded = places[here[: len(places)] > 1], np.sort(mine[here > crowd])
        if len(again) or len(crowded):
            batches.append(batch)
            out.append(_pack(again, crowded))
    return pa.table({"batch": pa.array(batches, pa.int64()), "blob": pa.array(out, pa.binary())})


class Numbers(dict):
    """A number for each word, as met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def grow(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of the suffixes at ``starts`` share their first ``window`` words with another of them.

    ``words`` are numbered; ``node[i]`` names the inner node that the suffix at ``i`` is below, so far, or the leaf that it
    is alone in.  Only suffixes that are not alone go on to a prefix of twice the length.
    """
    n = len(words)
    node, depth, free = words.astype(np.int64), 1, int(words.max(initial=-1)) + 1
    going = np.arange(n)

    def split(at: np.ndarray, step: int, free: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The nodes of the suffixes ``at``, split by the node ``step`` words on, and which are not alone in theirs."""
        on = np.where(at + step < n, node[np.minimum(at + step, n - 1)], free)
        both = node[at] * (free + 1) + on  # names are below ``free``, which is a few times the number of words at most
        order = np.argsort(both)
        ranked = both[order]
        new = np.ones(len(at), bool)
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
        number = np.cumsum(new) - 1
        out, many = np.empty(len(at), np.int64), np.empty(len(at), bool)
        out[order] = free + number
        # not alone: equal to the one before or after
        many[order] = ~(new & np.r_[new[1:], True])
        return out, many, free + int(new.sum())

    while 2 * depth <= window and len(going):
        named, many, free = split(going, depth, free)
        node[going] = named
        going, depth = going[many], 2 * depth
    if not len(starts):
        return np.zeros(0, bool)
    if depth == window:  # the nodes are as deep as asked for
        number = np.unique(node[starts], return_inverse=True)[1]
        return np.bincount(number)[number] > 1
    return split(starts, window - depth, free)[1]


def _trees(table: pa.Table, window: int) -> pa.Table:
    """For a partition: to each batch the starts of those of its windows that are below a deep node."""
    numbers, codes, sizes, owners, firsts = Numbers(), [], [], [], []
    for i, blob in enumerate(table["blob"]):
        places, text = _unpack(blob.as_py(), np.uint32, np.uint8)
        stretches = text.tobytes().split(b"\n")
        sizes += [x.count(b" ") + 1 for x in stretches]
        owners += [i] * len(stretches)
        firsts += [*places.tolist(), *[-1] * (len(stretches) - len(places))]
        codes.append(np.fromiter(map(numbers.__getitem__, b" ".join(stretches).split(b" ")), np.int64))
    size = np.array(sizes, np.int64)
    windows = size - window + 1
    offset = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    deep = grow(np.concatenate(codes), np.repeat(np.cumsum(size) - size, windows) + offset, window)
    first = np.repeat(np.array(firsts, np.int64), windows)
    owner = np.repeat(np.array(owners, np.int64), windows)[deep & (first >= 0)]
    place = (first + offset)[deep & (first >= 0)]
    batches, out = [], []
    at, number = _starts(owner)
    for s, k in zip(at.tolist(), number.tolist()):
        batches.append(table["batch"][int(owner[s])].as_py())
        out.append(_pack(place[s : s + k].astype(np.uint32)))
    return pa.table({"batch": pa.array(batches, pa.int64()), "blob": pa.array(out, pa.binary())})


def _anchors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch: the places of its repeated anchors, and the anchors that are crowded."""
    got = [_unpack(b.as_py(), np.uint32, np.uint64) for b in table["blob"]]
    places = np.concatenate([p for p, _ in got]) if got else np.zeros(0, np.uint32)
    crowded = np.concatenate([c for _, c in got]) if got else np.zeros(0, np.uint64)
    return np.sort(places).astype(np.int64), np.sort(crowded)


def _places(table: pa.Table) -> np.ndarray:
    found = [_unpack(b.as_py(), np.uint32)[0] for b in table["blob"]]
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


def _zip(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(text)


def _together(rows: np.ndarray, texts: list[list[bytes]]) -> bytes:
    """Texts compressed as one, which takes less than each by itself."""
    return _pack(rows.astype(np.uint32), np.frombuffer(b"\n".join(map(b" ".join, texts)), np.uint8), level=5)


def _apart(blob: bytes) -> tuple[list[int], list[list[bytes]]]:
    rows, text = _unpack(blob, np.uint32, np.uint8)
    return rows.tolist(), [t.split() for t in text.tobytes().split(b"\n")]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, texts: bool = False,
                    batch_words: int = 700_000, part_bytes: int = 8 << 20, crowd: int = 8192) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256, spans)`` for every row, and ``kept_text`` if ``texts``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  Removed is each word in a run of ``window`` words that starts anywhere else too,
    be it in the same text; ``spans`` are the removed stretches as word numbers ``(start, end)``, end excluded.
    ``kept_sha256`` is over the words left, joined by one space.  Null and empty texts have no words; repeated rows
    repeat each other; null ids and other columns change nothing; an empty table gives no row.
    """
    if window < ANCHOR:
        raise ValueError(f"a window has at least {ANCHOR} words")
    spark = docs.sparkSession
    rows = take(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType
    bits = part_bits(docs, part_bytes, least=6)
    names = ["batch", "part", "blob", "row", "id", "n_words", "sha", "words"]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.IntegerType(), T.BinaryType(), T.IntegerType(), kind, T.LongType(), T.StringType(), T.BinaryType()))])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts in batches, and requests for their anchors."""
        task = TaskContext.get().partitionId() << 32
        held: list[list[bytes]] = []
        ids, size, serial = [], 0, 0

        def flush() -> pa.RecordBatch:
            # a text shorter than a window is done; places count over the others
            batch = Batch([w for w in held if len(w) >= window], window)
            places = batch.anchors()
            asked, own = _ask(batch.grams[places], places, bits)
            asked += [(OWN, _pack(own.astype(np.uint32), np.zeros(0, np.uint64)))] if len(own) else []
            rows = [i for i, w in enumerate(held) if len(w) >= window]
            asked += [(TEXTS, _together(np.array(rows), [held[i] for i in rows]))] if rows else []
            n, m = len(held), len(asked)
            shas = [hashlib.sha256(b" ".join(w)).hexdigest() for w in held]
            kept = [_zip(b" ".join(w)) if texts else None for w in held]
            return pa.RecordBatch.from_arrays([
                pa.array([task + serial] * (n + m), pa.int64()),
                pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array([p for p, _ in asked], pa.int32())]),
                pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([b for _, b in asked], pa.binary())]),
                pa.concat_arrays([pa.array(range(n), pa.int32()), pa.nulls(m, pa.int32())]),
                pa.concat_arrays([*ids, pa.nulls(m, ids[0].type)]),
                pa.concat_arrays([pa.array([len(w) for w in held], pa.int64()), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.array(shas), pa.nulls(m, pa.string())]),
                pa.concat_arrays([pa.array(kept, pa.binary()), pa.nulls(m, pa.binary())]),
            ], names)

        for b in batches:
            for i in range(b.num_rows):
                held.append((b.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass").split())
                ids.append(b.column(0).slice(i, 1))
                size += len(held[-1])
                if size >= batch_words or len(held) >= 50_000:
                    yield flush()
                    held, ids, size, serial = [], [], 0, serial + 1
        if held:
            yield flush()

    table = written(rows.mapInArrow(first, schema), "suffixes")
    parts = parts_for(docs, part_bytes)
    dealt = lambda df, *keys: df.repartition(parts, *keys)
    asked = dealt(table.where("part >= 0").select("part", "batch", "blob"), "part").groupBy("part").applyInArrow(lambda t: _answer(t, crowd), "batch long, blob binary")
    anchors = asked.union(table.where(F.col("part") == OWN).select("batch", "blob"))
    long_texts = table.where(F.col("part") == TEXTS).select("batch", "blob")

    def second(texts: pa.Table, found: pa.Table) -> pa.Table:
        """The stretches of suffixes around repeated anchors, in words, each once."""
        asked: list[tuple[int, bytes]] = []
        if texts.num_rows and found.num_rows:
            held = _apart(texts["blob"][0].as_py())[1]
            batch = Batch(held, window)
            places, crowded = _anchors(found)
            starts = batch.candidates(places)
            low = batch.low[starts]
            apart = np.isin(low, crowded)
            new = np.ones(len(starts), bool)
            new[1:] = (starts[1:] != starts[:-1] + 1) | (low[1:] != low[:-1]) | apart[1:]
            begin = np.flatnonzero(new)
            count = np.diff(np.r_[begin, len(starts)])
            key = low[begin]
            alone = apart[begin]
            if alone.any():
                key = np.where(alone, runs(batch.hashes, window)[starts[begin]], key)
            words = [w for t in held for w in t]
            by_part: dict[int, dict[bytes, list[int]]] = {}
            part = (key * np.uint64(_BASE) >> np.uint64(64 - bits)).astype(np.int64).tolist()
            for p, s, k in zip(part, starts[begin].tolist(), count.tolist()):
                by_part.setdefault(p, {}).setdefault(b" ".join(words[s : s + k + window - 1]), []).append(s)
            own = [np.zeros(0, np.int64)]
            for p, stretches in by_part.items():
                single = [(x, at[0]) for x, at in stretches.items() if len(at) == 1]
                several = [(x, at) for x, at in stretches.items() if len(at) > 1]
                own += [np.arange(s, s + x.count(b" ") + 2 - window) for x, at in several for s in at]
                text = b"\n".join([x for x, _ in single] + [x for x, _ in several])
                asked.append((p, _pack(np.array([s for _, s in single], np.uint32), np.frombuffer(text, np.uint8), level=3)))
            repeated = np.concatenate(own)
            asked += [(OWN, _pack(repeated.astype(np.uint32)))] if len(repeated) else []
        batch_id = [texts["batch"][0].as_py()] * len(asked) if asked else []
        return pa.table({"batch": pa.array(batch_id, pa.int64()), "part": pa.array([p for p, _ in asked], pa.int32()), "blob": pa.array([b for _, b in asked], pa.binary())})

    by_batch = lambda df: dealt(df, "batch").groupBy("batch")
    deep = written(by_batch(long_texts).cogroup(by_batch(anchors)).applyInArrow(second, "batch long, part int, blob binary"), "stretches")
    del asked, anchors
    release(spark)
    grown = dealt(deep.where("part >= 0").select("part", "batch", "blob"), "part").groupBy("part").applyInArrow(lambda t: _trees(t, window), "batch long, blob binary")
    repeats = written(grown.union(deep.where(F.col("part") == OWN).select("batch", "blob")), "repeats")
    del grown
    release(spark)

    def third(texts: pa.Table, found: pa.Table) -> pa.Table:
        """The words to remove from each text."""
        out = [[], [], [], [], [], []]
        starts, low = _places(found), 0
        for row, words in zip(*_apart(texts["blob"][0].as_py())) if texts.num_rows and len(starts) else ():
            own = starts[np.searchsorted(starts, low) : np.searchsorted(starts, low + len(words))] - low
            low += len(words)
            if len(own):
                gone = covered(own, len(words), window)
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False])).tolist()
                spans = [{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2])]
                for column, value in zip(out, (texts["batch"][0].as_py(), int(row), int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans, _zip(kept) if with_texts else None)):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], ["b2", "r2", "removed", "sha2", "spans", "kept"])

    with_texts = texts
    removed = by_batch(long_texts).cogroup(by_batch(repeats)).applyInArrow(
        third, "b2 long, r2 int, removed long, sha2 string, spans array<struct<start:long,end:long>>, kept binary")
    all_texts = table.where(F.col("part").isNull()).select("batch", "row", "id", "n_words", "sha", *(["words"] if texts else []))
    joined = all_texts.join(removed, (F.col("batch") == F.col("b2")) & (F.col("row") == F.col("r2")), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    columns = ["id", "n_words", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha2", "sha").alias("kept_sha256"), F.coalesce("spans", none).alias("spans")]
    if not texts:
        return joined.select(*columns)
    plain = joined.select(*columns, F.coalesce("kept", "words").alias("kept_text"))

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([zstandard.ZstdDecompressor().decompress(x.as_py()).decode("utf-8", "replace") for x in b.column(5)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], text], b.schema.names)

    return plain.mapInArrow(unzip, T.StructType([*plain.schema.fields[:5], T.StructField("kept_text", T.StringType())]))
