"""Language-model scores from a weighted backoff automaton.

The model is an n-gram model of all training texts, with nothing pruned.  Each order is smoothed by the one below:

    P(w | h) = (c(h w) + s P(w | h')) / (c(h) + s),     h' = h without its first word,

down to unigrams with half a count for each word and for the unknown one.  As an automaton: every n-gram seen below
the highest order is a state; from state h an arc for each word seen after it carries log P(w | h) and leads to the
longest state that then ends the text; a failure arc to h' costs log s / (c(h) + s), which is what is left for words
not seen after h.  Weights need no more than counts, so states and arcs can lie wherever their counts do.

The automaton grows with the corpus and is held nowhere as a whole.  Texts travel in batches.  A batch asks for its
distinct n-grams by key, packed by partition of the key; a partition adds up what all batches have of a key and
answers with the totals.  The answers are the batch's own part of the automaton, exact for its texts, which one
left-to-right traversal a text then scores.  One exchange both counts and answers, a hot n-gram is one key a batch,
and no task, driver or broadcast holds more than a batch or a partition of bounded size.

Words are known by 63 bits of a hash, and n-grams by 20 bits more than the logarithm of their number: about one in a
million of them shares its count with another, at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import part_bits, parts_for, release, take, written

#: The end of a text is a token of its own; words have the other half of the hashes.
END = 1 << 63
_MASK = END - 1
MOST_WORDS = 8
#: Bits of an n-gram's key beyond the logarithm of the number of n-grams.
SPARE_BITS = 20


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(row_id, folds: int = 5, fold: int = 1):
    return F.coalesce(F.crc32(row_id.cast("string")) % folds == fold, F.lit(False))


class Vocabulary(dict):
    """Numbers of words as met, and their hashes; the end of a text is number 0."""

    def __init__(self):
        super().__init__()
        self.hashes = [END]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word) & _MASK)
        return n

    def of(self, text: str | None) -> np.ndarray:
        """The numbers of a text's tokens, its end included."""
        w = words(text)
        out = np.zeros(len(w) + 1, np.int64)
        out[:-1] = np.fromiter(map(self.__getitem__, w), np.int64, len(w))
        return out


# --- n-grams by key -------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0x9FB21C651E98DF25)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def gram_keys(hashes: np.ndarray, sizes: np.ndarray, order: int, bits: int = 64) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order the keys of all n-grams of texts laid end to end, and the places in which they end.

    Words have keys of 64 bits, longer n-grams of ``bits``."""
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys, ends, at = [], [], None
    for k in range(order):
        before = np.full(len(hashes), k, np.uint64) if at is None else np.r_[np.uint64(0), at[:-1]]
        at = _mix(before * np.uint64(0x9E3779B97F4A7C15) + hashes)
        ends.append(np.flatnonzero(place >= k))
        keys.append(at[ends[-1]] if not k else at[ends[-1]] >> np.uint64(64 - bits))
    return keys, ends


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted; where each is met; and the number of each key among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[new], order[new], number


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers, byte plane by byte plane, so that leading zeros take no room."""
    head = np.array([len(arrays), *map(len, arrays)], np.int64)
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(planes))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 + 8 * n, []
    for size in np.frombuffer(raw, np.int64, n, 8).tolist():
        out.append(np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, -1).T.copy().view(np.uint64).reshape(-1))
        at += 8 * size
    return out


def _cuts(keys: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Where the partitions begin in sorted keys of ``width`` bits: the first ``bits`` of a key are its partition."""
    return np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits)).tolist() + [len(keys)]


def _requests(hashes: np.ndarray, sizes: np.ndarray, learns: np.ndarray, order: int, width: int, bits: int) -> Iterator[tuple[int, bytes]]:
    """For each partition a batch's distinct words and n-grams there, sorted by key, and how often its training texts have each."""
    keys, ends = gram_keys(hashes, sizes, order, width)
    mine = np.repeat(learns, sizes)
    packs = []
    for ks, es, w in ((keys[:1], ends[:1], 64), (keys[1:], ends[1:], width)):
        found, _, number = distinct(np.concatenate([*ks, np.zeros(0, np.uint64)]))
        learned = np.concatenate([*(mine[e] for e in es), np.zeros(0, bool)])
        packs.append((found, np.bincount(number[learned], minlength=len(found)).astype(np.uint64), _cuts(found, w, bits)))
    for part in range(1 << bits):
        arrays = [x for found, times, cut in packs for x in (np.diff(found[cut[part] : cut[part + 1]], prepend=np.uint64(0)), times[cut[part] : cut[part + 1]])]
        if len(arrays[0]) or len(arrays[2]):
            yield part, _pack(*arrays)


def _totals(table: pa.Table) -> pa.Table:
    """A partition's answers: to each batch the totals of the words and n-grams it asked for; and the number of words seen."""
    got = [_unpack(b.as_py()) for b in table["blob"]]
    answers, seen = [], 0
    for low in (0, 2):
        keys = [np.cumsum(g[low], dtype=np.uint64) for g in got]
        found, _, number = distinct(np.concatenate(keys))
        # exact as doubles up to 2^53
        total = np.bincount(number, np.concatenate([g[low + 1] for g in got]), len(found)).astype(np.uint64)
        answers.append(np.split(total[number], np.cumsum([len(k) for k in keys])[:-1]))
        seen = int((total > 0).sum()) if low == 0 else seen
    blobs = [_pack(w, g) for w, g in zip(*answers)]
    return pa.table({"batch": table["batch"], "part": table["part"], "blob": pa.array(blobs, pa.binary()), "v": pa.array([seen] + [0] * (len(blobs) - 1), pa.int64())})


# --- the automaton --------------------------------------------------------------------------------------------


@dataclass
class Grams:
    """The n-grams of one order in texts laid end to end: the places in which they end, by these the number of the
    distinct n-gram and its count in the training texts, and one index of ``ends`` for each distinct n-gram."""

    ends: np.ndarray
    number: np.ndarray
    counts: np.ndarray
    first: np.ndarray


class Automaton:
    """The states and arcs of the n-grams of some texts.

    State 0 is the empty context.  A state's arcs are keyed ``state * words + word``, words numbered from 0, and sorted;
    each has a weight and a target.  ``fail`` and ``back`` are the failure arcs' targets and weights.
    """

    def __init__(self, codes: np.ndarray, grams: list[Grams], n_words: int, norm: float, strengths: Sequence[float]):
        """From texts' word numbers laid end to end, and their n-grams order by order."""
        self.n_words, self.order = n_words, len(grams)
        self.unknown = math.log10(0.5 / norm)
        states = 1
        keys, weights, targets, back, fail = [], [], [], [np.zeros(1)], [np.zeros(1, np.int64)]
        smooth = np.zeros(len(codes))
        context = np.zeros(len(codes), np.int64)  # by the place after it: the state of the context one order below
        context_count = np.zeros(len(codes))
        shorter = np.zeros(len(codes), np.int64)  # by place: the longest state of a lower order that ends there
        for k, g in enumerate(grams):
            c = g.counts.astype(float)
            p = (c + 0.5) / norm if k == 0 else (c + strengths[k - 1] * smooth[g.ends]) / (context_count[g.ends] + strengths[k - 1])
            smooth[g.ends] = p
            seen = g.first[c[g.first] > 0]
            places = g.ends[seen]
            keys.append(context[places] * n_words + codes[places])
            weights.append(np.log10(p[seen]))
            if k == len(grams) - 1:  # arcs lead to the longest state, that of the n-gram without its first word
                targets.append(shorter[places])
                break
            targets.append(np.arange(states, states + len(seen)))
            back.append(np.log10(strengths[k] / (c[seen] + strengths[k])))
            fail.append(shorter[places])
            state_of = np.zeros(int(g.number.max(initial=-1)) + 1, np.int64)
            state_of[g.number[seen]] = targets[-1]
            states += len(seen)
            here, number_seen = np.zeros(len(codes), np.int64), np.zeros(len(codes))
            here[g.ends], number_seen[g.ends] = state_of[g.number], c
            context, context_count = np.r_[0, here[:-1]], np.r_[0.0, number_seen[:-1]]
            shorter = np.where(here > 0, here, shorter)
        joined = np.concatenate(keys)
        ranked = np.argsort(joined)
        # one more than any key, so that a search always ends on some arc
        self.keys = np.r_[joined[ranked], np.iinfo(np.int64).max]
        self.weight, self.to = np.r_[np.concatenate(weights)[ranked], 0.0], np.r_[np.concatenate(targets)[ranked], 0]
        self.back, self.fail = np.concatenate(back), np.concatenate(fail)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words lead from states, and at what log-probability: failure arcs until there is an arc."""
        key = state * self.n_words + word
        arc = np.searchsorted(self.keys, key)
        to, paid = self.to[arc], self.weight[arc]
        lost = np.flatnonzero(self.keys[arc] != key)
        if len(lost):
            at = state[lost]
            to[lost], paid[lost] = 0, self.unknown
            some = at > 0
            if some.any():
                lost, at = lost[some], at[some]
                to[lost], further = self.step(self.fail[at], word[lost])
                paid[lost] = self.back[at] + further
        return to, paid

    def score(self, codes: np.ndarray, sizes: np.ndarray, piece: int = 512) -> np.ndarray:
        """The log-probabilities of texts laid end to end: each is traversed once from left to right.

        Texts advance side by side, long ones in pieces.  A state is what the last ``order - 1`` words leave, so a
        piece that begins that many words earlier, from the empty context, arrives at its own first word in the state
        that the whole text has there.
        """
        pieces = np.maximum(1, -(-sizes // piece))
        text = np.repeat(np.arange(len(sizes)), pieces)
        low = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * piece
        lead = np.minimum(low, self.order - 1)
        length = np.minimum(low + piece, sizes[text]) - low + lead
        begin = (np.cumsum(sizes) - sizes)[text] + low - lead
        by_length = np.argsort(-length)
        length, begin, lead = length[by_length], begin[by_length], lead[by_length]
        state, total = np.zeros(len(text), np.int64), np.zeros(len(text))
        active = len(text) - np.searchsorted(length[::-1], np.arange(int(length.max(initial=0))), side="right")
        for t, n in enumerate(active.tolist()):
            state[:n], paid = self.step(state[:n], codes[begin[:n] + t])
            total[:n] += paid if t >= self.order - 1 else np.where(lead[:n] <= t, paid, 0.0)
        return np.bincount(text[by_length], total, len(sizes))


# --- scoring --------------------------------------------------------------------------------------------------


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, strengths: Sequence[float] = (1000.0, 10.0),
                batch_tokens: int = 600_000, part_bytes: int = 4 << 20) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    Learns from the rows whose crc32(id as text) mod 5 is not 1 (null ids learn too).  ``base_score`` is the smoothed
    unigram log-probability of the tokens (words in ASCII lower case, then the end), ``score`` the automaton's;
    ``strengths`` are the s above, for two words on.  Null and empty texts are one token, the end.  Repeated rows
    count each; other columns change nothing; an empty table gives no row; without training rows every token is unseen.
    """
    if not 1 <= order <= MOST_WORDS or len(strengths) < order - 1 or any(not s > 0 for s in strengths):
        raise ValueError(f"an order from 1 to {MOST_WORDS}, and a strength above 0 for each order above 1")
    spark = docs.sparkSession
    rows = take(docs, id=id_col, text=text_col).select("id", "text", held_out(F.col("id")).alias("held_out"))
    kind = rows.schema["id"].dataType
    parts = parts_for(docs, 16 << 20)
    bits = part_bits(docs, part_bytes, least=max(4, math.ceil(math.log2(4 * parts))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts in batches: their ids, and packed their tokens' numbers, those numbers' hashes, sizes and folds."""
        task = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        ids, aside, size, serial = [], [], 0, 0
        vocabulary = Vocabulary()

        def flush() -> pa.RecordBatch:
            met = np.concatenate(held)
            all_hashes = np.array(vocabulary.hashes, np.uint64)
            used = np.flatnonzero(np.bincount(met, minlength=len(all_hashes)))
            used = used[np.argsort(all_hashes[used])]
            hashes, number = all_hashes[used], np.zeros(len(all_hashes), np.int64)
            number[used] = np.arange(len(used))
            codes = number[met]
            sizes = np.array([len(h) for h in held], np.uint64)
            learned = int(sizes[~np.array(aside)].sum())
            blob = _pack(codes.astype(np.uint64), np.diff(hashes, prepend=np.uint64(0)), sizes, np.array(aside, np.uint64))
            together = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays(ids))
            return pa.RecordBatch.from_arrays([pa.array([task + serial], pa.int64()), together, pa.array([blob], pa.binary()), pa.array([learned], pa.int64()), pa.array([len(codes)], pa.int64())], ["batch", "ids", "texts", "learned", "tokens"])

        for b in batches:
            for i in range(b.num_rows):
                held.append(vocabulary.of(b.column(1)[i].as_py()))
                ids.append(b.column(0).slice(i, 1))
                aside.append(b.column(2)[i].as_py())
                size += len(held[-1])
                if size >= batch_tokens or len(held) >= 50_000:
                    yield flush()
                    held, ids, aside, size, serial = [], [], [], 0, serial + 1
                    if len(vocabulary) > 300_000:
                        vocabulary = Vocabulary()
        if held:
            yield flush()

    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("texts", T.BinaryType()), T.StructField("learned", T.LongType()), T.StructField("tokens", T.LongType())])
    coded = written(rows.mapInArrow(code, schema), "coded")
    total, tokens = coded.agg(F.coalesce(F.sum("learned"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    width = min(64, max(bits + 8, (order * tokens + 1).bit_length() + SPARE_BITS))

    def texts_of(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        codes, hashes, sizes, aside = _unpack(blob)
        return codes.astype(np.int64), np.cumsum(hashes, dtype=np.uint64), sizes.astype(np.int64), aside > 0

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, blob in zip(b.column(0).to_pylist(), b.column(1)):
                codes, hashes, sizes, aside = texts_of(blob.as_py())
                asked = list(_requests(hashes[codes], sizes, ~aside, order, width, bits))
                yield pa.RecordBatch.from_arrays([pa.array([batch] * len(asked), pa.int64()), pa.array([p for p, _ in asked], pa.int32()), pa.array([x for _, x in asked], pa.binary())], ["batch", "part", "blob"])

    asked = coded.select("batch", "texts").mapInArrow(ask, "batch long, part int, blob binary")
    answers = written(asked.repartition(parts, "part").groupBy("part").applyInArrow(_totals, "batch long, part int, blob binary, v long"), "answers")
    del asked
    release(spark)
    distinct_words = answers.agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]
    norm = total + 0.5 * (distinct_words + 1)
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def solve(texts: pa.Table, got: pa.Table) -> pa.Table:
        codes, hashes, sizes, aside = texts_of(texts["texts"][0].as_py())
        blobs = dict(zip(got["part"].to_pylist(), got["blob"]))
        counts = [np.concatenate(x) for x in zip(*(_unpack(blobs[p].as_py()) for p in sorted(blobs)))]
        keys, ends = gram_keys(hashes[codes], sizes, order, width)
        grams = []
        for at, ks in enumerate((keys[:1], keys[1:])):
            _, first, number = distinct(np.concatenate([*ks, np.zeros(0, np.uint64)]))
            low = 0
            for e in ends[:1] if not at else ends[1:]:
                high = low + len(e)
                mine = number[low:high]
                grams.append(Grams(e, mine, counts[at][mine], first[(first >= low) & (first < high)] - low))
                low = high
        scores = Automaton(codes, grams, len(hashes), norm, strengths).score(codes, sizes)
        c = grams[0].counts.astype(float)
        text = np.repeat(np.arange(len(sizes)), sizes)
        base = np.bincount(text, np.log10((c + 0.5) / norm), len(sizes))
        known = np.bincount(text, c > 0, len(sizes)).astype(np.int64)
        return pa.table([texts["ids"].combine_chunks().flatten(), pa.array(aside), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), total)), pa.array(base), pa.array(scores)], names)

    kinds = (kind, T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType())
    by_batch = lambda df: df.repartition(parts, "batch").groupBy("batch")
    return by_batch(coded.select("batch", "ids", "texts")).cogroup(by_batch(answers.select("batch", "part", "blob"))).applyInArrow(
        solve, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))
