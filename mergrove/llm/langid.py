"""Language identification: sparse multinomial logistic regression on TF-IDF weights of character n-grams.

N-grams of one to three characters are hashed into a fixed table of columns.  Document frequencies are counted
over all training documents.  Weights are learned with follow-the-regularised-leader (per-coordinate rates, L1 and
L2 penalties, so most stay exactly zero) on a bounded sample; on a part of that sample kept aside, one
temperature is then fitted so that scores are honest probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import take

UNDETERMINED = "und"
#: Columns of the hashed table, and the n-gram orders.
COLUMNS, ORDERS = 1 << 14, (1, 2, 3)
_STEP = np.uint32(0x9E3779B1)


class _Fold:
    """``str.translate`` table that folds case and blanks non-letters, filled as characters are met."""

    def __init__(self):
        self.table: dict[int, str] = {}

    def __getitem__(self, code: int) -> str:
        if code not in self.table:
            c = chr(code).lower()
            self.table[code] = c if c.isalpha() else " "
        return self.table[code]


_FOLD = _Fold()


def grams(text: str | None) -> np.ndarray | None:
    """Counts of the text's n-grams by column; ``None`` if it has no letter."""
    folded = " ".join((text or "").translate(_FOLD).split())
    if not folded:
        return None
    codes = np.frombuffer(f" {folded} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(COLUMNS, np.int64)
    key = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        key = (key[: len(codes) - n + 1] * np.uint32(31) + codes[n - 1 :]) * _STEP
        key ^= key >> np.uint32(15)
        if n in ORDERS:
            counts += np.bincount(key & np.uint32(COLUMNS - 1), minlength=COLUMNS)
    return counts


def weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of TF-IDF with damped term counts, each of length one."""
    x = np.log1p(counts) * idf
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return softmax((weights(counts, self.idf) @ self.weights + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5,
                  epochs: int = 6, batch: int = 16, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights (columns by classes) and bias by FTRL-proximal on small batches of sparse rows (columns, values), in a
    fixed shuffled order."""
    z = np.zeros((COLUMNS + 1, classes))
    n = np.zeros_like(z)
    keep = np.ones((COLUMNS + 1, 1))
    keep[-1] = 0.0  # the bias has no penalty

    def solve(at) -> np.ndarray:
        zr, nr, kr = z[at], n[at], keep[at]
        w = -(zr - np.sign(zr) * l1 * kr) / ((beta + np.sqrt(nr)) / alpha + l2 * kr)
        return np.where(np.abs(zr) <= l1 * kr, 0.0, w)

    order = np.random.default_rng(seed)
    target = np.eye(classes)[y]
    for _ in range(epochs):
        mix = order.permutation(len(rows))
        for start in range(0, len(mix), batch):
            b = mix[start : start + batch]
            at = np.unique(np.concatenate([rows[i][0] for i in b] + [[COLUMNS]]))
            part = np.zeros((len(b), len(at)))
            for k, i in enumerate(b):
                part[k, np.searchsorted(at, rows[i][0])] = rows[i][1]
            part[:, -1] = 1.0
            w = solve(at)
            g = part.T @ (softmax(part @ w) - target[b])
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = solve(np.arange(COLUMNS + 1))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log-loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    low, high, golden = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(row_id, folds: int = 4, fold: int = 2):
    return F.coalesce(F.crc32(row_id.cast("string")) % folds == fold, F.lit(False))


def frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of ``rows(text)`` each column occurs, and how many have letters: one short vector a task, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(COLUMNS, np.int64), 0
        for b in batches:
            for t in b.column(0):
                if (c := grams(t.as_py())) is not None:
                    seen += c > 0
                    n += 1
        if n:
            cells = np.r_[seen, n]
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at])], ["cell", "n"])

    out = np.zeros(COLUMNS + 1, np.int64)
    for r in rows.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out[:-1], int(out[-1])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_fit: int = 8000, max_languages: int = 500) -> Model:
    """Learn from rows outside the held-out fold that have a language and letters.

    Document frequencies come from all of them; weights and temperature from at most ``max_fit``, as many of each
    language (those with the smallest hashes of their id).
    """
    rows = take(docs, id=id_col, text=text_col, lang=lang_col).where("text is not null and lang is not null").where(~held_out(F.col("id")))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = tuple(sorted(counts))
    df, n = frequencies(rows)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    if not languages or not n:
        return Model(languages or (UNDETERMINED,), idf, np.zeros((COLUMNS, max(1, len(languages)))), np.zeros(max(1, len(languages))), 1.0)
    # a hash of id and text picks about ``each`` different rows a language, however often a row repeats; the exact bound is applied below
    each = max(1, max_fit // len(languages))
    span = 1 << 40
    chance = F.element_at(F.create_map(*[F.lit(v) for k in languages for v in (k, min(span, int(1.3 * span * each / counts[k]) + 1))]), F.col("lang"))
    hashed = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(span)).alias("h"), F.col("lang").cast("string").alias("lang"), "text")
    picked = hashed.where(F.col("h") < chance).groupBy("h", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(h, lang, c) for h, lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)) if (c := grams(t.as_py())) is not None]
            cells = [np.flatnonzero(c) for _, _, c in got]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _, _ in got], pa.int64()), pa.array([x for _, x, _ in got], pa.string()),
                 pa.array([c.astype(np.int16).tobytes() for c in cells], pa.binary()),
                 pa.array([c[i].astype(np.int32).tobytes() for (_, _, c), i in zip(got, cells)], pa.binary())], ["h", "lang", "cells", "n"])

    found = picked.select("h", "lang", "text").mapInArrow(run, "h long, lang string, cells binary, n binary").collect()
    by_lang: dict[str, int] = {}
    x, y = [], []
    for r in sorted(found, key=lambda r: (r.h, r.lang, bytes(r.cells), bytes(r.n))):
        by_lang[r.lang] = by_lang.get(r.lang, 0) + 1
        if by_lang[r.lang] <= each:
            cells = np.frombuffer(r.cells, np.int16)
            x.append((cells, weights(np.frombuffer(r.n, np.int32)[None], idf[cells])[0]))
            y.append(languages.index(r.lang))
    if not x:
        return Model(languages, idf, np.zeros((COLUMNS, len(languages))), np.zeros(len(languages)), 1.0)
    y, aside = np.array(y), np.arange(len(y)) % 5 == 4
    w, b = follow_leader([r for r, a in zip(x, aside) if not a], y[~aside], len(languages))
    logits = np.array([v @ w[c] + b for (c, v), a in zip(x, aside) if a]).reshape(-1, len(languages))
    return Model(languages, idf, w.astype(np.float32), b, calibrate(logits, y[aside]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for every row: one narrow pass over whole texts; ``score`` is the language's probability."""
    rows = take(docs, id=id_col, text=text_col)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], object)
        for batch in batches:
            best, score = np.full(batch.num_rows, len(m.languages)), np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, 128):
                counts = [grams(t.as_py()) for t in batch.column(1).slice(at, 128)]
                some = [i for i, c in enumerate(counts) if c is not None]
                if some:
                    p = m.probabilities(np.array([counts[i] for i in some]))
                    best[at + np.array(some)], score[at + np.array(some)] = p.argmax(1), p.max(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    kind = rows.schema["id"]
    return rows.mapInArrow(run, T.StructType([kind, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """``(id, held_out, lang_pred, score)`` for every row.

    Null texts and texts without letters are ``und`` with score 0.  Null ids are never held out; rows with null
    text or language teach nothing but are predicted; repeated rows and other columns change nothing; an empty
    table gives no row; without anything to learn from all is ``und``.
    """
    found = predict(docs, train(docs, id_col, text_col, lang_col, **options), id_col, text_col)
    return found.select("id", held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
