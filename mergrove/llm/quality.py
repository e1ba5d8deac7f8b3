"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class is a Gaussian over transformed statistics of the text.  Its covariance is shrunk towards the pooled
covariance and towards a scaled identity, so that statistics which never vary within a class do no harm.  The
Cholesky factors are computed once when the model is fitted; a score is the logistic of the difference of the
two log-densities, each a squared Mahalanobis distance and a log-determinant.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import take

FEATURES = (
    "words", "word_bytes", "symbols", "bangs", "pipes", "upper", "distinct", "stops", "dup_lines", "digits", "lines", "echo", "line_ends",
)


def _set(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_SYMBOLS, _STOPS, _DIGITS = _set("#*$%&<>@^~{}[]\\=+_`"), _set(".,;:?"), _set("0123456789")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text (null: as empty), in the order of ``FEATURES``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n, m = len(words), len(lines)
    bins = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(bins[65:91].sum()), int(bins[97:123].sum())
    # a rate of zero is zero at any length, and one hit in a short text is not much
    rate = lambda k, of, grain=20.0: np.log1p(50.0 * k / (of + grain))
    return [
        np.log1p(n),
        np.log((sum(map(len, words)) + 55.0) / (n + 10.0)),
        rate(int(bins[_SYMBOLS].sum()), n),
        rate(int(bins[33]), n),
        rate(int(bins[124]), n),
        rate(upper, upper + lower, 100.0),
        np.log((len(set(words)) + 20.0) / (n + 20.0)),
        rate(int(bins[_STOPS].sum()), n),
        rate(m - len(set(lines)), m, 5.0),
        rate(int(bins[_DIGITS].sum()), n, 100.0),
        rate(m, n),
        rate(sum(map(eq, words, words[1:])), n),
        (sum(x.rstrip()[-1:] in b".?" for x in lines) + 3.0) / (m + 3.0),
    ]


@dataclass(frozen=True)
class Model:
    """Per class: mean, Cholesky factor of the precision, constant (log prior - log determinant / 2)."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    const: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of statistics."""
        z = (x - self.centre) / self.scale
        logs = [c - 0.5 * (((z - m) @ w) ** 2).sum(1) for m, w, c in zip(self.means, self.whiten, self.const)]
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pool: float, ridge: float) -> Model:
    """Fit both classes; ``pool`` mixes in the pooled covariance, ``ridge`` a scaled identity.

    Without rows of a class, its Gaussian is the pooled one with a prior of half a row.
    """
    x = np.asarray(x, float).reshape(-1, len(FEATURES))
    centre = x.mean(0) if len(x) else np.zeros(len(FEATURES))
    scale = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(len(FEATURES))
    z = (x - centre) / scale
    groups = [z[y == k] for k in (0, 1)]
    means = [g.mean(0) if len(g) else np.zeros(z.shape[1]) for g in groups]
    scatter = [(g - m).T @ (g - m) for g, m in zip(groups, means)]
    pooled = sum(scatter) / max(1, len(z))
    whiten, const = [], []
    for g, s in zip(groups, scatter):
        own = s / len(g) if len(g) else pooled
        mixed = (1 - pool) * own + pool * pooled
        mixed = (1 - ridge) * mixed + ridge * max(np.trace(mixed) / len(mixed), 1e-3) * np.eye(len(mixed))
        factor = np.linalg.cholesky(mixed)
        whiten.append(np.linalg.inv(factor).T)
        const.append(np.log((len(g) + 0.5) / (len(z) + 1.0)) - np.log(np.diag(factor)).sum())
    return Model(centre, scale, np.array(means), np.array(whiten), np.array(const))


#: What :func:`choose` tries.
POOLS, RIDGES = (0.1, 0.3, 0.5, 0.7, 0.9), (0.005, 0.02, 0.08)


def choose(x: np.ndarray, y: np.ndarray, folds: int = 5) -> tuple[float, float]:
    """``pool`` and ``ridge`` by cross-validation over the rows given, none else: the least mean log loss on the fold left
    out, each class weighing the same; ties go to more pooling, then to the larger ridge.  Row ``i`` is in fold ``i % folds``."""
    fold = np.arange(len(y)) % folds
    seen = [k for k in (0, 1) if (y == k).any()]
    best = (np.inf, 0.0, 0.0)
    for pool in POOLS if len(seen) == 2 and len(y) >= 2 * folds else POOLS[-1:]:
        for ridge in RIDGES if len(y) >= 2 * folds else RIDGES[-1:]:
            p = np.full(len(y), 0.5)
            for f in range(folds if len(y) >= 2 * folds else 0):
                p[fold == f] = fit(x[fold != f], y[fold != f], pool, ridge).score(x[fold == f])
            right = np.clip(np.where(y == 1, p, 1 - p), 1e-6, 1)
            loss = sum(-np.log(right[y == k]).mean() for k in seen)
            best = min(best, (round(float(loss), 12), -pool, -ridge))
    return -best[1], -best[2]


def held_out(row_id, folds: int = 5, fold: int = 0):
    """Whether crc32 of the id as text leaves ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(row_id.cast("string")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_fit: int = 20_000) -> Model:
    """Fit on at most ``max_fit`` labelled rows outside the held-out fold, those with the smallest hashes of their id.

    How far the covariances are shrunk is chosen by cross-validation among these rows.  The driver gets their
    statistics alone, and no more than ``max_fit`` of them, however often an id repeats.
    """
    spark = docs.sparkSession
    marks = take(labels, id=id_col, label=label_col).where("id is not null and label is not null")
    marks = marks.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    chosen = [(r.id, int(r.label)) for r in marks.orderBy(F.xxhash64("id"), "id").limit(max_fit).collect()]
    few = F.broadcast(spark.createDataFrame(chosen, f"id {marks.schema['id'].dataType.simpleString()}, label int"))
    rows = take(docs, id=id_col, text=text_col).join(few, "id").select(F.xxhash64("id").alias("h"), "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = pa.array([statistics(t.as_py()) for t in b.column(2)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), stats], ["h", "label", "stats"])

    got = rows.mapInArrow(run, "h long, label int, stats array<double>").orderBy("h", "label", "stats").limit(max_fit).collect()
    x, y = np.array([r.stats for r in got]).reshape(-1, len(FEATURES)), np.array([r.label for r in got], int)
    return fit(x, y, *choose(x, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row: one narrow pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = np.array([statistics(t.as_py()) for t in b.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(stats))], ["id", "score"])

    rows = take(docs, id=id_col, text=text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **columns) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row of ``docs``.

    Labels are learned only from rows that are not held out.  Null and empty texts are scored as empty ones; null
    ids, repeated rows and other columns change nothing; without labels every score rests on the prior alone; an
    empty table gives no row.
    """
    model = train(docs, labels, **columns)
    rows = score(docs, model, **{k: v for k, v in columns.items() if k in ("id_col", "text_col")})
    return rows.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **columns) -> DataFrame:
    """The rows and columns of ``docs`` whose whole text scores ``threshold`` or more.

    Null and empty texts are scored as empty ones; rows with a null id and repeated rows are judged like any other; other
    columns pass through, clashing names included; without labels all scores rest on the prior alone; an empty table
    gives an empty one.
    """
    text_col = columns.get("text_col", "text")
    model = train(docs, labels, **columns)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = np.array([statistics(t.as_py()) for t in b.column(at)]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(stats) >= threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
