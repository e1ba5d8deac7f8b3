"""Quality classifier: the discriminant against plain densities, held-out accuracy, and odd input."""

import math
import random
import re
import zlib

import numpy as np

from mergrove.llm import quality, queries


def test_score_is_the_posterior_of_two_gaussians():
    rng = np.random.default_rng(1)
    k = len(quality.FEATURES)
    x = np.r_[rng.normal(0, 1, (60, k)), rng.normal(1, 2, (90, k))]
    y = np.r_[np.zeros(60, int), np.ones(90, int)]
    model = quality.fit(x, y, pool=0.3, ridge=0.1)
    z = (x - x.mean(0)) / x.std(0)
    groups = [z[y == c] for c in (0, 1)]
    cov = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, cov)) / len(z)
    logs = []
    for g, c in zip(groups, cov):
        m = 0.7 * c + 0.3 * pooled
        m = 0.9 * m + 0.1 * np.trace(m) / k * np.eye(k)
        d = z - g.mean(0)
        logs.append(np.log((len(g) + 0.5) / 151) - 0.5 * np.linalg.slogdet(m)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(m), d))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-9)


def text(rng, good, n):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n)]
    if good:
        return ". ".join(" ".join(words[i : i + 8]).capitalize() for i in range(0, n, 8)) + "."
    return rng.choice([" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join([words[0]] * n), " ".join(w + "***" for w in words)])


def sample(n):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        rows.append((i, text(rng, good, rng.randrange(3, 200)), int(good)))
    return rows


def test_held_out_accuracy(spark):
    rows = sample(600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    # labels of the held-out fold are wrong: they must not be learned from
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = spark.createDataFrame([(i, 1 - q if fold(i) else q) for i, _, q in rows if i % 3], "doc_id long, quality int")
    got = {r.id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 600 and all(r.held_out == fold(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    right = [got[i].predicted == q for i, _, q in rows if fold(i)]
    assert sum(right) >= 0.97 * len(right)
    kept = quality.keep_good(docs.selectExpr("doc_id", "text", "1 as score"), labels)
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_odd_input(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (2, ""), (3, "w " * 60000)], "doc_id long, text string").selectExpr("*", "1 as TEXT_2", "2 as predicted")
    for labels in ([], [(1, 1)], [(1, 1), (2, 0), (2, 1), (None, 1), (3, None)]):
        got = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert sorted(str(r.id) for r in got) == ["1", "2", "2", "3", "None"] and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.classify(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def plain_statistics(t):
    """The thirteen statistics from their definitions, character by character."""
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, m = len(words), len(lines)
    size = lambda x: len(x.encode())
    count = lambda chars: sum(c in chars for c in t)
    rate = lambda k, of, grain=20.0: math.log1p(50.0 * k / (of + grain))
    upper, lower = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    return [
        math.log1p(n), math.log((sum(map(size, words)) + 55) / (n + 10)), rate(count("#*$%&<>@^~{}[]\\=+_`"), n), rate(count("!"), n), rate(count("|"), n),
        rate(upper, upper + lower, 100.0), math.log((len(set(words)) + 20) / (n + 20)), rate(count(".,;:?"), n), rate(m - len(set(lines)), m, 5.0),
        rate(count("0123456789"), n, 100.0), rate(m, n), rate(sum(a == b for a, b in zip(words, words[1:])), n),
        (sum(re.sub(r"[\x20\x09-\x0D]+$", "", x)[-1:] in ("." , "?") for x in lines) + 3) / (m + 3),
    ]


def test_query_against_plain_version(spark, tmp_path):
    """The whole query: statistics, choice of settings, fit and scores worked out again from the definitions."""
    rng = random.Random(3)
    rows = [(i, t) for i, t, _ in sample(150)] + [(1000, None), (1001, ""), (1002, "a | b\n\n a | b \nDone. \né?!"), (1003, "x y\nx y\n")]
    marks = {i: q for i, _, q in sample(150) if rng.random() < 0.8}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in marks.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op5_quality(spark, str(tmp_path)).collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    order = {r.i: r.h for r in spark.createDataFrame([(i,) for i in marks], "i long").selectExpr("i", "xxhash64(i) AS h").collect()}
    learn = sorted((i for i in marks if not fold(i)), key=lambda i: order[i])
    texts = dict(rows)
    x, y = np.array([plain_statistics(texts[i]) for i in learn]), np.array([marks[i] for i in learn])

    def logit(x, y, z, pool, ridge):
        centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        x, z = (x - centre) / scale, (z - centre) / scale
        groups = [x[y == c] for c in (0, 1)]
        cov = [(g - g.mean(0)).T @ (g - g.mean(0)) / len(g) for g in groups]
        pooled = sum(len(g) * c for g, c in zip(groups, cov)) / len(x)
        out = []
        for g, c in zip(groups, cov):
            m = (1 - pool) * c + pool * pooled
            m = (1 - ridge) * m + ridge * max(np.trace(m) / 13, 1e-3) * np.eye(13)
            d = z - g.mean(0)
            out.append(np.log((len(g) + 0.5) / (len(x) + 1)) - 0.5 * np.linalg.slogdet(m)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(m), d))
        return 1 / (1 + np.exp(np.clip(out[0] - out[1], -500, 500)))

    def loss(pool, ridge):
        p = np.zeros(len(y))
        for f in range(5):
            own = np.arange(len(y)) % 5 == f
            p[own] = logit(x[~own], y[~own], x[own], pool, ridge)
        right = np.clip(np.where(y == 1, p, 1 - p), 1e-6, 1)
        return -np.log(right[y == 0]).mean() - np.log(right[y == 1]).mean()

    pool, ridge = min(((loss(a, b), -a, -b) for a in quality.POOLS for b in quality.RIDGES), key=lambda v: (round(v[0], 9), *v[1:]))[1:]
    want = logit(x, y, np.array([plain_statistics(t) for _, t in rows]), -pool, -ridge)
    for (i, _), p in zip(rows, want):
        assert abs(got[i].score - p) < 1e-6 and got[i].held_out == fold(i) and got[i].predicted == (got[i].score >= 0.3)


def test_a_repeated_id_does_not_break_the_bound(spark):
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(300)] + [(2, "another one!!!")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    model_of = quality.fit
    quality.fit = lambda x, y, *a: seen.append(len(x)) or model_of(x, y, *a)
    try:
        quality.train(docs, labels, max_fit=7)
    finally:
        quality.fit = model_of
    assert max(seen) <= 7
