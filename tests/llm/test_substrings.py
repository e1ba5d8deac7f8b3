"""Substring dedup against a plain version."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from mergrove.llm import substrings


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {k for s in range(len(w) - window + 1) if seen[tuple(w[s : s + window])] > 1 for k in range(s, s + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept, tuple(sorted(gone))))
    return out


def corpus(seed, window):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(9))
    shared = [[word() for _ in range(window + rng.randrange(-1, 12))] for _ in range(4)]
    rows = []
    for i in range(40):
        w = [word() for _ in range(rng.randrange(0, 90))]
        for s in rng.sample(shared, rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = s
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(100, "x " * (window + 3)), (101, "p q r " * window), (102, None), (103, ""), (104, " ".join(shared[0])), (105, rows[3][1]), (106, "x " * (window - 1)), (107, "É é " * window)]
    return rows


@pytest.mark.parametrize(("seed", "window", "batch"), [(1, 8, 50), (2, 11, 300), (3, 35, 700_000), (4, 20, 1)])
def test_matches_plain_version(spark, seed, window, batch):
    rows = corpus(seed, window)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, window)
    out = substrings.substring_dedup(df, window=window, batch_words=batch, texts=True)
    assert out.columns == ["id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"]
    got = out.collect()
    flat = lambda r: tuple(k for s in r.spans for k in range(s.start, s.end))
    assert sorted((r.id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text, flat(r)) for r in got) == sorted(want)
    digest = substrings.substring_dedup(df, window=window, batch_words=batch).collect()
    assert sorted((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in digest) == sorted(w[:4] for w in want)


def test_crowded_anchors(spark):
    """Anchors of many occurrences: their suffixes are dealt one by one, and nothing changes."""
    rows = corpus(6, 12) + [(200 + i, f"a{i} b{i} " + "the same long passage of words that very many of the documents have in the midst of them " + f"c{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(w[:4] for w in brute(rows, 12))
    for crowd, batch in ((1, 100), (3, 10**6), (40, 300)):
        got = substrings.substring_dedup(df, window=12, batch_words=batch, crowd=crowd).collect()
        assert sorted((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


def test_patterns_that_weaken_polynomial_hashes(spark):
    """Thue-Morse words of two letters and their complements: polynomials modulo a power of two tell them apart badly."""
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    rows = [(0, " ".join("ab"[b] for b in bits)), (1, " ".join("ba"[b] for b in bits)), (2, " ".join("xy"[b] for b in bits[:2048])), (3, " ".join("xy"[b] for b in bits[1024:3000]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for window in (35, 64):
        got = substrings.substring_dedup(df, window=window, batch_words=1).collect()
        assert sorted((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(w[:4] for w in brute(rows, window))


@pytest.mark.parametrize("window", [8, 9, 16, 35])
def test_trees_compare_words_not_hashes(window):
    rng = np.random.default_rng(window)
    words = rng.integers(0, 2, 4000)
    words[500:600] = words[3000:3100]
    starts = np.flatnonzero(rng.random(4000 - window) < 0.7)
    seen = Counter(tuple(words[s : s + window]) for s in starts)
    assert substrings.grow(words, starts, window).tolist() == [seen[tuple(words[s : s + window])] > 1 for s in starts]
    assert substrings.grow(words[:0], starts[:0], window).tolist() == []


def test_repeated_rows_nulls_and_clashes(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (None, "a b"), (2, None), (3, "y " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as batch", "2 as WORDS", "3 as id")
    got = Counter((r.id, r.n_words, r.n_removed) for r in substrings.substring_dedup(df).collect())
    assert got == Counter({(1, 40, 40): 2, (None, 2, 0): 1, (2, 0, 0): 1, (3, 60_000, 60_000): 1})
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.substring_dedup(none).count() == 0
    with pytest.raises(ValueError):
        substrings.substring_dedup(none, window=3)
