"""Language-model scores: against the model's definition over plain counts, with nothing pruned; probabilities that sum to one."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mergrove.llm import lmscore


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None]


def corpus(seed, n=150):
    rng = random.Random(seed)
    common = ["The", "cat", "sat", "on", "mat", "é"]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(0, 40)):
            at = common.index(w[-1]) if w and w[-1] in common else 0
            last = common[(at + 1) % 6] if rng.random() < 0.7 else rng.choice(common)
            w.append(last if rng.random() < 0.9 else f"rare{rng.randrange(200)}")
        rows.append((i, " ".join(w)))
    twice = " ".join(f"once{i}" for i in range(30))
    return [*rows, (900, None), (901, ""), (902, "unseen words only"), (903, "the\tCAT\nsat"), (904, twice), (905, twice), (None, "a null id learns")]


def is_out(row_id):
    return row_id is not None and zlib.crc32(str(row_id).encode()) % 5 == 1


class Plain:
    """The same model from its definition."""

    def __init__(self, texts, order, strengths):
        self.n, self.order, self.strengths = Counter(), order, strengths
        for t in texts:
            for k in range(1, order + 1):
                self.n.update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
        ones = [c for g, c in self.n.items() if len(g) == 1]
        self.total, self.types = sum(ones), len(ones)

    def p(self, context, w):
        if not context:
            return (self.n[(w,)] + 0.5) / (self.total + 0.5 * (self.types + 1))
        s = self.strengths[len(context) - 1]
        return (self.n[(*context, w)] + s * self.p(context[1:], w)) / (self.n[context] + s)

    def score(self, t):
        return sum(math.log10(self.p(tuple(t[max(0, i - self.order + 1) : i]), w)) for i, w in enumerate(t))


@pytest.mark.parametrize(("order", "strengths", "batch"), [(1, (), 100), (2, (5.0,), 100), (3, (7.0, 2.0), 60), (3, (1000.0, 10.0), 10**6), (4, (9.0, 4.0, 1.5), 200)])
def test_against_counts(spark, order, strengths, batch):
    rows = corpus(order)
    model = Plain([tokens(t) for i, t in rows if not is_out(i)], order, strengths)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lmscore.score_texts(df, order=order, strengths=strengths, batch_tokens=batch).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        t = tokens(texts[r.id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (is_out(r.id), len(t), model.total)
        assert r.n_known == sum(model.n[(w,)] > 0 for w in t)
        assert r.base_score == pytest.approx(sum(math.log10(model.p((), w)) for w in t), rel=1e-9)
        assert r.score == pytest.approx(model.score(t), rel=1e-9)


def test_probabilities_sum_to_one():
    texts = [tokens(t) for _, t in corpus(9, 30)]
    words = sorted({w or "" for t in texts for w in t}) + ["never seen"]
    model = Plain(texts, 3, (6.0, 3.0))
    for context in [(), ("the",), ("the", "cat"), ("cat", "the"), ("never", "seen")]:
        assert sum(model.p(context, w or None) for w in words) == pytest.approx(1)


def test_automaton_follows_failure_arcs():
    # words 0, 1, 2; the text 0 1 0 2 was seen, so that 1 0 1 is new to the state (1, 0) and falls to (0)
    keys, ends = lmscore.gram_keys(np.array([10, 20, 10, 30], np.uint64), np.array([4]), 3, 40)
    grams = []
    for k, e in zip(keys, ends):
        found, first, number = lmscore.distinct(k)
        grams.append(lmscore.Grams(e, number, np.bincount(number)[number], first))
    m = lmscore.Automaton(np.array([0, 1, 0, 2]), grams, 3, 6.0, (2.0, 1.0))
    score = lambda tokens: float(m.score(np.array(tokens), np.array([len(tokens)]))[0])
    uni = [2.5 / 6, 1.5 / 6, 1.5 / 6]
    one_after_zero = (1 + 2 * uni[1]) / (2 + 2)
    assert 10 ** score([0]) == pytest.approx(uni[0])
    assert 10 ** score([0, 1]) == pytest.approx(uni[0] * one_after_zero)
    zero_after_one = (1 + 2 * uni[0]) / (1 + 2)
    seen = (1 + zero_after_one) / (1 + 1)
    assert 10 ** score([0, 1, 0]) == pytest.approx(uni[0] * one_after_zero * seen)
    assert 10 ** score([0, 1, 0, 1]) == pytest.approx(uni[0] * one_after_zero * seen * (1 / (1 + 1)) * one_after_zero)
    assert 10 ** score([2, 0]) == pytest.approx(uni[2] * 2 / (1 + 2) * uni[0])


def test_pieces_of_long_texts_score_as_whole_ones():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 700, 3, 64, 0, 129])
    hashes = rng.integers(0, 9, sizes.sum()).astype(np.uint64)
    keys, ends = lmscore.gram_keys(hashes, sizes, 3)
    grams = []
    for k, e in zip(keys, ends):
        _, first, number = lmscore.distinct(k)
        learned = (e > 100) & (e < 300)  # of these words alone, so that many n-grams are unseen
        grams.append(lmscore.Grams(e, number, np.bincount(number, learned)[number], first))
    codes = hashes.astype(np.int64)
    m = lmscore.Automaton(codes, grams, 9, 1000.0, (5.0, 2.0))
    whole = m.score(codes, sizes, 10**6)
    for piece in (1, 2, 3, 7, 64):
        assert np.allclose(m.score(codes, sizes, piece), whole)


def test_nothing_is_lost_as_the_corpus_grows(spark):
    """A text that occurs twice scores as high among many other texts as by its own counts."""
    twice = " ".join(f"pair{i}" for i in range(50))
    rows = [(i, " ".join(f"w{(i * 7919 + j * 31) % 5000}" for j in range(200))) for i in range(600)]
    rows += [(10_000, twice), (10_002, twice)]
    got = {r.id: r for r in lmscore.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), batch_tokens=5000).collect()}
    learned = sum(not is_out(i) for i in (10_000, 10_002))
    assert learned
    model = Plain([tokens(t) for i, t in rows if not is_out(i)], 3, (1000.0, 10.0))
    assert got[10_000].score == pytest.approx(model.score(tokens(twice)))
    assert got[10_000].score > got[10_000].base_score * 0.5


def test_odd_input(spark):
    df = spark.createDataFrame([(None, None, 1, "x"), (None, "a b", 2, "y"), (3, "a b", None, "z")], "doc_id long, text string, TEXT int, Doc_ID string")
    got = lmscore.score_texts(df).collect()
    assert len(got) == 3 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert lmscore.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = next(i for i in range(100) if is_out(i))
    held = spark.createDataFrame([(out, "a b c"), (out, None)], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in lmscore.score_texts(held).collect()} == {(0, 0, 0.0, 0.0)}
    with pytest.raises(ValueError, match="order"):
        lmscore.score_texts(df, order=9)
