"""Quality rules against a plain Python version."""

import random
import re
from collections import Counter

import pytest

from mergrove.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", "  \n\t", "a", "a a a a a", "x y z x y z", "the of and " * 40, "um * # | <b> \U0001f600 é q\n" * 20,
    "l1\nl1\n\nl1\r\nl2 \nl2", " ".join(f"w{i} the of" for i in range(80)), "a b c d a b c e b c d f",
]


def test_counts_and_verdict(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (3, "a"), (90, "word the and " * 20000)]
    got = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = Counter((i, *brute(t)) for i, t in rows)
    assert Counter((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert {r.id for r in got if r.kept} == {9}


def plain_verdict(text):
    n, chars, symbols, dups, repeats = brute(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    stops = sum(w.rstrip(".,;:!?").lower() in {x for v in rules.STOP_WORDS.values() for x in v} for w in words)
    failed = n < 50 or 100 * repeats > 50 * n
    return not failed and 2 <= chars / n <= 12 and symbols / n <= 0.1 and stops / n >= 0.02 and dups / len(lines) <= 0.5 and (text or "").count("!") / n <= 0.5


def test_verdict_against_plain_version(spark):
    rng = random.Random(8)
    pool = ["the", "Of,", "und", "w#", "a!", "!!", "supercalifragilistic", "b", "##", "x|y"]
    texts = []
    for i in range(200):
        kind = rng.choices(pool, k=rng.randrange(1, 4)) + ["stone", "river"] * rng.randrange(4)
        texts.append("".join(rng.choice(kind) + str(rng.randrange(400)) * rng.randrange(2) + rng.choice([" ", " ", " ", "\n"]) for _ in range(rng.randrange(30, 160))))
    texts += [f"{'the ' * k}" + " ".join(f"word{i}" for i in range(100 - k)) for k in range(5)]
    got = {r.id: r.kept for r in rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {i: plain_verdict(t) for i, t in enumerate(texts)}
    assert got == want and 10 < sum(want.values()) < 190


def test_empty_and_unknown(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, TEXT int, kept int")
    assert rules.quality_rules(empty).count() == 0
    with pytest.raises(ValueError):
        rules.quality_rules(empty, rules=(rules.Rule("nope", low=1),)).count()
