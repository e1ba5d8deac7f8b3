"""Near-duplicates by SimHash and shingle sets: against all pairs, and planted copies through the pipeline's stage."""

import random
import re

import corpus_pipeline
from mergrove.llm import similar

SCHEMA = "doc_id long, text string"


def brute_set(text, width=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute_kept(rows, width=5, similarity=0.8):
    sets = {i: brute_set(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in sets if find(i) == i}


def planted(rng, originals, copies, length):
    """Texts, and copies of each with a few words changed."""
    rows = []
    for i in range(originals):
        base = [f"w{rng.randrange(5000)}" for _ in range(length(rng))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(copies):
            w = list(base)
            for at in rng.sample(range(len(w)), rng.randrange(0, 4)):
                w[at] = "changed"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_matches_all_pairs(spark):
    rng = random.Random(2)
    menu = " ".join(f"menu{i}" for i in range(40))
    rows = planted(rng, 40, 4, lambda r: r.randrange(3, 160))
    rows += [(i + len(rows), f"{menu} {t}") for i, t in enumerate(t for _, t in rows[:60])]
    rows += [(i + 1000, t) for i, t in enumerate([None, "", " \n", "One two", "ONE  two", "one two three four five"])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for similarity in (0.8, 0.95):
        got = [r.doc_id for r in similar.keep_one(df, similarity=similarity).collect()]
        assert sorted(got) == sorted(brute_kept(rows, similarity=similarity))


def test_order_of_shingles_changes_nothing(spark):
    rows = planted(random.Random(4), 20, 4, lambda r: 80)
    df = spark.createDataFrame(rows, SCHEMA)
    none, all_of_it = ({r.doc_id for r in similar.keep_one(df, sample_bytes=n).collect()} for n in (1, 1 << 30))
    assert none == all_of_it == brute_kept(rows)


def test_chunks_that_no_row_falls_into(spark):
    rows = planted(random.Random(8), 4, 5, lambda r: 80)
    df = spark.createDataFrame(rows, SCHEMA)
    for options in ({"tree_size": 1, "sample_bytes": 1 << 30}, {"chunk_shingles": 60}):
        assert {r.doc_id for r in similar.keep_one(df, **options).collect()} == brute_kept(rows)


def test_stage_removes_planted_near_copies(spark):
    # one word of a hundred: similarity 91 / 101, most of them more than 2 bits of a 3-word SimHash away
    rng, rows = random.Random(6), []
    for i in range(50):
        w = [f"w{rng.randrange(9000)}" for _ in range(100)]
        rows.append((i, " ".join(w), "s"))
        w[50] = "changed"
        rows.append((100 + i, " ".join(w), "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, df, "").collect()} == set(range(50))


def test_ids_null_and_repeated(spark):
    texts = ["a b c d e f", "x y z u v"]
    rows = [(5, texts[0]), (3, texts[0]), (9, texts[1]), (None, texts[1]), (3, texts[0]), (9, "quite different words in here")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    out = similar.keep_one(df)
    assert out.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(3, texts[0]), (9, texts[1]), (None, texts[1]), (9, "quite different words in here")]))
    assert similar.keep_one(df.limit(0)).count() == 0
