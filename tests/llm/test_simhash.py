"""SimHash: fingerprints and components against brute force."""

import random
import re

import numpy as np
import xxhash

from mergrove.llm import simhash

SCHEMA = "doc_id long, text string"


def brute_print(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_matches_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["ab", "Cd", "é", "ÀB", "x1", "yy"]) + str(rng.randrange(30)) for _ in range(300)) for _ in range(12)]
    texts = list(base)
    for b in base:
        for _ in range(6):
            w = b.split(" ")
            w[rng.randrange(len(w))] = "new"
            texts.append("\t".join(w))
    texts += [None, "", " \n", "One", "one two", "ONE two", "one two three", base[0]]
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {r.id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.id: r.component_id for r in got} == brute_components(prints)


def test_split_trees_and_chains(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints)[:5]:
        for _ in range(80):
            p ^= 1 << rng.randrange(64)
            prints.add(p)
    for size in (3, 50, 2048):
        rows = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
        from mergrove.llm.components import components

        found = {r.node: r.component for r in components(simhash.links(rows, 2, size)).collect()}
        want = brute_components({p: p for p in prints})
        groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
        signed = {int(np.uint64(k).view(np.int64)): v for k, v in want.items()}
        alone = [g for g in groups(signed) if len(g) > 1]
        assert sorted(g for g in groups(found) if len(g) > 1) == alone


def test_odd_input(spark):
    empty = simhash.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["id", "fingerprint", "component_id"]
    rows = [(None, "a b c d", 1, 2), (4, "a b c d", 1, 2), (4, "a b c d", 1, 2), (9, None, 1, 2), (7, "w " * 60000, 1, 2)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, Text int, fp int").toDF("doc_id", "text", "component_id", "fp"))
    assert sorted((str(r.id), r.component_id) for r in got.collect()) == [("4", 4), ("4", 4), ("7", 7), ("9", 9), ("None", 4)]


def test_tables_are_deleted(spark):
    from mergrove.llm import common

    common.clean(spark)
    table = common.written(spark.range(5).toDF("n"), "test")
    assert table.count() == 5
    files = table.inputFiles()
    common.clean(spark)
    import os

    assert files and not os.path.exists(files[0].removeprefix("file://"))
