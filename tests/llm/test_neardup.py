"""Embedding near-duplicates against brute force."""

import math

import numpy as np

from mergrove.llm import neardup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine):
    """rows: (id, vector or None) -> {id: (links, component)}; ids are unique."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(parent, 0)
    for n, (i, a) in enumerate(good):
        for j, b in good[:n]:
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (links[i], root(i)) for i, _ in rows}


def data(rng, n, dim):
    rows = [(int(i), rng.normal(size=dim).tolist()) for i in range(n)]
    base = rng.normal(size=dim)
    rows += [(1000 + i, (base + rng.normal(size=dim) * 0.2 * (i % 4)).tolist()) for i in range(60)]
    rows += [(2000 + i, rows[i % 3][1]) for i in range(25)] + [(3000, (np.array(rows[0][1]) * 7).tolist())]
    return rows


def test_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    # the second and fourth have as many pivots as rows ask for, the others as many as the bytes allow
    for dim, cosine, sizes, kind in ((8, 0.95, (40, 15, 4 * 64), SCHEMA), (3, 0.9, (10, 7, 1 << 20), SCHEMA), (16, 0.8, (4096, 4096, 4), SCHEMA), (6, 0.9, (3, 9, 1 << 20), SCHEMA.replace("float", "double"))):
        rows = data(rng, 120, dim)
        df = spark.createDataFrame([(*r, 1) for r in rows], kind)
        got = neardup.near_duplicates(df, cosine=cosine, cell_rows=sizes[0], chunk_rows=sizes[1], pivot_bytes=sizes[2]).collect()
        assert {r.id: (r.n_links, r.component_id) for r in got} == brute(rows, cosine)
        assert all(r.kept == (r.id == r.component_id) for r in got) and len(got) == len(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e-38, 0.0]), (12, [3e38, 1e38])]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    want = brute([r for r in rows if r[0] < 11], 0.95)
    assert {i: v[:2] for i, v in got.items() if 2 < i < 11} == {i: v for i, v in want.items() if i > 2}
    assert got[1] == (2, 1, True) and got[11] == (2, 1, False) and got[12] == (0, 12, True)


def test_null_repeated_and_empty(spark):
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (7, [0.0, 1.0], None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rep", "2 as VEC")).collect()
    assert sorted((str(r.id), r.n_links, r.component_id, r.kept) for r in got) == [("5", 1, 5, True), ("5", 1, 5, True), ("7", 0, 7, True), ("None", 0, None, False)]
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    named = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.01]), ("c", [0.0, 1.0])], "vec_id string, embedding array<double>")
    assert {r.id: (r.n_links, r.component_id) for r in neardup.near_duplicates(named).collect()} == {"a": (1, "a"), "b": (1, "a"), "c": (0, "c")}
    assert neardup.near_duplicates(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect()[0].n_links == 0
