"""Mixing: windows kept, deviation from the target weights below one block, every row placed once."""

from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mergrove.llm import mixing

UNEVEN = {"a": 0.5752, "b": 0.3499, "c": 0.0750}


def hold(found, weights, blocks):
    """Every block once, within its window, a slot each, and less than one block off the target while all sources last."""
    total = sum(weights.values())
    assert Counter((s, j) for s, j, *_ in found) == Counter({(s, j): 1 for s, n in blocks.items() for j in range(1, n + 1)})
    assert len({x[4] for x in found}) == len(found)
    for s, j, release, deadline, slot in found:
        w = Fraction(weights[s], total)
        assert release == (j - 1) // w and deadline == -(-j // w) and release <= slot < deadline
    last = min(max(x[4] for x in found if x[0] == s) for s in weights)
    seen = Counter()
    for t, (s, *_) in enumerate(sorted((x for x in found if x[4] <= last), key=lambda x: x[4]), 1):
        seen[s] += 1
        assert all(abs(seen[n] * total - t * w) < total for n, w in weights.items())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 400), min_size=1), st.integers(1, 60), st.integers(0, 50))
def test_segments_keep_all_windows(weights, n, step):
    blocks = {s: 1 + n * w // max(weights.values()) for s, w in weights.items()}
    total = sum(weights.values())
    length = max(mixing.window(blocks[s], w, total)[1] for s, w in weights.items())
    whole = list(mixing.schedule(weights, blocks))
    hold(whole, weights, blocks)
    step += mixing.longest(weights)
    cuts = [(at, at + step if at + step < length else None) for at in range(0, length, step)]
    hold([x for start, end in cuts for x in mixing.schedule(weights, blocks, start, end)], weights, blocks)


def test_long_uneven_targets_do_not_drift():
    weights = mixing.whole(UNEVEN)
    total = sum(weights.values())
    for t in (10**6, 10**9 + 7, 10**13 + 1):
        found = list(mixing.schedule(weights, {s: 10**15 for s in weights}, t, t + 500))
        assert [x[4] for x in found] == list(range(t, t + 500))
        for s, w in weights.items():
            js = [x[1] for x in found if x[0] == s]
            assert abs(js[0] - 1 - Fraction(w * t, total)) < 2 and abs(js[-1] - Fraction(w * (t + 500), total)) < 1
            assert js == list(range(js[0], js[-1] + 1))


def test_whole_is_exact():
    out = mixing.whole({"x": Fraction(1, 3), "y": Fraction(1, 2), "z": 0.25})
    assert out == {"x": 4, "y": 6, "z": 3}
    floats = mixing.whole(UNEVEN)
    assert all(Fraction(floats[a], floats[b]) == Fraction(UNEVEN[a]) / Fraction(UNEVEN[b]) for a in floats for b in floats)
    for bad in ({"a": 0.0}, {"a": -1.0}, {"a": float("inf")}, {"a": float("nan")}):
        with pytest.raises(ValueError, match="weights"):
            mixing.whole(bad)


def test_every_row_has_its_place(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 9}") for i in range(500)] + [(1000 + i, None) for i in range(7)] + [(None, "s0"), (None, "s0"), (5, "big")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, source string, text string, SLOT int").withColumnRenamed("SLOT", "slot")
    weights = {"big": 0.5, "s0": 0.3, "s3": 0.1, "s6": 0.05}
    for segment in (4, 4096):
        out = mixing.mix(df, weights, block=4, range_rows=16, segment=segment)
        assert out.columns == ["doc_id", "source", "text", "slot", "block", "release", "deadline", "slot"]
        got = [tuple(r) for r in out.collect()]
        assert Counter(g[:2] for g in got) == Counter(rows)
        blocks = defaultdict(Counter)
        for g in got:
            blocks[g[1] or ""][g[4]] += 1
        for c in blocks.values():
            assert all(v == 4 for b, v in c.items() if b < max(c))
        hold(list({(g[1] or "", *g[4:]) for g in got}), mixing.whole({**weights, "": 0.05}), {s: max(c) for s, c in blocks.items()})


def test_order_of_files_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i % 3}", str(i)) for i in range(300)], "doc_id long, source string, text string")
    mixed = {r.doc_id: r.slot for r in mixing.mix(df).select("doc_id", "slot").collect()}
    mixing.in_order(df, 5).write.parquet(str(tmp_path / "m"))
    out = spark.read.parquet(str(tmp_path / "m")).selectExpr("*", "_metadata.file_path as f", "_metadata.row_index as i").orderBy("f", "i").collect()
    assert len(out) == 300 and [mixed[r.doc_id] for r in out] == sorted(mixed.values())
    none = spark.createDataFrame([], "doc_id long, source string")
    assert mixing.mix(none).count() == 0 and mixing.in_order(none, 3).count() == 0
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(df, max_sources=2)
