"""The ten operators: lowering against the plain evaluator, and the cases that are easily got wrong."""

import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from mergrove import api  # noqa: E402
from mergrove.errors import IllegalArgument, NoStrategy  # noqa: E402
from mergrove.operators import joins  # noqa: E402
from mergrove.plans.flags import OperatorFlags, Strategy, register_strategy, unregister_strategy  # noqa: E402
from mergrove.plans.plan import Distinct, Empty, Join, Leaf, Merge, Project, Slice, Union  # noqa: E402
from mergrove.plans.reorder import reorder  # noqa: E402
from mergrove.sources.tables import TableSource  # noqa: E402


def table(spark, names, rows, **options):
    kind = options.pop("kind", "int")
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} {kind}" for n in names))
    return Leaf(TableSource(df, **options))


def rows_of(plan, spark):
    df = api.run(plan, spark)
    assert tuple(df.columns) == plan.public_vars
    return Counter(tuple(r) for r in df.collect())


def dicts(names, rows):
    return [dict(zip(names, r)) for r in rows]


def relation(rng, names, most, null):
    return [tuple(None if rng.random() < null else rng.randrange(3) for _ in names) for _ in range(rng.randrange(most))]


@pytest.mark.parametrize("seed", range(8))
def test_joins_match_plain_evaluator(spark, seed):
    rng = random.Random(seed)
    a, b = ["k", "x", "y"], ["y", "x", "z"]
    left, right = relation(rng, a, 9, 0.3), relation(rng, b, 9, 0.3)
    if seed % 3 == 1:  # x certain on both sides: the key of the mixed join
        fill = lambda rows, at: [tuple(1 if i == at and v is None else v for i, v in enumerate(r)) for r in rows]
        left, right = fill(left, 1), fill(right, 1)
    sure = ("x",) if seed % 3 == 1 else ()
    l, r = table(spark, a, left, never_null=sure), table(spark, b, right, never_null=sure)  # noqa: E741
    dl, dr = dicts(a, left), dicts(b, right)
    both = ["k", "x", "y", "z"]
    assert rows_of(l.join(r), spark) == brute.bag(brute.join(dl, dr), both)
    assert rows_of(l.left_join(r), spark) == brute.bag(brute.left_join(dl, dr, both), both)
    assert rows_of(l.exists(r), spark) == brute.bag(brute.exists(dl, dr), a)
    assert rows_of(l.not_exists(r), spark) == brute.bag(brute.exists(dl, dr, True), a)
    assert rows_of(l.minus(r), spark) == brute.bag(brute.minus(dl, dr), a)


@pytest.mark.parametrize(("n", "seed"), [(2, 1), (3, 2), (4, 3), (5, 4)])
def test_joins_on_several_uncertain_variables(spark, n, seed):
    """Any of the shared variables may be unbound: each set of them that two rows have in common, none included."""
    rng = random.Random(seed)
    shared = [f"v{i}" for i in range(n)]
    a, b = ["x", *shared], [*shared, "y"]
    left, right = ([tuple(None if rng.random() < 0.4 else rng.randrange(2) for _ in names) for _ in range(14)] for names in (a, b))
    l, r = table(spark, a, left), table(spark, b, right)  # noqa: E741
    dl, dr, both = dicts(a, left), dicts(b, right), ["x", *shared, "y"]
    assert rows_of(l.join(r), spark) == brute.bag(brute.join(dl, dr), both)
    assert rows_of(l.left_join(r), spark) == brute.bag(brute.left_join(dl, dr, both), both)
    assert rows_of(l.exists(r), spark) == brute.bag(brute.exists(dl, dr), a)
    assert rows_of(l.not_exists(r), spark) == brute.bag(brute.exists(dl, dr, True), a)
    assert rows_of(l.minus(r), spark) == brute.bag(brute.minus(dl, dr), a)
    # with a condition over both sides
    told = r.filter("?y = ?x")
    fits = lambda x, y: brute.compatible(x, y) and x["x"] is not None and x["x"] == y["y"]
    assert rows_of(l.join(told), spark) == brute.bag([brute.merged(x, y) for x in dl for y in dr if fits(x, y)], both)
    assert rows_of(l.exists(told), spark) == brute.bag([x for x in dl if any(fits(x, y) for y in dr)], a)
    assert rows_of(l.not_exists(told), spark) == brute.bag([x for x in dl if not any(fits(x, y) for y in dr)], a)


def test_copies_beyond_one_run(spark):
    """A row that Merge has to repeat more often than one array may hold."""
    many = spark.range(10_000).selectExpr("1 AS x", "2 AS y").union(spark.createDataFrame([(3, 4)], "x int, y int"))
    few = table(spark, ["x", "y"], [(1, 2), (3, 4), (3, 4)])
    got = api.run(api.merge(Leaf(TableSource(many)), few), spark).groupBy("x", "y").count().collect()
    assert {tuple(r) for r in got} == {(1, 2, 10_000), (3, 4, 2)}
    several = api.merge(*[few] * 17, table(spark, ["x", "y"], [(3, 4)] * 3))  # more inputs than are counted side by side
    assert rows_of(several, spark) == Counter({(1, 2): 1, (3, 4): 3})
    bare = api.merge(Leaf(TableSource(many)).project(), few.project())
    assert api.run(bare, spark).count() == 10_001


def test_windowed_distinct_by_columns(spark):
    rows = [(1, "a", float("nan")), (1, "a", float("nan")), (None, "a", 1.0), (None, "a", 1.0), (1, None, None), (1, "a", float("nan")), (2, "b", -0.5), (None, "a", 1.0)]
    df = spark.createDataFrame(rows, "x int, s string, d double").coalesce(1)
    for window, n in ((100, 4), (2, 6), (1, 6)):
        plan = Leaf(TableSource(df)).distinct(window, flags=api.OperatorFlags.ALLOW_DUPLICATES)
        assert len(api.run(plan, spark).collect()) == n, window
    nested = spark.createDataFrame([([1, 2],), ([1, 2],), (None,), ([1],)], "v array<int>").coalesce(1)
    assert api.run(Leaf(TableSource(nested)).distinct(10, flags=api.OperatorFlags.ALLOW_DUPLICATES), spark).count() == 3


def test_lateral_slices(spark):
    left, right = table(spark, ["k", "a"], [(1, 10), (2, 20), (3, 30), (3, 30)]), table(spark, ["k", "b"], [(1, 5), (1, 6), (1, 7), (3, 8), (3, 9)])
    part = right.slice(1, 1, ("b",))
    assert rows_of(left.lateral_join(part), spark) == Counter({(1, 10, 6): 1, (3, 30, 9): 2})
    assert rows_of(left.lateral_join(part, outer=True), spark) == Counter({(1, 10, 6): 1, (2, 20, None): 1, (3, 30, 9): 2})
    assert rows_of(left.lateral_join(right.slice(2, None, ("-b",))), spark) == Counter({(1, 10, 5): 1})
    assert rows_of(left.lateral_join(right.slice(0, 0)), spark) == Counter()
    assert rows_of(left.lateral_join(right), spark) == rows_of(left.join(right), spark)
    assert rows_of(left.lateral_join(right.filter("?b > ?a - 3").slice(0, 1, ("b",))), spark) == Counter()
    assert rows_of(left.join(part), spark) == Counter([(1, 10, 6)])


@pytest.mark.parametrize("seed", range(4))
def test_sets_match_plain_evaluator(spark, seed):
    rng = random.Random(100 + seed)
    a, b = ["x", "y"], ["y", "z"]
    left, right, more = relation(rng, a, 12, 0.3), relation(rng, b, 12, 0.3), relation(rng, a, 12, 0.3)
    l, r, m = table(spark, a, left), table(spark, b, right), table(spark, a, more)  # noqa: E741
    names = ["x", "y", "z"]
    dl, dr, dm = dicts(a, left), dicts(b, right), dicts(a, more)
    assert rows_of(api.union(l, r, m), spark) == brute.bag(dl + dr + dm, names)
    assert rows_of(api.merge(l, r, m), spark) == brute.merge(dl, dr, dm, names=names)
    assert rows_of(l.union(m).distinct(), spark) == Counter(set(brute.bag(dl + dm, a)))
    three = l.join(r).left_join(table(spark, a, more).distinct())
    want = brute.left_join(brute.join(dl, dr), [dict(zip(a, k)) for k in brute.bag(dm, a)], names)
    assert rows_of(three, spark) == brute.bag(want, names)


def test_unbound_left_value_takes_the_right_one(spark):
    assert rows_of(table(spark, ["a", "v"], [(1, None)]).join(table(spark, ["v", "b"], [(7, 2)])), spark) == Counter([(1, 7, 2)])


def test_multiplicity_when_right_selects_only_shared(spark):
    assert rows_of(table(spark, ["v"], [(1,)]).join(table(spark, ["v"], [(1,), (1,)])), spark) == Counter({(1,): 2})


def test_hidden_variables_join(spark):
    left = table(spark, ["o", "s"], [(1, 1), (2, 9)])
    right = table(spark, ["s", "o", "z"], [(1, 1, 5), (9, 9, 6)])
    hidden = Leaf(TableSource(spark.createDataFrame([(1, 1, 5), (9, 9, 6)], "s int, o int, z int"), hidden=("o",)))
    assert rows_of(left.join(hidden), spark) == Counter([(1, 1, 5)])
    assert rows_of(left.join(right.project("z")), spark) == Counter([(1, 1, 5)])
    assert rows_of(left.join(right.project("z").distinct()), spark) == Counter([(1, 1, 5)])
    assert rows_of(left.exists(right.project()), spark) == Counter([(1, 1)])
    # hidden on both sides does not join
    assert rows_of(left.project("o").join(hidden.project("z")), spark) == Counter([(1, 5)])
    # a hidden value is matched but not shown
    free = table(spark, ["k", "o"], [(1, None)])
    assert rows_of(free.join(hidden.project("z")), spark) == Counter([(1, None, 5), (1, None, 6)])
    nested = left.join(right.project("z").join(table(spark, ["q"], [(3,)])))
    assert rows_of(nested, spark) == Counter([(1, 1, 5, 3)])


def test_minus_of_disjoint_and_unbound(spark):
    left = table(spark, ["a", "v"], [(1, None), (2, 5)])
    assert rows_of(left.minus(table(spark, ["z"], [(1,)])), spark) == Counter([(1, None), (2, 5)])
    assert rows_of(left.minus(table(spark, ["v"], [(5,)])), spark) == Counter([(1, None)])
    assert rows_of(left.minus(table(spark, ["v", "w"], [(5, 1)]).filter("?w = ?a")), spark) == Counter([(1, None), (2, 5)])


def test_filters_that_name_left_variables(spark):
    left, right = table(spark, ["k", "a"], [(1, 5), (2, 1)]), table(spark, ["k", "b"], [(1, 3), (1, 9), (2, 3)])
    test = right.filter("?b > ?a")
    assert rows_of(left.left_join(test), spark) == Counter([(1, 5, 9), (2, 1, 3)])
    assert rows_of(left.exists(test), spark) == Counter([(1, 5), (2, 1)])
    assert rows_of(left.join(test), spark) == Counter([(1, 5, 9), (2, 1, 3)])
    assert rows_of(left.not_exists(right.filter("?b > ?a + 5")), spark) == Counter([(1, 5), (2, 1)])


def test_union_goes_by_name(spark):
    one, two = table(spark, ["x", "y"], [(1, 2)]), table(spark, ["y", "x"], [(3, 4)])
    assert rows_of(one.union(two), spark) == Counter([(1, 2), (4, 3)])


def test_project_and_slice(spark):
    t = table(spark, ["x", "y"], [(i, -i) for i in range(5)])
    assert rows_of(t.project("y", "nope", "y"), spark) == Counter([(-i, None) for i in range(5)])
    got = [r.x for r in api.run(t.slice(1, 3, ("-x",)), spark).collect()]
    assert got == [3, 2, 1]
    assert rows_of(t.slice(9, 2), spark) == Counter()
    with pytest.warns(UserWarning):
        assert rows_of(t.slice(0, 0), spark) == Counter()
    with pytest.raises(IllegalArgument):
        Slice(t, -1)
    with pytest.raises(IllegalArgument):
        Project(t, ("x", None))


def test_slice_of_an_optional_side_is_global(spark):
    left, right = table(spark, ["k"], [(1,), (2,)]), table(spark, ["k", "b"], [(1, 1), (2, 2)])
    assert rows_of(left.left_join(right.slice(0, 1, ("k",))), spark) == Counter([(1, 1), (2, None)])


def test_nested_optional_is_bottom_up_and_warns(spark):
    a, b, c = table(spark, ["x"], [(1,)]), table(spark, ["y"], [(2,)]), table(spark, ["y", "x"], [(2, 9)])
    with pytest.warns(UserWarning, match="outer variables"):
        assert rows_of(a.left_join(b.left_join(c)), spark) == Counter([(1, None)])
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert rows_of(a.left_join(table(spark, ["x", "y"], [(1, 2)]).left_join(c)), spark) == Counter([(1, 2)])


def test_zero_columns_and_empty(spark):
    t = table(spark, ["x"], [(1,), (1,), (2,)])
    assert api.run(t.project(), spark).count() == 3
    assert api.run(t.project().distinct(), spark).count() == 1
    assert api.run(api.merge(t.project(), t.project()), spark).count() == 3
    assert api.ask(t.filter("?x = 2"), spark) and not api.ask(t.filter("?x = 3"), spark)
    assert rows_of(Empty(("a", "b")), spark) == Counter()
    assert rows_of(api.join(t, Empty(("x",))), spark) == Counter()
    assert rows_of(api.union(t, Empty(("x",)), api.union(t, t)), spark) == Counter({(1,): 6, (2,): 3})
    assert api.run(Join(()), spark).count() == 1
    assert api.run(Union(()), spark).count() == 0 and api.run(Merge(()), spark).count() == 0


def test_windowed_distinct_keeps_memory_bounded(spark):
    df = spark.createDataFrame([(c,) for c in "xxyxyzx"], "v string").coalesce(1)
    leaf = Leaf(TableSource(df))
    lax = Distinct(leaf, 2, OperatorFlags.ALLOW_DUPLICATES)
    assert [r.v for r in api.run(lax, spark).collect()] == list("xyzx")
    assert rows_of(Distinct(leaf, 2), spark) == Counter([("x",), ("y",), ("z",)])
    with pytest.raises(IllegalArgument):
        Distinct(leaf, 0)


def test_mixed_encodings_meet_as_terms(spark):
    native = table(spark, ["x", "n"], [(1, 2), (3, 4)])
    text = spark.createDataFrame([('"1"^^<http://www.w3.org/2001/XMLSchema#int>', '"a"'), ('"3"', '"b"')], "x string, s string")
    nt = Leaf(TableSource(text, nt=("x", "s")))
    assert [r.s for r in api.run(native.join(nt), spark).collect()] == ['"a"']
    assert api.run(native.union(nt), spark).where("x is null").count() == 0


def test_bind(spark):
    t = table(spark, ["x", "y", "z"], [(1, 2, 3), (1, 5, 6), (4, 2, 7)])
    assert rows_of(t.bind({"x": 1}), spark) == Counter([(2, 3), (5, 6)])
    assert t.bind({"nope": 1}) is t and t.bind({}) is t
    p = t.project("x", "y").bind({"x": 1})
    assert p.public_vars == ("y",) and rows_of(p, spark) == Counter([(2,), (5,)])
    f = t.filter("?z > ?lim").bind({"lim": 5})
    assert rows_of(f, spark) == Counter([(1, 5, 6), (4, 2, 7)])
    assert "lim" in t.filter("?z > ?lim").all_vars and "lim" not in f.all_vars
    assert rows_of(t.filter("?z > 3").bind({"z": 6}), spark) == Counter([(1, 5)])


def test_plans_are_values(spark):
    t = table(spark, ["x"], [(1,)])
    assert t.join(t, t) == Join((t, t, t)) and hash(t.distinct()) == hash(Distinct(t))
    assert t.filter("?x = 1").union(t).explain_plan().splitlines() == ["Union", "  Filter(?x = 1)", "    Leaf(table)", "  Leaf(table)"]


class Vars:
    """What ordering looks at: public and all variables."""

    def __init__(self, public, hidden=""):
        self.public_vars, self.all_vars = tuple(public), tuple(public + hidden)


@pytest.mark.parametrize(
    ("operands", "bind", "order"),
    [
        ([], False, []),
        ([Vars("x", "sp")], False, [0]),
        ([Vars("x", "sp"), Vars("xy", "s")], False, [0, 1]),
        ([Vars("x", "p"), Vars("z", "q")], False, [0, 1]),
        ([Vars("y", "x"), Vars("x", "p")], False, [0, 1]),
        ([Vars("y", "x"), Vars("x", "p")], True, [1, 0]),
        ([Vars("x", "p"), Vars("y", "x")], True, [0, 1]),
        ([Vars("y", "x"), Vars("x", "p"), Vars("yz", "q")], True, [1, 0, 2]),
        ([Vars("z", "a"), Vars("x", "b"), Vars("y", "c"), Vars("xy", "d"), Vars("yz", "e")], False, [0, 4, 2, 3, 1]),
        ([Vars("x", "y"), Vars("w", "p"), Vars("y", "q"), Vars("x", "y"), Vars("yz", "r")], True, [2, 0, 3, 4, 1]),
    ],
)
def test_join_order(operands, bind, order):
    assert reorder("avoid_cartesian", operands, bind) == order
    assert reorder("none", operands, bind) == list(range(len(operands)))


def test_unknown_order(spark):
    t = table(spark, ["x"], [(1,)])
    with pytest.raises(IllegalArgument):
        api.run(api.join(t, t, reorder="hash"), spark)


def test_strategies_bid(spark):
    t = table(spark, ["x"], [(1,), (1,)])
    seen = []

    def lower(solutions, plan):
        seen.append(plan)
        return solutions[0]

    register_strategy("Distinct", Strategy("keep", lambda flags: 1 if flags & OperatorFlags.USER else 1 << 31, lower))
    try:
        assert rows_of(t.distinct(), spark) == Counter([(1,)]) and not seen
        assert rows_of(t.distinct(flags=OperatorFlags.USER), spark) == Counter({(1,): 2}) and len(seen) == 1
    finally:
        unregister_strategy("Distinct", "keep")
    from mergrove.plans.flags import choose

    with pytest.raises(NoStrategy):
        choose("Nothing", OperatorFlags.NONE)


def test_plans_stay_on_keys(spark):
    """Certain variables join by hash or merge; unbound ones only widen the condition; sizes declared small broadcast."""

    def physical(plan):
        return api.run(plan, spark)._jdf.queryExecution().executedPlan().toString()

    sure = table(spark, ["k", "v"], [(1, 1)], never_null=True)
    maybe = table(spark, ["k", "v"], [(1, None)], never_null=("k",))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan in (sure.join(maybe), sure.left_join(maybe), sure.exists(maybe), sure.not_exists(maybe), sure.minus(maybe)):
            text = physical(plan)
            assert "SortMergeJoin" in text and "NestedLoop" not in text and "Cartesian" not in text
        from mergrove.plans.plan import LeftJoin

        known = Leaf(TableSource(spark.range(5).selectExpr("cast(id as int) as k"), never_null=True))
        assert "BroadcastHashJoin" in physical(LeftJoin(sure, known, OperatorFlags.SMALL_SECOND))
        # a side of unknown or great size stays with the planner, whatever the caller says
        assert "BroadcastHashJoin" not in physical(LeftJoin(sure, maybe, OperatorFlags.SMALL_SECOND))
        many = Leaf(TableSource(spark.range(1 << 40).selectExpr("cast(id as int) as k"), never_null=True))
        assert "BroadcastHashJoin" not in physical(LeftJoin(sure, many, OperatorFlags.SMALL_SECOND))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 as twice", "'x' as other").write.parquet(str(tmp_path / "t"))
    leaf = Leaf(TableSource(spark.read.parquet(str(tmp_path / "t")), {"id": "i", "twice": "t", "other": "o"}))
    text = api.run(leaf.filter("?i > 90").project("t"), spark)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,90)" in text and "ReadSchema: struct<id:bigint,twice:bigint>" in text


def test_join_metrics_and_observation(spark):
    from mergrove.metrics import Observed, join_metrics

    left, right = table(spark, ["k"], [(1,), (2,), (3,)], never_null=True), table(spark, ["k", "v"], [(1, 1), (1, 2), (2, 1)], never_null=True)
    m = join_metrics(left, right, spark)
    assert (m.left_rows, round(m.unmatched_rate, 3), m.avg_matches, m.max_matches) == (3, 0.333, 1.0, 2)
    seen = []
    watcher = Observed()
    watcher.add_listener(seen.append)
    rows, metrics = watcher.collect(left.join(right).filter("?v = 1"), spark)
    assert len(rows) == 2 and seen == metrics and metrics[-1].rows == 2 and metrics[-1].end >= metrics[-1].start


def test_disjoint_variables(spark):
    left, none, some = table(spark, ["a"], [(1,)]), table(spark, ["b"], []), table(spark, ["b"], [(2,), (3,)])
    assert rows_of(left.exists(none), spark) == Counter() and rows_of(left.not_exists(none), spark) == Counter([(1,)])
    assert rows_of(left.exists(some), spark) == Counter([(1,)])
    assert rows_of(left.left_join(none), spark) == Counter([(1, None)])
    assert rows_of(left.join(some), spark) == Counter([(1, 2), (1, 3)])
    assert joins.INNER == "inner"
