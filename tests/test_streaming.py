"""Streams: what works on them, and what is refused."""

import pytest

from mergrove import api
from mergrove.errors import IllegalArgument
from mergrove.plans.plan import Leaf
from mergrove.sources.tables import TableSource
from mergrove.streaming import operators as streaming


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:0{i % 10}:00", i % 3) for i in range(20)]
    spark.createDataFrame(rows, "id int, ts string, k int").selectExpr("id", "cast(ts as timestamp) as ts", "k").write.parquet(str(tmp_path / "in"))
    return lambda: spark.readStream.schema("id int, ts timestamp, k int").parquet(str(tmp_path / "in"))


def finish(df, name, tmp_path, spark):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_plans_over_streams(spark, stream, tmp_path):
    leaf = Leaf(TableSource(stream(), never_null=True))
    static = Leaf(TableSource(spark.createDataFrame([(1, "one"), (2, "two")], "k int, name string"), never_null=True))
    plan = leaf.filter("?id < 12").join(static).project("id", "name")
    assert len(finish(streaming.run(plan, spark), "joined", tmp_path, spark)) == 8
    both = leaf.exists(static).project("id").union(Leaf(TableSource(stream(), {"id": "id"})))
    assert len(finish(streaming.run(both, spark), "unioned", tmp_path, spark)) == 13 + 20
    for bad in (leaf.merge(leaf), leaf.slice(1, 2), leaf.distinct(), static.minus(leaf), static.not_exists(leaf), static.lateral_join(leaf.slice(0, 1))):
        with pytest.raises(IllegalArgument):
            streaming.run(bad, spark)
    assert api.run(leaf, spark).isStreaming


def test_windowed_distinct_and_joins(spark, stream, tmp_path):
    got = finish(streaming.distinct_within(stream().select("ts", "k"), "ts", "1 hour"), "distinct_rows", tmp_path, spark)
    assert sorted(r.k for r in got) == [0, 1, 2]
    other = stream().withColumnsRenamed({"ts": "ts2", "id": "id2"})
    joined = streaming.join_streams(stream(), other, ["k"], "ts", "ts2", "1 minute", "5 minutes")
    got = finish(joined, "stream_join", tmp_path, spark)
    rows = [(i, i % 10, i % 3) for i in range(20)]
    assert len(got) == sum(a[2] == b[2] and abs(a[1] - b[1]) <= 1 for a in rows for b in rows)
    with pytest.raises(IllegalArgument):
        streaming.join_streams(stream(), stream(), ["k"], "ts", "ts", "1 minute", "5 minutes")
