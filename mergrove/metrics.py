"""Numbers about running plans: rows by node, and how joins matched."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.sparql_text import common_vars
from .operators import joins
from .plans.lower import Lowering, to_df
from .plans.plan import Plan


@dataclass(frozen=True)
class PlanMetrics:
    """What one node did."""

    plan: Plan
    name: str
    rows: int
    start: float
    end: float
    error: BaseException | None = None
    cancelled: bool = False


class Observed:
    """Runs plans with a row count at every node, and tells listeners.

    Counts are gathered while the query runs, without a pass of their own; a node that the optimiser drops, or
    that a limit above stops early, reports the rows it made.
    """

    def __init__(self):
        self.listeners: list[Callable[[PlanMetrics], None]] = []

    def add_listener(self, listener: Callable[[PlanMetrics], None]) -> None:
        self.listeners.append(listener)

    def remove_listener(self, listener: Callable[[PlanMetrics], None]) -> None:
        self.listeners.remove(listener)

    def collect(self, plan: Plan, spark: SparkSession) -> tuple[list, list[PlanMetrics]]:
        """The rows of a plan, on the driver, and the metrics of its nodes, leaves first."""
        return self.run(plan, spark, lambda df: df.collect())

    def run(self, plan: Plan, spark: SparkSession, sink: Callable[[DataFrame], object] | None = None) -> tuple[object, list[PlanMetrics]]:
        """What ``sink`` makes of a plan's DataFrame (default: it is computed and thrown away), and the metrics of its nodes,
        leaves first."""
        watched: list[tuple[Plan, Observation]] = []

        def observe(node: Plan, df: DataFrame) -> DataFrame:
            seen = Observation(f"node{len(watched)}")
            watched.append((node, seen))
            return df.observe(seen, F.count(F.lit(1)).alias("rows"))

        sink = sink or (lambda df: df.write.format("noop").mode("overwrite").save())
        start, made, error = time.time(), [], None
        df = to_df(plan, spark, observe)
        try:
            made = sink(df)
        except Exception as e:
            error = e
        end = time.time()
        out = [PlanMetrics(node, node.describe(), 0 if error else int(seen.get.get("rows", 0)), start, end, error) for node, seen in watched]
        for m in out:
            for listener in self.listeners:
                listener(m)
        if error:
            raise error
        return made, out


@dataclass(frozen=True)
class JoinMetrics:
    left_rows: int
    unmatched_rate: float
    avg_matches: float
    max_matches: int


def join_metrics(left: Plan, right: Plan, spark: SparkSession) -> JoinMetrics:
    """How many right rows are compatible with each left row, by one aggregate query."""
    low = Lowering(spark)
    l = low.lower(left)  # noqa: E741
    r = low.lower(right, frozenset(l.public))
    l, r, _ = joins.align(l, r)  # noqa: E741
    keys = common_vars(l.public, r.columns)
    numbered = joins.Solution(l.df.withColumn("row__", F.monotonically_increasing_id()), l.public, l.columns, l.maybe, l.nt)
    marked = joins.Solution(r.df.withColumn("hit__", F.lit(1)), r.public, r.columns, r.maybe, r.nt)
    if not keys:  # every right row is compatible with every left row
        n, m = l.df.count(), r.df.count()
        return JoinMetrics(n, float(n > 0 and m == 0), float(m if n else 0), m if n else 0)
    df = joins.matched(numbered, marked, joins.LEFT)
    per_row = df.groupBy("row__").agg(F.count("hit__").alias("n"))
    got = per_row.agg(F.count("*").alias("rows"), F.avg((F.col("n") == 0).cast("double")).alias("none"), F.avg("n").alias("mean"), F.max("n").alias("most")).first()
    return JoinMetrics(got.rows, got.none or 0.0, got["mean"] or 0.0, got.most or 0)
