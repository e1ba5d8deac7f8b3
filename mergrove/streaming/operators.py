"""The operators that work on streaming DataFrames.

Project, Filter and Union work as they are; Join and Exists do against a static side, and between streams with
watermarks; Distinct forgets rows once a watermark has passed them.  Slices with an offset, Merge, and negation
by a streaming right side need the whole input and are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IllegalArgument
from ..plans.plan import Distinct, Exists, Lateral, Leaf, LeftJoin, Merge, Minus, Plan, Slice


def _streams(plan: Plan) -> bool:
    if isinstance(plan, Leaf):
        df = getattr(plan.source, "df", None)
        return bool(df is not None and df.isStreaming)
    return any(_streams(o) for o in plan.operands)


def check(plan: Plan) -> None:
    """Refuse plans that no stream can answer."""
    for o in plan.operands:
        check(o)
    if not _streams(plan):
        return
    if isinstance(plan, Merge):
        raise IllegalArgument("Merge needs all rows of a stream")
    if isinstance(plan, Lateral):
        raise IllegalArgument("a lateral join numbers all rows of a stream")
    if isinstance(plan, Slice) and (plan.offset or plan.order_by):
        raise IllegalArgument("a stream has no order to slice by")
    if isinstance(plan, Distinct):
        raise IllegalArgument("use distinct_within for streams")
    if isinstance(plan, (Minus, LeftJoin)) and _streams(plan.right) or isinstance(plan, Exists) and _streams(plan.right) and plan.negate:
        raise IllegalArgument(f"{type(plan).__name__} needs all rows of its right side")


def run(plan: Plan, spark) -> DataFrame:
    """The streaming results of a plan."""
    from ..api import run as run_plan

    check(plan)
    return run_plan(plan, spark)


def distinct_within(df: DataFrame, time: str, delay: str, *columns: str) -> DataFrame:
    """Rows whose ``columns`` (default: all but the time) did not occur within ``delay`` before; state is dropped after it."""
    keys = list(columns) or [c for c in df.columns if c != time]
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def join_streams(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, within: str, delay: str, how: str = "inner") -> DataFrame:
    """Rows of two streams that agree on ``on`` and lie at most ``within`` apart in time; both sides' state is bounded by it."""
    if left_time == right_time:
        raise IllegalArgument("the two times need different names")
    a, b = left.withWatermark(left_time, delay), right.withWatermark(right_time, delay)
    keys = {c: f"right_{c}" for c in on}
    b = b.withColumnsRenamed(keys)
    span = F.expr(f"interval {within}")
    near: Column = (F.col(right_time) >= F.col(left_time) - span) & (F.col(right_time) <= F.col(left_time) + span)
    for c, r in keys.items():
        near = near & (F.col(c) == F.col(r))
    return a.join(b, near, how).drop(*keys.values())
