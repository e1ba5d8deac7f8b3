"""Entry points: one function for each operator, and running a plan.

``join(query(df_source), ...)`` builds a plan; ``run(plan)`` makes it a DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession

from .plans import lower as _lower
from .plans.flags import OperatorFlags
from .plans.plan import Distinct, Empty, Exists, Filter, Join, Lateral, Leaf, LeftJoin, Merge, Minus, Plan, Project, Slice, Union
from .sources.tables import TableSource
from .sources.triples import TriplesSource

ASYNC = OperatorFlags.ASYNC
NONE = OperatorFlags.NONE


def query(source, **options) -> Plan:
    """A leaf: a source, or a DataFrame (options as for :class:`TableSource`)."""
    return Leaf(TableSource(source, **options) if isinstance(source, DataFrame) else source)


def triples(df: DataFrame, text: str, prefixes: dict[str, str] | None = None) -> Plan:
    """A leaf: a query text over a DataFrame of triples."""
    return Leaf(TriplesSource(df, text, prefixes))


def empty(*names: str) -> Plan:
    return Empty(names)


def join(*plans: Plan, flags: OperatorFlags = ASYNC, reorder: str = "avoid_cartesian") -> Plan:
    return Join(plans, flags, reorder)


def left_join(left: Plan, right: Plan, flags: OperatorFlags = NONE) -> Plan:
    return LeftJoin(left, right, flags)


def lateral_join(left: Plan, right: Plan, outer: bool = False, flags: OperatorFlags = NONE) -> Plan:
    """A join whose right side, a slice for example, is evaluated for each left row."""
    return Lateral(left, right, outer, flags)


def union(*plans: Plan, flags: OperatorFlags = ASYNC) -> Plan:
    return Union(plans, flags)


def merge(*plans: Plan, flags: OperatorFlags = ASYNC) -> Plan:
    return Merge(plans, flags)


def exists(left: Plan, right: Plan, negate: bool = False, flags: OperatorFlags = NONE) -> Plan:
    return Exists(left, right, negate, flags)


def minus(left: Plan, right: Plan, flags: OperatorFlags = NONE) -> Plan:
    return Minus(left, right, flags)


def filter(plan: Plan, *exprs: str, strict: bool = False, flags: OperatorFlags = NONE) -> Plan:  # noqa: A001
    return Filter(plan, exprs, strict, (), flags)


def project(plan: Plan, *names: str, flags: OperatorFlags = NONE) -> Plan:
    return Project(plan, names, flags)


def distinct(plan: Plan, window: int | None = None, flags: OperatorFlags = NONE) -> Plan:
    return Distinct(plan, window, flags)


def slice(plan: Plan, offset: int = 0, limit: int | None = None, order_by: tuple[str, ...] = (), flags: OperatorFlags = NONE) -> Plan:  # noqa: A001
    return Slice(plan, offset, limit, tuple(order_by), flags)


def run(plan: Plan, spark: SparkSession, observe=None) -> DataFrame:
    """The results of a plan as a DataFrame with one column a public variable."""
    return _lower.to_df(plan, spark, observe)


def ask(plan: Plan, spark: SparkSession) -> bool:
    return _lower.ask(plan, spark)


def rows(plan: Plan, spark: SparkSession) -> Iterator[Row]:
    """Rows one after the other as partitions finish, without holding all of them."""
    return run(plan, spark).toLocalIterator(prefetchPartitions=True)
