"""Lowering: a plan becomes one DataFrame; everything physical is left to Catalyst."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IllegalArgument
from ..functions import expr
from ..functions.sparql_text import common_vars
from ..operators import joins, sets
from ..operators.solution import Solution, fresh, from_frame
from .flags import OperatorFlags, Strategy, choose
from .plan import Distinct, Empty, Exists, Filter, Join, Lateral, Leaf, LeftJoin, Merge, Minus, Plan, Project, Slice, Union
from .reorder import reorder

_NONE: frozenset[str] = frozenset()


def _hint(flags: OperatorFlags) -> str:
    """Which side a caller has declared small."""
    if flags & OperatorFlags.SMALL_SECOND:
        return "right"
    return "left" if flags & OperatorFlags.SMALL_FIRST else ""


def _scope(*sides: Solution) -> dict[str, expr.Value]:
    """Variables for an expression: an earlier side wins."""
    out: dict[str, expr.Value] = {}
    for s in sides:
        for v in s.columns:
            out.setdefault(v, s.value(v))
    return out


def _constant(value) -> expr.Value:
    """A bound value: N-Triples text, or a plain Python value."""
    if isinstance(value, str) and value[:1] in ('"', "<", "_"):
        return expr.Value(F.lit(value), "nt")
    column = F.lit(value)
    kind = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}.get(type(value))
    if kind is None:
        raise IllegalArgument(f"cannot bind a {type(value).__name__}")
    return expr.native(column, kind)


class Lowering:
    """One pass over a plan.  ``observe(name, df)`` may wrap the DataFrame of each node."""

    def __init__(self, spark: SparkSession, observe: Callable[[Plan, DataFrame], DataFrame] | None = None):
        self.spark, self.observe = spark, observe

    def lower(self, plan: Plan, needed: frozenset[str] = _NONE) -> Solution:
        """``needed``: variables that an ancestor may match even where they are hidden."""
        default = Strategy("catalyst", lambda flags: 1024, lambda p, n: getattr(self, f"_{type(p).__name__.lower()}")(p, n))
        chosen = choose(type(plan).__name__, getattr(plan, "flags", OperatorFlags.NONE), default)
        if chosen is default:
            out = default.lower(plan, needed)
        else:
            out = chosen.lower([self.lower(o, needed) for o in plan.operands], plan)
        if self.observe:
            out = Solution(self.observe(plan, out.df), out.public, out.columns, out.maybe, out.nt)
        return out

    # --- leaves
    def _leaf(self, plan: Leaf, needed):
        # a source that is a plan itself keeps only the hidden variables that are asked for
        asked = (needed | frozenset(dict(plan.bound)),) if hasattr(plan.source, "plan") else ()
        s = plan.source.solution(self.spark, *asked)
        for name, value in plan.bound:
            if s.has(name):
                v = _constant(value)
                for c in s.columns[name]:
                    own = expr.Value(F.col(c), "nt") if name in s.nt else expr.native(F.col(c), s.df.schema[c].dataType)
                    if own.domain == "nt":
                        same = F.col(c) == expr._term(v)
                    elif v.domain == "nt":
                        same = expr._term(own) == v.column
                    else:
                        same = F.col(c) == v.column
                    # an unbound variable is free, so any value suits it
                    s = Solution(s.df.where(same | F.col(c).isNull() if name in s.maybe else same), s.public, s.columns, s.maybe, s.nt)
        gone = dict(plan.bound)
        columns = {v: c for v, c in s.columns.items() if v not in gone}
        s = Solution(s.df, plan.public_vars, columns, s.maybe - frozenset(gone), s.nt - frozenset(gone))
        return s.keep(s.public, needed)

    def _empty(self, plan: Empty, needed):
        schema = T.StructType([T.StructField(v, T.StringType()) for v in plan.public_vars])
        return from_frame(self.spark.createDataFrame([], schema), plan.public_vars, nt=plan.public_vars)

    # --- joins
    @staticmethod
    def _warn_nested(left: Solution, plan: Plan) -> None:
        """An optional part inside the right side that shares a variable with the left which its own mandatory part lacks is
        evaluated before the left is seen; some engines would fill it in first."""
        for node in (plan, *plan.operands):
            if node is not plan:
                Lowering._warn_nested(left, node)
            elif isinstance(node, (LeftJoin, Minus, Exists)):
                loose = [v for v in node.right.all_vars if left.has(v) and v not in node.left.all_vars]
                if loose:
                    warnings.warn(f"{node.algebra_name} on the right uses outer variables {loose} that its left side lacks", stacklevel=2)

    def _sides(self, left: Solution, plan: Plan, needed, correlate: bool = True) -> tuple[Solution, Column | None]:
        """The right operand, and the conjuncts of its filter that name left variables only: they join rather than filter."""
        ask = needed | frozenset(left.public)
        self._warn_nested(left, plan)
        outer: list[tuple[Filter, tuple]] = []
        inner = plan
        if isinstance(plan, Filter) and not plan.strict:
            known = set(plan.input.all_vars)
            moved = [e for e in plan.exprs if any(v not in known and left.has(v) for v in expr.variables(expr.parse(e)))]
            if moved:
                outer = [(plan, expr.parse(e)) for e in moved]
                rest = tuple(e for e in plan.exprs if e not in moved)
                inner = Filter(plan.input, rest, plan.strict, plan.bound, plan.flags) if rest else plan.input
                ask |= frozenset(v for _, e in outer for v in expr.variables(e))
        right = self.lower(inner, ask)
        if outer and not correlate:
            # a variable that only the filter names is not replaced in MINUS: it is unbound, so the filter is an error
            return Solution(right.df.where(F.lit(False)), right.public, right.columns, right.maybe, right.nt), None
        return right, (lambda l, r: reduce(and_, [expr.condition(e, {k: _constant(v) for k, v in f.bound} | _scope(r, l)) for f, e in outer])) if outer else None

    def _pair(self, left: Solution, right: Solution, extra, how, hint, negate=False) -> Solution:
        left, right, _ = joins.align(left, right)
        condition = extra(left, right) if extra else None
        if how == "exists":
            return joins.exists(left, right, negate, condition, hint)
        if how == "minus":
            return joins.minus(left, right, condition, hint)
        return joins.join(left, right, how, condition, hint)

    def _join(self, plan: Join, needed):
        if not plan.inputs:
            return from_frame(self.spark.range(1).select(), ())
        order = reorder(plan.reorder, plan.inputs)
        out = self.lower(plan.inputs[order[0]], needed)
        for i in order[1:]:
            right, extra = self._sides(out, plan.inputs[i], needed)
            out = self._pair(out, right, extra, joins.INNER, _hint(plan.flags) if len(order) == 2 else "")
        return out.keep(plan.public_vars, needed)

    def _leftjoin(self, plan: LeftJoin, needed):
        left = self.lower(plan.left, needed)
        right, extra = self._sides(left, plan.right, needed)
        return self._pair(left, right, extra, joins.LEFT, _hint(plan.flags)).keep(plan.public_vars, needed)

    def _lateral(self, plan: Lateral, needed):
        """A join of rows that carry a number each; a slice on the right then counts within a number."""
        part = plan.right if isinstance(plan.right, Slice) else Slice(plan.right)
        order = [v.lstrip("-") for v in part.order_by]
        left = self.lower(plan.left, needed)
        row, place = fresh("row"), fresh("place")
        left = Solution(left.df.withColumn(row, F.monotonically_increasing_id()), left.public, {**left.columns, row: (row,)}, left.maybe, left.nt)
        inner = part.input if set(order) <= set(part.input.public_vars) else Project(part.input, tuple(dict.fromkeys((*part.input.public_vars, *order))))
        right, extra = self._sides(left, inner, needed | frozenset(order))
        unknown = [v for v in order if not right.has(v)]
        if unknown:
            raise IllegalArgument(f"no variable {unknown} to order by")
        out = self._pair(left, right, extra, joins.LEFT if plan.outer else joins.INNER, _hint(plan.flags))
        if part.offset or part.limit is not None:
            keys = [out.col(v[1:]).desc_nulls_last() if v.startswith("-") else out.col(v).asc_nulls_first() for v in part.order_by]
            numbered = out.df.withColumn(place, F.row_number().over(Window.partitionBy(row).orderBy(*keys or [F.lit(0)])))
            last = F.lit(True) if part.limit is None else F.col(place) <= part.offset + part.limit
            kept = (F.col(place) > part.offset) & last
            out = Solution(numbered.where(kept).drop(place), out.public, out.columns, out.maybe, out.nt)
            if plan.outer:  # rows whose whole slice is gone stay too
                lone = self._again(plan, left, out, row)
                out = Solution(out.df.unionByName(lone, allowMissingColumns=True), out.public, out.columns, out.maybe, out.nt)
        columns = {v: c for v, c in out.columns.items() if v != row}
        return Solution(out.df.drop(row), out.public, columns, out.maybe, out.nt).keep(plan.public_vars, needed)

    @staticmethod
    def _again(plan: Lateral, left: Solution, out: Solution, row: str) -> DataFrame:
        """Left rows of which ``out`` has none."""
        own = left.df.join(out.df.select(F.col(row).alias("row__done")).distinct(), F.col(row) == F.col("row__done"), "left_anti")
        return own.select(*[c for c in own.columns if c in out.df.columns], *[left.col(v).alias(out.columns[v][0]) for v in left.public if out.columns[v][0] not in own.columns])

    def _exists(self, plan: Exists, needed):
        left = self.lower(plan.left, needed)
        right, extra = self._sides(left, plan.right, _NONE)
        return self._pair(left, right, extra, "exists", _hint(plan.flags), plan.negate)

    def _minus(self, plan: Minus, needed):
        left = self.lower(plan.left, needed)
        if not common_vars(plan.left.public_vars, plan.right.all_vars):
            return left
        right, _ = self._sides(left, plan.right, _NONE, correlate=False)
        return self._pair(left, right, None, "minus", _hint(plan.flags))

    # --- sets
    def _flat(self, plan) -> list[Plan]:
        """Nested nodes of one kind side by side, operands without rows left out if they add no variable."""
        out: list[Plan] = []
        for o in plan.inputs:
            out += self._flat(o) if type(o) is type(plan) and isinstance(plan, Union) else [o]
        others = {v for o in out if not isinstance(o, Empty) for v in o.public_vars}
        kept = [o for o in out if not (isinstance(o, Empty) and set(o.public_vars) <= others)]
        return kept or out

    def _union(self, plan: Union, needed):
        if not plan.inputs:
            return self._empty(Empty(), needed)
        return sets.union([self.lower(o, needed) for o in self._flat(plan)], needed).keep(plan.public_vars, needed)

    def _merge(self, plan: Merge, needed):
        if not plan.inputs:
            return self._empty(Empty(), needed)
        return sets.merge([self.lower(o, needed) for o in self._flat(plan)], needed).keep(plan.public_vars, needed)

    # --- one input
    def _filter(self, plan: Filter, needed):
        s = self.lower(plan.input, needed | frozenset(plan.filter_vars))
        if plan.exprs:
            scope = {k: _constant(v) for k, v in plan.bound} | _scope(s)
            unknown = [v for v in plan.filter_vars if v not in scope]
            if unknown and not plan.strict:
                warnings.warn(f"filter names unknown variables {unknown}: they are unbound", stacklevel=2)
            test = reduce(and_, [expr.condition(e, scope, plan.strict) for e in plan.parsed])
            s = Solution(s.df.where(test), s.public, s.columns, s.maybe, s.nt)
        return s.keep(plan.public_vars, needed)

    def _project(self, plan: Project, needed):
        return self.lower(plan.input, needed | frozenset(plan.names)).keep(plan.public_vars, needed)

    def _distinct(self, plan: Distinct, needed):
        s = self.lower(plan.input, needed).keep(plan.public_vars, needed)
        if plan.window and plan.flags & OperatorFlags.ALLOW_DUPLICATES:
            return sets.windowed_distinct(s, plan.window)
        return sets.distinct(s)

    def _slice(self, plan: Slice, needed):
        s = self.lower(plan.input, needed | frozenset(v.lstrip("-") for v in plan.order_by))
        df = s.df
        if plan.order_by:
            unknown = [v for v in plan.order_by if not s.has(v.lstrip("-"))]
            if unknown:
                raise IllegalArgument(f"no variable {unknown} to order by")
            df = df.orderBy(*[s.col(v[1:]).desc_nulls_last() if v.startswith("-") else s.col(v).asc_nulls_first() for v in plan.order_by])
        if plan.offset:
            df = df.offset(plan.offset)
        if plan.limit is not None:
            if plan.limit == 0:
                warnings.warn("a slice of no rows", stacklevel=2)
            df = df.limit(plan.limit)
        return Solution(df, s.public, s.columns, s.maybe, s.nt).keep(plan.public_vars, needed)


def lower(plan: Plan, spark: SparkSession, observe=None) -> Solution:
    return Lowering(spark, observe).lower(plan)


def to_df(plan: Plan, spark: SparkSession, observe=None) -> DataFrame:
    """The results of a plan, one column a public variable."""
    return lower(plan, spark, observe).frame()


def ask(plan: Plan, spark: SparkSession) -> bool:
    """Whether the plan has a solution."""
    return bool(to_df(plan, spark).limit(1).count())


__all__ = ["Lowering", "ask", "fresh", "lower", "to_df"]
