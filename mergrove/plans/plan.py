"""The algebra: small immutable trees that lowering turns into DataFrames.

``public_vars`` is what results expose; ``all_vars`` also has the variables that are used inside.  A join
matches the left's public variables with *all* variables of the right.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from ..errors import IllegalArgument
from ..functions import expr
from ..functions.sparql_text import merge_vars
from .flags import OperatorFlags

NO_FLAGS = OperatorFlags.NONE


@dataclass(frozen=True)
class Plan:
    """Base of all nodes."""

    @property
    def operands(self) -> tuple[Plan, ...]:
        return ()

    @property
    def public_vars(self) -> tuple[str, ...]:
        raise NotImplementedError

    @property
    def all_vars(self) -> tuple[str, ...]:
        return tuple(merge_vars(*[o.all_vars for o in self.operands]))

    def with_operands(self, operands: tuple[Plan, ...]) -> Plan:
        return self

    def bind(self, binding: Mapping[str, Any]) -> Plan:
        """A copy in which variables have the given values; the same plan if none of them occurs."""
        if not any(v in self.all_vars for v in binding):
            return self
        return self.with_operands(tuple(o.bind(binding) for o in self.operands))

    @property
    def algebra_name(self) -> str:
        return type(self).__name__

    def describe(self) -> str:
        return self.algebra_name

    def explain_plan(self, indent: int = 0) -> str:
        """The tree as text."""
        return "\n".join([" " * indent + self.describe(), *[o.explain_plan(indent + 2) for o in self.operands]])

    # fluent forms
    def join(self, *others: Plan, **k) -> Plan:
        return Join((self, *others), **k)

    def left_join(self, other: Plan, **k) -> Plan:
        return LeftJoin(self, other, **k)

    def lateral_join(self, other: Plan, outer: bool = False, **k) -> Plan:
        return Lateral(self, other, outer, **k)

    def union(self, *others: Plan, **k) -> Plan:
        return Union((self, *others), **k)

    def merge(self, *others: Plan, **k) -> Plan:
        return Merge((self, *others), **k)

    def exists(self, other: Plan, negate: bool = False, **k) -> Plan:
        return Exists(self, other, negate, **k)

    def not_exists(self, other: Plan, **k) -> Plan:
        return Exists(self, other, True, **k)

    def minus(self, other: Plan, **k) -> Plan:
        return Minus(self, other, **k)

    def filter(self, *exprs: str, **k) -> Plan:
        return Filter(self, exprs, **k)

    def project(self, *names: str, **k) -> Plan:
        return Project(self, names, **k)

    def distinct(self, window: int | None = None, **k) -> Plan:
        return Distinct(self, window, **k)

    def slice(self, offset: int = 0, limit: int | None = None, order_by: tuple[str, ...] = (), **k) -> Plan:
        return Slice(self, offset, limit, tuple(order_by), **k)


@dataclass(frozen=True)
class Leaf(Plan):
    """A scan of a source (see ``mergrove.sources``), with values that some of its variables are bound to.

    With ``bound``, those variables are no longer public; a binding may name hidden variables.
    """

    source: Any
    bound: tuple[tuple[str, Any], ...] = ()
    flags: OperatorFlags = NO_FLAGS

    @property
    def public_vars(self):
        gone = dict(self.bound)
        return tuple(v for v in self.source.public_vars if v not in gone)

    @property
    def all_vars(self):
        gone = dict(self.bound)
        return tuple(v for v in self.source.all_vars if v not in gone)

    def bind(self, binding):
        own = {k: v for k, v in binding.items() if v is not None and k in self.all_vars}
        return dataclasses.replace(self, bound=(*self.bound, *own.items())) if own else self

    def describe(self):
        return f"Leaf({self.source!r}{''.join(f', ?{k}={v!r}' for k, v in self.bound)})"


@dataclass(frozen=True)
class Empty(Plan):
    """No rows, with the given variables."""

    vars: tuple[str, ...] = ()

    @property
    def public_vars(self):
        return tuple(merge_vars(self.vars))

    all_vars = public_vars

    def bind(self, binding):
        return self

    def describe(self):
        return f"Empty{list(self.public_vars)}"


@dataclass(frozen=True)
class _NAry(Plan):
    inputs: tuple[Plan, ...]
    flags: OperatorFlags = OperatorFlags.ASYNC

    def __post_init__(self):
        object.__setattr__(self, "inputs", tuple(self.inputs))

    @property
    def operands(self):
        return self.inputs

    @property
    def public_vars(self):
        return tuple(merge_vars(*[o.public_vars for o in self.inputs]))

    def with_operands(self, operands):
        return dataclasses.replace(self, inputs=operands)


@dataclass(frozen=True)
class Join(_NAry):
    """Compatibility join of all inputs on shared variables; a product where none is shared.

    ``reorder``: ``avoid_cartesian`` or ``none``.
    """

    reorder: str = "avoid_cartesian"


@dataclass(frozen=True)
class Union(_NAry):
    """All rows of all inputs; variables that an input lacks are unbound."""


@dataclass(frozen=True)
class Merge(_NAry):
    """Union in which a row occurs as often as in the input that has it most often."""


@dataclass(frozen=True)
class _Binary(Plan):
    left: Plan
    right: Plan

    @property
    def operands(self):
        return (self.left, self.right)

    @property
    def public_vars(self):
        return self.left.public_vars

    def with_operands(self, operands):
        return dataclasses.replace(self, left=operands[0], right=operands[1])


@dataclass(frozen=True)
class LeftJoin(_Binary):
    """OPTIONAL: every left row, with the right's variables where a row matches."""

    flags: OperatorFlags = NO_FLAGS

    @property
    def public_vars(self):
        return tuple(merge_vars(self.left.public_vars, self.right.public_vars))


@dataclass(frozen=True)
class Lateral(_Binary):
    """The join in which the right is evaluated for each left row by itself: its slice, if it is one, counts for each
    (``outer``: a left row without a match stays)."""

    outer: bool = False
    flags: OperatorFlags = NO_FLAGS

    @property
    def public_vars(self):
        return tuple(merge_vars(self.left.public_vars, self.right.public_vars))


@dataclass(frozen=True)
class Exists(_Binary):
    """Left rows for which the right has (``negate``: has not) a compatible row."""

    negate: bool = False
    flags: OperatorFlags = NO_FLAGS

    def describe(self):
        return "NotExists" if self.negate else "Exists"


@dataclass(frozen=True)
class Minus(_Binary):
    """Left rows without a right row that shares a bound variable with them and agrees on all; all rows if none is shared."""

    flags: OperatorFlags = NO_FLAGS


@dataclass(frozen=True)
class _Unary(Plan):
    input: Plan

    @property
    def operands(self):
        return (self.input,)

    @property
    def public_vars(self):
        return self.input.public_vars

    def with_operands(self, operands):
        return dataclasses.replace(self, input=operands[0])


@dataclass(frozen=True)
class Filter(_Unary):
    """Rows that satisfy every expression; ``strict`` makes errors end the query instead of dropping the row."""

    exprs: tuple[str, ...] = ()
    strict: bool = False
    bound: tuple[tuple[str, Any], ...] = ()
    flags: OperatorFlags = NO_FLAGS

    def __post_init__(self):
        object.__setattr__(self, "exprs", (self.exprs,) if isinstance(self.exprs, str) else tuple(self.exprs))

    @property
    def parsed(self) -> list[tuple]:
        return [expr.parse(e) for e in self.exprs]

    @property
    def filter_vars(self) -> tuple[str, ...]:
        return tuple(v for v in merge_vars(*[expr.variables(e) for e in self.parsed]) if v not in dict(self.bound))

    @property
    def all_vars(self):
        return tuple(merge_vars(self.input.all_vars, self.filter_vars))

    def bind(self, binding):
        own = {k: v for k, v in binding.items() if v is not None and k in self.all_vars}
        if not own:
            return self
        used = tuple((k, v) for k, v in own.items() if k in self.filter_vars)
        return dataclasses.replace(self, input=self.input.bind(own), bound=(*self.bound, *used))

    def describe(self):
        return f"Filter({' && '.join(self.exprs)})"


@dataclass(frozen=True)
class Project(_Unary):
    """The named variables in order; a repeated name counts once, an unknown one is unbound."""

    names: tuple[str, ...] = ()
    flags: OperatorFlags = NO_FLAGS

    def __post_init__(self):
        if any(n is None for n in self.names):
            raise IllegalArgument("a variable name is missing")
        object.__setattr__(self, "names", tuple(self.names))

    @property
    def public_vars(self):
        return tuple(merge_vars(self.names))

    def bind(self, binding):
        if not any(k in self.all_vars or k in self.names for k in binding):
            return self
        kept = tuple(n for n in self.names if binding.get(n) is None)
        return dataclasses.replace(self, input=self.input.bind(binding), names=kept)

    def describe(self):
        return f"Project{list(self.public_vars)}"


@dataclass(frozen=True)
class Distinct(_Unary):
    """No row twice.  With ``window`` and ``ALLOW_DUPLICATES``, rows repeated farther apart than ``window`` may stay."""

    window: int | None = None
    flags: OperatorFlags = NO_FLAGS

    def __post_init__(self):
        if self.window is not None and self.window < 1:
            raise IllegalArgument(f"window {self.window}")

    def describe(self):
        return "Distinct" + (f"(window={self.window})" if self.window else "")


@dataclass(frozen=True)
class Slice(_Unary):
    """Rows from ``offset`` on, ``limit`` at most, in the order of ``order_by`` (``-x``: descending) or as they come."""

    offset: int = 0
    limit: int | None = None
    order_by: tuple[str, ...] = ()
    flags: OperatorFlags = NO_FLAGS
    #: Not part of the plan's identity.
    note: str = field(default="", compare=False)

    def __post_init__(self):
        if self.offset < 0 or (self.limit is not None and self.limit < 0):
            raise IllegalArgument(f"offset {self.offset}, limit {self.limit}")

    def describe(self):
        return f"Slice({self.offset}, {self.limit})"
