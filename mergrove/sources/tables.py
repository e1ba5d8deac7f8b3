"""A relation as a source: columns become variables and keep their native types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..errors import IllegalArgument
from ..operators.solution import Solution, from_frame


class TableSource:
    """``columns`` maps columns to variables (default: each to its own name); ``hidden`` variables join but do not show.

    Parquet declares every column nullable; ``never_null`` lists variables known to be bound in every row, which
    keeps their joins plain equi-joins (default: those whose schema says so).  ``nt`` lists those that hold
    N-Triples text.
    """

    def __init__(self, df: DataFrame, columns: Mapping[str, str] | None = None, hidden: Sequence[str] = (), never_null: Sequence[str] | bool = (),
                 nt: Sequence[str] = (), name: str = "table"):
        self.df, self.columns, self.name = df, dict(columns or {c: c for c in df.columns}), name
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise IllegalArgument(f"no columns {missing} in {df.columns}")
        names = list(self.columns.values())
        if len(set(names)) != len(names):
            raise IllegalArgument(f"a variable is given twice in {names}")
        self.public_vars = tuple(v for v in names if v not in hidden)
        self.all_vars = tuple(names)
        self.never_null = frozenset(names if never_null is True else never_null or ())
        self.nt = tuple(nt)

    def solution(self, spark: SparkSession) -> Solution:
        at = {c: i for i, c in enumerate(self.df.columns)}
        plain = self.df.toDF(*[f"c{i}" for i in range(len(self.df.columns))])
        frame = plain.select(*[plain[f"c{at[c]}"].alias(v) for c, v in self.columns.items()])
        hidden = tuple(v for v in self.all_vars if v not in self.public_vars)
        s = from_frame(frame, self.public_vars, hidden, self.nt)
        return Solution(s.df, s.public, s.columns, s.maybe - self.never_null, s.nt)

    def __repr__(self):
        return self.name
