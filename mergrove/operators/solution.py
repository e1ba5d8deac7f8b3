"""A solution sequence: a DataFrame, and what its columns mean."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr, terms

_serial = itertools.count()


def fresh(var: str) -> str:
    """A column name used nowhere else, so that joins never meet an ambiguous name."""
    return f"{var}__{next(_serial)}"


@dataclass(frozen=True)
class Solution:
    """``columns[v]`` are the columns that hold variable ``v``: for a public one the first is its value, the rest are
    hidden uses that a later join must match too.  ``maybe`` has the variables that may be unbound, ``nt`` those
    held as N-Triples text (others are native)."""

    df: DataFrame
    public: tuple[str, ...]
    columns: dict[str, tuple[str, ...]]
    maybe: frozenset[str]
    nt: frozenset[str]

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def has(self, var: str) -> bool:
        return var in self.columns

    def col(self, var: str) -> Column:
        return F.col(self.columns[var][0])

    def type(self, var: str) -> T.DataType:
        return self.df.schema[self.columns[var][0]].dataType

    def value(self, var: str) -> expr.Value:
        """The variable as an operand of a filter expression."""
        return expr.Value(self.col(var), "nt") if var in self.nt else expr.native(self.col(var), self.type(var))

    def term(self, var: str, column: str | None = None) -> Column:
        """The variable as N-Triples text."""
        c = F.col(column or self.columns[var][0])
        return c if var in self.nt else terms.to_nt(c, self.df.schema[column or self.columns[var][0]].dataType)

    def frame(self) -> DataFrame:
        """The public variables as plain columns."""
        return self.df.select(*[self.col(v).alias(v) for v in self.public])

    def keep(self, public: tuple[str, ...], needed: frozenset[str]) -> Solution:
        """``public`` in that order, unknown ones unbound; of the rest, those that an ancestor may join by stay hidden."""
        names = {v: self.columns[v] for v in (*public, *self.columns) if v in self.columns and (v in public or v in needed)}
        added = {v: (fresh(v),) for v in public if v not in self.public}
        columns = dict(names)
        for v, new in added.items():
            columns[v] = (*new, *names.get(v, ()))
        df = self.df.select(
            *dict.fromkeys(c for v in names for c in names[v]), *[F.lit(None).cast("string").alias(n[0]) for n in added.values()]
        )
        nt = (self.nt & frozenset(columns)) | frozenset(v for v in added if v not in names)
        return Solution(df, public, columns, (self.maybe & frozenset(columns)) | frozenset(added), nt)

    def as_nt(self, names: frozenset[str]) -> Solution:
        """The same with the given variables as N-Triples text."""
        todo = [v for v in names if v in self.columns and v not in self.nt]
        if not todo:
            return self
        new = {c: fresh(v) for v in todo for c in self.columns[v]}
        keep = [F.col(c) for c in self.df.columns if c not in new]
        df = self.df.select(*keep, *[self.term(v, c).alias(new[c]) for v in todo for c in self.columns[v]])
        columns = {v: tuple(new.get(c, c) for c in cs) for v, cs in self.columns.items()}
        return Solution(df, self.public, columns, self.maybe, self.nt | frozenset(todo))


def from_frame(df: DataFrame, public: tuple[str, ...], hidden: tuple[str, ...] = (), nt=(), nullable: bool | None = None) -> Solution:
    """A solution over a DataFrame whose columns are named by variables."""
    columns = {v: (fresh(v),) for v in (*public, *hidden)}
    at = {n: i for i, n in enumerate(df.columns)}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = plain.select(*[F.col(f"c{at[v]}").alias(columns[v][0]) for v in columns])
    maybe = frozenset(v for v in columns if (df.schema.fields[at[v]].nullable if nullable is None else nullable))
    return Solution(out, public, columns, maybe, frozenset(nt))
