"""Files of query results (JSON, TSV, CSV) as sources, read and decoded by Spark's own readers and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IllegalArgument
from ..functions import terms
from ..operators.solution import Solution, from_frame

_JSON = "struct<head:struct<vars:array<string>>,boolean:string,results:struct<bindings:array<map<string,struct<type:string,value:string,datatype:string,`xml:lang`:string>>>>>"


def _name(datatype: Column) -> Column:
    """The IRI of a datatype that may be written with a known prefix; one lookup, so that no text is copied for each prefix."""
    bare = F.regexp_replace(datatype, "^<|>$", "")
    known = F.create_map(*[F.lit(x) for pair in terms.PREFIXES.items() for x in pair])
    base = F.try_element_at(known, F.regexp_extract(bare, "^([^:]*):", 1))
    return F.coalesce(F.concat(base, F.regexp_extract(bare, "(?s)^[^:]*:(.*)$", 1)), bare)


def json_term(cell: Column) -> Column:
    """The N-Triples text of a JSON cell, a missing type guessed from what it has."""
    kind, value, datatype, lang = cell["type"], cell["value"], cell["datatype"], cell["xml:lang"]
    untyped = kind.isNull()
    blank = kind.isin("bnode", "blank") | (untyped & value.startswith("_:"))
    iri = kind.isin("uri", "iri") | (untyped & lang.isNull() & datatype.isNull() & value.rlike("(?i)^https?://"))
    label = F.regexp_replace(F.coalesce(value, F.lit("")), "^_:", "")
    literal = (
        F.when(lang.isNotNull(), terms.nt_literal(value, lang=lang))
        .when(datatype.isNotNull(), terms.nt_literal(value, _name(datatype)))
        .otherwise(terms.nt_literal(value))
    )
    return F.when(cell.isNull(), None).when(blank, F.concat(F.lit("_:"), F.when(label == "", F.uuid()).otherwise(label))).when(iri, terms.nt_iri(value)).otherwise(literal)


def csv_term(cell: Column) -> Column:
    return F.when(cell == "", None).when(cell.rlike("(?i)^https?://"), terms.nt_iri(cell)).when(cell.startswith("_:"), cell).otherwise(terms.nt_literal(cell))


def tsv_term(cell: Column) -> Column:
    cell = F.btrim(cell, F.lit(" \r"))
    literal = F.lit(r'(?s)^"((?:[^"\\]|\\.)*)"(@[A-Za-z0-9_-]+|\^\^\S+)?$')
    kind = F.regexp_extract(cell, r'\^\^(\S+)$', 1)
    body, tag = F.regexp_extract(cell, r'(?s)^("(?:[^"\\]|\\.)*")', 1), F.regexp_extract(cell, r'"@([A-Za-z0-9_-]+)$', 1)
    as_literal = (
        F.when(tag != "", F.concat(body, F.lit("@"), F.replace(tag, F.lit("_"), F.lit("-"))))
        .when(kind != "", F.concat(body, F.lit("^^<"), _name(kind), F.lit(">")))
        .otherwise(body)
    )
    short = terms.expand(cell)
    return (
        F.when(cell == "", None)
        .when(F.regexp(cell, literal), as_literal)
        .when(short != cell, short)
        .when(cell == "[]", F.concat(F.lit("_:"), F.uuid()))
        .when(cell.rlike(r"^<[^<>\s]*>$|^_:\S*$"), cell)
        .otherwise(terms.nt_literal(cell))
    )


def _checked(cells: Column, n: int, mode: str) -> Column:
    """The cells of a line, or an error if there are too few or too many (``PERMISSIVE``: missing ones are unbound)."""
    if mode == "PERMISSIVE":
        return cells
    return F.when(F.size(cells) == n, cells).otherwise(F.raise_error(F.concat(F.lit(f"columns instead of {n}: "), F.size(cells).cast("string"))))


class ResultsFileSource:
    """``path`` holds one document or a folder of documents of one format with the same variables.

    ``format``: ``json``, ``tsv`` or ``csv`` (default: by the suffix).  ``mode``: ``FAILFAST`` or ``PERMISSIVE`` for lines
    with a wrong number of columns.  JSON documents are each read whole by one task; lines of TSV are split freely;
    line ends within quoted CSV cells become ``\\n``.
    """

    def __init__(self, spark: SparkSession, path: str, format: str | None = None, names: tuple[str, ...] | None = None, mode: str = "FAILFAST"):  # noqa: A002
        self.path, self.format, self.mode = path, (format or path.rstrip("/").rsplit(".", 1)[-1]).lower(), mode.upper()
        if self.format not in ("json", "tsv", "csv"):
            raise IllegalArgument(f"no reader for {self.format!r} results")
        self.header: list[str] = []
        self.public_vars = tuple(names) if names is not None else tuple(self._names(spark))
        self.all_vars = self.public_vars

    def _first(self, spark: SparkSession) -> str | None:
        row = spark.read.text(self.path).limit(1).collect()
        return row[0].value if row else None

    def _names(self, spark: SparkSession) -> list[str]:
        if self.format == "json":
            docs = self._documents(spark).select("d.head.vars").limit(1).collect()
            return list(docs[0].vars or []) if docs else []
        if self.format == "csv":
            row = spark.read.csv(self.path, multiLine=True, quote='"', escape='"', header=False).limit(1).collect()
            self.header = [x or "" for x in row[0]] if row else []
            names = [x.strip() for x in self.header]
        else:
            self.header = (self._first(spark) or "").rstrip("\r").split("\t")
            names = [x.strip().lstrip("?$") for x in self.header]
        return [] if names == [""] or (len(names) == 1 and names[0].lower() == "_askresult") else names

    def _documents(self, spark: SparkSession) -> DataFrame:
        text = spark.read.text(self.path, wholetext=True)
        return text.select(F.from_json("value", T.StructType.fromDDL(f"d {_JSON}")["d"].dataType).alias("d"))

    def frame(self, spark: SparkSession) -> DataFrame:
        names = self.public_vars
        if self.format == "json":
            docs = self._documents(spark)
            yes = docs.where(F.lower("d.boolean").isin("true", "1")).select()
            if not names:
                return yes
            rows = docs.select(F.explode("d.results.bindings").alias("b"))
            return rows.select(*[json_term(F.element_at(F.col("b"), F.lit(v))).alias(v) for v in names])
        if self.format == "csv":
            schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(1, len(names)))])
            rows = spark.read.csv(self.path, schema=schema, multiLine=True, quote='"', escape='"', header=True, enforceSchema=True, mode=self.mode, emptyValue="", nullValue="\0")
            if not names:
                return rows.where(F.lower("c0") == "true").select()
            return rows.select(*[csv_term(F.coalesce(F.col(f"c{i}"), F.lit(""))).alias(v) for i, v in enumerate(names)])
        lines = spark.read.text(self.path)
        if not names:
            return lines.where(F.lower(F.btrim("value")) == "true").select()
        # a header a file; lines equal to it beyond that are rows, of which only the number matters
        head = "\t".join(self.header)
        bare = F.rtrim("value", F.lit("\r"))
        heads = lines.where(bare == head).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n")).where("n > 1")
        again = heads.select(F.explode(F.sequence(F.lit(2).cast("long"), F.col("n"))).alias("i")).select(F.lit(head).alias("value"))
        body = lines.where(bare != head).select("value").union(again).select(_checked(F.split("value", "\t", -1), len(names), self.mode).alias("cells"))
        return body.select(*[tsv_term(F.coalesce(F.get("cells", F.lit(i)), F.lit(""))).alias(v) for i, v in enumerate(names)])

    def solution(self, spark: SparkSession) -> Solution:
        return from_frame(self.frame(spark), self.public_vars, nt=self.public_vars)

    def __repr__(self):
        return f"{self.format}:{self.path}"


def write_results(df: DataFrame, path: str, nt: tuple[str, ...] = ()) -> None:
    """Write solutions as TSV parts, each with a header: columns in ``nt`` hold terms, others are lifted to them."""
    cells = [F.coalesce(F.col(f"`{f.name}`") if f.name in nt else terms.to_nt(F.col(f"`{f.name}`"), f.dataType), F.lit("")) for f in df.schema.fields]
    rows = df.select(*[c.alias("?" + f.name) for c, f in zip(cells, df.schema.fields)])
    rows.write.csv(path, sep="\t", header=True, quote="\0", escape="\0", emptyValue="")


__all__ = ["ResultsFileSource", "csv_term", "json_term", "tsv_term", "write_results"]
