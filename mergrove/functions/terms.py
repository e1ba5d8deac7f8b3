"""RDF terms held as N-Triples text, and their conversion from and to native Spark columns.

Every function maps ``Column`` to ``Column`` and stays within built-in expressions.  A term that is unbound, or
an operation that SPARQL calls an error, is SQL NULL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"

#: Prefixes that filter expressions and patterns may use undeclared.
PREFIXES = {"xsd": XSD, "rdf": RDF, "rdfs": RDFS, "owl": OWL}

#: The local names of the XML Schema datatypes known by name.
XSD_NAMES = (
    "duration", "dateTime", "time", "date", "gYearMonth", "gYear", "gMonthDay", "gDay", "gMonth", "boolean", "base64Binary",
    "hexBinary", "float", "decimal", "double", "anyURI", "string", "integer", "nonPositiveInteger", "long", "nonNegativeInteger",
    "negativeInteger", "int", "unsignedLong", "positiveInteger", "short", "unsignedInt", "byte", "unsignedShort", "unsignedByte",
    "normalizedString", "token", "language",
)
INTEGERS = tuple(n for n in XSD_NAMES if re.search("nteger$|long$|Long$|int$|Int$|short$|Short$|byte$|Byte$", n))
NUMBERS = (*INTEGERS, "decimal", "float", "double")
LANG_STRING = RDF + "langString"

_LITERAL = r'(?s)^"(.*)"(?:@([A-Za-z0-9_-]+)|\^\^<([^>]*)>)?$'
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def escape(text: Column) -> Column:
    """A lexical form as it stands between the quotes of N-Triples."""
    for raw, safe in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    """The lexical form that an escaped text stands for; ``\\uXXXX`` and ``\\UXXXXXXXX`` included."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1))

    def one(p: Column) -> Column:
        mark = F.substring(p, 2, 1)
        named = F.element_at(F.create_map(*[F.lit(x) for pair in (("n", "\n"), ("r", "\r"), ("t", "\t"), ("b", "\b"), ("f", "\f")) for x in pair]), mark)
        code = F.decode(F.unhex(F.lpad(F.substring(p, 3, 8), 8, "0")), "UTF-32")
        plain = F.when(mark.isin("u", "U") & (F.length(p) > 2), code).otherwise(F.coalesce(named, mark))
        return F.when(p.startswith("\\") & (F.length(p) > 1), plain).otherwise(p)

    return F.when(text.contains("\\"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def nt_iri(iri: Column) -> Column:
    return F.concat(F.lit("<"), iri, F.lit(">"))


def nt_blank(label: Column) -> Column:
    return F.concat(F.lit("_:"), label)


def nt_literal(lexical: Column, datatype: str | Column | None = None, lang: Column | str | None = None) -> Column:
    """``"lexical"``, ``"lexical"@lang`` or ``"lexical"^^<datatype>``; ``_`` in a language becomes ``-``."""
    quoted = F.concat(F.lit('"'), escape(lexical), F.lit('"'))
    if lang is not None:
        return F.concat(quoted, F.lit("@"), F.replace(F.lit(lang) if isinstance(lang, str) else lang, F.lit("_"), F.lit("-")))
    if datatype is not None:
        return F.concat(quoted, F.lit("^^<"), F.lit(datatype) if isinstance(datatype, str) else datatype, F.lit(">"))
    return quoted


def kind(nt: Column) -> Column:
    """``iri``, ``blank``, ``literal`` or NULL for anything that is no term."""
    return (
        F.when(nt.startswith("<") & nt.endswith(">"), "iri")
        .when(nt.startswith("_:") | (nt == "[]"), "blank")
        .when(nt.rlike(_LITERAL), "literal")
    )


def lexical(nt: Column) -> Column:
    """``STR``: a literal's lexical form, an IRI's text."""
    return (
        F.when(kind(nt) == "iri", F.substring(nt, F.lit(2), F.length(nt) - 2))
        .when(nt.startswith('"'), unescape(F.regexp_extract(nt, _LITERAL, 1)))
    )


def lang(nt: Column) -> Column:
    return F.when(kind(nt) == "literal", F.regexp_extract(nt, _LITERAL, 2))


def datatype(nt: Column) -> Column:
    """The datatype IRI of a literal (without brackets): plain ones are strings."""
    named = F.regexp_extract(nt, _LITERAL, 3)
    return F.when(
        kind(nt) == "literal",
        F.when(named != "", named).when(F.regexp_extract(nt, _LITERAL, 2) != "", LANG_STRING).otherwise(XSD + "string"),
    )


_NUMBER = rf'^"([^"\\]+)"\^\^<{XSD}(?:{"|".join(NUMBERS)})>$'


def number(nt: Column) -> Column:
    """The value of a numeric literal as a double; NULL for any other term."""
    digits = F.regexp_extract(nt, _NUMBER, 1)
    return F.when(digits != "", F.trim(digits).try_cast("double"))


def is_numeric(nt: Column) -> Column:
    return F.when(nt.isNotNull(), number(nt).isNotNull())


def expand(nt: Column) -> Column:
    """A term with shorthand written out: bare numbers and booleans become typed literals, ``xsd:string`` goes."""
    typed = lambda name: F.concat(F.lit('"'), nt, F.lit(f'"^^<{XSD}{name}>'))
    return (
        F.when(nt.rlike(r"^[+-]?\d+$"), typed("integer"))
        .when(nt.rlike(r"^[+-]?\d*\.\d+$"), typed("decimal"))
        .when(nt.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+$"), typed("double"))
        .when(nt.isin("true", "false"), typed("boolean"))
        .when(nt.endswith(f"^^<{XSD}string>"), F.regexp_replace(nt, r"\^\^<[^>]*#string>$", ""))
        .otherwise(nt)
    )


def to_nt(column: Column, kind_of: T.DataType) -> Column:
    """A native column as N-Triples text, with the datatype of its Spark type."""
    names = {
        T.ByteType: "byte", T.ShortType: "short", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double",
        T.DecimalType: "decimal", T.BooleanType: "boolean", T.DateType: "date",
    }
    if isinstance(kind_of, T.StringType):
        return nt_literal(column)
    if isinstance(kind_of, (T.TimestampType, T.TimestampNTZType)):
        return nt_literal(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"), XSD + "dateTime")
    if isinstance(kind_of, T.BinaryType):
        return nt_literal(F.base64(column), XSD + "base64Binary")
    name = names.get(type(kind_of))
    if name is None:
        raise ValueError(f"a term is a scalar; there is none for {kind_of.simpleString()}")
    return nt_literal(column.cast("string"), XSD + name)


def to_native(nt: Column, spark_type: str) -> Column:
    """The value of a literal (or an IRI's text) as a native type; NULL where it has none."""
    return lexical(nt).try_cast(spark_type)


def coerce_to_bool(nt: Column, strict: bool = False) -> Column:
    """The effective boolean value of a term.

    NULL and the empty string are false; booleans and numbers count by value.  Other strings are true, or with
    ``strict`` an error that ends the query.
    """
    text, numeric = lexical(nt), lexical(nt).try_cast("double")
    boolish = F.lower(text).isin("true", "false")
    other = F.raise_error(F.concat(F.lit("no boolean value: "), nt)) if strict else F.lit(True)
    bare = expand(nt)
    return (
        F.when(nt.isNull() | nt.isin("", "''"), False)
        .when((bare != nt) & nt.isin("true", "false"), nt == "true")
        .when((bare != nt) & ~nt.startswith('"'), number(bare) != 0)
        .when((datatype(nt) == XSD + "boolean") | boolish, F.lower(text).isin("true", "1"))
        .when(text == "", False)
        .when(numeric.isNotNull(), (numeric != 0) & ~F.isnan(numeric))
        .when(F.lit(strict), other.cast("boolean"))
        .otherwise(kind(nt) == "literal")
    )
