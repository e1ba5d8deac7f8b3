"""Filter expressions of the SPARQL 1.1 grammar, compiled to one Spark column.

A small operator-precedence parser builds nested tuples; :func:`compile_expr` turns them into a ``Value``: a
column with the domain it lives in.  Native domains are ``bool``, ``num``, ``str``, ``time`` and ``iri``; ``nt``
is N-Triples text whose datatype is known only at run time.  An error is NULL, whose three-valued logic is that
of SPARQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExprSyntaxError, UnboundVariableError
from . import terms

_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
      |(?P<var>[?$]\w+)
      |(?P<iri><[^<>"{}|^`\\\s]*>)
      |(?P<str>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
      |(?P<num>\d+\.?\d*[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?|\d+\.\d+|\d+)
      |(?P<blank>_:\w[\w.-]*)
      |(?P<name>[A-Za-z][\w-]*)?(?P<colon>:(?P<local>[\w.-]*))
      |(?P<word>[A-Za-z_][\w]*)
      |(?P<op>\^\^|\|\||&&|!=|<=|>=|[=<>!+\-*/(),])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokens(text: str, prefixes: dict[str, str]) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExprSyntaxError(f"unexpected {text[at]!r} at {at} in {text!r}")
        if m["colon"] is not None:
            prefix = m["name"] or ""
            if prefix not in prefixes:
                raise ExprSyntaxError(f"undeclared prefix {prefix!r} in {text!r}")
            out.append(Token("iri", f"<{prefixes[prefix]}{m['local']}>", at))
        elif not m["space"]:
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return [*out, Token("end", "", at)]


def string_value(token: str) -> str:
    """The characters that a quoted string of any of the four styles stands for."""
    body = token[3:-3] if token[:3] in ('"""', "'''") else token[1:-1]
    known = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}

    def one(m: re.Match) -> str:
        return chr(int(m[1][1:], 16)) if len(m[1]) > 1 else known.get(m[1], m[1])

    return re.sub(r"(?s)\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, body)


class _Parser:
    """Binding powers: ``||`` 1, ``&&`` 2, comparisons 3 (not chained), sums 4, products 5."""

    POWER = {"||": 1, "&&": 2, "=": 3, "!=": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "IN": 3, "NOT": 3, "+": 4, "-": 4, "*": 5, "/": 5}

    def __init__(self, text: str, prefixes: dict[str, str]):
        self.text, self.list, self.i = text, tokens(text, prefixes), 0

    def peek(self) -> Token:
        return self.list[self.i]

    def next(self, expected: str | None = None) -> Token:
        t = self.list[self.i]
        if expected and t.text != expected:
            raise ExprSyntaxError(f"expected {expected!r}, found {t.text or 'the end'!r} at {t.at} in {self.text!r}")
        self.i += 1
        return t

    def whole(self) -> tuple:
        e = self.expr(0)
        if self.peek().kind != "end":
            raise ExprSyntaxError(f"unexpected {self.peek().text!r} at {self.peek().at} in {self.text!r}")
        return e

    def power(self) -> tuple[str, int]:
        t = self.peek()
        op = t.text.upper() if t.kind == "word" else t.text if t.kind == "op" else ""
        return op, self.POWER.get(op, 0)

    def expr(self, floor: int) -> tuple:
        left = self.unary()
        while True:
            op, power = self.power()
            if power <= floor:
                return left
            self.next()
            if op == "NOT":
                if self.next().text.upper() != "IN":
                    raise ExprSyntaxError(f"expected IN after NOT in {self.text!r}")
                left = ("!", ("in", left, self.arguments()))
            elif op == "IN":
                left = ("in", left, self.arguments())
            else:
                left = (op, left, self.expr(power))

    def unary(self) -> tuple:
        t = self.peek()
        if t.text in ("!", "-", "+") and t.kind == "op":
            self.next()
            inner = self.unary()
            return ("!", inner) if t.text == "!" else ("neg", inner) if t.text == "-" else ("pos", inner)
        return self.primary()

    def arguments(self) -> list[tuple]:
        self.next("(")
        out = []
        while self.peek().text != ")":
            if out:
                self.next(",")
            if self.peek().text.upper() == "DISTINCT":
                raise ExprSyntaxError("DISTINCT is for aggregates, which filters don't have")
            out.append(self.expr(0))
        self.next(")")
        return out

    def primary(self) -> tuple:
        t = self.next()
        if t.text == "(":
            inner = self.expr(0)
            self.next(")")
            return inner
        if t.kind == "var":
            return ("var", t.text[1:])
        if t.kind == "str":
            text = string_value(t.text)
            if self.peek().kind == "lang":
                return ("lit", text, None, self.next().text[1:])
            if self.peek().text == "^^":
                self.next()
                kind = self.next()
                if kind.kind != "iri":
                    raise ExprSyntaxError(f"no datatype after ^^ in {self.text!r}")
                return ("lit", text, kind.text[1:-1], None)
            return ("lit", text, None, None)
        if t.kind == "num":
            name = "double" if re.search("[eE]", t.text) else "decimal" if "." in t.text else "integer"
            return ("lit", t.text, terms.XSD + name, None)
        if t.kind == "iri":
            return ("call", t.text[1:-1], self.arguments()) if self.peek().text == "(" else ("iri", t.text[1:-1])
        if t.kind == "word" and t.text in ("true", "false"):
            return ("lit", t.text, terms.XSD + "boolean", None)
        if t.kind == "word" and self.peek().text == "(":
            return ("call", t.text.upper(), self.arguments())
        raise ExprSyntaxError(f"unexpected {t.text or 'end'!r} at {t.at} in {self.text!r}")


def parse(text: str, prefixes: dict[str, str] | None = None) -> tuple:
    return _Parser(text, terms.PREFIXES | (prefixes or {})).whole()


def variables(node: tuple) -> list[str]:
    """The variables of a parsed expression in order of appearance."""
    if node[0] == "var":
        return [node[1]]
    out: list[str] = []
    for part in node[1:]:
        for x in part if isinstance(part, list) else [part]:
            if isinstance(x, tuple):
                out += [v for v in variables(x) if v not in out]
    return out


@dataclass(frozen=True)
class Value:
    """A column and its domain; ``tag`` is the language of a literal in the ``str`` domain, where known."""

    column: Column
    domain: str
    tag: str = ""
    type: str = ""


def native(column: Column, kind: T.DataType) -> Value:
    """A native column as a value."""
    if isinstance(kind, T.BooleanType):
        return Value(column, "bool", type="boolean")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return Value(column, "time", type="date" if isinstance(kind, T.DateType) else "dateTime")
    if isinstance(kind, T.NumericType):
        names = {"tinyint": "byte", "smallint": "short", "bigint": "long"}
        simple = kind.simpleString().split("(")[0]
        return Value(column, "num", type=names.get(simple, simple))
    return Value(column, "str", type="string")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _term(v: Value) -> Column:
    """The N-Triples text of any value."""
    if v.domain == "nt":
        return v.column
    if v.domain == "iri":
        return terms.nt_iri(v.column)
    if v.domain == "str":
        return terms.nt_literal(v.column, lang=v.tag or None)
    if v.domain == "time" and v.type == "dateTime":
        return terms.nt_literal(F.date_format(v.column, "yyyy-MM-dd'T'HH:mm:ss"), terms.XSD + "dateTime")
    return terms.nt_literal(v.column.cast("string"), terms.XSD + (v.type or "decimal"))


def _text(v: Value) -> Column:
    """``STR`` of a value."""
    return terms.lexical(v.column) if v.domain == "nt" else v.column if v.domain in ("str", "iri") else v.column.cast("string")


def _num(v: Value) -> Column:
    if v.domain == "num":
        return v.column
    return terms.number(v.column) if v.domain == "nt" else _null("double")


def ebv(v: Value, strict: bool = False) -> Column:
    """The effective boolean value: NULL is an error."""
    if v.domain == "bool":
        return v.column
    if v.domain == "num":
        return (v.column != 0) & ~F.isnan(v.column.cast("double"))
    if v.domain == "str":
        return v.column != ""
    if v.domain == "nt":
        return F.when(v.column.isNotNull(), terms.coerce_to_bool(v.column, strict))
    return _null("boolean")


def _compare(op: str, a: Value, b: Value) -> Column:
    test: Callable[[Column, Column], Column] = {
        "=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y,
        ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y,
    }[op]
    if "nt" not in (a.domain, b.domain):
        if a.domain == b.domain and a.tag.lower() == b.tag.lower():
            return test(a.column, b.column)
        if {a.domain, b.domain} == {"time", "str"}:
            return test(a.column.try_cast("timestamp_ntz"), b.column.try_cast("timestamp_ntz"))
        same = {"=": False, "!=": True}.get(op)
        both = a.column.isNotNull() & b.column.isNotNull()
        return F.when(both, F.lit(same)) if same is not None else _null("boolean")
    if "num" in (a.domain, b.domain) or "str" in (a.domain, b.domain):
        # one side's type is known, which leaves one way in which the other can be like it
        known, other = (b, a) if a.domain == "nt" else (a, b)
        if known.domain == "num":
            alike, found = _num(other).isNotNull(), test(_num(a), _num(b))
        else:
            plain = terms.datatype(other.column).isin(terms.XSD + "string", terms.LANG_STRING)
            alike, found = plain & (F.lower(terms.lang(other.column)) == known.tag.lower()), test(_text(a), _text(b))
        both = a.column.isNotNull() & b.column.isNotNull()
        alike = F.coalesce(alike, F.lit(False))
        return F.when(both, F.when(alike, found).otherwise(F.lit(op == "!="))) if op in ("=", "!=") else F.when(both & alike, found)
    # run-time types: numbers by value, times by instant, other literals of one datatype and language by text
    x, y = _term(a), _term(b)
    n = test(_num(a), _num(b))
    numeric = _num(a).isNotNull() & _num(b).isNotNull()
    stamp = lambda t: F.when(terms.datatype(t).isin(terms.XSD + "dateTime", terms.XSD + "date"), terms.lexical(t).try_cast("timestamp"))
    times = stamp(x).isNotNull() & stamp(y).isNotNull()
    alike = (terms.datatype(x) == terms.datatype(y)) & (F.lower(terms.lang(x)) == F.lower(terms.lang(y)))
    text = test(terms.lexical(x), terms.lexical(y))
    same = F.when(numeric, n).when(times, test(stamp(x), stamp(y)))
    both = x.isNotNull() & y.isNotNull()
    if op in ("=", "!="):
        equal = terms.expand(x) == terms.expand(y)
        return F.when(both, same.when(alike, text).otherwise(equal if op == "=" else ~equal))
    return F.when(both, same.when(alike, text))


def _same_kind(values: list[Value]) -> list[Value]:
    """Values brought to one domain, as CASE needs."""
    if len({(v.domain, v.tag) for v in values}) == 1:
        return values
    return [Value(_term(v), "nt") for v in values]


def _string(v: Value, column: Column) -> Value:
    """A string result that keeps the language tag of its argument."""
    if v.domain == "nt":
        tag = terms.lang(v.column)
        return Value(F.when(tag != "", terms.nt_literal(column, lang=tag)).otherwise(terms.nt_literal(column)), "nt")
    return Value(column, "str", v.tag)


def _flags(flags: str) -> str:
    bad = set(flags) - set("ismx")
    if bad:
        raise ExprSyntaxError(f"unknown pattern flags {sorted(bad)}")
    return f"(?{flags})" if flags else ""


def _constant(node: tuple, what: str) -> str:
    if node[0] != "lit":
        raise ExprSyntaxError(f"{what} must be a literal string")
    return node[1]


#: Functions added by :func:`register_function`.
_ADDED: dict[str, Callable[..., Column]] = {}


def register_function(name: str, function: Callable[..., Column], domain: str = "str") -> None:
    """Make ``function`` (columns to a column) callable in filters by a word or an IRI."""
    _ADDED[name if ":" in name else name.upper()] = lambda *a: Value(function(*[_text(v) if v.domain == "nt" else v.column for v in a]), domain)


class _Compiler:
    def __init__(self, scope: dict[str, Value], strict: bool):
        self.scope, self.strict = scope, strict

    def boolean(self, node: tuple) -> Column:
        return ebv(self.value(node), self.strict)

    def value(self, node: tuple) -> Value:
        op = node[0]
        if op == "var":
            if node[1] in self.scope:
                return self.scope[node[1]]
            if self.strict:
                raise UnboundVariableError(f"?{node[1]} is bound nowhere")
            return Value(_null("string"), "nt")
        if op == "lit":
            return self.literal(*node[1:])
        if op == "iri":
            return Value(F.lit(node[1]), "iri")
        if op == "||":
            return Value(self.boolean(node[1]) | self.boolean(node[2]), "bool", type="boolean")
        if op == "&&":
            return Value(self.boolean(node[1]) & self.boolean(node[2]), "bool", type="boolean")
        if op == "!":
            return Value(~self.boolean(node[1]), "bool", type="boolean")
        if op in ("=", "!=", "<", ">", "<=", ">="):
            return Value(_compare(op, self.value(node[1]), self.value(node[2])), "bool", type="boolean")
        if op == "in":
            left, found = self.value(node[1]), F.lit(False)
            for x in node[2]:
                found = found | _compare("=", left, self.value(x))
            return Value(found, "bool", type="boolean")
        if op in ("+", "-", "*", "/"):
            a, b = _num(self.value(node[1])), _num(self.value(node[2]))
            f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
            return Value(f(a, b), "num")
        if op in ("neg", "pos"):
            v = _num(self.value(node[1]))
            return Value(F.try_subtract(F.lit(0), v) if op == "neg" else v, "num")
        return self.call(node[1], node[2])

    @staticmethod
    def literal(text: str, kind: str | None, tag: str | None) -> Value:
        if tag:
            return Value(F.lit(text), "str", tag)
        name = (kind or terms.XSD + "string").removeprefix(terms.XSD)
        if kind == terms.RDF + "langString" or not (kind or terms.XSD).startswith(terms.XSD):
            return Value(terms.nt_literal(F.lit(text), kind), "nt")
        if name in terms.INTEGERS and re.fullmatch(r"[+-]?\d+", text):
            return Value(F.lit(int(text)) if abs(int(text)) < 1 << 63 else F.lit(text).cast("decimal(38,0)"), "num", type=name)
        if name == "decimal" and re.fullmatch(r"[+-]?\d*\.?\d+", text):
            digits = len(text.split(".")[1]) if "." in text else 0
            return Value(F.lit(text).cast(f"decimal(38,{min(digits, 18)})"), "num", type=name)
        if name in ("double", "float"):
            return Value(F.lit(text).try_cast("double"), "num", type=name)
        if name == "boolean":
            return Value(F.lit({"true": True, "1": True, "false": False, "0": False}.get(text)), "bool", type=name)
        if name in ("dateTime", "date"):
            return Value(F.lit(text).try_cast("timestamp_ntz" if name == "dateTime" else "date"), "time", type=name)
        if name == "string":
            return Value(F.lit(text), "str", type=name)
        return Value(terms.nt_literal(F.lit(text), kind), "nt")

    def call(self, name: str, nodes: list[tuple]) -> Value:
        if name in _ADDED:
            return _ADDED[name](*[self.value(n) for n in nodes])
        if name.startswith(terms.XSD):
            return self.cast(name.removeprefix(terms.XSD), nodes)
        method = getattr(self, f"f_{name.lower()}", None)
        if method is None:
            raise ExprSyntaxError(f"unknown function {name}")
        try:
            return method(*nodes)
        except TypeError as e:
            if "positional argument" in str(e):
                raise ExprSyntaxError(f"wrong number of arguments for {name}") from e
            raise

    def cast(self, name: str, nodes: list[tuple]) -> Value:
        if len(nodes) != 1:
            raise ExprSyntaxError(f"xsd:{name} takes one argument")
        v = self.value(nodes[0])
        kinds = {"integer": "decimal(38,0)", "int": "int", "long": "bigint", "short": "smallint", "byte": "tinyint", "double": "double",
                 "float": "float", "decimal": "decimal(38,18)"}
        if name in kinds:
            source = _text(v) if v.domain in ("nt", "str") else v.column.cast("int") if v.domain == "bool" else v.column
            return Value(F.trim(source).try_cast(kinds[name]) if v.domain in ("nt", "str") else source.try_cast(kinds[name]), "num", type=name)
        if name == "boolean":
            if v.domain == "bool":
                return v
            text = _text(v)
            by_name = F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)
            return Value(F.coalesce(by_name, _num(v) != 0) if v.domain in ("nt", "num") else by_name, "bool", type=name)
        if name == "string":
            return Value(_text(v), "str", type=name)
        if name in ("dateTime", "date"):
            return Value(_text(v).try_cast("timestamp_ntz" if name == "dateTime" else "date"), "time", type=name)
        raise ExprSyntaxError(f"no cast to xsd:{name}")

    def _bool(self, c: Column) -> Value:
        return Value(c, "bool", type="boolean")

    # --- tests on terms
    def f_bound(self, n):
        if n[0] != "var":
            raise ExprSyntaxError("BOUND takes a variable")
        return self._bool(self.scope[n[1]].column.isNotNull() if n[1] in self.scope else F.lit(False))

    def _kind(self, n, wanted: str, domains: tuple[str, ...]) -> Value:
        v = self.value(n)
        if v.domain == "nt":
            return self._bool(terms.kind(v.column) == wanted)
        return self._bool(F.when(v.column.isNotNull(), F.lit(v.domain in domains)))

    def f_isiri(self, n):
        return self._kind(n, "iri", ("iri",))

    f_isuri = f_isiri

    def f_isblank(self, n):
        return self._kind(n, "blank", ())

    def f_isliteral(self, n):
        return self._kind(n, "literal", ("str", "num", "bool", "time"))

    def f_isnumeric(self, n):
        v = self.value(n)
        return self._bool(terms.is_numeric(v.column) if v.domain == "nt" else F.when(v.column.isNotNull(), F.lit(v.domain == "num")))

    def f_sameterm(self, a, b):
        a, b = self.value(a), self.value(b)
        same = a.domain == b.domain and (a.tag, a.type) == (b.tag, b.type)
        return self._bool(a.column == b.column if same else _term(a) == _term(b))

    # --- parts of terms
    def f_str(self, n):
        return Value(_text(self.value(n)), "str")

    def f_lang(self, n):
        v = self.value(n)
        if v.domain == "nt":
            return Value(terms.lang(v.column), "str")
        return Value(_null("string") if v.domain == "iri" else F.when(v.column.isNotNull(), F.lit(v.tag)), "str")

    def f_langmatches(self, a, b):
        tag, wanted = F.lower(_text(self.value(a))), F.lower(_text(self.value(b)))
        return self._bool(F.when(wanted == "*", tag != "").otherwise((tag == wanted) | tag.startswith(F.concat(wanted, F.lit("-")))))

    def f_datatype(self, n):
        v = self.value(n)
        if v.domain == "nt":
            return Value(terms.datatype(v.column), "iri")
        name = terms.LANG_STRING if v.tag else terms.XSD + (v.type or {"num": "decimal"}.get(v.domain, "string"))
        return Value(_null("string") if v.domain == "iri" else F.when(v.column.isNotNull(), F.lit(name)), "iri")

    def f_iri(self, n):
        return Value(_text(self.value(n)), "iri")

    f_uri = f_iri

    def f_bnode(self, n=None):
        label = F.replace(F.uuid(), F.lit("-"), F.lit("")) if n is None else F.sha1(_text(self.value(n)))
        return Value(terms.nt_blank(label), "nt")

    def f_strdt(self, a, b):
        return Value(terms.nt_literal(_text(self.value(a)), _text(self.value(b))), "nt")

    def f_strlang(self, a, b):
        return Value(terms.nt_literal(_text(self.value(a)), lang=_text(self.value(b))), "nt")

    # --- conditions
    def f_if(self, test, yes, no):
        a, b = _same_kind([self.value(yes), self.value(no)])
        test = self.boolean(test)
        return Value(F.when(test.isNotNull(), F.when(test, a.column).otherwise(b.column)), a.domain, a.tag, a.type)

    def f_coalesce(self, *nodes):
        values = _same_kind([self.value(n) for n in nodes])
        return Value(F.coalesce(*[v.column for v in values]), values[0].domain, values[0].tag, values[0].type)

    # --- strings
    def f_strlen(self, n):
        return Value(F.length(_text(self.value(n))), "num", type="integer")

    def f_substr(self, n, start, size=None):
        v = self.value(n)
        first = _num(self.value(start)).cast("int")
        if size is None:
            return _string(v, F.substring(_text(v), F.greatest(first, F.lit(1)), F.length(_text(v))))
        last = first + _num(self.value(size)).cast("int")
        return _string(v, F.substring(_text(v), F.greatest(first, F.lit(1)), F.greatest(last - F.greatest(first, F.lit(1)), F.lit(0))))

    def f_ucase(self, n):
        return _string(v := self.value(n), F.upper(_text(v)))

    def f_lcase(self, n):
        return _string(v := self.value(n), F.lower(_text(v)))

    def f_strstarts(self, a, b):
        return self._bool(_text(self.value(a)).startswith(_text(self.value(b))))

    def f_strends(self, a, b):
        return self._bool(_text(self.value(a)).endswith(_text(self.value(b))))

    def f_contains(self, a, b):
        return self._bool(_text(self.value(a)).contains(_text(self.value(b))))

    def f_strbefore(self, a, b):
        v, mark = self.value(a), _text(self.value(b))
        at = F.position(mark, _text(v))
        return _string(v, F.when(at > 0, F.substring(_text(v), F.lit(1), at - 1)).when(at == 0, F.lit("")))

    def f_strafter(self, a, b):
        v, mark = self.value(a), _text(self.value(b))
        at = F.position(mark, _text(v))
        return _string(v, F.when(at > 0, F.substring(_text(v), at + F.length(mark), F.length(_text(v)))).when(at == 0, F.lit("")))

    def f_concat(self, *nodes):
        return Value(F.concat(*[_text(self.value(n)) for n in nodes]) if nodes else F.lit(""), "str")

    def f_encode_for_uri(self, n):
        return Value(F.replace(F.replace(F.url_encode(_text(self.value(n))), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), "str")

    def f_regex(self, n, pattern, flags=("lit", "", None, None)):
        text, wanted = _text(self.value(n)), self.value(pattern)
        flag = _constant(flags, "the flags of REGEX")
        if "q" in flag:
            return self._bool(text.contains(wanted.column))
        return self._bool(F.regexp(text, F.concat(F.lit(_flags(flag)), _text(wanted))))

    def f_replace(self, n, pattern, to, flags=("lit", "", None, None)):
        v = self.value(n)
        wanted = F.concat(F.lit(_flags(_constant(flags, "the flags of REPLACE"))), _text(self.value(pattern)))
        return _string(v, F.regexp_replace(_text(v), wanted, _text(self.value(to))))

    # --- numbers
    def f_abs(self, n):
        return Value(F.abs(_num(self.value(n))), "num")

    def f_round(self, n):
        return Value(F.floor(_num(self.value(n)) + F.lit(0.5)), "num")

    def f_ceil(self, n):
        return Value(F.ceil(_num(self.value(n))), "num")

    def f_floor(self, n):
        return Value(F.floor(_num(self.value(n))), "num")

    def f_rand(self):
        return Value(F.rand(), "num", type="double")

    # --- time
    def _time(self, n) -> Column:
        v = self.value(n)
        return v.column if v.domain == "time" else _text(v).try_cast("timestamp")

    def f_now(self):
        return Value(F.current_timestamp(), "time", type="dateTime")

    def f_year(self, n):
        return Value(F.year(self._time(n)), "num", type="integer")

    def f_month(self, n):
        return Value(F.month(self._time(n)), "num", type="integer")

    def f_day(self, n):
        return Value(F.dayofmonth(self._time(n)), "num", type="integer")

    def f_hours(self, n):
        return Value(F.hour(self._time(n)), "num", type="integer")

    def f_minutes(self, n):
        return Value(F.minute(self._time(n)), "num", type="integer")

    def f_seconds(self, n):
        return Value(F.second(self._time(n)), "num", type="integer")

    def f_tz(self, n):
        return Value(F.regexp_extract(_text(self.value(n)), r"(Z|[+-]\d\d:\d\d)$", 1), "str")

    def f_timezone(self, n):
        tz = F.regexp_extract(_text(self.value(n)), r"(Z|[+-]\d\d:\d\d)$", 1)
        hours, minutes = F.substring(tz, 2, 2).try_cast("int"), F.substring(tz, 5, 2).try_cast("int")
        size = F.concat(F.when(tz.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""),
                        F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
        zero = (tz == "Z") | ((hours == 0) & (minutes == 0))
        return Value(F.when(tz != "", terms.nt_literal(F.when(zero, "PT0S").otherwise(size), terms.XSD + "dayTimeDuration")), "nt")

    # --- hashes
    def f_md5(self, n):
        return Value(F.md5(_text(self.value(n))), "str")

    def f_sha1(self, n):
        return Value(F.sha1(_text(self.value(n))), "str")

    def _sha(self, n, bits: int) -> Value:
        return Value(F.sha2(_text(self.value(n)), bits), "str")

    def f_sha256(self, n):
        return self._sha(n, 256)

    def f_sha384(self, n):
        return self._sha(n, 384)

    def f_sha512(self, n):
        return self._sha(n, 512)


def compile_expr(expression: str | tuple, scope: dict[str, Value], strict: bool = False, prefixes: dict[str, str] | None = None) -> Value:
    """The value of an expression over a scope of variables.

    ``strict`` makes a variable that the scope lacks, or a string without boolean value, an error of the query.
    """
    return _Compiler(scope, strict).value(parse(expression, prefixes) if isinstance(expression, str) else expression)


def condition(expression: str | tuple, scope: dict[str, Value], strict: bool = False, prefixes: dict[str, str] | None = None) -> Column:
    """The expression as a condition: NULL (an error) rejects a row, as false does."""
    return ebv(compile_expr(expression, scope, strict, prefixes), strict)
