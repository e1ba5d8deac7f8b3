"""Endpoints over HTTP as a Spark data source, and bound queries against them.

``spark.read.format("sparql")`` (after ``register``) reads one query; ``EndpointSource`` is a leaf.  A bound query
sends batches of left rows as a VALUES block from each task, never one request a row.  Requests are repeated
after connection errors and 5xx answers; reading has no side effects, so retried tasks are safe.
"""

from __future__ import annotations

import io
import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import BadQuery, MalformedResults, ServerError, WrongQueryType
from ..functions import sparql_text
from ..operators.solution import Solution, from_frame
from .config import Configuration, Endpoint, MediaType, escape_query_param
from .results_text import parse_stream
from .web_socket import converse


def setting(name: str, default: str) -> str:
    """An option of this library from the environment: ``client.max-query-get`` is ``MERGROVE_CLIENT_MAX_QUERY_GET``."""
    return os.environ.get("MERGROVE_" + re.sub(r"[^A-Za-z0-9]", "_", name).upper(), default)


def request(endpoint: Endpoint, query: str, graph: bool = False) -> urllib.request.Request:
    config = endpoint.config.supported()
    method = config.method_for(query)
    params = "&".join(f"{urllib.parse.quote(k)}={escape_query_param(v)}" for k, vs in config.params.items() for v in vs)
    headers = {"accept": config.accept_header(graph)} | {k.lower(): v for k, v in config.headers.items()}
    for name, values in config.append_headers.items():
        headers[name.lower()] = ", ".join([*([headers[name.lower()]] if name.lower() in headers else []), *values])
    uri, body = endpoint.uri, None
    if method == "get":
        params = "&".join(p for p in (f"query={escape_query_param(query)}", params) if p)
    elif method == "form":
        body = urllib.parse.urlencode([("query", query), *((k, v) for k, vs in config.params.items() for v in vs)]).encode()
        headers["content-type"], params = "application/x-www-form-urlencoded", ""
    else:
        body, headers["content-type"] = query.encode(), "application/sparql-query"
    if params:
        uri += ("&" if "?" in uri else "?") + params
    return urllib.request.Request(uri, body, headers, method="GET" if body is None else "POST")


class _NoRedirects(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, req, fp, code, msg, headers, newurl):
        return None


def opened(endpoint: Endpoint, query: str, graph: bool = False, retries: int | None = None, wait: float | None = None):
    """The answer's media type, and the answer itself, still to be read."""
    retries = int(setting("client.conn.retries", "3")) if retries is None else retries
    wait = float(setting("client.conn.wait", "1.0")) if wait is None else wait
    opener = urllib.request.build_opener(_NoRedirects)
    for left in range(retries, -1, -1):
        try:
            answer = opener.open(request(endpoint, query, graph), timeout=600)
            kind = answer.headers.get("Content-Type")
            if not kind:
                answer.close()
                raise MalformedResults("the answer has no Content-Type")
            return MediaType.parse(kind), answer
        except urllib.error.HTTPError as e:
            if e.code < 500 or not left:
                raise ServerError(e.code, e.read(500).decode("utf-8", "replace")) from e
        except (urllib.error.URLError, ConnectionError, TimeoutError) as e:
            if not left:
                raise ServerError(0, f"{endpoint.uri}: {e}") from e
        time.sleep(wait)
    raise AssertionError


def fetch(endpoint: Endpoint, query: str, graph: bool = False, **options) -> tuple[MediaType, bytes]:
    """The answer's media type and its whole body."""
    kind, answer = opened(endpoint, query, graph, **options)
    with answer:
        return kind, answer.read()


def rows(endpoint: Endpoint, query: str, names: Sequence[str], **options) -> Iterator[tuple]:
    """Rows of a SELECT or ASK query as they arrive, in the order of ``names``; variables that the answer lacks are unbound."""

    def ordered(found: Sequence[str], lines: Iterator[tuple]) -> Iterator[tuple]:
        at = [found.index(v) if v in found else None for v in names]
        for row in lines:
            yield tuple(row[i] if i is not None else None for i in at)

    if endpoint.is_web_socket:
        talk = converse(endpoint.uri, query)
        yield from ordered(talk.vars or [], (row for _, row in talk.rows))
        return
    kind, answer = opened(endpoint, query, **options)
    with answer:
        yield from ordered(*parse_stream(str(kind), io.TextIOWrapper(answer, kind.charset, newline="\n")))


class SparqlDataSource(DataSource):
    """Options: ``uri`` (with keywords), ``query``, ``mode`` (``select`` or ``graph``), ``headers`` (JSON)."""

    @classmethod
    def name(cls):
        return "sparql"

    def _endpoint(self) -> Endpoint:
        e = Endpoint.parse(self.options["uri"])
        asked = Configuration(headers=json.loads(self.options.get("headers", "{}")), params={k: tuple(v) for k, v in json.loads(self.options.get("params", "{}")).items()})
        return Endpoint(e.uri, e.config.overlay(asked))

    def schema(self):
        query, graph = self.options["query"], self.options.get("mode", "select") == "graph"
        if graph != sparql_text.is_graph_query(query):
            raise WrongQueryType(f"mode {self.options.get('mode', 'select')!r} does not fit {query!r}")
        if graph:
            return T.StructType().add("chunk", "integer").add("media_type", "string").add("fragment", "binary")
        names = sparql_text.public_vars(query)
        return T.StructType([T.StructField(v, T.StringType()) for v in names or ["_ask"]])

    def reader(self, schema):
        return _Reader(self._endpoint(), self.options["query"], schema, self.options.get("mode", "select") == "graph")


class _Reader(DataSourceReader):
    CHUNK = 1 << 20

    def __init__(self, endpoint: Endpoint, query: str, schema: T.StructType, graph: bool):
        self.endpoint, self.query, self.names, self.graph = endpoint, query, schema.fieldNames(), graph

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        if self.graph:
            kind, answer = opened(self.endpoint, self.query, True)
            with answer:
                number, fragment = 0, answer.read(self.CHUNK)
                while fragment or not number:
                    yield number, str(kind), fragment
                    number, fragment = number + 1, answer.read(self.CHUNK)
        elif self.names == ["_ask"]:
            yield from (("true",) for _ in rows(self.endpoint, self.query, []))
        else:
            yield from rows(self.endpoint, self.query, self.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SparqlDataSource)


def graph_text(fragments: DataFrame, charset: str = "utf-8") -> DataFrame:
    """The fragments of a graph answer, in order, as one text."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "fragment"))), lambda x: F.hex(x["fragment"])), "")
    return fragments.agg(F.decode(F.unhex(whole), charset).alias("text"))


class EndpointSource:
    """A query at an endpoint as a source; all its columns are N-Triples text."""

    def __init__(self, uri: str, query: str, **options: str):
        if sparql_text.is_graph_query(query):
            raise WrongQueryType("a graph query has no rows; read it with mode=graph")
        self.uri, self.query, self.options = uri, query, options
        self.public_vars = tuple(sparql_text.public_vars(query))
        self.all_vars = tuple(sparql_text.all_vars(query)) or self.public_vars

    def solution(self, spark: SparkSession) -> Solution:
        register(spark)
        # hidden variables can join only if they are fetched too
        text = self.query
        hidden = tuple(v for v in self.all_vars if v not in self.public_vars)
        if hidden and not re.search(r"(?i)\b(distinct|reduced|group\s+by|limit|offset)\b", text) and self.public_vars:
            text = re.sub(r"(?is)select\s.*?(?=where\b|\{)", "SELECT * ", text, count=1)
        else:
            hidden = ()
        df = spark.read.format("sparql").options(uri=self.uri, query=text, **self.options).load()
        if not self.public_vars:
            return from_frame(df.select(), ())
        return from_frame(df, self.public_vars, hidden, nt=(*self.public_vars, *hidden))

    def __repr__(self):
        return f"{self.query} @ {self.uri}"


JOIN, LEFT_JOIN, EXISTS, NOT_EXISTS, MINUS = "join", "left_join", "exists", "not_exists", "minus"


def values_query(query: str, names: Sequence[str], batch: Sequence[Sequence[str | None]]) -> tuple[str, list[str]]:
    """``query`` restricted to a batch of bindings, selecting all that is needed to match its rows with them."""
    if sparql_text.is_graph_query(query):
        raise BadQuery("a graph query cannot be bound")
    form, start, body = sparql_text._form(query)
    pattern = query[body:].strip()
    pattern = re.sub(r"(?is)^where\s*", "", pattern) if form else (pattern if pattern.startswith("{") else "{ " + pattern + " }")
    prologue = query[: max(start, 0)]
    cells = " ".join("(" + " ".join("UNDEF" if v is None or v.startswith("_:") else v for v in row) + ")" for row in batch)
    wanted = list(dict.fromkeys([*names, *sparql_text.public_vars(query)]))
    tail = ""
    if m := re.search(r"(?s)\}([^}]*)$", pattern):
        pattern, tail = pattern[: m.start(1)], m[1]
    return f"{prologue}SELECT {' '.join('?' + v for v in wanted)} WHERE {{ VALUES ({' '.join('?' + v for v in names)}) {{ {cells} }} {pattern} }}{tail}", wanted


def _bindings(endpoint: Endpoint, query: str, names: list[str], keys: list[tuple], public: list[str]) -> list[dict]:
    """The rows of a query for a batch of bindings, each with the values it was bound to."""
    if names and endpoint.is_web_socket:
        # the server binds: rows come with the number of the binding they belong to
        talk = converse(endpoint.uri, query if public else sparql_text.to_ask(query), names, keys)
        return [dict(zip(talk.vars or [], r)) | {v: k for v, k in zip(names, keys[n]) if k is not None} for n, r in talk.rows]
    text, wanted = values_query(query, names, keys) if names else (query, sparql_text.public_vars(query))
    return [dict(zip(wanted, r)) for r in rows(endpoint, text, wanted)]


class _Operand:
    """One query of the right side, and its answers to a batch of left rows."""

    def __init__(self, uri: str, query: str, columns: Sequence[str], kind: str):
        self.endpoint, self.query = Endpoint.parse(uri), query
        self.names = [c for c in columns if c in set(sparql_text.all_vars(query))]
        self.public = [v for v in sparql_text.public_vars(query) if v not in columns] if kind in (JOIN, LEFT_JOIN) else []

    def ask(self, part: list[dict]) -> None:
        names = self.names
        keys = list(dict.fromkeys(tuple(r[v] for v in names) for r in part))
        self.found = _bindings(self.endpoint, self.query, names, keys, self.public)
        self.index: dict[tuple, list[dict]] = {}
        self.loose: list[dict] = []
        for f in self.found:
            key = tuple(f.get(v) for v in names)
            (self.index.setdefault(key, []) if None not in key else self.loose).append(f)

    def matches(self, r: dict, kind: str) -> list[dict]:
        key = tuple(r[v] for v in self.names)
        if None in key:
            match = [f for f in self.found if all(a is None or f.get(v) is None or a == f.get(v) for a, v in zip(key, self.names))]
        else:
            match = self.index.get(key, []) + [f for f in self.loose if all(f.get(v) in (None, a) for a, v in zip(key, self.names))]
        if kind == MINUS:
            match = [f for f in match if any(r[v] is not None and f.get(v) is not None for v in self.names)]
        return match


def bind_join(left: DataFrame, uri: str, query: str, kind: str = JOIN, batch_rows: int = 512, ask_collapse: bool = False) -> DataFrame:
    """``left`` (columns of N-Triples text) joined with a query, evaluated by the endpoint for batches of its rows.

    ``kind`` is one of the five kinds of binding.  ``ask_collapse`` keeps a left row once however many
    matches it has if the query selects nothing else.
    """
    return bind_union(left, [(uri, query)], kind, False, batch_rows, ask_collapse)


def bind_union(left: DataFrame, operands: Sequence[tuple[str, str]], kind: str = JOIN, merge: bool = False, batch_rows: int = 512, ask_collapse: bool = False) -> DataFrame:
    """``left`` joined with the union of several ``(uri, query)`` (``merge``: a match as often as in the operand that has it
    most often).  Every batch of left rows is read once and sent to all operands."""
    columns = left.columns
    shape = [_Operand(u, q, columns, kind) for u, q in operands]
    public = list(dict.fromkeys(v for o in shape for v in o.public))
    if kind == MINUS:
        operands = [x for x, o in zip(operands, shape) if o.names]  # one that shares no variable removes nothing
        if not operands:
            return left
    out_names = [*columns, *public]
    schema = T.StructType([*left.schema.fields, *[T.StructField(v, T.StringType()) for v in public]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [_Operand(u, q, columns, kind) for u, q in operands]
        for batch in batches:
            table = batch.to_pylist()
            for at in range(0, len(table), batch_rows):
                part, out = table[at : at + batch_rows], []
                for side in sides:
                    side.ask(part)
                for r in part:
                    plain = tuple(r[c] for c in columns)
                    each = [side.matches(r, kind) for side in sides]
                    if kind not in (JOIN, LEFT_JOIN):
                        if any(each) == (kind == EXISTS):
                            out.append(plain)
                        continue
                    made = [[tuple(r[c] if r[c] is not None else f.get(c) for c in columns) + tuple(f.get(v) for v in public) for f in match] for match in each]
                    if ask_collapse and not public:
                        made = [m[:1] for m in made]
                    if merge:
                        most: Counter = Counter()
                        for m in made:
                            most |= Counter(m)
                        made = [list(most.elements())]
                    out += [x for m in made for x in m] or ([plain + (None,) * len(public)] if kind == LEFT_JOIN else [])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], out_names)

    return left.mapInArrow(run, schema)
