"""How to talk to an endpoint: methods, formats, parameters and headers, and media types."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from urllib.parse import quote

from ..errors import IllegalArgument, UnacceptableConfiguration

METHODS = ("get", "post", "form", "ws")
#: Media types of the result formats and of the graph formats.
RESULTS = {"json": "application/sparql-results+json", "tsv": "text/tab-separated-values", "csv": "text/csv", "xml": "application/sparql-results+xml"}
GRAPHS = {"ttl": "text/turtle", "nt": "application/n-triples", "trig": "application/trig", "jsonld": "application/ld+json", "rdfxml": "application/rdf+xml"}
#: Longer queries are not sent by GET.
MAX_GET = 1024


@dataclass(frozen=True)
class MediaType:
    """``type/subtype;name=value``; ``*`` matches anything."""

    type: str
    subtype: str
    params: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def parse(text: str) -> MediaType:
        m = re.fullmatch(r"\s*([\w.+*-]+)/([\w.+*-]+)\s*((?:;.*)?)", text, re.S)
        if not m:
            raise IllegalArgument(f"no media type: {text!r}")
        pairs = (p.partition("=") for p in m[3].split(";") if p.strip())
        return MediaType(m[1].lower(), m[2].lower(), tuple((k.strip().lower(), v.strip().strip('"')) for k, _, v in pairs))

    def accepts(self, other: MediaType) -> bool:
        """Whether ``other`` is within this type: parameters named here must agree."""
        there = dict(other.params)
        return self.type in ("*", other.type) and self.subtype in ("*", other.subtype) and all(there.get(k, "").lower() == v.lower() for k, v in self.params if k != "q")

    @property
    def charset(self) -> str:
        return dict(self.params).get("charset", "utf-8")

    def __str__(self):
        return f"{self.type}/{self.subtype}" + "".join(f";{k}={v}" for k, v in self.params)


def _ordered(own: tuple, asked: tuple, what: str) -> tuple:
    """What both have, in the order asked; either may be empty, which is anything."""
    if not own or not asked:
        return asked or own
    both = tuple(x for x in asked if x in own)
    if not both:
        raise UnacceptableConfiguration(f"{what} {asked} asked, {own} offered")
    return both


@dataclass(frozen=True)
class Configuration:
    """Accepted methods, result formats and graph formats by preference, and what goes with each request."""

    methods: tuple[str, ...] = ()
    results: tuple[str, ...] = ()
    graphs: tuple[str, ...] = ()
    params: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    headers: Mapping[str, str] = field(default_factory=dict)
    append_headers: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        for names, known in ((self.methods, METHODS), (self.results, RESULTS), (self.graphs, GRAPHS)):
            if unknown := [n for n in names if n not in known]:
                raise IllegalArgument(f"unknown {unknown}; there are {sorted(known)}")

    def overlay(self, asked: Configuration) -> Configuration:
        """This endpoint's configuration under a request's: what both accept, parameters and headers of both."""
        params = {k: (*self.params.get(k, ()), *asked.params.get(k, ())) for k in (*self.params, *asked.params)}
        lower = {k.lower(): v for k, v in self.headers.items()} | {k.lower(): v for k, v in asked.headers.items()}
        more = {k: (*self.append_headers.get(k, ()), *asked.append_headers.get(k, ())) for k in (*self.append_headers, *asked.append_headers)}
        return Configuration(
            _ordered(self.methods, asked.methods, "methods"), _ordered(self.results, asked.results, "results"),
            _ordered(self.graphs, asked.graphs, "graphs"), params, lower, more)

    def accepts(self, asked: Configuration) -> bool:
        try:
            self.overlay(asked)
        except UnacceptableConfiguration:
            return False
        return True

    def supported(self, results: tuple[str, ...] = ("json", "tsv", "csv"), methods: tuple[str, ...] = ("get", "post", "form")) -> Configuration:
        """Without formats and methods that this library cannot do; an error if none is left."""
        keep = lambda mine, able, what: tuple(x for x in mine or able if x in able) or _none(what, mine)
        return replace(self, results=keep(self.results, results, "results"), methods=keep(self.methods, methods, "methods"))

    def method_for(self, query: str) -> str:
        """The preferred method; a long query is not sent by GET if there is another way."""
        methods = self.methods or ("get", "post", "form")
        if methods[0] == "get" and len(query) > MAX_GET:
            return next((m for m in methods if m != "get"), "post")
        return methods[0]

    def accept_header(self, graph: bool = False) -> str:
        """Media types with falling q-values."""
        names, table = (self.graphs or tuple(GRAPHS), GRAPHS) if graph else (self.results or ("json", "tsv", "csv"), RESULTS)
        return ", ".join(table[n] + (f"; q={max(1, 10 - i) / 10:g}" if i else "") for i, n in enumerate(names))


def _none(what: str, mine: tuple) -> tuple:
    raise UnacceptableConfiguration(f"none of the {what} {mine} is supported")


@dataclass(frozen=True)
class Endpoint:
    """An address with its configuration, written ``json,tsv,post@http://host/path``."""

    uri: str
    config: Configuration = Configuration()

    @staticmethod
    def parse(text: str) -> Endpoint:
        m = re.fullmatch(r"(?:([\w,+/-]+)@)?((?:https?|wss?)://\S+)", text.strip())
        if not m:
            raise IllegalArgument(f"no endpoint address: {text!r}")
        words = [w.strip().lower() for w in (m[1] or "").split(",") if w.strip()]
        unknown = [w for w in words if w not in METHODS and w not in RESULTS and w not in GRAPHS]
        if unknown:
            raise IllegalArgument(f"unknown keywords {unknown} in {text!r}")
        methods = tuple(w for w in words if w in METHODS)
        if m[2].startswith("ws"):
            if any(x != "ws" for x in methods):
                raise IllegalArgument(f"{m[2]} takes WebSocket only")
            methods = ("ws",)
        return Endpoint(m[2], Configuration(methods, tuple(w for w in words if w in RESULTS), tuple(w for w in words if w in GRAPHS)))

    @property
    def is_web_socket(self) -> bool:
        return self.uri.startswith("ws")


def escape_query_param(text: str) -> str:
    """Percent-encode what cannot stand in a query parameter."""
    return quote(text, safe="!'()*-._~/:@?,;$")
