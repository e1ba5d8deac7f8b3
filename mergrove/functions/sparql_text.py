"""Lexical work on query texts: which variables they have, and substituting terms for them.

Nothing here parses SPARQL in full; a scanner tells variables from strings, IRIs and comments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from ..errors import BadQuery

_PIECE = re.compile(
    r"""(?P<quoted>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      |(?P<iri><[^<>"{}|^`\\\s]*>)
      |(?P<comment>\#[^\n]*)
      |(?P<var>[?$](?P<name>\w+))
      |(?P<brace>[{}()])
      |(?P<word>[A-Za-z_][\w:-]*)
      |(?P<other>.)""",
    re.X | re.S,
)


def _pieces(text: str) -> Iterator[re.Match]:
    return _PIECE.finditer(text)


def _form(text: str) -> tuple[str, int, int]:
    """The query form (``""`` for a fragment), where its keyword starts, and where its body starts."""
    form, start = "", -1
    for m in _pieces(text):
        if m["word"] and m["word"].upper() in ("SELECT", "ASK", "CONSTRUCT", "DESCRIBE") and not form:
            form, start = m["word"].upper(), m.start()
        elif form and m["word"] and m["word"].upper() == "WHERE":
            return form, start, m.start()
        elif m["brace"] == "{":
            return form, start, m.start()
    return form, start, len(text)


def is_graph_query(text: str) -> bool:
    return _form(text)[0] in ("CONSTRUCT", "DESCRIBE")


def all_vars(text: str) -> list[str]:
    """Every variable outside strings, IRIs and comments, in order of appearance."""
    return list(dict.fromkeys(m["name"] for m in _pieces(text) if m["var"]))


def _projection(text: str, start: int, body: int) -> list[tuple[str, int, int]]:
    """Projected variables with the span of the text that projects each, ``(expr AS ?v)`` included."""
    out, depth, opened, last = [], 0, 0, None
    for m in _pieces(text[start:body]):
        if m["brace"] in ("(", "{"):
            opened = m.start() if not depth else opened
            depth += 1
        elif m["brace"]:
            depth -= 1
            if not depth and last:
                out.append((last, start + opened, start + m.end()))
                last = None
        elif m["var"]:
            if depth:
                last = m["name"]
            else:
                out.append((m["name"], start + m.start(), start + m.end()))
    return out


def public_vars(text: str) -> list[str]:
    """The variables of the results: the projection in its order, none for ASK, all for ``*`` and fragments."""
    form, start, body = _form(text)
    if form == "ASK":
        return []
    if form != "SELECT" or re.search(r"SELECT\s+(?:DISTINCT\s+|REDUCED\s+)?\*", text[start:body], re.I):
        return all_vars(text)
    return list(dict.fromkeys(v for v, _, _ in _projection(text, start, body)))


def _pattern(tail: str) -> str:
    return re.sub(r"(?i)^where\s*", "", tail)


def bind(text: str, binding: Mapping[str, str | None]) -> str:
    """Replace bound variables by their terms; in a projection they go, and SELECT of bound variables only becomes ASK.

    A variable bound to ``None`` stays.
    """
    terms = {k: v for k, v in binding.items() if v is not None}
    form, start, body = _form(text)
    head, tail = text[:body], text[body:]
    if form == "SELECT":
        spans = _projection(text, start, body)
        if spans and all(v in terms for v, _, _ in spans):
            head, tail = text[:start] + "ASK ", _pattern(tail)
        else:
            for v, s, e in reversed(spans):
                if v in terms:
                    head = head[:s] + head[e:].lstrip(" ")
    elif not form:
        head, tail = "", text
    return head + "".join(terms.get(m["name"], m[0]) if m["var"] else m[0] for m in _pieces(tail))


def to_ask(text: str) -> str:
    """A query that only tells whether ``text`` has a solution."""
    form, start, body = _form(text)
    if form == "ASK":
        return text
    if form == "SELECT":
        return text[:start] + "ASK " + _pattern(text[body:])
    if form:
        raise BadQuery(f"{form} has no solutions to ask for")
    return "ASK " + (text if text.lstrip().startswith("{") else "{ " + text + " }")


def merge_vars(*lists: list[str] | tuple[str, ...]) -> list[str]:
    """Order-preserving union."""
    return list(dict.fromkeys(v for names in lists for v in names))


def common_vars(a, b) -> list[str]:
    """The variables of ``a`` that ``b`` has too, in the order of ``a``."""
    there = set(b)
    return [v for v in dict.fromkeys(a) if v in there]


def is_product(a_public, b_all) -> bool:
    return not common_vars(a_public, b_all)
