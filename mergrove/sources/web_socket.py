"""The line protocol of WebSocket endpoints: TSV rows among control lines that begin with ``!``.

``Conversation`` is the client's side of it without the socket: feed it what arrives, send what it returns.
``converse`` holds one over a connection.
"""

from __future__ import annotations

import base64
import hashlib
import os
import socket
import ssl
import struct
import urllib.parse
from collections import deque
from collections.abc import Iterator, Sequence

from ..errors import MalformedResults, ServerError
from .results_text import tsv_term


class Conversation:
    """One query, bound or not.

    ``bindings`` (rows of N-Triples text under ``names``) are sent when the server asks for them; ``row_for`` gives the left row to
    which the rows then received belong, by its number.
    """

    def __init__(self, query: str, names: Sequence[str] = (), bindings: Sequence[Sequence[str | None]] = ()):
        self.query, self.names, self.bindings = query, list(names), list(bindings)
        self.vars: list[str] | None = None
        self.rows: list[tuple[int | None, tuple]] = []
        self.active: int | None = None
        self.sent, self.capacity, self.ended, self.cancelled = 0, 1, False, False
        self._queue: deque[int] = deque()
        self._rest = ""

    def start(self) -> list[str]:
        """What to send first."""
        verb = "!bind" if self.names else "!query"
        lines = [f"{verb} {self.query}\n"]
        if self.names:
            lines.append("\t".join("?" + n for n in self.names) + "\n")
        return lines

    def cancel(self) -> list[str]:
        return [] if self.ended else ["!cancel\n"]

    def _bindings(self, n: int) -> list[str]:
        out = []
        for row in self.bindings[self.sent : self.sent + n]:
            out.append("\t".join("" if x is None else x for x in row) + "\n")
            self._queue.append(self.sent)
            self.sent += 1
        if self.sent == len(self.bindings):
            out.append("!end\n")
        return out

    def feed(self, text: str) -> list[str]:
        """Take in a piece of text, cut anywhere; returns what to send in answer."""
        *lines, self._rest = (self._rest + text).split("\n")
        out: list[str] = []
        for line in lines:
            if self.ended:
                if line.strip():
                    raise MalformedResults(f"{line!r} after the end")
            elif line.startswith("!"):
                out += self._control(line[1:].strip())
            else:
                self._row(line.rstrip("\r"))
        return out

    def _control(self, line: str) -> list[str]:
        verb, _, rest = line.partition(" ")
        if verb == "end":
            self.ended = True
        elif verb == "error":
            self.ended = True
            raise ServerError(0, rest or "the server gave no reason")
        elif verb == "cancelled":
            self.ended = self.cancelled = True
        elif verb == "ping":
            return ["!ping-ack\n"]
        elif verb == "action-queue-cap":
            self.capacity = int(rest.lstrip("="))
        elif verb.startswith("action-queue-cap="):
            self.capacity = int(verb.partition("=")[2])
        elif verb == "bind-request":
            return self._bindings(int(rest.lstrip("+")))
        elif verb == "active-binding":
            # the server repeats the binding: it is the oldest of those sent that agrees
            want = rest.split("\t")
            while self._queue:
                self.active = self._queue.popleft()
                own = ["" if x is None else x for x in self.bindings[self.active]]
                if own == want or not rest:
                    break
            else:
                raise MalformedResults(f"no such binding: {rest!r}")
        elif verb != "ping-ack":
            raise MalformedResults(f"unknown control line !{line}")
        return []

    def _row(self, line: str) -> None:
        cells = line.split("\t")
        if self.vars is None:
            self.vars = [] if cells == [""] else [c.strip().lstrip("?$") for c in cells]
        elif not self.vars:
            if line.strip():
                raise MalformedResults(f"columns in an ASK answer: {line!r}")
            self.rows.append((self.active, ()))
        elif len(cells) != len(self.vars):
            raise MalformedResults(f"{len(cells)} columns instead of {len(self.vars)}")
        else:
            self.rows.append((self.active, tuple(map(tsv_term, cells))))


class Socket:
    """A minimal WebSocket client: text messages, pings answered, one close."""

    _MAGIC = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"

    def __init__(self, uri: str, timeout: float = 600.0):
        u = urllib.parse.urlparse(uri)
        secure = u.scheme == "wss"
        self.sock = socket.create_connection((u.hostname, u.port or (443 if secure else 80)), timeout)
        if secure:
            self.sock = ssl.create_default_context().wrap_socket(self.sock, server_hostname=u.hostname)
        key = base64.b64encode(os.urandom(16)).decode()
        path = (u.path or "/") + (f"?{u.query}" if u.query else "")
        self.sock.sendall(
            f"GET {path} HTTP/1.1\r\nHost: {u.netloc}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode()
        )
        self.file = self.sock.makefile("rb")
        status = self.file.readline().decode("latin-1").split(None, 2)
        headers = {}
        while (line := self.file.readline().decode("latin-1").strip()):
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        want = base64.b64encode(hashlib.sha1((key + self._MAGIC).encode()).digest()).decode()
        if len(status) < 2 or status[1] != "101" or headers.get("sec-websocket-accept") != want:
            self.sock.close()
            raise ServerError(int(status[1]) if len(status) > 1 and status[1].isdigit() else 0, "no WebSocket handshake")

    def _send(self, code: int, body: bytes) -> None:
        mask = os.urandom(4)
        size = bytes([128 | len(body)]) if len(body) < 126 else struct.pack(">BH", 254, len(body)) if len(body) < 1 << 16 else struct.pack(">BQ", 255, len(body))
        pad = (mask * (len(body) // 4 + 1))[: len(body)]
        self.sock.sendall(bytes([128 | code]) + size + mask + bytes(a ^ b for a, b in zip(body, pad)))

    def send(self, text: str) -> None:
        self._send(1, text.encode())

    def _exactly(self, n: int) -> bytes:
        data = self.file.read(n)
        if len(data) < n:
            raise ServerError(0, "the server closed the connection")
        return data

    def messages(self) -> Iterator[str]:
        """Text as it arrives, until either side closes."""
        parts: list[bytes] = []
        while True:
            first, second = self._exactly(2)
            size = second & 127
            size = struct.unpack(">H", self._exactly(2))[0] if size == 126 else struct.unpack(">Q", self._exactly(8))[0] if size == 127 else size
            body = self._exactly(size)
            code = first & 15
            if code == 8:
                return
            if code == 9:
                self._send(10, body)
            elif code in (0, 1, 2):
                parts.append(body)
                if first & 128:
                    yield b"".join(parts).decode("utf-8", "replace")
                    parts = []

    def close(self) -> None:
        try:
            self._send(8, struct.pack(">H", 1000))
        except OSError:
            pass
        self.sock.close()


def converse(uri: str, query: str, names: Sequence[str] = (), bindings: Sequence[Sequence[str | None]] = ()) -> Conversation:
    """Hold a whole conversation with an endpoint; the result has its variables and rows."""
    talk, link = Conversation(query, names, bindings), Socket(uri)
    try:
        for line in talk.start():
            link.send(line)
        for text in link.messages():
            for line in talk.feed(text):
                link.send(line)
            if talk.ended:
                return talk
        raise ServerError(0, "the server closed the connection before the end")
    finally:
        link.close()
