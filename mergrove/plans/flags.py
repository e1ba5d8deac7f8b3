"""Operator flags and the registry of strategies that bid for an operator."""

from __future__ import annotations

import enum
from collections.abc import Callable
from dataclasses import dataclass

from ..errors import NoStrategy


class OperatorFlags(enum.IntFlag):
    """What a caller knows or allows.

    ``SMALL_*`` becomes a broadcast hint; ``ALLOW_DUPLICATES`` lets Distinct forget old rows; ``ASYNC`` and
    ``SPILLOVER`` ask for what Spark does anyway.  The other ``ALLOW_*`` are accepted and change nothing.
    """

    NONE = 0
    SMALL_FIRST = 1
    LARGE_FIRST = 2
    SMALL_SECOND = 4
    LARGE_SECOND = 8
    ALL_SMALL = 5
    ALL_LARGE = 10
    SPILLOVER = 16
    ASYNC = 32
    ALLOW_DEDUPLICATE = 64
    ALLOW_INCOMPLETE = 128
    ALLOW_DUPLICATES = 256
    ALLOW_UNSOUND = 512
    #: Bits from here on are the user's.
    USER = 1 << 32


#: Units of the bids.
BUILTIN, MINOR, SLOW, OUT_OF_MEMORY, UNSUPPORTED = 1024, 128, 1024, 32 * 1024, (1 << 31) - 1


@dataclass(frozen=True)
class Strategy:
    """``bid(flags)`` says how dear it would be; ``lower(solutions, plan)`` makes the operator's DataFrame."""

    name: str
    bid: Callable[[OperatorFlags], int]
    lower: Callable


_REGISTRY: dict[str, list[Strategy]] = {}


def register_strategy(operator: str, strategy: Strategy) -> None:
    _REGISTRY.setdefault(operator, []).append(strategy)


def unregister_strategy(operator: str, name: str) -> None:
    _REGISTRY[operator] = [s for s in _REGISTRY.get(operator, []) if s.name != name]


def choose(operator: str, flags: OperatorFlags, default: Strategy | None = None) -> Strategy:
    """The lowest bid below ``UNSUPPORTED``; the first registered of equals."""
    bids = [(s.bid(flags), i, s) for i, s in enumerate([*([default] if default else []), *_REGISTRY.get(operator, [])])]
    best = min((b for b in bids if b[0] < UNSUPPORTED), key=lambda b: b[:2], default=None)
    if best is None:
        raise NoStrategy(f"no strategy for {operator} under {flags!r}")
    return best[2]
