"""Spans of a text as ``kind:start:end``, in code points with the end exclusive."""

from __future__ import annotations

import hashlib
from bisect import bisect_right

Span = tuple[str, int, int]


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """By start, then in the order of ``kinds``, then by end; comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])))


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


class Cover:
    """What spans cover, as sorted runs that don't touch, for look-ups by bisection."""

    def __init__(self, spans: list[Span]):
        self.starts, self.stops = [], []
        for a, b in sorted((s[1], s[2]) for s in spans):
            if self.stops and a < self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], b)
            else:
                self.starts.append(a)
                self.stops.append(b)

    def overlaps(self, a: int, b: int) -> bool:
        i = bisect_right(self.stops, a)
        return i < len(self.starts) and self.starts[i] < b
