"""Spans of a text that do not overlap."""

from __future__ import annotations

import bisect


class Spans:
    """Kept (start, end) spans, none of which overlap; questions and additions take logarithmic time (and a short move)."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.starts, a)
        return (not i or self.ends[i - 1] <= a) and (i == len(self.starts) or self.starts[i] >= b)

    def add(self, a: int, b: int) -> bool:
        """Keeps the span if it overlaps none; whether it did."""
        if not self.free(a, b):
            return False
        i = bisect.bisect_right(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


def settled(found: list[tuple[int, int, str]], order) -> list[tuple[int, int, str]]:
    """Finds in order of position, of overlapping ones the first by ``order``."""
    spans = Spans()
    return sorted([f for f in sorted(set(found), key=order) if spans.add(f[0], f[1])])
