"""Components inside one task; those of whole link tables are the library's."""

from __future__ import annotations

from starloom.operators.components import components

__all__ = ["Forest", "components"]


class Forest:
    """Union-find over 0..n-1 inside one task; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
