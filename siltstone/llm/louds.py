"""Succinct level-order tries over numpy: the shape of a forest as one bit vector."""

from __future__ import annotations


class Louds:
    """A forest in level order. Each node in turn, after the root that is over all tops, has a 1 for each child and a 0.

    The i-th one is node i, and as many zeros stand before it as nodes, the root included, come
    before its parent is done: that gives parents and degrees without a pointer.
    """

    def __init__(self, bits):
        import numpy as np

        self.bits = bits
        self.ones, self.zeros = np.flatnonzero(bits), np.flatnonzero(~bits)

    @classmethod
    def of_parents(cls, parents) -> Louds:
        """``parents`` of nodes in level order, -1 for tops: never falling."""
        import numpy as np

        n = len(parents)
        bits = np.zeros(2 * n + 1, dtype=bool)
        bits[np.arange(n) + parents + 1] = True
        return cls(bits)

    def packed(self) -> bytes:
        import numpy as np

        return np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, packed: bytes, nodes: int) -> Louds:
        import numpy as np

        return cls(np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=2 * nodes + 1).astype(bool))

    def __len__(self) -> int:
        return len(self.ones)

    def parents(self):
        """The parent of each node, -1 for tops."""
        import numpy as np

        return self.ones - np.arange(len(self.ones)) - 1

    def degrees(self):
        import numpy as np

        return np.diff(self.zeros) - 1

    def children(self, node: int) -> range:
        """The children of a node; of -1, the tops."""
        before = 0 if node < 0 else int(self.zeros[node]) - node
        return range(before, int(self.zeros[node + 1]) - node - 1)

    def levels(self) -> list[tuple[int, int]]:
        """First node and end of each level, tops first."""
        found, start, end = [], 0, len(self.children(-1))
        while start < end:
            found.append((start, end))
            start, end = end, int(self.zeros[end]) - end
        return found


def level_order(parents):
    """Order of nodes by level, then parent, then place; parents are places, -1 for tops.

    A cycle or a parent outside is an error, as its nodes would be in no level.
    """
    import numpy as np

    by_parent = np.argsort(parents, kind="stable")
    firsts = np.searchsorted(parents[by_parent], np.arange(-1, len(parents) + 1))
    level, order = np.array([-1]), []
    while len(level):
        starts, counts = firsts[level + 1], firsts[level + 2] - firsts[level + 1]
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        level = by_parent[np.repeat(starts, counts) + nth]
        order.append(level)
    order = np.concatenate(order)
    if len(order) != len(parents):
        raise ValueError("not a forest")
    return order
