"""A packed R-tree of envelopes in arrays, bulk-loaded by sort-tile-recursive order, and its probe by many envelopes at once.

Nodes of a level lie side by side, ``FANOUT`` of them under one of the next, so there are no pointers: children of node i are i * FANOUT and the following ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 16
FRONTIER = 1 << 18  # pairs of probe and node that are looked at together


class PackedTree:
    """``boxes``: (n, 4) of xmin, ymin, xmax, ymax; ``order``: where each packed leaf stands in what was given."""

    def __init__(self, boxes: np.ndarray):
        self.order = _tiled(boxes)
        self.levels = [np.ascontiguousarray(boxes[self.order])]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            starts = np.arange(0, len(below), FANOUT)
            self.levels.append(np.column_stack([np.minimum.reduceat(below[:, :2], starts), np.maximum.reduceat(below[:, 2:], starts)]))

    def probe(self, boxes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``boxes``, row of the tree's) of pairs that meet, touching included, some at a time."""
        if not len(self.order) or not len(boxes):
            return
        # what is still to be looked at, deepest first, so that it stays small
        waiting = [(len(self.levels) - 1, np.arange(len(boxes)), np.zeros(len(boxes), np.int64))]
        while waiting:
            level, who, node = waiting.pop()
            if len(who) > FRONTIER:
                half = len(who) // 2
                waiting += [(level, who[half:], node[half:]), (level, who[:half], node[:half])]
                continue
            b, t = boxes[who], self.levels[level][node]
            met = (b[:, 0] <= t[:, 2]) & (t[:, 0] <= b[:, 2]) & (b[:, 1] <= t[:, 3]) & (t[:, 1] <= b[:, 3])
            who, node = who[met], node[met]
            if not len(who):
                continue
            if level == 0:
                yield who, self.order[node]
                continue
            below = len(self.levels[level - 1])
            first = node * FANOUT
            n = np.minimum(first + FANOUT, below) - first
            ends = np.cumsum(n)
            waiting.append((level - 1, np.repeat(who, n), np.arange(ends[-1]) - np.repeat(ends - n - first, n)))


def _tiled(boxes: np.ndarray) -> np.ndarray:
    """Sort-tile-recursive order: slices by the middle in x, each by the middle in y."""
    n = len(boxes)
    with np.errstate(invalid="ignore", over="ignore"):
        middle = np.nan_to_num(boxes[:, :2] / 2 + boxes[:, 2:] / 2)
    slices = max(1, int(np.ceil(np.sqrt(np.ceil(n / FANOUT)))))
    per = -(-n // slices) if n else 1
    place = np.empty(n, np.int64)
    place[np.argsort(middle[:, 0], kind="stable")] = np.arange(n)
    return np.lexsort((middle[:, 1], place // max(per, 1)))
