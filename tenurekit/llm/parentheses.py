"""Ordered trees as balanced parentheses, with a range min-max structure over blocks of excess."""

from __future__ import annotations

import numpy as np

#: Parentheses in a block.
BLOCK = 64


class Parentheses:
    """steps: 1 for each opening and -1 for each closing parenthesis of one tree, in order."""

    def __init__(self, steps: np.ndarray) -> None:
        self.opens = steps > 0
        self.excess = np.cumsum(steps, dtype=np.int64)
        self.rank = np.concatenate(([0], np.cumsum(self.opens)))
        leaf = self.opens & np.concatenate((~self.opens[1:], [False]))
        self.leaf_rank = np.concatenate(([0], np.cumsum(leaf)))
        n_blocks = -(-len(steps) // BLOCK)
        self.blocks = np.concatenate((self.excess, np.full(n_blocks * BLOCK - len(steps), np.iinfo(np.int64).max))).reshape(n_blocks, BLOCK)
        self.least = [self.blocks.min(axis=1)]  # of each block, then of pairs of what lies below
        while len(self.least[-1]) > 1:
            below = self.least[-1]
            even = np.concatenate((below, np.full(len(below) % 2, np.iinfo(np.int64).max)))
            self.least.append(even.reshape(-1, 2).min(axis=1))

    def _first_below(self, block: np.ndarray, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Place in each block, from start on, where the excess is first at most target; -1 if nowhere."""
        found = np.full(len(block), -1)
        open_ = np.arange(len(block))
        for step in range(BLOCK):
            at = start[open_] + step
            inside = at < BLOCK
            open_, at = open_[inside], at[inside]
            if not len(open_):
                break
            hit = self.blocks[block[open_], at] <= target[open_]
            found[open_[hit]] = block[open_[hit]] * BLOCK + at[hit]
            open_ = open_[~hit]
        return found

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the next place with an excess one lower than at the opening."""
        target = self.excess[at] - 1
        out = self._first_below(at // BLOCK, at % BLOCK + 1, target)
        left = np.flatnonzero(out < 0)
        if not len(left):
            return out
        node, want = at[left] // BLOCK, target[left]
        # up, until a later sibling holds an excess as low; then down to the first block that does
        level, climbing = np.zeros(len(left), np.int64), np.ones(len(left), bool)
        for depth, least in enumerate(self.least):
            sibling = node + 1
            right = climbing & (node % 2 == 0) & (sibling < len(least))
            right[right] = least[sibling[right]] <= want[right]
            node[right], level[right] = sibling[right], depth
            climbing &= ~right
            node[climbing] //= 2
        for depth in range(len(self.least) - 1, 0, -1):
            here = level >= depth
            node[here] *= 2
            later = here.copy()
            later[here] = self.least[depth - 1][node[here]] > want[here]
            node[later] += 1
        out[left] = self._first_below(node, np.zeros(len(left), np.int64), want)
        return out


def range_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo:hi] for each pair of bounds (none empty), by tables of powers of two."""
    length = np.maximum(hi - lo, 1)
    power = np.frexp(length)[1] - 1
    out, table = np.empty(len(lo), values.dtype), values
    for p in range(int(power.max(initial=0)) + 1):
        here = power == p
        out[here] = np.minimum(table[lo[here]], table[hi[here] - (1 << p)])
        table = np.minimum(table[: -(1 << p)], table[1 << p :])
    return out
