"""Balanced parentheses of a stretch of a tree in preorder, with what can be asked of them.

A node opens a parenthesis and closes it after its subtree.  The excess (open less closed ones) is
kept as minima and maxima of blocks and, above them, of pairs of blocks, so the nearest place with
a given excess is found by climbing and descending that tree.  All questions are asked for many
nodes at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


class RangeMin:
    """Minima of any stretches of an array, by minima of all stretches of two to the k."""

    def __init__(self, values: np.ndarray):
        self.rows, size = [np.asarray(values)], 1
        while 2 * size <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-size], last[size:]))
            size *= 2

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Minimum of values[begin:end] for non-empty stretches."""
        begin, end = np.asarray(begin), np.asarray(end)
        out = np.empty(len(begin), self.rows[0].dtype)
        level = np.frexp((end - begin).astype(float))[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.rows[k][begin[at]], self.rows[k][end[at] - (1 << int(k))])
        return out


class Parentheses:
    """`opens` is a 0/1 array; the excess at a place counts that place's own parenthesis."""

    def __init__(self, opens: np.ndarray):
        opens = np.asarray(opens, np.int64)
        self.size = len(opens)
        self.at = np.flatnonzero(opens)  # place of each node
        self.rank = np.cumsum(opens)  # nodes up to and including each place
        pair = np.zeros(self.size, np.int64)
        pair[:-1] = (opens[:-1] == 1) & (opens[1:] == 0)
        self.leaf_rank = np.concatenate([[0], np.cumsum(pair)])  # leaf pairs that begin before each place
        self.excess = np.cumsum(np.where(opens == 1, 1, -1))
        blocks = -(-self.size // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        padded[:self.size] = self.excess
        low = padded.reshape(-1, BLOCK).min(1)
        padded[self.size:] = np.iinfo(np.int64).min
        high = padded.reshape(-1, BLOCK).max(1)
        self.levels = [(low, high)]
        while len(low) > 1:
            if len(low) % 2:
                low, high = np.append(low, np.iinfo(np.int64).max), np.append(high, np.iinfo(np.int64).min)
            low, high = low.reshape(-1, 2).min(1), high.reshape(-1, 2).max(1)
            self.levels.append((low, high))

    def _in_block(self, block: np.ndarray, after: np.ndarray, before: np.ndarray, target: np.ndarray, forward: bool) -> np.ndarray:
        """First (or last) place of a block strictly between two places with the target excess; -1 if there is none."""
        out = np.full(len(block), -1)
        for a in range(0, len(block), 16384):  # bounds the table of queries and places
            part = slice(a, a + 16384)
            place = block[part, None] * BLOCK + np.arange(BLOCK)
            fits = (place > after[part, None]) & (place < np.minimum(before[part, None], self.size))
            fits &= self.excess[np.minimum(place, self.size - 1)] == target[part, None]
            if not forward:
                fits = fits[:, ::-1]
            first = fits.argmax(1)
            there = fits[np.arange(len(first)), first]
            out[part] = np.where(there, block[part] * BLOCK + (first if forward else BLOCK - 1 - first), -1)
        return out

    def nearest(self, start: np.ndarray, target: np.ndarray, forward: bool = True) -> np.ndarray:
        """The nearest place after (or before) each start with the target excess; -1 if there is none."""
        start, target = np.asarray(start, np.int64), np.asarray(target, np.int64)
        nowhere = np.full(len(start), -1 if forward else self.size)
        block = np.maximum(start, 0) // BLOCK
        out = self._in_block(block, start if forward else nowhere - self.size - 1, np.full(len(start), self.size) if forward else start, target, forward)
        left = np.flatnonzero((out < 0) & (start >= 0))
        at, found_at = block[left], np.full(len(left), -1)
        # Up: the next neighbour that may hold the target, at the lowest level that has one.
        for level, (low, high) in enumerate(self.levels[:-1]):
            beside = at + 1 if forward else at - 1
            sibling = (at % 2 == 0) if forward else (at % 2 == 1)
            ok = sibling & (found_at < 0) & (beside < len(low))
            near = np.where(ok, beside, 0)
            ok &= (low[near] <= target[left]) & (target[left] <= high[near])
            found_at[ok] = level
            at = np.where(found_at < 0, at // 2, np.where(ok, beside, at))
        # Down: the nearer child that may hold it.
        for level in range(len(self.levels) - 1, 0, -1):
            low, high = self.levels[level - 1]
            down = found_at == level
            child = at * 2 if forward else at * 2 + 1
            near = np.where(down & (child < len(low)), child, 0)
            ok = (child < len(low)) & (low[near] <= target[left]) & (target[left] <= high[near])
            at = np.where(down, np.where(ok, child, child + (1 if forward else -1)), at)
            found_at[down] = level - 1
        hit = found_at == 0
        left, at = left[hit], at[hit]
        out[left] = self._in_block(at, np.full(len(at), -1), np.full(len(at), self.size), target[left], forward)
        return out

    def close(self) -> np.ndarray:
        """Where each node closes; -1 if that is not here."""
        return self.nearest(self.at, self.excess[self.at] - 1)

    def parent(self) -> np.ndarray:
        """Number of each node's parent; -1 if it is not here."""
        # A parent opens right after the nearest earlier place with its own parent's excess, or at the beginning.
        wanted = self.excess[self.at] - 2
        place = self.nearest(self.at, wanted, forward=False) + 1
        there = (place > 0) | (wanted == 0)
        return np.where(there & (self.excess[self.at] > 1), self.rank[place] - 1, -1)
