"""Bin patterns from a histogram of lengths: a configuration linear program, rounded.

Everything here works on counts per length, so its size depends on the capacity only, not on the
number of pieces. All lengths but the shortest (``SAND``) take part: the most frequent as they are,
the others in geometric classes, rounded up.
The configuration program (cover every class, with as few patterns as possible) is approached by
multiplicative weights; the pattern that is worth most at the current weights comes from a
knapsack dynamic program. From the patterns found, exchanges in a basis lead to the dual bound.
The solution is rounded down, its slots are filled with true lengths,
and what is left (fractions and all small lengths) goes best-fit, longest first, into the gaps.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from typing import NamedTuple

import numpy as np

# Pieces of at most one SAND-th of the capacity fill gaps only.
SAND = 32
# Lengths that are classes of their own, and geometric classes of the others.
EXACT = 96
SHARED = 96
STEP = 0.3
# Rounds of multiplicative weights from one knapsack to the next.
PRICED = 16
# Distance from the dual bound at which the program counts as solved.
GAP = 1e-4


class Group(NamedTuple):
    """``count`` sequences that all hold pieces of these lengths, in this order."""

    lengths: tuple[int, ...]
    count: int


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: copies of each size in the pattern of highest worth."""
    best = np.zeros(capacity + 1)
    steps = []
    for k, size in enumerate(sizes.tolist()):
        # One, two, four ... copies at once: together any number that fits.
        copies, n = capacity // size, 1
        while copies:
            n = min(n, copies)
            value = best[: capacity + 1 - n * size] + n * worth[k]
            better = value > best[n * size :]
            best[n * size :][better] = value[better]
            steps.append((k, n, better))
            copies, n = copies - n, 2 * n
    pattern = np.zeros(len(sizes), np.int64)
    room = capacity
    for k, n, better in reversed(steps):
        rest = room - n * sizes[k]
        if rest >= 0 and better[rest]:
            pattern[k] += n
            room = rest
    return pattern


def _dual_bound(weights: np.ndarray, demand: np.ndarray, pattern: np.ndarray) -> float:
    """Scaled by the best pattern, the weights are a feasible solution of the dual program."""
    return float(weights @ demand / (weights @ pattern))


def _multiply_weights(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The patterns of a solution within about ``STEP`` of the optimum, and the best dual bound.

    A round raises no class by more than ``rise``, and one class by that much, so the number of
    rounds grows with K log K / STEP ** 2. Between two knapsacks the best known pattern is used.
    """
    k = len(sizes)
    eta = np.log(max(2, k)) / STEP
    rise = STEP / eta
    known = np.diag(capacity // sizes)
    names = {row.tobytes() for row in known}
    covered, total, bound = np.zeros(k), 0.0, 0.0
    for turn in range(int(2 * k / rise) + 1):
        weights = np.exp(-eta * (covered - covered.min())) / demand
        if turn % PRICED == 0:
            pattern = _best_pattern(sizes, weights, capacity)
            bound = max(bound, _dual_bound(weights, demand, pattern))
            if turn and total <= (1 + STEP) * bound * covered.min():
                break
            if pattern.tobytes() not in names:
                names.add(pattern.tobytes())
                known = np.vstack([known, pattern])
        else:
            pattern = known[int((known @ weights).argmax())]
        used = pattern > 0
        step = rise * float((demand[used] / pattern[used]).min())
        covered += step * pattern / demand
        total += step
    return known, bound


def solve_covering(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[dict[tuple[int, ...], float], float]:
    """Fractional multiplicities of patterns that cover ``demand``, and a lower bound on their sum.

    Multiplicative weights find the patterns; a basis of them is then exchanged, column by column,
    until the sum is within ``GAP`` of the dual bound. The two returned values tell the gap left.
    """
    known, bound = _multiply_weights(sizes, demand, capacity)
    basis = np.diag(capacity // sizes).astype(float)
    amounts = demand / np.diag(basis)
    # The limit only guards against cycling of equal solutions.
    for _ in range(100 * len(sizes) + 1000):
        weights = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth = known @ weights
        pattern = known[int(worth.argmax())]
        if worth.max() <= 1 + GAP:
            pattern = _best_pattern(sizes, np.maximum(weights, 0), capacity)
            bound = max(bound, _dual_bound(np.maximum(weights, 0), demand, pattern))
            if amounts.sum() <= (1 + GAP) * bound or weights @ pattern <= 1 + 1e-9:
                break
            known = np.vstack([known, pattern])
        change = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.full(len(sizes), np.inf)
        np.divide(amounts, change, out=ratio, where=change > 1e-9)
        out = int(ratio.argmin())
        amounts = np.maximum(amounts - ratio[out] * change, 0)
        amounts[out] = ratio[out]
        basis[:, out] = pattern
    columns = basis.T.astype(np.int64)
    return {tuple(np.repeat(np.arange(len(sizes)), p).tolist()): x for p, x in zip(columns, amounts.tolist(), strict=True) if x > 0}, bound


class _Bins:
    """Open sequences by the room that is left in them."""

    def __init__(self):
        self.by_room: dict[int, Counter] = {}
        self.rooms: list[int] = []

    def add(self, room: int, lengths: tuple[int, ...], count: int) -> None:
        if room not in self.by_room:
            self.by_room[room] = Counter()
            bisect.insort(self.rooms, room)
        self.by_room[room][lengths] += count

    def count(self) -> int:
        return sum(sum(group.values()) for group in self.by_room.values())

    def place(self, length: int, count: int, capacity: int) -> None:
        """Best fit: the fullest sequences that still have room, one piece each, then again."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = capacity // length
                whole, rest = divmod(count, each)
                if whole:
                    self.add(capacity - each * length, (length,) * each, whole)
                if rest:
                    self.add(capacity - rest * length, (length,) * rest, 1)
                return
            room = self.rooms[at]
            group = self.by_room[room]
            lengths, have = next(iter(group.items()))
            used = min(have, count)
            if used == have:
                del group[lengths]
                if not group:
                    del self.by_room[room]
                    del self.rooms[at]
            else:
                group[lengths] -= used
            self.add(room - length, (*lengths, length), used)
            count -= used


def length_classes(left: dict[int, int], capacity: int) -> list[list[int]]:
    """Lengths above sand by class, each sorted; the longest of a class is its size.

    The lengths with the most tokens are classes of their own, the others share classes of equal
    ratio, so the number of classes does not grow with the histogram.
    """
    large = sorted(length for length in left if length * SAND > capacity)
    exact = set(sorted(large, key=lambda x: (-x * left[x], x))[:EXACT])
    shared = [length for length in large if length not in exact]
    per_log = SHARED / math.log((shared[-1] + 1) / shared[0]) if shared else 0.0
    classes: dict[tuple[str, int], list[int]] = {}
    for length in large:
        place = ("exact", length) if length in exact else ("shared", int(per_log * math.log(length / shared[0])))
        classes.setdefault(place, []).append(length)
    return sorted(classes.values(), key=lambda members: members[-1])


def _pack(left: dict[int, int], capacity: int, amounts: dict[tuple[int, ...], float], classes: list[list[int]]) -> _Bins:
    """The patterns, rounded down, and everything else best-fit, longest first."""
    bins, left = _Bins(), dict(left)
    classes = [list(members) for members in classes]
    for pattern, amount in sorted(amounts.items(), key=lambda item: -item[1]):
        _fill(bins, [classes[c] for c in pattern], left, int(amount + 1e-6), capacity)
    for length in sorted(left, reverse=True):
        if left[length]:
            bins.place(length, left[length], capacity)
    return bins


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Group], float]:
    """Groups of sequences that hold every piece of the histogram once, and a lower bound.

    The program is solved and rounded whatever the histogram. It rounds lengths up to classes, so
    best-fit alone can still need fewer sequences; then that plan is returned.
    """
    left = {length: n for length, n in histogram.items() if n and length < capacity}
    full = histogram.get(capacity, 0)
    total = sum(length * n for length, n in left.items())
    bound = float(-(-total // capacity))
    classes = length_classes(left, capacity)
    amounts: dict[tuple[int, ...], float] = {}
    if classes:
        sizes = np.array([members[-1] for members in classes], np.int64)
        demand = np.array([sum(left[x] for x in members) for members in classes], float)
        amounts, least = solve_covering(sizes, demand, capacity)
        if all(len(members) == 1 for members in classes):
            bound = max(bound, math.ceil(least * (1 - 1e-9)))
    bins = _pack(left, capacity, amounts, classes)
    if bins.count() > bound:
        bins = min(bins, _pack(left, capacity, {}, []), key=_Bins.count)
    groups = [Group(lengths, n) for counter in bins.by_room.values() for lengths, n in counter.items()]
    if full:
        groups.append(Group((capacity,), full))
    return groups, bound + full


def _fill(bins: _Bins, slots: list[list[int]], left: dict[int, int], count: int, capacity: int) -> None:
    """``count`` sequences of a pattern, filled with the longest pieces left in each class."""
    while count > 0:
        lengths: list[int] = []
        for members in slots:
            while members and not left[members[-1]] - lengths.count(members[-1]):
                if lengths.count(members[-1]):
                    break
                members.pop()
            if not members:
                return
            spare = next((x for x in reversed(members) if left[x] > lengths.count(x)), None)
            if spare is None:
                return
            lengths.append(spare)
        uses = Counter(lengths)
        n = min(count, *(left[x] // k for x, k in uses.items()))
        for x, k in uses.items():
            left[x] -= k * n
        bins.add(capacity - sum(lengths), tuple(lengths), n)
        count -= n
