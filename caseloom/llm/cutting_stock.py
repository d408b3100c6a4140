"""The cutting-stock plan behind packing: which lengths share a sequence, and how often.

Works on a histogram of length classes, whose number is fixed, whatever the size of the corpus.  Lengths
are rounded up to whole units (a class); a pattern is a multiset of classes that fits one sequence.  The
linear program over patterns asks for the fewest sequences that hold every class's pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Pattern = dict[int, int]


def price(sizes: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the best value of each exact fill, and the last size put in."""
    best, last = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    best[0] = 0.0
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = upto[c]
        if k:
            value = best[c - sizes[:k]] + duals[:k]
            i = int(value.argmax())
            best[c], last[c] = value[i], i
    return best, last


def _pattern(fill: int, sizes: np.ndarray, last: np.ndarray) -> np.ndarray:
    column = np.zeros(len(sizes))
    while fill:
        i = last[fill]
        column[i] += 1
        fill -= sizes[i]
    return column


def relaxed(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-4, pivots: int = 20_000):
    """The linear program by column generation: (columns of the basis, uses of each).

    Revised simplex with an explicit inverse; every class must be covered, more is allowed.  Each
    knapsack solution offers its best patterns, and pivots run over these before the next pricing.
    Ends when the bound from the duals (their value divided by the best pattern's) is within ``gap``
    of the sequences used; an earlier end leaves a feasible plan.
    """
    m = len(sizes)
    fits = capacity // sizes
    basis, inverse = np.diag(fits.astype(float)), np.diag(1.0 / fits)
    x, duals = demand / fits, 1.0 / fits
    cost, surplus = np.ones(m), -np.eye(m)
    done = 0
    while done < pivots:
        best, last = price(sizes, duals, capacity)
        top = float(best[np.isfinite(best)].max())
        if top <= 1 + gap:
            break
        fills = [c for c in np.argsort(-best)[:40].tolist() if c and np.isfinite(best[c]) and best[c] > 1]
        pool = np.vstack([np.array([_pattern(f, sizes, last) for f in fills]), surplus])
        costs = np.append(np.ones(len(fills)), np.zeros(m))
        before = done
        while done < pivots:
            reduced = costs - pool @ duals
            j = int(reduced.argmin())
            if reduced[j] > -1e-9:
                break
            step = inverse @ pool[j]
            allowed = step > 1e-9
            if not allowed.any():
                break
            limit = np.where(allowed, x / np.where(allowed, step, 1.0), np.inf)
            r = int(limit.argmin())
            move, row = limit[r], inverse[r] / step[r]
            x = np.maximum(x - move * step, 0.0)
            x[r] = move
            step[r] -= 1.0
            inverse -= np.outer(step, row)
            basis[:, r], cost[r] = pool[j], costs[j]
            duals = cost @ inverse
            done += 1
        if done == before:
            break
    x = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0.0)
    return basis[:, cost > 0], x[cost > 0]


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, for the few pieces that rounding leaves."""
    room: dict[int, list[Pattern]] = {}
    for size in sorted(left, reverse=True):
        count = left[size]
        while count:
            space = min((s for s in room if s >= size), default=None)
            pattern: Pattern = {} if space is None else room[space].pop()
            if space is not None and not room[space]:
                del room[space]
            space = capacity if space is None else space
            n = min(count, space // size)
            pattern[size] = pattern.get(size, 0) + n
            room.setdefault(space - n * size, []).append(pattern)
            count -= n
    return [(pattern, 1) for patterns in room.values() for pattern in patterns]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of classes and how often each is used; together they hold exactly ``histogram``."""
    out: list[tuple[Pattern, int]] = []
    if histogram.get(capacity):
        out.append(({capacity: 1}, histogram[capacity]))
    sizes = np.array(sorted(s for s, n in histogram.items() if n and s < capacity), int)
    if not len(sizes):
        return out
    demand = np.array([histogram[s] for s in sizes.tolist()])
    basis, x = relaxed(sizes, demand, capacity)
    columns, whole, left = basis.round().astype(int), np.floor(x + 1e-7).astype(int), demand.copy()
    uses = np.zeros(len(x), int)
    for j in np.argsort(-whole).tolist():  # the floors, never more than there are pieces
        a = columns[:, j]
        n = min([int(whole[j]), *(left[a > 0] // a[a > 0]).tolist()])
        uses[j], left = n, left - n * a
    rest = _best_fit(_counts(sizes, left), capacity)
    more, after = uses.copy(), left.copy()
    for j in np.argsort(-(x - np.floor(x))).tolist():  # or first one more of each pattern that still fits
        a = columns[:, j]
        if (a <= after).all():
            more[j], after = more[j] + 1, after - a
    fewer = _best_fit(_counts(sizes, after), capacity)
    if more.sum() + len(fewer) < uses.sum() + len(rest):
        uses, rest = more, fewer
    for j in np.flatnonzero(uses):
        a = columns[:, j]
        out.append(({int(sizes[i]): int(a[i]) for i in np.flatnonzero(a)}, int(uses[j])))
    return out + rest


def _counts(sizes: np.ndarray, left: np.ndarray) -> dict[int, int]:
    return {int(s): int(n) for s, n in zip(sizes, left) if n}


@dataclass
class Slots:
    """Where the pieces of one class go, by their rank: runs of slots of one pattern each."""

    first: np.ndarray  # rank of the run's first slot
    sequence: np.ndarray  # sequence of that slot
    copies: np.ndarray  # slots of this class in a sequence of the pattern
    slot: np.ndarray  # number of the first of them in its sequence


def slots(patterns: list[tuple[Pattern, int]]) -> dict[int, Slots]:
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    placed: dict[int, int] = {}
    sequence = 0
    for pattern, uses in patterns:
        slot = 0
        for size in sorted(pattern, reverse=True):
            copies = pattern[size]
            runs.setdefault(size, []).append((placed.get(size, 0), sequence, copies, slot))
            placed[size] = placed.get(size, 0) + copies * uses
            slot += copies
        sequence += uses
    return {size: Slots(*map(np.array, zip(*rows))) for size, rows in runs.items()}


def place(size: np.ndarray, rank: np.ndarray, table: dict[int, Slots]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, slot in it) of pieces by class and rank among the pieces of that class."""
    sequence, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    for one in np.unique(size).tolist():
        rows = np.flatnonzero(size == one)
        s, r = table[one], rank[rows]
        run = np.searchsorted(s.first, r, "right") - 1
        inside = r - s.first[run]
        sequence[rows] = s.sequence[run] + inside // s.copies[run]
        slot[rows] = s.slot[run] + inside % s.copies[run]
    return sequence, slot
