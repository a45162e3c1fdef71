"""Cutting stock by column generation: how many sequences to fill by which lengths. Sizes depend on the capacity, never on the number of documents.

A column of the linear program is a pattern, lengths that fill one sequence, at the price of the sequence with its padding; or a
cut, one document that is laid in the stream, at its own tokens and CUT more. Each length has to be placed as often as there are
documents of it. The knapsack program prices columns against the duals until none is left that would lower the price.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Cutting a document costs as much as so many tokens of padding.
CUT = 10
#: A column enters if its reduced cost is above this.
TOLERANCE = 1e-7
#: Demands are raised by shares below this, each by another one, so that no two columns leave the basis at once.
SPREAD = 1e-6
#: Columns that a pricing adds at most, and columns kept for each length; those that would be dearest go, and are priced again if need be.
AT_ONCE, KEPT = 96, 6


@dataclass
class Plan:
    """Ranks of each length to places. slots[length]: arrays of first rank, copies in a sequence, first sequence, offset; ranks from used[length] on lie in the stream, from base[length] on."""

    capacity: int
    sequences: int = 0
    slots: dict[int, tuple[np.ndarray, ...]] = field(default_factory=dict)
    used: dict[int, int] = field(default_factory=dict)
    base: dict[int, int] = field(default_factory=dict)
    stream: int = 0

    def first_full(self) -> int:
        return self.sequences + -(-self.stream // self.capacity)


def cost(fill: int, capacity: int) -> int:
    """A sequence is padded to the capacity, except at a power of two."""
    return fill if fill & (fill - 1) == 0 else capacity


def _knapsack(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the most value that fills c exactly; last[c]: an item in it."""
    best, last = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    best[0] = 0
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = upto[c]
        if k:
            total = best[c - sizes[:k]] + value[:k]
            last[c] = j = int(total.argmax())
            best[c] = total[j]
    return best, last


def _pattern(last: np.ndarray, sizes: np.ndarray, fill: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while fill:
        j = int(last[fill])
        out[j] = out.get(j, 0) + 1
        fill -= int(sizes[j])
    return out


def _fill(need: int, left: np.ndarray, sizes: np.ndarray) -> list[int]:
    """Sizes that are left (left[size] > 0) and add up to need, or else to as much of it as can be; a size may be there more often than is left."""
    there = left > 0
    if there[need]:
        return [need]
    pair = np.minimum(left[1:need], left[need - 1 : 0 : -1]) * (there[1:need] & there[need - 1 : 0 : -1])
    if need % 2 == 0:
        pair[need // 2 - 1] /= 2
    if len(pair) and pair.max() > 0:
        a = int(pair.argmax()) + 1
        return [a, need - a]
    at = sizes[there[sizes] & (sizes <= need)]
    if not len(at):
        return []
    best, last = _knapsack(at.astype(float), at, need)
    fill = int(np.flatnonzero(best > -np.inf).max())
    return [int(at[j]) for j, k in _pattern(last, at, fill).items() for _ in range(k)]


def greedy(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """Patterns to begin with, each used until one of its lengths is used up."""
    left = np.zeros(capacity + 1)
    left[lengths] = demand
    place = {int(s): j for j, s in enumerate(lengths)}
    out = []
    for top in lengths[::-1].tolist():
        while left[top] > 0:
            pattern: dict[int, int] = {}
            for s in [top, *(_fill(capacity - top, left, lengths) if capacity > top else [])]:
                pattern[place[s]] = pattern.get(place[s], 0) + 1
            at, copies = lengths[list(pattern)], np.array(list(pattern.values()), float)
            left[at] -= (left[at] / copies).min() * copies
            left[at[left[at] < 1e-9]] = 0
            out.append(pattern)
    return out


def _subset(sizes: list[int], left: dict[int, int], capacity: int) -> dict[int, int]:
    """Sizes, no more of each than are left, that come as near to the capacity as any choice does. A set of sums is the bits of a number."""
    within = (1 << capacity + 1) - 1
    parts, sums = [], [1]
    for s in sizes:
        n, k = min(left[s], capacity // s), 1
        while n > 0:
            k = min(k, n)
            parts.append((s, k))
            sums.append(sums[-1] | sums[-1] << s * k & within)
            n, k = n - k, 2 * k
        if sums[-1] >> capacity & 1:
            break
    at, out = sums[-1].bit_length() - 1, {}
    for (s, k), before in zip(reversed(parts), reversed(sums[:-1]), strict=True):
        if not before >> at & 1:
            out[s] = out.get(s, 0) + k
            at -= s * k
    return out


def rest(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """Patterns, each used once, for what rounding leaves: the largest document that is left, and those that fill its sequence best. Where cutting is cheaper it is cut."""
    left = {int(s): int(n) for s, n in zip(lengths, demand, strict=True) if n > 0}
    place = {int(s): j for j, s in enumerate(lengths)}
    order, out = sorted(left, reverse=True), []
    while order:
        top = order[0]
        left[top] -= 1
        pattern = _subset([s for s in order if left[s]], left, capacity - top)
        pattern[top] = pattern.get(top, 0) + 1
        fill = sum(s * k for s, k in pattern.items())
        if cost(fill, capacity) - fill <= CUT * sum(pattern.values()):
            out.append({place[s]: k for s, k in pattern.items()})
            left[top] += 1
            for s, k in pattern.items():
                left[s] -= k
        order = [s for s in order if left[s]]
    return out


@dataclass
class Program:
    """The solved program: patterns (places in lengths: copies) or cuts (None), how often each is used, the lengths' duals."""

    used: list[tuple[dict[int, int] | None, float]]
    price: float
    duals: np.ndarray
    pivots: int = 0
    priced: int = 0


class _Master:
    """Revised simplex over the columns so far. The first n are the cuts, which are also the first basis."""

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, capacity: int):
        n = len(lengths)
        self.lengths, self.capacity, self.n = lengths, capacity, n
        self.demand = demand * (1 + SPREAD * np.random.default_rng(1).random(n))
        self.patterns: list[dict[int, int] | None] = [None] * n
        self.columns, self.prices = np.eye(n), (lengths + CUT).astype(float)
        self.scale = 1 / np.sqrt(1 + (self.columns**2).sum(0))
        self.basis, self.inverse, self.x = np.arange(n), np.eye(n), self.demand.copy()
        self.known: set[tuple] = set()
        self.pivots = 0

    def duals(self) -> np.ndarray:
        return self.prices[self.basis] @ self.inverse

    def add(self, patterns: list[dict[int, int]]) -> int:
        new = []
        for p in patterns:
            key = tuple(sorted(p.items()))
            if key not in self.known:
                self.known.add(key)
                new.append(p)
        if new:
            more = np.zeros((self.n, len(new)))
            for c, p in enumerate(new):
                more[list(p), c] = list(p.values())
            self.patterns += new
            self.columns = np.concatenate([self.columns, more], 1)
            self.prices = np.append(self.prices, [cost(sum(int(self.lengths[j]) * k for j, k in p.items()), self.capacity) for p in new])
            self.scale = np.append(self.scale, 1 / np.sqrt(1 + (more**2).sum(0)))
        return len(new)

    def _refresh(self) -> None:
        self.inverse = np.linalg.inv(self.columns[:, self.basis])
        self.x = self.inverse @ self.demand

    def solve(self) -> None:
        """Pivots, on the steepest column by its length, until no column lowers the price."""
        since = 0
        while True:
            gain = self.duals() @ self.columns - self.prices
            c = int((gain * self.scale).argmax())
            if gain[c] <= TOLERANCE:
                if not since:
                    return
                self._refresh()  # once more with exact numbers
                since = 0
                continue
            step = self.inverse @ self.columns[:, c]
            up = np.flatnonzero(step > 1e-9)
            ratio = self.x[up] / step[up]
            least = ratio.min()
            ties = up[ratio <= least + 1e-12]
            out = int(ties[step[ties].argmax()])
            self.x -= least * step
            self.x[out] = least
            row = self.inverse[out] / step[out]
            hit, wide = np.flatnonzero(np.abs(step) > 1e-13), np.flatnonzero(row)
            if 2 * len(wide) > self.n:
                self.inverse[hit] -= np.outer(step[hit], row)
            else:
                self.inverse[np.ix_(hit, wide)] -= np.outer(step[hit], row[wide])
            self.inverse[out] = row
            self.basis[out] = c
            self.pivots += 1
            since += 1
            if since == 200:
                self._refresh()
                since = 0

    def forget(self) -> None:
        """Leaves out the dearest of the columns that aren't in use."""
        over = self.columns.shape[1] - (KEPT + 2) * self.n
        if over <= 0:
            return
        gain = self.duals() @ self.columns - self.prices
        gain[: self.n] = gain[self.basis] = np.inf
        stay = np.sort(np.argsort(-gain, kind="stable")[: KEPT * self.n])
        for c in set(range(self.columns.shape[1])).difference(stay.tolist()):
            self.known.discard(tuple(sorted(self.patterns[c].items())))
        self.basis = np.searchsorted(stay, self.basis)
        self.patterns = [self.patterns[c] for c in stay]
        self.columns, self.prices, self.scale = self.columns[:, stay], self.prices[stay], self.scale[stay]


def priced_columns(duals: np.ndarray, lengths: np.ndarray, capacity: int, at_once: int = AT_ONCE) -> list[dict[int, int]]:
    """Patterns whose duals come to more than their price: the best filling of each power of two, of any size, and beside each length. None of them: no pattern is left that would lower the price."""
    best, last = _knapsack(duals, lengths, capacity)
    powers = [1 << k for k in range(capacity.bit_length()) if 1 << k <= capacity]
    out = [_pattern(last, lengths, p) for p in powers if best[p] - cost(p, capacity) > TOLERANCE]
    if best[top := int(best.argmax())] - capacity > TOLERANCE:
        out.append(_pattern(last, lengths, top))
    rest = best[capacity - lengths] + duals - capacity
    for j in np.argsort(-rest, kind="stable")[:at_once].tolist():
        if rest[j] > TOLERANCE:
            column = _pattern(last, lengths, capacity - int(lengths[j]))
            out.append(column | {j: column.get(j, 0) + 1})
    return out


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> Program:
    """The program over all patterns. It begins with cuts and the patterns that a greedy filling uses, and ends when pricing finds no column any more."""
    master = _Master(lengths, demand.astype(float), capacity)
    master.add(greedy(lengths, demand.astype(float), capacity))
    priced = 0
    while True:
        master.solve()
        new = master.add(priced_columns(master.duals(), lengths, capacity))
        if not new:
            break
        priced += new
        master.forget()
    x = np.maximum(np.linalg.solve(master.columns[:, master.basis], demand.astype(float)), 0)
    return Program([(master.patterns[c], float(t)) for c, t in zip(master.basis.tolist(), x, strict=True)], float(master.prices[master.basis] @ x), master.duals(), master.pivots, priced)


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """histogram: documents by the tokens that are left of them beside whole sequences, 1 to capacity - 1; other lengths and counts of 0 are ignored, an empty histogram gives an empty plan, and equal histograms give equal plans."""
    out = Plan(capacity)
    lengths = np.array(sorted(k for k, n in histogram.items() if n and 0 < k < capacity), np.int64)
    if not len(lengths):
        return out
    demand = np.array([histogram[int(k)] for k in lengths], float)
    used = np.zeros(len(lengths), np.int64)
    places: dict[int, list[tuple[int, int, int, int]]] = {}

    def lay(pattern: dict[int, int], times: int) -> None:
        fill, offset = sum(int(lengths[j]) * k for j, k in pattern.items()), 0
        times = min([times, *((int(demand[j]) - int(used[j])) // k for j, k in pattern.items())])
        if times <= 0 or cost(fill, capacity) - fill > CUT * sum(pattern.values()):
            return  # cutting them is cheaper
        for j, k in pattern.items():
            places.setdefault(j, []).append((int(used[j]), k, out.sequences, offset))
            used[j] += times * k
            offset += k * int(lengths[j])
        out.sequences += times

    for pattern, often in solve(lengths, demand, capacity).used:
        if pattern:
            lay(pattern, int(often + 1e-4))
    # what rounding leaves is a few documents a pattern, however many there are in all
    for pattern in rest(lengths, demand - used, capacity):
        lay(pattern, 1)
    for j, size in enumerate(lengths.tolist()):
        out.slots[size] = tuple(np.array(c, np.int64) for c in zip(*places[j], strict=True)) if j in places else ()
        out.used[size], out.base[size] = int(used[j]), out.stream
        out.stream += size * (int(demand[j]) - int(used[j]))
    return out
