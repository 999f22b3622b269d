"""Least cost of edits that make a rule cover a segment: dynamic programming over all spans, without a limit.

The parts of a grammar become nodes. A node's costs on all spans of one length are a row; lengths are
done from short to long. A sequence of two parts costs the least sum over the places where a span can
be split. Where one of the parts is inserted whole, its cost is a constant, so that within a length only
"costs as much as that node and a constant" is left, which is repeated until nothing changes.

A terminal on a span keeps or replaces one token and deletes the others; what may be empty deletes all.

Time grows with the cube of a segment's length and what is kept with its square: 2 bytes for each span and
each part of a sequence. In long segments costs above a bound are left out, which leaves few lengths to most
nodes; as no part of a repair costs more than the whole, a cost within the bound is the least, and where there
is none the bound is raised. What doesn't fit memory is kept in files.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np

#: Cost of what can't be; two of them and no more can be added.
NEVER = {np.int16: (1 << 14) - 1, np.int32: (1 << 30) - 1}
#: Tokens from which a segment is long, and the first bound of its costs.
LONG, FIRST = 400, 8
#: Bytes of kept costs in memory; what comes later is mapped from files.
IN_MEMORY = 512 << 20


class Costs:
    """The nodes that a rule is made of, numbered, with the order in which they are done within a length."""

    def __init__(self, rules: dict[str, tuple], rule: str):
        self.rules = rules
        self.numbers: dict[tuple, int] = {}
        self.n = 0
        self.leaves: list[tuple[int, tuple]] = []  # terminals and brackets
        self.pairs: list[tuple[int, int, int]] = []  # sequences of two nodes
        self.same: list[tuple[int, int]] = []  # (node, another that it may be)
        self.nothing = self._number(("empty",))
        self.root = self._add(("n", rule))
        self._insertions()
        self._order()

    def _number(self, key: tuple) -> int:
        self.numbers[key] = self.n
        self.n += 1
        return self.n - 1

    def _pair(self, left: int, right: int) -> int:
        key = ("pair", left, right)
        if key not in self.numbers:
            self.pairs.append((self._number(key), left, right))
        return self.numbers[key]

    def _add(self, x: tuple) -> int:
        if x in self.numbers:
            return self.numbers[x]
        kind = x[0]
        if kind == "seq":
            at = self._add(x[1])
            for y in x[2:]:
                at = self._pair(at, self._add(y))
            self.numbers[x] = at
            return at
        at = self._number(x)
        if kind in ("t", "g"):
            self.leaves.append((at, x))
        elif kind == "n":
            self.same.append((at, self._add(self.rules[x[1]])))
        else:
            self.same += [(at, self._add(y)) for y in x[1:]] if kind != "rep" else [(at, self._pair(at, self._add(x[1])))]
            if kind != "alt":
                self.same.append((at, self.nothing))
        return at

    def _insertions(self) -> None:
        """What it costs to insert each node."""
        self.least = [NEVER[np.int32]] * self.n
        self.least[self.nothing] = 0
        for at, _ in self.leaves:
            self.least[at] = 1
        changed = True
        while changed:
            changed = False
            for at, got in [(x, self.least[y]) for x, y in self.same] + [(x, self.least[a] + self.least[b]) for x, a, b in self.pairs]:
                if got < self.least[at]:
                    self.least[at] = got
                    changed = True

    def _order(self) -> None:
        """Levels of (node, [(what it may be, constant)]): what costs nothing more is done before what it is part
        of, as far as there are no rings."""
        edges: dict[int, list[tuple[int, int]]] = {}
        for x, y in self.same:
            edges.setdefault(x, []).append((y, 0))
        for x, a, b in self.pairs:
            edges.setdefault(x, []).extend([(a, self.least[b]), (b, self.least[a])])
        level: dict[int, int] = {}

        def depth(x: int) -> int:
            if x not in level:
                level[x] = 0  # met again within itself
                level[x] = 1 + max((depth(y) for y, c in edges.get(x, ()) if not c), default=-1)
            return level[x]

        by_level: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
        for x, es in edges.items():
            by_level.setdefault(depth(x), []).append((x, es))
        self.levels = [es for _, es in sorted(by_level.items())]

    def _steps(self, known: np.ndarray, most: int, kind: type) -> list[tuple]:
        """Of each level the nodes that can be one of those known, where each one's sources begin, sources, constants."""
        known = known.copy()
        count = -1
        while count != (count := int(known.sum())):
            for level in self.levels:
                for x, es in level:
                    known[x] |= any(known[y] and c <= most for y, c in es)
        out = []
        for level in self.levels:
            kept = [(x, [(y, c) for y, c in es if known[y] and c <= most]) for x, es in level if known[x]]
            kept = [(x, es) for x, es in kept if es]
            if kept:
                flat = [e for _, es in kept for e in es]
                begins = np.cumsum([0, *[len(es) for _, es in kept[:-1]]])
                out.append((np.array([x for x, _ in kept]), begins, np.array([y for y, _ in flat]), np.array([[c] for _, c in flat], dtype=kind)))
        return out

    def cost(self, n: int, hit: Callable[[tuple, int], bool]) -> int:
        """The least cost for n tokens; hit says whether a terminal or bracket can be the token at a place."""
        if not n:
            return self.least[self.root]
        hits = np.array([[hit(x, i) for i in range(n)] for _, x in self.leaves])
        enough = n + self.least[self.root]  # all deleted, all inserted
        most = enough if n <= LONG else FIRST
        while (got := self._within(n, hits, min(most, enough))) is None:
            most *= 4
        return got

    def _within(self, n: int, hits: np.ndarray, most: int) -> int | None:
        """The least cost if it is within `most`."""
        kind = np.int16 if 2 * n + max(self.least) < NEVER[np.int16] else np.int32
        never = NEVER[kind]
        leaves = np.array([at for at, _ in self.leaves])
        pairs, lefts, rights = np.array(self.pairs, dtype=np.int64).reshape(-1, 3).T
        left, right = _Kept(n, len(pairs), kind), _Kept(n, len(pairs), kind)
        met = np.zeros_like(hits)
        steps: dict[bytes, list[tuple]] = {}
        for size in range(1, n + 1):
            m = n - size + 1
            costs = np.full((len(self.least), m), never, dtype=kind)
            met = met[:, :m] | hits[:, size - 1 :]
            if size <= most + 1:
                costs[leaves] = size - met.astype(kind)
                costs[self.nothing] = size
            if size > 1:
                best = np.full((len(pairs), m), never, dtype=kind)
                sums = np.empty_like(best)
                both = left.has[1:size] & right.has[size - 1 : 0 : -1]
                for k in np.flatnonzero(both.any(axis=1)) + 1:
                    if left.whole[k] and right.whole[size - k]:
                        np.add(left.rows[k][:, :m], right.rows[size - k][:, k : k + m], out=sums)
                        np.minimum(best, sums, out=best)
                    else:
                        at = np.flatnonzero(both[k - 1])
                        best[at] = np.minimum(best[at], left.of(k, at)[:, :m] + right.of(size - k, at)[:, k : k + m])
                costs[pairs] = best
            costs[costs > most] = never
            known = (costs < never).any(axis=1)
            key = known.tobytes()
            if key not in steps:
                steps[key] = self._steps(known, most, kind)
            changed = True
            while changed:
                changed = False
                for xs, begins, sources, extra in steps[key]:
                    got = np.minimum.reduceat(costs[sources] + extra, begins, axis=0)
                    old = costs[xs]
                    np.minimum(got, old, out=got)
                    if not changed and (got < old).any():
                        changed = True
                    costs[xs] = got
            costs[costs > most] = never
            known = (costs < never).any(axis=1)
            left.keep(size, costs, lefts, known)
            right.keep(size, costs, rights, known)
        return int(costs[self.root, 0]) if costs[self.root, 0] <= most else None


class _Kept:
    """Costs of the nodes that are a part of pairs, by length; of those only that have any on it."""

    def __init__(self, n: int, pairs: int, kind: type):
        self.rows: list[np.ndarray] = [np.empty((0, 0), dtype=kind)] * (n + 1)
        self.has = np.zeros((n + 1, pairs), dtype=bool)
        self.whole = np.zeros(n + 1, dtype=bool)
        self.bytes = 0

    def keep(self, size: int, costs: np.ndarray, nodes: np.ndarray, known: np.ndarray) -> None:
        self.has[size] = known[nodes]
        self.whole[size] = self.has[size].all()
        rows = costs[nodes[self.has[size]]]
        self.bytes += rows.nbytes
        if self.bytes > IN_MEMORY and rows.size:
            with tempfile.TemporaryFile() as f:
                mapped = np.memmap(f, dtype=rows.dtype, shape=rows.shape)
            mapped[:] = rows
            rows = mapped
        self.rows[size] = rows

    def of(self, size: int, pairs: np.ndarray) -> np.ndarray:
        """The costs of some pairs' parts, all of which have any."""
        if self.whole[size]:
            return self.rows[size][pairs]
        return self.rows[size][np.cumsum(self.has[size])[pairs] - 1]
