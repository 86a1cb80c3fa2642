"""Graph kernels on numpy arrays, for one world, one root or one small graph at a time."""

from __future__ import annotations

import heapq
import math

import numpy as np


class Arcs:
    """A directed graph in compressed rows; ``names`` maps numbers to node ids."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, extra: np.ndarray | None = None):
        self.names, packed = np.unique(np.concatenate([src, dst]), return_inverse=True)
        self.n, m = len(self.names), len(src)
        a, b = packed[:m], packed[m:]
        order = np.lexsort((b, a))
        self.to, self.extra = b[order], None if extra is None else np.asarray(extra)[order]
        self.start = np.searchsorted(a[order], np.arange(self.n + 1))

    @classmethod
    def packed(cls, start: np.ndarray, to: np.ndarray, extra: np.ndarray) -> Arcs:
        """From compressed rows of nodes that are their own numbers."""
        g = cls.__new__(cls)
        g.n, g.start, g.to, g.extra = len(start) - 1, start, to, extra
        g.names = np.arange(g.n)
        return g

    def number(self, nodes) -> np.ndarray:
        nodes = np.asarray(nodes)
        at = np.searchsorted(self.names, nodes)
        at[at == self.n] = 0
        return np.where(self.n and self.names[at] == nodes, at, -1) if self.n else np.full(len(nodes), -1)

    def after(self, nodes: np.ndarray) -> np.ndarray:
        """All heads of arcs out of ``nodes``."""
        lo, hi = self.start[nodes], self.start[nodes + 1]
        size = hi - lo
        return self.to[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())]


def levels(g: Arcs, seeds: np.ndarray) -> np.ndarray:
    """Least number of arcs from any seed number to each node; -1: not reached."""
    out = np.full(g.n, -1)
    front = np.unique(seeds[seeds >= 0])
    out[front] = 0
    level = 0
    while len(front):
        level += 1
        found = g.after(front)
        front = np.unique(found[out[found] < 0])
        out[front] = level
    return out


def diameter(g: Arcs) -> int:
    """The greatest distance in a connected graph whose arcs go both ways.

    A search from a node bounds the greatest distance of every other one: it is the node's own, less or
    plus the way there, and that way at least. Of two nodes further apart than the greatest distance found,
    one is further than half of it from the middle, the searched node that has the least. So nodes that far
    out are searched, the greatest bound first, until none's can exceed the greatest distance found; some of the
    first searches look for the middle, from the least bound.
    """
    low, high, middle = np.zeros(g.n, np.int64), np.full(g.n, g.n), np.full(g.n, g.n)
    first = 1 - np.diff(g.start) / (len(g.to) + 1)  # of equal bounds, the most arcs
    best, least, turn = 0, g.n, 0
    while len(left := np.flatnonzero((high > best) & (2 * middle > best))):
        if turn < 20 and turn % 2 == 0:
            left = np.flatnonzero(high > best)
            v = left[np.argmin(first[left] + low[left])]
        else:
            v = left[np.argmin(first[left] - high[left])]
        way = levels(g, np.array([v]))
        far, turn = int(way.max()), turn + 1
        if far < least:
            least, middle = far, way
        best, low, high = max(best, far), np.maximum(low, np.maximum(way, far - way)), np.minimum(high, far + way)
    return best


def first_rank(g: Arcs, seeds: np.ndarray) -> np.ndarray:
    """The place in ``seeds`` of the first seed that reaches each node; -1: none."""
    out = np.full(g.n, -1)
    for rank, s in enumerate(seeds):
        if s < 0 or out[s] >= 0:
            continue
        front = np.array([s])
        out[s] = rank
        while len(front):
            found = np.unique(g.after(front))
            front = found[out[found] < 0]
            out[front] = rank
    return out


def follow(g: Arcs, lack: np.ndarray, lit: np.ndarray, front: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Follow the arcs out of the first places of ``front``, ``most`` or so: (the places they lead to, newly lit ones, the rest of front).

    g.extra: weights; lack: what each place lacks to its threshold; lit: flags. Both are changed; they hold copies of g's nodes laid in one row.
    """
    lo = g.start[front % g.n]
    size = g.start[front % g.n + 1] - lo
    take = max(1, int(np.searchsorted(np.cumsum(size), most, "right")))
    now, later, lo, size = front[:take], front[take:], lo[:take], size[:take]
    at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
    to = np.repeat(now - now % g.n, size) + g.to[at]
    np.subtract.at(lack, to, g.extra[at])
    met = to[lack[to] <= 0]
    new = np.unique(met[~lit[met]])
    lit[new] = True
    return to, new, later


def activate(g: Arcs, lack: np.ndarray, lit: np.ndarray, front: np.ndarray, most: int = 1 << 20) -> None:
    """Light ``front`` and, under linear thresholds, all that follow; the order does not matter."""
    lit[front] = True
    while len(front):
        _, new, later = follow(g, lack, lit, front, most)
        front = np.concatenate([later, new]) if len(later) else new


def threshold_spreads(g: Arcs, need: np.ndarray, held: np.ndarray, tried: np.ndarray, cells: int = 1 << 21) -> np.ndarray:
    """How many nodes ``held`` and each of the ``tried`` numbers activate under linear thresholds (need), in whole numbers.

    What held activates is found once; copies of that state for many tried ones go on together.
    """
    lack, lit = need.copy(), np.zeros(g.n, bool)
    activate(g, lack, lit, held)
    out, width = np.zeros(len(tried), np.int64), max(1, cells // g.n)
    for k in range(0, len(tried), width):
        some = tried[k : k + width]
        lacks, lits = np.tile(lack, len(some)), np.tile(lit, len(some))
        row = np.flatnonzero(~lit[some])
        activate(g, lacks, lits, row * g.n + some[row])
        out[k : k + width] = lits.reshape(-1, g.n).sum(1)
    return out


def nested_spreads(g: Arcs, need: np.ndarray, held: np.ndarray, tried: np.ndarray, some: int = 128, cells: int = 1 << 22) -> np.ndarray:
    """The same as threshold_spreads, in less time: what a node activates holds all that any node among them activates.

    Every tried one is followed until it has lit ``some`` nodes. Those that have more are followed to their end, the
    ones that they light first; each goes on from the largest known state of a node that it lights. At most ``cells``
    cells of states are kept, the ones used last.
    """
    lack0, lit0 = need.copy(), np.zeros(g.n, bool)
    activate(g, lack0, lit0, held)
    base, width = int(lit0.sum()), max(1, cells // g.n)
    out, first = np.full(len(tried), base), {}
    lack, lit = np.tile(lack0, min(width, len(tried))), np.tile(lit0, min(width, len(tried)))
    for k in range(0, len(tried), width):
        batch = tried[k : k + width]
        row = np.flatnonzero(~lit0[batch])
        front = row * g.n + batch[row]
        lit[front] = True
        found, touched, seen, count = [front], [], 0, np.bincount(row, minlength=len(batch))
        while len(front):
            to, new, later = follow(g, lack, lit, front)
            count += np.bincount(new // g.n, minlength=len(batch))
            found.append(new)
            seen += len(to)
            touched = [*touched, to] if seen <= len(lack) else []
            front = np.concatenate([later, new]) if len(later) else new
            front = front[count[front // g.n] <= some]
        out[k : k + width] += count
        found = np.concatenate(found)
        for i in np.flatnonzero(count > some):
            first[int(batch[i])] = found[found // g.n == i] % g.n
        lit[found] = False
        if seen > len(lack):
            lack.reshape(-1, g.n)[:] = lack0
        for to in touched:
            lack[to] = lack0[to % g.n]
    del lack, lit
    place, left, size = dict(zip(tried.tolist(), range(len(tried)))), np.zeros(g.n, bool), np.zeros(g.n, np.int64)
    left[list(first)] = True
    states: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def start(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """A copy of the largest kept state of one of nodes, which it lights too: thresholds, flags, front, lit ones."""
        v, count = int(nodes[np.argmax(size[nodes])]), base
        lack, lit = lack0, lit0
        if size[v]:
            lack, lit = states[v] = states.pop(v)  # now the last used
            count = int(size[v])
        lack, lit = lack.copy(), lit.copy()
        front = nodes[~lit[nodes]]
        lit[front] = True
        return lack, lit, front, count + len(front)

    for root in first:
        stack = [root] if left[root] else []
        left[root] = False
        while stack:
            v = stack[-1]
            under = first[v][left[first[v]]]
            if len(under):
                stack.append(int(under[0]))
                left[under[0]] = False
                continue
            stack.pop()
            lack, lit, front, count = start(first[v])
            while len(front):
                _, new, later = follow(g, lack, lit, front)
                front, count = np.concatenate([later, new]) if len(later) else new, count + len(new)
                if len(new) and size[new].max() > count:
                    lack, lit, front, count = start(np.flatnonzero(lit & ~lit0))
            out[place[v]], size[v] = count, count
            states[v] = lack, lit
            if len(states) > width:
                gone = next(iter(states))
                del states[gone]
                size[gone] = 0
    return out


def components(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component), edges read both ways."""
    nodes, packed = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = packed[: len(src)], packed[len(src) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def strong(g: Arcs) -> np.ndarray:
    """The smallest member of each node's strongly connected component (numbers)."""
    index, low, on = np.full(g.n, -1), np.zeros(g.n, np.int64), np.zeros(g.n, bool)
    out, stack, count = np.full(g.n, -1), [], 0
    for root in range(g.n):
        if index[root] >= 0:
            continue
        work = [(root, g.start[root])]
        while work:
            v, i = work.pop()
            if i == g.start[v] and index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            moved = False
            while i < g.start[v + 1]:
                u = g.to[i]
                i += 1
                if index[u] < 0:
                    work += [(v, i), (u, g.start[u])]
                    moved = True
                    break
                if on[u]:
                    low[v] = min(low[v], index[u])
            if moved:
                continue
            if low[v] == index[v]:
                part = []
                while True:
                    u = stack.pop()
                    on[u] = False
                    part.append(u)
                    if u == v:
                        break
                out[part] = min(part)
            if work:
                p = work[-1][0]
                low[p] = min(low[p], low[v])
    return out


def reach_sets(g: Arcs, scc: np.ndarray | None = None) -> list[set[int]]:
    """For every node the set of nodes it reaches, itself included: over the condensation's DAG."""
    scc = strong(g) if scc is None else scc
    members: dict[int, list[int]] = {}
    for v, c in enumerate(scc):
        members.setdefault(int(c), []).append(v)
    done: dict[int, set[int]] = {}
    for root in members:
        work = [root]
        while work:
            c = work[-1]
            if c in done:
                work.pop()
                continue
            after = {int(scc[u]) for v in members[c] for u in g.to[g.start[v] : g.start[v + 1]]} - {c}
            todo = [d for d in after if d not in done]
            if todo:
                work += todo
                continue
            done[c] = set(members[c]).union(*[done[d] for d in after])
            work.pop()
    return [done[int(c)] for c in scc]


def reach_counts(g: Arcs, part: int = 0, parts: int = 1, words: int = 1 << 22) -> np.ndarray:
    """For every node how many nodes it reaches, itself included, out of one of ``parts`` even parts of the nodes.

    Bit sets over the condensation's DAG, heads first, for a block of reached nodes at a time: all sets of a
    block take ``words`` 64-bit words or so, however large the reach.
    """
    name, comp = np.unique(strong(g), return_inverse=True)
    c = len(name)
    a, b = comp[np.repeat(np.arange(g.n), np.diff(g.start))], comp[g.to]
    a, b = np.divmod(np.unique((a * c + b)[a != b]), max(c, 1))
    start, order = np.searchsorted(a, np.arange(c + 1)), np.argsort(b, kind="stable")
    back = np.searchsorted(b[order], np.arange(c + 1))

    def spans(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())

    left, layers = np.diff(start), []
    front = np.flatnonzero(left == 0)
    while len(front):
        tails, n = np.unique(a[order[spans(back[front], back[front + 1] - back[front])]], return_counts=True)
        left[tails] -= n
        front = tails[left[tails] == 0]
        if len(front):
            size = start[front + 1] - start[front]
            layers.append((front, b[spans(start[front], size)], np.cumsum(size) - size))
    total = np.zeros(c, np.int64)
    width = 64 * max(1, words // max(c, 1))
    for lo in range(part * g.n // parts, last := (part + 1) * g.n // parts, width):
        node = np.arange(lo, min(lo + width, last))
        sets = np.zeros((c, -(-len(node) // 64)), np.uint64)
        np.bitwise_or.at(sets, (comp[node], (node - lo) // 64), np.uint64(1) << ((node - lo) % 64).astype(np.uint64))
        for front, heads, at in layers:
            sets[front] |= np.bitwise_or.reduceat(sets[heads], at, axis=0)
        total += np.bitwise_count(sets).sum(1, dtype=np.int64)
    return total[comp]


def spanning_forest(edges: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Kruskal: edges (cost, u, v) of the least forest, ties by (cost, u, v)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for e in sorted(edges):
        a, b = find(e[1]), find(e[2])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append(e)
    return out


def neighbours(edges) -> dict[int, dict[int, float]]:
    """u -> {v: value} of undirected (u, v, value)."""
    out: dict[int, dict[int, float]] = {}
    for u, v, x in edges:
        out.setdefault(u, {})[v] = x
        out.setdefault(v, {})[u] = x
    return out


def shortest_paths(adj: dict[int, dict[int, float]], root: int, cutoff: float = math.inf) -> tuple[dict[int, float], dict[int, int]]:
    """Dijkstra: costs up to ``cutoff`` and parents; ties go to the smaller (cost, parent, node)."""
    cost, parent, heap = {}, {}, [(0.0, -1, root)]
    while heap:
        c, p, v = heapq.heappop(heap)
        if v in cost:
            continue
        cost[v] = c
        if p >= 0:
            parent[v] = p
        for u, x in adj.get(v, {}).items():
            if u not in cost and c + x <= cutoff:
                heapq.heappush(heap, (c + x, v, u))
    return cost, parent
