"""A small causal self-attention model in numpy: training, and scoring in overlapping windows.

Subword ids are the leaves of a two-level tree: GROUPS groups of SLOTS leaves, so that a probability
takes one softmax over groups and one inside the right group. The commonest ids have a leaf each; the
others share the last leaves by what stands before and after them, and such an id's part of its leaf
is its smoothed share of the leaf's count over the whole training corpus. Leaves with like neighbours
stand in one group. So every id has a probability and all sum to one. Inputs are embedded by leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Ids before the scored ones in a window, and scored ones.
CONTEXT, SCORED = 10, 30
WINDOW = CONTEXT + SCORED
GROUPS, SLOTS, RARE, DIM, HIDDEN = 32, 48, 64, 16, 32
LEAVES = GROUPS * SLOTS
#: Common ids whose neighbourhood tells leaves apart.
ANCHORS = 128
MASK = (np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None]).astype(np.float32)
FULL = np.tril(np.ones((WINDOW, WINDOW), np.float32))
EPS = 1e-5


def anchors(counts: np.ndarray) -> np.ndarray:
    """The ANCHORS commonest ids."""
    return np.lexsort((np.arange(len(counts)), -counts))[:ANCHORS]


def neighbour_keys(ids: np.ndarray, vocab: int, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a (vocab, 2 * anchors) table: one for each anchor just before or just after an id.

    The second array tells where in ``ids`` the later of the two stands.
    """
    place = np.full(vocab, -1)
    place[anchors] = np.arange(len(anchors))
    a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
    left, right = np.flatnonzero(place[a] >= 0), np.flatnonzero(place[b] >= 0)
    keys = [b[left] * 2 * len(anchors) + place[a[left]], a[right] * 2 * len(anchors) + len(anchors) + place[b[right]]]
    return np.concatenate(keys), np.concatenate([left, right]) + 1


def shares(near: np.ndarray) -> np.ndarray:
    """For every id the shares (square roots) of the anchors just before and just after it."""
    return np.sqrt(near / np.maximum(near.sum(1, keepdims=True), 1)).astype(np.float32)


def neighbourhoods(counts: np.ndarray, sample: list[np.ndarray]) -> np.ndarray:
    """Uses of the anchors beside every id in sequences."""
    found = anchors(counts)
    size = 2 * len(found)
    keys = np.concatenate([np.zeros(0, np.int64), *[neighbour_keys(ids, len(counts), found)[0] for ids in sample]])
    return np.bincount(keys, minlength=len(counts) * size).reshape(-1, size)


def balanced(rows: np.ndarray, index: np.ndarray, size: int) -> list[np.ndarray]:
    """Parts of ``size`` rows with like rows together: halves along the main direction, again and again."""
    if len(index) <= size:
        return [index]
    x = rows[index] - rows[index].mean(0)
    axis = np.random.default_rng(len(index)).standard_normal(x.shape[1])
    for _ in range(12):
        axis = x.T @ (x @ axis)
        axis /= max(np.linalg.norm(axis), 1e-12)
    order = index[np.lexsort((index, np.round(x @ axis, 6)))]
    half = len(index) // 2
    return balanced(rows, order[:half], size) + balanced(rows, order[half:], size)


def leaves(counts: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The leaf of every id: group * SLOTS + slot; near: uses of the anchors beside every id."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    single, rest = order[: LEAVES - RARE], order[LEAVES - RARE :]
    near = shares(near)
    raw = np.zeros(len(counts), np.int64)
    raw[single] = np.arange(len(single))
    parts = balanced(near, rest[np.argsort(rest)], -(-len(rest) // RARE)) if len(rest) else []
    mean = [near[single]]
    for k, part in enumerate(parts):
        raw[part] = len(single) + k
        mean.append(near[part].mean(0, keepdims=True))
    of_leaf = np.zeros(LEAVES, np.int64)
    for g, part in enumerate(balanced(np.concatenate(mean), np.arange(LEAVES), SLOTS)):
        of_leaf[part] = g * SLOTS + np.arange(len(part))
    return of_leaf[raw]


def within(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """log P(id | leaf), smoothed by a tenth."""
    c = counts + 0.1
    return np.log(c / np.bincount(of, c, LEAVES)[of]).astype(np.float32)


def norm(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = np.sqrt(np.einsum("...i,...i->...", x, x)[..., None] / x.shape[-1] + EPS)
    return x / r, r


def norm_back(dy: np.ndarray, y: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = y * (np.einsum("...i,...i->...", dy, y)[..., None] / np.float32(y.shape[-1]))
    np.subtract(dy, out, out=out)
    out /= r
    return out


def new_weights(dim: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    shapes = {"E": (LEAVES, dim), "P": (WINDOW, dim), "Q": (dim, dim), "K": (dim, dim), "V": (dim, dim), "O": (dim, dim), "A": (dim, hidden), "B": (hidden, dim), "U": (dim, GROUPS), "L": (GROUPS, dim, SLOTS)}
    out = {n: (rng.standard_normal(s) * (0.5 if n in "EP" else s[-2] ** -0.5)).astype(np.float32) for n, s in shapes.items()}
    out["u"], out["l"] = np.zeros(GROUPS, np.float32), np.zeros((GROUPS, SLOTS), np.float32)
    return out


def exp_of(logits: np.ndarray) -> None:
    """In place: exp, of rows shifted to a largest entry of zero if any entry is far from zero."""
    if logits.size and max(-logits.min(), logits.max()) > 60:
        logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)


def by_group(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings rows of a group together, and where each group starts."""
    order = np.argsort(group.astype(np.uint8), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS))])


def loss_and_gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of the next leaves ``y`` where ``use``, and its gradients; x, y: (windows, WINDOW).

    Places before the first that any window uses are only keys and values; all else about them is zero.
    """
    d = w["Q"].shape[1]
    from_ = int(np.argmax(use.any(0)))
    root = np.float32(d**0.5)
    h0 = w["E"].take(x, axis=0)
    h0 += w["P"]
    n0, r0 = norm(h0)
    all_rows, late = n0.reshape(-1, d), np.ascontiguousarray(n0[:, from_:])
    late_rows, query, key_value = late.reshape(-1, d), w["Q"] / root, np.hstack([w["K"], w["V"]])
    q = (late_rows @ query).reshape(late.shape)
    kv = (all_rows @ key_value).reshape(*x.shape, 2 * d)
    k, v = kv[..., :d], kv[..., d:]
    a = q @ k.transpose(0, 2, 1)
    if max(-a.min(), a.max()) > 60:
        np.clip(a, -60, 60, out=a)
    np.exp(a, out=a)
    a *= FULL[from_:]
    a /= np.einsum("bij->bi", a)[..., None]
    c = a @ v
    c_rows = c.reshape(-1, d)
    h1 = c_rows @ w["O"]
    h1 += h0[:, from_:].reshape(-1, d)
    n1, r1 = norm(h1)
    g = n1 @ w["A"]
    np.maximum(g, 0, out=g)
    h2 = g @ w["B"]
    h2 += h1
    n2, r2 = norm(h2)
    rows = np.flatnonzero(use[:, from_:])
    goal, share = y[:, from_:].ravel().take(rows), np.float32(1 / max(len(rows), 1))
    order, edge = by_group(goal // SLOTS)
    rows, goal = rows.take(order), goal.take(order).astype(np.int64)  # rows of a group together
    flat, group = np.empty((len(rows), d + 1), n2.dtype), goal // SLOTS
    flat[:, :d] = n2.take(rows, axis=0)
    flat[:, d] = 1  # for the biases
    at_group, at_slot = np.arange(len(flat)) * GROUPS + group, np.arange(len(flat)) * SLOTS + goal % SLOTS
    p = flat @ np.vstack([w["U"], w["u"]])
    exp_of(p)
    p /= np.einsum("ij->i", p)[:, None]
    loss = -float(np.log(p.take(at_group)).sum(dtype=np.float64) * share)
    p.reshape(-1)[at_group] -= 1
    p *= share
    outer = flat.T @ p
    dused = p @ w["U"].T
    inner = np.concatenate([w["L"], w["l"][:, None]], axis=1)
    back, dinner, t = w["L"].transpose(0, 2, 1), np.empty_like(dused), np.empty((len(flat), SLOTS), flat.dtype)
    parts = np.flatnonzero(np.diff(edge)).tolist()
    spans = [slice(*e) for e in zip(edge.tolist(), edge[1:].tolist())]
    for part in parts:
        at = spans[part]
        np.matmul(flat[at], inner[part], out=t[at])
    exp_of(t)
    t /= np.einsum("ij->i", t)[:, None]
    loss -= float(np.log(t.take(at_slot)).sum(dtype=np.float64) * share)
    t.reshape(-1)[at_slot] -= 1
    t *= share
    inner[:] = 0
    for part in parts:
        at = spans[part]
        own = t[at]
        np.matmul(flat[at].T, own, out=inner[part])
        np.matmul(own, back[part], out=dinner[at])
    dused += dinner
    grad = {"U": outer[:d], "u": outer[d], "L": inner[:, :d], "l": inner[:, d]}
    dflat = np.zeros((len(n2), d), n2.dtype)
    dflat[rows] = dused
    dh2 = norm_back(dflat, n2, r2)
    grad["B"] = g.T @ dh2
    dz = dh2 @ w["B"].T
    dz *= g > 0
    grad["A"] = n1.T @ dz
    dh1 = norm_back(dz @ w["A"].T, n1, r1)
    dh1 += dh2
    grad["O"] = c_rows.T @ dh1
    dc = (dh1 @ w["O"].T).reshape(c.shape)
    da = dc @ v.transpose(0, 2, 1)
    dkv = np.empty_like(kv)
    np.matmul(a.transpose(0, 2, 1), dc, out=dkv[..., d:])
    da -= np.einsum("bid,bid->bi", dc, c)[..., None]  # the mean of da under a
    da *= a
    dq = (da @ k).reshape(-1, d)
    np.matmul(da.transpose(0, 2, 1), q, out=dkv[..., :d])
    dkv_rows = dkv.reshape(-1, 2 * d)
    dn0 = (dkv_rows @ key_value.T).reshape(n0.shape)
    dn0[:, from_:] += (dq @ query.T).reshape(late.shape)
    both = all_rows.T @ dkv_rows
    grad["Q"], grad["K"], grad["V"] = late_rows.T @ dq / root, both[:, :d], both[:, d:]
    dh0 = norm_back(dn0, n0, r0)
    dh0[:, from_:] += dh1.reshape(late.shape)
    grad["P"] = np.einsum("bij->ij", dh0)
    grad["E"] = np.zeros_like(w["E"])
    leaf = x.ravel().astype(np.int16)
    order = np.argsort(leaf, kind="stable")
    leaf = leaf.take(order)
    first = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
    grad["E"][leaf[first]] = np.add.reduceat(dh0.reshape(-1, d).take(order, axis=0), first, axis=0)
    return loss, grad


def layout(streams: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences that each close with ``end``, laid in one row: the row, which of its places count as inputs,
    where each window starts, and whose it is. What follows a place of the row is its next id.

    A sequence's inputs are ``end`` and all its ids but the last; CONTEXT ends stand before it. Its
    windows advance by SCORED, and only the last SCORED places of a window count, each id once.
    """
    size = np.array([len(s) for s in streams], np.int64)
    n = -(-size // SCORED)
    room = n * SCORED + CONTEXT + 1  # the last place is only a next id
    first = np.cumsum(room) - room
    flat = np.full(int(room.sum()), end, np.int32)
    good = np.zeros(len(flat), bool)
    for f, s in zip(first.tolist(), streams):
        flat[f + CONTEXT + 1 : f + CONTEXT + 1 + len(s)] = s
        good[f + CONTEXT : f + CONTEXT + len(s)] = True
    owner = np.repeat(np.arange(len(streams)), n)
    start = np.repeat(first, n) + SCORED * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
    return flat, good, start, owner


def windows(streams: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of sequences: inputs, their next ids, which count, whose they are."""
    flat, good, start, owner = layout(streams, end)
    at = start[:, None] + np.arange(WINDOW)
    good = good[at]
    good[:, :CONTEXT] = False
    return flat[at], flat[at + 1], good, owner


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    of: np.ndarray  # leaf of every id
    inside: np.ndarray  # log P(id | leaf)
    end: int

    def prepare(self) -> None:
        w, d = self.weights, self.weights["Q"].shape[1]
        self.query = (w["Q"] / np.float32(d**0.5)).astype(np.float32)
        self.value = (w["V"] @ w["O"]).astype(np.float32)
        # rows of length sqrt(d) at most go into every product, so this bounds all exponents
        size = lambda m: float(np.sqrt((m**2).sum(-2).max()))
        most = max(d * size(self.query @ w["K"].T) * d**0.5, d**0.5 * size(w["U"]) + abs(w["u"]).max(), d**0.5 * size(w["L"]) + abs(w["l"]).max())
        self.clip = most > 80
        # the biases stand beside a last component that is always one
        self.group_out = np.vstack([w["U"], w["u"]]).astype(np.float32)
        self.slot_out = np.concatenate([w["L"], w["l"][:, None, :]], axis=1).astype(np.float32)
        self.tables = None

    def by_place(self) -> list[np.ndarray]:
        """The input, query, key and value of every leaf at every place of a window (made where they are used)."""
        if self.tables is None:
            w = self.weights
            h0 = (w["E"][:, None] + w["P"]).reshape(-1, w["E"].shape[1])
            n0, _ = norm(h0)
            self.tables = [np.ascontiguousarray(t.astype(np.float32)) for t in (h0, n0 @ self.query, n0 @ w["K"], n0 @ self.value)]
        return self.tables

    def leaf_logs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log P(leaf y) at the last SCORED places of windows of leaves x."""
        w = self.weights
        inputs, queries, keys, values = self.by_place()
        d = inputs.shape[1]
        at = x.astype(np.int64) * WINDOW + np.arange(WINDOW)
        own = np.ascontiguousarray(at[:, CONTEXT:])
        e = np.take(queries, own, axis=0) @ np.take(keys, at, axis=0).transpose(0, 2, 1)
        self.exp(e)
        e *= MASK
        c = e @ np.take(values, at, axis=0)
        c /= np.einsum("bij->bi", e)[..., None]
        c += np.take(inputs, own, axis=0)
        h = c.reshape(-1, d)
        size = np.sqrt(np.einsum("ij,ij->i", h, h) / d + EPS)
        z = h @ w["A"]
        z = np.maximum(z, 0, out=z) @ w["B"]
        z /= size[:, None]
        h += z
        last = np.empty((len(h), d + 1), np.float32)
        np.divide(h, np.sqrt(np.einsum("ij,ij->i", h, h) / d + EPS)[:, None], out=last[:, :d])
        last[:, d] = 1
        h = last
        goal = y.ravel().astype(np.int64)
        group, slot = goal // SLOTS, goal % SLOTS
        row = np.arange(len(h))
        logit = h @ self.group_out
        out = logit.take(row * GROUPS + group)
        self.exp(logit)
        out -= np.log(np.einsum("ij->i", logit))
        order, edge = by_group(group)
        h = h.take(order, axis=0)
        inner = np.empty((len(h), SLOTS), np.float32)
        for k in np.flatnonzero(np.diff(edge)):
            at = slice(edge[k], edge[k + 1])
            np.matmul(h[at], self.slot_out[k], out=inner[at])
        picked = inner.take(row * SLOTS + slot.take(order))
        self.exp(inner)
        picked -= np.log(np.einsum("ij->i", inner))
        out[order] += picked
        return out.reshape(y.shape)

    def exp(self, x: np.ndarray) -> None:
        if self.clip:
            np.minimum(x, 80, out=x)
        np.exp(x, out=x)

    def score(self, streams: list[np.ndarray], block: int = 256) -> np.ndarray:
        """log10 probability of each sequence of ids (its end included)."""
        flat, good, start, owner = layout(streams, self.end)
        leaf, inside, out = self.of.take(flat), self.inside.take(flat), np.zeros(len(streams))
        for b in range(0, len(start), block):
            at = start[b : b + block, None] + np.arange(WINDOW)
            goal = at[:, CONTEXT:] + 1
            logs = self.leaf_logs(leaf.take(at), leaf.take(goal))
            logs += inside.take(goal)
            logs *= good.take(at[:, CONTEXT:])
            own = owner[b : b + block]
            out[own[0] : own[-1] + 1] += np.bincount(own - own[0], logs.sum(1, dtype=np.float64))
        return out / np.log(10)


class Adam:
    """Steps down the gradient that change the weights ``w``, which become parts of one row; the first ``warm`` are shorter."""

    def __init__(self, w: dict[str, np.ndarray], warm: int = 50):
        self.w, self.t, self.warm = w, 0, warm
        self.row = np.concatenate([v.ravel() for v in w.values()])
        self.slope, self.first, self.second = np.empty_like(self.row), np.zeros_like(self.row), np.zeros_like(self.row)
        ends = np.cumsum([v.size for v in w.values()])[:-1]
        for (n, v), part in zip(list(w.items()), np.split(self.row, ends)):
            w[n] = part.reshape(v.shape)

    def step(self, x: np.ndarray, y: np.ndarray, use: np.ndarray, rate: float) -> None:
        _, grad = loss_and_gradients(self.w, x, y, use)
        np.concatenate([grad[n].ravel() for n in self.w], out=self.slope)
        self.t += 1
        t = self.t
        size = 1 - 0.98**t
        step, least = rate * min(1, t / self.warm) / (1 - 0.9**t) * size**0.5, 1e-8 * size**0.5
        for k in range(0, len(self.row), 1 << 14):  # parts that stay in a CPU's cache
            w, g, first, second = (v[k : k + (1 << 14)] for v in (self.row, self.slope, self.first, self.second))
            first *= 0.9
            first += 0.1 * g
            second *= 0.98
            g *= g
            g *= 0.02
            second += g
            np.sqrt(second, out=g)
            g += least
            np.divide(first, g, out=g)
            g *= step
            w -= g


def start(counts: np.ndarray, of: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Weights before training; the biases give every leaf its share of the corpus."""
    w = new_weights(DIM, HIDDEN, rng)
    share = np.bincount(of, counts + 0.1, LEAVES).reshape(GROUPS, SLOTS) / (counts + 0.1).sum()
    w["u"] = np.log(share.sum(1) + 1e-9).astype(np.float32)
    w["l"] = np.log(share / share.sum(1, keepdims=True).clip(1e-9) + 1e-9).astype(np.float32)
    return w


def train(sample: list[np.ndarray], counts: np.ndarray, end: int, steps: int = 1500, batch: int = 64, rate: float = 0.01, seed: int = 11, near: np.ndarray | None = None) -> Model:
    """A model from sampled sequences (each closed by ``end``) and the counts of ids in the whole corpus.

    near: uses of the anchors beside every id, by default in the sample.
    """
    of = leaves(counts, neighbourhoods(counts, sample) if near is None else near)
    w = start(counts, of, rng := np.random.default_rng(seed))
    if sample:
        x, y, _, _ = windows(sample, end)
        real = np.zeros(x.shape, bool)
        real[:, CONTEXT:] = True
        x, y = of[x], of[y]
        adam = Adam(w)
        for t in range(1, steps + 1):
            some = rng.integers(0, len(x), batch)
            adam.step(x[some], y[some], real[some], rate * (1 - t / (steps + 1)))
    model = Model(w, of, within(counts, of), end)
    model.prepare()
    return model


def train_on(adam: Adam, x: np.ndarray, y: np.ndarray, rate: float, rng: np.random.Generator, batch: int = 64) -> None:
    """One pass over windows of leaves, each in one step; y: the next leaves, -1 where they don't count."""
    order = rng.permutation(len(x))
    for k in range(0, len(order), batch):
        some = order[k : k + batch]
        adam.step(x[some], np.maximum(y[some], 0), y[some] >= 0, rate)
