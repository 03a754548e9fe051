"""Likelihood, expectations and maximisation for one packed tree, all sites at once.

The model is that of operators.likelihood. Values are kept linear and rescaled at each node, so no floor is needed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .trees import Tree

LEAST, MOST = 0.005, 10.0
MISSING, SILENCED = -2, -1  # codes in a matrix of states: unknown, and silenced for certain


@dataclass
class Data:
    """states: (leaves, sites) codes: 0, 1..k into the site's alphabet, MISSING or SILENCED; q: (sites, k), 0 beyond it."""

    names: list[str]
    states: np.ndarray
    q: np.ndarray


@dataclass
class Fit:
    tree: Tree
    nu: float
    phi: float
    nllh: float
    rounds: int = 0
    trace: list[float] = field(default_factory=list)


def data_of(rows: dict[str, list], priors: list[dict[int, float]] | None = None) -> Data:
    """From cell -> states ('?' or None: missing, -1: silenced); priors by site, uniform over seen states if None."""
    names = sorted(rows)
    sites = len(next(iter(rows.values())))
    seen = [sorted({r[s] for r in rows.values() if isinstance(r[s], int) and r[s] > 0}) for s in range(sites)]
    priors = priors or [{a: 1 / len(x) for a in x} if x else {1: 1.0} for x in seen]
    width = max(len(p) for p in priors)
    q, states = np.zeros((sites, width)), np.zeros((len(names), sites), np.int64)
    for s, p in enumerate(priors):
        order = sorted(p)
        total = sum(p.values())
        q[s, : len(order)] = [p[a] / total for a in order]
        code = {a: k + 1 for k, a in enumerate(order)} | {0: 0, "?": MISSING, None: MISSING, -1: SILENCED}
        states[:, s] = [code[rows[n][s]] for n in names]
    return Data(names, states, q)


def _emission(tree: Tree, data: Data, phi: float) -> dict[int, np.ndarray]:
    """(sites, 2 + k) for each leaf; columns are 0, silenced, alphabet."""
    row = {n: i for i, n in enumerate(data.names)}
    sites, k = data.q.shape
    out = {}
    for leaf in tree.leaves.tolist():
        code = data.states[row[tree.label[leaf]]]
        e = np.zeros((sites, k + 2))
        known = code >= 0
        column = np.where(code == 0, 0, code + 1)
        e[np.flatnonzero(known), column[known]] = 1 - phi
        e[code == MISSING] = phi
        e[code == MISSING, 1] = 1.0
        e[code == SILENCED, 1] = 1.0
        out[leaf] = e
    return out


def _up(inside: np.ndarray, q: np.ndarray, d: float, nu: float) -> np.ndarray:
    """The value of each state at the top of an edge."""
    p, pv = np.exp(-d), np.exp(-d * nu)
    lost = (1 - pv) * inside[:, 1:2]
    out = pv * inside + lost
    out[:, 1] = inside[:, 1]
    out[:, 0] = p * pv * inside[:, 0] + pv * (1 - p) * (q * inside[:, 2:]).sum(1) + lost[:, 0]
    return out


def _inside(tree: Tree, data: Data, d: np.ndarray, nu: float, phi: float):
    emission, kids = _emission(tree, data, phi), tree.children
    inside, message, scale = [None] * len(d), [None] * len(d), np.zeros(len(data.q))
    for i in range(len(d)):
        x = emission[i] if not kids[i] else np.prod([message[k] for k in kids[i]], axis=0)
        top = x.max(1)
        top[top == 0] = 1.0
        inside[i] = x / top[:, None]
        scale += np.log(top)
        message[i] = _up(inside[i], data.q, d[i], nu)
    with np.errstate(divide="ignore"):
        return inside, message, scale + np.log(message[-1][:, 0])


def nllh(tree: Tree, data: Data, nu: float, phi: float) -> float:
    return float(-_inside(tree, data, tree.length, nu, phi)[2].sum())


def expectations(tree: Tree, data: Data, nu: float, phi: float):
    """(S of shape (nodes, 5), expected dropouts, number of observed leaf states, nllh).

    S counts, over sites, 0 kept, 0 mutated, 0 silenced, mutation kept, mutation silenced on each edge.
    """
    d, kids = tree.length, tree.children
    inside, message, site = _inside(tree, data, d, nu, phi)
    n, (sites, k) = len(d), data.q.shape
    above, s, dropouts = [None] * n, np.zeros((n, 5)), 0.0
    above[n - 1] = np.zeros((sites, k + 2))
    above[n - 1][:, 0] = 1.0
    row = {name: i for i, name in enumerate(data.names)}
    for i in reversed(range(n)):
        p, pv, u, x = np.exp(-d[i]), np.exp(-d[i] * nu), above[i], inside[i]
        parts = [u[:, 0] * p * pv * x[:, 0], u[:, 0] * pv * (1 - p) * (data.q * x[:, 2:]).sum(1), u[:, 0] * (1 - pv) * x[:, 1], pv * (u[:, 2:] * x[:, 2:]).sum(1), (1 - pv) * u[:, 2:].sum(1) * x[:, 1]]
        total = sum(parts) + u[:, 1] * x[:, 1]
        s[i] = [(part / total).sum() for part in parts]
        # outside at the bottom of the edge
        down = pv * u
        down[:, 0] = p * pv * u[:, 0]
        down[:, 1] = u[:, 1] + (1 - pv) * (u[:, 0] + u[:, 2:].sum(1))
        down[:, 2:] += pv * (1 - p) * u[:, :1] * data.q
        if not kids[i]:
            post = down * x
            post /= post.sum(1, keepdims=True)
            dropouts += (1 - post[data.states[row[tree.label[i]]] == MISSING, 1]).sum()
        for c in kids[i]:
            rest = down.copy()
            for other in kids[i]:
                if other != c:
                    rest *= message[other]
            above[c] = rest / rest.max(1, keepdims=True)
    return s, float(dropouts), int((data.states >= 0).sum()), float(-site.sum())


def _slopes(s, d, nu):
    """First and second derivatives of the expected log-likelihood in each length."""
    lost = s[:, 2] + s[:, 4]
    a, b = np.expm1(d), np.expm1(np.maximum(nu * d, 1e-300))
    first = -(1 + nu) * s[:, 0] - nu * (s[:, 1] + s[:, 3]) + s[:, 1] / a + (nu * lost / b if nu > 0 else 0)
    second = -s[:, 1] * np.exp(d) / a**2 - (nu**2 * lost * np.exp(nu * d) / b**2 if nu > 0 else 0)
    return first, second


def best_lengths(s: np.ndarray, nu: float, least: float = LEAST, most: float = MOST) -> np.ndarray:
    """Each edge's best length by itself: bisection on the falling derivative, all edges at once."""
    low, high = np.full(len(s), least), np.full(len(s), most)
    for _ in range(60):
        mid = (low + high) / 2
        up = _slopes(s, mid, nu)[0] > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2


def best_heights(tree: Tree, s: np.ndarray, nu: float, d: np.ndarray, least: float = LEAST) -> np.ndarray:
    """Best lengths when all leaves lie equally deep: Newton on the heights of inner nodes with a log barrier.

    d must satisfy the constraint with every length above least.
    """
    n, leaves = len(d), tree.leaves
    inner = np.setdiff1d(np.arange(n), leaves)
    column = {int(i): k for k, i in enumerate(inner)}
    top = len(inner)  # the start of the root's edge
    incidence = np.zeros((n, top + 1))
    for i in range(n):
        incidence[i, column[int(tree.parent[i])] if tree.parent[i] >= 0 else top] += 1
        if i in column:
            incidence[i, column[i]] -= 1

    def value(x, mu):
        if (x <= least).any():
            return -np.inf
        lost = s[:, 2] + s[:, 4]
        out = -(1 + nu) * s[:, 0] * x - nu * (s[:, 1] + s[:, 3]) * x + s[:, 1] * np.log(-np.expm1(-x))
        if nu > 0:
            out += lost * np.log(-np.expm1(-nu * x))
        return (out + mu * np.log(x - least)).sum()

    for mu in (1e-1, 1e-3, 1e-5, 1e-7):
        for _ in range(12):
            first, second = _slopes(s, d, nu)
            g = incidence.T @ (first + mu / (d - least))
            h = incidence.T @ ((second - mu / (d - least) ** 2)[:, None] * incidence)
            step = incidence @ np.linalg.solve(-h + 1e-12 * np.eye(len(h)), g)
            size, now = 1.0, value(d, mu)
            while size > 1e-10 and value(d + size * step, mu) < now:
                size /= 2
            d = d + size * step if size > 1e-10 else d
            if np.abs(size * step).max() < 1e-7:
                break
    return d


def best_nu(s: np.ndarray, d: np.ndarray) -> float:
    lost, kept = s[:, 2] + s[:, 4], s[:, 0] + s[:, 1] + s[:, 3]
    if lost.sum() <= 1e-12:
        return 0.0
    low, high = 1e-9, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (-d * kept + lost * d / np.expm1(mid * d)).sum() > 0 else (low, mid)
    return (low + high) / 2


def fit(tree: Tree, data: Data, nu: float | None = None, phi: float | None = None, start: tuple[float, float] = (0.3, 0.3), ultrametric: bool = False, free: np.ndarray | None = None, tolerance: float = 1e-8, most_rounds: int = 1000) -> Fit:
    """Expectation-maximisation of lengths, nu and phi; nu or phi stay where given; free masks the lengths to change."""
    fix_nu, fix_phi = nu is not None, phi is not None
    nu, phi = (nu if fix_nu else start[0]), (phi if fix_phi else start[1])
    has_missing = bool((data.states == MISSING).any())
    phi = phi if fix_phi or has_missing else 0.0
    length = np.clip(np.nan_to_num(tree.length, nan=0.1), LEAST * 1.01, MOST)
    if ultrametric:
        length = _levelled(tree)
    tree = Tree(tree.parent, length, tree.label)
    trace = []
    for rounds in range(most_rounds):
        s, dropouts, observed, now = expectations(tree, data, nu, phi)
        trace.append(now)
        if rounds and abs(trace[-2] - now) <= tolerance * abs(trace[-2]):
            break
        if not fix_phi and has_missing:
            phi = dropouts / (dropouts + observed)
            phi = 0.0 if phi < 1 / data.states.size else phi
        d = best_heights(tree, s, nu, tree.length) if ultrametric else best_lengths(s, nu)
        tree = Tree(tree.parent, d if free is None else np.where(free, d, tree.length), tree.label)
        if not fix_nu:
            nu = best_nu(s, tree.length)
    return Fit(tree, nu, phi, trace[-1], len(trace), trace)


def _levelled(tree: Tree, total: float = 1.0) -> np.ndarray:
    """Lengths that put all leaves at depth total: inner nodes are spread by their number of levels below."""
    below = np.zeros(len(tree.parent))
    for i, p in enumerate(tree.parent[:-1]):
        below[p] = max(below[p], below[i] + 1)
    unit = total / (below[-1] + 1)
    return np.array([unit * ((below[p] if p >= 0 else below[-1] + 1) - below[i]) for i, p in enumerate(tree.parent)])
