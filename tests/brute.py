"""Plain Python solvers that results are held against."""

from __future__ import annotations


def components(edges, nodes=()):
    up = {v: v for v in nodes} | {v: v for e in edges for v in e}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {v: top(v) for v in up}


def minimum_forest(edges):
    """Edges (small, large) in ascending order, but for those that close a cycle."""
    out = []
    for e in sorted({(min(x), max(x)) for x in edges if x[0] != x[1]}):
        top = components(out, e)
        if top[e[0]] != top[e[1]]:
            out.append(e)
    return out


def bridges(edges):
    """Undirected edges {a, b} without which more components are left; parallel edges count as one."""
    simple = {frozenset(e) for e in edges if e[0] != e[1]}
    nodes = {v for e in simple for v in e}
    n = len(set(components([tuple(e) for e in simple], nodes).values()))
    return {e for e in simple if len(set(components([tuple(x) for x in simple - {e}], nodes).values())) > n}


def ancestors(parent, v):
    out = [v]
    while parent[out[-1]] is not None:
        out.append(parent[out[-1]])
    return out


def lca(parent, x, y):
    above = set(ancestors(parent, x))
    return next(v for v in ancestors(parent, y) if v in above)


def tour(edges, root):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    near = {v: sorted(x) for v, x in near.items()}
    a, b, out = root, near[root][0], []
    while not out or (a, b) != out[0]:
        out.append((a, b))
        x = near[b]
        a, b = b, x[(x.index(a) + 1) % len(x)]
    return {e: i for i, e in enumerate(out)}


def distances(edges, start):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, front = {start: 0}, [start]
    while front:
        front = [w for v in front for w in near.get(v, ()) if w not in seen and not seen.update({w: seen[v] + 1})]
    return seen
