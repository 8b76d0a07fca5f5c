"""Graph edit distance of small graphs: nodes of unlike kind cost 1 to exchange, insertions and deletions cost 1.

Branch and bound over the assignment of the first graph's nodes, with an admissible bound
from the kinds still open.  Effort is counted in expansions, not seconds, so a result
is the same everywhere; if they run out the best bound so far is returned and marked.
"""

from __future__ import annotations

from collections import Counter

from .graphs import Graph


def distance(a: Graph, b: Graph, most: int = 200_000) -> tuple[int, bool]:
    """(distance or an upper bound of it, whether the search was cut short)."""
    if len(a.nodes) > len(b.nodes):
        a, b = b, a
    ka, kb = sorted(a.nodes, key=lambda k: -len(a.out[k]) - len(a.into[k])), list(b.nodes)
    na, nb = len(ka), len(kb)
    kinds_a, kinds_b = [a.nodes[k].kind for k in ka], [b.nodes[k].kind for k in kb]
    at_a, at_b = {k: i for i, k in enumerate(ka)}, {k: i for i, k in enumerate(kb)}
    out_a, out_b = [[False] * na for _ in ka], [[False] * nb for _ in kb]
    for k in ka:
        for x in a.out[k]:
            out_a[at_a[k]][at_a[x]] = True
    for k in kb:
        for x in b.out[k]:
            out_b[at_b[k]][at_b[x]] = True
    edges_b = b.n_edges
    # edges of a among the nodes from i on, and between them and earlier ones
    open_a = [sum(out_a[x][y] for x in range(na) for y in range(na) if x >= i or y >= i) for i in range(na + 1)]
    rest_kinds = [Counter(kinds_a[i:]) for i in range(na + 1)]
    best = na + nb + a.n_edges + edges_b
    left = most
    used = [False] * nb
    to = [-1] * na

    def bound(i: int, free: Counter, n_free: int, covered: int) -> int:
        """At least so much more is to come: kinds that can't be matched, and edge counts that differ."""
        same = sum((rest_kinds[i] & free).values())
        return max(na - i, n_free) - same + abs(open_a[i] - (edges_b - covered))

    def search(i: int, cost: int, free: Counter, n_free: int, covered: int) -> None:
        nonlocal best, left
        if left <= 0 or cost + bound(i, free, n_free, covered) >= best:
            return
        left -= 1
        if i == na:
            best = min(best, cost + n_free + edges_b - covered)
            return
        choices = []
        for j in range(nb):
            if used[j]:
                continue
            more = kinds_a[i] != kinds_b[j]
            seen = int(out_b[j][j])
            more += out_a[i][i] != out_b[j][j]
            for x in range(i):
                y = to[x]
                for ea, eb in ((out_a[i][x], y >= 0 and out_b[j][y]), (out_a[x][i], y >= 0 and out_b[y][j])):
                    more += ea != eb
                    seen += eb
            choices.append((more, j, seen))
        for more, j, seen in sorted(choices):
            used[j], to[i] = True, j
            kind = kinds_b[j]
            free[kind] -= 1
            search(i + 1, cost + more, free, n_free - 1, covered + seen)
            free[kind] += 1
            used[j], to[i] = False, -1
        gone = 1 + out_a[i][i] + sum(out_a[i][x] + out_a[x][i] for x in range(i))
        search(i + 1, cost + gone, free, n_free, covered)

    search(0, 0, Counter(kinds_b), nb, 0)
    return best, left <= 0


def similarity(a: Graph, b: Graph, most: int = 200_000) -> dict:
    ged, cut = distance(a, b, most)
    norm = max(len(a.nodes), len(b.nodes)) + max(a.n_edges, b.n_edges)
    return {"ged": float(ged), "similarity_normalized": round(1 - ged / norm, 4) if norm else 1.0, "similarity_inverse": round(1 / (1 + ged), 4), "timed_out": cut}
