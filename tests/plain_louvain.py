"""Louvain node after node in plain Python, and modularity: what the way over tables is compared with."""

from collections import defaultdict


def louvain(pairs: list[tuple[str, str, float]], resolution: float = 1.0) -> dict[str, int]:
    """node -> community, by moves of strictly positive gain in node order, then folding, until nothing moves."""
    names = sorted({x for a, b, _ in pairs for x in (a, b)})
    at = {n: i for i, n in enumerate(names)}
    graph: dict[int, dict[int, float]] = {i: {} for i in range(len(names))}
    for a, b, w in pairs:
        for x, y in {(at[a], at[b]), (at[b], at[a])}:
            graph[x][y] = graph[x].get(y, 0.0) + w
    label = list(range(len(names)))
    while graph:
        total = sum(sum(v.values()) + v.get(i, 0.0) for i, v in graph.items())
        degree = {i: sum(v.values()) + v.get(i, 0.0) for i, v in graph.items()}
        home, load, moved, again = {i: i for i in graph}, dict(degree), False, True
        while again and total:
            again = False
            for i in sorted(graph):
                own = home[i]
                load[own] -= degree[i]
                link: dict[int, float] = defaultdict(float)
                for j, w in graph[i].items():
                    if j != i:
                        link[home[j]] += w
                gain = {c: w - resolution * load[c] * degree[i] / total for c, w in link.items()}
                stay = gain.get(own, -resolution * load[own] * degree[i] / total)
                best = min(gain, key=lambda c: (-gain[c], c), default=own)
                if gain.get(best, stay) > stay + 1e-12:
                    home[i], moved, again = best, True, True
                load[home[i]] += degree[i]
        if not moved:
            break
        fresh = {c: k for k, c in enumerate(sorted(set(home.values())))}
        label = [fresh[home[x]] for x in label]
        folded: dict[int, dict[int, float]] = {k: {} for k in fresh.values()}
        for i, v in graph.items():
            for j, w in v.items():
                if i <= j:
                    x, y = sorted((fresh[home[i]], fresh[home[j]]))
                    for p, q in {(x, y), (y, x)}:
                        folded[p][q] = folded[p].get(q, 0.0) + w
        graph = folded
    order: dict[int, int] = {}
    return {n: order.setdefault(label[i], len(order)) for i, n in enumerate(names)}


def modularity(pairs: list[tuple[str, str, float]], label: dict[str, int]) -> float:
    total, inside, load = 0.0, 0.0, defaultdict(float)
    for a, b, w in pairs:
        total += 2 * w
        inside += 2 * w * (label[a] == label[b])
        load[label[a]] += w
        load[label[b]] += w
    return inside / total - sum(x * x for x in load.values()) / total**2 if total else 0.0
