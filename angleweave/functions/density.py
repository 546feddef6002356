"""Hierarchical density clustering of a few rows in numpy alone; what the distributed clusters are held against."""

from __future__ import annotations


def spanning_tree(x, core):
    """Edges (weight, a, b), a < b, of the least spanning tree of mutual reachability, lightest first; equal weights go by ids."""
    import numpy as np

    a, b = np.triu_indices(len(x), 1)
    w = np.maximum(np.sqrt(((x[a] - x[b]) ** 2).sum(axis=1)), np.maximum(core[a], core[b]))
    top, edges = list(range(len(x))), []

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for k in np.lexsort((b, a, w)):
        i, j = find(a[k]), find(b[k])
        if i != j:
            top[j] = i
            edges.append((float(w[k]), int(a[k]), int(b[k])))
            if len(edges) == len(x) - 1:
                break
    return edges


def core_distances(x, k: int):
    """Distance to the k-th other point."""
    import numpy as np

    out = np.empty(len(x))
    for s in range(0, len(x), 512):
        d = ((x[s : s + 512, None, :] - x[None, :, :]) ** 2).sum(axis=2)
        out[s : s + 512] = np.sqrt(np.partition(d, k, axis=1)[:, k])
    return out


def hdbscan(x, least: int = 50, k: int = 10):
    """Labels by excess of mass; -1 is noise. Fewer than 2 * least points are all noise, as a root is never chosen."""
    import numpy as np

    n = len(x)
    if n < 2 * least or n <= k:
        return np.full(n, -1)
    parts, weight, size, top = {}, {}, {i: 1 for i in range(n)}, list(range(n))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    holder = list(range(n))
    for step, (w, a, b) in enumerate(spanning_tree(x, core_distances(x, k))):
        a, b, new = find(a), find(b), n + step
        parts[new], weight[new] = (holder[a], holder[b]), max(w, 1e-12)
        size[new] = size[holder[a]] + size[holder[b]]
        top[b] = a
        holder[a] = new

    def leaves(node):
        todo = [node]
        while todo:
            i = todo.pop()
            if i < n:
                yield i
            else:
                todo.extend(parts[i])

    owner, mass, parent, birth = np.zeros(n, int), [0.0], [-1], [0.0]
    todo = [(2 * n - 2, 0)]
    while todo:
        node, cluster = todo.pop()
        if node < n:
            owner[node] = cluster
            continue
        lam = 1.0 / weight[node]
        big = [c for c in parts[node] if size[c] >= least]
        for c in parts[node]:
            if len(big) == 2:
                mass[cluster] += size[c] * (lam - birth[cluster])
                mass.append(0.0), parent.append(cluster), birth.append(lam)
                todo.append((c, len(mass) - 1))
            elif c in big:
                todo.append((c, cluster))
            else:
                mass[cluster] += size[c] * (lam - birth[cluster])
                owner[[*leaves(c)]] = cluster
    below, chosen = [0.0] * len(mass), [False] * len(mass)
    for c in range(len(mass) - 1, 0, -1):
        chosen[c] = mass[c] >= below[c]
        below[parent[c]] += max(mass[c], below[c])
    name, final = {}, [-1] * len(mass)
    for c in range(1, len(mass)):
        # The highest chosen ancestor counts; parents come before their children.
        final[c] = final[parent[c]] if final[parent[c]] >= 0 else name.setdefault(c, len(name)) if chosen[c] else -1
    return np.array(final)[owner]
