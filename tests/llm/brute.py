"""Mixing by brute force, for the tests of the operator and of the pipeline."""

import hashlib


def water_filled(budget, children):
    """Shares of (name, weight, capacity) by filling those of the least capacity over weight, the rest by running totals."""
    out, left = {}, sorted(children, key=lambda c: (c[2] / c[1], c[0]))
    while left and budget * left[0][1] >= left[0][2] * sum(w for _, w, _ in left):
        name, _, capacity = left.pop(0)
        out[name] = capacity
        budget -= capacity
    total, upto = sum(w for _, w, _ in left), 0
    for name, weight, _ in left:
        out[name] = budget * (upto + weight) // total - budget * upto // total
        upto += weight
    return out


def mixed(ids, paths, tokens, weights, share, max_epochs=2, seed=17, levels=("domain", "lang", "source")):
    """(budget of each path, times that each row is taken); rows of one leaf, id and size are interchangeable."""
    capacity: dict = {}
    for p, n in zip(paths, tokens, strict=True):
        for d in range(len(levels) + 1):
            capacity[p[:d]] = capacity.get(p[:d], 0) + max_epochs * n
    budgets = {(): min(int(sum(tokens) * share), capacity[()])}
    for d, level in enumerate(levels):
        for parent in sorted({p[:d] for p in paths}):
            names = sorted({p[d] for p in paths if p[:d] == parent})
            found = water_filled(budgets[parent], [(n, weights.get(f"{level}={n}", 1), capacity[*parent, n]) for n in names])
            budgets |= {(*parent, n): b for n, b in found.items()}
    times = [0] * len(ids)
    for leaf in set(paths):
        own, supply = [i for i, p in enumerate(paths) if p == leaf], capacity[leaf] // max_epochs
        whole, run = budgets[leaf] // supply if supply else 0, 0
        rank = {i: hashlib.md5("|".join([str(seed), *leaf, str(whole), "" if ids[i] is None else str(ids[i])]).encode()).hexdigest()[:16] for i in own}
        for i in sorted(own, key=lambda i: (rank[i], tokens[i])):
            run += tokens[i]
            times[i] = whole + (run <= budgets[leaf] - whole * supply and tokens[i] > 0)
    return budgets, times
