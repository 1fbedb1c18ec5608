"""Plain forms of what operators compute, for small inputs."""

import numpy as np

from parcelfusion.llm.decontam import fitting_edits, words

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = (text or "").translate(UPPER).encode().split()
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if w else set()


def near_components(rows, width, percent):
    """Component number of every row (id, text, ...)."""
    sets = [shingles(r[1], width) for r in rows]
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(v) for v in range(len(rows))]


def brute_contaminated(texts, items, percent=20):
    """Whether each text holds an item within ``percent`` word edits."""
    vocabulary = {}
    code = lambda t: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(t)], np.int64)
    coded = [x for x in map(code, items) if len(x)]
    found = []
    for t in texts:
        text = code(t)
        found.append(any(len(text) and 100 * fitting_edits(x, text)[0] <= percent * len(x) for x in coded))
    return found


def sizes(rows, targets=False):
    """Words of each source, or their targets."""
    out = {}
    for r in rows:
        out[r[3]] = out.get(r[3], 0) + len((r[1] or "").encode().split())
    if not targets:
        return out
    order = sorted(out, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, open_, target = sum(out.values()), set(order), {}
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * out[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * out[s] for s in over}
        open_ -= over
    return target
