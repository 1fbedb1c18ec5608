import hashlib
import random

import numpy as np

from pyspark.sql import functions as F

from parcelfusion.llm import exact_dedup as X
from parcelfusion.llm import minhash as M
from parcelfusion.llm.components import connected_components
from parcelfusion.llm.exact_dedup import directory, exact_dedup, records

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(rows):
    by = {}
    for i, t, _ in rows:
        by.setdefault((t or "").translate(UPPER), []).append(i)
    return sorted((i, max(g), len(g), i == max(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in by.items() for i in g)


def exact_rows():
    rng = random.Random(2)
    rows = [(i, rng.choice(["Alpha", "alpha", "ÉCOLE", "école", "a\nb", "", "x" * 50_000, "beta " + str(rng.randrange(9))]), "s") for i in range(300)]
    return rows + [(300, None, None), (301, None, "s"), (7, rows[7][1], "s")]


def test_exact_against_brute_force(documents):
    rows = exact_rows()
    want = brute_exact(rows)
    ways = ({}, {"key_bits": 2, "capacity": 3}, {"key_bits": 8, "capacity": 1, "broadcast_rows": 0}, {"key_bits": 2, "digest_bytes": 0}, {"key_bits": 1, "digest_bytes": 0, "broadcast_rows": 0})
    for how in ways:
        got = exact_dedup(documents(rows), **how)
        assert sorted(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want
    assert exact_dedup(documents([])).count() == 0


def test_exact_null_and_long_ids(spark):
    big = 2**53 + 1
    rows = [(None, "a"), (big, "A"), (None, "alone"), (None, None), (None, ""), (big - 1, "b")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "keep_id", "group_size", "kept").collect()
    want = [(None, big, 2, False), (big, big, 2, True), (None, None, 1, True), (None, None, 2, True), (None, None, 2, True), (big - 1, big - 1, 1, True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_results_come_through_the_index(documents, monkeypatch):
    rows = exact_rows()
    real = X.directory

    def half(keys, capacity, *rest):
        return real(keys, capacity, *rest).where("bucket < 0")

    _, chains, index = X.build_index(documents(rows), capacity=2)
    assert index.select("bucket").distinct().count() > 1
    # Buckets are ranges of unsigned keys that don't overlap.
    ends = [(min(k), max(k)) for k in ([r.key % 2**64 for r in index.where(F.col("bucket") == b).collect()] for (b,) in index.select("bucket").distinct().collect())]
    assert all(a[1] < b[0] for a, b in zip(sorted(ends), sorted(ends)[1:], strict=False))
    assert index.count() == chains.count() == len({(t or "").translate(UPPER) for _, t, _ in rows})
    monkeypatch.setattr(X, "directory", half)  # a directory without slots: nothing is found any more
    assert exact_dedup(documents(rows)).where("group_size > 1").count() == 0


def test_directory_splits_only_overfull_buckets(documents):
    slots = directory(records(documents([(i, f"t{i}", "s") for i in range(500)])), 40).collect()
    held = {}
    for r in slots:
        held.setdefault((r.bucket, r.local_depth), 0)
    assert {r.local_depth for r in slots} <= {4, 5, 6} and len(held) > 12
    (whole,) = {r.local_depth for r in directory(records(documents([(1, "a", "s"), (2, "b", "s")])), 40).collect()}
    assert whole == 0


def shingles(text, width):
    w = (text or "").translate(UPPER).split(" ") if False else [x for x in (text or "").translate(UPPER).replace("\n", " ").replace("\t", " ").split(" ") if x]
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if w else set()


def brute_near(rows, width, percent):
    sets = {i: shingles(t, width) for i, t, _ in rows}
    root = {i: i for i in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def near_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["The", "of", "é"]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    rows, base = [], say(120)
    for i in range(90):  # a large group whose members lie at all distances around the threshold
        t = list(base)
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t), "s"))
    chain = say(200)
    for i in range(90, 110):  # neighbours are alike, the ends aren't
        chain = chain[4:] + say(4)
        rows.append((i, "\n".join(chain), "s"))
    rows += [(i, " ".join(say(rng.randrange(0, 6))), "s") for i in range(110, 160)] + [(i, " ".join(say(100)), "s") for i in range(160, 190)]
    return rows + [(190, None, None), (191, " \t\n", "s"), (192, rows[3][1].upper(), "s"), (193, "one", "s"), (194, "ONE", "s"), (195, " ".join(say(30_000)), "s")]


def test_near_against_brute_force(documents):
    rows = near_rows()
    for width in (2, 5):
        got = sorted(tuple(r) for r in M.near_duplicates(documents(rows), width, 80).collect())
        assert got == brute_near(rows, width, 80)
    assert M.near_duplicates(documents([])).count() == 0


def test_one_of_each(documents):
    rows = near_rows() + [(193, "one", "s")]
    kept = M.one_of_each(documents(rows), 5, 80)
    assert kept.columns == documents(rows[:1]).columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted([i for i, _, _, k in brute_near(near_rows(), 5, 80) if k])


def test_near_null_and_repeated_ids(spark):
    big = 2**53 + 1
    text = " ".join(f"w{k}" for k in range(40))
    other, third = " ".join(f"v{k}" for k in range(40)), " ".join(f"u{k}" for k in range(40))
    rows = [(None, text), (big, text + " x"), (1, other), (1, third), (None, "alone here"), (None, third + " y"), (2, text), (2, text), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in M.near_duplicates(docs, 5, 80).collect())))
    n = 36
    want = [(None, n, 2, False), (big, n + 1, 2, False), (1, n, 1, True), (1, n, 1, True), (None, 1, None, True), (None, n + 1, 1, False), (2, n, 2, True), (2, n, 2, True), (None, 0, None, True), (None, 0, None, True)]
    assert got == sorted(map(str, want))
    kept = sorted(map(str, (tuple(r) for r in M.one_of_each(docs, 5, 80).collect())))
    assert kept == sorted(map(str, [(2, text), (1, other), (1, third), (None, "alone here"), (None, None), (None, "")]))


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for similar in (0.6, 0.8, 0.95):
        both = int(2000 * 2 * similar / (1 + similar))
        a, b = pool[:2000], pool[2000 - both : 4000 - both]
        sk = M.sketches(np.array([M.samples(np.sort(a)), M.samples(np.sort(b))]))
        assert abs(M.estimate(sk[0], sk[1]) - both / (4000 - both)) < 0.12


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5)] + [(i, i + 1) for i in range(100, 160)] + [(50, k) for k in range(60, 90)]
    got = {r.v: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {i: 100 for i in range(100, 161)} | {k: 50 for k in (50, *range(60, 90))}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
