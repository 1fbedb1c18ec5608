import hashlib
import random
import zlib

import numpy as np

from parcelfusion.llm.mixing import mix, mixed_documents, offsets
from parcelfusion.llm.sharding import communication_matrix, hypergeometric, shard


def rows(n=400):
    rng = random.Random(3)
    pick = lambda: rng.choices(["big", "b", "É", "", None, "tiny"], [50, 10, 5, 5, 5, 1])[0]
    out = [(i, " ".join("w" for _ in range(rng.randrange(0, 40))), pick()) for i in range(n)]
    return out + [(n, None, "b"), (n + 1, "w " * 5000, "big"), (n + 2, "w", "tiny"), (5, out[5][1], out[5][2])]


def water_fill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return target


def fair_queue(data):
    """Brute force: (doc_id, text) -> words taken, and how often the document stands before the cut or across it."""
    size = lambda t: len((t or "").split())
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = water_fill(sizes)
    key = lambda r: (hashlib.md5(f"mix:{r[0]}".encode()).hexdigest(), r[0])
    copies, done = [], {}
    for k, (i, t, s) in sorted(enumerate(data), key=lambda e: key(e[1])):
        done[s] = done.get(s, 0) + size(t)
        for turn in range(3 if want[s] else 1):
            finish = (done[s] + turn * sizes[s]) / want[s] if want[s] else 0.0
            copies.append((finish, (s is None, s or ""), *key((i, t, s)), turn, k, size(t)))
    budget, running, taken, often = sum(sizes.values()), 0, {}, {}
    for *_, k, n in sorted(copies, key=lambda c: c[:5]):
        if running >= budget:
            break
        taken[k] = taken.get(k, 0) + min(n, budget - running)
        often[k] = often.get(k, 0) + 1
        running += n
    return want, sizes, taken, often


def test_mix_against_a_queue(documents):
    data = rows()[:-1]  # without the repeated row
    want, sizes, taken, _ = fair_queue(data)
    got = {r.doc_id: r for r in mix(documents(data)).collect()}
    assert len(got) == len(data)
    for k, (i, _, s) in enumerate(data):
        r = got[i]
        assert abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and r.taken == taken.get(k, 0) <= 3 * r.size
    assert sum(r.taken for r in got.values()) == sum(sizes.values())
    assert sorted(map(tuple, got.values()), key=str) == sorted(map(tuple, mix(documents(data).repartition(7)).collect()), key=str)


def test_mix_of_odd_tables(spark, documents):
    assert mix(documents([])).count() == 0 == mixed_documents(documents([])).count()
    assert [r.taken for r in mix(documents([(1, None, "a"), (2, "", None)])).collect()] == [0, 0]
    assert mixed_documents(documents([(1, None, "a"), (2, "", None)])).count() == 2
    again = documents(rows())
    assert mix(again).count() == len(rows()) and again.columns == mixed_documents(again).columns
    nulls = spark.createDataFrame([(None, f"w {k}", "s") for k in range(50)] + [(None, "w w", None)] * 2, "doc_id long, text string, source string")
    assert mix(nulls).agg({"taken": "sum"}).first()[0] == 104 and mix(nulls).count() == 52


def test_mixed_documents(documents):
    data = rows()[:-1]
    *_, often = fair_queue(data)
    counts = {r.doc_id: r["count"] for r in mixed_documents(documents(data)).groupBy("doc_id").count().collect()}
    want = {data[k][0]: n for k, n in often.items()}
    # Wordless documents at the very place of the cut may fall on either side of it.
    assert {i: n for i, n in counts.items() if data[i][1]} == {i: n for i, n in want.items() if data[i][1]}


def test_shard(documents):
    data = rows(1500)
    for how in ({}, {"keep_columns": True}):
        df = shard(documents(data), 24, **how)
        got = df.collect()
        assert len(got) == len(data)
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r.slot)
        assert set(by) == set(range(24)) and {len(v) for v in by.values()} <= {len(data) // 24, len(data) // 24 + 1}
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        text = {i: t or "" for i, t, _ in data}
        assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.grown_shard is None for r in got)
    assert {"text", "source", "document_size", "bucket"} <= set(df.columns) and {r.document_size for r in df.collect()} == {1}
    again = shard(documents(data).repartition(5), 24).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in again) == sorted((r.doc_id, r.shard, r.slot) for r in got)
    assert shard(documents([]), 24).count() == 0 and shard(documents(data[:3]), 24).count() == 3


def test_matrix_is_exact_and_uniform():
    counts = [7, 0, 30, 1, 12]
    m = np.array(communication_matrix(counts, 4, 1))
    assert m.sum(axis=1).tolist() == counts and sorted(m.sum(axis=0)) == [12, 12, 13, 13]
    rng = np.random.default_rng(0)
    draws = np.array([hypergeometric(30, 50, 20, u) for u in rng.random(20_000)])
    real = rng.hypergeometric(30, 50, 20, 20_000)
    assert abs(draws.mean() - 7.5) < 0.05 and abs(draws.std() - real.std()) < 0.05
    assert hypergeometric(10**11, 10**11, 10**6, 0.5) in range(499_000, 501_000)


def test_offsets_by_levels(spark):
    """Bucket offsets added up by prefixes are those of one running sum, whatever the number of digits."""
    rng = np.random.default_rng(3)
    data = sorted({(str(s), f"{b:05x}") for s, b in zip(rng.integers(0, 3, 600), rng.integers(0, 1 << 20, 600), strict=True)})
    sizes = rng.integers(0, 9, len(data)).tolist()
    rows = [(s, b, n) for (s, b), n in zip(data, sizes, strict=True)]
    want, done = {}, {}
    for s, b, n in rows:
        want[s, b] = done.get(s, 0)
        done[s] = want[s, b] + n
    df = spark.createDataFrame(rows, "src string, bucket string, bucket_size long").repartition(3)
    for step in (1, 2, 3, 5, 7):
        assert {(r.src, r.bucket): r.offset for r in offsets(df, 5, step).collect()} == want


def test_shard_of_odd_tables(spark):
    """Null and repeated ids, repeated rows and very long texts all get a slot of their own."""
    long = "w " * 60_000
    df = spark.createDataFrame([(None, None)] * 40 + [(1, "same")] * 40 + [(2, long), (2, "é"), (3, "")], "doc_id long, text string")
    got = shard(df, 5).collect()
    assert len(got) == 83 and len({(r.shard, r.slot) for r in got}) == 83 and {r.law for r in got} == {"rows"}
    assert sorted(sum(r.shard == k for r in got) for k in range(5)) == [16, 16, 17, 17, 17]
    assert {(r.doc_id, r.size) for r in got} == {(None, 8), (1, 12), (2, 120_008), (2, 10), (3, 8)}
