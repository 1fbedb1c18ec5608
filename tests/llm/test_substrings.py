import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from parcelfusion.llm import substrings, wordruns
from parcelfusion.llm.substrings import digests, substring_dedup


def brute(rows, width):
    """(id, n words, n removed, sha of what stays) of every row; equal rows are one document."""
    first = {}
    order = lambda r: (r[0] is None, r[0] or 0)
    for r in rows:
        w = (r[1] or "").encode().split()
        for i in range(len(w) - width + 1):
            key, at = tuple(w[i : i + width]), (order(r), i)
            first[key] = min(first.get(key, at), at)
    out = []
    for r in rows:
        w = (r[1] or "").encode().split()
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < (order(r), i) for j in range(i, i + width)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(n, seed, words=40):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(n):
        w = [f"w{rng.randrange(words)}" for _ in range(rng.choice([0, 3, 19, 20, 21, 80, 150]))]
        if i % 3 == 0:
            a = rng.randrange(40)
            w[10:10] = passage[a : a + rng.randrange(5, 60)]
        if i % 7 == 0 and rows:
            w = w[:5] + rows[rng.randrange(len(rows))][1].split() + w[5:]
        if i % 11 == 0:
            w = (["same", "line"] * 30)[: rng.randrange(60)]
        rows.append((i, rng.choice([" ", "  \t", "\n"]).join(w), None))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [3, 1 << 15])
@pytest.mark.parametrize("run", [300, 1 << 22])
def test_against_brute_force(spark, documents, monkeypatch, hot, run):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "BUCKET", 500)
    monkeypatch.setattr(wordruns.runs, "__defaults__", (None, run))
    rows = corpus(120, 3)
    found = digests(substring_dedup(documents(rows).repartition(5), 20)).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, 20)


def test_edges(spark, documents):
    long = " ".join(f"x{i % 90}" for i in range(30_000))
    rows = [(1, None, None), (2, "", None), (3, "a b", None), (None, long, None), (4, long, None), (5, "é " * 25, None), (5, "é " * 25, None), (6, " ".join("abcdefghijklmnopqrstuvwxyz"), None), (None, "x " + " ".join("abcdefghijklmnopqrstuvwxyz"), None)]
    found = substring_dedup(documents(rows), 20)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_text"]
    assert sorted(map(tuple, digests(found).collect()), key=str) == brute(rows, 20)
    assert substring_dedup(documents(rows).where("false"), 20).collect() == []
    assert sorted(map(tuple, digests(substring_dedup(documents(rows), 2)).collect()), key=str) == brute(rows, 2)
    with pytest.raises(ValueError):
        substring_dedup(documents(rows), 0)


def test_one_id_with_several_texts(documents):
    """They go by the hash of their text: one of them keeps the passage."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(7, f"{passage} a{k}", None) for k in range(4)] + [(None, f"{passage} n{k}", None) for k in range(4)]
    found = {r.kept_text: r.n_removed for r in substring_dedup(documents(rows), 20).collect()}
    assert sorted(found.values()) == [0] + [30] * 7
    assert any(k.startswith("p0") and " a" in k for k in found)


def test_equal_windows_are_told_by_words():
    """Windows whose hashes collide are compared word by word and numbered apart."""
    code = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 1, 2, 3])
    place = np.array([0, 3, 6, 9])
    assert substrings.standing(code, place, np.zeros(4, np.uint64), 3, [np.array([5, 6, 7, 7])]).tolist() == [0, 0, 1, 2]
    assert substrings.standing(code, place, np.zeros(4, np.uint64), 3, [np.array([7, 6, 7, 5])]).tolist() == [1, 0, 2, 0]


def test_super_k_mers_hold_every_travelling_window(spark, documents):
    """Consecutive windows of a minimiser travel together, and each bucket gets all windows of its keys."""
    rows = corpus(60, 5)
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "print": [hash(r[1]) for r in rows], "text": [r[1].encode() for r in rows]})
    sent = list(substrings.travelling(iter([batch]), 20, np.full(16, (1 << 64) - 1, np.uint64), np.zeros(16, np.uint64)))
    packed = [p for b in sent for p in b.column("packed").to_pylist() if p]
    seen = [tuple(w[i : i + 20]) for w in (p.split() for p in packed) for i in range(len(w) - 19)]
    every = {tuple(w[i : i + 20]) for w in (r[1].encode().split() for r in rows) for i in range(len(w) - 19)}
    assert len(seen) == len(set(seen)) and set(seen) == every
    assert len(packed) < len(seen) / 3
    keys = {}
    for b in sent:
        for k, p in zip(b.column("key").to_pylist(), b.column("packed").to_pylist(), strict=True):
            for i in range(len(p.split()) - 19 if p else 0):
                keys.setdefault(tuple(p.split()[i : i + 20]), set()).add(k)
    assert all(len(k) == 1 for k in keys.values())


def test_long_texts_are_cut_behind_words():
    text = b" ".join(b"%d" % i for i in range(5000)) + b" " + b"y" * 700 + b" z"
    found = list(wordruns.runs(pa.array([b"a b", text, None, b"c"]), substrings.BLANKS, 19, size=500))
    words = {}
    for r in found:
        names = np.array(r.vocabulary.to_pylist(), object)[r.code]
        for row, at, name in zip(r.row.tolist(), r.at.tolist(), names.tolist(), strict=True):
            assert words.setdefault((row, at), name) == name
    assert [words[1, i] for i in range(5002)] == text.split() and words[0, 1] == b"b" and words[3, 0] == b"c"
    assert len(words) == 5005
