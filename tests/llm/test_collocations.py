import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from parcelfusion.llm import collocations as C
from parcelfusion.llm import wordruns
from parcelfusion.llm.collocations import collocations, frequent_phrases
from parcelfusion.llm.common import arrow_batches

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, size):
    """Occurrences of every phrase by language, '' for all words."""
    f = defaultdict(Counter)
    for _, lang, text in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            w = re.findall(r"[^ \t]+", piece)
            f[lang or "und"][""] += len(w)
            for m in range(1, size + 1):
                f[lang or "und"].update(" ".join(w[i : i + m]) for i in range(len(w) - m + 1))
    return f


def brute(rows, least, size, held, top):
    out = []
    for lang, f in plain_counts(rows, size).items():
        frequent = {p: n for p, n in f.items() if " " in p and n >= least}
        longer = Counter()
        for p, n in frequent.items():
            w = p.split(" ")
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    inner = " ".join(w[i : i + m])
                    longer[inner] = max(longer[inner], n)
        found = []
        for p, a in frequent.items():
            w = p.split(" ")
            cuts = []
            for k in range(1, len(w)):
                left, right = f[" ".join(w[:k])], f[" ".join(w[k:])]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            if 100 * longer[p] < held * a:
                found.append((-score, -a, p.encode(), p, left, right))
        out += [(lang, i, p, -a, left, right, f[""], -s) for i, (s, a, _, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(n, seed):
    rng = random.Random(seed)
    fixed = ["new york city", "Side By side", "per se", "ab ab ab ab", "naïve é ü"]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(40)):
            w += rng.choice(fixed).split() if rng.random() < 0.2 else [f"w{int(rng.paretovariate(0.7))}"]
        text = "".join(x + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " "]) for x in w)
        rows.append((i, rng.choice(["en", "de", None]), text))
    return rows


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame([(*r, "k", 1, "s") for r in rows], "doc_id long, lang string, text string, key string, size long, phrase string")


@pytest.mark.parametrize("run", [200, 1 << 22])
@pytest.mark.parametrize("sample", [0.0, 0.2, 1.0])
def test_against_brute_force(frame, monkeypatch, run, sample):
    """Whatever the sample proposes, also nothing, the result is the same."""
    monkeypatch.setattr(wordruns.runs, "__defaults__", (None, run))
    rows = corpus(150, 1)
    found = collocations(frame(rows), least=4, size=3, held=50, top=25, sample=sample)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, 4, 3, 50, 25)


def test_longer_phrases_and_repeated_rows(frame):
    rows = corpus(60, 2) * 2
    found = collocations(frame(rows), least=5, size=5, held=70, top=1000)
    assert sorted(map(tuple, found.collect())) == brute(rows, 5, 5, 70, 1000)


def test_full_filters_only_cost_work(frame, monkeypatch):
    """A filter in which every bit is set lets all phrases pass; counts stay exact."""
    monkeypatch.setattr(C, "bitmap", lambda df, bits: np.full(max(1, bits // 64), (1 << 64) - 1, np.uint64))
    rows = corpus(60, 3)
    assert sorted(map(tuple, collocations(frame(rows), 4, 3, 50, 100).collect())) == brute(rows, 4, 3, 50, 100)


def test_counts_of_all_frequent_phrases(frame):
    rows = corpus(80, 4)
    f = plain_counts(rows, 3)
    want = {(lang, p, n) for lang, c in f.items() for p, n in c.items() if n >= 4 or not p}
    assert {(r.lang, r.phrase, r.n) for r in frequent_phrases(frame(rows), 4, 3, sample=0.1).collect()} == want


def test_edges(frame):
    rows = [(1, None, None), (2, "en", ""), (3, None, " . "), (4, "fr", "a b"), (5, "fr", "A\tb ;a b\x0ba b"), (None, "fr", "x" * 5000 + " " + "y z " * 3000)]
    assert sorted(map(tuple, collocations(frame(rows), 3, 3, 50, 10).collect())) == brute(rows, 3, 3, 50, 10)
    assert collocations(frame(rows).where("false"), 3, 3, 50, 10).collect() == []


def test_scores_beyond_64_bits(spark):
    """The exact quotient of products that pass 64 bits."""
    a, left, right = 3_000_000_000, 4_000_000_001, 5_000_000_003
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(C.score("a", "l", "r").alias("s")).first()
    assert row.s == 1_000_000 * a * a // (left * right)


def test_passes_run_on_batches_of_bounded_bytes(spark, monkeypatch):
    """A batch of 10,000 long texts, held several times over, took an executor's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, during, write = spark.conf.get(name), [], C.stored
    monkeypatch.setattr(C, "stored", lambda df, path: (during.append(spark.conf.get(name)), write(df, path))[1])
    docs = spark.createDataFrame([(i, "en", "a long word " * 40) for i in range(50)], "doc_id long, lang string, text string")
    assert frequent_phrases(docs).count() > 0
    assert during and set(during) == {f"{C.BATCH}b"} and C.BATCH < wordruns.RUN
    assert spark.conf.get(name) == before


def test_arrow_batches_hold_few_bytes(spark):
    docs = spark.range(1000).coalesce(1).selectExpr("repeat('x', 1000) AS text")
    size = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    with arrow_batches(spark, 20_000):
        sizes = [r["n"] for r in docs.mapInArrow(size, "n long").collect()]
    assert len(sizes) >= 40 and max(sizes) <= 30_000
