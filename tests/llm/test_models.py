import random
import textwrap
import zlib

import numpy as np
import regex
from pyspark.sql import functions as F

from parcelfusion.llm import langid, licenses, quality
from parcelfusion.llm.common import stored
from parcelfusion.llm.urlfilter import url_filter

STEMS = {"en": ["the", "thing", "and", "ing", "shed"], "de": ["der", "und", "schaft", "keit", "über"], "fr": ["le", "eau", "é", "que", "ment"]}


def texts(n=240, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        say = lambda k, lang=lang: " ".join("".join(rng.choices(STEMS[lang], k=rng.randrange(1, 4))) for _ in range(k))
        out.append((i, say(rng.randrange(3, 80)), lang))
    return out


def test_language(spark):
    data = texts() + [(1000, None, "en"), (1001, "", "de"), (1002, "123 !!", "fr"), (1003, "the " * 30_000, None), (3, texts()[3][1], texts()[3][2])]
    df = spark.createDataFrame([(i, t, x, "score") for i, t, x in data], "doc_id long, text string, lang string, score string")
    got = langid.identify(df, docs_per_lang=40).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and by[1003].lang_pred == "en"
    held = [(x, by[i].lang_pred) for i, _, x in data[:240] if by[i].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    kept = langid.keep_identified(df, docs_per_lang=40)
    assert kept.columns == df.columns and kept.count() == len(data) - 3
    assert [r.lang_pred for r in langid.identify(df.where("lang is null")).collect()] == ["und"]
    assert langid.identify(df.limit(0)).count() == 0


def test_switched_words():
    docs = texts(300, 9)
    labels = sorted(STEMS)
    model = langid.Crf(labels, {})
    model.fit([(langid.tokens(t), labels.index(x)) for _, t, x in docs])
    words = "thething shed andthe ingthe thing dieund derschaft keitund überder schaftkeit".split()
    prob, _ = model.marginals(model.emissions(words), np.array([len(words)]))
    assert [x[:2] for x in langid.Tagger(model).label(" ".join(words))] == list(zip(words, ["en"] * 5 + ["de"] * 5, strict=True))
    assert [labels[k] for k in prob.argmax(axis=1)] == ["en"] * 5 + ["de"] * 5
    assert np.allclose(prob.sum(axis=1), 1) and (np.diag(model.steps) > model.steps.mean(axis=1)).all()


def test_forward_backward_against_brute_force():
    from itertools import product

    rng = np.random.default_rng(0)
    model = langid.Crf(["a", "b", "c"], {})
    model.steps = rng.normal(size=(3, 3)).astype(np.float32)
    lengths = np.array([5, 3, 1])
    emit = rng.normal(size=(9, 3)).astype(np.float32)
    pairs, want_pairs, want_z = np.zeros((3, 3)), np.zeros((3, 3)), 0.0
    (got, log_z), at = model.marginals(emit.copy(), lengths, pairs), 0
    for n in lengths:
        want, steps = np.zeros((n, 3)), np.zeros((3, 3))
        for path in product(range(3), repeat=int(n)):
            w = np.exp(sum(emit[at + t, y] for t, y in enumerate(path)) + sum(model.steps[a, b] for a, b in zip(path, path[1:], strict=False)))
            for t, y in enumerate(path):
                want[t, y] += w
            for a, b in zip(path, path[1:], strict=False):
                steps[a, b] += w
        total = want.sum(axis=1)[0]
        want_pairs, want_z = want_pairs + steps / total, want_z + np.log(total)
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True), atol=1e-4)
        at += n
    assert np.allclose(pairs, want_pairs, atol=1e-4) and abs(log_z - want_z) < 1e-3


def test_gradients_are_those_of_the_likelihood():
    labels = sorted(STEMS)
    docs = [(langid.tokens(t)[:20], labels.index(x)) for _, t, x in texts(12, 7)]
    model = langid.Crf(labels, {"the": np.array([0, 1, 0], np.float32), "und": np.array([1, 0, 0], np.float32)})
    rng = np.random.default_rng(2)
    for name in ("weights", "lexical", "steps"):
        setattr(model, name, rng.normal(0, 0.3, getattr(model, name).shape))
    model.weights[langid.SLOTS] = 0
    sample = langid.Sample(model, docs, 1)
    _, grads = model.loss(sample)
    for name, grad in zip(("weights", "lexical", "steps"), grads, strict=True):
        value = getattr(model, name)
        at = [tuple(x) for x in np.argwhere(np.abs(grad) > 1e-4)]
        for k in ([at[int(i)] for i in rng.integers(0, len(at), 12)]):
            held, ends = value[k], []
            for step in (1e-4, -1e-4):
                value[k] = held + step
                ends.append(model.loss(sample)[0])
            value[k] = held
            assert abs((ends[0] - ends[1]) / 2e-4 - grad[k]) < 1e-4 + 0.01 * abs(grad[k]), (name, k)


def test_words_of_every_script():
    assert langid.tokens("½ ² ① 12 _ !?") == [] and langid.tokens("Über l'été") == ["über", "l", "été"]
    assert langid.tokens("हिन्दी भाषा") == ["हिन्दी", "भाषा"]
    long = "".join(chr(0x4E00 + k) for k in range(100))
    assert "".join(langid.tokens(long)) == long and all(len(w.encode()) <= langid.WIDTH for w in langid.tokens(long + "a" * 99))
    ends = ("漢" * 40, "漢" * 20 + "字" * 20)
    assert langid.tokens(ends[0]) != langid.tokens(ends[1])


def test_language_of_null_and_long_ids(spark):
    big = 2**53 + 1
    rows = [(i, t, x) for i, t, x in texts(120)] + [(big, "½ ² ①", "en"), (big, "the thing", None), (None, "der und", "de"), (None, None, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    got = sorted(((r.doc_id, r.lang_pred, r.held_out) for r in langid.identify(df, docs_per_lang=40).collect()[-4:]), key=str)
    assert got == sorted([(big, "und", zlib.crc32(str(big).encode()) % 5 == 0), (big, "en", zlib.crc32(str(big).encode()) % 5 == 0), (None, "de", True), (None, "und", True)], key=str)
    words = langid.label_words(df.where("doc_id is null"), langid.train(df, 40)).collect()
    assert [(r.doc_id, r["at"], r.word, r.label) for r in words] == [(None, 0, "der", "de"), (None, 1, "und", "de")]


def test_quality(spark):
    data = texts(400)
    rng = random.Random(1)
    rows = [(i, t if i % 3 else " | ".join(t.upper().split()) + " $$$" * rng.randrange(1, 9)) for i, t, _ in data] + [(900, None), (901, ""), (5, data[5][1])]
    docs = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, quality int, held_out string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(1, None), (2, 1), (9999, 0)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0


def brute_tokens(text):
    out, before = [], None
    for m in quality.TOKEN.findall(text or ""):
        word = quality.plain(m)
        out.append(word)
        if word == before:
            out.append(quality.AGAIN)
        if len(m) > 1 and m.isupper():
            out.append(quality.CAPITALS)
        before = word
    return out


def test_vectors_and_pooling_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    data = [" ".join(rng.choice(["The", "the", "SHOUT", "42", "7", "!!!!", "été", f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(0, 60))) for _ in range(60)] + [None, "", "...", "the " * 4000]
    monkeypatch.setattr(quality, "RUN_TOKENS", 500)
    sums, counts = {}, {}
    for t in data:
        ws = brute_tokens(t)
        for i, w in enumerate(ws):
            counts[w] = counts.get(w, 0) + 1
            v = sums.setdefault(w, np.zeros(quality.DIM))
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(ws):
                    place, sign = quality.index_vectors([ws[j]])
                    for m in range(quality.MARKS):
                        v[place[0, m]] += sign[0, m]
    for held in (10**6, 12):  # at once, and passed on in between
        monkeypatch.setattr(quality, "HELD", held)
        got, of = {}, {}
        for words, n, v in quality.context_sums(iter([data[:20], data[20:]])):
            for k, w in enumerate(words):
                got[w], of[w] = got.get(w, 0) + v[k], of.get(w, 0) + n[k]
        assert {w: n for w, n in of.items() if n} == counts and all(np.array_equal(got[w], sums[w]) for w in counts)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(data)], "doc_id long, text string")
    for vocabulary in (1000, 10):
        vectors = quality.word_vectors(docs, vocabulary)
        assert vectors.words == (len(counts) if vocabulary == 1000 else vectors.words) <= vocabulary
        kept = sorted(counts, key=lambda w: -counts[w])[: vectors.words]
        assert set(vectors.at) <= {w for w in counts if counts[w] >= min(counts[k] for k in kept)}
        pooled = quality.Pool(vectors).of(data)
        for t, x in zip(data, pooled, strict=True):
            ws = brute_tokens(t)
            if not ws:
                assert not x.any()
                continue
            at = vectors.rows(ws)
            v, w = vectors.vectors[at].astype(float), vectors.weights[at].astype(float)
            mean = (w[:, None] * v).sum(axis=0) / w.sum()
            spread = np.sqrt(np.maximum(0, (w[:, None] * v * v).sum(axis=0) / w.sum() - mean**2))
            assert np.allclose(x, np.r_[mean, spread, np.log1p(len(ws)) / 10], atol=2e-3)
    monkeypatch.setattr(quality, "PIECE", 100)
    assert np.allclose(quality.Pool(vectors).of(data), pooled, atol=2e-2)


def test_probabilities_are_calibrated():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 5))
    y = (rng.random(6000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    score = quality.Network(x[:3000], y[:3000]).score(x[3000:])
    for lo in (0.0, 0.2, 0.4, 0.6, 0.8):
        part = (score >= lo) & (score < lo + 0.2)
        assert abs(score[part].mean() - y[3000:][part].mean()) < 0.08


def test_quality_of_null_and_long_ids(spark):
    big = 2**53 + 1
    rows = [(i, t) for i, t, _ in texts(80)] + [(None, "the thing"), (big, "and"), (big, "ing shed"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (big, 1)], "doc_id long, quality int")
    got = quality.quality(docs, labels, train_rows=30).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in rows), key=str)
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == big}) == 2


def test_licences(spark):
    notices = {0: ("Released under the MIT License.", "mit"), 1: ("ALL RIGHTS RESERVED", "reserved"), 2: ("Licensed under the  Apache License, Version 2.0", "apache"), 3: ("licensed under cc by-nc 4.0.", "cc-by-nc"), 4: ("This work is licensed under the GNU General Public License version 3", "gpl"), 5: ("The permission to copyright gardens was licensed by nobody here today", None)}
    wrapped = {f: "\n".join(textwrap.wrap(licenses.TEMPLATES[f][0], 72)) for f in ("mit", "gpl", "isc", "bsd")}
    rows = [(i, t, None) for i, t, _ in texts(200)] + [(1000 + k, f"some words\n\n{n}\n \t\nmore words", None) for k, (n, _) in notices.items()]
    rows += [(1100 + k, f"some words\r\n\r\n{t}\n\nmore", None) for k, t in enumerate(wrapped.values())]
    rows += [(2000, None, None), (2001, "", None), (2002, "x " * 20_000 + "\n\nReleased under the MIT License.", None), rows[200]]
    rows += [(3000, wrapped["isc"], None), (3000, wrapped["mit"], None), (None, wrapped["gpl"], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string")
    out = licenses.scan(docs, sample_docs=50).collect()
    got = {(r.doc_id, r.paragraph, r.family): r for r in out}
    assert len(got) == len(out)
    families = lambda d: {(r.paragraph, r.family, r.confirmed) for r in out if r.doc_id == d}
    for k, (_, family) in notices.items():
        assert families(1000 + k) == {(1, family, True)} if family else families(1000 + k) <= {(1, "unknown", False)}, k
    for k, f in enumerate(wrapped):
        assert families(1100 + k) == {(1, f, True)}, f
    assert families(2002) == {(1, "mit", True)} and families(3000) == {(0, "isc", True), (0, "mit", True)} and families(None) == {(0, "gpl", True)}
    assert {r.doc_id for r in out} <= {*range(1000, 1006), *range(1100, 1104), 2002, 3000, None}
    assert licenses.scan(docs.limit(0), sample_docs=50).count() == 0


def test_anchors_let_no_template_pass():
    rng = random.Random(4)
    tokens = {f: [regex.findall(r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*", t.lower()) for t in ts] for f, ts in licenses.TEMPLATES.items()}
    every = [ws for ts in tokens.values() for ws in ts]
    rate = {w: rng.randrange(50) for ws in every for w in ws}
    chosen = set(licenses.anchors(every, rate, 0.6))
    for ws in every:
        own = {(w,) for w in ws} | set(zip(ws, ws[1:], strict=False))
        assert sum(not chosen & set(g) for g in own) < 0.6 * len(own)


def brute_windows(ws, chosen):
    """(start, size) of the windows of a paragraph that are read."""
    out = {(0, len(ws))} if len(ws) <= licenses.SIZES[-1] else set()
    for size in licenses.SIZES:
        if len(ws) > size:
            out |= {(min(i, len(ws) - size), size) for i in range(0, len(ws) - size + size // 3, size // 3)}
    return sorted((i, n) for i, n in out if chosen & set(ws[i : i + n]))


def test_windows_and_logits_against_brute_force(spark):
    rng = random.Random(12)
    chosen = {"licensed", "reserved", "mit"}
    vocabulary = ["licensed", "under", "mit", "the", "all", "rights", "reserved"] + [f"w{k}" for k in range(60)]
    parts = [" ".join(rng.choice(vocabulary[3 if n > 3000 else 0 :]) for _ in range(n)) for n in (1, 5, 6, 7, 95, 96, 97, 300, 2048, 2100, 2144, 2145, 4300, 9000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(parts)], "doc_id long, text string")
    rows = licenses.blocks(licenses.paragraphs(docs), sorted(chosen))
    found = licenses.windows(stored(rows, "test-blocks")).select("doc_id", "start", "size", "words", licenses.grams(F.col("words")).alias("grams"))
    got = {}
    for r in found.collect():
        assert r.words == parts[r.doc_id].split()[r.start : r.start + r.size]
        assert set(r.grams) == set(r.words) | {f"{a} {b}" for a, b in zip(r.words, r.words[1:], strict=False)}
        got.setdefault(r.doc_id, []).append((r.start, r.size))
    for k, t in enumerate(parts):
        assert sorted(got.get(k, [])) == brute_windows(t.split(), chosen), k
    table = {w: [rng.uniform(-1, 1) for _ in range(3)] for w in [*vocabulary[:20], "licensed under", "all rights"]}
    bias = [0.5, -0.25, 0.0]
    weights = spark.createDataFrame(list(table.items()), "gram string, w array<double>")
    some = found.where("doc_id < 8").select(F.concat_ws(":", "doc_id", "start", "size").alias("row"), "grams")
    sums = {r["row"]: r.logits for r in licenses.logits(some, weights, bias, ["row"]).collect()}
    for r in some.collect():
        hit = [table[g] for g in r.grams if g in table]
        assert np.allclose(sums[r["row"]], np.sum(hit, axis=0) + bias) if hit else r["row"] not in sums
    soft = spark.createDataFrame([([1.0, 2.0, -3.0],)], "x array<double>").select(licenses.softmax(F.col("x"), 0.7)).first()[0]
    want = np.exp(np.array([1.0, 2.0, -3.0]) / 0.7)
    assert np.allclose(soft, want / want.sum())


def test_licence_inside_a_long_line(spark):
    ordinary = " ".join(t for _, t, _ in texts(300)).replace("\n", " ").replace(".", "").split()
    middle = lambda n, *notices: " ".join(w for k, t in enumerate(notices) for w in [*ordinary[k * n : k * n + n // 2], t, *ordinary[k * n + n // 2 : k * n + n]])
    short = {"reserved": "All rights reserved.", "mit": "Released under the MIT License.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}
    long = {f: licenses.TEMPLATES[f][0] for f in ("apache", "gpl", "agpl", "mit")}
    cases = [(n, {f: t}) for n in (40, 160, 1000) for f, t in [*short.items(), *long.items()]] + [(1000, short)]
    rows = [(i, t) for i, t, _ in texts(200)] + [(1000 + k, middle(n, *c.values())) for k, (n, c) in enumerate(cases)]
    rows += [(2000, middle(1000, "under no licence of"))]
    got: dict[int, set] = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), sample_docs=50).collect():
        got.setdefault(r.doc_id, set()).add((r.family, r.confirmed))
    for k, (n, c) in enumerate(cases):
        assert got.get(1000 + k) == {(f, True) for f in c}, (n, c)
    assert got.get(2000, set()) <= {("unknown", False)}


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def brute_urls(pages, rounds=300, damping=0.85):
    import re

    def split(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")

    def rule(h, p):
        fits = [(len(rh + rp), rh + rp, v) for v, rh, rp in RULES if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        return max(fits)[1:] if fits else (None, None)

    parsed = [(i, *split(u), *rule(*split(u)), re.findall(r"href=\"https?://([^/?#\"]+)", html or "")) for i, u, html in pages]
    edges, names = {}, set()
    for _, h, *_, links in parsed:
        if h:
            names.add(h)
        for x in set(links):
            if h and h != x:
                edges[h, x] = edges.get((h, x), 0) + 1
                names.add(x)
    for h in list(names):
        part = h.split(".")
        for k in range(len(part) - 2):
            a, b = ".".join(part[k:]), ".".join(part[k + 1 :])
            if (a, b) not in edges.get("kin", ()):
                edges.setdefault("kin", set()).add((a, b))
    for a, b in edges.pop("kin", ()):
        edges[a, b] = edges.get((a, b), 0) + 1
        edges[b, a] = edges.get((b, a), 0) + 1
    nodes = sorted({x for e in edges for x in e} | {p[1] for p in parsed if p[1]})
    at = {n: k for k, n in enumerate(nodes)}
    A = np.zeros((len(nodes), len(nodes)))
    for (a, b), w in edges.items():
        A[at[a], at[b]] = w
    T, D = A / np.maximum(A.sum(1, keepdims=True), 1e-300), (A / np.maximum(A.sum(0, keepdims=True), 1e-300)).T
    t0, d0 = np.zeros(len(nodes)), np.zeros(len(nodes))
    for _, h, _, _, v, _ in parsed:
        if h and v:
            (t0 if v == "allow" else d0)[at[h]] += 1
    t0, d0 = t0 / max(t0.sum(), 1), d0 / max(d0.sum(), 1)
    t, d = t0, d0
    for _ in range(rounds):
        t, d = (1 - damping) * t0 + damping * t @ T, (1 - damping) * d0 + damping * d @ D
    bad = {n for n, k in at.items() if t[k] + d[k] > 0 and round(t[k] / (t[k] + d[k]), 6) < 0.5}
    return {i: (h, p, r, v or ("block" if h in bad else "allow")) for i, h, p, r, v, _ in parsed}


def test_urls(spark):
    rng = random.Random(8)
    hosts = ["a.example.org", "example.org", "B.x.com", "y.com", "z.y.com", "q.net", "w.q.net", "lone.net"]
    link = lambda: f'<a href="https://{rng.choice(hosts).lower()}/x">'
    pages = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['fr/', 'de/', 'es/', 'en/1', ''])}{rng.choice(['', '?a=/de/', '#t'])}", "".join(link() for _ in range(rng.randrange(3)))) for i in range(150)]
    pages += [(150, None, None), (151, "no scheme/de/", "x"), (152, "https://a.example.org", "x"), (153, "x://h.com/de/u://v.org/", None), (3, pages[3][1], pages[3][2])]
    df = spark.createDataFrame([(*p, "v", "r") for p in pages], "page_id long, url string, html string, verdict string, rule string")
    got = url_filter(df, RULES).collect()
    want = brute_urls(pages)
    assert len(got) == len(pages) and all((r.host, r.path, r.rule, r.verdict) == want[r.page_id] for r in got)
    assert "block" in {r.verdict for r in got if r.rule is None}
    assert url_filter(df.limit(0), RULES).count() == 0


def test_urls_at_the_threshold_and_very_long_ones(spark):
    """As much trust as distrust is allowed; urls and pages of megabytes are read whole."""
    to = lambda host: f'<a href="https://{host}/x">'
    filler = "words " * 400_000
    pages = [
        (1, "https://t.org/", to("mid.net")), (2, "https://mid.net/", filler + to("bad.com")), (3, "https://bad.com/de/", None), (4, "https://mid.net/" + "p" * 2_000_000, None),
        (6, "https://late.net/?" + "q" * 2_000_000 + "/de/", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter(df, RULES, damping=0.5).collect()}  # a tie is walked to the end, which is nearer so
    assert {k: r.verdict for k, r in got.items()} == {1: "allow", 2: "allow", 3: "block", 4: "allow", 6: "allow"}
    assert len(got[4].path) == 2_000_001 and got[6].path == "/" and got[6].rule is None
    # Without the trusted page distrust alone reaches the host.
    alone = spark.createDataFrame([*pages[1:3], (5, "https://" + "a." * 60 + "org/", None)], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter(alone, RULES).collect()} == {2: "block", 3: "block", 5: "allow"}


def test_held_out_is_crc(spark):
    got = spark.range(50).select("id", langid.held_out(F.col("id"), 5, 0).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
