import numpy as np

import pytest

from parcelfusion.llm import decontam
from parcelfusion.llm.decontam import Searcher, contaminated, decontaminate, fitting_edits, words


def brute(docs, items, percent=20):
    vocab, out = {}, set()
    code = lambda t: np.array([vocab.setdefault(w, len(vocab)) for w in words(t)], np.int64)
    coded = {i: code(t) for i, t in items}
    for d, t in docs:
        text = code(t)
        for i, x in coded.items():
            if len(x) >= 5 and len(text):
                edits, _ = fitting_edits(x, text)
                if 100 * edits <= 20 * len(x):
                    out.add((d, i, edits))
    return out


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of"] * 30
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, say(int(n))) for i, n in enumerate(rng.integers(5, 60, 40))] + [(40, None), (41, "too short"), (42, ""), (43, None)]
    items.append((44, items[3][1]))
    docs = [(d, say(int(n))) for d, n in enumerate(rng.integers(1, 400, 150))]
    for d in range(150, 300):
        x = items[d % 40][1].split()
        for _ in range(int(rng.integers(0, len(x) // 3 + 1))):
            k = int(rng.integers(0, len(x)))
            x[k : k + 1] = [[], ["new"], [x[k], "more"]][rng.integers(0, 3)]
        docs.append((d, f"{say(30).upper()}\n{' '.join(x)}! {say(int(rng.integers(0, 3000)))}"))
    docs += [(300, None), (301, ""), (302, " ... "), (150, docs[150][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(d, t, "x", d) for d, t in docs], "doc_id long, text string, item_id string, edits long")
    got = {(r.doc_id, r.item_id, r.edits) for r in contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, [(i, t) for i, t in items if t])
    assert got <= want and len(got) >= 0.98 * len(want)
    exact = {x for x in want if x[2] * 10 <= len(dict(items)[x[1]].split())}
    assert exact <= got
    kept = decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, *_ in got}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs, none).count() == 0
    assert contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_repeats_follow_recall():
    assert len(Searcher([(1, " ".join(f"w{i}" for i in range(40)))], recall=0.5).families[0].repeats) <= 8


def test_every_length_reaches_the_recall():
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 20_000, n))
    # Mostly items of 30 words and more, which are the easiest to find.
    lengths = [5, 6, 8, 10, 12, 13, 15, 20]
    items = [say(n) for n in [*rng.integers(30, 60, 600), *np.repeat(lengths, 10)]]
    searcher = Searcher(list(enumerate(items)))
    for n in lengths:
        tried = [(k, decontam.edited(np.arange(1, n + 1), 20, rng)) for k in np.repeat([k for k, t in enumerate(items) if len(t.split()) == n], 60)]
        texts = [" ".join(items[k].split()[w - 1] if w else "new" for w in x) for k, x in tried]
        found = {(at, k) for at, k, *_ in searcher.find(texts)}
        assert sum((at, k) in found for at, (k, _) in enumerate(tried)) >= 0.985 * len(tried), n


def test_a_recall_out_of_reach_is_an_error(monkeypatch):
    monkeypatch.setattr(decontam, "MAX_REPEATS", 4)
    with pytest.raises(ValueError, match="not reached"):
        Searcher([(1, " ".join(f"w{i}" for i in range(12)))], recall=0.9999)


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Mount Kilimanjaro"), (2, "blue whale, 1952"), (3, "Zanzibar"), (4, "水の沸点は何度ですか？"), (5, "北京"), (6, "กรุงเทพมหานคร"), (7, "..."), (8, "who wrote it?")]
    docs = [(1, "They saw mount kilimanjaro, at dawn"), (2, "mount\nKilimanjaro"), (3, "Kilimanjaro mount"), (4, "a blue whale 1952"), (5, "a blue big whale 1952"), (6, "zanzibars"), (7, "to Zanzibar"), (8, "質問。水の沸点は何度ですか。答え"), (9, "水の沸点は何度でしょうか"), (10, "我住在北京市"), (11, "京北"), (12, "ไปกรุงเทพมหานครกัน"), (13, "wrote it who"), (14, "… and who wrote it"), (15, "水は百度で沸く")]
    want = {(1, 1), (2, 1), (4, 2), (7, 3), (8, 4), (9, 4), (10, 5), (12, 6), (14, 8)}
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(*frames).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {r.edits for r in got if r.item_words < 5} == {0}
    assert {r.doc_id for r in decontaminate(*frames).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    # With edits allowed in them, short items are still found wherever one is.
    loose = Searcher([(1, "one two three four")], percent=30)
    assert [h[:3] for h in loose.find(["x one two other four x", "one two", "three x four two one", "two three four"])] == [(0, 1, 1), (3, 1, 1)]


def test_null_long_and_repeated_ids(spark):
    big, item = 2**53 + 1, " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(None, f"x {item} y"), (big, item), (big, "clean"), (None, "clean too"), (None, None), (3, "")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(big + 2, item), (None, None)], "item_id long, text string")
    assert sorted(map(str, (tuple(r)[:3] for r in contaminated(docs, items).collect()))) == sorted(map(str, [(None, big + 2, 0), (big, big + 2, 0)]))
    assert sorted(map(str, map(tuple, decontaminate(docs, items).collect()))) == sorted(map(str, [(big, "clean"), (None, "clean too"), (None, None), (3, "")]))


def test_blocks_of_items(spark, monkeypatch):
    docs, items = corpus()
    frame, bench = spark.createDataFrame(docs[150:], "doc_id long, text string"), spark.createDataFrame(items[:40], "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in contaminated(frame, bench).collect() if r.edits * 10 <= r.item_words}
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 15)
    assert whole <= {(r.doc_id, r.item_id) for r in contaminated(frame, bench).collect()}
    assert not {d for d, _ in whole} & {r.doc_id for r in decontaminate(frame, bench).collect()}
