"""Licence windows without an anchor: left out only if no guess but ordinary text is possible."""

import random

from pyspark.sql import functions as F

from parcelfusion.llm import licenses
from parcelfusion.llm.common import stored

from test_models import texts


def every_window(ws):
    out = {(0, len(ws))} if len(ws) <= licenses.SIZES[-1] else set()
    for size in licenses.SIZES:
        if len(ws) > size:
            out |= {(min(i, len(ws) - size), size) for i in range(0, len(ws) - size + size // 3, size // 3)}
    return out


def test_no_window_is_left_out_that_a_family_may_win(spark):
    rng = random.Random(7)
    some = [f"w{k}" for k in range(400)]
    table = {w: [rng.gauss(0, 0.5) for _ in range(4)] for w in some[:60]} | {f"{a} {b}": [rng.gauss(0, 0.7) for _ in range(4)] for a, b in (rng.sample(some[:30], 2) for _ in range(60))}
    bias = [0.1, -0.2, 0.0, 2.5]
    parts = [" ".join(rng.choice(some[:30] if k % 100 < 8 and rng.random() < 0.5 else some) for k in range(n)) for n in (1, 5, 6, 7, 95, 96, 97, 300, 2048, 2100, 2144, 2145, 4300, 9001)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(parts)], "doc_id long, text string")
    rise = licenses.Rise(table, bias)
    rows = stored(licenses.blocks(licenses.paragraphs(docs), ["w399"], rise), "test-blocks")
    got = {(r.doc_id, r.start, r.size) for r in licenses.windows(rows).select("doc_id", "start", "size").collect()}
    worth = {g: max(w[:-1]) - w[-1] for g, w in table.items()}
    least, most = set(), set()
    for k, t in enumerate(parts):
        ws = t.split()
        for i, size in every_window(ws):
            each = ws[i : i + size]
            own = {*each, *(f"{a} {b}" for a, b in zip(each, each[1:], strict=False))}
            sums = [b + sum(table[g][f] for g in own if g in table) for f, b in enumerate(bias)]
            if "w399" in each or max(sums[:-1]) > sums[-1]:
                least.add((k, i, size))
            if "w399" in each or len(ws) <= size or 1.3 * sum(max(worth.get(g, 0.0), 0.0) for g in own) + 0.02 * len(own) > 2.4 - 1e-3:
                most.add((k, i, size))
    assert any("w399" not in parts[k].split()[i : i + size] for k, i, size in least)
    assert least <= got <= most and len(got) < 0.8 * sum(len(every_window(t.split())) for t in parts)


def test_a_licence_without_an_anchor_is_found(spark):
    rows = [(i, t) for i, t, _ in texts(200)] + [(1000, "first words\n\ncreative commons cc by-sa 4.0 gnu gpl-3.0 lgpl-2.1 mit isc\n\nlast words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = licenses.Model(docs, 50, 0.6)
    assert not set(model.anchors) & set("creative commons cc by-sa 4.0 gnu gpl-3.0 lgpl-2.1 mit isc".split())
    got = {(r.doc_id, r.paragraph) for r in licenses.scan(docs, sample_docs=50).select("doc_id", "paragraph").collect()}
    assert got == {(1000, 1)}
