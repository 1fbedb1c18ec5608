from pathlib import Path

import pytest

import corpus_pipeline
from parcelfusion.llm.queries import oracle_sql, queries

from brute import brute_contaminated, near_components, sizes

DATA = "/root/testdata/sf0.001"


def rows(spark):
    """The smallest documents with columns that clash, and rows with null, long and repeated ids."""
    found = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    text = next(t for _, t, x, _ in found if x == "en" and t and len(t.split()) > 60)
    other = next(t for _, t, x, _ in found if x == "fr" and t and len(t.split()) > 60)
    big = 2**53 + 1
    found += [(None, text + " more", "en", "s"), (None, f"{other} {item}", None, None), (big, " ".join(reversed(text.split())), "en", "s"), (big, " ".join(reversed(other.split())), "fr", None)]
    found += [(big, " ".join(reversed(other.split())), "fr", None), (None, None, "en", "s"), (7, "", None, "s"), (8, "½ 12 !?", "en", "s")]
    return [(*r, 1, "x", 2, "y") for r in found]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_stages_against_brute_force(spark):
    data = rows(spark)
    schema = "doc_id long, text string, lang string, source string, size long, shard string, kept int, component string"
    docs = spark.createDataFrame(data, schema)
    key = lambda r: str((r[0], r[1]))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        before, after = sorted(map(tuple, docs.collect()), key=key), out.collect()
        if name != "sharding":
            assert out.columns == docs.columns
            after = sorted(map(tuple, after), key=key)
        if name == "language_id":
            assert set(after) <= set(before) and {r for r in before if len((r[1] or "").split()) > 5} <= set(after)
            assert not {r[1] for r in after} & {None, "", "½ 12 !?"}
        elif name == "near_dedup":
            of = near_components(before, 5, 80)
            assert set(after) <= set(before) and len(after) == len(set(of)) < len(before)
            # One row of each component, that of its smallest id.
            for c in set(of):
                own = [r for r, x in zip(before, of, strict=True) if x == c]
                best = min((r[0] is None, r[0] or 0) for r in own)
                assert any((r[0] is None, r[0] or 0) == best and r in after for r in own)
        elif name == "decontamination":
            bad = brute_contaminated([r[1] for r in before], [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
            clean = [r for r, b in zip(before, bad, strict=True) if not b]
            assert [r for r in after if r in clean] == clean and len(after) - len(clean) <= 0.02 * sum(bad) and sum(bad) > 1
        elif name == "mixing":
            assert set(after) <= set(before) and max(after.count(r) for r in set(after)) <= 3 * max(before.count(r) for r in set(before))
            total, taken, targets = sizes(before), sizes(after), sizes(before, targets=True)
            longest = max(len((r[1] or "").split()) for r in before)
            assert all(abs(taken.get(s, 0) - targets[s]) <= 2 * longest for s in total)
        else:
            assert len(after) == len(before) and {r.document_size for r in after} == {1} and {r.document_shard for r in after} == {"x"}
            assert sorted(str((r.doc_id, r.text)) for r in after) == sorted(map(key, before))
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = docs.count()
    assert {"doc_id", "shard", "slot"} <= set(docs.columns) and seen["sharding"] == seen["mixing"] > 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_run_leaves_its_result_alone_behind(spark):
    from parcelfusion.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert [p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before] == ["pipeline-sharding"]


def test_names():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert set(oracle_sql()) <= set(names) and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_of_empty_tables(spark, tmp_path):
    """No documents give no rows and the same columns; an empty benchmark drops nothing."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (2, None, None, None, None)], schema)
    assert corpus_pipeline.decontamination(spark, some, str(tmp_path)).count() == 2
