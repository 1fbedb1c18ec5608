"""Phrase collocations by Toivonen mining: a sample proposes, full passes count exactly until nothing is left out.

A phrase can be frequent only if all its parts are. The phrases that are frequent in a sample and their negative border (phrases
that aren't, but whose parts are) are counted in one pass over all texts. If a phrase of the border proves frequent, the sample
was wrong about it, and phrases that it is part of may have been left out: they and their border are counted in a further pass, and so on until a
pass finds no new one, after as many passes as a phrase has words at most.

Which phrases a pass counts depends on their words alone: single words always, longer ones if their two longest parts are in the filter of
frequent phrases. That is a bitmap of bounded size, so it goes to every task whatever the corpus; what it lets through
by chance is counted as well, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_BYTES, arrow_batches, stored
from .wordruns import RUN, STEP, Run, bitmap, byte_classes, filter_size, hashed, mixed, passes, runs

BREAKS = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
COUNTS = pa.schema([("lang", pa.string()), ("size", pa.int8()), ("phrase", pa.string()), ("n", pa.int64())])
#: Filters of frequent phrases by their number of words, from 1.
Filters = list[np.ndarray]
#: Bytes of a batch of texts: one run, as a task holds a batch several times over, in the JVM and in Python.
BATCH = RUN * 19 // 20


def extended(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of phrases with hash ``h``, each with one word more."""
    return mixed(h * STEP + words)


def phrase_hashes(langs: np.ndarray, words: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Hashes of the phrases of 1, 2, ... ``size`` words from each place on; ``langs``: hash of the language at each place."""
    h = extended(langs, words)
    yield h
    for m in range(2, size + 1):
        h = extended(h[: max(0, len(words) - m + 1)], words[m - 1 :])
        yield h


def counts_of(run: Run, langs: np.ndarray, lang_hashes: np.ndarray, filters: list[Filters], size: int, everything: bool) -> Iterator[tuple]:
    """(places, words, counts) of the distinct phrases of 1, 2, ... words of a run that this pass counts.

    ``filters``: the filters of each pass so far, the last being this one's; what an earlier pass let through has been counted. ``everything``: count all.
    """
    of = langs[run.row]
    hashes = list(phrase_hashes(lang_hashes[of], run.hashes(), size - 1)) if not everything else []
    allowed = lambda f, m: (lambda on: on[:-1] & on[1:])(passes(f[m - 2], hashes[m - 2]))
    number = of * np.int64(len(run.vocabulary)) + run.code
    for m in range(1, size + 1):
        n = len(run.code) - m + 1
        if n <= 0:
            return
        on = run.piece[:n] == run.piece[m - 1 :]
        on[: max(0, run.known - m + 1)] = False
        if m > 1:
            # Phrases go by the number of their first m - 1 words and the next word.
            number = number[:n] * np.int64(len(run.vocabulary)) + run.code[m - 1 :]
            if not everything:
                on &= allowed(filters[-1], m)
                for f in filters[:-1]:
                    on &= ~allowed(f, m)
        elif len(filters) > 1:
            on[:] = False
        at = np.flatnonzero(on)
        if len(at):
            _, first, times = np.unique(number[at], return_index=True, return_counts=True)
            yield at[first], m, times
        if m < size:  # small numbers again, so that the next product stays small
            number = np.unique(number, return_inverse=True)[1].reshape(-1).astype(np.int64)


def counted(batches: Iterator[pa.RecordBatch], filters: list[Filters], size: int, everything: bool) -> Iterator[pa.RecordBatch]:
    """Counts of phrases, and of all words of a language as the phrase '' of 0 words."""
    for batch in batches:
        named = batch.column("lang").dictionary_encode()
        langs, names, lang_hashes = named.indices.to_numpy(zero_copy_only=False), named.dictionary, hashed(named.dictionary)
        for run in runs(batch.column("text"), BREAKS, size - 1, LOWER_BYTES):
            if not len(run.code):
                continue
            if len(filters) <= 1:
                n = np.bincount(langs[run.row[run.known :]], minlength=len(names))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.zeros(len(names)), pa.int8()), pa.array([""] * len(names)), pa.array(n, pa.int64())], schema=COUNTS)
            vocabulary = run.vocabulary.cast(pa.string())
            for at, m, times in counts_of(run, langs, lang_hashes, filters, size, everything):
                words = [vocabulary.take(pa.array(run.code[at + j])) for j in range(m)]
                phrase = pc.binary_join_element_wise(*words, " ") if m > 1 else words[0]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(langs[run.row[at]])), pa.array(np.full(len(at), m), pa.int8()), phrase, pa.array(times, pa.int64())], schema=COUNTS)


def hashed_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each phrase, as ``phrase_hashes`` has it."""
    for batch in batches:
        split = pc.split_pattern(batch.column("phrase"), " ")
        lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        word, lang = hashed(split.flatten()), hashed(batch.column("lang"))
        begin = np.cumsum(lengths) - lengths
        for j in range(int(lengths.max(initial=0))):
            on = lengths > j
            lang[on] = extended(lang[on], word[begin[on] + j])
        yield pa.RecordBatch.from_arrays([pa.array(lang.view(np.int64))], ["hash"])


def phrase_counts(texts: DataFrame, least: int, size: int, filters: list[Filters] = (), everything: bool = False) -> DataFrame:
    """lang, size, phrase, n of the phrases that this pass counts and that occur ``least`` times, and of all words (size 0)."""
    sent = texts.sparkSession.sparkContext.broadcast(list(filters))
    rows = texts.mapInArrow(lambda batches: counted(batches, sent.value, size, everything), "lang string, size byte, phrase string, n long")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0))


def filters_of(frequent: DataFrame, size: int, before: Filters | None = None) -> Filters:
    """A filter of the phrases of 1, 2, ... ``size`` - 1 words, with what the filters ``before`` let through."""
    n = {r["size"]: r["count"] for r in frequent.groupBy("size").count().collect()}
    out = []
    for m in range(1, size):
        bits = max(filter_size(n.get(m, 0)), 64 * len(before[m - 1]) if before else 0)
        new = bitmap(frequent.where(F.col("size") == m).select("lang", "phrase").mapInArrow(hashed_phrases, "hash long"), bits)
        # A smaller filter repeated has the same bits set for the same hashes.
        out.append(new | np.tile(before[m - 1], len(new) // len(before[m - 1])) if before else new)
    return out


def frequent_phrases(docs: DataFrame, least: int = 10, size: int = 3, sample: float = 1 / 16, lowered: float = 0.8) -> DataFrame:
    """``counted_phrases``, whose passes all run here, on batches of bounded size."""
    with arrow_batches(docs.sparkSession, BATCH):
        return counted_phrases(docs, least, size, sample, lowered)


def counted_phrases(docs: DataFrame, least: int, size: int, sample: float, lowered: float) -> DataFrame:
    """lang, size, phrase, n of all phrases of up to ``size`` words that occur ``least`` times in a language, and its number of words (size 0).

    ``sample``: share of the documents that proposes; there a phrase counts as frequent from ``lowered`` times its share of ``least`` on. Neither changes the result.
    """
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.encode("text", "UTF-8").alias("text"))
    proposed = docs.where(key < int(sample * (1 << 20))).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.encode("text", "UTF-8").alias("text"))
    enough = max(2, round(lowered * sample * least))
    found = stored(phrase_counts(proposed, enough, max(1, size - 1), everything=True).where("size > 0"), "collocations-sample")
    filters = [filters_of(found, size)]
    known = stored(phrase_counts(texts, least, size, filters), "collocations-counts")
    new = known
    while size > 1:
        # Phrases of the border that proved frequent: the last filters lack them.
        failed = stored(new.where(F.col("size").between(1, size - 1)).mapInArrow(_beyond(filters[-1]), "lang string, size byte, phrase string, n long"), "collocations-failures")
        if failed.isEmpty():
            return known
        filters.append(filters_of(failed, size, filters[-1]))
        new = stored(phrase_counts(texts, least, size, filters).where("size > 0"), "collocations-counts")
        known = known.unionByName(new)
    return known


def _beyond(filters: Filters):
    """The phrases that the filters lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            hashes = next(hashed_phrases(iter([batch]))).column(0).to_numpy().view(np.uint64)
            lacks = np.zeros(len(batch), bool)
            for m in np.unique(sizes):
                lacks[sizes == m] = ~passes(filters[m - 1], hashes[sizes == m])
            yield batch.filter(pa.array(lacks))

    return run


def score(a: str, left: str, right: str) -> Column:
    """The whole part of 1,000,000 a² / (left right), in decimals, as the products pass 64 bits."""
    wide = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})")


def collocations(docs: DataFrame, least: int = 10, size: int = 3, held: int = 50, top: int | None = None, sample: float = 1 / 16) -> DataFrame:
    """lang, phrase, a, l, r, n, score of phrases of 2 to ``size`` words (documents: doc_id, lang, text), and rank where ``top`` is given.

    Texts are lower-cased (A-Z) and split into pieces at ``. , ; : ! ?`` and line ends, pieces into words at spaces and tabs. a, l, r are the numbers of occurrences of the
    phrase and of the two parts of its lowest-scoring cut, inside pieces and per language (null: ``und``), n that of all words; score is the whole part of
    1,000,000 a² / (l r). Phrases with fewer than ``least`` occurrences are left out, and so are those inside a longer one that is met at least
    ``held`` percent as often. ``top``: the best of each language by score, a and phrase (byte order). Null and empty texts count nothing; repeated rows count again; an empty table gives no rows.
    """
    known = frequent_phrases(docs, least, size, sample)
    words = known.where("size = 0").select("lang", F.col("n").alias("n_words"))
    parts = known.where(f"size between 1 and {size - 1}").select("lang", "phrase", "n")
    phrases = known.where("size > 1")
    k = lambda i, j: F.array_join(F.slice("w", i, j), " ")
    split = phrases.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    split = split.select("lang", "phrase", F.col("n").alias("a"), "k", k(1, F.col("k")).alias("left"), k(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    named = lambda part, count: parts.select("lang", F.col("phrase").alias(part), F.col("n").alias(count)).hint("merge")
    cuts = split.join(named("left", "l"), ["lang", "left"]).join(named("right", "r"), ["lang", "right"])
    best = cuts.withColumn("score", score("a", "l", "r")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = phrases.where("size > 2").withColumn("w", F.split("phrase", " ")).withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1))).select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "n")
    longer = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = best.join(longer.hint("merge"), ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {held} * a")
    n_langs = stored(words, "collocations-words")
    n_langs = F.broadcast(n_langs) if n_langs.count() <= 300_000 else n_langs.hint("merge")
    out = kept.join(n_langs, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", F.col("n_words").alias("n"), "cut.score")
    return out if top is None else ranked(out, top)


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The best ``top`` of each language with their rank. Shares of a language are cut to ``top`` first, so no task sorts a whole one."""
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(256))
    some = found.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).where(F.col("rank") <= top)
    last = some.drop("share", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    return last.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
