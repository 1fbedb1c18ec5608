"""Substring dedup by super-k-mers: windows of words that occur earlier are taken out of every document.

A window is ``width`` consecutive words of a document. Its minimiser is the least hash of the ``SHINGLE``-word shingles in it; consecutive
windows of one minimiser travel as one packed string of words to the minimiser's bucket, where all equal windows meet. There windows
are sorted by hash, neighbours are compared word by word, and all but the earliest of equal ones are reported.

Before they travel, a task sorts the windows of each run of its texts the same way and reports those with an earlier equal in the run, so a
passage that many documents share travels once a run. A count of all minimisers comes first: windows whose minimiser no other stretch of
windows has cannot have an equal, and stay. Windows of a minimiser that has more than ``HOT`` windows (say the edges of a shared passage, each beside
another neighbour) travel one by one, dealt by the hash of the whole window. Both sets of minimisers are kept as filters of
bounded size; what these let through by chance travels in vain, or is dealt otherwise, and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .wordruns import STEP, Run, bitmap, byte_classes, filter_size, mixed, passes, runs

BLANKS = byte_classes(b" \t\n\x0b\x0c\r")
SHINGLE = 8
#: Windows that a minimiser may have before they travel one by one, and windows of a bucket.
HOT, BUCKET = 1 << 12, 1 << 18
TRAVELLER = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("print", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("packed", pa.binary())])
MARK = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` items from each place on, by doubling."""
    size, step, out, have = 1, STEP, None, 0
    while size <= width:
        if width & size:
            out, have = (h, size) if out is None else (_joined(out, h, have, step), have + size)
        h, step, size = _joined(h, h, size, step), mixed(np.array([step]))[0] | np.uint64(1), 2 * size
    return mixed(out)


def _joined(a: np.ndarray, b: np.ndarray, have: int, step: np.uint64) -> np.ndarray:
    """Hash of the ``have`` items of a from each place on, followed by those of b."""
    n = max(0, min(len(a), len(b) - have))
    return a[:n] * step + b[have : have + n]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    size = 1
    n = max(0, len(x) - width + 1)
    while 2 * size <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


FIRST, LATER, AGAIN = 0, 1, 2


def standing(code: np.ndarray, place: np.ndarray, hashes: np.ndarray, width: int, order: list[np.ndarray]) -> np.ndarray:
    """Of windows, ``width`` codes from ``place``: LATER where an equal one comes before it by ``order`` (keys of the windows, the last
    first), AGAIN where it is met before with the very same keys, else FIRST."""
    out = np.zeros(len(place), np.int8)
    ranked = np.sort(hashes)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return out
    coarse = np.zeros(1 << 20, bool)
    coarse[(twice & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    some = np.flatnonzero(coarse[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
    twice = np.unique(twice)
    spot = np.minimum(np.searchsorted(twice, hashes[some]), len(twice) - 1)
    some = some[twice[spot] == hashes[some]]
    group = hashes[some]
    for _ in range(2):
        turn = np.lexsort([*[o[some] for o in order], group])
        a, b = some[turn[:-1]], some[turn[1:]]
        met = group[turn[:-1]] == group[turn[1:]]
        same = met.copy()
        for j in range(width):
            same &= code[place[a] + j] == code[place[b] + j]
        if (same == met).all():
            break
        # Different windows of one hash: number the windows by their words instead.
        group = np.unique(code[place[some][:, None] + np.arange(width)], axis=0, return_inverse=True)[1].reshape(-1)
    again = same.copy()
    for o in order:
        again &= o[a] == o[b]
    steps = np.append(0, np.cumsum(same & ~again))
    begun = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(some)), 0))
    out[some[turn]] = np.where(np.append(False, again), AGAIN, np.where(steps > steps[begun], LATER, FIRST))
    return out


def windows(run: Run, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, minimiser) of the windows of a run that lie in one text."""
    n = len(run.code) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = run.hashes()
    place = np.flatnonzero(run.piece[:n] == run.piece[width - 1 :])
    shingle = min(SHINGLE, width)
    return place, rolled(h, width)[place], sliding_least(rolled(h, shingle), width - shingle + 1)[place]


def stretches(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the stretches that begin where ``breaks`` is set (as it is at 0)."""
    first = np.flatnonzero(breaks)
    return first, np.append(first[1:], len(breaks)) - 1


def covered(owner: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of a window of the owner, low, high) of the words that windows at ``start`` cover, sorted by owner and start."""
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    first, last = stretches(np.append(True, (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + width)))
    return first, start[first], start[last] + width


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids with 0 for null, whether each is null, prints)."""
    ids = batch.column("doc_id")
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), batch.column("print").to_numpy(zero_copy_only=False)


def first_windows(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    """Per run: run, place, hash, minimiser of its windows, their standing in the run, and rows' ids, nulls and prints."""
    ids, nulls, prints = _ids(batch)
    for run in runs(batch.column("text"), BLANKS, width - 1):
        place, hashes, least = windows(run, width)
        row = run.row[place]
        stand = standing(run.code, place, hashes, width, [run.at[place], prints[row], ids[row], nulls[row]])
        yield run, place, hashes, least, stand, (ids, nulls, prints)


def breaks(place: np.ndarray, row: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Where a stretch of consecutive windows with one minimiser begins."""
    return np.append(True, (place[1:] != place[:-1] + 1) | (row[1:] != row[:-1]) | (least[1:] != least[:-1]))


def counted(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Windows and stretches of each minimiser of each run."""
    schema = pa.schema([("hash", pa.int64()), ("n", pa.int64()), ("stretches", pa.int64())])
    for batch in batches:
        for run, place, _, least, stand, _ in first_windows(batch, width):
            on = np.flatnonzero(stand == FIRST)
            if not len(on):
                continue
            first, last = stretches(breaks(place[on], run.row[place[on]], least[on]))
            found, of, n = np.unique(least[on][first], return_inverse=True, return_counts=True)
            yield _batch(schema, found.view(np.int64), np.bincount(of.reshape(-1), last - first + 1).astype(np.int64), n)


def travelling(batches: Iterator[pa.RecordBatch], width: int, shared: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed stretches of the first windows that may have equals elsewhere, and the words that later ones in a run cover."""
    for batch in batches:
        for run, place, hashes, least, stand, (ids, nulls, prints) in first_windows(batch, width):
            row = run.row[place]
            on = np.flatnonzero((stand == FIRST) & passes(shared, least))
            if len(on):
                alone = passes(hot, least[on])
                p, r = place[on], row[on]
                starts = breaks(p, r, least[on])
                starts[1:] |= alone[1:] | alone[:-1]
                first, last = stretches(starts)
                text, begin = run.joined()
                low, high = begin[p[first]], begin[p[last] + width - 1] + run.length[p[last] + width - 1]
                packed = [text[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                key = np.where(alone[first], hashes[on][first], least[on][first])
                yield _batch(TRAVELLER, key.view(np.int64), pa.array(ids[r[first]], mask=nulls[r[first]]), prints[r[first]], run.at[p[first]], pa.nulls(len(first), pa.int64()), packed)
            gone = np.flatnonzero(stand == LATER)
            at, from_, to = covered(row[gone], run.at[place[gone]], width)
            back = row[gone][at]
            if len(back):
                key = mixed(prints[back].view(np.uint64)).view(np.int64)
                yield _batch(TRAVELLER, key, pa.array(ids[back], mask=nulls[back]), prints[back], from_, to, pa.nulls(len(back), pa.binary()))


def met(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The covered words of a bucket partition, which holds all windows of its keys; what is covered already passes."""
    held = []
    for batch in batches:
        done = batch.filter(batch.column("packed").is_null())
        yield done.select(MARK.names)
        held.append(batch.filter(batch.column("packed").is_valid()))
    table = pa.Table.from_batches(held, TRAVELLER).combine_chunks() if held else None
    if table is None or not len(table):
        return
    batch = table.to_batches()[0]
    ids, nulls, prints = _ids(batch)
    low = batch.column("low").to_numpy()
    whole = list(runs(batch.column("packed"), BLANKS, width - 1, size=1 << 31))
    for run in whole:
        place, hashes, _ = windows(run, width)
        row = run.row[place]
        start = low[row] + run.at[place]
        gone = np.flatnonzero(standing(run.code, place, hashes, width, [start, prints[row], ids[row], nulls[row]]) == LATER)
        at, from_, to = covered(row[gone], start[gone], width)
        back = row[gone][at]
        yield _batch(MARK, pa.array(ids[back], mask=nulls[back]), prints[back], from_, to)


def kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    for batch in batches:
        texts, marks = batch.column("text"), batch.column("marks")
        n, gone, out = [], [], []
        for text, spans in zip(texts, marks, strict=True):
            words = (text.as_py() or b"").split()
            stay = np.ones(len(words), bool)
            for span in spans.as_py() or ():
                stay[span["low"] : span["high"]] = False
            n.append(len(words))
            gone.append(len(words) - int(stay.sum()))
            out.append(b" ".join(words if stay.all() else [words[i] for i in np.flatnonzero(stay)]).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], schema=schema)


def substring_dedup(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each document without the words of windows that also start earlier.

    Windows are judged on the input. Earlier is a smaller doc_id, or an earlier start in one document; null ids come last, and documents of one
    id go by the hash of their text. Rows equal in id and text are one document: they don't count as copies of each other, and
    all get its result. Texts that are null or have fewer than ``width`` words stay as they are, apart from blanks (one space between words). Only doc_id and
    text are read. An empty table gives no rows. ``docs`` must give the same rows in the same order when a task is run again, as files do.
    """
    if width < 1:
        raise ValueError("a window has a word at least")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), F.encode("text", "UTF-8").alias("text"))
    least = rows.mapInArrow(lambda batches: counted(batches, width), "hash long, n long, stretches long").groupBy("hash").agg(F.sum("n").alias("n"), F.sum("stretches").alias("stretches"))
    least = stored(least.where("stretches > 1").select("hash", "n"), "substrings-minimisers")
    n_shared, total, n_hot = least.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > HOT)).first()
    shared = spark.sparkContext.broadcast(bitmap(least, filter_size(n_shared, 1 << 30)))
    hot = spark.sparkContext.broadcast(bitmap(least.where(F.col("n") > HOT), filter_size(n_hot)))
    found = rows.mapInArrow(lambda batches: travelling(batches, width, shared.value, hot.value), "key long, doc_id long, print long, low long, high long, packed binary")
    found = found.repartition(max(1, -(-total // BUCKET)), "key").mapInArrow(lambda batches: met(batches, width), "doc_id long, print long, low long, high long")
    marks = stored(found.groupBy("doc_id", "print").agg(F.collect_set(F.struct("low", "high")).alias("marks")), "substrings-marks")
    key = lambda df, p: df.select(F.coalesce("doc_id", F.lit(0)).alias("at_id"), F.isnull("doc_id").alias("at_null"), F.col("print").alias("at_print"), *p)
    joined = key(rows, ["doc_id", "text"]).join(key(marks, ["marks"]).hint("merge"), ["at_id", "at_null", "at_print"], "left")
    return joined.select("doc_id", "text", "marks").mapInArrow(kept_words, "doc_id long, n_words long, n_removed long, kept_text string")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the kept words."""
    digest: Column = F.sha2(F.encode("kept_text", "UTF-8"), 256)
    return found.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))
