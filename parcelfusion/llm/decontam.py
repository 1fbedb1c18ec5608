"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit check.

Texts are word sequences (A-Z lower-cased, ASCII punctuation removed); in scripts without spaces every character is a
word, and their punctuation is none. A CGK random walk reads a window:
at step j it writes the word under its pointer and moves on by a random bit that depends on j and the word,
so windows a few edits apart write strings a small Hamming distance apart. Each repetition draws its own
bits and its own sample of steps; the words written at those steps are the LSH key.

Items are embedded at every ``ANCHOR``-th word (short ones at every word), documents at every word of the whole text. The first step is always
among the sampled ones and keys are looked up as they grow, so nearly all windows of a clean document end after two
samples. Items of similar length form a family with its own repetitions, which are added until simulated items with the
most edits allowed are found at the target recall at every length (``strata``). What collides is checked exactly: least edits, in words, that turn the item into some stretch of
the document.

Items under ``MIN_WORDS`` words are found by equal runs of words: one with k edits allowed is cut into k + 1 pieces, of which
one stays whole.

Items are taken in blocks of bounded size, each broadcast against all documents: a stated query set in
blocks. Result rows are only documents that hold an item.

Edge cases: null texts and items, and items without words, match nothing; equal items are reported each; repeated documents are
reported each, and so are rows that share a doc_id; ids may be null and pass through as they are; ``decontaminate`` judges each row by its
own text; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES

MIN_WORDS, ANCHOR, BLOCK_ITEMS = 5, 4, 20_000
#: Walk steps and samples for long items, and for those under LONG words; least words of the items of each family.
LONG, STEPS, SAMPLES, SHORT_STEPS, SHORT_SAMPLES = 12, 18, 6, 5, 3
CLASSES = [MIN_WORDS, LONG, 15, 20, 30]
#: Simulated items a length; repetitions after which a family that still misses the target is an error.
TRIALS, MAX_REPEATS = 400, 400
#: Thai to Tibetan, Myanmar, Khmer, kana and Han; CJK and full-width punctuation.
SPACELESS = re.compile("([\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
STOPS = re.compile("[\u3000-\u3004\u3008-\u303f\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
PUNCTUATION = string.punctuation.encode()
MULT = np.uint64(0x9E3779B97F4A7C15)
#: Lookup tables of grown keys have 2^SPARE slots a window of the items, so that few slots are taken, and 2^22 at most: a block's
#: tables, some forty, stay under 200 MB.
SPARE, MOST_BITS = 6, 22
#: Words of documents searched at once, rounded up to whole documents.
RUN_WORDS = 100_000
RESULT = "doc_id long, item_id long, edits int, item_words int, at_word long"
NAMES, KINDS = ["doc_id", "item_id", "edits", "item_words", "at_word"], [pa.int64(), pa.int32(), pa.int32(), pa.int64()]


def words(text: str | None) -> list[bytes]:
    text = text or ""
    if not text.isascii() and SPACELESS.search(text):
        text = SPACELESS.sub(r" \1 ", STOPS.sub(" ", text))
    return text.encode("utf-8", "replace").translate(LOWER_BYTES, PUNCTUATION).split()


def grow(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key after one more sampled word."""
    key = (key ^ word.astype(np.uint64)) * MULT
    return key ^ (key >> np.uint64(29))


def slot(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def fitting_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least word edits between ``item`` and a stretch of ``text``, where that stretch ends)."""
    cols = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - cols) + cols
    end = int(row.argmin())
    return int(row[end]), end


class Family:
    """The LSH of the items of one length class."""

    def __init__(self, items: list[np.ndarray], numbers: list[int], size: int, steps: int, samples: int, seed: int):
        self.items, self.numbers, self.size, self.steps, self.samples = items, numbers, size, steps, samples
        self.rng = np.random.default_rng(seed)
        self.repeats: list[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]] = []
        starts = [(n, o) for n, x in enumerate(items) for o in range(0, max(1, len(x) - steps // 2), ANCHOR if len(x) >= 2 * LONG else 1)]
        self.where = np.array(starts, np.int64).reshape(-1, 2)
        longest = max(map(len, items), default=0)
        self.padded = np.full((len(items), longest + steps), -1, np.int64)
        for n, x in enumerate(items):
            self.padded[n, : len(x)] = x
        self.bits = min(MOST_BITS, max(10, int(np.ceil(np.log2(len(starts)))) + SPARE))
        self.first = np.zeros(size, bool)
        self.first[self.padded[self.where[:, 0], self.where[:, 1]]] = True

    def add_repeat(self) -> None:
        steps = np.sort(np.r_[0, 1 + self.rng.choice(self.steps - 1, self.samples - 1, replace=False)])
        bits = self.rng.integers(0, 2, (self.steps, self.size), dtype=np.int8)
        n, i = self.where[:, 0], self.where[:, 1].copy()
        key, live, tables = np.zeros(len(n), np.uint64), np.ones(len(n), bool), []
        for j in range(int(steps[-1]) + 1):
            word = self.padded[n, i]
            live &= word >= 0  # the walk left the item
            if j in steps:
                key = grow(key, word)
                if j:
                    table = np.zeros(1 << self.bits, bool)
                    table[slot(key[live], self.bits)] = True
                    tables.append(table)
            i = i + bits[j][np.maximum(word, 0)]
        order = np.argsort(key[live], kind="stable")
        self.repeats.append((steps, bits, tables, key[live][order], np.flatnonzero(live)[order]))

    def caught(self, trials: list[tuple[int, np.ndarray]], percent: int) -> np.ndarray:
        """Whether the last repetition finds each trial's item (its number here) where the exact check will confirm it."""
        if not trials:
            return np.zeros(0, bool)
        gap = np.zeros(self.steps, np.int64)
        joined = np.concatenate([x for _, t in trials for x in (t, gap)])
        begins = np.cumsum([0] + [len(t) + self.steps for _, t in trials[:-1]])
        found, wanted = np.zeros(len(trials), bool), np.array([n for n, _ in trials])
        for at, lo, hi, owners in self.hits(joined, self.repeats[-1:]):
            of = np.searchsorted(begins, at, "right") - 1
            for k, p, a, b in zip(of, at, lo, hi, strict=True):
                n, o = self.where[owners[a:b]].T
                slack = percent * len(self.items[wanted[k]]) // 100 + ANCHOR
                found[k] = found[k] or ((n == wanted[k]) & (np.abs(p - begins[k] - o) <= slack)).any()
        return found

    def collisions(self, text: np.ndarray) -> set[tuple[int, int, int]]:
        """(item number here, window start in ``text``, word of the item that this window starts at)."""
        found: set[tuple[int, int, int]] = set()
        for at, lo, hi, owners in self.hits(text, self.repeats):
            for p, a, b in zip(at, lo, hi, strict=True):
                for n, o in self.where[owners[a:b]]:
                    found.add((int(n), int(p), int(o)))
        return found

    def hits(self, text: np.ndarray, repeats: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By repetition: starts of windows whose key an item has, and the range of its owners."""
        start = np.flatnonzero(self.first[text])
        tail = np.zeros(self.steps, text.dtype)
        text = np.concatenate([text, tail])
        for steps, bits, tables, keys, owners in repeats:
            at, i = start, start
            key = grow(np.zeros(len(at), np.uint64), text[i])
            level = 0
            for j in range(int(steps[-1]) + 1):
                if not len(at):
                    break
                word = text[i]
                if j and j in steps:
                    key = grow(key, word)
                    on = tables[level][slot(key, self.bits)]
                    level += 1
                    at, i, key, word = at[on], i[on], key[on], word[on]
                i = i + bits[j][word]
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            yield at[hi > lo], lo[hi > lo], hi[hi > lo], owners


class Runs:
    """The items too short for a walk, by equal runs of words."""

    def __init__(self, items: list[np.ndarray], numbers: list[int], percent: int, size: int):
        self.items, self.numbers = items, numbers
        self.first = np.zeros(size, bool)
        #: By length of the piece, and by its key: (item number here, word of the item that the piece starts at).
        self.pieces: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for n, x in enumerate(items):
            cuts = np.array_split(np.arange(len(x)), min(len(x), percent * len(x) // 100 + 1))
            for cut in cuts:
                self.first[x[cut[0]]] = True
                key = int(self.keys(x[cut], len(cut))[0])
                self.pieces.setdefault(len(cut), {}).setdefault(key, []).append((n, int(cut[0])))
        self.known = {k: np.array(sorted(v), np.uint64) for k, v in self.pieces.items()}

    @staticmethod
    def keys(text: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
        at = np.arange(len(text) - length + 1) if at is None else at
        key = np.zeros(len(at), np.uint64)
        for j in range(length):
            key = grow(key, text[at + j])
        return key

    def collisions(self, text: np.ndarray) -> set[tuple[int, int, int]]:
        """(item number here, start of the piece in ``text``, word of the item that the piece starts at)."""
        found: set[tuple[int, int, int]] = set()
        start = np.flatnonzero(self.first[text])
        for length, known in self.known.items():
            at = start[start <= len(text) - length]
            key = self.keys(text, length, at)
            on = np.isin(key, known)
            for p, k in zip(at[on].tolist(), key[on].tolist(), strict=True):
                for n, o in self.pieces[length][k]:
                    found.add((n, p, o))
        return found


def strata(items: list[np.ndarray]) -> dict[int, list[int]]:
    """Numbers of the items by length, those of 30 words and more by doubled length."""
    out: dict[int, list[int]] = {}
    for n, x in enumerate(items):
        out.setdefault(len(x) if len(x) < 30 else 30 + int(np.log2(len(x) / 30)), []).append(n)
    return out


def edited(item: np.ndarray, percent: int, rng: np.random.Generator) -> np.ndarray:
    """``item`` after the most edits allowed."""
    x = item.tolist()
    for _ in range(percent * len(x) // 100):
        k, kind = int(rng.integers(0, len(x))), rng.integers(0, 3)
        x[k : k + 1] = [[], [0], [x[k], 0]][kind]
    return np.array(x, np.int64)


class Searcher:
    """A block of items: finds those that a text holds within ``percent`` word edits."""

    def __init__(self, items: Sequence[tuple[int, str]], percent: int = 20, recall: float = 0.995, seed: int = 5):
        self.percent, self.vocabulary = percent, {}
        split = [(i, words(t)) for i, t in items]
        split = [(i, w) for i, w in split if w]
        for _, ws in split:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)  # 0: a word of no item
        coded = [(i, self.code(w)) for i, w in split]
        self.families: list[Family | Runs] = []
        for k, least in enumerate(CLASSES):
            own = [(i, x) for i, x in coded if least <= len(x) < (*CLASSES, np.inf)[k + 1]]
            if own:
                shape = (SHORT_STEPS, SHORT_SAMPLES) if least < LONG else (STEPS, SAMPLES)
                family = Family([x for _, x in own], [i for i, _ in own], len(self.vocabulary) + 1, *shape, seed + k)
                self.tune(family, recall, seed)
                self.families.append(family)
        few = [(i, x) for i, x in coded if len(x) < MIN_WORDS]
        if few:
            self.families.append(Runs([x for _, x in few], [i for i, _ in few], percent, len(self.vocabulary) + 1))

    def code(self, ws: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))

    def tune(self, family: Family, recall: float, seed: int) -> None:
        """Add repetitions until edited items of every stratum of length are found at the target recall."""
        rng = np.random.default_rng([seed, 1])
        of, trials = [], []
        for stratum, numbers in strata(family.items).items():
            for n in rng.choice(numbers, TRIALS):
                of.append(stratum)
                trials.append((int(n), edited(family.items[n], self.percent, rng)))
        missed, of = np.arange(len(trials)), np.array(of)
        while len(family.repeats) < 4 or np.bincount(of[missed], minlength=1).max() > (1 - recall) * TRIALS:
            if len(family.repeats) == MAX_REPEATS:
                raise ValueError(f"recall {recall} at {self.percent} % of edits is not reached in {MAX_REPEATS} repetitions, for items of {min(map(len, family.items))} words and more")
            family.add_repeat()
            missed = missed[~family.caught([trials[t] for t in missed], self.percent)]

    def find(self, texts: Sequence[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item id, edits, item words, first word of the window) of every item that a text holds.

        Texts are searched some ``RUN_WORDS`` words at a time, with a gap of no item's words between them.
        """
        run: list[tuple[int, np.ndarray]] = []
        held = 0
        for number, text in enumerate(texts):
            run.append((number, self.code(words(text))))
            held += len(run[-1][1])
            if held >= RUN_WORDS:
                yield from self.find_run(run)
                run, held = [], 0
        yield from self.find_run(run)

    def find_run(self, run: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, int, int, int]]:
        gap = np.zeros(STEPS, np.int64)
        joined = np.concatenate([x for _, c in run for x in (c, gap)] or [gap])
        begins = np.cumsum([0] + [len(c) + STEPS for _, c in run])
        for family in self.families:
            hits: dict[tuple[int, int], set[int]] = {}
            for n, p, o in family.collisions(joined):
                k = int(np.searchsorted(begins, p, "right")) - 1
                hits.setdefault((k, n), set()).add(p - o - int(begins[k]))
            for (k, n), starts in sorted(hits.items()):
                number, coded = run[k]
                item, best, done = family.items[n], None, None
                allowed = self.percent * len(item) // 100
                slack = allowed + ANCHOR
                for p in sorted(starts):
                    if best and not best[0]:
                        break
                    if done is not None and p - done <= slack:
                        continue  # inside the stretch just searched
                    done = p
                    low = max(0, p - 2 * slack)
                    edits, end = fitting_edits(item, coded[low : max(0, p) + len(item) + 2 * slack])
                    if edits <= allowed and (best is None or edits < best[0]):
                        best = edits, max(0, low + end - len(item))
                if best:
                    yield number, family.numbers[n], best[0], len(item), best[1]


def searchers(benchmark: DataFrame, percent: int, recall: float) -> list[Broadcast]:
    """A searcher for each block of items, broadcast; a block has some ``BLOCK_ITEMS`` items."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    out = []
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text")
        out.append(benchmark.sparkSession.sparkContext.broadcast(Searcher([(r[0], r[1]) for r in block.collect()], percent, recall)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 20, recall: float = 0.995) -> DataFrame:
    """doc_id, item_id, edits, item_words, at_word: each benchmark item that a document holds, its closest place."""
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    found = None
    for block in searchers(benchmark, percent, recall):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(block.value.find(batch.column("text").to_pylist()))
                rows, *columns = zip(*hits, strict=True) if hits else ((),) * 5
                columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, KINDS, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, NAMES)

        part = texts.mapInArrow(run, RESULT)
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = 20, recall: float = 0.995) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay."""
    for block in searchers(benchmark, percent, recall):
        docs = docs.where(clean(block)(F.col("text")))
    return docs


def clean(block: Broadcast) -> Callable[[Column], Column]:
    """Whether a text holds no item of the block."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            hit = {n for n, *_ in block.value.find(texts.tolist())}
            yield pd.Series([k not in hit for k in range(len(texts))], dtype=bool)

    return F.pandas_udf(run, "boolean")
