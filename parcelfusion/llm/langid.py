"""Language identification with a linear-chain conditional random field over words.

Each word has hashed features: affixes, character n-grams (bytes of its UTF-8 form, with the word's ends marked), and a lexicon
feature for each language's frequent training words. Label transitions are learned from training sequences, half of
which switch language midway. Forward-backward gives every word of a text its label probabilities;
a document takes the label with the largest mean, and that mean is its score.

A word is a letter with the letters and combining marks after it; one of more than ``WIDTH`` bytes, as whole clauses are in
scripts without spaces, is read in pieces of ``PIECE`` characters, so every character counts.

Training uses a bounded sample: at most ``docs_per_lang`` documents for each language, the first by a hash of id and text, and
of each at most ``MAX_CHARS`` characters. More than ``MAX_LANGS`` languages are an error, not a cut. Prediction reads
whole texts of all documents.

Edge cases: null texts and texts without a letter are ``und`` with score 0, as is everything where nothing
can be learned; ids may be null and pass through as they are; repeated rows are predicted each; null langs teach nothing;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

ASCII_WORD, WORD = re.compile("[a-z]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*")
MAX_CHARS, MAX_LANGS = 20_000, 1000
#: Bytes of a word read whole, and characters (of at most four bytes) of the pieces of longer ones.
WIDTH, PIECE = 32, 8
#: Hashed feature slots; lexicon words a language.
SLOTS, LEXICON = 1 << 16, 400
SEQUENCE, ROUNDS, RATE, DECAY = 32, 30, 0.15, 1e-4
CACHE, RUN_TOKENS = 400_000, 300_000
UND = "und"
RESULT = "doc_id long, lang_pred string, score double"
WORDS = "doc_id long, at long, word string, label string, probability double"


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a row is in the fold: CRC-32 of its id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def tokens(text: str | None) -> list[str]:
    low = (text or "").lower()
    plain = low.isascii()
    found = ASCII_WORD.findall(low) if plain else WORD.findall(low)
    most = WIDTH if plain else PIECE
    if not any(len(w) > most for w in found):
        return found
    cut = lambda w: [w] if len(w) <= most or len(w.encode("utf-8", "replace")) <= WIDTH else [w[i : i + PIECE] for i in range(0, len(w), PIECE)]
    return [piece for w in found for piece in cut(w)]


def hashed(value: np.ndarray, tag: int) -> np.ndarray:
    x = (value + np.uint64(tag << 56)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(33)).astype(np.int64) % SLOTS


def word_features(words: list[str]) -> np.ndarray:
    """(words, features) slots; SLOTS stands for none."""
    raw = [w.encode("utf-8", "replace") for w in words]
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    body = np.zeros((len(raw), WIDTH + 4), np.uint64)
    body[:, 1 : WIDTH + 1] = np.array(raw, f"S{WIDTH}").view(np.uint8).reshape(len(raw), WIDTH)
    body[:, 0] = 1
    row = np.arange(len(raw))
    body[row, n + 1] = 2
    pair = body[:, :-1] * np.uint64(256) + body[:, 1:]
    triple = pair[:, :-1] * np.uint64(256) + body[:, 2:]
    at = np.arange(WIDTH)
    grams = np.where(at < n[:, None], hashed(triple[:, :WIDTH], 1), SLOTS)
    pairs = np.where(at < n[:, None] - 1, hashed(pair[:, 1 : WIDTH + 1], 2), SLOTS)
    start = hashed(triple[:, 0] * np.uint64(256) + body[:, 3], 3)
    last = np.maximum(n - 2, 0)
    end = hashed(pair[row, last] * np.uint64(65536) + pair[row, last + 2], 4)
    whole = np.zeros(len(raw), np.uint64)
    for k in range(WIDTH + 1):
        whole = (whole ^ body[:, k + 1]) * np.uint64(0x100000001B3)
    return np.column_stack([grams, pairs, start, end, hashed(whole & np.uint64(2**55 - 1), 5)])


class Crf:
    """Labels, weights of features, of lexicons and of transitions."""

    def __init__(self, labels: list[str], lexicon: dict[str, np.ndarray]):
        self.labels, self.lexicon = labels, lexicon
        k = len(labels)
        self.weights = np.zeros((SLOTS + 1, k), np.float32)
        self.lexical = np.zeros((k, k), np.float32)
        self.steps = np.zeros((k, k), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for i in range(0, len(words), 8192):
            part = words[i : i + 8192]
            out[i : i + 8192] = self.weights[word_features(part)].sum(axis=1)
            out[i : i + 8192] += self.in_lexicon(part) @ self.lexical
        return out

    def in_lexicon(self, words: list[str]) -> np.ndarray:
        none = np.zeros(len(self.labels), np.float32)
        return np.array([self.lexicon.get(w, none) for w in words], np.float32).reshape(len(words), len(self.labels))

    def marginals(self, emit: np.ndarray, lengths: np.ndarray, pairs: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """Forward-backward over sequences laid end to end, the longest first: label probabilities of each word, and the
        sum of the sequences' log partition functions. The expected label pairs of neighbours are added to ``pairs``."""
        begin = np.cumsum(lengths) - lengths
        tops, most = emit.max(axis=1, keepdims=True), self.steps.max()
        scale = np.exp(emit - tops) + 1e-30
        move = np.exp(self.steps - most)
        live = np.searchsorted(-lengths, -np.arange(int(lengths.max())), "left")  # sequences longer than t
        ahead = np.empty_like(scale)
        log_z = float(tops.sum(dtype=np.float64)) + float(most) * float((lengths - 1).sum())
        a = None
        for t, n in enumerate(live):
            at = begin[:n] + t
            a = scale[at] if a is None else (a[:n] @ move) * scale[at]
            total = a.sum(axis=1, keepdims=True)
            log_z += float(np.log(total).sum(dtype=np.float64)) if pairs is not None else 0.0
            a /= total
            ahead[at] = a
        back = np.ones((0, emit.shape[1]), emit.dtype)
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            at = begin[:n] + t
            if len(back) < n:
                back = np.concatenate([back, np.ones((n - len(back), emit.shape[1]), emit.dtype)])
            inward = scale[at] * back
            if pairs is not None and t:
                joint = ahead[at - 1][:, :, None] * move * inward[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            both = ahead[at] * back
            back = inward @ move.T
            back /= back.sum(axis=1, keepdims=True)
            ahead[at] = both / both.sum(axis=1, keepdims=True)
        return ahead, log_z

    def loss(self, sample: Sample) -> tuple[float, list[np.ndarray]]:
        """Mean negative log-likelihood of the sample's labels with a small penalty, and its gradients."""
        n, k = len(sample.word), len(self.labels)
        emit = (self.weights[sample.slots].sum(axis=1) + sample.listed @ self.lexical)[sample.word]
        expected = np.zeros((k, k))
        prob, log_z = self.marginals(emit, sample.lengths, expected)
        score = emit[np.arange(n), sample.label].sum(dtype=np.float64) + (sample.pairs * self.steps).sum()
        miss = prob / n
        miss[np.arange(n), sample.label] -= 1 / n
        by_word = np.column_stack([np.bincount(sample.word, miss[:, c], len(sample.slots)) for c in range(k)])
        flat = sample.slots.ravel()
        each = np.column_stack([np.bincount(flat, np.repeat(by_word[:, c], sample.slots.shape[1]), SLOTS + 1) for c in range(k)])
        each[SLOTS] = 0  # no feature
        params = [self.weights, self.lexical, self.steps]
        grads = [each, sample.listed.T @ by_word, (expected - sample.pairs) / n]
        penalty = DECAY / 2 / n * sum(float((p * p).sum(dtype=np.float64)) for p in params)
        return (log_z - score) / n + penalty, [g + DECAY / n * p for g, p in zip(grads, params, strict=True)]

    def fit(self, texts: list[tuple[list[str], int]], seed: int = 11) -> None:
        """Adam on the mean negative log-likelihood of labelled word sequences."""
        sample = Sample(self, texts, seed)
        params = [self.weights, self.lexical, self.steps]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, ROUNDS + 1):
            _, grads = self.loss(sample)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


class Sample:
    """Training sequences: pieces of texts, half of them joined to a piece in another language, the longest first."""

    def __init__(self, model: Crf, texts: list[tuple[list[str], int]], seed: int):
        rng = np.random.default_rng(seed)
        half = SEQUENCE // 2
        pieces = [(ws[i : i + half], y) for ws, y in texts for i in range(0, len(ws), half)]
        order = rng.permutation(len(pieces))
        sequences = [[pieces[i], pieces[j]] for i, j in zip(order[::2], order[1::2], strict=False)] or [[p] for p in pieces]
        if len(pieces) > 1:  # every second sequence goes on in its own language
            of = {y: [p for p in pieces if p[1] == y] for _, y in pieces}
            sequences = [[a, of[a[1]][int(rng.integers(len(of[a[1]])))]] if k % 2 else [a, b] for k, (a, b) in enumerate(sequences)]
        sequences.sort(key=lambda s: -sum(len(ws) for ws, _ in s))
        self.lengths = np.array([sum(len(ws) for ws, _ in s) for s in sequences])
        number: dict[str, int] = {}
        self.word = np.array([number.setdefault(w, len(number)) for s in sequences for ws, _ in s for w in ws])
        self.label = np.array([y for s in sequences for ws, y in s for _ in ws])
        begins = np.zeros(len(self.word), bool)
        begins[np.cumsum(self.lengths) - self.lengths] = True
        words, k = list(number), len(model.labels)
        self.slots, self.listed = word_features(words), model.in_lexicon(words)
        inside = ~begins[1:]
        self.pairs = np.bincount(self.label[:-1][inside] * k + self.label[1:][inside], minlength=k * k).reshape(k, k)


class Tagger:
    """Predicts documents; keeps the emissions of words that it has met."""

    def __init__(self, model: Crf):
        self.model, self.known, self.emit = model, {}, np.zeros((0, len(model.labels)), np.float32)

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > CACHE:
            self.known, self.emit = {}, self.emit[:0]
        known, had = self.known, len(self.known)
        out = [np.fromiter((known.setdefault(w, len(known)) for w in ws), np.int64, len(ws)) for ws in texts]
        if len(known) > had:
            new = list(known)[had:]
            self.emit = np.concatenate([self.emit, self.model.emissions(new)])
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UND, 0.0)] * len(texts)
        for run in runs(texts):
            coded = self.numbers([ws for _, ws in run])
            lengths = np.array([len(c) for c in coded])
            prob, _ = self.model.marginals(self.emit[np.concatenate(coded)], lengths)
            mean = np.add.reduceat(prob, np.cumsum(lengths) - lengths, axis=0, dtype=np.float64) / lengths[:, None]
            for (k, _), m in zip(run, mean, strict=True):
                best = int(m.argmax())
                out[k] = self.model.labels[best], float(min(1.0, m[best]))
        return out


    def label(self, text: str | None) -> list[tuple[str, str, float]]:
        """(word, label, probability) of each word of a text, which may switch languages."""
        ws = tokens(text)
        if not ws:
            return []
        coded = self.numbers([ws])[0]
        prob, _ = self.model.marginals(self.emit[coded], np.array([len(ws)]))
        return [(w, self.model.labels[int(p.argmax())], float(min(1.0, p.max()))) for w, p in zip(ws, prob, strict=True)]


def runs(texts: list[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
    """(number, words) of the texts that have words, the most words first, some RUN_TOKENS words at a time.

    Texts are split as their run comes up, so that no more words than those of a run are held.
    """
    run, held = [], 0
    for k in sorted(range(len(texts)), key=lambda k: -len(texts[k] or "")):
        words = tokens(texts[k])
        if words:
            run.append((k, words))
            held += len(words)
            if held >= RUN_TOKENS:
                yield sorted(run, key=lambda r: -len(r[1]))
                run, held = [], 0
    if run:
        yield sorted(run, key=lambda r: -len(r[1]))


def train(docs: DataFrame, docs_per_lang: int = 150) -> Crf | None:
    """The model of a bounded sample of the labelled ``docs``, or None without any."""
    key = F.md5(F.concat_ws(":", "doc_id", F.xxhash64("text")).cast("binary")).alias("key")
    labelled = docs.where("lang is not null and text is not null")
    langs = [r[0] for r in labelled.select("lang").distinct().limit(MAX_LANGS + 1).collect()]
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    place = F.row_number().over(W.partitionBy("lang").orderBy("key"))
    some = stored(labelled.select("lang", key).withColumn("n", place).where(F.col("n") <= docs_per_lang).select("lang", "key").distinct(), "language-sample")
    # At most MAX_LANGS * docs_per_lang keys, and as many texts.
    rows = labelled.select("lang", key, F.substring("text", 1, MAX_CHARS).alias("text")).join(F.broadcast(some), ["lang", "key"], "left_semi")
    rows = rows.groupBy("lang", "key").agg(F.max("text").alias("text")).select("key", "lang", "text").collect()
    labels = sorted(langs)
    texts = [(tokens(r["text"]), labels.index(r["lang"])) for r in sorted(rows)]
    texts = [x for x in texts if x[0]]
    if not texts:
        return None
    lexicon: dict[str, np.ndarray] = {}
    for y in range(len(labels)):
        words, counts = np.unique(np.array([w for ws, at in texts if at == y for w in ws] or [""]), return_counts=True)
        for w in words[np.argsort(-counts, kind="stable")[:LEXICON]].tolist():
            lexicon.setdefault(w, np.zeros(len(labels), np.float32))[y] = 1
    model = Crf(labels, lexicon)
    model.fit(texts)
    return model


def predict(docs: DataFrame, model: Crf | None) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value) if shared.value else None
        for batch in batches:
            said = tagger.predict(batch.column("text").to_pylist()) if tagger else [(UND, 0.0)] * len(batch)
            columns = [batch.column("doc_id"), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def label_words(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, at (the word's number in its text), word, label and its probability, of every word of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            for k, text in enumerate(batch.column("text").to_pylist()):
                said = tagger.label(text)
                if said:
                    ids = batch.column("doc_id").take(pa.array([k] * len(said)))
                    columns = [pa.array(c, t) for c, t in zip(zip(*said, strict=True), (pa.string(), pa.string(), pa.float64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(range(len(said)), pa.int64()), *columns], ["doc_id", "at", "word", "label", "probability"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, WORDS)


def identify(docs: DataFrame, docs_per_lang: int = 150) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    out = held_out(F.col("doc_id"), 5, 0)
    return predict(docs, train(docs.where(~out), docs_per_lang)).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.35, docs_per_lang: int = 150) -> DataFrame:
    """``docs`` without those whose language is undetermined: ``und``, or no language with a mean of ``least``."""
    model = train(docs.where(~held_out(F.col("doc_id"), 5, 0)), docs_per_lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(shared.value) if shared.value else None
        for batch in texts:
            yield pd.Series([s for _, s in tagger.predict(batch.tolist())] if tagger else np.zeros(len(batch)), dtype="float64")

    return docs.where(F.pandas_udf(scores, "double")(F.col("text")) >= least)
