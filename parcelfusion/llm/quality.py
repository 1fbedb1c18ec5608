"""Document quality: random-indexing word vectors pooled per document, and a calibrated two-layer network.

Tokens are words, numbers and runs of punctuation; a word in capitals or equal to the one before adds a token that says
so. A word's vector is the sum, over all its occurrences in all documents, of the sparse random index vectors of the tokens
around it; index vectors come from a hash of the token, so they need no table. Each task sums the vectors of its own
words, and Spark adds them up by word. The ``vocabulary`` most frequent words keep their vectors, cut where the counts of
the corpus say; the others share ``SHARED`` sums by a hash. So the table that goes to the tasks has a proven bound (8 MB).
A document is the mean and the spread of its tokens' vectors, frequent words weighing less, taken from its counts of
distinct words, so that long texts need no more memory than short ones. A network with one hidden layer, trained on a
bounded sample of labelled rows (``train_rows``, by a threshold on a hash of the id), gives a logit; a temperature fitted on
rows kept out of the training turns it into a probability.

Edge cases: null and empty texts are pooled to zeros and scored like any other; ids may be null and pass through as they
are; several labels of one doc_id count as their largest, and of several rows of one doc_id one teaches; null labels and
ids teach nothing; with no labels every score is 0.5, with one class its share; repeated rows are scored each; empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .langid import held_out

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
DIM, MARKS, AROUND, SHARED = 32, 2, 2, 4096
#: Words that no token can be; what a number counts as.
AGAIN, CAPITALS, NUMBER = "said again", "in capitals", "0"
#: Frequency at which a word weighs half.
USUAL = 1e-3
#: Characters of a text read at once; tokens read at once; words a task holds before it passes their sums on.
PIECE, RUN_TOKENS, HELD = 1 << 20, 200_000, 500_000
HIDDEN, EPOCHS, RATE = 32, 400, 0.01
THRESHOLD = 0.7


def plain(token: str) -> str:
    """The word that a token counts as."""
    word = token.lower()
    return word if word[0].isalpha() else NUMBER if word.isdigit() else word[:3]


class Words(dict):
    """Token -> twice the number of its word, plus one for a token in capitals; numbers come as tokens are met."""

    def __init__(self) -> None:
        self.restart()

    def restart(self) -> None:
        self.clear()
        self |= {AGAIN: 0, CAPITALS: 2}
        self.order = [AGAIN, CAPITALS]

    def __missing__(self, token: str) -> int:
        word = plain(token)
        if word != token:
            n = self[word] >> 1
        else:
            n = len(self.order)
            self.order.append(word)
        self[token] = out = 2 * n + (len(token) > 1 and token.isupper())
        return out


def pieces(text: str) -> Iterator[list[str]]:
    """Tokens of a text, ``PIECE`` characters at a time, cut at white space where there is any."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            end = next((k for k in range(end, max(at, end - 1000), -1) if text[k - 1].isspace()), end)
        yield TOKEN.findall(text, at, end)
        at = end


def read(texts: list[str | None], words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, the text each stands in) of some ``RUN_TOKENS`` tokens at a time, whole pieces."""
    tokens: list[str] = []
    owners, lengths = [], []

    def coded() -> tuple[np.ndarray, np.ndarray]:
        value = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
        word, loud, owner = value >> 1, value & 1, np.repeat(owners, lengths)
        again = np.zeros(len(word), np.int64)
        again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        # The marks of a token stand behind it.
        more = again + loud
        at = np.arange(len(word)) + np.cumsum(more) - more
        out = np.zeros(len(word) + int(more.sum()), np.int64)
        out[at] = word
        out[at[again == 1] + 1] = 0
        out[(at + again)[loud == 1] + 1] = 1
        return out, np.repeat(owner, 1 + more)

    for number, text in enumerate(texts):
        for piece in pieces(text or ""):
            tokens += piece
            owners.append(number)
            lengths.append(len(piece))
            if len(tokens) >= RUN_TOKENS:
                yield coded()
                tokens, owners, lengths = [], [], []
    if tokens:
        yield coded()


def index_vectors(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words, MARKS) places and signs, from a hash of each word."""
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64).reshape(-1, 1)
    shift = np.arange(MARKS, dtype=np.uint64) * np.uint64(8)
    return ((h >> shift) % np.uint64(DIM)).astype(np.int64), ((h >> (shift + np.uint64(40))) & np.uint64(1)).astype(np.int32) * 2 - 1


def context_sums(texts: Iterator[list[str | None]]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(words, counts, sums of the index vectors around each), the words of a task at once, or ``HELD`` at a time."""
    words, places, signs = Words(), *index_vectors([])
    counts, sums = np.zeros(1 << 12, np.int64), np.zeros((1 << 12) * DIM, np.int32)
    for batch in texts:
        for x, owner in read(batch, words):
            new = words.order[len(places) :]
            places, signs = (np.concatenate(both) for both in zip((places, signs), index_vectors(new), strict=True))
            n = len(places)
            if n > len(counts):
                room = max(n, 2 * len(counts)) - len(counts)
                counts, sums = np.pad(counts, (0, room)), np.pad(sums, (0, room * DIM))
            counts[:n] += np.bincount(x, minlength=n)
            for step in range(1, AROUND + 1):
                near = owner[:-step] == owner[step:]
                left, right = x[:-step][near], x[step:][near]
                for a, b in ((left, right), (right, left)):
                    for m in range(MARKS):
                        np.add.at(sums, a * DIM + places[b, m], signs[b, m])
            if n > HELD:
                yield words.order, counts[:n], sums[: n * DIM].reshape(-1, DIM)
                words.restart()
                places, signs = index_vectors([])
                counts[:], sums[:] = 0, 0
    n = len(places)
    if n:
        yield words.order, counts[:n], sums[: n * DIM].reshape(-1, DIM)


class Vectors:
    """Vectors and weights of the frequent words, and of the sums that the others share."""

    def __init__(self, words: list[str], vectors: np.ndarray, counts: np.ndarray):
        self.at = {w: k for k, w in enumerate(words)}
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        self.vectors = (vectors / np.maximum(length, 1e-9)).astype(np.float32)
        frequency = counts / max(1.0, counts.sum())
        self.weights = (USUAL / (USUAL + frequency)).astype(np.float32)
        self.words = len(words)

    def rows(self, words: list[str]) -> np.ndarray:
        get = self.at.get
        return np.array([k if (k := get(w)) is not None else self.words + zlib.crc32(w.encode("utf-8", "replace")) % SHARED for w in words], np.int64)


def word_vectors(docs: DataFrame, vocabulary: int) -> Vectors:
    """The vectors, from all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, counts, sums in context_sums(b.column("text").to_pylist() for b in batches):
            # Nearly all words of a task are rare: their sums fit in bytes.
            large = np.abs(sums).max(axis=1) > 127
            for some, kind, other in ((~large, pa.int8(), pa.int32()), (large, pa.int32(), pa.int8())):
                rows = np.flatnonzero(some & (counts > 0))
                for at in (rows[k : k + 10_000] for k in range(0, len(rows), 10_000)):
                    values = pa.array(sums[at].ravel().astype(kind.to_pandas_dtype()))
                    lists = pa.ListArray.from_arrays(pa.array(range(0, DIM * len(at) + 1, DIM), pa.int32()), values)
                    columns = [lists, pa.nulls(len(at), pa.list_(other))]
                    yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in at]), pa.array(counts[at]), *columns[:: 1 if kind == pa.int8() else -1]], ["word", "n", "small", "large"])

    value = lambda i: F.coalesce(F.col("small")[i].cast("int"), F.col("large")[i])
    total = lambda of: [F.sum("n").alias("n"), F.array(*[F.sum(of(i)) for i in range(DIM)]).alias("v")]
    # Dealt out before the grouping, as tasks have added up their own words already.
    rows = docs.select("text").mapInArrow(run, "word string, n long, small array<tinyint>, large array<int>").repartition("word")
    words = stored(rows.groupBy("word").agg(*total(value)), "quality-words")
    level = F.floor(8 * F.log2("n")).cast("int")
    levels = words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # at most 8 * 64 rows
    held, least = 0, 1 << 30
    for r in levels:
        held += r["count"]
        if held > vocabulary:
            break
        least = r["level"]
    slot = F.crc32(F.col("word").cast("binary")) % SHARED
    frequent = words.where(level >= least).select("word", "n", "v").toArrow().sort_by("word")  # at most ``vocabulary`` rows
    rare = words.where(level < least).groupBy(slot.alias("slot")).agg(*total(lambda i: F.col("v")[i])).select("slot", "n", "v").toArrow().sort_by("slot")
    count, vectors = np.zeros(len(frequent) + SHARED), np.zeros((len(frequent) + SHARED, DIM))
    at = np.concatenate([np.arange(len(frequent)), len(frequent) + rare["slot"].to_numpy()]).astype(np.int64)
    count[at] = np.concatenate([frequent["n"].to_numpy(), rare["n"].to_numpy()])
    vectors[at] = np.concatenate([np.array(t["v"].to_pylist(), np.float64).reshape(-1, DIM) for t in (frequent, rare)])
    return Vectors(frequent["word"].to_pylist(), vectors, count)


class Pool:
    """Pools texts: (texts, 2 DIM + 1) weighted mean and spread of the tokens' vectors, and the logarithm of their number."""

    def __init__(self, vectors: Vectors):
        self.vectors, self.words, self.rows = vectors, Words(), np.zeros(0, np.int64)

    def of(self, texts: list[str | None]) -> np.ndarray:
        if len(self.words) > 2 * HELD:
            self.words, self.rows = Words(), np.zeros(0, np.int64)
        size, table = self.vectors.words + SHARED, self.vectors.vectors
        n, weight, sums = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros((len(texts), 2 * DIM))
        for x, owner in read(texts, self.words):
            self.rows = np.concatenate([self.rows, self.vectors.rows(self.words.order[len(self.rows) :])])
            both, counts = np.unique(owner * size + self.rows[x], return_counts=True)
            of, at = both // size, both % size
            begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            v, w = table[at], (counts * self.vectors.weights[at]).astype(np.float32)
            there = of[begins]
            n[there] += np.add.reduceat(counts, begins)
            weight[there] += np.add.reduceat(w, begins, dtype=np.float64)
            sums[there] += np.add.reduceat(np.hstack([v, v * v]) * w[:, None], begins, axis=0)
        out = np.zeros((len(texts), 2 * DIM + 1), np.float32)
        some = n > 0
        mean = sums[some] / weight[some, None]
        out[some, :DIM], out[some, DIM:-1] = mean[:, :DIM], np.sqrt(np.maximum(0, mean[:, DIM:] - mean[:, :DIM] ** 2))
        out[some, -1] = np.log1p(n[some]) / 10
        return out


class Network:
    """Two layers, standardised input, logit over temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 17):
        self.share = float(y.mean()) if len(y) else 0.5
        self.fitted = len(y) >= 10 and 0 < self.share < 1
        if not self.fitted:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-4
        apart = rng.random(len(y)) < 0.2
        fit, kept = (~apart, apart) if 0 < y[~apart].mean() < 1 and apart.any() else (np.ones(len(y), bool),) * 2
        z, t = (x[fit] - self.mean) / self.scale, y[fit]
        self.w = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        weight = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean())) ** 0.5
        for epoch in range(1, EPOCHS + 1):
            at = rng.permutation(len(t))[:4096]
            h = np.tanh(z[at] @ self.w[0] + self.w[1])
            miss = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - t[at]) * weight[at] / len(at)
            inner = miss[:, None] * self.w[2] * (1 - h * h)
            grads = [z[at].T @ inner, inner.sum(axis=0), h.T @ miss, miss.sum(keepdims=True)]
            for w, g, a, b in zip(self.w, grads, m, v, strict=True):
                g = g + 1e-4 * w
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= RATE * (a / (1 - 0.9**epoch)) / (np.sqrt(b / (1 - 0.99**epoch)) + 1e-8)
        logit, t = self.logit(x[kept]), y[kept]
        grid = np.geomspace(0.05, 8, 81)
        loss = [np.logaddexp(0, np.where(t == 1, -1, 1) * logit / c).mean() for c in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, vocabulary: int = 50_000) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from the labels of rows that are not held out.

    ``train_rows``: labelled rows that teach, about as many at most; ``vocabulary``: words with vectors of their own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs, vocabulary))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooled = Pool(vectors.value)
        for batch in batches:
            x = pooled.of(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([row.tobytes() for row in x], pa.binary())], ["doc_id", "x"])

    rows = stored(docs.mapInArrow(pool, "doc_id long, x binary"), "quality-pooled")
    out = held_out(F.col("doc_id"), 4, 2)
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).where(~out)
    known = stored(known, "quality-labels")
    share = min(1.0, train_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < int(share * (1 << 30)))  # some train_rows rows
    taught = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(taught["x"].to_pylist()), np.float32).reshape(-1, 2 * DIM + 1).astype(np.float64)
    network = context.broadcast(Network(x, taught["quality"].to_numpy().astype(np.float64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(len(batch), 2 * DIM + 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(network.value.score(x.astype(np.float64)))], ["doc_id", "score"])

    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
