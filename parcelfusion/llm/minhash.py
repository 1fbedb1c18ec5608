"""Near-duplicate documents by MinHash bands, verified first on odd sketches, then on full sets.

1. One pass over the texts hashes each document's distinct word shingles to 64 bits, takes ``K`` MinHash
   samples, hashes them in bands of ``ROWS``, and folds the samples into an odd sketch: a bitmap in which
   each (sample number, value) flips one bit. The population count of the XOR of two bitmaps estimates
   how many samples differ.
2. Documents with identical sets are one class. Classes are numbered, and from here on a class goes by its number, whatever
   the ids of its documents; its text is that of one of them, found again by doc_id and digest.
3. Classes that share a band value are a bucket. Each member is compared with the bucket's smallest number
   alone; sketches discard, full sets confirm; links give components.
4. A bucket whose members are all in one component can add nothing. In the others, the documents outside
   the bucket's most frequent component are compared with all that meet that component in a bucket and are in another
   one, in blocks of bounded size: sketches first, full sets next, until two components are joined. No
   link that could join two components is left untested, and pairs inside a component, the bulk of a large
   group, are never formed.

With 40 bands of 5, a pair at similarity 0.8 misses all bands with probability (1 - 0.8^5)^40 = 1e-7. The
sketch cut (an estimate below ``SKETCH_CUT``) lies more than four standard deviations under 0.8.

Edge cases: null, empty or wordless texts have no set and are linked with nothing; a text with fewer
words than a shingle has one shingle, the whole sequence; every row has its own place, so rows that share a doc_id but
not the text may be in different components, and a row with a null doc_id takes part: its component_id is the smallest id
that is not null, or null where there is none. ``kept`` is doc_id = component_id, nulls being equal. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, sized_join, stored
from .components import connected_components

K, ROWS, BITS = 200, 5, 1024
BANDS = K // ROWS
SKETCH_CUT = 0.64
#: Documents whose signatures are made at once.
AT_ONCE = 1000
#: Documents in one block, those compared and those compared with, and bytes of their sets in either.
BLOCK_A, BLOCK_B, BLOCK_BYTES = 512, 4096, 16_000_000
GOLDEN, MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 2**63, K, dtype=np.uint64)


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= MIXER
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``width``-word shingles of the lower-cased (A-Z) text."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    x = np.full(len(hashes) - width + 1, width, np.uint64)
    for i in range(width):
        x = (x ^ hashes[i : i + len(x)]) * GOLDEN
        x ^= x >> np.uint64(29)
    return np.unique(scramble(x))


def samples(shingles: np.ndarray) -> np.ndarray:
    """K MinHash samples, in pieces of bounded memory."""
    least = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        piece = np.multiply.outer(shingles[i : i + 1024], FACTORS)
        piece += OFFSETS
        np.minimum(least, piece.min(axis=0), out=least)
    return least


def sketches(signatures: np.ndarray) -> np.ndarray:
    """(documents, K) samples -> (documents, BITS / 64) odd sketches."""
    at = (scramble(signatures ^ (np.arange(K, dtype=np.uint64) * GOLDEN)) % np.uint64(BITS)).astype(np.int64)
    flips = np.bincount((at + np.arange(len(at))[:, None] * BITS).ravel(), minlength=len(at) * BITS) & 1
    return np.packbits(flips.astype(np.uint8).reshape(len(at), BITS), axis=1)


def band_values(signatures: np.ndarray) -> np.ndarray:
    """(documents, K) samples -> (documents, BANDS) band hashes; the band's number is part of the hash."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS)
    value = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(ROWS):
        value = (value ^ rows[:, :, r]) * GOLDEN
        value ^= value >> np.uint64(31)
    return value.astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of sets by the XOR population counts of their odd sketches (last axis: bytes)."""
    differ = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    left = np.maximum(1e-9, 1.0 - 2.0 * differ / BITS)
    return 1.0 + BITS / (4.0 * K) * np.log(left)


def digest(text: Column) -> Column:
    """SHA-256 of the text as it is; with the doc_id it finds a row again."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, sha, n_shingles, set_key (128-bit hash of the set), sketch, bands; the last three null for no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sketches take 8 KB a document while they are made, so a whole batch at once would take much.
        for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, len(b), AT_ONCE)):
            sets = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
            keep = [i for i, s in enumerate(sets) if len(s)]
            sig = np.array([samples(sets[i]) for i in keep], np.uint64).reshape(len(keep), K)
            sketch, bands, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            for i, one, values in zip(keep, sketches(sig) if keep else (), band_values(sig), strict=True):
                sketch[i], bands[i], keys[i] = one.tobytes(), values, xxhash.xxh3_128_digest(sets[i].tobytes())
            columns = [batch.column("doc_id"), batch.column("sha"), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sha", "n_shingles", "set_key", "sketch", "bands"])

    rows = docs.select("doc_id", digest(F.col("text")).alias("sha"), "text")
    return rows.mapInArrow(run, "doc_id long, sha binary, n_shingles long, set_key binary, sketch binary, bands array<long>")


def sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """v and its full shingle set, for the classes in ``ids`` (v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(sets, pa.binary())], ["v", "shingles"])

    places = classes.join(ids.hint("merge"), "v", "left_semi").select("v", F.col("place.doc_id").alias("at_id"), F.col("place.sha").alias("at_sha"))
    places = stored(places, "near-places")
    here = (digest(F.col("text")) == F.col("at_sha")) & F.col("doc_id").eqNullSafe(F.col("at_id"))
    found = sized_join(docs.select("doc_id", "text"), places, here, "inner", places.count(), 500_000)  # some 50 bytes each
    return found.select("v", "text").mapInArrow(run, "v long, shingles binary").dropDuplicates(["v"])  # a row may be repeated


def sketch_filter(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose sketches don't rule out the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), BITS // 8) for c in ("sketch_a", "sketch_b"))
                yield batch.loc[estimate(a, b) >= SKETCH_CUT, ["a", "b"]]

    at_a = reps.select(F.col("v").alias("a"), F.col("sketch").alias("sketch_a"))
    at_b = reps.select(F.col("v").alias("b"), F.col("sketch").alias("sketch_b"))
    return pairs.join(at_a.hint("merge"), "a").join(at_b.hint("merge"), "b").mapInPandas(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs with 100 * |intersection| >= percent * |union| on full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    ids = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
    sets = stored(sets_of(docs, classes, ids, width), "near-sets")
    at_a = sets.select(F.col("v").alias("a"), F.col("shingles").alias("set_a"))
    at_b = sets.select(F.col("v").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(at_a.hint("merge"), "a").join(at_b.hint("merge"), "b").mapInPandas(run, "a long, b long")


def shared_counts(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of ``one`` (sorted) each of ``others`` holds."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    begins = np.cumsum([0] + [len(o) for o in others[:-1]])
    return np.add.reduceat((one[at] == flat).astype(np.int64), begins)


def block_links(a: pd.DataFrame, b: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between rows of ``a`` and rows of ``b`` in other components, enough to join every two components that any link joins."""
    if not len(a) or not len(b):
        return []
    x, y = (np.frombuffer(b"".join(map(bytes, f["sketch"])), np.uint8).reshape(len(f), BITS // 8).view(np.uint64) for f in (a, b))
    sets_a, sets_b = ([np.frombuffer(v, np.uint64) for v in f["shingles"]] for f in (a, b))
    size_b = np.array([len(v) for v in sets_b])
    ids, other, inside = a["v"].to_numpy(), b["v"].to_numpy(), (b["component"] == b["main"]).to_numpy()
    of, part = a["component"].to_numpy(), b["component"].to_numpy()
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (p := root.get(v, v)) != v:
            root[v] = root.get(p, p)
            v = p
        return v

    found = []
    for k in range(len(a)):
        one, n = sets_a[k], len(sets_a[k])
        # Two that are both outside meet twice: the smaller id asks. Sizes further apart than the threshold can't link.
        fits = (100 * np.minimum(n, size_b) >= percent * np.maximum(n, size_b)) & (part != of[k]) & (inside | (other > ids[k]))
        ask = np.flatnonzero(fits)
        near = estimate(x[k], y[ask])
        ask = ask[near >= SKETCH_CUT][np.argsort(-near[near >= SKETCH_CUT], kind="stable")]
        while len(ask):
            now, ask = ask[:64], ask[64:]
            shared = shared_counts(one, [sets_b[m] for m in now])
            for m in now[100 * shared >= percent * (n + size_b[now] - shared)]:
                u, v = find(int(of[k])), find(int(part[m]))
                if u != v:
                    root[max(u, v)] = min(u, v)
                    found.append((int(ids[k]), int(other[m])))
            mine = find(int(of[k]))
            ask = ask[[find(int(c)) != mine for c in part[ask]]] if len(ask) else ask
    return found


def rest_links(buckets: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that join components which meet in a bucket: a, b."""
    seen = buckets.join(labels.hint("merge"), "v", "left")
    seen = seen.select("key", "v", F.coalesce("component", "v").alias("component"))
    per = seen.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = per.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    main = stored(main.select("key", F.col("most.component").alias("main")), "near-open")
    # A class once for each component it meets, however many buckets they share.
    met = stored(seen.join(main.hint("merge"), "key").select("main", "v", "component").distinct(), "near-met")
    sets = sets_of(docs, classes, met.select("v").distinct(), width)
    whole = stored(classes.select("v", "sketch").join(sets.hint("merge"), "v"), "near-sets")
    outside = F.col("component") != F.col("main")
    load = F.octet_length("shingles")
    sizes = met.join(whole.select("v", load.alias("load")).hint("merge"), "v").groupBy("main")
    blocks = lambda rows, size, row_limit: F.greatest(F.ceil(F.sum(rows) / row_limit), F.ceil(F.sum(size) / BLOCK_BYTES)).cast("int")
    sizes = sizes.agg(
        blocks(F.when(outside, 1).otherwise(0), F.when(outside, F.col("load")).otherwise(0), BLOCK_A).alias("na"), blocks(F.lit(1), F.col("load"), BLOCK_B).alias("nb")
    )
    met = met.join(stored(sizes, "near-blocks").hint("merge"), "main").join(whole.hint("merge"), "v")
    at = F.pmod(F.xxhash64("v"), F.lit(2**30)).cast("int")
    body = [F.col(c).alias(c) for c in ("main", "v", "component", "sketch", "shingles")]  # a plain column would be ambiguous
    a = met.where(outside).select(*body, (at % F.col("na")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    b = met.select(*body, F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"), (at % F.col("nb")).alias("j"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(a, b, percent), columns=["a", "b"], dtype="int64")

    return a.groupBy("main", "i", "j").cogroup(b.groupBy("main", "i", "j")).applyInPandas(run, "a long, b long")


def components_of(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): doc_id, sha, n_shingles, set_key of every row; set_key, component, component_id of the sets in
    components of several rows."""
    sigs = stored(signatures(docs, width), "near-signatures")
    classes = sigs.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min(F.struct("doc_id", "sha")).alias("place"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")
    )
    classes = stored(classes.withColumn("v", F.monotonically_increasing_id()), "near-classes")
    values = classes.select("v", F.explode("bands").alias("key"))
    shared = values.groupBy("key").agg(F.min("v").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = stored(values.join(shared.hint("merge"), "key"), "near-buckets")
    stars = buckets.where("v <> first").select(F.col("first").alias("a"), F.col("v").alias("b")).distinct()
    links = stored(confirmed(stored(sketch_filter(stars, classes), "near-stars"), docs, classes, width, percent), "near-links")
    labels = connected_components(links)
    more = stored(rest_links(buckets, labels, classes, docs, width, percent), "near-rest")
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more))
    named = classes.select("v", "set_key", "least", "n").join(labels.hint("merge"), "v", "left")
    named = named.select("set_key", "least", "n", F.coalesce("component", "v").alias("component"))
    whole = named.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    groups = stored(named.select("set_key", "component").join(whole.hint("merge"), "component"), "near-groups")
    return sigs.select("doc_id", "sha", "n_shingles", "set_key"), groups


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept (doc_id is the smallest id of its component)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, groups = components_of(docs, width, percent)
    found = sized_join(rows, groups, "set_key", "left", groups.count())
    component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of its smallest id (nulls last); all columns stay.

    Rows without words are in no group and stay.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, groups = components_of(texts, width, percent)
    member = sized_join(rows, groups.select("set_key", "component"), "set_key", "inner", groups.count())
    member = stored(member.groupBy("component", "doc_id", "sha").agg(F.count("*").alias("n")), "near-members")
    best = member.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")).alias("best"))
    best = stored(best.select("component", F.col("best.doc_id").alias("best_id"), F.col("best.sha").alias("best_sha")), "near-best")
    judged = sized_join(member, best, "component", "inner", best.count())
    chosen = (F.col("sha") == F.col("best_sha")) & F.col("doc_id").eqNullSafe(F.col("best_id"))
    judged = judged.select(F.col("doc_id").alias("_copy_id"), F.col("sha").alias("_copy_sha"), "n", chosen.alias("chosen"))
    judged = stored(judged.where("not chosen or n > 1"), "near-judged")
    here = (digest(F.col("text")) == F.col("_copy_sha")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_copy_id"))
    gone, again = judged.where("not chosen").select("_copy_id", "_copy_sha"), judged.where("chosen").select("_copy_id", "_copy_sha")
    kept = sized_join(docs, gone, here, "left_anti", gone.count())
    if again.isEmpty():
        return kept
    n = again.count()
    # The chosen row itself is repeated.
    return sized_join(kept, again, here, "left_anti", n).unionByName(sized_join(kept, again, here, "left_semi", n).dropDuplicates(["doc_id", "text"]))
