"""Words of a column of texts as numpy arrays, in runs of bounded size.

A batch of texts is cut into runs of some ``RUN`` bytes. A text longer than that is cut behind a word, and the next
run takes the last ``overlap`` words before the cut once more, so whatever spans ``overlap`` + 1 words is whole in one run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text worked on at once.
RUN = 4_000_000
#: An odd multiplier with well mixed bits.
STEP = np.uint64(0x9E3779B97F4A7C15)


def byte_classes(blanks: bytes, ends: bytes = b"") -> np.ndarray:
    """0 for bytes of words, 1 for ``blanks``, 2 for ``ends``, which also end a piece."""
    out = np.zeros(256, np.uint8)
    out[list(blanks)], out[list(ends)] = 1, 2
    return out


@dataclass
class Run:
    """The words of a run: ``code`` in ``vocabulary``, ``row`` of the batch, ``piece`` (words of one are next to each other), number
    ``at`` in its text; ``known``: how many leading words the run before had as well."""

    code: np.ndarray
    vocabulary: pa.Array
    row: np.ndarray
    piece: np.ndarray
    at: np.ndarray
    known: int
    solid: np.ndarray
    length: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, the same in every process."""
        return hashed(self.vocabulary)[self.code] if len(self.code) else np.zeros(0, np.uint64)

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words with a space behind each, and where each begins."""
        out = np.full(len(self.solid) + len(self.code), 32, np.uint8)
        out[np.arange(len(self.solid)) + np.repeat(np.arange(len(self.code)), self.length)] = self.solid
        return out.tobytes(), np.cumsum(self.length + 1) - self.length - 1


def hashed(values: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(values.to_pylist(), object)) if len(values) else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the high bits of products over all bits."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _tokens(data: np.ndarray, begins: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece, solid) of the words in ``data``, in which texts begin at ``begins``."""
    kind = classes[data]
    solid = kind == 0
    before, after = np.empty_like(solid), np.empty_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    before[begins] = False
    after[begins[begins > 0] - 1], after[-1:] = False, False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    ends = np.cumsum(kind == 2)
    ends = ends[start] if len(start) else np.zeros(0, np.int64)
    return start, end, ends, solid


def _run(data: np.ndarray, begins: np.ndarray, rows: np.ndarray, first: int, known: int, classes: np.ndarray) -> tuple[Run, np.ndarray]:
    start, end, ends, solid = _tokens(data, begins[begins < len(data)], classes)
    text = np.searchsorted(begins, start, "right") - 1
    length = end - start
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    bare = data[solid]
    coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(bare)]).dictionary_encode()
    n = np.bincount(text, minlength=len(begins))
    at = np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n) + first
    piece = ends + text  # grows at every end and at every text
    return Run(coded.indices.to_numpy(), coded.dictionary, rows[text], piece, at, known, bare, length), start


def runs(texts: pa.Array, classes: np.ndarray, overlap: int, table: bytes | None = None, size: int = RUN) -> Iterator[Run]:
    """The runs of a column of binary or string values; nulls are empty. ``table``: a byte translation made first."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    values = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    swap = None if table is None else np.frombuffer(table, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        if offsets[high] - offsets[low] <= size:
            data = values[offsets[low] : offsets[high]]
            yield _run(data if swap is None else swap[data], offsets[low:high] - offsets[low], np.arange(low, high), 0, 0, classes)[0]
        else:
            yield from _long(values[offsets[low] : offsets[high]], low, classes, overlap, swap, size)
        low = high


def _long(text: np.ndarray, row: int, classes: np.ndarray, overlap: int, swap: np.ndarray | None, size: int) -> Iterator[Run]:
    begin, first, known = 0, 0, 0
    while True:
        end = begin + size
        while end < len(text):  # behind a word; a word longer than a run stays whole
            gap = np.flatnonzero(classes[text[end : end + size]] > 0)
            end = end + int(gap[0]) if len(gap) else end + size
            if len(gap):
                break
        end = min(end, len(text))
        data = text[begin:end]
        run, start = _run(data if swap is None else swap[data], np.zeros(1, np.int64), np.array([row]), first, known, classes)
        yield run
        if end == len(text):
            return
        known = min(overlap, len(start))
        first += len(start) - known
        if len(start):
            begin = begin + int(start[-known]) if known else end
            if known and begin + size <= end:  # the overlap alone fills a run
                size = end - begin + size
        else:
            begin = end


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``bits`` bits (a power of two) in which the bit of each value of the long column ``hash`` is set.

    Its size is given, whatever the table holds; a full filter lets everything pass.
    """
    slot = F.col("hash").bitwiseAND(F.lit(bits - 1))
    words = hashes.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(hash & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(max(1, bits // 64), np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash has its bit set."""
    slot = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def filter_size(n: int, most: int = 1 << 28) -> int:
    """Bits of a filter for ``n`` values: 16 each, as a power of two, 2^28 (32 MB) at most."""
    return min(most, 1 << max(10, (16 * max(1, n) - 1).bit_length()))
