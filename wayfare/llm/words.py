"""Columnar word layout shared by the text operators.

A batch of texts becomes one dictionary of distinct words and one code for each word, so anything that
depends on a word alone (subwords, n-grams, hashes) is computed once for each distinct word of the batch
and gathered with numpy. Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; memory of a worker is a small multiple of it. One text may be longer.
SLICE_BYTES = 6 << 20


@dataclass
class Words:
    """``codes[offsets[i]:offsets[i + 1]]`` are the words of text i, as positions in ``dictionary``."""

    codes: np.ndarray
    offsets: np.ndarray
    dictionary: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def per_text(self, per_word: np.ndarray) -> np.ndarray:
        """Sum over each text's words of a figure given for each distinct word."""
        return segment_sums(per_word[self.codes], self.offsets)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``size`` bytes of ``column`` at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts, null as empty."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    if lower:
        texts = pc.ascii_lower(texts)  # changes the bytes A-Z alone
    lists = pc.ascii_split_whitespace(texts)
    raw = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(raw[0], raw[-1] - raw[0]) if len(raw) else lists.values
    raw = raw - raw[0]
    real = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    kept = np.zeros(len(real) + 1, dtype=np.int64)
    np.cumsum(real, out=kept[1:])
    encoded = values.filter(pa.array(real)).dictionary_encode()
    return Words(encoded.indices.to_numpy().astype(np.int64), kept[raw], encoded.dictionary)


def spread(lists_offsets: np.ndarray, flat: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate, for each word occurrence, the run of ``flat`` that belongs to its code; also the new offsets of the texts."""
    size = np.diff(lists_offsets)[codes]
    ends = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(size, out=ends[1:])
    start = np.repeat(lists_offsets[:-1][codes] - ends[:-1], size)
    return flat[start + np.arange(ends[-1])], ends[offsets]


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text of each position."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes_of(dictionary: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each string's UTF-8 bytes, unsigned."""
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False), repeat(seed)), dtype=np.uint64, count=len(dictionary))
