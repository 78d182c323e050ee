"""Sets of word shingles as 64-bit hashes, and groups of rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STORE_WORDS = 600_000
WORDS: dict[str, int] = {}


def mix(x: np.ndarray | np.uint64) -> np.ndarray:
    """Spread the bits of 64-bit numbers evenly (wraps around)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word; the worker remembers those it has met."""
    import xxhash

    if len(WORDS) > STORE_WORDS:
        WORDS.clear()
    for word in set(words).difference(WORDS):
        WORDS[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``width`` lower-case words; a shorter text is one run of all it has."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = word_hashes(words)
    width = min(width, len(words))
    total = np.zeros(len(words) - width + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = mix(total + hashes[k : k + len(total)])
    return np.unique(total)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``keys`` columns, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> pa.Table:
        return pa.Table.from_batches(parts).combine_chunks()

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        starts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1 if batch.num_rows > 1 else np.zeros(0, dtype=int)
        bounds = [0, *starts.tolist(), batch.num_rows]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield joined(held)
            held = []
        for low, high in zip(bounds, bounds[1:], strict=False):
            if high < batch.num_rows:
                yield joined([*held, batch.slice(low, high - low)])
                held = []
            else:
                held.append(batch.slice(low, high - low))
        last = tuple(c[-1] for c in columns)
    if held:
        yield joined(held)
