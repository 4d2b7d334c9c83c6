"""Words of a text and their hashes, as arrays inside a task.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``; that is what
``bytes.split`` gives. Case is folded for A-Z only, which is what ``bytes.lower`` does.
A missing text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)

#: Bytes of text handled together, so that a batch of very long texts stays small.
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others; one to one."""
    x = x ^ (x >> _HALF)
    x = x * _MIX
    x = x ^ (x >> _HALF)
    x = x * _MIX
    return x ^ (x >> _HALF)


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """Another one-to-one hash of 64-bit values for each seed."""
    return mix(x ^ mix(np.array([seed + 1], np.uint64))[0])


def word_hashes(text: str | None, fold: bool) -> np.ndarray:
    raw = (text or "").encode()
    words = (raw.lower() if fold else raw).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` values from each position on; positions without as many are left out.

    Windows are put together from windows of half the size, so a long one costs few passes.
    """
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    done, at = None, 0
    power, length = hashes, 1
    while True:
        if size & length:
            part = power[at:at + count]
            done = part if done is None else mix(done * _ODD + part)
            at += length
        if at == size:
            return done.copy() if size == 1 else done
        power = mix(power[:-length] * _ODD + power[length:])
        length *= 2


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles, A-Z folded.

    A text of fewer words is one shingle of all of them; a text without words has none.
    """
    hashes = word_hashes(text, fold=True)
    if not len(hashes):
        return hashes
    return np.unique(window_hashes(hashes, min(size, len(hashes))))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that the named column holds some megabytes in each."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        at = batch.schema.get_field_index(column)
        step = max(1, int(rows * CHUNK_BYTES / max(1, batch.column(at).nbytes)))
        for start in range(0, rows, step):
            yield batch.slice(start, step)
