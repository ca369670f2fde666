"""The same tokenizer over whole Arrow batches, for operators that need token positions.

It works on the UTF-8 bytes of a string array: non-ASCII bytes are separators like any other, so no decoding is
needed. The cost is a few NumPy passes over the bytes.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa

_FOLD = np.zeros(256, dtype=np.uint8)
for _c in string.ascii_lowercase + string.digits:
    _FOLD[ord(_c)] = ord(_c)
for _c in string.ascii_uppercase:
    _FOLD[ord(_c)] = ord(_c.lower())


def string_buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row offsets, bytes) of a string array, nulls as empty strings."""
    a = a.cast(pa.large_string())
    if a.null_count:
        a = a.fill_null("")
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw
    return (offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)), raw


def tokenize_batch(a: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each token, tokens as a large_string array), in text order."""
    n = len(a)
    if n == 0:
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    offsets, raw = string_buffers(a)
    # a separator after each row, so that no token runs on into the next row
    lengths = np.diff(offsets)
    starts = offsets[:-1] + np.arange(n)
    spaced = np.zeros(len(raw) + n, dtype=np.uint8)
    keep = np.ones(len(spaced), dtype=bool)
    keep[starts + lengths] = False
    spaced[keep] = _FOLD[raw]
    word = spaced != 0
    edge = np.diff(word.astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = np.searchsorted(starts, begin, side="right") - 1
    token_offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    data = spaced[word]
    toks = pa.LargeStringArray.from_buffers(
        len(begin), pa.py_buffer(token_offsets.tobytes()), pa.py_buffer(data.tobytes())
    )
    return row, toks


def encode_batch(a: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, dictionary): tokens of the batch as codes into the batch's own dictionary."""
    row, toks = tokenize_batch(a)
    d = toks.dictionary_encode()
    return row, np.asarray(d.indices, dtype=np.int64), d.dictionary


def row_token_counts(row: np.ndarray, code: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, code) pairs sorted by row and code, with their counts."""
    if len(row) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    key = row * max(1, n_codes) + code
    key.sort()
    first = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.flatnonzero(first)
    return key[at] // n_codes, key[at] % n_codes, np.diff(np.append(at, len(key)))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64 (public domain), on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_strings(a: pa.Array) -> np.ndarray:
    """Stable 64-bit hashes of distinct strings (xxhash), independent of process and batch."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(s) for s in a.to_pylist()), dtype=np.uint64, count=len(a))
