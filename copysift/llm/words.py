"""Words and word shingles of whole Arrow string columns as 64-bit hashes, computed by numpy for a batch at a time.

A word is a maximal run of bytes other than space and 0x09-0x0D; the hash of a word ignores the case of A-Z.
A shingle hash combines the hashes of k consecutive words; a text of fewer words has one shingle, its whole sequence.
Hashes have 64 bits and no per-process seed, so every executor and every rerun gets the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text that are expanded to 64-bit values at once; a longer text is worked through in parts.
PART_BYTES = 1 << 19

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_letters = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
_letters[65:91] = _letters[97:123]
_places = mix(np.arange(1001, 1033, dtype=U64) * U64(BASE)) | U64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_up = _powers(BASE, PART_BYTES + 1)
_down = _powers(pow(BASE, -1, 1 << 64), PART_BYTES + 1)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one text after the other, and the offsets of the texts; nulls are empty."""
    texts = pc.fill_null(texts, "")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, width, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(batch: pa.RecordBatch, column: str, most: int = 2 * PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each (at least one row), to bound memory."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = _space[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    full = np.flatnonzero(np.diff(offsets) > 0)
    before[offsets[full]] = True
    after[offsets[full + 1] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PART_BYTES, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        if high - low <= PART_BYTES:
            total = np.zeros(high - low + 1, U64)
            np.cumsum(_letters[data[low:high]] * _up[: high - low], dtype=U64, out=total[1:])
            a, b = starts[i:j] - low, ends[i:j] - low
            out[i:j] = mix((total[b] - total[a]) * _down[a] + (b - a).astype(U64))
        else:  # one word longer than a part
            total = U64(0)
            with np.errstate(over="ignore"):
                for at in range(low, high, PART_BYTES):
                    piece = _letters[data[at : min(high, at + PART_BYTES)]]
                    total = total * U64(BASE) + np.sum(piece * _up[: len(piece)], dtype=U64)
            out[i] = mix(np.array([total], U64))[0]
        i = j
    return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, repeats included, and the index of each text's first one."""
    n = np.diff(first)
    m = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(m)])
    out = np.empty(begin[-1], U64)
    if len(words) >= k:
        span = len(words) - k + 1
        total = np.zeros(span, U64)
        for j in range(k):
            total += words[j : j + span] * _places[j]
        whole = np.arange(span) + k <= np.repeat(first[1:], n)[:span]
        out[np.repeat(n >= k, m)] = mix(total[whole] + _places[k])
    for short in range(1, k):
        where = np.flatnonzero(n == short)
        if len(where):
            total = np.zeros(len(where), U64)
            for j in range(short):
                total += words[first[where] + j] * _places[j]
            out[begin[where]] = mix(total + _places[16 + short])
    return out, begin


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = buffers(texts)
    starts, ends, first = word_spans(data, offsets)
    hashes, begin = shingle_hashes(word_hashes(data, starts, ends), first, k)
    return [np.unique(hashes[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
