"""Words of whole text columns as numpy arrays, a bounded slice of rows at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20

_SPACE = b" \t\n\x0b\x0c\r"
#: A random number for each place (mod 64) and byte; a word's hash is their sum.
_PLACES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, (64, 256), np.uint64)
_FURTHER = np.uint64(0x9E3779B97F4A7C15)


def byte_table(word_bytes: bytes | None = None) -> np.ndarray:
    """256 bytes: A-Z in lower case, bytes outside ``word_bytes`` a space.

    With ``word_bytes`` None all bytes but ASCII white space belong to words.
    """
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    keep = np.ones(256, dtype=bool)
    if word_bytes is None:
        keep[list(_SPACE)] = False
    else:
        keep[:] = False
        keep[list(word_bytes)] = True
        keep[65:91] = True
    table[~keep] = 32
    return table


#: [0-9a-z and every byte from 0x80], lower-cased.
ALNUM = byte_table(bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))
#: Anything but ASCII white space, lower-cased.
NONSPACE = byte_table()


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text",
           most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, row ends with a leading 0); nulls are empty."""
    text = pc.fill_null(text, "")
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, wide)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[ends[0]:ends[-1]], ends - ends[0]


class Words(NamedTuple):
    """Words in order: ``per_row`` counts them, ``start`` and ``length`` place them in ``data``."""

    per_row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    hashes: np.ndarray
    data: np.ndarray

    def at(self, i: int) -> bytes:
        return self.data[self.start[i]:self.start[i] + self.length[i]].tobytes()


def unit_hashes(data: np.ndarray, inside: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges that together cover the True places of ``inside``."""
    if not len(start):
        return np.zeros(0, np.uint64)
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    parts = _PLACES[place & 63, data[inside]]
    far = np.flatnonzero(place > 63)
    if len(far):
        parts[far] *= (place[far] >> 6).astype(np.uint64) * _FURTHER * np.uint64(2) + np.uint64(1)
    return np.add.reduceat(parts, first)


def words(text: pa.Array, table: np.ndarray) -> Words:
    """The words that ``table`` leaves between spaces, row by row."""
    raw, ends = text_bytes(text)
    data = table[raw]
    inside = data != 32
    opens = np.empty(len(data), bool)
    opens[:1] = True
    np.logical_not(inside[:-1], out=opens[1:])
    opens[ends[:-1][ends[:-1] < len(data)]] = True
    opens &= inside
    start = np.flatnonzero(opens)
    word = np.cumsum(opens)[inside] - 1
    length = np.bincount(word, minlength=len(start)) if len(start) else np.zeros(0, np.int64)
    upto = np.searchsorted(start, ends)
    return Words(np.diff(upto), start, length, unit_hashes(data, inside, start, length), data)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
