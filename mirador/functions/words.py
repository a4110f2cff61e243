"""Index tokens of many texts at once, cut from the bytes of an Arrow batch.

``cut`` gives the tokens that ``columns.fts_tokens`` gives for each text, from texts that Spark has
lowered (so case mappings are Spark's); a text becomes neither a Python object nor a Spark array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from mirador.functions import lookups as L

CUT_BYTES = 1 << 20            # text cut at once, about; one text at least

_ONE = np.zeros(256, np.uint8)                                  # a..z as they are, all else separates
_ONE[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_TWO = np.zeros(1 << 16, np.uint8)                              # accented letters of two bytes
for _accented, _plain in zip(L.ACCENTED, L.UNACCENTED, strict=True):
    _TWO[int.from_bytes(_accented.encode())] = ord(_plain)


def string_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string or binary array."""
    if not len(texts):
        return np.zeros(1, np.int32), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    held = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return at - at[0], held[at[0]:at[-1]]


def strings_of(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """A string array from each string's bytes (a size below 0 stands for null) and all bytes."""
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(np.maximum(sizes, 0), out=at[1:])
    null = sizes < 0
    valid = pa.py_buffer(np.packbits(~null, bitorder="little")) if null.any() else None
    return pa.Array.from_buffers(pa.string(), len(sizes), [valid, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def sizes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What ``strings_of`` takes: (bytes of each string or -1, all bytes)."""
    at, data = string_parts(texts)
    sizes = np.diff(at).astype(np.int32)
    if texts.null_count:
        sizes[texts.is_null().to_numpy(zero_copy_only=False)] = -1
    return sizes, data


def bytes_of_each(texts: pa.Array) -> list[bytes]:
    """Every string's bytes, null's as none."""
    at, data = string_parts(texts)
    at, held = at.tolist(), data.tobytes()
    return [held[i:j] for i, j in zip(at, at[1:])]


def pieces(columns: list[pa.Array]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``CUT_BYTES`` of text, a row at least."""
    upto = sum(string_parts(c)[0].astype(np.int64) for c in columns)
    lo, n = 0, len(upto) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + CUT_BYTES, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the tokens of all texts in order, the text each is from); lowered texts, without nulls."""
    at, data = string_parts(texts)
    letters = _ONE[data]
    lead = np.flatnonzero(data[:-1] >= 0xC3)
    plain = _TWO[data[lead].astype(np.uint16) << 8 | data[lead + 1]]
    lead, plain = lead[plain > 0], plain[plain > 0]
    if len(lead):
        letters[lead] = plain
        keep = np.ones(len(data), bool)
        keep[lead + 1] = False                                  # an accented letter's second byte
        letters, at = letters[keep], at - np.searchsorted(lead + 1, at)
    inside = letters > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    border = at[(at > 0) & (at < len(inside))]                  # words end with their text
    first[border], last[border - 1] = inside[border], inside[border - 1]
    start = np.flatnonzero(first)
    words = strings_of(np.flatnonzero(last) - start + 1, letters[inside])
    return words, np.searchsorted(at, start, side="right") - 1
