"""Polynomial fingerprints of words and of runs of words, in numpy, modulo 2^64.

A word's value is a polynomial over its bytes, a run's value one over its words; both come from prefix sums, so a run of any
length costs one subtraction and one product.  Letters A-Z have the values of a-z."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
#: Powers of the base and of its inverse, longer ones as they are needed.
_powers = {b: np.ones(1, np.uint64) for b in (_BASE, _INVERSE)}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole value, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _prefix(values: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=sums[1:])
    return sums


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word ``data[start:end]``."""
    sums = _prefix(_BYTES[data])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


class Runs:
    """Values of runs of consecutive words, from the words' values."""

    def __init__(self, words: np.ndarray):
        self.sums, self.inverse = _prefix(words), _power(_INVERSE, len(words) + 1)

    def values(self, first: np.ndarray, size) -> np.ndarray:
        """A 64-bit value for each run of ``size`` words (a number or an array) from word ``first`` on."""
        return mix((self.sums[first + size] - self.sums[first]) * self.inverse[first] + np.asarray(size, np.uint64) * np.uint64(_INVERSE))


def chunks(column: pa.Array, size: int, breaks: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, byte in it, bytes, offsets) for rows of a string column, some ``size`` bytes at a time.

    A longer text comes alone; with ``breaks`` (true for some byte values) in parts that end behind such a byte."""
    column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        text, at = data[offsets[row] : offsets[end]], 0
        while breaks is not None and end == row + 1 and len(text) - at > size:
            places = np.flatnonzero(breaks[text[at : at + size]])
            reach = size
            while not len(places) and at + reach < len(text):
                places, reach = np.flatnonzero(breaks[text[at + reach : at + 2 * reach]]) + reach, 2 * reach
            stop = at + int(places[-1]) + 1 if len(places) else len(text)
            yield row, at, text[at:stop], np.array([0, stop - at])
            at = stop
        yield row, at, text[at:], np.maximum(offsets[row : end + 1] - offsets[row] - at, 0)
        row = end


def bitmap(df: DataFrame, column: str, bits: int) -> bytes:
    """A bitmap of 2^``bits`` places with two places set for each 64-bit value of ``column``; its size does not depend on the rows."""
    value, last = F.col(column), F.lit((1 << bits) - 1)
    places = df.select(F.explode(F.array(value.bitwiseAND(last), F.shiftrightunsigned(value, 32).bitwiseAND(last))).alias("p"))
    blocks = places.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits"))
    out = bytearray(1 << (bits - 3))
    for r in blocks.toLocalIterator():
        at = (r.b - 1) * len(r.bits)
        out[at : at + len(r.bits)] = r.bits
    return bytes(out)


def in_bitmap(held: bytes, values: np.ndarray) -> np.ndarray:
    """Which values may be in the bitmap; all that are in it are."""
    places, last = np.frombuffer(held, np.uint8), np.uint64(8 * len(held) - 1)

    def lit(p: np.ndarray) -> np.ndarray:
        return (places[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1

    return (lit(values & last) & lit((values >> np.uint64(32)) & last)).astype(bool)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of true places; none crosses an offset."""
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    begins, stops = inside & cut[:-1], inside & cut[1:]
    begins[1:] |= inside[1:] & ~inside[:-1]
    stops[:-1] |= inside[:-1] & ~inside[1:]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1
