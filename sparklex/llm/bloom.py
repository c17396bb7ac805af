"""A Bloom filter over 64-bit keys of words, filled by the tasks and sent to them; it decides nothing by itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Bits of the filter: so many a key, at most MOST_BITS in all (256 MB in a task), which is enough for some 200 M keys.
BITS_A_KEY, MOST_BITS = 32, 1 << 31

_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_PIECE = 1 << 13  # bytes of the filter in one row


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """64-bit hash of a word; the lowest bit tells whether it holds a figure."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) & ~1 | any(map(str.isdigit, word))
        return got


class Bloom:
    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def places(keys: np.ndarray, mask: np.uint64):
        with np.errstate(over="ignore"):
            return (keys & mask, (keys >> np.uint64(31)) & mask, mix(keys ^ _Q) & mask)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), bool)
        for p in self.places(keys, self.mask):
            left = np.flatnonzero(ok)
            p = p[left]
            ok[left] = (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
        return ok


def build_bloom(rows: DataFrame, keys_of, count: int) -> Bloom:
    """The filter over the seeds of rows: each task fills pieces of it, which are joined bit by bit before they are read."""
    size = 1 << 16
    while size < min(MOST_BITS, count * BITS_A_KEY):
        size *= 2
    mask = np.uint64(size - 1)

    def fill(batches):
        """Pieces of the filter: the bits themselves, or the numbers of those that are set if they are shorter."""
        bits, hashes = np.zeros(size // 8, np.uint8), Hashes()
        for batch in batches:
            for p in Bloom.places(keys_of(batch, hashes), mask):
                np.bitwise_or.at(bits, (p >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))
        pieces = []
        for i in range(0, len(bits), _PIECE):
            piece = bits[i : i + _PIECE]
            if piece.any():
                few = np.flatnonzero(np.unpackbits(piece, bitorder="little")) if np.count_nonzero(piece) < _PIECE // 4 else None
                pieces.append((i, piece.tobytes() if few is None or 2 * len(few) >= _PIECE else few.astype("<u2").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pieces], pa.int64()), pa.array([b for _, b in pieces], pa.binary())], ["at", "bits"])

    def whole(piece: bytes) -> np.ndarray:
        if len(piece) == _PIECE:
            return np.frombuffer(piece, np.uint8)
        bits = np.zeros(8 * _PIECE, np.uint8)
        bits[np.frombuffer(piece, "<u2")] = 1
        return np.packbits(bits, bitorder="little")

    def unite(pdf):
        return pdf.iloc[:1].assign(bits=[np.bitwise_or.reduce([whole(b) for b in pdf["bits"]]).tobytes()])

    bits = np.zeros(size // 8, np.uint8)
    for r in rows.mapInArrow(fill, "at long, bits binary").groupBy("at").applyInPandas(unite, "at long, bits binary").collect():
        bits[r["at"] : r["at"] + _PIECE] = np.frombuffer(r["bits"], np.uint8)
    return Bloom(bits)
