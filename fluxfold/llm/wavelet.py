"""A wavelet matrix over token ids: one compressed file with access, counting and occurrence lookup.

File format (little-endian): magic ``WVM1``, number of ids n, of documents d, of symbols s and of
planes p (uint64 each), then zstd frames, each after its length (uint64): the s symbols in
ascending order (uint32), the d document lengths (uint64), and p bit-planes of n bits, highest
first. Ids are stored as ranks among the shard's symbols, so only as many planes are kept as the
symbols need. Plane k holds one bit per position of the sequence as plane k - 1 has ordered it:
zeros first, then ones, each in their old order. Rank directories are rebuilt on reading.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"WVM1"
_HEAD = struct.Struct("<4sQQQQ")
_SIZE = struct.Struct("<Q")
#: Bits between two entries of a rank directory.
_BLOCK = 512


def _pack(data: bytes) -> bytes:
    import zstandard

    frame = zstandard.ZstdCompressor(level=1).compress(data)
    return _SIZE.pack(len(frame)) + frame


def encode(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of a shard: the ids of its documents one after another, and their lengths."""
    symbols = np.flatnonzero(np.bincount(ids)).astype(np.uint32) if len(ids) else np.zeros(0, np.uint32)
    rank = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.uint32)
    rank[symbols] = np.arange(len(symbols), dtype=np.uint32)
    planes = max(0, int(len(symbols) - 1).bit_length()) if len(symbols) else 0
    kind = np.uint16 if planes <= 16 else np.uint32
    order = rank[ids].astype(kind)
    out = [_HEAD.pack(MAGIC, len(ids), len(lengths), len(symbols), planes)]
    out += [_pack(symbols.astype("<u4").tobytes()), _pack(np.asarray(lengths).astype("<u8").tobytes())]
    for level in range(planes - 1, -1, -1):
        ones = (order & kind(1 << level)) != 0
        out.append(_pack(np.packbits(ones, bitorder="little").tobytes()))
        order = np.concatenate([np.compress(~ones, order), np.compress(ones, order)])
    return b"".join(out)


class WaveletMatrix:
    """Reads one file; every query works on the bit-planes."""

    def __init__(self, data: bytes):
        import zstandard

        magic, self.n, documents, symbols, planes = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = _HEAD.size
        frames = []
        opener = zstandard.ZstdDecompressor()
        for _ in range(2 + planes):
            (size,) = _SIZE.unpack_from(data, at)
            at += _SIZE.size
            frames.append(opener.decompress(data[at : at + size]))
            at += size
        self.symbols = np.frombuffer(frames[0], "<u4")
        self.lengths = np.frombuffer(frames[1], "<u8").astype(np.int64)
        self.planes = [np.frombuffer(f, np.uint8) for f in frames[2:]]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self._directories: list[np.ndarray] | None = None
        self._zeros: list[int] | None = None

    # -- rank and select ------------------------------------------------------------------------

    def _prepare(self) -> None:
        if self._directories is None:
            self._directories, self._zeros = [], []
            for plane in self.planes:
                padded = np.zeros(-(-max(len(plane), 1) // (_BLOCK // 8)) * (_BLOCK // 8), np.uint8)
                padded[: len(plane)] = plane
                per_block = np.bitwise_count(padded).reshape(-1, _BLOCK // 8).sum(axis=1, dtype=np.int64)
                self._directories.append(np.concatenate([[0], np.cumsum(per_block)]))
                self._zeros.append(self.n - int(self._directories[-1][-1]))

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before position i."""
        block = i // _BLOCK
        first = block * (_BLOCK // 8)
        part = self.planes[k][first : first + (i - block * _BLOCK + 7) // 8]
        bits = int(np.bitwise_count(part).sum())
        if i % 8 and len(part):
            bits -= int(part[-1] >> (i % 8)).bit_count()
        return int(self._directories[k][block]) + bits

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3] >> (i & 7)) & 1

    def _select(self, k: int, bit: int, j: int) -> int:
        """Position of the j-th (from 0) such bit of plane k."""
        low, high = 0, self.n - 1
        while low < high:
            middle = (low + high) // 2
            ones = self._ones(k, middle + 1)
            if (ones if bit else middle + 1 - ones) > j:
                high = middle
            else:
                low = middle + 1
        return low

    # -- queries --------------------------------------------------------------------------------

    def access(self, i: int) -> int:
        """The id at position i."""
        self._prepare()
        value = 0
        for k in range(len(self.planes)):
            bit = self._bit(k, i)
            ones = self._ones(k, i)
            i = self._zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return int(self.symbols[value])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.symbols, token))
        return at if at < len(self.symbols) and self.symbols[at] == token else None

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of ``token`` in positions start to stop - 1."""
        low, high = self._range(token, start, self.n if stop is None else stop)
        return high - low

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        self._prepare()
        code = self._code(token)
        if code is None:
            return 0, 0
        for k in range(len(self.planes)):
            a, b = self._ones(k, low), self._ones(k, high)
            if code >> (len(self.planes) - 1 - k) & 1:
                low, high = self._zeros[k] + a, self._zeros[k] + b
            else:
                low, high = low - a, high - b
        return low, high

    def occurrence(self, token: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of ``token``."""
        low, high = self._range(token, 0, self.n)
        if not 0 <= j < high - low:
            raise IndexError("no such occurrence")
        at, code = low + j, self._code(token)
        for k in range(len(self.planes) - 1, -1, -1):
            bit = code >> (len(self.planes) - 1 - k) & 1
            at = self._select(k, bit, at - self._zeros[k] if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids, by undoing the planes from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        order = np.zeros(self.n, kind)
        for level, plane in enumerate(reversed(self.planes)):
            ones = np.unpackbits(plane, count=self.n, bitorder="little").astype(bool)
            first, second = np.flatnonzero(~ones), np.flatnonzero(ones)
            before = np.empty(self.n, kind)
            before[first] = order[: len(first)]
            before[second] = order[len(first) :] | kind(1 << level)
            order = before
        return self.symbols[order]
