"""Token ids in wavelet-matrix shard files: succinct bit-planes that give access, counts and places of ids.

A shard holds consecutive documents in ascending order.  File: 8 bytes magic, 8 bytes little-endian
length of a JSON header, the header, then zstd-compressed sections: the documents' lengths and, for each
bit from the highest down, one plane of bits.  On opening, each plane gets a directory of the ones before
every 512-bit block; rank and select cost one lookup and one popcount or search.
"""

from __future__ import annotations

import json

import numpy as np
import zstandard

MAGIC = b"WVLTMTX1"
BLOCK = 512


def encode_shard(ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray, level: int = 1) -> bytes:
    """One compressed file of all ids; lengths and doc_ids of its documents travel with it."""
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    cur = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    pack = zstandard.ZstdCompressor(level=level).compress
    sections = [pack(doc_ids.astype("<i8").tobytes()), pack(lengths.astype("<u4").tobytes())]
    zeros = []
    for k in range(levels - 1, -1, -1):
        bits = (cur & cur.dtype.type(1 << k)) != 0
        off = len(cur) - int(np.count_nonzero(bits))
        zeros.append(off)
        sections.append(pack(np.packbits(bits, bitorder="little").tobytes()))
        if k:  # zeros first, each half in its order
            parted = np.empty_like(cur)
            np.compress(~bits, cur, out=parted[:off])
            np.compress(bits, cur, out=parted[off:])
            cur = parted
    head = json.dumps({"n": len(ids), "levels": levels, "docs": len(lengths), "zeros": zeros, "sizes": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *sections])


class WaveletShard:
    """A shard file, opened from its bytes."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = int.from_bytes(blob[8:16], "little")
        head = json.loads(blob[16 : 16 + size])
        self.n, self.levels, self.zeros = head["n"], head["levels"], head["zeros"]
        at, raw = 16 + size, []
        for s in head["sizes"]:
            raw.append(zstandard.ZstdDecompressor().decompress(blob[at : at + s]))
            at += s
        self.doc_ids = np.frombuffer(raw[0], "<i8")
        self.lengths = np.frombuffer(raw[1], "<u4").astype(np.int64)
        self.packed = [np.frombuffer(r, np.uint8) for r in raw[2:]]
        self._ranks: list[np.ndarray] | None = None

    def bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.packed[level], count=self.n, bitorder="little")

    def all_ids(self) -> np.ndarray:
        """Every id in order, plane by plane from the lowest bit."""
        v = np.zeros(self.n, np.uint8)
        for place in range(self.levels):
            if place in (8, 16):  # no wider than the bits read so far
                v = v.astype(np.uint16 if place == 8 else np.uint32)
            bits = self.bits(self.levels - 1 - place).view(bool)
            off = self.zeros[self.levels - 1 - place]
            up = np.empty_like(v)
            up[~bits] = v[:off]
            up[bits] = v[off:] | v.dtype.type(1 << place)
            v = up
        return v

    # succinct access ---------------------------------------------------------------------------

    @property
    def ranks(self) -> list[np.ndarray]:
        if self._ranks is None:
            self._ranks = []
            for p in self.packed:
                ones = np.bitwise_count(np.pad(p, (0, -len(p) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
                self._ranks.append(np.concatenate([[0], np.cumsum(ones)]))
        return self._ranks

    def _bit(self, level: int, i: int) -> int:
        return int(self.packed[level][i >> 3] >> (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        p, block = self.packed[level], i // BLOCK
        lo, hi = block * BLOCK // 8, i >> 3
        n = int(self.ranks[level][block]) + int(np.bitwise_count(p[lo:hi]).sum())
        return n + (int(p[hi] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) zero or one of a plane."""
        r = self.ranks[level]
        before = r if bit else np.arange(len(r)) * BLOCK - r
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.packed[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        v = 0
        for level in range(self.levels):
            b = self._bit(level, i)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if b else i - ones
            v = v * 2 + b
        return v

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        if symbol >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if symbol >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in positions lo to hi."""
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def locate(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        lo, hi = self._range(symbol, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.levels - 1, -1, -1):
            bit = symbol >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i
