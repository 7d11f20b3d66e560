"""Wavelet matrix over token ids: one compressed file per shard with access, counting and occurrence lookup.

The matrix is Huffman-shaped: ids have prefix codes by their frequency in the shard, level k holds bit k of the
codes that are longer than k, in the stable order by the bits before it, last bit first. Codes are dealt so that the
ids that end at a level stand last in the next order, so dropping them moves no other position. A shard
takes the entropy of its ids (about 1.1 bytes per id where plain 16-bit ids take 2) and 1/16 more for ranks.

File: magic, a little-endian header (version, levels, tokens, documents, shard key), the documents' ids,
validity and token counts and the shard's ids with their counts and code lengths (both deflated), then for every
level: the number of zeros, a rank directory (ones before every 512th position) and the packed bits. There is no
other copy of the ids.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np

MAGIC = b"WVMX"
VERSION = 2
HEADER = struct.Struct("<4sHHqqqq")
BLOCK = 512
#: Longest code, and the longest in shards of at most ``FEW`` distinct ids; frequencies are flattened until it fits.
LONGEST, SHORT, FEW = 32, 16, 1 << 13


class Plane:
    """A bit vector with rank and select."""

    def __init__(self, packed: np.ndarray, ones_before: np.ndarray, n: int, zeros: int) -> None:
        self.packed, self.ones_before, self.n, self.zeros = packed, ones_before, n, zeros

    def bit(self, i: int) -> int:
        return (int(self.packed[i >> 3]) >> (i & 7)) & 1

    def rank1(self, i: int) -> int:
        """Ones among the first ``i`` bits."""
        block = i // BLOCK
        first, last = block * (BLOCK // 8), i >> 3
        n = int(self.ones_before[block]) + int(np.bitwise_count(self.packed[first:last]).sum())
        return n + ((int(self.packed[last]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def rank(self, bit: int, i: int) -> int:
        return self.rank1(i) if bit else i - self.rank1(i)

    def select(self, bit: int, k: int) -> int:
        """Position of the k-th (0-based) ``bit``."""
        before = self.ones_before if bit else np.minimum(np.arange(len(self.ones_before)) * BLOCK, self.n) - self.ones_before
        block = int(np.searchsorted(before, k, side="right")) - 1
        first = block * BLOCK
        bits = np.unpackbits(self.packed[first // 8 : first // 8 + BLOCK // 8], bitorder="little")[: self.n - first]
        return first + int(np.flatnonzero(bits == bit)[k - int(before[block])])


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths; a lone symbol has length 1."""
    if len(counts) < 2:
        return np.ones(len(counts), np.uint8)
    weights = counts.astype(np.int64)
    while True:
        heap = [(int(c), i) for i, c in enumerate(weights)]
        heapq.heapify(heap)
        up, node = [0] * (2 * len(heap) - 1), len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[1]] = up[b[1]] = node
            heapq.heappush(heap, (a[0] + b[0], node))
            node += 1
        depth = [0] * node
        for i in range(node - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        lengths = np.array(depth[: len(counts)])
        if lengths.max() <= (SHORT if len(counts) <= FEW else LONGEST):
            return lengths.astype(np.uint8)
        weights = (weights + 1) // 2


class Code:
    """Ids in ascending order, their counts and code lengths; ``code`` has the bits from the highest of 32 down."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> None:
        self.symbols, self.counts, self.lengths = symbols, counts, lengths
        self.code = np.zeros(len(symbols), np.uint32)
        #: Per level, the positions of the ids that end there, in the order in which they stand.
        self.ending: list[np.ndarray] = []
        #: Per level, the tokens whose codes reach it.
        self.sizes = [int(counts.sum())]
        open_ = np.zeros(1, np.uint32)
        for k in range(int(lengths.max()) if len(lengths) else 0):
            nodes = np.concatenate([open_, open_ | np.uint32(1 << (31 - k))])
            ends = np.flatnonzero(lengths == k + 1)
            open_ = nodes[: len(nodes) - len(ends)]
            self.code[ends] = nodes[len(open_) :]
            self.ending.append(ends)
            self.sizes.append(self.sizes[-1] - int(counts[ends].sum()))

    @classmethod
    def of(cls, ids: np.ndarray) -> Code:
        if len(ids) and int(ids.max()) < 1 << 22:
            counts = np.bincount(ids)
            symbols = np.flatnonzero(counts)
            counts = counts[symbols]
        else:
            symbols, counts = np.unique(ids, return_counts=True)
        return cls(symbols.astype(np.uint32), counts.astype(np.int64), code_lengths(counts))

    def place(self, token: int) -> int:
        """Position of ``token`` among the ids; -1 if it does not occur."""
        at = int(np.searchsorted(self.symbols, token)) if token >= 0 else len(self.symbols)
        return at if at < len(self.symbols) and int(self.symbols[at]) == token else -1

    def bits(self, place: int) -> list[int]:
        return [int(self.code[place]) >> (31 - k) & 1 for k in range(int(self.lengths[place]))]


class WaveletMatrix:
    """A sequence of ids, level by level."""

    def __init__(self, planes: list[Plane], code: Code) -> None:
        self.planes, self.code, self.n = planes, code, code.sizes[0]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        code, planes = Code.of(ids), []
        if len(code.symbols):
            top = int(code.symbols[-1]) + 1
            if top <= 1 << 22:
                of = np.zeros(top, np.uint32)
                of[code.symbols] = code.code
                now = of[ids]
            else:
                now = code.code[np.searchsorted(code.symbols, ids)]
            if int(code.lengths.max()) <= 16:
                now = (now >> np.uint32(16)).astype(np.uint16)
        for n, following in zip(code.sizes, code.sizes[1:], strict=False):
            ones = now >= now.dtype.type(1 << (8 * now.itemsize - 1))
            packed = np.packbits(ones, bitorder="little")
            full = np.zeros(-(-max(n, 1) // BLOCK) * (BLOCK // 8), np.uint8)
            full[: len(packed)] = packed
            counts = np.bitwise_count(full.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            before = np.concatenate([np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)])
            planes.append(Plane(packed, before, n, n - int(before[-1])))
            now <<= now.dtype.type(1)
            now = np.concatenate([now[~ones], now[ones]])[:following]
        return cls(planes, code)

    def access(self, i: int) -> int:
        for k, plane in enumerate(self.planes):
            i = plane.zeros + plane.rank1(i) if plane.bit(i) else i - plane.rank1(i)
            if i >= self.code.sizes[k + 1]:  # its code ends here
                ends = self.code.ending[k]
                upto = np.cumsum(self.code.counts[ends]) + self.code.sizes[k + 1]
                return int(self.code.symbols[ends[np.searchsorted(upto, i, side="right")]])
        raise IndexError(i)

    def _range(self, place: int, upto: int) -> tuple[int, int]:
        """Where the occurrences of an id among the first ``upto`` stand in the order in which it ends."""
        lo, hi = 0, upto
        for bit, plane in zip(self.code.bits(place), self.planes, strict=False):
            lo, hi = plane.rank(bit, lo) + plane.zeros * bit, plane.rank(bit, hi) + plane.zeros * bit
        return lo, hi

    def count(self, token: int, upto: int | None = None) -> int:
        """Occurrences of ``token`` among the first ``upto`` ids (all by default)."""
        if (place := self.code.place(token)) < 0:
            return 0
        lo, hi = self._range(place, self.n if upto is None else upto)
        return hi - lo

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th (0-based) occurrence of ``token``; -1 if there are fewer."""
        if not 0 <= k < self.count(token):
            return -1
        place = self.code.place(token)
        at = self._range(place, self.n)[0] + k
        bits = self.code.bits(place)
        for bit, plane in zip(reversed(bits), reversed(self.planes[: len(bits)]), strict=True):
            at = plane.select(bit, at - plane.zeros * bit)
        return at

    def ids(self) -> np.ndarray:
        """The whole sequence: the stable partitions undone from the last level up."""
        code = self.code
        kind = np.uint16 if not len(code.symbols) or code.symbols[-1] < 1 << 16 else np.uint32
        now = np.zeros(0, kind)
        for plane, ends in zip(reversed(self.planes), reversed(code.ending), strict=True):
            now = np.concatenate([now, np.repeat(code.symbols[ends].astype(kind), code.counts[ends])])
            ones = np.unpackbits(plane.packed, count=plane.n, bitorder="little").view(bool)
            before = np.empty_like(now)
            before[~ones] = now[: plane.zeros]
            before[ones] = now[plane.zeros :]
            now = before
        return now


def _deflated(*arrays: np.ndarray) -> bytes:
    table = zlib.compress(b"".join(a.tobytes() for a in arrays), 1)
    return struct.pack("<q", len(table)) + table


def to_bytes(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None], part: int, shard: int) -> bytes:
    matrix = WaveletMatrix.build(ids)
    code = matrix.code
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([0 if d is None else d for d in doc_ids], np.int64)
    out = [HEADER.pack(MAGIC, VERSION, len(matrix.planes), matrix.n, len(doc_ids), part, shard)]
    out.append(_deflated(np.diff(numbers, prepend=0), valid, lengths.astype("<i8")))
    out += [struct.pack("<q", len(code.symbols)), _deflated(code.symbols.astype("<u4"), code.counts.astype("<i8"), code.lengths)]
    for plane in matrix.planes:
        out += [struct.pack("<q", plane.zeros), plane.ones_before.astype("<u4").tobytes(), plane.packed.tobytes()]
    return b"".join(out)


def from_bytes(raw: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray, int, int]:
    """matrix, doc ids, tokens per document, partition, shard."""
    magic, version, levels, n, docs, part, shard = HEADER.unpack_from(raw)
    if magic != MAGIC or version != VERSION:
        raise ValueError(f"not a wavelet shard of version {VERSION}")
    at = HEADER.size

    def number() -> int:
        nonlocal at
        at += 8
        return struct.unpack_from("<q", raw, at - 8)[0]

    def inflated() -> bytes:
        nonlocal at
        size = number()
        at += size
        return zlib.decompress(raw[at - size : at])

    table = inflated()
    numbers = np.cumsum(np.frombuffer(table, np.int64, docs))
    valid = np.frombuffer(table, np.uint8, docs, 8 * docs)
    lengths = np.frombuffer(table, "<i8", docs, 9 * docs)
    m = number()
    table = inflated()
    code = Code(np.frombuffer(table, "<u4", m), np.frombuffer(table, "<i8", m, 4 * m), np.frombuffer(table, np.uint8, m, 12 * m))
    planes = []
    for size in code.sizes[:levels]:
        zeros, blocks = number(), -(-max(size, 1) // BLOCK) + 1
        before = np.frombuffer(raw, "<u4", blocks, at)
        packed = np.frombuffer(raw, np.uint8, -(-size // 8), at + 4 * blocks)
        at += 4 * blocks + len(packed)
        planes.append(Plane(packed, before, size, zeros))
    ids = [int(d) if v else None for d, v in zip(numbers, valid, strict=True)]
    return WaveletMatrix(planes, code), ids, lengths, part, shard
