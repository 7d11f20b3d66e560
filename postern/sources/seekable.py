"""Files in the seekable format of Zstandard: independent frames, then their sizes in a frame that decoders skip.

``zstd -d`` reads such a file whole; here any range of its content is read by decoding the frames that hold it.
"""

from __future__ import annotations

import bisect
import mmap
from typing import BinaryIO

import numpy as np
import pyarrow as pa

SUFFIX = ".zst"
#: Bytes of content in a frame, so that a range of a megabyte decodes little beside its own.
FRAME_BYTES = 256 << 10
_LEVEL = 3
_SKIPPED, _MAGIC = 0x184D2A5E, 0x8F92EAB1
_SIZES = np.dtype([("stored", "<u4"), ("held", "<u4")])


class Writer:
    """Frames of what is written, cut at a fixed size wherever that falls. ``sizes`` is their part of the table."""

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.pending, self.codec = out, bytearray(), pa.Codec("zstd", _LEVEL)
        self.sizes: list[tuple[int, int]] = []

    def write(self, data: bytes) -> int:
        self.pending += data
        while len(self.pending) >= FRAME_BYTES:
            self._frame(bytes(self.pending[:FRAME_BYTES]))
            del self.pending[:FRAME_BYTES]
        return len(data)

    def flush(self) -> None:
        if self.pending:
            self._frame(bytes(self.pending))
            self.pending.clear()

    def _frame(self, data: bytes) -> None:
        self.sizes.append((self.out.write(self.codec.compress(data, asbytes=True)), len(data)))


def table(sizes: list[tuple[int, int]]) -> bytes:
    """What ends a file of these frames."""
    rows = np.array(sizes, _SIZES).tobytes()
    head = np.array([_SKIPPED, len(rows) + 9], "<u4").tobytes()
    return head + rows + np.array([len(sizes)], "<u4").tobytes() + b"\0" + np.array([_MAGIC], "<u4").tobytes()


class Frames:
    """The content of such a file: its length, slices and ``find``. Keeps the frames that it decoded last."""

    KEPT = 4

    def __init__(self, data: mmap.mmap | bytes) -> None:
        sizes, n, begin = np.empty(0, _SIZES), 0, -1
        if len(data) >= 17 and int.from_bytes(data[-4:], "little") == _MAGIC:
            n = int.from_bytes(data[-9:-5], "little")
            wide = _SIZES.itemsize + 4 * (data[-5] >> 7)  # with a checksum for each frame
            begin = len(data) - 9 - n * wide
        if begin >= 8:
            table = np.frombuffer(data[begin : begin + n * wide], np.uint8).reshape(n, wide)
            sizes = table[:, : _SIZES.itemsize].copy().view(_SIZES).reshape(n)
        if begin != sizes["stored"].sum(dtype=np.int64) + 8:
            raise ValueError("not a whole file in the seekable format of Zstandard: its table of frames does not fit it")
        self.data, self.codec, self.kept = data, pa.Codec("zstd"), {}
        self.stored = [0, *np.cumsum(sizes["stored"], dtype=np.int64).tolist()]
        self.starts = [0, *np.cumsum(sizes["held"], dtype=np.int64).tolist()]
        self.base, self.end, self.block = 0, 0, b""

    def __len__(self) -> int:
        return self.starts[-1]

    def _at(self, at: int) -> None:
        """Makes the frame that holds this byte the current one."""
        i = bisect.bisect_right(self.starts, at) - 1
        if i not in self.kept:
            if len(self.kept) >= self.KEPT:
                del self.kept[next(iter(self.kept))]
            stored = self.data[self.stored[i] : self.stored[i + 1]]
            self.kept[i] = self.codec.decompress(stored, self.starts[i + 1] - self.starts[i], asbytes=True)
        self.base, self.end, self.block = self.starts[i], self.starts[i + 1], self.kept[i]

    def __getitem__(self, part: slice) -> bytes:
        at, end = part.start, part.stop
        if self.base <= at <= end <= self.end:
            return self.block[at - self.base : end - self.base]
        end, out = min(end, len(self)), []
        while at < end:
            self._at(at)
            out.append(self.block[at - self.base : end - self.base])
            at = self.end
        return b"".join(out)

    def find(self, what: bytes, start: int, end: int | None = None) -> int:
        at, end = start, len(self) if end is None else min(end, len(self))
        over = len(what) - 1
        while at < end:
            if not self.base <= at < self.end:
                self._at(at)
            base, stop = self.base, self.end
            hit = self.block.find(what, at - base, end - base)
            if hit >= 0:
                return base + hit
            if stop >= end:
                return -1
            seam = max(at, stop - over)  # what begins in this frame and ends in a later one
            hit = self[seam : min(end, stop + over)].find(what)
            if hit >= 0:
                return seam + hit
            at = stop
        return -1
