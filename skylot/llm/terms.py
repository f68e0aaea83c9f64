"""Terms of whole texts as bytes, and sums of their checks, many at a time."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: What belongs to terms: digits, letters and all beyond ASCII. A-Z become small, the rest white space.
_KEPT = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Terms that a Python worker keeps at most, but for one batch; then it starts anew.
CACHE = 500_000
#: Texts taken apart at once.
ROWS = 256
_POLYNOMIAL, _LONG = 0xEDB88320, 48


def split(text: bytes | None) -> list[bytes]:
    """The maximal runs `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, only A-Z lower-cased; null has none."""
    return text.translate(_KEPT).split() if text else []


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Few rows at a time, with the bytes of their column text."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column("text").cast(pa.binary()).to_pylist()


@functools.cache
def _advanced() -> np.ndarray:
    """[n, k, v]: the check v << 8k after n zero bytes; checks of joined strings are sums of such."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(_POLYNOMIAL), step >> 1)
    tables = np.empty((_LONG + 1, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _LONG + 1):
        tables[n] = (tables[n - 1] >> 8) ^ step[tables[n - 1] & 255]
    return tables


class Checks:
    """CRC-32 of terms, and of pairs of terms joined by a space."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.alone, self.behind, self.length = np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.int64)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > CACHE:
            self.__init__()
        if new := list(set(words) - self.number.keys()):
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.alone = np.append(self.alone, np.fromiter(map(zlib.crc32, new), np.uint32, len(new)))
            self.behind = np.append(self.behind, np.fromiter((zlib.crc32(b" " + w) for w in new), np.uint32, len(new)))
            self.length = np.append(self.length, np.fromiter(map(len, new), np.int64, len(new)))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def of(self, words: list[bytes], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(checks of words, checks of pairs of neighbours, places of the first of each pair). starts: where texts begin."""
        at = self._numbers(words)
        first = np.setdiff1d(np.arange(len(words) - 1), starts - 1) if len(words) > 1 else np.empty(0, np.int64)
        left, right, n = self.alone[at[first]], self.behind[at[first + 1]], self.length[at[first + 1]] + 1
        tables, short = _advanced(), np.minimum(n, _LONG)
        pairs = right.copy()
        for k in range(4):
            pairs ^= tables[short, k, (left >> np.uint32(8 * k)) & np.uint32(255)]
        for i in np.flatnonzero(n > _LONG):
            pairs[i] = zlib.crc32(b" " + words[first[i] + 1], int(left[i]))
        return self.alone[at], pairs, first


@functools.cache
def checks() -> Checks:
    """One a Python worker."""
    return Checks()
