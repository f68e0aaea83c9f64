"""Progressive JPEG in numpy: scans into coefficient arrays, and those into RGB tensors.

A decoder keeps a coefficient array a component. Every scan adds to it: a spectral selection brings a
band of coefficients, a first pass brings their high bits (successive approximation), and refinement
passes one bit more each. Entropy decoding goes through all restart segments of a scan side by side:
one step of the loop reads a symbol in every segment, so a file cut finely by restart markers, or many
files of one layout at once, decode at array speed. A file without restart markers is one segment.

Supported: 8 bits a sample, Huffman coding, one or three components, sampling factors 1 and 2,
restart intervals that hold whole MCUs, spectral selection, successive approximation, runs of blocks
without further coefficients (EOB runs).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: The zigzag order as (row, column) places of an 8 x 8 block: along diagonals, to and fro.
ZIGZAG = np.array([8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)),
                   key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))])

#: A marker that is neither a stuffed byte nor a restart.
_NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


@dataclass
class Scan:
    components: list[int]
    low: int
    high: int
    was: int  # the bit position of the pass before; 0: this is the first
    now: int
    tables: dict  # (0 for DC, 1 for AC; component) -> lookup of 16 bits
    data: bytes
    restart: int


@dataclass
class Frame:
    height: int = 0
    width: int = 0
    sampling: list[tuple[int, int]] = field(default_factory=list)
    comment: bytes = b""
    quantizer: list[int] = field(default_factory=list)
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)

    def grid(self) -> tuple[int, int]:
        """MCUs down and across."""
        v, h = max(s[1] for s in self.sampling), max(s[0] for s in self.sampling)
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))


@lru_cache(64)
def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """65536 entries: symbol << 8 | code length, by the next 16 bits; 0 where there is no code."""
    table, code, k = np.zeros(65536, np.int32), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            first = code << (16 - length)
            table[first:first + (1 << (16 - length))] = symbols[k] << 8 | length
            code, k = code + 1, k + 1
        code <<= 1
    return table


def parse(data: bytes) -> Frame:
    """The markers of a file; entropy-coded data stays as it is."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    frame, at, huffman, restart = Frame(), 2, {}, 0
    ids: list[int] = []
    while at < len(data):
        marker, size = data[at + 1], int.from_bytes(data[at + 2:at + 4], "big")
        if marker == 0xD9:
            break
        body = data[at + 4:at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1:65 + 64 * wide], ">u2" if wide else np.uint8)
                frame.tables[body[0] & 15] = values.astype(np.int32)
                body = body[65 + 64 * wide:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0] >> 4, body[0] & 15] = lookup(bytes(body[1:17]), bytes(body[17:17 + n]))
                body = body[17 + n:]
        elif marker == 0xFE:
            frame.comment = body
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xC2:
            if body[0] != 8:
                raise ValueError("only 8 bits a sample")
            frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for k in range(body[5]):
                i, s, q = body[6 + 3 * k:9 + 3 * k]
                ids.append(i)
                frame.sampling.append((s >> 4, s & 15))
                frame.quantizer.append(q)
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("no progressive Huffman JPEG")
        elif marker == 0xDA:
            n = body[0]
            parts = [ids.index(body[1 + 2 * k]) for k in range(n)]
            tables = {}
            for k, c in enumerate(parts):
                t = body[2 + 2 * k]
                tables |= {(kind, c): huffman[kind, i] for kind, i in ((0, t >> 4), (1, t & 15)) if (kind, i) in huffman}
            low, high, bits = body[1 + 2 * n:4 + 2 * n]
            end = _NEXT.search(data, at).start()
            frame.scans.append(Scan(parts, low, high, bits >> 4, bits & 15, tables, data[at:end], restart))
            at = end
    return frame


class _Segments:
    """The restart segments of scans, read side by side."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        ff = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) > 1 else np.empty(0, np.int64)
        after = raw[ff + 1]
        marks = ff[(after >= 0xD0) & (after <= 0xD7)]
        keep = np.ones(len(raw), bool)
        keep[ff[after == 0] + 1] = False
        keep[marks] = keep[marks + 1] = False
        kept = np.cumsum(keep)
        cut = np.concatenate([[0], kept[marks]]) if len(marks) else np.zeros(1, np.int64)
        self.bytes = np.concatenate([raw[keep], np.zeros(8, np.uint8)]).astype(np.uint32)
        self.words = self.bytes[:-3] << 24 | self.bytes[1:-2] << 16 | self.bytes[2:-1] << 8 | self.bytes[3:]
        self.at = cut.astype(np.int64) * 8

    def __len__(self) -> int:
        return len(self.at)

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        """The next 16 bits of each lane."""
        at = self.at[lanes]
        return (self.words[at >> 3] >> (16 - (at & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF

    def bits(self, lanes: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """The next n (up to 16) bits of each lane, taken."""
        value = self.peek(lanes) >> (16 - n)
        self.at[lanes] += n
        return value

    def symbol(self, lanes: np.ndarray, table: np.ndarray) -> np.ndarray:
        entry = table[self.peek(lanes)]
        if not (entry & 31).all():
            raise ValueError("broken entropy-coded data")
        self.at[lanes] += entry & 31
        return (entry >> 8).astype(np.int64)


def _signed(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(value < (1 << np.maximum(size - 1, 0)), value - (1 << size) + 1, value)


def _first_dc(seg: _Segments, lanes: np.ndarray, table: np.ndarray) -> np.ndarray:
    size = seg.symbol(lanes, table)
    return _signed(seg.bits(lanes, size), size)


def _first_ac(seg: _Segments, lanes: np.ndarray, eob: np.ndarray, table: np.ndarray, scan: Scan) -> np.ndarray:
    """One block of each lane: the band's coefficients, (lanes, 64)."""
    block = np.zeros((len(lanes), 64), np.int32)
    idle = eob[lanes] > 0
    eob[lanes[idle]] -= 1
    live = np.flatnonzero(~idle)
    k = np.full(len(lanes), scan.low)
    while len(live):
        symbol = seg.symbol(lanes[live], table)
        run, size = symbol >> 4, symbol & 15
        ends = (size == 0) & (run < 15)
        if ends.any():
            who = live[ends]
            eob[lanes[who]] = (1 << run[ends]) - 1 + seg.bits(lanes[who], run[ends])
            live, run, size = live[~ends], run[~ends], size[~ends]
        k[live] += run
        value = _signed(seg.bits(lanes[live], size), size)
        real = size > 0
        block[live[real], k[live[real]]] = value[real] << scan.now
        k[live] += 1
        live = live[k[live] <= scan.high]
    return block


def _refine_ac(seg: _Segments, lanes: np.ndarray, eob: np.ndarray, table: np.ndarray, scan: Scan, block: np.ndarray) -> None:
    """One block of each lane gets its next bit, in place. At each place a lane reads a symbol if it has
    none open; the symbol's run counts the zeros to pass, and coefficients on the way get a bit each."""
    bit = 1 << scan.now
    over = eob[lanes] > 0
    eob[lanes[over]] -= 1
    open_ = np.zeros(len(lanes), bool)
    run, new = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    for k in range(scan.low, scan.high + 1):
        need = np.flatnonzero(~over & ~open_)
        if len(need):
            symbol = seg.symbol(lanes[need], table)
            r, s = symbol >> 4, symbol & 15
            ends = (s == 0) & (r < 15)
            if ends.any():
                who = need[ends]
                eob[lanes[who]] = (1 << r[ends]) - 1 + seg.bits(lanes[who], r[ends])
                over[who] = True
            stays = need[~ends]
            if len(stays):
                run[stays], open_[stays] = r[~ends], True
                new[stays] = 0
                fresh = need[s > 0]
                new[fresh] = np.where(seg.bits(lanes[fresh], 1) > 0, bit, -bit)
        here = block[:, k]
        known = np.flatnonzero(here)
        if len(known):
            plus = seg.bits(lanes[known], 1) > 0
            grow = known[plus & ((np.abs(here[known]) & bit) == 0)]
            block[grow, k] += np.where(block[grow, k] > 0, bit, -bit).astype(np.int32)
        if open_.any():
            zero = open_.copy()
            zero[known] = False
            placed = zero & (run == 0)
            block[placed, k] = new[placed]
            open_ &= ~placed
            run[zero & ~placed] -= 1


def coefficients(frames: list[Frame]) -> list[list[np.ndarray]]:
    """By frame and component, (blocks down, blocks across, 64) in zigzag order. The frames have scans
    of one layout; the segments of all of them are decoded side by side."""
    first = frames[0]
    n_parts = len(first.sampling)
    grids = [f.grid() for f in frames]
    most_h, most_v = max(s[0] for s in first.sampling), max(s[1] for s in first.sampling)
    shapes = [[(d * v, a * h) for h, v in first.sampling] for d, a in grids]
    base = [np.cumsum([0] + [s[c][0] * s[c][1] for s in shapes]) for c in range(n_parts)]
    flat = [np.zeros((base[c][-1], 64), np.int32) for c in range(n_parts)]
    for k, scan in enumerate(first.scans):
        where: dict[tuple[int, int], list[np.ndarray]] = {}
        units, data, restarts = [], [], []
        for i, (frame, (down, across)) in enumerate(zip(frames, grids, strict=True)):
            own = frame.scans[k]
            if (own.components, own.low, own.high, own.was, own.now) != (scan.components, scan.low, scan.high, scan.was, scan.now) or any(
                    own.tables[t] is not scan.tables[t] for t in scan.tables) or frame.sampling != first.sampling:
                raise ValueError("frames of several layouts")
            if len(scan.components) == 1:
                c = scan.components[0]
                h, v = frame.sampling[c]
                rows, columns = -(-(-(-frame.height * v // most_v)) // 8), -(-(-(-frame.width * h // most_h)) // 8)
                at = np.add.outer(np.arange(rows) * shapes[i][c][1], np.arange(columns)).ravel()
                where.setdefault((c, 0), []).append(at + base[c][i])
                units.append(rows * columns)
            else:
                for c in scan.components:
                    h, v = frame.sampling[c]
                    wide = shapes[i][c][1]
                    top = np.add.outer(np.arange(down) * v * wide, np.arange(across) * h).ravel() + base[c][i]
                    for j in range(h * v):
                        where.setdefault((c, j), []).append(top + j // h * wide + j % h)
                units.append(down * across)
            data.append(own.data)
            restarts.append(own.restart or units[-1])
        places = [(c, np.concatenate(x)) for (c, _), x in where.items()]
        seg = _Segments(b"\xff\xd0".join(data))
        units, restarts = np.array(units), np.array(restarts)
        cuts = -(-units // restarts)
        if len(seg) != cuts.sum():
            raise ValueError("restart markers don't fit the scan")
        owner = np.repeat(np.arange(len(frames)), cuts)
        nth = np.arange(len(seg)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = nth * restarts[owner]
        size = np.minimum(restarts[owner], units[owner] - start)
        start += (np.cumsum(units) - units)[owner]
        last = {c: np.zeros(len(seg), np.int64) for c in scan.components}
        eob = np.zeros(len(seg), np.int64)
        for step in range(int(size.max())):
            lanes = np.flatnonzero(size > step)
            for c, at in places:
                here = at[start[lanes] + step]
                if scan.low == 0 and scan.was == 0:
                    last[c][lanes] += _first_dc(seg, lanes, scan.tables[0, c])
                    flat[c][here, 0] = last[c][lanes] << scan.now
                elif scan.low == 0:
                    flat[c][here, 0] |= (seg.bits(lanes, 1) << scan.now).astype(np.int32)
                elif scan.was == 0:
                    flat[c][here] += _first_ac(seg, lanes, eob, scan.tables[1, c], scan)
                else:
                    block = flat[c][here]
                    _refine_ac(seg, lanes, eob, scan.tables[1, c], scan, block)
                    flat[c][here] = block
    return [[flat[c][base[c][i]:base[c][i + 1]].reshape(*shapes[i][c], 64) for c in range(n_parts)] for i in range(len(frames))]


#: The cosines of the transform, times 4096 and rounded: sums of products are whole numbers below 2**53,
#: so that samples don't depend on the order of additions.
_COS = np.rint(4096 * np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8)[None, :] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(0.125), 0.5))
_NATURAL = np.argsort(ZIGZAG)


def inverse_transform(blocks: np.ndarray) -> np.ndarray:
    """(down, across, 64) dequantized coefficients in zigzag order -> samples (8 down, 8 across)."""
    down, across, _ = blocks.shape
    natural = blocks[..., _NATURAL].astype(np.float64)
    both = _COS @ (natural.reshape(-1, 8) @ _COS.T).reshape(-1, 8, 8)
    samples = np.clip(np.rint(both * 2.0**-24 + 128), 0, 255).astype(np.int32)
    return samples.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)


def rgb(frame: Frame, arrays: list[np.ndarray]) -> np.ndarray:
    """(height, width, 3) uint8; chroma is repeated up to full resolution."""
    most_h, most_v = max(s[0] for s in frame.sampling), max(s[1] for s in frame.sampling)
    planes = []
    for c, (h, v) in enumerate(frame.sampling):
        plane = inverse_transform(arrays[c] * frame.tables[frame.quantizer[c]])
        planes.append(plane.repeat(most_v // v, 0).repeat(most_h // h, 1)[:frame.height, :frame.width])
    y = planes[0]
    if len(planes) == 1:
        return np.stack([y, y, y], -1).astype(np.uint8)
    cb, cr = planes[1] - 128, planes[2] - 128
    half = 1 << 15  # the usual factors, in 1/65536
    out = np.stack([y + (91881 * cr + half >> 16), y - (22554 * cb + 46802 * cr + half >> 16), y + (116130 * cb + half >> 16)], -1)
    return np.clip(out, 0, 255).astype(np.uint8)
