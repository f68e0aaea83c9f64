"""Media columns: payloads stored as progressive JPEGs, read back as coefficients and RGB tensors.

A payload's bytes become quantized coefficients, 64 a block in zigzag order, byte b as 256 + b: the
luma plane is filled first, then the two chroma planes of half its resolution (4:2:0). Five scans a
plane write them: the DC coefficients' high bits, their last bit, two bands of the AC coefficients'
high bits, and their last bit, with a restart marker behind each block, so that readers can go through
all blocks side by side. With all values between 256 and 511 each code has the same length, and numpy
packs a batch of documents at once. The quantizer is 1, so that JPEG's own unit, the quantized
coefficient, holds the payload without loss; the comment holds its length.

Cases: a null text is empty, and the payload of an empty one is 64 zero bytes; equal texts give equal
files and features; a document is encoded whole, in slices of blocks; an empty table gives an empty
one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skylot.llm import jpeg

BLOCK = 64
#: MCUs across at most (65,535 samples), and blocks that are worked on at once.
ACROSS, AT_ONCE = 4095, 32768
#: (low, high, position of the pass before, position now) of each plane's scans.
SCANS = [(0, 0, 0, 1), (0, 0, 1, 0), (1, 5, 0, 1), (6, 63, 0, 1), (1, 63, 1, 0)]
SAMPLING = [(2, 2), (1, 1), (1, 1)]


def _marker(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, number: int, symbol: int) -> bytes:
    """A Huffman table of one symbol, whose code is 0."""
    return bytes([kind << 4 | number, 1, *[0] * 15, symbol])


_TABLES = _marker(0xDB, bytes([0, *[1] * 64])) + _marker(0xC4, _table(0, 0, 8) + _table(1, 0, 8) + _table(1, 1, 0))


def _scan_bytes(values: np.ndarray, low: int, high: int, was: int) -> np.ndarray:
    """(blocks, 64) payload bytes -> (blocks, n) entropy-coded bytes of one scan."""
    part = values[:, low:high + 1]
    if was:  # the last bits; before AC ones, the code of "no new coefficient in this block"
        bits = part & 1
        if low:
            bits = np.concatenate([np.zeros((len(part), 1), np.uint8), bits], 1)
    else:  # code 0 (eight bits follow), then 128 + b // 2
        bits = np.unpackbits((part >> 1 | 128)[..., None], axis=2)
        bits = np.concatenate([np.zeros((*part.shape, 1), np.uint8), bits], 2).reshape(len(part), -1)
    if pad := -bits.shape[1] % 8:
        bits = np.concatenate([bits, np.ones((len(bits), pad), np.uint8)], 1)
    return np.packbits(bits, axis=1)


def _stuffed(coded: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with a zero behind each 255 and a restart marker behind each block; the blocks' ends,
    before their markers. nth: each block's number in its scan."""
    flat, wide = coded.ravel(), coded.shape[1]
    full = flat == 255
    block = np.repeat(np.arange(len(coded)), wide)
    shift = np.cumsum(full)
    out = np.zeros(len(flat) + int(shift[-1]) + 2 * len(coded), np.uint8)
    out[np.arange(len(flat)) + shift - full + 2 * block] = flat
    ends = np.arange(1, len(coded) + 1) * wide + shift[wide - 1::wide] + 2 * np.arange(len(coded))
    out[ends], out[ends + 1] = 255, 0xD0 + nth % 8
    return out, ends


def encode(payloads: list[bytes], lengths: list[int]) -> list[bytes]:
    """A JPEG a payload (each a positive multiple of 64 bytes); lengths go into the comments."""
    grids, planes = [], [[], [], []]
    for payload in payloads:
        mcus = -(-len(payload) // (6 * BLOCK))
        across = min(mcus, ACROSS)
        down = -(-mcus // across)
        n = across * down
        blocks = np.zeros((6 * n, BLOCK), np.uint8)
        blocks.reshape(-1)[:len(payload)] = np.frombuffer(payload, np.uint8)
        grids.append((down, across))
        for plane, part in zip(planes, (blocks[:4 * n], blocks[4 * n:5 * n], blocks[5 * n:]), strict=True):
            plane.append(part)
    coded: list[list[bytes]] = [[] for _ in payloads]
    for c, plane in enumerate(planes):
        values, size = np.concatenate(plane), np.array([len(p) for p in plane])
        stop = np.cumsum(size)
        nth = np.arange(len(values)) - np.repeat(stop - size, size)
        for low, high, was, now in SCANS:
            head = _marker(0xDA, bytes([1, c + 1, 1 if low and was else 0, low, high, was << 4 | now]))
            parts, ends, base = [], [], 0
            for at in range(0, len(values), AT_ONCE):
                raw, e = _stuffed(_scan_bytes(values[at:at + AT_ONCE], low, high, was), nth[at:at + AT_ONCE])
                parts.append(raw.tobytes())
                ends.append(e + base)
                base += len(raw)
            data, ends, start = b"".join(parts), np.concatenate(ends), 0
            for own, last in zip(coded, ends[stop - 1].tolist(), strict=True):
                own += [head, data[start:last]]
                start = last + 2
    files = []
    for (down, across), own, n in zip(grids, coded, lengths, strict=True):
        frame = b"\x08" + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        files.append(b"".join([b"\xff\xd8", _marker(0xFE, b"bytes=%d" % n), _TABLES, _marker(0xC2, frame), _marker(0xDD, b"\x00\x01"), *own, b"\xff\xd9"]))
    return files


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def payload(frame: jpeg.Frame, arrays: list[np.ndarray]) -> tuple[bytes, int]:
    """What a stored file holds, and its length without padding."""
    n = int(frame.comment.removeprefix(b"bytes="))
    raw = b"".join((a.reshape(-1, 64) - 256).astype(np.uint8).tobytes() for a in arrays)
    return raw[:max(BLOCK, -(-n // BLOCK) * BLOCK)], n


def feature(image: np.ndarray) -> str:
    """Size and exact channel sums of an RGB tensor."""
    height, width, _ = image.shape
    red, green, blue = image.reshape(-1, 3).sum(0, dtype=np.int64).tolist()
    return f"{width}x{height}:{red},{green},{blue}"


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of at most AT_ONCE blocks together, or of one."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > AT_ONCE:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


STORED = "doc_id long, media binary"


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> STORED: every text as a progressive JPEG."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for a, b in _groups([len(r) // BLOCK + 1 for r in raw]):
                files = encode([padded(r) for r in raw[a:b]], [len(r) for r in raw[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(files, pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(write, STORED)


DECODED = "doc_id long, height int, width int, pixels binary"
DIGEST = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
          "media_sha256 string, feature string")


def _decoded(media: list[bytes]) -> Iterator[tuple[int, jpeg.Frame, list[np.ndarray]]]:
    frames = [jpeg.parse(m) for m in media]
    for a, b in _groups([6 * f.grid()[0] * f.grid()[1] for f in frames]):
        yield from zip(range(a, b), frames[a:b], jpeg.coefficients(frames[a:b]), strict=True)


def tensors(media: DataFrame) -> DataFrame:
    """(doc_id, media) of one layout -> DECODED: full-resolution RGB, row by row, three bytes a pixel."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, frame, arrays in _decoded(batch.column("media").to_pylist()):
                image = jpeg.rgb(frame, arrays)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i]], pa.int64()), pa.array([frame.height], pa.int32()), pa.array([frame.width], pa.int32()),
                     pa.array([image.tobytes()], pa.binary())], ["doc_id", "height", "width", "pixels"])

    return media.mapInArrow(decode, DECODED)


def digests(media: DataFrame) -> DataFrame:
    """(doc_id, media) as stored() makes it -> DIGEST, all read back from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(f.split() for f in DIGEST.split(", ")), strict=True)
        schema = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in zip(names, kinds, strict=True)])
        for batch in batches:
            files, ids, rows = batch.column("media").to_pylist(), batch.column("doc_id").to_pylist(), []
            for i, frame, arrays in _decoded(files):
                held, n = payload(frame, arrays)
                rows.append((ids[i], n, len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-BLOCK:]),
                             len(files[i]), hashlib.sha256(files[i]).hexdigest(), feature(jpeg.rgb(frame, arrays))))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return media.mapInArrow(digest, DIGEST)
