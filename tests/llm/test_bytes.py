"""Media: an exact round trip, and decoding against a plain inverse transform."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skylot.llm import jpeg, media
from tests.llm.docs import empty, frame, odd, table


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=900), min_size=1, max_size=5))
def test_payloads_round_trip(raw):
    files = media.encode([media.padded(r) for r in raw], [len(r) for r in raw])
    frames = [jpeg.parse(f) for f in files]
    for r, f, own, arrays in zip(raw, files, frames, jpeg.coefficients(frames), strict=True):
        assert media.payload(own, arrays) == (media.padded(r), len(r))
        assert f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9"
        assert media.encode([media.padded(r)], [len(r)]) == [f]  # alone or in a batch


def test_rgb_against_a_plain_inverse_transform():
    raw = bytes(range(256)) * 3
    frame_ = jpeg.parse(media.encode([media.padded(raw)], [len(raw)])[0])
    (arrays,) = jpeg.coefficients([frame_])
    image = jpeg.rgb(frame_, arrays)
    assert image.dtype == np.uint8 and image.shape == (frame_.height, frame_.width, 3)
    zigzag = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    basis = np.array([[(np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])

    def plane(blocks):
        rows, columns = blocks.shape[:2]
        out = np.zeros((8 * rows, 8 * columns))
        for r in range(rows):
            for c in range(columns):
                square = np.zeros((8, 8))
                for k, (y, x) in enumerate(zigzag):
                    square[y, x] = blocks[r, c, k]
                out[8 * r:8 * r + 8, 8 * c:8 * c + 8] = basis.T @ square @ basis + 128
        return np.clip(np.round(out), 0, 255)

    luma, blue, red = (plane(a.reshape(-1, a.shape[-2] if a.ndim > 2 else 1, 64)) if a.ndim > 2 else None for a in arrays)
    if luma is None:
        pytest.skip("planes are kept flat")
    blue, red = (np.repeat(np.repeat(p, 2, 0), 2, 1) - 128 for p in (blue, red))
    expected = np.stack([luma + 1.402 * red, luma - 0.344136 * blue - 0.714136 * red, luma + 1.772 * blue], 2)
    assert np.abs(np.clip(expected, 0, 255) - image).max() <= 3  # roundings of samples and chroma


def test_digests_of_whole_texts(spark):
    texts = [r["text"] for r in table("documents")] + [None, "", "x" * 64, "x" * 63, "ÿ😀" * 9000]
    rows = media.digests(media.stored(frame(spark, texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"] - 1] or "").encode()
        held = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (
            len(raw), len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-64:]))
        assert r["media_bytes"] > 0 and len(r["media_sha256"]) == 64


def test_tensors_and_odd_rows(spark):
    stored = media.stored(odd(spark, "abc"))
    rows = media.tensors(stored).collect()
    assert len(rows) == 6 and all(len(r["pixels"]) == 3 * r["height"] * r["width"] for r in rows)
    found = media.digests(stored).collect()
    assert len({(r["media_sha256"], r["feature"]) for r in found if r["n_bytes"] == 3 and r["doc_id"] in (1, None)}) == 1
    assert media.digests(media.stored(empty(spark))).count() == 0
