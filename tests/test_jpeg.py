"""JPEG files: round trips, a file put together by hand, restart marks and broken input."""

import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselace.sources import jpeg


def picture(height, width, depth, seed=1):
    y, x = np.mgrid[:height, :width]
    planes = [128 + 80 * np.sin(x / (7 + c) + c) * np.cos(y / (9 + 2 * c)) + 20 * (x > width // 2) for c in range(depth)]
    return np.clip(np.rint(np.stack(planes, 2)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("shape", [(16, 16, 3), (37, 51, 3), (9, 70, 1), (8, 8, 1), (1, 1, 3)])
@pytest.mark.parametrize("interval", [0, 2])
def test_round_trip(shape, interval):
    pixels = picture(*shape)
    for halved in (True, False):
        made = jpeg.decoded(jpeg.encoded(pixels, 95, halved, interval))
        assert made.shape == pixels.shape
        error = np.abs(made.astype(int) - pixels)
        assert error.mean() < (6 if halved else 2.5)
    rough, fine = (np.abs(jpeg.decoded(jpeg.encoded(pixels, q, False)).astype(int) - pixels).mean() for q in (20, 99))
    assert fine <= rough and len(jpeg.encoded(pixels, 20)) <= len(jpeg.encoded(pixels, 99))


def test_blocks_by_hand():
    """One grey block whose codes are written out: first coefficient 2 * 8, and one of 3 * 4 across."""
    order = jpeg.ZIGZAG.tolist()
    assert order[:6] == [0, 1, 8, 16, 9, 2] and sorted(order) == list(range(64)) and order[-2:] == [62, 63]
    segment = lambda mark, data: bytes([0xFF, mark]) + struct.pack(">H", len(data) + 2) + data
    steps = bytes([8, 4, *[1] * 62])
    counts = lambda **k: bytes(k.get(f"n{i}", 0) for i in range(1, 17))
    tables = b"\x00" + counts(n2=2) + b"\x00\x02" + b"\x10" + counts(n2=2) + b"\x00\x02"
    bits = "01" + "10" + "01" + "11" + "00"  # size 2, value 2; run 0 size 2, value 3; end of block
    body = int(bits + "1" * (-len(bits) % 8), 2).to_bytes(2, "big")
    data = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, b"\x00" + steps) + segment(0xC0, struct.pack(">BHHB", 8, 8, 8, 1) + b"\x01\x11\x00") + segment(0xC4, tables) + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + body + b"\xff\xd9"
    want = 128 + 16 / 8 + 12 * 0.5 * 0.125**0.5 * np.cos((2 * np.arange(8) + 1) * np.pi / 16)
    assert np.array_equal(jpeg.decoded(data)[..., 0], np.tile(np.rint(want), (8, 1)).astype(np.uint8))
    for bad in (b"", data[:20], data[:-3], data.replace(b"\xff\xc0", b"\xff\xc2"), data[:2] + b"\xff\xd9\x00\x02"):
        with pytest.raises((ValueError, IndexError, struct.error)):
            jpeg.decoded(bad)


def test_codes_are_short_and_prefix_free():
    counts = Counter({k: 2**k for k in range(40)})
    lengths = jpeg.code_lengths(counts)
    assert max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) <= 1
    assert lengths[-1] == max(lengths.values())
    assert jpeg.code_lengths(Counter({5: 3}))[5] == 1


def test_as_rows(spark, tmp_path):
    pixels = picture(20, 30, 3)
    (tmp_path / "a.jpg").write_bytes(jpeg.encoded(pixels, 90))
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8nothing")
    rows = jpeg.jpeg_images(spark, f"file://{tmp_path}/*.jpg")
    good = {r.y: r.row for r in rows.where("error is null").collect()}
    assert np.array_equal(np.array([good[y] for y in range(20)]).reshape(20, 30, 3), jpeg.decoded(jpeg.encoded(pixels, 90)))
    assert rows.where(F.col("error").isNotNull()).count() == 1
    again = jpeg.jpeg_bytes(rows).collect()
    assert len(again) == 1 and jpeg.decoded(bytes(again[0].content)).shape == pixels.shape
