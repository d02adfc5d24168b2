import struct
import zlib

import numpy as np
import pytest

from tesselace.sources import formats


def write(folder, name, text):
    (folder / name).write_text(text)
    return f"file://{folder / name}"


def test_text_formats(spark, tmp_path):
    f = formats.features(spark, write(tmp_path, "a.feat", "1.5 2 3 0.25\n4 5 6 7\n"))
    assert [tuple(r) for r in f.collect()] == [(1.5, 2.0, 3.0, 0.25), (4.0, 5.0, 6.0, 7.0)]
    m = formats.match_pairs(spark, write(tmp_path, "m.txt", "2 1\n1\nsift 2\n0 3\n4 5\n7 8\n1\nsift 0\n"))
    assert sorted(tuple(r) for r in m.collect()) == [(2, 1, "sift", 0, 3), (2, 1, "sift", 4, 5)]
    assert [tuple(r) for r in formats.matched_views(m).collect()] == [(1, 2)]
    p = formats.listed_pairs(spark, write(tmp_path, "p.txt", "1 2 3\n4\n"))
    assert sorted(tuple(r) for r in p.collect()) == [(1, 2), (1, 3)]
    c = formats.case_lines(spark, write(tmp_path, "c.txt", "# note\none | here | A=1 B=2 # x\ntwo | there |\n")).collect()
    assert [(r.name, r.install, r.options) for r in c] == [("one", "here", {"A": "1", "B": "2"}), ("two", "there", None)]


def test_json_and_logs(spark, tmp_path):
    scene = '{"views":[{"viewId":"1","poseId":"9","path":"a"},{"viewId":"2","poseId":"8","path":"b"}],"poses":[{"poseId":"9","pose":{"transform":{"rotation":["1"],"center":["1","2","3"]}}}]}'
    got = {r.view_id: r.center for r in formats.cameras(spark, write(tmp_path, "s.json", scene)).collect()}
    assert got == {1: [1.0, 2.0, 3.0], 2: None}
    r = formats.run_records(spark, write(tmp_path, "r.json", '{"tag":"x","wall_s":1.5}\nnot json\n'), "tag string, wall_s double").collect()
    assert sorted((x.tag or "") for x in r) == ["", "x"]
    v = formats.log_values(spark, write(tmp_path, "l.log", "n=1\nother\nn=2\n"), {"n": r"n=(\d+)", "none": r"z=(\d+)"}).first()
    assert (v.n, v.none) == ("2", None)


def test_mesh_round_trip(spark, tmp_path):
    path = write(tmp_path, "m.obj", "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\nf -1 -2 -3\n")
    vertices, triangles = formats.meshes(spark, path)
    assert sorted((r.a, r.b, r.c) for r in triangles.collect()) == [(0, 1, 2), (0, 2, 3), (3, 2, 1)]
    lines = [r.value for r in formats.mesh_lines(vertices, triangles).collect()]
    assert lines[0] == "v 0.00000000 0.00000000 0.00000000" or lines[0].startswith("v 0")
    assert lines[4:] == ["f 1 2 3", "f 1 3 4", "f 4 3 2"]


def exr(pixels: np.ndarray, compression: int, half: bool) -> bytes:
    """One channel Y; chunks as the format describes them."""
    height, width = pixels.shape
    attribute = lambda n, k, v: n.encode() + b"\0" + k.encode() + b"\0" + struct.pack("<i", len(v)) + v
    head = struct.pack("<II", 20000630, 2)
    head += attribute("channels", "chlist", b"Y\0" + struct.pack("<iIii", 1 if half else 2, 0, 1, 1) + b"\0")
    head += attribute("compression", "compression", bytes([compression])) + attribute("dataWindow", "box2i", struct.pack("<4i", 0, 0, width - 1, height - 1)) + b"\0"
    lines = 16 if compression == 3 else 1
    chunks = []
    for y in range(0, height, lines):
        raw = pixels[y : y + lines].astype("<f2" if half else "<f4").tobytes()
        packed = raw
        if compression:
            mixed = np.frombuffer(raw[0::2] + raw[1::2], np.uint8).astype(int)
            stepped = np.r_[mixed[:1], (np.diff(mixed) + 128) % 256].astype(np.uint8).tobytes()
            packed = zlib.compress(stepped) if compression > 1 else b"".join(struct.pack("b", -len(p)) + p for p in (stepped[i : i + 100] for i in range(0, len(stepped), 100)))
            packed = packed if len(packed) < len(raw) else raw
        chunks.append(struct.pack("<ii", y, len(packed)) + packed)
    at, table = len(head) + 8 * len(chunks), b""
    for c in chunks:
        table += struct.pack("<Q", at)
        at += len(c)
    return head + table + b"".join(chunks)


@pytest.mark.parametrize("compression", [0, 1, 2, 3])
@pytest.mark.parametrize("half", [True, False])
def test_images(spark, tmp_path, compression, half):
    pixels = np.repeat(np.arange(20, dtype=np.float32)[:, None], 33, 1) / 4
    (tmp_path / "a.exr").write_bytes(exr(pixels, compression, half))
    (tmp_path / "bad.exr").write_bytes(exr(pixels, compression, half)[:-20] if compression < 2 else b"no image")
    got = formats.exr_images(spark, f"file://{tmp_path}/*.exr").collect()
    good = {r.y: r.row for r in got if r.error is None and r.file.endswith("a.exr")}
    assert np.array_equal(np.array([good[y] for y in range(20)], np.float32), pixels)
    assert [r.error is not None for r in got if r.file.endswith("bad.exr")] == [True]
