"""Baseline JPEG (ITU T.81, eight bits, Huffman): reading as rows of pixels, and writing with tables made for the image."""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row-major place of each coefficient in order of frequency: diagonals, up and down in turn.
ZIGZAG = np.array([i * 8 + j for i, j in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
COSINES = np.array([[(0.5 if k else 0.125**0.5) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


class Unsupported(ValueError):
    """A kind of file that is left to other readers."""


def code_table(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For every 16 bits, the length and the symbol of the code that they begin with; length 0 where there is none."""
    length, symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code = k = 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            first = code << 16 - n
            length[first : first + (1 << 16 - n)], symbol[first : first + (1 << 16 - n)] = n, symbols[k]
            code += 1
            k += 1
        code <<= 1
    return length, symbol


def parsed(data: bytes) -> dict:
    """Size, components, tables and the entropy-coded segments (between restart marks, without stuffed bytes)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    out: dict = {"tables": {}, "quantisers": {}, "interval": 0}
    at = 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("file ends early")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            p = 0
            while p < len(body):
                wide, name = body[p] >> 4, body[p] & 15
                table = np.frombuffer(body, ">u2" if wide else "u1", 64, p + 1).astype(np.int64)
                out["quantisers"][name] = table
                p += 129 if wide else 65
        elif mark == 0xC4:
            p = 0
            while p < len(body):
                n = sum(body[p + 1 : p + 17])
                out["tables"][body[p]] = code_table(body[p + 1 : p + 17], body[p + 17 : p + 17 + n])
                p += 17 + n
        elif mark in FRAMES:
            if mark > 0xC1 or body[0] != 8:
                raise Unsupported("not baseline")
            out["height"], out["width"] = struct.unpack_from(">HH", body, 1)
            out["components"] = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            if len(out["components"]) not in (1, 3) or not out["width"] or not out["height"]:
                raise Unsupported("components")
        elif mark == 0xDD:
            (out["interval"],) = struct.unpack(">H", body)
        elif mark == 0xDA:
            if "components" not in out or body[0] != len(out["components"]):
                raise Unsupported("several scans")
            out["scan"] = [(body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            break
        elif mark == 0xD9:
            raise ValueError("no scan")
    segments, start, p = [], at, at
    while True:
        p = data.find(b"\xff", p)
        if p < 0 or p + 1 >= len(data):
            raise ValueError("file ends early")
        if data[p + 1] == 0:
            p += 2
        elif 0xD0 <= data[p + 1] <= 0xD7:
            segments.append(data[start:p].replace(b"\xff\x00", b"\xff"))
            p = start = p + 2
        elif data[p + 1] == 0xFF:
            p += 1
        else:
            segments.append(data[start:p].replace(b"\xff\x00", b"\xff"))
            return out | {"segments": segments}


def coefficients(segment: bytes, tables: list[tuple], units: int) -> np.ndarray:
    """Quantised coefficients (blocks, 64) in order of frequency of one segment: `units` groups of blocks, whose tables
    are listed as (component, (length, symbol) of the first coefficient, (length, symbol) of all others)."""
    out = np.zeros((units * len(tables), 64), np.int32)
    before = [0] * (1 + max(c for c, _, _ in tables))
    block = 0
    words = segment + b"\xff" * 16
    at, end = 0, 8 * len(segment)

    def peek(at: int) -> int:
        k = at >> 3
        return (words[k] << 16 | words[k + 1] << 8 | words[k + 2]) >> 8 - (at & 7) & 0xFFFF

    def value(at: int, size: int) -> int:
        v = peek(at) >> 16 - size
        return v if v >> size - 1 else v - (1 << size) + 1

    for _ in range(units):
        for c, first, rest in tables:
            code = peek(at)
            n = int(first[0][code])
            if not n or at >= end:
                raise ValueError("bad code")
            size = int(first[1][code])
            at += n
            if size:
                before[c] += value(at, size)
                at += size
            out[block, 0] = before[c]
            k = 1
            while k < 64:
                code = peek(at)
                n, s = int(rest[0][code]), int(rest[1][code])
                if not n or at > end:
                    raise ValueError("bad code")
                at += n
                run, size = s >> 4, s & 15
                if not size:
                    if run != 15:
                        break
                    k += 16
                    continue
                k += run
                if k > 63:
                    raise ValueError("too many coefficients")
                out[block, k] = value(at, size)
                at += size
                k += 1
            block += 1
    if at > end:
        raise ValueError("segment ends early")
    return out


def decoded(data: bytes) -> np.ndarray:
    """Pixels (height, width, 1 or 3) of a baseline file; any bad segment rejects the file."""
    head = parsed(data)
    parts = head["components"]
    high, wide = max(v for _, _, v, _ in parts), max(h for _, h, _, _ in parts)
    if len(parts) == 1:  # blocks of a single component follow one another
        parts, high, wide = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-head["width"] // (8 * wide)), -(-head["height"] // (8 * high))
    tables = []
    for c, ((_, h, v, _), (dc, ac)) in enumerate(zip(parts, head["scan"], strict=True)):
        try:
            tables += [(c, head["tables"][dc], head["tables"][16 + ac])] * (h * v)
        except KeyError:
            raise ValueError("missing table") from None
    units, per = across * down, head["interval"] or across * down
    if len(head["segments"]) < -(-units // per):
        raise ValueError("missing segments")
    found = np.concatenate([coefficients(s, tables, min(per, units - k * per)) for k, s in enumerate(head["segments"][: -(-units // per)])])
    found = found.reshape(units, len(tables), 64)
    planes, first = [], 0
    for _, h, v, q in parts:
        blocks = np.zeros((units, h * v, 64))
        blocks[:, :, ZIGZAG] = found[:, first : first + h * v] * head["quantisers"][q]
        first += h * v
        pixels = COSINES.T @ blocks.reshape(units, h * v, 8, 8) @ COSINES
        plane = pixels.reshape(down, across, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * v * 8, across * h * 8)
        plane = plane.repeat(high // v, 0).repeat(wide // h, 1)
        planes.append(plane[: head["height"], : head["width"]] + 128)
    return np.clip(np.rint(to_rgb(np.stack(planes, 2)) if len(planes) == 3 else np.stack(planes, 2)), 0, 255).astype(np.uint8)


def to_rgb(p: np.ndarray) -> np.ndarray:
    y, b, r = p[..., 0], p[..., 1] - 128, p[..., 2] - 128
    return np.stack([y + 1.402 * r, y - (0.114 * 1.772 * b + 0.299 * 1.402 * r) / 0.587, y + 1.772 * b], -1)


def to_ycc(p: np.ndarray) -> np.ndarray:
    y = 0.299 * p[..., 0] + 0.587 * p[..., 1] + 0.114 * p[..., 2]
    return np.stack([y, 128 + (p[..., 2] - y) / 1.772, 128 + (p[..., 0] - y) / 1.402], -1)


def quantiser(quality: int) -> np.ndarray:
    """Steps in order of frequency that grow along the diagonals; quality 1 to 100."""
    i, j = np.divmod(ZIGZAG, 8)
    return np.clip(np.rint((10 + 6.0 * (i + j)) * (100 - quality) / 50), 1, 255).astype(np.int64)


def code_lengths(counts: Counter) -> dict[int, int]:
    """Lengths of at most 16 bits of a prefix code, by merging packages; no code of all ones is used."""
    weights = [(n, (s,)) for s, n in sorted(counts.items())] + [(0, (-1,))]
    merged: list = []
    for _ in range(16):
        both = list(heapq.merge(sorted(weights), merged, key=lambda x: x[0]))
        merged = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(both[::2], both[1::2], strict=False)]
    lengths: Counter = Counter()
    for _, symbols in merged[: len(weights) - 1]:
        lengths.update(symbols)
    longest = max(lengths.values())
    # the symbol that is never written takes a longest code, which canonical order makes the last one
    other = next((s for s, n in lengths.items() if n == longest and s != -1), -1)
    if lengths[-1] < longest and other != -1:
        lengths[-1], lengths[other] = lengths[other], lengths[-1]
    return dict(lengths)


def encoded(pixels: np.ndarray, quality: int = 75, halved: bool = True, interval: int = 0) -> bytes:
    """A baseline file of pixels (height, width, 1 or 3); colour planes at half size if `halved`; a restart mark every
    `interval` units if that is not 0."""
    height, width, depth = pixels.shape
    planes = to_ycc(pixels.astype(float)) if depth == 3 else pixels.astype(float)
    factor = 2 if halved and depth == 3 else 1
    side = 8 * factor
    across, down = -(-width // side), -(-height // side)
    planes = np.pad(planes, ((0, down * side - height), (0, across * side - width), (0, 0)), mode="edge") - 128
    steps, blocks = quantiser(quality), []
    for c in range(depth):
        f = factor if c == 0 else 1
        plane = planes[..., c] if c == 0 or factor == 1 else planes[..., c].reshape(down * 8, 2, across * 8, 2).mean((1, 3))
        cut = plane.reshape(down, f, 8, across, f, 8).transpose(0, 3, 1, 4, 2, 5).reshape(down * across, f * f, 8, 8)
        blocks.append(np.rint((COSINES @ cut @ COSINES.T).reshape(down * across, f * f, 64)[..., ZIGZAG] / steps).astype(int))
    order = [(0 if c == 0 else 1, c, k) for c in range(depth) for k in range(blocks[c].shape[1])]
    writes: list[list[tuple[int, int, int, int]]] = []  # (table, symbol, value, size) by segment
    before = [0] * depth
    for unit in range(down * across):
        if not writes or interval and unit % interval == 0:
            writes.append([])
            before = [0] * depth
        for kind, c, k in order:
            block = blocks[c][unit, k].tolist()
            step, before[c] = block[0] - before[c], block[0]
            size = abs(step).bit_length()
            writes[-1].append((kind, size, step if step >= 0 else step + (1 << size) - 1, size))
            run = 0
            last = max((i for i in range(1, 64) if block[i]), default=0)
            for v in block[1 : last + 1]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    writes[-1].append((kind + 2, 0xF0, 0, 0))
                    run -= 16
                size = abs(v).bit_length()
                writes[-1].append((kind + 2, run << 4 | size, v if v >= 0 else v + (1 << size) - 1, size))
                run = 0
            if last < 63:
                writes[-1].append((kind + 2, 0, 0, 0))
    codes: list[dict] = []
    tables = b""
    for t in (0, 2) if depth == 1 else (0, 1, 2, 3):
        lengths = code_lengths(Counter(s for w in writes for kind, s, _, _ in w if kind == t))
        listed = sorted((n, s if s >= 0 else 1 << 16) for s, n in lengths.items())
        code, previous, made = 0, 0, {}
        for n, s in listed:
            code <<= n - previous
            previous = n
            made[s] = (code, n)
            code += 1
        real = [(n, s) for n, s in listed if s < 1 << 16]
        per = bytes(sum(1 for n, _ in real if n == k) for k in range(1, 17))
        tables += bytes([(t // 2) << 4 | t % 2]) + per + bytes(s for _, s in real)
        codes.append(made)
    at = {t: k for k, t in enumerate((0, 2) if depth == 1 else (0, 1, 2, 3))}
    body = b""
    for k, w in enumerate(writes):
        bits = "".join(f"{codes[at[t]][s][0]:0{codes[at[t]][s][1]}b}" + (f"{v:0{n}b}" if n else "") for t, s, v, n in w)
        bits += "1" * (-len(bits) % 8)
        body += (b"" if not k else bytes([0xFF, 0xD0 + (k - 1) % 8])) + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    segment = lambda mark, data: bytes([0xFF, mark]) + struct.pack(">H", len(data) + 2) + data
    frame = struct.pack(">BHHB", 8, height, width, depth) + b"".join(bytes([c + 1, (factor if c == 0 else 1) * 17, 0]) for c in range(depth))
    scan = bytes([depth]) + b"".join(bytes([c + 1, 17 * (c > 0)]) for c in range(depth)) + b"\x00\x3f\x00"
    marks = segment(0xDD, struct.pack(">H", interval)) if interval else b""
    return b"\xff\xd8" + segment(0xDB, b"\x00" + bytes(steps.tolist())) + segment(0xC0, frame) + segment(0xC4, tables) + marks + segment(0xDA, scan) + body + b"\xff\xd9"


def jpeg_images(spark: SparkSession, path: str) -> DataFrame:
    """(file, y, channels, row, error): a row of pixels a record, channels side by side; a file that cannot be read, or
    is of a kind that is not supported, has one record with the error."""

    def rows(it):
        for frame in it:
            out = []
            for file, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    pixels = decoded(bytes(content))
                    out += [(file, y, pixels.shape[2], line.ravel().tolist(), None) for y, line in enumerate(pixels)]
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    out.append((file, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["file", "y", "channels", "row", "error"]).astype({"y": "Int32", "channels": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, y int, channels int, row array<int>, error string")


def jpeg_bytes(images: DataFrame, quality: int = 75) -> DataFrame:
    """(file, content) of images given as jpeg_images gives them. An image is one group."""

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("y")
        pixels = np.array(frame["row"].tolist(), np.uint8).reshape(len(frame), -1, int(frame["channels"].iloc[0]))
        return pd.DataFrame({"file": [key[0]], "content": [encoded(pixels, quality)]})

    return images.where(F.col("row").isNotNull()).groupBy("file").applyInPandas(one, "file string, content binary")
