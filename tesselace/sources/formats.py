"""Readers and writers of text and image formats, as DataFrames."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HALF_FLOAT_SCHEMA = "file string, channel string, y int, row array<float>, error string"


def features(spark: SparkSession, path: str) -> DataFrame:
    """Lines of four numbers (x, y, scale, orientation); lines that are no numbers are null."""
    return spark.read.csv(path, sep=" ", schema="x float, y float, scale float, orient float")


def match_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(view_i, view_j, kind, i, j) of match files: blocks 'I J', a number of kinds, and 'kind n' with n lines 'i j'.

    A file is one record (its blocks can only be told apart from the start); files are read in parallel."""

    def parse(text: str) -> list[tuple]:
        lines = iter(text.split("\n"))
        out = []
        for line in lines:
            if not line.strip():
                continue
            a, b = map(int, line.split())
            for _ in range(int(next(lines))):
                kind, n = next(lines).split()
                out += [(a, b, kind, *map(int, next(lines).split())) for _ in range(int(n))]
        return out

    def rows(it):
        for frame in it:
            yield pd.DataFrame([r for t in frame["value"] for r in parse(t)], columns=["view_i", "view_j", "kind", "i", "j"])

    return spark.read.text(path, wholetext=True).mapInPandas(rows, "view_i long, view_j long, kind string, i long, j long")


def matched_views(matches: DataFrame) -> DataFrame:
    """Unordered view pairs with at least one match."""
    return matches.select(F.least("view_i", "view_j").alias("a"), F.greatest("view_i", "view_j").alias("b")).distinct()


def listed_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'view partner partner ...': (a, b) for each partner."""
    words = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(words[0].cast("long").alias("a"), F.explode(F.slice(words, F.lit(2), F.size(words))).alias("b")).withColumn("b", F.col("b").cast("long"))


def case_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, install, options) of lines 'name | install | K=V K=V'; '#' begins a comment."""
    parts = F.split(F.regexp_replace("value", r"\s*#.*$", ""), r"\s*\|\s*")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.length(F.trim(F.col("p")[0])) > 0)
    options = F.get("p", F.lit(2))
    return rows.select(F.trim(F.col("p")[0]).alias("name"), F.get("p", F.lit(1)).alias("install"), F.when(F.length(F.trim(options)) > 0, F.expr("str_to_map(trim(p[2]), '\\\\s+', '=')")).alias("options"))


def cameras(spark: SparkSession, path: str) -> DataFrame:
    """(view_id, path, center, rotation) of a scene file; views without a pose have nulls."""
    pose = "struct<transform:struct<rotation:array<string>,center:array<string>>>"
    scene = spark.read.schema(f"views array<struct<viewId:string,poseId:string,path:string>>, poses array<struct<poseId:string,pose:{pose}>>").json(path, multiLine=True)
    views = scene.select(F.explode("views").alias("v")).select(F.col("v.viewId").cast("long").alias("view_id"), F.col("v.poseId").alias("pose"), F.col("v.path").alias("path"))
    poses = scene.select(F.explode("poses").alias("p")).select(F.col("p.poseId").alias("pose"), *(F.transform(f"p.pose.transform.{c}", lambda x: x.cast("double")).alias(c) for c in ("center", "rotation")))
    return views.join(poses, "pose", "left").drop("pose")


def run_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that is no JSON has nulls and its text in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE")


def log_values(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """One row a file: the last capture of each pattern, null where there is none."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return lines.groupBy("file").agg(*(F.max_by(F.when(F.col("value").rlike(p), F.regexp_extract("value", p, 1)), F.when(F.col("value").rlike(p), F.struct("block", "at"))).alias(k) for k, p in patterns.items()))


def meshes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of OBJ files; polygons are fanned, indices are from 0 and negative ones count from the end
    of the vertices read so far. A file is one record."""

    def parse(it):
        for frame in it:
            out = []
            for file, text in zip(frame["file"], frame["value"], strict=True):
                n = k = 0
                for line in text.split("\n"):
                    word = line.split()
                    if word[:1] == ["v"]:
                        out.append((file, "v", n, *map(float, word[1:4]), None, None, None))
                        n += 1
                    elif word[:1] == ["f"]:
                        at = [int(w.split("/")[0]) for w in word[1:]]
                        at = [i - 1 if i > 0 else n + i for i in at]
                        for a, b in zip(at[1:], at[2:], strict=False):
                            out.append((file, "f", k, None, None, None, at[0], a, b))
                            k += 1
            yield pd.DataFrame(out, columns=["file", "kind", "id", "x", "y", "z", "a", "b", "c"]).astype({c: "Int64" for c in "abc"})

    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").mapInPandas(parse, "file string, kind string, id long, x double, y double, z double, a long, b long, c long")
    return rows.where("kind = 'v'").select("file", "id", "x", "y", "z"), rows.where("kind = 'f'").select("file", "id", "a", "b", "c")


def mesh_lines(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """OBJ lines in the mesh's order, nine significant digits; write them with one sorted partition."""
    v = vertices.select(F.lit(0).alias("part"), "id", F.format_string("v %.9g %.9g %.9g", "x", "y", "z").alias("value"))
    f = triangles.select(F.lit(1).alias("part"), "id", F.format_string("f %d %d %d", F.col("a") + 1, F.col("b") + 1, F.col("c") + 1).alias("value"))
    return v.unionByName(f).orderBy("part", "id").select("value")


def exr_header(data: bytes) -> dict:
    """Channels (sorted by name), size, compression and the place of the chunk table of a scan-line OpenEXR file."""
    magic, version = struct.unpack_from("<II", data)
    if magic != 20000630 or version & 0xFF != 2 or version & 0x1A00:
        raise ValueError("not a single-part scan-line file")
    at, out = 8, {}
    while data[at]:
        name_end = data.index(b"\0", at)
        kind_end = data.index(b"\0", name_end + 1)
        name, kind = data[at:name_end].decode(), data[name_end + 1 : kind_end].decode()
        (size,) = struct.unpack_from("<i", data, kind_end + 1)
        value, at = data[kind_end + 5 : kind_end + 5 + size], kind_end + 5 + size
        if kind == "chlist":
            channels, p = [], 0
            while value[p]:
                end = value.index(b"\0", p)
                pixel, _, sx, sy = struct.unpack_from("<iIii", value, end + 1)
                if pixel not in (1, 2) or sx != 1 or sy != 1:
                    raise ValueError("unsupported channel")
                channels.append((value[p:end].decode(), pixel))
                p = end + 17
            out["channels"] = channels
        elif name == "compression":
            out["compression"] = value[0]
        elif name == "dataWindow":
            out["window"] = struct.unpack("<4i", value)
        elif kind == "string":
            out.setdefault("strings", {})[name] = value.decode(errors="replace")
    if out["compression"] > 3:
        raise ValueError("unsupported compression")
    x0, y0, x1, y1 = out["window"]
    return out | {"table": at + 1, "width": x1 - x0 + 1, "height": y1 - y0 + 1, "lines": 16 if out["compression"] == 3 else 1}


def exr_unpacked(packed: bytes, size: int, compression: int) -> bytes:
    """One chunk's bytes: stored, run lengths or zlib, then the predictor and the interleave undone."""
    if compression == 0 or len(packed) == size:
        if len(packed) != size:
            raise ValueError("bad chunk")
        return packed
    if compression == 1:
        out, at = bytearray(), 0
        while at < len(packed):
            n = struct.unpack_from("b", packed, at)[0]
            if n < 0:
                out += packed[at + 1 : at + 1 - n]
                at += 1 - n
            else:
                out += packed[at + 1 : at + 2] * (n + 1)
                at += 2
    else:
        out = zlib.decompress(packed)
    if len(out) != size:
        raise ValueError("bad chunk")
    step = np.frombuffer(bytes(out), np.uint8).astype(np.int64)
    step[1:] -= 128
    flat = np.cumsum(step).astype(np.uint8)
    both = np.empty(size, np.uint8)
    half = (size + 1) // 2
    both[0::2], both[1::2] = flat[:half], flat[half:]
    return both.tobytes()


def exr_rows(data: bytes) -> list[tuple[str, int, np.ndarray]]:
    """(channel, y, values) of a whole file; any bad chunk rejects the file."""
    head = exr_header(data)
    width, height = head["width"], head["height"]
    chunks = -(-height // head["lines"])
    out = []
    per_line = width * sum(2 if k == 1 else 4 for _, k in head["channels"])
    for at in struct.unpack_from(f"<{chunks}Q", data, head["table"]):
        y, n = struct.unpack_from("<ii", data, at)
        y -= head["window"][1]
        lines = min(head["lines"], height - y)
        if at + 8 + n > len(data):
            raise ValueError("file ends early")
        raw = exr_unpacked(data[at + 8 : at + 8 + n], lines * per_line, head["compression"])
        p = 0
        for line in range(lines):
            for name, kind in head["channels"]:
                size = width * (2 if kind == 1 else 4)
                out.append((name, y + line, np.frombuffer(raw[p : p + size], "<f2" if kind == 1 else "<f4").astype(np.float32)))
                p += size
    return out


def exr_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, channel, y, row, error): a row of pixels a record; a file that cannot be read has one record with the error."""

    def rows(it):
        for frame in it:
            out = []
            for file, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    out += [(file, c, y, v.tolist(), None) for c, y, v in exr_rows(bytes(data))]
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    out.append((file, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["file", "channel", "y", "row", "error"]).astype({"y": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, HALF_FLOAT_SCHEMA)


HEAD_BYTES = 65_536


def exr_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, width, height, compression, lines, chunks, channels, strings, error): what the first 64 KB of each
    file say; the pixels are not decoded, and no more than the head leaves the JVM."""

    def rows(it):
        for frame in it:
            out = []
            for file, length, data in zip(frame["path"], frame["length"], frame["head"], strict=True):
                try:
                    h = exr_header(bytes(data))
                    out.append((file, length, h["width"], h["height"], h["compression"], h["lines"], -(-h["height"] // h["lines"]), [c for c, _ in h["channels"]], h.get("strings", {}), None))
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    out.append((file, length, *[None] * 7, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["file", "length", "width", "height", "compression", "lines", "chunks", "channels", "strings", "error"]).astype({c: "Int32" for c in ("width", "height", "compression", "lines", "chunks")})

    files = spark.read.format("binaryFile").load(path).select("path", "length", F.substring("content", 1, HEAD_BYTES).alias("head"))
    return files.mapInPandas(rows, "file string, length long, width int, height int, compression int, lines int, chunks int, channels array<string>, strings map<string,string>, error string")


def exr_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, chunk, y, lines, offset, packed, unpacked): the plan of each file's chunks of scan lines, by its table of
    offsets. Files that cannot be planned have none."""

    def rows(it):
        for frame in it:
            out = []
            for file, content in zip(frame["path"], frame["content"], strict=True):
                data = bytes(content)
                try:
                    h = exr_header(data)
                    count, per_line = -(-h["height"] // h["lines"]), h["width"] * sum(2 if k == 1 else 4 for _, k in h["channels"])
                    found = []
                    for k, at in enumerate(struct.unpack_from(f"<{count}Q", data, h["table"])):
                        y, packed = struct.unpack_from("<ii", data, at)
                        y -= h["window"][1]
                        lines = min(h["lines"], h["height"] - y)
                        found.append((file, k, y, lines, at + 8, packed, lines * per_line))
                    out += found
                except (ValueError, KeyError, IndexError, struct.error):
                    continue
            yield pd.DataFrame(out, columns=["file", "chunk", "y", "lines", "offset", "packed", "unpacked"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, chunk int, y int, lines int, offset long, packed int, unpacked int")


def exr_worthwhile(spark: SparkSession, path: str, least_chunks: int) -> tuple[DataFrame, list[str]]:
    """(images, rest): the files with at least so many chunks, judged by their heads before they are read whole, and the
    names of all others, which are handed back."""
    heads = exr_headers(spark, path).select("file", (F.col("error").isNull() & (F.col("chunks") >= least_chunks)).alias("good")).collect()
    good, rest = [r.file for r in heads if r.good], [r.file for r in heads if not r.good]
    images = exr_images(spark, good) if good else spark.createDataFrame([], HALF_FLOAT_SCHEMA)
    return images, sorted(rest)


def paired_files(spark: SparkSession, first: str, second: str, pattern: str) -> DataFrame:
    """(name, first, second, found): files of two folders by name, where a pattern's first group is the name; found says
    both, first, second, or differ for both with different content."""

    def side(folder: str, c: str) -> DataFrame:
        files = spark.read.format("binaryFile").load(folder).select(F.col("path").alias(c), F.md5("content").alias(f"__{c}"))
        name = F.regexp_extract(F.element_at(F.split(c, "/"), -1), pattern, 1)
        return files.withColumn("name", name).where("name <> ''")

    both = side(first, "first").join(side(second, "second"), "name", "full_outer")
    found = F.when(F.col("second").isNull(), "first").when(F.col("first").isNull(), "second").when(F.col("__first") == F.col("__second"), "both").otherwise("differ")
    return both.select("name", "first", "second", found.alias("found"))


def view_range(rows: DataFrame, view: str, start: int, size: int) -> DataFrame:
    """Rows of the views whose place among the different views, in order, is in start .. start + size - 1."""
    from tesselace.operators.order import numbered

    some = numbered(rows.select(view).distinct(), [view], "__at").where(F.col("__at").between(start, start + size - 1)).select(view)
    return rows.join(some, view, "left_semi")


def gps_position(latitude: Column, north: Column, longitude: Column, east: Column, altitude: Column, below: Column) -> list[Column]:
    """Latitude, longitude and altitude of metadata 'd, m, s' with hemispheres and 'a' with its reference (1: below the
    sea; missing: above); a text that is none gives null."""

    def degrees(text: Column, half: Column, negative: str) -> Column:
        part = lambda k: F.get(F.split(text, ","), F.lit(k)).try_cast("double")
        return F.when(F.upper(F.trim(half)) == negative, -1.0).otherwise(1.0) * (part(0) + part(1) / 60 + part(2) / 3600)

    down = F.when(F.coalesce(below.try_cast("int"), F.lit(0)) == 1, -1.0).otherwise(1.0)
    return [degrees(latitude, north, "S"), degrees(longitude, east, "W"), down * altitude.try_cast("double")]


def looked_up(values: Column, table: Column) -> Column:
    """Eight-bit values through a table of 256 entries."""
    return F.transform(values, lambda x: F.get(table, x))
