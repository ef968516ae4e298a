"""Page images and tables as DataFrames."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staveline.operators.images import plane_of


def page_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``page, content`` of the files below ``path``, read by Spark's binary source."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("page"), "content")


def page_file_stream(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The same as a stream: each file once, as it arrives."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("page"), "content")


def decode(content: bytes) -> np.ndarray:
    """BGR pixels of an 8-bit PNG (gray, RGB, palette, with or without alpha) or a binary PGM/PPM; alpha is dropped."""
    if content[:2] in (b"P5", b"P6"):
        return _decode_pnm(content)
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("neither PNG nor PGM/PPM")
    at, data, palette = 8, b"", None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        chunk = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += chunk
        at += 12 + size
    if depth != 8 or interlace:
        raise ValueError("only 8-bit PNGs that aren't interlaced")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int64)
    for y in range(height):
        above = out[y] = _unfilter(int(raw[y, 0]), raw[y, 1:].astype(np.int64), above.astype(np.int64), channels)
    pixels = out.reshape(height, width, channels)
    if color == 3:
        pixels = palette[pixels[..., 0]]
    elif channels <= 2:
        pixels = np.repeat(pixels[..., :1], 3, 2)
    return np.ascontiguousarray(pixels[..., 2::-1] if pixels.shape[2] >= 3 else pixels)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + above) & 255
    out = np.zeros(len(line) + step, np.int64)
    for k in range(len(line)):
        left = out[k]
        if kind == 1:
            guess = left
        elif kind == 3:
            guess = (left + above[k]) // 2
        else:
            corner = above[k - step] if k >= step else 0
            p = left + above[k] - corner
            options = ((abs(p - left), 0, left), (abs(p - above[k]), 1, above[k]), (abs(p - corner), 2, corner))
            guess = min(options)[2]
        out[k + step] = (line[k] + guess) & 255
    return out[step:]


def _decode_pnm(content: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        end = at
        while content[end : end + 1].isspace():
            end += 1
        if content[end : end + 1] == b"#":
            at = content.index(b"\n", end)
            continue
        at = end
        while not content[at : at + 1].isspace():
            at += 1
        fields.append(int(content[end:at]))
    width, height, _ = fields
    channels = 3 if content[:2] == b"P6" else 1
    pixels = np.frombuffer(content, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)
    return np.ascontiguousarray(np.repeat(pixels, 3, 2) if channels == 1 else pixels[..., ::-1])


def decoded(pages: DataFrame) -> DataFrame:
    """``page, plane, error``: BGR planes; a file that can't be decoded has a null plane and ``bad_input``."""
    kind = pa.struct([("kind", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    plane, error = plane_of(decode(content.as_py()), "color"), None
                except (KeyError, TypeError, ValueError, IndexError, struct.error, zlib.error, UnboundLocalError):
                    plane, error = None, "bad_input"
                yield pa.RecordBatch.from_arrays([pa.array([page.as_py()]), pa.array([plane], kind), pa.array([error], pa.string())], ["page", "plane", "error"])

    return pages.select("page", "content").mapInArrow(run, "page string, plane struct<kind:string,width:int,height:int,data:binary>, error string")
