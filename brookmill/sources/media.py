"""Media files: headers of images read from their bytes, and a boundary for probes that need tools of their own."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

HEADER = "path string, width int, height int, channels int, mode string, error string"
VIDEO = "path string, width int, height int, source_fps double, nb_frames int, duration double, error string"
#: PNG colour types and their channels and modes. Fixed values.
_PNG = {0: (1, "L"), 2: (3, "RGB"), 3: (1, "P"), 4: (2, "LA"), 6: (4, "RGBA")}
#: JPEG channels and their modes. Fixed values.
_JPEG = {1: "L", 3: "RGB", 4: "CMYK"}


def image_header(data: bytes) -> tuple[int, int, int, str]:
    """(width, height, channels, mode) of a PNG, JPEG, GIF or BMP; anything else raises."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 26:
        w, h, _, kind = struct.unpack(">IIBB", data[16:26])
        return w, h, *_PNG[kind]
    if data[:6] in (b"GIF87a", b"GIF89a"):
        w, h = struct.unpack("<HH", data[6:10])
        return w, h, 1, "P"
    if data[:2] == b"BM" and len(data) >= 30:
        w, h, _, bits = struct.unpack("<iiHH", data[18:30])
        return w, abs(h), max(1, bits // 8), "RGBA" if bits == 32 else "RGB" if bits == 24 else "P"
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w, n = struct.unpack(">HHB", data[at + 5 : at + 10])
                return w, h, n, _JPEG[n]
            at += 1 if kind == 0xFF else 2 if 0xD0 <= kind <= 0xD9 else 2 + size  # a fill byte, a bare marker, a segment
    raise ValueError("no image header")


def read_image_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The header of every image file, or why it has none; files without a byte are not read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((path, *image_header(bytes(data)), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HEADER.split(", ")]).astype({c: "Int64" for c in ("width", "height", "channels")})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(read, HEADER)


def probe_paths(paths: DataFrame, probe: Callable[[str], tuple], column: str = "path", schema: str = VIDEO) -> DataFrame:
    """``probe``'s answer for each path, in ``schema``, whose first field is the path and last the error if it failed."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf[column]:
                try:
                    rows.append((path, *probe(path), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=names).convert_dtypes()

    return paths.select(column).where(f"{column} is not null").distinct().mapInPandas(run, schema)
