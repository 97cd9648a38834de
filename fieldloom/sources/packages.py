"""Calibration packages (a ZIP of metadata and raw little-endian arrays) and tiled BigTIFF files."""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest unpacked package that is read.
MOST_BYTES = 1024 << 20


def write_package(path: str, metadata: dict, arrays: dict[str, np.ndarray]) -> None:
    """One package; arrays are stored little-endian under their names with their type and shape in the metadata."""
    described = metadata | {"arrays": {k: {"dtype": a.dtype.newbyteorder("<").str, "shape": list(a.shape)} for k, a in arrays.items()}}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("metadata.json", json.dumps(described))
        for name, a in arrays.items():
            z.writestr(f"{name}.bin", np.ascontiguousarray(a, a.dtype.newbyteorder("<")).tobytes())


def read_package(content: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    """Metadata and arrays; a package that is too large, incomplete or of wrong sizes is an error."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
            raise ValueError("the package is too large")
        metadata = json.loads(z.read("metadata.json"))
        arrays = {}
        for name, kind in metadata.get("arrays", {}).items():
            raw, dtype = z.read(f"{name}.bin"), np.dtype(kind["dtype"])
            if len(raw) != dtype.itemsize * int(np.prod(kind["shape"])):
                raise ValueError(f"{name} has a wrong size")
            arrays[name] = np.frombuffer(raw, dtype).reshape(kind["shape"])
    return metadata, arrays


def coefficients(spark: SparkSession, path: str, array: str = "coefficients") -> DataFrame:
    """The spline coefficients (``file, cx, cy, dx, dy``) of all packages under ``path``; broken ones have a ``fault``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    a = read_package(content)[1][array]
                    cy, cx = np.divmod(np.arange(a.shape[0] * a.shape[1]), a.shape[1])
                    flat = a.reshape(-1, 2)
                    yield pd.DataFrame({"file": name, "cx": cx, "cy": cy, "dx": flat[:, 0], "dy": flat[:, 1], "fault": None})
                except (ValueError, KeyError, zipfile.BadZipFile, json.JSONDecodeError, IndexError) as e:
                    yield pd.DataFrame({"file": [name], "cx": [None], "cy": [None], "dx": [None], "dy": [None], "fault": [f"{type(e).__name__}: {e}"]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, cx long, cy long, dx double, dy double, fault string")


def tile_layout(tiles: DataFrame, columns: int, rows: int) -> DataFrame:
    """Place and byte offset of every tile of a file; tiles off the grid or given twice have a ``fault``."""
    from pyspark.sql import Window

    index = F.col("cell_row") * columns + F.col("cell_col")
    off = (F.col("cell_row") < 0) | (F.col("cell_col") < 0) | (F.col("cell_row") >= rows) | (F.col("cell_col") >= columns)
    placed = tiles.withColumn("index", index).withColumn("twice", F.row_number().over(Window.partitionBy("index").orderBy("bytes")) > 1)
    good = placed.withColumn("fault", F.when(off, "off the grid").when(F.col("twice"), "twice")).drop("twice")
    before = Window.orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(F.col("fault").isNull(), F.col("bytes")).otherwise(0)
    return good.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)))


def write_bigtiff(path: str, width: int, height: int, tile: int, tiles: Iterator[tuple[int, int, np.ndarray]]) -> None:
    """A tiled RGBA BigTIFF, each tile deflated; tiles that are not given are transparent.

    ``tiles`` gives (tile row, tile column, pixels) in any order; one off the grid or given twice is an error.
    """
    across, down = -(-width // tile), -(-height // tile)
    offsets, counts = [0] * (across * down), [0] * (across * down)
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))

        def put(index: int, pixels: np.ndarray) -> None:
            data = zlib.compress(np.ascontiguousarray(pixels, np.uint8).tobytes(), 6)
            offsets[index], counts[index] = f.tell(), len(data)
            f.write(data)

        for row, col, pixels in tiles:
            if not (0 <= row < down and 0 <= col < across) or pixels.shape != (tile, tile, 4):
                raise ValueError(f"tile {row}, {col} is not of this file")
            if counts[row * across + col]:
                raise ValueError(f"tile {row}, {col} is given twice")
            put(row * across + col, pixels)
        for index in range(across * down):
            if not counts[index]:
                put(index, np.zeros((tile, tile, 4), np.uint8))
        spots = {}
        for name, values, code in (("offsets", offsets, "Q"), ("counts", counts, "Q"), ("bits", [8, 8, 8, 8], "H")):
            f.write(b"\0" * (-f.tell() % 8))
            spots[name] = f.tell()
            f.write(struct.pack(f"<{len(values)}{code}", *values))
        f.write(b"\0" * (-f.tell() % 8))
        here, n = f.tell(), across * down
        inline = lambda code, v: struct.pack(f"<{code}", v).ljust(8, b"\0")
        many = lambda values, at: inline("Q", values[0]) if n == 1 else inline("Q", at)
        tags = [
            (256, 4, 1, inline("I", width)), (257, 4, 1, inline("I", height)), (258, 3, 4, struct.pack("<4H", 8, 8, 8, 8)), (259, 3, 1, inline("H", 8)),
            (262, 3, 1, inline("H", 2)), (277, 3, 1, inline("H", 4)), (284, 3, 1, inline("H", 1)), (322, 4, 1, inline("I", tile)), (323, 4, 1, inline("I", tile)),
            (324, 16, n, many(offsets, spots["offsets"])), (325, 16, n, many(counts, spots["counts"])), (338, 3, 1, inline("H", 2)),
        ]
        f.write(struct.pack("<Q", len(tags)))
        for tag, kind, count, value in tags:
            f.write(struct.pack("<HHQ", tag, kind, count) + value)
        f.write(struct.pack("<Q", 0))
        f.seek(8)
        f.write(struct.pack("<Q", here))
