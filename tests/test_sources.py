import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.sources import packages, tracking


def test_tracking_documents_of_both_layouts(spark, tmp_path):
    old = {"format": "tracking", "model_version": 1, "path": [{"frame": 0, "timestamp_us": 0, "x_px": 1.0, "y_px": 2.0, "rotation_deg": 90.0, "raw_x_px": 1.0, "raw_y_px": 2.0, "raw_rotation_deg": 0.0, "patches": 3}]}
    new = {"format": "tracking", "path": [
        {"frame": 5, "timestamp": 9, "mode": "field", "pose": {"x": 1.0, "y": 2.0, "rotation": 0.5}, "sharpness": {"score": 4.0}, "success": False}, {"frame": 7, "timestamp": 10},
        {"frame": 7, "timestamp": 11}, {"frame": -1, "timestamp": 12}]}
    for name, doc in (("old", old), ("new", new)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    rows = {(r.file.rsplit("/", 1)[-1][:3], r.timestamp_us): r for r in tracking.read_tracking(spark, str(tmp_path)).collect()}
    assert rows["old", 0].mode == "window" and rows["old", 0].pose.rotation == pytest.approx(np.pi / 2) and rows["old", 0].fault is None
    assert rows["new", 9].pose.x == 1.0 and rows["new", 9].success is False and rows["new", 9].sharpness == 4.0 and rows["new", 10].pose is None
    assert [rows["new", t].fault for t in (9, 10, 11, 12)] == [None, "frame twice", "frame twice", "frame"]


def test_movement_table_round_trip(spark, tmp_path):
    path = spark.createDataFrame([(1, 0, 0, 1.0, 2.0, 0.5, 3.0, None, True), (1, 1, 40, None, None, None, 4.0, 2.0, False)], "video_id int, frame int, timestamp_us int, x double, y double, rotation double, points double, sharpness double, success boolean")
    tracking.write_movement(path, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, inferSchema=True).collect()
    assert len(back) == 1 and back[0].rotation_deg == pytest.approx(28.6478897565) and back[0].video_id == 1
    doc = json.loads(tracking.tracking_documents(path, "video_id").first().document)
    assert [e.get("pose") for e in doc["path"]] == [{"x": 1.0, "y": 2.0, "rotation": 0.5}, None]


def test_package_round_trip(spark, tmp_path):
    a = np.arange(24.0).reshape(3, 4, 2)
    packages.write_package(str(tmp_path / "a.zip"), {"version": 3}, {"coefficients": a, "valid": np.ones((2, 2), np.uint8)})
    (tmp_path / "b.zip").write_bytes(b"no zip")
    metadata, arrays = packages.read_package((tmp_path / "a.zip").read_bytes())
    assert metadata["version"] == 3 and (arrays["coefficients"] == a).all()
    rows = packages.coefficients(spark, str(tmp_path)).collect()
    good = {(r.cx, r.cy): (r.dx, r.dy) for r in rows if r.fault is None}
    assert len(good) == 12 and good[2, 1] == (12.0, 13.0) and [r.fault.split(":")[0] for r in rows if r.fault] == ["BadZipFile"]


def test_bigtiff(tmp_path):
    tile = np.random.default_rng(0).integers(0, 255, (16, 16, 4), np.uint8)
    path = tmp_path / "a.tif"
    packages.write_bigtiff(str(path), 40, 20, 16, iter([(1, 2, tile), (0, 0, tile)]))
    raw = path.read_bytes()
    assert raw[:4] == b"II\x2b\0"
    at = struct.unpack_from("<Q", raw, 8)[0]
    n = struct.unpack_from("<Q", raw, at)[0]
    tags = {t: (k, c, v) for t, k, c, v in (struct.unpack_from("<HHQ8s", raw, at + 8 + 20 * i) for i in range(n))}
    assert n == 12 and list(tags) == sorted(tags) and tags[324][1] == 6
    offsets, counts = (struct.unpack_from("<6Q", raw, struct.unpack("<Q", tags[t][2])[0]) for t in (324, 325))
    part = [zlib.decompress(raw[o : o + c]) for o, c in zip(offsets, counts, strict=True)]
    assert part[5] == part[0] == tile.tobytes() and part[1] == bytes(1024)
    with pytest.raises(ValueError):
        packages.write_bigtiff(str(path), 40, 20, 16, iter([(0, 0, tile), (0, 0, tile)]))


def test_tile_layout(spark):
    tiles = spark.createDataFrame([(0, 0, 10), (0, 1, 5), (1, 0, 7), (0, 0, 11), (5, 0, 1)], "cell_row int, cell_col int, bytes int")
    got = {(r.cell_row, r.cell_col, r.bytes): (r.offset, r.fault) for r in packages.tile_layout(tiles, 2, 2).collect()}
    assert got[0, 0, 10] == (0, None) and got[0, 1, 5] == (10, None) and got[1, 0, 7] == (15, None) and got[0, 0, 11][1] == "twice" and got[5, 0, 1][1] == "off the grid"
