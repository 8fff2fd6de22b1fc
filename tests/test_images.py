"""Image files: exact round trips, the JVM's reader as a second opinion, hand-built kinds, streams, viewports."""

import struct
import zlib

import numpy as np
import pytest

from mattework.plans import viewport as vp
from mattework.settings import Settings
from mattework.sources import images
from mattework.streaming.frames import key_stream, latest


def pixels(spark, shapes, channels=4, seed=3):
    rng, rows, planes = np.random.default_rng(seed), [], {}
    for image_id, (h, w) in shapes.items():
        planes[image_id] = plane = rng.integers(0, 256, (h, w, channels))
        rows += [(image_id, y, x, *(int(v) for v in plane[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, " + ", ".join(f"{c} int" for c in ("r", "g", "b", "alpha")[:channels])), planes


def png(w, h, depth, colour, raw, extra=b"", laced=0):
    head = images._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, laced))
    return images.SIGNATURE + head + extra + images._chunk(b"IDAT", zlib.compress(raw)) + images._chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_round_trip(spark, tmp_path, channels):
    df, planes = pixels(spark, {7: (70, 9), 8: (1, 1), 9: (130, 33)}, channels)
    names = ("r", "g", "b", "alpha")[:channels]
    images.write_png(df.repartition(5), str(tmp_path / "out"), names)
    got = images.read_images(spark, str(tmp_path / "out")).toPandas()
    seen = spark.read.format("image").load(str(tmp_path / "out")).select("image.*").collect()
    assert len(seen) == 3
    for r in seen:
        image_id = int(r.origin.rsplit("/", 1)[1].split(".")[0])
        bgr = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
        theirs = bgr if channels == 1 else bgr[..., [2, 1, 0, 3][:channels]]
        assert (theirs == planes[image_id]).all()
        ours = got[got["path"].str.endswith(f"/{image_id}.png")].sort_values(["y", "x"])
        plane = planes[image_id].reshape(-1, channels)
        assert (ours[["r", "g", "b"]].to_numpy() == plane[:, [0, 0, 0] if channels == 1 else [0, 1, 2]]).all()
        assert np.allclose(ours["a0"], plane[:, 3] / 255) if channels == 4 else ours["a0"].isna().all()


def test_row_filters():
    rng = np.random.default_rng(1)
    plane = rng.integers(0, 256, (5, 6, 3))
    raw = b""
    for y in range(5):
        line = bytearray([y])
        for i in range(18):
            at = lambda yy, k: int(plane[yy].ravel()[k]) if yy >= 0 and k >= 0 else 0
            a, b, c = at(y, i - 3), at(y - 1, i), at(y - 1, i - 3)
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((at(y, i) - [0, a, b, (a + b) // 2, near][y]) % 256)
        raw += bytes(line)
    rgba, has_alpha, _ = images.decode_png(png(6, 5, 8, 2, raw))
    assert (rgba[..., :3] == plane).all() and not has_alpha


def test_kinds_of_png():
    gray, _, _ = images.decode_png(png(5, 1, 2, 0, bytes([0, 0b00011011, 0b11000000])))
    assert gray[0, :, 0].tolist() == [0, 85, 170, 255, 255]
    deep, has_alpha, _ = images.decode_png(png(1, 1, 16, 4, bytes([0, 9, 255, 7, 0])))
    assert deep[0, 0].tolist() == [9, 9, 9, 7] and has_alpha
    extra = images._chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6])) + images._chunk(b"tRNS", bytes([40]))
    chosen, has_alpha, _ = images.decode_png(png(3, 1, 1, 3, bytes([0, 0b01000000]), extra))
    assert chosen[0].tolist() == [[1, 2, 3, 40], [4, 5, 6, 255], [1, 2, 3, 40]] and has_alpha
    plane = np.arange(63).reshape(7, 9)
    raw = b"".join(b"\0" + bytes(row.tolist()) for y0, x0, dy, dx in images.PASSES for row in plane[y0::dy, x0::dx] if len(row))
    assert (images.decode_png(png(9, 7, 8, 0, raw, laced=1))[0][..., 0] == plane).all()
    for bad in (b"", images.SIGNATURE, png(2, 2, 8, 2, b"\0"), png(1, 1, 8, 2, b"\0\1\2\3")[:-9]):
        with pytest.raises(ValueError):
            images.decode_png(bad)


def test_orientation():
    tags = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHIHH", images.ORIENTATION, 3, 1, 6, 0)
    block = b"Exif\0\0" + tags
    assert images.file_orientation(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xda\0\0") == 6
    assert images.tiff_orientation(tags) == 6 and images.tiff_orientation(tags[:12]) == 1 and images.file_orientation(b"") == 1
    plane = np.array([[1, 2, 3], [4, 5, 6]])
    want = {1: plane, 2: plane[:, ::-1], 3: np.rot90(plane, 2), 4: plane[::-1], 5: plane.T, 6: np.rot90(plane, -1), 7: np.rot90(plane, 2).T, 8: np.rot90(plane)}
    assert all((images.upright(plane, k) == v).all() for k, v in want.items())
    assert images.decode_png(png(1, 1, 8, 0, b"\0\5", images._chunk(b"eXIf", tags)))[2] == 6


def test_masks_and_failures(spark, tmp_path):
    df, planes = pixels(spark, {1: (4, 6)}, 1)
    images.write_mask(df, str(tmp_path / "m"), "r")
    got = images.read_masks(spark, str(tmp_path / "m"), (7, 5)).toPandas()
    assert len(got) == 35
    for r in got.itertuples():
        assert r.mask == planes[1][r.y * 4 // 7, r.x * 6 // 5, 0]
    (tmp_path / "m" / "bad.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="bad.png"):
        images.read_images(spark, str(tmp_path / "m")).count()
    with pytest.raises(Exception, match="every pixel once"):
        images.encode_png(df.where("x <> 2 or y <> 1"), ("r",)).count()


def test_other_formats(spark, tmp_path):
    plane = np.random.default_rng(5).integers(0, 256, (3, 4, 3), dtype=np.uint8)
    size = 54 + 3 * 12
    head = b"BM" + struct.pack("<IHHI", size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 4, 3, 1, 24, 0, 36, 0, 0, 0, 0)
    (tmp_path / "a.bmp").write_bytes(head + plane[::-1, :, ::-1].tobytes())
    got = images.read_images(spark, str(tmp_path)).orderBy("y", "x").toPandas()
    assert (got[["r", "g", "b"]].to_numpy() == plane.reshape(-1, 3)).all() and got["a0"].isna().all()


def test_stream(spark, tmp_path):
    df, _ = pixels(spark, {1: (12, 16), 2: (12, 16)}, 3)
    images.write_png(df, str(tmp_path / "in"), ("r", "g", "b"))
    s = Settings(edge_refine_radius=2, fringe_band_radius=1, despeckle_min_area=0, cleanup=0)
    for _ in range(2):  # the second run finds nothing new
        key_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), s, once=True).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2 * 12 * 16 and out.select("image_id").distinct().count() == 2
    again = out.unionByName(out.where("y = 0").withColumn("generation", out.generation + 1))
    assert latest(again).count() == 2 * 16


def test_viewport():
    assert vp.proxy_shape(100, 200) == (100, 200, 1.0) and vp.proxy_shape(1000, 3600) == (500, 1800, 0.5)
    assert vp.visible_crop((2000, 3000), (600, 800)) == (1100, 700, 1900, 1300)
    assert vp.visible_crop((2000, 3000), (10, 9999), (0, 1990)) == (0, 1760, 1400, 2000)
    assert vp.crop_center((0, 0, 100, 50), (10, 20), 0.5) == (110, 70)
    assert vp.image_position(3.7, 0.2, 4, 1) == (3, 0) and vp.image_position(4, 0, 4, 1) is None
    assert vp.clamped_rect(-3.2, 1.1, 2.1, 1.1, 8, 6) == (0, 1, 3, 2)
    steps = vp.Steps(0.0, 1.0, 0.01)
    assert steps.count == 100 and steps.position(-3) == 0 and steps.position(0.125) == 12 and steps.position(0.333) == 33 and steps.value(33) == 0.33 and steps.value(999) == 1.0
    assert vp.Steps(1, 9, 1, integer=True).value(2) == 3.0
