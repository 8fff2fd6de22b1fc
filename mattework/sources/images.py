"""Image files as relations of pixels and back.

PNG is read and written here, from the public format: every colour type, depth and interlacing. Other formats
come through Spark's image source (JPEG, BMP, GIF, TIFF). Files are turned as their orientation tag says.
Pixels leave a task in stripes. Writing compresses stripes of rows apart and joins them, so that a task holds
the pixels of a stripe and no more than the compressed bytes of an image. A file that cannot be read is a
ValueError that names it; no file is left out silently. An empty folder of a stated schema gives no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "path string, image_id long, height int, width int, y int, x int, r int, g int, b int, a0 double"
STRIPE_PIXELS = 1 << 18

# Fixed values of the formats: the signature, samples a pixel by colour type, the passes of interlacing
# (first row, first column, step of rows, step of columns), the tag of the orientation.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]
ORIENTATION = 0x0112

PNG_GLOB = "*.[pP][nN][gG]"
OTHER_GLOB = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[bB][mM][pP],[gG][iI][fF],[tT][iI][fF],[tT][iI][fF][fF]}"


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a damaged chunk")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n
    raise ValueError("the file ends early")


def _unfilter(raw: np.ndarray, h: int, stride: int, bpp: int) -> np.ndarray:
    """The rows of a pass; Average and Paeth depend on the byte before and go byte by byte."""
    lines = raw.reshape(h, stride + 1)
    out = np.zeros((h + 1, stride), np.uint8)
    for y in range(h):
        kind, line, up = int(lines[y, 0]), lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            for k in range(bpp):
                out[y + 1, k::bpp] = np.cumsum(line[k::bpp], dtype=np.uint8)
        elif kind == 2:
            out[y + 1] = line + up
        elif kind in (3, 4):
            out[y + 1] = np.frombuffer(_sequential(kind, line.tolist(), up.tolist(), bpp), np.uint8)
        else:
            raise ValueError("an unknown row filter")
    return out[1:]


def _sequential(kind: int, line: list[int], up: list[int], bpp: int) -> bytes:
    done = bytearray(len(line))
    for i, value in enumerate(line):
        left = done[i - bpp] if i >= bpp else 0
        if kind == 3:
            guess = (left + up[i]) >> 1
        else:
            corner = up[i - bpp] if i >= bpp else 0
            near = left + up[i] - corner
            guess = min((left, up[i], corner), key=lambda c: abs(near - c))  # the first of equals
        done[i] = (value + guess) & 255
    return bytes(done)


def _samples(raw: np.ndarray, h: int, w: int, depth: int, per: int) -> np.ndarray:
    """(h, w, per) of samples as stored; of 16 bits the upper 8."""
    stride = (w * per * depth + 7) // 8
    rows = _unfilter(raw, h, stride, max(1, per * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        rows = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
    return rows[:, : w * per].reshape(h, w, per)


def decode_png(data: bytes) -> tuple[np.ndarray, bool, int]:
    """(RGBA of 8 bits, whether the file has alpha, orientation 1..8). A transparent colour of gray or RGB is not alpha."""
    head, idat, palette, fade, turn = None, [], None, b"", 1
    for kind, body in png_chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            fade = body
        elif kind == b"eXIf":
            turn = tiff_orientation(body)
        elif kind == b"IDAT":
            idat.append(body)
    if head is None or head[2] not in (1, 2, 4, 8, 16) or head[3] not in SAMPLES or not head[0] or not head[1]:
        raise ValueError("an unknown kind of PNG")
    w, h, depth, colour, _, _, laced = head
    per = SAMPLES[colour]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8)
    except zlib.error as why:
        raise ValueError(str(why)) from why
    out, at = np.zeros((h, w, per), np.uint8), 0
    for y0, x0, dy, dx in PASSES if laced else [(0, 0, 1, 1)]:
        ph, pw = -(-(h - y0) // dy), -(-(w - x0) // dx)
        if ph > 0 and pw > 0:
            n = ph * ((pw * per * depth + 7) // 8 + 1)
            if at + n > len(raw):
                raise ValueError("too few rows")
            out[y0::dy, x0::dx] = _samples(raw[at : at + n], ph, pw, depth, per)
            at += n
    alpha = np.full((h, w, 1), 255, np.uint8)
    if colour == 3:
        if palette is None or int(out.max()) >= len(palette):
            raise ValueError("a colour that the palette lacks")
        faded = np.frombuffer(fade + b"\xff" * (256 - len(fade)), np.uint8)
        out, alpha = palette[out[..., 0]], faded[out] if fade else alpha
    else:
        if depth < 8:
            out = out * np.uint8(255 // ((1 << depth) - 1))
        if per in (2, 4):
            out, alpha = out[..., :-1], out[..., -1:]
        if out.shape[2] == 1:
            out = np.repeat(out, 3, axis=2)
    return np.concatenate([out, alpha], axis=2), per in (2, 4) or (colour == 3 and bool(fade)), turn


def tiff_orientation(block: bytes) -> int:
    """The orientation in a block of tags; 1 where none is stated or the block is damaged."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    try:
        first = struct.unpack_from(f"{order}I", block, 4)[0]
        for k in range(struct.unpack_from(f"{order}H", block, first)[0]):
            tag, _, _, value = struct.unpack_from(f"{order}HHIH", block, first + 2 + 12 * k)
            if tag == ORIENTATION:
                return value if 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


def file_orientation(data: bytes) -> int:
    """Orientation of a JPEG or TIFF file."""
    if data[:2] in (b"II", b"MM"):
        return tiff_orientation(data)
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        n = struct.unpack_from(">H", data, at + 2)[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return tiff_orientation(data[at + 10 : at + 2 + n])
        at += 2 + n
    return 1


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """2 to 4 mirror or turn by half; 5 to 8 exchange the axes first."""
    image = image.swapaxes(0, 1) if orientation >= 5 else image
    image = image[::-1] if orientation in (3, 4, 7, 8) else image
    return image[:, ::-1] if orientation in (2, 3, 6, 7) else image


def _rows(path: str, image_id: int, rgba: np.ndarray, has_alpha: bool) -> Iterator[pd.DataFrame]:
    h, w = rgba.shape[:2]
    step = max(1, STRIPE_PIXELS // w)
    for y in range(0, h, step):
        part = rgba[y : y + step].reshape(-1, 4).astype(np.int32)
        n = len(part)
        yield pd.DataFrame({
            "path": path, "image_id": image_id, "height": h, "width": w, "y": np.repeat(np.arange(y, y + n // w, dtype=np.int32), w), "x": np.tile(np.arange(w, dtype=np.int32), n // w),
            "r": part[:, 0], "g": part[:, 1], "b": part[:, 2], "a0": part[:, 3] / 255.0 if has_alpha else np.full(n, np.nan),
        })


def _from_png(turned: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, image_id, content in zip(batch["path"], batch["image_id"], batch["content"], strict=True):
                try:
                    rgba, has_alpha, turn = decode_png(content)
                except ValueError as why:
                    raise ValueError(f"{path}: {why}") from why
                yield from _rows(path, image_id, upright(rgba, turn) if turned else rgba, has_alpha)

    return run


def _from_source(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            if r.height <= 0:
                raise ValueError(f"{r.path}: cannot be read")
            bgr = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
            rgb = np.repeat(bgr, 3, axis=2) if r.nChannels == 1 else bgr[..., 2::-1]
            alpha = bgr[..., 3:] if r.nChannels == 4 else np.full((r.height, r.width, 1), 255, np.uint8)
            yield from _rows(r.path, r.image_id, upright(np.concatenate([rgb, alpha], axis=2), r.turn), r.nChannels == 4)


def _turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"key": batch["key"], "turn": [file_orientation(c) for c in batch["content"]]})


def _key(column: str):
    """A path with one slash after the scheme, whichever source names it."""
    return F.regexp_replace(column, "^([a-zA-Z0-9]+):/+", "$1:/")


def png_pixels(files: DataFrame, turned: bool = True) -> DataFrame:
    """Pixels of (path, content) rows, as binaryFile gives them, static or streaming."""
    named = files.select(_key("path").alias("path"), F.xxhash64(_key("path")).alias("image_id"), "content")
    out = named.mapInPandas(_from_png(turned), PIXELS)
    return out.withColumn("a0", F.when(~F.isnan("a0"), F.col("a0")))


def read_images(spark: SparkSession, folder: str, turned: bool = True) -> DataFrame:
    """path, image_id (a hash of the path), height, width, y, x, r, g, b, a0 (null without alpha) of all files."""
    pngs = png_pixels(spark.read.format("binaryFile").option("pathGlobFilter", PNG_GLOB).load(folder), turned)
    seen = spark.read.format("image").option("pathGlobFilter", OTHER_GLOB).load(folder).select("image.*").withColumn("path", _key("origin"))
    seen = seen.withColumn("image_id", F.xxhash64("path"))
    if turned:
        raw = spark.read.format("binaryFile").option("pathGlobFilter", OTHER_GLOB).load(folder)
        turns = raw.select(_key("path").alias("key"), "content").mapInPandas(_turns, "key string, turn int")
        seen = seen.join(turns, F.col("path") == F.col("key"), "left").withColumn("turn", F.coalesce("turn", F.lit(1)))
    else:
        seen = seen.withColumn("turn", F.lit(1))
    rest = seen.select("path", "image_id", "height", "width", "nChannels", "data", "turn").mapInPandas(_from_source, PIXELS)
    return pngs.unionByName(rest.withColumn("a0", F.when(~F.isnan("a0"), F.col("a0"))))


def read_masks(spark: SparkSession, folder: str, shape: tuple[int, int] | None = None) -> DataFrame:
    """path, image_id, y, x, mask 0..255: files as gray, not turned; nearest pixels where a shape (h, w) is told."""
    gray = F.expr("cast((r * 19595 + g * 38470 + b * 7471 + 32768) div 65536 as int)")
    masks = read_images(spark, folder, turned=False).withColumn("mask", gray)
    if shape is None:
        return masks.select("path", "image_id", "y", "x", "mask")
    grown = masks.withColumns({"sy": F.col("y"), "sx": F.col("x")})
    # the target rows whose floor(t * height / h) is y run from ceil(y * h / height) to ceil((y + 1) * h / height) - 1
    for c, size, n in (("y", "height", shape[0]), ("x", "width", shape[1])):
        ceil = lambda e: f"(({e}) * {n} + {size} - 1) div {size}"  # noqa: E731, B023
        low, high = ceil(f"s{c}"), ceil(f"s{c} + 1")
        grown = grown.where(f"{high} > {low}").withColumn(c, F.explode(F.expr(f"sequence(cast({low} as int), cast({high} - 1 as int))")))
    return grown.select("path", "image_id", "y", "x", "mask")


# --- writing -------------------------------------------------------------------------------------

ADLER = 65521  # fixed value of the checksum


def adler_join(one: int, two: int, n_two: int) -> int:
    """The Adler-32 of two strings after each other from those of each."""
    a1, b1, a2, b2 = one & 0xFFFF, one >> 16, two & 0xFFFF, two >> 16
    return ((b1 + b2 + n_two * (a1 - 1)) % ADLER) << 16 | (a1 + a2 - 1) % ADLER


def _piece(channels: tuple[str, ...]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top, h, w = int(pdf["y"].min()), int(pdf["y"].max() - pdf["y"].min()) + 1, int(pdf["x"].max()) + 1
        image_id = int(pdf["image_id"].iloc[0])
        if len(pdf) != h * w or pdf.duplicated(["y", "x"]).any():
            raise ValueError(f"image {image_id}: rows {top} to {top + h - 1} do not have every pixel once")
        plane = np.zeros((h, w, len(channels)), np.uint8)
        plane[pdf["y"] - top, pdf["x"]] = np.clip(pdf[list(channels)].to_numpy(), 0, 255)
        moved = plane.copy()
        moved[:, 1:] -= plane[:, :-1]
        raw = np.concatenate([np.ones((h, 1), np.uint8), moved.reshape(h, -1)], axis=1).tobytes()
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = deflate.compress(raw) + deflate.flush(zlib.Z_FULL_FLUSH)
        return pd.DataFrame([(image_id, top, h, w, zlib.adler32(raw), packed)], columns=["image_id", "top", "rows", "width", "adler", "piece"])

    return run


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _assemble(n_channels: int):
    colour = {1: 0, 3: 2, 4: 6}[n_channels]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image_id, pieces in zip(batch["image_id"], batch["pieces"], strict=True):
                width, height, adler, body = pieces[0]["width"], 0, 1, [b"\x78\x9c"]
                for p in pieces:
                    if p["top"] != height or p["width"] != width:
                        raise ValueError(f"image {image_id}: rows are missing or of another width")
                    height += p["rows"]
                    adler = adler_join(adler, p["adler"], p["rows"] * (width * n_channels + 1))
                    body.append(p["piece"])
                body.append(b"\x03\x00" + struct.pack(">I", adler))
                head = _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0))
                png = SIGNATURE + head + b"".join(_chunk(b"IDAT", bytes(p)) for p in body) + _chunk(b"IEND", b"")
                yield pd.DataFrame({"image_id": [image_id], "png": [png]})

    return run


def encode_png(pixels: DataFrame, channels: tuple[str, ...] = ("r", "g", "b", "alpha"), stripe: int = 64) -> DataFrame:
    """(image_id, png) for every image; one channel is gray, three RGB, four RGBA. A store takes it as a table."""
    parts = pixels.select("image_id", "y", "x", *channels).groupBy("image_id", F.floor(F.col("y") / stripe).alias("stripe"))
    pieces = parts.applyInPandas(_piece(channels), "image_id long, top int, rows int, width int, adler long, piece binary")
    whole = pieces.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("top", "rows", "width", "adler", "piece"))).alias("pieces"))
    return whole.mapInPandas(_assemble(len(channels)), "image_id long, png binary")


def write_png(pixels: DataFrame, folder: str, channels: tuple[str, ...] = ("r", "g", "b", "alpha")) -> None:
    """folder/<image_id>.png for every image, in a folder that all executors mount. A repeated task writes the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for image_id, png in zip(batch["image_id"], batch["png"], strict=True):
                draft = os.path.join(folder, f".{image_id}-{uuid.uuid4().hex}")
                with open(draft, "wb") as out:
                    out.write(png)
                os.replace(draft, os.path.join(folder, f"{image_id}.png"))
            yield batch[["image_id"]]

    encode_png(pixels, channels).mapInPandas(run, "image_id long").write.format("noop").mode("overwrite").save()


def write_mask(pixels: DataFrame, folder: str, column: str = "alpha") -> None:
    """The first channel of a mask as gray PNG files."""
    write_png(pixels, folder, (column,))


def export_result(result: DataFrame, folder: str) -> None:
    """Results as RGBA files, the colour of transparent pixels 0."""
    clear = {c: F.when(F.col("alpha") > 0, F.col(c)).otherwise(F.lit(0)) for c in "rgb"}
    write_png(result.withColumns(clear), folder)


def export_matte(result: DataFrame, folder: str) -> None:
    """The alpha of results as gray files."""
    write_mask(result, folder, "alpha")


def write_baseline(results: DataFrame, metrics: DataFrame, folder: str) -> None:
    """What a later run is compared with: results as Parquet, the metrics of each image as lines of JSON."""
    results.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/results")
    metrics.write.mode("overwrite").json(f"{folder.rstrip('/')}/metrics")
