"""Masks beside pixels: a relation of a mask joins the pixels of its image, whatever size it has.

A pixel takes the mask's value at floor(position * mask size / image size). Pixels of images that have no mask keep what
they had, or get the kind's empty value. keep and remove are told by more than 127; a hint by its level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mattework.functions.sql import Dialect, clip

PX = ["image_id", "y", "x"]
EMPTY = {"keep": "0", "remove": "0", "hint": "cast(NULL as int)"}


def one_channel(d: Dialect, columns: list[str]) -> str:
    """What a mask of several channels says: the last of four, else the first."""
    return columns[3] if len(columns) == 4 else columns[0]


def mask_level(d: Dialect, value: str, kind: str, greatest: str = "2") -> str:
    """A mask's value as 0..255: kind bool, int or float; floats of a mask whose greatest is at most 1 are scaled, cut
    off, and what is no number is 0."""
    if kind == "bool":
        return f"CASE WHEN {value} THEN 255 ELSE 0 END"
    if kind == "int":
        return f"cast(greatest(0, least(255, {value})) as int)"
    sane = f"coalesce(CASE WHEN isnan({value}) THEN 0e0 ELSE {clip(value, 0, 255)} END, 0e0)"
    return d.trunc(f"least(255e0, {sane} * CASE WHEN {greatest} <= 1 THEN 255e0 ELSE 1e0 END)")


def with_mask(pixels: DataFrame, mask: DataFrame, kind: str, value: str = "mask") -> DataFrame:
    """pixels with the column kind (keep, remove or hint) from mask(image_id, y, x, value).

    A mask has every pixel of its own size. Both are read by line and column of one image; the join is by the mask's
    pixel, and sizes, a row an image, are joined first.
    """
    if kind not in EMPTY:
        raise ValueError(f"a mask is one of {', '.join(EMPTY)}")
    size = lambda of, h, w: of.groupBy("image_id").agg((F.max("y") + 1).alias(h), (F.max("x") + 1).alias(w))
    sizes = size(pixels, "h_", "w_").join(size(mask, "mh_", "mw_").hint("merge"), "image_id", "left")
    placed = pixels.join(sizes.hint("merge"), "image_id").withColumns({"my_": F.expr("y * mh_ div h_"), "mx_": F.expr("x * mw_ div w_")})
    values = mask.select(F.col("image_id").alias("mi_"), F.col("y").alias("vy_"), F.col("x").alias("vx_"), F.col(value).cast("int").alias("told_"))
    # an estimate of a mask's size can be that of the table that it is made from, so it is never sent to all
    joined = placed.join(values.hint("merge"), (F.col("image_id") == F.col("mi_")) & (F.col("my_") == F.col("vy_")) & (F.col("mx_") == F.col("vx_")), "left")
    before = F.col(kind) if kind in pixels.columns else F.expr(EMPTY[kind])
    return joined.withColumn(kind, F.coalesce("told_", before)).drop("h_", "w_", "mh_", "mw_", "my_", "mx_", "mi_", "vy_", "vx_", "told_")


def without_mask(pixels: DataFrame, kind: str) -> DataFrame:
    """pixels with the kind's empty value everywhere."""
    return pixels.withColumn(kind, F.expr(EMPTY[kind]))
