"""Frames with known truth, by formula: a disc before a screen. Every size can be divided by a scale.

The relation has what key_frames reads (image_id, y, x, r, g, b, kr, kg, kb, a0, keep, remove, hint) and the truth: a_true
and the foreground's colour fr, fg, fb. Rows of pixels are dealt over the tasks before their pixels are made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mattework.functions.sql import SPARK, clip, num


@dataclass(frozen=True)
class Disc:
    """A screen colour for each channel as SQL over u and v (position across and down, 0..1), and a disc."""

    name: str
    height: int
    width: int
    key: tuple[int, int, int]
    screen: tuple[str, str, str]
    colour: tuple[int, int, int]
    radius: float
    feather: float = 0.0
    island: tuple[float, float, tuple[int, int, int]] | None = None  # radius, steps above the middle, colour


def flat(r: int, g: int, b: int) -> tuple[str, str, str]:
    return f"{r}e0", f"{g}e0", f"{b}e0"


UNEVEN = ("4 + 0.15e0 * (34 * v - 16)", "185 + 57 * u + 34 * v - 16", "35 + 0.25e0 * (34 * v - 16)")

# Sizes, colours and radii of the frames that the thresholds of quality are stated for.
DISCS = (
    Disc("green_flat", 720, 960, (0, 220, 50), flat(0, 220, 40), (215, 160, 120), 180),
    Disc("blue_flat", 600, 840, (30, 80, 235), flat(28, 80, 232), (230, 190, 120), 150),
    Disc("custom_flat", 600, 840, (185, 42, 170), flat(185, 42, 170), (70, 190, 125), 150),
    Disc("green_uneven_gradient", 720, 960, (0, 220, 50), UNEVEN, (218, 158, 120), 175),
    Disc("green_same_color_island", 720, 960, (0, 220, 50), flat(0, 220, 45), (210, 154, 118), 210, island=(58, 20, (4, 206, 52))),
    Disc("green_antialiased_edge", 720, 960, (0, 220, 50), flat(0, 220, 42), (214, 160, 122), 185, 8),
    Disc("edge_fringe_green", 280, 360, (0, 220, 50), flat(0, 220, 50), (220, 185, 120), 78, 8),
    Disc("edge_fringe_blue", 280, 360, (30, 80, 235), flat(30, 80, 235), (220, 185, 120), 78, 8),
)


def disc_frames(spark: SparkSession, scale: float = 1.0, discs: tuple[Disc, ...] = DISCS) -> DataFrame:
    """Pixels of the discs, image_id being the place in discs; sizes and radii (not feathers) divided by scale."""
    lines = [(i, y) for i, d in enumerate(discs) for y in range(round(d.height / scale))]
    told = spark.createDataFrame(lines, "image_id long, y int").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image_id", "y")
    which = lambda of: "CASE image_id " + " ".join(f"WHEN {i} THEN {of(d)}" for i, d in enumerate(discs)) + " END"
    size = {"h": which(lambda d: round(d.height / scale)), "w": which(lambda d: round(d.width / scale))}
    out = told.withColumns({n: F.expr(e) for n, e in size.items()}).withColumn("x", F.explode(F.expr("sequence(0, w - 1)")))
    out = out.withColumns({"u": F.expr("x / (w - 1)"), "v": F.expr("y / (h - 1)"), "dist": F.expr("sqrt(pow(x - w / 2e0, 2) + pow(y - h / 2e0, 2))")})
    alpha = lambda d: (clip(f"({num(d.radius / scale + d.feather)} - dist) / {num(2 * d.feather)}") if d.feather else f"CASE WHEN dist <= {num(d.radius / scale)} THEN 1e0 ELSE 0e0 END")
    inside = lambda d: f"pow(x - w div 2, 2) + pow(y - (h div 2 - {num(d.island[1] / scale)}), 2) < {num((d.island[0] / scale) ** 2)}" if d.island else "false"
    out = out.withColumns({"a_true": F.expr(which(alpha)), "island": F.expr(which(inside))})
    out = out.withColumns({f"f{c}": F.expr(f"cast(CASE WHEN island THEN {which(lambda d: d.island[2][i] if d.island else 0)} ELSE {which(lambda d: d.colour[i])} END as int)") for i, c in enumerate("rgb")})
    mixed = lambda i, c: SPARK.trunc(clip(f"cast(greatest(0e0, least(255e0, {which(lambda d: d.screen[i])})) as int) * (1e0 - a_true) + f{c} * a_true", 0, 255))
    out = out.withColumns({c: F.expr(mixed(i, c)) for i, c in enumerate("rgb")} | {f"k{c}": F.expr(which(lambda d: d.key[i])) for i, c in enumerate("rgb")})
    out = out.withColumns({"a0": F.lit(None).cast("double"), "keep": F.lit(0), "remove": F.lit(0), "hint": F.lit(None).cast("int")})
    return out.select("image_id", "y", "x", "r", "g", "b", "kr", "kg", "kb", "a0", "keep", "remove", "hint", "a_true", "fr", "fg", "fb", "island")
