"""Arithmetic of an interactive front end: proxy sizes, the visible crop, positions, slider steps.

Plain numbers for one view; the same formulas as SQL for a table of views. Rounding is half to even.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from mattework.functions.sql import Dialect

#: Fixed value: the longest side of a proxy.
PROXY_SIDE = 1800


@dataclass(frozen=True)
class Axis:
    """One axis of a view: the least and the most that a preview works on."""

    low: int
    high: int

    def spans(self, size, seen, middle):
        """Starts and ends, for numbers or arrays of them: the part of 0..size around middle (nan: the middle)."""
        size = np.asarray(size)
        n = np.minimum(size, np.clip(seen, self.low, self.high))
        start = np.clip(np.rint(np.where(np.isnan(middle), size / 2, middle) - n / 2), 0, size - n).astype(int)
        return start, start + n

    def sql(self, d: Dialect, size: str, seen: str, middle: str) -> tuple[str, str]:
        """The same of columns, as (start, length)."""
        n = f"least({size}, greatest({self.low}, least({self.high}, {seen})))"
        return f"greatest(0, least({size} - {n}, {d.rint(f'{middle} - {n} / 2e0')}))", n


# Bounds of the crop that a preview works on.
ACROSS, DOWN = Axis(320, 1400), Axis(240, 1000)


def proxy_shape(height: int, width: int, max_side: int = PROXY_SIDE) -> tuple[int, int, float]:
    """(height, width, scale) of a proxy; an image is never enlarged."""
    scale = min(1.0, max_side / max(height, width))
    return (height, width, 1.0) if scale >= 1 else (max(1, round(height * scale)), max(1, round(width * scale)), scale)


def visible_crop(shape: tuple[int, int], viewport: tuple[int, int], center: tuple[float, float] = (np.nan, np.nan)) -> tuple[int, int, int, int]:
    """(x0, y0, x1, y1) around the centre (x, y), or the image's middle, within the image. viewport is (height, width)."""
    x = ACROSS.spans(shape[1], viewport[1], center[0])
    y = DOWN.spans(shape[0], viewport[0], center[1])
    return tuple(int(v) for v in (x[0], y[0], x[1], y[1]))


def crop_center(rect: tuple[int, int, int, int], origin: tuple[int, int], scale: float) -> tuple[float, float]:
    """The full-size (x, y) in the middle of a displayed rectangle."""
    middle = np.reshape(rect, (2, 2)).mean(axis=0) / max(scale, 1e-6)
    return tuple((np.asarray(origin) + middle).tolist())


def image_position(x: float, y: float, width: int, height: int) -> tuple[int, int] | None:
    """The pixel under a position; None outside."""
    at = np.floor([x, y]).astype(int)
    return tuple(at.tolist()) if ((at >= 0) & (at < [width, height])).all() else None


def clamped_rect(left: float, top: float, right: float, bottom: float, width: int, height: int) -> tuple[int, int, int, int]:
    """Whole pixels that a rectangle touches, at least one each way unless it starts past the end."""
    size = np.array([width, height])
    low = np.floor([left, top]).clip(0, size)
    high = np.maximum(np.ceil([right, bottom]).clip(0, size), low + 1).clip(0, size)
    return tuple(np.concatenate([low, high]).astype(int).tolist())


class Steps:
    """The values that a control can take, as a grid; positions are indices into it."""

    def __init__(self, minimum: float, maximum: float, step: float, decimals: int = 2, integer: bool = False):
        at = minimum + step * np.arange(max(1, round((maximum - minimum) / step)) + 1)
        self.grid = np.round(np.minimum(at, maximum), 0 if integer else decimals)
        self._exact = at

    @property
    def count(self) -> int:
        return len(self.grid) - 1

    def position(self, value: float) -> int:
        return int(np.rint(np.interp(value, self._exact, np.arange(len(self._exact)))))

    def value(self, position: int) -> float:
        return float(self.grid[np.clip(position, 0, self.count)])


def proxy_sql(d: Dialect, src: str, max_side: int) -> str:
    """image_id, h, w and the proxy's nh, nw."""
    scale = f"least(1e0, {max_side}e0 / greatest(h, w))"
    side = lambda c: f"greatest(1, {d.rint(f'{c} * {scale}')})"
    return f"SELECT image_id, h, w, {side('h')} AS nh, {side('w')} AS nw FROM ({src}) s"


def crop_sql(d: Dialect, src: str) -> str:
    """image_id and the crop of h, w, view_h, view_w, cx, cy."""
    (x, w), (y, h) = ACROSS.sql(d, "w", "view_w", "cx"), DOWN.sql(d, "h", "view_h", "cy")
    out = f"SELECT image_id, {x} AS x0, {y} AS y0, {w} AS cw, {h} AS ch FROM ({src}) s"
    return f"SELECT image_id, x0, y0, x0 + cw AS x1, y0 + ch AS y1 FROM ({out}) p"


def resize_area_any(d: Dialect, src: str, shape: tuple[int, int], to: tuple[int, int], columns: str = "rgb") -> str:
    """A smaller image whose pixels are means by covered area, for any ratio.

    Sides are measured in units in which both grids have whole numbers, so weights are exact integers. At a
    reduction a source pixel touches at most two target pixels each way; they meet in an aggregate by target.
    """
    (h, w), (nh, nw) = shape, to
    first = lambda c, n, size: d.trunc(f"{c} * {n} / {size}e0")
    weight = lambda t, c, n, size: f"(least(({t} + 1) * {size}, ({c} + 1) * {n}) - greatest({t} * {size}, {c} * {n}))"
    out = f"SELECT s.*, {first('y', nh, h)} + iy.i AS ty, {first('x', nw, w)} + ix.i AS tx FROM ({src}) s CROSS JOIN {d.series('2', 'iy')} CROSS JOIN {d.series('2', 'ix')}"
    out = f"SELECT *, {weight('ty', 'y', nh, h)} AS wy, {weight('tx', 'x', nw, w)} AS wx FROM ({out}) t"
    means = ", ".join(f"{d.rint(f'sum(cast({c} * wy * wx as bigint)) / {h * w}e0')} AS {c}" for c in columns)
    return f"SELECT image_id, cast(ty as int) AS y, cast(tx as int) AS x, {means} FROM ({out}) v WHERE wy > 0 AND wx > 0 GROUP BY image_id, ty, tx"
