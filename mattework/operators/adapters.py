"""External models as relations: the pixels of an image go in, planes of pixels come out.

A seam says where a model fits: which settings name it, what it needs, which planes it gives. A model is named
`module:attribute` (or `module` alone, with the seam's usual attribute). Nothing of it is imported before an executor
works on an image; a report on a seam only looks whether packages, folders and names are there. A model needs its image
whole, so an image is gathered in one task here and nowhere else.
"""

from __future__ import annotations

import os
import pkgutil
from collections.abc import Mapping
from dataclasses import dataclass
from importlib.util import find_spec

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Longest side that a hint model is asked to work at. Fixed value.
MAX_SIDE = 1536


@dataclass(frozen=True)
class Seam:
    title: str
    setting: str
    attribute: str
    packages: tuple[str, ...] = ()
    model_setting: str = ""


HINT = Seam("alpha hint", "MATTE_HINT_ADAPTER", "generate_alpha_hint", ("torch", "torchvision", "transformers"), "MATTE_HINT_MODEL")
PLUGIN = Seam("matte plugin", "MATTE_PLUGIN_ADAPTER", "process")
#: A seam for functions that need nothing but themselves.
PLAIN = Seam("plain hint", "MATTE_PLAIN_ADAPTER", "generate_alpha_hint")


@dataclass(frozen=True)
class Report:
    """What a seam lacks; `adapter` and `model` are those that were told or found in the environment."""

    title: str
    adapter: str
    model: str
    missing_packages: tuple[str, ...]
    missing_settings: tuple[str, ...]

    @property
    def available(self) -> bool:
        return not (self.missing_packages or self.missing_settings)

    @property
    def message(self) -> str:
        lacks = [f"package {p}" for p in self.missing_packages] + [f"setting {s}" for s in self.missing_settings]
        return f"{self.title}: " + (f"lacks {', '.join(lacks)}" if lacks else f"runs {self.adapter} when asked")


def report(seam: Seam, adapter: str | None = None, model: str | None = None) -> Report:
    adapter, model = ((os.environ.get(name, "") if told is None else told).strip() for name, told in ((seam.setting, adapter), (seam.model_setting, model)))
    settings = [] if adapter else [seam.setting]
    if seam.model_setting and not (model and os.path.exists(model)):
        settings.append(seam.model_setting)
    return Report(seam.title, adapter, model, tuple(p for p in seam.packages if find_spec(p) is None), tuple(settings))


def model_function(seam: Seam, adapter: str):
    found = pkgutil.resolve_name(adapter if ":" in adapter else f"{adapter}:{seam.attribute}")
    if callable(found):
        return found
    raise TypeError(f"{adapter} is no function")


def levels(values, shape: tuple[int, int], channels: int, name: str) -> np.ndarray:
    """values as (height, width, channels) of 0..255, of exactly this height and width.

    Of several channels one plane takes the fourth if there are just four, else the first. Truth values are 0 and 255;
    a plane of fractions none of which is above 1 is scaled; fractions are cut off, what is no number is 0.
    """
    if values is None:
        raise ValueError(f"{name} is required")
    grid = np.atleast_3d(np.asarray(values))
    if grid.ndim != 3 or grid.shape[:2] != shape or grid.shape[2] < channels:
        raise ValueError(f"{name} has the shape {np.shape(values)}, an image of {shape} needs {channels} channels")
    grid = grid[:, :, [3 if grid.shape[2] == 4 else 0]] if channels == 1 else grid[:, :, :channels]
    if grid.dtype == np.uint8:
        return grid
    fractions = channels == 1 and grid.dtype.kind == "f" and not (grid > 1).any()
    factor = 255 if fractions or grid.dtype == bool else 1
    return np.nan_to_num(grid * float(factor), nan=0.0, posinf=255.0, neginf=0.0).clip(0, 255).astype(np.uint8)


def answer(raw, *names: str):
    """The first of the names that a result has, as a key or an attribute."""
    for name in names:
        found = raw.get(name) if isinstance(raw, Mapping) else getattr(raw, name, None)
        if found is not None:
            return found
    return None if isinstance(raw, Mapping) or any(hasattr(raw, n) for n in names) else raw


def luma_hint(rgb_u8: np.ndarray, model_path: str | None = None, max_side: int = MAX_SIDE) -> np.ndarray:
    """A stand-in model: brightness."""
    return rgb_u8.astype(np.float64).mean(axis=2) / 255.0


def luma_matte(rgb_u8: np.ndarray, alpha_hint_u8: np.ndarray) -> dict:
    """A stand-in plugin: the hint as alpha, the image as foreground."""
    return {"alpha": alpha_hint_u8, "foreground": rgb_u8, "processed": np.dstack([rgb_u8, alpha_hint_u8])}


def _by_image(pixels: DataFrame, given: dict[str, list[str]], planes: dict[str, list[str]], run) -> DataFrame:
    """(image_id, y, x, the planes' columns): run(arrays by name) gives arrays by name, None for a plane it lacks."""
    columns = [c for cs in planes.values() for c in cs]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows["y"].to_numpy(), rows["x"].to_numpy()
        shape = int(at[0].max()) + 1, int(at[1].max()) + 1
        arrays = {}
        for name, cs in given.items():
            arrays[name] = np.zeros((*shape, len(cs)), np.uint8)
            arrays[name][at] = rows[cs].fillna(0).to_numpy()
        out, made = rows[["image_id", "y", "x"]].copy(), run(arrays)
        for name, cs in planes.items():
            plane = made[name]
            for i, c in enumerate(cs):
                out[c] = pd.array([None] * len(rows) if plane is None else levels(plane, shape, len(cs), name)[..., i][at], dtype="Int32")
        return out

    used = ["image_id", "y", "x", *(c for cs in given.values() for c in cs)]
    return pixels.select(*used).groupBy("image_id").applyInPandas(one, "image_id long, y int, x int, " + ", ".join(f"{c} int" for c in columns))


def generate_hints(pixels: DataFrame, adapter: str | None = None, *, seam: Seam = HINT, model: str | None = None, max_side: int = MAX_SIDE) -> DataFrame:
    """(image_id, y, x, hint) of pixels(image_id, y, x, r, g, b). The model gets rgb_u8, model_path and max_side and
    gives an array, or a result with alpha_hint or alpha."""
    told = report(seam, adapter, model)
    if not told.available:
        raise RuntimeError(told.message)

    def run(arrays):
        raw = model_function(seam, told.adapter)(rgb_u8=arrays["rgb"], model_path=told.model or None, max_side=max_side)
        return {"hint": answer(raw, "alpha_hint", "alpha")}

    return _by_image(pixels, {"rgb": ["r", "g", "b"]}, {"hint": ["hint"]}, run)


def plugin_mattes(pixels: DataFrame, adapter: str | None = None, *, seam: Seam = PLUGIN) -> DataFrame:
    """(image_id, y, x, alpha, fr, fg, fb, pr, pg, pb, pa) of pixels(image_id, y, x, r, g, b, hint): the plugin's alpha
    and, where it gives them, its foreground and its processed image. It gets rgb_u8 and alpha_hint_u8."""
    told = report(seam, adapter)
    if not told.available:
        raise RuntimeError(told.message)

    def run(arrays):
        raw = model_function(seam, told.adapter)(rgb_u8=arrays["rgb"], alpha_hint_u8=arrays["hint"][..., 0])
        if not isinstance(raw, Mapping) and not hasattr(raw, "alpha"):
            raise TypeError("a plugin gives a mapping or a result with alpha")
        return {"alpha": answer(raw, "alpha"), "foreground": answer(raw, "foreground", "foreground_rgb"), "processed": answer(raw, "processed", "processed_rgba")}

    planes = {"alpha": ["alpha"], "foreground": ["fr", "fg", "fb"], "processed": ["pr", "pg", "pb", "pa"]}
    return _by_image(pixels, {"rgb": ["r", "g", "b"], "hint": ["hint"]}, planes, run)
