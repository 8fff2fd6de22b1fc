"""Parameters of keying: 45 fields with their fixed default values, presets and derived scalars."""

from __future__ import annotations

from dataclasses import dataclass, replace

MODES = ("GraphicExact", "ProChroma", "AIHint")


@dataclass(frozen=True)
class Settings:
    """The defaults are those that users of keying settings know."""

    key_color: tuple[int, int, int] = (0, 220, 50)
    tolerance: float = 0.18
    softness: float = 0.075
    edge_blur: float = 1.2
    cleanup: int = 1
    despill: float = 0.70
    mode: str = "GraphicExact"
    sample_size: int = 5
    auto_border_sample: bool = True
    auto_detect_key_color: bool = False
    border_sample_width: int = 24
    local_screen_model: bool = True
    max_local_screen_model_pixels: int = 12_000_000
    brightness_tolerance: float = 0.34
    clip_background: float = 0.78
    clip_foreground: float = 0.14
    matte_gamma: float = 1.0
    core_strength: float = 0.55
    edge_refine_radius: int = 0
    edge_softness: float = 0.55
    erode_expand: int = 0
    despeckle_min_area: int = 48
    aggressive_interior_removal: bool = False
    aggressive_threshold: float = 0.84
    aggressive_min_area: int = 0
    alpha_hint_foreground_threshold: int = 192
    alpha_hint_minimum_alpha: int = 48
    alpha_hint_strength: float = 1.0
    decontaminate: float = 0.50
    luminance_restore: float = 0.35
    unmix_amount: float = 0.75
    preview_scale: float = 1.0
    full_res_crop: tuple[int, int, int, int] | None = None
    use_tiling: bool = True
    tile_size: int = 2048
    tile_overlap: int = 128
    fringe_remove: float = 0.75
    edge_color_repair: float = 0.65
    inner_color_pull: float = 0.45
    fringe_band_radius: int = 3
    luminance_protect: float | None = None
    guided_alpha_refine: float = 0.0
    guided_radius: int = 8
    guided_eps: float = 1e-3
    guided_max_pixels: int = 2_000_000

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")

    @property
    def thresholds(self) -> tuple[int, int]:
        """(background, foreground) on the 0..255 probability."""
        clip = lambda v: round(min(1.0, max(0.0, v)) * 255)
        return clip(self.clip_background), clip(self.clip_foreground)

    @property
    def edge_radius(self) -> int:
        return self.edge_refine_radius if self.edge_refine_radius > 0 else max(2, round(self.edge_blur * 4 + 1))

    @property
    def min_area(self) -> int:
        return max(self.despeckle_min_area, self.cleanup * 12)

    @property
    def protect(self) -> float:
        told = self.luminance_restore if self.luminance_protect is None else self.luminance_protect
        return min(1.0, max(0.0, told))

    @property
    def nearest_radius(self) -> int:
        if self.inner_color_pull <= 0 or self.edge_color_repair <= 0:
            return 0
        return min(256, max(8, 4 * self.edge_radius, self.edge_radius + self.fringe_band_radius))

    def blur_kernel(self) -> int:
        """Side of the alpha blur; 1 means none."""
        r, soft = self.edge_radius, max(0.0, self.edge_softness)
        return odd_kernel(max(0.35, min(r / 3, r * soft * 0.55))) if soft > 0 and r > 1 else 1


def odd_kernel(radius: float) -> int:
    k = max(1, round(2 * radius + 1))
    return k + 1 if k % 2 == 0 else k


def screen_radius(height: int, width: int) -> int:
    return max(24, min(181, max(height, width) // 18))


#: What a preset changes; other fields stay. Fixed values.
PRESETS = {
    "Fast": {"edge_refine_radius": 4, "despeckle_min_area": 0, "guided_alpha_refine": 0.0},
    "Clean": {"edge_refine_radius": 6, "despeckle_min_area": 48, "cleanup": 1},
    "High Accuracy": {
        "key_color": (30, 80, 235), "tolerance": 0.45, "softness": 0.01, "edge_blur": 7.75, "cleanup": 0, "despill": 0.70, "sample_size": 10, "clip_background": 0.97, "clip_foreground": 0.0, "matte_gamma": 2.20,
        "core_strength": 0.38, "edge_refine_radius": 32, "edge_softness": 0.0, "erode_expand": -8, "despeckle_min_area": 0, "aggressive_interior_removal": True, "decontaminate": 0.50, "luminance_restore": 0.76,
        "fringe_remove": 0.75, "edge_color_repair": 0.65, "inner_color_pull": 0.45, "fringe_band_radius": 3,
    },
}


def preset(name: str, settings: Settings | None = None) -> Settings:
    return replace(settings or Settings(), **PRESETS[name])


def normalized_crop(crop, width: int, height: int):
    """The crop (x0, y0, x1, y1) within the image; ValueError if nothing is left."""
    if crop is None:
        return None
    x0, y0, x1, y1 = (int(v) for v in crop)
    x0, x1 = max(0, min(x0, width)), max(0, min(x1, width))
    y0, y1 = max(0, min(y0, height)), max(0, min(y1, height))
    if x1 <= x0 or y1 <= y0:
        raise ValueError("the crop is empty")
    return x0, y0, x1, y1
