"""The matte and its colours on whole small images, as arrays (y, x, image) instead of relations of pixels.

Each function is the same formula as the relation of that name in matte.py or key_image.py, term by term, for images of one
shape that are whole: many images at once, neighbours by shifted slices, so no pixel is sorted, dealt or joined. Images
lie along the last axis, so what is one number an image (the screen's colour) needs no copy for each pixel.
"""

from __future__ import annotations

import math

import numpy as np

from mattework.functions import sql as f
from mattework.operators import views as v
from mattework.operators.matte import ellipse, seed_limit
from mattework.settings import Settings

LINEAR = np.array(f.LINEAR)
Arrays = dict[str, np.ndarray]


def clip(x, low=0.0, high=1.0):
    return np.maximum(low, np.minimum(high, x))


def rint(x) -> np.ndarray:
    return np.rint(x).astype(np.int32)


def luma(a, b, c):
    return 0.2126 * a + 0.7152 * b + 0.0722 * c


def lerp(a, b, w):
    return a + (b - a) * w


def smoothstep(e0, e1, x):
    t = clip((x - e0) / np.maximum(e1 - e0, 1e-12))
    return np.where(e1 <= e0, np.where(x >= e1, 1.0, 0.0), t * t * (3.0 - 2.0 * t))


def second(a, b, c):
    return np.maximum(np.maximum(np.minimum(a, b), np.minimum(a, c)), np.minimum(b, c))


def of_key(star, a, b, c):
    return np.where(star == 0, a, np.where(star == 1, b, c))


def others(star, a, b, c):
    return np.where(star == 0, np.maximum(b, c), np.where(star == 1, np.maximum(a, c), np.maximum(a, b)))


def star_of(r, g, b):
    return np.where((r >= g) & (r >= b), 0, np.where(g >= b, 1, 2))


def hsv(r, g, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    high, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    delta = (high - low).astype(float)
    safe = np.maximum(delta, 1.0)
    degrees = np.where(high == r, 60.0 * (g - b) / safe, np.where(high == g, 120.0 + 60.0 * (b - r) / safe, 240.0 + 60.0 * (r - g) / safe))
    degrees = np.where(delta == 0, 0.0, degrees)
    return rint(np.where(degrees < 0, degrees + 360.0, degrees) / 2.0) % 180, rint(255.0 * delta / np.maximum(high.astype(float), 1.0)), high


# --- the screen ----------------------------------------------------------------------------------


class Terms:
    """key_terms of pixels (r, g, b) and a screen (kr, kg, kb)."""

    def __init__(self, rgb, key):
        self.p, self.q = [c / 255.0 for c in rgb], [clip(c / 255.0, 1e-4, 1.0) for c in key]
        self.star = star_of(*key)
        self.dom = np.maximum(np.maximum(self.q[0], self.q[1]), self.q[2]) - second(*self.q)
        self.lead = of_key(self.star, *self.p) - others(self.star, *self.p)

    def chroma(self):
        ptot, qtot = (np.maximum(c[0] + c[1] + c[2], 1e-4) for c in (self.p, self.q))
        r, g, b = (p / ptot - q / qtot for p, q in zip(self.p, self.q, strict=True))
        return np.sqrt(r * r + g * g + b * b)


def probability(rgb, key, s: Settings) -> np.ndarray:
    tol, soft = max(0.015, s.tolerance), max(0.015, s.softness)
    t = Terms(rgb, key)
    (hue, sat, _), (khue, ksat, _) = hsv(*rgb), hsv(*key)
    turn = np.abs(hue - khue)
    score = np.minimum(turn, 180 - turn) / 90.0 + 0.18 * np.abs(sat - ksat) / 255.0
    chroma = 1.0 - smoothstep(tol, tol + 2.15 * soft, t.chroma())
    hue_like = 1.0 - smoothstep(1.35 * tol, 1.35 * tol + 2.8 * soft, score)
    bright = 1.0 - smoothstep(max(0.04, s.brightness_tolerance), max(0.06, s.brightness_tolerance + 2 * soft), np.abs(luma(*t.p) - luma(*t.q)))
    dom_like = smoothstep(0.015, np.maximum(0.05, 0.9 * t.dom), t.lead)
    led = np.maximum(clip(0.48 * chroma + 0.32 * hue_like + 0.20 * bright), dom_like * (0.82 + 0.18 * bright))
    return rint(255.0 * clip(np.where(t.dom > 0.12, led, 0.68 * chroma + 0.22 * hue_like + 0.10 * bright)))


def spill(rgb, key) -> np.ndarray:
    t = Terms(rgb, key)
    plum, qlum = luma(*t.p), luma(*t.q)
    q = [c - qlum for c in t.q]
    qnorm = np.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2])
    along = ((t.p[0] - plum) * q[0] + (t.p[1] - plum) * q[1] + (t.p[2] - plum) * q[2]) / np.maximum(qnorm, 1e-4)
    lead = np.maximum(t.lead, 0.0) / np.maximum(of_key(t.star, *t.p), 1 / 255)
    return np.where(t.dom > 0.12, clip(lead), np.where(qnorm < 1e-4, 0.0, clip(along)))


def median(values: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Of values (place, image) where use; not a number where nothing is."""
    n = use.sum(axis=0)
    told = np.sort(np.where(use, values.astype(float), np.inf), axis=0)
    pick = lambda i: np.take_along_axis(told, np.clip(i, 0, len(told) - 1)[None], axis=0)[0]
    return np.where(n > 0, 0.5 * pick((n - 1) // 2) + 0.5 * pick(n // 2), np.nan)


def screened(rgb, key, s: Settings) -> list[np.ndarray]:
    """The screen as sampled from each image's border: matte.border, screen_color and auto_color."""
    if not s.auto_border_sample:
        return list(key)
    h, w = rgb[0].shape[:2]
    width = min(max(1, s.border_sample_width, s.sample_size), max(1, h // 2), max(1, w // 2))
    y, x = np.mgrid[:h, :w]
    on = (y < width) | (y >= h - width) | (x < width) | (x >= w - width)
    rgb = [c[on] for c in rgb]
    t, total = Terms(rgb, key), len(rgb[0])
    near = (t.chroma() <= max(0.05, s.tolerance + 2 * s.softness)) & ((t.dom <= 0.12) | (t.lead > np.maximum(0.015, 0.2 * t.dom)))
    n, mid = near.sum(axis=0), [median(c, near) for c in rgb]
    far = lambda m: np.sqrt((m[0] - key[0]) ** 2 + (m[1] - key[1]) ** 2 + (m[2] - key[2]) ** 2)
    use = (n >= max(16, total // 80)) & (far(mid) <= 110.0)
    out = [rint(np.where(use, 0.7 * np.nan_to_num(m) + 0.3 * c, c)) for m, c in zip(mid, key, strict=True)]
    if not s.auto_detect_key_color:
        return out
    hue, sat, val = hsv(*rgb)
    usable, images = (sat >= 48) & (val >= 42), hue.shape[1]
    at, weight = (np.arange(images) * 180 + hue)[usable], (sat * np.maximum(val, 1))[usable]
    top = np.bincount(at, weight, images * 180).reshape(images, 180).argmax(axis=1)
    turn = np.abs(hue - top)
    close = usable & (np.minimum(turn, 180 - turn) <= 7)
    mid = [median(c, close) for c in rgb]
    use = (usable.sum(axis=0) >= max(24, total // 160)) & (close.sum(axis=0) >= max(16, total // 220)) & (np.max(mid, axis=0) - np.min(mid, axis=0) >= 28.0)
    blend = far(mid) < 55.0
    return [np.where(use, rint(np.nan_to_num(np.where(blend, 0.85 * m + 0.15 * c, m))), o) for m, c, o in zip(mid, key, out, strict=True)]


# --- neighbourhoods ------------------------------------------------------------------------------


def _wide(mask: np.ndarray, k: int) -> np.ndarray:
    out = mask.copy()
    for j in range(1, k + 1):
        out[:, j:] |= mask[:, :-j]
        out[:, :-j] |= mask[:, j:]
    return out


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """Where the mask has a pixel under an ellipse; what lies beyond the image is not looked for."""
    if radius < 1:
        return mask
    h, w = mask.shape[:2]
    wide, out = {}, np.zeros_like(mask)
    for dy, k in ellipse(radius).items():
        if abs(dy) < h:
            k = min(k, w - 1)
            wide[k] = wide[k] if k in wide else _wide(mask, k)
            out[max(0, -dy) : min(h, h - dy)] |= wide[k][max(0, dy) : min(h, h + dy)]
    return out


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    return ~dilate(~mask, radius)


def border_connected(mask: np.ndarray) -> np.ndarray:
    """The mask's components (eight neighbours) that touch the border."""
    seen = np.zeros_like(mask)
    for edge in (np.s_[0], np.s_[-1], np.s_[:, 0], np.s_[:, -1]):
        seen[edge] = mask[edge]
    while True:
        side = _wide(seen, 1)
        grown = side.copy()
        grown[1:] |= side[:-1]
        grown[:-1] |= side[1:]
        grown &= mask
        if np.array_equal(grown, seen):
            return seen
        seen = grown


def gaussian(a: np.ndarray, kernel: int) -> np.ndarray:
    if kernel <= 1:
        return a
    sigma, r = max(0.2, kernel / 5), kernel // 2
    weights = [math.exp(-j * j / (2 * sigma * sigma)) for j in range(r + 1)]
    total = weights[0] + 2 * sum(weights[1:])
    for axis in (1, 0):
        n = a.shape[axis]
        at = np.arange(n)

        def side(j, a=a, axis=axis, n=n, at=at):
            place = at + j
            mirrored = -place if j < 0 else 2 * (n - 1) - place
            place = np.where((place >= 0) & (place < n), place, mirrored)
            return np.take(a, np.where((place >= 0) & (place < n), place, at), axis=axis)

        out = weights[0] / total * a
        for j in range(1, r + 1):
            out = out + weights[j] / total * (side(-j) + side(j))
        a = out
    return a


def box(a: np.ndarray, radius: int, rows: slice, cols: slice) -> np.ndarray:
    """Sums over (2r+1)**2 pixels around rows and cols; beyond the border the nearest pixel counts. Exact for whole numbers."""

    def counts(n: int, told: slice) -> np.ndarray:
        out = np.zeros((told.stop - told.start, n))
        for i, row in enumerate(out):
            np.add.at(row, np.clip(np.arange(told.start + i - radius, told.start + i + radius + 1), 0, n - 1), 1.0)
        return out

    h, w, n = a.shape
    lines = (counts(h, rows) @ a.reshape(h, w * n)).reshape(-1, w, n)
    return np.matmul(counts(w, cols), lines)


def screen_map(rgb, key, known: np.ndarray, radius: int, rows: slice, cols: slice) -> list[np.ndarray]:
    n = box(known.astype(float), radius, rows, cols)
    return [rint(np.where(n > 0, box(np.where(known, c, 0.0), radius, rows, cols) / np.maximum(n, 1.0), k.astype(float))) for c, k in zip(rgb, key, strict=True)]


def nearest(seeds: np.ndarray, rows: slice, cols: slice) -> tuple[np.ndarray, np.ndarray]:
    """For pixels of rows and cols, the place y * w + x of the nearest seed and its squared distance, ties by (y, x); -1
    without a seed."""
    h, w, _ = seeds.shape
    size = h * w
    kind, far = (np.int32, 1 << 30) if (h * h + w * w + 1) * size < 1 << 29 else (np.int64, 1 << 61)
    x = np.arange(w, dtype=kind)[:, None]
    none = 4 * w
    left = np.maximum.accumulate(np.where(seeds, x, kind(-none)), axis=1)[:, cols]
    right = np.minimum.accumulate(np.where(seeds, x, kind(none))[:, ::-1], axis=1)[:, ::-1][:, cols]
    x = x[cols]
    before, after = x - left, right - x
    dx = np.minimum(before, after)
    line = np.where(dx < w, dx * dx * kind(size) + np.where(before <= after, left, right) + np.arange(h, dtype=kind)[:, None, None] * kind(w), kind(far))
    y = np.arange(rows.start, rows.stop, dtype=kind)
    best = np.full((len(y), *line.shape[1:]), far, kind)
    for sy in range(h):
        np.minimum(best, line[sy] + ((y - sy) ** 2 * size)[:, None, None], out=best)
    none = best >= far
    return np.where(none, -1, best % size), np.where(none, far, best // size)


# --- the matte -----------------------------------------------------------------------------------


def interior(prob: np.ndarray, s: Settings) -> np.ndarray:
    """Background by colour: what connects to the border, and with aggressive removal what is very likely the screen."""
    on = prob >= s.thresholds[0]
    if s.erode_expand:
        on = (dilate if s.erode_expand > 0 else erode)(on, abs(s.erode_expand))
    seen = border_connected(on)
    return seen | (prob >= round(s.aggressive_threshold * 255)) if s.aggressive_interior_removal else seen


def merged_masks(of: np.ndarray, a: Arrays, s: Settings) -> np.ndarray:
    return np.where(a["keep"] > 127, False, np.where(a["remove"] > 127, True, np.where((a["hint"] >= 0) & (a["hint"] >= s.alpha_hint_foreground_threshold), False, of)))


def finished(a: Arrays, background: np.ndarray, s: Settings) -> Arrays:
    """trimap_alpha and original_alpha: background, edge and alpha of images with prob, keep, remove, hint (-1 where there is
    none) and a0 (not a number where there is none)."""
    prob, keep, hint = a["prob"], a["keep"] > 127, a["hint"]
    bg255, fg255 = s.thresholds
    r, soft, kernel = s.edge_radius, max(0.0, s.edge_softness), s.blur_kernel()
    edge = (dilate(background, r) & ~erode(background, r)) | ((prob > fg255) & (prob < bg255) & dilate(background, max(1, 2 * r)))
    fg = max(0.0, min(0.92, max(0.0, fg255 / 255 + (s.core_strength - 0.5) * 0.08)) - 0.02 * soft)
    bg = min(1.0, bg255 / 255 + 0.02 * soft)
    levels = 1.0 - smoothstep(fg, bg, np.arange(256) / 255.0)
    if abs(max(0.05, s.matte_gamma) - 1) > 1e-3:
        levels = levels ** (1 / max(0.05, s.matte_gamma))
    rough = np.where(edge, levels[prob], np.where(background, 0.0, 1.0))
    blend = min(0.55, 0.45 * soft) if kernel > 1 else 0.0
    smooth = np.where(edge, lerp(rough, gaussian(rough, kernel), blend), rough)
    exact = np.where(smooth < 0.004, 0.0, np.where(smooth > 0.996, 1.0, smooth))
    exact = np.where(~background & (~edge | (prob <= fg255)), 1.0, np.where(background & (~edge | (prob >= bg255)), 0.0, exact))
    alpha = np.where(keep, 255, rint(255.0 * exact))
    k = min(1.0, max(0.0, s.alpha_hint_strength))
    if k:
        raised = rint(np.maximum(alpha.astype(float), alpha * (1 - k) + hint * k))
        allowed = (hint >= 0) & (hint >= s.alpha_hint_minimum_alpha) & ~background
        alpha = np.where(allowed, np.where(hint >= s.alpha_hint_foreground_threshold, np.maximum(raised, hint), raised), alpha)
    core = (hint >= 0) & (hint >= max(s.alpha_hint_foreground_threshold, s.alpha_hint_minimum_alpha)) & ~background & (alpha >= 248) if s.alpha_hint_strength > 0 else False
    alpha = np.where(keep, 255, np.where(a["remove"] > 127, 0, alpha))
    given = ~np.isnan(a["a0"])
    alpha = np.where(given, rint(alpha * clip(np.where(given, a["a0"], 0.0))), alpha)
    return {"background": background, "edge": edge & ~(keep | core), "alpha": alpha}


def fringe(a: Arrays, rgb, key, s: Settings) -> np.ndarray:
    alpha, share, edge = a["alpha"], a["alpha"] / 255.0, a["edge"].astype(float)
    near = dilate((alpha > 2) & (alpha < 253), s.fringe_band_radius)
    band = np.where((alpha > 1) & (near | a["edge"]), 1.0, 0.0)
    rim = np.maximum(np.maximum(4.0 * share * (1.0 - share), 0.55 * edge), 0.35 * band)
    weight = np.maximum(smoothstep(0.02, 0.5, spill(rgb, key)), a["prob"] / 255.0 * (1.0 - share) * 0.75)
    return rint(255.0 * clip(band * rim * weight))


def seeds(a: Arrays, s: Settings) -> np.ndarray:
    return (a["alpha"] >= 250) & ~a["background"] & (a["fringe"] <= 24) & (a["prob"] <= seed_limit(s))


# --- colours -------------------------------------------------------------------------------------


def toned(a: Arrays, rgb, screen, near, s: Settings) -> Arrays:
    """or, og, ob and despill of pixels with alpha, fringe, edge and prob; near is the nearest inner colour, less than 0 where
    there is none. Pixels that nothing is spilled on keep their colour, so the others alone are worked out."""
    lum = s.edge_color_repair * (0.25 + 0.75 * s.decontaminate)
    share = a["alpha"] / 255.0
    live = share > 0.001
    es = np.maximum(4.0 * share * (1.0 - share), 0.35 * a["edge"])
    fr = np.where(live, a["fringe"] / 255.0, 0.0)
    legacy = np.where(live, clip(np.maximum(es, a["prob"] / 255.0 * (1.0 - share))) * s.despill, 0.0)
    spilled = np.maximum(legacy, fr * max(s.despill, lum))
    out = [np.where(live, c, 0) for c in rgb]
    at = np.flatnonzero(live & (spilled > 0))
    if len(at):
        told = lambda c: c.reshape(-1)[at]
        share, fr, legacy, spilt = told(share), told(fr), told(legacy), told(spilled)
        light = [LINEAR[told(c)] for c in rgb]
        t = [LINEAR[told(np.broadcast_to(c, live.shape))] for c in screen]
        w = fr * (s.unmix_amount * lum)
        u = [lerp(x, clip((x - (1.0 - share) * y) / np.maximum(share, 0.06)), w) for x, y in zip(light, t, strict=True)]
        vw = clip(1.5 * np.maximum(fr * s.despill, 0.4 * legacy) * s.fringe_remove)
        star, dom, tl, ul = star_of(*t), np.maximum(np.maximum(t[0], t[1]), t[2]) - second(*t), luma(*t), luma(*u)
        over = np.maximum(of_key(star, *u) - others(star, *u), 0.0)
        k = [c - tl for c in t]
        tn = np.maximum(np.sqrt(k[0] * k[0] + k[1] * k[1] + k[2] * k[2]), 1e-4)
        along = np.maximum(((u[0] - ul) * k[0] + (u[1] - ul) * k[1] + (u[2] - ul) * k[2]) / tn, 0.0)
        clamped = [clip(np.where(dom > 0.12, x - np.where(star == i, over * vw, 0.0), x - y / tn * along * vw * 0.70)) for i, (x, y) in enumerate(zip(u, k, strict=True))]
        if near is not None:
            near = [told(c) for c in near]
            pull = fr * (s.inner_color_pull * lum)
            clamped = [np.where(c < 0, x, lerp(x, LINEAR[c], pull)) for x, c in zip(clamped, near, strict=True)]
        ll, wl = luma(*light), luma(*clamped)
        scale = np.where(wl <= 1e-4, 1.0, clip(ll / np.maximum(wl, 1e-4), 0.70, 1.45))
        for o, x in zip(out, clamped, strict=True):
            x = clip(lerp(x, clip(x * scale), spilt * s.protect))
            o.reshape(-1)[at] = rint(255.0 * np.where(x <= 0.0031308, x * 12.92, 1.055 * np.power(x, 1 / 2.4) - 0.055))
    return {"or": out[0], "og": out[1], "ob": out[2], "despill": rint(255.0 * clip(spilled))}


def picked(rgb, place: np.ndarray) -> list[np.ndarray]:
    """The colours at places y * w + x of each pixel's image, -1 where the place is."""
    h, w, n = rgb[0].shape
    at = np.maximum(place, 0) * n + np.arange(n)
    return [np.where(place < 0, -1, c.reshape(-1)[at]) for c in rgb]


def screen(a: Arrays, rgb, key, s: Settings, radius: int) -> list[np.ndarray]:
    """key_image.screen of whole images, with its gate."""
    if not s.local_screen_model:
        return list(key)
    known = a["prob"] >= s.thresholds[0]
    h, w, _ = known.shape
    use = known.reshape(h * w, -1).sum(axis=0) / float(h * w) >= 0.01
    return [np.where(use, c, k) for c, k in zip(screen_map(rgb, key, known, radius, slice(0, h), slice(0, w)), key, strict=True)]


def near_of(a: Arrays, rgb, s: Settings, reach: int | None = None) -> list[np.ndarray] | None:
    """The nearest inner colours of whole images, at any distance or within reach."""
    if not s.nearest_radius:
        return None
    h, w, _ = a["fringe"].shape
    place, d2 = nearest(seeds(a, s), slice(0, h), slice(0, w))
    none = a["fringe"] <= 0 if reach is None else (a["fringe"] <= 0) | (d2 > reach * reach)
    return picked(rgb, np.where(none, -1, place))


def coloured(a: Arrays, rgb, key, s: Settings, radius: int, reach: int | None = None) -> Arrays:
    """or, og, ob and despill of whole images with fringe."""
    return toned(a, rgb, screen(a, rgb, key, s, radius), near_of(a, rgb, s, reach), s)


def coloured_tiles(a: Arrays, rgb, key, s: Settings, tile: int, near, overlap: int | None, radius: int, most: int, least: int) -> Arrays:
    """key_image.coloured_tiles: near is the image's nearest colours, or None where each tile (reading at most `most` pixels,
    with `least` seeds) looks for its own."""
    h, w, n = a["fringe"].shape
    local = s.local_screen_model and h * w > s.max_local_screen_model_pixels
    overlap = v.overlap_of(s, v.extra_overlap(s, radius if local else 0, s.nearest_radius if near is None else 0)) if overlap is None else overlap
    whole = None if local else screen(a, rgb, key, s, radius)
    sown = seeds(a, s) if s.nearest_radius and near is None else None
    out = {c: np.empty((h, w, n), np.int32) for c in ("or", "og", "ob", "despill")}
    for y in range(0, h, tile):
        for x in range(0, w, tile):
            core = np.s_[y : min(h, y + tile), x : min(w, x + tile)]
            read = np.s_[max(0, y - overlap) : min(h, core[0].stop + overlap), max(0, x - overlap) : min(w, core[1].stop + overlap)]
            rows, cols = (slice(c.start - r.start, c.stop - r.start) for c, r in zip(core, read, strict=True))
            cells = [c[read] for c in rgb]
            shown = screen_map(cells, key, a["background"][read], radius, rows, cols) if local else [np.broadcast_to(c, (h, w, n))[core] for c in whole]
            own = None
            if near is not None:
                own = [c[core] for c in near]
            elif sown is not None:
                ends = [c.start - r.start for c, r in zip(core, read, strict=True) if c.start > 0] + [r.stop - c.stop for c, r, m in zip(core, read, (h, w), strict=True) if c.stop < m]
                bound = min([s.nearest_radius, *[m for m in ends if m > 0]])
                area = (read[0].stop - read[0].start) * (read[1].stop - read[1].start)
                looks = 1 <= area <= most and not (core == read == np.s_[0:h, 0:w])
                place, d2 = nearest(sown[read], rows, cols)
                few = sown[read].sum(axis=(0, 1)) < least
                own = picked_in(cells, np.where((a["fringe"][core] <= 0) | few | (d2 > bound * bound) | (not looks), -1, place))
            made = toned({c: a[c][core] for c in ("alpha", "fringe", "edge", "prob")}, [c[core] for c in rgb], shown, own, s)
            for c, told in made.items():
                out[c][core] = told
    return out


def picked_in(cells, place: np.ndarray) -> list[np.ndarray]:
    return picked([np.ascontiguousarray(c) for c in cells], place)


# --- metrics -------------------------------------------------------------------------------------


def run_diff(one: Arrays, two: Arrays) -> Arrays:
    """views.run_diff by image."""
    h, w, n = one["alpha"].shape
    alpha = np.abs(one["alpha"] - two["alpha"]).max(axis=(0, 1))
    rgb = np.max([np.abs(one[c] - two[c]).max(axis=(0, 1)) for c in ("or", "og", "ob")], axis=0)
    return {"alpha_diff": alpha, "rgb_diff": rgb, "rgba_diff": np.maximum(alpha, rgb), "n": np.full(n, h * w, np.int64)}


def in_seam_band(tile: int, shape: tuple[int, int], radius: int = 2) -> np.ndarray:
    """views.seam_band by (y, x)."""
    on = np.zeros(shape, bool)
    for c, n in zip(np.mgrid[: shape[0], : shape[1]], shape, strict=True):
        on |= ((c >= tile) & (c % tile <= radius)) | ((c % tile >= tile - radius) & (c - c % tile + tile < n))
    return on


def seam_metrics(one: Arrays, two: Arrays, band: np.ndarray) -> Arrays:
    """views.seam_metrics by image."""
    y, x = (c[band] for c in np.mgrid[: band.shape[0], : band.shape[1]])
    one, two = ({c: told[band] for c, told in side.items()} for side in (one, two))
    shade = (np.where((y // 18 + x // 18) % 2 == 0, 0.78, 0.92) * 255.0)[:, None]
    over = lambda side, c: np.trunc(side[c] * (side["alpha"] / 255.0) + shade * (1.0 - side["alpha"] / 255.0)).astype(np.int32)
    most = lambda told: np.max(told, axis=0)
    calm = (one["alpha"] >= 250) & (two["alpha"] >= 250) & (one["fringe"] <= 4) & (two["fringe"] <= 4)
    seen = (one["alpha"] > 0) | (two["alpha"] > 0)
    rgb = most([np.abs(one[c] - two[c]) for c in ("or", "og", "ob")])
    alpha = np.abs(one["alpha"] - two["alpha"])
    checker = most([np.abs(over(one, c) - over(two, c)) for c in ("or", "og", "ob")])
    return {
        "boundary_pixels": np.full(rgb.shape[1], len(y), np.int64), "opaque_nonfringe_pixels": calm.sum(axis=0), "visible_pixels": seen.sum(axis=0), "max_alpha_diff": most(alpha),
        "max_rgb_diff_opaque_nonfringe": most(np.where(calm, rgb, 0)), "max_checker_diff_visible": most(np.where(seen, checker, 0)), "max_rgba_diff_boundary": most(np.maximum(rgb, alpha)),
    }
