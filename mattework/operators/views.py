"""Tiles, resampling, view projections and quality metrics, as relations over relations of pixels."""

from __future__ import annotations

from mattework.functions.sql import Dialect, clip, num, of_key, others, u8
from mattework.operators.matte import ROW, add
from mattework.settings import Settings

GRAY = (119, 125, 134)  # the fixed gray of the application's background
ACCENT = (79, 140, 255)  # the fixed divider of the split view


def tile_grid(d: Dialect, images: str, tile: int, overlap: int) -> str:
    """Core and read rectangles of the tiles of images(image_id, h, w)."""
    n = lambda c: f"cast(ceil({c} / {num(tile)}) as int)"
    if d.spark:
        grid = f"SELECT image_id, h, w, ty, explode(sequence(0, {n('w')} - 1)) AS tx FROM (SELECT image_id, h, w, explode(sequence(0, {n('h')} - 1)) AS ty FROM ({images}) i) g"
    else:
        grid = f"SELECT image_id, h, w, ty, unnest(range({n('w')})) AS tx FROM (SELECT image_id, h, w, unnest(range({n('h')})) AS ty FROM ({images}) i) g"
    core = f"SELECT image_id, h, w, cast(ty * {n('w')} + tx as int) AS tile_id, cast(ty * {tile} as int) AS core_y0, cast(least(h, (ty + 1) * {tile}) as int) AS core_y1, cast(tx * {tile} as int) AS core_x0, cast(least(w, (tx + 1) * {tile}) as int) AS core_x1 FROM ({grid}) g"
    return add(core, read_y0=f"greatest(0, core_y0 - {overlap})", read_y1=f"least(h, core_y1 + {overlap})", read_x0=f"greatest(0, core_x0 - {overlap})", read_x1=f"least(w, core_x1 + {overlap})")


def tile_halo(d: Dialect, src: str, tile: int, overlap: int) -> str:
    """Pixels dealt to every tile that reads them: the own one and those within the overlap. No join with a table of
    tiles: a pixel finds its tiles by arithmetic. A tile past the image's end reads pixels, but has no core."""
    reach = list(range(-(-(-overlap // tile)), -(-overlap // tile) + 1))
    own = lambda c: f"cast(floor({c} / {num(tile)}) as int)"
    inside = lambda c, t: f"{t} >= 0 AND {c} >= {t} * {tile} - {overlap} AND {c} < ({t} + 1) * {tile} + {overlap}"
    out = f"SELECT s.*, {own('y')} + dy AS ty, {own('x')} + dx AS tx, dy = 0 AND dx = 0 AS core FROM ({src}) s {d.each(reach, 'dy')} {d.each(reach, 'dx')}"
    return f"SELECT * FROM ({out}) t WHERE {inside('y', 'ty')} AND {inside('x', 'tx')}"


def bounded_radius(radius: int) -> str:
    """The radius, or what a tile reads beyond its core at the side where that is least (of sides within the image)."""
    ends = [(f"core_{c}0 > 0", f"core_{c}0 - read_{c}0") for c in "yx"] + [(f"core_{c}1 < {n}", f"read_{c}1 - core_{c}1") for c, n in zip("yx", "hw", strict=True)]
    margins = ", ".join(f"CASE WHEN {inside} AND {size} > 0 THEN {size} END" for inside, size in ends)
    return f"least({radius}, coalesce(least({margins}), {radius}))"


def can_look(most: int) -> str:
    """Whether a tile may look for nearest colours of its own: it reads something, not too much, and is not the image."""
    whole = " AND ".join(f"{k}_{c}0 <= 0 AND {k}_{c}1 >= {n}" for k in ("read", "core") for c, n in zip("yx", "hw", strict=True))
    return f"cast(read_y1 - read_y0 as bigint) * (read_x1 - read_x0) BETWEEN 1 AND {most} AND NOT ({whole})"


def extra_overlap(s: Settings, screen_radius: int, nearest_radius: int) -> int:
    """Pixels around a tile that its colours can depend on."""
    guided = 2 * max(0, s.guided_radius) + 2 if s.guided_alpha_refine > 0 else 0
    return max(screen_radius, max(0, s.fringe_band_radius), guided, nearest_radius)


def overlap_of(s: Settings, extra: int = 0) -> int:
    return max(s.tile_overlap, 4 * s.edge_radius, extra, 0)


def tile_of(s: Settings, shape: tuple[int, int]) -> int:
    """The side of a tile, 0 for an image that is rendered whole."""
    return max(1, s.tile_size) if s.use_tiling and max(shape) > max(1, s.tile_size) else 0


def resize_area(d: Dialect, src: str, factor: int) -> str:
    return f"SELECT image_id, cast(floor(y / {num(factor)}) as int) AS y, cast(floor(x / {num(factor)}) as int) AS x, {', '.join(d.rint(f'avg({c})') + f' AS {c}' for c in 'rgb')} FROM ({src}) s GROUP BY image_id, floor(y / {num(factor)}), floor(x / {num(factor)})"


def resize_nearest(d: Dialect, src: str, sizes: tuple[int, int], to: tuple[int, int]) -> str:
    """The image of sizes (h, w) at `to`: each new pixel takes the one at floor(new * old / new size)."""
    index = lambda c, old, new: f"cast(floor({c}.i * {num(old)} / {num(new)}) as int)"
    grid = f"SELECT cast(a.i as int) AS ny, cast(b.i as int) AS nx, {index('a', sizes[0], to[0])} AS y, {index('b', sizes[1], to[1])} AS x FROM {d.series(str(to[0]), 'a')} CROSS JOIN {d.series(str(to[1]), 'b')}"
    return f"SELECT image_id, ny AS y, nx AS x, r, g, b FROM ({src}) s JOIN ({grid}) t ON s.y = t.y AND s.x = t.x"


def over(d: Dialect, background: tuple[str, str, str], names: tuple[str, str, str] = ("cr", "cg", "cb"), exact: bool = False, colour: tuple[str, str, str] = ("r", "g", "b")) -> dict[str, str]:
    """A pixel over a background; truncated, or rounded with exact."""
    f = d.rint if exact else d.trunc
    return {n: f(f"{c} * (alpha / 255e0) + {b} * (1e0 - alpha / 255e0)") for n, c, b in zip(names, colour, background, strict=True)}


def checkerboard(d: Dialect, src: str, cell: int = 18) -> str:
    b = f"(CASE WHEN (cast(floor(y / {num(cell)}) as int) + cast(floor(x / {num(cell)}) as int)) % 2 = 0 THEN 0.78e0 ELSE 0.92e0 END * 255e0)"
    return add(src, **over(d, (b, b, b)))


def composite(d: Dialect, src: str, colours: dict[str, tuple[int, int, int]] | None = None, exact: bool = True) -> str:
    """Over plain colours (white, gray and black of the display), one row for each pixel and background; rounded, or cut
    off for comparisons."""
    colours = colours or {"white": (255, 255, 255), "gray": GRAY, "black": (0, 0, 0)}
    shade = {f"b{c}_": "CASE background_name " + " ".join(f"WHEN '{n}' THEN {v[i]}" for n, v in colours.items()) + " END" for i, c in enumerate("rgb")}
    out = add(f"SELECT s.*, background_name FROM ({src}) s {d.each(list(colours), 'background_name')}", **shade)
    return add(out, **over(d, ("br_", "bg_", "bb_"), exact=exact))


#: What composites are compared over. Fixed values.
PLAIN = {"black": (0, 0, 0), "white": (255, 255, 255), "gray": (128, 128, 128)}


def split_compare(d: Dialect, src: str, width: int, source: tuple[str, str, str] = ("r", "g", "b")) -> str:
    """Source on the left, the composite on the right, a divider of two pixels at the middle."""
    out = checkerboard(d, src)
    return add(out, **{f"v{c}": f"CASE WHEN x IN ({width // 2 - 1}, {width // 2}) THEN {accent} WHEN x < {width // 2} THEN {left} ELSE c{c} END" for c, accent, left in zip("rgb", ACCENT, source, strict=True)})


#: Columns that a view shows, of relations with the result r, g, b, the source r0, g0, b0 and the masks.
VIEWS = {
    "Result": ("r", "g", "b"), "Source": ("r0", "g0", "b0"), "Alpha": ("alpha",) * 3, "AI Hint": ("coalesce(hint, 0)",) * 3, "Background Mask": ("255 * background",) * 3,
    "Edge Mask": ("255 * edge",) * 3, "Fringe Mask": ("fringe",) * 3, "Despill Mask": ("despill",) * 3, "Foreground RGB": ("r", "g", "b"), "Split Compare": ("vr", "vg", "vb"),
}


def view(src: str, mode: str) -> str:
    """image_id, y, x, vr, vg, vb as the view shows them."""
    return f"SELECT image_id, y, x, {', '.join(f'cast({e} as int) AS v{c}' for e, c in zip(VIEWS[mode], 'rgb', strict=True))} FROM ({src}) s"


def all_views(d: Dialect, src: str, width: int) -> str:
    """image_id, y, x, mode, red, green, blue of every view, from one pass over the pixels of a result with o*."""
    result = "`or`" if d.spark else '"or"'
    out = f"SELECT image_id, y, x, r AS r0, g AS g0, b AS b0, {result} AS r, og AS g, ob AS b, alpha, hint, background, edge, fringe, despill FROM ({src}) s"
    out = f"SELECT s.*, mode FROM ({split_compare(d, out, width, ('r0', 'g0', 'b0'))}) s {d.each(list(VIEWS), 'mode')}"
    shown = lambda i: "CASE mode " + " ".join(f"WHEN '{n}' THEN {es[i]}" for n, es in VIEWS.items()) + " END"
    return f"SELECT image_id, y, x, mode, {', '.join(f'cast({shown(i)} as int) AS {c}' for i, c in enumerate(('red', 'green', 'blue')))} FROM ({out}) v"


# --- metrics -------------------------------------------------------------------------------------

STAR = "CASE WHEN kr >= kg AND kr >= kb THEN 0 WHEN kg >= kb THEN 1 ELSE 2 END"


def excess(src: str) -> str:
    out = add(src, mstar=STAR)
    return add(out, excess=f"greatest({of_key('mstar', 'r', 'g', 'b')} - {others('mstar', 'r', 'g', 'b')}, 0)")


def edge_key_residual(d: Dialect, src: str) -> str:
    return f"SELECT image_id, count(*) AS n, {d.q('avg(excess)')} AS mean_excess, {d.q(d.percentile('excess', 0.95), 4)} AS p95_excess, max(excess) AS max_excess FROM ({excess(src)}) s WHERE edge = 1 AND alpha > 0 GROUP BY image_id"


def opaque_delta(d: Dialect, src: str) -> str:
    diff = [f"abs({c} - f{c})" for c in "rgb"]
    return f"SELECT image_id, count(*) AS n, max(greatest({', '.join(diff)})) AS max_delta, {d.q(f'sum({" + ".join(diff)}) / (3e0 * count(*))')} AS mean_delta FROM ({src}) s WHERE a_true >= 0.995e0 AND alpha >= 240 GROUP BY image_id"


def soft_band(src: str, low: int = 0, high: int = 255) -> str:
    return f"SELECT image_id, count(*) FILTER (WHERE alpha > {low} AND alpha < {high}) AS soft FROM ({src}) s GROUP BY image_id"


def roughness(d: Dialect, src: str, mask: str = "edge = 1") -> str:
    """Mean step of alpha between neighbours that are both in the mask, along rows and columns."""
    out = add(src, in_mask=f"CASE WHEN {mask} THEN 1 ELSE 0 END")
    pair = lambda axis: f"SELECT image_id, CASE WHEN in_mask = 1 AND lag(in_mask) OVER ({axis}) = 1 THEN abs(alpha - lag(alpha) OVER ({axis})) END AS step FROM ({out}) m"
    return f"SELECT image_id, count(step) AS pairs, {d.q('avg(step)')} AS roughness FROM ({pair(ROW)} UNION ALL {pair('PARTITION BY image_id, x ORDER BY y')}) p GROUP BY image_id"


def transparent_zero(src: str) -> str:
    return f"SELECT image_id, count(*) FILTER (WHERE alpha = 0) AS transparent, max(CASE WHEN alpha = 0 THEN greatest(r, g, b) END) AS max_rgb FROM ({src}) s GROUP BY image_id"


def run_diff(one: str, two: str) -> str:
    """The greatest difference of two results: of their alpha, of their colours, of either."""
    rgb = "greatest(abs(a.r - b.r), abs(a.g - b.g), abs(a.b - b.b))"
    return f"SELECT a.image_id, max(abs(a.alpha - b.alpha)) AS alpha_diff, max({rgb}) AS rgb_diff, max(greatest({rgb}, abs(a.alpha - b.alpha))) AS rgba_diff, count(*) AS n FROM ({one}) a JOIN ({two}) b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x GROUP BY a.image_id"


def composite_error(d: Dialect, src: str, mask: str = "true") -> str:
    """Levels between the result and what is expected (the true foreground f* with the true alpha, 0 where that is
    transparent), both over black, white and middle gray, within the mask."""
    both = add(src, talpha=d.rint(f"255e0 * {clip('a_true')}"))
    both = composite(d, f"SELECT * FROM ({both}) m WHERE {mask}", PLAIN, exact=False)
    want = add(both, **{f"e{c}": d.trunc(f"CASE WHEN talpha = 0 THEN 0 ELSE f{c} END * (talpha / 255e0) + b{c}_ * (1e0 - talpha / 255e0)") for c in "rgb"})
    diff = [f"abs(c{c} - e{c})" for c in "rgb"]
    return f"SELECT image_id, background_name, count(*) AS n, max(greatest({', '.join(diff)})) AS max_error, {d.q(f'sum({" + ".join(diff)}) / (3e0 * count(*))')} AS mean_error FROM ({want}) s GROUP BY image_id, background_name"


def seam_band(tile: int, shape: tuple[int, int], radius: int = 2) -> str:
    """Whether a pixel is within radius of a line between two tiles."""
    radius = max(1, radius)
    after = lambda c: f"({c} >= {tile} AND {c} % {tile} <= {radius})"
    before = lambda c, n: f"({c} % {tile} >= {tile - radius} AND ({c} - {c} % {tile} + {tile}) < {n})"
    return "(" + " OR ".join(f"{after(c)} OR {before(c, n)}" for c, n in zip("yx", shape, strict=True)) + ")"


def seam_metrics(d: Dialect, one: str, two: str, band: str) -> str:
    """How two results with different tiles differ near either's seams."""
    cells = [f"{c}{i}" for i in "12" for c in ("r", "g", "b", "alpha", "fringe")]
    both = f"SELECT a.image_id, a.y, a.x, {', '.join(f'{"a" if c[-1] == "1" else "b"}.{c[:-1]} AS {c}' for c in cells)} FROM ({one}) a JOIN ({two}) b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x"
    out = f"SELECT * FROM ({both}) p WHERE {band}"
    shade = f"(CASE WHEN (cast(floor(y / {num(18)}) as int) + cast(floor(x / {num(18)}) as int)) % 2 = 0 THEN 0.78e0 ELSE 0.92e0 END * 255e0)"
    over_ = lambda c, i: d.trunc(f"{c}{i} * (alpha{i} / 255e0) + {shade} * (1e0 - alpha{i} / 255e0)")
    out = add(out, calm="alpha1 >= 250 AND alpha2 >= 250 AND fringe1 <= 4 AND fringe2 <= 4", seen="alpha1 > 0 OR alpha2 > 0", rgb="greatest(abs(r1 - r2), abs(g1 - g2), abs(b1 - b2))", a_="abs(alpha1 - alpha2)", checker=f"greatest({', '.join(f'abs({over_(c, 1)} - {over_(c, 2)})' for c in 'rgb')})")
    return f"""SELECT image_id, count(*) AS boundary_pixels, count(*) FILTER (WHERE calm) AS opaque_nonfringe_pixels, count(*) FILTER (WHERE seen) AS visible_pixels, max(a_) AS max_alpha_diff,
        coalesce(max(rgb) FILTER (WHERE calm), 0) AS max_rgb_diff_opaque_nonfringe, coalesce(max(checker) FILTER (WHERE seen), 0) AS max_checker_diff_visible, max(greatest(rgb, a_)) AS max_rgba_diff_boundary FROM ({out}) s GROUP BY image_id"""


def metric_bundle(d: Dialect, src: str) -> str:
    """All metrics of a result with truth (a_true, f*), one row an image, in one pass but for the joined groups.

    Classes: background up to 0.002 of true alpha, core from 0.995, soft between. The residual is taken on the soft edge,
    or where there is none on the fringe; composites are compared outside the background."""
    soft_ = "a_true > 0.002e0 AND a_true < 0.995e0"
    out = add(src, is_soft=soft_, is_core="a_true >= 0.995e0", is_back="a_true <= 0.002e0", tstar=STAR)
    out = add(out, key_excess=f"greatest({of_key('tstar', 'r', 'g', 'b')} - {others('tstar', 'r', 'g', 'b')}, 0)", drift="greatest(abs(r - fr), abs(g - fg), abs(b - fb))", drift_sum="abs(r - fr) + abs(g - fg) + abs(b - fb)")
    one = lambda where, name: f"count(*) FILTER (WHERE {where} AND alpha > 0) AS n_{name}, avg(key_excess) FILTER (WHERE {where} AND alpha > 0) AS mean_{name}, {d.percentile('key_excess', 0.95)} FILTER (WHERE {where} AND alpha > 0) AS p95_{name}, max(key_excess) FILTER (WHERE {where} AND alpha > 0) AS max_{name}"
    core = "is_core AND alpha >= 240"
    whole = f"""SELECT image_id, count(*) FILTER (WHERE is_back) AS known_background, count(*) FILTER (WHERE is_core) AS foreground_core, count(*) FILTER (WHERE is_soft) AS soft_edge, {one('is_soft', 's')}, {one('fringe > 0', 'f')},
        count(*) FILTER (WHERE {core}) AS opaque_count, coalesce(max(drift) FILTER (WHERE {core}), 0) AS opaque_max_delta, coalesce(sum(drift_sum) FILTER (WHERE {core}) / (3e0 * nullif(count(*) FILTER (WHERE {core}), 0)), 0e0) AS opaque_mean_delta,
        count(*) FILTER (WHERE alpha > 0 AND alpha < 255) AS alpha_soft, count(*) FILTER (WHERE alpha = 0) AS transparent, coalesce(max(greatest(r, g, b)) FILTER (WHERE alpha = 0), 0) AS transparent_max_rgb FROM ({out}) m GROUP BY image_id"""
    told = lambda name, zero: f"coalesce(CASE WHEN soft_edge > 0 THEN {name}_s ELSE {name}_f END, {zero})"
    over_ = composite_error(d, src, "a_true > 0.002e0")
    wide = f"SELECT image_id, {', '.join(f'coalesce(max({c}) FILTER (WHERE background_name = {n!r}), 0) AS {n}_{c}' for n in PLAIN for c in ('max_error', 'mean_error'))} FROM ({over_}) e GROUP BY image_id"
    return f"""SELECT w.image_id, known_background, foreground_core, soft_edge, {told('n', 0)} AS residual_count, {d.q(told('mean', '0e0'))} AS residual_mean, {d.q(told('p95', '0e0'), 4)} AS residual_p95, {told('max', 0)} AS residual_max,
        opaque_count, opaque_max_delta, {d.q('opaque_mean_delta')} AS opaque_mean_delta, alpha_soft, transparent, transparent_max_rgb, {', '.join(f'coalesce({n}_{c}, 0) AS {n}_{c}' for n in PLAIN for c in ('max_error', 'mean_error'))} FROM ({whole}) w LEFT JOIN ({wide}) c ON w.image_id = c.image_id"""


def content_hash(d: Dialect, src: str, columns: tuple[str, ...]) -> str:
    """A fingerprint of each row of an image, so that no task gathers more than a line of pixels."""
    return f"SELECT image_id, y, {d.sha(d.concat(*columns), 'x')} AS digest FROM ({src}) s GROUP BY image_id, y"


def u8_columns(d: Dialect) -> dict[str, str]:
    return {f"c{c}": u8(d.trunc(f"({c} * 1.7e0 - 60e0)")) for c in "rgb"}


def settings_for_small_frames() -> Settings:
    """Radii that suit frames of a dozen rows; everything else is the default."""
    return Settings(edge_refine_radius=2, fringe_band_radius=1, despeckle_min_area=0, cleanup=0, inner_color_pull=0.45)
