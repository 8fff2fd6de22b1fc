"""Every registered query of the matte engine, with its statement for another engine as the oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mattework.functions import sql as f
from mattework.functions.sql import DUCK, SPARK, Dialect
from mattework.operators import adapters, components, dense, masks
from mattework.operators import matte as m
from mattework.operators import views as v
from mattework.plans import key_image as k
from mattework.plans import viewport as vp
from mattework.plans.stages import parts_for, stage
from mattework.settings import Settings, preset
from mattework.sources import fixtures
from mattework.sources import rasters as s

TABLES = ("part", "embeddings", "lineitem", "events")
S = v.settings_for_small_frames()
PX = "image_id, y, x"


def pick(src: str, columns: str) -> str:
    return f"SELECT {columns} FROM ({src}) picked"


def soft(d: Dialect) -> str:
    """Frames with their true alpha as alpha, the key as screen, and the masks that the colour steps read."""
    out = m.add(s.frames(d), alpha=d.rint("255e0 * a_true"), background="CASE WHEN a_true <= 0.002e0 THEN 1 ELSE 0 END", edge="CASE WHEN a_true > 0.002e0 AND a_true < 0.995e0 THEN 1 ELSE 0 END", sr="kr", sg="kg", sb="kb", nr="fr", ng="fg", nb="fb")
    out = m.probability(d, out, S)
    out = pick(out, "image_id, y, x, r, g, b, kr, kg, kb, a_true, a0, keep, remove, hint, fr, fg, fb, alpha, background, edge, sr, sg, sb, nr, ng, nb, prob")
    return m.fringe(d, m.spill(out), S)


def lit(d: Dialect) -> str:
    """Frames with prob, and the pixels at or above the threshold as background."""
    return m.add(m.probability(d, s.frames(d), S), background=f"CASE WHEN prob >= {S.thresholds[0]} THEN 1 ELSE 0 END")


def colours(d: Dialect, upto: str) -> str:
    out = m.weights(m.linear_light(d, soft(d)), S)
    for name, step in (("u", lambda o: m.unmix(o, S)), ("v", lambda o: m.vlahos(o, S)), ("w", lambda o: m.pull(d, o, S)), ("o", lambda o: m.protect(d, o, S))):
        out = step(out)
        if name == upto:
            break
    return out


def quantised(d: Dialect, upto: str) -> str:
    return pick(colours(d, upto), f"{PX}, " + ", ".join(d.rint(f"{upto}{c} * 4095e0") + f" AS {c}" for c in "rgb"))


PLAIN: dict[str, Callable[[Dialect], str]] = {
    "frames_scan": lambda d: pick(s.frames(d), f"{PX}, r, g, b, kr, kg, kb, {d.rint('1000e0 * a_true')} AS a1000, keep, remove, hint"),
    "embed_raster_scan": lambda d: s.embed_raster(d),
    "density_raster": lambda d: s.density_raster(d),
    "events_raster": lambda d: s.events_raster(d),
    "crop_filter": lambda d: pick(s.frames(d), f"{PX}, r, g, b") + " WHERE x >= 3 AND x < 11 AND y >= 2 AND y < 9",
    "mask_level": lambda d: pick(s.frames(d), f"{PX}, {masks.mask_level(d, 'a_true', 'float', '1')} AS fraction, {masks.mask_level(d, 'a_true * 300e0 - 20e0', 'float')} AS level, {masks.mask_level(d, 'r * 2 - 100', 'int')} AS whole, {masks.mask_level(d, '(keep > 127)', 'bool')} AS kept"),
    "ensure_u8": lambda d: pick(m.add(s.embed_raster(d), **v.u8_columns(d)), f"{PX}, cr, cg, cb"),
    "rgb_to_hsv": lambda d: pick(s.embed_raster(d), f"{PX}, " + ", ".join(f"{e} AS {n}" for e, n in zip(f.hsv(d, "r", "g", "b"), ("hue", "sat", "val"), strict=True))),
    "smoothstep": lambda d: pick(s.frames(d), f"{PX}, {d.rint('10000e0 * ' + f.ss(0.2, 0.9, 'r / 255e0'))} AS up, {d.rint('10000e0 * ' + f.ss(0.5, 0.5, 'g / 255e0'))} AS step"),
    "screen_probability": lambda d: pick(m.probability(d, s.frames(d), S), f"{PX}, prob"),
    "screen_probability_custom_key": lambda d: pick(m.probability(d, f"SELECT *, 120 AS kr, 128 AS kg, 116 AS kb FROM ({s.embed_raster(d)}) e", S), f"{PX}, prob"),
    "spill_strength": lambda d: pick(m.spill(s.frames(d)), f"{PX}, {d.rint('10000e0 * spill')} AS spill"),
    "srgb_linear_lut": lambda d: pick(m.add(s.embed_raster(d), lin=f.linear(d, "r")), f"{PX}, {d.rint('65535e0 * lin')} AS linear, {f.to_srgb(d, 'lin')} AS back"),
    "linear_luma": lambda d: pick(s.frames(d), f"{PX}, {d.rint('65535e0 * ' + f.luma(*(f.linear(d, c) for c in 'rgb')))} AS luma"),
    "original_alpha_mul": lambda d: pick(s.frames(d), f"{PX}, CASE WHEN a0 IS NULL THEN 200 ELSE {d.rint('200 * greatest(0e0, least(1e0, a0))')} END AS alpha"),
    "border_pixels": lambda d: pick(m.border(s.frames(d), 2), f"{PX}, r, g, b"),
    "border_candidates": lambda d: pick(m.candidates(m.border(s.frames(d), 2), S), f"{PX}, candidate"),
    "sample_screen_color": lambda d: m.screen_color(d, m.border(s.frames(d), 2), S),
    "auto_hue_histogram": lambda d: m.hue_histogram(d, m.border(s.frames(d), 2)),
    "auto_screen_color": lambda d: m.auto_color(d, m.border(s.frames(d), 2)),
    "pick_patch_median": lambda d: f"SELECT image_id, {', '.join(d.trunc(f'median(cast({c} as double))') + f' AS {c}' for c in 'rgb')} FROM ({s.frames(d)}) p WHERE y BETWEEN 4 AND 8 AND x BETWEEN 6 AND 10 GROUP BY image_id",
    "mask_bounds": lambda d: f"SELECT image_id, greatest(0, min(y) - 2) AS y0, least({s.HEIGHT}, max(y) + 3) AS y1, greatest(0, min(x) - 2) AS x0, least({s.WIDTH}, max(x) + 3) AS x1 FROM ({s.frames(d)}) p WHERE a_true > 0.5e0 GROUP BY image_id",
    "known_share_gate": lambda d: f"SELECT image_id, round(avg(cast(background as double)), 6) AS known, avg(cast(background as double)) >= 0.01e0 AS use_map FROM ({lit(d)}) p GROUP BY image_id",
    "box_filter_replicate": lambda d: pick(m.box(s.embed_raster(d), ["r", "g"], 3), f"{PX}, cast(r_box as bigint) AS r_box, cast(g_box as bigint) AS g_box"),
    "dilate_ellipse": lambda d: pick(m.morph(m.add(s.embed_raster(d), on_="CASE WHEN r > 190 THEN 1 ELSE 0 END"), "on_", 3, "grown"), f"{PX}, grown"),
    "erode_ellipse": lambda d: pick(m.morph(m.add(s.embed_raster(d), on_="CASE WHEN r > 70 THEN 1 ELSE 0 END"), "on_", 2, "shrunk", dilate=False), f"{PX}, shrunk"),
    "gaussian_alpha": lambda d: pick(m.gaussian(m.add(s.embed_raster(d), c_="r / 255e0"), "c_", 5, "soft"), f"{PX}, {d.rint('10000e0 * soft')} AS soft"),
    "guided_filter": lambda d: pick(m.guided(s.embed_raster(d), "r / 255e0", "g / 255e0", 2, 1e-3), f"{PX}, {d.rint('10000e0 * guided')} AS guided"),
    "screen_map_local": lambda d: pick(m.screen_map(d, lit(d), f"prob >= {S.thresholds[0]}", 3), f"{PX}, sr, sg, sb"),
    "mask_merge": lambda d: pick(m.merged_masks(pick(lit(d), "image_id, y, x, keep, remove, hint, background AS chroma"), S, "chroma", "background"), f"{PX}, background"),
    "trimap_edge": lambda d: pick(m.trimap(lit(d), S), f"{PX}, background, edge"),
    "alpha_from_trimap": lambda d: pick(m.alpha(d, m.trimap(lit(d), S), S), f"{PX}, alpha0 AS alpha"),
    "alpha_hint_merge": lambda d: pick(m.alpha_hint(d, lit(d), replace(S, alpha_hint_strength=0.6), "90", "alpha"), f"{PX}, alpha"),
    "guided_alpha_refine": lambda d: pick(m.guided(soft(d), f.luma(*(f.linear(d, c) for c in "rgb")), "alpha / 255e0", 2, 1e-3), f"{PX}, CASE WHEN edge = 1 AND alpha > 0 AND alpha < 255 THEN {d.rint('255e0 * ' + f.lerp('alpha / 255e0', 'guided', '0.8e0'))} ELSE alpha END AS alpha"),
    "fringe_mask": lambda d: pick(soft(d), f"{PX}, fringe"),
    "inner_seeds": lambda d: pick(m.seeds(soft(d), S), PX),
    "unmix": lambda d: quantised(d, "u"),
    "vlahos_clamp": lambda d: quantised(d, "v"),
    "inner_pull": lambda d: quantised(d, "w"),
    "protect_luminance": lambda d: pick(colours(d, "o"), f'{PX}, "or" AS r, og AS g, ob AS b') if not d.spark else pick(colours(d, "o"), f"{PX}, `or` AS r, og AS g, ob AS b"),
    "despill_mask": lambda d: pick(m.weights(m.linear_light(d, soft(d)), S), f"{PX}, {d.rint('255e0 * legacy')} AS despill"),
    "tile_grid": lambda d: v.tile_grid(d, f"SELECT p_partkey AS image_id, cast(12 + p_size as int) AS h, cast(16 + p_size * 2 as int) AS w FROM {d.table('part')}", 20, 4),
    "tile_halo": lambda d: f"SELECT image_id, ty, tx, count(*) AS read_px, count(*) FILTER (WHERE core) AS core_px FROM ({v.tile_halo(d, s.embed_raster(d), 16, 4)}) t GROUP BY image_id, ty, tx",
    "tile_crop_prune": lambda d: f"SELECT image_id, tile_id FROM ({v.tile_grid(d, f'SELECT p_partkey AS image_id, 48 AS h, cast(40 + p_size as int) AS w FROM {d.table("part")}', 16, 4)}) t WHERE core_x0 < 30 AND core_x1 > 10 AND core_y0 < 20 AND core_y1 > 5",
    "tile_count": lambda d: f"SELECT image_id, count(*) AS tiles FROM ({v.tile_grid(d, f'SELECT p_partkey AS image_id, cast(20 + p_size as int) AS h, 64 AS w FROM {d.table("part")}', 16, 4)}) t GROUP BY image_id",
    "resize_area": lambda d: v.resize_area(d, s.frames(d), 2),
    "resize_area_any": lambda d: vp.resize_area_any(d, s.frames(d), (s.HEIGHT, s.WIDTH), (7, 11)),
    "proxy_shape": lambda d: vp.proxy_sql(d, f"SELECT p_partkey AS image_id, cast(600 + p_size * 37 as int) AS h, cast(900 + p_partkey % 1700 as int) AS w FROM {d.table('part')}", 1800),
    "visible_crop": lambda d: vp.crop_sql(d, f"SELECT p_partkey AS image_id, cast(200 + p_size * 37 as int) AS h, cast(250 + p_partkey % 1700 as int) AS w, cast(100 + p_partkey % 1500 as int) AS view_h, cast(150 + p_partkey % 1900 as int) AS view_w, p_partkey % 1777 / 2e0 AS cx, p_size * 21 / 2e0 AS cy FROM {d.table('part')}"),
    "resize_nearest": lambda d: v.resize_nearest(d, s.frames(d), (s.HEIGHT, s.WIDTH), (9, 24)),
    "display_to_full": lambda d: pick(s.frames(d), f"{PX}, {d.rint('y / 0.37e0')} AS full_y, {d.rint('x / 0.37e0')} AS full_x"),
    "checkerboard": lambda d: pick(v.checkerboard(d, soft(d), 5), f"{PX}, cr, cg, cb"),
    "composite_solid": lambda d: pick(v.composite(d, soft(d)), f"{PX}, background_name, cr, cg, cb"),
    "split_compare": lambda d: pick(v.split_compare(d, soft(d), s.WIDTH), f"{PX}, vr, vg, vb"),
    "view_mask_rgb": lambda d: v.view(soft(d), "Fringe Mask"),
    "view_all_modes": lambda d: v.all_views(d, colours(d, "o"), s.WIDTH),
    "composite_truncated": lambda d: pick(v.composite(d, soft(d), v.PLAIN, exact=False), f"{PX}, background_name, cr, cg, cb"),
    "metric_bundle": lambda d: v.metric_bundle(d, soft(d)),
    "border_stride": lambda d: pick(m.border(s.frames(d), 2, most=20), f"{PX}, r, g, b"),
    "gaussian_wide": lambda d: pick(m.gaussian(m.add(s.embed_raster(d), c_="r / 255e0"), "c_", 13, "soft"), f"{PX}, {d.rint('10000e0 * soft')} AS soft"),
    "screen_tile": lambda d: pick(k.by_owner(d, lambda c: m.screen_map(d, c, "background = 1", 2), k.tiles_of(d, lit(d), 5, 3)), "owner, gy, gx, ty, tx, core, sr, sg, sb"),
    "tile_bounded_radius": lambda d: f"SELECT image_id, tile_id, {v.bounded_radius(24)} AS radius, {v.can_look(900)} AS can_look FROM ({v.tile_grid(d, f'SELECT p_partkey AS image_id, cast(12 + p_size as int) AS h, cast(16 + p_size * 2 as int) AS w FROM {d.table("part")}', 20, 9)}) t",
    "point_lookup": lambda d: pick(soft(d), f"{PX}, r, g, b, alpha") + " WHERE y = 6 AND x = 8",
    "edge_key_residual": lambda d: v.edge_key_residual(d, soft(d)),
    "opaque_delta": lambda d: v.opaque_delta(d, soft(d)),
    "soft_band_count": lambda d: v.soft_band(soft(d), 35, 220),
    "edge_roughness": lambda d: v.roughness(d, soft(d)),
    "transparent_zero": lambda d: v.transparent_zero(f"SELECT image_id, alpha, CASE WHEN alpha = 0 THEN 0 ELSE r END AS r, CASE WHEN alpha = 0 THEN 0 ELSE g END AS g, CASE WHEN alpha = 0 THEN 0 ELSE b END AS b FROM ({soft(d)}) q"),
    "composite_error": lambda d: v.composite_error(d, soft(d)),
    "fringe_sample_argmax": lambda d: f"SELECT image_id, y, x, excess FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY excess DESC, y, x) AS nth FROM ({v.excess(soft(d))}) e WHERE alpha > 35 AND alpha < 225 AND fringe > 70 AND excess > 18) t WHERE nth = 1",
    "content_hash": lambda d: v.content_hash(d, s.frames(d), ("r", "g", "b")),
    "mask_runs": lambda d: components.runs_sql(f"SELECT image_id, y, x FROM ({s.embed_raster(d)}) e WHERE r > 150"),
    "mask_classes": lambda d: f"SELECT image_id, CASE WHEN a_true <= 0.002e0 THEN 'background' WHEN a_true >= 0.995e0 THEN 'core' ELSE 'soft' END AS class, count(*) AS n FROM ({s.frames(d)}) p GROUP BY image_id, CASE WHEN a_true <= 0.002e0 THEN 'background' WHEN a_true >= 0.995e0 THEN 'core' ELSE 'soft' END",
}

DENSE = "r > 150"
SPARSE = "r > 200"
HOLES = "r <= 200"


def _embed(spark: SparkSession) -> DataFrame:
    return spark.sql(s.embed_raster(SPARK))


def _areas(spark: SparkSession) -> DataFrame:
    runs = components.labelled(_embed(spark), SPARSE)
    return runs.groupBy("image_id", "label").agg(F.max("area").alias("area"), F.max("border").alias("border"))


SHAPE = (s.HEIGHT, s.WIDTH)
#: Where a session keeps the number of partitions that its frames are dealt to.
PARTS = "mattework.frames.parts"


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get(PARTS))


def nominal(d: Dialect) -> str:
    """Frames whose key is only nominal, so that the screen has to be sampled."""
    return f"SELECT {d.without('kr', 'kg', 'kb')}, 0 AS kr, 220 AS kg, 50 AS kb FROM ({s.frames(d)}) f"


def whole(spark: SparkSession) -> bool:
    """Whether each row of part has a key of its own, so that each makes an image that is whole."""
    keys = spark.table(f"{SPARK.table('part')}_keys").groupBy("p_partkey").count()
    return keys.where("count > 1 OR p_partkey IS NULL").isEmpty()


def _result(spark: SparkSession, settings: Settings = S, sampled: bool = False) -> DataFrame:
    if k.covers(settings, SHAPE) and whole(spark):
        out = k.key_packed(spark, spark.sql(nominal(SPARK) if sampled else s.frames(SPARK)), settings, SHAPE, parts(spark), sampled)
    else:
        out = _by_pixels(spark, settings, sampled)
    return out.select("image_id", "y", "x", F.col("or").alias("r"), F.col("og").alias("g"), F.col("ob").alias("b"), "alpha", "background", "edge", "fringe", "despill", "prob")


def _by_pixels(spark: SparkSession, settings: Settings, sampled: bool) -> DataFrame:
    pixels = k.screened(spark, stage(spark.sql(nominal(SPARK)), "frames", parts(spark)), settings) if sampled else spark.sql(s.frames(SPARK))
    return k.key_frames(spark, pixels, settings, SHAPE, parts(spark))


def _mattes(spark: SparkSession, settings: Settings = S) -> DataFrame:
    """For queries that return no colours."""
    return k.mattes(spark, spark.sql(s.frames(SPARK)), settings, parts(spark))


def _duck_result(settings: Settings = S, sampled: bool = False) -> str:
    columns = 'image_id, y, x, "or" AS r, og AS g, ob AS b, alpha, background, edge, fringe, despill, prob'
    pixels = k.screened_sql(DUCK, nominal(DUCK), settings) if sampled else s.frames(DUCK)
    matte = pick(k.with_alpha(DUCK, "SELECT * FROM lit", settings), MATTE)
    near = f"SELECT * FROM ({m.nearest(DUCK, m.fringe(DUCK, m.spill('SELECT * FROM matte'), settings), settings, 1000)}) n" if settings.nearest_radius else None
    return f"{k.duck_connected(DUCK, pixels, settings)}, matte AS MATERIALIZED ({matte}) {pick(k.coloured(DUCK, 'SELECT * FROM matte', settings, SHAPE, near), columns)}"


def _keyed(settings: Settings, sampled: bool = True) -> tuple[Callable[[SparkSession], DataFrame], str]:
    return lambda spark: _result(spark, settings, sampled), _duck_result(settings, sampled)


def _nearest(radius: int) -> tuple[Callable[[SparkSession], DataFrame], str]:
    """Seeds and targets are looked up in one staged relation, so what makes it runs once."""
    needed = f"{PX}, alpha, background, fringe, prob"

    def run(spark: SparkSession) -> DataFrame:
        marked = stage(spark.sql(pick(soft(SPARK), needed)), "marked", parts(spark))
        return k._sql(spark, m.nearest(SPARK, "SELECT * FROM {src}", S, radius), marked)

    return run, f"WITH marked AS MATERIALIZED ({pick(soft(DUCK), needed)}) {m.nearest(DUCK, 'SELECT * FROM marked', S, radius)}"


MATTE = "image_id, y, x, r, g, b, kr, kg, kb, prob, background, edge, alpha, hint, a_true, fr, fg, fb"
SHOWN = 'image_id, y, x, "or" AS r, og AS g, ob AS b, alpha, fringe, despill'
#: Tiles each with its own screen; frames are small, so their screens are taken within two pixels.
TILED = replace(S, max_local_screen_model_pixels=1, tile_overlap=3, edge_refine_radius=1)
NEAR_SCREEN = 2


def _matte(spark: SparkSession) -> DataFrame:
    """A matte without components, for what is done to mattes: background is the probable screen."""
    return stage(spark.sql(pick(k.original_alpha(SPARK, k.trimap_alpha(SPARK, lit(SPARK), S)), MATTE)), "matte", parts(spark))


def _tiles(d: Dialect, matte: str, tile: int, settings: Settings, near: str | None) -> str:
    out = k.coloured_tiles(d, matte, settings, SHAPE, tile, near, radius=NEAR_SCREEN)
    return pick(out, SHOWN.replace('"or"', "`or`") if d.spark else SHOWN)


def _whole(d: Dialect, matte: str, settings: Settings) -> str:
    return pick(k.coloured(d, matte, settings, SHAPE), SHOWN.replace('"or"', "`or`") if d.spark else SHOWN)


def _on_matte(build: Callable[[Dialect, str], str]) -> tuple[Callable[[SparkSession], DataFrame], str]:
    """A statement over the relation of mattes, which is staged in Spark."""
    matte = f"WITH matte AS MATERIALIZED ({pick(k.original_alpha(DUCK, k.trimap_alpha(DUCK, lit(DUCK), S)), MATTE)}) "
    return lambda spark: k._sql(spark, build(SPARK, "SELECT * FROM {src}"), _matte(spark)), matte + build(DUCK, "SELECT * FROM matte")


def _on_images(step: Callable[[dense.Arrays, list, list], dense.Arrays], columns: str, build: Callable[[Dialect, str], str], pixels: bool = False) -> tuple[Callable[[SparkSession], DataFrame], str]:
    """build's statement over mattes; in Spark, where images are whole, the same by step over packed mattes."""
    by_rows, oracle = _on_matte(build)

    def run(spark: SparkSession) -> DataFrame:
        if not (k.covers(S, SHAPE) and whole(spark)):
            return by_rows(spark)
        return k.by_images(k.packed_mattes(spark, spark.sql(s.frames(SPARK)), S, SHAPE, parts(spark)), lambda *a: step(*a), SHAPE, columns, pixels)

    return run, oracle


def _dense_tiles(a: dense.Arrays, rgb: list, key: list, settings: Settings, tile: int, near: list | None, **told) -> dense.Arrays:
    a["fringe"] = dense.fringe(a, rgb, key, settings)
    out = dense.coloured_tiles(a, rgb, key, settings, tile, near, told.get("overlap"), told.get("radius", NEAR_SCREEN), k.TILE_PIXELS, k.TILE_SEEDS)
    return out | {"alpha": a["alpha"], "fringe": a["fringe"]}


def _dense_near(a: dense.Arrays, rgb: list, key: list) -> list:
    return dense.near_of(a | {"fringe": dense.fringe(a, rgb, key, S)}, rgb, S, S.nearest_radius)


def _dense_local(a: dense.Arrays, rgb: list, key: list) -> dense.Arrays:
    return _dense_tiles(a, rgb, key, TILED, 5, None)


def _dense_diff(a: dense.Arrays, rgb: list, key: list) -> dense.Arrays:
    radius = k.screen_radius(*SHAPE)
    two = _dense_tiles(a, rgb, key, S, 5, _dense_near(a, rgb, key), overlap=3, radius=radius)
    return dense.run_diff(dense.coloured(a, rgb, key, S, radius, S.nearest_radius) | {"alpha": a["alpha"]}, two)


def _dense_seams(a: dense.Arrays, rgb: list, key: list) -> dense.Arrays:
    near = _dense_near(a, rgb, key)
    band = dense.in_seam_band(5, SHAPE) | dense.in_seam_band(7, SHAPE)
    return dense.seam_metrics(*(_dense_tiles(a, rgb, key, TILED, tile, near) for tile in (5, 7)), band)


#: What these return, as Spark's names and kinds.
SHOWN_KINDS = "image_id long, y int, x int, or int, og int, ob int, alpha int, fringe int, despill int"
DIFF_KINDS = "image_id long, alpha_diff int, rgb_diff int, rgba_diff int, n long"
SEAM_KINDS = "image_id long, boundary_pixels long, opaque_nonfringe_pixels long, visible_pixels long, max_alpha_diff int, max_rgb_diff_opaque_nonfringe int, max_checker_diff_visible int, max_rgba_diff_boundary int"


def _shown(made: tuple, where: str = "true") -> tuple[Callable[[SparkSession], DataFrame], str]:
    run, oracle = made
    return lambda spark: run(spark).withColumnsRenamed({"or": "r", "og": "g", "ob": "b"}).where(where), oracle


def _global_near(d: Dialect, matte: str) -> str:
    return m.nearest(d, m.fringe(d, m.spill(matte), S), S)


def _tiled_vs_full(d: Dialect, matte: str) -> str:
    """Rendered whole and by tiles of five pixels that read three beyond, both from the image's own maps."""
    one = pick(k.coloured(d, matte, S, SHAPE, _global_near(d, matte)), SHOWN.replace('"or"', "`or`") if d.spark else SHOWN)
    two = pick(k.coloured_tiles(d, matte, S, SHAPE, 5, _global_near(d, matte), overlap=3), SHOWN.replace('"or"', "`or`") if d.spark else SHOWN)
    return v.run_diff(one, two)


def _seams(d: Dialect, matte: str) -> str:
    """Tiles of five and of seven pixels, each with its own screen, near either's seams."""
    near = _global_near(d, matte)
    band = f"{v.seam_band(5, SHAPE)} OR {v.seam_band(7, SHAPE)}"
    return v.seam_metrics(d, _tiles(d, matte, 5, TILED, near), _tiles(d, matte, 7, TILED, near), band)


def masked(d: Dialect) -> str:
    """Frames beside which a mask of half the size stands: (image_id, y, x, mask)."""
    return f"SELECT image_id, y, x, CASE WHEN (x + y + image_id) % 3 = 0 THEN 255 ELSE (x * 31 + y) % 128 END AS mask FROM ({s.frames(d, 6, 8)}) f WHERE image_id % 2 = 0"


def _imported(spark: SparkSession) -> DataFrame:
    pixels = stage(spark.sql(pick(s.frames(SPARK), f"{PX}, keep")), "pixels", parts(spark))
    return masks.with_mask(pixels, spark.sql(masked(SPARK)), "keep").select(*PX.split(", "), "keep")


def _fixtures(spark: SparkSession) -> DataFrame:
    """Metrics of frames with known truth, a sixth of their size, keyed with the default settings."""
    pixels = stage(fixtures.disc_frames(spark, 6.0), "fixtures")
    shape = (120, 160)
    out = k.key_frames(spark, k.screened(spark, pixels.drop("island"), Settings()), Settings(), shape)
    out = stage(out.select("image_id", "y", "x", F.col("or").alias("r"), F.col("og").alias("g"), F.col("ob").alias("b"), "alpha", "fringe", "a_true", "fr", "fg", "fb", "kr", "kg", "kb"), "keyed")
    return k._sql(spark, v.metric_bundle(SPARK, "SELECT * FROM {src}"), out)


#: Queries that need more than one statement in Spark: (Spark, oracle or None).
SPECIAL: dict[str, tuple[Callable[[SparkSession], DataFrame], str | None]] = {
    "border_connected": (lambda spark: components.border_connected(_embed(spark), DENSE), components.reach_sql(s.embed_raster(DUCK), DENSE, components.BORDER_SEED) + " SELECT * FROM reach"),
    "component_areas": (_areas, components.labels_sql(s.embed_raster(DUCK), SPARSE) + " SELECT image_id, label, max(area) AS area, bool_or(border) AS border FROM comp GROUP BY image_id, label"),
    "remove_small_components": (lambda spark: components.remove_small(_embed(spark), SPARSE, 3), components.labels_sql(s.embed_raster(DUCK), SPARSE) + " SELECT image_id, y, x FROM comp WHERE area >= 3 OR border"),
    "fill_small_holes": (lambda spark: components.fill_holes(_embed(spark), HOLES, 3), components.labels_sql(s.embed_raster(DUCK), f"NOT ({HOLES})") + f" SELECT image_id, y, x FROM px WHERE {HOLES} UNION ALL SELECT image_id, y, x FROM comp WHERE area < 3 AND NOT border"),
    "aggressive_interior": (
        lambda spark: _mattes(spark, replace(S, aggressive_interior_removal=True)).select("image_id", "y", "x", "background"),
        k.duck_connected(DUCK, s.frames(DUCK), S) + " " + pick(m.merged_masks(m.add("SELECT * FROM lit", interior=f"greatest(connected, CASE WHEN prob >= {round(S.aggressive_threshold * 255)} THEN 1 ELSE 0 END)"), S, "interior", "background"), f"{PX}, background"),
    ),
    "key_image_rgba": _keyed(S, sampled=False),
    "key_image_sampled": _keyed(S),
    "key_image_auto": _keyed(replace(S, auto_detect_key_color=True, border_sample_width=3, sample_size=1)),
    "key_image_high_accuracy": _keyed(replace(preset("High Accuracy"), auto_detect_key_color=True)),
    "key_image_expanded": _keyed(replace(S, erode_expand=1, edge_softness=0.2)),
    "key_image_summary": (
        lambda spark: _mattes(spark).groupBy("image_id").agg(F.count_if(F.col("alpha") == 0).alias("transparent"), F.count_if((F.col("alpha") > 0) & (F.col("alpha") < 255)).alias("soft"), F.count_if(F.col("alpha") == 255).alias("opaque")),
        f"SELECT image_id, count(*) FILTER (WHERE alpha = 0) AS transparent, count(*) FILTER (WHERE alpha > 0 AND alpha < 255) AS soft, count(*) FILTER (WHERE alpha = 255) AS opaque FROM ({_duck_result()}) r GROUP BY image_id",
    ),
    "nearest_inner": _nearest(32),
    "nearest_inner_bounded": _nearest(3),
    "tiled_vs_full": _on_images(_dense_diff, DIFF_KINDS, _tiled_vs_full),
    "tile_seam_band": _on_images(_dense_seams, SEAM_KINDS, _seams),
    "tile_local_render": _shown(_on_images(_dense_local, SHOWN_KINDS, lambda d, matte: _tiles(d, matte, 5, TILED, None), True)),
    "tile_local_crop": _shown(_on_images(_dense_local, SHOWN_KINDS, lambda d, matte: f"SELECT * FROM ({_tiles(d, matte, 5, TILED, None)}) t WHERE x >= 3 AND x < 13 AND y >= 4 AND y < 11", True), "x >= 3 AND x < 13 AND y >= 4 AND y < 11"),
    "global_screen_render": _on_matte(lambda d, matte: _whole(d, matte, replace(S, local_screen_model=False))),
    "mask_import": (_imported, f"SELECT p.image_id, p.y, p.x, cast(coalesce(mask, keep) as int) AS keep FROM ({s.frames(DUCK)}) p LEFT JOIN ({masked(DUCK)}) q ON p.image_id = q.image_id AND p.y // 2 = q.y AND p.x // 2 = q.x"),
    "fixture_metrics": (_fixtures, None),
    "adapter_matte": (
        lambda spark: adapters.plugin_mattes(spark.sql(pick(s.frames(SPARK), f"{PX}, r, g, b, hint")), "mattework.operators.adapters:luma_matte"),
        pick(s.frames(DUCK), f"{PX}, coalesce(hint, 0) AS alpha, r AS fr, g AS fg, b AS fb, r AS pr, g AS pg, b AS pb, coalesce(hint, 0) AS pa"),
    ),
    "adapter_hint": (lambda spark: adapters.generate_hints(spark.sql(pick(s.frames(SPARK), f"{PX}, r, g, b")), "mattework.operators.adapters:luma_hint", seam=adapters.PLAIN), pick(s.frames(DUCK), f"{PX}, {DUCK.trunc('(r + g + b) / 3e0 / 255e0 * 255e0')} AS hint")),
}


def register(spark: SparkSession, sf_dir: str) -> None:
    """The tables as views. Rows of part become frames of pixels: they are dealt by their key first, so that every core
    makes frames, each frame's lines are already together, and no task sorts more than it can hold."""
    for name in TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "part":
            spark.conf.set(PARTS, parts_for(spark, table.count(), SHAPE))
            table.select("p_partkey").createOrReplaceTempView(f"{SPARK.table(name)}_keys")
            table = table.select("p_partkey", "p_size", "p_retailprice").repartition(parts(spark), "p_partkey")
        table.createOrReplaceTempView(SPARK.table(name))


def _plain(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        return spark.sql(build(SPARK))

    return run


def _special(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        return make(spark)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _plain(b) for n, b in PLAIN.items()} | {n: _special(make) for n, (make, _) in SPECIAL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: b(DUCK) for n, b in PLAIN.items()} | {n: text for n, (_, text) in SPECIAL.items() if text}
