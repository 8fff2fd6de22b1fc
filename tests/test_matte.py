"""Every query of the matte engine against its oracle in another engine, and helper assertions."""

from dataclasses import replace

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from mattework.functions import sql as f
from mattework.operators import adapters, components, masks
from mattework.operators import matte as m
from mattework.operators import views as v
from mattework.operators.matte import ellipse
from mattework.plans import catalog, jobs
from mattework.plans import key_image as k
from mattework.plans.stages import stage
from mattework.sources import fixtures
from mattework.settings import Settings, normalized_crop, odd_kernel, preset

SF = "/root/testdata/sf0.001"
ORACLE = catalog.oracle_sql()


def rows(values):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_oracle(spark, name):
    got = catalog.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]}) o" if not ORACLE[name].lstrip().upper().startswith("WITH") else ORACLE[name])
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(tuple(r[i] for i in order) for r in want.fetchall())


def test_settings():
    with pytest.raises(ValueError):
        Settings(mode="other")
    assert Settings().thresholds == (199, 36) and Settings().min_area == 48 and Settings().edge_radius == 6
    assert preset("High Accuracy").key_color == (30, 80, 235) and preset("Fast").despill == 0.70
    assert odd_kernel(0.605) == 3 and ellipse(1) == {-1: 0, 0: 1, 1: 0}
    assert normalized_crop((-5, 0, 10, 99), 8, 6) == (0, 0, 8, 6)
    with pytest.raises(ValueError):
        normalized_crop((9, 0, 12, 4), 8, 6)


def test_linear_round_trip(spark):
    got = spark.sql(f"SELECT id, {f.to_srgb(f.SPARK, f.linear(f.SPARK, 'id'))} AS back FROM range(256)").collect()
    assert all(abs(r.id - r.back) <= 1 for r in got)


def test_reports_on_models(monkeypatch, tmp_path):
    bare = adapters.report(adapters.HINT, "")
    assert not bare.available and adapters.HINT.setting in bare.missing_settings and adapters.HINT.model_setting in bare.missing_settings and "torch" in bare.message
    assert adapters.report(adapters.PLUGIN, " a:b ").available and not adapters.report(adapters.PLUGIN).available
    monkeypatch.setenv("MATTE_PLUGIN_ADAPTER", "some.module")
    assert adapters.report(adapters.PLUGIN).adapter == "some.module"
    needs_model = replace(adapters.HINT, packages=())
    assert not adapters.report(needs_model, "a:b", str(tmp_path / "none")).available and adapters.report(needs_model, "a:b", str(tmp_path)).available
    assert adapters.model_function(adapters.PLAIN, "mattework.operators.adapters:luma_hint") is adapters.luma_hint
    assert adapters.model_function(replace(adapters.PLAIN, attribute="luma_hint"), "mattework.operators.adapters") is adapters.luma_hint
    with pytest.raises(TypeError):
        adapters.model_function(adapters.PLAIN, "mattework.operators.adapters:MAX_SIDE")


def test_planes_of_models():
    told = lambda v, n=1, shape=(1, 2): adapters.levels(v, shape, n, "plane")[..., 0].tolist()
    assert told([[True, False]]) == [[255, 0]] and told([[0.5, 1.0]]) == [[127, 255]] and told([[0.5, 2.9]]) == [[0, 2]]
    assert told([[float("nan"), float("inf")]]) == [[0, 255]] and told([[-4, 300]]) == [[0, 255]]
    assert told([[[1, 2, 3, 4], [5, 6, 7, 8]]]) == [[4, 8]] and told([[[1, 2, 3], [5, 6, 7]]]) == [[1, 5]]
    for bad in ([[1, 2]], None):
        with pytest.raises(ValueError):
            told(bad, 1, (2, 2))
    with pytest.raises(ValueError):
        told([[[1, 2, 3], [4, 5, 6]]], 4)
    assert adapters.answer({"alpha": 3}, "alpha_hint", "alpha") == 3 and adapters.answer(7, "alpha") == 7 and adapters.answer({}, "alpha") is None


def test_plugin(spark):
    rows = [(i, y, x, 10 * i, y, x, 7 * x) for i in (1, 2) for y in range(2) for x in range(3)]
    pixels = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, hint int")
    got = adapters.plugin_mattes(pixels, "mattework.operators.adapters:luma_matte").collect()
    assert sorted(tuple(r) for r in got) == sorted((i, y, x, h, r, g, b, r, g, b, h) for i, y, x, r, g, b, h in rows)
    with pytest.raises(RuntimeError):
        adapters.plugin_mattes(pixels, "")


GREEN, RED = (0, 220, 50), (200, 30, 30)
SMALL = Settings(edge_refine_radius=1, despeckle_min_area=0, cleanup=0, fringe_band_radius=1)


def frame(spark, colour, side=14, key=GREEN):
    """Pixels of one frame, coloured by (y, x), the key as its screen."""
    rows = [(1, y, x, *colour(y, x), *key, None, 0, 0, None) for y in range(side) for x in range(side)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, kr int, kg int, kb int, a0 double, keep int, remove int, hint int")


def keyed(spark, pixels, s, column="background"):
    return {(r.y, r.x): r[column] for r in k.key_frames(spark, pixels, s, (14, 14)).select("y", "x", column).collect()}


def test_key_frames_erodes_and_expands(spark):
    pixels = frame(spark, lambda y, x: RED if 5 <= y <= 8 and 5 <= x <= 8 else GREEN)
    found = {e: keyed(spark, pixels, replace(SMALL, erode_expand=e)) for e in (-1, 0, 1)}
    assert [found[e][4, 6] for e in (-1, 0, 1)] == [0, 1, 1] and [found[e][5, 6] for e in (-1, 0, 1)] == [0, 0, 1]


def test_key_frames_clears_specks_after_the_merges(spark):
    pixels = frame(spark, lambda y, x: GREEN if y in (0, 13) or x in (0, 13) or (y, x) in {(6, 6), (6, 7)} else RED)
    hot = replace(SMALL, aggressive_interior_removal=True)
    found = [keyed(spark, pixels, s)[6, 6] for s in (SMALL, hot, replace(hot, aggressive_min_area=3), replace(hot, despeckle_min_area=3))]
    assert found == [0, 1, 0, 0]


def test_key_frames_refines_alpha(spark):
    mixed = tuple((a + b) // 2 for a, b in zip(GREEN, RED))
    pixels = frame(spark, lambda y, x: GREEN if x < 6 else mixed if x == 6 and y % 3 else RED)
    plain, guided, capped = (keyed(spark, pixels, replace(SMALL, **g), "alpha") for g in ({}, {"guided_alpha_refine": 1.0, "guided_radius": 2}, {"guided_alpha_refine": 1.0, "guided_max_pixels": 1}))
    assert plain != guided and plain == capped and all(guided[p] == a for p, a in plain.items() if a in (0, 255))


def test_screen_is_sampled_from_the_border(spark):
    pixels = frame(spark, lambda y, x: RED if 5 <= y <= 8 and 5 <= x <= 8 else (0, 200, 60))
    key = lambda s: {(r.kr, r.kg, r.kb) for r in k.screened(spark, pixels, s).select("kr", "kg", "kb").collect()}
    s = replace(SMALL, border_sample_width=2)
    assert key(s) == {(0, 206, 57)} and key(replace(s, auto_border_sample=False)) == {GREEN}
    assert key(replace(s, auto_detect_key_color=True)) == {(0, 203, 58)}


def test_nearest_seed_at_any_distance(spark):
    seeds = {(1, y, x) for y in range(3) for x in range(4)} | {(1, 2, 60), (2, 0, 0)}
    targets = {(1, 0, 9), (1, 2, 31), (1, 2, 32), (1, 1, 90), (2, 3, 79), (3, 0, 5)}
    rows = [(i, y, x, 255 if (i, y, x) in seeds else 100, 0, 90 if (i, y, x) in targets else 0, 0) for i in (1, 2, 3) for y in range(4) for x in range(92)]
    marked = spark.createDataFrame(rows, "image_id long, y int, x int, alpha int, background int, fringe int, prob int")
    assert SMALL.nearest_radius == 8
    got = {(r.image_id, r.y, r.x): (r.ny, r.nx) for r in k.nearest_seeds(spark, marked, SMALL).collect()}
    want = {(i, y, x): min(((y - b) ** 2 + (x - c) ** 2, b, c) for j, b, c in seeds if j == i)[1:] for i, y, x in targets if i < 3}
    assert got == want


# --- values worked out by hand, or by arrays, from the definitions ---------------------------------


def pixels_of(spark, rows, columns):
    return spark.createDataFrame([(1, *r) for r in rows], "image_id long, y int, x int, " + columns)


def ran(spark, text, src):
    return k._sql(spark, text, src)


def test_spill_by_hand(spark):
    """A green key: lead by level. Without a lead: what lies along the key once luma is taken off; nothing for gray."""
    green = pixels_of(spark, [(0, 0, 51, 204, 102, 0, 220, 50), (0, 1, 200, 90, 100, 0, 220, 50)], "r int, g int, b int, kr int, kg int, kb int")
    assert [round(r.spill, 6) for r in ran(spark, m.spill("SELECT * FROM {src}"), green).orderBy("x").collect()] == [0.5, 0.0]
    weights = np.array([0.2126, 0.7152, 0.0722])
    rows = [(0, 0, 255, 0, 255, 128, 110, 130), (0, 1, 40, 200, 60, 128, 110, 130), (0, 2, 9, 9, 9, 77, 77, 77)]
    got = [r.spill for r in ran(spark, m.spill("SELECT * FROM {src}"), pixels_of(spark, rows, "r int, g int, b int, kr int, kg int, kb int")).orderBy("x").collect()]
    for (_, _, *v), spill in zip(rows, got):
        pixel, key = np.array(v[:3]) / 255, np.array(v[3:]) / 255
        key = key - key @ weights
        norm = np.linalg.norm(key)
        assert abs(spill - (0 if norm < 1e-4 else np.clip((pixel - pixel @ weights) @ key / norm, 0, 1))) < 1e-9
    assert got[0] > 0.3 and got[1] == 0 and got[2] == 0


def test_auto_colour_needs_enough_pixels(spark):
    """24 saturated pixels at least, and 16 in the cluster."""
    row = lambda i, c: (0, i, *c, 0, 220, 50)
    gray, blue, red = (90, 90, 90), (20, 40, 230), (230, 30, 20)
    for colours, found in (([blue] * 23 + [gray] * 100, 0), ([blue] * 24 + [gray] * 100, 1), ([blue] * 15 + [red] * 15, 0), ([blue] * 16 + [red] * 15, 1), ([blue] * 24 + [gray] * 5000, 0)):
        src = pixels_of(spark, [row(i, c) for i, c in enumerate(colours)], "r int, g int, b int, kr int, kg int, kb int")
        got = ran(spark, m.auto_color(f.SPARK, "SELECT * FROM {src}"), src).collect()
        assert len(got) == found and all((r.sr, r.sg, r.sb) == blue for r in got)


def test_border_is_strided_in_order(spark):
    h, w, bw = 7, 9, 2
    order = [(y, x) for y in range(bw) for x in range(w)] + [(y, x) for y in range(h - bw, h) for x in range(w)]
    order += [(y, x) for y in range(bw, h - bw) for x in range(bw)] + [(y, x) for y in range(bw, h - bw) for x in range(w - bw, w)]
    src = spark.createDataFrame([(1, y, x) for y in range(h) for x in range(w)], "image_id long, y int, x int")
    for most in (len(order), 20, 7):
        step = max(1, len(order) // most) if len(order) > most else 1
        got = {(r.y, r.x) for r in ran(spark, m.border("SELECT * FROM {src}", bw, most), src).collect()}
        assert got == set(order[::step])


@pytest.mark.parametrize("stripe", [1, 3, 7, 256])
def test_components_across_stripes(spark, stripe):
    """Random masks, a spiral, a comb and an empty mask, against a flood fill."""
    rng = np.random.default_rng(stripe)
    spiral, comb = np.zeros((15, 15), bool), np.zeros((15, 15), bool)
    for i in range(1, 14, 4):  # squares, each open to the next
        spiral[i, 1:14] = True
    spiral[1:14, 13], comb[1:14, 1:14:2], comb[13, 1:14] = True, True, True
    grids = [rng.random((23, 19)) < 0.4, rng.random((8, 31)) < 0.3, spiral, comb, np.zeros((9, 9), bool), ~comb]
    pixels = spark.createDataFrame([(n, y, x, int(g[y, x])) for n, g in enumerate(grids) for y in range(g.shape[0]) for x in range(g.shape[1])], "image_id long, y int, x int, v int")
    want = set()
    for n, g in enumerate(grids):
        h, w = g.shape
        left = {(int(y), int(x)) for y, x in np.argwhere(g)}
        while left:
            todo, whole = [left.pop()], []
            while todo:
                y, x = todo.pop()
                whole.append((y, x))
                near = {(y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1)} & left
                left -= near
                todo += near
            first, border = min(whole), any(y in (0, h - 1) or x in (0, w - 1) for y, x in whole)
            want |= {(n, y, x, first[0] * 10**6 + first[1], len(whole), border) for y, x in whole}
    got = components.pixels_of(components.labelled(pixels, "v = 1", stripe), "label", "area", "border").select("image_id", "y", "x", "label", "area", "border").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("kernel", [3, 5, 13, 21])
def test_gaussian_mirrors(spark, kernel):
    rng = np.random.default_rng(kernel)
    image = rng.random((14, 12))
    r, sigma = kernel // 2, max(0.2, kernel / 5)
    taps = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma**2))
    taps /= taps.sum()
    want = np.pad(image, r, mode="reflect")
    for axis in (0, 1):
        want = np.apply_along_axis(lambda v: np.convolve(v, taps, "valid"), axis, want)
    src = pixels_of(spark, [(y, x, float(image[y, x])) for y in range(14) for x in range(12)], "v double")
    for row in ran(spark, m.gaussian("SELECT * FROM {src}", "v", kernel, "soft"), src).collect():
        assert abs(row.soft - want[row.y, row.x]) < 1e-9


def test_edges_go_where_pixels_are_kept_or_hinted(spark):
    """(keep, hint, background, alpha) and the edge that is left."""
    cases = [((255, None, 0, 10), 0), ((0, 200, 0, 250), 0), ((0, 200, 0, 240), 1), ((0, 100, 0, 250), 1), ((0, 200, 1, 250), 1), ((0, None, 0, 255), 1)]
    src = pixels_of(spark, [(0, i, *c, 1) for i, (c, _) in enumerate(cases)], "keep int, hint int, background int, alpha1 int, edge int")
    text = lambda s: m.cleared_edge(f.SPARK, "SELECT * FROM {src}", s, "alpha1")
    assert [r.edge for r in ran(spark, text(Settings()), src).orderBy("x").collect()] == [e for _, e in cases]
    assert [r.edge for r in ran(spark, text(Settings(alpha_hint_strength=0.0)), src).orderBy("x").collect()] == [0, 1, 1, 1, 1, 1]


def test_screen_of_a_tile(spark):
    """Known columns at both sides of two levels of green; what none is near takes the fallback."""
    level = lambda x: 220 if x < 5 else 180
    rows = [(y, x, 0, level(x), 50, 1, 2, 3, 1 if x < 3 or x > 7 else 0) for y in range(9) for x in range(11)]
    src = pixels_of(spark, rows, "r int, g int, b int, kr int, kg int, kb int, background int")
    got = {(r.y, r.x): (r.sr, r.sg, r.sb) for r in ran(spark, m.screen_map(f.SPARK, "SELECT * FROM {src}", "background = 1", 2), src).collect()}
    assert all(got[y, x] == (0, 220, 50) for y in range(9) for x in range(5)) and all(got[y, x][1] == 180 for y in range(9) for x in range(6, 11)) and got[4, 5] == (1, 2, 3)


def test_seams_and_radii_of_tiles():
    run = lambda e, **c: duckdb.sql(f"SELECT {e} FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in c.items())})").fetchall()[0][0]
    for y in range(20):
        near = any(abs(y - t) <= 2 for t in range(7, 20, 7))
        assert run(v.seam_band(7, (20, 5)), y=y, x=0) == near, y
    box = {"h": 100, "w": 100, "core_y0": 0, "core_y1": 50, "core_x0": 50, "core_x1": 100, "read_y0": 0, "read_y1": 58, "read_x0": 45, "read_x1": 100}
    assert run(v.bounded_radius(24), **box) == 5 and run(v.bounded_radius(3), **box) == 3 and run(v.can_look(10**6), **box)
    assert not run(v.can_look(100), **box) and run(v.bounded_radius(24), **(box | {"read_x0": 50})) == 8
    whole = {"h": 9, "w": 9, "core_y0": 0, "core_y1": 9, "core_x0": 0, "core_x1": 9, "read_y0": 0, "read_y1": 9, "read_x0": 0, "read_x1": 9}
    assert not run(v.can_look(10**6), **whole) and run(v.bounded_radius(24), **whole) == 24
    assert v.tile_of(Settings(tile_size=100), (50, 100)) == 0 and v.tile_of(Settings(tile_size=100), (50, 101)) == 100 and v.tile_of(Settings(use_tiling=False), (9999, 9999)) == 0
    assert v.extra_overlap(Settings(), 30, 24) == 30 and v.extra_overlap(Settings(guided_alpha_refine=1.0, guided_radius=40), 30, 24) == 82 and v.overlap_of(Settings(tile_overlap=8), 30) == 30


def test_composite_is_cut_off(spark):
    src = pixels_of(spark, [(0, 0, 200, 100, 7, 128, 1.0, 200, 100, 7), (0, 1, 200, 100, 7, 0, 0.0, 50, 50, 50)], "r int, g int, b int, alpha int, a_true double, fr int, fg int, fb int")
    got = {(r.background_name, r.x): (r.cr, r.cg, r.cb) for r in ran(spark, v.composite(f.SPARK, "SELECT * FROM {src}", v.PLAIN, exact=False), src).collect()}
    assert got["gray", 0] == (164, 113, 67) and got["black", 0] == (100, 50, 3) and got["white", 1] == (255, 255, 255)
    errors = {r.background_name: (r.n, r.max_error) for r in ran(spark, v.composite_error(f.SPARK, "SELECT * FROM {src}"), src).collect()}
    assert errors == {"black": (2, 100), "white": (2, 123), "gray": (2, 60)}


def test_tiles_render_what_the_whole_does(spark):
    """A frame of 40 pixels rendered by tiles of 16 from the image's own maps is the whole frame's."""
    def mixed(y, x):
        a = min(1.0, max(0.0, (13 - ((y - 20) ** 2 + (x - 20) ** 2) ** 0.5) / 6))
        return tuple(int(p * a + q * (1 - a)) for p, q in zip((220, 160, 120), (4, 214 + (x + y) % 5, 50)))

    pixels = frame(spark, mixed, side=40, key=(4, 216, 50))
    s = replace(SMALL, tile_size=16, tile_overlap=4)
    matte = stage(k.key_frames(spark, pixels, s, (40, 40)).select("image_id", "y", "x", "r", "g", "b", "kr", "kg", "kb", "prob", "background", "edge", "alpha", "hint"), "matte")
    found = lambda tile, s=s: {(r.y, r.x): (r["or"], r.og, r.ob, r.despill) for r in k.colours(spark, matte, s, (40, 40), tile).select("y", "x", "or", "og", "ob", "despill").collect()}
    whole = found(0)
    assert len(whole) == 1600 and found(16) == whole
    local = found(16, replace(s, max_local_screen_model_pixels=1))
    assert len(local) == 1600 and max(abs(a - b) for p in whole for a, b in zip(whole[p], local[p])) <= 2


def test_masks_join_at_any_size(spark):
    pixels = spark.createDataFrame([(i, y, x, 7) for i in (1, 2) for y in range(6) for x in range(9)], "image_id long, y int, x int, keep int")
    mask = spark.createDataFrame([(1, y, x, 10 * y + x) for y in range(4) for x in range(3)], "image_id long, y int, x int, mask int")
    got = {(r.image_id, r.y, r.x): r.keep for r in masks.with_mask(pixels, mask, "keep").collect()}
    assert got == {(i, y, x): 10 * (y * 4 // 6) + x * 3 // 9 if i == 1 else 7 for i in (1, 2) for y in range(6) for x in range(9)}
    assert {r.hint for r in masks.with_mask(pixels, mask.limit(0), "hint").collect()} == {None}
    assert {r.keep for r in masks.without_mask(pixels, "keep").collect()} == {0}
    with pytest.raises(ValueError):
        masks.with_mask(pixels, mask, "other")


def test_work_in_the_background(spark):
    from concurrent.futures import CancelledError

    done = jobs.Work(spark, lambda: spark.range(1000).selectExpr("sum(id) AS s").first().s)
    assert done.result(60) == 499500 and not done.running and done.progress().done > 0
    slow = lambda: spark.range(4).rdd.map(lambda i: __import__("time").sleep(60)).count()
    latest = jobs.Latest(spark)
    first = latest.ask(slow)
    import time

    while not first.progress().known:
        time.sleep(0.1)
    second = latest.ask(lambda: 5)
    with pytest.raises(CancelledError):
        first.result(60)
    assert second.result(60) == 5


def test_quality_of_frames_with_known_truth(spark):
    """Thresholds, away from the edge band: 98.5 % of the screen at most 8 (flat ones 4), 98.5 % of the core at least
    245 (its middle 248); an island in the screen's colour stays; an antialiased edge stays soft, without a rest of key."""
    s = Settings()
    pixels = stage(fixtures.disc_frames(spark, 6.0), "fixtures")
    out = k.key_frames(spark, k.screened(spark, pixels, s), s, (120, 160)).select("image_id", "y", "x", "alpha", F.col("or").alias("r"), F.col("og").alias("g"), F.col("ob").alias("b"))
    truth = spark.createDataFrame([(i, d.radius / 6, round(d.height / 6), round(d.width / 6)) for i, d in enumerate(fixtures.DISCS)], "image_id long, radius double, h int, w int")
    out = out.join(pixels.select("image_id", "y", "x", "island"), ["image_id", "y", "x"]).join(F.broadcast(truth), "image_id")
    out = out.withColumn("dist", F.expr("sqrt(pow(x - w / 2e0, 2) + pow(y - h / 2e0, 2))"))
    share = lambda where, what: F.avg(F.when(F.expr(where), F.expr(what).cast("int")))
    told = {fixtures.DISCS[r.image_id].name: r for r in out.groupBy("image_id").agg(
        share("dist > radius + 13", "alpha <= 8").alias("gone"), F.max(F.when(F.expr("dist > radius + 13"), F.col("alpha"))).alias("back"), share("dist < radius - 13", "alpha >= 245").alias("kept"),
        F.max(F.when(F.expr("y = h div 2 and x = w div 2"), F.col("alpha"))).alias("middle"), F.min(F.when(F.col("island"), F.col("alpha"))).alias("island"), F.count_if(F.expr("alpha > 35 and alpha < 220")).alias("soft"), F.max(F.when(F.col("alpha") == 0, F.greatest("r", "g", "b"))).alias("dirt")).collect()}
    assert all(r.gone > 0.985 and r.dirt == 0 for r in told.values()) and all(told[n].back <= 4 for n in told if "flat" in n), told
    assert all(told[n].kept > 0.985 and told[n].middle >= 248 for n in told if "fringe" not in n), told
    assert told["green_same_color_island"].island >= 248 and told["green_antialiased_edge"].soft > 900 / 6, told


@pytest.mark.parametrize("batch", [1, 3, 7, 1000])
def test_components_of_many_images_in_batches(batch):
    """Stripes that batches cut anywhere, of images that lie together, are labelled apart."""
    rng = np.random.default_rng(batch)
    rows = []
    for image in range(12):
        mask = rng.random((9, 11)) < 0.5
        for stripe in range(3):
            for y in range(max(0, stripe * 3 - 1), stripe * 3 + 3):
                edges = np.diff(np.r_[0, mask[y].astype(int), 0])
                rows += [(image, y, x0, x1 - 1, 9, 11, stripe, y < stripe * 3) for x0, x1 in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)]
    runs = pd.DataFrame(rows, columns=["image_id", "y", "x0", "x1", "h", "w", "stripe", "above"])
    got = pd.concat(components._labels(iter([runs[i : i + batch] for i in range(0, len(runs), batch)])), ignore_index=True)
    assert len(got) == len(runs)
    want = {}
    for (image, stripe), part in runs.groupby(["image_id", "stripe"]):
        cells = {(y, x): (y, x0, above) for y, x0, x1, above in part[["y", "x0", "x1", "above"]].itertuples(index=False) for x in range(x0, x1 + 1)}
        seen = set()
        for start in sorted(cells):
            if start in seen:
                continue
            found, todo = {start}, [start]
            while todo:
                y, x = todo.pop()
                near = {(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & cells.keys() - found
                found |= near
                todo += near
            seen |= found
            own = [c for c in found if not cells[c][2]]
            told = (start[0] * 1_000_000 + start[1], len(own), any(y in (0, 8) or x in (0, 10) for y, x in own))
            want |= {(image, stripe, *cells[c][:2]): told for c in found}
    assert want == {(r.image_id, r.stripe, r.y, r.x0): (r.label, r.area, r.border) for r in got.itertuples()}


def _exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("BroadcastExchange"), text.count("ENSURE_REQUIREMENTS")


def test_a_mask_is_not_sent_to_all(spark):
    """Estimates of exploded tables are too small; pixels dealt by image are not dealt again."""
    assert _exchanges(__spark_entry__.queries()["mask_import"](spark, "/root/testdata/sf0.001")) == (0, 0)


@pytest.mark.parametrize("name", ["protect_luminance", "view_all_modes"])
def test_generated_methods_are_compiled(spark, name):
    """The JVM interprets methods of over 8000 bytes; Spark's own limit is the class file's."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


@pytest.mark.parametrize("name", ["screen_tile", "global_screen_render", "tile_local_render", "tile_local_crop", "tiled_vs_full", "tile_seam_band"])
def test_pixels_dealt_by_image_are_not_dealt_again(spark, name):
    """Tiles and joins by pixel stay where the images are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _exchanges(__spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")) == (0, 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["aggressive_interior", "key_image_summary"])
def test_no_colours_are_made_where_none_are_returned(spark, monkeypatch, name):
    """alpha and background are the matte's: nearest colours and what they are looked up in are not needed."""
    monkeypatch.setattr(k, "colours", lambda *a, **b: pytest.fail("colours were made"))
    assert "background" in (got := __spark_entry__.queries()[name](spark, SF)).columns or "opaque" in got.columns


@pytest.mark.parametrize("name", ["key_image_expanded", "key_image_auto", "key_image_high_accuracy", "key_image_sampled"])
def test_no_pixels_are_sent_to_all(spark, monkeypatch, name):
    """An estimate of pixels is of the compressed files that they are made from, which says little of them."""
    seen = []

    def told(df, *rest):
        seen.append(df._jdf.queryExecution().sparkPlan().toString())
        return stage(df, *rest)

    for module in (k, components, catalog):
        monkeypatch.setattr(module, "stage", lambda df, name, parts=None: told(df, name, parts))
    out = catalog.queries()[name](spark, SF)
    seen.append(out._jdf.queryExecution().sparkPlan().toString())
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b" and len(seen) > 6
    assert not [plan for plan in seen if "Broadcast" in plan] and any("SortMergeJoin" in plan for plan in seen)


# --- small whole images, as arrays ----------------------------------------------------------------


def noisy(spark, n=6, h=12, w=16):
    """Frames of patches of the screen's colour and of others, with masks, hints and alpha here and there."""
    random, rows = np.random.default_rng(7), []
    keys = [(0, 220, 50), (30, 80, 235), (185, 42, 170), (120, 120, 120)]
    for i in range(n):
        key, blocks = np.array(keys[i % 4]), random.integers(0, 4, (h // 3, w // 4)).repeat(3, 0).repeat(4, 1)
        colours = np.array([key, key, *random.integers(0, 256, (2, 3))])[blocks]
        mix = random.random((h, w, 1)) * (random.random((h, w, 1)) < 0.4)
        rgb = np.clip(colours * (1 - mix) + random.integers(0, 256, (h, w, 3)) * mix + random.integers(-4, 5, (h, w, 3)), 0, 255).astype(int).tolist()
        some = lambda share, made: np.where(random.random((h, w)) < share, made, None).tolist()  # noqa: B023, E731
        keep, remove, hint, a0 = some(0.1, 255), some(0.1, 200), some(0.3, random.integers(0, 256, (h, w))), some(0.5, random.random((h, w)) * 1.2 - 0.1)
        rows += [(i, y, x, *rgb[y][x], *key.tolist(), a0[y][x], keep[y][x], remove[y][x], hint[y][x]) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, kr int, kg int, kb int, a0 double, keep int, remove int, hint int").coalesce(1)


@pytest.mark.parametrize("sampled,s", [
    (True, replace(catalog.S, auto_detect_key_color=True, border_sample_width=3, sample_size=1)),
    (True, replace(preset("High Accuracy"), auto_detect_key_color=True)),
    (False, replace(catalog.S, erode_expand=1, alpha_hint_strength=0.6, matte_gamma=1.4, edge_refine_radius=5, edge_softness=0.9, aggressive_interior_removal=True)),
    (False, replace(catalog.S, local_screen_model=False, inner_color_pull=0.0)),
], ids=["auto", "high accuracy", "soft", "plain"])
def test_arrays_key_as_relations_do(spark, sampled, s):
    pixels = stage(noisy(spark), "noisy")
    assert k.covers(s, (12, 16))
    got = k.key_packed(spark, pixels, s, (12, 16), 2, sampled)
    want = k.key_frames(spark, k.screened(spark, pixels, s) if sampled else pixels, s, (12, 16))
    assert rows(got.collect()) == rows(want.select(*got.columns).collect()) and got.count() == 6 * 192


def test_arrays_need_whole_images(spark):
    pixels = noisy(spark, 1)
    for broken in (pixels.where("y < 11 OR x < 15"), pixels.where("NOT (y = 3 AND x = 4)"), pixels.withColumn("kr", F.col("x")), pixels.withColumn("r", F.col("r") + 256)):
        with pytest.raises(Exception, match="whole|level"):
            k.packed(broken, (12, 16), 1).collect()
    assert not k.covers(replace(catalog.S, despeckle_min_area=2), (12, 16)) and not k.covers(replace(catalog.S, guided_alpha_refine=0.5), (12, 16))


def test_images_of_one_key_are_relations(spark, tmp_path):
    part = spark.read.parquet(f"{SF}/part.parquet").limit(5).coalesce(1)
    for name, table, whole in (("own", part, True), ("twice", part.union(part.limit(1)), False), ("none", part.withColumn("p_partkey", F.when(F.col("p_partkey") != part.first().p_partkey, F.col("p_partkey"))), False)):
        for other in catalog.TABLES:
            (table if other == "part" else spark.read.parquet(f"{SF}/{other}.parquet").limit(0)).write.parquet(f"{tmp_path}/{name}/{other}.parquet")
        catalog.register(spark, f"{tmp_path}/{name}")
        assert catalog.whole(spark) == whole


@pytest.mark.parametrize("name", ["key_image_auto", "tile_local_render", "tile_seam_band", "key_image_high_accuracy", "tile_local_crop", "tiled_vs_full"])
def test_small_images_are_not_taken_apart(spark, monkeypatch, name):
    """Windows and joins by pixel take more time for small whole images than the formulas do."""
    seen = []

    def told(df, *rest):
        seen.append(df)
        return stage(df, *rest)

    for module in (k, components, catalog):
        monkeypatch.setattr(module, "stage", lambda df, name, parts=None: told(df, name, parts))
    seen.append(catalog.queries()[name](spark, SF))
    plans = [df._jdf.queryExecution().sparkPlan().toString() for df in seen]
    assert not [plan for plan in plans if "Window" in plan] and all("MapInArrow" in plan for plan in plans)


def test_array_tiles_render_as_relations_do(spark):
    pixels = stage(noisy(spark), "noisy")
    lit = m.add(m.probability(f.SPARK, "SELECT * FROM {src}", catalog.S), background=f"CASE WHEN prob >= {catalog.S.thresholds[0]} THEN 1 ELSE 0 END")
    matte = stage(k._sql(spark, k.original_alpha(f.SPARK, k.trimap_alpha(f.SPARK, lit, catalog.S)), pixels).select("image_id", "y", "x", *"rgb", "kr", "kg", "kb", "prob", "background", "edge", "alpha"), "matte")
    images = k.packed_mattes(spark, pixels, catalog.S, (12, 16), 2)
    for step, kinds, build in ((catalog._dense_local, catalog.SHOWN_KINDS, lambda d, src: catalog._tiles(d, src, 5, catalog.TILED, None)), (catalog._dense_seams, catalog.SEAM_KINDS, catalog._seams), (catalog._dense_diff, catalog.DIFF_KINDS, catalog._tiled_vs_full)):
        got = k.by_images(images, step, (12, 16), kinds, pixels=" y int" in kinds).withColumnsRenamed({"or": "r", "og": "g", "ob": "b"})
        want = k._sql(spark, build(f.SPARK, "SELECT * FROM {src}"), matte)
        assert rows(got.collect()) == rows(want.select(*got.columns).collect()) and got.count() in (6, 6 * 192)
