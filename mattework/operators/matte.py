"""Point-wise, sampling and neighbourhood operators of the matte, as relations over relations of pixels.

Every function takes a dialect and the SQL of its input and returns the SQL of its output; columns are
added, none is lost. Windows run along one row or column of one image, so a task holds a line of pixels.
"""

from __future__ import annotations

import math

from mattework.functions.sql import Dialect, clip, hsv, lerp, linear, luma, num, of_key, others, second, smoothstep, ss, to_srgb
from mattework.settings import Settings

ROW, COLUMN = "PARTITION BY image_id, y ORDER BY x", "PARTITION BY image_id, x ORDER BY y"


def add(src: str, **columns: str) -> str:
    return f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM ({src}) s"


def key_terms(src: str) -> str:
    """Pixel and key in 0..1, the key's first greatest channel, its lead, and the pixel's lead in it."""
    k = {f"q{c}": clip(f"k{c} / 255e0", 1e-4, 1) for c in "rgb"}
    src = add(src, **{f"p{c}": f"{c} / 255e0" for c in "rgb"}, **k, star="CASE WHEN kr >= kg AND kr >= kb THEN 0 WHEN kg >= kb THEN 1 ELSE 2 END")
    return add(src, ptot="greatest(pr + pg + pb, 1e-4)", qtot="greatest(qr + qg + qb, 1e-4)", dom=f"greatest(qr, qg, qb) - {second('qr', 'qg', 'qb')}", lead_=f"{of_key('star', 'pr', 'pg', 'pb')} - {others('star', 'pr', 'pg', 'pb')}")


CHROMA = "sqrt((pr / ptot - qr / qtot) * (pr / ptot - qr / qtot) + (pg / ptot - qg / qtot) * (pg / ptot - qg / qtot) + (pb / ptot - qb / qtot) * (pb / ptot - qb / qtot))"


def probability(d: Dialect, src: str, s: Settings) -> str:
    """prob 0..255: how likely a pixel shows the screen of colour (kr, kg, kb)."""
    tol, soft = max(0.015, s.tolerance), max(0.015, s.softness)
    h, sat, _ = hsv(d, "r", "g", "b")
    kh, ks, _ = hsv(d, "kr", "kg", "kb")
    out = add(key_terms(src), chroma_d=CHROMA, hue=h, sat=sat, khue=kh, ksat=ks, dluma=f"abs({luma('pr', 'pg', 'pb')} - {luma('qr', 'qg', 'qb')})")
    out = add(out, hue_score="least(abs(hue - khue), 180 - abs(hue - khue)) / 90e0 + 0.18e0 * abs(sat - ksat) / 255e0")
    out = add(
        out,
        chroma=f"1e0 - {ss(tol, tol + 2.15 * soft, 'chroma_d')}",
        hue_like=f"1e0 - {ss(1.35 * tol, 1.35 * tol + 2.8 * soft, 'hue_score')}",
        bright=f"1e0 - {ss(max(0.04, s.brightness_tolerance), max(0.06, s.brightness_tolerance + 2 * soft), 'dluma')}",
        dom_like=smoothstep("0.015e0", "greatest(0.05e0, 0.9e0 * dom)", "lead_"),
    )
    vec = clip("0.48e0 * chroma + 0.32e0 * hue_like + 0.20e0 * bright")
    return add(out, prob=d.rint("255e0 * " + clip(f"CASE WHEN dom > 0.12e0 THEN greatest({vec}, dom_like * (0.82e0 + 0.18e0 * bright)) ELSE 0.68e0 * chroma + 0.22e0 * hue_like + 0.10e0 * bright END")))


def spill(src: str) -> str:
    """spill 0..1: the key channel's lead, or for a key without a lead what of the pixel's colour, its luma taken off,
    lies along the key's (nothing for a gray key)."""
    out = add(key_terms(src), plum=luma("pr", "pg", "pb"), qlum=luma("qr", "qg", "qb"))
    out = add(out, qnorm="sqrt((qr - qlum) * (qr - qlum) + (qg - qlum) * (qg - qlum) + (qb - qlum) * (qb - qlum))")
    along = "((pr - plum) * (qr - qlum) + (pg - plum) * (qg - qlum) + (pb - plum) * (qb - qlum)) / greatest(qnorm, 1e-4)"
    lead = f"greatest(lead_, 0e0) / greatest({of_key('star', 'pr', 'pg', 'pb')}, {num(1 / 255)})"
    return add(out, spill=f"CASE WHEN dom > 0.12e0 THEN {clip(lead)} WHEN qnorm < 1e-4 THEN 0e0 ELSE {clip(along)} END")


#: Border pixels beyond which only every n-th is looked at. Fixed value.
BORDER_MOST = 160_000


def border(src: str, width: int, most: int = BORDER_MOST) -> str:
    """Pixels of the frame's border: width, but half the height or width at most. Of more than `most`, every n-th in
    the order top, bottom, left, right."""
    out = add(src, h_="max(y) OVER (PARTITION BY image_id, x) + 1", w_="max(x) OVER (PARTITION BY image_id, y) + 1")
    out = add(out, bw_=f"cast(least({width}, greatest(1, floor(h_ / 2e0)), greatest(1, floor(w_ / 2e0))) as int)")
    out = f"SELECT * FROM ({out}) b WHERE y < bw_ OR y >= h_ - bw_ OR x < bw_ OR x >= w_ - bw_"
    place = "CASE WHEN y < bw_ THEN y * w_ + x WHEN y >= h_ - bw_ THEN (y - h_ + 2 * bw_) * w_ + x WHEN x < bw_ THEN 2 * bw_ * w_ + (y - bw_) * bw_ + x ELSE 2 * bw_ * w_ + (h_ - 3 * bw_ + y) * bw_ + x - w_ + bw_ END"
    out = add(out, place_=place, all_="2 * bw_ * w_ + 2 * bw_ * greatest(0, h_ - 2 * bw_)")
    return f"SELECT * FROM ({out}) p WHERE all_ <= {most} OR place_ % greatest(1, cast(floor(all_ / {num(most)}) as int)) = 0"


def candidates(src: str, s: Settings) -> str:
    """Border pixels near the key in chroma and, for a key with a lead, leading in its channel."""
    reach = max(0.05, s.tolerance + 2 * s.softness)
    return add(key_terms(src), candidate=f"{CHROMA} <= {num(reach)} AND (dom <= 0.12e0 OR lead_ > greatest(0.015e0, 0.2e0 * dom))")


def screen_color(d: Dialect, src: str, s: Settings) -> str:
    """image_id, n, sr, sg, sb: the median of the candidates, blended with the key; the key where they are few or far."""
    agg = ", ".join(f"{d.median(c, 'candidate')} AS m{c}" for c in "rgb")
    out = f"SELECT image_id, min(kr) AS kr, min(kg) AS kg, min(kb) AS kb, count(*) AS total, count(*) FILTER (WHERE candidate) AS n, {agg} FROM ({candidates(src, s)}) c GROUP BY image_id"
    far = "sqrt((mr - kr) * (mr - kr) + (mg - kg) * (mg - kg) + (mb - kb) * (mb - kb))"
    use = f"n >= greatest(16, floor(total / 80e0)) AND {far} <= 110e0"
    return f"SELECT image_id, n, {', '.join(d.rint(f'CASE WHEN {use} THEN 0.7e0 * m{c} + 0.3e0 * k{c} ELSE cast(k{c} as double) END') + f' AS s{c}' for c in 'rgb')} FROM ({out}) m"


def hue_histogram(d: Dialect, src: str) -> str:
    """image_id, hue, weight: saturated and bright pixels by hue, weighted S * max(V, 1)."""
    h, sat, v = hsv(d, "r", "g", "b")
    return f"SELECT image_id, hue, cast(sum(sat * greatest(v, 1)) as bigint) AS weight, count(*) AS n FROM (SELECT image_id, {h} AS hue, {sat} AS sat, {v} AS v FROM ({src}) s) t WHERE sat >= 48 AND v >= 42 GROUP BY image_id, hue"


def auto_color(d: Dialect, src: str) -> str:
    """image_id, hue, sr, sg, sb: the median of the cluster around the heaviest hue (the least of equals);
    none where too few pixels are saturated or in the cluster, or its channels lie within 28 levels; blended with
    the key where it is close to it."""
    h, sat, v = hsv(d, "r", "g", "b")
    seen = f"SELECT image_id, r, g, b, kr, kg, kb, {h} AS hue, {sat} AS sat, {v} AS v FROM ({src}) s"
    seen = f"SELECT *, sat >= 48 AND v >= 42 AS usable FROM ({seen}) u"
    enough = f"SELECT image_id, count(*) AS total FROM ({seen}) e GROUP BY image_id HAVING count(*) FILTER (WHERE usable) >= greatest(24, floor(count(*) / 160e0))"
    top = f"SELECT image_id, hue AS top FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY weight DESC, hue) AS nth FROM ({hue_histogram(d, src)}) w) t WHERE nth = 1"
    near = f"SELECT {d.merged('t', 'e')}p.*, top, total FROM ({seen}) p JOIN ({top}) t ON p.image_id = t.image_id JOIN ({enough}) e ON p.image_id = e.image_id WHERE usable AND least(abs(hue - top), 180 - abs(hue - top)) <= 7"
    out = f"SELECT image_id, top AS hue, min(kr) AS kr, min(kg) AS kg, min(kb) AS kb, {', '.join(f'{d.median(c)} AS m{c}' for c in 'rgb')} FROM ({near}) n GROUP BY image_id, top HAVING count(*) >= greatest(16, floor(min(total) / 220e0))"
    far = "sqrt((mr - kr) * (mr - kr) + (mg - kg) * (mg - kg) + (mb - kb) * (mb - kb))"
    return f"SELECT image_id, hue, {', '.join(d.rint(f'CASE WHEN {far} < 55e0 THEN 0.85e0 * m{c} + 0.15e0 * k{c} ELSE m{c} END') + f' AS s{c}' for c in 'rgb')} FROM ({out}) m WHERE greatest(mr, mg, mb) - least(mr, mg, mb) >= 28e0"


# --- neighbourhoods ------------------------------------------------------------------------------


def box(src: str, columns: list[str], radius: int, replicate: bool = True) -> str:
    """c_box: sums over (2r+1)**2 pixels; beyond the border the nearest pixel counts, or nothing."""
    for axis, at, out in ((ROW, "x", "_bx"), (COLUMN, "y", "_box")):
        full = axis + " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
        made = {}
        for c in columns:
            of = c if at == "x" else f"{c}_bx"
            e = f"sum({of}) OVER ({axis} ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)"
            if replicate:
                e += f" + greatest(0, {radius} - {at}) * first_value({of}) OVER ({full}) + greatest(0, {at} + {radius} - max({at}) OVER ({full})) * last_value({of}) OVER ({full})"
            made[c + out] = e
        src = add(src, **made)
    return src


def ellipse(radius: int) -> dict[int, int]:
    """Half-width of the structuring element at each row offset."""
    return {dy: round(math.sqrt(radius * radius - dy * dy)) for dy in range(-radius, radius + 1)}


def morph(src: str, column: str, radius: int, out: str, dilate: bool = True) -> str:
    """Greatest (or least) of an int column under an ellipse; pixels beyond the border do not count."""
    if radius < 1:
        return add(src, **{out: column})
    agg, pick, half = ("max", "greatest", ellipse(radius)) if dilate else ("min", "least", ellipse(radius))
    wide = add(src, **{f"{out}_w{k}": f"{agg}({column}) OVER ({ROW} ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)" for k in sorted(set(half.values()))})
    shift = lambda dy, k: f"{out}_w{k}" if not dy else f"{'lag' if dy < 0 else 'lead'}({out}_w{k}, {abs(dy)}) OVER ({COLUMN})"
    return add(wide, **{out: f"{pick}({', '.join(shift(dy, k) for dy, k in half.items())})"})


def gaussian(src: str, column: str, kernel: int, out: str) -> str:
    """Separable Gaussian of an odd number of taps, sigma max(0.2, k/5), mirrored at the border without its pixel
    (for lines longer than half the kernel; in a shorter one a place mirrored twice takes the pixel itself)."""
    if kernel <= 1:
        return add(src, **{out: column})
    sigma, r = max(0.2, kernel / 5), kernel // 2
    weights = [math.exp(-j * j / (2 * sigma * sigma)) for j in range(r + 1)]
    total = weights[0] + 2 * sum(weights[1:])
    of, name = column, lambda j: f"{out}_{'b' if j < 0 else 'a'}{abs(j)}"
    for axis, at, made in ((ROW, "x", f"{out}_gx"), (COLUMN, "y", out)):
        steps = {name(j): f"{'lag' if j < 0 else 'lead'}({of}, {abs(j)}) OVER ({axis})" for j in range(-r, r + 1) if j}
        src = f"SELECT *, {', '.join(f'{e} AS {at}_{c}' for c, e in steps.items())}, max({at}) OVER ({axis} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS {at}_{out}_end FROM ({src}) s"
        tap = lambda j: f"{at}_{name(j)}" if j else of  # noqa: B023, E731
        side = lambda j, place: f"coalesce({tap(j)}, CASE {place} {' '.join(f'WHEN {i} THEN {tap(-j + 2 * i * (1 if j > 0 else -1))}' for i in range(abs(j)))} END, {of})"  # noqa: B023, E731
        terms = [f"{num(weights[0] / total)} * {of}"]
        terms += [f"{num(weights[j] / total)} * ({side(-j, at)} + {side(j, f'({at}_{out}_end - {at})')})" for j in range(1, r + 1)]
        src = add(src, **{made: " + ".join(terms)})
        of = made
    return src


def guided(src: str, guide: str, target: str, radius: int, eps: float) -> str:
    """guided: target smoothed along the edges of guide (box means with replicated borders)."""
    n = num((2 * radius + 1) ** 2)
    out = add(src, gf_i=f"({guide})", gf_p=f"({target})", gf_ip=f"({guide}) * ({target})", gf_ii=f"({guide}) * ({guide})")
    out = box(out, ["gf_i", "gf_p", "gf_ip", "gf_ii"], radius)
    out = add(out, gf_a=f"(gf_ip_box / {n} - gf_i_box / {n} * gf_p_box / {n}) / greatest(gf_ii_box / {n} - gf_i_box / {n} * gf_i_box / {n} + {num(eps)}, 1e-12)")
    out = add(out, gf_b=f"gf_p_box / {n} - gf_a * gf_i_box / {n}")
    out = box(out, ["gf_a", "gf_b"], radius)
    return add(out, guided=clip(f"gf_a_box / {n} * gf_i + gf_b_box / {n}"))


def screen_map(d: Dialect, src: str, known: str, radius: int) -> str:
    """sr, sg, sb: the mean colour of known background around a pixel, the key where there is none."""
    out = add(src, sm_n=f"CASE WHEN {known} THEN 1 ELSE 0 END", **{f"sm_{c}": f"CASE WHEN {known} THEN {c} ELSE 0 END" for c in "rgb"})
    out = box(out, ["sm_n", "sm_r", "sm_g", "sm_b"], radius)
    return add(out, **{f"s{c}": d.rint(f"CASE WHEN sm_n_box > 0 THEN sm_{c}_box / cast(greatest(sm_n_box, 1) as double) ELSE cast(k{c} as double) END") for c in "rgb"})


# --- alpha ---------------------------------------------------------------------------------------


def trimap(src: str, s: Settings) -> str:
    """edge 0/1 from background 0/1 and prob: the band around the boundary and transitions near it."""
    bg, fg = s.thresholds
    r = s.edge_radius
    out = morph(src, "background", r, "tri_d")
    out = morph(out, "background", r, "tri_e", dilate=False)
    out = morph(out, "background", max(1, 2 * r), "tri_f")
    return add(out, edge=f"CASE WHEN (tri_d = 1 AND tri_e = 0) OR (prob > {fg} AND prob < {bg} AND tri_f = 1) THEN 1 ELSE 0 END")


def alpha(d: Dialect, src: str, s: Settings) -> str:
    """alpha 0..255 from background, edge and prob."""
    bg255, fg255 = s.thresholds
    soft = max(0.0, s.edge_softness)
    fg = max(0.0, min(0.92, max(0.0, fg255 / 255 + (s.core_strength - 0.5) * 0.08)) - 0.02 * soft)
    bg = min(1.0, bg255 / 255 + 0.02 * soft)
    gamma = max(0.05, s.matte_gamma)
    a = f"1e0 - {ss(fg, bg, 'prob / 255e0')}"
    if abs(gamma - 1) > 1e-3:
        a = f"power({a}, {num(1 / gamma)})"
    out = add(src, al_a=f"CASE WHEN edge = 1 THEN {a} WHEN background = 1 THEN 0e0 ELSE 1e0 END")
    out = gaussian(out, "al_a", s.blur_kernel(), "al_g")
    blend = min(0.55, 0.45 * soft) if s.blur_kernel() > 1 else 0.0
    out = add(out, al_b=f"CASE WHEN edge = 1 THEN {lerp('al_a', 'al_g', num(blend))} ELSE al_a END")
    exact = f"""CASE WHEN background = 1 AND (edge = 0 OR prob >= {bg255}) THEN 0e0 WHEN background = 0 AND (edge = 0 OR prob <= {fg255}) THEN 1e0 WHEN al_b < 0.004e0 THEN 0e0 WHEN al_b > 0.996e0 THEN 1e0 ELSE al_b END"""
    return add(out, alpha0=d.rint(f"255e0 * ({exact})"))


def alpha_hint(d: Dialect, src: str, s: Settings, before: str, out: str) -> str:
    """Raises alpha where the hint says foreground; never makes background."""
    k = min(1.0, max(0.0, s.alpha_hint_strength))
    if not k:
        return add(src, **{out: before})
    allowed = f"hint IS NOT NULL AND hint >= {s.alpha_hint_minimum_alpha} AND background = 0"
    raised = d.rint(f"greatest(cast({before} as double), {before} * {num(1 - k)} + hint * {num(k)})")
    return add(src, **{out: f"CASE WHEN {allowed} AND hint >= {s.alpha_hint_foreground_threshold} THEN greatest({raised}, hint) WHEN {allowed} THEN {raised} ELSE {before} END"})


def cleared_edge(d: Dialect, src: str, s: Settings, alpha: str) -> str:
    """edge 0 on kept pixels and where the hint says core and alpha is nearly full."""
    core = f"hint IS NOT NULL AND hint >= {max(s.alpha_hint_foreground_threshold, s.alpha_hint_minimum_alpha)} AND background = 0 AND {alpha} >= 248" if s.alpha_hint_strength > 0 else "false"
    out = add(src, edge_=f"CASE WHEN keep > 127 OR ({core}) THEN 0 ELSE edge END")
    return f"SELECT {d.without('edge', 'edge_')}, edge_ AS edge FROM ({out}) e"


def merged_masks(src: str, s: Settings, of: str, out: str) -> str:
    """Background without hinted and kept pixels, with removed ones that are not kept."""
    return add(src, **{out: f"CASE WHEN keep > 127 THEN 0 WHEN remove > 127 THEN 1 WHEN hint >= {s.alpha_hint_foreground_threshold} THEN 0 ELSE {of} END"})


def fringe(d: Dialect, src: str, s: Settings) -> str:
    """fringe 0..255 from alpha, edge, prob and spill."""
    out = add(src, fr_semi="CASE WHEN alpha > 2 AND alpha < 253 THEN 1 ELSE 0 END")
    out = morph(out, "fr_semi", s.fringe_band_radius, "fr_band")
    a = "(alpha / 255e0)"
    band = "(CASE WHEN alpha > 1 AND (fr_band = 1 OR edge = 1) THEN 1e0 ELSE 0e0 END)"
    edge = f"greatest(4e0 * {a} * (1e0 - {a}), 0.55e0 * edge, 0.35e0 * {band})"
    weight = f"greatest({ss(0.02, 0.5, 'spill')}, prob / 255e0 * (1e0 - {a}) * 0.75e0)"
    return add(out, fringe=d.rint("255e0 * " + clip(f"{band} * {edge} * {weight}")))


def seed_limit(s: Settings) -> int:
    return max(48, s.thresholds[1] + 32)


def seeds(src: str, s: Settings) -> str:
    return f"SELECT * FROM ({src}) s WHERE alpha >= 250 AND background = 0 AND fringe <= 24 AND prob <= {seed_limit(s)}"


def nearest(d: Dialect, src: str, s: Settings, radius: int | None = None, also: str = "") -> str:
    """image_id, y, x, ny, nx, d2: the nearest seed of each fringe pixel, ties by (d2, y, x). also: a column by which rows
    are dealt, that image_id decides.

    Seeds and targets meet by buckets as wide as the radius, a target in its own and the eight around it.
    """
    r = radius or s.nearest_radius
    cell = lambda c: f"cast(floor({c} / {num(r)}) as int)"
    own, t_own, on = (f"{also}, ", f"t.{also}, ", f"t.{also} = q.{also} AND ") if also else ("", "", "")
    target = f"SELECT {own}image_id, y, x, {cell('y')} + dy AS by_, {cell('x')} + dx AS bx_ FROM (SELECT {own}image_id, y, x FROM ({src}) a WHERE fringe > 0) t {d.each([-1, 0, 1], 'dy')} {d.each([-1, 0, 1], 'dx')}"
    seed = f"SELECT {own}image_id, y AS sy, x AS sx, {cell('y')} AS by_, {cell('x')} AS bx_ FROM ({seeds(src, s)}) q"
    best = f"SELECT {d.merged('q')}{t_own}t.image_id, t.y, t.x, min(cast((t.y - sy) * (t.y - sy) + (t.x - sx) * (t.x - sx) as bigint) * 1000000000000 + cast(sy as bigint) * 1000000 + sx) AS best FROM ({target}) t JOIN ({seed}) q ON {on}t.image_id = q.image_id AND t.by_ = q.by_ AND t.bx_ = q.bx_ WHERE (t.y - sy) * (t.y - sy) + (t.x - sx) * (t.x - sx) <= {r * r} GROUP BY {t_own}t.image_id, t.y, t.x"
    return f"SELECT {own}image_id, y, x, cast(floor(best % 1000000000000 / 1000000e0) as int) AS ny, cast(best % 1000000 as int) AS nx, cast(floor(best / 1000000000000e0) as int) AS d2 FROM ({best}) b"


# --- colour --------------------------------------------------------------------------------------


def linear_light(d: Dialect, src: str) -> str:
    """Source and screen in linear light: l*, and t* from s*."""
    return add(src, **{f"l{c}": linear(d, c) for c in "rgb"}, **{f"t{c}": linear(d, f"s{c}") for c in "rgb"})


def weights(src: str, s: Settings) -> str:
    """a, f (fringe) and legacy (despill) weights of a pixel with alpha, fringe, edge and prob."""
    out = add(src, a="alpha / 255e0")
    out = add(out, live="a > 0.001e0", es="greatest(4e0 * a * (1e0 - a), 0.35e0 * edge)", f="CASE WHEN a > 0.001e0 THEN fringe / 255e0 ELSE 0e0 END")
    return add(out, legacy=f"CASE WHEN live THEN {clip('greatest(es, prob / 255e0 * (1e0 - a))')} * {num(s.despill)} ELSE 0e0 END")


def unmix(src: str, s: Settings) -> str:
    """u*: the screen's share taken out of a soft pixel."""
    w = f"f * {num(s.unmix_amount * s.edge_color_repair * (0.25 + 0.75 * s.decontaminate))}"
    return add(src, **{f"u{c}": lerp(f"l{c}", clip(f"(l{c} - (1e0 - a) * t{c}) / greatest(a, 0.06e0)"), w) for c in "rgb"})


def vlahos(src: str, s: Settings) -> str:
    """v*: excess in the key channel taken off; for a key without a lead, what lies along its residual."""
    weight = clip(f"1.5e0 * greatest(f * {num(s.despill)}, 0.4e0 * legacy) * {num(s.fringe_remove)}")
    out = add(src, vw=weight, tstar="CASE WHEN tr >= tg AND tr >= tb THEN 0 WHEN tg >= tb THEN 1 ELSE 2 END", tdom=f"greatest(tr, tg, tb) - {second('tr', 'tg', 'tb')}", tl=luma("tr", "tg", "tb"), ul=luma("ur", "ug", "ub"))
    out = add(out, over=f"greatest({of_key('tstar', 'ur', 'ug', 'ub')} - {others('tstar', 'ur', 'ug', 'ub')}, 0e0)", tn="greatest(sqrt((tr - tl) * (tr - tl) + (tg - tl) * (tg - tl) + (tb - tl) * (tb - tl)), 1e-4)")
    out = add(out, along="greatest(((ur - ul) * (tr - tl) + (ug - ul) * (tg - tl) + (ub - ul) * (tb - tl)) / tn, 0e0)")
    return add(out, **{f"v{c}": clip(f"CASE WHEN tdom > 0.12e0 THEN u{c} - (CASE WHEN tstar = {i} THEN over * vw ELSE 0e0 END) ELSE u{c} - (t{c} - tl) / tn * along * vw * 0.70e0 END") for i, c in enumerate("rgb")})


def pull(d: Dialect, src: str, s: Settings) -> str:
    """w*: towards the nearest inner colour n*, where there is one."""
    k = f"f * {num(s.inner_color_pull * s.edge_color_repair * (0.25 + 0.75 * s.decontaminate))}"
    return add(src, **{f"w{c}": f"CASE WHEN n{c} IS NULL THEN v{c} ELSE {lerp(f'v{c}', linear(d, f'coalesce(n{c}, 0)'), k)} END" for c in "rgb"})


def protect(d: Dialect, src: str, s: Settings) -> str:
    """o*: luma of the source restored by `amount`, written back where anything was spilled."""
    out = add(src, spilled=f"greatest(legacy, f * {num(max(s.despill, s.edge_color_repair * (0.25 + 0.75 * s.decontaminate)))})")
    out = add(out, ll=luma("lr", "lg", "lb"), wl=luma("wr", "wg", "wb"))
    out = add(out, scale=f"CASE WHEN wl <= 1e-4 THEN 1e0 ELSE {clip('ll / greatest(wl, 1e-4)', 0.70, 1.45)} END")
    back = lambda c: to_srgb(d, lerp(f"w{c}", clip(f"w{c} * scale"), f"spilled * {num(s.protect)}"))
    out = add(out, **{f"o{c}": f"CASE WHEN NOT live THEN 0 WHEN spilled > 0e0 THEN {back(c)} ELSE {c} END" for c in "rgb"})
    return add(out, despill=d.rint("255e0 * " + clip("spilled")))
