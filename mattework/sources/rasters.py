"""Relations of pixels from the analytic tables, as SQL. Each covers its whole table.

frames: one synthetic frame for each part: a feathered disc on a green, blue or magenta screen with a mild
gradient. embed_raster: an image for each label, a row for each vector, a column for each dimension.
density_raster: lineitem counted on a grid. events_raster: event types by user and hour.
"""

from __future__ import annotations

from mattework.functions.sql import Dialect, clip

HEIGHT, WIDTH = 12, 16


def frames(d: Dialect, h: int = HEIGHT, w: int = WIDTH) -> str:
    """image_id, y, x, r, g, b, kr, kg, kb, a_true, a0, keep, remove, hint, fr, fg, fb."""
    dist = f"sqrt((y - {h / 2:g}e0) * (y - {h / 2:g}e0) + (x - {w / 2:g}e0) * (x - {w / 2:g}e0))"
    mixed = lambda c: d.trunc(clip(f"(b{c} * (1e0 - a_true) + f{c} * a_true)", 0, 255))
    return f"""
    SELECT image_id, y, x, {mixed('r')} AS r, {mixed('g')} AS g, {mixed('b')} AS b, kr, kg, kb, a_true, CASE WHEN image_id % 4 = 0 THEN a_true END AS a0,
        CASE WHEN x = {w // 2} AND y >= {h // 2} AND image_id % 5 = 0 THEN 255 ELSE 0 END AS keep, CASE WHEN y = {h // 2} AND x >= {w // 2} AND image_id % 5 = 1 THEN 255 ELSE 0 END AS remove,
        CASE WHEN image_id % 3 = 0 THEN {d.rint('255e0 * a_true')} END AS hint, fr, fg, fb
    FROM (SELECT *, {clip(f"(radius + 1.5e0 - {dist}) / 3e0")} AS a_true, greatest(0, least(255, kr + (x + y) % 5)) AS br, greatest(0, least(255, kg + (x * 2 + y) % 7 - 3)) AS bg, greatest(0, least(255, kb + x % 3)) AS bb
      FROM (SELECT p_partkey AS image_id, cast(yy as int) AS y, cast(xx as int) AS x, 2e0 + p_size % 4 AS radius,
          CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 30 ELSE 185 END AS kr, CASE p_partkey % 3 WHEN 0 THEN 220 WHEN 1 THEN 80 ELSE 42 END AS kg, CASE p_partkey % 3 WHEN 0 THEN 50 WHEN 1 THEN 235 ELSE 170 END AS kb,
          cast(60 + p_partkey * 37 % 180 as int) AS fr, cast(60 + p_partkey * 53 % 150 as int) AS fg, cast({d.trunc('p_retailprice')} % 200 as int) AS fb
        FROM {d.table('part')} {d.count(str(h), 'yy')} {d.count(str(w), 'xx')}) grid) shaped"""


def embed_raster(d: Dialect) -> str:
    """image_id, y, x, r, g, b: neighbouring dimensions quantised to 0..255."""
    q = lambda c: d.trunc(clip(f"(({c}) + 0.6e0) * 212e0", 0, 255))
    near = lambda k: f"coalesce(lead(v, {k}) OVER (PARTITION BY vec_id ORDER BY x), v)"
    return f"""
    SELECT cast(label as bigint) AS image_id, cast(dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 as int) AS y, x, {q('v')} AS r, {q('v1')} AS g, {q('v2')} AS b
    FROM (SELECT *, {near(1)} AS v1, {near(2)} AS v2 FROM (SELECT vec_id, label, cast(pos as int) AS x, cast(val as double) AS v FROM {d.table('embeddings')} {d.unpack('embedding', 'e')}) flat) wide"""


def density_raster(d: Dialect, h: int = 40, w: int = 50) -> str:
    """image_id, y, x, r, g, b, n: lineitem on a grid of parts and suppliers."""
    return f"""
    SELECT cast(0 as bigint) AS image_id, cast(l_suppkey % {h} as int) AS y, cast(l_partkey % {w} as int) AS x, cast(least(255, sum(l_quantity) % 256) as int) AS r, {d.rint('255e0 * round(avg(l_discount), 6) * 9e0')} % 256 AS g, {d.rint('255e0 * round(avg(l_tax), 6) * 11e0')} % 256 AS b, count(*) AS n
    FROM {d.table('lineitem')} GROUP BY l_suppkey % {h}, l_partkey % {w}"""


def events_raster(d: Dialect) -> str:
    """event_type, y (hour), x (user modulo 24), n, v: an image for each event type."""
    return f"""SELECT event_type, cast(hour(ts) as int) AS y, cast(user_id % 24 as int) AS x, count(*) AS n, round(sum(value), 3) AS v FROM {d.table('events')} GROUP BY event_type, hour(ts), user_id % 24"""
