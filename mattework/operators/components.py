"""Connected components (eight neighbours) of a mask, over runs of pixels instead of pixels.

Runs are found by a window along a row and joined by union-find in stripes of STRIPE rows, whole stripes at a time. The last
row of a stripe stands in the next stripe too; where it got a label in both, the two are one component. These links, at
most one for two pixels of every STRIPE-th row, are joined by image: 2 million for an image of a thousand million pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mattework.plans.stages import stage

#: Rows of an image that are labelled in one group.
STRIPE = 256
LABELLED = "image_id long, y int, x0 int, x1 int, label long, area long, border boolean"
#: Above all labels (y * 10**6 + x0), so that stripe * NODE + label names a component of a stripe.
NODE = 1 << 41


def runs_sql(mask: str) -> str:
    """image_id, y, x0, x1 of each run of the pixels (image_id, y, x) of the mask."""
    return f"SELECT image_id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS island FROM ({mask}) m) i GROUP BY image_id, y, island"


def mask_runs(mask: DataFrame) -> DataFrame:
    island = F.col("x") - F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x"))
    return mask.withColumn("island", island).groupBy("image_id", "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


class _Sets:
    """Disjoint sets of 0..n-1; a set's least member stands for it."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.parent[max(a, b)] = min(a, b)

    def roots(self) -> list[int]:
        return [self.find(i) for i in range(len(self.parent))]


def _label(runs: pd.DataFrame) -> pd.DataFrame:
    """Runs of whole stripes, sorted by image, stripe, y and x0, with the label, area and border of their component in
    its stripe; the row above only connects."""
    line = runs[["image_id", "stripe", "y"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]).any(axis=1)])
    follows = (line[starts[1:]] - line[starts[:-1]] == [0, 0, 1]).all(axis=1).tolist()
    starts = [*starts.tolist(), len(runs)]
    sets = _Sets(len(runs))
    x0, x1 = runs["x0"].tolist(), runs["x1"].tolist()
    for n, below in enumerate(follows):
        if not below:
            continue
        k, end = starts[n], starts[n + 1]
        for i in range(end, starts[n + 2]):
            while k < end and x1[k] + 1 < x0[i]:
                k += 1
            j = k
            while j < end and x0[j] <= x1[i] + 1:
                sets.join(i, j)
                j += 1
    roots, own = np.array(sets.roots()), ~runs["above"].to_numpy()
    size = ((runs["x1"] - runs["x0"] + 1) * own).to_numpy()
    touch = ((runs["y"] == 0) | (runs["x0"] == 0) | (runs["y"] == runs["h"] - 1) | (runs["x1"] == runs["w"] - 1)).to_numpy() & own
    label = runs["y"].to_numpy(np.int64)[roots] * 1_000_000 + runs["x0"].to_numpy()[roots]
    out = runs.assign(label=label, area=np.bincount(roots, size)[roots].astype(np.int64), border=np.bincount(roots, touch)[roots] > 0)
    return out[["image_id", "y", "x0", "x1", "label", "area", "border", "stripe", "above"]]


def _labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """_label for batches that cut stripes anywhere: a stripe waits until the next one begins."""
    key, held = ["image_id", "stripe"], []
    for runs in batches:
        if not len(runs):
            continue
        here, last = runs[key].to_numpy(), runs[key].to_numpy()[-1]
        if held and (held[-1][key].to_numpy()[-1] == last).all():
            held.append(runs)
            continue
        open_ = (here == last).all(axis=1)
        if held or not open_.all():
            yield _label(pd.concat([*held, runs[~open_]], ignore_index=True))
        held = [runs[open_]]
    if held:
        yield _label(pd.concat(held, ignore_index=True))


def _joined(links: pd.DataFrame) -> pd.DataFrame:
    """The whole components of an image that links of its stripes' components make."""
    sides = [links[[f"{c}_{side}" for c in ("node", "label", "area", "border")]].set_axis(["node", "label", "area", "border"], axis=1) for side in "ab"]
    nodes = pd.concat(sides, ignore_index=True).drop_duplicates("node").sort_values("label", ignore_index=True)
    at = pd.Series(nodes.index, nodes["node"])
    sets = _Sets(len(nodes))
    for i, j in zip(at[links["node_a"]].tolist(), at[links["node_b"]].tolist(), strict=True):
        sets.join(i, j)
    whole = nodes.groupby(sets.roots())
    out = nodes.assign(label=whole["label"].transform("min"), area=whole["area"].transform("sum"), border=whole["border"].transform("any"))
    return out.assign(image_id=links["image_id"].iloc[0])[["image_id", "node", "label", "area", "border"]]


def labelled(pixels: DataFrame, mask: str, stripe: int = STRIPE, parts: int | None = None) -> DataFrame:
    """Runs of the pixels where the condition holds, with label (y * 10**6 + x0 of the first run), area and
    whether the component touches the image's border."""
    size = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    runs = mask_runs(pixels.where(mask).select("image_id", "y", "x")).join(size.hint("merge"), "image_id")
    own = F.floor(F.col("y") / stripe).cast("int")
    last = (F.col("y") % stripe == stripe - 1) & (F.col("y") < F.col("h") - 1)
    dealt = runs.withColumn("stripe", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))))
    dealt = dealt.withColumn("above", F.col("y") < F.col("stripe") * stripe)
    dealt = dealt.repartition(parts, "image_id") if parts else dealt.repartition("image_id", "stripe")
    made = dealt.sortWithinPartitions("image_id", "stripe", "y", "x0").mapInPandas(lambda batches: _labels(batches), f"{LABELLED}, stripe int, above boolean")
    stripes = stage(made, "stripes", parts)
    node = F.col("stripe") * F.lit(NODE) + F.col("label")
    end = lambda side: [node.alias(f"node_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("label", "area", "border"))]
    below = stripes.where("above").select("image_id", "y", "x0", *end("b"))
    rows = stripes.where("not above")
    if below.isEmpty():  # no image is higher than a stripe
        return rows.drop("stripe", "above")
    ends = rows.where(F.col("y") % stripe == stripe - 1).select("image_id", "y", "x0", *end("a"))
    links = ends.join(below.hint("merge"), ["image_id", "y", "x0"]).drop("y", "x0").distinct()
    whole = links.groupBy("image_id").applyInPandas(lambda pdf: _joined(pdf), "image_id long, node long, label long, area long, border boolean")
    whole = whole.select("image_id", "node", F.struct("label", "area", "border").alias("whole"))
    out = rows.withColumn("node", node).join(whole.hint("merge"), ["image_id", "node"], "left")
    return out.select("image_id", "y", "x0", "x1", *(F.coalesce(f"whole.{c}", c).alias(c) for c in ("label", "area", "border")))


def pixels_of(runs: DataFrame, *columns: str) -> DataFrame:
    return runs.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), *columns)


def border_connected(pixels: DataFrame, mask: str, parts: int | None = None) -> DataFrame:
    """(image_id, y, x) of the mask's components that touch the border."""
    return pixels_of(labelled(pixels, mask, parts=parts).where("border"))


def remove_small(pixels: DataFrame, mask: str, min_area: int, protect_border: bool = True, parts: int | None = None) -> DataFrame:
    """(image_id, y, x) of the mask without components smaller than min_area; nothing goes for min_area <= 1."""
    if min_area <= 1:
        return pixels.where(mask).select("image_id", "y", "x")
    keep = F.col("area") >= min_area
    return pixels_of(labelled(pixels, mask, parts=parts).where(keep | F.col("border") if protect_border else keep))


def fill_holes(pixels: DataFrame, mask: str, min_area: int, parts: int | None = None) -> DataFrame:
    """The mask with the small components of its complement that do not touch the border."""
    own = pixels.where(mask).select("image_id", "y", "x")
    if min_area <= 1:
        return own
    holes = labelled(pixels, f"NOT ({mask})", parts=parts).where((F.col("area") < min_area) & ~F.col("border"))
    return own.union(pixels_of(holes))


# --- the same for an engine with recursive queries, as the oracle ---------------------------------


def reach_sql(pixels: str, mask: str, seeds: str) -> str:
    """Flood fill by a recursive union: pixels of the mask that touch a seed of the mask."""
    return f"""WITH RECURSIVE px AS MATERIALIZED ({pixels}), m AS MATERIALIZED (SELECT image_id, y, x FROM px WHERE {mask}), size AS (SELECT image_id, max(y) AS my, max(x) AS mx FROM px GROUP BY image_id),
    reach(image_id, y, x) AS (SELECT m.image_id, m.y, m.x FROM m JOIN size USING (image_id) WHERE {seeds} UNION SELECT m.image_id, m.y, m.x FROM reach r JOIN m ON m.image_id = r.image_id AND m.y BETWEEN r.y - 1 AND r.y + 1 AND m.x BETWEEN r.x - 1 AND r.x + 1)"""


BORDER_SEED = "m.y = 0 OR m.x = 0 OR m.y = my OR m.x = mx"


def labels_sql(pixels: str, mask: str) -> str:
    """comp(image_id, y, x, label, area, border) for a mask of small components."""
    return f"""WITH RECURSIVE px AS MATERIALIZED ({pixels}), m AS MATERIALIZED (SELECT image_id, y, x FROM px WHERE {mask}), size AS (SELECT image_id, max(y) AS my, max(x) AS mx FROM px GROUP BY image_id),
    reach(image_id, y0, x0, y, x) AS (SELECT image_id, y, x, y, x FROM m UNION SELECT m.image_id, r.y0, r.x0, m.y, m.x FROM reach r JOIN m ON m.image_id = r.image_id AND m.y BETWEEN r.y - 1 AND r.y + 1 AND m.x BETWEEN r.x - 1 AND r.x + 1),
    comp AS (SELECT r.image_id, r.y, r.x, min(cast(y0 as bigint) * 1000000 + x0) AS label, count(*) AS area, bool_or(y0 = 0 OR x0 = 0 OR y0 = my OR x0 = mx) AS border FROM reach r JOIN size USING (image_id) GROUP BY r.image_id, r.y, r.x)"""
