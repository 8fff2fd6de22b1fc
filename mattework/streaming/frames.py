"""Image files keyed as they arrive, and the rule that only the latest result of an image counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mattework.plans.key_image import key_frames, screened
from mattework.settings import Settings
from mattework.sources.images import PNG_GLOB, png_pixels

MASKS = {"keep": "0", "remove": "0", "hint": "cast(NULL as int)"}
FILES = "path string, modificationTime timestamp, length long, content binary"
#: Of a larger image side, the share that is the radius of the screen map, and its bounds. Fixed values.
RADIUS = "greatest(24, least(181, greatest(height, width) div 18))"


def key_images(spark: SparkSession, pixels: DataFrame, s: Settings) -> DataFrame:
    """The result of images of any sizes: at most 158 radii of the screen map, each a plan of its own."""
    kr, kg, kb = s.key_color
    ready = pixels.withColumns({"kr": F.lit(kr), "kg": F.lit(kg), "kb": F.lit(kb)} | {n: F.expr(e) for n, e in MASKS.items() if n not in pixels.columns})
    ready = screened(spark, ready, s)
    ready = ready.withColumn("radius", F.expr(RADIUS))
    parts = []
    for (radius,) in sorted(ready.select("radius").distinct().collect()):
        side = radius * 18
        out = key_frames(spark, ready.where(F.col("radius") == radius).drop("path", "height", "width", "radius"), s, (side, side))
        parts.append(out.select("image_id", "y", "x", F.col("or").alias("r"), F.col("og").alias("g"), F.col("ob").alias("b"), "alpha"))
    if not parts:
        return spark.createDataFrame([], "image_id long, y int, x int, r int, g int, b int, alpha int")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def key_stream(spark: SparkSession, folder: str, sink: str, checkpoint: str, s: Settings, *, files_a_batch: int = 64, once: bool = False) -> StreamingQuery:
    """Keys PNG files that arrive in folder; a batch that runs again overwrites its own part of the sink."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", PNG_GLOB).option("maxFilesPerTrigger", files_a_batch).load(folder)

    def one(batch: DataFrame, batch_id: int) -> None:
        out = key_images(batch.sparkSession, png_pixels(batch), s)
        out.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/generation={batch_id}")

    writer = files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(results: DataFrame, generation: str = "generation", key: str = "image_id") -> DataFrame:
    """Rows of the greatest generation of each image; older results are stale. Works per image, not per pixel."""
    newest = results.groupBy(F.col(key).alias("key_")).agg(F.max(generation).alias("newest_"))
    return results.join(newest, (F.col(key) == F.col("key_")) & (F.col(generation) == F.col("newest_"))).drop("key_", "newest_")
