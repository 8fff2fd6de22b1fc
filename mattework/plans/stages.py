"""Stages written as tables, so that plans stay small and a lost executor costs one stage at most."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


#: Pixels of small images that a task is dealt, so that what it sorts stays in memory.
TASK_PIXELS = 100_000


def parts_for(spark, images: int, shape: tuple[int, int]) -> int:
    """Partitions by image_id for so many small images, each whole in one of them.

    Leaves in the session that joins by (image_id, y, x) of two sides dealt by image_id need no other dealing, and that
    no method is generated that is too long for the JVM to compile (8000 bytes): long ones are split instead."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-images * shape[0] * shape[1] // TASK_PIXELS))


def stage(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir (one of our own only where that is unset), and read.

    With parts (for small images) it lies in so many buckets by image_id. What is read from them is dealt by image as it
    is, so windows along lines, and joins of two such tables by pixel, move no rows."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        root = _own["dir"] = _own.get("dir") or f"file://{tempfile.mkdtemp(prefix='mattework-')}"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    if parts:
        table = f"mattework_{name}_{uuid.uuid4().hex}"
        df.repartition(parts, "image_id").write.format("parquet").option("path", path).bucketBy(parts, "image_id").saveAsTable(table)
        return spark.table(table)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
