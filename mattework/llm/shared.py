"""Tables in the folder that all executors share, and connected components over them."""

from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset (tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = f"file://{tempfile.mkdtemp(prefix='mattework-')}"
    return _own["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: df written as a table in the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes from which an Arrow batch to a Python worker ends, however few rows it has.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that Python workers hold, by rows and by bytes, as single texts can be long.

    The bounds hold for whatever is run later, as plans are run after they are built; they are only ever lowered, so
    that no operator loosens another's.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of `rows` rows for what is executed within; the session's own bound comes back after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bitmap(hashes: DataFrame, count: int, most: int = 30, flags_each: int = 32) -> tuple[int, np.ndarray]:
    """(bits, packed flags) of hashes(hash long): the flag at a hash's top `bits` bits is set.

    About flags_each flags for each of `count` hashes, but 2**most at most (128 MB): a set that is larger
    than that lets more through, it loses none. Flags are packed on the executors.
    """
    bits = min(most, max(20, math.ceil(math.log2(max(count, 1) * flags_each))))
    low = bits - 6

    def pack(key, table):
        flags = np.zeros(1 << low, bool)
        flags[np.asarray(table["bit"]) & ((1 << low) - 1)] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "flags": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    bit = hashes.select(F.shiftrightunsigned("hash", 64 - bits).alias("bit")).withColumn("part", F.shiftright("bit", low)).distinct()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for part, chunk in bit.groupBy("part").applyInArrow(pack, "part long, flags binary").toLocalIterator():
        out[part << (low - 3) : (part + 1) << (low - 3)] = np.frombuffer(chunk, np.uint8)
    return bits, out


def flagged(flags: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes have their flag set."""
    bit = (hashes.astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return (flags[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def components(edges: DataFrame) -> DataFrame:
    """(id, label): label is the least id of the component, for every id of edges(a, b).

    Rounds of least-neighbour labels with pointer jumping, each written to the shared folder; the
    number of rounds grows with the logarithm of the longest path. Nothing but a count of changed
    labels reaches the driver.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other"))
    both = both.union(both.select("other", "id")).union(both.select("id", "id")).union(both.select("other", "other"))
    both = materialize(both.distinct(), "links")  # an id is its own neighbour, too
    labels = materialize(both.groupBy("id").agg(F.min("other").alias("label")), "labels")
    while True:
        own = F.max(F.when(F.col("id") == F.col("other"), F.col("label")))
        least = both.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(own.alias("was"), F.min("label").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("label").alias("far"))
        moved = least.join(jump, "near", "left").select("id", "was", F.least("near", F.coalesce("far", "near")).alias("label"))
        moved = materialize(moved, "labels")
        labels = moved.select("id", "label")
        if moved.where("was <> label").isEmpty():
            return labels
