"""Exact deduplication by an extendible-hash index kept as shared files.

1. Every text is normalised (each run of space, tab, LF, VT, FF, CR becomes one space; null counts
   as empty) and hashed to a 64-bit key and a SHA-256.
2. The directory of the extendible hash starts as one bucket and doubles: any bucket that holds more
   distinct keys or bytes than its capacity splits by the next high bit of the key. Only counts by key
   prefix reach the driver, at most 2**DIRECTORY_BITS rows.
3. Texts go to the owner of their bucket, equal texts of one map task once with their least doc_id and
   count. The owner walks its key range in order, keeps a chain of the distinct texts of the current
   key, compares bytes, and appends (bucket, key, slot, sha, keep_id, group_size) to the index files.
4. Every document looks up its entry by key and digest.

A key with any share of all rows costs an owner one entry per map batch, and the last join is one that
the engine can split. Empty and null texts are one group; ties of doc_id keep one group of that id, and
repeated rows count in group_size; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mattework.llm.shared import materialize, small_batches

SPACES = "[\\x20\\x09-\\x0D]+"
#: Finest directory: 2**16 prefixes. Owners stream, so an overfull bucket at this depth is still exact.
DIRECTORY_BITS = 16
BUCKET_KEYS, BUCKET_BYTES = 4096, 32 << 20
#: Bytes of distinct texts that a map task combines before it passes them on.
COMBINE_BYTES = 16 << 20

ENTRY = "bucket int, key long, text binary, doc_id long, n long"
INDEX = "bucket int, key long, slot int, text_sha256 string, keep_id long, group_size long"


def directory(loads: list[tuple[int, int, int]], bits: int = DIRECTORY_BITS, keys: int = BUCKET_KEYS, size: int = BUCKET_BYTES) -> np.ndarray:
    """Bucket of each key prefix of `bits` bits. loads: (prefix, keys, bytes).

    Directory doubling: a bucket at local depth d owns the prefixes that agree in their first d bits;
    while it is overfull and d < bits it splits in two. A bucket is known by its first prefix.
    """
    count, volume = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for prefix, k, b in loads:
        count[prefix] += k
        volume[prefix] += b
    owner = np.zeros(1 << bits, np.int32)
    todo = [(0, 0)]
    while todo:
        first, depth = todo.pop()
        width = 1 << (bits - depth)
        span = slice(first, first + width)
        if depth < bits and (count[span].sum() > keys or volume[span].sum() > size):
            todo += [(first, depth + 1), (first + width // 2, depth + 1)]
        else:
            owner[span] = first
    return owner


def _combine(owner: np.ndarray):
    def run(batches):
        held: dict[tuple[int, bytes], list[int]] = {}
        volume = 0

        def out():
            rows = [(int(owner[(k >> (64 - DIRECTORY_BITS)) & ((1 << DIRECTORY_BITS) - 1)]), k, t, d, n) for (k, t), (d, n) in held.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["bucket", "key", "text", "doc_id", "n"])

        for batch in batches:
            for k, t, d in zip(batch["key"].to_pylist(), batch["norm"].cast(pa.binary()).to_pylist(), batch["doc_id"].to_pylist(), strict=True):
                if entry := held.get((k, t)):
                    entry[0], entry[1] = _least(entry[0], d), entry[1] + 1
                else:
                    held[k, t] = [d, 1]
                    volume += len(t) + 200
                if volume > COMBINE_BYTES:
                    yield out()
                    held.clear()
                    volume = 0
        yield out()

    return run


def _least(a, b):
    return a if b is None else b if a is None else min(a, b)


def _own(batches):
    """Walk the sorted entries of the owned key ranges; one chain of distinct texts at a time."""
    at, chain = None, []
    rows: list[tuple] = []

    def close():
        for slot, (text, doc, n) in enumerate(chain):
            rows.append((at[0], at[1], slot, hashlib.sha256(text).hexdigest(), doc, n))

    def out():
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["bucket", "key", "slot", "text_sha256", "keep_id", "group_size"])

    for batch in batches:
        for b, k, t, d, n in zip(*(batch[c].to_pylist() for c in ("bucket", "key", "text", "doc_id", "n")), strict=True):
            if at != (b, k):
                close()
                at, chain = (b, k), []
            for entry in chain:
                if entry[0] == t:  # the bytes, not only the key
                    entry[1], entry[2] = _least(entry[1], d), entry[2] + n
                    break
            else:
                chain.append([t, d, n])
        yield out()
        rows.clear()
    close()
    yield out()


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    norm = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")
    return docs.select("doc_id", norm.alias("norm")).withColumn("key", F.xxhash64("norm"))


def build_index(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(digests by document, index entries), both written to the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    digests = materialize(keyed(docs).select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256"), F.length(F.encode("norm", "UTF-8")).cast("long").alias("n_bytes")), "digests")
    prefix = F.shiftrightunsigned("key", 64 - DIRECTORY_BITS).cast("int")
    loads = digests.groupBy("key").agg(F.max("n_bytes").alias("b")).groupBy(prefix.alias("p")).agg(F.count("*").alias("k"), F.sum("b").alias("b"))
    owner = directory([tuple(r) for r in loads.collect()])
    entries = keyed(docs).mapInArrow(_combine(owner), ENTRY)
    dealt = entries.repartition("bucket").sortWithinPartitions("bucket", "key")
    return digests, materialize(dealt.mapInArrow(_own, INDEX), "index")


def exact_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs(doc_id, text).

    A null doc_id is never the least while another is there. Of repeated rows with the kept doc_id, all
    are marked as kept (they are the same document).
    """
    digests, index = build_index(docs, text)
    found = digests.join(index.select("key", "text_sha256", "keep_id", "group_size"), ["key", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
