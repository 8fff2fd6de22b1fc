"""Document fingerprints by locally consistent parsing.

Level 0 is the UTF-8 bytes. At each level runs of one symbol become one (symbol, length) symbol; then
deterministic coin tossing labels every symbol by the lowest bit in which it differs from the one before
it, twice the bit's place plus the bit, and does so again on the labels until they are below six. Strict
local maxima of the labels start phrases; a phrase's name is the hash of its symbols, the next level's
symbol. A boundary depends on a few symbols around it only, so equal substrings get equal phrases but
near their ends, wherever they stand. The fingerprint is a one-permutation min-hash of the names of the
phrases of levels SKETCHED (a phrase of level 3 spans some thirty bytes): BINS bins of 16 bits in hex.

Null counts as empty; the empty text's fingerprint is all zeros. Equal texts have equal fingerprints. An empty table
gives no rows; columns other than doc_id and text are not read. Texts are parsed whole, a few at a time by their bytes.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mattework.llm.bytesops import NAMES, U, blocks, column_bytes, mix, prefix_sums, span_hash
from mattework.llm.shared import small_batches

BINS = 64
SKETCHED = (3, 4)
ROUNDS = 3


def _toss(symbols: np.ndarray, head: np.ndarray, virtual: int) -> np.ndarray:
    """One round of coin tossing; the symbol before the first of a document is `virtual`."""
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[head] = virtual
    differs = symbols ^ before
    low = differs & (~differs + symbols.dtype.type(1))
    place = np.bitwise_count(low - symbols.dtype.type(1)).astype(np.uint8)
    return place * np.uint8(2) + ((symbols & low) != 0)


def parse(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level: names of the phrases and the documents' offsets into them."""
    n = len(symbols)
    if not n:
        return symbols, offsets
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    new = np.ones(n, bool)
    new[1:] = symbols[1:] != symbols[:-1]
    new[heads] = True
    start = np.flatnonzero(new)
    if len(start) < n:
        length = np.diff(start, append=n)
        symbols = symbols[start]
        longer = length > 1
        symbols[longer] = mix(symbols[longer] ^ mix(length[longer].astype(U)))
        offsets = np.searchsorted(start, offsets)
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        n = len(symbols)
    label = _toss(symbols, heads, 0)
    for _ in range(ROUNDS):
        label = _toss(label, heads, 255)
    peak = np.zeros(n, bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    peak[tails] = False  # the last symbol has no right neighbour
    peak[heads] = True
    start = np.flatnonzero(peak)
    end = np.append(start[1:], n)
    return span_hash(prefix_sums(symbols), start, end), np.searchsorted(start, offsets)


def sketches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, BINS) 16-bit sketch; 0 marks a bin without a phrase."""
    docs = len(offsets) - 1
    symbols, at = NAMES[data], offsets
    names, owner = [], []
    for level in range(1, max(SKETCHED) + 1):
        symbols, at = parse(symbols, at)
        if level in SKETCHED:
            names.append(mix(symbols + U(level)))
            owner.append(np.repeat(np.arange(docs), np.diff(at)))
    name, doc = np.concatenate(names), np.concatenate(owner)
    slot = doc * BINS + (name & U(BINS - 1)).astype(np.int64)
    name >>= U(6)
    order = np.argsort(name)[::-1]  # the least name of a bin is written last
    out = np.zeros(docs * BINS, np.uint16)
    out[slot[order]] = ((name[order] * U(0x9E3779B97F4A7C15)) >> U(48)).astype(np.uint16) | np.uint16(1)
    return out.reshape(docs, BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the phrase sets, row by row; two empty sketches are alike."""
    either = ((a != 0) | (b != 0)).sum(axis=1)
    return np.where(either == 0, 1.0, ((a == b) & (a != 0)).sum(axis=1) / np.maximum(either, 1))


def hexed(sketch: np.ndarray) -> list[str]:
    raw = sketch.astype(">u2").tobytes().hex()
    step = 4 * BINS
    return [raw[i : i + step] for i in range(0, len(raw), step)]


def sketch_texts(texts: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    return np.concatenate([sketches(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets)]) if texts else np.zeros((0, BINS), np.uint16)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of docs(doc_id, text)."""

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch["text"])
            out = [x for i, j in blocks(offsets) for x in hexed(sketches(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))]
            yield pa.record_batch([batch["doc_id"], pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Documents that are worked on at once, in bytes.
GROUP_BYTES = 2 << 20
#: Rows of a range of doc_id.
RANGE_ROWS = 4000


def _edit(batches):
    """Rows come by range, in descending order, and the last of a range is the row that follows it."""
    held: list[tuple[int, int, bool, str]] = []

    def out():
        texts = [t for *_, t in held]
        own = sketch_texts([t.encode("utf-8", "surrogatepass") for t in texts])
        pairs = [i for i in range(len(held) - 1) if held[i][0] == held[i + 1][0] and not held[i][2]]
        changed = [edited(texts[i], texts[i + 1]).encode("utf-8", "surrogatepass") for i in pairs]
        other = sketch_texts(changed)
        at = np.array(pairs, np.int64)
        return pa.record_batch(
            [
                pa.array([held[i][1] for i in pairs], pa.int64()),
                pa.array([len(texts[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in changed], pa.string()),
                pa.array(hexed(own[at]), pa.string()),
                pa.array(hexed(other), pa.string()),
                pa.array(likeness(own[at], other), pa.float64()),
                pa.array(likeness(own[at], own[at + 1]), pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    volume = 0
    for batch in batches:
        for part, doc, halo, text in zip(*(batch[c].to_pylist() for c in ("part", "doc_id", "halo")), batch["text"], strict=True):
            text = text.as_py() or ""
            held.append((part, doc, halo, text))
            volume += len(text)
            if volume > GROUP_BYTES and len(held) > 1:
                yield out()
                held, volume = held[-1:], len(held[-1][3])
    if len(held) > 1:
        yield out()


def _range_of(key: Column, cuts: list[int], fan: int = 64) -> Column:
    """How many cuts are at or below the key, found in two steps so that a row looks at few of them."""
    if not cuts:
        return F.lit(0)
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= key))
    step = -(-len(cuts) // fan)
    coarse = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    group = below(array([c[0] for c in coarse]))
    return F.when(group == 0, 0).otherwise((group - 1) * step + below(F.element_at(F.array(*map(array, coarse)), F.greatest(group, F.lit(1))))).cast("int")


#: The first bytes of a text as a number, in the order of texts.
HEAD = "cast(conv(rpad(hex(substring(cast(text as binary), 1, 7)), 14, '0'), 16, 10) as long)"


def _ranges(docs: DataFrame, parts: int) -> DataFrame:
    """docs(key, text) with part: about as many equal ranges in the order of key, and of text where a key is frequent.

    A key that several cuts fall on starts a range of its own; its rows are cut by the heads of their texts into as
    many ranges, below the rest of that range. Nothing but cuts reaches the driver.
    """
    cuts = docs.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    often = {key: n for key, n in Counter(cuts).items() if n > 1}
    base = _range_of(F.col("key"), sorted(set(cuts)))
    if not often:
        return docs.withColumn("part", base)
    grid = max(often.values())
    heads = docs.where(F.col("key").isin(list(often))).groupBy("key").agg(F.percentile_approx(F.expr(HEAD), [i / grid for i in range(1, grid)], 10 * grid).alias("at"))
    cut = [(r.key, sorted({r.at[j * grid // often[r.key] - 1] for j in range(1, often[r.key])})) for r in heads.collect()]
    cut = docs.sparkSession.createDataFrame(cut, "key long, heads array<long>")  # no more heads than parts
    head = F.expr(HEAD)
    within = F.when(F.col("heads").isNull(), grid).otherwise(F.size(F.filter("heads", lambda c: c <= head)))
    return docs.join(F.broadcast(cut), "key", "left").withColumn("part", (base * (grid + 1) + within).cast("int")).drop("heads")


def edit_fingerprints(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """EDITS for every row of docs(doc_id, text): its fingerprint and that of its edited text.

    The edited text has its last floor(n/3) code points replaced by the first as many of the next
    document, in descending order of doc_id and, for equal ids, of text; after the last comes the first.
    Rows are dealt out by ranges of doc_id, and of text where one id (or null) has many rows; the row that
    follows a range goes to it too, so that no task sees more than a range and nothing is joined. A null
    doc_id counts as the least of all. A single row is its own next. Rows equal in both stay in one range.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long")))
    (n,) = docs.agg(F.count("*")).first()
    if not n:
        return spark.createDataFrame([], EDITS)
    docs = _ranges(docs, max(1, min(20_000, -(-n // range_rows))))
    tops = {r[0]: r[1] for r in docs.groupBy("part").agg(F.max("key")).collect()}  # a row for each range
    order = sorted(tops)
    follows = {order[i]: order[i + 1] for i in range(len(order) - 1)} | {order[-1]: order[0]}
    heads = spark.createDataFrame([(tops[p], p, follows[p]) for p in order], "key long, part int, above int")
    # of equal greatest ids the row with the greatest text comes first, and that one follows the range above
    first = docs.join(F.broadcast(heads), ["key", "part"]).groupBy("above").agg(F.max_by(F.struct("doc_id", "text"), "text").alias("row")).select(F.col("above").alias("part"), "row.doc_id", F.lit(True).alias("halo"), "row.text", F.lit(None).cast("long").alias("key"))
    rows = docs.select("part", "doc_id", F.lit(False).alias("halo"), "text", "key").union(first)
    dealt = rows.repartition("part").sortWithinPartitions("part", "halo", F.desc("key"), F.desc("text"))
    return dealt.select("part", "doc_id", "halo", "text").mapInArrow(_edit, EDITS)
