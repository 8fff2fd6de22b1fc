"""Language-model scoring by context-tree weighting over bytes.

A text is its bytes (A-Z in lower case) and one end, a byte that UTF-8 never has, so that the probabilities of all
texts add up to at most 1. A byte is eight binary decisions, from the high bit down; a decision's node is the bits
before it. For each node there is a context tree over the DEPTH bytes before, nearest first (zero bytes
before a text's start). Every tree node s has counts (a, b) of zeros and ones, its Krichevsky-Trofimov
block probability Pe(s), and the weighted probability Pw(s) = Pe(s)/2 + (product of Pw of its children)/2;
a decision is predicted by mixing (b + 1/2)/(a + b + 1) over all depths with the weight Pe(s)/2 / Pw(s) at
each node, from the deepest seen context up. A context never seen in training passes on its parent's
estimate. The sum of the logarithms is the code length.

Counts are of all grams of DEPTH + 1 bytes of the training texts, gathered exactly; the trees are worked
out by their two nearest bytes, in parallel, and no context shares a count with another. Every distinct gram
of all rows is scored once where its tree is, so the model grows with the corpus. Scores by gram are broadcast
if there are at most GRAMS; beyond that, each document's gram counts are joined with them.

The base is a unigram model of words with add-one smoothing. Its vocabulary is broadcast if it has at most
VOCABULARY words; beyond that, each document's word counts are joined with it. Words are compared by
64-bit hashes. Null counts as empty: one token (the end) and the end's score. An empty training set scores every bit
as 1/2. Repeated rows are scored each; null doc_ids are training rows. Texts of any length are scored whole, in
blocks of whole texts. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mattework.llm.bytesops import LOWER, NAMES, U, mix, prefix_sums, span_hash, sums_by, text_blocks, word_spans
from mattework.llm.langid import fold_of
from mattework.llm.shared import materialize, small_batches

DEPTH = 5
#: The end of a text.
LAST = 0xFF
GRAMS = 6_000_000
VOCABULARY = 6_000_000
END = int(mix(np.array([0xE0D], U))[0].astype(np.int64))


def grams_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the texts and of their ends with the DEPTH before it: byte | nearest << 8 | ... ; zeros before a
    text's start. And the offsets of the texts into these."""
    low = np.insert(LOWER[data], offsets[1:], LAST).astype(U)
    offsets = offsets + np.arange(len(offsets))
    out = low.copy()
    for j in range(1, DEPTH + 1):
        before = np.zeros_like(low)
        before[j:] = low[: max(0, len(low) - j)]
        for i in range(j):  # the first j bytes of a text have fewer before them
            at = offsets[:-1] + i
            before[at[at < offsets[1:]]] = 0
        out |= before << U(8 * j)
    return out, offsets


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, after seven steps up."""
    y = x + 7.0
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


_HALF = float(log_gamma(np.array([0.5]))[0])


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - 2 * _HALF - log_gamma(a + b + 1.0)


def decisions(grams: np.ndarray, n: np.ndarray):
    """(context << 8 | node, zeros, ones) of the decisions of grams with counts, keys sorted."""
    symbol, context = grams & U(255), grams >> U(8)
    keys, ones, count = [], [], []
    for level in range(8):
        keys.append(context << U(8) | U(1 << level) | symbol >> U(8 - level))
        ones.append(n * ((symbol >> U(7 - level)) & U(1)).astype(np.int64))
        count.append(n)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    b = np.bincount(back, np.concatenate(ones).astype(np.float64))
    return key, np.bincount(back, np.concatenate(count).astype(np.float64)) - b, b


def lift(key: np.ndarray, a: np.ndarray, b: np.ndarray, weighted: np.ndarray, depth: int):
    """From the nodes of one depth to those of the depth above: (key, a, b, log Pw, weight of stopping)."""
    up = (key >> U(8) & U((1 << (8 * depth)) - 1)) << U(8) | (key & U(255))
    up, back = np.unique(up, return_inverse=True)
    a, b, below = (np.bincount(back, x, len(up)) for x in (a, b, weighted))
    own = log_kt(a, b)
    total = np.logaddexp(own, below) - np.log(2)
    return up, a, b, total, np.exp(own - np.log(2) - total)


class Nodes(NamedTuple):
    """Nodes of one depth: sorted keys (context << 8 | node), counts, log Pw, weight of stopping."""

    key: np.ndarray
    a: np.ndarray
    b: np.ndarray
    weighted: np.ndarray
    stop: np.ndarray


class Model(NamedTuple):
    """Counts (gram, n) as a table, n of training rows only, and the nodes of depths 0 and 1."""

    counts: DataFrame
    top: list[Nodes]


NODE = "key long, a double, b double, weighted double"
NEAR = "shiftrightunsigned(gram, 8) & 65535"


def subtree(table: pa.Table) -> dict[int, Nodes]:
    """Nodes of depths 2..DEPTH below one pair of nearest bytes, of the grams with counts."""
    grams, n = np.asarray(table["gram"]).astype(U), np.asarray(table["n"])
    grams, n = grams[n > 0], n[n > 0]
    if not len(grams):
        return {}
    key, a, b = decisions(grams, n)
    out = {DEPTH: Nodes(key, a, b, log_kt(a, b), np.ones(len(key)))}
    for depth in range(DEPTH - 1, 1, -1):
        below = out[depth + 1]
        out[depth] = Nodes(*lift(below.key, below.a, below.b, below.weighted, depth))
    return out


def _second(table: pa.Table) -> pa.Table:
    nodes = subtree(table).get(2)
    cols = nodes[:4] if nodes else [np.zeros(0)] * 4
    return pa.table([pa.array(np.asarray(c).astype(t)) for c, t in zip(cols, (np.int64, float, float, float), strict=True)], names=["key", "a", "b", "weighted"])


def _count_grams(batches):
    held, size = [], 0

    def out():
        # a held-out row's gram counts 0; its mark stands above the 48 bits
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        n[grams >> U(48) > 0] = 0
        return pa.record_batch([pa.array((grams & U((1 << 48) - 1)).astype(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    for batch, data, offsets in text_blocks(batches):
        mark = np.asarray(batch["held_out"].to_pylist(), U) << U(48)
        found, at = grams_of(data, offsets)
        held.append(found | np.repeat(mark, np.diff(at)))
        size += len(found)
        if size > 6 << 20:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def fit(texts: DataFrame) -> Model:
    """The model of texts(text), learned from all rows, or from those that are not held_out if there is such a column."""
    if "held_out" not in texts.columns:
        texts = texts.withColumn("held_out", F.lit(False))
    grams = materialize(texts.select("text", "held_out").mapInArrow(_count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    second = grams.groupBy(F.expr(NEAR).alias("near")).applyInArrow(lambda t: _second(t), NODE)
    nearest = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFF))

    def first(table: pa.Table) -> pa.Table:
        nodes = lift(np.asarray(table["key"]).astype(U), *(np.asarray(table[c]) for c in ("a", "b", "weighted")), 1)
        return pa.table([pa.array(nodes[0].astype(np.int64)), *(pa.array(x) for x in nodes[1:])], names=["key", "a", "b", "weighted", "stop"])

    # depths 1 and 0: at most 65,280 and 255 nodes
    one = sorted(tuple(r) for r in second.groupBy(nearest.alias("nearest")).applyInArrow(lambda t: first(t), f"{NODE}, stop double").collect())
    if not one:
        return Model(grams, [])
    key, *rest = (np.array(c) for c in zip(*one, strict=True))
    depth1 = Nodes(key.astype(U), *rest)
    return Model(grams, [Nodes(*lift(depth1.key, depth1.a, depth1.b, depth1.weighted, 0)), depth1])


def log_probability(grams: np.ndarray, trees: dict[int, Nodes]) -> np.ndarray:
    """log10 probability of each gram's last byte after the others; trees has the nodes by depth."""
    symbol, context = grams & U(255), grams >> U(8)
    total = np.zeros(len(grams))
    for level in range(8):
        node = U(1 << level) | symbol >> U(8 - level)
        p, any_ = np.full(len(grams), 0.5), np.zeros(len(grams), bool)
        for depth in sorted(trees, reverse=True):
            nodes = trees[depth]
            key = (context & U((1 << (8 * depth)) - 1)) << U(8) | node
            at = np.minimum(np.searchsorted(nodes.key, key), len(nodes.key) - 1)
            seen = nodes.key[at] == key
            own = (nodes.b[at] + 0.5) / (nodes.a[at] + nodes.b[at] + 1)
            stop = np.where(any_, nodes.stop[at], 1.0)
            p = np.where(seen, stop * own + (1 - stop) * p, p)
            any_ |= seen
        one = (symbol >> U(7 - level) & U(1)) > 0
        total += np.log10(np.where(one, p, 1 - p))
    return total


def score_grams(model: Model) -> DataFrame:
    """(gram, score) of every gram of the model's counts, also of those that no training row has."""
    top = model.counts.sparkSession.sparkContext.broadcast(model.top)

    def run(table: pa.Table) -> pa.Table:
        trees = dict(enumerate(top.value)) | subtree(table)
        return pa.table({"gram": table["gram"], "score": pa.array(log_probability(np.asarray(table["gram"]).astype(U), trees))})

    return model.counts.select("gram", "n").groupBy(F.expr(NEAR).alias("near")).applyInArrow(lambda t: run(t), "gram long, score double")


def gram_scores(grams: np.ndarray, model: Model) -> np.ndarray:
    """log10 probability of each of a few grams' last bytes after the others."""
    spark = model.counts.sparkSession
    asked = spark.createDataFrame([(int(g), 0) for g in grams.astype(np.int64)], "gram long, n long")
    counts = model.counts.union(asked).groupBy("gram").agg(F.sum("n").alias("n"))
    scores = {r.gram: r.score for r in score_grams(Model(counts, model.top)).join(asked.select("gram"), "gram", "left_semi").collect()}
    return np.array([scores[int(g)] for g in grams.astype(np.int64)])


# --- the base: words -----------------------------------------------------------------------------


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, at = word_spans(data, offsets)
    return span_hash(prefix_sums(NAMES[LOWER[data]]), start, end), at


def _count_words(batches):
    held, size, ends = [], 0, 0

    def out():
        names, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(np.append(names.astype(np.int64), END)), pa.array(np.append(n.astype(np.int64), ends))], ["hash", "n"])

    for batch, data, offsets in text_blocks(batches):
        held.append(words_of(data, offsets)[0])
        size, ends = size + len(held[-1]), ends + batch.num_rows
        if size > 1 << 21:
            yield out()
            held, size, ends = [], 0, 0
    if held:
        yield out()


def _blob(batches):
    for batch in batches:
        yield pa.record_batch([pa.array([np.asarray(batch["hash"]).tobytes()], pa.binary()), pa.array([np.minimum(np.asarray(batch["n"]), 2**31 - 1).astype("<i4").tobytes()], pa.binary())], ["hashes", "counts"])


def _score_blob(batches):
    for batch in batches:
        yield pa.record_batch([pa.array([np.asarray(batch[c]).tobytes()], pa.binary()) for c in ("gram", "score")], ["grams", "scores"])


SCORED = "doc_id long, held_out boolean, row_id long, n_bytes long, n_tokens long, n_known long, base_score double, score double"


def _score(held, tokens: int, kinds: int):
    def run(batches):
        table, vocabulary = held.value
        below = np.log10(float(tokens) + (kinds + 1))
        end = 0
        if vocabulary is not None:
            hashes, counts = vocabulary
            at = np.searchsorted(hashes, END)
            end = int(counts[at]) if at < len(hashes) and hashes[at] == END else 0
        for batch, data, offsets in text_blocks(batches):
            score = np.zeros(batch.num_rows)
            if table is not None:
                found, ends = grams_of(data, offsets)
                new, back = np.unique(found.astype(np.int64), return_inverse=True)
                score = sums_by(table[1][np.searchsorted(table[0], new)][back], ends)
            names, at = words_of(data, offsets)
            n = np.diff(at) + 1
            known, base = np.zeros(len(n), np.int64), np.zeros(len(n))
            if vocabulary is not None:
                names = names.astype(np.int64)
                new = np.unique(names)
                place = np.minimum(np.searchsorted(hashes, new), len(hashes) - 1) if len(hashes) else None
                c = np.where(hashes[place] == new, counts[place], 0) if len(hashes) else np.zeros(len(new), np.int64)
                c = c[np.searchsorted(new, names)]
                known = sums_by(c > 0, at) + (end > 0)
                logs = np.log10(c + 1.0) - below
                base = np.array([logs[at[i] : at[i + 1]].sum() for i in range(len(n))]) + (np.log10(end + 1.0) - below)
            yield pa.record_batch([batch["doc_id"], batch["held_out"], batch["row_id"], pa.array(np.diff(offsets)), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "row_id", "n_bytes", "n_tokens", "n_known", "base_score", "score"])

    return run


def _word_rows(batches):
    for batch, data, offsets in text_blocks(batches):
        names, at = words_of(data, offsets)
        owner = np.repeat(np.asarray(batch["row_id"]), np.diff(at))
        yield pa.record_batch([pa.array(np.concatenate([owner, np.asarray(batch["row_id"])])), pa.array(np.concatenate([names.astype(np.int64), np.full(batch.num_rows, END, np.int64)]))], ["row_id", "hash"])


def _gram_rows(batches):
    for batch, data, offsets in text_blocks(batches):
        # grams have 48 bits, and a block has at most 2**16 rows (small_batches)
        found, at = grams_of(data, offsets)
        each, n = np.unique(found | np.repeat(np.arange(batch.num_rows), np.diff(at)).astype(U) << U(48), return_counts=True)
        owner = np.asarray(batch["row_id"])[(each >> U(48)).astype(np.int64)]
        yield pa.record_batch([pa.array(owner), pa.array((each & U((1 << 48) - 1)).astype(np.int64)), pa.array(n.astype(np.int64))], ["row_id", "gram", "k"])


def score_texts(docs: DataFrame, vocabulary: int = VOCABULARY, grams: int = GRAMS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of
    docs(doc_id, text). bits_per_byte is the code length of the text and its end by their number of bytes.

    Learned from the rows with crc32(doc_id as text) mod 7 other than 2.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(fold_of(7) == 2, F.lit(False)).alias("held_out"))
    docs = docs.withColumn("row_id", F.xxhash64("doc_id", "text"))
    texts = docs.where("not held_out").select("text")
    scores = materialize(score_grams(fit(docs)), "scores")
    table = None
    if scores.count() <= grams:
        blobs = list(scores.orderBy("gram").mapInArrow(_score_blob, "grams binary, scores binary").toLocalIterator())
        table = (np.frombuffer(b"".join(bytes(r[0]) for r in blobs), np.int64), np.frombuffer(b"".join(bytes(r[1]) for r in blobs), np.float64))
    words = materialize(texts.mapInArrow(_count_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "words")
    kinds, tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    broadcast = None
    if kinds <= vocabulary and tokens < 1 << 31:
        blobs = list(words.orderBy("hash").mapInArrow(_blob, "hashes binary, counts binary").toLocalIterator())
        hashes = np.frombuffer(b"".join(bytes(r[0]) for r in blobs), np.int64)
        counts = np.frombuffer(b"".join(bytes(r[1]) for r in blobs), "<i4")
        broadcast = (hashes, counts)
    held = spark.sparkContext.broadcast((table, broadcast))
    scored = docs.mapInArrow(_score(held, tokens, kinds), SCORED)
    if broadcast is None:
        per = docs.select("row_id", "text").dropDuplicates(["row_id"]).mapInArrow(_word_rows, "row_id long, hash long").groupBy("row_id", "hash").agg(F.count("*").alias("k"))
        c = F.coalesce("n", F.lit(0))
        joined = per.join(words, "hash", "left").groupBy("row_id").agg(F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("n_known"), F.sum(F.col("k") * (F.log10(c + 1.0) - F.log10(F.lit(float(tokens + kinds + 1))))).alias("base_score"))
        scored = scored.drop("n_known", "base_score").join(joined, "row_id")
    if table is None:
        per = docs.select("row_id", "text").dropDuplicates(["row_id"]).mapInArrow(_gram_rows, "row_id long, gram long, k long")
        joined = per.join(scores, "gram").groupBy("row_id").agg(F.sum(F.col("k") * F.col("score")).alias("score"))
        scored = scored.drop("score").join(joined, "row_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") / F.lit(math.log10(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
