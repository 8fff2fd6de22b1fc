"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labels are used on a bounded sample of at most about SAMPLE labelled rows, chosen by a hash of doc_id and
cut in three by another: one part finds the lexicon (words, and beginnings of words of 4 and 5 bytes, that
stand far more often in toxic texts than in others), the second grows the trees, the third calibrates.
Features of a whole text: densities and counts of the lexicon, lexicon words near the second person,
capitals, punctuation, obfuscation (signs and digits inside words), repeats and lengths. Trees are grown
on histograms of quantile bins by Newton steps of the logistic loss; pool-adjacent-violators maps their
sum to a probability, linear between the centres of its blocks.

Null and empty texts have all-zero features and get a score like any other. Repeated rows are scored
each. Without labels of both kinds every score is the share of toxic ones (0 without any). Rows of labels
for one doc_id more than once count each. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mattework.llm.bytesops import LOWER, NAMES, U, mix, prefix_sums, span_hash, sums_by, text_blocks, word_spans
from mattework.llm.langid import fold_of
from mattework.llm.shared import materialize, small_batches

SAMPLE = 24_000
LEXICON = 4096
#: Words that address the reader, in the languages of the corpus. Fixed values.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie ihnen ihre tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros vuestro".split()
NEAR = 4
BINS, DEPTH, TREES, RATE = 32, 3, 80, 0.15
_PREFIX = U(0x517CC1B727220A95)

IS_UPPER = np.zeros(256, bool)
IS_UPPER[65:91] = True
IS_ALPHA = IS_UPPER.copy()
IS_ALPHA[97:123] = True
IS_ALPHA[128:] = True
IS_DIGIT = np.zeros(256, bool)
IS_DIGIT[48:58] = True
IS_SIGN = np.zeros(256, bool)
IS_SIGN[33:128] = True
IS_SIGN &= ~IS_ALPHA & ~IS_DIGIT


def hash_word(word: bytes) -> int:
    raw = np.frombuffer(word, np.uint8)
    return int(span_hash(prefix_sums(NAMES[raw]), np.array([0]), np.array([len(raw)]))[0])


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """Bare words (outer signs stripped, lower case): hash, hash of the first 4 and 5 bytes (0 if shorter), starts, ends, offsets."""
    start, end, at = word_spans(data, offsets)
    low = LOWER[data]
    s, e = start.copy(), end.copy()
    for _ in range(3):
        s += (s < e) & IS_SIGN[low[np.minimum(s, len(low) - 1)]] if len(low) else 0
        e -= (e > s) & IS_SIGN[low[np.maximum(e - 1, 0)]] if len(low) else 0
    sums = prefix_sums(NAMES[low])
    whole = span_hash(sums, s, e)
    heads = [np.where(e - s > n, span_hash(sums, s, np.minimum(s + n, e)) ^ _PREFIX, U(0)) for n in (4, 5)]
    return whole, heads, start, end, at


FEATURES = 20


def features(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, heads: np.ndarray, second: np.ndarray) -> np.ndarray:
    """(texts, FEATURES); words, heads: sorted hashes of the lexicon; second: of the second person."""
    whole, begins, start, end, at = word_hashes(data, offsets)
    size = np.diff(offsets).astype(np.float64)
    count = np.diff(at).astype(np.float64)
    bytes_, per = np.maximum(size, 1), np.maximum(count, 1)

    def within(table, x):
        return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x if len(table) else np.zeros(len(x), bool)

    bad, begun, you = within(words, whole), within(heads, begins[0]) | within(heads, begins[1]), within(second, whole)
    n_bad, n_begun, n_any, n_you = (sums_by(x, at) for x in (bad, begun, bad | begun, you))
    seen = np.concatenate([[0], np.cumsum(you)])
    i = np.arange(len(whole))
    doc = np.repeat(np.arange(len(count)), np.diff(at))
    close = seen[np.minimum(i + NEAR + 1, at[doc + 1])] - seen[np.maximum(i - NEAR, at[doc])] > 0
    n_close = sums_by((bad | begun) & close, at)
    upper, alpha, digit, sign = (table[data] for table in (IS_UPPER, IS_ALPHA, IS_DIGIT, IS_SIGN))
    tot = lambda x: np.concatenate([[0], np.cumsum(x)])
    t_upper, t_alpha, t_odd = tot(upper), tot(alpha), tot(digit | sign)
    inner_odd = t_odd[np.maximum(end - 1, start)] - t_odd[np.minimum(start + 1, end)]
    obfuscated = (inner_odd > 0) & (t_alpha[end] - t_alpha[start] > 0)
    shouted = (t_upper[end] - t_upper[start] == end - start) & (end - start > 2)
    again = np.zeros(len(data), bool)
    again[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    excl, ask, star = ((data == ord(c)) for c in "!?*")
    cols = [
        n_bad, n_bad / per, n_begun, n_begun / per, n_any, n_any / per, np.minimum(n_any, 3), n_close, n_close / per, n_you / per,
        sums_by(upper, offsets) / bytes_, sums_by(shouted, at) / per, sums_by(excl, offsets) / bytes_, sums_by(ask, offsets) / bytes_, sums_by(star, offsets) / bytes_, sums_by(sign, offsets) / bytes_,
        sums_by(digit, offsets) / bytes_, sums_by(obfuscated, at) / per, sums_by(again, offsets) / bytes_, np.log1p(count),
    ]
    return np.stack(cols, axis=1)


# --- the model ---------------------------------------------------------------------------------


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="higher")) for j in range(x.shape[1])]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


@dataclass
class Boosted:
    edges: list[np.ndarray]
    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, leaf values

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        out = np.full(len(x), self.start)
        for which, at, leaf in self.trees:
            out += leaf[self._leaf(b, which, at)]
        return out

    @staticmethod
    def _leaf(b: np.ndarray, which: np.ndarray, at: np.ndarray) -> np.ndarray:
        node = np.zeros(len(b), np.int64)
        rows = np.arange(len(b))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[rows, which[node]] > at[node])
        return node - (2**DEPTH - 1)


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE, ridge: float = 1.0) -> Boosted:
    """Trees of fixed depth; a node without a gain sends all rows left."""
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Boosted(bin_edges(x), float(np.log(share / (1 - share))))
    b = binned(x, model.edges)
    margin = np.full(len(y), model.start)
    inner = 2**DEPTH - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        which, at = np.zeros(inner, np.int64), np.full(inner, 255, np.int64)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, wide = 2**depth - 1, 2**depth
            local = node - first
            best = np.full(wide, 1e-6)
            for j in range(x.shape[1]):
                cell = local * 256 + b[:, j]
                gs = np.bincount(cell, g, wide * 256).reshape(wide, 256)[:, :BINS].cumsum(axis=1)
                hs = np.bincount(cell, h, wide * 256).reshape(wide, 256)[:, :BINS].cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < 1) | (ht - hs < 1)] = -1
                top = gain.argmax(axis=1)
                value = gain[np.arange(wide), top]
                better = value > best
                best[better], which[first:][:wide][better], at[first:][:wide][better] = value[better], j, top[better]
            node = 2 * node + 1 + (b[np.arange(len(y)), which[node]] > at[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        model.trees.append((which, at, value))
        margin += value[leaf]
    return model


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the blocks of the best rising step function (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, sum of scores
    for s, v, w in zip(score[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([v * w, w, s * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            for k in range(3):
                blocks[-1][k] += last[k]
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.02) / (b[1] + 0.04) for b in blocks])


@dataclass
class Scorer:
    words: np.ndarray
    heads: np.ndarray
    second: np.ndarray
    model: Boosted | None
    centres: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.full(len(x), self.values[0])
        return np.clip(np.interp(self.model.raw(x), self.centres, np.maximum.accumulate(self.values)), 0.0, 1.0)


def _vocabulary(batches):
    """Distinct word and prefix hashes of each text, counted by kind and label within the batch."""
    for batch, data, offsets in text_blocks(batches, limit=1 << 20):
        whole, heads, _, _, at = word_hashes(data, offsets)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        label = np.asarray(batch["toxic"]).astype(bool)
        for kind, hashes in enumerate((whole, np.concatenate(heads))):
            of = doc if not kind else np.concatenate([doc, doc])
            some = hashes != 0
            salted = mix(hashes[some] ^ mix(of[some].astype(U)))
            _, first = np.unique(salted, return_index=True)  # once for each text
            hashes_, of_ = hashes[some][first], of[some][first]
            names, back = np.unique(hashes_, return_inverse=True)
            bad = np.bincount(back, label[of_], len(names)).astype(np.int64)
            n = np.bincount(back, minlength=len(names)).astype(np.int64)
            yield pa.record_batch([pa.array(np.full(len(names), kind, np.int32)), pa.array(names.astype(np.int64)), pa.array(bad), pa.array(n - bad)], ["kind", "hash", "bad", "good"])


def _rows(held):
    def run(batches):
        words, heads, second = held.value
        for batch, data, offsets in text_blocks(batches):
            x = features(data, offsets, words, heads, second)
            yield pa.record_batch([batch["toxic"], batch["part"], pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "part", "x"])

    return run


def learn(docs: DataFrame, labels: DataFrame, train_rows, sample: int = SAMPLE) -> Scorer:
    """docs(doc_id, text), labels(doc_id, toxic); train_rows: a condition on doc_id."""
    spark = docs.sparkSession
    second = np.sort(np.array([hash_word(w.encode()) for w in SECOND_PERSON], U))
    none = np.zeros(0, U)
    known = labels.where(train_rows & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or toxic in (0, n):
        return Scorer(none, none, second, None, none, np.array([toxic / n if n else 0.0]))
    # up to half of the sample for the rarer label
    spot = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30))
    shares = [min(1 << 30, int(max(sample / 2, sample - (n - k)) / k * (1 << 30)) + 1) for k in (n - toxic, toxic)]
    chosen = known.where(spot < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0]))
    # the sample is bounded, so it goes to the texts and no other text moves
    chosen = materialize(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10)).cast("int").alias("part")), "labelled")
    first = chosen.where("part < 3").mapInArrow(_vocabulary, "kind int, hash long, bad long, good long").groupBy("kind", "hash").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = chosen.where("part < 3").agg(F.sum("toxic"), F.count("*")).first()
    ratio = (odds[1] - (odds[0] or 0) + 1) / ((odds[0] or 0) + 1)
    lift = F.log((F.col("bad") + 0.5) * ratio / (F.col("good") + 0.5))
    lexicon = first.where("bad >= 3").withColumn("lift", lift).where("lift > 2.5").orderBy(F.desc(F.col("lift")), F.desc("bad"), "hash").limit(LEXICON).collect()
    words, heads = (np.sort(np.array([r["hash"] for r in lexicon if r["kind"] == k], np.int64).astype(U)) for k in (0, 1))
    held = spark.sparkContext.broadcast((words, heads, second))
    rows = chosen.where("part >= 3").mapInArrow(_rows(held), "toxic int, part int, x array<double>").collect()  # bounded by the sample
    x, y, part = (np.array([r[c] for r in rows]) for c in ("x", "toxic", "part"))
    tree, cal = part < 7, part >= 7
    if not len(rows) or len(set(y[tree].tolist())) < 2 or len(set(y[cal].tolist())) < 2:
        return Scorer(words, heads, second, None, none, np.array([toxic / n]))
    model = boost(x[tree], y[tree].astype(np.float64))
    weight = np.array([(1 << 30) / k if k else 0.0 for k in shares])[y[cal]]  # undoes the sampling by label
    centres, values = isotonic(model.raw(x[cal]), y[cal].astype(np.float64), weight)
    return Scorer(words, heads, second, model, centres, values)


def _score(held):
    def run(batches):
        scorer = held.value
        for batch, data, offsets in text_blocks(batches):
            p = scorer.score(features(data, offsets, scorer.words, scorer.heads, scorer.second))
            yield pa.record_batch([batch["doc_id"], pa.array(p)], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; labels of held-out rows are not used."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    held_out = F.coalesce(fold_of(5) == 0, F.lit(False))
    scorer = spark.sparkContext.broadcast(learn(docs, labels, ~held_out))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(scorer), "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
