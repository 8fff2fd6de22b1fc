"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the 3- and 4-byte grams of the lower-cased text with white space as one mark; each hashes to
one of 2**BUCKET_BITS buckets. A text's vector is the mean of its buckets' embeddings; a linear softmax
over it gives the language. Embeddings and softmax are learned by stochastic gradient descent in numpy from every
labelled row but two tenths, whole texts: each task descends over all of its rows from one start, and what the tasks come
to is averaged by their rows. The start is trained on the driver on some of these rows, about SAMPLE for each language,
chosen by a hash of doc_id (with more than SAMPLE_ROWS / SAMPLE languages each gives an equal share of SAMPLE_ROWS). Every
language of a labelled row is learned. Of the two tenths all rows count: one fits a temperature, the other is predicted
and fits the rejection: the score below which a text is rejected, set so that of those rightly named REJECT_SHARE at most
falls below it. Without such rows nothing but texts without a letter is rejected.

A null text and a text without a letter get `und` with score 0 and are rejected. An empty table or one
without labelled rows gives `und` for all. Columns other than text, lang and doc_id are not read; only
text is an input of a prediction. Repeated rows are predicted each.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mattework.llm.bytesops import LOWER, NAMES, SPACE, U, give_back, gram_hash, prefix_sums, text_blocks
from mattework.llm.shared import materialize, small_batches

BUCKET_BITS, DIM = 13, 16
#: Rows of each language that train the start, in the mean, and of all languages together.
SAMPLE, SAMPLE_ROWS = 1200, 480_000
REJECT_SHARE = 0.001
#: Of the descent over all rows: its first rate, and how often a block of texts is gone through.
RATE, ROUNDS = 0.5, 3
#: Texts in a step, and by how much shares are scaled (they are small) to make the mean vector of unit order.
STEP_ROWS, SCALE = 32, np.float32(20.0)
#: Tasks whose outcomes are averaged together, and the averages that reach the driver at most.
AVERAGED, AVERAGES = 6, 16
GRAMS = (3, 4)


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the subwords and the documents' offsets into them."""
    plain = np.where(SPACE[data], np.uint8(32), LOWER[data])
    sums = prefix_sums(NAMES[plain])
    size = np.diff(offsets)
    out, owner = [], []
    for n in GRAMS:
        hashes = (gram_hash(sums, n) >> U(64 - BUCKET_BITS)).astype(np.int32)
        per = np.maximum(size - n + 1, 0)
        first = np.repeat(offsets[:-1] - (np.cumsum(per) - per), per) + np.arange(per.sum())
        out.append(hashes[first])
        owner.append(per)
    total = np.sum(owner, axis=0)
    at = np.concatenate([[0], np.cumsum(total)])
    joined = np.empty(at[-1], np.int32)
    low = at[:-1].copy()
    for values, per in zip(out, owner, strict=True):
        joined[np.repeat(low - (np.cumsum(per) - per), per) + np.arange(len(values))] = values
        low += per
    return joined, at


@dataclass
class Model:
    names: list[str]
    logits: np.ndarray  # (buckets, languages): embedding times softmax, over the temperature
    bias: np.ndarray
    reject: float = 0.0

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found, at = buckets(data, offsets)
        count = np.maximum(np.diff(at), 1)
        z = np.empty((len(count), len(self.names)))
        for k in range(len(self.names)):
            total = np.concatenate([[0.0], np.cumsum(self.logits[found, k])])
            z[:, k] = (total[at[1:]] - total[at[:-1]]) / count + self.bias[k]
        return softmax(z)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Shares:
    """Each text's shares of the subwords, kept sparse; only the rows asked for are made dense."""

    def __init__(self):
        self.kinds: list[np.ndarray] = []
        self.shares: list[np.ndarray] = []

    def add(self, kinds: list[int], counts: list[int]):
        self.kinds.append(np.array(kinds, np.int32))
        self.shares.append((np.array(counts, np.float32) / np.float32(sum(counts) or 1)).astype(np.float16))

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), 1 << BUCKET_BITS), np.float32)
        for i, r in enumerate(rows.tolist()):
            out[i, self.kinds[r]] = self.shares[r]
        return out


@dataclass
class Net:
    embed: np.ndarray  # (buckets, DIM)
    weight: np.ndarray  # (DIM, languages)
    bias: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Logits of the shares x, before a temperature."""
        return (x * SCALE) @ self.embed @ self.weight + self.bias

    def step(self, x: np.ndarray, labels: np.ndarray, rate: float) -> None:
        """A step of gradient descent, in place."""
        x = x * SCALE
        h = x @ self.embed
        g = softmax(h @ self.weight + self.bias).astype(np.float32)
        g[np.arange(len(x)), labels] -= 1
        g /= len(x)
        back = g @ self.weight.T
        self.weight -= rate * (h.T @ g)
        self.bias -= rate * g.sum(axis=0)
        self.embed -= rate * (x.T @ back)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.embed, self.weight, self.bias)])

    @staticmethod
    def of(flat: np.ndarray, k: int) -> Net:
        embed, weight, bias = np.split(flat.astype(np.float32), [DIM << BUCKET_BITS, (DIM << BUCKET_BITS) + DIM * k])
        return Net(embed.reshape(-1, DIM), weight.reshape(DIM, k), bias)


def train(features: Shares, labels: np.ndarray, k: int, epochs: int = 30, rate: float = 2.0, seed: int = 7) -> Net:
    """The start: a net of k languages from the rows of features."""
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM)).astype(np.float32), np.zeros((DIM, k), np.float32), np.zeros(k, np.float32))
    rows = np.arange(len(labels))
    for epoch in range(epochs):
        rng.shuffle(rows)
        for low in range(0, len(rows), STEP_ROWS):
            some = rows[low : low + STEP_ROWS]
            net.step(features.dense(some), labels[some], rate * (1 - epoch / epochs))
    return net


def _shares(batches, names):
    """Each block's shares of the subwords, a row a text, and its labels."""
    place = {name: i for i, name in enumerate(names)}
    for batch, data, offsets in text_blocks(batches):
        found, at = buckets(data, offsets)
        x = np.empty((batch.num_rows, 1 << BUCKET_BITS), np.float32)
        for i in range(len(x)):
            x[i] = np.bincount(found[at[i] : at[i + 1]], minlength=1 << BUCKET_BITS)
        x /= np.maximum(np.diff(at), 1)[:, None].astype(np.float32)
        yield x, np.array([place[name] for name in batch["lang"].to_pylist()])


def refined(rows: DataFrame, names: list[str], start: Net) -> Net:
    """start after a descent over every row of rows(text, lang): the tasks' nets, averaged by their rows."""
    held = rows.sparkSession.sparkContext.broadcast(start.flat())
    kind = "part long, rows long, net binary"

    def descend(batches):
        from pyspark import TaskContext

        net, rng, seen, blocks = Net.of(held.value, len(names)), np.random.default_rng(7), 0, 0
        for x, labels in _shares(batches, names):
            blocks += 1
            for _ in range(ROUNDS):
                order = rng.permutation(len(x))
                for low in range(0, len(x), STEP_ROWS):
                    some = order[low : low + STEP_ROWS]
                    net.step(x[some], labels[some], RATE / blocks**0.5 * len(some) / STEP_ROWS)
            seen += len(x)
        if seen:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([seen]), pa.array([net.flat().tobytes()], pa.binary())], ["part", "rows", "net"])

    def mean(key, found):
        seen, nets = found["rows"].to_numpy(), (np.frombuffer(x.as_py(), np.float32) for x in found["net"])
        total = sum(float(n) * net.astype(np.float64) for n, net in zip(seen, nets, strict=True)) / seen.sum()
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "rows": pa.array([int(seen.sum())]), "net": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    nets = rows.select("text", "lang").mapInArrow(descend, kind)
    nets = nets.groupBy(F.floor(F.col("part") / AVERAGED).alias("to")).applyInArrow(mean, kind)
    nets = nets.groupBy((F.col("part") % AVERAGES).alias("to")).applyInArrow(mean, kind)
    total, seen = 0.0, 0
    for r in nets.toLocalIterator():
        total, seen = total + float(r["rows"]) * np.frombuffer(r["net"], np.float32).astype(np.float64), seen + r["rows"]
    return Net.of(total / seen, len(names)) if seen else start


def temperature(rows: DataFrame, names: list[str], net: Net) -> float:
    """By which logits are divided: where the loss over all of rows(text, lang) is least, 1 without rows."""
    held, steps = rows.sparkSession.sparkContext.broadcast(net.flat()), np.geomspace(0.25, 8, 40)

    def losses(batches):
        net, loss = Net.of(held.value, len(names)), np.zeros(len(steps))
        for x, labels in _shares(batches, names):
            z = net.raw(x)
            loss += [-np.log(np.maximum(softmax(z / t)[np.arange(len(x)), labels], 1e-12)).sum() for t in steps]
        yield pa.record_batch([pa.array([loss.tolist()])], ["loss"])

    loss = sum(np.array(r["loss"]) for r in rows.select("text", "lang").mapInArrow(losses, "loss array<double>").toLocalIterator())
    return float(steps[int(np.argmin(loss))]) if np.any(loss) else 1.0


def _histograms(batches):
    for batch, data, offsets in text_blocks(batches):
        found, at = buckets(data, offsets)
        kinds, counts = [], []
        for i in range(len(at) - 1):
            kind, count = np.unique(found[at[i] : at[i + 1]], return_counts=True)
            kinds.append(kind)
            counts.append(count.astype(np.int32))
        yield pa.record_batch([batch["lang"], pa.array(kinds, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["lang", "kinds", "counts"])


def learn(docs: DataFrame, train_rows, sample: int = SAMPLE) -> Model | None:
    """A model from the rows of docs(doc_id, text, lang) that the condition train_rows names."""
    known = docs.where(train_rows & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    known = known.where(F.col("text").rlike("\\p{L}"))
    counts = known.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return None
    names = sorted(r["lang"] for r in counts)
    sample = min(sample, SAMPLE_ROWS / len(names))
    spot = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10))
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1 << 30, int(sample / r["count"] * (1 << 30)) + 1))]), F.col("lang"))
    known = known.withColumn("fold", fold)
    learned = known.where("fold > 1")
    features, labels = Shares(), []
    for r in learned.where(spot < share).select("text", "lang").mapInArrow(_histograms, "lang string, kinds array<int>, counts array<int>").toLocalIterator():
        features.add(r["kinds"], r["counts"])
        labels.append(names.index(r["lang"]))
    if not labels:
        return None
    start = train(features, np.array(labels), len(names))
    del features
    give_back()
    net = refined(learned, names, start)
    t = temperature(known.where("fold = 0"), names, net)
    model = Model(names, (SCALE * net.embed @ net.weight / t).astype(np.float64), (net.bias / t).astype(np.float64))
    return replace(model, reject=rejection(known.where("fold = 1"), model))


def rejection(labelled: DataFrame, model: Model) -> float:
    """The score below which REJECT_SHARE of the rightly named rows of labelled(text, lang) fall at most: counted by
    narrow ranges of scores, then looked up in the one that has it."""
    found = materialize(predicted(labelled, model, ["lang"]).where("lang_pred = lang").selectExpr("score", "cast(floor(score * 65536) as int) AS slot"), "scores")
    slots = sorted((r["slot"], r["count"]) for r in found.groupBy("slot").count().toLocalIterator())
    nth = int(sum(n for _, n in slots) * REJECT_SHARE)
    for slot, n in slots:
        if nth < n:
            return float(found.where(F.col("slot") == slot).orderBy("score").offset(nth).first()["score"])
        nth -= n
    return 0.0


def _predict(held):
    def run(batches):
        model = held.value
        for batch, data, offsets in text_blocks(batches):
            if model is None:
                best, top = [None] * batch.num_rows, np.zeros(batch.num_rows)
                reject = np.ones(batch.num_rows, bool)
            else:
                p = model.probabilities(data, offsets)
                best, top = [model.names[i] for i in p.argmax(axis=1)], p.max(axis=1)
                reject = top < model.reject
            letters = np.asarray(batch["letters"].fill_null(False))
            lang = [b if ok and b is not None else "und" for b, ok in zip(best, letters, strict=True)]
            yield pa.record_batch([batch["rest"], pa.array(lang), pa.array(np.where(letters, top, 0.0)), pa.array(reject | ~letters)], ["rest", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, train_rows, keep: list[str]) -> DataFrame:
    """The columns in keep, and lang_pred, score, rejected, for every row of docs(doc_id, text, lang)."""
    small_batches(docs.sparkSession, 500)
    return predicted(docs, learn(docs, train_rows), keep)


def predicted(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.select(F.struct(*keep).alias("rest"), F.col("text").cast("string").alias("text"), F.col("text").rlike("\\p{L}").alias("letters"))
    kind = rest.schema["rest"].dataType.simpleString()
    out = rest.mapInArrow(_predict(held), f"rest {kind}, lang_pred string, score double, rejected boolean")
    return out.select("rest.*", "lang_pred", "score", "rejected")


def fold_of(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learned from rows with crc32(doc_id) mod 4 other than 2."""
    docs = docs.select("doc_id", "text", "lang", F.coalesce(fold_of(4) == 2, F.lit(False)).alias("held_out"))
    return identify(docs, ~F.col("held_out"), ["doc_id", "held_out"])
