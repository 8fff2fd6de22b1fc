"""Near-duplicate detection by DartMinHash.

A document is the multiset of its word shingles: a shingle weighs as much as often as it stands there. Darts are thrown by hashing at the regions of
each element: the weight axis is cut into cells [0,1), [1,2), [2,4), ..., and in each cell darts arrive as
a Poisson process along the rank axis, each with a hashed rank, weight and coordinate. A dart hits if its
weight is below the element's. Only ranks below (k ln k + 2k) / total weight are thrown, twice as many
where a coordinate stayed empty, so a document costs about its elements plus k ln k darts. The earliest
dart of each of the k coordinates is the signature; two documents agree in a coordinate with a
probability of their weighted Jaccard similarity.

Signatures are cut into bands of `rows` coordinates. Two documents with a similarity of 0.8 share none of
the 20 bands of 4 with a probability of 3e-5. Every link is decided by the exact weighted Jaccard similarity
of the multisets, held as sets of 32-bit hashes of (shingle, how many of it stood before):

1. Documents of the same words in the same order are one from the start.
2. In each bucket everyone is compared with the least member, then links give components.
3. In buckets that still hold several components, signatures are compared across components, in blocks;
   large buckets that share members are taken together, so that no pair is compared in every band.
   A member with few partners that its signature does not rule out lists them, and those pairs are
   compared. The members of a block that have more are compared all at once, by the product of their
   incidence matrix with itself, and only links of a spanning tree are emitted.
4. Components of all links.

So a group of many thousand near copies costs a few rows a member. Step 3 has no cap: a group of m members
of many components costs m**2 / 2 signature comparisons, spread over pairs of blocks.

Null and empty texts, and texts of white space alone, have no shingle and no link. A text of less than
five words is one shingle. Repeated rows (also of one doc_id) are copies of each other. Texts are worked on whole,
however long. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mattework.llm.bytesops import LOWER, NAMES, U, mix, prefix_sums, span_hash, text_blocks, word_spans
from mattework.llm.shared import bitmap, components, flagged, materialize, small_batches

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
#: Standard deviations below the threshold at which signatures rule a pair out.
MARGIN = 5.0
#: Members of a bucket that one task compares with one another.
BLOCK = 1024
#: Members of a bucket that is a group by itself.
SMALL = 256
#: Partners in a block that a member lists; a member of more is compared with all such by a matrix product.
FEW = 8
#: Groups of more than BLOCK members whose numbers are broadcast; those of more groups are joined.
LARGE_GROUPS = 100_000
_WEIGHT, _SLOT, _STEP = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3)


def _unit(x: np.ndarray) -> np.ndarray:
    """(0, 1] from 64 bits."""
    return ((x >> U(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(elements: np.ndarray, weights: np.ndarray | None, offsets: np.ndarray, k: int) -> np.ndarray:
    """(sets, k) ids of the earliest darts; 0 for a set without weight.

    elements: 64-bit hashes, weights: positive (None: all 1), offsets: of the sets into them. An element
    that stands twice in a set counts as the one of larger weight, as its darts are the same.
    """
    n = len(offsets) - 1
    out = np.zeros((n, k), U)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    if weights is None:
        total = size.astype(np.float64)
        cells = [(0.0, 1.0, elements, owner, None)]
    else:
        cumulative = np.concatenate([[0.0], np.cumsum(weights)])
        total = cumulative[offsets[1:]] - cumulative[offsets[:-1]]
        cells, low, high = [], 0.0, 1.0
        while (sel := np.flatnonzero(weights > low)).size:
            cells.append((low, high - low, elements[sel], owner[sel], weights[sel]))
            low, high = high, high * 2
    bound = np.where(total > 0, (k * math.log(max(k, 2)) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    while todo.any():
        slots, ranks, darts = [], [], []
        for number, (low, width, ids, of, weight) in enumerate(cells):
            keep = todo[of]
            seed = mix(ids[keep] ^ mix(np.full(1, number, U)))
            of, limit = of[keep], bound[of[keep]]
            weight = weight[keep] if weight is not None else None
            rank, turn = np.zeros(len(of)), 0
            while len(of):
                dart = mix(seed + U(int(_STEP) * turn % 2**64))
                rank = rank - np.log(_unit(dart)) / width
                here = rank <= limit
                seed, of, limit, rank, dart = seed[here], of[here], limit[here], rank[here], dart[here]
                if weight is not None:
                    weight = weight[here]
                    hit = low + _unit(mix(dart ^ _WEIGHT)) * width <= weight
                    slots.append((of * k + (mix(dart ^ _SLOT) % U(k)).astype(np.int64))[hit])
                    ranks.append(rank[hit])
                    darts.append(dart[hit])
                else:
                    slots.append(of * k + (mix(dart ^ _SLOT) % U(k)).astype(np.int64))
                    ranks.append(rank)
                    darts.append(dart)
                turn += 1
        slot, rank, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(darts)
        order = np.argsort(rank)[::-1]  # the earliest dart of a slot is written last
        flat = out.reshape(-1)
        flat[slot[order]] = dart[order] | U(1)
        todo &= (out == 0).any(axis=1)
        out[todo] = 0
        bound[todo] *= 2
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, the documents' offsets into them, and a hash of each document's sequence of words.

    Words are runs of bytes other than white space, A-Z in lower case.
    """
    start, end, at = word_spans(data, offsets)
    names = span_hash(prefix_sums(NAMES[LOWER[data]]), start, end)
    count = np.diff(at)
    sums = prefix_sums(names)
    whole = span_hash(sums, at[:-1], at[1:])
    per = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    to = np.concatenate([[0], np.cumsum(per)])
    first = np.repeat(at[:-1], per) + np.arange(to[-1]) - np.repeat(to[:-1], per)
    last = np.minimum(first + words, np.repeat(at[1:], per))
    return span_hash(sums, first, last), to, whole


def weighed(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document, how often each stands there, the documents' offsets into both; and
    for each shingle in the order (document, shingle) a hash of it and of the number of equal ones before."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    turn = np.arange(len(hashes)) - np.repeat(first, np.diff(np.append(first, len(hashes))))
    single = np.where(turn > 0, mix(hashes + turn.astype(U) * _STEP), hashes)
    return hashes[first], np.diff(np.append(first, len(hashes))).astype(np.float64), np.searchsorted(owner[first], np.arange(len(at))), single


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, k = signature.shape
    keys = np.zeros((n, k // rows), U)
    for i in range(rows):
        keys = mix(keys ^ signature[:, i::rows][:, : k // rows])
    return mix(keys + np.arange(k // rows, dtype=U))


SIGNED = "doc_id long, words_hash long, n_shingles long, bands array<long>, signature binary"


def _sign(words: int, bands: int, rows: int):
    def run(batches):
        for batch, data, offsets in text_blocks(batches):
            hashes, at, whole = shingles(data, offsets, words)
            elements, weights, of, _ = weighed(hashes, at)
            signature = signatures(elements, weights, of, bands * rows)
            full = np.diff(at) > 0
            keys = band_keys(signature, rows).astype(np.int64)
            size = np.where(full, bands, 0)
            short = (signature & U(0xFFFF)).astype("<u2")
            yield pa.record_batch(
                [
                    batch["doc_id"],
                    pa.array(whole.astype(np.int64)),
                    pa.array(np.diff(at).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(keys[full].reshape(-1))),
                    pa.array([x.tobytes() for x in short], pa.binary()),
                ],
                ["doc_id", "words_hash", "n_shingles", "bands", "signature"],
            )

    return run


def _sets(words: int, bits: int, held):
    """Multisets of the documents whose flag is set, so that no other text moves."""

    def run(batches):
        flags = held.value
        for batch in batches:
            some = flagged(flags, bits, np.asarray(batch["spot"]))
            for part, data, offsets in text_blocks([batch.filter(pa.array(some))]):
                hashes, at, _ = shingles(data, offsets, words)
                short = (weighed(hashes, at)[3] >> U(32)).astype("<u4")
                yield pa.record_batch([part["doc_id"], pa.array([np.unique(short[at[i] : at[i + 1]]).tobytes() for i in range(len(at) - 1)], pa.binary())], ["id", "members"])

    return run


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, members): the shingle multiset of each document of ids(id), as sorted 32-bit hashes."""
    spark = docs.sparkSession
    ids = materialize(ids.distinct(), "ids")
    bits, flags = bitmap(ids.select(F.xxhash64("id").alias("hash")), ids.count())
    found = docs.where("doc_id is not null").withColumn("spot", F.xxhash64("doc_id")).mapInArrow(_sets(words, bits, spark.sparkContext.broadcast(flags)), "id long, members binary")
    return materialize(found.dropDuplicates(["id"]).join(ids, "id", "left_semi"), "sets")


def _linked(threshold: float):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u4") for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common >= threshold * (len(both) - common) - 1e-9)
            yield pa.record_batch([batch["a"], batch["b"], pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    return run


def verified(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, linked) of pairs(a, b), by the Jaccard similarity of their sets(id, members)."""
    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
    return materialize(joined.select("a", "b", "x", "y").mapInArrow(_linked(threshold), "a long, b long, linked boolean"), "verified")


def _across(k: int, least: int):
    """What is left to compare in a pair of blocks of a bucket.

    Rows (a, b): members of different components whose signatures agree often enough, listed by each
    member that has FEW such partners at most. Rows (a, null): a member that has more.
    """

    def run(keys, table):
        ids, labels, side = (np.asarray(table[c]) for c in ("id", "label", "block"))
        raw = np.frombuffer(b"".join(table["signature"].to_pylist()), "<u2").reshape(len(ids), k)
        p, q = keys[1].as_py(), keys[2].as_py()
        a, b = [], []
        for i in range(len(ids)):
            others = np.flatnonzero((labels != labels[i]) & (side == (q if side[i] == p else p)))
            close = others[(raw[others] == raw[i]).sum(axis=1) >= least]
            if len(close) > FEW:
                a.append(ids[i])
                b.append(None)
            else:
                a += [int(ids[i])] * len(close)
                b += ids[close].tolist()
        n = len(a)
        return pa.table({"key": pa.array([keys[0].as_py()] * n, pa.int64()), "p": pa.array([p] * n, pa.int32()), "q": pa.array([q] * n, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _dense(threshold: float):
    """Links that join the members of a group, from the product of its incidence matrix with itself."""

    def run(table):
        ids, side = np.asarray(table["id"]), np.asarray(table["block"])
        m = len(ids)
        sets = [np.frombuffer(x, "<u4") for x in table["members"].to_pylist()]
        size = np.array([len(x) for x in sets])
        names, back = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(m), size)
        shared = np.bincount(back, minlength=len(names)) > 1
        place = np.cumsum(shared) - 1
        row, column = row[shared[back]], place[back[shared[back]]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        one, two = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
        at = np.zeros(m, np.int64)
        at[one], first = np.arange(len(one)), side[row] == side.min()
        at[two] = np.arange(len(two))
        common = np.zeros((len(one), len(two)), np.float32)
        for low in range(0, int(shared.sum()), 2048):
            i, j = np.searchsorted(column, [low, low + 2048])
            r, c, f = row[i:j], column[i:j] - low, first[i:j]
            x = np.zeros((len(one), 2048), np.float32)
            x[at[r[f]], c[f]] = 1
            if side.min() == side.max():
                y = x
            else:
                y = np.zeros((len(two), 2048), np.float32)
                y[at[r[~f]], c[~f]] = 1
            common += x @ y.T
        link = common >= threshold * (size[one][:, None] + size[two][None, :] - common) - 1e-4
        near = [[] for _ in range(m)]
        for i, j in zip(*(x.tolist() for x in np.nonzero(link)), strict=True):
            near[one[i]].append(two[j])
            near[two[j]].append(one[i])
        a, b, left = [], [], np.ones(m, bool)
        for seed in range(m):  # a spanning tree of each component
            edge = [seed] if left[seed] else []
            left[seed] = False
            while edge:
                i = edge.pop()
                for j in near[i]:
                    if left[j]:
                        left[j] = False
                        a.append(int(ids[i]))
                        b.append(int(ids[j]))
                        edge.append(j)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _blocks(members: DataFrame) -> DataFrame:
    """members(group, id) with each group in blocks; every pair of blocks (p, q) is one task's work."""
    sizes = materialize(members.groupBy("group").count().where(F.col("count") > BLOCK).select("group", F.ceil(F.col("count") / BLOCK).cast("int").alias("more")), "sizes")
    place = members.join(F.broadcast(sizes) if sizes.count() <= LARGE_GROUPS else sizes, "group", "left").withColumn("blocks", F.coalesce("more", F.lit(1))).drop("more")
    place = place.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    place = place.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return place.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other")).drop("blocks", "other")


def near_groups(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, class_size, kept) for every row of docs(doc_id, text).

    class_id is the least doc_id of the documents that links join; the row with that id is kept. Of
    repeated rows with that id all count as kept. A null doc_id is a class of its own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    k = bands * rows
    least = max(1, math.floor(k * threshold - MARGIN * math.sqrt(k * threshold * (1 - threshold))))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(docs.mapInArrow(_sign(words, bands, rows), SIGNED), "signed")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    heads = materialize(named.groupBy("words_hash", "n_shingles").agg(F.min("doc_id").alias("head"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("signature", "doc_id").alias("signature")), "heads")
    keys = heads.select(F.col("head").alias("id"), F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a", "n")
    stars = materialize(keys.join(buckets, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "stars")
    ends = lambda pairs: pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    tried = verified(sets_of(docs, ends(stars), words), stars, threshold)
    links = tried.where("linked").select("a", "b")
    labels = components(links)

    known = heads.select(F.col("head").alias("id"), "bands", "signature").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"), "bands", "signature")
    members = known.select("id", "label", F.explode("bands").alias("key"))
    mixed = materialize(members.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key", "n"), "mixed")
    # a small bucket is a group; large ones that share members are one, so that each pair is compared once
    small = members.join(mixed.where(F.col("n") <= SMALL), "key").select(F.col("key").alias("group"), "id", "label")
    large = materialize(members.join(mixed.where(F.col("n") > SMALL), "key").select("key", "id", "label"), "large")
    if not large.isEmpty():
        joint = components(large.join(large.groupBy("key").agg(F.min("id").alias("a")), "key").select("a", F.col("id").alias("b")).distinct())
        small = small.union(large.select("id", "label").distinct().join(joint.withColumnRenamed("label", "joint"), "id").select(F.xxhash64("joint", F.lit("large")).alias("group"), "id", "label"))
    place = _blocks(small).select(F.col("group").alias("key"), "p", "q", "block", "id", "label").join(known.select("id", "signature"), "id")
    across = materialize(place.groupBy("key", "p", "q").applyInArrow(_across(k, least), "key long, p int, q int, a long, b long"), "across")
    pairs = across.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    few = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "few")
    many = materialize(across.where("b is null").select(F.col("key").alias("group"), F.col("a").alias("id")).distinct(), "many")
    wanted = ends(few).union(many.select("id"))
    if not wanted.isEmpty():
        sets = sets_of(docs, wanted, words)
        dense = _blocks(many).join(sets, "id").groupBy("group", "p", "q").applyInArrow(_dense(threshold), "a long, b long")
        links = links.union(verified(sets, few, threshold).where("linked").select("a", "b")).union(materialize(dense, "dense"))
        labels = components(links)

    classes = heads.select("words_hash", "n_shingles", "head").join(labels.withColumnRenamed("id", "head"), "head", "left").select("words_hash", "n_shingles", F.coalesce("label", "head").alias("class_id"))
    found = signed.select("doc_id", "words_hash", "n_shingles").join(classes, ["words_hash", "n_shingles"], "left")
    found = found.select("doc_id", F.when(F.col("n_shingles") > 0, F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"))
    sizes = found.groupBy(F.col("class_id").alias("of")).agg(F.count("*").alias("class_size"))
    return found.join(sizes, F.col("class_id").eqNullSafe(F.col("of"))).select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
