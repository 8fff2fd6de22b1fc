"""Operators for training text: brute force, exact round trips, hostile inputs."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mattework.llm import bpe, ctw, dartminhash, exact, langid, lcp, packing, shared, suffix, toxicity, warc
from mattework.llm.queries import tokenizer_path

KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("key", T.StringType()), T.StructField("label", T.IntegerType())])


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéfg") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Empty, null and long texts, repeated rows, ties, a null id, extra columns with clashing names."""
    rng = random.Random(5)
    long = words(rng, 9000)
    base = words(rng, 300)
    texts = ["", None, "  \n\t ", "One", base, base, base.replace(" ", "\n"), base[:-9], long, long[100:], "x" * 3000, words(rng, 40) + base[200:1100] + words(rng, 40), "<|endoftext|> ÀΣ it's 12"]
    rows = [(i, t, "en" if i % 2 else None, "k", i) for i, t in enumerate(texts)] + [(4, base, "en", "k", 4), (None, "null id", None, None, None)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def test_exact(docs, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    got, all_ = exact.exact_groups(docs).collect(), docs.collect()
    for r in got:
        same = [d for d in all_ if hashlib.sha256(norm(d.text).encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(same) and r.keep_id == min((d.doc_id for d in same if d.doc_id is not None), default=None)
    assert len(got) == len(all_) and exact.exact_groups(empty).count() == 0
    owner = exact.directory([(3, 9000, 1), (4, 10, 1), (60000, 10, 1)])
    assert owner[3] != owner[60000] and len(set(owner[[3, 4]])) == 2


def test_near(docs, empty):
    got = {r.doc_id: r.class_id for r in dartminhash.near_groups(docs).collect()}
    assert got[5] == got[6] == got[7] == 4 and got[9] == 8 and got[0] == 0 and got[2] == 2 and got[None] is None
    assert got[11] == 11 and dartminhash.near_groups(empty).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    a = rng.integers(1, 2**63, 200).astype(np.uint64)
    w = rng.choice([0.4, 1.0, 3.0], 200)
    s = dartminhash.signatures(np.concatenate([a, a[:120]]), np.concatenate([w, w[:120]]), np.array([0, 200, 320]), 1024)
    assert abs((s[0] == s[1]).mean() - w[:120].sum() / w.sum()) < 0.06


@pytest.mark.parametrize("limits", [{}, {"FEW": 0, "BLOCK": 4, "SMALL": 2, "LARGE_GROUPS": 0}])
def test_near_against_all_pairs(spark, monkeypatch, limits):
    """Classes are the components of all pairs with a weighted Jaccard similarity of shingle counts of 0.8 or more."""
    for name, value in limits.items():
        monkeypatch.setattr(dartminhash, name, value)
    rng = random.Random(21)
    texts = []
    for _ in range(12):
        base = words(rng, 120).split()
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            texts.append(" ".join(copy))
    line = words(rng, 6)
    texts += [" ".join([line] * n + [words(random.Random(n // 9), 30)]) for n in range(1, 30, 2)]
    rng.shuffle(texts)
    bags = []
    for t in texts:
        w = t.lower().split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    label = list(range(len(texts)))
    for i in range(len(bags)):
        for j in range(i):
            if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total():
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r.doc_id: r.class_id for r in dartminhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == label and 20 < len(set(label)) < len(label)


def test_dense_step(docs, monkeypatch):
    monkeypatch.setattr(dartminhash, "FEW", 0)
    monkeypatch.setattr(dartminhash, "BLOCK", 2)
    monkeypatch.setattr(dartminhash, "SMALL", 2)
    test_near(docs, docs.limit(0))


def test_suffix(docs, empty, monkeypatch):
    got = sorted((tuple(r) for r in suffix.removed_bytes(docs).collect()), key=repr)
    raws = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(b[i : i + 400] for _, b in raws for i in range(len(b) - 399))
    want = []
    for doc, b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((doc, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=repr) and suffix.removed_bytes(empty).count() == 0
    monkeypatch.setattr(suffix, "GROUP", 1)
    assert sorted((tuple(r) for r in suffix.removed_bytes(docs).collect()), key=repr) == got


@pytest.mark.parametrize(("group", "share", "hot"), [(8192, 20_000, 1000), (2, 7, 1), (1, 3, 2)])
def test_suffix_groups_that_are_cut(spark, monkeypatch, group, share, hot):
    """Passages and near copies in very many documents; ranges, groups and hot names of any size give one result."""
    for name, value in (("GROUP", group), ("RANGE", share), ("SAMPLED", 1), ("HOT_PLACES", hot), ("HOT_NAMES", 10**9), ("WINDOWS", 50)):
        monkeypatch.setattr(suffix, name, value)
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    short, long, base = text(34), text(90), text(200)
    texts = [text(60) + (short if i % 2 else long) + text(60) for i in range(60)] + ["", None, base, base]
    for _ in range(40):
        at = rng.randrange(200)
        texts.append(base[:at] + text(rng.randint(0, 2)) + base[at + 1 :])
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 40] for b in raws for i in range(len(b) - 39))
    want = {}
    for k, b in enumerate(raws):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 39):
            if seen[b[i : i + 40]] > 1:
                gone[i : i + 40] = True
        want[k] = (int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = suffix.cut_repeats(docs, length=40, gram=8).collect()
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in got} == want


@pytest.mark.parametrize("hot", [1, 1000])
def test_suffix_marks_runs_of_repeated_stretches_at_once(spark, monkeypatch, hot):
    """Copies and lines of one byte: a mark for each row, where there were as many as stretches (of a line, as bytes)."""
    monkeypatch.setattr(suffix, "HOT_PLACES", hot)
    monkeypatch.setattr(suffix, "HOT_NAMES", 10**9)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    copy = text(2500)
    for times in (1, 2):
        texts = [copy] * (10 * times) + ["-" * (1000 + i) for i in range(10 * times)]
        alone = [text(900), "-" * 399, "", None]
        docs = spark.createDataFrame(list(enumerate(texts + alone)), "row_id long, text string").repartition(1 if hot > 1 else 4)
        marks = {r.row_id: r.marks for r in suffix.marks_of(docs, 400, 32).collect()}
        want = {k: [(0, [0], [len(t) - 400])] for k, t in enumerate(texts)}
        assert {k: [tuple(m) for m in v] for k, v in marks.items()} == want


def test_runs_of_known_stretches():
    name, first = np.array([5, 7, 5, 9, 8, 8, 9, 6]), np.array([0, 3, 4, 9, 12, 20, 21, 30])
    last = np.array([2, 3, 8, 11, 13, 20, 29, 31])  # the starts 14 to 19 are of no stretch: another text follows
    known, a, b = suffix.runs_of_known(name, first, last, np.array([6]))
    assert known.tolist() == [True, False, True, True, True, True, True, True]
    assert list(zip(first[a].tolist(), last[b].tolist(), strict=True)) == [(0, 2), (4, 13), (20, 31)]
    none = np.zeros(0, np.int64)
    assert [x.tolist() for x in suffix.runs_of_known(none, none, none, none)] == [[], [], []]
    assert [x.tolist() for x in suffix.runs_of_known(name[:2], first[:2], last[:2], none)] == [[False, False], [], []]


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(1)
    some = lambda n: bytes(rng.choice(b"ab") for _ in range(rng.randint(0, n)))
    runs = [sorted((some(9), some(3), i) for i in range(40)) for _ in range(5)]
    merged = list(suffix.merge([suffix.front_decode(suffix.front_code(r)) for r in runs]))
    assert [(m[0], m[2]) for m in merged] == sorted(e[:2] for r in runs for e in r)
    for a, b in zip(merged, merged[1:], strict=False):
        assert b[1] == suffix._common(a[0], b[0], 0)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    per, sequences = {}, {}
    for r in got:
        per.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = [p for p in per[r.doc_id] if p.doc_tokens == len(ids)]
        assert sum(p.length for p in mine) % len(ids) == 0
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in mine)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or at & (at - 1) == 0
    assert packing.pack(empty, path).count() == 0


def test_closest_against_all_subsets():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(0, 3) for _ in range(4)}
        room = rng.randint(0, 30)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        got = packing.closest(counts, room)
        assert all(0 < n <= counts[k] for k, n in got.items()) and sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_each_id_once(seed):
    rng = random.Random(seed)
    most = (1, 3, 40)[seed % 3]
    histogram = {rng.randint(1, 64): rng.randint(1, most) for _ in range(rng.randint(1, 40))}
    placements, sequences, pieces = packing.plan(histogram, 64), {}, {}
    shift, blocks = packing.blocks_of(placements, histogram)
    for length, block, first, last, start, size, seq, offset, per in blocks:
        for r in range(first, last):
            if r >> shift[length] == block:
                sequences.setdefault(seq + (r - first) // per, []).append((offset + (r - first) % per * size, size))
                pieces.setdefault((length, r), []).append((start, size))
    for kind, whole in ((sequences, lambda _, n: n == 64 or n & (n - 1) == 0), (pieces, lambda key, n: n == key[0])):
        for key, parts in kind.items():
            at = 0
            for start, size in sorted(parts):
                assert start == at
                at += size
            assert whole(key, at)
    assert set(pieces) == {(k, r) for k, n in histogram.items() for r in range(n)}


def test_plan_does_not_grow_with_the_rows():
    assert len(packing.plan({600: 10**6})) < 100 and len(packing.plan({k: 10**6 - k for k in range(1, 1025)})) < 20_000


def test_ids_of_very_long_runs():
    encode = packing.Encoder(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(2)
    mixed = "".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x3000, 0x9FFF), rng.randint(0x1F300, 0x1FAFF), 32, 10])) for _ in range(60_000))
    assert encode.fast
    for text in (" " * 2_000_000, "\n" * 300_000 + "a", "a" * 200_000, mixed):
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.library(text)


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.code_digests(docs, path).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()) in got
    assert bpe.code_digests(empty, path).count() == 0


def test_lcp(docs, empty):
    got = lcp.edit_fingerprints(docs, 4).collect()
    order = sorted(docs.collect(), key=lambda r: (r.doc_id if r.doc_id is not None else -(1 << 63), r.text or ""), reverse=True)
    want = {}
    for i, r in enumerate(order):
        t, n = r.text or "", order[(i + 1) % len(order)].text or ""
        want.setdefault(r.doc_id, set()).add(hashlib.sha256(lcp.edited(t, n).encode()).hexdigest())
    assert len(got) == len(order) and all(r.edited_sha256 in want[r.doc_id] and 0 <= r.near_edited <= 1 for r in got)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[4] == prints[5] and set(prints[0]) == {"0"} and lcp.edit_fingerprints(empty).count() == 0


def test_lcp_is_local():
    rng = random.Random(2)
    a = words(rng, 400).encode()
    s = lcp.sketch_texts([a, b"some other start of any length " + a, words(rng, 400).encode()])
    near = lcp.likeness(s[[0, 0]], s[[1, 2]])
    assert near[0] > 0.85 and near[1] < 0.1


def test_lcp_edits_against_plain_python(spark):
    """Edited texts over ranges of few rows, beyond the BMP, empty and null; sketches of texts alone; likeness counted bin by bin."""
    rng = random.Random(17)
    texts = [words(rng, rng.randint(1, 120)) + "\U0001f600é" * rng.randint(0, 3) for _ in range(24)] + ["", None, "ab", words(rng, 4000)]
    rows = list(zip(rng.sample(range(-50, 10**12), len(texts)), texts, strict=True))
    got = {r.doc_id: r for r in lcp.edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), range_rows=5).collect()}
    ordered = sorted(rows, reverse=True, key=lambda r: r[0])
    bins = lambda t: lcp.hexed(lcp.sketch_texts([t.encode()]))[0]

    def alike(x, y):
        x, y = ([h[i : i + 4] for i in range(0, len(h), 4)] for h in (x, y))
        either = sum(p != "0000" or q != "0000" for p, q in zip(x, y, strict=True))
        return sum(p == q != "0000" for p, q in zip(x, y, strict=True)) / either if either else 1.0

    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        changed = "".join([*text[: len(text) - k], *following[:k]])
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (bins(text), bins(changed))
        assert r.near_edited == alike(bins(text), bins(changed)) and r.near_next == alike(bins(text), bins(following))


def test_lcp_deals_one_frequent_id_by_text(spark):
    """Rows without an id, a third of all and of one, are cut by their texts; edits are those of the whole order."""
    rng = random.Random(23)
    rows = [(None, words(rng, rng.randint(1, 30))) for _ in range(60)] + [(7, words(rng, 9)) for _ in range(30)] + [(i, words(rng, 9)) for i in range(100, 190)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    assert max(r["count"] for r in lcp._ranges(keyed, 36).groupBy("part").count().collect()) <= 12
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1].encode()), reverse=True)
    want = sorted((str(d), hashlib.sha256(lcp.edited(t, order[(i + 1) % len(order)][1]).encode()).hexdigest()) for i, (d, t) in enumerate(order))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in lcp.edit_fingerprints(docs, range_rows=5).collect()) == want


def test_ctw(docs, empty):
    got = {r.doc_id: r for r in ctw.score_texts(docs).collect() if r.doc_id is not None}
    joined = {r.doc_id: r for r in ctw.score_texts(docs, vocabulary=0).collect() if r.doc_id is not None}
    assert got[0].n_tokens == 1 and got[4].score < got[0].score < 0 and got[0].score == got[1].score
    rows = docs.collect()
    of = lambda r: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")] + [None]
    learned = Counter(w for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for w in of(r))
    total, kinds = sum(learned.values()), len(learned)
    for r in rows:
        if r.doc_id is not None and r.doc_id != 4 and all(c.isascii() or not c.isupper() for c in r.text or ""):
            base = sum(math.log10((learned[w] + 1) / (total + kinds + 1)) for w in of(r))
            told = got[r.doc_id]
            assert abs(told.base_score - base) < 1e-6 * abs(base) and told.train_tokens == total and told.n_tokens == len(of(r))
            assert told.n_known == sum(learned[w] > 0 for w in of(r)) and told.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
            assert abs(told.bits_per_byte + told.score / math.log10(2) / (len((r.text or "").encode()) + 1)) < 1e-9
    for i, r in got.items():
        assert r.n_known == joined[i].n_known and abs(r.base_score - joined[i].base_score) < 1e-6 * abs(r.base_score)
    assert ctw.score_texts(empty).count() == 0


def test_ctw_is_a_distribution(docs):
    tables = ctw.fit(docs.select("text"))
    grams = np.arange(256, dtype=np.uint64) | np.uint64(ord("a") << 8 | ord("b") << 16)
    assert abs((10 ** ctw.gram_scores(grams, tables)).sum() - 1) < 1e-9


def ctw_plain(train, texts):
    """log10 probability of texts by the definition, on dictionaries of whole contexts."""
    bits = lambda t: [(t[max(0, i - 5) : i].rjust(5, b"\0")[::-1], 1 << k | c >> 8 - k, c >> 7 - k & 1) for i, c in enumerate(t) for k in range(8)]
    count = Counter((c[:d], node, bit) for t in train for c, node, bit in bits(t) for d in range(6))
    kids = {}
    for c, node, _ in count:
        if c:
            kids.setdefault((c[:-1], node), set()).add(c)
    ab = lambda c, node: (count[c, node, 0], count[c, node, 1])
    lg, weigh = math.lgamma, {}

    def weighted(c, node):
        if (c, node) not in weigh:
            a, b = ab(c, node)
            own = lg(a + 0.5) + lg(b + 0.5) - 2 * lg(0.5) - lg(a + b + 1)
            total, stop = own, 1.0
            if len(c) < 5:
                total = float(np.logaddexp(own, sum(weighted(k, node)[0] for k in kids[c, node])) - math.log(2))
                stop = math.exp(own - math.log(2) - total)
            weigh[c, node] = total, stop
        return weigh[c, node]

    def score(t):
        out = 0.0
        for c, node, bit in bits(t):
            p, deeper = 0.5, False
            for d in range(5, -1, -1):
                a, b = ab(c[:d], node)
                if a + b:
                    stop = weighted(c[:d], node)[1] if deeper else 1.0
                    p, deeper = stop * (b + 0.5) / (a + b + 1) + (1 - stop) * p, True
            out += math.log10(p if bit else 1 - p)
        return out

    return [score(t) for t in texts]


def test_ctw_scores_are_exact(spark):
    rng = random.Random(11)
    rows = [(i, words(rng, 12) if i else "") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = [t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    assert 0 < len(train) < len(rows)
    want = ctw_plain([t + b"\xff" for t in train], [t.encode() + b"\xff" for _, t in rows])
    for limit in (ctw.GRAMS, 0):  # broadcast and joined
        got = {r.doc_id: r.score for r in ctw.score_texts(docs, grams=limit).collect()}
        assert all(abs(got[i] - want[i]) < 1e-8 * abs(want[i]) for i, _ in rows)


def test_languages_and_toxicity_take_hostile_inputs(spark, docs, empty):
    got = {r.doc_id: r for r in langid.predict_languages(docs).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[1].score == 0 and got[4].lang_pred == "en"
    assert langid.predict_languages(empty).count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(13)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, labels).collect())
    assert toxicity.score_toxicity(docs, labels.limit(0)).count() == docs.count() and toxicity.score_toxicity(empty, labels).count() == 0


def test_language_scores_and_rejection_against_plain_python(spark):
    rng = np.random.default_rng(9)
    model = langid.Model(["aa", "bb", "cc"], rng.normal(0, 9, (1 << langid.BUCKET_BITS, 3)), rng.normal(0, 1, 3))
    texts = [words(random.Random(i), i % 40 + 1) for i in range(300)]
    plain = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        found, _ = langid.buckets(data, np.array([0, len(data)]))
        assert len(found) == sum(max(len(data) - n + 1, 0) for n in langid.GRAMS)
        z = [sum(model.logits[b, k] for b in found) / max(len(found), 1) + model.bias[k] for k in range(3)]
        e = [math.exp(v - max(z)) for v in z]
        plain.append((model.names[z.index(max(z))], max(e) / sum(e)))
    labels = [name if i % 3 else "cc" for i, (name, _) in enumerate(plain)]
    docs = spark.createDataFrame(list(zip(range(300), texts, labels, strict=True)), "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predicted(docs, model, ["doc_id"]).collect()}
    assert all(got[i].lang_pred == name and abs(got[i].score - p) < 1e-9 for i, (name, p) in enumerate(plain))
    right = sorted(p for i, (name, p) in enumerate(plain) if labels[i] == name)
    assert langid.rejection(docs, model) == pytest.approx(right[int(len(right) * langid.REJECT_SHARE)])
    assert langid.rejection(docs.where("false"), model) == 0.0


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than the sample has rows for at the usual share: each gives fewer, none is left out."""
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 600)
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = {f"l{k}": [letters[k] + "".join(rng.choices(letters, k=4)) for _ in range(12)] for k in range(20)}
    rows = [(i, " ".join(rng.choices(kinds[f"l{i % 20}"], k=15)), f"l{i % 20}") for i in range(2000)]
    got = langid.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} == set(kinds)
    assert sum(r.lang_pred == f"l{r.doc_id % 20}" for r in got if r.held_out) > 0.9 * sum(r.held_out for r in got)


def test_languages_are_learned_from_every_row(spark, monkeypatch):
    """What only rows outside of the start's sample show is learned too, and all of a tenth fits the rejection."""
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 6)
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = [["".join(rng.choices(letters, k=6)) for _ in range(4)] for _ in range(60)]  # a language has 30 kinds of text, most in no sample
    rows = [(i, " ".join(rng.choices(kinds[i % 60], k=12)), f"l{i % 2}") for i in range(6000)]
    judged = []
    monkeypatch.setattr(langid, "rejection", lambda labelled, model, judge=langid.rejection: judged.append(labelled.count()) or judge(labelled, model))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r for r in langid.predict_languages(docs).collect() if r.held_out]
    assert sum(r.lang_pred == f"l{r.doc_id % 2}" for r in got) > 0.95 * len(got)
    learnable = docs.where(langid.fold_of(4) != 2)
    assert judged == [learnable.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10)) == 1).count()]


def test_batches_are_only_made_smaller(spark):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(rows), spark.conf.get(size)
    try:
        for now, most, want in (("10000", 500, "500"), ("400", 1000, "400"), ("0", 1000, "1000")):
            spark.conf.set(rows, now)
            shared.small_batches(spark, most)
            assert spark.conf.get(rows) == want
        spark.conf.set(size, "64m")
        shared.small_batches(spark)
        long = spark.range(0, 100, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
        sizes = [r.n for r in long.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()]
        assert sum(sizes) == 100 and max(sizes) <= 5
    finally:
        spark.conf.set(rows, before[0])
        spark.conf.set(size, before[1])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = langid.predict_languages(documents).where("held_out").join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    scored = toxicity.score_toxicity(documents, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in scored) / len(scored) > 0.9


def test_isotonic_rises():
    c, v = toxicity.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert (np.diff(v) > 0).all() and (np.diff(c) > 0).all()


def test_warc(spark, docs):
    pages = docs.selectExpr("doc_id AS page_id", "key AS url", "text AS html", "label")
    got = {r.page_id: r for r in warc.warc_roundtrip(pages).collect()}
    assert got[4].record_type == "revisit" and got[4].refers_to == 5 and got[5].record_type == "response" and got[0].refers_to == 1
    assert got[12].payload_digest == warc.digest("<|endoftext|> ÀΣ it's 12".encode())
    assert warc.warc_roundtrip(pages.limit(0)).count() == 0


def test_warc_against_plain_python(spark):
    """Every record by its definition: length and digest of the payload, the largest page_id of equal ones the response."""
    import base64

    rng = random.Random(9)
    kinds = ["", None, "a", "\r\n\r\nWARC/1.0", words(rng, 2000), "é" * 300]
    rows = [(i, f"http://h/{i}", kinds[rng.randrange(6)] if i % 3 else words(rng, 5)) for i in range(90)]
    got = {r.page_id: tuple(r[c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.warc_roundtrip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(i, last.get(html or "", -1))
    for i, _, html in rows:
        raw, top = (html or "").encode(), last[html or ""]
        told = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert got[i] == (len(raw), told, "response" if top == i else "revisit", None if top == i else top)
    assert len(got) == 90


def test_normaliser_reads_one_stream_and_writes_members():
    raw = [warc.record(i, "u", b"\r\n\r\nWARC/1.1" * i, "response", None, "d") for i in range(20)]
    members = list(warc.normalise(io.BytesIO(b"".join(warc.write_monolith(iter(raw))))))
    assert [zlib.decompress(m, 31) for m, _ in members] == raw
    at = 0
    for i, (m, line) in enumerate(members):
        assert line == f"{at} {len(m)} {i}\n".encode()
        at += len(m)


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.selectExpr("doc_id", "text", "lang", "key AS source", "cast(length(text) as bigint) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in rows}
    assert 4 in ids and not ids & {0, 1, 2, 5, 6, 7} and 8 in ids and 9 not in ids


@pytest.mark.parametrize("stage", ["exact_duplicates", "near_duplicates"])
def test_pipeline_judges_rows_not_ids(spark, stage):
    import corpus_pipeline

    rng = random.Random(21)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    # expected: rows in order of (doc_id, text) with the first of each text, null ids last
    cases = {
        "one null id": ([(None, a), (1, b)], [(None, a), (1, b)]),
        "one id with two texts": ([(1, a), (2, a), (2, b)], [(1, a), (2, b)]),
        "equal rows without an id": ([(None, a), (None, a), (None, b), (3, b)], [(None, a), (3, b)]),
        "all ids apart": ([(1, a), (2, a), (3, c)], [(1, a), (3, c)]),
        "equal rows of one id": ([(5, d), (5, d), (4, c)], [(5, d), (4, c)]),
    }
    for name, (rows, want) in cases.items():
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        got = getattr(corpus_pipeline, stage)(spark, docs, "").collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr), name


def test_suffix_of_a_text_that_is_worked_on_in_pieces(spark):
    rng = np.random.default_rng(11)
    letters = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    shared, cut = letters(900), suffix.TEXT_BYTES
    long = bytearray(letters(2 * cut + 5000))
    for at in (cut - 500, cut + 100, 2 * cut - 399):  # across a cut, from it on, up to one
        long[at : at + 900] = shared
    texts = {1: bytes(long), 2: letters(300) + shared[100:], 3: bytes(long[cut - 1000 : cut + 50]), 4: b"short"}
    windows = Counter(t[i : i + 400] for t in texts.values() for i in range(len(t) - 399))
    want = {}
    for k, t in texts.items():
        gone = np.zeros(len(t) + 400, bool)
        for i in range(len(t) - 399):
            if windows[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        want[k] = (int(gone.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone[: len(t)]].tobytes()).hexdigest())
    docs = spark.createDataFrame([(k, t.decode()) for k, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix.removed_bytes(docs).collect()} == want and want[1][0] > 1800
