"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The symbols of a word are the leaves' places of a segment tree; a leaf holds (rank of the pair that
starts there, place), the root the least of all, that is the leftmost pair of lowest rank. A merge
changes three leaves at most, each a walk to the root. Words of one tree size are merged together, one
column of a numpy tree each; a word of more than LONG symbols has a tree of its own in plain lists.

The vocabulary is read from a tokenizers JSON file: NFC, lower case by character, white space dropped,
words by the pattern in the file, byte-level symbols, a suffix on the last one. Its added tokens are
found in the raw text first. Null text counts as empty: no ids. Every row gives one row, repeated or not.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mattework.llm.shared import small_batches

NONE = np.int64(1) << 62
SHIFT = 24  # place in the low bits of a leaf; SHORT words only
LONG = 256


def byte_symbols() -> list[str]:
    """The printable character of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


class WordBPE:
    LIMIT = 120_000

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.names = {i: t for t, i in vocab.items()}
        self.added = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.names |= {i: t for t, i in self.added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        pattern = next(x["pattern"]["Regex"] for x in told["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(pattern).findall
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = {}
        for rank, (a, b) in enumerate(model["merges"]):
            pairs[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys], np.int64)
        self.made = np.zeros(len(model["merges"]), np.int64)
        for rank, new in pairs.values():
            self.made[rank] = new
        self.cache: dict[str, str] = {}
        self.plain: dict[str, str] = {}

    # --- the tree -----------------------------------------------------------------------------

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.ranks[at], NONE >> SHIFT)

    def merge_all(self, words: list[np.ndarray]) -> list[list[int]]:
        """Ids of words of symbols, each by its own tree; those of like size go together."""
        out: list[list[int]] = [[]] * len(words)
        sizes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.merge_long(w.tolist())
            elif len(w) < 2:
                out[i] = w.tolist()
            else:
                sizes.setdefault(1 << (len(w) - 1).bit_length(), []).append(i)
        for size, at in sizes.items():
            for low in range(0, len(at), 20_000):
                some = at[low : low + 20_000]
                for i, ids in zip(some, self._merge(size, [words[i] for i in some]), strict=True):
                    out[i] = ids
        return out

    def _merge(self, size: int, words: list[np.ndarray]) -> list[list[int]]:
        n = len(words)
        lengths = np.array([len(w) for w in words])
        token = np.full((n, size + 1), -1, np.int64)
        token[np.repeat(np.arange(n), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.concatenate(words)
        after = np.broadcast_to(np.minimum(np.arange(1, size + 2), size), (n, size + 1)).copy()
        before = np.broadcast_to(np.arange(-1, size), (n, size + 1)).copy()
        place = np.arange(size, dtype=np.int64)
        tree = np.full((n, 2 * size), NONE, np.int64)
        tree[:, size:] = self.rank(token[:, :-1], token[:, 1:]) << SHIFT | place
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        top = (NONE >> SHIFT) << SHIFT
        live = np.flatnonzero(tree[:, 1] < top)
        while len(live):
            root = tree[live, 1]
            at = root & ((1 << SHIFT) - 1)
            gone = after[live, at]
            nxt = after[live, gone]
            token[live, at] = self.made[root >> SHIFT]
            token[live, gone] = -1
            after[live, at] = nxt
            before[live, nxt] = at
            prev = before[live, at]
            has = prev >= 0
            left = np.where(has, prev, 0)
            new = token[live, at]
            tree[live, size + gone] = NONE
            tree[live, size + at] = self.rank(new, token[live, nxt]) << SHIFT | at
            tree[live, size + left] = np.where(has, self.rank(token[live, left], np.where(has, new, -1)) << SHIFT | left, tree[live, size + left])
            for leaf in (gone, at, left):
                node = (size + leaf) >> 1
                while node[0]:
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                    node = node >> 1
            live = live[tree[live, 1] < top]
        kept = token[:, :-1]
        flat, count = kept[kept >= 0].tolist(), (kept >= 0).sum(axis=1).tolist()
        out, low = [], 0
        for c in count:
            out.append(flat[low : low + c])
            low += c
        return out

    def merge_long(self, token: list[int]) -> list[int]:
        """The same with one tree in lists: n log n for n symbols."""
        n = len(token)
        size, pairs, none = 1 << (n - 1).bit_length(), self.pairs, (1 << 60, 0)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)

        def leaf(i):
            j = after[i]
            found = pairs.get(token[i] << 20 | token[j]) if j < n else None
            return (found[0], i) if found else none

        for i in range(n):
            tree[size + i] = leaf(i)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] is not none and tree[1] < none:
            i = tree[1][1]
            j = after[i]
            token[i], token[j] = pairs[token[i] << 20 | token[j]][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            changed = [(j, none), (i, leaf(i))]
            if before[i] >= 0:
                changed.append((before[i], leaf(before[i])))
            for k, value in changed:
                node = size + k
                tree[node] = value
                node >>= 1
                while node:
                    a, b = tree[2 * node], tree[2 * node + 1]
                    tree[node] = a if a <= b else b
                    node >>= 1
        return [t for t in token if t >= 0]

    # --- texts --------------------------------------------------------------------------------

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case by character, no final sigma
        return text.lower()

    def segments(self, text: str):
        """Words of the text in order; an added token comes as its id."""
        if self.split and any(x in text for x in self.added):
            for part in self.split(text):
                if part in self.added:
                    yield self.added[part]
                else:
                    yield from self.words(self.normal(part))
        else:
            yield from self.words(self.normal(text))

    def learn(self, new: list[str]) -> None:
        symbols = []
        for w in new:
            raw = np.frombuffer(w.encode("utf-8", "surrogatepass"), np.uint8)
            ids = self.first[raw]
            ids[-1] = self.last[raw[-1]]
            symbols.append(ids)
        for w, ids in zip(new, self.merge_all(symbols), strict=True):
            self.cache[w] = " ".join(map(str, ids))
            self.plain[w] = " ".join([self.names[i] for i in ids])

    def both(self, texts: list[str]) -> list[tuple[str, str]]:
        """(decimal ids joined by a space, decoded text) of each text."""
        cut = [self.words(self.normal(t)) if not any(x in t for x in self.added) else list(self.segments(t)) for t in texts]
        if len(self.cache) > self.LIMIT:
            self.cache.clear()
            self.plain.clear()
        cache, plain = self.cache, self.plain
        if new := list({w for words in cut for w in words if w not in cache and isinstance(w, str)}):
            self.learn(new)
        out = []
        for words in cut:
            try:
                out.append((" ".join([cache[w] for w in words]), " ".join([plain[w] for w in words])))
            except KeyError:  # an added token
                out.append((" ".join([cache[w] if isinstance(w, str) else str(w) for w in words]), " ".join([plain[w] if isinstance(w, str) else self.names[w] for w in words])))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.both([text])[0][0].split()]

    def decode(self, ids: list[int]) -> str:
        """As the library does for a file without a decoder: tokens joined by a space, none skipped."""
        return " ".join([self.names[i] for i in ids])


_models: dict[str, WordBPE] = {}


def model(path: str) -> WordBPE:
    if path not in _models:
        _models[path] = WordBPE(path)
    return _models[path]


CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(x: str) -> str:
    return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()


def _code(path: str):
    def run(batches):
        bpe = model(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 100):
                part = batch.slice(low, 100)
                pairs = bpe.both([x or "" for x in part["text"].to_pylist()])
                yield pa.record_batch([part["doc_id"], pa.array([i.count(" ") + 1 if i else 0 for i, _ in pairs], pa.int64()), pa.array([_digest(i) for i, _ in pairs], pa.string()), pa.array([_digest(d) for _, d in pairs], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode(path: str):
    def run(batches):
        bpe = model(path)
        for batch in batches:
            ids = [[int(x) for x in i.split()] for i, _ in bpe.both([x or "" for x in batch["text"].to_pylist()])]
            yield pa.record_batch([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    return _columns(docs).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode_ids(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of coded(doc_id, ids)."""

    def run(batches):
        bpe = model(path)
        for batch in batches:
            yield pa.record_batch([batch["doc_id"], pa.array([bpe.decode(x or []) for x in batch["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def code_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    return _columns(docs).mapInArrow(_code(path), CODED)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
