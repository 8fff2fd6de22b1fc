"""Packing by minimum bin slack.

A document is its token ids and one end id. Whole windows of `capacity` ids are cut from its front; the
rest is a remainder of 1..capacity-1 ids. What the driver sees is a histogram of piece lengths, at most
`capacity` numbers whatever the input. It fills one window at a time: the longest remaining length goes
in, and a subset-sum dynamic program over Python integers used as bitsets finds the largest sum of the
remaining multiset that fits beside it; backtracking through the kept bitsets gives how many of each
length. Where the closest sum leaves slack, a remaining longer piece is cut to fill it. The pattern, its cut
with it, is used as often as the counts allow, so the number of patterns depends on the lengths that occur and
not on how often they do. What is left at the very end is cut into sequences of a power of two, which need no
padding. Pieces get their place by their rank within their length, ranks coming from counts by (length,
salt), so that no task holds a hot length; they meet placements by (length, block of ranks).

Null text counts as empty (a piece of the end id alone). Repeated rows are packed each on its own, also
under a shared or null doc_id. A text of any length is encoded whole. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mattework.llm.bpe import byte_symbols
from mattework.llm.shared import bitmap, flagged, materialize, small_batches

CAPACITY = 1024
END_ID = 0
#: Pieces of one length are ranked in so many parts, those of whole windows in more.
SALTS, FULL_SALTS = 64, 2048


@dataclass(frozen=True)
class Placement:
    """Ids [start, start + size) of the pieces of a length with ranks [first, last): those of the r-th go to sequence
    seq + (r-first)//per at offset + (r-first)%per*size. A piece that is cut has a placement for each part."""

    length: int
    first: int
    last: int
    start: int
    size: int
    seq: int
    offset: int
    per: int = 1


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of lengths within counts whose sum is the largest that is at most room."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, group = min(counts[length], room // length), 1
        while left:  # counts in powers of two
            take = min(group, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, group = left - take, group * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


class _Pool:
    """What remains: for each size the runs (length, first rank, number, start) of equal parts of pieces."""

    def __init__(self, histogram: dict[int, int]):
        self.counts = {k: v for k, v in histogram.items() if v}
        self.runs = {k: deque([(k, 0, v, 0)]) for k, v in self.counts.items()}
        self.out: list[Placement] = []

    def take(self, size: int, n: int):
        """Runs of n parts of this size, which are then no longer there."""
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
        while n:
            length, first, have, start = self.runs[size].popleft()
            if have > n:
                self.runs[size].appendleft((length, first + n, have - n, start))
            got = min(have, n)
            yield length, first, got, start
            n -= got

    def place(self, size: int, per: int, times: int, seq: int, offset: int):
        """per parts of the size in each of `times` sequences from seq on."""
        at = 0
        for length, first, n, start in self.take(size, per * times):
            while n:  # whole sequences at once, the parts before and after them one by one
                many = n // per * per if at % per == 0 and n >= per else 1
                self.out.append(Placement(length, first, first + many, start, size, seq + at // per, offset + at % per * size, per if many > 1 else 1))
                at, first, n = at + many, first + many, n - many

    def cut(self, size: int, take: int, times: int, seq: int, offset: int):
        """The first ids of a part of this size fill each of `times` sequences; the others become new parts."""
        at = 0
        for length, first, n, start in self.take(size, times):
            self.out.append(Placement(length, first, first + n, start, take, seq + at, offset))
            self.runs.setdefault(size - take, deque()).append((length, first, n, start + take))
            self.counts[size - take] = self.counts.get(size - take, 0) + n
            at += n


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Placement]:
    """Placements for all pieces of the histogram {length: count}, lengths 1..capacity."""
    pool, seq = _Pool(histogram), 0
    if full := pool.counts.get(capacity):
        pool.place(capacity, 1, full, 0, 0)
        seq = full
    while pool.counts:
        if sum(k * v for k, v in pool.counts.items()) <= capacity:
            break
        # sizes with many parts first, so that patterns are used often; all sizes where those leave nothing to cut
        for least in (max(pool.counts.values()) // 2, 0):
            rest = {k: v for k, v in pool.counts.items() if v > least}
            top = max(rest)
            rest[top] -= 1
            pattern = closest(rest, capacity - top)
            pattern[top] = pattern.get(top, 0) + 1
            slack = capacity - sum(k * v for k, v in pattern.items())
            fillers = [(v // (pattern.get(k, 0) + 1), k) for k, v in pool.counts.items() if k >= slack and v > pattern.get(k, 0)]
            if not slack or fillers:
                break
        need, filler = dict(pattern), 0
        if slack:  # cut the part that is there most often, or use one as it is
            filler = max(fillers)[1]
            need[filler] = need.get(filler, 0) + 1
        times = min(pool.counts[k] // v for k, v in need.items())
        offset = 0
        for size, per in sorted(pattern.items(), reverse=True):
            pool.place(size, per, times, seq, offset)
            offset += size * per
        if slack and slack == filler:
            pool.place(filler, 1, times, seq, offset)
        elif slack:
            pool.cut(filler, slack, times, seq, offset)
        seq += times
    rest = sum(k * v for k, v in pool.counts.items())
    while rest:  # a window at most: sequences of a power of two
        size = capacity if rest == capacity else 1 << (rest.bit_length() - 1)
        offset = 0
        while offset < size:
            length = max(pool.counts)
            take = min(length, size - offset)
            if take == length:
                pool.place(length, 1, 1, seq, offset)
            else:
                pool.cut(length, take, 1, seq, offset)
            offset += take
        rest -= size
        seq += 1
    return pool.out


def blocks_of(placements: list[Placement], total: dict[int, int]) -> tuple[dict[int, int], list[tuple]]:
    """By how many bits ranks of a length are cut into blocks, and the placements by (length, block): as many
    blocks as placements at most, so a rank meets few placements and there are about twice as many rows."""
    number: dict[int, int] = {}
    for p in placements:
        number[p.length] = number.get(p.length, 0) + 1
    shift = {k: max(0, (n // number[k]).bit_length()) for k, n in total.items()}
    return shift, [(p.length, block, p.first, p.last, p.start, p.size, p.seq, p.offset, p.per) for p in placements for block in range(p.first >> shift[p.length], (p.last - 1 >> shift[p.length]) + 1)]


# --- token ids ---------------------------------------------------------------------------------

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, as the tokenizers library gives them for the file.

    Where the file is a byte-level BPE whose ids follow the order of its merges and PROBES come out alike, tiktoken
    gives the library's ids from the same vocabulary five times as fast. Other files, texts with an added token in
    them and texts with a very long run of one kind go to the library itself.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    LONG, RUN = 50_000, re.compile(r"\s{5000}|\S{5000}")
    PROBES = ("", " ", "a", " a b  c\n\n d\t", "It's I'll we've'd 'S", "x\u00a0\u2003y\u3000z \u200b", "\u00e9e\u0301 \u00df\u0130\u01c5 \u0645\u0631\u062d\u0628\u0627 \u4f60\u597d \U0001f600\ufe0f", "12 \u0664\u00b2\u2163 3.5e-7", "#!? ...--__//", "\x00\x1c\x85\u2028 end  ")

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        split, model = told.get("pre_tokenizer") or {}, told["model"]
        if split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space", True) or told.get("normalizer") or model["type"] != "BPE":
            return
        vocab, merges = model["vocab"], model["merges"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        back = {s: b for b, s in enumerate(byte_symbols())}
        if made == sorted(made) and not model.get("ignore_merges") and not model.get("dropout"):
            ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in self.special}
            fast = tiktoken.Encoding("of-file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            if all(fast(x) == self.library(x) for x in self.PROBES):
                self.fast = fast

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        slow = self.fast is None or any(x in text for x in self.special) or (len(text) > self.LONG and self.RUN.search(text))
        return np.array(self.library(text) if slow else self.fast(text), "<u4").tobytes()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)


PIECES = "doc_id long, row_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, capacity: int, end: bytes):
    def run(batches):
        encode = encoder(path)
        for batch in batches:
            rows = []
            for doc, row, text in zip(batch["doc_id"].to_pylist(), batch["row_id"].to_pylist(), batch["text"], strict=True):
                ids = encode(text.as_py() or "") + end
                for at in range(0, len(ids), 4 * capacity):
                    piece = ids[at : at + 4 * capacity]
                    rows.append((doc, row, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
                if len(rows) > 20_000:
                    yield _batch(rows, PIECE_NAMES)
                    rows = []
            yield _batch(rows, PIECE_NAMES)

    return run


PIECE_NAMES = ["doc_id", "row_id", "start", "length", "ids_crc32", "doc_tokens"]
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PACKED_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _flagged(bits: int, held):
    """Rows whose flag is set: all that a part needs and few besides, so that no other text moves."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(flagged(held.value, bits, np.asarray(batch["row_id"]))))

    return run


def _recut(path: str, end: bytes):
    """The parts of the pieces that the plan cuts, from their documents' texts; rows of one text follow each other."""

    def run(batches):
        encode = encoder(path)
        at, ids = None, b""
        for batch in batches:
            rows = []
            columns = (batch[c].to_pylist() for c in ("doc_id", "row_id", "start", "size", "sequence_id", "offset"))
            for doc, row, start, size, seq, offset, text in zip(*columns, batch["text"], strict=True):
                if row != at:
                    at, ids = row, encode(text.as_py() or "") + end
                rows.append((doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), len(ids) // 4, seq, offset))
            yield _batch(rows, PACKED_NAMES)

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of docs(doc_id, text): PACKED. See the module for the method."""
    spark = docs.sparkSession
    small_batches(spark)
    end = struct.pack("<I", end_id)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("row_id"))
    pieces = materialize(docs.mapInArrow(_pieces(tokenizer_path, capacity, end), PIECES), "pieces")
    salts = F.when(F.col("length") == capacity, FULL_SALTS).otherwise(SALTS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_id", "start"), salts))
    counts = salted.groupBy("length", "salt").count().collect()  # capacity x SALTS + FULL_SALTS rows at most
    base, total = [], {}
    for length, salt, n in sorted(tuple(r) for r in counts):
        base.append((length, salt, total.get(length, 0)))
        total[length] = total.get(length, 0) + n
    shift, places = blocks_of(plan(total, capacity), total)
    bases = spark.createDataFrame([(*b, shift[b[0]]) for b in base], "length long, salt long, base long, shift int")
    place = spark.createDataFrame(places, "length long, block long, first long, last long, from long, size long, seq long, at long, per long")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "row_id", "start")
    ranked = salted.withColumn("nth", F.row_number().over(order) - 1).join(F.broadcast(bases), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("nth"))
    ranked = ranked.withColumn("block", F.expr("shiftright(rank, shift)"))
    # both tables are bounded by capacity, not by the input
    placed = ranked.join(F.broadcast(place), ["length", "block"]).where("rank >= first and rank < last")
    step = F.col("rank") - F.col("first")
    seq, at = (F.col("seq") + F.floor(step / F.col("per"))).cast("long"), (F.col("at") + step % F.col("per") * F.col("size")).cast("long")
    placed = placed.select("doc_id", "row_id", (F.col("start") + F.col("from")).alias("start"), "length", "size", "ids_crc32", "doc_tokens", seq.alias("sequence_id"), at.alias("offset"))
    placed = materialize(placed, "placed")
    whole = placed.where("size = length").select(*PACKED_NAMES)
    parts = materialize(placed.where("size < length").select("doc_id", "row_id", "start", "size", "sequence_id", "offset"), "parts")
    bits, flags = bitmap(parts.select(F.col("row_id").alias("hash")), parts.count())
    texts = docs.select("row_id", "text").mapInArrow(_flagged(bits, spark.sparkContext.broadcast(flags)), "row_id long, text string").dropDuplicates(["row_id"])
    # a merge at every size: what moves is the parts and the texts that have any
    found = parts.join(texts.hint("merge"), "row_id").select("row_id", "text", "doc_id", "start", "size", "sequence_id", "offset")
    return whole.unionByName(found.mapInArrow(_recut(tokenizer_path, end), PACKED))
