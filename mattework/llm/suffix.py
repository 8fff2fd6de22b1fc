"""Removal of long repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the corpus.

1. Anchors. Of the GRAM-byte grams in each window of `length` bytes the one with the least hash (the
   leftmost of equals) is the window's anchor, so equal windows have equal anchors at equal offsets. All
   windows of consecutive starts with one anchor are one stretch, about length/2 starts each. A stretch
   whose anchor gram stands nowhere else holds no repeated window; one that stands twice as a whole is
   repeated in all of them. Where different stretches share an anchor gram their suffixes are sorted.
   Of equal stretches one place, the owner, is sorted for all. Two bitmaps tell tasks which stretches
   count and which places are owners; they have up to 2**30 bits, and a full one only lets more go on.
2. Runs. A map task sorts the suffixes that start at its anchors (each as far as its stretch's windows
   reach; ties by what stands left of the anchor, read backwards), cuts the sorted run at splitters
   and front-codes it: the length of the common prefix with the suffix before, and the rest. Splitters are
   sampled suffixes; one inside a group of at most GROUP members moves to the group's start.
3. Merge. A range's task merges its runs with a loser tree whose nodes keep the common prefix of loser and
   winner: unequal prefixes decide at once, equal ones are compared from there on only. Suffixes come out
   with the common prefix to the one before.
4. Groups. Suffixes with a common prefix of GRAM bytes are one anchor's group. A window can be repeated
   only if the common prefix with a neighbour covers its part right of the anchor; those windows are
   hashed with their left part and counted. In a group of more than GROUP members, which no task holds,
   windows that a neighbour repeats are found by both common lengths, right and left of the anchor, and
   given as spans. The others are bounded on the right by the neighbours in order and on the left by those in
   the order of the left parts, sorted by all tasks; what lies within both is hashed and counted by all.
5. Marks go back to the documents. Where step 2 knows that a stretch is repeated, as its name stands twice in the
   texts at hand or at very many places (such names are sent to all tasks, at most HOT_NAMES of them), a run
   of such stretches of a text is one mark, however many it holds: a line of one byte has one for each byte. The
   other stretches are joined with their names' marks.

Null and empty texts have no byte and lose none. Repeated rows repeat each other. An empty table gives
an empty result. Columns of docs other than doc_id, text and those in `keep` are not looked at, whatever their
names. Windows are compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import bisect
import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mattework.llm.bytesops import NAMES, U, give_back, gram_hash, mix, prefix_sums, span_hash, text_blocks
from mattework.llm.shared import batch_rows, bitmap, flagged, materialize, small_batches

LENGTH, GRAM = 400, 32
#: Bytes of distinct suffixes that a map task holds for a run.
RUN_BYTES = 6 << 20
#: Bytes of text that are worked on at once; a longer text is worked on in pieces.
TEXT_BYTES = 1 << 19
#: Suffixes of a run that are packed, and unpacked again, at once.
BLOCK = 64
#: Suffixes that a range should have, and the most ranges; a range's share grows with the corpus beyond them.
RANGE, RANGES = 20_000, 16_384
#: One in SAMPLED stretches is a candidate for a splitter, OVERSAMPLE candidates are looked at for each range.
SAMPLED, OVERSAMPLE = 64, 4
#: Members of a group that one task judges.
GROUP = 8192
#: A stretch at more than one in HOT_NAMES of all places (at least HOT_PLACES) is known to all tasks and not joined.
HOT_NAMES, HOT_PLACES = 2000, 1000
#: Windows of an Arrow batch.
WINDOWS = 1 << 16
#: Documents of an Arrow batch.
ROWS = 400


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Arrays (doc, first start, last start, anchor, gram hash) of the stretches, and the prefix sums."""
    sums = prefix_sums(NAMES[data])
    reach = length - gram + 1
    n = len(data)
    empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U), sums)
    size = np.diff(offsets)
    if not (size >= length).any():
        return empty
    hashes = gram_hash(sums, gram)
    key = (hashes & U(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=U)
    rows = -(-len(key) // reach)
    grid = np.full(rows * reach, U(0xFFFFFFFFFFFFFFFF))
    grid[: len(key)] = key
    grid = grid.reshape(rows, reach)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - length + 1
    least = np.minimum(behind[:starts], ahead[reach - 1 : reach - 1 + starts])
    anchor = (least & U(0xFFFFFFFF)).astype(np.int64)
    change = np.zeros(starts + 1, np.int8)
    long = size >= length
    np.add.at(change, offsets[:-1][long], 1)
    np.add.at(change, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(change[:starts]).astype(bool)
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    heads = offsets[:-1][long]
    new[heads] = True
    stop = valid.copy()
    stop[:-1] &= new[1:] | ~valid[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(stop)
    at = anchor[first]
    return np.searchsorted(offsets, first, "right") - 1, first, last, at, hashes[at], sums


def pieces(batches, length: int):
    """(rows of the batch, bytes, offsets, place of the first byte in its text) of blocks of whole texts.

    A text of more than TEXT_BYTES comes in pieces that overlap by length - 1 bytes, so each window is in one
    piece. A stretch that a cut divides is two stretches with one anchor gram, which are sorted as others are.
    """
    for batch, data, offsets in text_blocks(batches, limit=TEXT_BYTES):
        if len(offsets) > 2 or len(data) < TEXT_BYTES + length:
            yield batch, data, offsets, 0
            continue
        for low in range(0, len(data) - length + 1, TEXT_BYTES):
            part = data[low : low + TEXT_BYTES + length - 1]
            yield batch, part, np.array([0, len(part)]), low


SEEN = "gram long, name long, n long, place long, sampled long, head binary, rear binary"


def names_of(sums: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A stretch's name: the hash of its bytes and of its anchor's place in it."""
    return mix(span_hash(sums, first, last + length) ^ (at - first).astype(U)).astype(np.int64)


def places_of(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of where a stretch stands: its row and its first byte there."""
    return mix(rows.astype(U) ^ mix(first.astype(U))).astype(np.int64)


def _count(length: int, gram: int):
    """Distinct stretches of a task with their number and one of their places; sampled ones with their bytes."""

    def run(batches):
        held, size = [], 0
        columns = ["gram", "name", "n", "place", "sampled", "head", "rear"]

        def out():
            grams, names, places = (np.concatenate(x) for x in zip(*held, strict=True))
            names, at, n = np.unique(names, return_index=True, return_counts=True)
            none = [pa.nulls(len(n), t) for t in (pa.int64(), pa.binary(), pa.binary())]
            return pa.record_batch([pa.array(grams[at].astype(np.int64)), pa.array(names), pa.array(n.astype(np.int64)), pa.array(places[at]), *none], columns)

        for batch, data, offsets, low in pieces(batches, length):
            doc, first, last, at, grams, sums = stretches(data, offsets, length, gram)
            names = names_of(sums, first, last, at, length)
            held.append((grams, names, places_of(np.asarray(batch["row_id"])[doc], first - offsets[doc] + low)))
            size += len(grams)
            spot = mix(names.astype(U))
            some = np.flatnonzero(spot % U(SAMPLED) == 0)
            if len(some):
                _, once = np.unique(spot[some], return_index=True)
                some = some[once]
                raw, none = data.tobytes(), pa.nulls(len(some), pa.int64())
                heads = [raw[a:e] for a, e in zip(at[some].tolist(), (last[some] + length).tolist(), strict=True)]
                rears = [raw[s:a][::-1] for s, a in zip(first[some].tolist(), at[some].tolist(), strict=True)]
                yield pa.record_batch([pa.array(grams[some].astype(np.int64)), pa.array(names[some]), none, none, pa.array(spot[some].astype(np.int64)), pa.array(heads, pa.binary()), pa.array(rears, pa.binary())], columns)
            if size > 1 << 20:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return run


def _common(a: bytes, b: bytes, k: int) -> int:
    """Length of the common prefix, known to be at least k."""
    end = min(len(a), len(b))
    while k + 64 <= end and a[k : k + 64] == b[k : k + 64]:
        k += 64
    while k < end and a[k] == b[k]:
        k += 1
    return k


def front_code(entries: list[tuple[bytes, bytes, int]]) -> bytes:
    """A sorted run of (suffix, left part backwards, name), in blocks that are unpacked one by one."""
    before, out, pack = b"", [], zstandard.ZstdCompressor(level=1)
    for low in range(0, len(entries), BLOCK):
        block = entries[low : low + BLOCK]
        head = np.zeros((len(block), 3), "<u4")
        names = np.array([name for _, _, name in block], "<i8")
        blob = []
        for i, (right, rear, _) in enumerate(block):
            k = _common(before, right, 0)
            head[i] = k, len(right) - k, len(rear)
            blob += [right[k:], rear]
            before = right
        packed = pack.compress(head.tobytes() + names.tobytes() + b"".join(blob))
        out += [len(block).to_bytes(4, "little"), len(packed).to_bytes(4, "little"), packed]
    return b"".join(out)


def front_decode(run):
    """(suffix, common prefix with the one before, left part backwards, name) in order; holds one block unpacked."""
    run, start, before, unpack = memoryview(run), 0, b"", zstandard.ZstdDecompressor()
    while start < len(run):
        n, size = (int.from_bytes(run[start + i : start + i + 4], "little") for i in (0, 4))
        block = unpack.decompress(run[start + 8 : start + 8 + size])
        start += 8 + size
        head = np.frombuffer(block, "<u4", 3 * n).reshape(n, 3).tolist()
        names = np.frombuffer(block, "<i8", n, 12 * n).tolist()
        at = 20 * n
        for (k, rest, rear), name in zip(head, names, strict=True):
            before = before[:k] + block[at : at + rest]
            at += rest
            yield before, k, block[at : at + rear], name
            at += rear


def merge(runs: list):
    """(suffix, common prefix with the last one, left part backwards, name) of all runs, merged; equal
    suffixes by the left part backwards.

    A loser tree. What a node keeps of its loser is the common prefix with the winner that beat it; on the
    way of the next suffix from the winner's run that prefix is one with the last output.
    """
    size = 1 << max(0, (len(runs) - 1).bit_length())
    heads: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    known = [0 if h else -1 for h in heads]  # common prefix with the last output, -1 at a run's end
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's prefix with the winner."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        x, y = heads[a][0], heads[b][0]
        k = _common(x, y, known[a])
        if heads[a][2] <= heads[b][2] if k == len(x) == len(y) else k == len(x) or (k < len(y) and x[k] < y[k]):
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        win, loser[node] = play(build(2 * node), build(2 * node + 1))
        return win

    win = build(1)
    while known[win] >= 0:
        right, _, rear, name = heads[win]
        yield right, known[win], rear, name
        heads[win] = next(runs[win], None)
        known[win] = heads[win][1] if heads[win] else -1
        node = (size + win) >> 1
        while node:
            win, loser[node] = play(win, loser[node])
            node >>= 1


def runs_of_known(name: np.ndarray, first: np.ndarray, last: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which stretches are known to be repeated, the first and the last stretch of each run of them).

    Known are those whose name is hot or stands twice here. Starts of two texts never follow each other.
    """
    _, which, n = np.unique(name, return_inverse=True, return_counts=True)
    known = (n[which] > 1) | np.isin(name, hot)
    at = np.flatnonzero(known)
    new = np.ones(len(at), bool)
    new[1:] = first[at[1:]] != last[at[:-1]] + 1
    return known, at[new], at[np.append(new[1:], True)[: len(at)]]


#: Rows without a part are places of stretches, those without a name too are runs of stretches that are repeated as a whole.
RUNS = "part int, run binary, row_id long, name long, first long, windows long"


def _runs(length: int, gram: int, often, owners, splitters: list[tuple[bytes, bytes]], hot: np.ndarray):
    def run(batches):
        (bits, held_flags), (owner_bits, held_owners) = often, owners
        flags, owner_flags = held_flags.value, held_owners.value
        held: dict[int, tuple] = {}
        volume = 0

        def out():
            entries = sorted((right, rear, name) for name, (right, rear) in held.items())
            parts: list[list] = [[] for _ in range(len(splitters) + 1)]
            at = 0
            for e in entries:
                if at < len(splitters) and e[:2] >= splitters[at]:
                    at = bisect.bisect_right(splitters, e[:2], at)
                parts[at].append(e)
            full = [i for i, p in enumerate(parts) if p]
            return _rows([pa.array(full, pa.int32()), pa.array([front_code(parts[i]) for i in full], pa.binary())])

        def _rows(left, right=None):
            n = len((left or right)[0])
            left = left or [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            right = right or [pa.nulls(n, pa.int64())] * 4
            return pa.record_batch([*left, *right], ["part", "run", "row_id", "name", "first", "windows"])

        for batch, data, offsets, low in pieces(batches, length):
            doc, first, last, at, grams, sums = stretches(data, offsets, length, gram)
            go = np.flatnonzero(flagged(flags, bits, grams))
            if not len(go):
                continue
            doc, first, last, at = doc[go], first[go], last[go], at[go]
            name = names_of(sums, first, last, at, length)
            rows, begin = np.asarray(batch["row_id"])[doc], first - offsets[doc] + low
            known, a, b = runs_of_known(name, first, last, hot)
            open_ = np.flatnonzero(~known)
            yield _rows(None, [pa.array(rows[open_]), pa.array(name[open_]), pa.array(begin[open_]), pa.array((last - first + 1)[open_])])
            yield _rows(None, [pa.array(rows[a]), pa.nulls(len(a), pa.int64()), pa.array(begin[a]), pa.array(last[b] - first[a] + 1)])
            go = np.flatnonzero(flagged(owner_flags, owner_bits, places_of(rows, begin)))
            raw = data.tobytes()
            for x, s, e, a in zip(name[go].tolist(), first[go].tolist(), (last[go] + length).tolist(), at[go].tolist(), strict=True):
                if x not in held:
                    held[x] = raw[a:e], raw[s:a][::-1]
                    volume += e - s + 200
            if volume > RUN_BYTES:
                yield out()
                held.clear()
                volume = 0
        if held:
            yield out()

    return run


MARKS = "name long, lows array<int>, highs array<int>, top int, head binary, rear binary, chained boolean"


def _spans(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


def _merge_ranges(length: int, gram: int):
    """Spans of repeated windows of the stretches of a range. Of a stretch whose group no task holds whole, those
    that its neighbours prove, with its bytes and `top`, the last window that may be repeated; chained: the first span
    is proven by the neighbour before."""

    def run(batches):
        rows: list[tuple] = []

        def judge(group: list[list]):
            """All members [suffix, prefix with the one before, left part backwards, name] of a group, in order."""
            if len(group) == 1:
                return
            whole = np.frombuffer(b"".join([g[2][::-1] + g[0] for g in group]), np.uint8)
            sizes = np.array([len(g[2]) + len(g[0]) for g in group])
            begin = np.cumsum(sizes) - sizes
            near = np.array([g[1] for g in group] + [0])
            near[0] = 0
            near = np.maximum(near[:-1], near[1:])
            tested = np.clip(near + np.array([len(g[2]) for g in group]) - length + 1, 0, sizes - length + 1)
            total = int(tested.sum())
            if not total:
                return
            which = np.repeat(np.arange(len(group)), tested)
            start = begin[which] + np.arange(total) - np.repeat(np.cumsum(tested) - tested, tested)
            hashes = span_hash(prefix_sums(NAMES[whole]), start, start + length)
            order = np.argsort(hashes)
            same = np.diff(hashes[order]) == 0
            flag = np.zeros(total, bool)
            flag[order[:-1][same]] = flag[order[1:][same]] = True
            low = 0
            for g, t in zip(group, tested.tolist(), strict=True):
                if flag[low : low + t].any():
                    rows.append((g[3], *_spans(flag[low : low + t]), None, None, None, None))
                low += t

        def judge_open(line: list[list], first: int, last: int):
            """Members first..last-1 of a line of members; one at the line's end may have a neighbour elsewhere."""
            for i in range(first, last):
                right, _, rear, name = line[i]
                lows, highs, reach, chained = [], [], 0, False
                for a, b in ((i - 1, i), (i, i + 1)):
                    if a < 0 or b == len(line):
                        reach = len(right)
                        continue
                    k, left = line[b][1], _common(line[a][2], line[b][2], 0)
                    reach = max(reach, k)
                    if k + left >= length:
                        lows.append(len(rear) - left)
                        highs.append(len(rear) - length + k)
                        chained |= b == i
                top = len(rear) - length + reach
                if top >= 0:
                    rows.append((name, lows, highs, top, right, rear, chained))

        def out():
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary(), pa.bool_())
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            made = pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["name", "lows", "highs", "top", "head", "rear", "chained"])
            rows.clear()
            return made

        def of_range(runs, cut: set[bytes]):
            group: list[list] = []
            seen = 0  # members at the group's head that are judged already and stay as neighbours

            def end():
                if seen or (group and group[0][0][:gram] in cut):
                    judge_open(group, seen, len(group))
                elif group:
                    judge(group)

            for right, k, rear, name in merge([front_decode(r) for r in runs]):
                if group and k < gram:
                    end()
                    group, seen = [], 0
                elif group and group[-1][3] == name:  # the same stretch of another run
                    continue
                elif len(group) > GROUP:
                    judge_open(group, seen, len(group) - 1)
                    group, seen = group[-2:], 1
                group.append([right, k, rear, name])
                if len(rows) > 2000:
                    yield out()
            end()

        held, cut, at = [], set(), None
        for batch in batches:
            for part, blob, ends in zip(batch["part"].to_pylist(), batch["run"], batch["ends"].to_pylist(), strict=True):
                if part != at and held:
                    yield from of_range(held, cut)
                    held = []
                at, cut = part, set(ends)
                held.append(blob.as_buffer())
        if held:
            yield from of_range(held, cut)
        yield out()
        held = []
        give_back()

    return run


def _open_windows(length: int, gram: int):
    """(name, j, hash) of the windows of MARKS rows, sorted by the gram and the left part backwards, that neighbours
    on both sides allow. Of a chain of neighbours that prove a window to each other its first gives it, for members
    elsewhere. The first and last row of a task may have neighbours in other tasks."""

    def run(batches):
        made: list[tuple] = []
        size = 0

        def windows(row, left: int):
            name, lows, highs, top, right, rear, chained = row
            low = len(rear) - min(left, len(rear))
            open_ = np.ones(top + 1, bool)
            open_[:low] = False
            if chained:
                open_[lows[0] : highs[0] + 1] = False
            j = np.flatnonzero(open_)
            sums = prefix_sums(NAMES[np.frombuffer(rear[::-1] + right, np.uint8)])
            made.append((np.full(len(j), name, np.int64), j.astype(np.int32), span_hash(sums, j, j + length).astype(np.int64)))
            return len(j)

        def out():
            cols = [np.concatenate(c) for c in zip(*made, strict=True)]
            made.clear()
            return pa.record_batch([pa.array(c) for c in cols], ["name", "j", "hash"])

        held, before = None, 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("name", "lows", "highs", "top", "head", "rear", "chained")), strict=True):
                if held is None:
                    before = len(row[5])
                else:
                    left = _common(held[5], row[5], 0) if held[4][:gram] == row[4][:gram] else 0
                    size += windows(held, max(before, left))
                    before = left
                held = row
                if size > WINDOWS:
                    yield out()
                    size = 0
        if held:
            windows(held, len(held[5]))
            yield out()

    return run


def _apply(length: int):
    def run(batches):
        for batch in batches:
            rows = []
            texts = []
            for doc, text, marks in zip(batch["doc_id"].to_pylist(), batch["text"], batch["marks"], strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                removed = spans = 0
                if marks.is_valid and len(marks):
                    edge = np.zeros(len(raw) + 1, np.int32)
                    at = np.array([(m["first"] + a, m["first"] + b + length) for m in marks.as_py() for a, b in zip(m["lows"], m["highs"], strict=True)])
                    np.add.at(edge, at[:, 0], 1)
                    np.add.at(edge, at[:, 1], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                else:
                    kept = raw
                rows.append((doc, len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
                texts.append(None if not text.is_valid else kept.decode("utf-8", "ignore") if removed else text.as_py())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.array(texts, pa.string()), batch["rest"]], [*CUT_NAMES, "kept_text", "rest"])
            rows, texts = [], []
        give_back()

    return run


CUT_NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _splitters(seen: DataFrame, mixed: DataFrame, gram: int) -> list[tuple[bytes, bytes]]:
    """Bounds (suffix, left part backwards) of the ranges, each range about as many distinct suffixes."""
    volume = mixed.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    ranges = min(math.ceil(volume / RANGE), RANGES)
    if ranges < 2:
        return []
    once = seen.where("sampled is not null").groupBy("sampled").agg(F.min(F.struct("gram", "head", "rear")).alias("s")).select("sampled", "s.*")
    some = once.join(mixed.select("gram", (F.col("kinds") > GROUP).alias("large")), "gram").orderBy("sampled").limit(OVERSAMPLE * ranges)
    heads = sorted((bytes(r["head"]), bytes(r["rear"]), r["large"]) for r in some.select("head", "rear", "large").toLocalIterator())
    picked = [heads[i * len(heads) // ranges] for i in range(1, ranges)] if heads else []
    return sorted({(head, rear) if large else (head[:gram], b"") for head, rear, large in picked})


def marks_of(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(row_id, marks) for the rows of docs(row_id, text) that have a repeated window."""
    spark = docs.sparkSession
    seen = materialize(docs.mapInArrow(_count(length, gram), SEEN), "seen")
    names = seen.where("sampled is null").groupBy("gram", "name").agg(F.sum("n").alias("n"), F.min("place").alias("place"))
    names = materialize(names, "names")
    grams = names.groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    often = materialize(grams.where("n > 1"), "often")
    mixed = often.where("kinds > 1")
    owners = materialize(names.join(mixed.select("gram"), "gram", "left_semi").select(F.col("place").alias("hash")), "owners")
    held = []
    for some in (often.select(F.col("gram").alias("hash")), owners):
        bits, flags = bitmap(some, some.count(), flags_each=16)
        held.append((bits, spark.sparkContext.broadcast(flags)))
    splitters = _splitters(seen, mixed, gram)
    most = max(HOT_PLACES, names.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT_NAMES)
    hot = np.array([r["name"] for r in names.where(f"n > {most}").select("name").collect()], np.int64)
    work = materialize(docs.mapInArrow(_runs(length, gram, *held, splitters, hot), RUNS), "runs")
    for _, sent in held:
        sent.destroy()
    # the grams whose group a splitter cuts, at the ranges on either side of it
    ends: list[list[bytes]] = [[] for _ in range(len(splitters) + 1)]
    for i, (head, _) in enumerate(splitters):
        if len(head) > gram:
            ends[i].append(head[:gram])
            ends[i + 1].append(head[:gram])
    cuts = spark.createDataFrame([(i, e) for i, e in enumerate(ends)], "part int, ends array<binary>")
    dealt = work.where("part is not null").select("part", "run").join(F.broadcast(cuts), "part")
    dealt = dealt.repartition(len(splitters) + 1, "part").sortWithinPartitions("part")
    with batch_rows(spark, 16):  # a row is a part of a run here
        found = materialize(dealt.mapInArrow(_merge_ranges(length, gram), MARKS), "marks")
    some = found.where("size(lows) > 0").select("name", "lows", "highs")
    left = found.where("top is not null")
    if not left.isEmpty():
        order = [F.substring("head", 1, gram), F.col("rear"), F.col("name")]
        lined = left.dropDuplicates(["name"]).repartitionByRange(*order).sortWithinPartitions(*order)
        windows = materialize(lined.mapInArrow(_open_windows(length, gram), "name long, j int, hash long"), "windows")
        several = windows.groupBy("hash").agg(F.count("*").alias("k")).where("k > 1").select("hash")
        some = some.union(windows.join(several, "hash", "left_semi").select("name", F.array("j").alias("lows"), F.array("j").alias("highs")))
    # a stretch that stands twice is repeated in all its windows
    none = F.lit(None).cast("array<int>")
    whole = names.where(f"n > 1 and n <= {most}").select("name", none.alias("lows"), none.alias("highs"))
    each = some.union(whole).groupBy("name").agg(F.flatten(F.collect_list("lows")).alias("lows"), F.flatten(F.collect_list("highs")).alias("highs"), F.max(F.col("lows").isNull()).alias("whole"))
    places = work.where("part is null").select("row_id", "name", "first", "windows")
    known = places.where("name is null")
    all_ = (F.array(F.lit(0)), F.array((F.col("windows") - 1).cast("int")))
    lows, highs = (F.when(F.col("whole"), a).otherwise(F.col(c)).alias(c) for a, c in zip(all_, ("lows", "highs"), strict=True))
    marked = places.join(each, "name").select("row_id", "first", lows, highs).union(known.select("row_id", "first", *all_))
    return marked.groupBy("row_id").agg(F.collect_set(F.struct("first", "lows", "highs")).alias("marks"))


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: list[str] | None = None) -> DataFrame:
    """CUT for every row of docs(doc_id, text), and a struct `rest` of the columns in keep.

    kept_text is the text without the removed bytes; of a character that is cut through, what is left is
    dropped there, while kept_sha256 is of all the remaining bytes.
    """
    small_batches(docs.sparkSession, ROWS)
    rest = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    docs = docs.withColumn("row_id", F.xxhash64("doc_id", "text"))
    marks = marks_of(docs.select("row_id", "text"), length, gram)
    joined = docs.join(marks, "row_id", "left").select("doc_id", "text", "rest", "marks")
    kind = docs.schema["rest"].dataType
    schema = f"{CUT}, rest {kind.simpleString()}"
    return joined.mapInArrow(_apply(length), schema)


def removed_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs(doc_id, text)."""
    return cut_repeats(docs).select(*CUT_NAMES)
