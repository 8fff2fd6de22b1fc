"""WARC writing, and normalising of monolithic gzip archives.

Each task writes its records as one gzip stream over the whole file, the form that crawlers often
deliver and that cannot be read from the middle. The normaliser inflates such a stream once, in bounded
pieces, writes every record again as a gzip member of its own, and writes a sidecar index with one line
`offset length page_id` for each record. A reader then needs one seek to get any record.

Of records with equal payloads of at least `min_bytes`, the one with the largest page_id is a response
and the others are revisits that refer to it; smaller ones are all responses. Null html is an empty
payload; a null page_id is never referred to while another is there, and is written as an empty id;
an empty table makes no archive. Files get their final name by a rename after they are complete, so a
repeated task replaces its own file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mattework.llm.shared import materialize, new_path, small_batches

PIECE = 1 << 18
DATE = "2000-01-01T00:00:00Z"  # a fixed date, so that equal tables give equal archives


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, kind: str, refers_to, payload_digest: str) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its payload's length and digest stay in the header."""
    block = payload if kind == "response" else b""
    name = lambda x: "" if x is None else x
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name(page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def page_of(urn: str):
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def inflate(stream, piece: int = PIECE) -> Iterator[bytes]:
    """Inflated pieces of a gzip stream of one or many members, each of bounded size."""
    unzip = zlib.decompressobj(31)
    data = stream.read(piece)
    while data or unzip.unconsumed_tail:
        if out := unzip.decompress(unzip.unconsumed_tail or data, piece):
            yield out
        if unzip.eof:
            data, unzip = unzip.unused_data or stream.read(piece), zlib.decompressobj(31)
        elif not unzip.unconsumed_tail:
            data = stream.read(piece)
    if out := unzip.flush():
        yield out


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The raw records of an inflated archive, found by their Content-Length; holds one at a time."""
    held, size, end = [], 0, -1
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        while True:
            if end < 0:
                joined = b"".join(held)
                held, size = [joined], len(joined)
                if (cut := joined.find(b"\r\n\r\n")) < 0:
                    break
                end = cut + 4 + int(parse_head(joined[:cut])["content-length"]) + 4
            if size < end:
                break
            joined = b"".join(held)
            yield joined[:end]
            held, size, end = [joined[end:]], size - end, -1
    if b"".join(held):
        raise ValueError("the archive ends within a record")


def _put(files: fs.FileSystem, path: str, chunks) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(temporary, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
    files.move(temporary, path)


def write_monolith(records_: Iterator[bytes]) -> Iterator[bytes]:
    """Chunks of one gzip member over all records."""
    zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
    for r in records_:
        if chunk := zipper.compress(r):
            yield chunk
    yield zipper.flush()


def normalise(stream) -> Iterator[tuple[bytes, bytes]]:
    """(gzip member, index line) for each record of a gzip stream that is read once, front to back."""
    at = 0
    for raw in records(inflate(stream)):
        zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = zipper.compress(raw) + zipper.flush()
        page = page_of(parse_head(raw[: raw.find(b"\r\n\r\n")])["warc-record-id"])
        yield member, f"{at} {len(member)} {'' if page is None else page}\n".encode()
        at += len(member)


def read_index(files: fs.FileSystem, path: str) -> Iterator[tuple[int, int]]:
    with files.open_input_stream(path, compression=None) as f:
        for line in f.read().decode().splitlines():
            at, size, _ = line.split(" ")
            yield int(at), int(size)


def _writer(root: str):
    def run(batches):
        files, base = fs.FileSystem.from_uri(root)
        name = f"{base}/part-{TaskContext.get().partitionId():06d}"
        files.create_dir(base, recursive=True)
        count = [0]

        def each():
            for batch in batches:
                for row in batch.to_pylist():
                    count[0] += 1
                    payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                    yield record(row["page_id"], row["url"], payload, row["record_type"], row["refers_to"], row["payload_digest"])

        _put(files, f"{name}.mono.warc.gz", write_monolith(each()))
        if count[0]:
            yield pa.record_batch([pa.array([name]), pa.array([count[0]], pa.int64())], ["name", "n"])

    return run


def _normaliser(root: str):
    def run(batches):
        files, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, n in zip(batch["name"].to_pylist(), batch["n"].to_pylist(), strict=True):
                lines: list[bytes] = []
                with files.open_input_stream(f"{name}.mono.warc.gz", compression=None) as stream:

                    def members():
                        for member, line in normalise(stream):
                            lines.append(line)
                            yield member

                    _put(files, f"{name}.warc.gz", members())
                _put(files, f"{name}.warc.gz.idx", lines)
                if len(lines) != n:
                    raise ValueError(f"{name}: {len(lines)} records, {n} were written")
                yield pa.record_batch([pa.array([name]), pa.array([len(lines)], pa.int64())], ["name", "n"])

    return run


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _reader(root: str):
    def run(batches):
        files, _ = fs.FileSystem.from_uri(root)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for name in batch["name"].to_pylist():
                rows: list[tuple] = []
                with files.open_input_file(f"{name}.warc.gz") as f:
                    for at, size in read_index(files, f"{name}.warc.gz.idx"):
                        f.seek(at)
                        raw = zlib.decompress(f.read(size), 31)
                        cut = raw.find(b"\r\n\r\n")
                        head = parse_head(raw[:cut])
                        kind, told = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                        block = raw[cut + 4 : -4]
                        if kind == "response" and (digest(block) != told or len(block) != int(head["x-payload-length"])):
                            raise ValueError(f"{name} at {at}: the payload differs from its digest")
                        rows.append((page_of(head["warc-record-id"]), int(head["x-payload-length"]), told, kind, page_of(head["warc-refers-to"]) if kind == "revisit" else None))
                        if len(rows) == 5000:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _digests(batches):
    for batch in batches:
        payloads = [(x or "").encode("utf-8", "surrogatepass") for x in batch["html"].to_pylist()]
        yield pa.record_batch([batch["page_id"].cast(pa.int64()), pa.array([digest(x) for x in payloads]), pa.array([len(x) for x in payloads], pa.int64())], ["page_id", "payload_digest", "payload_bytes"])


def archive(pages: DataFrame, min_bytes: int = 0) -> tuple[str, DataFrame]:
    """Write pages(page_id, url, html) as monolithic archives; (their folder, table of file names)."""
    spark = pages.sparkSession
    small_batches(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    heads = pages.select("page_id", "html").mapInArrow(_digests, "page_id long, payload_digest string, payload_bytes long")
    largest = heads.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("largest")).where("largest is not null")
    digested = pages.mapInArrow(_with_digest, "page_id long, url string, html string, payload_digest string, payload_bytes long")
    judged = digested.join(largest, ["payload_digest", "payload_bytes"], "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    judged = judged.select("page_id", "url", "html", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("largest")).alias("refers_to"))
    root = new_path(spark, "warc")
    return root, materialize(judged.mapInArrow(_writer(root), "name string, n long"), "warc-files")


def _with_digest(batches):
    for batch in batches:
        payloads = [(x or "").encode("utf-8", "surrogatepass") for x in batch["html"].to_pylist()]
        yield pa.record_batch([*batch.columns, pa.array([digest(x) for x in payloads]), pa.array([len(x) for x in payloads], pa.int64())], [*batch.schema.names, "payload_digest", "payload_bytes"])


def read_back(root: str, names: DataFrame) -> DataFrame:
    """Normalise the monolithic archives and read every record through the sidecar index."""
    spread = lambda df: df.repartition(max(1, min(10_000, df.count())), "name")  # noqa: E731  one file is one task's work
    done = materialize(spread(names).mapInArrow(_normaliser(root), "name string, n long"), "warc-done")
    return spread(done).mapInArrow(_reader(root), READ)


def warc_roundtrip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record read back."""
    return read_back(*archive(pages, min_bytes))
