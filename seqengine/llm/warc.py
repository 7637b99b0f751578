"""WARC files with a Merkle fixity audit (operator 8).

Pages become WARC/1.0 response records in files of at most `FILE_RECORDS`
records, in order of page_id, stored as rows of a Parquet table.  A record is a
leaf of a tree of fan-out 256: its key is (partition, file, number) in 48 bits
and its hash covers its byte range and its bytes.  A node's hash covers those of
its children in order, its range theirs.  Two replicas are compared from their
roots: only branches whose hashes differ, or that one replica lacks, are
descended, down to the records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqengine.llm.shared import discard, written

FILE_RECORDS = 256
FILE_BYTES = 4 << 20
LEVELS = 6  # a leaf key has 48 bits, a level takes 8
DATE = "2024-01-01T00:00:00Z"


def record_bytes(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A page as a WARC response record; null fields are empty."""
    mark = hashlib.md5(("" if page_id is None else str(page_id)).encode()).hexdigest()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode()
    head = (
        f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:md5:{mark}>\r\nWARC-Page-ID: {'' if page_id is None else page_id}\r\n"
        f"WARC-Date: {DATE}\r\nWARC-Target-URI: {target}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + body + b"\r\n\r\n"


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Offset, length and header fields of each record of a file; a file cut short ends with what is left."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        fields = {}
        if end >= 0 and content[at : at + 5] == b"WARC/":
            for line in content[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
                name, _, value = line.partition(":")
                fields[name.strip().lower()] = value.strip()
        size = fields.get("content-length", "")
        stop = min(end + 8 + int(size), len(content)) if size.isdigit() else len(content)
        yield at, stop - at, fields
        at = stop


def _pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    held: list[bytes] = []
    number = 0

    def file() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([number], pa.int32()), "content": pa.array([b"".join(held)], pa.binary())})

    for batch in stream:
        for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
            held.append(record_bytes(*row))
            if len(held) == FILE_RECORDS or sum(map(len, held)) >= FILE_BYTES:
                yield file()
                held, number = [], number + 1
    if held:
        yield file()


def warc_files(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as a written table of WARC files: part, file, content.

    Rows are ordered by page_id, nulls first, then url and html; repeated rows
    are repeated records.  Other columns are ignored; no pages make no files.
    """
    columns = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    ordered = columns.repartitionByRange("page_id", "url", F.xxhash64("html")).sortWithinPartitions("page_id", "url", F.xxhash64("html"))
    return written(ordered.mapInArrow(_pack, "part int, file int, content binary"), "warc")


def replicate(files: DataFrame, damage: Callable[[bytes], bytes]) -> DataFrame:
    """Another replica of a table of files, whose contents went through `damage`."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([damage(x) for x in batch.column(2).to_pylist()], pa.binary())], ["part", "file", "content"])

    return written(files.select("part", "file", "content").mapInArrow(run, "part int, file int, content binary"), "replica")


def _leaves(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        out = []
        for part, file, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for number, (at, size, fields) in enumerate(islice(parse(content), FILE_RECORDS)):
                if number == FILE_RECORDS - 1:  # the last leaf has whatever a damaged file holds beyond
                    size = len(content) - at
                digest = hashlib.sha256(content[at : at + size]).hexdigest()
                leaf = hashlib.sha256(f"0:{at}:{size}:{digest}".encode()).hexdigest()
                page = fields.get("warc-page-id", "")
                out.append({"key": part << 24 | file << 8 | number, "hash": leaf, "first": at, "end": at + size, "page_id": int(page) if page.lstrip("-").isdigit() else None, "digest": digest})
        kinds = pa.schema([("key", pa.int64()), ("hash", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string())])
        yield pa.RecordBatch.from_pylist(out, schema=kinds)


def tree(files: DataFrame) -> list[DataFrame]:
    """The written levels of the tree over a table of files, leaves first, the root last."""
    levels = [written(files.select("part", "file", "content").mapInArrow(_leaves, "key long, hash string, first long, end long, page_id long, digest string"), "leaves")]
    for _ in range(LEVELS):
        child = F.array_sort(F.collect_list(F.struct("key", "first", "end", "hash")))
        up = levels[-1].groupBy(F.shiftright("key", 8).alias("key")).agg(child.alias("c"))
        text = F.concat(F.lit("1:"), F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["key"].cast("string"), x["first"].cast("string"), x["end"].cast("string"), x["hash"])), ";"))
        levels.append(written(up.select("key", F.sha2(text, 256).alias("hash"), F.get("c", F.lit(0))["first"].alias("first"), F.element_at("c", -1)["end"].alias("end")), "nodes"))
    return levels


def audit(one: list[DataFrame], two: list[DataFrame]) -> DataFrame:
    """Records in which two replicas differ: key, and page_id, range and digest in each (null where absent).

    The differing nodes of a level are written before the next one is
    descended; equal roots end the descent at once.
    """
    bad: DataFrame | None = None
    for a, b in zip(reversed(one[1:]), reversed(two[1:])):
        if bad is not None:
            a, b = (x.join(bad, F.shiftright(x["key"], 8) == F.col("up"), "left_semi") for x in (a, b))
        left, right = a.select("key", F.col("hash").alias("x")), b.select("key", F.col("hash").alias("y"))
        above, bad = bad, written(left.join(right, "key", "full").where("not (x <=> y)").select(F.col("key").alias("up")), "differing")
        if above is not None:
            discard(above)
        if bad.isEmpty():
            break
    sides = []
    for mark, leaves in (("a", one[0]), ("b", two[0])):
        part = leaves.join(bad, F.shiftright("key", 8) == F.col("up"), "left_semi")
        sides.append(part.select("key", *(F.col(c).alias(f"{c}_{mark}") for c in ("hash", "first", "end", "page_id", "digest"))))
    return sides[0].join(sides[1], "key", "full").where("not (hash_a <=> hash_b)").drop("hash_a", "hash_b")


def flip_marked(content: bytes) -> bytes:
    """Damage for the audit's query: one byte of each record whose page number's md5 begins with 0."""
    out = bytearray(content)
    for at, _, fields in parse(content):
        if hashlib.md5(fields.get("warc-page-id", "").encode()).hexdigest()[0] == "0":
            out[content.index(b"\r\n\r\n", at) + 4] ^= 0x10
    return bytes(out)
