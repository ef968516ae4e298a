"""WARC archives with a two-level capture index.

Writing: each partition of records becomes one archive of gzip members, one
member for each record. Of records with equal payloads the one with the largest
id is a ``response``; the others are ``revisit`` records with the HTTP header
only, which refer to it. Payload groups are counted before the join that tells
each record its part; a hot payload's rows are split by adaptive execution.

Indexing: captures are range-partitioned and sorted by URL key (host labels
reversed, then the path) and id. A partition's lines are cut into zlib blocks of
``BLOCK_LINES`` lines; the first key of every block goes into a sparse directory
at the end of the index file. The first key of every index file is all that the
driver keeps: one entry for each partition.

Reading: looked-up keys are sent to their index file by binary search among the
files' first keys, then to a block by binary search in that file's directory,
then to a line in the block; the archive is read by range. Index files are read
once for each task, blocks one at a time.

Archives and index lie below ``spark.checkpoint.dir`` (or the folder given) and
are opened with ``pyarrow.fs`` by URI, so that any store it knows can hold them.
A task writes under a name of its own attempt, and only files that a finished
task reports are in the index: lost executors leave orphans, not damage.

Null payloads are empty, null urls have the key ``)``; records with a null id
are written as responses and are not referred to. Rows with equal id and equal
payload, if it is the largest, are all responses. Other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveline.llm.tables import small_batches
from staveline.sources.scratch import materialize, scratch_path

BLOCK_LINES = 128
DATE = "1970-01-01T00:00:00Z"
ENTRIES = "surt string, page_id long, file string, at long, size long"
FILES = "surt string, page_id long, file string, directory_at long, directory_size long"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def surt(url: str | None) -> str:
    """The host's labels reversed and joined by commas, ``)``, then the rest of the url."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return ")"
    m = re.match(r"([^/?#]*)(.*)", rest, re.S)
    return ",".join(reversed(m[1].lower().split("."))) + ")" + m[2]


def _open(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store, name


def _header(pairs: list[tuple[str, str]], first: str) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n").encode()


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str | None = None) -> bytes:
    """One WARC record as a gzip member; with ``refers_to`` a revisit without payload."""
    digest = digest or sha1_base32(payload)
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    body = http if refers_to is not None else http + payload
    name = "none" if page_id is None else str(page_id)
    pairs = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        pairs += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
        ]
    pairs += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return gzip.compress(_header(pairs, "WARC/1.1") + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of one record; the payload's length and digest are those of the full payload.

    A response's digest is computed anew and must be the one in its header.
    """
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda text: None if text == "none" else int(text)
    refers = fields.get("WARC-Refers-To")
    if refers is None and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't hold the payload that its header names")
    return {
        "page_id": number(fields["WARC-Record-ID"][10:-1]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
        "refers_to": number(refers[10:-1]) if refers else None, "payload_bytes": size, "payload_digest": digest, "payload": payload,
    }


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row below ``folder``; the captures (``ENTRIES``)."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    keepers = rows.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1")
    roles = rows.join(keepers.select("digest", "keeper"), "digest", "left")
    refers = F.when(F.col("page_id") < F.col("keeper"), F.col("keeper"))
    names = [x.strip().split(" ")[0] for x in ENTRIES.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/archive-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        store = out = None
        at = 0
        for batch in batches:
            found = []
            for page_id, url, data, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store, name = _open(path)
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(name, compression=None)
                member = record(page_id, url, data, refers_to)
                out.write(member)
                found.append((surt(url), page_id, path, at, len(member)))
                at += len(member)
            cols = list(zip(*found, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
        if out is not None:
            out.close()

    chosen = small_batches(roles).select("page_id", "url", "payload", refers.alias("refers_to"))
    return materialize(chosen.mapInArrow(run, ENTRIES), "captures")


def index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the index files of ``captures`` below ``folder``; one row for each file (``FILES``)."""
    names = [x.strip().split(" ")[0] for x in FILES.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/index-{task.partitionId():06d}-{task.taskAttemptId()}.cdx"
        out, at, first = None, 0, None
        lines: list[bytes] = []
        directory: list[tuple[str, int, int]] = []
        head = None

        def close() -> None:
            nonlocal at, head
            block = zlib.compress(b"\n".join(lines), 6)
            out.write(block)
            directory.append((head, at, len(block)))
            at += len(block)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store, name = _open(path)
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(name, compression=None)
                    first = row[:2]
                if not lines:
                    head = list(row[:2])
                lines.append(json.dumps(row).encode())
                if len(lines) == BLOCK_LINES:
                    close()
        if out is not None:
            if lines:
                close()
            data = zlib.compress(json.dumps(directory).encode())
            out.write(data + struct.pack("<q", len(data)))
            out.close()
            cols = [pa.array([v], k) for v, k in zip((*first, path, at, len(data)), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names)

    ordered = captures.repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id")
    return materialize(ordered.mapInArrow(run, FILES), "index")


def _key(surt_key: str, page_id: int | None) -> tuple[bytes, int]:
    """Order as Spark sorts: nulls first, strings by their bytes."""
    return surt_key.encode(), -(1 << 63) - 1 if page_id is None else page_id


def lookup(keys: DataFrame, files: DataFrame, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The archived record of each row of ``keys`` (``READ``), found through the index.

    A key that isn't archived gives no row; one that is archived twice gives all of its records once for each row.
    """
    known = sorted((_key(r.surt, r.page_id), r.file, r.directory_at, r.directory_size) for r in files.collect())  # one for each partition
    firsts = [k for k, *_ in known]
    names = [x.strip().split(" ")[0] for x in READ.split(",")]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for page_id, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = surt(url)
                low, high = bisect.bisect_left(firsts, _key(k, page_id)), bisect.bisect_right(firsts, _key(k, page_id))
                # Equal keys may go on from the file before.
                found += [(n, k, page_id) for n in range(max(0, low - 1), high)]
            cols = list(zip(*found, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64()), strict=True)], ["file", "surt", "page_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, object] = {}

        def ranged(path: str, at: int, size: int) -> bytes:
            if path not in opened:
                if len(opened) >= 64:
                    opened.pop(next(iter(opened))).close()
                store, name = _open(path)
                opened[path] = store.open_input_file(name)
            opened[path].seek(at)
            return opened[path].read(size)

        at_file, directory, heads, at_block, rows, row_keys = -1, [], [], -1, [], []
        for batch in batches:
            found = []
            for n, k, page_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n != at_file:
                    _, path, start, size = known[n]
                    directory = json.loads(zlib.decompress(ranged(path, start, size)))
                    heads = [_key(*h) for h, _, _ in directory]
                    at_file, at_block = n, -1
                want = _key(k, page_id)
                b = max(0, bisect.bisect_left(heads, want) - 1)
                while b < len(heads) and heads[b] <= want:
                    if b != at_block:
                        block = zlib.decompress(ranged(known[n][1], *directory[b][1:]))
                        rows = [json.loads(x) for x in block.split(b"\n")]
                        row_keys = [_key(*r[:2]) for r in rows]
                        at_block = b
                    for r in rows[bisect.bisect_left(row_keys, want) : bisect.bisect_right(row_keys, want)]:
                        got = parse(ranged(*r[2:]))
                        found.append([got[x] for x in names])
                    b += 1
            cols = list(zip(*found, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)
        for x in opened.values():
            x.close()

    wanted = keys.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    dealt = wanted.mapInArrow(spread, "file int, surt string, page_id long")
    return dealt.repartition("file").sortWithinPartitions("file", "surt", "page_id").mapInArrow(run, READ)


def archive(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Write ``pages`` as archives with their index; the index files. ``folder`` is a URI."""
    folder = folder or f"{scratch_path(pages.sparkSession, 'warc')}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    return index(write(pages, folder, **columns), folder)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive every page and read each back through the index (``READ``)."""
    files = archive(pages, folder)
    wanted = pages.select("page_id", "url").distinct()
    return lookup(wanted, files)
