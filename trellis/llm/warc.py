"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: payloads are grouped by SHA-1 and length; of equal ones the largest page_id is the response, the others are
revisit records that refer to it and hold no payload. Rows of one page_id and payload are all responses. Each task writes
files of at most FILE bytes (or one record), under a private name first.

Reading: tasks scan blocks of the files for the magic and emit (offset, successor's offset) of everything that parses as a
record header, magic within payloads included; where a header's end isn't within the block, the task reads on. Per file, pointer jumping from offset 0 keeps the records on the chain:
in each round the reached set takes one jump and the jumps double, so a chain of n records needs log2(n) rounds over
arrays. A file whose chain doesn't end at its last byte is refused, one without candidates too. A file's candidates are bounded by its size.

A null html is an empty payload, a null url is the empty one; a null page_id is written as such, and is never the largest
unless all are null. An empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from urllib.parse import quote

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_fs, put_file, ship, table, work_dir, written

MAGIC = b"WARC/1.0\r\n"
FILE, BLOCK, HEADER = 32 << 20, 4 << 20, 64 << 10
#: Revisits that may be broadcast.
FEW = 500_000


def record(page_id, url: str | None, payload: bytes, kind: str, refers_to, digest: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {quote(url or '', safe='%/:=&?~#+!$,;@()*[]')}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return MAGIC + "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to. Digests are grouped by partial aggregation; payloads stay where they are while
    the revisits are few enough to be broadcast, else rows meet by digest and page_id, so a payload of a third of all rows
    is spread."""
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha", F.unhex(F.sha1("payload")))
    ids = p.select("sha", F.octet_length("payload").alias("n"), "page_id")
    best = ids.groupBy("sha").agg(F.max("page_id").alias("best"), F.count("*").alias("c")).filter("c > 1").drop("c")
    again = (F.col("n") >= least) & F.coalesce(F.col("page_id") != F.col("best"), F.col("best").isNotNull())
    refs = written(ids.distinct().join(best, "sha").filter(again).select(F.col("sha").alias("_s"), F.col("page_id").alias("_p"), F.col("best").alias("refers_to")), "warc-revisits")
    small = refs.count() <= FEW  # at most 50 bytes a row
    j = p.join(F.broadcast(refs) if small else refs, (F.col("sha") == F.col("_s")) & F.col("page_id").eqNullSafe(F.col("_p")), "left")
    return j.select("page_id", "url", "payload", "refers_to")


def write(pages: DataFrame, uri: str, least: int = 0) -> list[tuple[str, int]]:
    """Write an archive of pages (page_id, url, html) below uri; returns its files and their sizes, one line per FILE bytes."""

    ship(pages.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, files, chunks, size = TaskContext.get().partitionId(), [], [], 0

        def flush():
            path = f"{uri}/{part:06d}-{len(files):04d}.warc"
            files.append((path, put_file(path, chunks)))

        for b in batches:
            for i, url, payload, ref in zip(*(b.column(k) for k in range(4))):
                payload, ref = payload.as_py(), ref.as_py()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                r = record(i.as_py(), url.as_py(), payload, "response" if ref is None else "revisit", ref, digest)
                if chunks and size + len(r) > FILE:
                    flush()
                    chunks, size = [], 0
                chunks.append(r)
                size += len(r)
        if chunks:
            flush()
        yield pa.RecordBatch.from_pydict({"path": pa.array([f for f, _ in files], pa.string()), "size": pa.array([n for _, n in files], pa.int64())})

    rows = typed(pages, least).mapInArrow(run, "path string, size long").collect()  # not sorted on the cluster: that would write twice
    return sorted((r["path"], r["size"]) for r in rows)


_length = re.compile(rb"\r\ncontent-length: *(\d+)\r\n", re.I)


def candidates(data: bytes, at: int, upto: int, more=lambda: b"") -> list[tuple[int, int]]:
    """(offset, successor) for each header that begins in data before `upto`; data begins at offset `at` of the file, and
    more() gives the bytes that follow, none at the file's end. A header may be of any length."""
    out, i, end, m = [], data.find(MAGIC), -1, None
    while 0 <= i < upto:
        if end < i:
            end = data.find(b"\r\n\r\n", i)
            while end < 0 and (next_ := more()):
                seen = max(i, len(data) - 3)
                data += next_
                end = data.find(b"\r\n\r\n", seen)
            if end < 0:
                break
            m = _length.search(data, i, end + 2)
        elif m and m.start() < i:
            m = _length.search(data, i, end + 2)
        if m:
            out.append((at + i, at + end + 4 + int(m[1]) + 4))
        i = data.find(MAGIC, i + 1)
    return out


def chain(offsets: np.ndarray, successors: np.ndarray, size: int) -> np.ndarray:
    """Which of the candidates are reached from offset 0, by pointer jumping. Raises unless the chain ends at size."""
    order = np.argsort(offsets)
    at = np.append(offsets[order], size)
    n = len(offsets)
    k = np.searchsorted(at, successors[order])
    good = (k <= n) & (at[np.minimum(k, n)] == successors[order])
    jump = np.append(np.where(good, k, n + 1), [n, n + 1])  # n: the end, n + 1: nowhere
    reached = np.zeros(n + 2, bool)
    if n and at[0] == 0:
        reached[0] = True
    while True:
        more = reached.copy()
        more[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
        if (more == reached).all():
            break
        reached = more
    if size and not reached[n]:
        raise ValueError("the chain of records breaks off")
    out = np.zeros(n, bool)
    out[order] = reached[:n]
    return out


def boundaries(spark, files: list[tuple[str, int]]) -> DataFrame:
    """path, offset, successor of each record of the files."""
    ship(spark)
    d = spark.createDataFrame(files, "path string, size long")
    blocks = d.select("path", "size", F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {BLOCK}L)")).alias("at"))
    n = max(1, min(sum(-(-s // BLOCK) for _, s in files), 4 * spark.sparkContext.defaultParallelism * 8))

    def scan(batches):
        import pyarrow as pa

        for b in batches:
            for path, size, at in zip(*(b.column(k).to_pylist() for k in range(3))):
                fs, p = open_fs(path)
                with fs.open_input_file(p) as f:
                    f.seek(at)
                    found = candidates(f.read(BLOCK + HEADER), at, BLOCK, lambda f=f: f.read(BLOCK))
                if at == 0:
                    found.append((-1, -1))  # stands for the file, so that one without candidates is seen
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(found), pa.string()), "size": pa.array([size] * len(found), pa.int64()), "offset": pa.array([x for x, _ in found], pa.int64()), "successor": pa.array([y for _, y in found], pa.int64())})

    def keep(pdf):
        size, pdf = int(pdf["size"].iloc[0]), pdf[pdf["offset"] >= 0]
        ok = chain(pdf["offset"].to_numpy(), pdf["successor"].to_numpy(), size)
        return pdf.loc[ok, ["path", "offset", "successor"]].sort_values("offset")

    found = blocks.repartition(n, "path", "at").mapInArrow(scan, "path string, size long, offset long, successor long")
    return found.groupBy("path").applyInPandas(keep, "path string, offset long, successor long")


def parse(data: bytes) -> dict:
    """A record's fields. The payload of a response is checked against its digest."""
    end = data.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in data[len(MAGIC) : end].decode().split("\r\n"))
    block = data[end + 4 : -4]
    cut = block.index(b"\r\n\r\n")
    payload = block[cut + 4 :]
    n = int(_length.search(block, 0, cut + 2)[1])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    page = lambda k: head[k][len("<urn:page:") : -1]
    if head["WARC-Type"] == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload isn't what its record says")
    return {"page_id": int(page("WARC-Record-ID")) if page("WARC-Record-ID") else None, "url": head["WARC-Target-URI"], "payload": payload, "payload_bytes": n, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": int(page("WARC-Refers-To")) if "WARC-Refers-To" in head else None}


def read(spark, files: list[tuple[str, int]]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of the files."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        path, f = None, None
        for b in batches:
            rows = []
            for p, at, end in zip(*(b.column(k).to_pylist() for k in range(3))):
                if p != path:
                    fs, inner = open_fs(p)
                    path, f = p, fs.open_input_file(inner)
                f.seek(at)
                r = parse(f.read(end - at))
                rows.append([r[k] for k in names])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names)

    return boundaries(spark, files).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    files = write(table(spark, sf_dir, "pages", "page_id", "url", "html"), work_dir(spark, "warc"))
    return read(spark, files)
