"""WARC archives with an index first, read back by coalesced byte ranges.

write() puts each row into an archive (one gzip member a record, one archive a task) and returns the index: archive, offset, length,
URL, digest and the record's id. read() takes any selection of index rows, sorts them by archive and offset, joins ranges that lie
closer than `gap` up to `span` bytes, reads each joined range once and parses the records in it.

Of records with one payload of at least `least` bytes, the one with the largest key is the response and the others revisit it.
Which one that is comes from sums over digests; a payload that a third of all rows share is joined by salted digests.

Archives are named by task attempt and counted only if their index rows were committed, so a lost executor leaves no wrong
record. They are written through pyarrow's file systems (files, HDFS, S3, GCS), below the folder that all executors share.

Defined results: a null payload is empty; a null URL is empty; a null key is never a response that others refer to, unless all rows
with the payload have one, which then are all responses; of repeated rows with the largest key, all are responses; an empty table
gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae.llm.common import fresh_dir, join_hot, ready, text_of, written

INDEX = "archive string, offset long, length long, url string, digest string, record_id long, record_type string"
END = b"\r\n"


def shared_folder(spark: SparkSession, folder: str) -> str:
    """folder with the scheme that Spark takes it to have, so that it is the same place to executors' workers: without one it would be a
    folder on each executor's own disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _file_system(uri: str):
    """pyarrow's file system and path of a URI; it knows S3 by one name only."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    if rest and scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def record(key: int | None, url: str, payload: bytes, kind: str, refers_to: int | None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """A record as one gzip member. A revisit has no payload but its digest and length."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if key is None else key}>"), ("WARC-Date", date),
        ("WARC-Target-URI", "".join(url.splitlines())), ("WARC-Payload-Digest", digest), ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode("utf-8", "surrogatepass") + END + block + END + END) + pack.flush()


def parse(member: bytes) -> dict:
    """The record of one gzip member: fields, key, kind, refers_to, payload (None in a revisit), digest (hex) and payload's length."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(END + END)
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if rest[n:] != END + END:
        raise ValueError("a record's length is wrong")
    _, _, payload = rest[:n].partition(END + END)
    page = lambda name: (lambda v: int(v) if v else None)(fields[name][len("<urn:page:") : -1]) if name in fields else None
    kind = fields["WARC-Type"]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload doesn't have its digest")
    return {"key": page("WARC-Record-ID"), "kind": kind, "refers_to": page("WARC-Refers-To"), "payload": payload if kind == "response" else None, "digest": digest, "length": int(fields["WARC-Payload-Length"]), "url": fields["WARC-Target-URI"]}


def decide(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 1000) -> DataFrame:
    """key, url, payload (binary), kind and refers_to of each row."""
    body = text_of(payload).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("key"), text_of("url").alias("url"), body.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = pages.select(F.col(key).cast("long").alias("key"), body.alias("payload")).where(F.length("payload") >= least).select("key", F.sha1("payload").alias("digest"))
    first = written(large.groupBy("digest").agg(F.max("key").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"), "digests")
    out = join_hot(rows, first, ["digest"], salt_by=["key"])
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return out.select("key", "url", "payload", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"))


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write decide()'s rows into archives below folder; return the index, itself a table in the shared folder."""
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_id", pa.int64()), ("record_type", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        name = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, at = None, 0
        for b in batches:
            if out is None and b.num_rows:
                out = system.open_output_stream(name, compression=None)
            index: list[tuple] = []
            for key, url, payload, kind, refers_to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                payload = payload.as_py()
                member = record(key, url, payload, kind, refers_to)
                out.write(member)
                index.append((name, at, len(member), url, hashlib.sha1(payload).hexdigest(), key, kind))
                at += len(member)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index, strict=True), schema, strict=True)], schema=schema)
        if out is not None:
            out.close()

    ready(rows.sparkSession)
    return written(rows.select("key", "url", "payload", "kind", "refers_to").mapInArrow(run, INDEX), "index")


def ranges(rows: list[tuple[int, int]], gap: int, span: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, last + 1, offset, length) of the joined ranges of rows (offset, length), which are sorted by offset."""
    i = 0
    while i < len(rows):
        start, end, k = rows[i][0], rows[i][0] + rows[i][1], i + 1
        while k < len(rows) and rows[k][0] - end <= gap and max(end, rows[k][0] + rows[k][1]) - start <= span:
            end = max(end, rows[k][0] + rows[k][1])
            k += 1
        yield i, k, start, end - start
        i = k


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(selected: DataFrame, folder: str, gap: int = 64 << 10, span: int = 4 << 20, chunk: int = 4 << 20, with_payload: bool = True, most_tasks: int = 100_000) -> DataFrame:
    """READ of the index rows selected. Archives are cut into chunks of `chunk` bytes, so that a large one is read by many tasks: one a
    chunk or so, whatever the index takes itself; chunks grow where there would be more than most_tasks."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(folder)
        for b in batches:
            rows = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            lo = 0
            while lo < len(rows):
                hi = next((k for k in range(lo, len(rows)) if rows[k][0] != rows[lo][0]), len(rows))
                own = [(r[1], r[2]) for r in rows[lo:hi]]
                with system.open_input_file(rows[lo][0]) as archive:
                    for i, k, offset, length in ranges(own, gap, span):
                        data = archive.read_at(length, offset)
                        got = [parse(data[o - offset : o - offset + n]) for o, n in own[i:k]]
                        cols = ([g[c] if c != "payload" or with_payload else None for g in got] for c in ("key", "url", "payload", "length", "digest", "kind", "refers_to"))
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
                lo = hi

    ready(selected.sparkSession)
    total = selected.agg(F.sum("length")).first()[0] or 0
    chunk = max(chunk, -(-total // most_tasks))
    place = F.floor(F.col("offset") / chunk).alias("_chunk")
    sorted_rows = selected.select("archive", "offset", "length", place).repartition(max(1, -(-total // chunk)), "archive", "_chunk").sortWithinPartitions("archive", "offset")
    return sorted_rows.select("archive", "offset", "length").mapInArrow(run, READ)


def report(pages: DataFrame) -> DataFrame:
    """Write all pages, read all records back."""
    folder = shared_folder(pages.sparkSession, fresh_dir(pages.sparkSession, "warc"))
    index = write(decide(pages), folder)
    return read(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
