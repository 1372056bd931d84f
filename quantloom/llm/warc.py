"""WARC archives, index first.

Every page becomes a record, a gzip member of its own (WARC/1.1): a `response` whose block is an HTTP head and the
payload, or a `revisit` (HTTP head only) of the record that holds an equal payload. Of records with equal payloads of
at least `min_bytes` bytes the one with the largest page_id is the response. An archive begins with a `warcinfo`
record. A response's id is a UUID of its folder, page_id and digest, so a revisit names the record it stands for
(`WARC-Refers-To`) without looking it up. Ids of revisits, of records without page_id and of responses that rows equal in
page_id and payload repeat are made from task and offset; a revisit of such a response names the page alone. Page and
page referred to are in extension fields too.

Who refers to whom is settled on (page_id, digest) alone: a partial maximum for each digest, then a join in which the
digests of more than `HEAVY` pages (at most pages / HEAVY of them) are broadcast and only the others shuffled. Payloads
are dealt out once, by page_id and digest. So a payload that a third of all pages share makes no hot task.

Writing gives an index row for each record: archive, offset, length, URL, digest. Reading selects index rows, sorts
them by archive and offset, coalesces neighbours (gaps up to `gap`, ranges up to `most` bytes), deals the ranges out to
as many tasks as their bytes need (`TASK_BYTES` each, but a task a core where there are that many ranges) and reads
each range at once. An archive's name holds the task attempt that wrote it, and the index names the attempts that were
committed, so what a lost executor left behind is never read.

Defined cases. Null html: an empty payload. Null URL: no target URI. A null page_id is a response that refers to
nothing. Rows that repeat a page_id and payload have the same type; a page_id with several payloads has a record for
each, settled apart. Empty table: no archives, an empty result. Other
columns are ignored. The archive folder must have a scheme that pyarrow.fs opens.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, open_fs, scratch, staged, table

INDEX = "archive string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
DATE = "2024-01-01T00:00:00Z"  # pages have no date of their own
TASK_BYTES, HEAVY = 64 << 20, 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(kind: str, fields: list[str], block: bytes, seed: str, level: int = 1) -> bytes:
    """A record as a gzip member."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(seed)}", f"WARC-Date: {DATE}", *fields, f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def info(seed: str) -> bytes:
    return member("warcinfo", ["Content-Type: application/warc-fields"], b"software: quantloom\r\nformat: WARC File Format 1.1\r\n", seed)


def record_id(seed: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, seed)}>"


def response_seed(folder: str, page_id: int, digest: str) -> str:
    return f"{folder}/{page_id}/{digest}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, repeated: bool, folder: str, place: str) -> tuple[bytes, str]:
    """(gzip member, digest) of a page; repeated: several rows hold the response; place: what else a record is named by."""
    digest, kind = sha1_base32(payload), "response" if refers_to is None else "revisit"
    seed = place if page_id is None or repeated or kind == "revisit" else response_seed(folder, page_id, digest)
    fields = ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        fields.append(f"X-Page-ID: {page_id}")
    if url is not None:
        fields.append(f"WARC-Target-URI: {quote(url, safe='%:/?#[]@!$&()*+,;=~' + chr(39))}")
    if refers_to is not None:
        fields += [f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
        if not repeated:
            fields.append(f"WARC-Refers-To: {record_id(response_seed(folder, refers_to, digest))}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return member(kind, fields, http + (payload if refers_to is None else b""), seed), digest


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, digest, type, refers_to) of a page's record; a response's are taken from its payload."""
    head, _, rest = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    number = lambda name: int(fields[name]) if name in fields else None
    if fields["WARC-Type"] == "response":
        payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
        return number("X-Page-ID"), len(payload), sha1_base32(payload), "response", None
    return number("X-Page-ID"), int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], number("X-Refers-To-Page-ID")


def _digest():
    return F.unhex(F.sha1(F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))))


def _settled(pages: DataFrame, min_bytes: int, heavy: int) -> DataFrame:
    """(__id, __d, __to, __repeated): page and digest, the page that holds the response, and whether several rows do; a
    row where these are two pages, or several rows."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    keyed = pages.where(F.col("page_id").isNotNull() & (F.octet_length(payload) >= min_bytes)).select("page_id", _digest().alias("d"))
    keyed = staged(keyed.groupBy("page_id", "d").agg(F.count("*").alias("k")), "warc-digests")
    largest = keyed.groupBy("d").agg(F.max(F.struct("page_id", "k")).alias("m"), F.count("*").alias("n"))
    largest = staged(largest.where("n > 1 or m.k > 1").selectExpr("d", "n", "m.page_id as __to", "m.k > 1 as __repeated"), "warc-largest")
    many = F.broadcast(largest.where(F.col("n") > heavy).drop("n"))
    few = keyed.join(many, "d", "left_anti").join(largest.where(F.col("n") <= heavy).drop("n"), "d")
    return keyed.join(many, "d").unionByName(few).selectExpr("page_id as __id", "d as __d", "__to", "__repeated").where("__id < __to or __repeated")


def referrals(pages: DataFrame, min_bytes: int = 0, heavy: int = HEAVY) -> DataFrame:
    """(__id, __d, __to): the pages and digests that revisit another page, and which."""
    return _settled(pages, min_bytes, heavy).where("__id < __to").drop("__repeated")


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write the archives of pages (page_id, url, html) and return their index."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, name, at = None, f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.warc.gz", 0
        fs, root = open_fs(folder)
        seed = f"{folder}/{TaskContext.get().partitionId()}"
        for b in batches:
            rows = []
            for page, url, html, to, repeated in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)  # members are packed here
                    out.write(first := info(f"{seed}:info"))
                    at = len(first)
                to = None if to == page else to
                packed, digest = record(page, url, (html or "").encode("utf-8", "surrogatepass"), to, repeated, folder, f"{seed}:{at}")
                out.write(packed)
                rows.append((name, at, len(packed), page, url, digest, "response" if to is None else "revisit"))
                at += len(packed)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    same = (F.col("page_id") == F.col("__id")) & (_digest() == F.col("__d"))
    joined = pages.join(_settled(pages, min_bytes, HEAVY), same, "left").selectExpr("page_id", "url", "html", "__to", "coalesce(__repeated, false)")
    return staged(joined.mapInArrow(run, INDEX), "warc-index")


def ranges(index: DataFrame, gap: int = 1 << 16, most: int = 4 << 20) -> DataFrame:
    """Coalesced byte ranges of the selected index rows: archive, from, to, parts (offset, length)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("archive").orderBy("offset", "length")
    rows = index.select("archive", "offset", "length").distinct()
    rows = rows.withColumn("__before", F.lag(F.col("offset") + F.col("length")).over(w))
    rows = rows.withColumn("__run", F.sum((F.coalesce(F.col("offset") - F.col("__before"), F.lit(gap + 1)) > gap).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min("offset").over(Window.partitionBy("archive", "__run"))
    rows = rows.withColumn("__part", F.floor((F.col("offset") - first) / most))
    return rows.groupBy("archive", "__run", "__part").agg(F.min("offset").alias("from"), F.max(F.col("offset") + F.col("length")).alias("to"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("parts")).select("archive", "from", "to", "parts")


def read(index: DataFrame, folder: str, gap: int = 1 << 16, most: int = 4 << 20) -> DataFrame:
    """The records that index names: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        for b in batches:
            for archive, start, stop, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_file(f"{root}/{archive}") as f:
                    f.seek(start)
                    data = f.read(stop - start)
                rows = [parse(data[p["offset"] - start : p["offset"] - start + p["length"]]) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    found = staged(ranges(index, gap, most), "warc-ranges")
    n, size = found.agg(F.count("*"), F.sum(F.col("to") - F.col("from"))).first()
    tasks = max(-(-(size or 0) // TASK_BYTES), min(n, index.sparkSession.sparkContext.defaultParallelism), 1)
    return found.repartition(tasks).mapInArrow(run, RESULT)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    index = write(table(spark, sf_dir, "pages"), folder)
    scratch(spark, folder)
    return read(index, folder)


ORACLE = """
with p as (select page_id, coalesce(encode(html), ''::blob) as b from pages),
h as (select page_id, octet_length(b) as n, upper(sha1(b)) as x from p),
d as (select page_id, n, x, max(page_id) over (partition by x) as top from h),
bits as (select page_id, n, top, list_aggregate(list_transform(range(1, 41), lambda i: right('000' || bin(strpos('0123456789ABCDEF', x[i:i]) - 1), 4)), 'string_agg', '') as s from d)
select page_id, cast(n as bigint) as payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(list_aggregate(list_transform(range(1, 6), lambda j: cast(s[5 * i + j : 5 * i + j] as integer) << (5 - j)), 'sum') as integer) + 1, 1)), 'string_agg', '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to
from bits
"""
QUERIES = {"op4_warc": op4_warc}
ORACLES = {"op4_warc": ORACLE}
