"""URL filter over a sorted digest array.

The list (keys like `example.org/es/`: host, then path prefix) becomes shards in the shared folder, one for each
`shard_rows` keys, dealt by ranges of the digest: each an array of 64-bit xxhash keys (seed 42, as Spark's xxhash64) in
ascending order, the full key strings in that order and their verdicts. Executors memory-map a shard's arrays when a
candidate first falls into its range, once a process (a shard in a store that can't be mapped is read then), probe all
candidate keys of a batch of URLs in the shards of their ranges by vectorised binary search, and confirm every digest
hit against the stored string, so that a collision never decides. A URL's candidates are its host and parent domains of
no more labels and letters than the list's hosts have, each with the path prefixes of those lengths that occur in the
list. The longest confirmed key wins; without one the verdict is `default`.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end.
Defined cases. Null URL or no `://`: empty host and path, no rule, the default. Equal keys in the list: block wins. List
entries with a null key or verdict are ignored; a key without a slash is a host: it is read as if `/` followed. Hosts of
any number of labels. Repeated rows are judged one by one; other columns are ignored. Empty list: every URL gets the
default.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, new_folder, open_fs, scratch, table

SHARD_ROWS = 1_000_000
SCHEMA = "page_id long, host string, path string, rule string, verdict string"
#: The production list: the stated rules, then invented block entries.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
LISTED = ["adserver.example/", "tracker.example/", "malware.example/", "phish.example/login"]
URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def _put(fs, path: str, data: bytes) -> None:
    with fs.open_output_stream(path) as out:
        out.write(data)


def digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, 42)


def build(entries: DataFrame, folder: str, shards: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write the digest array of entries (key, verdict); returns its manifest (shard path, lowest and highest digest, n,
    path lengths, most labels and letters of a host)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if not rows:
            return
        rows = sorted((digest(k.encode()), k, v) for k, v in rows)
        from pyspark import TaskContext

        fs, root = open_fs(folder)
        base = f"{root}/shard-{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        fs.create_dir(root, recursive=True)
        names = [k.encode() for _, k, _ in rows]
        for name, x in (("keys", np.array([h for h, _, _ in rows], np.uint64)), ("ends", np.cumsum([len(k) for k in names])), ("block", np.array([v for _, _, v in rows])), ("text", np.frombuffer(b"".join(names), np.uint8))):
            np.save(out := io.BytesIO(), x)
            _put(fs, f"{base}.{name}.npy", out.getvalue())
        lengths = sorted({len(k) - k.index("/") for _, k, _ in rows})
        bounds = [pa.array(np.array([rows[k][0]], np.uint64).view(np.int64)) for k in (0, -1)]
        hosts = [k[: k.index("/")] for _, k, _ in rows]
        most = [pa.array([max(x)]) for x in ([h.count(".") + 1 for h in hosts], list(map(len, hosts)))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([base]), *bounds, pa.array([len(rows)]), pa.array([lengths], pa.list_(pa.int64())), *most],
            names=["base", "lo", "hi", "n", "lengths", "labels", "letters"],
        )

    keyed = entries.where("key is not null and verdict is not null").withColumn("key", F.expr("if(instr(key, '/') = 0, key || '/', key)"))
    keyed = keyed.groupBy("key").agg(F.max(F.col("verdict") == "block").alias("blocked")).withColumn("h", F.xxhash64("key"))
    shards = shards or -(-keyed.count() // shard_rows)
    # Signed order, halved around zero, is not the digests' own: the sign bit is flipped, so ranges are of unsigned digests.
    dealt = keyed.repartitionByRange(shards, F.expr("h ^ -9223372036854775808L")) if shards > 1 else keyed.repartition(1)
    return dealt.select("key", "blocked").mapInArrow(write, "base string, lo long, hi long, n long, lengths array<long>, labels long, letters long")


class Shard:
    """The arrays of one shard, mapped where the folder is a local mount."""

    _held: dict[str, Shard] = {}

    @classmethod
    def of(cls, folder: str, base: str) -> Shard:
        """A shard of the folder in use; shards of another folder are let go."""
        if not all(k.startswith(f"{folder}|") for k in cls._held):
            cls._held.clear()
        if (key := f"{folder}|{base}") not in cls._held:
            cls._held[key] = cls(open_fs(folder)[0], base)
        return cls._held[key]

    def __init__(self, fs, base: str) -> None:
        from pyarrow import fs as pafs

        def load(name: str) -> np.ndarray:
            if isinstance(fs, pafs.LocalFileSystem):
                return np.load(f"{base}.{name}.npy", mmap_mode="r")
            with fs.open_input_file(f"{base}.{name}.npy") as f:
                return np.load(io.BytesIO(f.read()))

        self.keys, self.ends, self.block, self.text = map(load, ("keys", "ends", "block", "text"))

    def find(self, digests: np.ndarray, names: list[bytes]) -> list[tuple[int, bool]]:
        """(index of the candidate, blocked) of those whose digest and string are stored."""
        at, found = np.searchsorted(self.keys, digests), []
        inside = np.minimum(at, len(self.keys) - 1)
        for i in np.flatnonzero(self.keys[inside] == digests):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:  # equal digests lie side by side
                if self.text[int(self.ends[j - 1]) if j else 0 : int(self.ends[j])].tobytes() == names[i]:
                    found.append((int(i), bool(self.block[j])))
                    break
                j += 1
        return found


def split_url(url: str | None) -> tuple[str, str]:
    m = URL.search(url or "")
    return (m[1].translate(str.maketrans(UPPER, LOWER)), m[2]) if m else ("", "")


def judge(urls: DataFrame, entries: DataFrame, default: str = "allow", shards: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of urls (page_id, url) under entries (key, verdict)."""
    folder = new_folder(urls.sparkSession, "url-digests")
    manifest = build(entries, folder, shards).toArrow().to_pydict()  # a row a shard
    scratch(urls.sparkSession, folder)
    bases, lengths = manifest["base"], sorted({x for row in manifest["lengths"] for x in row})
    most_labels, most_letters = (max(manifest[c], default=1) for c in ("labels", "letters"))
    lo, hi = (np.array(manifest[c], np.int64).view(np.uint64) for c in ("lo", "hi"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            names, owner = [], []
            for i, (host, path) in enumerate(parts):
                labels = host.rsplit(".", most_labels) if host else []
                for k in range(len(labels) > most_labels, len(labels)):
                    domain = ".".join(labels[k:])
                    for n in lengths if len(domain) <= most_letters else ():
                        if n <= len(path):
                            names.append((domain + path[:n]).encode())
                            owner.append(i)
            digests = np.array([digest(x) for x in names], np.uint64)
            best: dict[int, tuple[int, bytes, bool]] = {}
            for base, low, high in zip(bases, lo, hi, strict=True) if names else ():
                mine = np.flatnonzero((digests >= low) & (digests <= high))
                for k, blocked in Shard.of(folder, base).find(digests[mine], [names[c] for c in mine]) if len(mine) else ():
                    c = int(mine[k])
                    best[owner[c]] = max(best.get(owner[c], (-1, b"", False)), (len(names[c].decode()), names[c], blocked))
            rule = [best[i][1].decode() if i in best else None for i in range(len(parts))]
            verdict = [("block" if best[i][2] else "allow") if i in best else default for i in range(len(parts))]
            cols = [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "host", "path", "rule", "verdict"])

    return urls.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(probe, SCHEMA)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame([*RULES, *((k, "block") for k in LISTED)], "key string, verdict string")
    return judge(table(spark, sf_dir, "pages"), entries)


_ALL = [*RULES, *((k, "block") for k in LISTED)]
ORACLE = rf"""
with r(host, path, rule, verdict) as (values {', '.join(f"('{k[:k.index('/')]}', '{k[k.index('/'):]}', '{k}', '{v}')" for k, v in _ALL)}),
p as (select row_number() over () as n, page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
m as (select n, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from p join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by n)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join m using (n)
"""
QUERIES = {"op2_url_filter": op2_url_filter}
ORACLES = {"op2_url_filter": ORACLE}
