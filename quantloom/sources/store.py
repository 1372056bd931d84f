"""Stored tables: bucketed by key, sorted within buckets, renewed when what they are made of changes.

A table is a folder of versions and a manifest. A version's name is the fingerprint of the inputs' files (path, length, time
of change) and of the layout; the manifest, replaced by a rename once the data are committed, names the version in force.
So a changed input gives a new version, a build that failed leaves the old one in force, and readers of an old version are
not disturbed. Plans by the key over a stored table need no exchange: its buckets are the partitions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import quoted

MANIFEST = "manifest.json"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def fingerprint(inputs: list[DataFrame], *parts: object) -> str:
    """Of the files that inputs read (no data are read) and of parts."""
    rows = []
    for df in inputs:
        for name in df.inputFiles():
            fs, where = _fs(df.sparkSession, name)
            status = fs.getFileStatus(where)
            rows.append((name, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(json.dumps([sorted(rows), *map(str, parts)]).encode()).hexdigest()[:16]


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """What the folder's manifest says; null without one."""
    fs, where = _fs(spark, f"{path}/{MANIFEST}")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    fs, new = _fs(spark, f"{path}/{MANIFEST}.new")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    _, old = _fs(spark, f"{path}/{MANIFEST}")
    fs.delete(old, False)
    if not fs.rename(new, old):
        raise OSError(f"{path}: the manifest could not be put in force")


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """The version in force, as a table of the session's catalogue with its buckets declared."""
    m = read_manifest(spark, path)
    if m is None:
        raise FileNotFoundError(f"{path}: no manifest")
    name = f"stored_{hashlib.sha256(f'{path}/{m['version']}'.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(name):
        by, order = (", ".join(map(quoted, m[k])) for k in ("by", "order"))
        layout = f"clustered by ({by}){f' sorted by ({order})' if order else ''} into {m['buckets']} buckets"
        spark.sql(f"create table {name} ({m['schema']}) using parquet {layout} location '{path}/{m['version']}'")
    return spark.table(name)


def stored(spark: SparkSession, path: str, build: Callable[[], DataFrame], inputs: list[DataFrame], by: list[str], order: list[str], buckets: int, version: str = "") -> DataFrame:
    """The stored table at path, built first if there is none or if the inputs' files, the layout or `version` (the
    caller's name for how it is built) have changed. A bucket is a task's share: choose buckets by the table's size. Keys
    of very many rows stay in one bucket; for these see operators.ranges."""
    mark = fingerprint(inputs, by, order, buckets, version)
    m = read_manifest(spark, path)
    if m is None or m["version"] != mark:
        df = build()
        name = f"building_{mark}_{hashlib.sha256(path.encode()).hexdigest()[:8]}"
        spark.sql(f"drop table if exists {name}")
        dealt = df.repartition(buckets, *by)  # a file a bucket
        writer = dealt.write.mode("overwrite").format("parquet").option("path", f"{path}/{mark}").bucketBy(buckets, *by)
        (writer.sortBy(*order) if order else writer).saveAsTable(name)
        schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)
        spark.sql(f"drop table {name}")  # external: the files stay
        _write_manifest(spark, path, {"version": mark, "by": by, "order": order, "buckets": buckets, "schema": schema})
    return open_table(spark, path)


def versions(spark: SparkSession, path: str) -> list[str]:
    """The versions that the folder holds."""
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []


def prune(spark: SparkSession, path: str) -> None:
    """Remove the versions that are no longer in force."""
    m = read_manifest(spark, path)
    for v in versions(spark, path):
        if m is not None and v != m["version"]:
            fs, where = _fs(spark, f"{path}/{v}")
            fs.delete(where, True)
