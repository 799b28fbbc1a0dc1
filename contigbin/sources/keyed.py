"""A keyed table that several writers change at once (SNK-7, SNK-8): snapshots with compare-and-swap.

A table is a folder of snapshots (Parquet) and of numbered versions, each a small file that
names its snapshot. A writer reads the latest version, writes the merged rows as a snapshot of its own and claims the
next number; if another writer was first, it merges again with what that one wrote. Readers never see half a change.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .tables import upsert as merged


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _claim(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file with its content unless it is there; whether this call created it. Atomic: a link on local disks, elsewhere a rename, which does not replace."""
    jvm = spark.sparkContext._jvm
    draft = f"{path}.{uuid.uuid4().hex}"
    fs, source = _fs(spark, draft)
    out = fs.create(source, False)
    out.write(content.encode())
    out.close()
    try:
        if fs.getUri().getScheme() != "file":
            return fs.rename(source, _fs(spark, path)[1])
        local = lambda p: jvm.java.nio.file.Path.of(jvm.java.net.URI(fs.makeQualified(_fs(spark, p)[1]).toUri().toString()))
        try:
            jvm.java.nio.file.Files.createLink(local(path), local(draft))
            return True
        except Exception as error:
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
    finally:
        fs.delete(source, False)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions, ascending."""
    fs, folder = _fs(spark, f"{path}/versions")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table at its latest (or a given) version. Raises if there is none."""
    have = versions(spark, path)
    version = have[-1] if version is None and have else version
    if version not in have:
        raise FileNotFoundError(f"{path} has no version {version if version is not None else ''}".rstrip())
    fs, file = _fs(spark, f"{path}/versions/{version:08d}")
    stream = spark.sparkContext._jvm.java.io.BufferedReader(spark.sparkContext._jvm.java.io.InputStreamReader(fs.open(file)))
    try:
        snapshot = stream.readLine()
    finally:
        stream.close()
    return spark.read.parquet(f"{path}/snapshots/{snapshot}")


def upsert(rows: DataFrame, path: str, keys: list[str], replace: bool, retries: int = 20) -> int:
    """Add ``rows`` to the table: of equal keys the incoming (``replace``) or the existing stays; the version this made.

    Raises ValueError if columns or types differ from the table's or a key repeats in ``rows``, and RuntimeError if others were first ``retries`` times.
    """
    spark = rows.sparkSession
    twice = rows.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"keys repeat: {tuple(twice[0])[:-1]}")
    for _ in range(retries):
        have = versions(spark, path)
        new = rows
        if have:
            existing = read(spark, path, have[-1])
            if [(f.name, f.dataType) for f in existing.schema] != [(f.name, f.dataType) for f in rows.schema]:
                raise ValueError(f"columns differ: {existing.schema.simpleString()} and {rows.schema.simpleString()}")
            new = merged(existing, rows, keys, replace)
        snapshot, number = uuid.uuid4().hex, (have[-1] if have else 0) + 1
        new.write.parquet(f"{path}/snapshots/{snapshot}")
        fs, folder = _fs(spark, f"{path}/versions")
        fs.mkdirs(folder)
        if _claim(spark, f"{path}/versions/{number:08d}", snapshot):
            return number
        fs.delete(_fs(spark, f"{path}/snapshots/{snapshot}")[1], True)
    raise RuntimeError(f"{path}: other writers were first {retries} times")
