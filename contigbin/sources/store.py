"""Files by way of pyarrow (for Python readers and writers on executors), folders for intermediate tables, and writers that change a folder at once."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def open_store(path: str):
    """The file system of a path and the path on it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


_written: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone by now
            return


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share: that of checkpoints, or else the warehouse. It is removed when the driver's process ends."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/contigbin-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


class Tables:
    """Tables of a loop in the shared folder, in place of checkpoints: a checkpoint keeps the estimate of its size, which every join multiplies, so that
    after some rounds it is a number of millions of digits on the driver. What is read from files has the size of its files. All of them go with ``drop``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, []

    def keep(self, rows: DataFrame, **options) -> DataFrame:
        """``rows``, written (with the writer's ``options``) and read again."""
        self.paths.append(scratch(self.spark, self.label))
        rows.write.options(**options).parquet(self.paths[-1])
        return self.spark.read.schema(rows.schema).parquet(self.paths[-1])

    def drop(self, but: int = 0) -> None:
        """Removes all tables but the last ``but``; nothing may read them any more."""
        gone = self.paths[: len(self.paths) - but]
        self.paths = self.paths[len(gone) :]
        for path in gone:
            _remove(self.spark, path)
            _written.remove((self.spark, path))


class GroupFileSource(DataSource):
    """``df.write.format("group_files").option("path", ..)`` for columns (name, value): a file ``name`` + suffix (option; .fa) for each name, one line a value (SNK-2).

    The rows of a name must stand together in one partition. Tasks write to a folder beside the
    target; on commit that folder takes the target's place as a whole, and the old files go then and not before. A task
    gives a file its name when it is complete, so what a killed task leaves is never taken for one.
    """

    @classmethod
    def name(cls):
        return "group_files"

    def schema(self):
        return "name string, value string"

    def writer(self, schema, overwrite):
        return _GroupWriter(self.options)


class _GroupWriter(DataSourceWriter):
    def __init__(self, options):
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", ".fa")
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def write(self, rows):
        store, folder = open_store(self.staging)
        store.create_dir(folder)
        attempt, done, name, out = uuid.uuid4().hex, set(), None, None

        def close():
            if out is not None:
                out.close()
                store.move(f"{folder}/.{name}.{attempt}", f"{folder}/{name}{self.suffix}")
                done.add(name)

        for row in rows:
            if row[0] != name or out is None:
                close()
                name = row[0]
                if name in done:
                    raise ValueError(f"the rows of {name} are not together")
                out = store.open_output_stream(f"{folder}/.{name}.{attempt}")
            out.write(f"{row[1]}\n".encode())
        close()
        return WriterCommitMessage()

    def commit(self, messages):
        from pyarrow import fs

        store, staged = open_store(self.staging)
        target = open_store(self.path)[1]
        store.create_dir(staged)
        for left in store.get_file_info(fs.FileSelector(staged)):
            if left.base_name.startswith("."):
                store.delete_file(left.path)
        old = f"{target}.old-{uuid.uuid4().hex}"
        there = store.get_file_info(target).type != fs.FileType.NotFound
        if there:
            store.move(target, old)
        store.move(staged, target)
        if there:
            store.delete_dir(old)

    def abort(self, messages):
        from pyarrow import fs

        store, staged = open_store(self.staging)
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)
