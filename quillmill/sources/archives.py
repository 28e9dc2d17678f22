"""A data source of the entries of ZIP archives: spark.read.format("zip_entries").load(path).

path is an archive or a folder of them, in any store that pyarrow knows. Each partition is a range of one archive's entries (as
its directory lists them): a task opens the archive, reads the directory and the bytes of its own entries, and unpacks them one
at a time; nothing is written to a disk. Options: suffix (of entry names) and per_partition. Filters on the name (equal, begins
with) are pushed to the tasks where Spark's setting for that is on, so other entries' bytes aren't read.

Defined results: folders' own entries are left out, empty entries have empty content. An archive without entries gives no rows.
A file that is no archive is an error that names it.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

PER_PARTITION = 500


def _opened(uri: str):
    """(file system, path) of an address; plain paths are local."""
    import pyarrow.fs as pafs

    if "://" not in uri:
        uri = f"file://{os.path.abspath(uri.removeprefix('file:'))}"
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def archives_in(uri: str) -> list[str]:
    """The archives of a path, by name; one address each, without their file system."""
    import pyarrow.fs as pafs

    fs, path = _opened(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(".zip"))


class _File:
    """A file of Arrow's as zipfile knows files: a place that there isn't is an OSError."""

    def __init__(self, held):
        self.held = held

    def seek(self, *at):
        try:
            return self.held.seek(*at)
        except ValueError as e:
            raise OSError(str(e)) from e

    def __getattr__(self, name):
        return getattr(self.held, name)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.held.close()


@dataclass
class Entries(InputPartition):
    archive: str
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffix, self.per = options.get("suffix", ""), int(options.get("per_partition", PER_PARTITION))
        self.names: list[str] = []
        self.starts: list[str] = []

    def _infos(self, held: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
        return [i for i in held.infolist() if not i.is_dir() and i.filename.endswith(self.suffix) and all(i.filename == n for n in self.names) and all(i.filename.startswith(s) for s in self.starts)]

    def _archive(self, path: str):
        fs, _ = _opened(self.path)
        return _File(fs.open_input_file(path))

    def partitions(self) -> list[Entries]:
        out = []
        for path in archives_in(self.path):
            with self._archive(path) as f:
                try:
                    with zipfile.ZipFile(f) as held:
                        n = len(self._infos(held))
                except zipfile.BadZipFile as e:
                    raise ValueError(f"{path} is no archive: {e}") from e
            out += [Entries(path, k, min(n, k + self.per)) for k in range(0, n, self.per)]
        return out

    def read(self, partition: Entries) -> Iterator[tuple]:
        with self._archive(partition.archive) as f, zipfile.ZipFile(f) as held:
            for i in self._infos(held)[partition.first : partition.last]:
                yield partition.archive, i.filename, i.file_size, held.read(i)


class _PushedReader(_Reader):
    """For sessions that push filters to Python data sources; others refuse a reader that takes some."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.names.append(f.value)
            elif isinstance(f, StringStartsWith) and f.attribute == ("name",):
                self.starts.append(f.value)
            else:
                yield f


class ZipEntries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return "archive string, name string, size long, content binary"

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (_PushedReader if options.get("pushed") == "true" else _Reader)(options)


def zip_entries(spark: SparkSession, path: str, suffix: str = "", per_partition: int = PER_PARTITION) -> DataFrame:
    """(archive, name, size, content) of the entries whose names end in suffix."""
    spark.dataSource.register(ZipEntries)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("zip_entries").option("suffix", suffix).option("per_partition", per_partition).option("pushed", pushed).load(path)


def biorxiv_archive(spark: SparkSession, path: str) -> DataFrame:
    """A preprint server's records from its archives of article XML, with the archive and name of each."""
    from .landed import biorxiv

    pages = zip_entries(spark, path, ".xml").select("archive", "name", F.decode("content", "UTF-8").alias("html"))
    return biorxiv(pages).drop("html")
