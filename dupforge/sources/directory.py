"""A Spark data source for directories: a row for each regular file and one for each warning. It lists; it reads and changes nothing.

    spark.dataSource.register(DirectorySource)
    spark.read.format("directory").option("roots", json.dumps([...])).load()

Spark's own binaryFile source reads contents, drops names that begin with _ and has no change time. Roots have to be mounted on
every executor. Each root's subfolders are read by tasks of their own.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from dupforge.functions import fixed
from dupforge.operators.filters import ScanOptions

OWN_PREFIX = ".Dupforge_"
SCHEMA = "path string, root string, root_pos int, folder string, name string, size long, mtime double, mtime_ns long, ctime_ns long, attributes int, status string"


class DirectorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "directory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DirectoryReader:
        return DirectoryReader(self.options)


class DirectoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [os.path.abspath(x) for x in json.loads(options["roots"])]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.skip_hidden = options.get("skiphidden", options.get("skipHidden", "true")).lower() == "true"
        self.excluded = [os.path.normcase(os.path.abspath(x)) for x in json.loads(options.get("excluded", "[]"))]

    def partitions(self) -> list[InputPartition]:
        """Each root's own files, and each of its subfolders."""
        out = []
        for k, root in enumerate(self.roots):
            out.append(InputPartition((k, root, root, False)))
            if self.recursive:
                try:
                    with os.scandir(root) as found:
                        out += [InputPartition((k, root, x.path, True)) for x in sorted(found, key=lambda x: x.name) if x.is_dir(follow_symlinks=False)]
                except OSError:
                    pass  # the root's own task tells
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        k, root, top, whole = partition.value
        here = lambda path, status: (path, root, k, os.path.dirname(path), os.path.basename(path), None, None, None, None, None, status)
        if self._out(top):
            yield here(top, "excluded_directory")
            return
        if whole and (skipped := self._skip(top)):
            if skipped != "own":
                yield here(top, skipped)
            return
        stack = [top]
        while stack:
            folder = stack.pop()
            try:
                with os.scandir(folder) as found:
                    entries = sorted(found, key=lambda x: x.name)
            except FileNotFoundError:
                yield here(folder, "missing")
                continue
            except OSError as e:
                yield here(folder, f"error: {e.strerror}")
                continue
            for x in entries:
                try:
                    s = x.stat(follow_symlinks=False)
                except OSError as e:
                    yield here(x.path, f"error: {e.strerror}")
                    continue
                attributes = getattr(s, "st_file_attributes", 0)
                if stat.S_ISLNK(s.st_mode) or attributes & fixed.REPARSE:
                    continue
                if stat.S_ISDIR(s.st_mode):
                    if not whole:
                        continue
                    if self._out(x.path):
                        yield here(x.path, "excluded_directory")
                    elif skipped := self._skip(x.path, attributes):
                        if skipped != "own":
                            yield here(x.path, skipped)
                    else:
                        stack.append(x.path)
                elif stat.S_ISREG(s.st_mode):
                    yield (x.path, root, k, folder, x.name, s.st_size, s.st_mtime, s.st_mtime_ns, s.st_ctime_ns, attributes, "file")

    def _out(self, path: str) -> bool:
        path = os.path.normcase(path)
        return any(path == e or path.startswith(e.rstrip(os.sep) + os.sep) for e in self.excluded)

    def _skip(self, path: str, attributes: int = 0) -> str:
        name = os.path.basename(path)
        if name.startswith(OWN_PREFIX):
            return "own"
        return "hidden_directory" if self.skip_hidden and (name.startswith(".") or attributes & (fixed.HIDDEN | fixed.SYSTEM)) else ""


def scan(spark: SparkSession, roots: list[str], options: ScanOptions | None = None) -> DataFrame:
    """Everything that a scan meets, files once each under the first root that reaches them; the filters are dupforge.operators.filters."""
    options = (options or ScanOptions()).checked()
    spark.dataSource.register(DirectorySource)
    reader = spark.read.format("directory").option("roots", json.dumps(roots)).option("recursive", str(options.recursive)).option("skipHidden", str(options.skip_hidden)).option("excluded", json.dumps(list(options.excluded)))
    return first_root(reader.load())


def first_root(files: DataFrame) -> DataFrame:
    """Of rows with one path, the one of the first root."""
    return files.withColumn("_n", F.row_number().over(W.partitionBy("path").orderBy("root_pos"))).filter("_n = 1").drop("_n")
