"""Folders of source trees and bibliographies as a data source: a partition is one tree, and what is left out is never listed.

    spark.dataSource.register(TreeSource)
    spark.read.format("source_tree").option("path", root).option("levels", 2).load()

The driver lists the levels of folders that name a tree (owner/repository, or a paper version) and no more; each tree is
listed where it is read. Comparisons of the name with constants choose the trees that become partitions.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .landing import MOST_BYTES, SKIPPED

#: Bytes of texts in a batch, about; a larger file is a batch of its own.
BATCH = 8 << 20


@dataclass
class Tree(InputPartition):
    """One tree: its folder, and its name below the root."""

    folder: str
    name: str


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


def _listed(store, folder: str):
    """Folders and files right below a folder, in order of names."""
    from pyarrow import fs

    found = sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda i: i.base_name)
    return [i for i in found if i.type == fs.FileType.Directory], [i for i in found if i.type == fs.FileType.File]


class TreeReader(DataSourceReader):
    def __init__(self, options, schema, first: str, suffixes: tuple[str, ...] | None = None):
        self.uri, self.first, self.schema = options["path"], first, schema
        self.levels, self.most = int(options.get("levels", 1)), int(options.get("maxBytes", MOST_BYTES))
        self.skipped = set(filter(None, options.get("skip", ",".join(SKIPPED)).split(",")))
        own = options.get("suffixes")
        self.suffixes = tuple(filter(None, own.split(","))) if own else suffixes
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == (self.first,):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield f

    def partitions(self) -> list[Tree]:
        store, root = _filesystem(self.uri)
        level = [(root.rstrip("/"), "")]
        for _ in range(self.levels):
            level = [(d.path, f"{name}/{d.base_name}".lstrip("/")) for folder, name in level for d in _listed(store, folder)[0] if d.base_name not in self.skipped]
        return [Tree(folder, name) for folder, name in level if self.names is None or name in self.names]

    def _files(self, store, folder: str):
        folders, files = _listed(store, folder)
        for f in files:
            if f.size <= self.most and (self.suffixes is None or f.base_name.endswith(self.suffixes)):
                yield f
        for d in folders:
            if d.base_name not in self.skipped:
                yield from self._files(store, d.path)

    def row(self, tree: Tree, path: str, size: int, text: str) -> tuple:
        return tree.name, path, size, text

    def read(self, partition: Tree):
        if partition is None:  # no tree at all
            return
        store, root = _filesystem(self.uri)
        rows, total = [], 0
        for f in self._files(store, partition.folder):
            with store.open_input_stream(f.path) as data:
                text = data.read().decode("utf-8", "replace")
            rows.append(self.row(partition, os.path.relpath(f.path, partition.folder), f.size, text))
            total += f.size
            if total >= BATCH:
                yield self._batch(rows)
                rows, total = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64() if f.dataType.typeName() == "long" else pa.string() for f in self.schema]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=self.schema.names)


class TreeSource(DataSource):
    """Files (repo, path, size, text) of the trees under a path.

    Options: path; levels of folders that name a tree (1); skip, names of folders that are left out; maxBytes of a file;
    suffixes of files, all if not given. Bytes that are no UTF-8 become U+FFFD.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "repo string, path string, size long, text string"

    def reader(self, schema):
        return TreeReader(self.options, schema, "repo")


class BibliographyReader(TreeReader):
    def row(self, tree: Tree, path: str, size: int, text: str) -> tuple:
        return tree.name, path, path.rsplit(".", 1)[-1], text


class BibliographySource(DataSource):
    """Bibliographies (paper_version, file, kind, text) of the papers under a path, one folder for each; options as of trees."""

    @classmethod
    def name(cls) -> str:
        return "bibliographies"

    def schema(self) -> str:
        return "paper_version string, file string, kind string, text string"

    def reader(self, schema):
        return BibliographyReader(self.options, schema, "paper_version", (".bbl", ".bib"))


def _read(spark: SparkSession, source: type[DataSource], root: str, options: dict) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(path=root, **options).load()


def code_trees(spark: SparkSession, root: str, levels: int = 1, **options) -> DataFrame:
    """Files (repo, path, size, text) of every source tree under a folder."""
    return _read(spark, TreeSource, root, {"levels": levels, **options})


def bibliography_files(spark: SparkSession, root: str, **options) -> DataFrame:
    """Bibliographies under root/<paper version>/ as (paper_version, file, kind, text), for scan.bibliography."""
    return _read(spark, BibliographySource, root, options)
