"""Spark data sources for workbooks and paged files: ``spark.read.format("workbook")`` and ``spark.read.format("paged_lines")``.

``path`` is a file or a folder, on any file system that pyarrow opens by its address and that driver and executors both see. A file is a
partition, or several: one for each of the named ``sheets``, or ``parts`` ranges of pages. Files are opened where they are read, never by the
driver. What cannot be read is a row with its ``problem``; with ``mode`` FAILFAST it is an error.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vellumgrid.sources import files, paged

CELLS = "path string, sheet string, row int, col string, kind string, value string, problem string"


def _listed(address: str, suffix: str) -> list[str]:
    """Addresses of a file, or of a folder's files that end with ``suffix``."""
    store, root = pyarrow.fs.FileSystem.from_uri(address)
    info = store.get_file_info(root)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(address)
    head = address[: len(address) - len(root)] if address.endswith(root) else ""
    if info.type == pyarrow.fs.FileType.File:
        return [address]
    found = store.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
    return sorted(head + f.path for f in found if f.type == pyarrow.fs.FileType.File and f.path.lower().endswith(suffix.lower()))


def _content(address: str) -> bytes:
    store, path = pyarrow.fs.FileSystem.from_uri(address)
    with store.open_input_stream(path) as stream:
        return stream.read()


@dataclass
class Piece(InputPartition):
    path: str
    sheet: str | None = None
    part: int = 0
    parts: int = 1


class _Reader(DataSourceReader):
    suffix = ""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.options, self.strict = options, options.get("mode", "PERMISSIVE").upper() == "FAILFAST"

    def paths(self) -> list[str]:
        return _listed(self.options["path"], self.options.get("suffix", self.suffix))

    def told(self, path: str, problem: str) -> str:
        if self.strict:
            raise ValueError(f"{path}: {problem}")
        return problem


class _Cells(_Reader):
    suffix = ".xlsx"

    def partitions(self) -> list[Piece]:
        sheets = [s.strip() for s in self.options.get("sheets", "").split(",") if s.strip()]
        return [Piece(p, s) for p in self.paths() for s in (sheets or [None])]

    def read(self, piece: Piece) -> Iterator[tuple]:
        try:
            for sheet, row, col, kind, value in files.sheet_cells(_content(piece.path), piece.sheet):
                yield piece.path, sheet, row, col, kind, value, None
        except Exception as error:  # noqa: BLE001  a broken file is a row, or fails below
            yield piece.path, piece.sheet, None, None, None, None, self.told(piece.path, f"{type(error).__name__}: {error}")


class WorkbookSource(DataSource):
    """Cells of workbooks with their own row numbers; ``sheets``: names, parted by commas, of the sheets to read (a workbook without one is a problem)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _Cells(self.options)


class _Lines(_Reader):
    def partitions(self) -> list[Piece]:
        parts = int(self.options.get("parts", 1))
        return [Piece(p, None, i, parts) for p in self.paths() for i in range(parts)]

    def read(self, piece: Piece) -> Iterator[tuple]:
        module, _, attribute = self.options["reader"].partition(":")
        reader = getattr(importlib.import_module(module), attribute)()
        content = _content(piece.path)
        for page, read, problem in paged.read(reader, content, float(self.options.get("seconds", paged.SECONDS)), piece.part, piece.parts):
            if problem is not None:
                yield (piece.path, page, *[None] * 11, self.told(piece.path, problem))
            else:
                yield from files.line_rows(piece.path, page, *read)


class PagedSource(DataSource):
    """Line boxes of paged files; ``reader``: module:class of a paged.Reader, ``seconds``: limit of a page, ``parts``: partitions of a file."""

    @classmethod
    def name(cls) -> str:
        return "paged_lines"

    def schema(self) -> str:
        return files.LINE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if not self.options.get("reader"):
            raise ValueError("a reader is needed, as module:class")
        return _Lines(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
    spark.dataSource.register(PagedSource)
