"""Positioned words as a Spark data source. The parser is given by the user: none ships with the engine."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WORDS = "file string, page int, text string, x0 double, y0 double, x1 double, y1 double, conf double"


class WordSource(DataSource):
    """spark.read.format("positioned_words").option("parser", "module:function").load(paths split by commas).

    The parser takes a path and yields (page, text, x0, y0, x1, y1, conf or None); each file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "positioned_words"

    def schema(self) -> str:
        return WORDS

    def reader(self, schema) -> DataSourceReader:
        if "parser" not in self.options:
            raise ValueError("no page parser is installed: name one in the option 'parser', as module:function")
        return _Reader(self.options["parser"], self.options.get("path", ""))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, parser: str, paths: str):
        self.parser, self.paths = parser, [p for p in paths.split(",") if p]

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition) -> Iterator[tuple]:
        module, name = self.parser.split(":")
        for page, text, x0, y0, x1, y1, conf in getattr(importlib.import_module(module), name)(partition.path):
            yield partition.path, page, text, x0, y0, x1, y1, conf


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WordSource)
