"""Large text files read by many tasks: a data source that plans byte ranges and cuts them at lines, sentences or headings.

    spark.dataSource.register(RangedText)
    spark.read.format("ranged_text").option("cut", "sentence").load("/data/dump.txt")

A file is divided by a grid of `windowBytes`. The cut that belongs to a grid line is the last border of the window before it; where
that window has none, it is the last start of a character. So a cut depends on its own window alone: tasks need nothing from
each other, a sequential reader gets the same windows, and their contents joined are the file. A task reads the
`rangeBytes` dealt to it and one window before, and holds two windows at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What stands before a cut, and what must follow it
BORDERS = {"line": rb"(?<=\n)", "sentence": rb"(?<=[.!?])(?=[\x20\x09-\x0D])", "heading": rb"(?<=\n)(?=#{1,3}\x20)"}
AHEAD = 4


def opened(uri: str):
    """(file system, path) of a path or URI."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


@dataclass
class ByteRange(InputPartition):
    """Windows first to last - 1 of a file."""

    uri: str
    size: int
    first: int
    last: int


def cut_before(line: int, window: int, held: bytes, at: int, border: re.Pattern) -> int:
    """The cut of the grid line `line`; held are the file's bytes from `at` = line - window on, with a few beyond the line."""
    found = border.match(held)
    if found and found.end():
        return at + found.end()
    end = window
    while end > 1 and end < len(held) and held[end] & 0xC0 == 0x80:
        end -= 1
    return at + end


class RangedReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.window = int(options.get("windowBytes", 1 << 20))
        self.range = max(int(options.get("rangeBytes", 128 << 20)), self.window)
        self.cut = options.get("cut", "line")
        if self.cut not in BORDERS or self.window < 8:
            raise ValueError(f"cut is one of {', '.join(BORDERS)}; windowBytes is 8 or more")

    def partitions(self) -> list[ByteRange]:
        from pyarrow import fs

        files, path = opened(self.path)
        found = files.get_file_info(path)
        if found.type == fs.FileType.Directory:
            infos = files.get_file_info(fs.FileSelector(path, recursive=True))
        elif found.type == fs.FileType.File:
            infos = [found]
        else:
            raise FileNotFoundError(self.path)
        step = self.range // self.window
        return [
            ByteRange(i.path, i.size, k, min(k + step, -(-i.size // self.window)))
            for i in sorted(infos, key=lambda i: i.path) if i.type == fs.FileType.File and i.size and not re.match(r"[._]", i.base_name)
            for k in range(0, -(-i.size // self.window), step)
        ]

    def read(self, part: ByteRange) -> Iterator[tuple]:
        w, size = self.window, part.size
        border = re.compile(rb"(?s).{0,%d}" % w + BORDERS[self.cut])
        files, _ = opened(self.path)
        with files.open_input_file(part.uri) as f:

            def window(k: int) -> bytes:
                f.seek(k * w)
                return f.read(min(w + AHEAD, size - k * w))

            def cut(k: int, before: bytes) -> int:
                return size if k * w >= size else 0 if k == 0 else cut_before(k * w, w, before, (k - 1) * w, border)

            start, left = 0, b""
            if part.first:
                before = window(part.first - 1)
                start = cut(part.first, before)
                left = before[start - (part.first - 1) * w : w]
            for k in range(part.first, part.last):
                held = window(k)
                end = cut(k + 1, held)
                content = left + held[: end - k * w]
                yield part.uri, k, start, end, content.decode("utf-8", "replace")
                left, start = held[end - k * w : w], end


class RangedText(DataSource):
    """Options: path (a file or folder), windowBytes, rangeBytes, cut (line, sentence, heading)."""

    @classmethod
    def name(cls) -> str:
        return "ranged_text"

    def schema(self) -> str:
        return "path string, window long, start_byte long, end_byte long, content string"

    def reader(self, schema) -> RangedReader:
        return RangedReader(self.options)


def read_ranges(spark: SparkSession, path: str, cut: str = "line", window: int = 1 << 20, part: int = 128 << 20) -> DataFrame:
    """(path, window, start_byte, end_byte, content) of the files below a path, a row for each window.

    Empty files and those whose name begins with . or _ give none. Bytes that aren't UTF-8 become replacement characters.
    """
    spark.dataSource.register(RangedText)
    return spark.read.format("ranged_text").option("cut", cut).option("windowBytes", window).option("rangeBytes", part).load(path)
