"""Text files: standard input, single files, lists, and directory trees as a data source.

The built-in binaryFile source leaves out dot files, files that begin with an underscore and empty ones, and has
times in milliseconds only; all of those matter here, so the tree is listed by this source's own reader, on the
driver. Contents are read by the executors, a bounded number of bytes for each partition.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ignore import IgnoreRules

# Extensions of binary files.
BINARY_EXTENSIONS = frozenset(
    ".png .jpg .jpeg .gif .bmp .ico .webp .tiff .tif .pdf .doc .docx .xls .xlsx .ppt .pptx .zip .tar .gz .bz2 .7z .rar .exe .dll .so "
    ".dylib .app .bin .mp3 .mp4 .avi .mov .wmv .flv .wav .flac .ogg .ttf .otf .woff .woff2 .pyc .class .o .a .tiktoken".split()
)
SNIFFED = 512
STDIN = "-"
SCHEMA = "path string, relative_path string, size long, mtime_ns long, content binary"
PARTITION_BYTES = 64 << 20


class BinaryFile(ValueError):
    """A single file that is binary."""


def extension(path: str) -> str:
    """From the last dot of the last element on, lower-cased; a name that is all extension counts."""
    name = path.rsplit("/", 1)[-1]
    return name[name.rfind(".") :].lower() if "." in name else ""


def is_binary(path: str) -> bool:
    """By extension, else by a NUL among the first 512 bytes; the extension saves opening the file."""
    if extension(path) in BINARY_EXTENSIONS:
        return True
    with open(path, "rb") as f:
        return b"\0" in f.read(SNIFFED)


def binary_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*sorted(BINARY_EXTENSIONS))


def binary_content(content: Column) -> Column:
    """Whether a NUL is among the first 512 bytes of a binary column."""
    return F.locate("\0", F.substring(content, 1, SNIFFED).cast("string")) > 0


def binary(path: Column, content: Column) -> Column:
    return binary_extension(path) | binary_content(content)


@dataclass
class Walk:
    files: list[str] = field(default_factory=list)
    total_files: int = 0
    skipped_binary: int = 0
    skipped_ignore: int = 0


def walk(root: str, sniff: bool = True) -> Walk:
    """Text files below root in lexical order. .git folders are left out at any depth; only root's own ignore file counts.

    Without ``sniff`` no file is opened: binary ones are told by their extension only, and the reader has to sniff.

    A file that can't be opened counts as binary; so does a link to a folder, which isn't followed.
    """
    rules_path = os.path.join(root, ".gitignore")
    rules = IgnoreRules("")
    if os.path.lexists(rules_path):
        with open(rules_path, encoding="utf-8", errors="surrogateescape") as f:
            rules = IgnoreRules(f.read())
    out = Walk()

    def visit(folder: str) -> None:
        for entry in sorted(os.scandir(folder), key=lambda e: os.fsencode(e.name)):
            if entry.is_dir(follow_symlinks=False):
                if entry.name != ".git":
                    visit(entry.path)
                continue
            out.total_files += 1
            if rules.ignored(os.path.relpath(entry.path, root).replace(os.sep, "/")):
                out.skipped_ignore += 1
                continue
            try:
                skip = is_binary(entry.path) if sniff else extension(entry.path) in BINARY_EXTENSIONS or entry.is_symlink() and not os.path.isfile(entry.path)
            except OSError:
                skip = True
            if skip:
                out.skipped_binary += 1
            else:
                out.files.append(entry.path)

    visit(root)
    return out


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, str, int, int]]


class _TreeReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = options.get("path")
        self.listed = options.get("files")
        self.contents = options.get("contents", "true").lower() == "true"
        self.sniff = options.get("sniff", "false").lower() == "true"
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        files = json.loads(self.listed) if self.listed is not None else walk(self.root).files
        rows, size = [[]], 0
        for path in files:
            info = os.stat(path)
            if rows[-1] and size + info.st_size > self.bytes:
                rows.append([])
                size = 0
            relative = os.path.relpath(path, self.root) if self.root else path
            rows[-1].append((path, relative.replace(os.sep, "/"), info.st_size, info.st_mtime_ns))
            size += info.st_size
        return [_Files(r) for r in rows]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path, relative, size, mtime in partition.files:
            content = None
            if self.contents or self.sniff:
                try:
                    with open(path, "rb") as f:
                        content = f.read(SNIFFED)
                        if self.sniff and b"\0" in content:
                            continue
                        content = content + f.read() if self.contents else None
                except OSError:
                    if self.sniff:
                        continue
                    raise
                size = len(content) if self.contents else size
            yield path, relative, size, mtime, content


class TextTree(DataSource):
    """Format text_tree. Options: path (a folder); files (a JSON list of paths) instead of a walk of it; contents; sniff (leave
    out files that are binary or can't be opened, on the executors); partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "text_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def directory(spark: SparkSession, root: str, contents: bool = True) -> DataFrame:
    """Text files of a tree; FileNotFoundError if there are none."""
    found = walk(root).files
    if not found:
        raise FileNotFoundError(f"no text files in {root}")
    return listed_files(spark, root, found, contents)


def listed_files(spark: SparkSession, root: str, paths: list[str], contents: bool = True, sniff: bool = False) -> DataFrame:
    """The files at ``paths`` as parts of the tree at root; no other file is opened."""
    spark.dataSource.register(TextTree)
    return spark.read.format("text_tree").option("path", root).option("files", json.dumps(paths)).option("contents", str(contents)).option("sniff", str(sniff)).load()


def file_list(spark: SparkSession, paths: list[str], contents: bool = True) -> DataFrame:
    """The files named, binary or not; an empty list is an error."""
    if not paths:
        raise ValueError("no files")
    spark.dataSource.register(TextTree)
    return spark.read.format("text_tree").option("files", json.dumps(paths)).option("contents", str(contents)).load()


def single_file(spark: SparkSession, path: str, reject_binary: bool = True) -> DataFrame:
    if reject_binary and is_binary(path):
        raise BinaryFile(path)
    return file_list(spark, [path])


def standard_input(spark: SparkSession, stream=None) -> DataFrame:
    """One row of all of standard input, under the path -."""
    data = (stream or sys.stdin.buffer).read()
    return spark.createDataFrame([(STDIN, STDIN, len(data), 0, bytearray(data))], SCHEMA)


def as_text(content: Column) -> Column:
    """Bytes as a string column, kept as they are; statistics see the raw bytes."""
    return content.cast("string")


def canonical_root(path: str) -> str:
    return os.path.realpath(path)


def root_name(path: str) -> str:
    """Name of a root's state: the hash of its canonical path."""
    return hashlib.sha256(canonical_root(path).encode()).hexdigest()
