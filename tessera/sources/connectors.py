"""A snapshot source over the Python Data Source API, and bounded admission of media files."""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Largest admitted bytes by media type; other types are refused.
MEDIA_BYTES = {"txt": 4 << 20, "md": 4 << 20, "pdf": 32 << 20, "png": 16 << 20, "wav": 64 << 20}


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, parts: int):
        self.root, self.parts = root, parts

    def partitions(self) -> list[_Part]:
        found = sorted(os.path.join(d, f) for d, _, files in os.walk(self.root) for f in files if "/.git/" not in d + "/")
        return [_Part(found[i :: self.parts]) for i in range(min(self.parts, len(found)))] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as f:
                data = f.read()
            # the identity of a blob is the hash of its header and content, as content-addressed stores use it
            blob = hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()
            mode = "100755" if os.access(path, os.X_OK) else "100644"
            yield os.path.relpath(path, self.root), blob, mode, len(data), data


class TreeSource(DataSource):
    """``spark.read.format("tessera_tree").option("root", ...)``: a working tree as (path, blob, mode, size, content).

    The root must be on storage that all executors mount; files are dealt to ``parts`` tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "tessera_tree"

    def schema(self) -> str:
        return "path string, blob string, mode string, size bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options["root"], int(self.options.get("parts", "8")))


class _Entries(InputPartition):
    def __init__(self, entries: list[tuple[str, str, str]]):
        self.entries = entries


class _CommitReader(DataSourceReader):
    def __init__(self, root: str, commit: str, parts: int):
        self.root, self.commit, self.parts = root, commit, parts

    def partitions(self) -> list[_Entries]:
        listed = subprocess.run(["git", "-C", self.root, "ls-tree", "-r", "-z", self.commit], capture_output=True, check=True).stdout
        entries = []
        for line in listed.split(b"\0"):
            if line:
                head, path = line.split(b"\t", 1)
                mode, kind, blob = head.decode().split(" ")
                if kind == "blob":
                    entries.append((path.decode("utf-8", "replace"), blob, mode))
        return [_Entries(entries[i :: self.parts]) for i in range(min(self.parts, len(entries)))] or [_Entries([])]

    def read(self, partition: _Entries) -> Iterator[tuple]:
        if not partition.entries:
            return
        with subprocess.Popen(["git", "-C", self.root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for path, blob, mode in partition.entries:
                git.stdin.write(blob.encode() + b"\n")
                git.stdin.flush()
                size = int(git.stdout.readline().split()[2])
                data = git.stdout.read(size)
                git.stdout.read(1)
                yield path, blob, mode, size, data
            git.stdin.close()


class CommitSource(DataSource):
    """``spark.read.format("tessera_commit").option("root", ...).option("commit", ...)``: the files of a pinned commit as (path, blob, mode, size,
    content), whatever the working tree holds. The repository must be on storage that all executors mount; names are listed once, and the
    blobs of each task are read by one process."""

    @classmethod
    def name(cls) -> str:
        return "tessera_commit"

    def schema(self) -> str:
        return "path string, blob string, mode string, size bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _CommitReader(self.options["root"], self.options.get("commit", "HEAD"), int(self.options.get("parts", "8")))


def read_commit(spark: SparkSession, root: str, commit: str = "HEAD", parts: int = 8) -> DataFrame:
    spark.dataSource.register(CommitSource)
    return spark.read.format("tessera_commit").option("root", root).option("commit", commit).option("parts", parts).load()


def read_tree(spark: SparkSession, root: str, parts: int = 8) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("tessera_tree").option("root", root).option("parts", parts).load()


# How the content of a media type begins, in hex.
SIGNATURES = {"pdf": "^255044462D", "png": "^89504E470D0A1A0A", "wav": "^52494646.{8}57415645"}


def admit_media(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, size, admitted, reason): media files by type, size and content: signatures of PDF, PNG and WAV files, UTF-8 of texts. Only the
    contents of files of an admitted type and size are looked at; Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    most = F.element_at(F.create_map(*[F.lit(v) for kv in MEDIA_BYTES.items() for v in kv]), kind)
    begins = F.hex(F.substring("content", 1, 12))
    signed = F.lit(True)
    for name, rx in SIGNATURES.items():
        signed = F.when(kind == name, begins.rlike(rx)).otherwise(signed)
    whole = F.when(kind.isin("txt", "md"), F.is_valid_utf8(F.col("content").cast("string"))).otherwise(signed)
    reason = F.when(most.isNull(), "type").when(F.col("length") > most, "size").when(~whole, "content")
    return files.select("path", kind.alias("kind"), F.col("length").alias("size"), reason.isNull().alias("admitted"), reason.alias("reason"))
