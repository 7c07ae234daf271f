"""Readers and writers: file trees, JSON lines with alias keys, transcripts, symbol indexes, JDBC, versioned tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_FILE_BYTES = 4 << 20
CODE = ("go", "py", "ts", "tsx", "js", "rs", "java", "md", "txt", "json", "yaml", "yml", "toml", "sql", "sh")
#: Alias keys of a document row, the first present one counts.
ALIASES = {"id": ("id", "document_id", "doc_id"), "text": ("text", "body", "content"), "title": ("title", "name"), "uri": ("source_uri", "uri", "path")}


def list_files(spark: SparkSession, root: str, extensions: Sequence[str] = CODE, ignore: Sequence[str] = ()) -> DataFrame:
    """(path, size, modified) of a tree; the content column is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return _wanted(files, extensions, ignore).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def crawl(spark: SparkSession, root: str, extensions: Sequence[str] = CODE, ignore: Sequence[str] = ()) -> DataFrame:
    """(path, size, modified, text) of the files of at most ``MAX_FILE_BYTES``; size and name filters run before contents are read.
    ``left_out`` tells which files these filters left out, and why."""
    files = _wanted(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), extensions, ignore)
    files = files.where(F.col("length") <= MAX_FILE_BYTES)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))


def left_out(spark: SparkSession, root: str, extensions: Sequence[str] = CODE, ignore: Sequence[str] = ()) -> DataFrame:
    """(path, size, reason) of the files of a tree that ``crawl`` does not read: extension, ignored or too_large, the first that holds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    known = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions)
    reason = F.when(~known, "extension").when(ignored(F.col("path"), ignore), "ignored").when(F.col("length") > MAX_FILE_BYTES, "too_large")
    return files.select("path", F.col("length").alias("size"), reason.alias("reason")).where(F.col("reason").isNotNull())


def _wanted(files: DataFrame, extensions: Sequence[str], ignore: Sequence[str]) -> DataFrame:
    files = files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions))
    return files.where(~ignored(F.col("path"), ignore)) if ignore else files


def ignored(path: Column, rules: Sequence[str]) -> Column:
    """Ignore-file rules, the last that matches counts; a leading ! takes a path back in."""
    import re

    out = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        keep, body = rule.startswith("!"), rule.lstrip("!")
        folder, anchored = body.endswith("/"), "/" in body.rstrip("/")
        rx = "".join(".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else re.escape(p) for p in re.split(r"(\*\*|\*|\?)", body.strip("/")))
        rx = ("(^|/)" if not anchored or not body.startswith("/") else "/") + rx + ("/" if folder else "(/|$)")
        out = F.when(path.rlike(rx), not keep).otherwise(out)
    return out


def aliased(raw: DataFrame) -> DataFrame:
    """(id, text, title, uri) strings from whichever alias columns are there."""
    have = set(raw.columns)
    cols = [F.coalesce(*[F.col(a).cast("string") for a in names if a in have], F.lit(None).cast("string")).alias(k) for k, names in ALIASES.items()]
    return raw.select(*cols)


def read_documents(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Documents of JSON-lines files; a fixed schema of all alias keys, so no inference pass. Strict reading fails on a broken
    line, else broken lines and rows without id or text are dropped."""
    schema = T.StructType([T.StructField(a, T.StringType()) for names in ALIASES.values() for a in names])
    raw = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    rows = aliased(raw)
    return rows if strict else rows.where(F.col("id").isNotNull() & F.col("text").isNotNull())


def validated_documents(raw: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """(id, text, title, uri, problem) of imported rows: missing_id, missing_text, too_large or repeated_id (all but the first by text), null where
    a row is good. An import takes the good rows or, if it must be whole, none."""
    d = aliased(raw)
    w = Window.partitionBy("id").orderBy("text")
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    problem = F.when(blank("id"), "missing_id").when(blank("text"), "missing_text").when(F.octet_length("text") > most_bytes, "too_large").when(F.row_number().over(w) > 1, "repeated_id")
    return d.withColumn("problem", problem)


_SEGMENT = "array<struct<start_millis:bigint,end_millis:bigint,text:string,speaker_label:string>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(meeting_id, title, started_at_ms, position, segment fields): one row per segment of JSON transcripts."""
    raw = spark.read.schema(f"meeting_id string, title string, started_at_ms bigint, ended_at_ms bigint, segments {_SEGMENT}").json(path)
    return raw.select("meeting_id", "title", "started_at_ms", F.posexplode("segments").alias("position", "s")).select("meeting_id", "title", "started_at_ms", "position", "s.*")


def decode_symbol_index(rows: DataFrame, json_col: str) -> DataFrame:
    """(path, language, symbol, kind, line, column) of symbol-index JSON documents; roles with bit 1 are definitions."""
    schema = "struct<documents:array<struct<relative_path:string,language:string,occurrences:array<struct<range:array<int>,symbol:string,symbol_roles:int>>>>>"
    d = rows.select(F.explode(F.from_json(json_col, schema)["documents"]).alias("d")).select("d.relative_path", "d.language", F.explode("d.occurrences").alias("o"))
    kind = F.when(F.col("o.symbol_roles").bitwiseAND(1) > 0, "definition").when(F.col("o.symbol_roles").bitwiseAND(2) > 0, "import").otherwise("reference")
    return d.select(F.col("relative_path").alias("path"), "language", F.col("o.symbol").alias("symbol"), kind.alias("kind"), F.col("o.range")[0].alias("line"), F.col("o.range")[1].alias("column"))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table in ``parts`` concurrent ranges of a numeric key."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


class VersionedTable:
    """Parquet versions in one folder and a pointer table to the current one; a reader sees a whole version or none.

    Publishing writes the version first and creates the pointer of its generation after, so a failure between leaves the old version
    current. A pointer file is created only where none is: of two publishers of one generation one wins and the other is told.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> tuple[int, str] | None:
        """(generation, version) of the newest pointer file; no job runs."""
        folder, fs = self._path("pointers")
        if not fs.exists(folder):
            return None
        found = sorted((f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().startswith("g-") and f.getLen() > 0), reverse=True)
        if not found:
            return None
        place, fs = self._path(f"pointers/{found[0]}")
        stream = fs.open(place)
        try:
            row = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return row["generation"], row["version"]

    def load(self) -> DataFrame | None:
        c = self.current()
        return self.spark.read.parquet(f"{self.root}/{c[1]}") if c else None

    def publish(self, df: DataFrame, partition_by: Sequence[str] = ()) -> int:
        c = self.current()
        generation, version = (c[0] + 1 if c else 1), f"v-{uuid.uuid4().hex}"
        w = df.write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.root}/{version}")
        place, fs = self._path(f"pointers/g-{generation:012d}.json")
        try:
            out = fs.create(place, False)  # not over an existing one
        except Exception as e:
            raise RuntimeError(f"generation {generation} was published by another writer") from e
        try:
            out.write(bytearray(f'{{"generation": {generation}, "version": "{version}"}}\n'.encode()))
        finally:
            out.close()
        return generation

    def upsert(self, rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> int:
        """Latest row of each key over the current version and the new rows."""
        from tessera.operators.relations import latest_wins

        old = self.load()
        return self.publish(latest_wins(rows if old is None else old.unionByName(rows), keys, order))


class DeltaTable:
    """A keyed table to which batches are appended as they are: a read takes the latest row of each key over the current version and the deltas
    after it. ``compact`` makes a new version of that; until it is published, readers see the old one with its deltas."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[Column]):
        self.spark, self.base, self.keys, self.order = spark, VersionedTable(spark, root), keys, order

    def _deltas(self) -> str:
        c = self.base.current()
        return f"{self.base.root}/deltas/after-{c[0] if c else 0}"

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self._deltas())

    def load(self) -> DataFrame | None:
        from tessera.operators.relations import latest_wins

        path, fs = self.base._path(self._deltas()[len(self.base.root) + 1 :])
        has = fs.exists(path)
        parts = [x for x in (self.base.load(), self.spark.read.parquet(self._deltas()) if has else None) if x is not None]
        return latest_wins(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), self.keys, self.order) if parts else None

    def compact(self) -> int:
        return self.base.publish(self.load())


def open_or_refresh(stored: VersionedTable, manifest: DataFrame | None, disk: DataFrame, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(table, refreshed): the stored version where all stamps (path, size, mtime) of its manifest are those on disk, else a new one."""
    from tessera.operators.relations import freshness

    if manifest is not None and (old := stored.load()) is not None and freshness(manifest, disk).first()["fresh"]:
        return old, False
    stored.publish(build())
    return stored.load(), True


def save_postings(post: DataFrame, root: str, buckets: int = 64, parts: int | None = None) -> int:
    """Publish postings in buckets by token, so a query's tokens read a few buckets only; returns the generation. Each task writes its own files of
    the buckets, so nothing is shuffled; there are at most ``parts`` tasks (else four for each core), which bounds the files. ``load_postings`` adds up
    what several rows have of a document and token."""
    t = VersionedTable(post.sparkSession, root)
    parts = parts or 4 * post.sparkSession.sparkContext.defaultParallelism
    generation = t.publish(post.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")).coalesce(parts), ["bucket"])
    checksum(t.load(), sorted(post.columns)).write.parquet(f"{root}/sums/g-{generation}")
    return generation


def verify_postings(spark: SparkSession, root: str) -> bool:
    """Whether the saved postings still have the rows and the checksum they were saved with."""
    t = VersionedTable(spark, root)
    c = t.current()
    if c is None:
        return False
    rows = t.load()
    want = spark.read.parquet(f"{root}/sums/g-{c[0]}").first()
    return tuple(checksum(rows, sorted(x for x in rows.columns if x != "bucket")).first()) == tuple(want)


def load_postings(spark: SparkSession, root: str, tokens: Sequence[str] | None = None, buckets: int = 64) -> DataFrame:
    post = VersionedTable(spark, root).load()
    if tokens is not None:
        # literals: Spark folds the hashes into partition values while it plans, so no job runs for them
        wanted = [F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in tokens]
        post = post.where(F.col("bucket").isin(*wanted) & F.col("token").isin(*tokens))
    return post.groupBy(*[c for c in post.columns if c not in ("bucket", "tf")]).agg(F.sum("tf").alias("tf"))


def checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rows, checksum): order-free checksum of rows, the sum of their hashes of 40 bits modulo 2^63. The upper and lower halves of the hashes are
    summed apart: one sum of them all overflows at some 17 million rows."""
    low = F.lit((1 << 20) - 1)
    h = F.pmod(F.xxhash64(*columns), F.lit(1 << 40))
    sums = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.shiftright(h, 20)), F.lit(0)).alias("upper"), F.coalesce(F.sum(h.bitwiseAND(low)), F.lit(0)).alias("lower"))
    upper = (F.col("upper") + F.shiftright("lower", 20)).bitwiseAND(F.lit((1 << 43) - 1))
    return sums.select("rows", F.shiftleft(upper, 20).bitwiseOR(F.col("lower").bitwiseAND(low)).alias("checksum"))
