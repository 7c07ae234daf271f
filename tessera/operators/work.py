"""Incremental work: job leases, waves, refresh queues, snapshots with changes, event logs with strict replay, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Kinds of session events.
EVENT_KINDS = ("task_start", "read", "search", "edit", "refresh", "failure", "decision", "compaction", "completion")
EVENT_SCHEMA = "session string, seq bigint, time string, kind string, path string, start bigint, end bigint, text string, freshness string"


def claim_jobs(jobs: DataFrame, now: Column, lease_seconds: int, most: int) -> DataFrame:
    """Jobs (job, state, attempts, priority, created, lease_until) that a worker gets: pending ones and running ones whose lease is over, best
    priority first, then the oldest; ``most`` of them, running with a new lease and one attempt more."""
    free = jobs.where((F.col("state") == "pending") | ((F.col("state") == "running") & (F.col("lease_until") < now)))
    got = free.orderBy(F.desc("priority"), "created", "job").limit(most)
    until = (now.cast("timestamp").cast("double") + lease_seconds).cast("timestamp")
    return got.withColumn("state", F.lit("running")).withColumn("attempts", F.col("attempts") + 1).withColumn("lease_until", until)


def waves(jobs: DataFrame, width: int) -> DataFrame:
    """(kind, job, wave): the jobs (kind, job, priority) of each kind dealt to waves of ``width`` that run one after another; within a wave they run at once."""
    w = Window.partitionBy("kind").orderBy(F.desc("priority"), "job")
    return jobs.select("kind", "job", F.floor((F.row_number().over(w) - 1) / width).alias("wave"))


def refresh_queue(changes: DataFrame, capacity: int = 4_096) -> DataFrame:
    """(path, rescan): the distinct changed paths (path, at) in order of their first change; where more than ``capacity`` wait, one row without
    a path that asks for a full rescan."""
    first = changes.groupBy("path").agg(F.min("at").alias("at"))
    n = first.agg(F.count("*").alias("n"))
    kept = first.crossJoin(F.broadcast(n)).where(F.col("n") <= capacity).select("path", F.lit(False).alias("rescan"))  # one row
    return kept.union(n.where(F.col("n") > capacity).select(F.lit(None).cast("string"), F.lit(True)))


def apply_changes(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, digest): a snapshot after changes (op add, modify, delete or rename; path, old_path, digest). A rename without a digest keeps
    the old file's; changes of a path that is not there add it."""
    touched = changes.select(F.col("path").alias("p")).union(changes.where("op = 'rename'").select("old_path")).distinct()
    kept = snapshot.join(touched, snapshot.path == F.col("p"), "left_anti").select("path", "digest")
    old = snapshot.select(F.col("path").alias("old_path"), F.col("digest").alias("had"))
    new = changes.where("op <> 'delete'").join(old, "old_path", "left").select("path", F.coalesce("digest", "had").alias("digest"))
    return kept.union(new)


def paths_to_ingest(files: DataFrame, paths: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, action): what re-indexing the listed paths (path) means for a stored index (path, digest): add, update or keep what is there
    (path, digest), remove what is stored but gone, ignore what is neither."""
    wanted = paths.select("path").distinct()
    f, s = files.select("path", F.col("digest").alias("now")), stored.select("path", F.col("digest").alias("was"))
    j = wanted.join(f, "path", "left").join(s, "path", "left")
    action = (
        F.when(F.col("now").isNull() & F.col("was").isNull(), "ignore").when(F.col("now").isNull(), "remove").when(F.col("was").isNull(), "add")
        .when(F.col("now") == F.col("was"), "keep").otherwise("update")
    )
    return j.select("path", action.alias("action"))


def append_events(events: DataFrame, path: str, retain: int | None = None) -> None:
    """Append events to a log of JSON lines. With ``retain`` the newest so many events of each session stay and the log is written anew
    beside the old one, which is given up once the new one is whole."""
    spark = events.sparkSession
    events.select(*[f.name for f in _event_fields()]).write.mode("append").json(path)
    if retain is not None:
        import uuid

        w = Window.partitionBy("session").orderBy(F.desc("seq"))
        fresh = f"{path}-{uuid.uuid4().hex}"
        replay(spark, path).withColumn("n", F.row_number().over(w)).where(F.col("n") <= retain).drop("n").write.json(fresh)
        hadoop = spark._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(hadoop.Path(path), True)
        fs.rename(hadoop.Path(fresh), hadoop.Path(path))


def _event_fields():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(EVENT_SCHEMA).fields


def replay(spark: SparkSession, path: str) -> DataFrame:
    """The events of a log, strictly: blank lines are passed over; a line that is no event (broken, with a field the schema lacks, of an
    unknown kind, without session or seq) is an error."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    names = [f.name for f in _event_fields()]
    e = F.from_json("value", EVENT_SCHEMA)
    odd = F.coalesce(F.size(F.array_except(F.json_object_keys("value"), F.array(*[F.lit(n) for n in names]))) > 0, F.lit(True))
    bad = odd | e["session"].isNull() | e["seq"].isNull() | ~F.coalesce(e["kind"].isin(*EVENT_KINDS), F.lit(False))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("invalid event line: "), F.substring("value", 1, 80))).cast("string")).otherwise(e["session"])
    return raw.select(checked.alias("session"), *[e[n].alias(n) for n in names if n != "session"])


def roll_up(ledger: DataFrame, steps: DataFrame, keep: int) -> DataFrame:
    """(category, step, saved, spent): a ledger after new steps: the newest ``keep`` steps of each category stay, older ones add up in one row
    without a step number. Totals never change."""
    rows = ledger.select("category", "step", "saved", "spent").unionByName(steps.select("category", "step", "saved", "spent"))
    n = F.row_number().over(Window.partitionBy("category").orderBy(F.desc_nulls_last("step")))
    rows = rows.withColumn("step", F.when(F.col("step").isNotNull() & (n <= keep), F.col("step")))
    return rows.groupBy("category", "step").agg(F.sum("saved").alias("saved"), F.sum("spent").alias("spent"))


def changed_rows(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, op): upsert of new and changed rows, delete of those that are gone: what a continual refresh has to do."""
    j = old.select(key, F.col(digest).alias("o")).join(new.select(key, F.col(digest).alias("n")), key, "full_outer")
    op = F.when(F.col("n").isNull(), "delete").when(F.col("o").isNull() | (F.col("o") != F.col("n")), "upsert")
    return j.select(key, op.alias("op")).where(F.col("op").isNotNull())


def byte_tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, position, token, start, end): runs without blanks and their byte offsets. Offsets are running sums over a document's runs."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(r"(\S+|\s+)"), F.lit(1))
    r = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(runs).alias("i", "token"))
    w = Window.partitionBy("doc").orderBy("i")
    r = r.withColumn("end", F.sum(F.octet_length("token")).over(w)).withColumn("start", F.col("end") - F.octet_length("token"))
    r = r.where(~F.col("token").rlike(r"^\s"))
    return r.select("doc", (F.row_number().over(w) - 1).alias("position"), "token", "start", "end")


