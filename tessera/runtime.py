"""Session-level helpers shared by every operator: table access, lineage cuts, checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides estimated above this many bytes are never broadcast by ``checked_broadcast``.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data directory; filters and projections on it reach the parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor shares: ``spark.checkpoint.dir`` of the session. Where it is unset, a temporary one serves a session on one
    machine; on a cluster that is an error, since each executor would write to its own disk."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        path = jsc.getCheckpointDir().get()
    return path.rstrip("/")


def materialise(df: DataFrame, *, label: str = "cut") -> DataFrame:
    """Cut lineage: write ``df`` as parquet into the shared folder and read it back.

    A written table survives the loss of any executor, and is columnar and compressed, so
    later stages read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """Broadcast ``df`` only if its measured row count keeps it under ``BROADCAST_BYTES``; else leave the join to shuffle."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: nothing to do where its folder is on their path, else it is sent along once."""
    import os
    import tempfile
    import zipfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    on_path = root in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if on_path or sc.master.startswith("local[") and os.getcwd() == root or getattr(sc, "_tessera_sent", False):
        return
    place = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_package.zip")  # the driver serves it from here
    with zipfile.ZipFile(place, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "tessera")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(place)
    sc._tessera_sent = True
