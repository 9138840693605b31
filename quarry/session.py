"""Session helpers: local session for tests, scratch paths under the
checkpoint directory, size-checked broadcast and input spreading."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# Largest number of rows any operator broadcasts without a further check.
# Rows here are narrow (ids, a term, a count), so this is tens of MB at most.
BROADCAST_ROW_LIMIT = 2_000_000


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "quarry", driver_memory: str = "8g") -> SparkSession:
    """A ``local[cores]`` session with AQE on and the UI off (tests, bench)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions",
                             str(shuffle_partitions or (cores if isinstance(cores, int) else 8)))
    builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint directory of the cluster.

    Read from the session. Only a ``local`` master without one gets a fresh
    scratch directory; on a cluster a machine-local folder would lose data,
    so that raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in the Python workers (once per application).

    Operators that run Python inside tasks (vector scoring, the encoder and
    lemma hooks) pickle functions of this package; ``addPyFile`` sends a zip
    of it to every executor, as ``--py-files`` would.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="quarry-pyfiles-"), "quarry.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame, key: str, min_partitions: int | None = None) -> DataFrame:
    """Hash-partition ``df`` by ``key`` when its scan yields too few partitions.

    Large inputs come in many splits and are left alone (no shuffle); a file
    with one row group gives one task, which would serialise the expensive
    text analysis, so it is spread over the cluster by key.
    """
    sc = df.sparkSession.sparkContext
    target = min_partitions or max(2, sc.defaultParallelism * 2)
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target, key)
    return df


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT):
    """Broadcast ``df`` only if its row count is within ``max_rows``.

    Returns ``(frame, rows, broadcast?)``. Above the bound the frame is
    returned as is and the planner (with AQE skew handling) shuffles it.
    """
    rows = df.count()
    if rows <= max_rows:
        return F.broadcast(df), rows, True
    return df, rows, False


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes within go when a write has ended; Spark else keeps
    them until the driver happens to collect its garbage. A write plans its rows
    anew, so nothing reads them again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet (cutting the lineage) and read it back."""
    writer = df.write.mode("overwrite")
    if codec:
        writer = writer.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_removed(df.sparkSession):
        writer.parquet(path)
    reader = df.sparkSession.read
    # An empty partitioned table has no file to take the schema from.
    return (reader.schema(df.schema) if partition_by else reader).parquet(path)
