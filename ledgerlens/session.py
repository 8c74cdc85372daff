"""Session helpers.

The library never builds its own cluster configuration when a session is
handed in; ``get_session`` is for tests, ``bench.py`` and local runs only.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Defaults that matter at scale as much as locally: AQE re-plans shuffles at
# runtime, coalesces small partitions and splits skewed join partitions.
_SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ledgerlens") -> SparkSession:
    """Build (or return) a local session with the library's defaults."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    for k, v in _SCALE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    if os.environ.get("LEDGERLENS_TZ"):  # testing: results must not depend on the session zone
        builder = builder.config("spark.sql.session.timeZone", os.environ["LEDGERLENS_TZ"])
    builder = builder.config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is.  Only when it is unset (local tests) a scratch folder is
    created and registered, so ``DataFrame.checkpoint()`` and written
    intermediate tables survive executor loss on the cluster.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    base = checkpoint_dir(spark)
    import uuid

    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df):
    """Materialise ``df`` with a reliable checkpoint in the shared folder.

    Used where one batch feeds several branches of a plan: the work runs
    once, and the lineage is cut so an executor lost later does not force
    the upstream parsing to run again.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Codec of intermediate tables and of the store: keys and hashes in hex take half the place that snappy gives them.
CODEC = "zstd"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def write_table(df, path: str) -> None:
    """``df`` as Parquet, packed, at ``path``; its shuffle files are let go."""
    with shuffles_let_go(df.sparkSession):
        df.write.option("compression", CODEC).parquet(path)


def stage_table(df):
    """``df`` written once as Parquet in the shared folder and read back: for wide batches, packed, of which a reader takes its columns only."""
    path = scratch_path(df.sparkSession, "staged")
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
