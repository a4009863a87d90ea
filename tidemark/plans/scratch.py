"""Shared scratch storage: where plans cut their lineage so that lost executors cost no recomputation."""

from __future__ import annotations

import contextlib
import getpass
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Spark's setting that removes a query's shuffle files as soon as the query has ended.
SHUFFLE_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share. A machine-local one serves only where the cluster names none."""
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        base = spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/tidemark-{getpass.getuser()}"
        spark.conf.set(CHECKPOINT_KEY, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """Fresh folder name below the shared folder."""
    path = f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: replicated storage instead of lineage.

    The write's shuffle files go when it ends, as what is read later is the table alone.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    with shuffles_removed(spark):
        df.write.parquet(path)
    for made in _COLLECTING:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that start meanwhile leave no shuffle files behind; the session's own setting comes back afterwards."""
    before = spark.conf.get(SHUFFLE_CLEANUP_KEY, None)
    spark.conf.set(SHUFFLE_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP_KEY)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_KEY, before)


_COLLECTING: list[list[str]] = []
#: Folders written and not yet deleted, by application.
_MADE: dict[str, set[str]] = {}


@contextlib.contextmanager
def collecting() -> Iterator[list[str]]:
    """Lists the folders that are written meanwhile, for ``discard`` once nothing reads them."""
    made: list[str] = []
    _COLLECTING.append(made)
    try:
        yield made
    finally:
        _COLLECTING.remove(made)


def discard(df_or_path, spark: SparkSession | None = None) -> None:
    """Delete a scratch folder early, once nothing reads it any more."""
    path = getattr(df_or_path, "_scratch_path", df_or_path)
    spark = spark or df_or_path.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _MADE.get(spark.sparkContext.applicationId, set()).discard(path)


def cleanup(spark: SparkSession) -> int:
    """Delete every scratch folder that this application has written and not deleted yet; how many there were."""
    left = sorted(_MADE.get(spark.sparkContext.applicationId, ()))
    for path in left:
        discard(path, spark)
    return len(left)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
