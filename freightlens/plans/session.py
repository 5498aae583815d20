"""Session settings and the shared folder for materialised tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written for. AQE re-plans joins from measured
# sizes (broadcast only below the threshold), coalesces small shuffle
# partitions and splits skewed ones.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def build_session(
    master: str | None = "local[*]",
    app_name: str = "freightlens",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create or get a session with the recommended settings and the web UI off."""
    b = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if master:
        b = b.master(master)
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def context(spark: SparkSession):
    """The SparkContext, or None where the session has none (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions raise here
        return None


def application_id(spark: SparkSession) -> str:
    sc = context(spark)
    if sc is not None:
        return sc.applicationId
    return spark.conf.get("spark.app.id", None) or str(id(spark))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised tables.

    Taken from the session (``spark.checkpoint.dir`` or the context's
    checkpoint directory). Only a local-mode session with nothing set gets a
    fresh folder of its own; on a cluster an unset value is an error, because a
    machine-local folder is not visible to the executors.
    """
    sc = context(spark)
    current = (sc.getCheckpointDir() if sc is not None else None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if current:
        return current.rstrip("/")
    if sc is None or not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a folder every executor can reach"
        )
    base = os.environ.get("TMPDIR", "/tmp")
    d = tempfile.mkdtemp(prefix="freightlens-ckpt-", dir=base)
    sc.setCheckpointDir(d)
    return d


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run within removes its shuffles' files when it has ended, not
    when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialise_path(spark: SparkSession, df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet under the shared checkpoint folder; return the path."""
    path = f"{checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return path


def remove_materialised(spark: SparkSession, path: str) -> None:
    """Delete a table that ``materialise_path`` wrote. Sessions without a
    SparkContext leave it to the folder's owner."""
    sc = context(spark)
    if sc is not None and path.startswith(f"{checkpoint_dir(spark)}/tables/"):
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame reading it back.

    This cuts the lineage: later plans start from files, executors that are
    lost re-read them, and a plan that refers to ``df`` several times stays
    small.
    """
    return spark.read.parquet(materialise_path(spark, df, name))
