"""Publishing several tables as one.

Each publication writes its tables to a folder of their own,
``<out>/versions/<version>/<table>``, and becomes visible by one step at the
end: a manifest, ``<out>/manifests/<number>.json``, is written under another
name and renamed. Readers take the manifest of the highest number, so they see
all tables of one publication or all of the one before it, whenever they look
and wherever a run fails. A number is taken once: a rename to a name that
exists fails, and the later of two concurrent publications takes the next one.
The files are reached through Spark's file system layer, as the tables are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import SparkSession

KEPT = 2  # publications whose files stay, for readers that have begun
_TRIES = 20


class NotPublished(FileNotFoundError):
    """There is no manifest in the folder."""


def _files(spark: SparkSession, out_dir: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    return path, path(out_dir).getFileSystem(conf)


def _numbers(spark: SparkSession, out_dir: str) -> list[int]:
    path, fs = _files(spark, out_dir)
    folder = path(f"{out_dir}/manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, out_dir: str, number: int) -> dict:
    rows = spark.read.option("wholetext", True).text(f"{out_dir}/manifests/{number:08d}.json")
    return json.loads(rows.first()[0])


def published(spark: SparkSession, out_dir: str) -> dict[str, str]:
    """``{table: path}`` of the latest publication in ``out_dir``."""
    out = out_dir.rstrip("/")
    numbers = _numbers(spark, out)
    if not numbers:
        raise NotPublished(out)
    version = _manifest(spark, out, numbers[-1])
    return {name: f"{out}/versions/{version['version']}/{name}" for name in version["tables"]}


def publish(
    spark: SparkSession, out_dir: str, writers: Mapping[str, Callable[[str], None]], keep: int = KEPT
) -> dict[str, str]:
    """Call each writer with the path of its table, then make all visible at
    once; returns ``{table: path}``. If a writer fails, nothing has changed for
    readers, and the files written so far are removed. Files of publications
    before the last ``keep`` are removed after the step."""
    out = out_dir.rstrip("/")
    path, fs = _files(spark, out)
    version = uuid.uuid4().hex
    base = f"{out}/versions/{version}"
    paths = {name: f"{base}/{name}" for name in writers}
    try:
        for name, write in writers.items():
            write(paths[name])
        number = _commit(spark, out, {"version": version, "tables": list(writers)})
    except BaseException:
        fs.delete(path(base), True)
        raise
    for old in [n for n in _numbers(spark, out) if n <= number - keep]:
        gone = _manifest(spark, out, old)["version"]
        fs.delete(path(f"{out}/manifests/{old:08d}.json"), False)
        fs.delete(path(f"{out}/versions/{gone}"), True)
    return paths


def _commit(spark: SparkSession, out: str, manifest: dict) -> int:
    path, fs = _files(spark, out)
    fs.mkdirs(path(f"{out}/manifests"))
    waiting = path(f"{out}/manifests/_{manifest['version']}")
    stream = fs.create(waiting, False)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    for _ in range(_TRIES):
        number = max(_numbers(spark, out), default=0) + 1
        target = path(f"{out}/manifests/{number:08d}.json")
        if not fs.exists(target) and fs.rename(waiting, target):
            return number
    fs.delete(waiting, False)
    raise RuntimeError(f"{out}: other publications took every number")
