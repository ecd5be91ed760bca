"""Session helpers: where shared files go, and how they are reached."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def use_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    A cluster whose workers have it elsewhere on their path is not disturbed.
    """
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    A session that names none uses a folder in its warehouse, which is shared as well.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = known.get() if known.isDefined() else None
    if not path:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/work"
    return path


_recorders: ContextVar[tuple[list[str], ...]] = ContextVar("recorders", default=())


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/hazardlake/{label}-{uuid.uuid4().hex}"
    for made in _recorders.get():
        made.append(path)
    return path


@contextmanager
def recording() -> Iterator[list[str]]:
    """The paths that ``work_dir`` gives out meanwhile in this thread or task."""
    made: list[str] = []
    token = _recorders.set((*_recorders.get(), made))
    try:
        yield made
    finally:
        _recorders.reset(token)


def drop_work(spark: SparkSession, paths: list[str], but_of: DataFrame | None = None) -> None:
    """Delete written work tables; those that ``but_of`` reads stay."""
    read = but_of.inputFiles() if but_of is not None and paths else []
    for path in paths:
        if not any(path.rsplit("/", 1)[1] in f for f in read):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Unlike ``checkpoint()``, which runs the plan once to count and once to write, this
    runs it once; the columnar table is also cheaper to read again.
    """
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
