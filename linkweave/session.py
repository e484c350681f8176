"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[str] = ContextVar("scope", default="")


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the package relies on. Safe to call any number of times."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # A JSON object with a repeated key is legal input: the last one wins.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # Several jobs aggregate above a join; without this the skew split is given up there.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, or else its warehouse.

    Only a local session may fall back to a folder of its own: on a cluster a machine-local path
    would be lost with its machine. ``local-cluster`` is a cluster, its executors have folders of their own.
    """
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return _shared(spark, root)
    context = spark.sparkContext
    if root := context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir():
        return _shared(spark, root)
    if _on_cluster(context.master):
        if root := spark.conf.get("spark.sql.warehouse.dir", None):
            return _shared(spark, root)
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="linkweave-"))
    return context.getCheckpointDir().rstrip("/")


def _on_cluster(master: str) -> bool:
    """Whether tasks run in other processes than the driver's."""
    return not master.startswith("local") or master.startswith("local-cluster")


# Folders that this process has seen shared, by application.
_seen_shared: set[tuple[str, str]] = set()


def _shared(spark: SparkSession, root: str) -> str:
    """``root``; on a cluster it is tried once: rows that tasks write there must be there for the driver. The scheme does not
    tell, as a mounted folder is a ``file:`` too. ``linkweave.sharedFileSystem`` leaves the trial out."""
    root = root.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not _on_cluster(master) or spark.conf.get("linkweave.sharedFileSystem", "false") == "true":
        return root
    key = (spark.conf.get("spark.app.id"), root)
    if key not in _seen_shared:
        path = f"{root}/linkweave/{key[0]}/shared-{uuid.uuid4().hex}"
        spark.range(0, _TRIED, 1, _TRIED).write.parquet(path)
        if spark.read.schema("id long").parquet(path).count() != _TRIED:
            raise RuntimeError(f"spark.checkpoint.dir is {root}, which the executors do not share; name a folder that they do")
        _seen_shared.add(key)
    return root


# Tasks of that trial, so that several executors take part.
_TRIED = 32


def _scratch_folder(spark: SparkSession) -> str:
    parts = [scratch_root(spark), "linkweave", spark.conf.get("spark.app.id"), _scope.get()]
    return "/".join(part for part in parts if part)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path that nothing has been written to yet, in this application's part of the folder."""
    return f"{_scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove what this application has staged. DataFrames read from it are not usable any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is removed at the end. For work that goes on for ever, such as the
    micro-batches of a stream; its results must be written elsewhere by then."""
    token = _scope.set(f"scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        drop_scratch(spark)
        _scope.reset(token)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage and freezes the rows, so a lost executor re-reads files instead of
    recomputing, and later passes read only the columns they use.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove the files of a DataFrame from ``stage`` that nothing will read any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
