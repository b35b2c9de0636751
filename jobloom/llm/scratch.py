"""Intermediate tables in the folder that the cluster shares.

A written table cuts lineage: an executor that is lost later costs a re-read, not a recomputation. An
operator discards what it has read for the last time; what its lazy result still reads is left to the
caller, who removes it with clear() once the result has been read.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Tables that stand, by application, in the order in which they were written.
_standing: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one, but only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="jobloom-")
    return _own[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/jobloom/{name}-{uuid.uuid4().hex}"
    standing(spark).append(path)
    return path


def standing(spark: SparkSession) -> list[str]:
    """Paths of the intermediate tables that have not been removed."""
    return _standing.setdefault(spark.sparkContext.applicationId, [])


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back under its own schema; .scratch_path has the place."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Removes tables that written() made and that no later step reads."""
    for df in frames:
        _remove(df.sparkSession, df.scratch_path)


def clear(spark: SparkSession, before: list[str] | None = None, *kept: DataFrame) -> None:
    """Removes all intermediate tables but `kept` and those of `before`, an earlier list(standing(spark))."""
    spared = {*(before or ()), *(df.scratch_path for df in kept)}
    for path in [p for p in standing(spark) if p not in spared]:
        _remove(spark, path)


def _remove(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if place in standing(spark):
        standing(spark).remove(place)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)
