"""Tables as sequences of immutable Parquet snapshots: <root>/<table>/v=<n>, or v=<n>.<tag>.

The current snapshot is the highest complete one. A mutation reads it and writes the next; a path that is
read is never written, and a number is claimed by one writer. A tag says what change a snapshot holds: it is part of
the name, and so complete when the data are.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.operators.records import kept_backups


def new_root(spark: SparkSession, name: str) -> str:
    """A folder of its own in spark.checkpoint.dir; where that is unset, a temporary one, but only for a local master."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(folder or tempfile.mkdtemp(prefix='jobloom-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, place: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, root: str, table: str, complete: bool = True) -> list[tuple[int, str]]:
    """Numbers and names of snapshots, in order."""
    fs, place = _folder(spark, f"{root}/{table}")
    if not fs.exists(place):
        return []
    found = [s.getPath() for s in fs.listStatus(place) if s.getPath().getName().startswith("v=")]
    success = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    names = [p.getName() for p in found if not complete or success(p)]
    return sorted((int(name.removeprefix("v=").split(".")[0]), name) for name in names)


def current(spark: SparkSession, root: str, table: str) -> DataFrame:
    versions = _versions(spark, root, table)
    if not versions:
        raise FileNotFoundError(f"{root}/{table} has no snapshot")
    return spark.read.parquet(f"{root}/{table}/{versions[-1][1]}")


def committed(spark: SparkSession, root: str, table: str, tag: str) -> bool:
    """Whether a complete snapshot holds the change of this tag."""
    return any(name.partition(".")[2] == tag for _, name in _versions(spark, root, table))


_claiming = threading.Lock()


def _claimed(spark: SparkSession, root: str, table: str) -> int:
    """The next number, claimed by a file that is made only if it does not exist; a number whose writer died stays unused.

    Drivers of one table need a file system that makes such a file for one of them alone, as HDFS does; the threads of
    a driver take turns.
    """
    with _claiming:
        n = max((n for n, _ in _versions(spark, root, table, complete=False)), default=0) + 1
        while True:
            fs, claim = _folder(spark, f"{root}/{table}/_claims/{n}")
            try:
                fs.create(claim, False).close()
                return n
            except Py4JJavaError:
                if not fs.exists(claim):
                    raise
            n += 1


def commit(df: DataFrame, root: str, table: str, partition_by: list[str] | None = None, tag: str | None = None) -> int:
    """Writes df as the next snapshot and returns its number."""
    n = _claimed(df.sparkSession, root, table)
    name = f"v={n}.{tag}" if tag else f"v={n}"
    df.write.mode("errorifexists").partitionBy(*partition_by or []).parquet(f"{root}/{table}/{name}")
    return n


def archive(df: DataFrame, leaves: Column, root: str, table: str, path: str) -> int:
    """Writes the rows that leave as JSON to path and then the others as the next snapshot, whose number it returns; null stays."""
    gone = F.coalesce(leaves, F.lit(False))
    df.where(gone).write.mode("overwrite").json(path)
    return commit(df.where(~gone), root, table)


def backup(df: DataFrame, root: str, table: str, day: str, days: int = 10) -> str:
    """Writes df as JSON to <root>/<table>-<day> and deletes the table's backups that are older than `days` before it; the new path."""
    spark, name = df.sparkSession, f"{table}-{day}"
    df.write.mode("overwrite").json(f"{root}/{name}")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths = {s.getPath().getName(): s.getPath() for s in fs.listStatus(place)}
    own = [n for n in paths if n.startswith(f"{table}-")]
    kept = kept_backups(spark.createDataFrame([(n,) for n in own], "name string"), "name", day, days)
    for old in set(own) - {r["name"] for r in kept.collect()}:
        fs.delete(paths[old], True)
    return f"{root}/{name}"


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; empty strings as null."""
    texts = {name: F.nullif(F.col(name), F.lit("")) for name, kind in df.dtypes if kind == "string"}
    df.withColumns(texts).write.json(path)
