"""Tables that follow a stream of changes: each batch makes the next snapshot, once.

A snapshot's tag is the stream's name and the batch's number, so that a batch that is given again after its snapshot was
written changes nothing, and one that died before is applied as if it had never begun.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobloom.operators import state
from jobloom.plans import snapshots

#: Rows of a stream of crawls: what a crawl found, how it ended, and what probes of single postings say.
CHANGES = "kind string, source string, url string, complete boolean, empty_is_valid boolean, dead1 boolean, dead2 boolean, at timestamp"

Step = Callable[[DataFrame, DataFrame], DataFrame]


def follow(changes: DataFrame, name: str, root: str, table: str, step: Step, checkpoint: str, leaves: Callable[[DataFrame], Column] | None = None) -> StreamingQuery:
    """Applies step(table, batch) to the table's current snapshot for each batch of changes there is, then stops.

    With leaves(batch), a column over the table, rows for which it holds go to <root>/<table>-archive/<name>-<batch>
    as JSON before the snapshot without them is written; written again, it is the same. step must depend on nothing but
    its two tables: a time comes from the batch.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark, tag = batch.sparkSession, f"{name}-{number}"
        if snapshots.committed(spark, root, table, tag):
            return
        new = step(snapshots.current(spark, root, table), batch)
        if leaves is not None:
            gone = F.coalesce(leaves(batch), F.lit(False))
            new.where(gone).write.mode("overwrite").json(f"{root}/{table}-archive/{tag}")
            new = new.where(~gone)
        snapshots.commit(new, root, table, tag=tag)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _time_of(batch: DataFrame) -> str:
    """The time of a batch: its latest change, in the session's time zone."""
    return str(batch.agg(F.max("at").cast("string")).first()[0])


def liveness(sticky: list[str]) -> Step:
    """Reconciles the table with the crawls of a batch of CHANGES, then closes what its probes call dead twice.

    A crawl's rows must come in one batch. Defined cases: a crawl without a 'run' row changes nothing; a kind that is
    not known is passed over; several runs of a source in a batch count as one, complete if all are.
    """

    def step(table: DataFrame, batch: DataFrame) -> DataFrame:
        of = lambda kind: batch.where(F.col("kind") == kind)
        runs = of("run").groupBy("source").agg(F.bool_and("complete").alias("complete"), F.bool_and("empty_is_valid").alias("empty_is_valid"))
        probes = of("probe").groupBy("source", "url").agg(F.bool_and("dead1").alias("dead1"), F.bool_and("dead2").alias("dead2"))
        return state.sweep(state.reconcile(table, of("found"), runs, _time_of(batch), sticky), probes)

    return step


def archived(time_based: list[str]) -> Callable[[DataFrame], Column]:
    """Which rows of the table leave it at the time of a batch."""
    return lambda batch: state.to_archive(F.col("source"), F.col("active"), F.col("first_seen"), _time_of(batch), time_based)


def first_written(keys: list[str], order: list[str]) -> Step:
    """Adds the first row of each key that the table lacks: what was written for a day stays."""
    return lambda table, batch: state.insert_absent(table, batch, keys, order).drop("is_new")
