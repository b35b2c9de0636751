"""Chains and trees of rows that point to each other: short chains in a task, others in as many rounds of joins as the longest way has binary digits."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.operators.crawls import LEAST_SHARE
from jobloom.sources.feeds import with_checkpoints

#: Whether Spark removes the files of a query's shuffles when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A crawl of more bytes of text, and ROW_BYTES a page, is not walked in a task.
WALK_BYTES = 16 << 20
ROW_BYTES = 100
#: Types of cursors that Python compares as Spark does; strings as their bytes.
WALKED_KINDS = {T.StringType(), T.BinaryType(), T.IntegerType(), T.LongType()}


@contextlib.contextmanager
def _folder(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a table of a round, which cuts its lineage, and removes the table it stands for; all are gone at the end.

    Shuffles go when their table is written, and not when the driver happens to collect its garbage.
    """
    root = f"{spark.sparkContext.getCheckpointDir()}/links-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    places: dict[int, str] = {}

    def written(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
        place = f"{root}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(place)
        if instead is not None:
            fs.delete(path(places.pop(id(instead))), True)
        back = spark.read.schema(df.schema).parquet(place)
        places[id(back)] = place
        return back

    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield written
    finally:
        spark.conf.set(CLEANUP, before)
        fs.delete(path(root), True)


def reached(links: DataFrame, by: list[str]) -> DataFrame:
    """by, id, next, place of the rows of links (by, id, next) that can be reached from those whose id is null, at place 0.

    Round k knows of each row the one 2^k steps on, and so doubles the places that are known; it ends when no row is
    new, which a cycle cannot delay. Of several places the least counts. links has one row for each of by and id. Rounds
    know rows by number, and a round's tables go when the next one has them.
    """
    spark = links.sparkSession
    with_checkpoints(spark)
    with _folder(spark) as written:
        rows = written(links.select(*by, "id", "next", F.monotonically_increasing_id().alias("here")))
        ids = rows.where("id IS NOT NULL").select(*[F.col(c).alias(f"_{c}") for c in by], F.col("id").alias("_id"), F.col("here").alias("there"))
        jumps = rows.where("next IS NOT NULL").join(ids, [*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("next") == F.col("_id")])
        jumps = written(jumps.select("here", "there"))
        found = written(rows.where("id IS NULL").select("here", F.lit(0).cast("long").alias("place")))
        n, step = found.count(), 1
        while True:
            onward = found.join(jumps, "here").select(F.col("there").alias("here"), (F.col("place") + step).alias("place"))
            found = written(found.unionByName(onward).groupBy("here").agg(F.min("place").alias("place")), found)
            now = found.count()
            if now == n:
                return rows.join(found, "here").select(*by, "id", "next", "place").checkpoint()
            n, step = now, 2 * step
            jumps = written(jumps.join(jumps.select(F.col("here").alias("there"), F.col("there").alias("then")), "there").select("here", F.col("then").alias("there")), jumps)


def cursor_pages(pages: DataFrame, by: list[str]) -> DataFrame:
    """pages (by, cursor, next, ...) of crawls by cursor, with place: 0 for the first, null for what no chain of cursors leads to.

    The first page of a crawl has no cursor, each other one that of the page before. Defined cases: of pages that repeat
    a cursor, the one with the least next counts and the others have no place; a cursor that leads back is followed no
    further; pages after one that is missing have no place; a crawl without a first page has no places.

    Crawls of up to WALK_BYTES are walked where their rows are, so that nothing but the pages is dealt out, and not even
    they if they already lie by crawl; the pages of larger ones, and cursors of other kinds, are joined in rounds.
    """
    kinds = {pages.schema[c].dataType for c in ("cursor", "next")}
    if len(kinds) > 1 or not kinds <= WALKED_KINDS:
        return _joined(pages, by)
    with_checkpoints(pages.sparkSession)
    size = F.octet_length(F.concat_ws("", *[pages[c].cast("string") for c in pages.columns])) + ROW_BYTES
    large = pages.groupBy(*by).agg(F.sum(size).alias("_bytes")).where(F.col("_bytes") > WALK_BYTES).select(*[F.col(c).alias(f"_{c}") for c in by]).checkpoint()
    if large.isEmpty():
        return _walked(pages, by)
    same = [pages[c].eqNullSafe(F.col(f"_{c}")) for c in by]
    # a table of few rows, as each stands for WALK_BYTES of pages
    small, rest = (pages.join(F.broadcast(large), same, how) for how in ("left_anti", "left_semi"))
    return _walked(small, by).unionByName(_joined(rest, by))


def _walked(pages: DataFrame, by: list[str]) -> DataFrame:
    """cursor_pages() of crawls that fit into a task, one at a time."""

    texts = pages.schema["cursor"].dataType == T.StringType()

    def places(crawl: pa.Table) -> pa.Table:
        cursors, nexts = ((crawl[c].cast(pa.large_binary()) if texts else crawl[c]).to_pylist() for c in ("cursor", "next"))
        step = {}
        for here, there in zip(cursors, nexts):
            if here not in step or there is not None and (step[here] is None or there < step[here]):
                step[here] = there
        at, place = None, {}
        while at in step and at not in place:
            place[at] = len(place)
            at = step[at]
        found = [place.get(here) if step[here] == there else None for here, there in zip(cursors, nexts)]
        return crawl.append_column("place", pa.array(found, pa.int64()))

    return pages.groupBy(*by).applyInArrow(places, T.StructType([*pages.schema, T.StructField("place", T.LongType())]))


def _joined(pages: DataFrame, by: list[str]) -> DataFrame:
    """cursor_pages() of crawls of any size."""
    links = pages.groupBy(*by, F.col("cursor").alias("id")).agg(F.min(F.struct(F.col("next").isNull().alias("ends"), "next"))["next"].alias("next"))
    known = reached(links, by).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("id").alias("_cursor"), F.col("next").alias("_to"), "place")
    on = [pages[c].eqNullSafe(F.col(f"_{c}")) for c in (*by, "cursor")] + [pages["next"].eqNullSafe(F.col("_to"))]
    return pages.join(known, on, "left").select(*[pages[c] for c in pages.columns], "place")


def cursor_runs(pages: DataFrame, by: list[str]) -> DataFrame:
    """by, n_pages, cards, ending, complete of each crawl of pages (by, cursor, next, cards, stated).

    ending is 'end' if the last page that was reached has no next one, 'cycle' if its next one was reached before, and
    'gap' if that is not there. A crawl is complete if it came to its end with LEAST_SHARE of what its first page states.
    """
    placed = cursor_pages(pages, by).where("place IS NOT NULL").dropDuplicates([*by, "place"])
    runs = placed.groupBy(*by).agg(
        F.count("*").alias("n_pages"), F.coalesce(F.sum("cards"), F.lit(0)).alias("cards"), F.min_by("stated", "place").alias("_stated"), F.max_by("next", "place").alias("next"),
    )
    seen = placed.where("cursor IS NOT NULL").select(*by, F.col("cursor").alias("next"), F.lit(True).alias("_seen"))
    ending = F.when(F.col("next").isNull(), "end").when(F.col("_seen"), "cycle").otherwise("gap")
    enough = F.col("_stated").isNull() | (F.col("cards") >= F.col("_stated") * LEAST_SHARE)
    found = runs.join(seen, [*by, "next"], "left").withColumn("ending", ending)
    return found.select(*by, "n_pages", "cards", "ending", ((F.col("ending") == "end") & enough).alias("complete"))


def tree_nodes(nodes: DataFrame, paths: bool = True) -> DataFrame:
    """id, root, depth, kind and, with paths, path of every row of nodes (id, parent, name), in trees of any depth.

    Each round joins what is above a node to what is above that, so that the depth that is known doubles. kind is 'node'
    below a root (a row without a parent), 'orphan' below a parent that is not there, and 'cycle' below, or as, a
    row that is its own ancestor; depth, root and path are from the topmost known row, null for cycles. ids are unique.
    """
    with_checkpoints(nodes.sparkSession)
    path = [F.col("name").alias("path")] if paths else []
    rows = nodes.select("id", F.col("parent").alias("up"), F.col("id").alias("root"), F.lit(0).alias("depth"), F.lit("node").alias("kind"), *path).checkpoint()
    left = -1
    while (now := rows.where("up IS NOT NULL").count()) != left and now:
        left = now
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("kind").alias("_kind"), *([F.col("path").alias("_path")] if paths else []))
        joined = rows.where("up IS NOT NULL").join(above, "up", "left")
        missing = F.col("_root").isNull()
        climbed = joined.select(
            "id", F.col("_up").alias("up"), F.coalesce("_root", "root").alias("root"), F.when(missing, F.col("depth")).otherwise(F.col("depth") + F.col("_depth") + 1).alias("depth"),
            F.when(missing, "orphan").otherwise(F.col("_kind")).alias("kind"), *([F.when(missing, F.col("path")).otherwise(F.concat("_path", F.lit("/"), "path")).alias("path")] if paths else []),
        )
        rows = rows.where("up IS NULL").unionByName(climbed).checkpoint()
    cyclic = F.col("up").isNotNull()
    out = ["id", *[F.when(~cyclic, F.col(c)).alias(c) for c in ("root", "depth")], F.when(cyclic, "cycle").otherwise(F.col("kind")).alias("kind")]
    return rows.select(*out, *([F.when(~cyclic, F.col("path")).alias("path")] if paths else []))
