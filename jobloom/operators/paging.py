"""How far a crawl's pages go: by a stated last page, a count, a short or empty page, a link to the next, or a status.

A page `ends` a crawl if it is its last; it `stops` one if it is past its last, and holds nothing of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.operators.crawls import LEAST_SHARE


def first_of(column: str, by: list[str], place: str = "place") -> Column:
    """A value of the first page of each crawl: the size that the others go by, or what it states."""
    return F.first(column).over(Window.partitionBy(*by).orderBy(place))


def by_last_page(place: Column, last: Column) -> Column:
    """The page, counted from 1, is the last that it states; one that states none is the last itself."""
    return place >= F.coalesce(last, place)


def by_count(place: Column, limit: Column, total: Column) -> Column:
    """The page at this offset and limit reaches the total, stated on the pages or by a probe; without one nothing ends."""
    return F.coalesce(place + limit >= total, F.lit(False))


def by_size(items: Column, size: Column) -> Column:
    """The page holds less than a whole one."""
    return items < size


def gone(status: Column) -> Column:
    return F.coalesce(status == 404, F.lit(False))


def with_probes(pages: DataFrame, probes: DataFrame, by: list[str]) -> DataFrame:
    """pages with total, of probes (by, total); of several the largest counts, without one it is null."""
    return pages.join(probes.groupBy(*by).agg(F.max("total").alias("total")), by, "left")


def walked(pages: DataFrame, by: list[str], index: Column, ends: Column, stops: Column | None = None, most: int | None = None) -> DataFrame:
    """pages (by, status, items, ...) with index and reached: whether a crawl that goes page by page, from index 0, keeps the page.

    It keeps a page if all before it are there, went well, and neither ended nor stopped the crawl, and if the page itself
    went well (a status of 2xx) and does not stop it. A page without items, and a 404, stop it as well. With most,
    pages from that index on are not asked for. Of pages of one index the first by status counts; the others are not reached.
    """
    fine = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    halts = gone(F.col("status")) | ~fine | (F.coalesce("items", F.lit(0)) == 0) | (F.coalesce(stops, F.lit(False)) if stops is not None else F.lit(False))
    crawl = Window.partitionBy(*by)
    ordered = crawl.orderBy("index", "status")
    rows = pages.withColumn("index", index.cast("long")).withColumn("_halts", halts).withColumn("_ends", F.coalesce(ends, F.lit(False)))
    rows = rows.withColumn("_twice", F.coalesce(F.lag("index").over(ordered) == F.col("index"), F.lit(False)))
    once = F.when(~F.col("_twice"), F.col("index"))
    # the places before this one are all there if there are as many of them as its index says
    there = F.count(once).over(ordered) == F.col("index") + 1
    over = F.max(F.when(~F.col("_twice") & (F.col("_ends") | F.col("_halts")), F.lit(True))).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    asked = F.col("index") < most if most is not None else F.lit(True)
    reached = ~F.col("_twice") & there & over.isNull() & ~F.col("_halts") & asked
    return rows.withColumn("reached", F.coalesce(reached, F.lit(False))).withColumn("_asked", F.coalesce(~F.col("_twice") & there & over.isNull() & asked, F.lit(False)))


def paged_runs(pages: DataFrame, by: list[str], index: Column, ends: Column, stops: Column | None = None, most: int | None = None, total: str | None = None) -> DataFrame:
    """by, n_pages, items, ending, complete of each crawl of pages, walked().

    ending is 'end' if the last page that was asked for ends the crawl, 'empty' or 'gone' if it has no items or is a 404,
    'error' for another status, 'stop' for another that stops it, and 'gap' if the next page is not there or not to be
    asked for. A crawl is complete if it came to an end other than a gap or an error, with LEAST_SHARE of total.
    """
    rows = walked(pages, by, index, ends, stops, most)
    at = lambda c: F.max_by(c, F.when(F.col("_asked"), F.col("index")))
    fine = F.col("status").between(200, 299)
    ending = F.when(gone(F.col("status")), "gone").when(~F.coalesce(fine, F.lit(False)), "error").when(F.coalesce("items", F.lit(0)) == 0, "empty").when(F.col("_halts"), "stop").when(F.col("_ends"), "end").otherwise("gap")
    found = rows.withColumn("_ending", ending).groupBy(*by).agg(
        F.count_if("reached").alias("n_pages"), F.coalesce(F.sum(F.when(F.col("reached"), F.col("items"))), F.lit(0)).alias("items"),
        F.coalesce(at("_ending"), F.lit("gap")).alias("ending"), (F.max(total) if total else F.lit(None).cast("long")).alias("_total"),
    )
    enough = F.col("_total").isNull() | (F.col("items") >= F.col("_total") * LEAST_SHARE)
    return found.select(*by, "n_pages", "items", "ending", (~F.col("ending").isin("gap", "error") & enough).alias("complete"))
