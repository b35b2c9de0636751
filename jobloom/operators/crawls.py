"""Crawls: where their pages end, whether they are whole, and which rows of one count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.operators.cleaning import first_per_key

#: A crawl is whole if it has at least this share of the postings that its source states.
LEAST_SHARE = 0.9


def pages_read(pages: DataFrame, by: list[str], stop: Column) -> DataFrame:
    """Pages (by, page, ...) before the first that stops a crawl: one that is missing, empty or brings nothing new, say."""
    first = F.min(F.when(F.coalesce(stop, F.lit(False)), F.col("page"))).over(Window.partitionBy(*by))
    return pages.withColumn("_first", first).where("_first IS NULL OR page < _first").drop("_first")


def with_new_urls(pages: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """pages with n_new, the number of urls of candidates (by, page, url) that no earlier page of the crawl has."""
    first = candidates.groupBy(*by, "url").agg(F.min("page").alias("page")).groupBy(*by, "page").agg(F.count("*").alias("n_new"))
    return pages.join(first, [*by, "page"], "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))


def crawl_runs(pages: DataFrame, by: list[str], empty_fails: bool = False, most_pages: int | None = None) -> DataFrame:
    """by, n_pages, cards, complete of each crawl of pages (by, page, status, cards, has_next, stated).

    A crawl is complete if no page failed (404 ends a crawl, it is no failure), its last page has no next
    one, and its cards are LEAST_SHARE of what its first page states; what is not stated is not asked.
    With empty_fails an empty page fails, with most_pages a crawl of as many that has a next page.
    """
    fine = F.col("status").between(200, 299)
    failed = ~fine & (F.col("status") != 404) | F.col("status").isNull()
    empty = fine & (F.coalesce("cards", F.lit(0)) == 0)
    last = F.coalesce(F.max_by("has_next", "page"), F.lit(False))
    out = pages.groupBy(*by).agg(
        F.count_if(fine).alias("n_pages"),
        F.coalesce(F.sum(F.when(fine, F.col("cards"))), F.lit(0)).alias("cards"),
        F.min_by("stated", "page").alias("_stated"),
        (F.count_if(failed) > 0).alias("_failed"),
        (F.count_if(empty) > 0).alias("_empty"),
        last.alias("_next"),
    )
    whole = ~F.col("_failed") & ~F.col("_next") & (F.col("_stated").isNull() | (F.col("cards") >= F.col("_stated") * LEAST_SHARE))
    if empty_fails:
        whole = whole & ~F.col("_empty")
    if most_pages is not None:
        whole = whole & (F.col("n_pages") <= most_pages)
    return out.select(*by, "n_pages", "cards", whole.alias("complete"))


def recipe_or_extracted(by_recipe: DataFrame, extracted: DataFrame, site: str) -> DataFrame:
    """Rows that recipes gave, and extracted rows of sites whose recipe gave none."""
    return by_recipe.unionByName(extracted.join(by_recipe.select(site), site, "left_anti").select(by_recipe.columns))


def without_own_reposts(batch: DataFrame, table: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first batch row of each key that no active row of table has; rows with a null key all stay."""
    keyed = batch.withColumn("_key", key)
    active = table.where("active").select(key.alias("_key"))
    first = first_per_key(keyed.where("_key IS NOT NULL"), ["_key"], order).join(active, "_key", "left_anti")
    return first.unionByName(keyed.where("_key IS NULL")).select(batch.columns)


def repost_moves(batch: DataFrame, table: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """id, url: where the latest inactive row of a key moves to: the first new url of the key in the batch."""
    old = table.where("NOT active").select(key.alias("_key"), "id", "first_seen").where("_key IS NOT NULL")
    old = old.groupBy("_key").agg(F.max_by("id", F.struct("first_seen", "id")).alias("id"))
    new = batch.join(table.select("url"), "url", "left_anti").withColumn("_key", key).where("_key IS NOT NULL")
    return old.join(first_per_key(new, ["_key"], order).select("_key", "url"), "_key").select("id", "url")
