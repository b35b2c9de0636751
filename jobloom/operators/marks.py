"""What people set on single postings: hidden or shown, corrected fields, and postings that are over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_URL = 2048


def _trimmed(marks: DataFrame) -> DataFrame:
    """marks with url and source trimmed, a blank source null; those without url, or with one longer than MOST_URL, are left out."""
    named = marks.withColumns({"url": F.trim("url"), "source": F.nullif(F.trim("source"), F.lit(""))})
    return named.where((F.col("url") != "") & (F.length("url") <= MOST_URL))


def set_hidden(table: DataFrame, marks: DataFrame) -> DataFrame:
    """table with hidden as the last mark (url, source, hidden, at) says that is for a row.

    A mark without source is for the rows of its url of every source, as mirrored postings go as one.
    Defined cases: marks without url, hidden or at are left out; of marks of one time, one that hides
    counts; rows without marks, and without url, stay as they are.
    """
    said = _trimmed(marks).where("hidden IS NOT NULL AND at IS NOT NULL")
    last = F.max(F.struct("at", "hidden"))
    of_all = said.where("source IS NULL").groupBy("url").agg(last.alias("_all"))
    of_one = said.where("source IS NOT NULL").groupBy("url", "source").agg(last.alias("_one"))
    joined = table.join(of_all, "url", "left").join(of_one, ["url", "source"], "left")
    # greatest passes over nulls
    return joined.withColumn("hidden", F.coalesce(F.greatest("_all", "_one")["hidden"], "hidden")).select(table.columns)


def fix_fields(table: DataFrame, fixes: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """table with columns as fixes (url, source, at, columns) say, and url, source, outcome of each url and source that they name.

    The last fix that states a column counts for it. A fix without source is for the one row of its url:
    where several sources have that url its outcome is 'ambiguous' and nothing changes; it is 'not found'
    where no row fits, else 'updated'. Of one row's fixes with and without source, each column's later one counts.
    """
    said = _trimmed(fixes)
    rows_of = table.where("url IS NOT NULL").groupBy("url").agg(F.count("*").alias("_n"), F.collect_set("source").alias("_sources"))
    asked = said.join(rows_of, "url", "left")
    fits = F.coalesce(F.when(F.col("source").isNull(), F.col("_n") > 0).otherwise(F.array_contains("_sources", F.col("source"))), F.lit(False))
    outcome = F.when(~fits, "not found").when(F.col("source").isNull() & (F.col("_n") > 1), "ambiguous").otherwise("updated")
    judged = asked.withColumn("outcome", outcome)
    # one row has the url where a fix names no source
    known = judged.where("outcome = 'updated'").withColumn("_s", F.coalesce("source", F.get("_sources", F.lit(0))))
    latest = [F.max(F.when(F.col(c).isNotNull(), F.struct("at", F.col(c).alias("value")))).alias(f"_{c}") for c in columns]
    new = known.groupBy("url", "_s").agg(*latest).withColumnRenamed("_s", "_source")
    joined = table.join(new.withColumnRenamed("url", "_url"), (F.col("url") == F.col("_url")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    fixed = joined.withColumns({c: F.coalesce(F.col(f"_{c}")["value"], c) for c in columns}).select(table.columns)
    return fixed, judged.select("url", "source", "outcome").distinct()


def deactivate(table: DataFrame, urls: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """table with the named urls of a source inactive and dead, and url, deactivated of each; what is unknown or inactive already is not deactivated."""
    named = urls.select("url").where("url IS NOT NULL").distinct()
    hit = table.where((F.col("source") == source) & F.col("active")).select("url").join(named, "url", "left_semi").distinct().withColumn("_hit", F.lit(True))
    joined = table.join(hit, "url", "left")
    gone = F.coalesce(F.col("_hit") & (F.col("source") == source) & F.col("active"), F.lit(False))
    changed = joined.withColumns({"active": F.col("active") & ~gone, "sweep_dead": F.col("sweep_dead") | gone}).select(table.columns)
    return changed, named.join(hit, "url", "left").select("url", F.coalesce("_hit", F.lit(False)).alias("deactivated"))
