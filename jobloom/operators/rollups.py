"""Daily and monthly statistics, and limits by sliding and fixed windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from jobloom.functions.levels import is_senior

INTERN_PREFIX = "intern:"


def months(spark, last: str, n: int) -> DataFrame:
    """The n months up to last (yyyy-MM-dd), as yyyy-MM."""
    spine = spark.range(1).select(F.explode(F.expr(f"sequence(add_months(date'{last}', {1 - n}), date'{last}', interval 1 month)")).alias("d"))
    return spine.select(F.date_format("d", "yyyy-MM").alias("month"))


def monthly_totals(rows: DataFrame, day: str, value: Column, spine: DataFrame) -> DataFrame:
    """Sum for each month of the spine, 0 for months without rows."""
    sums = rows.groupBy(F.date_format(F.col(day), "yyyy-MM").alias("month")).agg(F.sum(value).alias("total"))
    return spine.join(sums, "month", "left").withColumn("total", F.coalesce("total", F.lit(0)))


def category_sums(rows: DataFrame, category: str, value: str, intern: bool) -> DataFrame:
    """Sums by category, of the intern namespace with its prefix off, or of all others."""
    inside = F.col(category).startswith(INTERN_PREFIX)
    name = F.substring(category, len(INTERN_PREFIX) + 1, 10_000) if intern else F.col(category)
    return rows.where(inside if intern else ~inside).groupBy(name.alias("category")).agg(F.sum(value).alias("total"))


def daily_totals(rows: DataFrame, day: str, experience: str, intern: Column) -> DataFrame:
    """Rows of each day that are not senior, and those among them for interns."""
    return rows.where(~is_senior(F.col(experience))).groupBy(F.to_date(day).alias("day")).agg(F.count("*").alias("total"), F.count_if(intern).alias("interns"))


def returning(rows: DataFrame, user: str, ts: str, since: str) -> DataFrame:
    """Number of users seen on more than one day, the last time not before since."""
    seen = rows.groupBy(user).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    return seen.where((F.to_date("last") >= F.lit(since).cast("date")) & (F.to_date("first") < F.to_date("last"))).agg(F.count("*").alias("n"))


def target_counts(rows: DataFrame, user: str, target: str, admins: list[int]) -> DataFrame:
    """Different users of each target, admins left out."""
    return rows.where(~F.col(user).isin(*admins)).groupBy(target).agg(F.count_distinct(user).alias("n"))


#: Parts of a window of sliding_limit(): a task holds what one key has in one part, and in the part a window before.
WINDOW_PARTS = 16


def sliding_limit(events: DataFrame, key: str, ts: str, most: int, seconds: int) -> DataFrame:
    """events with hits (of the key in the window that ends with the event), allowed, and retry_after in seconds.

    Time is cut into WINDOW_PARTS parts a window. What a window holds of the parts between its first and its last is
    counted once for each key and part, before anything is shuffled; each event goes to its own part and, as context, to
    the part a window later, where they are told apart by time. So no task needs a key's whole history, and a busy
    key is as many groups as it has parts.

    Defined cases: a null key is a key; events without a time hit each other only; events of one time see each other; an
    empty table gives an empty result.
    """
    span = seconds * 1_000_000
    width = span // WINDOW_PARTS
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    own = events.withColumn("_at", at).withColumn("_part", F.floor(F.col("_at") / width)).withColumn("_kind", F.lit(0))
    timed = own.select(F.col(key), "_at", "_part").where("_at IS NOT NULL")
    earlier = timed.select(key, (F.col("_at") + span).alias("_at"), (F.col("_part") + WINDOW_PARTS).alias("_part"), F.lit(1).alias("_kind"))
    counts = timed.groupBy(key, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    later = counts.select(key, "_n", "_first", F.explode(F.sequence(F.col("_part") + 1, F.col("_part") + WINDOW_PARTS - 1)).alias("_part"))
    between = later.groupBy(key, "_part").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first")).withColumn("_kind", F.lit(2))
    both = own.unionByName(earlier, allowMissingColumns=True).unionByName(between, allowMissingColumns=True)
    group = Window.partitionBy(key, "_part")
    past = group.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    ahead = group.orderBy("_at").rangeBetween(1, Window.unboundedFollowing)
    mine, context = F.col("_kind") == 0, F.col("_kind") == 1
    # an earlier event is in the window as long as a window after it is still ahead
    in_last, in_first = F.count_if(mine).over(past), F.count_if(context).over(ahead)
    oldest = F.coalesce(F.min(F.when(context, F.col("_at") - span)).over(ahead), F.max("_first").over(group), F.min(F.when(mine, F.col("_at"))).over(past))
    hits = in_last + F.when(F.col("_at").isNull(), 0).otherwise(in_first + F.coalesce(F.max("_n").over(group), F.lit(0)))
    out = both.withColumn("hits", hits).withColumn("_oldest", oldest).where("_kind = 0")
    wait = F.ceil((F.col("_oldest") + span - F.col("_at")) / 1_000_000)
    out = out.withColumn("allowed", F.col("hits") <= most).withColumn("retry_after", F.when(F.col("hits") > most, wait))
    return out.select(*events.columns, "hits", "allowed", "retry_after")


def fixed_limit(events: DataFrame, key: str, ts: str, rows: str, most: int, seconds: int, tie: str = "event_id") -> DataFrame:
    """events with granted: what of its rows the budget of its fixed window has left; events of one time go by tie."""
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
    before = Window.partitionBy(key, "_slot").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    out = events.withColumn("_slot", slot).withColumn("_used", F.coalesce(F.sum(rows).over(before), F.lit(0)))
    return out.withColumn("granted", F.greatest(F.lit(0), F.least(F.col(rows), F.lit(most) - F.col("_used")))).drop("_slot", "_used")


def budget_granted(events: DataFrame, key: str, ts: str, tie: str, rows: str, most: int, seconds: int) -> DataFrame:
    """tie (an id) and granted: what of an event's rows the budget of its key has left.

    A window begins with the first write after the one before has ended, and only rows written are charged. Each
    window depends on the one before, so a key's events pass in order through one task, as a stream: what is held
    is one window's start and count.
    """
    span = seconds * 1_000_000
    ordered = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), tie, F.col(rows).cast("long").alias("asked"))
    schema = StructType([StructField(tie, events.schema[tie].dataType), StructField("granted", LongType())])

    def grant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, used = object(), None, 0
        for batch in batches:
            granted = []
            for k, at, asked in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "asked")), strict=True):
                if k != now or (start is not None and at - start >= span):
                    now, start, used = k, None, 0
                got = max(0, min(asked or 0, most - used))
                if got and start is None:
                    start = at
                used += got
                granted.append(got)
            yield pa.RecordBatch.from_arrays([batch.column(tie), pa.array(granted, pa.int64())], [tie, "granted"])

    return ordered.repartition("key").sortWithinPartitions("key", "at", tie).mapInArrow(grant, schema)


def category_histogram(titles: DataFrame, category: Column, categories: list[str]) -> DataFrame:
    """category and n, with a row for each of the categories even if it has no titles."""
    seed = titles.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    found = titles.groupBy(category.alias("category")).agg(F.count("*").alias("n"))
    return seed.join(found, "category", "full").withColumn("n", F.coalesce("n", F.lit(0)))


def ranked_histogram(titles: DataFrame, category: Column, categories: list[str]) -> DataFrame:
    """category, n and place (from 1) of the categories that have titles, the largest first, ties in the order of the list.

    Categories that are not in the list come after those that are, by name. The places are of one row a category.
    """
    found = titles.groupBy(category.alias("category")).agg(F.count("*").alias("n"))
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, categories)), F.col("category")), F.lit(0)), F.lit(len(categories) + 1))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), at, "category")))


def source_flags(rows: DataFrame, source: str, ok: str) -> DataFrame:
    """For each source its number of rows and whether all of them went well."""
    return rows.groupBy(source).agg(F.count("*").alias("n"), F.bool_and(ok).alias("complete"))


def found_by_source(pages: DataFrame, source: str, url: str, ok: str) -> DataFrame:
    """source, url, complete: the distinct urls that a source's pages found, each with whether all of its pages went well.

    Urls of pages that failed count as found; a source without any has one row with a null url. A bucket is
    rows and no array, so that a source of any size is split like others; a null ok is a failure.
    """
    runs = pages.groupBy(source).agg(F.bool_and(F.coalesce(F.col(ok), F.lit(False))).alias("complete"))
    found = pages.where(F.col(url).isNotNull()).select(source, url).distinct()
    return runs.withColumnRenamed(source, "_s").join(found, F.col("_s").eqNullSafe(F.col(source)), "left").select(F.col("_s").alias(source), url, "complete")


def least_rank(ids: Column, ranks: dict[int, int]) -> Column:
    """The smallest rank of the ids that have one; null if none has."""
    known = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.array_min(F.transform(ids, lambda x: F.try_element_at(known, x)))


def within_bytes(rows: DataFrame, size: str, most: int) -> DataFrame:
    """total, of the sizes that are numbers, and whether it is allowed."""
    return rows.agg(F.coalesce(F.sum(F.col(size).try_cast("long")), F.lit(0)).alias("total")).withColumn("allowed", F.col("total") <= most)


def token_cost(counts: dict[str, Column], prices: dict[str, float]) -> Column:
    """Dollars of token counts by their prices a million."""
    return sum((F.coalesce(counts[k], F.lit(0)) * F.lit(prices[k] / 1e6) for k in prices), F.lit(0.0))
