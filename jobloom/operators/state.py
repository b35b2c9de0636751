"""Mutations as pure functions of a snapshot and a change; each gives the new snapshot.

Postings have source, url, first_seen, active and sweep_dead. Every function is idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.functions.documents import same_json
from jobloom.functions.urls import url_path
from jobloom.operators.cleaning import first_per_key

GRACE_DAYS = 3
#: Sources that a crawl's runs may name to be sent to all tasks.
MOST_SOURCES = 100_000
REVIVE_DAYS = 45
ARCHIVE_DAYS, TIME_BASED_ARCHIVE_DAYS = 60, 30


def insert_absent(table: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """table and the first batch row of each key that it lacks; is_new tells them apart."""
    fresh = first_per_key(batch, keys, order).join(table.select(keys), keys, "left_anti").select(table.columns)
    return table.withColumn("is_new", F.lit(False)).unionByName(fresh.withColumn("is_new", F.lit(True)))


def fill_upsert(table: DataFrame, batch: DataFrame, keys: list[str], fills: dict[str, Column]) -> DataFrame:
    """table and batch by key: a column in fills takes the batch's value only where its condition on the table holds."""
    new = batch.select(*keys, *[F.col(c).alias(f"_{c}") for c in table.columns if c not in keys], F.lit(True).alias("_new"))
    old = table.withColumn("_old", F.lit(True))
    for c, empty in fills.items():
        old = old.withColumn(f"_empty_{c}", empty)
    both = old.join(new, keys, "full")
    columns = []
    for c in table.columns:
        if c in keys:
            columns.append(F.col(c))
        elif c in fills:
            kept = F.when(F.col(f"_empty_{c}"), F.coalesce(f"_{c}", c)).otherwise(F.col(c))
            columns.append(F.when(F.col("_old"), kept).otherwise(F.col(f"_{c}")).alias(c))
        else:
            columns.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c))
    return both.select(columns)


def reconcile(table: DataFrame, found: DataFrame, runs: DataFrame, as_of: str, sticky: list[str], grace_days: int = GRACE_DAYS, confirmed: DataFrame | None = None) -> DataFrame:
    """active and sweep_dead after crawls. found: source, url; runs: source, complete, empty_is_valid.

    A found posting is active again, unless its source is sticky and a sweep killed it. Of a complete run,
    postings older than the grace that were not found go inactive. A run that found nothing changes
    nothing, unless it is complete and that is valid. With confirmed (source, url), only postings in it go inactive.
    """
    seen = found.select("source", "url").distinct().withColumn("_found", F.lit(True))
    ran = runs.join(seen.groupBy("source").agg(F.count("*").alias("_n")), "source", "left")
    counts = (F.coalesce("_n", F.lit(0)) > 0) | (F.col("complete") & F.col("empty_is_valid"))
    ran = ran.select("source", F.col("complete").alias("_complete"), counts.alias("_counts"))
    # one row a source: a dimension, if it is no larger than that
    ran = F.broadcast(ran) if runs.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES else ran
    joined = table.join(seen, ["source", "url"], "left").join(ran, "source", "left")
    dead_for_sure = F.lit(True)
    if confirmed is not None:
        joined = joined.join(confirmed.select("source", "url").distinct().withColumn("_dead", F.lit(True)), ["source", "url"], "left")
        dead_for_sure = F.col("_dead").isNotNull()
    hit = F.col("_counts") & F.coalesce("_found", F.lit(False)) & ~(F.col("source").isin(*sticky) & F.col("sweep_dead"))
    old = F.col("first_seen") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {grace_days} DAYS")
    missed = F.col("_counts") & F.col("_complete") & F.col("_found").isNull() & old & dead_for_sure
    active = F.when(hit, True).when(missed, False).otherwise(F.col("active"))
    dead = F.when(hit, False).otherwise(F.col("sweep_dead"))
    return joined.withColumns({"active": active, "sweep_dead": dead}).select(table.columns)


def _pairs(old: DataFrame, new: DataFrame, key: Column) -> DataFrame:
    """source, url, _to: old rows and new urls of one key, one to one; a null key pairs nothing."""
    new = new.withColumn("_key", key).where("_key IS NOT NULL")
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy("source", "_key").orderBy("url")))
    rank = Window.partitionBy("source", "_key").orderBy(F.desc("active"), F.desc("first_seen"), "url")
    old = old.withColumn("_key", key).where("_key IS NOT NULL").withColumn("_n", F.row_number().over(rank))
    return old.select("source", "url", "_key", "_n").join(new.withColumnRenamed("url", "_to"), ["source", "_key", "_n"]).select("source", "url", "_to")


def migrate_urls(table: DataFrame, batch: DataFrame, key: Column, *others: Column) -> DataFrame:
    """Old rows take the batch's url with the same stable key, one to one; first_seen stays, and the row is active.

    Urls of the batch that the table has, and rows whose url the batch still lists, take no part. Of
    several old rows, active ones and then the latest go first. What one key has left is tried by the next of `others`.
    """
    batch = batch.select("source", "url").distinct()
    new = batch.join(table, ["source", "url"], "left_anti")
    old = table.join(batch, ["source", "url"], "left_anti").select("source", "url", "active", "first_seen")
    pairs = _pairs(old, new, key)
    for other in others:
        left = old.join(pairs, ["source", "url"], "left_anti")
        untaken = new.join(pairs.select("source", F.col("_to").alias("url")), ["source", "url"], "left_anti")
        pairs = pairs.unionByName(_pairs(left, untaken, other))
    moved = table.join(pairs, ["source", "url"], "left")
    is_moved = F.col("_to").isNotNull()
    changes = {"url": F.coalesce("_to", "url"), "active": F.col("active") | is_moved, "sweep_dead": F.col("sweep_dead") & ~is_moved}
    return moved.withColumns(changes).select(table.columns)


def batch_update(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows named in changes take its values; a null there keeps the old one."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return table.join(new, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(table.columns)


def is_dead(status: Column, url: Column, final_url: Column, body: Column, redirects: Column, banner: Column) -> Column:
    """Verdict of one probe: 404; another path after a redirect, where that counts; a banner in a 200 body."""
    moved = redirects & status.between(200, 399) & (url_path(url) != url_path(final_url))
    closed = (status == 200) & banner.isNotNull() & F.lower(body).contains(banner)
    return F.coalesce(status == 404, F.lit(False)) | F.coalesce(moved, F.lit(False)) | F.coalesce(closed, F.lit(False))


def sweep(table: DataFrame, probes: DataFrame) -> DataFrame:
    """Active rows that both probes call dead go inactive and are marked. probes: source, url, dead1, dead2; absent is alive."""
    joined = table.join(probes.select("source", "url", "dead1", "dead2"), ["source", "url"], "left")
    dead = F.col("active") & F.coalesce(F.col("dead1") & F.col("dead2"), F.lit(False))
    changes = {"active": F.col("active") & ~dead, "sweep_dead": F.col("sweep_dead") | dead}
    return joined.withColumns(changes).select(table.columns)


def revive(table: DataFrame, probes: DataFrame, as_of: str, sole: list[str], excluded: list[str], most_days: int = REVIVE_DAYS) -> DataFrame:
    """Inactive rows that only a sweep closed come back if both probes answered and call them alive."""
    joined = table.join(probes.select("source", "url", "dead1", "dead2", "answered"), ["source", "url"], "left")
    ours = F.col("sweep_dead") | F.col("source").isin(*sole)
    young = F.col("first_seen") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {most_days} DAYS")
    well = F.coalesce(F.col("answered") & ~F.col("dead1") & ~F.col("dead2"), F.lit(False))
    back = ~F.col("active") & ours & young & well & ~F.col("source").isin(*excluded)
    changes = {"active": F.col("active") | back, "sweep_dead": F.col("sweep_dead") & ~back}
    return joined.withColumns(changes).select(table.columns)


def expire(table: DataFrame, source: str, as_of: str, days: int) -> DataFrame:
    """Rows of a pushed source go inactive after so many days."""
    old = (F.col("source") == source) & (F.col("first_seen") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    return table.withColumn("active", F.col("active") & ~old)


def to_archive(source: Column, active: Column, first_seen: Column, as_of: str, time_based: list[str]) -> Column:
    """Whether a posting goes to the archive; the others are what the table keeps."""
    age = lambda days: first_seen < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return (source.isin(*time_based) & age(TIME_BASED_ARCHIVE_DAYS)) | (~active & age(ARCHIVE_DAYS))


def upsert_or_delete(table: DataFrame, change: DataFrame, keys: list[str], flags: list[str], kept: str, empty: str = "{}") -> DataFrame:
    """Changed rows replace old ones and go if all flags are false; `kept` keeps its old value where the new one is empty, however that is written."""
    old = table.select(*keys, F.col(kept).alias("_old"))
    is_empty = F.col(kept).isNotNull() & same_json(F.col(kept), F.lit(empty))
    new = change.join(old, keys, "left").withColumn(kept, F.when(is_empty, F.coalesce("_old", kept)).otherwise(F.col(kept)))
    some = F.lit(False)
    for flag in flags:
        some = some | F.col(flag)
    return table.join(change, keys, "left_anti").unionByName(new.where(some).select(table.columns))


def appended(table: DataFrame, new: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """table with rows added to it: columns that new lacks, and nulls in those with a default, take the default."""
    filled = []
    for field in table.schema.fields:
        default = F.lit(defaults.get(field.name)).cast(field.dataType)
        filled.append((F.coalesce(F.col(field.name), default) if field.name in new.columns else default).cast(field.dataType).alias(field.name))
    return table.unionByName(new.select(*filled))


def owner_update(table: DataFrame, changes: DataFrame, key: str, owner: str, fields: list[str]) -> DataFrame:
    """Fields of rows whose id and owner both match a change; null changes leave a field as it is."""
    new = changes.select(key, owner, *[F.col(c).alias(f"_{c}") for c in fields])
    joined = table.join(new, [key, owner], "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).select(table.columns)


def streaks(sites: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """sites (site, fail_streak, last_ok) after runs (site, ok): a good run ends the streak, a bad one adds to it."""
    joined = sites.join(runs.select("site", F.col("ok").alias("_ok")), "site", "left")
    streak = F.when(F.col("_ok"), 0).when(~F.col("_ok"), F.col("fail_streak") + 1).otherwise(F.col("fail_streak"))
    last = F.when(F.col("_ok"), F.lit(as_of).cast("timestamp")).otherwise(F.col("last_ok"))
    return joined.withColumns({"fail_streak": streak.cast("int"), "last_ok": last}).select(sites.columns)


def split_known(rows: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """rows with is_known: whether the table has their key."""
    mark = known.select(*key).distinct().withColumn("_known", F.lit(True))
    return rows.join(mark, key, "left").withColumn("is_known", F.col("_known").isNotNull()).drop("_known")


def by_priority(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """The union of parts with one row a key, that of the earliest part, tagged with its number as origin."""
    tagged = parts[0].withColumn("origin", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        tagged = tagged.unionByName(part.withColumn("origin", F.lit(k)))
    columns = [c for c in tagged.columns if c not in key]
    best = tagged.groupBy(*key).agg(F.min(F.struct("origin", *[c for c in columns if c != "origin"])).alias("best"))
    return best.select(*key, *[F.col(f"best.{c}").alias(c) for c in columns])


def looked_up(rows: DataFrame, key: str, first: DataFrame, second: DataFrame, value: str) -> DataFrame:
    """rows with value by key from the first dimension, else from the second."""
    sides = [d.select(key, F.col(value).alias(f"_{k}")).dropDuplicates([key]) for k, d in enumerate((first, second))]
    return rows.join(sides[0], key, "left").join(sides[1], key, "left").withColumn(value, F.coalesce("_0", "_1")).drop("_0", "_1")


def same_whatever_case(rows: DataFrame, others: DataFrame, column: str) -> DataFrame:
    """Rows whose column equals one of the others' but for case."""
    wanted = others.select(F.lower(column).alias("_lower")).distinct()
    return rows.join(wanted, F.lower(rows[column]) == F.col("_lower"), "left_semi")
