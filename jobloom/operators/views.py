"""Views of the faceted list and of reviews: search, modes, tracks, order and notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.levels import is_mid, is_senior, says_junior, suits_junior, suits_medior
from jobloom.functions.text import normalize_text, normalize_whitespace


def local_day(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def searched(fields: list[Column], live: str | None, saved: list[str]) -> Column:
    """Whether a field holds the live search; saved searches count, any of them, only without a live one."""
    holds = lambda needle: reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False)) for c in fields])
    if live and live.strip():
        return holds(live.strip())
    return reduce(lambda a, b: a | b, map(holds, saved)) if saved else F.lit(True)


def intern_mode(title: Column, experience: Column, source: Column, keywords: list[str], sources: list[str]) -> Column:
    """A keyword anywhere in title or experience and no 'junior' in the title, or a source for interns."""
    t, e, s = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, experience, source))
    said = reduce(lambda a, b: a | b, [t.contains(k) | e.contains(k) for k in keywords])
    return (said & ~t.contains("junior")) | reduce(lambda a, b: a | b, [s.contains(x) for x in sources])


def track(title: Column, experience: Column) -> Column:
    """junior, medior or any: the level that title and experience leave open is any; seniors have none."""
    e = F.trim(F.lower(F.coalesce(experience, F.lit(""))))
    junior = e.rlike("junior|diákmunka|diakmunka|gyakornok") | e.rlike(r"(^|[^0-9])(0|1)([^0-9]|$)")
    medior = e.contains("medior") | is_mid(title)
    return F.when(is_senior(experience, accents=True), None).when(medior, "medior").when(junior, "junior").otherwise("any")


def on_track(title: Column, description: Column, source: Column, experience: Column, keywords: list[str], sources: list[str], junior: bool, medior: bool) -> Column:
    """Whether a posting shows in the junior or medior list, or in both.

    Sources for interns and experience with an intern's keyword never do, nor does a title with one unless the experience
    says junior. Where a text says medior and the experience does not say junior, the medior list alone has it.
    """
    t, d, s, e = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, description, source, experience))
    any_of = lambda x, words: reduce(lambda a, b: a | b, [x.contains(w) for w in words], F.lit(False))
    candidate = ~any_of(s, sources) & ~any_of(e, keywords) & (says_junior(experience) | ~any_of(t, keywords))
    only_medior = (t.contains("medior") | d.contains("medior")) & ~says_junior(experience)
    shows = (suits_junior(experience) & F.lit(junior)) | (suits_medior(experience) & F.lit(medior))
    return candidate & F.when(only_medior, F.lit(medior)).otherwise(shows)


def shown_source(source: Column, prefix: str = "AI - ", bucket: str = "AI-scraped") -> Column:
    """Sources with the prefix show as one bucket."""
    return F.when(source.startswith(prefix), bucket).otherwise(source)


def of_sources_chosen(source: Column, include: list[str], exclude: list[str], buckets: dict[str, str]) -> Column:
    """Sources in include, or without any the sources not in exclude; a bucket stands for all sources with its prefix as well."""
    shown = lambda key: (source == key) | source.startswith(buckets[key]) if key in buckets else source == key
    any_of = lambda keys: reduce(lambda a, b: a | b, [F.coalesce(shown(k), F.lit(False)) for k in keys])
    if include:
        return any_of(include)
    return ~any_of(exclude) if exclude else F.lit(True)


def of_labels_chosen(labels: Column, include: list[str], exclude: list[str], none: str | None = None) -> Column:
    """Rows with a label in include, or without any include the rows with none of exclude; `none` stands for rows without labels."""
    mine = F.coalesce(labels, F.array().cast("array<string>"))
    if none is not None:
        mine = F.when(F.size(mine) == 0, F.array(F.lit(none))).otherwise(mine)
    some = lambda keys: F.arrays_overlap(mine, F.array(*[F.lit(k) for k in keys]))
    if include:
        return some(include)
    return ~some(exclude) if exclude else F.lit(True)


def awake(states: list[str], loaded: DataFrame, label: str = "label") -> list[str]:
    """The chosen labels that the loaded rows have; the others sleep until a row has them. One row a chosen label comes to the driver."""
    return [r[label] for r in loaded.where(F.col(label).isin(*states)).select(label).distinct().orderBy(label).collect()] if states else []


# The programmes that each mode of the reviews shows.
PROGRAMMES = {"MI": ["MI"], "MI_BOTH": ["MI", "MIMB"], "MB": ["MB"], "MB_BOTH": ["MB", "MIMB"], "BOTH": ["MI", "MB", "MIMB"]}


def of_semester(semester: Column, chosen: str, mine: Column) -> Column:
    """all; mine, the viewer's own; none, those without a semester; or the one named."""
    if chosen == "all":
        return F.lit(True)
    if chosen == "mine":
        return F.coalesce(mine, F.lit(False))
    said = F.coalesce(semester.cast("string"), F.lit(""))
    return said.isin("", "N/A") if chosen == "none" else said == chosen


def of_programme(programme: Column, mode: str) -> Column:
    """Programmes that a mode shows, whatever their case; an unknown mode shows all three."""
    return F.upper(F.coalesce(programme, F.lit(""))).isin(*PROGRAMMES.get(mode, PROGRAMMES["BOTH"]))


# What stands for no author.
NOBODY = ["N/A", "placeholder"]


def programmes_by_subject(reviews: DataFrame, name: str, user: str, programme: str, seq: str) -> DataFrame:
    """name (normalised), programme, n of each subject of reviews.

    Reviews by somebody decide: MIMB where they name both programmes, else MI if any does, else MB. Where the
    first row is the only such review, or there is none, the programme stays as the first row says it.
    """
    real = F.col(user).isNotNull() & (F.trim(F.col(user)) != "") & ~F.col(user).isin(*NOBODY)
    said = F.upper(F.coalesce(F.col(programme), F.lit("MI")))
    of = lambda k: F.coalesce(F.max(F.when(real, said.isin(k, "MIMB"))), F.lit(False))
    groups = reviews.groupBy(normalize_whitespace(F.col(name)).alias("name")).agg(
        of("MI").alias("mi"), of("MB").alias("mb"), F.count_if(real).alias("n"), F.min_by(F.struct(real.alias("real"), said.alias("said")), seq).alias("first")
    )
    alone = (F.col("n") == 0) | ((F.col("n") == 1) & F.col("first.real"))
    label = F.when(F.col("mi") & F.col("mb"), "MIMB").when(alone, F.col("first.said")).when(F.col("mi"), "MI").otherwise("MB")
    return groups.select("name", label.alias("programme"), "n")


def review_search(name: Column, user: Column, needle: str) -> Column:
    """Search in name and user whatever the case and accents."""
    wanted = normalize_text(F.lit(needle))
    return normalize_text(name).contains(wanted) | normalize_text(user).contains(wanted)


def file_order(is_folder: Column, name: Column) -> list[Column]:
    """Folders first, then by the number that a name begins with (9999 without), then by name as people sort: letters before case and accents."""
    number = F.coalesce(F.nullif(F.regexp_extract(name, r"^(\d+)", 1), F.lit("")).try_cast("double"), F.lit(9999.0))
    return [is_folder.desc(), number.asc(), F.collate(name, "UNICODE").asc()]


def notes_for(title: Column, notes: dict[str, str]) -> Column:
    """Notes whose key the title holds, in the order of the notes."""
    t = F.lower(title)
    return F.array_compact(F.array(*[F.when(t.contains(k.lower()), F.lit(v)) for k, v in notes.items()]))


def flattened(rows: DataFrame, items: str, group: str) -> DataFrame:
    """Each item of an array column, or the items of its group if it has one."""
    one = F.explode(items).alias("item")
    inner = F.explode(F.coalesce(F.col(f"item.{group}"), F.array(F.struct(F.col("item.name").alias("name"), F.col("item.url").alias("url")))))
    return rows.select("*", one).select(*rows.columns, inner.alias("entry")).drop(items)


def truncated_list(rows: DataFrame, needle: str, column: str, most: int = 100) -> DataFrame:
    """n, the matching rows, and the first `most` of their values; the needle's wildcards work."""
    match = F.lower(column).like(f"%{needle.lower()}%")
    found = rows.where(match)
    first = found.orderBy(column).limit(most).agg(F.sort_array(F.collect_list(column)).alias("first"))
    # one row on either side
    return found.agg(F.count("*").alias("n"), F.lit(1).alias("_one")).join(first.withColumn("_one", F.lit(1)), "_one").drop("_one")
