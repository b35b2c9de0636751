"""Years of experience that a posting's page asks for, looked for where its source writes them."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.extraction import REQUIREMENTS, requirements_section, years_in
from jobloom.sources.html import _Node, padded_text, page_rows, select

# By source, the containers that hold a posting's own text.
CONTAINERS = {
    "linkedin": ".description, .job-description, #job-details, .show-more-less-html__markup",
    "profession": "#box_az-allashoz-tartozo-elvarasok",
    "bluebird": "section.tcb-post-content",
    "talent": "[class*='jobDescriptionColumn']",
}
# Sources of which all such containers count and not the first alone; whose pages carry their state as
# JSON; whose other text is never read; and whose requirements have a heading.
ALL_CONTAINERS = ["bluebird"]
WITH_STATE = ["talent"]
CONTAINER_ONLY = ["linkedin"]
WITH_SECTION = ["kuka"]
_STATE = "script#__NEXT_DATA__"
_LINKED = "script[type='application/ld+json']"
_UNSEEN = "script, style, noscript, head"


def _in_containers(pages: DataFrame) -> DataFrame:
    """page_id, seq, source, scoped, state, linked, body of pages whose source has containers; linked is an array of JSON texts."""

    def of(root: _Node, source: str) -> Iterator[tuple]:
        gone = frozenset(id(x) for x in select(root, _UNSEEN))
        fits = [x for x in select(root, CONTAINERS[source]) if id(x) not in gone]
        scoped = " ".join(x.text(True, gone) for x in fits[: None if source in ALL_CONTAINERS else 1])
        scripts = [[x.code for x in select(root, s)] if source in WITH_STATE else [] for s in (_STATE, _LINKED)]
        yield source, scoped, next(iter(scripts[0]), ""), json.dumps(scripts[1]), root.text(True, gone)

    # the address of a page plays no part, so its source takes that place
    return page_rows(pages.select("page_id", F.col("source").alias("url"), "html"), of, "source scoped state linked body")


def _in_json(state: Column, linked: Column) -> list[Column]:
    """Years in a page's own state, its properties where it has them, and in its linked data, the first block that states any; what is no JSON says nothing."""
    whole = F.try_parse_json(state)
    props = F.coalesce(F.try_variant_get(whole, "$.props.pageProps", "variant"), whole)
    blocks = F.transform(F.from_json(linked, "array<string>"), lambda b: years_in(F.to_json(F.try_parse_json(b))))
    return [years_in(F.to_json(props)), F.get(F.array_compact(blocks), F.lit(0))]


def experience_in_pages(pages: DataFrame) -> DataFrame:
    """page_id, experience of pages (page_id, source, html): the phrases of years, null if none.

    A source of CONTAINERS states them in its container, then in its state and linked data, then anywhere
    on the page, CONTAINER_ONLY in its container alone; WITH_SECTION has them below its heading alone where
    it has that heading; every other source anywhere on the page. Only pages with containers are parsed,
    each once.

    Defined cases: a null or empty html and a null source have a row with null, or what the whole page
    says; other columns are ignored; repeated page_ids have a row each.
    """
    named = F.coalesce(F.col("source").isin(*CONTAINERS), F.lit(False))
    body = padded_text(F.col("html"))
    headed = F.col("source").isin(*WITH_SECTION) & F.col("html").contains(REQUIREMENTS)
    plain = pages.where(~named).select(F.col("page_id").cast("long"), years_in(F.when(headed, padded_text(requirements_section(F.col("html")))).otherwise(body)).alias("experience"))
    parsed = _in_containers(pages.where(named & F.col("html").isNotNull()))
    elsewhere = F.when(~F.col("source").isin(*CONTAINER_ONLY), F.col("body"))
    stated = F.coalesce(years_in(F.col("scoped")), *_in_json(F.col("state"), F.col("linked")), years_in(elsewhere))
    missing = pages.where(named & F.col("html").isNull()).select(F.col("page_id").cast("long"), F.lit(None).cast("string").alias("experience"))
    return plain.unionByName(parsed.select("page_id", stated.alias("experience"))).unionByName(missing)
