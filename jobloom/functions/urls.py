"""URLs as Column expressions over the common grammar; hosts are lower-cased, escapes are left as they are."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import once

# Query parameters that never tell pages apart.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid"]
# Town slugs that stand before a posting's number without a meaning.
TOWN_SLUGS = [
    "budapest", "debrecen", "szeged", "pecs", "gyor", "miskolc", "kecskemet", "szekesfehervar", "nyiregyhaza", "szombathely", "veszprem",
    "eger", "sopron",
]
_VALID = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+"


def is_url(url: Column) -> Column:
    return F.coalesce(url.rlike(_VALID), F.lit(False))


_DOTS = r"(?i)(^|/)(?:\.|%2e){1,2}(/|$)"


def url_parts(url: Column) -> Column:
    """scheme and authority in lower case, path, query with its ? and fragment with its #; each '' if it is not there."""
    after = lambda s, part, more=1: F.substr(s, F.length(part) + more)

    def of_rest(said: Column) -> Column:
        rest = F.when(said["scheme"] == "", said["head"]).otherwise(after(said["head"], said["scheme"], 2))
        host = F.when(rest.startswith("//"), F.substring_index(F.substr(rest, F.lit(3)), "/", 1))
        path = once(F.struct(rest.alias("rest"), host.alias("host")), lambda x: F.struct(F.coalesce(F.lower(x["host"]), F.lit("")).alias("authority"), F.coalesce(after(x["rest"], x["host"], 3), x["rest"]).alias("path")))
        return F.struct(F.lower(said["scheme"]).alias("scheme"), path["authority"].alias("authority"), path["path"].alias("path"), said["query"].alias("query"), said["fragment"].alias("fragment"))

    def of_head(said: Column) -> Column:
        scheme = F.regexp_extract(said["head"], r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
        return once(F.struct(said["head"].alias("head"), scheme.alias("scheme"), after(said["main"], said["head"]).alias("query"), said["fragment"].alias("fragment")), of_rest)

    main = F.struct(F.substring_index(url, "#", 1).alias("main"), after(url, F.substring_index(url, "#", 1)).alias("fragment"))
    return once(main, lambda x: once(F.struct(x["main"].alias("main"), F.substring_index(x["main"], "?", 1).alias("head"), x["fragment"].alias("fragment")), of_head))


def without_dots(path: Column) -> Column:
    """A path whose segments . and .., escaped ones too, have been followed; .. at the root stays there."""
    plain = lambda x: F.replace(F.lower(x), F.lit("%2e"), F.lit("."))
    up, here = (lambda x: plain(x) == ".."), (lambda x: plain(x) == ".")

    def put(held: Column, segment: Column) -> Column:
        above = F.when(F.size(held) > 1, F.slice(held, 1, F.size(held) - 1)).otherwise(held)
        return F.when(here(segment), held).when(up(segment), above).otherwise(F.concat(held, F.array(segment)))

    def followed(segments: Column) -> Column:
        last = F.element_at(segments, -1)
        kept = F.aggregate(segments, F.array().cast("array<string>"), put)
        return F.array_join(F.when(here(last) | up(last), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")

    return F.when(path.rlike(_DOTS), once(F.split(path, "/"), followed)).otherwise(path)


def _authority(parts: Column) -> Column:
    """Without the port that the scheme has anyway, or an empty one."""
    usual = F.when(parts["scheme"] == "https", ":443").when(parts["scheme"] == "http", ":80").otherwise(":")
    bare = F.regexp_replace(parts["authority"], ":$", "")
    return F.when(bare.endswith(usual), F.left(bare, F.length(bare) - F.length(usual))).otherwise(bare)


def _written(parts: Column, query: Column, fragment: Column) -> Column:
    path = F.when(parts["path"] == "", "/").otherwise(without_dots(parts["path"]))
    return F.concat(parts["scheme"], F.lit("://"), _authority(parts), path, query, fragment)


def resolved_url(base: Column, link: Column) -> Column:
    """The address of a link on the page at base, its dots followed; null if there is none.

    Defined cases: white space around a link and line breaks in it go; a link with a scheme stands for itself, one that
    begins with // takes the base's scheme, with / its host, with ? its path as well, and any other begins in its
    folder; an empty one is the base without its fragment; a scheme without // (mailto:) is left as it is; a
    relative link on what is no url, and a null, is null.
    """

    def of(sides: Column) -> Column:
        b, r, own = sides["base"], sides["link"], sides["own"]
        folder = F.regexp_extract(b["path"], "(?s)^(.*/)", 1)
        folder = F.when(folder == "", "/").otherwise(folder)
        path = F.when(r["path"] == "", b["path"]).when(r["path"].startswith("/"), r["path"]).otherwise(F.concat(folder, r["path"]))
        query = F.when((r["path"] == "") & (r["query"] == ""), b["query"]).otherwise(r["query"])
        merged = F.struct(b["scheme"].alias("scheme"), b["authority"].alias("authority"), path.alias("path"))
        across = F.struct(b["scheme"].alias("scheme"), r["authority"].alias("authority"), r["path"].alias("path"))
        based = (b["scheme"] != "") & (b["authority"] != "")
        return (
            F.when((r["scheme"] != "") & (r["authority"] != ""), _written(r, r["query"], r["fragment"]))
            .when(r["scheme"] != "", own)
            .when(based & (r["authority"] != ""), _written(across, r["query"], r["fragment"]))
            .when(based, _written(merged, query, r["fragment"]))
        )

    clean = F.regexp_replace(F.trim(F.regexp_replace(link, r"^[\x00-\x20]+|[\x00-\x20]+$", "")), r"[\t\r\n]", "")
    return once(F.struct(url_parts(base).alias("base"), url_parts(clean).alias("link"), clean.alias("own")), of)


def canonical_url(url: Column, drop: list[str] = TRACKING, keep_fragment: bool = False, else_null: bool = False, http_only: bool = False) -> Column:
    """url without the parameters in drop, its dots followed, without its scheme's own port and its fragment; what is no url stays, or is null with else_null."""

    def of(parts: Column) -> Column:
        left = F.filter(F.split(F.substr(parts["query"], F.lit(2)), "&"), lambda p: ~F.substring_index(p, "=", 1).isin(*drop) & (p != ""))
        query = once(left, lambda x: F.when(F.size(x) > 0, F.concat(F.lit("?"), F.array_join(x, "&"))).otherwise(""))
        whole = _written(parts, query, parts["fragment"] if keep_fragment else F.lit(""))
        return F.when(parts["scheme"].isin("http", "https"), whole) if http_only else whole

    # most addresses have nothing to change
    same = url.rlike(r"^https?://[a-z0-9.-]+/[^?#%\s]*$") & ~url.contains("/.")
    said = F.when(same, url).when(is_url(url), once(url_parts(url), of))
    return said if else_null else F.coalesce(said, url)


def without_town(url: Column) -> Column:
    """The town slug before a posting's number goes."""
    return F.regexp_replace(url, rf"(?i)-(?:{'|'.join(TOWN_SLUGS)})-(\d+)(/pro)?/?$", "-$1$2")


def url_host(url: Column) -> Column:
    return F.when(is_url(url), F.lower(F.regexp_extract(url, r"^[^:]+://(?:[^/?#@]*@)?([^/?#:]+)", 1)))


def url_path(url: Column) -> Column:
    """Path without trailing slashes, '/' for the root, null for what is no url."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:]+://[^/?#]+([^?#]*)", 1), "/+$", "")
    return F.when(is_url(url), F.when(path == "", "/").otherwise(path))


def source_of(url: Column) -> Column:
    """The name in a host: its label before the top level, or before a second-level suffix such as co.uk."""
    labels = F.split(F.regexp_replace(url_host(url), r"^www\.", ""), r"\.")
    n = F.size(labels)
    second = (n >= 3) & F.element_at(labels, -2).isin("co", "com", "org", "net", "gov", "ac")
    return F.when(n < 2, labels[0]).when(second, F.get(labels, n - 3)).otherwise(F.get(labels, n - 2))


def stable_key(url: Column) -> Column:
    """The url without the number at its end: what listings of one posting share when its number changes."""
    return F.regexp_replace(canonical_url(url), r"-\d+/?(\?.*)?$", "")


# What the variants drop besides TRACKING.
LISTING_PARAMETERS = ["sessionId", "hash", "keyword"]
NETWORK_PARAMETERS = ["trackingId", "pageNum", "position", "refId"]


# Paths of a job board that lead to no posting.
JUNK_PATHS = ["/fiokom", "/csomagok", "/hirdetesfeladas", "/job-category", "/terulet", "/tag", "/category"]


def is_junk(url: Column, prefixes: list[str] = JUNK_PATHS) -> Column:
    """The path begins with one of the prefixes, or this is no url; upper case differs."""
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]+([^?#]*)", 1)
    return F.coalesce(~is_url(url) | path.rlike("^(?:" + "|".join(re.escape(p) for p in prefixes) + ")"), F.lit(True))


def listing_url(url: Column, host: str = "www.profession.hu", prefix: str = "/allas/") -> Column:
    """Canonical, without search parameters, and on the listing's own paths without the town before the number."""
    own = (url_host(url) == host) & F.lower(F.regexp_extract(url, r"^[^:]+://[^/?#]+([^?#]*)", 1)).startswith(prefix)
    path = F.regexp_extract(url, r"^([^?#]*)", 1)
    rest = F.substr(url, F.length(path) + 1)
    return canonical_url(F.when(own, F.concat(without_town(path), rest)).otherwise(url), [*TRACKING, *LISTING_PARAMETERS])


def network_url(url: Column, host: str = "linkedin.com", prefix: str = "/jobs/view/") -> Column:
    """A posting's host and path; others canonical without the network's parameters."""
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]+([^?#]*)", 1)
    own = is_url(url) & url_host(url).contains(host) & path.startswith(prefix)
    return F.when(own, F.concat(F.lit("https://"), url_host(url), path)).otherwise(canonical_url(url, [*TRACKING, *NETWORK_PARAMETERS]))


def network_key(url: Column, host: str = "linkedin.com", prefix: str = "/jobs/view/") -> Column:
    """What postings of one title share on a network: the path without the number at its end, under one host."""
    clean = network_url(url, host, prefix)
    slug = F.regexp_replace(F.regexp_extract(clean, rf"{prefix}([^/]*)", 1), r"-\d+$", "")
    own = is_url(url) & url_host(url).contains(host) & F.regexp_extract(url, r"^[^:]+://[^/?#]+([^?#]*)", 1).startswith(prefix)
    return F.when(own, F.concat(F.lit(f"https://www.{host}{prefix}"), slug)).otherwise(clean)


def on_host(url: Column, host: str) -> Column:
    """The url's host is this one; false for what is no url."""
    return F.coalesce(url_host(url) == host, F.lit(False))


def key_by_source(source: Column, url: Column, patterns: dict[str, str]) -> Column:
    """The first group of the pattern of the url's source, where it matches: what a posting's urls share. Others are the url."""
    out = url
    for name, pattern in patterns.items():
        out = F.when((source == name) & url.rlike(pattern), F.regexp_extract(url, pattern, 1)).otherwise(out)
    return out


# By source, addresses whose number changes when a posting is refreshed. Groups are what stays.
VOLATILE_FORMS = {
    "profession": r"^(.*)-\d{4,}$",
    "kh": r"^(.*)-\d+$",
    "erste": r"^(.*)-\d+$",
    "raiffeisen": r"^(.*)-\d+$",
    "muisz": r"^(.*)--\d+$",
    "zyntern": r"^(https://zyntern\.com/job/)\d+-(.+)$",
    "schonherz": r"^(.*/)\d+-([^/]+)$",
    "mbh": r"^(.*/JobAdvertisement/)\d+(/.+)$",
    "mfb": r"^(.*/JobAdvertisement/)\d+(/.+)$",
    "smartrecruiters": r"^(https://jobs\.smartrecruiters\.com/[^/]+/)\d+-(.+)$",
    "dreamjobs": r"^https://dreamjobs\.hu/[a-z]{2}/job/([^/]+)/(.+)-\d+$",
    "otp": r"^https://karrier\.otpbank\.hu(?:/otp|/leanyvallalatok)?/job/[^/]+/(\d+)/?$",
}
# Sources whose titles change under a number that stays.
NUMBERED = ["kh", "erste", "raiffeisen"]


def volatile_key(source: Column, url: Column, forms: dict[str, str] | None = None) -> Column:
    """What addresses of one posting share while its number changes: the groups of its source's form, a line each; null for other addresses."""
    out = F.lit(None).cast("string")
    for name, form in (VOLATILE_FORMS if forms is None else forms).items():
        groups = [F.regexp_extract(url, form, k + 1) for k in range(re.compile(form).groups)]
        out = F.when(source == name, F.when(url.rlike(form), F.concat_ws("\n", *groups))).otherwise(out)
    return out


def number_key(source: Column, url: Column, sources: list[str] = NUMBERED) -> Column:
    """The number at the end of an address of the sources whose titles change under it; null for others."""
    return F.when(source.isin(*sources), F.nullif(F.regexp_extract(url, r"-(\d+)$", 1), F.lit("")))


def job_key(source: Column, url: Column, title: Column) -> Column:
    """Identity of a mark: by url where there is one, else by title."""
    return F.concat(F.lit("job:"), F.coalesce(source, F.lit("")), F.lit(":"), F.when(url != "", url).otherwise(F.coalesce(title, F.lit(""))))


# Parameters that a pasted address loses besides any utm_ ones, in lower case.
PASTED_PARAMETERS = ["gclid", "fbclid", "refid", "trackingid", "ebp", "referralsearchid"]


def pasted_url(url: Column, host: str = "linkedin.com", prefix: str = "/jobs/view/") -> Column:
    """A pasted address: with https:// where it has no scheme, without tracking parameters; a network's posting by its id alone.

    The fragment stays. Null and blank are ''.
    """

    def of_parts(said: Column) -> Column:
        raw, whole, parts = said["raw"], said["whole"], said["parts"]
        asked = F.regexp_extract(parts["query"], r"(?:^\?|&)currentJobId=([^&]+)", 1)
        posting = F.coalesce(F.nullif(asked, F.lit("")), F.nullif(F.regexp_extract(parts["path"], rf"^.*?{prefix}(\d+)", 1), F.lit("")))
        named = F.regexp_extract(parts["authority"], "^(?:[^@]*@)?([^:]+)", 1)
        own = (named == host) | named.endswith(f".{host}")
        noise = lambda n: F.lower(n).startswith("utm_") | F.lower(n).isin(*PASTED_PARAMETERS)
        left = F.filter(F.split(F.substr(parts["query"], F.lit(2)), "&"), lambda p: ~noise(F.substring_index(p, "=", 1)) & (p != ""))
        query = once(left, lambda x: F.when(F.size(x) > 0, F.concat(F.lit("?"), F.array_join(x, "&"))).otherwise(""))
        theirs = F.concat(F.lit(f"https://www.{host}{prefix}"), posting, F.lit("/"))
        return F.when(raw == "", "").when(~is_url(whole), raw).when(own & posting.isNotNull(), theirs).otherwise(_written(parts, query, parts["fragment"]))

    def of_raw(raw: Column) -> Column:
        whole = F.when(raw.rlike("(?i)^[a-z][a-z0-9+.-]*://"), raw).otherwise(F.concat(F.lit("https://"), raw))
        return once(whole, lambda w: once(F.struct(raw.alias("raw"), w.alias("whole"), url_parts(w).alias("parts")), of_parts))

    return once(F.trim(F.coalesce(url, F.lit(""))), of_raw)


def migrated_keys(marks: DataFrame, cached: DataFrame, most: int = 512) -> DataFrame:
    """marks (key, ...) under the key by url of the posting cached for them (key, source, url).

    A mark without a cached url or source, or whose new key is longer than `most`, keeps its key.
    """
    url = pasted_url(F.col("url"))
    new = cached.where("url <> '' AND source <> ''").select("key", job_key(F.col("source"), url, F.lit("")).alias("_new")).dropDuplicates(["key"])
    joined = marks.join(new, "key", "left")
    moved = F.when(F.length("_new") <= most, F.col("_new"))
    return joined.withColumn("key", F.coalesce(moved, "key")).select(marks.columns)
