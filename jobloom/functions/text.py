"""Text as Column expressions. Word edges are ASCII throughout, whatever Java's \\b makes of accents."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.unicode import composed, plain_table

#: White space: what \s matches in Java, and the spaces and line ends beyond ASCII.
WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value evaluated once however often `of` reads it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def strip_accents(s: Column) -> Column:
    """Letters without their accents, in all alphabets that have some; combining diacritical marks go as well."""
    return F.translate(s, *plain_table())


def normalize_whitespace(s: Column) -> Column:
    """Runs of white space, no-break space included, as one space; trimmed; null as ''."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), WS, " "))


def normalize_text(s: Column) -> Column:
    """Lower case without accents, white space collapsed; null as ''."""
    return F.lower(normalize_whitespace(strip_accents(s)))


def normalize_name(s: Column) -> Column:
    """White space collapsed, letters and their marks composed, case and accents as they are; null as ''."""
    return composed(normalize_whitespace(s))


def literal(keyword: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\/-])", r"\\\1", keyword)


def has_keyword(s: Column, keywords: list[str]) -> Column:
    """Whether any keyword stands between characters other than a-z and 0-9; accented letters are edges."""
    return s.rlike(f"(?iu)(^|[^a-z0-9])({'|'.join(map(literal, keywords))})([^a-z0-9]|$)")


def has_technology(s: Column, keyword: str) -> Column:
    """As has_keyword(), but a digit may follow: HTML5, C++11."""
    return s.rlike(rf"(?iu)(^|[^a-z0-9]){literal(keyword)}([^a-z0-9]|$|\d)")


_RUN = "[a-z0-9]+"


def _shape(keyword: str, digit_may_follow: bool) -> str:
    """A pattern for all that is built like the keyword: a run for each of its runs of a-z and 0-9, and its other characters as they are."""
    parts = re.findall("[a-z0-9]+|[^a-z0-9]+", keyword)
    built = "".join(_RUN if p[0] in _ALNUM else literal(p) for p in parts)
    edge = "" if parts[-1][0] in _ALNUM else "(?![a-z])" if digit_may_follow else "(?![a-z0-9])"
    return f"(?<![a-z0-9])(?=({built}){edge})"


_ALNUM = set("abcdefghijklmnopqrstuvwxyz0123456789")


def _with_stems(found: Column) -> Column:
    """found, and of each that ends in a run of several characters what stands before a digit in that run."""
    with_digit = F.filter(found, lambda x: x.rlike("[a-z0-9][0-9][a-z0-9]*$"))
    ends = lambda x: F.filter(F.sequence(F.lit(1), F.length(x) - 1), lambda k: F.substr(x, k).rlike("^[a-z0-9][0-9][a-z0-9]*$"))
    stems = F.transform(with_digit, lambda x: F.transform(ends(x), lambda k: F.substr(x, F.lit(1), k)))
    return F.concat(found, F.flatten(stems))


def keywords_in(s: Column, keywords: list[str], digit_may_follow: bool = True) -> Column:
    """The keywords (lower case) that has_technology() finds in s, or has_keyword() without digit_may_follow, in the list's order.

    The text is read once for each shape that keywords have, whatever their number: all that is a run of a-z and 0-9,
    or that is built like node.js, machine learning or c++, is cut out and met with the keywords by hashing. A run is one
    of such characters, or what stands before a digit in one.
    """
    shapes: dict[str, list[str]] = {}
    for k in dict.fromkeys(k for k in keywords if k):
        shapes.setdefault(_RUN if re.fullmatch(_RUN, k) else _shape(k, digit_may_follow), []).append(k)
    known = lambda words: F.from_json(F.lit(json.dumps(words)), "array<string>")

    def of_shape(lower: Column, shape: str, words: list[str]) -> Column:
        cut = F.array_distinct(F.regexp_extract_all(lower, F.lit(shape), F.lit(0 if shape == _RUN else 1)))
        ends_in_run = shape == _RUN or shape.endswith(f"{_RUN}))")
        return F.array_intersect(known(words), _with_stems(cut) if digit_may_follow and ends_in_run else cut)

    if not shapes:
        return F.array().cast("array<string>")
    found = once(F.lower(s), lambda lower: F.concat(*[of_shape(lower, *x) for x in shapes.items()]))
    if len(shapes) == 1:
        return found
    places = F.from_json(F.lit(json.dumps({k: i for i, k in enumerate(keywords)})), "map<string,int>")
    ordered = F.array_sort(F.transform(found, lambda k: F.struct(F.element_at(places, k).alias("place"), k.alias("keyword"))))
    return F.transform(ordered, lambda x: x["keyword"])


def labels_array(s: Column, dictionary: list[tuple[str, str]]) -> Column:
    """Labels of the (keyword, label) pairs found in s, distinct and in the dictionary's order; one pass, and no join."""
    labels = F.from_json(F.lit(json.dumps(dict(dictionary))), "map<string,string>")
    return F.array_distinct(F.transform(keywords_in(s, [k for k, _ in dictionary]), lambda k: F.element_at(labels, k)))


def labels_in(s: Column, dictionary: list[tuple[str, str]]) -> Column:
    """labels_array() joined by ', '; null if none."""
    joined = F.array_join(labels_array(s, dictionary), ", ")
    return F.when(joined != "", joined)


def canonical_labels(items: Column, dictionary: list[tuple[str, str]]) -> Column:
    """Canonical labels of a free-text list: those whose keyword stands in it anywhere, in the dictionary's order; null if none."""
    return labels_in(items, dictionary)


def slug(s: Column) -> Column:
    """Accents stripped, other runs as '-', one '-' trimmed at each end."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(F.coalesce(s, F.lit("")))), "[^a-z0-9]+", "-"), "^-|-$", "")


def slug_keeping_accents_out(s: Column) -> Column:
    """Accented letters are separators here, not letters."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def short_slug(s: Column, most: int = 80) -> Column:
    return F.substring(slug(s), 1, most)


def strip_date_suffix(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+\d{4}\.\s*\d{2}\.\s*\d{2}\.\s*$", ""))


def strip_written_date(s: Column) -> Column:
    """s without the date at its end as it is written, one space between its parts and nothing after it; outer spaces stay."""
    return F.regexp_replace(s, r"\s+\d{4}\.\s\d{2}\.\s\d{2}\.$(?!\n)", "")


def strip_control(s: Column, most: int = 2000) -> Column:
    return F.substring(F.regexp_replace(s, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), 1, most)


def trailing_year(s: Column) -> Column:
    return F.regexp_extract(s, r"(\d{4})\s*$", 1).try_cast("int")


def title_hash(s: Column) -> Column:
    """10000 to 99999 by a polynomial of the characters' codes."""
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit((1 << 31) - 1)))
    return F.lit(10000) + total % 90000


def company_key(company: Column) -> Column:
    """First word of the normalised company, the second after 'the'."""
    words = F.split(normalize_text(company), " ")
    return F.when(words[0] == "the", F.coalesce(F.get(words, F.lit(1)), F.lit(""))).otherwise(words[0])


def split_list(s: Column) -> Column:
    """Items of a comma-joined list, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")


def append_unseen(a: Column, b: Column) -> Column:
    """a, then what of b it lacks whatever the case."""
    return F.concat(a, F.filter(b, lambda y: ~F.exists(a, lambda x: F.lower(x) == F.lower(y))))


def trim_without_accents(s: Column) -> Column:
    """Accents stripped and ends trimmed; case and inner white space stay."""
    return F.trim(strip_accents(F.coalesce(s, F.lit(""))))


def route_slug(s: Column) -> Column:
    """Accents stripped, punctuation dropped, white space and dashes as one '-'."""
    plain = F.regexp_replace(F.lower(strip_accents(F.coalesce(s, F.lit("")))), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[\s-]+", "-"), "^-|-$", "")


def plain_dashes(s: Column) -> Column:
    return F.translate(s, "–—", "--")


def encoded_newlines(s: Column) -> Column:
    return F.replace(s, F.lit("\n"), F.lit("\\n"))


def decoded_newlines(s: Column) -> Column:
    return F.replace(s, F.lit("\\n"), F.lit("\n"))


def student_job_stem(title: Column) -> Column:
    """X of 'diákmunka - X' and of 'X - diákmunka'."""
    out = F.regexp_replace(title, r"(?iu)^\s*di[áa]kmunka\s*[-–:]\s*", "")
    return F.trim(F.regexp_replace(out, r"(?iu)\s*[-–:]\s*di[áa]kmunka\s*$", ""))


def http_code(message: Column) -> Column:
    """The status in a message such as 'HTTP 404'."""
    return F.regexp_extract(message, r"(?i)\bHTTP\s*(\d{3})\b", 1).try_cast("int")


def token_expiry(token: Column) -> Column:
    """exp of a JWT's payload, in seconds; null for what is none."""
    payload = F.translate(F.get(F.split(token, r"\."), F.lit(1)), "-_", "+/")
    padded = F.rpad(payload, F.ceil(F.length(payload) / 4).cast("int") * 4, F.lit("="))
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.get_json_object(text, "$.exp").try_cast("long")


def known_only(items: Column, known: list[str]) -> Column:
    """Distinct items that are among the known labels."""
    return F.array_distinct(F.filter(items, lambda x: x.isin(*known)))


def query_parameters(query: Column) -> Column:
    """A query string as a map; the first value of a name counts."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    names = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    first = F.filter(F.transform(pairs, lambda p, k: F.when(F.array_position(names, F.substring_index(p, "=", 1)) == k + 1, p)), lambda p: p.isNotNull())
    value = lambda p: F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")
    return F.map_from_entries(F.transform(first, lambda p: F.struct(F.substring_index(p, "=", 1), F.try_url_decode(F.replace(value(p), F.lit("+"), F.lit(" "))))))


def cookie(header: Column, name: str) -> Column:
    """The decoded value of a cookie, the first of its name; as it stands where it decodes to nothing, '' without one."""
    pairs = F.filter(F.split(F.coalesce(header, F.lit("")), ";"), lambda p: p.contains("=") & (F.trim(F.substring_index(p, "=", 1)) == name))
    value = F.trim(F.regexp_replace(F.get(pairs, F.lit(0)), "^[^=]*=", ""))
    decoded = F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))
    return F.coalesce(decoded, value, F.lit(""))


def localized_slug(raw: Column, language: str) -> Column:
    """A slug, or of a JSON map of slugs that of the language, else the Hungarian, else the English one; '' for what is no slug."""
    s = normalize_whitespace(raw)
    of = lambda k: F.get_json_object(s, f"$.{k}")
    picked = F.when(s.startswith("{") & s.contains('"'), normalize_whitespace(F.coalesce(of(language), of("hu"), of("en")))).otherwise(s)
    return F.when(picked.rlike(r'[{}"\s]'), "").otherwise(picked)


def client_address(forwarded: Column, own: Column, stated: Column) -> Column:
    """The first forwarded address, else the host's, else the stated one, else 'unknown'."""
    said = [F.nullif(F.trim(c), F.lit("")) for c in (F.substring_index(forwarded, ",", 1), own, stated)]
    return F.coalesce(*said, F.lit("unknown"))


def limit_key(address: Column, visitor: Column) -> Column:
    """What a limit counts by: the address where it is known, else the visitor; null without both, which no limit holds."""
    known = F.nullif(F.nullif(address, F.lit("")), F.lit("unknown"))
    return F.coalesce(F.concat(F.lit("ip:"), known), F.concat(F.lit("visitor:"), F.nullif(visitor, F.lit(""))))
