"""What the text of a posting says: its description, technologies, experience, company and clean title."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.levels import is_intern, is_junior, level_of, years_phrases
from jobloom.functions.text import labels_array, normalize_whitespace, once
from jobloom.sources.html import decoded

#: Shorter texts of a container are no description, so that the whole page counts where they name nothing.
LEAST_DESCRIPTION = 200
# The heading of a section of requirements, and the characters that belong to it.
REQUIREMENTS = "What you need to succeed"
REQUIREMENTS_CHARS = 3000
# Legal forms that end a company's name, marks that end a title, and words before one.
LEGAL_FORMS = ["kft", "zrt", "nyrt", "bt", "rt", "kht"]
TITLE_MARKS = ["ÚJ", "NEW", "FRISS"]
TITLE_PREFIXES = ["di[aá]kmunka", "gyakornok", "mel[oó]di[aá]k", "informatika", "programoz[oó]"]
MOST_COMPANY = 200

# Words of a description's opening before its company's name, words that join names, and words after one.
PARTNERS = ["Partnerünk,", "Partnercégünk,", "Megbízónk,"]
FOREIGN = "Nemzetközi"
ARTICLES = ["A", "Az"]
JOINTS = ["&", "és"]
OWNED = ["purpose", "corporate", "mission", "history", "team"]

_HUNGARIAN = "áéíóöőúüű"
_NAME_WORD = rf"^[A-Z{_HUNGARIAN.upper()}][A-Za-z0-9_{_HUNGARIAN}{_HUNGARIAN.upper()}.\-]*$"


def first_said(*texts: Column) -> Column:
    """The first that is neither null nor ''; '' if none."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def technologies_of(scoped: Column, body: Column, dictionary: list[tuple[str, str]]) -> Column:
    """Labels found in a description, joined by ', '; null if none. One that is short and names none gives way to the page's body."""
    said = lambda x: F.array_join(labels_array(x, dictionary), ", ")
    own = F.nullif(said(scoped), F.lit(""))
    return F.coalesce(own, F.when(F.length(scoped) < LEAST_DESCRIPTION, F.nullif(said(body), F.lit(""))))


def years_in(*texts: Column) -> Column:
    """Years of the first text that states any."""
    return F.coalesce(*[years_phrases(t) for t in texts])


def requirements_section(html: Column) -> Column:
    """The part of html from the requirements' heading on; null without one."""
    at = F.instr(html, REQUIREMENTS)
    return F.when(at > 0, F.substr(html, at, F.lit(REQUIREMENTS_CHARS)))


def resolved_experience(title: Column, body: Column, level: Column | None = None, labels: dict[str, str] | None = None) -> Column:
    """The level that a title states, else the stated level in our words (labels, lower case), else the years of the body, else '-'."""
    stated = F.lit(None).cast("string")
    for said, ours in (labels or {}).items():
        stated = F.when(F.lower(F.trim(level)) == said, F.lit(ours)).otherwise(stated)
    return F.coalesce(level_of(title), stated, years_phrases(body), F.lit("-"))


def level_in_brackets(title: Column) -> Column:
    """What stands in the last brackets of a title, such as a career level; null without any."""
    return F.nullif(F.trim(F.regexp_extract(title, r"\(([^()]*)\)\s*$", 1)), F.lit(""))


def student_before_junior(title: Column, body: Column) -> Column:
    """As resolved_experience() where junior titles are student work as well."""
    return F.when(is_intern(title) | is_junior(title), "diákmunka").otherwise(resolved_experience(title, body))


def _after_partner(words: Column) -> Column:
    """The names after 'our partner, a': up to the last point or comma of a run of them, the comma ending the run."""
    lead = F.when(words[0] == FOREIGN, 1).otherwise(0)
    told = F.get(words, lead).isin(*PARTNERS) & (F.get(words, lead + 1) == "a")

    def run(rest: Column) -> Column:
        named = F.transform(rest, lambda w: w.rlike(_NAME_WORD) | w.isin(*JOINTS))
        n = F.coalesce(F.nullif(F.array_position(named, False), F.lit(0)), F.size(rest) + 1) - 1
        last = F.get(rest, n.cast("int"))
        with_comma = F.when(F.regexp_replace(last, ",.*$", "").rlike(_NAME_WORD) & last.contains(","), F.array(F.regexp_replace(last, ",.*$", ","))).otherwise(F.array().cast("array<string>"))
        return F.regexp_extract(F.array_join(F.concat(F.slice(rest, F.lit(1), n.cast("int")), with_comma), " "), "(?s)^(.*)[.,]", 1)

    rest = F.slice(words, lead + 3, F.size(words))
    return F.when(told & F.regexp_replace(F.get(words, lead + 2), ",.*$", "").rlike(_NAME_WORD), once(rest, run))


def _after_article(words: Column) -> Column:
    """The names after a first word 'A' or 'Az', up to the last of them that a word in small letters follows."""

    def run(rest: Column) -> Column:
        named = F.transform(rest, lambda w: w.rlike(_NAME_WORD) | w.isin(*JOINTS))
        n = F.coalesce(F.nullif(F.array_position(named, False), F.lit(0)), F.size(rest) + 1).cast("int") - 1
        followed = F.filter(F.sequence(F.lit(1), n), lambda k: F.get(rest, k).rlike(f"^[a-z{_HUNGARIAN}]"))
        return F.array_join(F.slice(rest, F.lit(1), F.array_max(followed)), " ")

    return F.when(words[0].isin(*ARTICLES) & F.get(words, F.lit(1)).rlike(_NAME_WORD), once(F.slice(words, F.lit(2), F.size(words)), run))


def _word(words: Column, k: Column | int) -> Column:
    """A word without what stands after its first ASCII letters and digits."""
    return F.regexp_extract(F.get(words, F.lit(k) if isinstance(k, int) else k), "^[A-Za-z0-9_]*", 0)


def _before_is(words: Column) -> Column:
    """A first word that 'is a', 'is the' or 'is one of' follows."""
    one_of = (F.get(words, F.lit(2)) == "one") & (_word(words, 3) == "of")
    return F.when(words[0].rlike("^[A-Z][A-Za-z0-9&]{1,24}$") & (F.get(words, F.lit(1)) == "is") & (_word(words, 2).isin("a", "the") | one_of), words[0])


def _owner(words: Column) -> Column:
    """The first word of which something in OWNED is said to be."""
    owner = lambda w: F.regexp_extract(w, "(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9]{1,24})['’]s$", 1)
    owners = F.transform(words, lambda w, k: F.when(w.rlike("['’]s$") & _word(words, k + 1).isin(*OWNED), owner(w)))
    return F.get(F.filter(owners, lambda x: x != ""), F.lit(0))


def company_in_prose(description: Column) -> Column:
    """The company that the opening of a description names, or the first that something is said to be of, cut after its legal form; null if none.

    Entities are read as the characters they stand for.
    """

    def named(words: Column) -> Column:
        said = [F.nullif(of(words), F.lit("")) for of in (_after_partner, _after_article, _before_is, _owner)]
        return once(F.split(F.trim(F.regexp_replace(F.coalesce(*said), r"[\s-]+$", "")), " "), cut)

    def cut(names: Column) -> Column:
        form = F.array_position(F.transform(names, lambda w: F.lower(F.rtrim(w, F.lit("."))).isin(*LEGAL_FORMS)), True).cast("int")
        whole = F.array_join(F.when(form > 0, F.slice(names, F.lit(1), form)).otherwise(names), " ")
        return F.substring(F.when((form > 0) & ~whole.endswith("."), F.concat(whole, F.lit("."))).otherwise(whole), 1, MOST_COMPANY)

    return once(F.split(decoded(description), r"\s+"), named)


def title_before_mark(title: Column) -> Column:
    """A title up to the first of TITLE_MARKS that it has, without dashes and colons at its end."""
    cut = title
    for mark in reversed(TITLE_MARKS):
        cut = F.when(title.contains(mark), F.substring_index(title, mark, 1)).otherwise(cut)
    return F.trim(F.regexp_replace(F.trim(cut), "[-–:]+$", ""))


def title_before_colon(title: Column) -> Column:
    """A title up to its colon, without the kind of work before it; null if nothing is left."""
    cut = F.trim(F.substring_index(normalize_whitespace(title), ":", 1))
    bare = F.regexp_replace(cut, rf"(?iu)^(?:{'|'.join(TITLE_PREFIXES)})\s+", "")
    return F.nullif(normalize_whitespace(bare), F.lit(""))


def repaired_latin1(s: Column) -> Column:
    """UTF-8 that was read as Latin-1 as it was meant; what is no such text stays."""
    narrow = s.rlike(r"^[\x{00}-\x{ff}]*$") & s.rlike(r"[\x{80}-\x{ff}]")
    bytes_ = F.encode(F.when(narrow, s).otherwise(""), "ISO-8859-1").cast("string")
    return F.when(narrow & F.is_valid_utf8(bytes_) & ~bytes_.contains("�"), bytes_).otherwise(s)


def status_near(body: Column, anchor: Column, pattern: str, window: int) -> Column:
    """The first group of a pattern within `window` characters of an anchor's first place in a body; null without both."""
    near = F.when(F.instr(body, anchor) > 0, F.substr(body, F.instr(body, anchor), F.lit(window)))
    return F.nullif(F.regexp_extract(near, pattern, 1), F.lit(""))
