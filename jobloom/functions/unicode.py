"""Canonical decomposition and composition of texts, by tables made of the standard library's character data."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The combining diacritical marks.
FIRST_MARK, LAST_MARK = 0x300, 0x36F
_MARKED = r"[̀-ͯ]"
#: A character with the marks on it.
_CLUSTER = r"(?s).[̀-ͯ]*"


def _planes() -> list[str]:
    """Characters of the basic plane beyond ASCII."""
    return [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]


@cache
def plain_table() -> tuple[str, str]:
    """Characters that are a plain one with marks, and the plain ones; then the marks themselves, which have none."""
    marks = "".join(map(chr, range(FIRST_MARK, LAST_MARK + 1)))
    pairs = [(c, "".join(x for x in unicodedata.normalize("NFD", c) if x not in marks)) for c in _planes() if c not in marks]
    pairs = [(c, plain) for c, plain in pairs if len(plain) == 1 and plain != c]
    return "".join(c for c, _ in pairs) + marks, "".join(plain for _, plain in pairs)


@cache
def _decomposed() -> str:
    """JSON of characters that are others with marks, and their decompositions."""
    found = {c: unicodedata.normalize("NFD", c) for c in _planes()}
    return json.dumps({c: d for c, d in found.items() if len(d) > 1 and all(FIRST_MARK <= ord(x) <= LAST_MARK for x in d[1:])})


@cache
def _composed() -> str:
    """JSON of pairs of a character and a mark, and what they compose to."""
    pairs = {unicodedata.decomposition(c): c for c in _planes()}
    halves = {d: c for d, c in pairs.items() if d and "<" not in d and len(d.split()) == 2 and unicodedata.normalize("NFC", c) == c}
    marked = {"".join(chr(int(x, 16)) for x in d.split()): c for d, c in halves.items()}
    return json.dumps({pair: c for pair, c in marked.items() if FIRST_MARK <= ord(pair[1]) <= LAST_MARK})


@cache
def _classes() -> tuple[str, str]:
    """Marks, and for each a character whose code is its combining class; marks of class 0 stand where they are."""
    marks = [chr(c) for c in range(FIRST_MARK, LAST_MARK + 1)]
    return "".join(marks), "".join(chr(0x1000 + unicodedata.combining(c)) for c in marks)


def decomposed(cluster: Column) -> Column:
    """One character that is others with marks, as these; any other as it is."""
    return F.coalesce(F.try_element_at(F.from_json(F.lit(_decomposed()), "map<string,string>"), cluster), cluster)


def composed(s: Column) -> Column:
    """s in composed form: each character with the marks on it as one, as far as there is one, its marks in canonical order.

    Marks are the combining diacritical marks; what other marks compose to stays as it is, and texts without a
    mark are only searched for one.
    """
    pairs = F.from_json(F.lit(_composed()), "map<string,string>")
    none = F.lit("")

    def whole(cluster: Column) -> Column:
        parts = F.split(F.concat(decomposed(F.substring(cluster, 1, 1)), F.substring(cluster, 2, 1 << 30)), "")
        marks = F.transform(F.slice(parts, 2, F.size(parts)), lambda m, k: F.struct(F.translate(m, *_classes()).alias("class"), k.alias("at"), m.alias("mark")))
        start = F.struct(F.get(parts, F.lit(0)).alias("base"), none.alias("rest"), none.alias("last"))

        def put(held: Column, m: Column) -> Column:
            pair = F.try_element_at(pairs, F.concat(held["base"], m["mark"]))
            free = (held["last"] < m["class"]) & pair.isNotNull()
            base = F.when(free, pair).otherwise(held["base"])
            rest = F.when(free, held["rest"]).otherwise(F.concat(held["rest"], m["mark"]))
            return F.struct(base.alias("base"), rest.alias("rest"), F.when(free, held["last"]).otherwise(m["class"]).alias("last"))

        return F.aggregate(F.array_sort(marks), start, put, lambda held: F.concat(held["base"], held["rest"]))

    clusters = F.transform(F.regexp_extract_all(s, F.lit(_CLUSTER), F.lit(0)), lambda c: F.when(F.length(c) > 1, whole(c)).otherwise(c))
    return F.when(s.rlike(_MARKED), F.array_join(clusters, "")).otherwise(s)
