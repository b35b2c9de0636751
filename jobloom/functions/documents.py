"""JSON documents in text columns: equality, emptiness and merges by what they say, not by how it is written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import once

#: Objects in objects that merged_json() merges field by field; below, the newer value stands.
MOST_NESTED = 6
_FIELDS = "map<string,variant>"


def canonical_json(s: Column) -> Column:
    """A document without white space, the fields of its objects by name; null for what is no JSON or repeats a field in an object."""
    return F.to_json(F.try_parse_json(s))


def same_json(a: Column, b: Column) -> Column:
    """Whether two texts are the same document; texts that are no JSON are compared as they are, null is like null alone."""
    said = lambda s: F.coalesce(canonical_json(s), s)
    return said(a).eqNullSafe(said(b))


def is_empty_json(s: Column) -> Column:
    """An object or list without entries, a JSON null, a blank text or null."""
    return F.coalesce(canonical_json(s), F.trim(s), F.lit("")).isin("{}", "[]", "null", "")


def _merged(old: Column, new: Column, levels: int) -> Column:
    """new, or where both are objects their fields, merged likewise. A missing value is null, a JSON null is none."""
    if not levels:
        return new
    fields = lambda v: F.try_variant_get(v, "$", _FIELDS)

    def both(sides: Column) -> Column:
        a, b = sides["a"], sides["b"]
        inner = F.map_zip_with(a, b, lambda _, x, y: F.when(y.isNull(), x).when(x.isNull(), y).otherwise(_merged(x, y, levels - 1)))
        return F.when(a.isNotNull() & b.isNotNull(), F.to_variant_object(inner)).otherwise(new)

    return once(F.struct(fields(old).alias("a"), fields(new).alias("b")), both)


def merged_json(old: Column, new: Column, levels: int = MOST_NESTED) -> Column:
    """The canonical document of old with the fields of new put over it, objects in both merged in turn.

    Defined cases: a JSON null of new stands, as any value does; lists are values; a side that is null or no JSON is
    passed over, and both being so is null; a side that is no object gives way to the newer one.
    """

    def of(sides: Column) -> Column:
        a, b = sides["a"], sides["b"]
        return F.to_json(F.when(a.isNull(), b).when(b.isNull(), a).otherwise(_merged(a, b, levels)))

    return once(F.struct(F.try_parse_json(old).alias("a"), F.try_parse_json(new).alias("b")), of)


def field(s: Column, path: str, kind: str) -> Column:
    """A value of a document by its path ($.a[0].b), null if it is not there or not of the kind."""
    return F.try_variant_get(F.try_parse_json(s), path, kind)
