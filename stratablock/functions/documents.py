"""JSON text and VARIANT values as columns: members that nobody names survive. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: Column) -> Column:
    """A string as a JSON string."""
    one = F.to_json(F.array(name))
    return one.substr(F.lit(2), F.length(one) - 2)


def members(value: Column, *but: str) -> Column:
    """Of an object (``map<string,variant>``) the members but those named, each as JSON text."""
    kept = F.filter(F.map_entries(value), lambda e: ~e["key"].isin(*but)) if but else F.map_entries(value)
    return F.transform(kept, lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.to_json(e["value"])))


def member(name: str, text: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), text)


def object_of(*parts: Column) -> Column:
    """An object of arrays of members."""
    return F.concat(F.lit("{"), F.array_join(F.concat(*parts), ","), F.lit("}"))


def array_of(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def extended(array: Column, texts: Column) -> Column:
    """The JSON text of an array with further members at its end."""
    more = F.array_join(texts, ",")
    head = F.substring(array, F.lit(1), F.length(array) - 1)
    return F.when(more == "", array).when(array == "[]", F.concat(F.lit("["), more, F.lit("]"))).otherwise(F.concat(head, F.lit(","), more, F.lit("]")))


def shifted(indices: Column, offset: Column) -> Column:
    """JSON text of whole numbers in arrays of any depth, with ``offset`` added to each number."""
    tokens = F.regexp_extract_all(indices, F.lit("(-?[0-9]+|[^-0-9]+)"), F.lit(1))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce((t.try_cast("bigint") + offset).cast("string"), t)), "")


def as_object(value: Column, path: str = "$") -> Column:
    """A member of a VARIANT as ``map<string,variant>``; null where it is no object."""
    return F.try_variant_get(value, path, "map<string,variant>")
