"""Dictionaries as map columns: look up, set, delete, merge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get(d: Column, key: str, default: Column | None = None) -> Column:
    found = F.try_element_at(d, F.lit(key))
    return found if default is None else F.coalesce(found, default)


def remove(d: Column, key: str) -> Column:
    return F.map_filter(d, lambda k, _: k != key)


def put(d: Column, key: str, value: Column) -> Column:
    """With a key set, whether it was there or not."""
    return F.map_concat(remove(d, key), F.create_map(F.lit(key), value))


def put_if(d: Column, key: str, value: Column) -> Column:
    """Set where there is a value, else as it was."""
    return F.when(value.isNotNull(), put(d, key, value)).otherwise(d)


def update(d: Column, key: str, value: Column) -> Column:
    """Set where there is a value, else without the key."""
    return F.when(value.isNotNull(), put(d, key, value)).otherwise(remove(d, key))


def merge(left: Column, right: Column) -> Column:
    """Both; the left one's values count."""
    return F.map_concat(left, F.map_filter(right, lambda k, _: ~F.map_contains_key(left, k)))


def without_defaults(d: Column, defaults: dict[str, str]) -> Column:
    """Without entries that are what they would be anyway."""
    table = F.create_map(*[F.lit(x) for kv in sorted(defaults.items()) for x in kv])
    return F.map_filter(d, lambda k, v: ~F.coalesce(F.try_element_at(table, k) == v, F.lit(False)))


def sorted_entries(d: Column) -> Column:
    return F.array_sort(F.map_entries(d))


def set_stream(d: Column, data: Column, first: bool = False) -> Column:
    """The dictionary of a stream with its length, and Length1 if it is a font's."""
    n = F.octet_length(data).cast("string")
    out = put(d, "Length", n)
    return put(out, "Length1", n) if first else out
