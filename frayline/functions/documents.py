"""Map and JSON document expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_amounts(existing: Column, added: Column) -> Column:
    """Per-key sum of a numeric map and a map of texts; texts that are no integers are skipped."""
    numbers = F.map_filter(F.transform_values(added, lambda k, v: v.try_cast("bigint")), lambda k, v: v.isNotNull())
    empty = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(
        F.coalesce(existing, empty), F.coalesce(numbers, empty), lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    )


def skipped_amounts(added: Column) -> Column:
    """How many entries :func:`merge_amounts` skips."""
    return F.coalesce(F.size(F.filter(F.map_values(added), lambda v: v.try_cast("bigint").isNull())), F.lit(0))


def case_insensitive(document: Column, key: Column) -> Column:
    """Entry under the exact key, else the first under a key equal ignoring case."""
    loose = F.filter(F.map_entries(document), lambda e: F.lower(e["key"]) == F.lower(key))
    return F.coalesce(F.try_element_at(document, key), F.get(loose, F.lit(0))["value"])
