"""Arrays, maps and JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def searchsorted(array: Column, x: Column, right: bool = False) -> Column:
    """How many elements of a sorted array lie below x (with right: at or below it): its place of insertion."""
    return F.size(F.filter(array, lambda v: (v <= x) if right else (v < x)))


def running_max(array: Column) -> Column:
    """The largest element so far, for each element."""
    return F.transform(array, lambda v, i: F.array_max(F.slice(array, 1, i + 1)))


def linspace_places(n: Column, k: int) -> Column:
    """Up to k evenly spaced positions among n, the first and the last included."""
    take = F.least(n, F.lit(k))
    return F.when(take <= 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), take.cast("int") - 1), lambda i: F.floor(i * (n - 1) / (take - 1)).cast("long")))


def map_value(params: Column, key: Column, default: Column) -> Column:
    """A map's value with a default for other keys."""
    return F.coalesce(F.try_element_at(params, key), default)


def finite_json(value: Column) -> Column:
    """A struct as JSON with nulls kept; call `finite` on its numbers first, as JSON has no NaN or infinity."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def references(text: Column) -> Column:
    """Evidence references (a JSON list of url and sha256) that are whole: an address and 64 hexadecimal digits."""
    refs = F.from_json(text, "array<struct<url: string, sha256: string>>")
    return F.filter(refs, lambda r: F.coalesce(r["url"].rlike("^https?://") & r["sha256"].rlike("^[0-9a-fA-F]{64}$"), F.lit(False)))
