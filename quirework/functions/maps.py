"""Merging settings: trees of dictionaries on the driver, two-level maps in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def deep_merge(base: dict, over: dict) -> dict:
    """A new tree: where both sides have a dictionary they are merged in turn, elsewhere the right side wins, also with None."""
    out = dict(base)
    for key, value in over.items():
        mine = out.get(key)
        out[key] = deep_merge(mine, value) if isinstance(mine, dict) and isinstance(value, dict) else deep_merge({}, value) if isinstance(value, dict) else value
    return out


def merge_maps(base: Column, over: Column) -> Column:
    """map<string, map<string, x>>: sections of either side, their keys merged, the right side wins."""

    def flat(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)

    return F.map_zip_with(base, over, lambda k, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(flat(a, b)))
