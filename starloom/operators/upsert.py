"""Loading into tables that have rows already: no MERGE on plain files, so a join and a rewrite."""

from __future__ import annotations

from pyspark.sql import DataFrame


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old, and those of new whose key old does not have. Keys of new must be unique or equal rows."""
    return old.unionByName(new_rows(old, new, keys))


def new_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns)


def insert_replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new does not have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
