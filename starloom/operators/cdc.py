"""Change data capture by checksums of whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_crc(columns: list[str], null: str = "nan") -> Column:
    """CRC-32 of the values as text, joined by |. Null is a text of its own; column order counts. A | or \\ inside a value is marked
    by a \\, so that text which moves from a column to the next one shows."""
    value = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit(null)), r"([\\|])", r"\\$1")
    return F.crc32(F.encode(F.concat_ws("|", *map(value, columns)), "UTF-8"))


def with_crc(df: DataFrame) -> DataFrame:
    return df.withColumn("_crc", row_crc([c for c in df.columns if c != "_crc"]))


def diff(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that changed, with change_type insert, update or delete; deleted rows as they were, others as they are.

    One full outer join on the keys. Without an old table every row is an insert.
    """
    names = [c for c in new.columns if c != "_crc"]
    if old is None:
        return new.select(F.lit("insert").alias("change_type"), *names)
    new = new.select(*names, row_crc(names).alias("_crc"))
    old = (old if "_crc" in old.columns else with_crc(old)).select(*names, "_crc")
    side = lambda df, tag: df.select(*(F.col(k).alias(f"{tag}_{i}") for i, k in enumerate(keys)), F.struct(*names).alias(f"{tag}_row"), F.col("_crc").alias(f"{tag}_crc"))
    a, b = side(old, "old"), side(new, "new")
    same = [F.col(f"old_{i}").eqNullSafe(F.col(f"new_{i}")) for i in range(len(keys))]
    on = same[0]
    for s in same[1:]:
        on = on & s
    kind = F.when(F.col("old_row").isNull(), "insert").when(F.col("new_row").isNull(), "delete").when(F.col("old_crc") != F.col("new_crc"), "update")
    both = a.join(b, on, "full_outer").select(kind.alias("change_type"), F.coalesce("new_row", "old_row").alias("row")).filter("change_type is not null")
    return both.select("change_type", "row.*")


def apply_changes(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the changes: apply_changes(a, diff(a, b)) holds the rows of b."""
    rest = old.join(changes.select(*keys), keys, "left_anti")
    return rest.unionByName(changes.filter("change_type <> 'delete'").drop("change_type"))
