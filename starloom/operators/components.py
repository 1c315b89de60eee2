"""Connected components of a link table by alternating large and small stars, DataFrame functions only.

Every round is one aggregate and one join a star, its result is written to the shared folder, and what comes to
the driver is a row count and a checksum. Links reach the smallest id of their component in a number of rounds
that grows with the logarithm of the component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.storage import drop_written, written


def _stars(both: DataFrame) -> DataFrame:
    """From (u, v): for each u its smallest neighbour or itself as m, on every link."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.join(least, both["u"] == least["k"]).select("u", "v", "m")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Links here point from the larger to the smaller end."""
    s = _stars(e)
    return s.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(s.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From links (a, b): (id, component) for every id that has a link; component is the smallest id reachable."""
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "links")
    state = None
    for _ in range(most_rounds):
        mark = e.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
        if (mark["n"], mark["h"]) == state or not mark["n"]:
            break
        state = (mark["n"], mark["h"])
        after = written(_small_star(_large_star(e)), "links")
        drop_written(e)
        e = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
