"""Mixing sources to target weights by a time-varying curriculum (operator 6), DataFrame functions only.

Every source has a weight schedule, piecewise linear over training progress 0..1. Its integral is the
source's weight: the sources share `share` times all words by weight, each stopping at `epochs` times its own
words, the excess being shared again among the others (water filling, solved in closed form from running
sums over the sources). Within a source, documents are ordered by a hash of their id and taken in that order,
again from the start after the last, until the target is reached; the document at the end is taken in part.
Every pass of a document has a place of its own in its source's demand, which is inverted through the integral of
the schedule: a training position for each (document, pass). The mix is range-sorted by position.

The running sum over a source is taken in two steps, hash bucket totals first and then inside each bucket,
so a source with a third of all rows is spread over BUCKETS groups.

Defined cases: null text has size 0; sources go by code point, null last, and null is a source of its own;
sources without words have target 0; repeated ids count as separate documents (order: hash, id, size), in one bucket;
a null id is ordered by a hash of its text; passes that the mix does not take have no position; an empty table gives an
empty result. Columns other than id, text and source are carried along or not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.common import WORD, table, text_or_empty, written

BUCKETS = 4096
#: Weight schedules by rank of the source, repeating: (progress, weight) knots. Their integrals are 5, 2 and 1:
#: the heavy sources fade while the light ones come in.
SCHEDULES = (((0.0, 7.0), (1.0, 3.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.0), (0.5, 1.0), (1.0, 2.0)))


def integral(knots) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def progress_at(knots, share: Column) -> Column:
    """Inverts the normalised integral of a piecewise linear schedule: share of the demand -> progress."""
    whole, done, out = integral(knots), 0.0, F.lit(float(knots[-1][0]))
    steps = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        left = share * whole - done
        slope = (w1 - w0) / (t1 - t0)
        # w0 x + slope x^2 / 2 = left, in the form that is stable for slope 0
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * left, F.lit(0.0)))
        x = F.when(root + w0 > 0, 2 * left / (root + w0)).otherwise(F.lit(0.0))
        done += area
        steps.append((done, F.lit(t0) + F.least(F.greatest(x, F.lit(0.0)), F.lit(t1 - t0))))
    for end, value in reversed(steps):
        out = F.when(share * whole <= end, value).otherwise(out)
    return out


def running(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """Adds c_before for each c of sums: its sum over the rows that come earlier in `order`, without bringing all rows to one task.

    Rows are range-partitioned; totals of the partitions (one small row each) give each its start.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "running")
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    starts = dealt.groupBy("_p").agg(*(F.sum(c).alias(c) for c in sums)).select(F.col("_p").alias("_q"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}_start") for c in sums))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(starts), F.col("_p") == F.col("_q"))
    return out.select(*df.columns, *((F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{c}_start")).alias(f"{c}_before") for c in sums))


def source_targets(sizes: DataFrame, weights: list[float], share: float = 1.5, epochs: int = 2) -> DataFrame:
    """From (source, size): source, source_size, rank, target. One row a source.

    min(epochs * size, level * weight) for the level at which the targets add up to share * all words: sort by
    the level at which each source is full; the first source not full at the level left for it ends the search (later levels are lower).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = running(per, [F.col("source").asc_nulls_last()], ["one"]).withColumnRenamed("one_before", "rank").drop("one")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumns({"w": weight, "cap": F.col("source_size") * epochs})
    filled = running(ranked, [F.col("cap") / F.col("w"), F.col("rank")], ["cap", "w"])
    words, whole = (filled.select(F.sum(c)).scalar() for c in ("source_size", "w"))
    filled = filled.withColumn("level", (words * share - F.col("cap_before")) / (whole - F.col("w_before")))
    final = filled.select(F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))).scalar()
    target = F.least(F.col("cap").cast("double"), F.coalesce(final * F.col("w"), F.col("cap").cast("double")))
    return filled.select("source", "source_size", "rank", target.alias("target"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", schedules=SCHEDULES, share: float = 1.5, epochs: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, size, source_size, target, taken (words), positions (one for each pass begun); with `carry`, a struct _carry of the columns it names."""
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    order = F.coalesce(F.md5(F.col(id_col).cast("string")), F.md5(text_or_empty(text_col)))
    # A key that is never null, so that the join below can use the window's exchange.
    named = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    rows = docs.select(
        F.col(id_col).alias("_id"), named.alias("_key"), size.alias("size"), order.alias("_order"),
        F.struct(*(F.col(c) for c in carry)).alias("_carry") if carry else F.lit(None).cast("int").alias("_carry"),
    )
    bucket = (F.conv(F.substring("_order", 1, 3), 16, 10).cast("int") * BUCKETS / 4096).cast("int")
    rows = rows.withColumn("_bucket", bucket)
    sums = written(rows.groupBy("_key", "_bucket").agg(F.sum("size").alias("size")), "bucket-sizes")  # so texts are counted once for all that follows
    source = F.when(F.col("_key") != "-", F.substring("_key", 2, 1 << 30))
    targets = source_targets(sums.select(source.alias("source"), "size"), [integral(s) for s in schedules], share, epochs)
    targets = targets.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("_key"), "source_size", "rank", "target")
    prefix = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_key", "_bucket", F.coalesce(F.sum("size").over(prefix), F.lit(0)).alias("_base")).join(targets, "_key")
    inside = Window.partitionBy("_key", "_bucket").orderBy("_order", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["_key", "_bucket"], "left")
    start = F.col("_base") + F.col("_inside")
    goal = F.round("target").cast("long")
    passes = [F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - start - F.col("source_size") * e)) for e in range(epochs)]
    taken = sum(passes[1:], passes[0])

    def position(e: int) -> Column:
        middle = F.least(F.lit(1.0), (start + F.col("source_size") * e + passes[e] / 2) / goal)
        place = F.lit(None).cast("double")
        for k, knots in enumerate(schedules):
            place = F.when(F.pmod("rank", F.lit(len(schedules))) == k, progress_at(knots, middle)).otherwise(place)
        return F.when(passes[e] > 0, place)

    positions = F.array_compact(F.array(*(position(e) for e in range(epochs))))
    return placed.select(
        F.col("_id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), positions.alias("positions"), *(["_carry"] if carry else []),
    )


def in_training_order(mixed: DataFrame, position: str = "position", id_col="doc_id") -> DataFrame:
    return mixed.repartitionByRange(position, id_col).sortWithinPartitions(position, id_col)


def mixed_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The mix as documents in training order: those not taken go, those in their second pass come twice, each at its own place.

    A document taken in part stays whole: texts are never cut here.
    """
    # Positions are computed on ids and sizes and texts move once, with them.
    mixed = mix(docs, id_col, text_col, source_col, carry=tuple(docs.columns)).select(F.col(id_col).alias("_id"), F.explode("positions").alias("_position"), "_carry")
    return in_training_order(mixed, "_position", "_id").select("_carry.*")


def op6_mixing_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    place = lambda e: F.round(F.get("positions", F.lit(e)), 8)
    mixed = mix(docs).select("doc_id", "size", "source_size", "target", "taken", place(0).alias("position"), place(1).alias("position_2"))
    return in_training_order(mixed)


#: Positions by halving: the integral of a schedule from 0 to t is t times the mean of its ends, as all are linear.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS o
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2 * source_size AS cap FROM s
), f AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS goal,
    coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w
), l AS (
  SELECT *, (goal - full_before) / w_left AS level FROM f
), t AS (
  SELECT *, least(cap::DOUBLE, coalesce(max(CASE WHEN level * w <= cap THEN level END) OVER () * w, cap::DOUBLE)) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS goal, t.rank % 3 AS k,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, greatest(0, least(size, goal - start)) AS p0, greatest(0, least(size, goal - start - source_size)) AS p1 FROM p
), u AS (
  SELECT *, (start + p0 / 2) / goal AS u0, (start + source_size + p1 / 2) / goal AS u1 FROM q
), b AS (
  SELECT doc_id, k, 0 AS e, u0 AS u, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM u WHERE p0 > 0
  UNION ALL SELECT doc_id, k, 1, u1, 0.0, 1.0, 0 FROM u WHERE p1 > 0
  UNION ALL SELECT doc_id, k, e, u, CASE WHEN low THEN t ELSE lo END, CASE WHEN low THEN hi ELSE t END, step + 1 FROM (
    SELECT *, t * (w0 + w) / 2 < u * whole AS low FROM (
      SELECT *, CASE k WHEN 0 THEN 7 WHEN 1 THEN 2 ELSE 0 END AS w0, CASE k WHEN 0 THEN 7 - 4 * t WHEN 1 THEN 2 ELSE 2 * t END AS w, CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS whole
      FROM (SELECT *, (lo + hi) / 2 AS t FROM b WHERE step < 52)))
), x AS (SELECT doc_id, max(lo) FILTER (e = 0) AS t0, max(lo) FILTER (e = 1) AS t1 FROM b WHERE step = 52 GROUP BY doc_id)
SELECT u.doc_id, size, source_size, target, (p0 + p1)::BIGINT AS taken, round(t0, 8) AS position, round(t1, 8) AS position_2
FROM u LEFT JOIN x ON x.doc_id = u.doc_id
"""
