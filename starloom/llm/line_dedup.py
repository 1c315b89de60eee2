"""Line dedup by site-relative frequency (operator 5), DataFrame functions only.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it over the host's
pages; lines above `ratio` are boilerplate of the host and are dropped from its pages. A line on a single page does not
repeat and stays (`least` = 2), else hosts of few pages would lose all their text; there is no other floor.

Lines are counted by two hashes (96 bits, which stand for the line: equality is not checked on its text), once a page,
summed before and after one exchange. What is boilerplate of a host is at most (lines a page) / ratio lines. They are
laid out as a hash table, an array of short arrays that a line's hash points into, so a look-up costs the same whatever
their number. The tables of all hosts are written, so that Spark knows their size: while they are small the pages do not
move at all, else they are joined by host. Hosts with at least one page in SALTS, so at most SALTS hosts, are salted by
their share of the pages.

Defined cases: null text counts as empty, and stays as an empty text; lines are compared without surrounding white
space; blank lines are neither counted nor dropped; null is a host of its own; repeated rows are pages of their own;
a page whose lines all go becomes an empty text. Columns other than id, host and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import table, text_or_empty, written

RATIO = 0.02
LEAST = 2
SALTS = 256
SLOT = 4  # boilerplate lines a slot of the hash table, on average


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null where there is none. For tables that have URLs in place of hosts."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _mark(line: Column) -> Column:
    """96 bits of a stripped line; null if it is blank."""
    bare = F.btrim(line, F.lit("\x20\x09\x0a\x0b\x0c\x0d"))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("x"), F.hash(bare).alias("y")))


def boilerplate(rows: DataFrame, totals: DataFrame, ratio: float, least: int) -> DataFrame:
    """rows: _host, _lines. One row a host that has boilerplate: _host, _slots (array of arrays of marks)."""
    marks = F.array_distinct(F.filter(F.transform("_lines", _mark), lambda m: m.isNotNull()))
    counted = rows.select("_host", F.explode(marks).alias("_mark")).groupBy("_host", "_mark").agg(F.count("*").alias("_n"))
    frequent = counted.filter(F.col("_n") >= least).join(totals, "_host").filter(F.col("_n") > F.col("_pages") * ratio).select("_host", "_mark")
    sizes = frequent.groupBy("_host").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / SLOT)).cast("int").alias("_size"))
    full = frequent.join(sizes, "_host").select("_host", F.pmod("_mark.x", "_size").cast("int").alias("_slot"), "_mark")
    empty = sizes.select("_host", F.explode(F.sequence(F.lit(0), F.col("_size") - 1)).alias("_slot"), F.lit(None).cast(full.schema["_mark"].dataType).alias("_mark"))
    slots = full.unionByName(empty).groupBy("_host", "_slot").agg(F.collect_list("_mark").alias("_marks"))
    ordered = F.sort_array(F.collect_list(F.struct("_slot", "_marks")))
    return slots.groupBy("_host").agg(F.transform(ordered, lambda s: s["_marks"]).alias("_slots"))


def drop_boilerplate_lines(pages: DataFrame, id_col="doc_id", text_col="text", host_col: str | Column = "source", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """Per row: id, n_lines, n_dropped (longs), clean_text. host_col: a column or an expression, say host_of(F.col("url"))."""
    lines = F.split(text_or_empty(text_col), "\n", -1)
    given = F.col(host_col) if isinstance(host_col, str) else host_col
    host = F.coalesce(F.concat(F.lit("="), given.cast("string")), F.lit("-"))  # never null
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), lines.alias("_lines"))
    totals = written(rows.groupBy("_host").agg(F.count("*").alias("_pages")), "hosts")
    tables = boilerplate(rows, totals, ratio, least)
    every = totals.select(F.sum("_pages")).scalar()
    # At most SALTS hosts have a page in SALTS.
    hot = totals.withColumn("_all", every).filter(F.col("_pages") * SALTS >= F.col("_all")).select("_host", F.ceil(F.col("_pages") * SALTS / F.col("_all")).cast("int").alias("_salts"))
    salted = tables.join(F.broadcast(hot), "_host", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    salted = written(salted, "boilerplate")  # so that its size is known
    salt = F.pmod(F.xxhash64("_id", "_lines"), F.coalesce("_salts", F.lit(1))).cast("int")
    joined = rows.join(F.broadcast(hot), "_host", "left").withColumn("_salt", salt).join(salted, ["_host", "_salt"], "left")

    def stays(line: Column) -> Column:
        mark = _mark(line)
        return ~F.coalesce(F.array_contains(F.get("_slots", F.pmod(mark["x"], F.size("_slots")).cast("int")), mark), F.lit(False))

    kept = F.when(F.col("_slots").isNull(), F.col("_lines")).otherwise(F.filter("_lines", stays))
    out = joined.select("_id", F.size("_lines").cast("long").alias("n_lines"), kept.alias("_kept"))
    return out.select(F.col("_id").alias(id_col), "n_lines", (F.col("n_lines") - F.size("_kept")).alias("n_dropped"), F.array_join("_kept", "\n").alias("clean_text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate_lines(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, i, line, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS bare
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
f AS (
  SELECT l.source, l.bare FROM (SELECT DISTINCT doc_id, source, bare FROM l WHERE bare <> '') l JOIN t ON l.source IS NOT DISTINCT FROM t.source
  GROUP BY l.source, l.bare, t.pages HAVING count(*) >= {LEAST} AND count(*) > t.pages * {RATIO}::DOUBLE
)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(f.bare)::BIGINT AS n_dropped,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (f.bare IS NULL), '') AS clean_text
FROM l LEFT JOIN f ON l.source IS NOT DISTINCT FROM f.source AND l.bare = f.bare GROUP BY l.doc_id
"""
