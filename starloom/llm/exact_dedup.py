"""Exact dedup by content sort (operator 10), DataFrame functions only.

Sampled splitters range-partition the rows by content, Spark's external sort brings equal contents next to
each other, and the window then compares neighbours byte by byte. The sort key starts with the first bytes
of the content and its SHA-256, so that the sampled splitters stay short whatever the length of the texts;
the whole content is the last part of the key and decides.

A content that many rows share would end in one range. Contents that make up at least one part in
`hot_parts` of all rows (so at most `hot_parts` contents, whatever the size of the input) are found by a
pre-aggregated count of digests, dealt over salted ranges by a hash of the id, and the count, which also has the id that
stays, tells their size and row afterwards. A table is read three times: for the digests, the splitters and the sort.

Defined cases: null text counts as empty; empty texts are equal to each other; a null id sorts below all
others; rows that repeat an id and a text are one group, of which one row stays (the others carry
kept = false); columns of the input are carried along and none of them is read except the id and the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.common import table, written

HOT_PARTS = 2000
LEAD = 24


def mark_exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise=None,
    hot_parts: int = HOT_PARTS,
    carry: tuple[str, ...] = (),
    with_text: bool = False,
) -> DataFrame:
    """Per input row: id, keep_id, group_size, kept, text_sha256; with `carry`, a struct _carry of the columns it names;
    with_text, _text (normalised; null where it was).

    keep: "smallest" or "largest" id of a group stays. normalise: Column -> Column on the text, identity if None.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is {keep!r}")
    content: Column = F.coalesce(F.col(text_col), F.lit(""))
    content = normalise(content) if normalise else content
    # One struct for what is carried: no name of the input can clash with ours.
    rows = docs.select(
        F.col(id_col).alias("_id"), content.alias("_content"), F.struct(*(F.col(c) for c in carry)).alias("_carry") if carry else F.lit(None).cast("int").alias("_carry"),
        F.col(text_col).isNull().alias("_none"),
    ).withColumn("_digest", F.sha2(F.encode("_content", "UTF-8"), 256))

    best = F.min if keep == "smallest" else F.max
    digests = docs.select(F.sha2(F.encode(content, "UTF-8"), 256).alias("_digest"), F.col(id_col).alias("_id")).groupBy("_digest").agg(F.count("*").alias("_n"), best("_id").alias("_all_best"))
    total = docs.select(F.count("*")).scalar()
    # n * hot_parts >= total holds for at most hot_parts digests; n > 64 only spares tiny tables the salting.
    hot = (
        digests.filter("_n > 64").withColumn("_total", total).filter(F.col("_n") * hot_parts >= F.col("_total"))
        .select("_digest", F.ceil(F.col("_n") * hot_parts / F.col("_total")).cast("int").alias("_salts"), "_all_best", F.col("_n").alias("_all_size"))
    )
    hot = written(hot, "hot-contents")  # at most hot_parts rows; counted once
    rows = rows.join(F.broadcast(hot.select("_digest", "_salts")), "_digest", "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int"))
    )
    ranges = rows.withColumn("_lead", F.substring("_content", 1, LEAD)).repartitionByRange("_lead", "_digest", "_salt")
    run = Window.partitionBy("_lead", "_digest", "_salt", "_content")
    first = run.orderBy(F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last())
    runs = ranges.select(
        "_id", "_digest", "_salts", "_carry", F.row_number().over(first).alias("_place"), best("_id").over(run).alias("_best"), F.count("*").over(run).alias("_size"), F.col("_salt").alias("_part"),
        *([F.when(~F.col("_none"), F.col("_content")).alias("_text")] if with_text else []),
    )
    # Cold contents are complete in their run. Of hot ones, at most hot_parts digests, the row that stays is in the run of its id's salt.
    merged = hot.select("_digest", "_all_best", "_all_size", F.pmod(F.xxhash64("_all_best"), F.col("_salts")).cast("int").alias("_best_part"))
    out = runs.join(F.broadcast(merged), "_digest", "left")
    keep_id = F.when(F.col("_salts").isNull(), F.col("_best")).otherwise(F.col("_all_best"))
    size = F.when(F.col("_salts").isNull(), F.col("_size")).otherwise(F.col("_all_size"))
    kept = (F.col("_place") == 1) & (F.col("_salts").isNull() | (F.col("_part") == F.col("_best_part")))
    return out.select(
        F.col("_id").alias(id_col), keep_id.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.col("_digest").alias("text_sha256"), *(["_carry"] if carry else []), *(["_text"] if with_text else [])
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows that stay, with the columns of docs."""
    others = tuple(c for c in docs.columns if c != text_col)
    marked = mark_exact_duplicates(docs, id_col, text_col, keep, carry=others, with_text=True)
    return marked.filter("kept").select(*(F.col("_text").alias(c) if c == text_col else F.col(f"_carry.`{c}`").alias(c) for c in docs.columns))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
