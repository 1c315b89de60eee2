"""The pipeline as a whole on empty tables, null ids, repeated rows and clashing names."""

import corpus_pipeline
from starloom.storage import children, shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["'x' as _id", "1 as _carry", "2 as key", "3 as position", "'y' as lang_pred", "4 as text_sha256", "5 as component_id", "6 as _salt"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() == 0


def test_null_ids_repeated_rows_and_clashing_names(spark, tmp_path):
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, words, "en", "a", 0), (1, words, "en", "a", 0), (2, words, None, "a", 0), (None, words + " more", "en", None, 0), (None, None, "en", "a", 0), (3, "", "en", "b", 0), (4, "12 34", "en", "b", 0), (5, "w" * 60_000 + " " + words, "en", "b", 0)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *CLASH)
    at = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        at = spark.createDataFrame(stage(spark, at, "").collect(), docs.schema)
        assert at.columns == docs.columns, name
    ids = {r.doc_id for r in at.collect()}
    assert ids <= {1, None, 5} and 1 in ids  # the near copy without an id stays where the mix takes it
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    before = set(children(spark, shared_dir(spark)))
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.count() > 0
    left = set(children(spark, shared_dir(spark))) - before
    assert len(left) == 1 and next(iter(left)).startswith("stage-packing")  # nothing else is left behind
