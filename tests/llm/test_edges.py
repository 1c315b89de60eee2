"""Nulls, empty and very long texts, repeated rows and clashing names, where no other file has them."""

import base64
import hashlib

import pytest

from starloom.llm import exact_dedup, token_counts, warc


def test_token_counts_of_a_table(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.vocabulary()
    t = Tokenizer(models.Unigram([("<unk>", min(s for _, s in pieces)), *pieces], unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = [None, "", " ", "same", "same", "x" * 100_000, "ab☃" * 5000, "w " * 30_000, "a\nb\tc  d"]
    rows = [(i if i != 4 else 3, x) for i, x in enumerate(texts)] + [(None, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as n_tokens")
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(df).collect()), key=repr)
    assert got == sorted(((i, len(t.encode(x).ids) if x else 0) for i, x in rows), key=repr)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup_with_null_ids(spark, keep):
    rows = [(None, "x"), (3, "x"), (1, "x"), (None, "y"), (None, "y"), (None, None), (2, ""), (5, "z" * 200_000), (5, "z" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _content", "2 as keep_id", "3 as _lead")
    got = exact_dedup.mark_exact_duplicates(df, keep=keep).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 4
    by = {r.text_sha256: r for r in got if r.kept}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = {"smallest": 1, "largest": 3}[keep]
    assert (by[sha("x")].doc_id, by[sha("x")].keep_id, by[sha("x")].group_size) == (best, best, 3)
    assert (by[sha("y")].doc_id, by[sha("y")].group_size) == (None, 2)
    assert (by[sha("")].doc_id, by[sha("")].group_size) == (2, 2) and by[sha("z" * 200_000)].group_size == 2


def test_warc_null_ids_clashing_names_and_no_url(spark):
    rows = [(None, None, "p"), (None, "u", "p"), (4, "u v\n", "p"), (7, "u", None), (8, "u", ""), (None, "u", "q"), (9, "u", "é" * 300_000), (9, "u", "é" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as n", "3 as best", "4 as payload", "5 as sha1")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=repr)
    want = [(None, 1, "revisit", 4)] * 2 + [(4, 1, "response", None), (7, 0, "revisit", 8), (8, 0, "response", None), (None, 1, "response", None), (9, 600_000, "response", None), (9, 600_000, "revisit", 9)]
    assert got == sorted(want, key=repr)
    with pytest.raises(TypeError):
        warc.round_trip(df.selectExpr("cast(page_id as string) as page_id", "url", "html"))


def test_warc_payloads_below_a_size_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(df, least=3).collect()}
    assert [got[i].record_type for i in (1, 2, 3, 4)] == ["response", "response", "revisit", "response"]
    assert got[1].payload_digest == base64.b32encode(hashlib.sha1(b"ab").digest()).decode() == got[2].payload_digest


def test_store_names_schemes_as_arrow_does(tmp_path):
    store = warc.Store(f"file://{tmp_path}/a")
    with store.write("x") as out:
        out.write(b"1")
    store.delete("x")
    store.delete("x")  # as a task that runs twice does
    assert warc.Store(f"file:{tmp_path}/a").root == warc.Store(f"{tmp_path}/a").root == store.root
    with pytest.raises(ValueError):
        warc.Store("nosuch://bucket/folder")
