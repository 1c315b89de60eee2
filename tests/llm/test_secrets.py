"""Rules on long runs, and tokens against their pattern."""

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import secret_scan

JWT = next(r for r in secret_scan.RULES if r.kind == "jwt")


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["eyJ", ".", "a", "aaaaaaaa", "-", " ", "eyJaaaaaaaa.", "eyJbbbbbbbb", ".cccccccc", "é"]), max_size=14))
def test_tokens_equal_their_pattern(parts):
    text = "".join(parts)
    assert list(JWT.finder(text)) == [m.span() for m in re.finditer(JWT.pattern, text, re.A)]


def test_long_runs_take_linear_time():
    runs = ["eyJ", "a", "AKIA", "ghp_", "f", "token ", "token=", "token:  ", "xoxb-", "AIza", "bearer ", "password ", "-----BEGIN ", "eyJaaaaaaaa.", ".eyJ", "0123456789abcde "]
    for run in runs:
        began = time.process_time()
        secret_scan.spans_of([run * (1_500_000 // len(run))])
        assert time.process_time() - began < 20, run  # a second or so each


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "token = abcdefgh"), (1, "token = abcdefgh"), (None, "token = abcdefgh"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "'x' as kind")
    got = sorted((r.doc_id or 0, [(s.kind, s.start, s.end) for s in r.spans]) for r in secret_scan.scan_secrets(df).collect())
    assert got == [(0, [("assign", 0, 16)]), (1, [("assign", 0, 16)]), (1, [("assign", 0, 16)]), (2, [])]
