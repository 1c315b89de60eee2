"""Boilerplate lines against a plain count, on small hosts, large pages and odd rows."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from starloom.llm import line_dedup

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def brute(rows, ratio, least=2):
    pages, on = Counter(h for _, _, h in rows), defaultdict(Counter)
    for _, t, h in rows:
        on[h].update({x.strip(WHITE) for x in (t or "").split("\n")} - {""})
    out = []
    for i, t, h in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (x.strip(WHITE) and on[h][x.strip(WHITE)] >= least and on[h][x.strip(WHITE)] > pages[h] * ratio)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def check(spark, rows, ratio, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.drop_boilerplate_lines(df.selectExpr("*", "1 as _host", "2 as _salt", "3 as n_lines"), ratio=ratio, **more)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, ratio)


def test_hosts_of_few_pages(spark):
    rows = [(i, f"menu\nown {i}\n menu \n\nend", "four") for i in range(4)] + [(10, "menu\nalone", "one"), (11, "twice", "two"), (12, "twice\nown", "two")]
    check(spark, rows, 0.5)
    check(spark, rows, 0.02)


def test_many_boilerplate_lines_and_odd_rows(spark):
    rng = random.Random(1)
    common = [f"line {k}" for k in range(300)]
    rows = [(i, "\n".join([*rng.sample(common, 200), f"own {i}", " x", "\tmenu\r"]), "a") for i in range(60)]
    rows += [(5, rows[5][1], "a"), (5, rows[5][1], "a"), (None, "menu", "a"), (None, None, None), (70, "", None), (71, "w " * 300_000 + "\nmenu", "b"), (72, "menu", "b")]
    check(spark, rows, 0.5)
    check(spark, rows, 0.02)


def test_hot_hosts_are_salted(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SALTS", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(spark, [(i, f"menu\nown {i}", "hot" if i % 3 else f"h{i}") for i in range(120)], 0.1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hosts_from_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    host = line_dedup.host_of(F.col("url"))
    got = line_dedup.drop_boilerplate_lines(pages, "page_id", "html", host, ratio=0.3)
    rows = [(r.page_id, r.html, re.sub(r"^\w+://([^/:?#]+).*$", r"\1", r.url).lower()) for r in pages.collect()]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 0.3)
