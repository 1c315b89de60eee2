"""Kneser-Ney by dictionaries against the models' sorted arrays; samples, ties and odd rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from starloom.llm import language_id

TEXTS = {
    "aa": ["the cat sat on the mat", "a cat and a hat", "that is the end of it", "no 1 knows"],
    "bb": ["der hund und die katze", "ein hut ist da", "das ende", "der rat der stadt 7"],
    "cc": ["кот и пёс", "дом у моря и the end"],
}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string")


def plain_model(texts, order, letters, discount=0.75):
    """log P(newest letter | the letters before), by the recursion over dictionaries."""
    grams = Counter()
    for t in texts:
        out = ""
        for c in t.lower():
            c = c if c.isalpha() else " "
            if not (c == " " and out.endswith(" ")):
                out += c
        out = " " * order + out.strip(" ") if out.strip(" ") else " " * order
        if t and not t[-1].isalpha():
            out += " "
        for i in range(order - 1, len(out)):
            grams[out[i - order + 1 : i + 1]] += 1
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    total = {n: Counter() for n in levels}
    kinds = {n: Counter() for n in levels}
    for n, counts in levels.items():
        for g, c in counts.items():
            total[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (letters + 2)
        t = total[n][g[:-1]]
        if not t:
            return p(g[1:])
        c = levels[n][g]
        return max(c - discount, 0) / t + discount * kinds[n][g[:-1]] / t * p(g[1:])

    return p


@pytest.mark.parametrize("order", [2, 3, 5])
def test_models_equal_dictionaries(spark, order):
    rows = [(t, g) for g, ts in TEXTS.items() for t in ts]
    m = language_id.train(frame(spark, rows), "text", "lang", "doc_id", order=order)  # few rows: all learned from
    assert m.languages == ["aa", "bb", "cc"]
    brute = [plain_model(TEXTS[g], order, len(m.alphabet.letters)) for g in m.languages]
    rng = np.random.default_rng(0)
    seen = sorted({c for ts in TEXTS.values() for t in ts for c in t.lower() if c.isalpha()}) + [" "]
    grams = ["".join(rng.choice(seen, order)) for _ in range(300)] + [" " * order]
    for t in ("the cat", "der hut", "кот и", "das end"):
        grams += [(" " * order + t)[i : i + order] for i in range(len(t) + 1)]
    codes = {c: k + 1 for k, c in enumerate(m.alphabet.letters)} | {" ": 0}
    packed = np.array([sum(codes[c] << (m.alphabet.bits * k) for k, c in enumerate(reversed(g))) for g in grams], np.int64)
    got = m.score_grams(packed)
    for i, g in enumerate(grams):
        for k in range(3):
            assert math.isclose(got[i, k], math.log(brute[k](g)), abs_tol=2e-5), (g, m.languages[k])


def test_cross_entropy_is_the_mean_over_characters(spark):
    rows = [(t, g) for g, ts in TEXTS.items() for t in ts]
    m = language_id.train(frame(spark, rows), "text", "lang", "doc_id")
    brute = [plain_model(TEXTS[g], m.order, len(m.alphabet.letters)) for g in m.languages]
    h, letters = language_id.Scorer(m).entropies(["The Cat!! 12 sat"])
    text = "     the cat sat"
    own = [text[i - 4 : i + 1] for i in range(4, len(text))]
    assert letters.tolist() == [9]
    for k in range(3):
        assert math.isclose(h[0, k], -sum(math.log(brute[k](g)) for g in own) / len(own), abs_tol=1e-4)


def test_ties_null_labels_and_clashing_names(spark):
    rows = [("abc abd", "y"), ("abc abd", "x"), ("zzz qqq", None), (None, "x"), ("", None), ("abc abd", None)]
    df = frame(spark, rows)
    m = language_id.train(df, "text", "lang", "doc_id")
    assert m.languages == ["x", "y"]
    out = language_id.identify(df.selectExpr("*", "'old' as lang_pred", "1 as p", "2 as c0"), m)
    assert out.columns == ["doc_id", "text", "lang", "p", "c0", *language_id.ADDED]
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in out.collect()}
    assert got[0] == got[1] == got[5] == ("x", 0.5) and got[3] == got[4] == ("und", 0.0)  # ties by name; no letters


def test_text_of_any_plane_has_letters(spark):
    high = "".join(chr(c) for c in range(0x30000, 0x30010))
    m = language_id.train(frame(spark, [(high, "h"), ("abc", "l")] * 3), "text", "lang", "doc_id")
    lang, score, _, _ = language_id.Scorer(m).predict([high, chr(0x20000) + chr(0x31000), "abc"], 12.0)
    assert lang[0] == "h" and lang[1] != "und" and lang[2] == "l" and min(score) > 0


def test_sample_is_bounded_by_rows_and_characters(spark, monkeypatch):
    rows = [(f"word{k} " * 50, "a") for k in range(400)]
    seen = defaultdict(int)
    build = language_id.build_model

    def counted(languages, letters, order, lang, grams, count, *more):
        seen["n"] = int(count.sum())
        return build(languages, letters, order, lang, grams, count, *more)

    monkeypatch.setattr(language_id, "build_model", counted)
    language_id.train(frame(spark, rows), "text", "lang", "doc_id")
    whole = seen["n"]
    language_id.train(frame(spark, rows), "text", "lang", "doc_id", rows_per_language=40)
    assert 0.03 * whole < seen["n"] < 0.25 * whole
    language_id.train(frame(spark, rows), "text", "lang", "doc_id", chars_per_language=14_000)
    assert 0.03 * whole < seen["n"] < 0.25 * whole
