"""Language ID by interpolated Kneser-Ney character models (operator 9).

Per language a character model of order ORDER with interpolated Kneser-Ney smoothing, over letters folded to
lower case with every run of other characters read as one space. The n-gram counts of the training rows are
summed by Spark, so what reaches the driver is the distinct n-grams of a bounded sample: about `rows_per_language` rows and
`chars_per_language` characters a language at most, chosen by a hash of the id against a rate from the language's rows and characters.
The models are stored in sorted hash arrays, one for each order, that hold the interpolated log-probability
under every language that has the n-gram; a look-up is a binary search, from the shortest order up.

Every letter and every label of the training rows is learned. A letter takes as many bits as the alphabet needs (8 at
least) and an n-gram as many integers as its letters need; one of several integers is known by a 64-bit hash. Models
grow with the number of labels times the rows learned from each. Labels of fewer than FEW rows are learned from whole,
and the entropy of their random letters stands for that of their rows.

A text's cross-entropy under a language is the mean of minus the log-probabilities of its characters. The
language with the lowest wins. Rejection is calibrated on rows of the sample that are held back: a text is rejected
if its cross-entropy exceeds the mean of its language's own rows by more than `tolerance` standard deviations of
rows of that length, and by more than UNLIKE of the way to the entropy of random letters of the language. That leaves text of the
language alone, with foreign passages in it too, and drops text unlike anything learned.

Defined cases: text that is null or has no letters gives `und`, score 0, rejected. Rows with null language are
not learned from. Ties go to the first language by name. Without any labelled row all rows are `und`. Whole
texts are read; repeated rows are scored each for themselves; other columns are not read, but carried along by identify(), whose
own columns take the place of any of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import small_batches, table

ORDER = 5
ROWS_PER_LANGUAGE = 1500
CHARS_PER_LANGUAGE = 8_000_000
TOLERANCE = 12.0
UNLIKE = 0.5
CHARS = 1_500_000  # characters scored at once
CELLS = 30_000_000  # and log-probabilities held for them; with many languages fewer characters are scored at once
FEW = 10
SPREAD = np.uint64(0x9E3779B97F4A7C15)  # odd, so multiplying is one-to-one: distinct n-grams have distinct hashes


def _folded(text: str) -> str:
    return text.lower()


class Alphabet:
    """Letters to 1, 2, ...; 0 is anything that is not a letter, the last code a letter that training never saw."""

    def __init__(self, letters: str):
        self.letters = letters
        self.bits = max(8, (len(letters) + 1).bit_length())

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts in one array, each text after a 0, runs of 0 as one; and where each text starts."""
        if not hasattr(self, "_map"):
            known = np.zeros(0x110000, np.int32)
            known[[c for c in range(0x40000) if chr(c).isalpha()]] = len(self.letters) + 1
            for k, c in enumerate(self.letters):
                known[ord(c)] = k + 1
            self._map = known
        folded = [_folded(t) for t in texts]
        raw = np.frombuffer("\n".join(["", *folded]).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self._map[raw]
        ends = np.cumsum([len(t) + 1 for t in folded])
        starts = np.concatenate(([0], ends[:-1]))
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0
        keep[0] = True
        keep[starts] = True
        place = np.cumsum(keep) - 1
        return codes[keep], place[starts]

    def __getstate__(self):
        return {"letters": self.letters, "bits": self.bits}


def _grams(codes: np.ndarray, starts: np.ndarray, order: int, bits: int) -> np.ndarray:
    """At each position the last `order` codes as [integers, positions], the newest lowest in the first. Before a text's start there are zeros."""
    per = 63 // bits
    out = np.zeros((-(-order // per), len(codes)), np.int64)
    out[0] = codes
    begin = np.zeros(len(codes), np.int64)
    begin[starts] = starts
    since = np.arange(len(codes)) - np.maximum.accumulate(begin)
    for k in range(1, order):
        back = np.zeros(len(codes), np.int64)
        back[k:] = codes[:-k]
        back[since < k] = 0
        out[k // per] |= back << (bits * (k % per))
    return out


def _last(grams: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The newest n letters."""
    per = 63 // bits
    keep = [min(max(n - w * per, 0), per) for w in range(len(grams))]
    return grams & np.array([(1 << (bits * k)) - 1 for k in keep], np.int64)[:, None]


def _older(grams: np.ndarray, bits: int) -> np.ndarray:
    """All letters but the newest."""
    out = grams >> bits
    out[:-1] |= (grams[1:] & ((1 << bits) - 1)) << (bits * (63 // bits - 1))
    return out


def _hash(grams: np.ndarray) -> np.ndarray:
    """Distinct for distinct n-grams of one integer."""
    h = grams[-1].astype(np.uint64)
    for word in grams[-2::-1] if len(grams) > 1 else ():
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = (h ^ (h >> np.uint64(31))) ^ word.astype(np.uint64)
    return h * SPREAD


@dataclass
class Table:
    """Values by key and language, for the languages that have the key."""

    keys: np.ndarray  # sorted
    at: np.ndarray  # where the values of each key start, and the end
    lang: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, lang: np.ndarray, value: np.ndarray) -> Table:
        """From pairs in order of key and language."""
        distinct, at = np.unique(keys, return_index=True)
        return cls(distinct, np.append(at, len(keys)), lang.astype(np.int32), value.astype(np.float32))

    def cells(self, slots: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, language, value) of all values of the slots' keys."""
        n = self.at[slots + 1] - self.at[slots]
        source = np.repeat(self.at[slots] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(rows, n), self.lang[source], self.value[source]


@dataclass
class Model:
    languages: list[str]
    alphabet: Alphabet
    order: int
    grams: list[Table]  # by order 1..n: interpolated log-probabilities, by hash of the n-gram
    contexts: list[Table]  # by order 1..n: log of the mass that a context (order - 1 characters) leaves to the lower order
    floor: float  # log-probability of a character that no model knows
    own: np.ndarray | None = None  # letters that each language has
    mean: np.ndarray | None = None  # of the cross-entropies of each language's own rows
    spread: np.ndarray | None = None  # and their deviation, at 1 character and in the limit: sd^2 = a + b / n

    def score_grams(self, grams: np.ndarray) -> np.ndarray:
        """Log-probabilities [grams, languages]."""
        grams, bits = np.atleast_2d(grams), self.alphabet.bits
        out = np.full((grams.shape[1], len(self.languages)), -np.log(len(self.alphabet.letters) + 2), np.float32)
        left = np.arange(grams.shape[1])
        for n in range(1, self.order + 1):
            last = _last(grams[:, left], n, bits)
            at, hit = _find(self.contexts[n - 1].keys, _hash(_older(last, bits)))
            left, last = left[hit], last[:, hit]  # no longer context is known where this one is not
            row, lang, value = self.contexts[n - 1].cells(at[hit], left)
            out[row, lang] += value
            at, hit = _find(self.grams[n - 1].keys, _hash(last))
            row, lang, value = self.grams[n - 1].cells(at[hit], left[hit])
            out[row, lang] = value
            if n == 1:
                out[left[~hit]] = self.floor
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _pairs(keys: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, language) in order: where each is first, which one each input is, and how many there are."""
    order = np.lexsort((lang, keys))
    k, x = keys[order], lang[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
    which = np.empty(len(k), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which, np.diff(np.append(np.flatnonzero(new), len(k)))


def build_model(languages: list[str], letters: str, order: int, lang: np.ndarray, grams: np.ndarray, count: np.ndarray, discount: float = 0.75) -> Model:
    """From counts of the longest n-grams (language number, packed n-gram, count), each pair once."""
    alphabet = Alphabet(letters)
    uniform, bits = -np.log(len(letters) + 2), alphabet.bits
    first, _, _ = _pairs(_hash(grams), lang)
    lang, grams, count = lang[first], grams[:, first], count[first].astype(np.float64)
    levels = []  # from the longest: pairs with counts (continuation counts below the longest) and their place one order lower
    for n in range(order, 0, -1):
        shorter = _last(grams, n - 1, bits)
        first, lower, kinds = _pairs(_hash(shorter), lang)
        levels.append((lang, grams, count, lower))
        lang, grams, count = lang[first], shorter[:, first], kinds.astype(np.float64)
    tables, contexts = [], []
    p = np.full(len(lang), np.exp(uniform))
    for lang, grams, count, lower in reversed(levels):
        keys = _hash(_older(grams, bits))
        first, which, kinds = _pairs(keys, lang)
        total = np.bincount(which, count)
        share = discount * kinds / total
        p = (count - discount) / total[which] + share[which] * p[lower]
        tables.append(Table.of(_hash(grams), lang, np.log(p)))
        contexts.append(Table.of(keys[first], lang[first], np.log(share)))
    left = contexts[0].value
    floor = float(uniform + (left.max() if len(left) == len(languages) else 0.0))  # a language without rows leaves all its mass
    _, lang, _ = tables[0].cells(*[np.flatnonzero(tables[0].keys)] * 2)
    return Model(languages, alphabet, order, tables, contexts, floor, own=np.bincount(lang, minlength=len(languages)))


class Scorer:
    """Scores whole texts, remembering n-grams it has looked up (at most `most` of them)."""

    def __init__(self, model: Model, most: int = 600_000):
        n = max(1, len(model.languages))
        self.model, self.most, self.chars = model, min(most, CELLS // n), min(CHARS, CELLS // n)
        self.known, self.value = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)), np.float32)

    def _values(self, hashes: np.ndarray, grams: np.ndarray) -> np.ndarray:
        at, hit = _find(self.known, hashes)
        out = np.empty((len(hashes), len(self.model.languages)), np.float32)
        out[hit] = self.value[at[hit]]
        if not hit.all():
            fresh = hashes[~hit]
            out[~hit] = got = self.model.score_grams(grams[:, ~hit])
            if len(self.known) + len(fresh) > self.most:
                self.known, self.value = np.zeros(0, np.uint64), self.value[:0]
            both = np.concatenate((self.known, fresh))
            order = np.argsort(both, kind="stable")
            self.known, self.value = both[order], np.concatenate((self.value, got))[order]
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy [texts, languages] and the number of letters."""
        import pandas as pd

        codes, starts = self.model.alphabet.codes(texts)
        grams = _grams(codes, starts, self.model.order, self.model.alphabet.bits)
        which, distinct = pd.factorize(_hash(grams))
        distinct = np.asarray(distinct)
        first = np.empty(len(distinct), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        order = np.argsort(distinct)
        values = np.empty((len(distinct), len(self.model.languages)), np.float32)
        values[order] = self._values(distinct[order], grams[:, first[order]])
        letters = np.add.reduceat((codes != 0).astype(np.int64), starts)
        length = np.diff(np.append(starts, len(codes)))
        sums = np.stack([np.add.reduceat(values[:, k][which].astype(np.float64), starts) for k in range(values.shape[1])], axis=1)
        return -sums / length[:, None], letters

    def predict(self, texts: list[str | None], tolerance: float) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and whether rejected."""
        m = self.model
        if not m.languages:
            n = len(texts)
            return ["und"] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
        lang, score, cross, bad = [], [], [], []
        a = 0
        while a < len(texts):
            b, held = a, 0
            while b < len(texts) and (b == a or held + len(texts[b] or "") <= self.chars):
                held += len(texts[b] or "")
                b += 1
            h, letters = self.entropies([t or "" for t in texts[a:b]])
            best = h.argmin(axis=1)
            low = h[np.arange(len(h)), best]
            # posterior of equal priors, letters taken as independent up to 50 of them
            p = 1 / np.exp(-np.minimum(letters, 50)[:, None] * (h - low[:, None])).sum(axis=1)
            limit = m.mean[best] + tolerance * np.sqrt(m.spread[0][best] + m.spread[1][best] / np.maximum(letters, 1))
            limit = np.maximum(limit, m.mean[best] + UNLIKE * (np.log(m.own[best] + 2) - m.mean[best]))
            none = letters == 0
            lang += ["und" if x else m.languages[k] for x, k in zip(none, best)]
            score.append(np.where(none, 0.0, p))
            cross.append(np.where(none, np.nan, low))
            bad.append(none | (low > limit))
            a = b
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return lang, join(score, float), join(cross, float), join(bad, bool)


def _calibrate(model: Model, h: np.ndarray, letters: np.ndarray) -> None:
    """From (language number, cross-entropy, letters) of held-back training rows."""
    n = len(model.languages)
    model.mean, a, b = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        own = h[:, 0] == k
        x, size = h[own, 1], letters[own]
        model.mean[k] = x.mean() if len(x) else np.log(model.own[k] + 2)  # as of its random letters
        d2, inv = (x - model.mean[k]) ** 2, 1 / np.maximum(size, 1)
        if len(x) > 2:
            slope = max(0.0, float(np.polyfit(inv, d2, 1)[0])) if np.ptp(inv) > 0 else 0.0
            b[k], a[k] = slope, max(float((d2 - slope * inv).mean()), 1e-4)
        else:
            a[k] = 0.04  # too few rows to tell
    model.spread = np.stack([a, b])


def train(rows: DataFrame, text_col: str, lang_col: str, id_col: str, order: int = ORDER, rows_per_language: int = ROWS_PER_LANGUAGE, chars_per_language: int = CHARS_PER_LANGUAGE) -> Model:
    """rows: all that may be learned from. Three jobs: language counts, alphabet with n-gram counts, calibration."""
    spark = rows.sparkSession
    small_batches(spark)
    rows = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    found = rows.groupBy("_lang").agg(F.count("*").alias("n"), F.sum(F.length("_text")).alias("chars")).collect()  # one row a label
    per, chars = {r["_lang"]: r["n"] for r in found}, {r["_lang"]: max(1, r["chars"]) for r in found}
    languages = sorted(per)
    if not languages:
        return Model([], Alphabet(""), order, [], [], 0.0)
    labels = pa.table({"_lang": languages, "_k": pa.array(range(len(languages)), pa.int32()), "_rate": [min(1.0, rows_per_language / per[x], chars_per_language / chars[x] if per[x] >= FEW else 1.0) for x in languages], "_few": [per[x] < FEW for x in languages]})
    draw = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1_000_000)) / 1_000_000
    sample = rows.join(spark.createDataFrame(labels), "_lang").filter(draw < F.col("_rate")).select("_id", "_text", "_k", "_few")
    # every tenth row is held back for calibration
    held = (F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(1)), F.lit(10)) == 0) & ~F.col("_few")
    learn, check = sample.filter(~held), sample.filter(held)

    def letters_of(batches):
        from collections import Counter

        total: Counter = Counter()
        for b in batches:
            for t in b.column("_text").to_pylist():
                total.update(c for c in set(_folded(t)) if c.isalpha())
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], names=["c", "n"])

    letters = "".join(r["c"] for r in learn.mapInArrow(letters_of, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").collect())
    alphabet = Alphabet(letters)

    def counts_of(batches):
        for batch in batches:
            k = batch.column("_k").to_numpy()
            texts = batch.column("_text").to_pylist()
            for lang in np.unique(k):
                codes, starts = alphabet.codes([t for t, x in zip(texts, k) if x == lang])
                g = _grams(codes, starts, order, alphabet.bits)
                _, first, n = np.unique(_hash(g), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), lang, np.int32)), *map(pa.array, g[:, first]), pa.array(n.astype(np.int64))], names=["lang", *words, "n"])

    words = [f"g{w}" for w in range(-(-order // (63 // alphabet.bits)))]
    schema = ", ".join(["lang int", *(f"{w} bigint" for w in words), "n bigint"])
    counts = learn.mapInArrow(counts_of, schema).groupBy("lang", *words).agg(F.sum("n").alias("n")).toArrow()
    grams = np.stack([counts[w].to_numpy() for w in words])
    model = build_model(languages, letters, order, counts["lang"].to_numpy().astype(np.int64), grams, counts["n"].to_numpy())
    share = spark.sparkContext.broadcast(model)

    def entropies_of(batches):
        scorer = Scorer(share.value)
        for b in batches:
            texts = b.column("_text").to_pylist()
            for i in range(0, len(texts), 100):
                h, n = scorer.entropies(texts[i : i + 100])
                k = b.column("_k").to_numpy()[i : i + 100]
                ok = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(k[ok].astype(np.float64)), pa.array(h[np.arange(len(k)), k][ok]), pa.array(n[ok])], names=["k", "h", "n"])

    own = check.mapInArrow(entropies_of, "k double, h double, n bigint").orderBy("k", "h", "n").toArrow()
    _calibrate(model, np.stack([own["k"].to_numpy(), own["h"].to_numpy()], axis=1), own["n"].to_numpy())
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


ADDED = ("lang_pred", "lang_score", "lang_cross_entropy", "lang_rejected")


def identify(docs: DataFrame, model: Model, text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """Adds lang_pred, lang_score, lang_cross_entropy and lang_rejected to the rows of docs."""
    small_batches(docs.sparkSession)
    # The model is bounded by the training sample, never by the input.
    share = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*(c for c in ADDED if c != text_col))
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(share.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, score, cross, bad = scorer.predict(batch.column(at).to_pylist(), tolerance)
            more = [pa.array(lang, pa.string()), pa.array(score), pa.array(cross), pa.array(bad)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*(f"c{i}" for i in range(batch.num_columns)), "p", "s", "h", "r"])

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    out = plain.mapInArrow(run, f"{schema}, p string, s double, h double, r boolean")
    return out.toDF(*docs.columns, *ADDED)


def drop_unidentified(docs: DataFrame, model: Model, text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of docs that are not rejected."""
    small_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(share.value)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(~scorer.predict(batch.column(at).to_pylist(), tolerance)[3]))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()), "text", "lang", "doc_id")
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_rejected")
