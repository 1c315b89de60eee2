"""Secret scan by a trigram inverted index (operator 3).

Each rule's regular expression is parsed once into a Boolean query over byte trigrams that any match must
contain (AND of a literal's trigrams, OR over alternatives). Blocks of documents are indexed in memory:
postings of the trigrams that some query names, by document of the block. The query is evaluated on the
postings, and only the candidates it leaves are verified with the regular expression, over their whole text.
A rule without a mandatory trigram (hex runs) scans every document. Index and verification both work on a
block at a time, so there is no exchange and memory is bounded by the block (`block_chars`, or one document).

Matching is on whole texts; offsets are code points, end exclusive. Null text counts as empty. Documents
without spans are returned too, with zero counts, the SHA-256 of the empty string and an empty span list.
Repeated rows are scanned each for themselves. Columns other than id and text are not read, whatever their names. The time is
linear in a text, also in long runs of one kind of character.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from starloom.llm.common import small_batches, table

BLOCK_CHARS = 2_000_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length counts
    least: int = 0
    any_case: bool = False
    base: bool = False
    #: Finds what the pattern finds, (start, end), for patterns that would look at long runs again from every start in them.
    finder: Callable[[str], Iterator[tuple[int, int]]] | None = None

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.A | (re.I if self.any_case else 0))


_RUN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?=\.eyJ)")  # whole runs, each looked at once
_REST = re.compile(r"\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Three runs of base64 with dots between, the first two with eyJ in front; the first may start inside its run. Linear in the text."""
    done = 0
    for run in _RUN.finditer(text):
        start = text.find("eyJ", max(run.start(), done), run.end())
        if start >= 0 and run.end() - start >= 11 and (rest := _REST.match(text, run.end())):
            done = rest.end()
            yield start, done


#: Base rules first; the order is that of kinds at the same start.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, False, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, False, True),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", finder=_tokens),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=~-]{20,}", any_case=True),
)

# A query is None (no trigram is mandatory), a trigram (int), ("and", [...]) or ("or", [...]).


def _join(kind: str, parts: list):
    parts = [p for p in dict.fromkeys(parts) if p is not None or kind == "or"]
    if not parts or kind == "or" and None in parts:
        return None
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _literal(text: str):
    raw = text.lower().encode()
    return _join("and", [raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)])


def _strings(items, most: int = 64) -> list[str] | None:
    """The finite set of strings that a part can match, if small."""
    out = [""]
    for op, arg in items:
        if op is sre.LITERAL:
            more = [chr(arg)]
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg):
            more = [chr(c) for _, c in arg]
        elif op is sre.SUBPATTERN:
            more = _strings(arg[3])
        elif op is sre.BRANCH:
            sets = [_strings(x) for x in arg[1]]
            more = None if None in sets else [s for x in sets for s in x]
        elif op is sre.MAX_REPEAT and arg[1] <= 2:
            one = _strings(arg[2])
            more = None if one is None else ["".join([s] * k) for s in one for k in range(arg[0], arg[1] + 1)]
        else:
            return None
        if more is None or len(out) * len(more) > most:
            return None
        out = [a + b for a in out for b in more]
    return out


def trigram_query(pattern: str):
    """What every match of the pattern must contain, in lower-cased bytes. Only ASCII literals are used."""

    def walk(items):
        found, held = [], []
        for item in [*items, None]:
            if item is not None and (s := _strings([*held, item])) is not None:
                held.append(item)
                continue
            if held:
                found.append(_join("or", [_literal(x) for x in _strings(held)]))
            held = []
            if item is None:
                break
            if _strings([item]) is not None:
                held = [item]
                continue
            op, arg = item
            if op is sre.SUBPATTERN:
                found.append(walk(arg[3]))
            elif op is sre.BRANCH:
                found.append(_join("or", [walk(x) for x in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                found.append(walk(arg[2]))
        return _join("and", found)

    return walk(list(sre_parse.parse(pattern)))


def _named(query, into: set[int]) -> set[int]:
    if isinstance(query, int):
        into.add(query)
    elif query is not None:
        for part in query[1]:
            _named(part, into)
    return into


class BlockIndex:
    """Postings of the wanted trigrams for one block of texts: trigram -> sorted document numbers."""

    def __init__(self, texts: list[str], wanted: np.ndarray):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.documents = np.arange(len(raw))
        data = np.frombuffer(b"\0".join(raw).lower(), np.uint8)  # bytes.lower() folds ASCII only
        self.postings: dict[int, np.ndarray] = {}
        if len(data) < 3:
            return
        slot = np.full(1 << 16, False)
        slot[wanted & 0xFFFF] = True
        low = (data[1:-1].astype(np.uint16) << 8) | data[2:]
        at = np.flatnonzero(slot[low])
        codes = data[at].astype(np.int64) << 16 | low[at]
        place = np.searchsorted(wanted, codes)
        hit = wanted[np.minimum(place, len(wanted) - 1)] == codes
        starts = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])[:-1]))
        doc = np.searchsorted(starts, at[hit], "right") - 1
        pairs = np.unique(place[hit].astype(np.int64) * len(raw) + doc)
        which = pairs // len(raw)
        for k in np.unique(which):
            self.postings[int(wanted[k])] = pairs[which == k] % len(raw)

    def find(self, query) -> np.ndarray:
        if query is None:
            return self.documents
        if isinstance(query, int):
            return self.postings.get(query, self.documents[:0])
        parts = sorted((self.find(q) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


@lru_cache(4)
def _plan(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    wanted: set[int] = set()
    for q in queries:
        _named(q, wanted)
    return [r.compiled() for r in rules], queries, np.array(sorted(wanted), np.int64)


def spans_of(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Per text: (start, rule number, end), sorted."""
    compiled, queries, wanted = _plan(rules)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    index = BlockIndex(texts, wanted)
    for k, (rule, pattern, query) in enumerate(zip(rules, compiled, queries)):
        # [x]+ with a least length matches the same maximal runs as [x]{least,}, and much faster
        if rule.group == 0 and rule.least and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
            pattern = re.compile(rule.pattern[:-1] + f"{{{rule.least},}}", pattern.flags)
        for d in index.find(query).tolist():
            if rule.finder is not None:
                found[d] += [(a, k, b) for a, b in rule.finder(texts[d])]
                continue
            for m in pattern.finditer(texts[d]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[d].append((m.start(), k, m.end()))
    for spans in found:
        spans.sort()
    return found


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: id and an array of (kind, start, end, base), by start and then in the order of the rules."""
    small_batches(docs.sparkSession)
    source = docs.select(id_col, text_col)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            a = 0
            while a < len(texts):
                b, held = a, 0
                while b < len(texts) and (b == a or held + len(texts[b]) <= BLOCK_CHARS):
                    held += len(texts[b])
                    b += 1
                spans = [[{"kind": rules[k].kind, "start": s, "end": e, "base": rules[k].base} for s, k, e in x] for x in spans_of(texts[a:b], rules)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(spans, pa.list_(kind))], names=[id_col, "spans"])
                a = b

    kind_of_id = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind_of_id}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    joined = "concat_ws(',', transform({}, s -> concat_ws(':', s.kind, s.start, s.end)))"
    count = "size(filter(spans, s -> s.kind = '{0}')) :: bigint as n_{0}"
    return found.selectExpr(
        "doc_id", *(count.format(k).replace(" :: bigint", "") for k in ("assign", "access", "hex")),
        f"sha2({joined.format('filter(spans, s -> s.base)')}, 256) as base_sha256", f"{joined.format('spans')} as spans",
    ).selectExpr("doc_id", *(f"cast(n_{k} as bigint) as n_{k}" for k in ("assign", "access", "hex")), "base_sha256", "spans")
