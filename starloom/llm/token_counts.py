"""Token counts without tokens: count-only Viterbi over a unigram vocabulary (operator 2).

An Aho-Corasick automaton lists all vocabulary pieces that end at each place of a word; dynamic programming
carries the best score and the number of pieces of the best segmentation. Ties go as in the unigram model of the
tokenizers library: among equal scores the piece that starts first (the longest) wins, a character that no piece
covers is an unknown with the smallest score less 10, and neighbouring unknowns count as one piece.

Text is prepared as by the Metaspace pre-tokenizer: spaces become U+2581, one is put in front unless there is one,
and segmentation does not cross into the next U+2581. So a text's count is the sum over its words, and words seen
before are looked up (at most MOST of them are remembered; then the memory starts afresh).

The default vocabulary is the ordinary pieces of `piece_bpe_32k.model` with their scores. That model merges pairs by rank and
falls back to bytes; here its pieces are a unigram vocabulary, so counts are those of that unigram model, not of the file's own.

Defined cases: null and empty texts have 0 tokens. Whole texts are counted, a word of any length in time linear in it; repeated
rows each for themselves. Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from starloom.llm.common import small_batches, table

MOST = 1_000_000
SPACE = "▁"
UNKNOWN = 10.0
_NONE = float("-inf")
VOCABULARY = "piece_bpe_32k.model"


def vocabulary(name: str = VOCABULARY) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece file with their scores."""
    import public_tokenizers as public
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public.path(name))
    ordinary = (i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)))
    return [(m.id_to_piece(i), m.get_score(i)) for i in ordinary]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN
        self.seen: dict[str, int] = {}

    def word(self, w: str) -> int:
        """Pieces of the best segmentation of one word."""
        n, unknown = len(w), self.unknown
        best, count = [_NONE] * (n + 1), [0] * (n + 1)
        single, unk = bytearray(n + 1), bytearray(n + 1)  # a piece of one character ends here; the best ends unknown
        best[0], done = 0.0, 0

        def close(upto: int) -> None:
            """All pieces that end up to here are known: where none covers the last character, it may be unknown."""
            nonlocal done
            while done < upto:
                done += 1
                if not single[done] and (total := best[done - 1] + unknown) > best[done]:
                    best[done], count[done], unk[done] = total, count[done - 1] + (not unk[done - 1]), 1

        # ends rise, and of those at one end the longest comes first: the earliest start wins ties
        for end, (length, score) in self.automaton.iter(w):
            if done < end:
                close(end)
            end += 1
            total = best[end - length] + score
            if total > best[end]:
                best[end], count[end] = total, count[end - length] + 1
            if length == 1:
                single[end] = 1
        close(n)
        return count[n]

    def text(self, t: str | None) -> int:
        if not t:
            return 0
        t = t.replace(" ", SPACE)
        first, *rest = (t if t[0] == SPACE else SPACE + t).split(SPACE)
        seen, total = self.seen, 0
        for w in rest:
            n = seen.get(w)
            if n is None:
                if len(seen) >= MOST:
                    seen.clear()
                n = self.word(SPACE + w)
                if len(w) <= 64:
                    seen[w] = n
            total += n
        return total


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = VOCABULARY) -> DataFrame:
    """Per row: id, n_tokens."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        if name not in _counters:
            _counters[name] = Counter(vocabulary(name))
        count = _counters[name].text
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t) for t in batch.column(1).to_pylist()], pa.int64())], names=[id_col, "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens bigint")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
