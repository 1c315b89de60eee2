"""Best-fit packing by swap-based local search (operator 8).

Documents are tokenised once. A document longer than a sequence is cut from its end, so that all its pieces
but the first are full; full pieces are sequences of their own. The other pieces, a few integers each, are
dealt by hash over partitions and packed there in blocks of at most `block` pieces: best-fit decreasing, and
local search among the bins that still have room, by turns for long, middling and short pieces. A move puts a piece of one bin into a fuller one, a one-for-one
exchange swaps a longer piece in for a shorter one, a two-for-one exchange swaps one piece in for two that
are shorter together (or the reverse, or two for two). Every step raises the sum of squared fills. Bins are drained
from the emptiest up, each against all open bins and all their pieces, and those that become empty go, until no step is
left, or until as few bins are left as a lower bound allows. After `steps` exchanges a search ends early; that
bounds its time, and its bins are as full as it got them. What blocks cost is less than one sequence each.

Ids are those of the tokenizers library, also where a text has the string of an added token such as <|endoftext|>.

Defined cases: null and empty texts have one token, the end of text; repeated rows and ids are packed each for
themselves; an empty table gives no rows. Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import small_batches, table

LENGTH = 1024
BLOCK = 100_000
STEPS = 20_000
STAGES = (4, 8)
END = 2
VOCABULARY = "byte_bpe_50k.json"

_encoders: dict = {}


def encoder(vocabulary: str = VOCABULARY):
    """texts -> lists of ids, as the tokenizers library gives them for a file of public_tokenizers.

    The byte-level vocabulary exists as ranks for tiktoken too, which gives the same ids several times as fast. Added
    tokens that are plain strings are cut out of the text first, as tokenizers does; tests/llm compares the two libraries.
    """
    if vocabulary not in _encoders:
        import public_tokenizers as public

        with open(public.path(vocabulary), encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        plain = not any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added)
        if vocabulary == "byte_bpe_50k.json" and plain:
            import tiktoken

            with open(public.path("byte_bpe_50k.tiktoken"), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            one = tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
            ids = {a["content"]: a["id"] for a in added}
            border = re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")") if ids else None

            def encode(text: str) -> list[int]:
                if border is None or not border.search(text):
                    return one.encode_ordinary(text)
                out: list[int] = []
                for part in border.split(text):
                    out += [ids[part]] if part in ids else one.encode_ordinary(part)
                return out

            _encoders[vocabulary] = lambda texts: [encode(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(public.path(vocabulary))
            _encoders[vocabulary] = lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    return _encoders[vocabulary]


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first may be short."""
    first = (n - 1) % length + 1
    return [(0, first), *((s, length) for s in range(first, n, length))]


def pieces(docs: DataFrame, id_col="doc_id", text_col="text", length: int = LENGTH, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    ids.append(end)
                    raw = np.asarray(ids, "<u4").tobytes()
                    rows += [(doc, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cuts(len(ids), length))]
            if rows:
                a = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[0], batch.schema.field(0).type), pa.array(a[1], pa.int32()), *(pa.array(x, pa.int64()) for x in a[2:])],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: np.ndarray, length: int, pieces: np.ndarray | None = None, bins: list[list[int]] | None = None) -> tuple[list[list[int]], list[int]]:
    """Best-fit decreasing of all or some pieces, into the bins given and new ones. Bins are kept by room left, so a piece costs a
    look-up of at most `length` rooms."""
    bins = [] if bins is None else bins
    fill = [int(sizes[b].sum()) for b in bins]
    pieces = np.arange(len(sizes)) if pieces is None else pieces
    room: list[list[int]] = [[] for _ in range(length + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for b, f in enumerate(fill):
        room[length - f].append(b)
        open_rooms |= 1 << (length - f)
    for i in pieces[np.argsort(-sizes[pieces], kind="stable")].tolist():
        n = int(sizes[i])
        if fits := open_rooms >> n:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b = length, len(bins)
            bins.append([])
            fill.append(0)
        bins[b].append(i)
        fill[b] += n
        room[r - n].append(b)
        open_rooms |= 1 << (r - n)
    return bins, fill


def packed(sizes: np.ndarray, length: int, stages: tuple[int, ...] = STAGES) -> list[list[int]]:
    """Best fit and local search by turns: pieces of at least length / 4 first, then shorter ones, so that the search closes bins while
    short pieces, which would only hide their gaps, are still to come. Bins of a single piece wait for those and are searched at the end."""
    bins: list[list[int]] = []
    above = length + 1
    for least in (*(length // k for k in stages), 0):
        bins, fill = best_fit(sizes, length, np.flatnonzero((sizes < above) & (sizes >= least)), bins)
        above = least
        apart = [least > 0 and len(b) < 2 for b in bins]
        some = [k for k, wait in enumerate(apart) if not wait]
        bins = [b for b, wait in zip(bins, apart) if wait] + local_search([bins[k] for k in some], [fill[k] for k in some], sizes, length)
    plain, fill = best_fit(sizes, length)
    return bins if len(bins) <= len(plain) else local_search(plain, fill, sizes, length)


def least_bins(sizes: np.ndarray, length: int) -> int:
    """No packing has fewer bins: by the sum, by pieces too long to share with others, and by how many of a size fit a bin."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=length + 1)
    many, total = np.cumsum(count[::-1])[::-1], np.cumsum((count * np.arange(length + 1))[::-1])[::-1]  # of at least that size
    half = length // 2 + 1
    best = max(-(-int(total[0]) // length), int(many[half]))
    for k in range(1, half):
        # pieces above length - k sit alone among those of at least k; the other long ones leave room for short ones
        alone = int(many[length - k + 1])
        long_, long_total = int(many[half]) - alone, int(total[half] - total[length - k + 1])
        short = int(total[k] - total[half])
        best = max(best, alone + long_ + max(0, -(-(short - (long_ * length - long_total)) // length)))
        best = max(best, -(-int(many[k]) // (length // k)))
    return best


class Exchange:
    """What a block's open bins can give in exchange: for each bin nothing, one piece or two, by distinct sizes, in flat arrays.

    A bin that changes has its old entries voided and new ones put at the end.
    """

    def __init__(self, contents: dict[int, list[int]], fill: dict[int, int], length: int):
        self.length, self.contents = length, contents
        self.fill = np.full(max(contents, default=0) + 1, length, np.int64)
        for b, f in fill.items():
            self.fill[b] = f
        self.span: dict[int, tuple[int, int]] = {}
        self.end = self.void = 0
        self.data = np.zeros((4, 1024), np.int64)  # value, bin, one size, another
        for b in contents:
            self._enter(b)

    @staticmethod
    def options(sizes: list[int], pairs: bool = True) -> list[tuple[int, int, int]]:
        have = Counter(sizes)
        kinds = sorted(have, reverse=True)
        out = [(x, x, 0) for x in kinds]
        if pairs:
            out += [(x + y, x, y) for i, x in enumerate(kinds) for y in kinds[i if have[x] > 1 else i + 1 :]]
        return out

    def _enter(self, b: int) -> None:
        rows = [(0, 0, 0), *self.options(self.contents[b])]
        if self.end + len(rows) > self.data.shape[1]:
            live = np.flatnonzero(self.data[0, : self.end] <= self.length)
            order = live[np.argsort(self.data[1, live], kind="stable")]
            kept = self.data[:, order]
            self.data = np.zeros((4, 2 * (len(order) + len(rows)) + 1024), np.int64)
            self.data[:, : len(order)], self.end = kept, len(order)
            bins, first = np.unique(kept[1], return_index=True)
            self.span = {int(x): (int(a), int(c)) for x, a, c in zip(bins, first, [*first[1:], len(order)])}
        a, c = self.end, self.end + len(rows)
        new = np.array(rows, np.int64).T
        self.data[0, a:c], self.data[1, a:c], self.data[2:, a:c] = new[0], b, new[1:]
        self.span[b], self.end = (a, c), c

    def _leave(self, b: int) -> None:
        a, c = self.span.pop(b)
        self.data[0, a:c] = 4 * self.length  # never shorter than what it is exchanged for

    def step(self, a: int, pairs: bool) -> bool:
        """The exchange that raises the sum of squared fills most by draining bin a into a fuller one; False if there is none."""
        value, where = self.data[0, : self.end], self.data[1, : self.end]
        fill = self.fill[where]
        usable = np.flatnonzero((value <= self.length) & (where != a) & (fill >= self.fill[a]) & (fill < self.length) & ((self.data[3, : self.end] == 0) | pairs))
        if not len(usable):
            return False
        value, fill = value[usable], fill[usable]
        room, above = self.length - fill, fill - self.fill[a]
        best, most = None, 0
        give = self.options(self.contents[a], pairs)
        per = max(1, 2_000_000 // len(usable))
        for i in range(0, len(give), per):
            part = give[i : i + per]
            d = np.array([g[0] for g in part], np.int64)[:, None] - value
            gain = np.where((d > 0) & (d <= room), d * (above + d), 0)
            k = int(gain.argmax())
            if gain.flat[k] > most:
                most, best = int(gain.flat[k]), (part[k // len(usable)], int(usable[k % len(usable)]))
        if best is None:
            return False
        (_, *out), entry = best
        b, into = int(where[entry]), [int(x) for x in self.data[2:, entry]]
        for x in filter(None, out):
            self.contents[a].remove(x)
            self.contents[b].append(x)
        for x in filter(None, into):
            self.contents[b].remove(x)
            self.contents[a].append(x)
        gained = sum(out) - sum(into)
        self.fill[a] -= gained
        self.fill[b] += gained
        for x in (a, b):
            self._leave(x)
            if 0 < self.fill[x] < self.length:
                self._enter(x)
        return True


def local_search(bins: list[list[int]], fill: list[int], sizes: np.ndarray, length: int, steps: int = STEPS) -> list[list[int]]:
    """Moves and exchanges among bins with room, until no step raises the sum of squared fills, or no bin can be saved."""
    least, count = least_bins(sizes[[i for b in bins for i in b]], length) if bins else 0, len(bins)
    contents = {k: [int(sizes[i]) for i in b] for k, b in enumerate(bins) if fill[k] < length}
    if count <= least or len(contents) < 2:
        return bins
    pieces: dict[int, list[int]] = {}  # the pieces in open bins by size: any of a size will do
    for k in contents:
        for i in bins[k]:
            pieces.setdefault(int(sizes[i]), []).append(i)
    search = Exchange(contents, {k: fill[k] for k in contents}, length)
    changed = True
    while changed and count > least and steps > 0:
        changed = False
        failed: set[tuple[int, ...]] = set()  # contents that found no step since the last change
        for a in sorted(contents, key=lambda b: int(search.fill[b])):
            while 0 < search.fill[a] < length and steps > 0 and (key := tuple(sorted(contents[a]))) not in failed:
                if not (search.step(a, False) or search.step(a, True)):
                    failed.add(key)
                    break
                failed.clear()
                changed, steps = True, steps - 1
            if search.fill[a] == 0 and contents[a] == []:
                count -= 1
                search.fill[a] = length  # closed
            if count <= least or steps <= 0:
                break
    return [b for k, b in enumerate(bins) if k not in contents] + [[pieces[x].pop() for x in c] for c in contents.values() if c]


def pack_block(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece."""
    bins = packed(lengths, length)
    of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, members in enumerate(bins):
        at = 0
        for i in members:
            of[i], offset[i] = k, at
            at += int(lengths[i])
    return of, offset


def pack(cut: DataFrame, id_col="doc_id", length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to pieces (in place of columns of these names). Any table with id and length does."""
    cut = cut.drop("sequence_id", "offset")

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []
        used = 0

        def flush():
            nonlocal held, used
            t = pa.Table.from_batches(held).combine_chunks()
            n = t.column("length").to_numpy().astype(np.int64)
            whole = n >= length
            seq, at = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            seq[whole] = first + used + np.arange(whole.sum())
            used += int(whole.sum())
            if (~whole).any():
                of, offset = pack_block(n[~whole], length)
                seq[~whole], at[~whole] = first + used + of, offset
                used += int(of.max()) + 1
            held = []
            return t.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(at)).to_batches(max_chunksize=20_000)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= block:
                yield from flush()
        if held:
            yield from flush()

    key = [id_col, *(c for c in ("piece", "start", "length", "ids_crc32") if c in cut.columns)]  # not the id alone: it may repeat or be null
    dealt = cut.repartition(F.xxhash64(*key)).sortWithinPartitions(*key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return dealt.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
