"""MinHash near-dedup by a chosen-path set similarity join (operator 4).

1. Every document becomes a set of hashed word shingles, a sketch of COORDINATES minwise values and TREES roots.
   Documents with equal sets are one vertex from here on.
2. Each tree starts from one minwise value. A node with few documents is compared exhaustively, on sketches; a
   larger one is branched along two more coordinates, chosen by the node's path alone, so documents that are
   similar stay together on some branch. Trees are independent; with J the similarity, a pair misses all of them
   with at most about (1 - 0.94 J)^TREES, 2e-6 at J = 0.8. Nodes too large for one task are branched by Spark
   first, and what does not come apart there (masses of near copies) is split as below.
   Nodes return a spanning forest of candidate links, so rows stay linear in the documents.
3. Components of the candidate links bound what has to be looked at. In each, links are confirmed on the full sets by a
   breadth-first search that compares a document with those not reached yet.
4. Components of the confirmed links are the groups.

A node or component too large for a task, by documents, shingles or bytes, is split without a cap on partners: it is dealt
in blocks that share some hubs, each searched by itself; then the documents that have not come together with its largest
group are compared with every document of another group, a chunk of them with a block at a time. Near copies come
together over the hubs, so little is left to ask; a component of many groups is asked block by block, as an exact answer needs.

Defined cases: null and empty texts, and those without words, have empty sets and link with nothing; fewer words than
a shingle make one shingle of all; repeated rows are equal sets; rows that repeat an id with other texts
each have the component of their text; null ids link with nothing and are not kept; ids that are no integers are refused.
Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import by_group, small_batches, table, written
from starloom.llm.components import Forest, components
from starloom.llm.shingles import fingerprint, mixed, shingle_sets, slices

WORDS, SIMILARITY = 2, (80, 100)
TREES, COORDINATES = 10, 64
SMALL = 40  # documents that a node compares exhaustively
DEPTH = 7  # branchings inside a task
NODE = 6000  # documents of a node that one task takes
LEVELS = 3  # branchings by Spark of larger nodes
BLOCK = 4_000_000  # shingles of a component that one task takes
BYTES = 32 << 20  # of text that one task takes, but for a longer document
DOCS = 64  # documents of a block of a split component; components of up to four times as many are not split
ASKED = 128, 1024  # documents of a block that what is left is compared with: as many as are left, within these bounds
HUBS = 16
#: Equal coordinates, of 64, that make a candidate: five deviations below the mean at the least similarity.
SLACK = 5.0


def least_equal(similarity: tuple[int, int], coordinates: int = COORDINATES) -> int:
    j = similarity[0] / similarity[1]
    return max(1, int(coordinates * j - SLACK * (coordinates * j * (1 - j)) ** 0.5))


_rng = np.random.default_rng(4711)
_XOR = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_TIMES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For non-empty sets: [sets, COORDINATES] 16-bit values and [sets, TREES] roots."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    flat = np.concatenate(sets)
    least = np.stack([np.minimum.reduceat((flat ^ _XOR[c]) * _TIMES[c], starts) for c in range(COORDINATES)], axis=1)
    roots = mixed(least[:, :TREES] + np.arange(TREES, dtype=np.uint64))
    return (mixed(least) >> np.uint64(48)).astype(np.uint16).view(np.int16), roots.view(np.int64)


def sketch_table(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc, n, bytes, print, sketch, roots. Written to the shared folder."""
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}: number the documents by integers first")

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, 400_000):
                sets = shingle_sets(texts[a:b], words)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                sketch, roots = np.zeros((b - a, COORDINATES), np.int16), np.zeros((b - a, TREES), np.int64)
                if len(full):
                    sketch[full], roots[full] = sketches([sets[i] for i in full])
                rows = lambda m, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel(), kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary()), rows(sketch, pa.int16()), rows(roots, pa.int64())],
                    names=["doc", "n", "bytes", "print", "sketch", "roots"],
                )

    source = docs.select(F.col(id_col).cast("long"), text_col)
    return written(source.mapInArrow(run, "doc bigint, n bigint, bytes bigint, print binary, sketch array<smallint>, roots array<bigint>"), "sketches")


class NodeJoin:
    """The part of a tree below a node, in one task."""

    def __init__(self, sketch: np.ndarray, n: np.ndarray, similarity: tuple[int, int]):
        self.s, self.n, self.least, self.ratio = sketch, n, least_equal(similarity), similarity
        self.forest = Forest(len(n))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Candidates by sketch and size: matrix of a against b."""
        lo, hi = np.minimum(self.n[a][:, None], self.n[b]), np.maximum(self.n[a][:, None], self.n[b])
        return ((self.s[a][:, None, :] == self.s[b][None]).sum(axis=2) >= self.least) & (lo * self.ratio[1] >= hi * self.ratio[0])

    def branch(self, rows: np.ndarray, seed: int, depth: int = 0) -> None:
        if len(rows) <= SMALL:
            for i, j in np.argwhere(np.triu(self.near(rows, rows), 1)).tolist():
                self.forest.join(int(rows[i]), int(rows[j]))
        elif depth >= DEPTH:
            self.search(rows)
        else:
            for j in (1, 2):
                step = hash((seed, j, depth)) & 0xFFFFFFFF
                value = self.s[rows, step % COORDINATES]
                order = np.argsort(value, kind="stable")
                cuts = np.flatnonzero(np.diff(value[order])) + 1
                for part in np.split(rows[order], cuts):
                    if len(part) > 1:
                        self.branch(part, hash((step, int(self.s[part[0], step % COORDINATES]))), depth + 1)

    def search(self, rows: np.ndarray) -> None:
        """Breadth first: each document against those not reached yet. Linear for near copies, exact for any."""
        left = rows
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                x = np.array(queue[-8:])
                del queue[-8:]
                close = self.near(x, left)
                hit = close.any(axis=0)
                for j in np.flatnonzero(hit).tolist():
                    self.forest.join(int(x[close[:, j].argmax()]), int(left[j]))
                queue += left[hit].tolist()
                left = left[~hit]


def _forest_links(similarity):
    """Batches sorted by node -> candidate links (a, b)."""

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held).combine_chunks()
        node, rep, n = (t.column(c).to_numpy() for c in ("node", "rep", "n"))
        sketch = t.column("sketch").chunk(0).flatten().to_numpy().reshape(-1, COORDINATES)
        join = NodeJoin(sketch, n, similarity)
        cuts = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]))
        size = np.diff(cuts)
        two = cuts[:-1][size == 2]  # most nodes: pairs, all at once
        if len(two):
            lo, hi = np.minimum(n[two], n[two + 1]), np.maximum(n[two], n[two + 1])
            ok = ((sketch[two] == sketch[two + 1]).sum(axis=1) >= join.least) & (lo * similarity[1] >= hi * similarity[0])
            for i in two[ok].tolist():
                join.forest.join(i, i + 1)
        for k in np.flatnonzero(size > 2).tolist():
            join.branch(np.arange(cuts[k], cuts[k + 1]), int(node[cuts[k]]))
        roots = np.array([join.forest.root(i) for i in range(len(rep))])
        out = np.flatnonzero((roots != np.arange(len(rep))) & (rep != rep[roots]))
        return pa.RecordBatch.from_arrays([pa.array(rep[out]), pa.array(rep[roots[out]])], names=["a", "b"]) if len(out) else None

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            if rows >= 8192:
                last = held[-1].column("node")[-1].as_py()
                stop = int(np.searchsorted(node != last, True)) if node[0] == last else 0
                if stop < len(node):  # a node ends in this batch
                    if stop:
                        held.append(batch.slice(0, stop))
                    if (out := chunk(held)) is not None:
                        yield out
                    held, rows, batch = [], 0, batch.slice(stop)
            held.append(batch)
            rows += batch.num_rows
        if held and (out := chunk(held)) is not None:
            yield out

    return run


def candidate_links(reps: DataFrame, similarity=SIMILARITY, node_rows: int = NODE, levels: int = LEVELS) -> DataFrame:
    """reps: rep, n, sketch, roots. Spanning forests of the candidates of all nodes of all trees, as (a, b)."""
    rows = reps.select("rep", "n", "sketch", F.posexplode("roots").alias("tree", "root")).select(F.xxhash64("tree", "root").alias("node"), "rep", "n", "sketch")
    done: list[DataFrame] = []
    split = members = sketch = None
    for level in range(levels + 1):
        large = written(rows.groupBy("node").agg(F.count("*").alias("_n")).filter(F.col("_n") > node_rows), "large-nodes")
        if not large.limit(1).count():
            done.append(rows)
            break
        done.append(rows.join(large, "node", "left_anti"))
        big = rows.join(large, "node")
        if level < levels:
            step = F.pmod(F.xxhash64("node", "_j"), F.lit(COORDINATES)).cast("int")
            big = big.withColumn("_j", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("_step", step)
            rows = big.select(F.xxhash64("node", "_j", F.element_at("sketch", F.col("_step") + 1)).alias("node"), "rep", "n", "sketch")
        else:
            members = written(big.select(F.col("node").alias("key"), "rep", F.lit(0).alias("n"), F.lit(0).alias("bytes")), "node-members")
            sketch = reps.select(F.col("rep").alias("_rep"), F.col("n").alias("_size"), "sketch")
            split = written(in_blocks(members, node_rows, node_rows), "node-blocks")
            hubs = split.select("rep", "task").join(sketch, F.col("rep") == F.col("_rep")).select(F.col("task").alias("node"), "rep", F.col("_size").alias("n"), "sketch")
            done.append(hubs)
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    links = every.repartition(F.col("node")).sortWithinPartitions("node", "rep").mapInArrow(_forest_links(similarity), "a bigint, b bigint").distinct()
    if split is None:
        return links
    links = written(links, "node-links")

    def ask(group: pa.Table):
        n, rep, asking, of = (group[c].to_numpy(zero_copy_only=False) for c in ("n", "rep", "asks", "_group"))
        values = group["sketch"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)
        join, out = NodeJoin(values, n, similarity), set()
        rest = np.flatnonzero(~asking)
        for x in np.flatnonzero(asking).tolist():
            other = rest[of[rest] != of[x]]
            if len(other):
                out |= {(int(of[x]), int(y)) for y in np.unique(of[other[join.near(np.array([x]), other)[0]]]).tolist()}
        return _link_batch(out)

    asked = to_ask(in_groups(members, components(links)), (node_rows, node_rows)).join(sketch, F.col("rep") == F.col("_rep"))
    more = by_group(asked.select("task", "rep", F.col("_size").alias("n"), "sketch", "_group", "asks"), "task", ask, "a bigint, b bigint", "rep")
    return links.union(written(more, "node-asked")).distinct()


def _link_batch(pairs) -> pa.RecordBatch | None:
    a, b = zip(*sorted(pairs)) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if pairs else None


def _pieces(docs: int | Column, block: int, size: int) -> Column:
    """How many parts of at most so many documents, shingles and bytes the sums _docs, _n and _bytes make."""
    return F.greatest(F.lit(1), F.ceil(F.col("_docs") / docs), F.ceil(F.col("_n") / block), F.ceil(F.col("_bytes") / size)).cast("int")


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("_docs"), F.sum("n").alias("_n"), F.sum("bytes").alias("_bytes"))


def in_blocks(members: DataFrame, whole: int, docs: int, block: int = BLOCK, size: int = BYTES) -> DataFrame:
    """members: key, rep, n, bytes and more. Adds task, split (whether the key has several blocks: those of up to `whole`
    documents that fit a task have one) and hub: hubs of a split key are in all its blocks."""
    sums = _sums(members).withColumn("_blocks", F.when((F.col("_docs") <= whole) & (_pieces(whole, block, size) == 1), F.lit(1)).otherwise(_pieces(docs, block, size)))
    dealt = members.join(sums.select(F.col("key").alias("_key"), "_blocks", "_docs"), F.col("key") == F.col("_key")).drop("_key").withColumn("split", F.col("_blocks") > 1)
    # blocks and hubs of a document differ from key to key, so that trees stay independent
    dealt = dealt.withColumn("hub", F.col("split") & (F.pmod(F.xxhash64("rep", "key", F.lit(11)), F.greatest(F.lit(1), F.ceil(F.col("_docs") / HUBS))) == 0))
    own = F.array(F.pmod(F.xxhash64("rep", "key"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_block", F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(own)))
    return dealt.withColumn("task", F.xxhash64("key", "_block")).drop("_block", "_blocks", "_docs")


def in_groups(members: DataFrame, found: DataFrame) -> DataFrame:
    """Adds _group, by found: (id, component), and _left: whether that is not the largest of the key."""
    grouped = members.join(found.select(F.col("id").alias("_id"), F.col("component").alias("_component")), F.col("rep") == F.col("_id"), "left")
    grouped = grouped.withColumn("_group", F.coalesce("_component", "rep")).drop("_id", "_component")
    main = grouped.groupBy("key", "_group").agg(F.count("*").alias("_m")).groupBy(F.col("key").alias("_key")).agg(F.max_by("_group", F.struct("_m", "_group")).alias("_main"))
    return grouped.join(main, F.col("key") == F.col("_key")).withColumn("_left", F.col("_group") != F.col("_main")).drop("_key", "_main")


def around_anchors(members: DataFrame, placed: DataFrame) -> DataFrame:
    """placed: task, key, rep, root, hub, size: of the members of split keys, their root and its group's size in each block they are in.

    The hub that has most documents around it is its key's anchor: what came together with it in any block is one group,
    the rest is left, each with its block's group. Adds _group and _left.
    """
    around = placed.filter("hub").groupBy("key", "rep").agg(F.sum("size").alias("_m"))
    anchors = around.groupBy(F.col("key").alias("_key")).agg(F.max_by("rep", F.struct("_m", "rep")).alias("_anchor"))
    at = placed.filter("hub").join(anchors, (F.col("key") == F.col("_key")) & (F.col("rep") == F.col("_anchor"))).select(F.col("task").alias("_task"), F.col("root").alias("_at"), "_anchor")
    seen = placed.join(at, F.col("task") == F.col("_task"), "left").withColumn("_near", F.coalesce(F.col("root") == F.col("_at"), F.lit(False)))
    seen = seen.groupBy(F.col("key").alias("_key"), F.col("rep").alias("_rep")).agg(F.max("_near").alias("_near"), F.max("_anchor").alias("_anchor"), F.min("root").alias("_root"))
    grouped = members.join(seen, (F.col("key") == F.col("_key")) & (F.col("rep") == F.col("_rep")))
    return grouped.withColumn("_group", F.when(F.col("_near"), F.col("_anchor")).otherwise(F.col("_root"))).withColumn("_left", ~F.col("_near")).drop("_key", "_rep", "_near", "_anchor", "_root")


def to_ask(grouped: DataFrame, docs: tuple[int, int] = ASKED, block: int = BLOCK, size: int = BYTES) -> DataFrame:
    """Documents that are left (as chunks that ask) and all others of their key (as blocks), dealt so that each of the first meets
    each document of another group in one task.

    grouped: key, rep, n, bytes, _group, _left and more, one row a document and key. Adds asks, task. Written.
    """
    grouped = written(grouped, "split")
    left = _sums(grouped.filter("_left"))
    fits = F.greatest(F.lit(docs[0]), F.least(F.lit(docs[1]), F.col("_docs")))
    chunks = left.select(F.col("key").alias("_key2"), fits.alias("_fits"), _pieces(fits, block, size).alias("_chunks"))
    sums = _sums(grouped).join(chunks, F.col("key") == F.col("_key2"))  # keys with nothing left go
    sums = sums.select(F.col("key").alias("_key"), "_chunks", _pieces(F.col("_fits"), block, size).alias("_blocks"))
    grouped = grouped.join(sums, F.col("key") == F.col("_key"))
    draw = F.xxhash64("rep", "key", F.lit(13))
    block_of, chunk_of = F.pmod(draw, F.col("_blocks")).cast("int"), F.pmod(draw, F.col("_chunks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = [c for c in grouped.columns if c not in ("key", "n", "bytes", "_left", "_key", "_chunks", "_blocks")]
    as_block = grouped.withColumn("_other", every("_chunks")).select(*keep, F.lit(False).alias("asks"), F.xxhash64("key", block_of, "_other").alias("task"))
    asks = grouped.filter("_left").withColumn("_other", every("_blocks")).select(*keep, F.lit(True).alias("asks"), F.xxhash64("key", "_other", chunk_of).alias("task"))
    return written(as_block.union(asks), "asked")


class SetSearch:
    """Exact links among some documents' full sets."""

    def __init__(self, sets: list[np.ndarray], similarity):
        self.size = np.array([len(s) for s in sets], np.int64)
        flat, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.flag = np.zeros(len(flat), np.int64)
        self.ratio = similarity

    def linked(self, x: int, others: np.ndarray) -> np.ndarray:
        """Which of the others link with x."""
        fits = np.minimum(self.size[others], self.size[x]) * self.ratio[1] >= np.maximum(self.size[others], self.size[x]) * self.ratio[0]
        some = others[fits]
        if not len(some):
            return some
        mine = self.ids[self.at[x] : self.at[x + 1]]
        self.flag[mine] = 1
        if len(some) < len(self.size) // 4 or len(some) < 64:
            common = np.array([self.flag[self.ids[self.at[y] : self.at[y + 1]]].sum() for y in some.tolist()])
        else:
            common = np.add.reduceat(self.flag[self.ids], self.at[:-1])[some]
        self.flag[mine] = 0
        union = self.size[some] + self.size[x] - common
        return some[self.ratio[1] * common >= self.ratio[0] * union]

    def groups(self) -> Forest:
        forest = Forest(len(self.size))
        left = np.arange(len(self.size))
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                x = queue.pop()
                hit = self.linked(x, left)
                for y in hit.tolist():
                    forest.join(x, y)
                queue += hit.tolist()
                left = left[~np.isin(left, hit, assume_unique=True)] if len(hit) else left
        return forest


def _sets_of(group: pa.Table, words: int) -> tuple[list[np.ndarray], list[int]]:
    """Sets of the rows whose text has the fingerprint of the vertex, and their row numbers."""
    texts = [t or "" for t in group["text"].to_pylist()]
    sets: list[np.ndarray] = []
    for a, b in slices(texts):
        sets += shingle_sets(texts[a:b], words)
    ok = [i for i, (s, p) in enumerate(zip(sets, group["print"].to_pylist())) if fingerprint(s) == p]
    return [sets[i] for i in ok], ok


def confirmed_links(docs: DataFrame, members: DataFrame, words: int, similarity, block: int = BLOCK, part: int = DOCS) -> DataFrame:
    """docs: doc, text. members: key (the candidates' component), rep, n, bytes, print. Links (a, b) that span each true component."""
    members = written(members, "members")
    inside = written(in_blocks(members, 4 * part, part, block), "blocks")
    texts = docs.select(F.col("doc").alias("_doc"), "text")
    # Texts meet their vertices by a merge join at every size, then are spread again by task, so that
    # whole groups come to one task.
    rows = texts.join(inside.select("task", "key", "rep", "print", "split", "hub").hint("merge"), F.col("_doc") == F.col("rep")).drop("_doc")

    def search(group: pa.Table):
        sets, ok = _sets_of(group, words)
        if not sets:
            return None
        group = group.take(pa.array(ok))
        rep, split = group["rep"].to_numpy(), group["split"].to_numpy(zero_copy_only=False)
        forest = SetSearch(sets, similarity).groups()
        roots = np.array([forest.root(i) for i in range(len(rep))])
        size = np.bincount(roots, minlength=len(rep))[roots]
        out = pa.array(np.flatnonzero((rep != rep[roots]) | split))  # of split components every document, else links only
        more = [pa.array(rep[roots]).take(out), pa.array(size).take(out)]
        return pa.RecordBatch.from_arrays([*(group[c].combine_chunks().take(out) for c in ("task", "key", "rep", "split", "hub")), *more], names=["task", "key", "rep", "split", "hub", "root", "size"])

    found = written(by_group(rows, "task", search, "task bigint, key bigint, rep bigint, split boolean, hub boolean, root bigint, size bigint", "rep"), "links-confirmed")
    links = found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    placed = found.filter("split").drop("split")
    if not placed.limit(1).count():
        return links

    def ask(group: pa.Table):
        sets, ok = _sets_of(group, words)
        if len(sets) < 2:
            return None
        asking, of = group["asks"].to_numpy(zero_copy_only=False)[ok], group["_group"].to_numpy()[ok]
        find, out = SetSearch(sets, similarity), set()
        rest = np.flatnonzero(~asking)
        for x in np.flatnonzero(asking).tolist():
            hit = find.linked(x, rest[of[rest] != of[x]])
            out |= {(int(of[x]), int(y)) for y in np.unique(of[hit]).tolist()}
        return _link_batch(out)

    # The table is written, so texts of what is asked do not move by another merge join unless it is large.
    asked = to_ask(around_anchors(members, placed), ASKED, block)
    more = by_group(texts.join(asked, F.col("_doc") == F.col("rep")).select("task", "rep", "print", "text", "_group", "asks"), "task", ask, "a bigint, b bigint", "rep")
    return links.union(written(more, "links-asked"))


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, node_rows: int = NODE, block: int = BLOCK, part: int = DOCS) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    small_batches(spark)
    marks = sketch_table(docs, id_col, text_col, words)
    usable = marks.filter("n > 0 and doc is not null")
    reps = usable.groupBy("print").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.max("bytes").alias("bytes"), F.first("sketch").alias("sketch"), F.first("roots").alias("roots"))
    reps = written(reps, "set-classes")
    candidates = components(candidate_links(reps, similarity, node_rows)).withColumnRenamed("id", "rep")
    members = reps.select("rep", "n", "bytes", "print").join(candidates, "rep").withColumnRenamed("component", "key")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    # Of several sets under one id, one is confirmed.
    same = reps.groupBy("rep").agg(F.min("print").alias("print")).select("rep", "print")
    links = confirmed_links(texts, members.join(same, ["rep", "print"], "left_semi"), words, similarity, block, part)
    found = components(links).select(F.col("id").alias("_id"), F.col("component").alias("_component"))
    classes = reps.select(F.col("print").alias("_print"), "rep").join(found, F.col("rep") == F.col("_id"), "left").select("_print", F.coalesce("_component", "rep").alias("_component"))
    out = marks.join(classes, (F.col("print") == F.col("_print")) & (F.col("n") > 0) & F.col("doc").isNotNull(), "left")
    component = F.coalesce("_component", "doc")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 5, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The documents that stay, with the columns of docs: one of each group, that with the smallest id."""
    marked = near_duplicates(docs, id_col, text_col, words, similarity)
    gone = marked.groupBy(id_col).agg(F.max("kept").alias("_any")).filter("not _any").select(F.col(id_col).alias("__gone"))
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w
), n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, n, unnest(s) AS x FROM s JOIN n USING (doc_id)),
f AS (SELECT x, count(*) AS df FROM e GROUP BY x),
o AS (SELECT e.doc_id, e.n, e.x, row_number() OVER (PARTITION BY e.doc_id ORDER BY f.df, e.x) AS r FROM e JOIN f USING (x)),
p AS (SELECT doc_id, n, x FROM o WHERE r <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
v AS (SELECT c.a, c.b, len(list_intersect(sa.s, sb.s)) AS i, len(sa.s) + len(sb.s) AS t FROM c JOIN s sa ON sa.doc_id = c.a JOIN s sb ON sb.doc_id = c.b),
l AS (SELECT a, b FROM v WHERE 100 * i >= 80 * (t - i)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS other FROM g UNION SELECT r.id, g.b FROM r JOIN g ON r.other = g.a),
m AS (SELECT id, min(other) AS component FROM r GROUP BY id)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.component, n.doc_id) AS component_id, coalesce(m.component, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN m ON m.id = n.doc_id
"""
