"""Embedding near-dedup by a subspace pigeonhole join (operator 1).

Unit vectors with cosine >= t are at most d = sqrt(2 - 2t) apart. After a fixed random rotation the coordinates
are split into BLOCKS blocks of few dimensions; the squared distance is the sum over blocks, so some block has
at most its proportional share d^2 * dims / all dims. Each block is range-joined under that budget, and the union of the
candidates over the blocks is verified exactly, by cosine in double precision.

A task holds the vectors of one label, or two chunks of a large label: a vector travels once for each chunk of its label,
and a pair meets in one task. There the vectors are ordered by median splits into compact tiles. A pair of tiles is range-joined in
the blocks in which their bounding boxes are within the budget, and not at all if the boxes are farther apart than d.
Pairs are never emitted; a task returns for each vector the number of links and links to the roots of its local components
(a forest). Vectors that are equal in all components travel once, as a class with its count. A chunk has at most
CHUNK_BYTES of numbers; the chunks of a label grow with its vectors, so a label of n vectors moves n^2 / chunk of them: vectors
of no particular direction share no smaller neighbourhoods that an exact join could use.

Defined cases: vectors are compared only when labels are equal and not null. A vector that is null, zero or has null
or non-finite components links with nothing and is its own component; finite ones of any size are scaled by their largest
component first. Vectors of different lengths link with nothing. Rows that repeat a vec_id are vectors of their own. A null id
has no component and is not kept, but counts as a link of others. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import by_group, small_batches, table, written
from starloom.llm.components import components

COSINE = 0.93
BLOCKS = 8
CHUNK_BYTES = 16 << 20  # of double precision numbers
HALVED = 2048  # labels of more vectors are dealt as two chunks at least, for the sake of parallel tasks
TILE = 512
FEW = 20_000  # candidates of a pair of tiles that are looked at one by one
SALTS = 32  # keys under which the smallest id of a component is looked up
LOOSE = 4e-6  # what rounding to single precision may add to a squared distance of unit vectors


def rotation(dims: int, seed: int = 20240) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_bounds(dims: int, blocks: int) -> list[tuple[int, int]]:
    cut = np.linspace(0, dims, min(blocks, dims) + 1).round().astype(int)
    return list(zip(cut[:-1].tolist(), cut[1:].tolist()))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, whatever their size."""
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def tiles_of(r: np.ndarray, rows: np.ndarray, tile: int = TILE) -> list[np.ndarray]:
    """Median splits along the widest coordinate, down to `tile` rows."""
    if len(rows) <= tile:
        return [rows] if len(rows) else []
    part = r[rows]
    axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
    half = -(-len(rows) // tile // 2) * tile  # whole tiles to the left
    order = np.argpartition(part[:, axis], half)
    return tiles_of(r, rows[order[:half]], tile) + tiles_of(r, rows[order[half:]], tile)


class Groups:
    """Components inside one task, by arrays; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.up[a], self.up[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))
            while (shorter := self.up[self.up]).tobytes() != self.up.tobytes():
                self.up = shorter


def links_among(v: np.ndarray, copies: np.ndarray, side: np.ndarray | None, cosine: float, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each vector: among all, or between side 0 and side 1. A link counts as the partner's copies."""
    n, dims = v.shape
    u = unit(v.astype(np.float64))
    r = u @ rotation(dims)
    most = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
    bounds = block_bounds(dims, blocks)
    budget = np.array([most * (b - a) / dims for a, b in bounds])
    two = side is not None
    first = tiles_of(r, np.flatnonzero(side == 0) if two else np.arange(n))
    second = tiles_of(r, np.flatnonzero(side == 1)) if two else first
    cut = [a for a, _ in bounds]
    box = lambda tiles: (np.stack([r[t].min(axis=0) for t in tiles]), np.stack([r[t].max(axis=0) for t in tiles]))
    links, groups = np.zeros(n, np.int64), Groups(n)
    if not first or not second:
        return links, groups.up
    (low, high), (low2, high2) = box(first), box(second)
    one = np.ones((TILE, 1))

    def factors(t: np.ndarray, right: bool) -> list[np.ndarray]:
        """The squared distance of x and y in a block is the product of (x, |x|^2, 1) and (-2y, 1, |y|^2)."""
        out = []
        for a, b in bounds:
            part = r[t, a:b]
            square = (part**2).sum(axis=1)[:, None]
            both = np.hstack((-2 * part, one[: len(t)], square) if right else (part, square, one[: len(t)])).astype(np.float32)
            out.append(np.ascontiguousarray(both.T) if right else both)
        return out

    right = [factors(t, True) for t in second]
    space, within, union = np.empty(TILE * TILE, np.float32), np.empty(TILE * TILE, bool), np.empty(TILE * TILE, bool)
    for i, x in enumerate(first):
        left = factors(x, False)
        gap = np.maximum(0, np.maximum(low2 - high[i], low[i] - high2)) ** 2
        apart = np.add.reduceat(gap, cut, axis=1)  # at least so far apart, by tile and block
        for j in range(0 if two else i, len(second)):
            y = second[j]
            if apart[j].sum() > most:
                continue
            shape, size = (len(x), len(y)), len(x) * len(y)
            distance, near, hit = (buffer[:size].reshape(shape) for buffer in (space, within, union))
            hit[:] = False
            for k in np.flatnonzero(apart[j] <= budget).tolist():
                np.matmul(left[k], right[j][k], out=distance)
                np.less_equal(distance, budget[k] + LOOSE, out=near)
                np.logical_or(hit, near, out=hit)
            if not two and i == j:
                hit = np.triu(hit, 1)
            found = np.count_nonzero(hit)
            if not found:
                continue
            if found <= FEW:
                p, q = np.divmod(np.flatnonzero(hit), len(y))
                a, b = x[p], y[q]
                ok = np.einsum("ij,ij->i", u[a], u[b]) >= cosine
                a, b = a[ok], b[ok]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
            else:
                hit &= u[x] @ u[y].T >= cosine
                dense = hit.astype(np.float64)
                links[x] += (dense @ copies[y]).astype(np.int64)
                links[y] += (dense.T @ copies[x]).astype(np.int64)
                p, q = np.nonzero(hit)
                a, b = x[p], y[q]
            if len(a):
                groups.join(a, b)
    return links, groups.up


def near_links(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, chunk_bytes: int = CHUNK_BYTES, halved: int = HALVED) -> DataFrame:
    """vectors: (cls long, label string, v array, n copies). Returns (cls, links, root): the links of a class that one task
    counted, and the class's root there; rows with links only. Written."""
    size = F.size("v")
    sizes = vectors.groupBy("label", size.alias("_dims")).agg(F.count("*").alias("_n"))
    chunks = F.greatest(F.ceil(F.col("_n") * F.col("_dims") * 8 / chunk_bytes), F.least(F.lit(2), F.ceil(F.col("_n") / halved))).cast("int")
    large = written(sizes.select(F.col("label").alias("_label"), "_dims", chunks.alias("_chunks")).filter("_chunks > 1"), "large-labels")
    dealt = vectors.join(large, (F.col("label") == F.col("_label")) & (size == F.col("_dims")), "left").withColumn("_all", F.coalesce("_chunks", F.lit(1)))
    # Every pair of chunks is a task, and a chunk with itself; side 1 is the later chunk of two.
    dealt = dealt.withColumn("_mine", F.pmod(F.xxhash64("cls"), F.col("_all")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_all") - 1)))
    task = F.xxhash64("label", size, F.least("_mine", "_other"), F.greatest("_mine", "_other"))
    side = F.when(F.col("_mine") > F.col("_other"), 1).otherwise(0)
    dealt = dealt.select(task.alias("task"), "cls", "label", "v", F.col("n").cast("long").alias("n"), side.alias("side"), (F.col("_mine") != F.col("_other")).alias("two"), size.alias("dims"))

    def compare(group: pa.Table):
        if group.num_rows < 2:
            return None
        # One task key is one label, length and pair of chunks, but for equal hashes.
        kinds = group.select(["label", "dims", "two"]).group_by(["label", "dims", "two"]).aggregate([]).to_pylist()
        out = []
        for kind in kinds:
            part = group
            if len(kinds) > 1:
                import pyarrow.compute as pc

                for c, x in kind.items():
                    part = part.filter(pc.equal(part[c], x))
            v = part["v"].combine_chunks()
            v = (v.chunk(0) if isinstance(v, pa.ChunkedArray) else v).flatten().to_numpy(zero_copy_only=False).reshape(-1, kind["dims"])
            cls, copies = part["cls"].to_numpy(), part["n"].to_numpy()
            links, root = links_among(v, copies, part["side"].to_numpy() if kind["two"] else None, cosine, blocks)
            some = np.flatnonzero(links)
            out.append(pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(links[some]), pa.array(cls[root[some]])], names=["cls", "links", "root"]))
        return out[0] if len(out) == 1 else pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return written(by_group(dealt, "task", compare, "cls bigint, links bigint, root bigint", "cls"), "vector-links")


def dedup_embeddings(table_: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", cosine: float = COSINE, blocks: int = BLOCKS, chunk_bytes: int = CHUNK_BYTES, halved: int = HALVED) -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    small_batches(table_.sparkSession, 4096)
    # Values that come as floats stay floats: half the bytes of doubles, without loss.
    kind = "array<float>" if table_.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col(vector_col).cast(kind)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col(label_col).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = table_.select(F.col(id_col).alias("id"), F.when(usable, v).alias("v"), F.col(label_col).cast("string").alias("label"))
    # Rows that are equal in label and vector travel once. Their class is known by two hashes of both.
    named = [F.when(F.col("v").isNotNull(), h("v", "label")) for h in (F.xxhash64, F.hash)]
    rows = rows.withColumn("h1", named[0]).withColumn("h2", named[1])
    classes = rows.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("label").alias("label"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    found = near_links(classes.select("cls", "label", "n", "v"), cosine, blocks, chunk_bytes, halved)
    group = components(found.filter("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "cls")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    per_class = classes.select("h1", "h2", "cls", "least", "n").join(links, "cls", "left").join(group, "cls", "left")
    first = per_class.filter("component is not null").groupBy("component").agg(F.min("least").alias("_first"))
    # A component may hold most classes: its smallest id is met under SALTS keys.
    first = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    per_class = per_class.withColumn("_salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(first, ["component", "_salt"], "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("_first", "least").alias("component"))
    out = rows.select("id", "h1", "h2").join(per_class, ["h1", "h2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_embeddings(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT a AS id, a AS other FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a
), c AS (SELECT id, min(other) AS component FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component, e.vec_id) AS component_id, coalesce(c.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
