"""Embedding near-dedup by an inverted multi-index.

Vectors of equal labels are linked where their cosine reaches a limit. Each half of the
unit vectors has a codebook of its own, learned on a bounded sample; a vector's cell is
its nearest centre in each, so that k centres a half make a grid of k * k cells. From
its own cell a vector visits others by multi-sequence traversal, in the order of how near a
vector of that cell can be, until the share of links that it is to find (the target
recall) lies within. How far that is, is worked out on the sample: on pairs at the limit of
similarity, the hardest there are. Of two cells only the one of the smaller number sends its vectors,
so a pair meets at most once. Those that meet are verified by their cosine in double precision.

Spark groups equal vectors, deals cells out to tasks and counts; inside a task the members
of a cell are compared in numpy blocks. Links leave a task as a spanning forest and as sums for each
vector, never as all pairs of a group.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import dropped, fitting, join_skewed, read, written
from .components import components, union_pairs

SIMILARITY = 0.98
#: The share of pairs at the limit of similarity that the traversal is to reach; pairs of more similarity are reached more often.
TARGET = 0.999
#: The sample: rows at most, and numbers in it at most; both with the chance deviation of a hash.
SAMPLE_ROWS, SAMPLE_VALUES = 16_384, 4_000_000
#: Vectors of a label that a cell should hold, centres of a half, rounds of k-means, and the least sample for a codebook.
CELL_ROWS, MOST_CENTRES, ROUNDS, LEAST_SAMPLE = 512, 256, 12, 64
#: Members of a cell that are held at once, others that are compared with them in one task, and how many of those at a time.
HELD, CALLERS, AT_ONCE = 4096, 65_536, 512
#: Cells that need splitting and are broadcast, at most; more are joined by shuffling.
MOST_BIG = 20_000


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest number near 1: exact, and no square of it overflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def units(vectors: np.ndarray) -> np.ndarray:
    x = scaled(vectors)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows from centres."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :], 0)


class Codebook:
    """Centres of one half of the vectors."""

    def __init__(self, sample: np.ndarray, k: int, seed: int):
        rng = np.random.default_rng(seed)
        distinct = np.unique(sample, axis=0)
        self.centres = distinct[rng.permutation(len(distinct))[:k]]
        for _ in range(ROUNDS):
            nearest = _squares(sample, self.centres).argmin(axis=1)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, nearest, sample)
            n = np.bincount(nearest, minlength=len(self.centres))
            self.centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.centres)
        self.centres = np.unique(self.centres, axis=0)
        self.apart = np.sqrt(_squares(self.centres, self.centres))

    def reach(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest centre, and for every centre the least squared distance at which vectors of it can be: that of the plane between the two centres."""
        d = _squares(x, self.centres)
        own = d.argmin(axis=1)
        gap = d - d[np.arange(len(x)), own][:, None]
        between = 2 * self.apart[own]
        return own, np.divide(gap, between, out=np.zeros_like(gap), where=between > 1e-9) ** 2


def nearest_cells(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[int, int, float]]:
    """Cells (centre of the first half, of the second, sum) in ascending order of the sum of their two distances, up to ``limit``: multi-sequence traversal."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = a[first[a] <= limit], b[second[b] <= limit]
    waiting = [(float(first[a[0]] + second[b[0]]), 0, 0)] if len(a) and len(b) else []
    while waiting:
        sum_, i, j = heapq.heappop(waiting)
        if sum_ > limit:
            return
        yield int(a[i]), int(b[j]), sum_
        if i + 1 < len(a) and j == 0:
            heapq.heappush(waiting, (float(first[a[i + 1]] + second[b[0]]), i + 1, 0))
        if j + 1 < len(b):
            heapq.heappush(waiting, (float(first[a[i]] + second[b[j + 1]]), i, j + 1))


class MultiIndex:
    """The grid of cells for vectors of one length. Cells are numbered from 0 to k * k - 1."""

    def __init__(self, sample: np.ndarray, k: int, similarity: float = SIMILARITY, target: float = TARGET, seed: int = 7):
        x = units(sample)
        self.half = x.shape[1] // 2
        self.books = Codebook(x[:, : self.half], k, seed), Codebook(x[:, self.half :], k, seed + 1)
        self.limit = self._limit(x, similarity, target, seed)

    def reach(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each unit vector, and its squared distances from the centres' regions of either half."""
        i, first = self.books[0].reach(x[:, : self.half])
        j, second = self.books[1].reach(x[:, self.half :])
        return i * len(self.books[1].centres) + j, first, second

    def _limit(self, x: np.ndarray, similarity: float, target: float, seed: int) -> float:
        """The sum of squared distances within which a share ``target`` of pairs at the limit of similarity lie. Each sampled vector gets a partner turned towards another one. At the squared distance of such a pair nothing is missed."""
        rng = np.random.default_rng(seed)
        other = x[rng.permutation(len(x))] * rng.choice([-1.0, 1.0], (len(x), 1))
        turn = other - (other * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(turn, axis=1, keepdims=True)
        some = size[:, 0] > 1e-6
        y = similarity * x[some] + math.sqrt(1 - similarity**2) * turn[some] / size[some]
        sure = 2 - 2 * similarity
        if not some.any():
            return sure
        cells, *ahead = self.reach(x[some])
        cells2, *back = self.reach(y)
        k = len(self.books[1].centres)
        rows = np.arange(len(y))
        there = ahead[0][rows, cells2 // k] + ahead[1][rows, cells2 % k]
        here = back[0][rows, cells // k] + back[1][rows, cells % k]
        return float(min(np.quantile(np.where(cells < cells2, there, here), target), sure))

    def place(self, vectors: np.ndarray) -> tuple[list[int], list[list[int]]]:
        """The cell of each vector, and the cells of greater numbers that it visits, nearest first."""
        cells, first, second = self.reach(units(vectors))
        k = len(self.books[1].centres)
        visits = [[c for i, j, _ in nearest_cells(f, s, self.limit) if (c := i * k + j) > own] for own, f, s in zip(cells.tolist(), first, second, strict=True)]
        return cells.tolist(), visits


def _vectors(batch: pa.RecordBatch, column: str = "vec") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors in double precision) for each length of vector in the batch."""
    lists = batch.column(batch.schema.get_field_index(column))
    starts = np.asarray(lists.offsets)
    lengths, values = np.diff(starts), lists.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        yield rows, values[starts[rows][:, None] + np.arange(dim)].astype(np.float64)


def fit(valid: DataFrame, rows: int, similarity: float = SIMILARITY, target: float = TARGET, cell_rows: int = CELL_ROWS) -> dict[int, MultiIndex]:
    """An index for each length of vector that the sample holds often enough; vectors of others are all in one cell. ``valid``: key, label, vec."""
    if not rows:
        return {}
    width = valid.agg(F.avg(F.size("vec"))).first()[0]
    share = min(1.0, min(SAMPLE_ROWS, SAMPLE_VALUES / width) / rows)
    sample = valid.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec").toArrow().combine_chunks()
    labels = valid.agg(F.approx_count_distinct("label")).first()[0]
    k = 1 << max(0, math.ceil(math.log2(max(1.0, rows / max(1, labels) / cell_rows)) / 2))
    out = {}
    for batch in sample.to_batches():
        for _, x in _vectors(batch):
            if x.shape[1] > 1 and len(x) >= LEAST_SAMPLE:
                out[x.shape[1]] = MultiIndex(x, min(k, MOST_CENTRES, len(x) // 8), similarity, target)
    return out


def _place(indexes: dict[int, MultiIndex]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cells, visits = [0] * b.num_rows, [[]] * b.num_rows
            for rows, x in _vectors(b):
                if x.shape[1] in indexes:
                    for row, c, v in zip(rows.tolist(), *indexes[x.shape[1]].place(x), strict=True):
                        cells[row], visits[row] = c, v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], names=[*b.schema.names, "cell", "visits"])

    return run


class Members:
    """The members of a cell that a task holds, and what it finds of them."""

    def __init__(self, ids: np.ndarray, times: np.ndarray, vectors: np.ndarray, similarity: float):
        self.ids, self.times, self.x, self.similarity = ids, times, scaled(vectors), similarity
        self.norms = np.linalg.norm(self.x, axis=1)
        self.labels, self.links = np.arange(len(ids)), np.zeros(len(ids), np.int64)

    def hits(self, x: np.ndarray, at: int = 0) -> np.ndarray:
        return (self.x[at:] @ x.T) / (self.norms[at:, None] * np.linalg.norm(x, axis=1)[None, :]) >= self.similarity

    def among(self) -> None:
        """Links of the members with each other, each pair once."""
        n = len(self.ids)
        for at in range(0, n, AT_ONCE):
            hit = self.hits(self.x[at : at + AT_ONCE], at)
            here = hit.shape[1]
            hit &= np.arange(n - at)[:, None] > np.arange(here)[None, :]
            self.links[at:] += hit @ self.times[at : at + here]
            self.links[at : at + here] += self.times[at:] @ hit
            i, j = np.nonzero(hit)
            union_pairs(self.labels, at + i, at + j)

    def meet(self, ids: np.ndarray, times: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        """Links with others: (a, b, links) with an edge and the sum for each of them that is linked."""
        hit = self.hits(scaled(vectors))
        self.links += hit @ times
        i, j = np.nonzero(hit)
        labels = np.concatenate([self.labels, len(self.ids) + np.arange(len(ids))])
        union_pairs(labels, i, len(self.ids) + j)
        self.labels = labels[: len(self.ids)].copy()  # the least of a set is always a member
        some = np.flatnonzero(hit.any(axis=0))
        return found(ids[some], self.ids[labels[len(self.ids) + some]], (self.times @ hit)[some])

    def own(self) -> pa.RecordBatch:
        some = np.flatnonzero((self.links > 0) | (self.labels != np.arange(len(self.ids))))
        return found(self.ids[some], self.ids[self.labels[some]], self.links[some])


def found(a: np.ndarray, b: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(links)], names=["a", "b", "links"])


def _compare(similarity: float):
    """Over rows sorted by unit and then by ``caller``: the members of a unit are held, and its callers streamed past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, waiting, members = None, [], None

        def gathered() -> Members:
            ids, times, vectors = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            return Members(ids, times, vectors, similarity)

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal members
            if waiting:
                members = gathered()
                if unit[2] == 0:  # of the copies of a chunk of members one compares them
                    members.among()
            if members is not None:
                yield members.own()
            members = None

        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(at, AT_ONCE)
                names, parts, shares, callers = (b.column(i).to_pylist() for i in range(4))
                keys = list(zip(names, parts, shares, callers, strict=True))
                cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
                ids, times = b.column(4).to_numpy(), b.column(5).to_numpy()
                for i, j in zip(cuts, cuts[1:], strict=False):
                    if keys[i][:3] != unit:
                        yield from closed()
                        unit = keys[i][:3]
                    _, x = next(_vectors(b.slice(i, j - i)))  # the vectors of a unit have one length
                    if not keys[i][3]:
                        waiting.append((ids[i:j], times[i:j], x))
                        continue
                    if waiting:
                        members = gathered()
                        if unit[2] == 0:
                            members.among()
                    if members is not None:
                        yield members.meet(ids[i:j], times[i:j], x)
        yield from closed()

    return run


def near_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", similarity: float = SIMILARITY, target: float = TARGET, cell_rows: int = CELL_ROWS, held: int = HELD, callers: int = CALLERS) -> DataFrame:
    """One row for each row of ``df``: vec_id, n_links, component_id, kept.

    n_links: other rows of the same label, and of the same length of vector, whose cosine is ``similarity`` or more; component_id: the
    smallest id reachable by links, the row's own included; kept: whether that is the row's own.
    Null labels, and vectors that are null, empty, all zero, or hold a null or a
    number that is not finite, link with nothing. Equal vectors of a label are one class with its number of
    rows, and linked with each other. Rows that repeat an id are rows like any other;
    null ids are passed over when the smallest is sought, and are kept only where
    nothing linked has an id. An empty table gives an empty result. Every row is
    indexed; that pairs are missed is as likely as ``target`` says, at the limit of
    similarity, and less likely above it; none below it is linked.

    The grid is as fine as leaves about ``cell_rows`` vectors of a label to a cell.
    Cells of more than ``held`` classes are dealt out in chunks, and the others that
    come to them in shares of about ``callers``, so that no task gets a cell whole; the
    copies that this makes cost less than the comparisons that they are for.
    """
    spark = df.sparkSession
    kind = df.schema[id_column].dataType.simpleString()
    label, vec = F.col(label_column).cast("string"), F.col(vector_column)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)) & F.exists(vec, lambda x: x != 0)
    key = F.when(label.isNotNull() & F.coalesce(finite, F.lit(False)), F.concat_ws(".", F.xxhash64(F.lit(0), label, vec), F.xxhash64(F.lit(1), label, vec)))
    rows = df.select(F.col(id_column).alias("id"), key.alias("key"), label.alias("label"), vec.alias("vec"))
    ids = written(rows.select("id", "key"), "vector-rows")
    total = ids.count()
    valid = rows.where("key IS NOT NULL")
    indexes = fit(valid, ids.where("key IS NOT NULL").count(), similarity, target, cell_rows)

    classes = valid.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    numbered = classes.withColumn("class", F.monotonically_increasing_id())
    schema = T.StructType([*numbered.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("visits", T.ArrayType(T.IntegerType()))])
    placed = written(numbered.mapInArrow(_place(indexes), schema), "placed")

    def at(cell: str) -> F.Column:
        return F.concat_ws(":", F.size("vec"), cell, "label").alias("at")

    visitors = placed.select("class", "n", "vec", "label", F.explode("visits").alias("cell"))
    sizes = placed.groupBy(at("cell")).agg(F.count(F.lit(1)).alias("m")).join(visitors.groupBy(at("cell")).agg(F.count(F.lit(1)).alias("v")), "at", "left")
    split = sizes.select("at", F.ceil(F.col("m") / held).cast("int").alias("chunks"), F.ceil((F.col("m") + F.coalesce("v", F.lit(0))) / callers).cast("int").alias("shares"))
    big = written(split.where("chunks > 1 OR shares > 1"), "big-cells")
    few = big.count() <= MOST_BIG

    def dealt(members: DataFrame) -> DataFrame:
        """With the chunks of its cell, the shares of those that come to a chunk, and this row's own of both."""
        out = members.join(F.broadcast(big) if few else big, "at", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("chunks", "shares")})
        return out.withColumns({"chunk": F.pmod(F.xxhash64("class"), "chunks").cast("int"), "own": F.pmod(F.xxhash64("class", F.lit(1)), "shares").cast("int")})

    homes, others = dealt(placed.select(at("cell"), "class", "n", "vec")), dealt(visitors.select(at("cell"), "class", "n", "vec"))
    none = F.lit(0)
    columns = ("at", "part", "share", "caller", "class", "n", "vec")
    held_rows = homes.withColumns({"part": F.col("chunk"), "caller": F.lit(False)}).withColumn("share", F.explode(F.sequence(none, F.col("shares") - 1)))
    within = homes.where("chunk > 0").withColumns({"share": F.col("own"), "caller": F.lit(True)}).withColumn("part", F.explode(F.sequence(none, F.col("chunk") - 1)))
    coming = others.withColumns({"share": F.col("own"), "caller": F.lit(True)}).withColumn("part", F.explode(F.sequence(none, F.col("chunks") - 1)))
    units_ = held_rows.select(*columns).unionByName(within.select(*columns)).unionByName(coming.select(*columns))
    parts = fitting(spark, total, 200_000)
    compared = units_.repartition(parts, "at", "part", "share").sortWithinPartitions("at", "part", "share", "caller").mapInArrow(_compare(similarity), "a long, b long, links long")
    links = written(compared, "vector-links")

    roots = written(components(links.where("a <> b").select("a", "b")).select(F.col("node").alias("class"), "root"), "roots")
    sums = links.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    whole = placed.select("key", "class", "least", "n").join(sums, "class", "left").join(roots, "class", "left")
    named = written(whole.select("key", "least", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "class").alias("root")), "classes")
    leasts = written(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k")), "vector-components")
    table = written(join_skewed(named, leasts, "root", "k", total).select("key", "n", "n_links", "component_id"), "vector-classes")
    dropped(placed, big, links, roots, named, leasts)
    nothing = ids.where("key IS NULL").select("key", "id", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = join_skewed(ids.where("key IS NOT NULL"), table, "key", "n", total).select(*nothing.columns).unionByName(nothing)
    component = F.col("component_id").cast(kind)
    return out.select(F.col("id").alias("vec_id"), "n_links", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


QUERIES = {"op13_embedding_dedup": op13_embedding_dedup}
#: All pairs by brute force, and the ids reachable from each, step by step.
ORACLE_SQL = {
    "op13_embedding_dedup": f"""
WITH RECURSIVE vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM vectors WHERE label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= {SIMILARITY}),
reached(a, b) AS (SELECT vec_id, vec_id FROM vectors UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM vectors v JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) r ON r.a = v.vec_id"""
}
