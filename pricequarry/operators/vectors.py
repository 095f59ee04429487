"""Nearest vectors by angle: an index of cells and rings that leaves out only what cannot pass the limit.

Cells have centres fitted on a bounded sample; a vector belongs to the cell of its nearest centre, and in it to a ring by its angle to
that centre. Angles keep the triangle inequality, so a vector within an angle of a question lies in a ring
whose angles differ from the question's own by no more than that: only those rings are visited, and nothing is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import once
from ..functions.similarity import cosine_limit, dot

#: Vectors that the centres are fitted on, about as many.
SAMPLE = 16_384
#: Most cells of an index; the centres, and which rings hold vectors, go to every task, and a question to each cell that it reaches.
MOST_CELLS = 64
RINGS = 64
#: Rows of a cell that one task compares with its questions; a cell of more is dealt out.
RING_ROWS = 4_096
#: Questions that one task compares at a time with a block of rows.
ASKED_ROWS = 2_048
#: What an angle worked out in doubles may be off by.
_SLACK = 1e-6
#: Numbers that a task holds at a time for products or angles.
_NUMBERS = 1 << 20


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sums of products of rows, added up one by one as ``similarity.dot`` adds them, to the last bit."""
    return np.add.accumulate(a * b, axis=1)[:, -1] + 0.0 if a.shape[1] else np.zeros(len(a))


def _likeness(a: np.ndarray, b: np.ndarray, unit: bool) -> np.ndarray:
    """Of rows beside each other, as ``similarity.dot`` for vectors of length 1, else ``similarity.cosine``."""
    if unit:
        return _dots(a, b)
    norm = np.sqrt(_dots(a, a)) * np.sqrt(_dots(b, b))
    return np.where(norm == 0, 0.0, _dots(a, b) / np.where(norm == 0, 1.0, norm))


def _arrays(column: pa.ChunkedArray) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Each vector, None where it is null or holds a null, and their lengths (-1 for None)."""
    found = []
    for chunk in column.chunks:
        values, offsets = chunk.values, chunk.offsets.to_numpy()
        numbers, null = values.to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False)
        lost = np.concatenate([[0], np.cumsum(null)])
        there = chunk.is_valid().to_numpy(zero_copy_only=False)
        found += [numbers[i:j] if ok and lost[i] == lost[j] else None for i, j, ok in zip(offsets[:-1], offsets[1:], there, strict=True)]
    return found, np.array([-1 if x is None else len(x) for x in found], dtype=np.int64)


def _best(keys: np.ndarray, asked: list, asked_sizes: np.ndarray, ids: np.ndarray, held: list, sizes: np.ndarray, unit: bool, others_only: bool) -> list[tuple[int, int, float]]:
    """(row of the question, row held, similarity) of the most similar for each question, ties by the least id; NaN is the most, as in Spark.

    A product of matrices leaves only those within 1e-9 of the best, which are then worked out as Spark does. Vectors of other
    lengths or with nulls have a similarity of 0; what is not finite or has no usual length is worked out for all rows.
    """
    out = []
    by_id = np.argsort(ids, kind="stable")
    with np.errstate(all="ignore"):
        for size in np.unique(asked_sizes):
            qs, fit = np.flatnonzero(asked_sizes == size), by_id[sizes[by_id] == size] if size > 0 else by_id[:0]
            others = by_id if not len(fit) else by_id[sizes[by_id] != size]
            rows = np.stack([held[i] for i in fit]) if len(fit) else np.zeros((0, max(size, 0)))
            norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
            odd = np.flatnonzero(~((norms > 1e-100) & (norms < 1e100)))
            even = np.flatnonzero((norms > 1e-100) & (norms < 1e100))
            plain = rows[even] / norms[even, None]
            step = max(1, _NUMBERS // max(1, len(fit)))
            for start in range(0, len(qs), step):
                some = qs[start : start + step]
                q = np.stack([asked[i] for i in some]) if len(fit) else np.zeros((len(some), 0))
                length = np.sqrt(np.einsum("ij,ij->i", q, q))
                near = (q / length[:, None]) @ plain.T if len(fit) else np.zeros((len(some), 0))
                for k, i in enumerate(some):
                    chosen: list[tuple[float, int]] = []
                    if len(fit):
                        usual = 1e-100 < length[k] < 1e100
                        if usual:
                            own = near[k]
                            if others_only:
                                own = np.where(ids[fit[even]] == keys[i], -np.inf, own)
                            top = even[own >= own.max() - 1e-9] if len(own) and own.max() > -np.inf else even[:0]
                            at = np.sort(np.concatenate([top, odd]))
                        else:
                            at = np.arange(len(fit))
                        if others_only:
                            at = at[ids[fit[at]] != keys[i]]
                        if len(at):
                            like = _likeness(np.broadcast_to(q[k], (len(at), q.shape[1])), rows[at], unit)
                            first = int(np.flatnonzero(np.isnan(like))[0]) if np.isnan(like).any() else int(like.argmax())
                            chosen.append((float(like[first]), int(fit[at[first]])))
                    rest = next((j for j in others if not (others_only and ids[j] == keys[i])), None)
                    if rest is not None:
                        chosen.append((0.0, int(rest)))
                    if chosen:
                        like, j = max(chosen, key=lambda x: (math.inf if math.isnan(x[0]) else x[0], -int(ids[x[1]])))
                        out.append((int(i), j, like))
    return out


def nearest_of_groups(asked: DataFrame, held: DataFrame, group: Sequence[str], unit: bool = False, others_only: bool = False) -> DataFrame:
    """(key, c, id, similarity): the best of each group of ``held`` (id, w and the group's columns) for each question (key, q, c and the group's columns) in it: by blocks of at most about ``RING_ROWS`` rows and ``ASKED_ROWS`` questions, each compared in one task by a product of matrices."""
    on = list(group)

    def blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    here, there = blocks(held, RING_ROWS, "held_parts").alias("h"), blocks(asked, ASKED_ROWS, "asked_parts").alias("a")
    parts = here.join(there, [F.col(f"h.{g}").eqNullSafe(F.col(f"a.{g}")) for g in on]).select(*[F.col(f"h.{g}").alias(f"p_{g}") for g in on], "held_parts", "asked_parts")

    def dealt(df: DataFrame, by: str, own: str, other: str) -> DataFrame:
        joined = df.join(parts, [F.col(g).eqNullSafe(F.col(f"p_{g}")) for g in on])
        mine = F.pmod(F.xxhash64(by), F.col(f"{own}_parts")).cast("int").alias(f"{own}_part")
        return joined.select(*df.columns, mine, F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1)).alias(f"{other}_part"))

    tile = [*on, "asked_part", "held_part"]
    key_type, id_type, c_type = asked.schema["key"].dataType.simpleString(), held.schema["id"].dataType.simpleString(), asked.schema["c"].dataType.simpleString()

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        (q, q_sizes), (w, sizes) = _arrays(left["q"]), _arrays(right["w"])
        found = _best(left["key"].to_numpy(), q, q_sizes, right["id"].to_numpy(), w, sizes, unit, others_only) if len(left) and len(right) else []
        at, to = pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())
        return pa.table({"key": left["key"].take(at), "c": left["c"].take(at), "id": right["id"].take(to), "similarity": pa.array([x[2] for x in found], pa.float64())})

    left = dealt(asked, "key", "asked", "held").groupBy(*tile)
    return left.cogroup(dealt(held, "id", "held", "asked").groupBy(*tile)).applyInArrow(compared, f"key {key_type}, c {c_type}, id {id_type}, similarity double")


@dataclass
class AngularIndex:
    #: id, c (category), v (the vector at length 1), cell, ring
    rows: DataFrame
    centres: np.ndarray
    #: Whether a ring of a cell holds any vector.
    filled: np.ndarray


def _usable(vector: str) -> Column:
    """The vector in doubles; null where it is null, holds nulls or what is not finite, or has no length."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return F.when(fine, v)


def _unit(v: Column) -> Column:
    """A usable vector at length 1."""

    def over(v: Column, by: Column) -> Column:
        return once(by, lambda m: F.transform(v, lambda x: x / m))

    # by the greatest number first: squares of very small or large ones would vanish
    return once(over(v, F.array_max(F.transform(v, F.abs))), lambda even: over(even, F.sqrt(dot(even, even))))


def _angles(vectors: pd.Series, centres: np.ndarray) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def angular_index(references: DataFrame, id_column: str, vector: str, category: str | None = None, cells: int | None = None, sample: int = SAMPLE) -> AngularIndex | None:
    """The index of all usable vectors of ``references``, or None without any. All must have the same length.

    The centres are fitted by k-means on about ``sample`` vectors, chosen by a hash of their values; their number is the
    square root of the rows', at most ``MOST_CELLS``, unless given. They decide what is compared, never what is found.
    """
    c = F.col(category).cast("string") if category else F.lit(None).cast("string")
    rows = references.select(F.col(id_column).alias("id"), _usable(vector).alias("v"), c.alias("c")).where("v IS NOT NULL")
    n = rows.count()
    if not n:
        return None
    k = cells or max(1, min(MOST_CELLS, math.isqrt(n)))
    share = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.lit(max(1, int(min(1.0, sample / n) * (1 << 30))))
    chosen = rows.where(share).select(array_to_vector(_unit(F.col("v"))).alias("features"))
    if k > 1 and chosen.limit(1).count():
        found = np.array(KMeans(k=k, maxIter=10, seed=7, distanceMeasure="cosine", initSteps=2).fit(chosen).clusterCenters())
    else:
        found = np.array([rows.first()["v"]])
    found = found[np.linalg.norm(found, axis=1) > 0] if np.linalg.norm(found, axis=1).any() else np.eye(1, found.shape[1])
    centres = found / np.linalg.norm(found, axis=1, keepdims=True)
    width = math.pi / RINGS

    @F.pandas_udf("struct<cell:int,ring:int>")
    def placed(vectors: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in vectors:
            angles = _angles(v, centres) if len(v) else np.zeros((0, 1))
            cell = angles.argmin(axis=1)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "ring": np.minimum(RINGS - 1, angles[np.arange(len(cell)), cell] // width).astype(np.int32)})

    rows = rows.withColumn("p", placed("v")).select("id", _unit(F.col("v")).alias("v"), "c", "p.cell", "p.ring")
    filled = np.zeros((len(centres), RINGS), bool)
    for r in rows.select("cell", "ring").distinct().collect():  # at most MOST_CELLS * RINGS rows
        filled[r["cell"], r["ring"]] = True
    return AngularIndex(rows, centres, filled)


def nearest_by_angle(questions: DataFrame, index: AngularIndex, key: str, id_column: str, vector: str, category: str | None = None, limit: Callable[[Column], Column] = cosine_limit, others_only: bool = False) -> DataFrame:
    """(key, id, similarity): for each question the vector of the index with the largest cosine among those of its category, if it passes the category's limit; ties by the least id.

    The same rows as ``search.nearest_vector`` for limits above 0, without comparing all pairs. Questions whose vector
    is not usable have no neighbour. ``others_only``: no row is its own neighbour. Questions repeated under one key are one.
    A question goes to the cells of which it reaches a ring; those of more than ``RING_ROWS`` rows of a category are dealt out to several tasks, and their questions with them.
    """
    c = F.col(category).cast("string") if category else F.lit(None).cast("string")
    asked = questions.select(F.col(key).alias("key"), _usable(vector).alias("q"), c.alias("c")).where("q IS NOT NULL").withColumn("least", limit(F.col("c")))
    centres, filled, width = index.centres, index.filled, math.pi / RINGS

    @F.pandas_udf("array<int>")
    def visited(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """The cells with a ring that may hold a near vector: plain numbers, of a few questions at a time."""
        cell, ring = np.nonzero(filled)
        cells, starts = np.unique(cell, return_index=True)
        step = max(1, _NUMBERS // len(cell))
        for v, least in batches:
            reach = np.arccos(np.clip(least.to_numpy(dtype=np.float64), -1.0, 1.0))[:, None] + _SLACK
            out = []
            for i in range(0, len(v), step):
                a, r = _angles(v.iloc[i : i + step], centres)[:, cell], reach[i : i + step]
                # rings that meet [a - r, a + r]
                near = (ring * width <= a + r) & ((ring + 1) * width >= a - r)
                out += [cells[x].astype(np.int32) for x in np.logical_or.reduceat(near, starts, axis=1)]
            yield pd.Series(out, dtype=object)

    visits = asked.withColumn("p", visited("q", F.col("least").cast("double"))).select("key", _unit(F.col("q")).alias("q"), "c", F.explode("p").alias("cell"))
    held = index.rows.select("id", F.col("v").alias("w"), "c", "cell")
    near = nearest_of_groups(visits, held, ["c", "cell"], unit=True, others_only=others_only).where(F.col("similarity") >= limit(F.col("c")))
    best = near.groupBy("key").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "id")).alias("b"))
    return best.select(F.col("key").alias(key), F.col("b.id").alias(id_column), (-F.col("b.s")).alias("similarity"))
