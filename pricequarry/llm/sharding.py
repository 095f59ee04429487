"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

The number of rows that partition p sends to shard s is drawn first, for all p and s,
so that every shard gets exactly its size (a multivariate hypergeometric draw with
fixed row and column sums). It is drawn in two levels: for groups of partitions first, and
then by a task for each group's partitions, whose rows of the matrix are a written table
that each partition reads its own of. Each partition deals its rows out by a random permutation
of those labels, the rows are exchanged, and every shard is permuted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import extended, free_name, new_path, opened, read, text_of, written

#: Rows, and bytes of text, that one task permutes after the exchange, about.
BLOCK_ROWS, BLOCK_BYTES = 20_000, 64 << 20
#: Groups of partitions, at most, whose counts the driver draws.
GROUPS = 1_000
#: Populations from which numpy draws exactly, and the standard deviations within which larger ones are drawn.
NUMPY_MOST, SPREAD = 1_000_000_000, 12


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes at most one apart that add up to ``rows``."""
    return np.full(shards, rows // shards, np.int64) + (np.arange(shards) < rows % shards)


def communication_matrix(parts: np.ndarray, shards: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(partitions, shards) counts with these row and column sums, as a uniform shuffle would give."""
    left, out = shards.astype(np.int64).copy(), np.zeros((len(parts), len(shards)), np.int64)
    for p, n in enumerate(parts):
        out[p] = rng.multivariate_hypergeometric(left, n, method="marginals") if left.sum() < NUMPY_MOST else _marginals(left, int(n), rng)
        left -= out[p]
    return out


def _marginals(left: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A draw for populations beyond numpy's limit, a shard after another given those before it. No row is drawn by itself: time and memory grow with the standard deviation of a count."""
    out, rest = np.zeros(len(left), np.int64), int(left.sum())
    for s, good in enumerate(map(int, left)):
        rest -= good
        out[s] = hypergeometric(good, rest, n, rng)
        n -= int(out[s])
    return out


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``n`` drawn rows are good ones. By the chances of all counts within SPREAD standard deviations of the likeliest one, as products of the ratios of neighbours: what lies beyond weighs less than a double resolves."""
    total, low, high = good + bad, max(0, n - bad), min(good, n)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    spread = int(SPREAD * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5) + 100
    low, high = max(low, mode - spread), min(high, mode + spread)
    up, down = np.arange(mode, high, dtype=np.float64), np.arange(mode, low, -1, dtype=np.float64)
    more = np.cumprod((good - up) / (up + 1) * ((n - up) / (bad - n + up + 1)))
    less = np.cumprod(down / (good - down + 1) * ((bad - n + down) / (n - down + 1)))
    sums = np.cumsum(np.concatenate([less[::-1], [1.0], more]))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def _draw(shards: int, seed: int):
    """From a group's partitions (p, n, and its counts for each shard) to each one's counts."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        sent = communication_matrix(pdf["n"].to_numpy(np.int64), np.array(pdf["total"].iloc[0], np.int64), np.random.default_rng([seed, 1, int(key[0])]))
        return pd.DataFrame({"g": np.full(len(pdf), key[0], np.int32), "p": pdf["p"].to_numpy(np.int32), "sent": list(sent)})

    return run


def matrix_of(counts: DataFrame, shards: int, seed: int, groups: int = GROUPS) -> tuple[str, int, int]:
    """The matrix as a table in the shared folder, a folder ``g=...`` for each group of partitions: its path, the partitions of a group, and all rows. ``counts``: a written table of (p, n)."""
    spark = counts.sparkSession
    last, rows = counts.agg(F.max("p"), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = -(-((last or 0) + 1) // groups)
    group = F.floor(F.col("p") / each).cast("int")
    sums = {r["g"]: r["n"] for r in counts.groupBy(group.alias("g")).agg(F.sum("n").alias("n")).collect()}
    ids = sorted(sums)
    top = communication_matrix(np.array([sums[g] for g in ids], np.int64), shard_sizes(rows, shards), np.random.default_rng([seed, 0])) if rows else np.zeros((len(ids), shards), np.int64)
    totals = spark.createDataFrame([(g, row.tolist()) for g, row in zip(ids, top, strict=True)], "g int, total array<long>")
    path = new_path(spark, "matrix")
    joined = counts.withColumn("g", group).join(F.broadcast(totals), "g")  # at most GROUPS rows of as many numbers as there are shards
    joined.groupBy("g").applyInPandas(_draw(shards, seed), "g int, p int, sent array<long>").write.partitionBy("g").parquet(path)
    return path, each, rows


def shuffle_into_shards(df: DataFrame, shards: int = 40, seed: int = 17, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, groups: int = GROUPS) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (0 up, gapless in its shard).

    Every assignment of rows to (shard, slot) is equally likely, and row counts of
    shards differ by one at most, whatever the rows hold: nulls, equal texts and
    repeated rows are rows like any other. ``df`` should be a scan or a written table,
    whose partitions are the same when it is read again; a partition that comes back
    with another number of rows ends the run rather than giving wrong sizes. An empty
    table gives an empty result.
    """
    spark = df.sparkSession
    counts = written(df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")), "counts")
    matrix, each, rows = matrix_of(counts, shards, seed, groups)
    shard, key, size = (free_name(df.columns, n) for n in ("shard", "key", "bytes"))
    names = [*df.columns, shard, key, size]

    def own_row(p: int) -> np.ndarray | None:
        fs, path = opened(f"{matrix}/g={p // each}")
        if not fs.get_file_info(path).is_file and fs.get_file_info(path).type.name == "NotFound":
            return None  # no partition of the group holds rows
        found = pq.read_table(path, filesystem=fs, columns=["p", "sent"], partitioning=None).filter(pc.field("p") == p)
        return np.array(found.column("sent")[0].as_py(), np.int64) if found.num_rows else None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        own, labels, at = np.random.default_rng([seed, 2, p]), None, 0
        for b in batches:
            if labels is None:
                sent = own_row(p)
                labels = own.permutation(np.repeat(np.arange(shards, dtype=np.int32), sent)) if sent is not None else np.zeros(0, np.int32)
            mine = labels[at : at + b.num_rows]
            at += b.num_rows
            if len(mine) < b.num_rows:
                break
            held = np.zeros(b.num_rows, np.int64)
            for c in b.columns:
                if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                    held += np.asarray(pc.fill_null(pc.binary_length(c), 0), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mine, pa.int32()), pa.array(own.integers(0, 1 << 62, b.num_rows), pa.int64()), pa.array(held)], names=names)
        if labels is not None and at != len(labels):
            raise RuntimeError(f"partition {p} held {len(labels)} rows when counted and now another number; write the table first")

    dealt = written(df.mapInArrow(deal, extended(df, (shard, "int"), (key, "long"), (size, "long"))), "dealt")
    # permute again: a shard's rows in the order of their random keys, in blocks of the key's range that one task sorts
    found, held = dealt.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if found != rows:
        raise RuntimeError(f"{rows} rows were counted and {found} dealt; write the table first")
    blocks = max(1, -(-rows // (shards * block_rows)), -(-held // (shards * block_bytes)))
    block = F.least(F.floor(F.col(key) / F.lit(float(1 << 62)) * blocks).cast("long"), F.lit(blocks - 1))
    at, first, slot = free_name(names, "at"), free_name(names, "first"), free_name(df.columns, "slot")
    placed = dealt.withColumn(at, F.col(shard) * F.lit(blocks) + block)
    # where each block begins in its shard: a running sum over block sizes, which meets the rows by the exchange that they need anyway
    before = Window.partitionBy(shard).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    starts = written(placed.groupBy(shard, at).agg(F.count(F.lit(1)).alias("n")).select(at, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first)), "starts")
    w = Window.partitionBy(at).orderBy(key, *[c for c, t in df.dtypes if t in ("bigint", "int")][:1])
    return placed.join(starts, at).withColumn(slot, F.col(first) + F.row_number().over(w) - 1).select(*df.columns, shard, slot)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shuffle_into_shards(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id",
        (F.octet_length(text_of("text")) + 16).cast("long").alias("size"),
        F.crc32(text_of("text")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op6_sharding": op6_sharding}
#: A random shuffle has no SQL; tests/llm holds it against its law and against the uniform distribution.
ORACLE_SQL: dict[str, str] = {}
