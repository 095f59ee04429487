"""Exact dedup by two-pass Bloom filtering.

Pass one sets the bits of every text's hash in a counting filter whose slots stop
at two. Pass two tests each hash: where all its slots have been hit twice it may be
repeated, and only those rows shuffle; all other rows are alone and pass straight
through. The filter has no false negatives, so the result is exact at any filling;
a fuller filter only sends more rows through the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import dropped, extended, free_name, join_skewed, keep_only, raw, read, texts, written

#: What makes no difference between texts: [\x20\x09-\x0D].
BLANK = b" \t\n\x0b\x0c\r"
HASHES = 4
BITS_PER_ROW = 16
#: Bound of the filter, in slots (32 MB broadcast as bits). Beyond 16 million rows it fills up: still exact, but more rows shuffle.
MOST_SLOTS = 1 << 28
_SEGMENT = 1 << 20


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text.translate(None, BLANK)).digest()


def _slots(digests: pa.Array, slots: int) -> np.ndarray:
    """(rows, HASHES) slot numbers by double hashing of the digest's first 16 bytes; a row's slots differ."""
    heads = np.frombuffer(b"".join(d[:16] for d in digests.to_pylist()), "<u8").reshape(-1, 2)
    step = heads[:, 1] | np.uint64(1)
    return (heads[:, :1] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(slots - 1)


def _digests(text: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for b in batches:
            keys = b.column(b.schema.get_field_index(key))
            yield pa.RecordBatch.from_arrays(
                [keys, pc.cast(pc.utf8_length(texts(b, text)), pa.int64()), pa.array([digest(t) for t in raw(b, text)], pa.binary())],
                names=["doc_id", "n_chars", "digest"],
            )

    return run


def _sparse(slots: int):
    """From digests to (segment, offsets hit, whether twice), summed over up to 1 M hits of a partition at a time."""

    def emit(hits: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at, times = np.unique(np.concatenate(hits), return_counts=True)
        for twice in (False, True):
            some = at[(times > 1) == twice]
            cuts = np.flatnonzero(np.diff(some >> np.uint64(20))) + 1
            parts = [p for p in np.split(some, cuts) if len(p)]
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(p[0]) >> 20 for p in parts], pa.int32()),
                        pa.array([twice] * len(parts), pa.bool_()),
                        pa.array([(p & np.uint64(_SEGMENT - 1)).astype("<u4").tobytes() for p in parts], pa.binary()),
                    ],
                    names=["segment", "twice", "at"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, n = [], 0
        for b in batches:
            if b.num_rows:
                hits.append(_slots(b.column(0), slots).ravel())
                n += len(hits[-1])
            if n >= 1 << 20:
                yield from emit(hits)
                hits, n = [], 0
        if n:
            yield from emit(hits)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment to the packed bits of the slots hit at least twice; holds one segment at a time."""
    now, once, twice = None, None, None

    def end() -> Iterator[pa.RecordBatch]:
        if now is not None and twice.any():
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    for b in batches:
        for segment, again, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if segment != now:
                yield from end()
                now, once, twice = segment, np.zeros(_SEGMENT, bool), np.zeros(_SEGMENT, bool)
            at = np.frombuffer(at, "<u4")
            twice[at] |= True if again else once[at]
            once[at] = True
    yield from end()


def repeated_filter(digests: DataFrame, rows: int, most_slots: int = MOST_SLOTS):
    """The broadcast bits of the slots that at least two of the ``digests`` hit, and the number of slots (a power of two)."""
    spark = digests.sparkSession
    slots = min(most_slots, max(_SEGMENT, 1 << (max(1, rows * BITS_PER_ROW) - 1).bit_length()))
    parts = min(slots // _SEGMENT, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hits = digests.select("digest").mapInArrow(_sparse(slots), "segment int, twice boolean, at binary")
    merged = hits.repartition(max(1, parts), "segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment int, bits binary")
    bits = np.zeros(slots // 8, np.uint8)  # at most most_slots / 8 bytes
    for r in merged.toLocalIterator():
        bits[r["segment"] * _SEGMENT // 8 :][: _SEGMENT // 8] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(bits), slots


def maybe_repeated(digests: pa.Array, bits: np.ndarray, slots: int) -> np.ndarray:
    at = _slots(digests, slots)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _found(df: DataFrame, id_column: str, text_column: str, most_slots: int):
    """The result of :func:`exact_copies`, the filter it was made with, and the tables that it reads."""
    kind = df.schema[id_column].dataType.simpleString()
    base = written(df.select(id_column, text_column).mapInArrow(_digests(text_column, id_column), f"doc_id {kind}, n_chars long, digest binary"), "digests")
    rows = base.count()
    bits, slots = repeated_filter(base, rows, most_slots)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maybe = maybe_repeated(b.column(2), bits.value, slots) if b.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(maybe, pa.bool_())], names=[*b.schema.names, "maybe"])

    flagged = written(base.mapInArrow(test, f"doc_id {kind}, n_chars long, digest binary, maybe boolean"), "flagged")
    dropped(base)
    alone = flagged.where(~F.col("maybe")).select("doc_id", "n_chars", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    some = flagged.where("maybe").select("doc_id", "n_chars", "digest")
    groups = written(
        some.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("i"))).alias("best")),
        "groups",
    )
    joined = join_skewed(some, groups, "digest", "group_size", rows)
    kept = F.col("doc_id").eqNullSafe(F.col("best.i")) & (F.col("n_chars") == -F.col("best.n"))
    out = alone.unionByName(joined.select("doc_id", "n_chars", "digest", F.col("best.i").alias("keep_id"), "group_size", kept.alias("kept")))
    return out, bits, slots, (flagged, groups)


def exact_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_slots: int = MOST_SLOTS) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_chars, digest (binary), keep_id, group_size, kept.

    Texts are equal when identical after deletion of every character of
    ``[\\x20\\x09-\\x0D]``; null counts as empty, and all empty texts are one group.
    Of equal texts the one with the most code points stays, then the smallest id (a
    null id comes after all others). Rows that repeat the kept id and length are all
    marked kept, as no column tells them apart; :func:`exact_dedup` leaves one of
    them. An empty table gives an empty result; other columns are not read.
    """
    return _found(df, id_column, text_column, most_slots)[0]


def exact_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_slots: int = MOST_SLOTS) -> DataFrame:
    """The rows of ``df`` that stay, with all its columns and whole texts.

    A row whose hash the filter calls unrepeated goes straight from the scan to the
    result. Only the others are held against the rows to drop.
    """
    found, bits, slots, parts = _found(df, id_column, text_column, most_slots)
    groups = written(found.where("group_size > 1").select("doc_id", "n_chars", "digest", "kept").groupBy("digest", "doc_id", "n_chars").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("times")), "copies")
    dropped(*parts)
    many, most = groups.agg(F.count(F.lit(1)), F.max("times")).first()
    hashed, maybe = free_name(df.columns, "digest"), free_name(df.columns, "maybe")
    length = free_name(df.columns, "length")
    names = [*df.columns, hashed, length, maybe]

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = pa.array([digest(t) for t in raw(b, text_column)], pa.binary())
            m = maybe_repeated(d, bits.value, slots) if b.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*b.columns, d, pc.cast(pc.utf8_length(texts(b, text_column)), pa.int64()), pa.array(m, pa.bool_())], names=names)

    schema = extended(df, (hashed, "binary"), (length, "long"), (maybe, "boolean"))
    tested = df.mapInArrow(test, schema)
    straight = tested.where(~F.col(maybe)).select(*df.columns)
    if not many:
        return straight.unionByName(tested.where(maybe).select(*df.columns))
    a, g = tested.where(maybe).alias("a"), groups.alias("g")
    on = (F.col(f"a.{hashed}") == F.col("g.digest")) & F.col(f"a.{id_column}").eqNullSafe(F.col("g.doc_id")) & (F.col(f"a.{length}") == F.col("g.n_chars"))
    joined = a.join(g, on, "left").where("g.kept IS NULL OR g.kept")
    once = joined.where("g.times IS NULL OR g.times = 1").select(*[F.col(f"a.`{c}`") for c in df.columns])
    out = straight.unionByName(once)
    if most == 1:
        return out
    same = joined.where("g.times > 1").select(*[F.col(f"a.`{c}`") for c in [*df.columns, hashed]]).dropDuplicates([id_column, hashed]).select(*df.columns)
    return out.unionByName(same)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_copies(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLE_SQL = {
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
}
