"""Best-fit packing with certified bounds.

Documents longer than a sequence are cut; what is left over is packed into sequences
of CAPACITY tokens. Groups of pieces are packed by best-fit decreasing. A lower bound
from dual feasible functions certifies a group's count of sequences where they meet.
Where they do not, the group has a gap, and pieces are exchanged: it gives up the sequences with room for 1/64 or more, and its emptiest ones, two for each sequence over
its bound and one more; their pieces are dealt to fewer groups and packed again. A certified
group keeps its sequences and takes no part. When no group has a gap, or one holds all that
is left of those that have, a bound over all pieces certifies the whole; where it does not, the
whole has a gap that no group shows (each rounds up to whole sequences by itself), and
the sequences with room of the certified groups are packed together once, in place of what they
were if that takes fewer.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import keep_only, read, texts, written
from .tokens import TEXTS, Encoder, tokenizer_path

CAPACITY = 2048
#: Pieces that one group packs at first (about 60 bytes each in memory), and at most after exchanges.
GROUP_PIECES, MOST_PIECES = 4096, 1 << 18
#: Sequences with this share of room are given up.
LOOSE = 1 / 64
#: What becomes of a sequence: it stays, its pieces are exchanged, or it has room in a certified group.
KEPT, GIVEN, TAIL = 0, 1, 2


def pieces_of(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only documents longer than a sequence have several."""
    return [(at, min(capacity, length - at)) for at in range(0, length, capacity)]


def _cut(tokenizer: str, end_id: int, capacity: int, id_column: str, text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("tokens")
        encoder, end = Encoder.of(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            keys = b.column(b.schema.get_field_index(id_column))
            column = texts(b, text_column)
            rows, out = [], []
            for at in range(0, b.num_rows, TEXTS):
                for i, ids in enumerate(encoder.encode_column(column.slice(at, TEXTS)), at):
                    ids += end
                    for k, (start, n) in enumerate(pieces_of(len(ids) // 4, capacity)):
                        rows.append(i)
                        out.append((k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            k, start, n, crc = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_documents(df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece of each row of ``df``: doc_id, piece, start, length, ids_crc32. A null text is empty: the end id alone."""
    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(_cut(tokenizer, end_id, capacity, id_column, text_column), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The sequence number of each piece: longest first, each into the open sequence that it leaves the least room in, else into a new one."""
    out = np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a sequence has room r
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + ((fits & -fits).bit_length() - 1)
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, k = capacity, opened
            opened += 1
        out[i] = k
        room -= n
        if room:
            by_room[room].append(k)
            rooms |= 1 << room
    return out


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs. ``counts[n]``: pieces of length n.

    The largest bound of three families of dual feasible functions, each for all its
    parameters: the identity; f_t (pieces over capacity - t count whole, those under t
    not at all, the rest by length); and u_k (the share rounded down to 1/k, exact
    multiples kept).
    """
    n = np.arange(capacity + 1, dtype=np.int64)
    total = int((counts * n).sum())
    best = -(-total // capacity)
    upto = np.concatenate([[0], np.cumsum(counts)])
    weight = np.concatenate([[0], np.cumsum(counts * n)])
    for t in range(1, capacity // 2 + 1):
        whole = int(upto[capacity + 1] - upto[capacity - t + 1])
        middle = int(weight[capacity - t + 1] - weight[t])
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 101):
        scaled = n * (k + 1)
        exact = scaled % capacity == 0
        # in units of 1 / (k * capacity), so that all stays in integers
        value = np.where(exact, n * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def _pack(capacity: int, round_no: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins = best_fit_decreasing(lengths, capacity)
        n_bins = int(bins.max()) + 1
        used = np.bincount(bins, weights=lengths, minlength=n_bins).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        emptiest = np.argsort(used, kind="stable")
        state = np.full(n_bins, KEPT, np.int32)
        # a certified group keeps its sequences; what it could give once the whole falls short is marked
        open_ = GIVEN if n_bins > bound else TAIL
        state[emptiest[: 1 + 2 * (n_bins - bound)]] = open_
        state[capacity - used >= capacity * LOOSE] = open_
        state[used == capacity] = KEPT
        order = np.lexsort((np.arange(len(bins)), bins))
        sizes = lengths[order]
        ends = np.cumsum(sizes)
        first = np.r_[0, ends[:-1]]
        heads = np.flatnonzero(np.r_[True, np.diff(bins[order]) != 0])
        base = np.repeat(first[heads], np.diff(np.r_[heads, len(order)]))
        offset = np.empty(len(bins), np.int64)
        offset[order] = first - base
        return pdf.drop(columns="group").assign(
            sequence_id=(np.int64(round_no) << 56) + (np.int64(key[0]) << 24) + bins,
            offset=offset,
            state=state[bins],
        )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (a written table: doc_id, piece, start, length, ids_crc32) with sequence_id, offset and bound.

    ``bound`` is the proven least number of sequences for all pieces. In each round,
    groups of pieces dealt at random are packed in tasks of their own, and what those with a gap
    give up goes to the next. No piece is dropped; ties are broken by length, id and
    piece number. Repeated rows are pieces of their own.
    """
    kind = pieces.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, state int"
    counts = np.zeros(capacity + 1, np.int64)  # at most capacity + 1 rows reach the driver
    for r in pieces.groupBy("length").count().toLocalIterator():
        counts[r["length"]] = r["count"]
    bound = lower_bound(counts, capacity)
    # a whole sequence needs no packing
    whole = pieces.where(F.col("length") == capacity).select(*columns, (F.lit(0xFF << 54).cast("long") + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    final, tails = [written(whole, "whole")], []
    kept = int(counts[capacity])

    def packed_in(rest: DataFrame, groups: int, round_no: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
        """The pieces packed in groups dealt at random, and the number of sequences and pieces in each state."""
        # rows of a written table, so that their numbers are the same when a task runs again; equal rows are dealt apart
        key = F.pmod(F.xxhash64(F.lit(round_no), F.monotonically_increasing_id()), F.lit(groups)).cast("int")
        out = written(rest.select(*columns, key.alias("group")).groupBy("group").applyInPandas(_pack(capacity, round_no), schema), "packed")
        sizes = out.groupBy("state", "sequence_id").agg(F.count(F.lit(1)).alias("pieces")).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("pieces").alias("pieces"))
        return out, {r["state"]: (r["n"], r["pieces"]) for r in sizes.collect()}

    def counted(state: int, n: dict[int, tuple[int, int]]) -> tuple[int, int]:
        return n.get(state, (0, 0))

    rest, left, round_no = pieces.where(F.col("length") < capacity), int(counts[:capacity].sum()), 1
    groups = math.ceil(left / group_pieces)
    ended = None
    while left:
        packed, n = packed_in(rest, groups, round_no)
        final.append(packed.where(F.col("state") == KEPT))
        kept += counted(KEPT, n)[0]
        if counted(TAIL, n)[0]:
            tails.append((packed.where(F.col("state") == TAIL), *counted(TAIL, n)))
        rest, (given, left) = packed.where(F.col("state") == GIVEN), counted(GIVEN, n)
        after = max(1, math.ceil(left / MOST_PIECES), min(groups // 2, math.ceil(left / group_pieces)))
        round_no += 1
        if left and after >= groups:
            ended = (rest, given, left)
            break
        groups = after
    # what is left of the gaps, and the certified groups' sequences with room
    last = [*tails, *([ended] if ended else [])]
    open_, left = sum(n for _, n, _ in last), sum(n for _, _, n in last)
    if last and kept + open_ > bound and len(last) + open_ > 2:
        rest = last[0][0]
        for more, _, _ in last[1:]:
            rest = rest.unionByName(more)
        packed, n = packed_in(rest, math.ceil(left / MOST_PIECES), round_no)
        if sum(x for x, _ in n.values()) < open_:
            last = [(packed, 0, 0)]
    final += [df for df, _, _ in last]
    out = final[0].select(*columns, "sequence_id", "offset")
    for part in final[1:]:
        out = out.unionByName(part.select(*columns, "sequence_id", "offset"))
    return out.withColumn("bound", F.lit(bound).cast("long"))


def pack_documents(df: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Cuts and packs all rows of ``df``; an empty table gives an empty result."""
    pieces = written(cut_documents(df, tokenizer or tokenizer_path("word_bpe_49k.json"), 0, capacity, id_column, text_column), "pieces")
    return pack(pieces, capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op2_packing": op2_packing}
#: Byte-pair encoding has no SQL; tests/llm checks pieces, gaps and bounds.
ORACLE_SQL: dict[str, str] = {}
