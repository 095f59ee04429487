"""SimHash near-dedup by tiled exact comparison.

Fingerprints that differ at no more than RADIUS of 64 bits are linked. Distinct
fingerprints are sorted by the population counts of their four 16-bit quarters and
written as tiles. Every task holds one block of them and streams the tiles past it:
the sum of the quarters' differences in population count never exceeds the number of
differing bits, so tile pairs beyond the radius are skipped, and all others are
compared exactly by numpy exclusive-or and bit counts. Links leave a task as a
spanning forest, never as all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import dropped, fitting, free_name, join_skewed, keep_only, opened, raw, read, written
from .components import components, union_pairs

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Fingerprints in the block that a task holds (16 bytes each).
BLOCK_ROWS = 500_000
#: Fingerprints that are streamed past it at once, and pairs compared at once.
TILE_ROWS, PAIRS = 32_768, 1 << 20
#: Cells of a tile that are held against a block's cells at once.
CELLS = 64
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of each run of so many words, A-Z lower-cased, joined by single spaces; of all words if there are fewer; none without words."""
    parts = text.lower().split()  # bytes: A-Z only, and exactly [\x20\x09-\x0D]
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), seed)] if parts else []
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = (ends - np.fromiter(map(len, parts), np.int64, len(parts)) - 1)[: len(parts) - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    return [digest(joined[i:j], seed) for i, j in zip(starts, stops, strict=True)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive runs of ``counts`` hashes, the bits set in over half of each; 0 for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some].astype(np.int64)
    starts = np.cumsum(n) - n
    # pieces of at most 255 hashes, so that a byte of a lane holds each count
    per = -(-n // 255)
    first = np.cumsum(per) - per
    piece = np.repeat(starts, per) + 255 * (np.arange(per.sum()) - np.repeat(first, per))
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, piece).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes, first, axis=0, dtype=np.int64)
        for byte in range(8):
            out[some] |= (ones[:, byte] * 2 > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(texts: list[bytes], words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    counts: list[int] = []
    done = 0
    for i, t in enumerate(texts):
        own = shingle_hashes(t, words, seed)
        hashes += own
        counts.append(len(own))
        if len(hashes) > 1 << 18 or i == len(texts) - 1:
            out[done : i + 1] = majority_bits(np.array(hashes, np.uint64), np.array(counts))
            hashes, counts, done = [], [], i + 1
    return out


def quarter_counts(fps: np.ndarray) -> np.ndarray:
    """(n, 4) population counts of the 16-bit quarters."""
    return np.bitwise_count(np.ascontiguousarray(fps).view("<u2").reshape(-1, 4)).astype(np.int64)


def cells_of(fps: np.ndarray) -> np.ndarray:
    """One number for the four counts: of at most 17 ** 4 cells."""
    return quarter_counts(fps) @ np.array([17**3, 17**2, 17, 1])


def _counts_of_cells(cells: np.ndarray) -> np.ndarray:
    return np.stack([cells // 17**3, cells // 17**2 % 17, cells // 17 % 17, cells % 17], axis=1).astype(np.int16)


def _runs(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of a sorted array, and where each starts, with the end."""
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    return cells[starts], np.r_[starts, len(cells)]


class Block:
    """Fingerprints, sorted by cell, that tiles are compared with."""

    def __init__(self, fps: np.ndarray, radius: int):
        cells = cells_of(fps)
        order = np.lexsort((fps, cells))
        self.fps, self.radius = fps[order], radius
        self.cells, self.starts = _runs(cells[order])
        self.counts = _counts_of_cells(self.cells)
        self.sizes = np.diff(self.starts)
        self.labels = np.arange(len(fps))
        self.low, self.high = int(self.counts[:, 0].min()) - radius, int(self.counts[:, 0].max()) + radius

    def may_hold(self, first_cell: int, last_cell: int) -> bool:
        """False if no fingerprint of these cells (not before this block's own) can be in reach."""
        return last_cell >= self.cells[0] and first_cell // 17**3 <= self.high and last_cell // 17**3 >= self.low

    def links(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joins what a tile links and returns, for each of the tile's fingerprints that is linked, one of this block that it belongs with."""
        cells = cells_of(fps)
        order = np.lexsort((fps, cells))
        fps = fps[order]
        tiles, starts = _runs(cells[order])
        labels = np.concatenate([self.labels, len(self.fps) + np.arange(len(fps))])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(len(tiles)):
            # boxes first: a cell of the tile against the cells of the block, each pair once; few at a time are in memory
            if k % CELLS == 0:
                some = tiles[k : k + CELLS]
                near = (np.abs(self.counts[:, None, :] - _counts_of_cells(some)[None, :, :]).sum(axis=2, dtype=np.int16) <= self.radius) & (some[None, :] >= self.cells[:, None])
                any_near = near.any(axis=0)
            if not any_near[k % CELLS]:
                continue
            rows = np.flatnonzero(np.repeat(near[:, k % CELLS], self.sizes))
            mine = self.fps[rows]
            tile = fps[starts[k] : starts[k + 1]]
            step = max(1, PAIRS // len(mine))
            for at in range(0, len(tile), step):
                hit = np.bitwise_count(mine[:, None] ^ tile[None, at : at + step]) <= self.radius
                i, j = np.nonzero(hit)
                if len(i):
                    found.append((rows[i], len(self.fps) + starts[k] + at + j))
                if sum(len(x) for x, _ in found) > PAIRS or len(found) > 1000:
                    union_pairs(labels, *map(np.concatenate, zip(*found, strict=True)))
                    found = []
        if found:
            union_pairs(labels, *map(np.concatenate, zip(*found, strict=True)))
        self.labels = labels[: len(self.fps)].copy()  # a set's least member is always one of the block
        linked = labels[len(self.fps) :]
        some = linked < len(self.fps)
        return fps[some], self.fps[linked[some]]


def _compare(store: list[tuple[str, int, int]], radius: int):
    def tiles(uri: str) -> Iterator[np.ndarray]:
        fs, path = opened(uri)
        with fs.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(TILE_ROWS, columns=["fp"]):
                yield batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches if b.num_rows]
        if not held:
            return
        block = Block(np.concatenate(held), radius)
        for uri, first, last in store:
            if block.may_hold(first, last):
                for tile in tiles(uri):
                    a, b = block.links(tile)
                    apart = a != b
                    if apart.any():
                        yield edges(a[apart], b[apart])
        hung = np.flatnonzero(block.labels != np.arange(len(block.labels)))
        if len(hung):
            yield edges(block.fps[hung], block.fps[block.labels[hung]])

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): links that join the same sets of fingerprints as all pairs within the radius do. ``distinct``: a table with each ``fp`` once."""
    spark = distinct.sparkSession
    n = distinct.count()
    sums = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(4)]
    cell = sum((c * 17 ** (3 - q) for q, c in enumerate(sums)), F.lit(0)).cast("int")
    parts = fitting(spark, n, block_rows) if n > 4096 else 1
    store = written(distinct.select("fp", cell.alias("cell")).repartitionByRange(parts, "cell", "fp").sortWithinPartitions("cell", "fp"), "tiles")
    spans = {r["f"]: (r["lo"], r["hi"]) for r in store.groupBy(F.input_file_name().alias("f")).agg(F.min("cell").alias("lo"), F.max("cell").alias("hi")).collect()}
    directory = sorted(((uri, *span) for uri, span in spans.items()), key=lambda x: x[1:])
    return written(store.select("fp").mapInArrow(_compare(directory, radius), "a long, b long").distinct(), "pairs")


def simhash_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row for each row of ``df``: doc_id, fp (long), component_id, links.

    ``component_id`` is the smallest id reachable over links of fingerprints that
    differ at ``radius`` bits or fewer, the row's own included; ``links`` is the
    number of rows in the component. Null and wordless texts have the fingerprint
    zero, which is linked like any other. Null ids are passed over when the smallest
    is sought; a component of null ids only has a null component_id. Repeated rows
    and equal texts share a fingerprint. An empty table gives an empty result.
    """
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for b in batches:
            fps = np.concatenate([np.zeros(0, np.uint64), *(fingerprints(raw(b.slice(at, 1000), text_column), words) for at in range(0, b.num_rows, 1000))])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(id_column)), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    docs = written(df.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, fp long"), "fingerprints")
    distinct = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    pairs = near_links(distinct, radius)
    rows = docs.count()
    if pairs.isEmpty():
        return join_skewed(docs, distinct, "fp", "n", rows).select("doc_id", "fp", F.col("least").alias("component_id"), F.col("n").alias("links"))
    roots = written(components(pairs).withColumnRenamed("node", "fp"), "roots")
    linked = written(distinct.join(roots, "fp"), "linked")
    whole = written(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("links"), F.count(F.lit(1)).alias("k")), "whole")
    named = join_skewed(linked, whole, "root", "k", linked.count()).select("fp", "component_id", "links", "n")
    alone = distinct.join(roots, "fp", "left_anti").select("fp", F.col("least").alias("component_id"), F.col("n").alias("links"), "n")
    table = written(named.unionByName(alone), "components")
    dropped(pairs, roots, linked, whole, distinct)
    return join_skewed(docs, table, "fp", "n", rows).select("doc_id", "fp", "component_id", "links")


def simhash_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``df`` that stay, with all columns: of each component the row with the smallest id.

    Rows with a null id stay, as nothing tells which they are. Of rows that repeat a
    kept id one stays for each text.
    """
    found = simhash_groups(df, id_column, text_column, radius, words)
    gone = written(found.where("doc_id <> component_id").select("doc_id", "component_id").distinct(), "gone")
    out = df.join(gone.select(F.col("doc_id").alias(free_name(df.columns, "gone"))), F.col(id_column) == F.col(free_name(df.columns, "gone")), "left_anti")
    twice = written(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twice")
    if twice.isEmpty():
        return out
    key = free_name(df.columns, "twice")
    again = twice.select(F.col("doc_id").alias(key))
    same = out.join(again, F.col(id_column) == F.col(key), "left_semi").dropDuplicates([id_column, text_column])
    return out.join(again, F.col(id_column) == F.col(key), "left_anti").unionByName(same)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "links")


QUERIES = {"op3_simhash": op3_simhash}
#: XXH64 and majority bits have no DuckDB form; tests/llm compares all pairs by brute force.
ORACLE_SQL: dict[str, str] = {}
