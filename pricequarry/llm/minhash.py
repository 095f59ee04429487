"""Document fingerprints by MinHash, and near copies by bands of them.

A text's words (runs without [\\x20\\x09-\\x0D], A-Z lower-cased) make shingles of five.
Each shingle has a 64-bit hash, computed for whole batches in numpy; each of PERMS
universal hash functions (a x + b mod 2 ** 64, upper half) permutes them, and the
least value for each is the signature. A fingerprint is its lowest eight bits of each,
in hexadecimal; the share of equal bytes, less what chance gives, estimates the Jaccard
similarity of the shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import dropped, fitting, free_name, id_bounds, join_skewed, keep_only, ranges_of, raw, read, text_of, written
from .components import components

PERMS = 128
WORDS = 5
SIMILARITY = 0.8
#: Bands of ROWS values of the signature: at a similarity of 0.8 a pair shares none once in 70, at 0.85 once in 600, at 0.9 once in 60,000; at 0.5 it shares one once in 8.
BANDS, ROWS = 18, 7
#: Classes of a bucket that one task holds against as many others.
CHUNK_CLASSES = 1_000
#: Bytes of text that are hashed at once, and shingle hashes that are permuted at once (both fit a cache).
CHUNK_BYTES, CHUNK_SHINGLES = 1 << 17, 1 << 14
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += np.uint64(32)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others (shifts and multiplications that can be undone)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_UP, _DOWN = _powers(_BASE, CHUNK_BYTES + 2), _powers(_INVERSE, CHUNK_BYTES + 2)


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a chunk's words, and where each starts: a word's bytes as the digits of a number in a fixed base, mod 2 ** 64, mixed with its length."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_BLANK[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * _UP[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64)), starts


def _long(text: bytes) -> np.ndarray:
    """The word hashes of a text of any length, a chunk at a time. A word longer than a chunk counts as pieces."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + CHUNK_BYTES)
        if end < len(text):
            space = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            end = space + 1 if space > at else end
        out.append(_hashed(np.frombuffer(text, np.uint8, end - at, at))[0])
        at = end
    return np.concatenate(out)


def _shingled(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * _BASE + words[k : k + n]
    return mix(out)


def shingle_hashes(texts: list[bytes], size: int = WORDS) -> list[np.ndarray]:
    """For each text one hash for each run of ``size`` words; of all words if there are fewer; none without words."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, n = at + 1, len(texts[at])
        while end < len(texts) and n + 1 + len(texts[end]) <= CHUNK_BYTES:
            n += 1 + len(texts[end])
            end += 1
        if n > CHUNK_BYTES:
            words, firsts = _long(texts[at]), [0]
        else:
            words, starts = _hashed(np.frombuffer(b"\n".join(texts[at:end]), np.uint8))
            firsts = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts[at : end - 1])])).tolist()
        shingles = _shingled(words, size)
        for i, j in zip(firsts, [*firsts[1:], len(words)], strict=True):
            out.append(shingles[i : j - size + 1] if j - i >= size else _shingled(words[i:j], j - i) if j > i else words[:0])
        at = end
    return out


class Permutations:
    def __init__(self, perms: int = PERMS, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, perms, dtype=np.uint64)

    def signatures(self, groups: list[np.ndarray]) -> np.ndarray:
        """(groups, perms): the least permuted hash of each group; all ones for a group without any."""
        out = np.full((len(groups), len(self.a)), _EMPTY, np.uint64)
        some = [i for i, g in enumerate(groups) if len(g)]
        if not some:
            return out
        at = 0
        while at < len(some):
            mine, n = [], 0
            while at < len(some) and (not mine or n + len(groups[some[at]]) <= CHUNK_SHINGLES):
                mine.append(some[at])
                n += len(groups[some[at]])
                at += 1
            x = np.concatenate([groups[i] for i in mine])
            sizes = np.array([len(groups[i]) for i in mine])
            # one long group is cut in pieces, whose minima are joined
            cuts = np.concatenate([np.arange(0, s, CHUNK_SHINGLES) + o for s, o in zip(sizes, np.cumsum(sizes) - sizes, strict=True)])
            per = -(-sizes // CHUNK_SHINGLES)
            first = np.cumsum(per) - per
            least = np.empty((len(cuts), len(self.a)), np.uint64)
            if len(x) <= CHUNK_SHINGLES:
                for p in range(len(self.a)):
                    least[:, p] = np.minimum.reduceat(x * self.a[p] + self.b[p], cuts)
            else:
                for c, start in enumerate(cuts):
                    piece = x[start : start + CHUNK_SHINGLES]
                    for p in range(len(self.a)):
                        least[c, p] = (piece * self.a[p] + self.b[p]).min()
            out[mine] = np.minimum.reduceat(least, first, axis=0)
        return out


def fingerprint(signatures: np.ndarray) -> np.ndarray:
    """(n, perms) bytes: the lowest eight bits of each value's upper half."""
    return ((signatures >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of fingerprints, 0 to 1: equal bytes beyond the 1/256 that chance gives."""
    share = (a == b).mean(axis=1)
    return np.clip((share - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


# ---------------------------------------------------------------- each document beside the next


def beside_next(df: DataFrame, id_column: str, text_column: str, rows_each: int = 4000) -> DataFrame:
    """``df``'s ids and texts dealt out by ranges of the id, sorted, where the first row of every range stands once more at the end of the one before.

    Columns: range, carried, doc_id, text. The last range ends with the first row of
    all. The bounds are quantiles (a few numbers for each range); no row but the
    ranges' first ones moves twice.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    bounds = id_bounds(rows, "doc_id", fitting(spark, df.count(), rows_each))
    spread = rows.withColumn("range", ranges_of(F.col("doc_id"), bounds))
    # a row stands for its range if none is smaller; of rows with equal ids the smallest text does
    firsts = {r["range"]: r["i"] for r in spread.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), F.col("doc_id").alias("v"))).alias("i")).collect()}
    order = sorted(firsts)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    carry = spark.createDataFrame([(r, firsts[r]["v"], before[r]) for r in order], f"range int, doc_id {rows.schema['doc_id'].dataType.simpleString()}, to int")
    moved = spread.alias("s").join(F.broadcast(carry.alias("c")), (F.col("s.range") == F.col("c.range")) & F.col("s.doc_id").eqNullSafe(F.col("c.doc_id"))).select(F.col("c.to").alias("range"), F.lit(True).alias("carried"), F.col("s.doc_id").alias("doc_id"), "text")
    whole = spread.select("range", F.lit(False).alias("carried"), "doc_id", "text").unionByName(moved)
    return whole.repartitionById(max(order) + 1, "range").sortWithinPartitions("range", "carried", "doc_id", "text")


def _edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values the arrays share at their start."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    return int(apart[0]) if len(apart) else n


def _compare(perms: int, words: int):
    """Rows of one range after another, sorted, each range ending with the next one's first row, to one row for each that is not carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Permutations(perms)
        held: tuple | None = None  # the last row, whose next is not seen yet: carried, doc_id, text, shingles

        for b in batches:
            kind = b.schema.field(2).type
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = pc.fill_null(part.column(3), "").to_pylist()
                rows = list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), texts, shingle_hashes([t.encode() for t in texts], words), strict=True))
                if held is not None:
                    rows = [held, *rows]
                mine = [i for i in range(len(rows) - 1) if not rows[i][0]]
                edits = {i: _edited(rows[i][2], rows[i + 1][2]) for i in mine}
                new = dict(zip(mine, shingle_hashes([e.encode() for e in edits.values()], words), strict=True))
                # an edited text begins with the text's own shingles, whose minima serve for both
                same = [_common(rows[i][3], new[i]) if i in new else 0 for i in range(len(rows))]
                least = family.signatures([r[3][:k] for r, k in zip(rows, same, strict=True)] + [r[3][k:] for r, k in zip(rows, same, strict=True)] + [new[i][same[i] :] for i in mine])
                first, own, other = np.split(least, [len(rows), 2 * len(rows)])
                fps = fingerprint(np.minimum(first, own))
                edited = fingerprint(np.minimum(first[mine], other))
                held = None if rows[-1][0] else rows[-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rows[i][1] for i in mine], kind),
                        pa.array([len(rows[i][2]) for i in mine], pa.int64()),
                        pa.array([hashlib.sha256(edits[i].encode()).hexdigest() for i in mine], pa.string()),
                        pa.array([fps[i].tobytes().hex() for i in mine], pa.string()),
                        pa.array([f.tobytes().hex() for f in edited], pa.string()),
                        pa.array(likeness(fps[mine], edited), pa.float64()),
                        pa.array(likeness(fps[mine], fps[[i + 1 for i in mine]]), pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
        if held is not None:
            raise RuntimeError("a range ended without the next one's first row")

    return run


def fingerprint_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", perms: int = PERMS, words: int = WORDS) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and how alike they and the next document's are.

    The next document is the next in ascending id (after the last, the first; a
    single document is its own next). Ids are numbers or strings (by code points). Null ids come first; rows with equal ids follow
    each other by text. Null texts are empty. A text without words has the fingerprint of
    the empty set, which is like only itself (likeness 1). An empty table gives an empty result.
    """
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if df.isEmpty():
        return df.sparkSession.createDataFrame([], schema)
    return beside_next(df, id_column, text_column).mapInArrow(_compare(perms, words), schema)


# ---------------------------------------------------------------- near copies


def _class_of(shingles: np.ndarray) -> bytes:
    """Names a set of shingle hashes (sorted, each once)."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=8).digest()


def _band_rows(perms: int, bands: int, rows: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        family = Permutations(perms)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                shingles = [np.unique(s) for s in shingle_hashes(raw(part, "text"), words)]
                sigs = family.signatures(shingles) >> np.uint64(32)
                band = np.zeros((len(shingles), bands), np.uint64)
                for k in range(bands):
                    h = np.full(len(shingles), k + 1, np.uint64)
                    for r in range(rows):
                        h = mix(h * _BASE + sigs[:, k * rows + r])
                    band[:, k] = h
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(np.frombuffer(b"".join(map(_class_of, shingles)), "<i8")),
                        pa.array(band.view(np.int64).tolist(), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "key", "class", "bands"],
                )

    return run


def _set_rows(perms: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        family = Permutations(perms)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                shingles = [np.unique(s) for s in shingle_hashes(raw(b.slice(at, 256), "text"), words)]
                sigs = fingerprint(family.signatures(shingles))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(b"".join(map(_class_of, shingles)), "<i8")), pa.array([x.tobytes() for x in sigs], pa.binary()), pa.array([s.view(np.int64) for s in shingles], pa.list_(pa.int64()))],
                    names=["class", "sig", "shingles"],
                )

    return run


def _compare_chunks(similarity: float):
    """From the classes of one bucket (two chunks of them at most) to a spanning forest of the pairs of different roots that are similar.

    Fingerprints are compared all with all, in numpy; where they agree as those of a
    similarity of four standard deviations below the least do, the shingles decide.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        v, i, j = (k.as_py() for k in key)
        classes = table.column("class").to_numpy()
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(classes), -1)
        chunk = table.column("chunk").to_numpy()
        _, labels = np.unique(table.column("root").to_numpy(), return_inverse=True)
        lists = table.column("shingles").combine_chunks()
        sets: dict[int, np.ndarray] = {}

        def held(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = np.sort(lists[k].values.to_numpy())
            return sets[k]

        perms = sigs.shape[1]
        least = perms * (similarity - 4 * math.sqrt(similarity * (1 - similarity) / perms))
        found = []
        for k in range(len(classes) - 1):
            apart = labels[k + 1 :] != labels[k]
            if i != j:
                apart &= chunk[k + 1 :] != chunk[k]
            others = k + 1 + np.flatnonzero(apart)
            if not len(others):
                continue
            for o in others[(sigs[others] == sigs[k]).sum(axis=1) >= least].tolist():
                if labels[o] == labels[k]:
                    continue
                a, b = held(k), held(o)
                if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both >= similarity * (len(a) + len(b) - both):
                    found.append((int(classes[k]), int(classes[o])))
                    labels[labels == labels[o]] = labels[k]
        return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return run


def near_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY, words: int = WORDS, also: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, class, component): the hash of the text, the class of rows with equal shingle sets, and the least class reachable over pairs with a Jaccard similarity of at least ``similarity``.

    Classes that share a band's value are candidates, and so are the rows that ``also``
    (doc_id, component_id) names. First every class is verified against
    the least one of each of its buckets: links in proportion to the rows, which join most near
    copies. Buckets whose classes are then not all joined go to tasks that compare
    them all with all and return a spanning forest; one of many classes is dealt out in
    chunks, each pair of chunks in a task. So no pair of a bucket goes without a link or a comparison,
    and pairs are never written. Only the candidates' shingles are.
    A null text is an empty one; texts without a word
    are one class, which is near no other. Repeated rows and rows with a null id are rows like any other
    (``also`` names rows by ids that are not null). An empty table gives an empty result.
    """
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_of(text_column)).alias("key"), text_of(text_column).alias("text"))
    base = written(rows.mapInArrow(_band_rows(PERMS, BANDS, ROWS, words), f"doc_id {kind}, key long, class long, bands array<long>"), "bands")
    classes = base.groupBy("class").agg(F.first("bands").alias("bands"))
    # the buckets of several classes, each class beside the least one: a bucket of m classes makes m - 1 candidates
    bucket = Window.partitionBy("v")
    keys = classes.select("class", F.explode("bands").alias("v")).select("v", "class", F.min("class").over(bucket).alias("head"), F.count(F.lit(1)).over(bucket).alias("m"))
    shared = written(keys.where("m > 1"), "buckets")
    candidates = shared.where("class <> head").select(F.col("class").alias("a"), F.col("head").alias("b"))
    if also is not None:
        a, b = (base.select(F.col("doc_id").alias(i), F.col("class").alias(n)) for i, n in (("doc_id", "a"), ("component_id", "b")))
        candidates = candidates.unionByName(also.where("doc_id <> component_id").select("doc_id", "component_id").join(a, "doc_id").join(b, "component_id").where("a <> b").select("a", "b"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The fingerprint and the shingles of each class of ``wanted`` (class), from one text of it."""
        texts_of = written(base.join(wanted.distinct(), "class", "left_semi").groupBy("class").agg(F.min("key").alias("key")).select("key").distinct(), "wanted")
        out = written(rows.join(texts_of, "key", "left_semi").select("text").mapInArrow(_set_rows(PERMS, words), "class long, sig binary, shingles array<long>").dropDuplicates(["class"]), "sets")
        dropped(texts_of)
        return out

    pairs = written(candidates.distinct(), "candidates")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("class")))
    a, b = (sets.select(F.col("class").alias(n), F.col("shingles").alias(f"s{n}")) for n in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    links = written(pairs.join(a, "a").join(b, "b").where(both >= similarity * (F.size("sa") + F.size("sb") - both)).where("size(sa) > 0").select("a", "b"), "near")
    first = written(components(links).withColumnRenamed("node", "class"), "roots")
    dropped(pairs)

    # buckets whose classes are not all joined
    named = written(shared.join(first, "class", "left").select("v", "class", "m", F.coalesce("root", "class").alias("root")), "named")
    open_ = named.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi AND n > 2").select("v")
    chunks = F.ceil(F.col("m") / CHUNK_CLASSES).cast("int")
    members = named.join(open_, "v", "left_semi").withColumn("chunk", F.pmod(F.xxhash64("class"), chunks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), chunks - 1)))
    placed = members.select("v", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), "chunk", "class", "root").join(sets, "class")
    more = written(placed.groupBy("v", "i", "j").applyInArrow(_compare_chunks(similarity), "a long, b long").distinct(), "more")
    roots = written(components(links.unionByName(more)).withColumnRenamed("node", "class"), "roots")
    size = base.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    table = written(size.join(roots, "class", "left").select("class", F.coalesce("root", "class").alias("component"), "n"), "components")
    dropped(shared, sets, links, named, more, first, roots)
    return join_skewed(base.select("doc_id", "key", "class"), table, "class", "n", base.count()).select("doc_id", "key", "class", "component")


def near_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY, words: int = WORDS, also: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` that stay, with all columns: of each component of :func:`near_copies` the row with the smallest id.

    Rows with a null id stay, as nothing tells which they are. Of rows that repeat a
    kept id one stays for each text.
    """
    found = written(near_copies(df, id_column, text_column, similarity, words, also), "copies")
    least = written(found.groupBy("component").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "least")
    named = written(join_skewed(found, least, "component", "n", found.count()).select("doc_id", "key", "least"), "named")
    gone, twice, text = free_name(df.columns, "gone"), free_name(df.columns, "twice"), free_name(df.columns, "key")
    away = named.where("doc_id <> least").select(F.col("doc_id").alias(gone), F.col("key").alias(text)).distinct()
    again = written(named.where("doc_id = least").groupBy(F.col("doc_id").alias(twice)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(twice), "twice")
    away = written(away, "gone")
    dropped(found, least, named)
    out = df.join(away, (F.col(id_column) == F.col(gone)) & (F.xxhash64(text_of(text_column)) == F.col(text)), "left_anti")
    if again.isEmpty():
        return out
    repeated = F.col(id_column) == F.col(twice)
    return out.join(again, repeated, "left_anti").unionByName(out.join(again, repeated, "left_semi").dropDuplicates([id_column, text_column]))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op1_minhash": op1_minhash}
#: MinHash over numpy hashes has no SQL; tests/llm holds it against exact Jaccard similarities.
ORACLE_SQL: dict[str, str] = {}
