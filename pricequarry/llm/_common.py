"""What several of the operators share: the shared folder, tables written to cut lineage, skew-proof joins."""

from __future__ import annotations

import atexit
import ctypes
import gc
import json
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors see.

    Where that is unset, a local session gets a folder of its own that goes when
    Python ends; on a cluster it is an error, as no machine-local folder would do.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if root:
        return f"{root.rstrip('/')}/{sc.applicationId}"
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        own = tempfile.mkdtemp(prefix="pricequarry-")
        atexit.register(shutil.rmtree, own, True)
        _OWN[sc.applicationId] = f"file://{own}"
    return _OWN[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and read again after an executor is lost."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pq_path = path
    return out


#: Rows of whole texts that a Python worker gets at once where its memory is shared with other stages.
BATCH_ROWS = 2_000


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What is run inside hands at most ``rows`` rows at once to Python, or as few as the session says.

    A batch stands several times in an executor (its vectors, the buffer that it is sent by, the worker's
    own), and Spark bounds it by rows, however long their texts. Every row comes in some batch all the same.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(before, rows) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


#: What a Python worker keeps from task to task, by the module that keeps it.
_KEPT: dict[str, dict] = {}


def kept_by(name: str) -> dict:
    """A dictionary, empty at first, for what tasks of one module leave in a worker for its later tasks."""
    return _KEPT.setdefault(name, {})


def keep_only(*names: str) -> None:
    """Called in a task: lets go of what tasks of other modules have left in this worker, and gives the memory back.

    Workers outlive the stages of a pipeline, and each stage would add its tables to those of the stages before it.
    """
    others = [kept for name, kept in _KEPT.items() if kept and name not in names]
    for kept in others:
        kept.clear()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU's C library keeps freed memory otherwise
        if trim:
            trim(0)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_pq_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and path of a URI in the shared folder."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri)
    return pafs.LocalFileSystem(), uri


def put_whole(uri: str, chunks) -> int:
    """Writes a file under another name first, so that a lost or repeated task never leaves half of it."""
    fs, path = opened(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    draft, n = f"{path}.{uuid.uuid4().hex[:8]}.draft", 0
    with fs.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    fs.move(draft, path)
    return n


def fitting(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for so many rows: enough for every core, and at most ``each`` rows in one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, math.ceil(rows / each))


#: A key with over 1/HOT of all rows is hot. There are at most HOT of those, which bounds what is broadcast.
HOT = 1000


def join_skewed(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left-joins ``rows`` to ``groups``, which has one row for each non-null ``key`` and its number of rows in ``size``.

    Hot keys are joined by a broadcast of at most HOT rows; only the rest shuffle,
    so no task gets more than 1/HOT of the rows for one key. Both inputs should be
    tables that are cheap to read twice.
    """
    hot = groups.where(F.col(size) * HOT > F.lit(total))
    cold = groups.where(F.col(size) * HOT <= F.lit(total))
    keys = F.broadcast(hot.select(key))
    here = rows.join(F.broadcast(hot), key)
    # a null key goes with the rest, spread over the tasks by the join below only if there are few of them
    rest = rows.join(keys, key, "left_anti")
    return here.unionByName(rest.join(cold, key, "left"))


def texts(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A text column with null as the empty text."""
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return pc.fill_null(col, "")


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column as UTF-8, null as the empty text."""
    return texts(batch, column).cast(pa.binary()).to_pylist()


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(taken: list[str], name: str) -> str:
    """``name``, or with underscores before it until no column has it (names differ in case only for people)."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def extended(df: DataFrame, *columns: tuple[str, str]) -> T.StructType:
    """The schema of ``df`` with (name, type) columns after its own."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in columns)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Ranges of ids, at most: what bounds the driver's quantiles and the array that every row is held against.
MOST_RANGES = 1 << 15


def id_bounds(df: DataFrame, column: str, parts: int) -> list:
    """At most ``parts - 1`` values, and fewer than MOST_RANGES, that cut ``column`` (numbers or strings) into ranges of about as many rows each.

    Of strings, about eight for each range come to the driver, chosen by their hash.
    Bounds decide where rows go, never what a result holds.
    """
    parts = min(parts, MOST_RANGES)
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.NumericType, T.StringType)):
        raise TypeError(f"{column} is {kind.simpleString()}: ids are numbers or strings")
    if parts < 2:
        return []
    if isinstance(kind, T.NumericType):
        return sorted(set(df.select(F.col(column).cast("double")).na.drop().approxQuantile(column, [i / parts for i in range(1, parts)], 0.1 / parts)))
    known = df.select(column).na.drop()
    share = 8 * parts / max(1, known.count())
    some = sorted(r[0] for r in known.where(F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))).toLocalIterator())
    return sorted({some[i * len(some) // parts] for i in range(1, parts)}) if some else []


def ranges_of(column: Column, bounds: list) -> Column:
    """The number of bounds that a column reaches; 0 for null. Found by halving in one array literal, so that the plan is small for any number of bounds."""
    if not bounds:
        return F.lit(0)
    depth = len(bounds).bit_length()
    spare = (1 << depth) - 1 - len(bounds)
    if isinstance(bounds[0], str):
        held, value = F.from_json(F.lit(json.dumps([*bounds, *[None] * spare])), "array<string>"), column
    else:
        held, value = F.lit(np.array([*bounds, *[math.inf] * spare])), column.cast("double")
    steps = F.lit(np.array([1 << k for k in reversed(range(depth))], np.int32))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(value >= F.element_at(held, at + step), at + step).otherwise(at))
