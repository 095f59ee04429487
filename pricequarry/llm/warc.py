"""WARC archives with a two-level capture index.

Pages are dealt out by ranges of their reversed-host URL key and written in that order,
one gzip member for each record. Equal payloads are stored once: the smallest page_id's
record is a response, the others are revisit records that refer to it. The index of a
file's records, in the order of their keys, is cut into compressed blocks; a sparse
directory holds each block's first key. A look-up searches the directory by halving,
reads one block, searches it, and reads the record's bytes and no others.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import dropped, fitting, join_skewed, new_path, opened, put_whole, raw, read, texts, written

#: Index lines in a compressed block.
BLOCK_LINES = 500
#: Ranges of keys that look-ups are dealt out by, at most, and questions that one task answers, about.
MOST_RANGES, QUESTIONS = 10_000, 1_000
#: Revisit records are written for equal payloads of at least so many bytes.
LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def capture_key(url: str) -> str:
    """``http://www.example.net:80/a?b`` as ``net,example,www:80)/a?b``: hosts of a domain stand side by side. Without ``://`` the URL itself, after a ``)``."""
    scheme, mark, rest = url.partition("://")
    if not mark:
        return ")" + url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, port = rest[:cut].lower(), ""
    name, colon, number = host.rpartition(":")
    if colon and number.isdigit():
        host, port = name, ":" + number
    return ",".join(reversed(host.split("."))) + port + ")" + rest[cut:]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{copy}')}>"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(3, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def make_record(page_id: object, copy: int, url: str, payload: bytes, digest: str, refers_to: object = None, revisit: bool = False) -> bytes:
    """One record's bytes. A revisit keeps the response's HTTP head, which holds the payload's length, and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    # a line's end in a URL would end the header
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, copy)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {json.dumps(page_id)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, 0)}", f"X-Refers-To-Page: {json.dumps(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return _member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def parse_record(data: bytes) -> dict:
    """Headers, and for responses the payload, of one record's bytes."""
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or payload_digest(payload) != fields["WARC-Payload-Digest"].removeprefix("sha1:")):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"record_type": kind, "page_id": json.loads(fields["X-Page-Id"]), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": json.loads(fields.get("X-Refers-To-Page", "null")), "payload": payload if kind == "response" else None}


# ---------------------------------------------------------------- writing


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, html to page_id, key, digest, bytes."""
    for b in batches:
        payloads = raw(b, "html")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([capture_key(u) for u in texts(b, "url").to_pylist()], pa.string()), pa.array([payload_digest(p) for p in payloads], pa.string()), pa.array([len(p) for p in payloads], pa.int64())], names=["page_id", "key", "digest", "bytes"])


def _write(root: str):
    """Rows sorted by (key, page_id, digest, copy known) to an archive and its index blocks; yields a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        archive, index = f"{root}/pages-{name}.warc.gz", f"{root}/index-{name}.cdx.gz"
        lines: list[str] = []
        blocks: list[tuple] = []
        members: list[bytes] = []
        state = {"at": 0, "index": 0}
        known: dict = {"of": None}

        def close() -> None:
            if lines:
                packed = zlib.compress("\n".join(lines).encode(), 6)
                blocks.append((json.loads(lines[0])[0], json.loads(lines[-1])[0], archive, index, state["index"], len(packed), len(lines)))
                members.append(packed)
                state["index"] += len(packed)
                lines.clear()

        def records() -> Iterator[bytes]:
            for b in batches:
                key, page, digest, kept, first, url, html = (b.column(i) for i in range(7))
                payloads = raw(b, "html")
                for k, p, d, role, refers, u, payload in zip(key.to_pylist(), page.to_pylist(), digest.to_pylist(), kept.to_pylist(), first.to_pylist(), texts(b, "url").to_pylist(), payloads, strict=True):
                    own = (k, p, d)
                    if role == "role":  # what is known of the pages that follow with this key, id and digest
                        known.update(of=own, refers=refers, copies=1)
                        continue
                    if known["of"] == own:
                        revisit, to = True, known["refers"]
                        copy = known["copies"]
                        known["copies"] += 1
                    else:
                        # a response; rows that repeat it are its revisits
                        revisit, to, copy = False, None, 0
                        if len(payload) >= LEAST_BYTES:
                            known.update(of=own, refers=p, copies=1)
                    data = make_record(p, copy, u, payload, d, to, revisit)
                    lines.append(json.dumps([k, p, state["at"], len(data)], ensure_ascii=False))
                    state["at"] += len(data)
                    if len(lines) >= BLOCK_LINES:
                        close()
                    yield data

        head = next(batches, None)
        if head is None:
            return
        later = batches

        def again() -> Iterator[pa.RecordBatch]:
            yield head
            yield from later

        batches = again()
        put_whole(archive, records())
        close()
        put_whole(index, members)
        if blocks:
            columns = list(zip(*blocks, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["first_key", "last_key", "archive", "index", "at", "bytes", "lines"])

    return run


def write_archive(df: DataFrame, root: str, rows_per_file: int = 5_000) -> DataFrame:
    """Archives all rows of ``df`` (page_id, url, html) under ``root`` and returns the directory: one row for each index block.

    Null html is the empty payload, a null url the empty one. Of records with equal payloads the
    one with the smallest page_id (then the smallest URL key) is the response. A null page_id comes after all others. Of rows that repeat a page's id, url and
    payload, one takes its part and the rest revisit. Only ids, keys and digests are
    grouped; the pages themselves move once, by ranges of (key, id), beside which what is known of
    repeated payloads arrives as rows of their own. An empty table gives an empty directory.
    """
    spark = df.sparkSession
    kind = df.schema["page_id"].dataType.simpleString()
    pages = df.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = written(pages.mapInArrow(_keyed, f"page_id {kind}, key string, digest string, bytes long"), "keyed")
    rows = keyed.count()
    groups = written(keyed.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("key").alias("key"))).alias("first")).where("n > 1"), "payloads")
    repeated = join_skewed(keyed, groups, "digest", "n", rows).where("n IS NOT NULL AND NOT (page_id <=> first.id AND key = first.key)")
    roles = repeated.select("key", "page_id", "digest", F.lit("role").alias("kind"), F.col("first.id").alias("first"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")).distinct()

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, k in ((b, next(_keyed(iter([b])))) for b in batches):
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([k.column(1), b.column(0), k.column(2), pa.array(["row"] * n, pa.string()), pa.nulls(n, b.column(0).type), b.column(1), b.column(2)], names=["key", "page_id", "digest", "kind", "first", "url", "html"])

    held = pages.mapInArrow(with_key, f"key string, page_id {kind}, digest string, kind string, first {kind}, url string, html string")
    bounds = fitting(spark, rows, rows_per_file)
    ordered = held.unionByName(roles).repartitionByRange(bounds, "key", F.col("page_id").asc_nulls_last()).sortWithinPartitions("key", F.col("page_id").asc_nulls_last(), "digest", "kind")
    out = written(ordered.mapInArrow(_write(root), "first_key string, last_key string, archive string, index string, at long, bytes long, lines long"), "directory")
    dropped(keyed, groups)
    return out


# ---------------------------------------------------------------- reading


def read_block(index: str, at: int, size: int) -> list[list]:
    fs, path = opened(index)
    with fs.open_input_file(path) as f:
        f.seek(at)
        return [json.loads(x) for x in zlib.decompress(f.read(size)).decode().split("\n")]


class Archives:
    """Open archives of a task; records that lie side by side are read at once."""

    def __init__(self) -> None:
        self.uri, self.file = None, None

    def records(self, uri: str, lines: list[list], most: int = 8 << 20) -> Iterator[dict]:
        if uri != self.uri:
            if self.file is not None:
                self.file.close()
            fs, path = opened(uri)
            self.uri, self.file = uri, fs.open_input_file(path)
        i = 0
        while i < len(lines):
            start, end, j = lines[i][2], lines[i][2] + lines[i][3], i + 1
            while j < len(lines) and lines[j][2] == end and end - start < most:
                end += lines[j][3]
                j += 1
            self.file.seek(start)
            data = self.file.read(end - start)
            for _, _, at, size in lines[i:j]:
                yield parse_record(data[at - start : at - start + size])
            i = j


_FIELDS = (("page_id", None), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", None), ("payload", pa.binary()))


def _batch(records: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], t or kind) for n, t in _FIELDS], names=[n for n, _ in _FIELDS])


def _schema(kind: str) -> str:
    return f"page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, payload binary"


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def read_archive(directory: DataFrame, kind: str = "bigint", payloads: bool = True) -> DataFrame:
    """Every record of the archives, by way of the index: a task takes index blocks, and reads the ranges of the archive that they name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = Archives()
        for b in batches:
            for archive, index, at, size in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                found = []
                for r in archives.records(archive, read_block(index, at, size)):
                    found.append(r if payloads else r | {"payload": None})
                    if len(found) == 100:
                        yield _batch(found, _ARROW[kind])
                        found = []
                yield _batch(found, _ARROW[kind])

    blocks = directory.select("archive", "index", "at", "bytes")
    n = fitting(directory.sparkSession, directory.count(), 8)
    return blocks.repartition(n, "archive", "at").mapInArrow(run, _schema(kind))


def look_up(directory: DataFrame, urls: DataFrame, kind: str = "bigint", most_ranges: int = MOST_RANGES, questions: int = QUESTIONS) -> DataFrame:
    """The captures of the ``url`` s asked for: (asked, page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload).

    Questions and index blocks meet by ranges of the key, never by pairs of all: each
    question goes to the range of the directory (at most ``most_ranges`` bounds) that its key falls in,
    and is searched there by halving, first among the blocks, then in the block. A range
    whose blocks end within a run of equal keys hands the question on to the next one. A range with
    more questions than ``questions`` is searched by several tasks, each with its blocks' directory rows.
    A null question is the empty URL; repeated ones are answered once; an empty table of
    questions or an empty directory gives an empty result.
    """
    # archives stand in the order of their keys, so that every so many-th begins a range
    number = F.regexp_extract("archive", r"pages-(\d+)-", 1).cast("int")
    archives = directory.agg(F.countDistinct("archive")).first()[0]
    starts = directory.where(number % max(1, -(-archives // most_ranges)) == 0).groupBy("archive").agg(F.min("first_key").alias("k"))
    ranges = directory.sparkSession.sparkContext.broadcast(sorted({"", *(r["k"] for r in starts.toLocalIterator())}))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = ranges.value
        for b in batches:
            asked, keys, part = [], [], []
            for u in texts(b, "url").to_pylist():
                k = capture_key(u)
                for i in range(max(0, bisect.bisect_left(bounds, k) - 1), bisect.bisect_right(bounds, k)):
                    asked.append(u)
                    keys.append(k)
                    part.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(keys, pa.string()), pa.array(asked, pa.string())], names=["part", "key", "asked"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = ranges.value
        for b in batches:
            first = b.column(0).to_pylist()
            part = [bisect.bisect_right(bounds, k) - 1 for k in first]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *b.columns], names=["part", *b.schema.names])

    schema = "part int, first_key string, last_key string, archive string, index string, at long, bytes long"
    blocks = directory.select("first_key", "last_key", "archive", "index", "at", "bytes").mapInArrow(place, schema)
    asked = written(urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(numbered, "part int, key string, asked string"), "asked")
    # a row for each range that is asked in
    shares = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / questions).cast("int").alias("shares"))
    asked = asked.join(F.broadcast(shares), "part").withColumn("share", F.pmod(F.xxhash64("asked"), F.col("shares")).cast("int")).drop("shares")
    blocks = blocks.join(F.broadcast(shares), "part").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        known = sorted(right.select(["first_key", "last_key", "archive", "index", "at", "bytes"]).to_pylist(), key=lambda r: r["first_key"])
        firsts = [r["first_key"] for r in known]
        archives, out, held = Archives(), [], {}
        for q in sorted(left.to_pylist(), key=lambda r: r["key"]):
            k = q["key"]
            for i in range(max(0, bisect.bisect_left(firsts, k) - 1), bisect.bisect_right(firsts, k)):
                if known[i]["last_key"] < k:
                    continue
                if i not in held:  # one block at a time
                    held = {i: read_block(known[i]["index"], known[i]["at"], known[i]["bytes"])}
                lines = held[i]
                lo = bisect.bisect_left(lines, k, key=lambda x: x[0])
                hi = bisect.bisect_right(lines, k, key=lambda x: x[0])
                out += [(q["asked"], r) for r in archives.records(known[i]["archive"], lines[lo:hi])]
        batch = _batch([r for _, r in out], _ARROW[kind])
        return pa.Table.from_arrays([pa.array([a for a, _ in out], pa.string()), *batch.columns], names=["asked", *batch.schema.names])

    return asked.groupBy("part", "share").cogroup(blocks.groupBy("part", "share")).applyInArrow(search, "asked string, " + _schema(kind))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    directory = write_archive(pages, new_path(spark, "warc"))
    return read_archive(directory, kind, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op9_warc": op9_warc}
#: DuckDB has no SHA-1 in base32; tests/llm reads every record back and compares.
ORACLE_SQL: dict[str, str] = {}
