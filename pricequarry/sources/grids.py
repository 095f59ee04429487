"""Price lists as grids of cells: reading them, finding their headers and columns, taking products out.

A grid is (source, sheet, row_idx, cells array<string>).
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prices import normalize_price, sheet_price, trailing_price

GRID = "source string, sheet string, row_idx int, cells array<string>"
#: Words of column headings, by role. Fixed values.
HEADINGS = {"name": r"(?i)name|product|item|nama|produk|barang|description|keterangan", "price": r"(?i)price|harga|cost|rate|amount|idr|rp", "unit": r"(?i)unit|uom|satuan|size|pack|kemasan", "category": r"(?i)category|kategori|group|jenis|type"}
#: Sheets that hold no prices, by name.
OTHER_SHEETS = r"(?i)contact|info|instruction|macro"
HEADER_ROWS, SAMPLE_ROWS, SAMPLE_COLUMNS = 15, 10, 10


def _column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _parts(z: zipfile.ZipFile, space: str) -> Iterator[tuple[str, str]]:
    """(title, file) of a workbook's sheets in their order: the workbook names a relationship for each, and that the file. Without relationships the files stand in the order of their numbers."""
    names = set(z.namelist())
    listed = list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{space}sheet"))
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target", "")
            targets[r.get("Id")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
    numbered = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    for i, sheet in enumerate(listed):
        part = targets.get(sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"))
        if part is None and not targets:
            part = numbered[i] if i < len(numbered) else None
        if part in names and part.startswith("xl/worksheets/"):  # charts are sheets without rows
            yield sheet.get("name"), part


def sheets_of(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of a workbook's bytes; formulas by their stored values."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")]
        for title, part in _parts(z, space):
            for row in ElementTree.fromstring(z.read(part)).iter(f"{space}row"):
                cells: list[str | None] = []
                for c in row.iter(f"{space}c"):
                    at = _column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value, kind = c.find(f"{space}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{space}t"))
                    elif value is not None:
                        cells[at] = shared[int(value.text)] if kind == "s" else value.text
                yield title, int(row.get("r") or 1) - 1, cells


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """All sheets of all workbooks under a path; files are read by the tasks, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(sheets_of(data))
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["source", "sheet", "row_idx", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, GRID)


def split_line(line: Column) -> Column:
    """Cells of a CSV line: commas and semicolons outside quotes separate; quotes go."""
    return F.transform(F.split(line, r'[,;](?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files, blank ones left out, numbered in their file from 0.

    Tasks read splits of files, and lines are numbered in two passes: each within its split, and the splits by how many
    lines those before them in the file hold. So no task orders more than a split's lines, however long the file is.
    """
    at = F.struct(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block")).alias("s")
    lines = spark.read.text(path).select(at, F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r$", "").alias("line")).where(F.trim("line") != "").select("s.source", "s.block", "at", "line")
    counts = lines.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"))
    # a row for each split
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("source", "block", before.alias("start"))
    local = F.row_number().over(Window.partitionBy("source", "block").orderBy("at")) - 1
    row = (F.col("start") + F.col("local")).cast("int")
    return lines.withColumn("local", local).join(starts, ["source", "block"]).select("source", F.lit("csv").alias("sheet"), row.alias("row_idx"), split_line(F.col("line")).alias("cells"))


def price_like(grid: DataFrame) -> DataFrame:
    """Rows of the sheets that look like price lists: not by name something else, three rows or more, a price from 100 to a million within the first 20 rows."""
    priced = F.exists("cells", lambda c: F.coalesce(sheet_price(c).between(100, 1_000_000), F.lit(False)))
    good = grid.groupBy("source", "sheet").agg(F.count(F.lit(1)).alias("n"), F.bool_or((F.col("row_idx") < 20) & priced).alias("p")).where(F.col("p") & (F.col("n") >= 3) & ~F.col("sheet").rlike(OTHER_SHEETS))
    return grid.join(good.select("source", "sheet"), ["source", "sheet"], "left_semi")


def _hits(cell: Column) -> Column:
    return sum((F.when(cell.rlike(p), 1).otherwise(0) for p in HEADINGS.values()), F.lit(0))


def headers(grid: DataFrame) -> DataFrame:
    """(source, sheet, header_row, roles): the first of 15 rows whose cells hold heading words (0.2 each, over 0.3 in all), and the last column of each role in it."""
    cells = F.transform("cells", lambda c: F.coalesce(c, F.lit("")))
    score = F.aggregate(cells, F.lit(0), lambda s, c: s + _hits(c)) * 0.2
    first = grid.where(F.col("row_idx") < HEADER_ROWS).withColumn("score", F.least(F.lit(1.0), score)).where("score > 0.3").groupBy("source", "sheet").agg(F.min(F.struct("row_idx", "cells")).alias("h"))

    def last(pattern: str) -> Column:
        return F.array_max(F.transform(F.col("h.cells"), lambda c, i: F.when(F.coalesce(c, F.lit("")).rlike(pattern), i)))

    return first.select("source", "sheet", F.col("h.row_idx").alias("header_row"), *[last(p).alias(f"{r}_at") for r, p in HEADINGS.items()])


def columns_by_content(grid: DataFrame) -> DataFrame:
    """(source, sheet, name_at, price_at): the leftmost columns whose cells in rows 1 to 9 are names (0.15 each) or numbers (0.2 each), over 0.5 in all."""
    cells = grid.where(F.col("row_idx").between(1, SAMPLE_ROWS - 1)).select("source", "sheet", F.posexplode("cells").alias("at", "cell")).where(F.col("at") < SAMPLE_COLUMNS)
    named = (F.length("cell") > 3) & F.col("cell").rlike(r"\p{L}")
    scored = cells.groupBy("source", "sheet", "at").agg(F.sum(F.when(sheet_price(F.col("cell")).isNotNull(), 0.2).otherwise(0.0)).alias("price"), F.sum(F.when(named, 0.15).otherwise(0.0)).alias("name"))
    return scored.groupBy("source", "sheet").agg(F.min(F.when(F.col("name") > 0.5, F.col("at"))).alias("name_at"), F.min(F.when(F.col("price") > 0.5, F.col("at"))).alias("price_at"))


def roles(grid: DataFrame) -> DataFrame:
    """Each sheet's header row (-1 without one) and columns: by headings, else by content."""
    h, c = headers(grid), columns_by_content(grid).withColumnsRenamed({"name_at": "c_name", "price_at": "c_price"})
    both = c.join(h, ["source", "sheet"], "full_outer")
    return both.select("source", "sheet", F.coalesce("header_row", F.lit(-1)).alias("header_row"), F.coalesce("name_at", "c_name").alias("name_at"), F.coalesce("price_at", "c_price").alias("price_at"), "unit_at", "category_at")


def products(grid: DataFrame, unit: str = "pcs") -> DataFrame:
    """Products of the rows under the headers: a name of two letters or more and a price; the unit ``pcs`` where none is given."""

    def cell(at: str) -> Column:
        return F.trim(F.try_element_at("cells", F.col(at) + 1))

    rows = grid.join(roles(grid), ["source", "sheet"]).where(F.col("row_idx") > F.col("header_row"))
    out = rows.select(cell("name_at").alias("name"), sheet_price(cell("price_at")).alias("price"), F.coalesce(F.nullif(cell("unit_at"), F.lit("")), F.lit(unit)).alias("unit"), cell("category_at").alias("category"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("description"), F.col("sheet").alias("source_sheet"), F.col("row_idx").alias("source_row"), "source")
    return out.where((F.length("name") >= 2) & (F.col("price") > 0))


def with_headings(rows: DataFrame, by: Sequence[str], order: str, name: str, price: str, category: str = "category") -> DataFrame:
    """Rows with the category that the last row with a name and no price heads; heading rows go."""
    heading = F.when(F.col(price).isNull() & (F.coalesce(F.trim(name), F.lit("")) != ""), F.col(name))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(category, F.last(heading, ignorenulls=True).over(w)).where(F.col(price).isNotNull())


def unpivot_prices(rows: DataFrame, name: str, prices: Sequence[str]) -> DataFrame:
    """A product for each price column, its name with the column's: ``Tomato (retail)``."""
    rest = [c for c in rows.columns if c not in prices]
    out = rows.unpivot(rest, list(prices), "price_type", "price").where("price > 0")
    return out.withColumn(name, F.concat(F.col(name), F.lit(" ("), F.col("price_type"), F.lit(")")))


def text_products(lines: DataFrame, column: str = "value") -> DataFrame:
    """Products of text lines that end in a price."""
    name = F.trim(F.regexp_replace(column, r"[\s.\-:]*(?:Rp\.?\s*)?\d+(?:\.\d{3})*[Kk]?\s*$", ""))
    return lines.select(name.alias("name"), trailing_price(F.col(column)).alias("price")).where("length(name) >= 2 AND price > 0")


def paired(items: DataFrame, by: Sequence[str], order: str, text: str) -> DataFrame:
    """Names with the first price among the next three items of mixed content."""
    w = Window.partitionBy(*by).orderBy(order)

    def as_price(c: Column) -> Column:
        return F.when(c.rlike(r"(?i)^\s*(?:idr|rp)?\.?\s*[\d.,]+\s*k?\s*$"), normalize_price(c))

    following = F.coalesce(*[as_price(F.lead(text, k).over(w)) for k in (1, 2, 3)])
    return items.withColumn("price", following).where(as_price(F.col(text)).isNull() & ~F.upper(text).contains("IDR") & F.col("price").isNotNull() & F.col(text).rlike(r"\p{L}{2}")).select(*by, F.col(text).alias("name"), "price")


def preferred(rows: DataFrame, key: Column, kind: str = "price_type") -> DataFrame:
    """One row for each key: recommended retail before standard before retail before others."""
    rank = F.when(F.col(kind) == "recommended_retail", 3).when(F.col(kind) == "standard", 2).when(F.col(kind) == "retail", 1).otherwise(0)
    w = Window.partitionBy(F.lower(key)).orderBy(rank.desc(), *rows.columns)
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def best_extraction(results: DataFrame, document: str, products_column: str, rows_column: str) -> DataFrame:
    """The extraction of each document with the most products and rows (2 and 0.1 points each)."""
    score = 2 * F.col(products_column) + 0.1 * F.col(rows_column)
    return results.groupBy(document).agg(F.max_by(F.struct(*[c for c in results.columns if c != document]), score).alias("b")).select(document, "b.*")


def chunked(rows: DataFrame, by: Sequence[str], order: str, size: int = 50, tokens_each: int = 120) -> DataFrame:
    """Rows with the number of their batch for model calls, and the tokens that it takes about."""
    w = Window.partitionBy(*by).orderBy(order)
    out = rows.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    return out.withColumn("chunk_tokens", F.count(F.lit(1)).over(Window.partitionBy(*by, "chunk")) * tokens_each)
