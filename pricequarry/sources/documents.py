"""Documents that come in: their kind, where they go, and a slot for extractors of other formats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def route(path: Column, mime: Column | None = None) -> Column:
    """excel, csv, pdf, image or unknown, by MIME type, else by extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    m = F.lower(F.coalesce(mime, F.lit(""))) if mime is not None else F.lit("")
    return (
        F.when(m.contains("spreadsheet") | m.contains("excel") | ext.isin("xlsx", "xls"), "excel")
        .when(m.contains("csv") | (ext == "csv"), "csv")
        .when(m.contains("pdf") | (ext == "pdf"), "pdf")
        .when(m.startswith("image/") | ext.isin("png", "jpg", "jpeg", "webp"), "image")
        .otherwise("unknown")
    )


def classify(kind: Column, pages: Column, characters: Column, sheets: Column, columns: Column, path: Column) -> Column:
    """A finer kind: scanned PDFs have under 50 characters a page, workbooks one sheet or several, CSV files at most five columns or more, images go by name."""
    name = F.lower(path)
    return (
        F.when((kind == "pdf") & (characters < pages * 50), "pdf_scanned")
        .when(kind == "pdf", "pdf_structured")
        .when((kind == "excel") & (sheets > 1), "excel_multi_sheet")
        .when(kind == "excel", "excel_single_sheet")
        .when((kind == "csv") & (columns > 5), "csv_complex")
        .when(kind == "csv", "csv_simple")
        .when((kind == "image") & name.contains("menu"), "image_menu")
        .when((kind == "image") & name.rlike("catalog|katalog"), "image_catalog")
        .when(kind == "image", "image_other")
        .otherwise("unknown")
    )


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Files with their kind, size and SHA-256; contents stay with the tasks."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("file_hash"), route(F.col("path")).alias("kind"), "modificationTime")


def extract(files: DataFrame, extractor: Callable[[str, bytes], pd.DataFrame]) -> DataFrame:
    """Runs an extractor for formats that need one (PDF, images, models) on (path, content) rows, a file at a time. It returns the columns of ``schemas.EXTRACTED``; a failing file gives no rows."""
    names = [c.strip().split(" ")[0] for c in schemas.EXTRACTED.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    found = extractor(path, content)
                except Exception as error:  # one damaged file doesn't stop the rest; it is named in the result
                    found = pd.DataFrame([{"description": f"failed: {error}"[:200], "confidence": 0.0}])
                yield found.reindex(columns=names).assign(source=path).astype(object)

    return files.select("path", "content").mapInPandas(run, schemas.EXTRACTED + ", source string")


def parsed(json: Column) -> Column:
    """The struct of an extraction's JSON, without the code fences that models put around it."""
    return F.from_json(F.regexp_replace(json, r"^\s*```(?:json)?\s*|\s*```\s*$", ""), schemas.EXTRACTED_JSON)


def joined_parts(parts: DataFrame, by: str, order: str) -> DataFrame:
    """Results of a document's pages or tiles as one: products in order without repeats of (name, price), the first supplier that is given."""
    rows = parts.select(by, order, "supplier", F.posexplode_outer("products").alias("i", "p"))
    supplier = rows.groupBy(by).agg(F.min_by("supplier", F.when(F.col("supplier").isNotNull(), F.col(order))).alias("supplier"))
    key = F.struct(F.lower(F.trim(F.col("p.name"))).alias("n"), F.col("p.price").alias("c"))
    once = rows.where("p IS NOT NULL").groupBy(by, key.alias("k")).agg(F.min(F.struct(order, "i", "p")).alias("f"))
    lists = once.groupBy(by).agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["p"]).alias("products"))
    return supplier.join(lists, by, "left")
