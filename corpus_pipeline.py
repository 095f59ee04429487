"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``; all but the last return the columns
of ``documents``, whatever others they have. All stages take every row: a null text is an empty
one, texts of any length are read whole, rows with a null id and rows that repeat are rows
like any other, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricequarry.llm._common import dropped, free_name, read, small_batches, written
from pricequarry.llm.exact_dedup import exact_dedup
from pricequarry.llm.language_id import identify, learn
from pricequarry.llm.minhash import near_dedup
from pricequarry.llm.packing import pack_documents
from pricequarry.llm.simhash import simhash_groups


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: null, empty and letterless texts, or letters as no learned language has them. The label column is used to learn only; without any label all rows go, as no language is known. Repeated rows share their fate."""
    found = identify(docs, learn(docs))
    return found.where(f"NOT `{free_name(docs.columns, 'rejected')}`").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of texts that are equal but for blanks: the longest, then the smallest id (a null one last). Null and empty texts are one group; of repeated rows one stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each set joined by five-word Jaccard similarities of 0.8 or more. SimHash links and MinHash bands propose the pairs; only verified ones count. Rows with a null id stay, and texts without a word are near no other."""
    with small_batches(spark):
        return near_dedup(docs, also=simhash_groups(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: a row for each piece, not the columns of ``documents``. A null or empty text is its end id alone."""
    with small_batches(spark):
        return pack_documents(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("best-fit packing", packed)]

#: Language models, XXH64 and byte-pair encoding have no SQL; tests/llm runs the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with small_batches(spark):
            before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(before)  # each stage's table is whole before the one it came from goes
    return STAGES[-1][1](spark, docs, sf_dir)
