"""Keyed changes of tables without transactions: every operator returns the table as it is afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import against


def deleted(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti").select(*df.columns)


def updated(df: DataFrame, patch: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The table with the patch's values that are not null, and the patch's rows whose key it lacks."""
    given = [c for c in patch.columns if c != key]
    new = patch.select(key, *[F.col(c).alias(f"new_{c}") for c in given])
    out = df.join(new, key, "left").select(*[F.coalesce(F.col(f"new_{c}").cast(df.schema[c].dataType), F.col(c)).alias(c) if c in given else F.col(c) for c in df.columns])
    return out, patch.join(df.select(key), key, "left_anti")


def upserted(df: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows in place of those with the same key, or beside them."""
    return df.join(rows.select(*key).distinct(), list(key), "left_anti").select(*df.columns).unionByName(rows, allowMissingColumns=True).select(*df.columns)


def inserted_new(df: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not there yet, one for each key."""
    new = rows.dropDuplicates(list(key)).join(df.select(*key), list(key), "left_anti")
    return df.unionByName(new.select(*rows.columns), allowMissingColumns=True).select(*df.columns)


def count_unmatched(queue: DataFrame, names: DataFrame) -> DataFrame:
    """The queue of unmatched names after more of them: pending ones of the same name (case and outer spaces aside) count up, others are added."""
    norm = F.lower(F.trim("raw_name"))
    more = names.groupBy(norm.alias("k")).agg(F.min("raw_name").alias("raw"), F.count(F.lit(1)).cast("int").alias("more"))
    pending = queue.where("status = 'pending'").withColumn("k", norm).join(more, "k", "full_outer")
    counted = pending.select(
        F.coalesce("raw_name", "raw").alias("raw_name"),
        F.coalesce("normalized_name", "k").alias("normalized_name"),
        "context",
        "supplier_id",
        (F.coalesce("frequency", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("frequency"),
        F.lit("pending").alias("status"),
        "assigned_product_id",
    )
    return queue.where("NOT (status <=> 'pending')").unionByName(counted)


def assign(queue: DataFrame, aliases: DataFrame, name: Column, product_id: Column) -> tuple[DataFrame, DataFrame]:
    """The queue with a name assigned to a product, and the aliases with that name if no alias is it."""
    hit = F.lower(F.trim("raw_name")) == F.lower(F.trim(name))
    out = queue.withColumns({"status": F.when(hit, "assigned").otherwise(F.col("status")), "assigned_product_id": F.when(hit, product_id).otherwise(F.col("assigned_product_id"))})
    new = out.where(hit).limit(1).select(F.sha2(F.lower(F.trim("raw_name")), 256).alias("id"), F.col("assigned_product_id").alias("product_id"), F.lower(F.trim("raw_name")).alias("alias"), F.lit("en").alias("language"))
    return out, inserted_new(aliases, new, ["alias"])


def reviewed(uploads: DataFrame, keys: DataFrame, verdict: str) -> tuple[DataFrame, DataFrame]:
    """Uploads pending review approved or rejected, and the keys that were not pending. ``verdict``: approved or rejected."""
    marked = uploads.join(keys.select("id").distinct().withColumn("asked", F.lit(True)), "id", "left")
    hit = F.coalesce("asked", F.lit(False)) & (F.col("approval_status") == "pending_review")
    out = marked.withColumns({"approval_status": F.when(hit, verdict).otherwise(F.col("approval_status")), "status": F.when(hit, "completed" if verdict == "approved" else "rejected").otherwise(F.col("status"))}).select(*uploads.columns)
    return out, keys.join(uploads.where("approval_status = 'pending_review'").select("id"), "id", "left_anti")


def without_supplier(supplier_id: str, suppliers: DataFrame, prices: DataFrame, uploads: DataFrame, history: DataFrame) -> dict[str, DataFrame]:
    """All tables without a supplier and what belongs to it."""
    gone = F.lit(supplier_id)
    return {"suppliers": suppliers.where(F.col("id") != gone), **{n: t.where(~F.coalesce(F.col("supplier_id") == gone, F.lit(False))) for n, t in (("prices", prices), ("uploads", uploads), ("history", history))}}


def found_or_made(names: DataFrame, suppliers: DataFrame, contact: Sequence[str] = ("email", "phone", "address")) -> DataFrame:
    """Suppliers after an upload: a known one (the least id of those whose name contains the new one, case aside) gets the contact fields it lacks, others are added. Names that are null or empty are passed over."""
    given = names.where(F.coalesce(F.trim("name"), F.lit("")) != "").groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min(F.trim("name")).alias("new_name"), *[F.max(c).alias(f"new_{c}") for c in contact])
    pairs = against(suppliers.select("id", F.lower("name").alias("known")), given.select("k"), "k").where(F.contains("known", F.col("k")))
    met = pairs.groupBy("k").agg(F.min("id").alias("met"))
    held = given.join(met, "k", "left")
    news = held.where("met IS NOT NULL").groupBy("met").agg(*[F.max(f"new_{c}").alias(f"new_{c}") for c in contact])
    known = suppliers.join(news, suppliers.id == news.met, "left").select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"new_{c}"), F.col(c)).alias(c) if c in contact else suppliers[c] for c in suppliers.columns])
    made = {"id": F.sha2("k", 256), "name": F.col("new_name"), **{c: F.col(f"new_{c}") for c in contact}}
    added = held.where("met IS NULL").select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in suppliers.schema])
    return known.unionByName(added)
