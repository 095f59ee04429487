"""Filter interaction audit: what each filter does in every order in which the filters can run.

Direct relational replay. A document's failures are five flags in one small number; every
document is crossed with the 120 orders of the five filters, which are broadcast (a table
of fixed size), its first failure in that order is worked out once, the order's five steps
are exploded, and conditional sums are combined in the tasks before anything shuffles.
All of it is Spark SQL.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import dropped, join_skewed, read, text_of, written

FILTERS = "ABCDE"
_BLANKS = r"[\x20\x09-\x0D]+"
#: What fails a text, beside E, which needs the table: (filter, condition). ``words`` are its words, ``text`` is not null.
_FAILS = {
    "A": "size(words) < 50",
    "B": "100 * size(array_distinct(words)) < 65 * size(words)",
    "C": "100 * (char_length(text) - char_length(regexp_replace(text, '[A-Z]+', ''))) > 5 * char_length(text)",
    "D": "text RLIKE '[#$%&*|]'",
}


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def orders(spark: SparkSession) -> DataFrame:
    """filter_order and its steps (step, filter, bit, the bits of the filters before it): one row for each of the 120 orders."""
    rows = []
    for order in itertools.permutations(FILTERS):
        before, steps = 0, []
        for step, name in enumerate(order, 1):
            steps.append((step, name, bit(name), before))
            before |= bit(name)
        rows.append(("".join(order), steps))
    return spark.createDataFrame(rows, "filter_order string, steps array<struct<step: int, filter: string, bit: int, before: int>>")


def flags(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """(doc_id, part, failed): one row for each row of ``docs``, with a bit for each filter that its whole text fails.

    A null text is an empty one, which fails A (no words) and none of B, C and D. E is
    failed by a text that a row with a smaller id has too, removed or not: rows with a null id
    are neither smaller than others nor have any smaller, and rows that repeat an id
    are not smaller than each other. A null part is the empty string. A text that a
    third of all rows hold is joined by broadcast, and minima are taken before the shuffle.
    """
    text = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), text_of(text_column).alias("text"))
    words = text.withColumn("words", F.array_remove(F.split("text", _BLANKS), ""))
    own = sum((F.expr(condition).cast("int") * bit(name) for name, condition in _FAILS.items()), F.lit(0))
    held = written(words.select("doc_id", "part", own.alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")), "flags")
    # only texts that several rows hold can fail E
    shared = written(held.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-texts")
    again = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int") * bit("E")
    out = join_skewed(held, shared, "digest", "n", held.count()).select("doc_id", "part", (F.col("own") + again).alias("failed"))
    out = written(out, "failures")
    dropped(held, shared)
    return out


def audit(failures: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included: what the step's filter does there.

    ``failures`` is (doc_id, part, failed) as :func:`flags` gives it, ``labels`` has doc_id, quality and
    toxic. kept: documents left after the step; removed: those whose first failure is
    here; redundant: those that fail the filter but went before; unique_fails: those
    that fail no other; good_lost and toxic_lost: the removed that are labelled so;
    shapley: what the filter removes, summed over all orders and at any step. A
    document without a label, or with a null id, is neither good nor toxic; one
    with several labels is whatever any of them says. An empty table gives an empty result.
    """
    spark = failures.sparkSession
    known = labels.groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    docs = failures.join(known.where("good = 1 OR toxic = 1"), "doc_id", "left").select("part", "failed", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    crossed = docs.crossJoin(F.broadcast(orders(spark)))
    first = F.coalesce(*(F.when(F.col("failed").bitwiseAND(F.col("steps")[i]["bit"]) != 0, F.lit(i + 1)) for i in range(len(FILTERS))), F.lit(len(FILTERS) + 1))
    replayed = crossed.select("part", "filter_order", "failed", "good", "toxic", first.alias("first"), F.explode("steps").alias("s"))
    fails = F.col("failed").bitwiseAND(F.col("s.bit")) != 0
    here = F.col("first") == F.col("s.step")
    counts = {
        "kept": F.col("first") > F.col("s.step"),
        "removed": here,
        "redundant": fails & (F.col("first") < F.col("s.step")),
        "unique_fails": F.col("failed") == F.col("s.bit"),
        "good_lost": here & (F.col("good") == 1),
        "toxic_lost": here & (F.col("toxic") == 1),
    }
    found = replayed.groupBy("part", "filter_order", F.col("s.step").alias("step")).agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    # 600 rows a part are left: the sum over the orders in which the same filter ran
    same = Window.partitionBy("part", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    return found.withColumn("shapley", F.sum("removed").over(same))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(flags(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"))


def _sql() -> str:
    sums = ",\n  ".join(
        f"count(*) FILTER (WHERE {c}) AS {n}"
        for n, c in {
            "kept": "first > step",
            "removed": "first = step",
            "redundant": "failed & bit <> 0 AND first < step",
            "unique_fails": "failed = bit",
            "good_lost": "first = step AND good",
            "toxic_lost": "first = step AND toxic",
        }.items()
    )
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
flagged AS (SELECT doc_id, part,
  (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END)
  + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS failed FROM split),
labelled AS (SELECT f.*, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic FROM flagged f
  LEFT JOIN (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id) l ON f.doc_id = l.doc_id),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(name, bit)),
orders AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = {(1 << len(FILTERS)) - 1}),
crossed AS (SELECT part, failed, good, toxic, filter_order, bits,
  CASE WHEN failed & bits[1] <> 0 THEN 1 WHEN failed & bits[2] <> 0 THEN 2 WHEN failed & bits[3] <> 0 THEN 3 WHEN failed & bits[4] <> 0 THEN 4 WHEN failed & bits[5] <> 0 THEN 5 ELSE 6 END AS first
  FROM labelled, orders),
replayed AS (SELECT c.*, s.step, bits[s.step] AS bit FROM crossed c, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
counted AS (SELECT part, filter_order, step,
  {sums}
  FROM replayed GROUP BY part, filter_order, step)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM counted"""


QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLE_SQL = {"op11_filter_audit": _sql()}
