"""Every query against its SQL on the smallest fixture."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from pricequarry.plans import domain, registry
from pricequarry.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no fixtures here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(frame):
    def plain(x):
        return "null" if pd.isna(x) else f"{x:.10g}" if isinstance(x, float) else str(x)

    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, tables, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = tables.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_compared_prices_find_and_miss(spark):
    got = domain.compared_prices(spark, SF).collect()
    assert len(got) == registry.table(spark, SF, "part").where("p_partkey % 20 = 0").count()
    assert any(r["status"] == "not_found" for r in got) and any(r["deals"] for r in got)
    assert all(r["matched_id"] is None for r in got if r["product_name"] == "qqq")


def test_a_summary_and_unmatched_names_read_what_they_need(spark):
    def read(df):
        return {os.path.basename(f).removesuffix(".parquet") for f in df.inputFiles()}

    assert read(domain.comparison_summary(spark, SF)) == {"part", "lineitem"}
    assert read(domain.unmatched_names(spark, SF)) == {"part"}


def test_lines_of_related_prices_are_shuffled_once_and_unsorted(spark):
    plan = domain.related_prices(spark, SF)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning(l_partkey") :].split("FileScan")[0]
    assert plan.count("Exchange") == 5 and "Sort" not in below and "Aggregate" not in below


def test_a_store_leaves_no_price_without_a_supplier(spark):
    for q in (domain.stored_prices, domain.product_price_update, domain.unit_price_update):
        assert q(spark, SF).where("supplier_id IS NULL OR product_id IS NULL").count() == 0


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_similar_names(spark):
    got = {(r["q"], r["p_name"]): r["score"] for r in plans.similar_products(spark, SF).collect()}
    assert got and all(0 < s <= 100 for s in got.values())
    assert all(s == 100 for (q, p), s in got.items() if q == p.lower())


def test_nested_prices_hold_every_line(spark):
    got = plans.nested_prices_all(spark, SF).collect()
    assert sum(len(r["prices"].split(",")) for r in got if r["prices"]) == registry.table(spark, SF, "lineitem").count()
    assert len({(r["s_suppkey"], r["part"]) for r in got}) == len(got)


def test_every_line_has_a_price_status(spark):
    assert plans.price_status_all(spark, SF).count() == registry.table(spark, SF, "lineitem").count()


def test_embedding_names_are_cut_after_they_are_cleaned(spark, tmp_path):
    text = "  " + "!? \n" * 60 + "Red  Ring " * 40
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert plans.embedding_names(spark, str(tmp_path)).first()["name"] == (" red ring" * 40)[:200]
