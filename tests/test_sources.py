import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricequarry.sources import documents, grids, sinks
from pricequarry.streaming import uploads

SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c></row>
<row r="3"><c r="A3" t="inlineStr"><is><t>Product Name</t></is></c><c r="B3" t="inlineStr"><is><t>Unit</t></is></c><c r="C3" t="inlineStr"><is><t>Price</t></is></c></row>
<row r="4"><c r="A4" t="inlineStr"><is><t>Tomato</t></is></c><c r="C4"><v>25000</v></c></row>
<row r="5"><c r="A5" t="inlineStr"><is><t>Basil</t></is></c><c r="B5" t="inlineStr"><is><t>kg</t></is></c><c r="C5" t="inlineStr"><is><t>Rp 12.500</t></is></c></row>
</sheetData></worksheet>"""


@pytest.fixture
def book(tmp_path):
    with zipfile.ZipFile(tmp_path / "prices.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="May"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Cover</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
    return str(tmp_path)


def test_workbook_to_products(spark, book):
    grid = grids.price_like(grids.read_workbooks(spark, f"{book}/*.xlsx"))
    got = {(r["name"], r["price"], r["unit"]) for r in grids.products(grid).collect()}
    assert got == {("Tomato", 25000.0, "pcs"), ("Basil", 12500.0, "kg")}
    files = documents.scan(spark, f"{book}/*.xlsx").first()
    assert files["kind"] == "excel" and len(files["file_hash"]) == 64


def test_sheets_go_by_their_relationships(tmp_path):
    """Titles in another order than the files' numbers, and a chart between them."""
    r, m = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="Prices" r:id="a"/><sheet name="Chart" r:id="c"/><sheet name="Info" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="b" Target="worksheets/sheet1.xml"/><Relationship Id="a" Target="/xl/worksheets/sheet2.xml"/><Relationship Id="c" Target="chartsheets/sheet1.xml"/></Relationships>')
        for i, text in ((1, "about"), (2, "Tomato")):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{m}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>{text}</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/chartsheets/sheet1.xml", "<x/>")
    assert list(grids.sheets_of((tmp_path / "b.xlsx").read_bytes())) == [("Prices", 0, ["Tomato"]), ("Info", 0, ["about"])]


def test_csv_lines_keep_their_order_over_splits(spark, tmp_path):
    (tmp_path / "long.csv").write_text("\r\n".join(f"name {i};{1000 + i}" + ("\r\n" if i % 50 == 0 else "") for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    try:
        got = grids.read_csv(spark, f"{tmp_path}/long.csv")
        assert got.rdd.getNumPartitions() >= 1
        rows = got.orderBy("row_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["row_idx"] for r in rows] == list(range(3000))
    assert [r["cells"] for r in rows] == [[f"name {i}", str(1000 + i)] for i in range(3000)]


def test_csv_without_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n\n"Tomato, red";25000\nBasil;12000\nThyme;9000\nSage;8000\nMint;7000\n')
    grid = grids.read_csv(spark, f"{tmp_path}/a.csv")
    assert [r["cells"] for r in grid.orderBy("row_idx").collect()][1] == ["Tomato, red", "25000"]
    got = {(r["name"], r["price"]) for r in grids.products(grid).collect()}
    assert ("Tomato, red", 25000.0) in got and len(got) == 5


def test_rows_of_other_layouts(spark):
    rows = spark.createDataFrame([(0, "VEGETABLES", None), (1, "Tomato", 5.0), (2, "FRUIT", None), (3, "Apple", 6.0)], "i int, name string, price double").withColumn("d", F.lit(1))
    assert [(r["name"], r["category"]) for r in grids.with_headings(rows, ["d"], "i", "name", "price").orderBy("i").collect()] == [("Tomato", "VEGETABLES"), ("Apple", "FRUIT")]
    wide = spark.createDataFrame([("Tomato", 5.0, None), ("Apple", 6.0, 7.0)], "name string, retail double, wholesale double")
    assert {(r["name"], r["price"]) for r in grids.unpivot_prices(wide, "name", ["retail", "wholesale"]).collect()} == {("Tomato (retail)", 5.0), ("Apple (retail)", 6.0), ("Apple (wholesale)", 7.0)}
    lines = spark.createDataFrame([("Tomato cherry ... 25.000",), ("no price",)], "value string")
    assert [tuple(r) for r in grids.text_products(lines).collect()] == [("Tomato cherry", 25000.0)]
    mixed = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Tomato", "fresh", "IDR 25.000", "Basil", "x", "y", "z", "IDR 9.000"])], "d int, i int, t string")
    assert {(r["name"], r["price"]) for r in grids.paired(mixed, ["d"], "i", "t").collect()} == {("Tomato", 25000.0), ("fresh", 25000.0)}
    kinds = spark.createDataFrame([("a", "retail", 1.0), ("A", "recommended_retail", 2.0), ("b", "", 3.0)], "n string, price_type string, p double")
    assert {r["p"] for r in grids.preferred(kinds, F.col("n")).collect()} == {2.0, 3.0}


def test_documents(spark):
    def extractor(path, content):
        if b"bad" in content:
            raise ValueError("no")
        return pd.DataFrame([{"name": content.decode(), "price": 1.0}])

    files = spark.createDataFrame([("x", b"Tomato"), ("y", b"bad")], "path string, content binary")
    got = {r["source"]: (r["name"], r["description"]) for r in documents.extract(files, extractor).collect()}
    assert got["x"][0] == "Tomato" and got["y"][1].startswith("failed")
    parts = spark.createDataFrame([(1, 1, None, [("Tomato", 5.0)]), (1, 2, "Boga", [("tomato ", 5.0), ("Basil", 6.0)]), (2, 1, None, [])], "d int, page int, supplier string, products array<struct<name:string,price:double>>")
    got = {r["d"]: (r["supplier"], [p["name"] for p in r["products"] or []]) for r in documents.joined_parts(parts, "d", "page").collect()}
    assert got == {1: ("Boga", ["Tomato", "Basil"]), 2: (None, [])}
    j = spark.createDataFrame([('```json\n{"products": [{"product": "Tomato", "price": 5}]}\n```',)], "j string")
    assert j.select(documents.parsed(F.col("j")).alias("x")).first()["x"]["products"][0]["product"] == "Tomato"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2])], "id int, xs array<int>")
    path = sinks.snapshot(df, str(tmp_path / "t"), "1")
    sinks.append_new(spark.createDataFrame([(1, []), (2, []), (2, [])], df.schema), path, ["id"])
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2]
    sinks.export(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["xs"] == "[1,2]"
    sinks.export(df, str(tmp_path / "j"), "json")
    sinks.log(df, str(tmp_path / "l"))
    with pytest.raises(ValueError, match="export"):
        sinks.export(df, "x", "pdf")


def test_feeds_match_their_batch_form(spark, tmp_path):
    rows = [(i, f"2025-01-01 0{i // 10}:{(i * 7) % 60:02d}:00", "ab"[i % 2], float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, at string, k string, v double").withColumn("at", F.col("at").cast("timestamp_ntz"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    seen = []

    def each(batch, n):
        seen.append((n, batch.count()))

    q = uploads.process(uploads.incoming(spark, str(tmp_path / "in"), "id long, at timestamp_ntz, k string, v double"), each, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sum(n for _, n in seen) == 40 and len(seen) == 4
    stream = uploads.incoming(spark, str(tmp_path / "in"), "id long, at timestamp_ntz, k string, v double", files_at_once=10)
    out = uploads.tumbling(stream, "at", "1 hour", "1 day", "k", "v").writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert {tuple(r) for r in spark.table("hourly").collect()} == {tuple(r) for r in uploads.tumbling(df, "at", "1 hour", "1 day", "k", "v").collect()}
    assert uploads.progress(out)["active"] is False
    assert uploads.sessions(df, "at", "2 minutes", "1 day", "k").agg(F.sum("n")).first()[0] == 40
    assert uploads.sliding(df, "at", "1 hour", "30 minutes", "1 day", "k", "v").count() > 0


def test_workbooks_come_back(spark, tmp_path, monkeypatch):
    rows = [(i, f"a & <b> {i}", i / 2, None if i % 3 else "x", [i]) for i in range(25)]
    df = spark.createDataFrame(rows, "id long, name string, price double, note string, list array<long>").repartition(2, "id")
    sinks.export(df, str(tmp_path / "w"), "xlsx")
    files = sorted(p.name for p in (tmp_path / "w").iterdir() if p.suffix != ".crc")
    assert files == ["part-00000.xlsx", "part-00001.xlsx"]
    got = [r["cells"] for r in grids.read_workbooks(spark, f"{tmp_path}/w/*.xlsx").collect()]
    assert got.count(["id", "name", "price", "note", "list"]) == 2
    back = {(int(c[0]), c[1], float(c[2]), c[3], c[4]) for c in got if c[0] != "id"}
    assert back == {(i, n, p, t, f"[{x[0]}]") for i, n, p, t, x in rows}


def test_workbook_in_several_sheets(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sinks, "SHEET_ROWS", 4)
    path = tmp_path / "b.xlsx"
    with open(path, "wb") as out:
        assert sinks._write_workbook(out, ["a"], iter([pa.RecordBatch.from_pydict({"a": list(range(10))})]), "T") == 10
    rows = list(grids.sheets_of(path.read_bytes()))
    assert [t for t, _, _ in rows].count("T 3") == 3 and [c[0] for _, _, c in rows if c[0] != "a"] == [str(i) for i in range(10)]
