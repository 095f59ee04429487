"""Where results go: snapshots, appends without repeats, exports, logs."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a sheet can hold besides its heading. Fixed value of the format.
SHEET_ROWS = 1_048_575
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def snapshot(df: DataFrame, path: str, version: str) -> str:
    """A whole table under a new version's path, which is returned; readers of the old one are not disturbed."""
    target = f"{path.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def append_new(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """Appends the rows whose key the table lacks, one for each key."""
    here = df.sparkSession.read.parquet(path).select(*key)
    df.dropDuplicates(list(key)).join(here, list(key), "left_anti").write.mode("append").parquet(path)


def export(df: DataFrame, path: str, form: str = "csv") -> None:
    """csv (with a header), json or xlsx, in as many files as there are partitions. Nested columns go into CSV and workbooks as JSON."""
    if form == "json":
        df.write.mode("overwrite").json(path)
    elif form in ("csv", "xlsx"):
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
        if form == "csv":
            flat.write.mode("overwrite").option("header", True).csv(path)
        else:
            _workbooks(flat, path)
    else:
        raise ValueError(f"no export as {form}")


def log(df: DataFrame, path: str) -> None:
    """Appends JSON lines."""
    df.write.mode("append").json(path)


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>"
    text = "".join(c for c in str(value) if c >= " " or c in "\t\n\r")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet_rows(rows: Iterator[tuple]) -> Iterator[bytes]:
    for row in rows:
        yield f"<row>{''.join(map(_cell, row))}</row>".encode()


def _write_workbook(out, names: list[str], batches: Iterator[pa.RecordBatch], title: str) -> int:
    """Streams rows into as many sheets as they need, and returns how many rows there were."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    sheets, count = 0, 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        following = next(rows, None)
        while following is not None or not sheets:
            sheets += 1
            with z.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as part:
                part.write(f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                part.writelines(_sheet_rows(iter([tuple(names)])))
                held = 0
                while following is not None and held < SHEET_ROWS:
                    part.writelines(_sheet_rows(iter([following])))
                    following, held = next(rows, None), held + 1
                part.write(b"</sheetData></worksheet>")
                count += held
        numbers = range(1, sheets + 1)
        titles = "".join(f'<sheet name="{escape(title)} {i}" sheetId="{i}" r:id="rId{i}"/>' for i in numbers)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{titles}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
    return count


def _workbooks(df: DataFrame, path: str, title: str = "Price Comparison") -> None:
    """A workbook for each partition, streamed by its task under a draft's name first. A task that runs again puts the same file in its place."""
    names, root = df.columns, path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, folder = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/part-{task.partitionId():05d}"
        draft = f"{name}-{task.taskAttemptId()}.draft"
        with fs.open_output_stream(draft) as out:
            n = _write_workbook(out, names, batches, title)
        fs.move(draft, f"{name}.xlsx")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["rows"])

    df.mapInArrow(run, "rows long").write.format("noop").mode("overwrite").save()
