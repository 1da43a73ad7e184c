"""Writers: CSV, JSON, Parquet and ORC by Spark; Arrow IPC, Excel, Markdown and HTML for frames that fit the driver."""

from __future__ import annotations

import html
import io
import json
import zipfile
from collections.abc import Sequence
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from ashlar.operators.frame import Frame

_FORMULA = r"^[=+\-@\t\r]"


def _flat(df: DataFrame, columns, escape_formulas: bool, decimal: str) -> DataFrame:
    out = []
    for f in df.select(*columns).schema if columns else df.schema:
        c = F.col(f"`{f.name}`")
        if escape_formulas and isinstance(f.dataType, StringType):
            c = F.when(c.rlike(_FORMULA), F.concat(F.lit("'"), c)).otherwise(c)
        if decimal != "." and f.dataType.typeName() in ("double", "float", "decimal"):
            c = F.replace(c.cast("string"), F.lit("."), F.lit(decimal))
        if isinstance(f.dataType, (TimestampType, TimestampNTZType, DateType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(frame: Frame, path: str, separator: str = ",", quote: str = '"', header: bool = True, na_rep: str = "", decimal: str = ".", line_terminator: str = "\n", columns: Sequence[str] | None = None, escape_formulas: bool = False, encoding: str = "UTF-8", mode: str = "errorifexists", compression: str = "none") -> None:
    df = _flat(frame.df, columns, escape_formulas, decimal)
    df.write.mode(mode).options(sep=separator, quote=quote, escape=quote, header=str(header).lower(), nullValue=na_rep, emptyValue='""' if na_rep == "" else "", lineSep=line_terminator, encoding=encoding, compression=compression).csv(path)


def to_csv(frame: Frame, separator: str = ",", header: bool = True, na_rep: str = "", escape_formulas: bool = False, limit: int = 100_000) -> str:
    """Text of a frame that fits the driver; more than ``limit`` rows are refused."""
    df = _flat(frame.df, None, escape_formulas, ".")
    rows = _bounded(df, limit)

    def cell(v) -> str:
        if v is None:
            return na_rep
        v = "true" if v is True else "false" if v is False else str(v)
        return '"' + v.replace('"', '""') + '"' if v == "" or any(x in v for x in (separator, '"', "\n", "\r")) else v

    lines = [separator.join(cell(c) for c in df.columns)] if header else []
    return "\n".join([*lines, *[separator.join(cell(v) for v in r) for r in rows]]) + "\n"


def _bounded(df: DataFrame, limit: int) -> list:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write them with Spark instead")
    return rows


def write_json(frame: Frame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """One object a line."""
    frame.df.write.mode(mode).option("compression", compression).option("ignoreNullFields", "false").json(path)


def to_json(frame: Frame, orient: str = "records", indent: int | None = None, limit: int = 100_000) -> str:
    df = frame.df
    rows = [[v.isoformat() if hasattr(v, "isoformat") else v for v in r] for r in _bounded(df, limit)]
    if orient == "records":
        return json.dumps([dict(zip(df.columns, r, strict=True)) for r in rows], indent=indent, ensure_ascii=False)
    if orient == "lines":
        return "\n".join(json.dumps(dict(zip(df.columns, r, strict=True)), ensure_ascii=False) for r in rows)
    if orient == "columns":
        return json.dumps({c: [r[i] for r in rows] for i, c in enumerate(df.columns)}, indent=indent, ensure_ascii=False)
    if orient == "values":
        return json.dumps(rows, indent=indent, ensure_ascii=False)
    raise ValueError(f"orient: {orient}")


def write_parquet(frame: Frame, path: str, columns: Sequence[str] | None = None, codec: str = "snappy", row_group_bytes: int | None = None, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    w = (frame.df.select(*columns) if columns else frame.df).write.mode(mode).option("compression", codec.lower())
    if row_group_bytes:
        w = w.option("parquet.block.size", row_group_bytes)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def to_arrow_ipc(frame: Frame, format: str = "stream", batch_rows: int | None = None) -> bytes:  # noqa: A002
    t = frame.df.toArrow()
    sink = io.BytesIO()
    make = pa.ipc.new_stream if format == "stream" else pa.ipc.new_file
    with make(sink, t.schema) as w:
        w.write_table(t, batch_rows)
    return sink.getvalue()


def write_arrow_ipc(frame: Frame, path: str, format: str = "file") -> None:  # noqa: A002
    with open(path, "wb") as f:
        f.write(to_arrow_ipc(frame, format))


def write_excel(frame: Frame, path: str, sheet: str = "Sheet1", columns: Sequence[str] | None = None, header: bool = True) -> None:
    df = frame.df.select(*columns) if columns else frame.df
    rows = [list(r) for r in _bounded(df, (1 << 20) - 1)]
    if header:
        rows.insert(0, df.columns)

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006"
    data = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{data}</sheetData></worksheet>")


def _shown(frame: Frame, n: int):
    rows = frame.df.limit(n).collect()
    return frame.df.columns, [["" if v is None else str(v) for v in r] for r in rows]


def to_markdown(frame: Frame, n: int = 50) -> str:
    cols, rows = _shown(frame, n)
    line = lambda r: "| " + " | ".join(x.replace("|", "\\|").replace("\n", " ") for x in r) + " |"
    return "\n".join([line(cols), "| " + " | ".join("---:" if isinstance(f.dataType, NumericType) else "---" for f in frame.df.schema) + " |", *map(line, rows)])


def to_html(frame: Frame, n: int = 100) -> str:
    cols, rows = _shown(frame, n)
    tr = lambda r, t: "<tr>" + "".join(f"<{t}>{html.escape(x)}</{t}>" for x in r) + "</tr>"
    return "<table><thead>" + tr(cols, "th") + "</thead><tbody>" + "".join(tr(r, "td") for r in rows) + "</tbody></table>"
