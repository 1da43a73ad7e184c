"""Readers: CSV, JSON, Parquet, Arrow IPC, Excel (.xlsx), JDBC, Kafka batches, rows and columns in memory.

Files are read by Spark, distributed; schemas are inferred in a full pass or given. Only Arrow IPC and Excel files, whose
formats can't be split, are read per file, and in-memory rows come from the driver.
"""

from __future__ import annotations

import atexit
import csv
import io
import json
import re
import uuid
import zipfile
from collections.abc import Sequence
from datetime import date, datetime
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from ashlar.operators.frame import Frame
from ashlar.sources.policy import allowed

NULLS = ("", "null", "na", "nan")
MAX_SAFE = 2**53 - 1


class PrecisionLossError(ValueError):
    pass


# -- in memory --------------------------------------------------------------------------------------------------
def infer(values: Sequence):
    """Type of a whole column: any text wins, then datetime, then double, then int; booleans only among themselves."""
    some = [v for v in values if v is not None]
    if any(isinstance(v, str) for v in some):
        return StringType()
    if any(isinstance(v, (date, datetime)) for v in some):
        return TimestampType()
    if not some:
        return DoubleType()
    if all(isinstance(v, bool) for v in some):
        return BooleanType()
    if all(isinstance(v, (int, bool)) for v in some):
        return IntegerType() if all(-(2**31) <= v < 2**31 for v in some) else LongType()
    return DoubleType()


def _fit(v, kind):
    if v is None:
        return None
    if isinstance(kind, StringType):
        return v if isinstance(v, str) else json.dumps(v) if isinstance(v, (dict, list)) else str(v)
    if isinstance(kind, DoubleType):
        return float(v)
    if isinstance(kind, (IntegerType, LongType)):
        return int(v)
    if isinstance(kind, TimestampType) and isinstance(v, date) and not isinstance(v, datetime):
        return datetime(v.year, v.month, v.day)
    return v


def from_rows(spark: SparkSession, rows: Sequence[dict]) -> Frame:
    """Columns are the union of the rows' keys; missing values are null."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    kinds = {n: infer([r.get(n) for r in rows]) for n in names}
    schema = StructType([StructField(n, kinds[n]) for n in names])
    return Frame(spark.createDataFrame([tuple(_fit(r.get(n), kinds[n]) for n in names) for r in rows], schema))


def from_columns(spark: SparkSession, columns: dict[str, Sequence]) -> Frame:
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    return Frame(spark.createDataFrame(pa.table(columns)))


def int64_policy(df: DataFrame, policy: str = "keep") -> DataFrame:
    """keep, string, number (double) or error (beyond +-(2**53 - 1)) for bigint columns."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, LongType) and policy != "keep":
            safe = F.when(F.abs(c) > MAX_SAFE, F.raise_error(F.lit(f"{f.name}: integer beyond 2**53"))).otherwise(c)
            c = {"string": c.cast("string"), "number": c.cast("double"), "error": safe}[policy]
        out.append(c.alias(f.name))
    return df.select(*out)


# -- CSV --------------------------------------------------------------------------------------------------------
def _mangled(names: Sequence[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = n if n else f"column_{i}"
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}_{k}" if k else n)
    return out


def _coerced(df: DataFrame, quoted_empty: str, nulls, trues, falses, decimal: str, thousands: str | None, dtypes: dict[str, str]) -> DataFrame:
    """Typed columns from text, decided in one pass over all rows. Codes with leading zeros or a plus stay text."""
    low = [n.lower() for n in nulls]

    def value(c: str) -> Column:
        x = F.trim(F.col(f"`{c}`"))
        return F.when(F.lower(x).isin(low), None).otherwise(F.col(f"`{c}`"))

    def number(c: str) -> Column:
        x = F.trim(value(c))
        if thousands:
            x = F.replace(x, F.lit(thousands), F.lit(""))
        return F.replace(x, F.lit(decimal), F.lit(".")) if decimal != "." else x

    checks = []
    for i, c in enumerate(df.columns):
        v, n = value(c), number(c)
        some = v.isNotNull()
        isint = n.rlike(r"^-?(0|[1-9]\d*)$") & F.coalesce(F.abs(n.try_cast("double")) <= MAX_SAFE, F.lit(False))
        isnum = isint | n.rlike("[.eE]") & n.rlike(r"^-?(0|[1-9]\d*)?(\.\d+)?([eE][-+]?\d+)?$") & n.try_cast("double").isNotNull()
        isbool = F.lower(F.trim(v)).isin([t.lower() for t in (*trues, *falses)])
        small = F.coalesce(F.abs(n.try_cast("double")) < 2**31, F.lit(False))
        checks += [F.count_if(some).alias(f"s{i}"), F.count_if(some & isint & small).alias(f"i{i}"), F.count_if(some & isint).alias(f"l{i}"), F.count_if(some & isnum).alias(f"n{i}"), F.count_if(some & isbool).alias(f"b{i}")]
    got = df.agg(*checks).first() if df.columns else None
    out = []
    for i, c in enumerate(df.columns):
        s, whole, long, num, boo = (got[f"{k}{i}"] for k in "silnb")
        kind = dtypes.get(c) or ("double" if s == 0 else "boolean" if boo == s else "int" if whole == s else "bigint" if long == s else "double" if num == s else "string")
        v = value(c)
        if kind == "boolean":
            x = F.lower(F.trim(v)).isin([t.lower() for t in trues])
            x = F.when(v.isNull(), None).otherwise(x)
        elif kind == "string":
            x = F.when(F.col(f"`{c}`") == quoted_empty, "").otherwise(v)
        else:
            x = number(c).try_cast(kind)
        out.append(x.alias(c))
    return df.select(*out)


_EMPTY = "\x02"  # stands for a quoted empty cell, which is text and not null


def read_csv(spark: SparkSession, path: str, separator: str = ",", header: bool = True, names: Sequence[str] | None = None, skip_rows: int = 0, n_rows: int | None = None, comment: str | None = None, quote: str = '"', null_values=NULLS, true_values=("true",), false_values=("false",), decimal: str = ".", thousands: str | None = None, usecols: Sequence[str | int] | None = None, dtypes: dict[str, str] | None = None, multi_line: bool = True, encoding: str = "UTF-8") -> Frame:
    """Distributed CSV with whole-column typing; quoted empty cells stay '', blank ones are null.

    ``multi_line=False`` lets Spark split large files, if no cell holds a line break. ``skip_rows`` and ``n_rows`` take
    rows in file order (of one file, or of files in name order).
    """
    allowed(path, spark)
    r = spark.read.options(sep=separator, quote=quote, escape=quote, emptyValue=_EMPTY, nullValue="", multiLine=str(multi_line).lower(), encoding=encoding, header="false", inferSchema="false", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", mode="PERMISSIVE", maxColumns="100000", enforceSchema="true")
    if comment:
        r = r.option("comment", comment)
    if skip_rows:  # the width is that of the first row that counts, not of what comes before it
        top = [x[0] for x in spark.read.option("encoding", encoding).text(path).head(skip_rows + 100)]
        top = [x for x in top if x.strip() and not (comment and x.startswith(comment))]
        width = len(next(csv.reader(top[skip_rows:], delimiter=separator, quotechar=quote), [""]))
        r = r.schema(StructType([StructField(f"_c{i}", StringType()) for i in range(width)]))
    df = r.csv(path)
    raw = df.columns
    if skip_rows or header:
        df = df.withColumn("_f", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id())
        top = df.orderBy("_f", "_at").limit(skip_rows + (1 if header else 0)).collect()
        gone = [(x["_f"], x["_at"]) for x in top]
        if header and top:
            names = names or _mangled([("" if x is None or x == _EMPTY else x.strip()) for x in top[-1][: len(raw)]])
            head = top[-1]
            if len(gone) == 1:  # further files of a directory start with the same header: it goes where it is a file's first row
                same = F.lit(True)
                for c in raw:
                    same = same & F.col(c).eqNullSafe(F.lit(head[c]))
                starts = df.groupBy("_f").agg(F.min("_at").alias("_start"))
                df = df.join(starts, "_f").filter(~(same & (F.col("_at") == F.col("_start")))).drop("_start")
        for f, at in gone:
            df = df.filter(~((F.col("_f") == f) & (F.col("_at") == at)))
        if n_rows is not None:
            df = df.orderBy("_f", "_at").limit(n_rows)
        df = df.drop("_f", "_at")
    elif n_rows is not None:
        df = df.limit(n_rows)
    names = list(names or [f"column_{i}" for i in range(len(raw))])
    df = df.toDF(*(names + [f"column_{i}" for i in range(len(names), len(raw))])[: len(raw)])
    if usecols is not None:
        df = df.select(*[F.col(f"`{df.columns[u] if isinstance(u, int) else u}`") for u in usecols])
    return Frame(_coerced(df, _EMPTY, null_values, true_values, false_values, decimal, thousands, dtypes or {}))


def from_csv(spark: SparkSession, text: str, **options) -> Frame:
    """CSV in memory, through a file in the folder that executors share (spark.checkpoint.dir, or the warehouse)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/ashlar-csv-{uuid.uuid4().hex}/in.csv")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    atexit.register(_forget, spark, path.getParent())
    return read_csv(spark, path.toString(), **options)


def _forget(spark: SparkSession, path) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM has gone at exit; nothing depends on this
        pass


# -- JSON -------------------------------------------------------------------------------------------------------
def read_json(spark: SparkSession, path: str, orient: str = "records", schema=None, skip_rows: int = 0, n_rows: int | None = None, int64: str = "keep") -> Frame:
    """lines and records are read by Spark; columns and values, which have no rows to split at, by the driver."""
    allowed(path, spark)
    if orient in ("lines", "records"):
        r = spark.read.schema(schema) if schema is not None else spark.read.option("samplingRatio", 1.0)
        df = r.json(path, multiLine=orient == "records")
        if skip_rows or n_rows is not None:
            df = df.offset(skip_rows) if skip_rows else df
            df = df.limit(n_rows) if n_rows is not None else df
        return Frame(int64_policy(df, int64))
    data = json.loads(spark.read.option("wholetext", True).text(path).first()[0])
    if orient == "columns":
        rows = [dict(zip(data, v, strict=True)) for v in zip(*data.values(), strict=True)]
    elif orient == "values":
        rows = [{f"column_{i}": x for i, x in enumerate(r)} for r in data]
    else:
        raise ValueError(f"orient: {orient}")
    rows = rows[skip_rows:][:n_rows]
    return Frame(int64_policy(from_rows(spark, rows).df, int64))


def from_json(spark: SparkSession, text: str) -> Frame:
    """Records, or lines, in memory."""
    text = text.strip()
    rows = json.loads(text) if text.startswith("[") else [json.loads(x) for x in text.splitlines() if x.strip()]
    return from_rows(spark, rows)


# -- Parquet, Arrow, Excel --------------------------------------------------------------------------------------
def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, row_start: int | None = None, row_end: int | None = None, order: Sequence[str] = (), int64: str = "keep") -> Frame:
    """Row ranges need ``order``: files have none of their own."""
    df = spark.read.parquet(allowed(path, spark))
    f = Frame(int64_policy(df, int64), order)
    if row_start is not None or row_end is not None:
        f = f.slice(row_start or 0, row_end)
    return f.select(*columns) if columns else f


def _tables(content: bytes) -> pa.Table:
    source = io.BytesIO(content)
    try:
        return pa.ipc.open_file(source).read_all()
    except pa.ArrowInvalid:
        source.seek(0)
        return pa.ipc.open_stream(source).read_all()


def read_arrow_ipc(spark: SparkSession, path: str) -> Frame:
    """Stream or file format; files are decoded on the executors, the schema comes from the first."""
    files = spark.read.format("binaryFile").load(allowed(path, spark)).select("content")
    table = _tables(files.first()[0])
    schema = spark.createDataFrame(_plain(table.slice(0, 0))).schema

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _plain(_tables(batch.column(0)[i].as_py())).to_batches()

    return Frame(files.mapInArrow(run, schema))


def _plain(t: pa.Table) -> pa.Table:
    """Dictionaries decoded, unsigned widened, views and large strings made plain."""
    kinds = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.int64(), pa.float16(): pa.float32(), pa.large_string(): pa.string(), pa.string_view(): pa.string()}
    out = []
    for f in t.schema:
        k = f.type.value_type if pa.types.is_dictionary(f.type) else f.type
        k = kinds.get(k, k)
        if pa.types.is_timestamp(k):
            k = pa.timestamp("us", k.tz)
        if pa.types.is_date64(k):
            k = pa.date32()
        out.append(pa.field(f.name, k))
    return t.cast(pa.schema(out), safe=False)


def from_arrow_ipc(spark: SparkSession, data: bytes) -> Frame:
    return Frame(spark.createDataFrame(_plain(_tables(data))))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _sheet(data: bytes, sheet: str | int) -> list[list]:
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
    sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS)]
    i = sheets.index(sheet) if isinstance(sheet, str) else sheet
    rows = []
    for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i + 1}.xml")).iter(f"{{{_NS['m']}}}row"):
        row: list = []
        for c in r:
            letters = re.match("[A-Z]+", c.get("r", "")) if c.get("r") else None
            at = len(row)
            if letters:
                at = 0
                for ch in letters[0]:
                    at = at * 26 + ord(ch) - 64
                at -= 1
            row += [None] * (at - len(row))
            v, t = c.find("m:v", _NS), c.get("t")
            if t == "inlineStr":
                row.append("".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t")))
            elif v is None or v.text is None:
                row.append(None)
            else:
                row.append(shared[int(v.text)] if t == "s" else v.text if t in ("str", "e") else v.text == "1" if t == "b" else float(v.text) if "." in v.text or "e" in v.text.lower() else int(v.text))
        rows.append(row)
    return rows


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0, header: bool = True, names: Sequence[str] | None = None, skip_rows: int = 0, n_rows: int | None = None, usecols: Sequence[str] | None = None, null_values=NULLS) -> Frame:
    """One sheet of an .xlsx workbook (a sheet has at most 2**20 rows, so the driver reads it)."""
    rows = _sheet(spark.read.format("binaryFile").load(allowed(path, spark)).select("content").first()[0], sheet)[skip_rows:]
    if header and rows:
        names, rows = names or _mangled([str(x) if x is not None else "" for x in rows[0]]), rows[1:]
    width = max([len(r) for r in rows] + [len(names or [])])
    names = list(names or []) + [f"column_{i}" for i in range(len(names or []), width)]
    low = set(null_values)
    clean = lambda v: None if isinstance(v, str) and v.strip().lower() in low else v
    f = from_rows(spark, [{n: clean(r[i]) if i < len(r) else None for i, n in enumerate(names)} for r in rows[:n_rows]])
    return f.select(*usecols) if usecols else f


# -- databases, Kafka -------------------------------------------------------------------------------------------
def limited(sql: str, n: int | None, dialect: str = "postgres") -> str:
    """A single SELECT or WITH wrapped in a row limit, which the database then applies."""
    sql = sql.strip().rstrip(";").strip()
    if n is None:
        return sql
    if not re.match(r"(?is)\s*(select|with)\b", sql) or ";" in re.sub(r"'(?:[^']|'')*'", "", sql):
        raise ValueError("a row limit needs a single SELECT or WITH")
    if dialect == "mssql":
        return f"SELECT TOP ({int(n)}) * FROM ({sql}) q"
    return f"SELECT * FROM ({sql}) q LIMIT {int(n)}"


def read_sql(spark: SparkSession, sql: str, url: str, n_rows: int | None = None, dialect: str = "postgres", partition_column: str | None = None, lower=None, upper=None, partitions: int | None = None, int64: str = "keep", **properties: str) -> Frame:
    """A query over JDBC; with ``partition_column`` and its bounds, read in parallel ranges."""
    if not url.startswith("jdbc:"):
        raise ValueError("a JDBC url is needed")
    r = spark.read.format("jdbc").options(url=url, **properties)
    if partition_column:
        r = r.options(dbtable=f"({limited(sql, n_rows, dialect)}) q", partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    else:
        r = r.option("query", limited(sql, n_rows, dialect))
    return Frame(int64_policy(r.load(), int64))


read_database = read_sql


def read_kafka(spark: SparkSession, servers: str, topic: str, n_messages: int | None = 1000, codec: str = "json", schema=None, **options: str) -> Frame:
    """A bounded batch of messages as rows; needs Spark's Kafka connector on the class path."""
    df = spark.read.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, **options}).load()
    if n_messages is not None:
        df = df.orderBy("timestamp", "partition", "offset").limit(n_messages)
    return kafka_rows(df, codec, schema)


def kafka_rows(messages: DataFrame, codec: str = "json", schema=None) -> Frame:
    """(topic, partition, offset, timestamp, key, value) -> dotted columns of the value plus ``_kafka_*``.

    auto decodes JSON objects where every value is one, and text otherwise.
    """
    text = F.decode(F.col("value"), "UTF-8") if dict(messages.dtypes)["value"] == "binary" else F.col("value")
    key = F.decode(F.col("key"), "UTF-8") if dict(messages.dtypes)["key"] == "binary" else F.col("key")
    meta = [F.col(c).alias(f"_kafka_{c}") for c in ("topic", "partition", "offset", "timestamp")] + [key.alias("_kafka_key")]
    if codec == "auto":
        bad = messages.filter(F.col("value").isNotNull() & ~F.coalesce(F.is_valid_json(text) if hasattr(F, "is_valid_json") else F.get_json_object(text, "$").startswith("{"), F.lit(False))).limit(1).count()
        codec = "string" if bad else "json"
    if codec == "bytes":
        return Frame(messages.select("value", *meta))
    if codec == "string":
        return Frame(messages.select(text.alias("value"), *meta))
    f = Frame(messages.select(text.alias("value"), *meta)).unnest("value", schema=schema)
    return f.rename({c: c.removeprefix("value.") for c in f.columns if c.startswith("value.")})


def read(spark: SparkSession, path: str, format: str | None = None, **options) -> Frame:  # noqa: A002
    """By extension or by ``format``."""
    kind = format or path.rstrip("/").rpartition(".")[2].lower()
    readers = {"csv": read_csv, "tsv": lambda s, p, **o: read_csv(s, p, separator="\t", **o), "json": read_json, "ndjson": lambda s, p, **o: read_json(s, p, orient="lines", **o), "jsonl": lambda s, p, **o: read_json(s, p, orient="lines", **o), "parquet": read_parquet, "arrow": read_arrow_ipc, "feather": read_arrow_ipc, "ipc": read_arrow_ipc, "xlsx": read_excel}
    if kind not in readers:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(readers)}")
    return readers[kind](spark, path, **options)
