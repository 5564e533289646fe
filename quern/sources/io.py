"""Readers and writers: JSON documents and lines, text trees, exact CSV, JSON rows, metric text, spreadsheets where a library is there."""

from __future__ import annotations

import importlib.util
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_documents(spark: SparkSession, path: str, schema: str, unnest: tuple[str, ...] = ()) -> DataFrame:
    """Nested JSON documents to rows, each of unnest exploded in turn; a missing or malformed file gives no rows."""
    try:
        df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path, multiLine=True)
    except AnalysisException:
        df = spark.createDataFrame([], schema)
    for step in unnest:
        df = df.select(F.explode(step).alias("_x")).select("_x.*")
    return df


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """A log with one object in a line: a bad line is an error if strict, else it is skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def text_tree(spark: SparkSession, path: str, glob: str = "*.rs") -> DataFrame:
    """path and text of each file under a folder."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def csv_field(c: Column) -> Column:
    """A field of exact CSV: quoted only with a comma, a quote, or a control character in it."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike("[,\"\\x00-\\x1f]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*columns: Column) -> Column:
    return F.concat_ws(",", *map(csv_field, columns))


def write_csv(df: DataFrame, path: str, header: bool = True, bom: bool = True) -> None:
    """Exact CSV as one ordered set of text files; a byte order mark and a header begin the first one."""
    lines = df.select(csv_line(*(F.col(c) for c in df.columns)).alias("value"))
    if header or bom:
        head = (chr(0xFEFF) if bom else "") + (",".join(df.columns) if header else "")
        first = df.sparkSession.range(1, numPartitions=1).select(F.lit(head).alias("value"))
        lines = first.unionByName(lines)
    lines.write.mode("overwrite").text(path)


def row_json(df: DataFrame) -> DataFrame:
    """Each row as JSON: NaN and infinities are null, bytes are lower-case hex."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("float", "double"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        elif kind == "binary":
            c = F.lower(F.hex(c))
        out.append(c.alias(name))
    return df.select(F.to_json(F.struct(*out), {"ignoreNullFields": "false"}).alias("json"))


def metric_text(df: DataFrame, name: str, kind: str, value: str, labels: list[str]) -> DataFrame:
    """Metric rows as text lines, the type first."""
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{x}="'), F.col(x).cast("string"), F.lit('"')) for x in labels))
    line = F.concat(F.lit(name), F.when(F.lit(bool(labels)), F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(""), F.lit(" "), F.col(value).cast("string"))
    head = df.sparkSession.range(1).select(F.lit(0).alias("_k"), F.lit(f"# TYPE {name} {kind}").alias("line"))
    return head.unionByName(df.select(F.lit(1).alias("_k"), line.alias("line"))).orderBy("_k", "line").select("line")


def traces_json(spans: DataFrame) -> DataFrame:
    """One JSON text for each trace with its spans in order of their start."""
    body = F.array_sort(F.collect_list(F.struct("start", "span_id", "parent_id", "name", "tags")))
    return spans.groupBy("trace_id").agg(body.alias("spans")).select("trace_id", F.to_json(F.struct(F.col("trace_id").alias("traceID"), "spans")).alias("json"))


CELL = re.compile(r"([A-Z]{1,3})([1-9][0-9]*)")


def cell_place(name: str) -> tuple[int, int]:
    """Row and column, from 0, of a cell such as B12."""
    m = CELL.fullmatch(name)
    if not m:
        raise ValueError(f"not a cell: {name!r}")
    column = 0
    for c in m[1]:
        column = column * 26 + ord(c) - 64
    return int(m[2]) - 1, column - 1


def cell_text(c: Column, kind: str) -> Column:
    """Booleans in capitals, nothing for null."""
    return F.coalesce(F.when(c, "TRUE").otherwise("FALSE") if kind == "boolean" else c.cast("string"), F.lit(""))


def read_sheet(spark: SparkSession, path: str, sheet=0) -> DataFrame:
    """A spreadsheet's rows as text; needs openpyxl."""
    if importlib.util.find_spec("openpyxl") is None:
        raise RuntimeError("reading spreadsheets needs openpyxl")
    import pandas as pd

    frame = pd.read_excel(path, sheet_name=sheet, header=None, dtype=str).fillna("")
    return spark.createDataFrame(frame.rename(columns=lambda k: f"c{k}"))


def message_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Messages as JSON files in a folder, as a stream; a checkpoint at the writer makes it at least once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


#: A literal, a quoted name, a comment to the end of its line, the end of a statement, or anything else.
SQL_PART = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|;|[^'"`;-]+|.""", re.S)


def statements(text: str) -> list[str]:
    """The statements of a script without its comments; a semicolon in a literal or a quoted name ends none."""
    out = [""]
    for part in SQL_PART.findall(text):
        if part == ";":
            out.append("")
        elif not part.startswith("--"):
            out[-1] += part
    return [s for s in map(str.strip, out) if s]


def run_script(spark: SparkSession, text: str) -> int:
    """Runs the statements of a seed or migration file; the number of them."""
    found = statements(text)
    for s in found:
        spark.sql(s)
    return len(found)


def write_sheet(df: DataFrame, path: str, sheet: str = "Sheet1", start: str = "A1", most: int = 100_000) -> None:
    """Typed cells from a start cell on, the header first; needs openpyxl. One file is written by the driver, so more than most rows are an error."""
    if importlib.util.find_spec("openpyxl") is None:
        raise RuntimeError("writing spreadsheets needs openpyxl")
    row, column = cell_place(start)
    frame = df.limit(most + 1).toPandas()
    if len(frame) > most:
        raise ValueError(f"more than {most} rows are too many for a sheet")
    frame.to_excel(path, sheet_name=sheet, startrow=row, startcol=column, index=False)


def replace_json(df: DataFrame, path: str) -> None:
    """JSON lines in place of what is there: files are written aside and committed together."""
    df.write.mode("overwrite").json(path)
