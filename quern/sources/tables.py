"""Tables by name: scans, point lookups, identifier checks, schema metadata."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}")


def identifier(name: str) -> str:
    """name, if it is a plain identifier of at most 63 characters; raises otherwise."""
    if not IDENTIFIER.fullmatch(name or ""):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A full scan; Catalyst prunes columns and pushes filters down to the Parquet files."""
    return spark.read.parquet(f"{folder}/{identifier(name)}.parquet")


def placed(rows: DataFrame) -> DataFrame:
    """A table's rows with their place, as a reader of one file after the other meets them: _file, by its path, and _row in it."""
    return rows.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})


def query(spark: SparkSession, text: str, **args) -> DataFrame:
    """SQL text with named parameters, which are bound and never spliced."""
    return spark.sql(text, args=args)


def find_by_id(df: DataFrame, key: str, value, tenant: tuple[str, object] | None = None) -> DataFrame:
    """At most one row; a row of another tenant is not found."""
    found = df.filter(F.col(identifier(key)) == F.lit(value))
    if tenant is not None:
        found = found.filter(F.col(identifier(tenant[0])) == F.lit(tenant[1]))
    return found.limit(1)


def columns_of(df: DataFrame) -> list[dict]:
    """Name, type, nullability, and whether it is a key, unsigned, or commented, as its metadata says."""
    return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable, **{k: f.metadata.get(k) for k in ("primary_key", "unsigned", "default", "comment")}} for f in df.schema.fields]


#: SQL types of metadata and the type that holds all their values; there are no unsigned types, so these are one size wider.
TYPES = {
    "bool": T.BooleanType(), "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "f32": T.FloatType(), "f64": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(),
}


def conforms(value: dict, schema: dict) -> list[str]:
    """What a JSON object lacks or has of another type, by the subset required + properties.*.type; an integer is a number too."""
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
    wrong = [f"missing {k}" for k in schema.get("required", []) if k not in value]
    for name, rule in schema.get("properties", {}).items():
        if name in value and "type" in rule:
            v, kind = value[name], rule["type"]
            if kind in kinds and (not isinstance(v, kinds[kind]) or isinstance(v, bool) and kind in ("integer", "number")):
                wrong.append(f"{name} is not of type {kind}")
    return wrong


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Explicit columns only: no wildcard, and not none."""
    if not columns or "*" in columns:
        raise ValueError("name the columns")
    return df.select(*map(identifier, columns))


def exists(df: DataFrame, condition) -> bool:
    """Whether any row meets the condition; reads one row at most."""
    return not df.filter(condition).limit(1).isEmpty()


def check_sql(spark: SparkSession, text: str, **args) -> dict:
    """Parses and analyses a statement without running it: an error text, or its plan's joins, aggregates, sorts and a score of these."""
    from pyspark.errors import PySparkException

    try:
        plan = spark.sql(text, args=args)._jdf.queryExecution().optimizedPlan().toString()
    except PySparkException as e:
        return {"error": str(e).splitlines()[0], "score": None}
    counts = {name: len(re.findall(rf"\b{name}\b", plan)) for name in ("Join", "Aggregate", "Sort", "Window", "Generate")}
    return {"error": None, **counts, "score": 1 + 5 * counts["Join"] + 3 * counts["Window"] + 2 * (counts["Aggregate"] + counts["Sort"] + counts["Generate"])}
