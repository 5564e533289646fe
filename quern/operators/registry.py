"""Capabilities by name, scoped fan-out over tables, candidate sets, derived columns and context merging."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scope import tenant
from ..sources.tables import conforms


@dataclass(frozen=True)
class Capability:
    name: str
    description: str
    call: Callable[[dict], dict]
    schema: dict = field(default_factory=dict)
    tags: tuple[str, ...] = ()
    source: str = "local"


class Capabilities:
    """Named functions on JSON objects, checked against their schema and a permission before each call."""

    def __init__(self):
        self.by_name: dict[str, Capability] = {}

    def register(self, capability: Capability) -> None:
        if capability.name in self.by_name:
            raise ValueError(f"{capability.name} is registered already")
        self.by_name[capability.name] = capability

    def call(self, name: str, value: dict, permitted: Callable[[Capability], bool] = lambda c: True) -> dict:
        found = self.by_name[name]
        if not permitted(found):
            raise PermissionError(name)
        if wrong := conforms(value, found.schema):
            raise ValueError("; ".join(wrong))
        return found.call(value)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c.name, c.description, list(c.tags), c.source) for _, c in sorted(self.by_name.items())]
        return spark.createDataFrame(rows, "name string, description string, tags array<string>, source string")


def by_tags(table: DataFrame, tags: list[str], source: str | None = None) -> DataFrame:
    found = table.filter(F.forall(F.array(*map(F.lit, tags)), lambda t: F.array_contains("tags", t))) if tags else table
    return found if source is None else found.filter(F.col("source") == source)


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def fan_out(tables: dict[str, DataFrame], tenant_column: str, value) -> dict[str, DataFrame]:
    """Each table within the tenant; nothing runs yet."""
    return {name: tenant(df, tenant_column, value) for name, df in tables.items()}


def candidates(listed: Column) -> Column:
    """The sorted distinct ids of a list; an empty or null one is an error."""
    ids = F.array_sort(F.array_distinct(listed))
    return F.when(F.coalesce(F.size(ids), F.lit(0)) > 0, ids).otherwise(F.raise_error(F.lit("no candidates")).cast("array<bigint>"))


def kept_in_order(left: Column, right: Column) -> Column:
    """Those of left that are in right, in left's order, repeats included."""
    return F.filter(left, lambda x: F.array_contains(right, x))


def appended(df: DataFrame, columns: dict[str, Column | None]) -> DataFrame:
    """Derived columns; one without a definition is null."""
    return df.withColumns({n: F.lit(None).cast("string") if c is None else c for n, c in columns.items()})


def merged_context(context: Column, extra: Column, reserved: list[str]) -> Column:
    """A map with the entries of another one in place of its own, but for reserved keys."""
    allowed = F.map_filter(extra, lambda k, _: ~k.isin(*reserved)) if reserved else extra
    return F.map_concat(F.map_filter(context, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)


def stamped_name(prefix: str, at: Column, suffix: str, zone: str = "Asia/Shanghai") -> Column:
    """A file name with the local time of a zone in it."""
    return F.concat(F.lit(prefix), F.date_format(F.from_utc_timestamp(at, zone), "yyyyMMddHHmmss"), F.lit(suffix))


def outcomes(df: DataFrame, status: str, kinds: list[str]) -> DataFrame:
    """One row: how many of each outcome, and the total."""
    return df.agg(*(F.count_if(F.col(status) == k).alias(k) for k in kinds), F.count(F.lit(1)).alias("total"))


def counters(df: DataFrame, labels: list[str], kind: str, value: str, at: str) -> DataFrame:
    """Counters and gauges by labels: increments add up from the last set on. kind: inc, dec or set."""
    last_set = F.max(F.when(F.col(kind) == "set", F.col(at)))
    sets = df.groupBy(*labels).agg(last_set.alias("_at"), F.coalesce(F.max_by(F.when(F.col(kind) == "set", F.col(value)), F.when(F.col(kind) == "set", F.col(at))), F.lit(0)).alias("_base"))
    on = [df[x].eqNullSafe(sets[x]) for x in labels]
    joined = df.join(sets, on[0] if len(on) == 1 else on).drop(*(sets[x] for x in labels))
    step = F.when(F.col("_at").isNull() | (F.col(at) > F.col("_at")), F.when(F.col(kind) == "inc", F.col(value)).when(F.col(kind) == "dec", -F.col(value))).otherwise(0)
    return joined.groupBy(*labels).agg((F.first("_base") + F.coalesce(F.sum(step), F.lit(0))).alias("value"))
