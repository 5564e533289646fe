"""Writes as DataFrame rewrites: insert, update, delete, upsert, optimistic updates, versions, hooks, bookkeeping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import identifier


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    if not rows.columns:
        raise ValueError("nothing to insert")
    for c in rows.columns:
        identifier(c)
    return df.unionByName(rows.select(*rows.columns), allowMissingColumns=True)


def update(df: DataFrame, values: dict[str, Column], where: Column | None = None) -> DataFrame:
    where = F.lit(True) if where is None else where
    return df.withColumns({identifier(c): F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, where: Column | None) -> DataFrame:
    """Rows for which the condition is false or unknown stay; without a condition nothing is deleted at all."""
    if where is None:
        raise ValueError("a delete needs a condition")
    return df.filter(~F.coalesce(where, F.lit(False)))


def soft_delete(df: DataFrame, where: Column, field: str = "deleted_at", at: Column | None = None) -> DataFrame:
    return update(df, {field: F.current_timestamp() if at is None else at}, where & F.col(field).isNull())


def restore(df: DataFrame, where: Column, field: str = "deleted_at") -> DataFrame:
    return update(df, {field: F.lit(None)}, where)


def insert_deduplicated(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds rows whose keys are new, the first of each; a row with a null key is never a duplicate."""
    null = " OR ".join(f"{k} IS NULL" for k in keys)
    first = Window.partitionBy(*keys).orderBy(order)
    keyed = incoming.filter(f"NOT ({null})").withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")
    new = keyed.join(existing.select(*keys), keys, "left_anti").select(*incoming.columns)
    return existing.unionByName(new).unionByName(incoming.filter(null))


def update_if_version(df: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Compare and set: a change takes effect only on the version it was made for, which then goes up by one."""
    named = changes.select(*(F.col(c).alias(f"_n_{c}") for c in changes.columns))
    both = df.join(named, (df[key] == F.col(f"_n_{key}")) & (df[version] == F.col(f"_n_{version}")), "left")
    hit = F.col(f"_n_{key}").isNotNull()
    values = {c: F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in changes.columns if c not in (key, version)}
    return both.withColumns(values | {version: F.col(version) + hit.cast("int")}).select(*df.columns)


def add_up(df: DataFrame, rows: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Upsert that adds amounts of equal keys."""
    return df.select(*keys, amount).unionByName(rows.select(*keys, amount)).groupBy(*keys).agg(F.sum(amount).alias(amount))


class Versions:
    """An append-only table with versions from 1 per key: add, update, delete, get, list, history."""

    def __init__(self, rows: DataFrame, key: list[str], version: str = "version"):
        self.rows, self.key, self.version = rows, key, version

    def latest(self) -> DataFrame:
        return self.rows.groupBy(*self.key).agg(F.max_by(F.struct(*self.rows.columns), self.version).alias("_row")).select("_row.*")

    def add(self, new: DataFrame) -> Versions:
        known = self.rows.select(*self.key).distinct().withColumn("_known", F.lit(True))
        checked = new.join(known, self.key, "left").withColumn(self.version, F.when(F.col("_known"), F.raise_error(F.lit("the key exists")).cast("int")).otherwise(1))
        return Versions(self.rows.unionByName(checked.select(*self.rows.columns)), self.key, self.version)

    def update(self, new: DataFrame) -> Versions:
        last = self.rows.groupBy(*self.key).agg(F.max(self.version).alias("_last"))
        checked = new.join(last, self.key, "left").withColumn(self.version, F.when(F.col("_last").isNull(), F.raise_error(F.lit("no such key")).cast("int")).otherwise(F.col("_last") + 1))
        return Versions(self.rows.unionByName(checked.select(*self.rows.columns)), self.key, self.version)

    def delete(self, gone: DataFrame) -> Versions:
        return Versions(self.rows.join(gone.select(*self.key), self.key, "left_anti"), self.key, self.version)

    def history(self) -> DataFrame:
        return self.rows.orderBy(*self.key, F.desc(self.version))

    def at(self, version: int) -> DataFrame:
        return self.rows.filter(F.col(self.version) == version)


#: The order in which hooks run around each kind of write: fixed values.
HOOKS = {
    "insert": ("before_write", "before_insert", "write", "after_insert", "after_write"),
    "update": ("before_write", "before_update", "write", "after_update", "after_write"),
    "delete": ("before_delete", "write", "after_delete"),
    "restore": ("before_restore", "write", "after_restore"),
}


def with_hooks(kind: str, df: DataFrame, write: Callable[[DataFrame], DataFrame], hooks: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for name in HOOKS[kind]:
        df = write(df) if name == "write" else hooks.get(name, lambda x: x)(df)
    return df


def allowed(df: DataFrame, old: str, new: str, transitions: dict[str, list[str]]) -> DataFrame:
    """df with allowed: whether the step from old to new is one of the transitions."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, bs in transitions.items() for b in bs]
    return df.withColumn("allowed", F.array_contains(F.array(*pairs), F.struct(F.col(old).alias("a"), F.col(new).alias("b"))) if pairs else F.lit(False))


def next_batch(history: DataFrame) -> DataFrame:
    return history.agg((F.coalesce(F.max("batch"), F.lit(0)) + 1).alias("batch"))


class History:
    """The migrations that have run: name and batch. Each change gives a new one."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("name", "batch")

    def ran(self, names: DataFrame) -> History:
        """With the names that are not in it yet, as the next batch."""
        new = names.select("name").distinct().join(self.rows, "name", "left_anti")
        return History(self.rows.unionByName(new.crossJoin(F.broadcast(next_batch(self.rows)))))

    def rolled_back(self) -> History:
        """Without the last batch."""
        last = self.rows.agg(F.max("batch").alias("_last"))
        return History(self.rows.join(F.broadcast(last), F.col("batch") == F.col("_last"), "left_anti"))

    def listed(self) -> DataFrame:
        return self.rows.orderBy("batch", "name")

    def exists(self, name: str) -> bool:
        return not self.rows.filter(F.col("name") == name).isEmpty()
