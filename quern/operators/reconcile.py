"""Reconciliation: matching by computed keys, merging with soft deletion, claims and conflicts, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized(*parts: Column) -> Column:
    return F.concat_ws("|", *(F.lower(F.trim(p.cast("string"))) for p in parts))


def match_first(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, order: list[Column], columns: list[str]) -> DataFrame:
    """left with the columns of the first row of right that has the same key; nulls where there is none."""
    first = Window.partitionBy("_key").orderBy(*order)
    found = right.withColumn("_key", right_key).withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").select("_key", *columns)
    return left.withColumn("_key", left_key).join(found, "_key", "left").drop("_key")


def merge_actions(existing: DataFrame, incoming: DataFrame, key: str, deleted: str) -> DataFrame:
    """key and action of each: insert, update, delete (alive and not coming in), unchanged (deleted already)."""
    e = existing.select(F.col(key), F.col(deleted).alias("_deleted"), F.lit(True).alias("_old"))
    both = e.join(incoming.select(key).distinct().withColumn("_new", F.lit(True)), key, "full_outer")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNotNull(), "update").when(F.col("_deleted") != 0, "unchanged").otherwise("delete")
    return both.select(key, action.alias("action"))


def merge_counts(actions: DataFrame) -> DataFrame:
    return actions.agg(*(F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("insert", "update", "delete", "unchanged")))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti"))


def claims(rows: DataFrame, owner: str, item: str) -> DataFrame:
    """item, owner and claims: an item claimed once has an owner, one claimed more often is a conflict (owner null)."""
    counted = rows.groupBy(item).agg(F.count(F.lit(1)).alias("claims"), F.min(owner).alias("_first"))
    return counted.select(item, F.when(F.col("claims") == 1, F.col("_first")).alias("owner"), "claims")


def pair_up(left: DataFrame, right: DataFrame, group: list[str], left_key: str, right_key: str) -> DataFrame:
    """Pairs what is left over on both sides of a group by place, where both sides are equally many."""
    def numbered(df: DataFrame, key: str, n: str) -> DataFrame:
        w = Window.partitionBy(*group)
        return df.withColumn("_nth", F.row_number().over(w.orderBy(key))).withColumn(n, F.count(F.lit(1)).over(w))

    both = numbered(left, left_key, "_nl").join(numbered(right, right_key, "_nr"), [*group, "_nth"])
    return both.filter("_nl = _nr").drop("_nth", "_nl", "_nr")


def checked(left: DataFrame, candidates: DataFrame, keys: list[str], claimed_by: str, me: str, candidate: str) -> DataFrame:
    """left with outcome: unmatched, claimed (all candidates are another's), single, several; and the sorted free candidates."""
    lists = candidates.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(candidate, claimed_by))).alias("_all"))
    out = left.join(lists, keys, "left")
    free = F.filter("_all", lambda x: x[claimed_by].isNull() | (x[claimed_by] == F.col(me)))
    out = out.withColumn("free", F.coalesce(F.transform(free, lambda x: x[candidate]), F.array().cast(f"array<{dict(candidates.dtypes)[candidate]}>")))
    n = F.size("free")
    return out.withColumn("outcome", F.when(F.col("_all").isNull(), "unmatched").when(n == 0, "claimed").when(n == 1, "single").otherwise("several")).drop("_all")


def duplicate_pairs(df: DataFrame, keys: list[str], key: str) -> DataFrame:
    """first and duplicate: the first row of a key with each later one; one window, no join, no pairs among the later ones."""
    w = Window.partitionBy(*keys).orderBy(key)
    return df.withColumn("first", F.first(key).over(w)).filter(F.col("first") != F.col(key)).select("first", F.col(key).alias("duplicate"))
