"""Row scopes: tenants, soft deletion, five data scopes, department trees, reachability in graphs."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import identifier


class ScopeError(ValueError):
    """A scope that can't be decided: nothing may be read."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


def tenant(df: DataFrame, field: str, value) -> DataFrame:
    """The tenant is passed by hand, never taken from the thread."""
    return df.filter(F.col(identifier(field)) == F.lit(value))


def stamped(df: DataFrame, field: str, value) -> DataFrame:
    """For writing: tenant 0 becomes the current one, and another one stops the write."""
    c = F.col(identifier(field))
    return df.withColumn(field, F.when(F.coalesce(c, F.lit(0)) == 0, F.lit(value)).when(c == F.lit(value), c).otherwise(F.raise_error(F.lit("row of another tenant")).cast("long")))


def alive(df: DataFrame, deleted_at: str, which: str = "alive") -> DataFrame:
    """which: alive (not deleted), trashed (only deleted) or all."""
    c = F.col(identifier(deleted_at))
    return {"alive": lambda: df.filter(c.isNull()), "trashed": lambda: df.filter(c.isNotNull()), "all": lambda: df}[which]()


def is_deleted(value: Column) -> Column:
    """The test on values: non-null and non-empty means deleted."""
    return F.coalesce(value.cast("string") != "", F.lit(False))


def shared_folder(spark: SparkSession) -> None:
    """Sets the checkpoint folder that all executors share, as spark.checkpoint.dir names it; only a session on one machine may go without and gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quern-"))


def iterate(frontier: DataFrame, step) -> DataFrame:
    """All rows that step reaches from frontier, which stay distinct: a semi-naive closure that ends on cycles too.

    Each round joins only what is new, and is written to the checkpoint folder, so that plans stay short.
    """
    shared_folder(frontier.sparkSession)
    frontier = frontier.distinct().checkpoint()
    settled = [frontier]
    while True:
        if len(settled) > 10:  # a long union is written as one
            settled = [reduce(DataFrame.unionByName, settled).checkpoint()]
        reached = reduce(DataFrame.unionByName, settled)
        frontier = step(frontier).distinct().join(reached, reached.columns, "left_anti").checkpoint()
        if frontier.isEmpty():
            return reached
        settled.append(frontier)


def closure(edges: DataFrame, roots: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """root and node for each root (column id) and all its descendants, itself included; cycles end."""
    links = edges.select(F.col(parent).alias("_p"), F.col(child).alias("_c"))
    start = roots.select(F.col("id").alias("root"), F.col("id").alias("node"))
    return iterate(start, lambda at: at.join(links, F.col("node") == F.col("_p")).select("root", F.col("_c").alias("node")))


def closure_sql(edges: str, root: str) -> str:
    """The same for one root and edges known to be short: a recursive query that carries its path, so that cycles end."""
    return f"""
WITH RECURSIVE walk(node, path) AS (
  SELECT CAST({root} AS BIGINT), array(CAST({root} AS BIGINT))
  UNION ALL
  SELECT e.child, array_append(w.path, e.child) FROM walk w JOIN {edges} e ON e.parent = w.node WHERE NOT array_contains(w.path, e.child))
SELECT DISTINCT node FROM walk"""


def validate_graph(nodes: DataFrame, edges: DataFrame, start, ends: list) -> DataFrame:
    """node and problem: unreachable from the start (warning), or unable to reach any end (error)."""
    spark = nodes.sparkSession
    from_start = closure(edges, spark.range(1).select(F.lit(start).alias("id"))).select("node").distinct()
    back = closure(edges, spark.range(1).select(F.explode(F.array(*map(F.lit, ends))).alias("id")), "child", "parent").select("node").distinct()
    return nodes.join(from_start, "node", "left_anti").withColumn("problem", F.lit("unreachable")).unionByName(nodes.join(back, "node", "left_anti").withColumn("problem", F.lit("no_end")))


def data_scope(df: DataFrame, mode: str, user, department, is_super: bool = False, field: str | None = None, edges: DataFrame | None = None, custom=None) -> DataFrame:
    """Rows that a user may see. mode: all, dept, dept_and_sub, self, custom. A super-user sees all; whatever is unclear raises."""
    if is_super or mode == "all":
        return df
    if mode == "custom":
        found = list(custom(user, department)) if custom else []
        if not found:
            raise ScopeError("DATA_SCOPE_UNSAFE_CUSTOM", "the custom scope gives no condition")
        for c in found:
            df = df.filter(c)
        return df
    if not field or field not in df.columns:
        raise ScopeError("DATA_SCOPE_INVALID_RULE", f"mode {mode} needs a field of the table")
    if mode == "dept":
        return df.filter(F.col(field) == F.lit(department))
    if mode == "self":
        return df.filter(F.col(field) == F.lit(user))
    if mode == "dept_and_sub" and edges is not None:
        below = closure(edges, df.sparkSession.range(1).select(F.lit(department).alias("id"))).select(F.col("node").alias(field))
        return df.join(below.distinct(), field, "left_semi").select(*df.columns)
    raise ScopeError("DATA_SCOPE_INVALID_RULE", f"unknown mode {mode} or no tree")
