"""Aggregations: completed dimensions, snapshots, histograms, safe ratios, latest versions, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.predicates import all_of, date_range
from ..sources.tables import identifier


def literal_rows(spark, column: str, values: list) -> DataFrame:
    """One row for each value, with its place in _pos."""
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, values))).alias("_pos", column))


def completed(df: DataFrame, dimension: str, values: list, **sums: str) -> DataFrame:
    """Per value of a fixed list, in its order: count and sums; 0 for values that no row has."""
    found = df.filter(F.col(dimension).isin(*values)).groupBy(dimension).agg(F.count(F.lit(1)).alias("count"), *(F.sum(c).alias(n) for n, c in sums.items()))
    out = literal_rows(df.sparkSession, dimension, values).join(found, dimension, "left")
    return out.select("_pos", dimension, *(F.coalesce(n, F.lit(0)).alias(n) for n in ("count", *sums))).orderBy("_pos").drop("_pos")


def status_snapshot(df: DataFrame, status: str, statuses: list, since: str, pending: str, now_ms: int) -> DataFrame:
    """One row: how many of each status, and the age in seconds of the oldest pending one, at least 0."""
    oldest = F.min(F.when(F.col(status) == pending, F.col(since)))
    return df.agg(*(F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses), F.floor(F.greatest(F.coalesce(F.lit(now_ms) - oldest, F.lit(0)), F.lit(0)) / 1000).cast("long").alias("oldest_seconds"))


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts of values up to each bound, +Inf last, with sum and count; one pass, one row for each bound."""
    bounds = sorted(bounds)
    one = df.agg(*(F.count_if(F.col(value) <= b).alias(f"_{k}") for k, b in enumerate(bounds)), F.count(value).alias("count"), F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"))
    rows = [F.struct(F.lit(format(b, "g")).alias("le"), F.col(f"_{k}").alias("bucket")) for k, b in enumerate(bounds)]
    return one.select(F.explode(F.array(*rows, F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket")))).alias("_b"), "sum", "count").select("_b.*", "sum", "count")


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def latest(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of the largest version of each key."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), version).alias("_row")).select("_row.*")


def grouped_in_order(df: DataFrame, key: list[str], order: str, value: str, out: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(*key).agg(F.transform(pairs, lambda x: x[value]).alias(out))


def means_in_order(df: DataFrame, key: list[str], order: list[str], **means: str) -> DataFrame:
    """Means of doubles that are summed up row by row in an order: by rounding, another order may give others. Null if there is no value.

    The running mean at a key's last row; rows are sorted and not gathered, so a large key takes time and no memory.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = df.select(*key, *(F.avg(c).over(upto).alias(n) for n, c in means.items()), F.lead(F.lit(True)).over(w).alias("_more"))
    return running.filter("_more IS NULL").drop("_more")


def approval(status: str, completed: str = "completed", rejected: str = "rejected", pending: str = "pending") -> tuple[Column, Column]:
    """The verdicts when all must sign and when one is enough, over the rows of a group."""
    c = F.col(status)
    known = c.isin(completed, rejected, pending)
    all_sign = F.when(F.bool_or(c == rejected), "Rejected").when(F.coalesce(F.every(F.when(known, c == completed)), F.lit(False)), "Completed").otherwise("InProgress")
    any_sign = F.when(F.bool_or(c == completed), "Completed").when(F.every(c == rejected), "Rejected").otherwise("InProgress")
    return all_sign, any_sign


def nearest_index(df: DataFrame, value: str, percents: list[int], group: list[str] = ()) -> DataFrame:
    """Percentiles by the element at min(floor(n p / 100), n - 1) of the sorted values; no interpolation.

    Rows are numbered by a sort inside each group; without groups, values are counted first, so what one task sorts
    grows with the number of different values and not of rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(*group)
    ranked = counts.withColumn("_upto", F.sum("_n").over(by.orderBy(value))).withColumn("_all", F.sum("_n").over(by))
    at = lambda p: F.least(F.floor(F.col("_all") * p / 100), F.col("_all") - 1)
    return ranked.groupBy(*group).agg(*(F.coalesce(F.min(F.when(F.col("_upto") > at(p), F.col(value))), F.lit(0.0)).alias(f"p{p}") for p in percents))


def id_list(df: DataFrame, group: list[str], ids: str, out: str) -> DataFrame:
    """Sorted ids joined by commas."""
    return df.groupBy(*group).agg(F.array_join(F.sort_array(F.collect_set(ids)), ",").alias(out))


def report(df: DataFrame, dimensions: list[str], metrics: dict[str, Column], date: str | None = None, date_from=None, date_to=None, sort: str | None = None, descending: bool = True, page: int = 1, size: int = 20) -> DataFrame:
    """Sums of metrics by dimensions, within dates (ends inside), sorted, one page (size held to 1 to 100). Null dimensions are a group; ties go by dimensions."""
    size = min(max(size, 1), 100)
    rows = df.filter(all_of(date_range(date, date_from, date_to))) if date else df
    out = rows.groupBy(*map(identifier, dimensions)).agg(*(F.sum(c).alias(identifier(n)) for n, c in metrics.items()))
    key = F.col(sort or next(iter(metrics)))
    return out.orderBy(key.desc() if descending else key.asc(), *dimensions).offset((max(page, 1) - 1) * size).limit(size)
