"""Order, pages and top-k; every order has a key to break ties, so that pages are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of a page; page 0 is page 1, and a page past the end is empty."""
    return df.orderBy(*order).offset(max(number - 1, 0) * size).limit(size)


def page_with_total(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page's rows with the total of all rows, from one plan; the total is a one-row aggregate, broadcast."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return page(df, order, number, size).join(F.broadcast(total))


def listing(df: DataFrame, sort: str, key: str, number: int = 1, size: int = 20, export: bool = False, limit: int | None = None) -> DataFrame:
    """By sort ascending, missing as 0, then key; an export has no pages, but may have a limit."""
    order = [F.coalesce(F.col(sort), F.lit(0)).asc(), F.col(key).asc()]
    if export:
        return df.orderBy(*order) if limit is None else df.orderBy(*order).limit(limit)
    return page(df, order, number, size)


def top(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(key)).limit(k)


def top_per(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)
