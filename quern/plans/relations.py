"""Relations loaded as joins: one or many children, parents, many to many, polymorphic; naming rules for their keys."""

from __future__ import annotations

import operator
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snake(name: str) -> str:
    """An underscore before every capital but the first: HTTPServer is h_t_t_p_server."""
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def basename(name: str) -> str:
    return re.split(r"::|\\|/|\.", name)[-1]


def foreign_key(name: str) -> str:
    return f"{snake(basename(name))}_id"


def junction(current: str, related: str) -> str:
    """In the order given, not alphabetical."""
    return f"{snake(basename(current))}_{snake(basename(related))}"


def morph_columns(name: str) -> tuple[str, str]:
    return f"{name}_type", f"{name}_id"


def nested(path: str) -> tuple[str, str | None]:
    """A nested eager path at its first dot."""
    head, dot, tail = path.partition(".")
    return head, tail if dot else None


def _semi(rows: DataFrame, key: str, others: DataFrame, other: str) -> DataFrame:
    keys = others.select(F.col(other).alias("_key")).filter("_key IS NOT NULL")
    return rows.join(keys, rows[key] == F.col("_key"), "left_semi")


def has_many(children: DataFrame, parents: DataFrame, fk: str, pk: str) -> DataFrame:
    """The children of all the parents, by one semi join; no parents, no rows."""
    return _semi(children, fk, parents, pk)


def has_one(children: DataFrame, parents: DataFrame, fk: str, pk: str, order: list[Column]) -> DataFrame:
    """The first child of each parent."""
    first = Window.partitionBy(fk).orderBy(*order)
    return has_many(children, parents, fk, pk).withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")


def belongs_to(parents: DataFrame, children: DataFrame, fk: str, pk: str) -> DataFrame:
    """The parents that any child names."""
    return _semi(parents, pk, children, fk)


def belongs_to_many(related: DataFrame, links: DataFrame, pk: str, other: str, owners: Column) -> DataFrame:
    """related's columns for each link whose owner is wanted; duplicates stay, the link's columns don't."""
    wanted = links.filter(owners).select(F.col(other).alias("_other"))
    return related.join(wanted, related[pk] == F.col("_other")).select(*related.columns)


def morph_many(children: DataFrame, kind: str, type_column: str, id_column: str, parents: DataFrame, pk: str) -> DataFrame:
    return _semi(children.filter(F.col(type_column) == kind), id_column, parents, pk)


def morph_groups(rows: DataFrame, type_column: str, id_column: str) -> DataFrame:
    """type and ids (text): rows without a type or id, or with an empty one, are left out; true and false are 1 and 0."""
    c = F.col(id_column)
    text = F.when(c, "1").otherwise("0") if dict(rows.dtypes)[id_column] == "boolean" else c.cast("string")
    found = rows.select(F.col(type_column).alias("type"), F.when(c.isNotNull(), text).alias("_id")).filter("type IS NOT NULL AND _id IS NOT NULL AND _id <> ''")
    return found.groupBy("type").agg(F.sort_array(F.collect_list("_id")).alias("ids"))


def morph_to(rows: DataFrame, type_column: str, id_column: str, parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """rows with the columns of the parent that their type names; one join for each type."""
    parts = []
    for kind, (parent, pk) in parents.items():
        mine = rows.filter(F.col(type_column) == kind)
        parts.append(mine.join(parent, mine[id_column] == parent[pk]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_join(main: DataFrame, related: DataFrame, on: Column, columns: list[Column], how: str = "left") -> DataFrame:
    """Eager loading of a one-to-one relation; how: left or inner."""
    if how not in ("left", "inner"):
        raise ValueError(how)
    return main.join(related, on, how).select(*(main[c] for c in main.columns), *columns)


COMPARE = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt, "=": operator.eq, "!=": operator.ne}


def has_count(parents: DataFrame, children: DataFrame, pk: str, fk: str, op: str, n: int) -> DataFrame:
    """Parents whose number of children compares so; those without any child are none of them, as in an inner join."""
    counts = children.groupBy(F.col(fk).alias("_fk")).agg(F.count(fk).alias("_n")).filter(COMPARE[op](F.col("_n"), F.lit(n)))
    return parents.join(counts, parents[pk] == F.col("_fk"), "left_semi")


def composite(parents: DataFrame, children: DataFrame, pk: str, fk: str, item: Column, name: str) -> DataFrame:
    """Parents with all their children as a sorted array; an empty one for those without."""
    lists = children.groupBy(F.col(fk).alias("_fk")).agg(F.sort_array(F.collect_list(item)).alias(name))
    out = parents.join(lists, parents[pk] == F.col("_fk"), "left").drop("_fk")
    return out.withColumn(name, F.coalesce(name, F.array().cast(dict(lists.dtypes)[name])))


def cascade_delete(parents: DataFrame, children: DataFrame, pk: str, fk: str, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parents that are gone and their children."""
    dead = parents.filter(gone).select(F.col(pk).alias("_dead"))
    return parents.join(dead, parents[pk] == F.col("_dead"), "left_anti"), children.join(dead, children[fk] == F.col("_dead"), "left_anti")
