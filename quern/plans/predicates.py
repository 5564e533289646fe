"""Declarative predicates: conjunctions, alternatives, optional filters, containment, sampling."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import identifier


@dataclass(frozen=True)
class Where:
    """One condition: field, op (eq, ne, gt, ge, lt, le, in, not_in, like, null, not_null, between), value."""

    field: str
    op: str
    value: Any = None

    def column(self) -> Column:
        c, v = F.col(identifier(self.field)), self.value
        compare = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le}
        if self.op in compare:
            return compare[self.op](c, F.lit(v))
        if self.op in ("in", "not_in"):  # an empty list is IN (NULL): no row either way
            found = c.isin(*v) if len(v) else F.lit(None).cast("boolean")
            return ~found if self.op == "not_in" else found
        if self.op == "between":
            return c.between(*v)
        if self.op == "like":
            return c.like(v)
        if self.op in ("null", "not_null"):
            return c.isNull() if self.op == "null" else c.isNotNull()
        raise ValueError(f"unknown operator {self.op!r}")


def all_of(conditions) -> Column:
    return reduce(operator.and_, (c.column() if isinstance(c, Where) else c for c in conditions), F.lit(True))


def any_of(conditions) -> Column:
    return reduce(operator.or_, (c.column() if isinstance(c, Where) else c for c in conditions), F.lit(False))


def find_by(df: DataFrame, conditions, alternatives=()) -> DataFrame:
    """Rows that meet all conditions and at least one of the alternatives; no alternatives, no such restriction."""
    alternatives = list(alternatives)
    kept = df.filter(all_of(conditions))
    return kept.filter(any_of(alternatives)) if alternatives else kept


def optional(field: str, op: str, value) -> list[Where]:
    """The condition, or none when the value is absent or blank."""
    return [] if value is None or isinstance(value, str) and not value.strip() else [Where(field, op, value.strip() if isinstance(value, str) else value)]


def date_range(field: str, start=None, end=None) -> list[Where]:
    """Both ends are inside."""
    return optional(field, "ge", start) + optional(field, "le", end)


def contains(field: str, keyword: str | None) -> list[Where]:
    """LIKE %keyword% after trimming; no condition for a blank keyword. What LIKE treats as special is escaped."""
    word = (keyword or "").strip()
    escaped = word.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return [Where(field, "like", f"%{escaped}%")] if word else []


def contains_any_case(keyword: str, *fields: str) -> Column:
    return any_of(F.lower(F.col(f)).contains(keyword.lower()) for f in fields)


def has_all(tags: str, wanted: list) -> Column:
    """Whether the array holds all that is wanted."""
    return F.forall(F.array(*map(F.lit, wanted)), lambda t: F.array_contains(F.col(tags), t)) if wanted else F.lit(True)


def excluded(field: str, names: list) -> Column:
    return ~F.col(field).isin(*names) if names else F.lit(True)


def sampled(df: DataFrame, always: Column, rate: float, key: str) -> DataFrame:
    """Rows that always stay, and a share rate of the others by a hash of their key (none at 0 or less, all at 1 or more), the same ones whatever the partitions."""
    if rate >= 1:
        return df
    chosen = F.md5(F.col(key).cast("string")) < F.lit(f"{round(rate * 2**32):08x}")
    return df.filter(always if rate <= 0 else always | chosen)


def member_with_status(members: str, wanted, status: str, value) -> Column:
    """Whether the array holds the wanted member and the row has the status; false where either is null."""
    return F.coalesce(F.array_contains(F.col(members), wanted) & (F.col(status) == value), F.lit(False))


def event_class(status: Column) -> Column:
    return F.when(status == 401, "AuthFailure").when(status == 403, "AccessDenied").when(status == 413, "BodyTooLarge").otherwise("HttpRequest")
