"""Row validation: rule strings to boolean Columns, and the list of what each row fails."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import is_numeric, loose_compare, loose_equal, number, parse_timestamp

#: Patterns of rules: fixed values.
CHINESE = r"\x{4e00}-\x{9fa5}\x{9fa6}-\x{9fef}\x{3400}-\x{4db5}\x{20000}-\x{2ebe0}"
PATTERNS = {
    "alpha": r"^[A-Za-z]+$",
    "alphaNum": r"^[A-Za-z0-9]+$",
    "alphaDash": r"^[A-Za-z0-9\-_]+$",
    "chs": f"^[{CHINESE}]+$",
    "chsAlpha": f"^[{CHINESE}a-zA-Z]+$",
    "chsAlphaNum": f"^[{CHINESE}a-zA-Z0-9]+$",
    "chsDash": rf"^[{CHINESE}a-zA-Z0-9_\-]+$",
    "mobile": r"^1[3-9]\d{9}$",
    "idCard": r"(^[1-9]\d{5}(18|19|([23]\d))\d{2}((0[1-9])|(10|11|12))(([0-2][1-9])|10|20|30|31)\d{3}[0-9Xx]$)|(^[1-9]\d{5}\d{2}((0[1-9])|(10|11|12))(([0-2][1-9])|10|20|30|31)\d{3}$)",
    "zip": r"\d{6}",
    "email": r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$",
    "url": r"^(http://|https://|ftp://|ftps://|mailto:|tel:|file://)",
    "macAddr": r"^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$",
    "integer": r"^[+-]?[0-9]+$",
    "ipv4": r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])[.]){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$",
    "ipv6": r"^(([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(([0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{1,4})?::(([0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{1,4})?)$",
}
CALLBACKS: dict[str, Callable[[Column], Column]] = {}


def parse_rules(text: str) -> list[tuple[str, list[str]]]:
    """name:a,b|name2 to names and arguments; a regex keeps its commas and bars to its end."""
    out = []
    while text:
        if text.startswith("regex:"):
            return [*out, ("regex", [text[6:]])]
        one, _, text = text.partition("|")
        name, _, args = one.partition(":")
        out.append((name, args.split(",") if args else []))
    return out


def is_kind(v: Column, kind: str) -> Column:
    if kind == "accepted":
        return v.isin("yes", "on", "1")
    if kind == "date":
        return parse_timestamp(v).isNotNull()
    if kind in ("boolean", "bool"):
        return v.isin("1", "0")
    if kind in ("number", "float"):
        return is_numeric(v)
    if kind == "integer":
        return v.rlike(PATTERNS["integer"]) & v.try_cast("bigint").isNotNull()
    if kind == "array":
        return v.rlike(r"^\s*\[")
    if kind == "ip":
        return v.rlike(PATTERNS["ipv4"]) | v.rlike(PATTERNS["ipv6"])
    return v.rlike(PATTERNS[kind]) if kind in PATTERNS else F.lit(True)  # an unknown name passes


def whole(text: str) -> int:
    """A bound; 0 if it is no whole number."""
    return int(text) if re.fullmatch(r"[+-]?[0-9]+", text.strip()) else 0


def check(field: str, name: str, args: list[str], now: Column | None = None, kind: T.DataType | None = None) -> Column:
    """Whether a row meets one rule. kind: the field's type, if it is known; arrays and maps are measured by their elements."""
    v = F.col(field).cast("string")
    lits = [F.lit(a) for a in args]
    other = F.col(args[0]).cast("string") if args and re.fullmatch(r"\w+", args[0]) and not args[0].isdigit() else None
    present = v.isNotNull() & (v != "")
    if name in ("require", "must"):
        return present
    if name == "requireIf":
        return present | ~F.coalesce(loose_equal(other, lits[1]), F.lit(False))
    if name in ("requireWith", "requireWithout"):
        given = other.isNotNull() & (other != "")
        return present | (~given if name == "requireWith" else given)
    if name == "eq":
        return loose_equal(v, lits[0])
    if name in ("gt", "egt", "lt", "elt"):
        c = loose_compare(v, other)
        return {"gt": c > 0, "egt": c >= 0, "lt": c < 0, "elt": c <= 0}[name] & other.isNotNull()
    if name == "confirm":
        return v.eqNullSafe(other)
    if name == "different":
        return ~F.coalesce(loose_equal(v, other), F.lit(False))
    if name in ("in", "notIn"):
        hit = F.lit(False)
        for x in lits:
            hit = hit | loose_equal(v, x)
        return hit if name == "in" else ~hit
    if name in ("between", "notBetween"):
        if len(args) < 2:
            return F.lit(name == "notBetween")
        inside = (loose_compare(v, lits[0]) >= 0) & (loose_compare(v, lits[1]) <= 0)
        return inside if name == "between" else ~inside
    if name in ("length", "max", "min"):
        n = F.size(F.col(field)) if isinstance(kind, (T.ArrayType, T.MapType)) else F.length(v)
        bounds = [whole(a) for a in args]
        if name == "length":
            return (n == bounds[0]) if len(args) == 1 else n.between(bounds[0], bounds[1])
        return n <= bounds[0] if name == "max" else n >= bounds[0]
    if name == "dateFormat":
        from .scalars import date_pattern

        return F.try_to_timestamp(v, F.lit(date_pattern(args[0]))).isNotNull()
    if name in ("after", "before"):
        t, limit = parse_timestamp(v), parse_timestamp(F.lit(",".join(args)))
        return F.coalesce(t >= limit if name == "after" else t <= limit, F.lit(False))
    if name in ("afterWith", "beforeWith"):
        t, limit = parse_timestamp(v), parse_timestamp(other)
        return F.coalesce(t >= limit if name == "afterWith" else t <= limit, F.lit(False))
    if name == "expire":
        now = F.current_timestamp() if now is None else now
        return F.coalesce(now.between(parse_timestamp(lits[0]), parse_timestamp(lits[1])), F.lit(False))
    if name == "ip":
        return v.rlike(PATTERNS["ipv6" if args == ["ipv6"] else "ipv4"])
    if name in ("allowIp", "denyIp"):
        listed = v.isin(*(a.strip() for a in args))
        return listed if name == "allowIp" else ~listed
    if name == "regex":
        return v.rlike(args[0])
    if name in CALLBACKS:
        return CALLBACKS[name](F.col(field))
    asked = args[0] if name == "is" else name
    if isinstance(kind, T.BooleanType) and asked in ("boolean", "bool"):
        return F.col(field).isNotNull()
    if isinstance(kind, T.ArrayType) and asked == "array":
        return F.col(field).isNotNull()
    return is_kind(v, asked)


def field_failure(field: str, rules: str, kind: T.DataType | None = None) -> Column:
    """The name of the first rule that the field fails, or null. Absent and empty values only meet must and require rules."""
    v = F.col(field).cast("string")
    absent = v.isNull() | (v == "")
    out = F.lit(None).cast("string")
    for name, args in reversed(parse_rules(rules)):
        ok = F.coalesce(check(field, name, args, kind=kind), F.lit(False))
        if not (name == "must" or name.startswith("require")):
            ok = ok | absent
        out = F.when(~ok, F.lit(name)).otherwise(out)
    return out


def failures(df: DataFrame, rules: dict[str, str], scene: list[str] | None = None, batch: bool = True) -> Column:
    """array<string> of field:rule, one for each field that fails; only the first one unless batch. scene: the fields to check."""
    checked = [(f, r) for f, r in rules.items() if scene is None or f in scene]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    each = [F.concat(F.lit(f"{f}:"), field_failure(f, r, kinds.get(f))) for f, r in checked]
    found = F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")
    return found if batch else F.slice(found, 1, 1)


def validated(df: DataFrame, rules: dict[str, str], **options) -> DataFrame:
    return df.withColumn("failures", failures(df, rules, **options))


def non_negative(items: str, *fields: str) -> Column:
    """Whether no item of an array of structs has a negative field."""
    bad = lambda x: F.greatest(*(F.when(x[f] < 0, 1).otherwise(0) for f in fields), F.lit(0)) > 0
    return ~F.exists(F.col(items), bad)


__all__ = ["CALLBACKS", "check", "failures", "field_failure", "is_kind", "non_negative", "number", "parse_rules", "validated"]
