"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_template(sql: Column) -> Column:
    """Quoted strings and runs of digits become ?; an unclosed quote takes the rest."""
    return F.regexp_replace(sql, """'[^']*'?|"[^"]*"?|[0-9][0-9.]*""", "?")


def snake(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "(?<!^)(?=[A-Z])", "_"))


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^:./\\]+)$", 1)


def foreign_key(c: Column) -> Column:
    return F.concat(snake(basename(c)), F.lit("_id"))


def capitalize(c: Column) -> Column:
    """The first letter only; the tail stays as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def pascal(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "_"), capitalize), "")


def camel(c: Column) -> Column:
    p = pascal(c)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))


def kebab(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "(?<!^)(?=[A-Z])", "-"))


def pluralize(c: Column) -> Column:
    return F.when(c == "", c).when(c.endswith("s"), c).when(c.endswith("y"), F.concat(F.regexp_replace(c, "y$", ""), F.lit("ies"))).otherwise(F.concat(c, F.lit("s")))


def singularize(c: Column) -> Column:
    return F.when(c.endswith("ies") & (F.length(c) > 3), F.regexp_replace(c, "ies$", "y")).when(c.endswith("ss"), c).when(c.endswith("s"), F.regexp_replace(c, "s$", "")).otherwise(c)


#: A number as a strict parser takes it: no blanks around.
NUMBER = r"^[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


def is_numeric(c: Column) -> Column:
    return F.coalesce(c.rlike(NUMBER), F.lit(False))


def number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def quoted_key(c: Column) -> Column:
    """A key for SQL text: numbers as they are, else quoted with doubled quotes."""
    return F.when(is_numeric(c), c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")))


def loose_equal(a: Column, b: Column) -> Column:
    """As numbers if both are, else as text."""
    x, y = number(a), number(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a == b)


def loose_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    x, y = number(a), number(b)
    sign = lambda p, q: F.when(p < q, -1).when(p > q, 1).otherwise(0)
    return F.when(x.isNotNull() & y.isNotNull(), sign(x, y)).otherwise(sign(a, b))


def as_text(flag: Column) -> Column:
    """A boolean as text: 1 for true, empty for false and null."""
    return F.when(flag, "1").otherwise("")


def is_empty(text: Column) -> Column:
    return text.isNull() | text.isin("", "0", "[]", "{}", "false")


def parse_ids(c: Column) -> Column:
    """array<bigint> from a JSON array, a comma list or one number; parts that are no numbers are dropped."""
    parts = F.transform(F.split(F.regexp_replace(c, r'[\[\]"\s]', ""), ","), lambda p: p.try_cast("bigint"))
    return F.coalesce(F.filter(parts, lambda p: p.isNotNull()), F.array().cast("array<bigint>"))


def csv_ids(c: Column) -> Column:
    """As parse_ids, but zeros go too."""
    return F.filter(parse_ids(c), lambda p: p != 0)


#: Digits of Chinese numerals: fixed values.
DIGITS = "零壹贰叁肆伍陆柒捌玖"


def money_digits(c: Column) -> Column:
    """An amount as Chinese numerals: its two decimals, then its whole digits from the last to the first; null if it is no plain amount."""
    whole, part = F.regexp_extract(c, r"^([0-9]*)", 1), F.regexp_extract(c, r"[.]([0-9]*)$", 1)
    digits = F.filter(F.split(F.concat(F.rpad(part, 2, "0"), F.reverse(whole)), ""), lambda d: d != "")
    table = F.array(*map(F.lit, DIGITS))
    return F.when(c.rlike(r"^[0-9]*([.][0-9]*)?$"), F.transform(digits, lambda d: F.element_at(table, d.cast("int") + 1)))


#: Formats of timestamps, in the order in which they are tried: fixed values.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_timestamp(c: Column) -> Column:
    """From RFC 3339, the formats above, or whole seconds since the epoch; else null. For a session in UTC."""
    rfc = F.when(c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), c.try_cast("timestamp"))
    return F.coalesce(rfc, *(F.try_to_timestamp(c, F.lit(f)) for f in FORMATS), F.when(c.rlike(r"^-?[0-9]+$"), F.timestamp_seconds(c.try_cast("bigint"))))


#: Letters of PHP date formats and their patterns: fixed values.
PHP = {"Y": "yyyy", "y": "yy", "m": "MM", "n": "M", "d": "dd", "j": "d", "H": "HH", "G": "H", "i": "mm", "s": "ss", "a": "a", "A": "a"}


def date_pattern(php: str) -> str:
    """A backslash takes the next letter as it is."""
    out, letters = "", iter(php)
    for c in letters:
        plain = next(letters, "") if c == "\\" else c
        out += PHP[c] if c in PHP else f"'{plain}'" if plain.isalpha() else plain
    return out


def query_params(c: Column) -> Column:
    """map<string,string> of a query string, decoded."""
    pairs = F.transform(F.filter(F.split(c, "&"), lambda p: p != ""), lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)), F.when(p.contains("="), F.try_url_decode(F.regexp_extract(p, "=(.*)$", 1))).otherwise("")))
    return F.map_from_entries(pairs)


def cache_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def backoff_ms(attempts: Column, base: float, cap: float, jitter: float = 0.0, u: Column | None = None) -> Column:
    wait = F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(attempts, F.lit(6)).cast("double")), F.lit(cap))
    return F.floor(wait * (1 + F.lit(jitter) * (F.lit(0.0) if u is None else u)) * 1000).cast("long")


def finite(c: Column) -> Column:
    """null for what JSON has no number for."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def json_type(text: Column) -> Column:
    s = F.schema_of_variant(F.try_parse_json(text))
    return F.when(s.isNull(), None).when(s == "VOID", "null").when(s == "BOOLEAN", "boolean").when(s.isin("BIGINT"), "integer").when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "number").when(s == "STRING", "string").when(s.startswith("ARRAY"), "array").otherwise("object")


def masked(c: Column, kind: str) -> Column:
    """A sensitive value of a kind (string, int, float, bool) blotted out; null stays."""
    blank = {"string": F.lit("***"), "int": F.lit(0), "float": F.lit(0.0), "bool": F.lit(False)}[kind]
    return F.when(c.isNotNull(), blank)


def masked_deep(c: Column, kind, names: set[str], keep: set[str] = frozenset(), hit: bool = False) -> Column:
    """c of the Spark type kind with the sensitive fields among names blotted out at every depth; the fields of keep never are."""
    from pyspark.sql import types as T

    if isinstance(kind, T.StructType):
        inner = (masked_deep(c[f.name], f.dataType, names, keep, (hit or f.name in names) and f.name not in keep).alias(f.name) for f in kind.fields)
        return F.when(c.isNotNull(), F.struct(*inner))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: masked_deep(x, kind.elementType, names, keep, hit))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: F.when(k.isin(*names), masked_deep(v, kind.valueType, names, keep, True)).otherwise(masked_deep(v, kind.valueType, names, keep, hit)))
    if not hit:
        return c
    if isinstance(kind, T.StringType):
        return masked(c, "string")
    if isinstance(kind, T.BooleanType):
        return masked(c, "bool")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return masked(c, "float").cast(kind)
    return masked(c, "int").cast(kind) if isinstance(kind, T.IntegralType) else F.lit(None).cast(kind)


def masked_map(c: Column, names: set[str]) -> Column:
    """A map of headers or audit fields with the values of sensitive keys, in any case, blotted out."""
    return F.transform_values(c, lambda k, v: F.when(F.lower(k).isin(*(n.lower() for n in names)), F.lit("***")).otherwise(v))


def bound_text(c: Column) -> Column:
    """A histogram bound as text."""
    return F.when(c == float("inf"), "+Inf").otherwise(c.cast("string"))
