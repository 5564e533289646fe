"""Two small predicate languages, parsed on the driver and turned to Columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import number

LONGEST = 1024
TOKEN = re.compile(r"""\s*(?:(?P<string>'[^']*'|"[^"]*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<path>\$(?:\.[A-Za-z_]\w*)+)|(?P<word>[A-Za-z_][\w.]*)|(?P<sign>==|!=|>=|<=|>|<|\|\||&&|!|\(|\)))""")
#: How the template language spells comparisons: fixed values.
WORDS = {"eq": "==", "neq": "!=", "gt": ">", "lt": "<", "egt": ">=", "elt": "<=", "heq": "===", "nheq": "!=="}


class ExpressionError(ValueError):
    pass


def tokenize(text: str) -> list[tuple[str, str]]:
    if len(text) > LONGEST:
        raise ExpressionError("the expression is too long")
    out, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:].strip()[:10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Parser:
    """or < and < not < comparison. value: a token to a Column; compare: operator and two Columns to a Column; truth: a lone value to a Column."""

    def __init__(self, tokens, value: Callable, compare: Callable, truth: Callable):
        self.tokens, self.at, self.value, self.compare, self.truth = tokens, 0, value, compare, truth

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "sign") and self.tokens[self.at][1] in texts

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ExpressionError("the expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Column:
        out = self.either()
        if self.at < len(self.tokens):
            raise ExpressionError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self) -> Column:
        out = self.both()
        while self.peek("or", "||"):
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.negated()
        while self.peek("and", "&&"):
            self.take()
            out = out & self.negated()
        return out

    def negated(self) -> Column:
        if self.peek("not", "!"):
            self.take()
            return ~self.negated()
        if self.peek("("):
            self.take()
            out = self.either()
            if self.take()[1] != ")":
                raise ExpressionError("a parenthesis is not closed")
            return out
        return self.comparison()

    def comparison(self) -> Column:
        left = self.operand()
        if self.peek("==", "!=", ">", "<", ">=", "<=", *WORDS):
            sign = self.take()[1]
            return self.compare(WORDS.get(sign, sign), left, self.operand())
        return self.truth(left)

    def operand(self):
        kind, text = self.take()
        if kind == "word" and self.peek("("):
            raise ExpressionError("functions can't be called")
        if kind == "sign":
            raise ExpressionError(f"unexpected {text!r}")
        return self.value(kind, text)


def guard(expression: str, context: str) -> Column:
    """A guard over a JSON context column: strict equality, order between numbers only; an unknown path or a value that is no boolean raises."""
    parsed = F.parse_json(F.col(context))

    def value(kind: str, text: str):
        if kind == "string":
            return "string", F.lit(text[1:-1])
        if kind == "number":
            return "number", F.lit(float(text))
        if kind == "path":
            return "path", text
        if text in ("true", "false"):
            return "bool", F.lit(text == "true")
        if text == "null":
            return "null", None
        raise ExpressionError(f"unknown name {text!r}")

    def read(path: str, type_: str) -> Column:
        known = F.try_variant_get(parsed, path, "variant").isNotNull() | F.is_variant_null(F.try_variant_get(parsed, path, "variant"))
        return F.when(known, F.try_variant_get(parsed, path, type_)).otherwise(F.raise_error(F.lit(f"unknown path {path}")).cast(type_))

    types = {"string": "string", "number": "double", "bool": "boolean"}

    def compare(sign: str, a, b) -> Column:
        if a[0] == "path" and b[0] == "path":
            a, b = (("number", read(x[1], "double")) for x in (a, b))
        elif "path" in (a[0], b[0]):
            p, o = (a, b) if a[0] == "path" else (b, a)
            if o[0] == "null":
                same = F.is_variant_null(F.try_variant_get(parsed, p[1], "variant"))
                return same if sign == "==" else ~same
            got = (o[0], read(p[1], types[o[0]]))
            a, b = (got, b) if a[0] == "path" else (a, got)
        if sign in ("==", "!="):
            same = F.lit(False) if a[0] != b[0] else F.coalesce(a[1] == b[1], F.lit(False))
            return same if sign == "==" else ~same
        if a[0] != "number" or b[0] != "number":
            raise ExpressionError("only numbers have an order")
        return F.coalesce({">": a[1] > b[1], "<": a[1] < b[1], ">=": a[1] >= b[1], "<=": a[1] <= b[1]}[sign], F.lit(False))

    def truth(a) -> Column:
        if a[0] == "bool":
            return a[1]
        if a[0] == "path":
            return F.coalesce(read(a[1], "boolean"), F.raise_error(F.lit(f"{a[1]} is no boolean")).cast("boolean"))
        raise ExpressionError("the result is no boolean")

    return Parser(tokenize(expression), value, compare, truth).whole()


def template(expression: str, names: dict[str, Column]) -> Column:
    """A template condition over text Columns by name: loose equality, and an order in which what is no number is 0; heq and nheq compare text."""

    def value(kind: str, text: str) -> Column:
        if kind == "string":
            return F.lit(text[1:-1])
        if kind == "number":
            return F.lit(text)
        name = text.removeprefix("$.") if kind == "path" else text
        if name in ("true", "false", "null"):
            return {"true": F.lit("1"), "false": F.lit(""), "null": F.lit(None).cast("string")}[name]
        return names.get(name, F.lit(None)).cast("string")

    def compare(sign: str, a: Column, b: Column) -> Column:
        x, y = number(a), number(b)
        if sign in ("===", "!=="):
            return a.eqNullSafe(b) if sign == "===" else ~a.eqNullSafe(b)
        if sign in ("==", "!="):
            same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a.eqNullSafe(b))
            return same if sign == "==" else ~same
        p, q = F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))
        return {">": p > q, "<": p < q, ">=": p >= q, "<=": p <= q}[sign]

    def truth(a: Column) -> Column:
        return F.coalesce(~a.isin("", "0", "false"), F.lit(False))

    return Parser(tokenize(expression), value, compare, truth).whole()


def all_guards(expressions: list[str], context: str) -> Column:
    return reduce(lambda a, b: a & b, (guard(e, context) for e in expressions), F.lit(True))
