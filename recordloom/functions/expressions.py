"""Compute expressions over fields, compiled to columns.

The language has + - * / with the usual precedence, unary minus,
parentheses, double-quoted texts, numbers, true, false, null, fields, and the
functions concat, lower, upper, trim and coalesce. Unknown functions and wrong
numbers of arguments are found when a plan is built.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ExpressionError, TransformError, failure
from .values import Value, finite

_TOKEN = re.compile(r'\s*(?:(?P<text>"(?:[^"\\]|\\.)*")|(?P<number>[0-9][0-9.]*)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign>[(),+*/-])|(?P<end>$))', re.S)
#: Escapes of texts; words that are values.
_ESCAPES = {'"': '"', "\\": "\\", "n": "\n", "r": "\r", "t": "\t"}
_WORDS = {"true": (True, "bool"), "false": (False, "bool"), "null": (None, "null")}
_LEVEL = {"+": 1, "-": 1, "*": 2, "/": 2}
#: White space of all scripts, at either end.
_ENDS = r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$"


def fail(what: str) -> Column:
    return failure(TransformError, what)


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while True:
        m = _TOKEN.match(source, at)
        if not m:
            raise ExpressionError(f"unexpected character at {at} in {source!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        if m.lastgroup == "end":
            return out
        at = m.end()


class _Compiler:
    """Reads tokens by precedence and gives a Value for each part."""

    def __init__(self, source: str, fields: Mapping[str, Value]):
        self.source, self.fields, self.tokens, self.at = source, fields, _tokens(source), 0

    def error(self, what: str) -> ExpressionError:
        return ExpressionError(f"{what} in {self.source!r}")

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, sign: str) -> None:
        if self.take() != ("sign", sign):
            raise self.error(f"expected {sign!r}")

    def peek(self) -> str:
        kind, text = self.tokens[self.at]
        return text if kind == "sign" else ""

    def binary(self, least: int = 1) -> Value:
        left = self.unary()
        while _LEVEL.get(self.peek(), 0) >= least:
            sign = self.take()[1]
            left = self.arithmetic(sign, left, self.binary(_LEVEL[sign] + 1))
        return left

    def unary(self) -> Value:
        if self.peek() == "-":
            self.take()
            return Value(finite(-self.number(self.unary())), "float")
        return self.primary()

    def primary(self) -> Value:
        kind, text = self.take()
        if kind == "sign" and text == "(":
            inner = self.binary()
            self.expect(")")
            return inner
        if kind == "text":
            return Value(F.lit(re.sub(r"\\(.)", self.escaped, text[1:-1], flags=re.S)), "text")
        if kind == "number":
            try:
                return Value(F.lit(float(text)), "float")
            except ValueError:
                raise self.error(f"{text!r} is no number") from None
        if kind == "name" and self.peek() == "(":
            return self.call(text)
        if kind == "name":
            if text in _WORDS:
                value, kind = _WORDS[text]
                return Value(F.lit(value), kind)
            return self.fields.get(text, Value(F.lit(None), "null"))
        raise self.error(f"unexpected {text or 'end'!r}")

    def escaped(self, m: re.Match) -> str:
        if m[1] not in _ESCAPES:
            raise self.error(f"unknown escape \\{m[1]}")
        return _ESCAPES[m[1]]

    def number(self, value: Value) -> Column:
        """Null, lists, objects and texts that are no numbers are errors."""
        return F.coalesce(value.number(), fail(f"not a number in {self.source!r}").cast("double"))

    def arithmetic(self, sign: str, left: Value, right: Value) -> Value:
        a, b = self.number(left), self.number(right)
        if sign == "/":
            return Value(finite(F.coalesce(F.try_divide(a, b), F.lit(0.0))), "float")
        return Value(finite({"+": a + b, "-": a - b, "*": a * b}[sign]), "float")

    def call(self, name: str) -> Value:
        self.expect("(")
        args = []
        if self.peek() != ")":
            args.append(self.binary())
            while self.peek() == ",":
                self.take()
                args.append(self.binary())
        self.expect(")")
        if name in ("lower", "upper", "trim"):
            if len(args) != 1:
                raise self.error(f"{name} takes one argument")
            text = F.coalesce(args[0].only_text(), fail(f"{name} takes a text in {self.source!r}").cast("string"))
            return Value({"lower": F.lower, "upper": F.upper, "trim": lambda c: F.regexp_replace(c, _ENDS, "")}[name](text), "text")
        if name == "concat":
            return Value(F.concat_ws("", *(a.json_text() for a in args)) if args else F.lit(""), "text")
        if name == "coalesce":
            return self.first_of(args)
        raise self.error(f"unknown function {name!r}")

    def first_of(self, args: list[Value]) -> Value:
        args = [a for a in args if a.kind != "null"]
        if not args:
            return Value(F.lit(None), "null")
        kinds = {a.kind for a in args}
        if len(kinds) == 1 and kinds != {"variant"} and kinds != {"complex"}:
            return Value(F.coalesce(*(a.column for a in args)), args[0].kind)
        as_variant = [F.when(~a.is_null(), a.column if a.kind == "variant" else F.parse_json(F.to_json(a.column)) if a.kind == "complex" else F.to_variant_object(F.array(a.column))) for a in args]
        unpacked = [v if a.kind in ("variant", "complex") else F.try_variant_get(v, "$[0]", "variant") for a, v in zip(args, as_variant)]
        return Value(F.coalesce(*unpacked), "variant")


def compile_expression(source: str, fields: Mapping[str, Value]) -> Value:
    """The value of an expression over the given fields; fields that are not given are null."""
    compiler = _Compiler(source, fields)
    value = compiler.binary()
    if compiler.take()[0] != "end":
        raise compiler.error("something follows the expression")
    return value
