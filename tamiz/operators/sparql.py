"""SPARQL text to DataFrame plans over a table of triples (s, p, o, tipo, lengua).

A query is parsed to a tree and the tree to joins, filters and aggregates of the
triple table, so that Catalyst sees one declarative plan: constants of a pattern
are filters below its join, a group's patterns are joined on the variables they
share, OPTIONAL is a left join, UNION a union by name.

Read are PREFIX, SELECT [DISTINCT] with variables, ``*`` and ``(expression AS ?x)``,
basic patterns with ``a``, ``;`` and ``,``, groups, OPTIONAL, UNION, MINUS, FILTER, BIND,
GROUP BY, HAVING, ORDER BY, LIMIT and OFFSET; operators and the functions and
aggregates in ``FUNCTIONS`` and ``AGGREGATES``. Anything else is a ``ValueError``.

Defined results: every variable is a column of the lexical forms of its terms,
null where unbound; comparisons with a number compare numbers, a form that is
none fits no comparison; patterns that share no variable with those before are
refused, as they would make a cross join; an empty triple table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.operators.graph import RDF_TYPE

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>\s]*>)
    |(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    |(?P<tag>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<var>[?$]\w+)
    |(?P<number>[+-]?(?:\d+\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<name>[A-Za-z_][\w-]*:(?:[\w.-]*[\w-])?|:[\w-]+|_:\w+)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<mark>\^\^|&&|\|\||!=|<=|>=|[][{}().;,*/=<>!+-])""",
    re.VERBOSE,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}

#: Functions by name: arguments (columns) -> column.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "STR": lambda x: x.cast("string"), "LCASE": F.lower, "UCASE": F.upper, "STRLEN": F.length, "CONTAINS": lambda x, y: F.contains(x, y), "STRSTARTS": F.startswith, "STRENDS": F.endswith,
    "CONCAT": lambda *x: F.concat(*x), "COALESCE": lambda *x: F.coalesce(*x), "BOUND": lambda x: x.isNotNull(), "ABS": lambda x: F.abs(x.cast("double")), "ROUND": lambda x: F.round(x.cast("double")),
    "IF": lambda c, x, y: F.when(c, x).otherwise(y), "YEAR": lambda x: F.year(F.try_to_date(F.substring(x, 1, 10))), "MONTH": lambda x: F.month(F.try_to_date(F.substring(x, 1, 10))),
    "SUBSTR": lambda x, a, n=None: F.substring(x, a.cast("int"), n.cast("int") if n is not None else F.length(x)),
    "REGEX": lambda x, p, flags=None: F.regexp_like(x, p if flags is None else F.concat(F.lit("(?"), flags, F.lit(")"), p)),
}
#: Aggregates by name: (argument, distinct, separator) -> column.
AGGREGATES: dict[str, Callable[[Column, bool, str], Column]] = {
    "COUNT": lambda x, distinct, _: F.countDistinct(x) if distinct else F.count(x), "SUM": lambda x, distinct, _: F.sum_distinct(x.cast("double")) if distinct else F.sum(x.cast("double")),
    "AVG": lambda x, distinct, _: F.avg(x.cast("double")), "MIN": lambda x, distinct, _: F.min(x), "MAX": lambda x, distinct, _: F.max(x), "SAMPLE": lambda x, distinct, _: F.min(x),
    "GROUP_CONCAT": lambda x, distinct, separator: F.array_join(F.array_sort((F.collect_set if distinct else F.collect_list)(x.cast("string"))), separator),
}


class Parser:
    """Recursive descent over the tokens of one query; nodes are tuples."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise ValueError(f"unexpected text at {text[at : at + 20]!r}")
            if found.lastgroup:
                self.tokens.append((found.lastgroup, found[0]))
            at = found.end()
        self.at = 0
        self.prefixes: dict[str, str] = {}
        #: Datatype of the literal read last.
        self.datatype: str | None = None

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> str | None:
        """The next token if it is one of ``wanted`` (words in any case)."""
        kind, text = self.peek()
        if (text.upper() if kind == "word" else text) in wanted:
            self.at += 1
            return text.upper() if kind == "word" else text
        return None

    def need(self, *wanted: str) -> str:
        found = self.take(*wanted)
        if found is None:
            raise ValueError(f"expected {' or '.join(wanted)} before {self.peek()[1]!r}")
        return found

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def variable(self) -> str:
        kind, text = self.next()
        if kind != "var":
            raise ValueError(f"expected a variable, not {text!r}")
        return text[1:]

    # Terms: ("var", name), ("uri", iri), ("literal", text, language), ("number", value).
    def term(self) -> tuple:
        kind, text = self.next()
        if kind == "var":
            return ("var", text[1:])
        if kind == "iri":
            return ("uri", text[1:-1])
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return ("uri", self.prefixes[prefix] + local)
        if kind == "string":
            value = re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), text[1:-1])
            self.datatype = None
            if self.peek()[0] == "tag":
                return ("literal", value, self.next()[1][1:])
            if self.take("^^"):
                self.datatype = self.term()[1]
            return ("literal", value, None)
        if kind == "number":
            return ("number", text)
        if kind == "word" and text.lower() in ("true", "false"):
            return ("literal", text.lower(), None)
        raise ValueError(f"unexpected {text!r}")

    def query(self) -> dict[str, Any]:
        while self.take("PREFIX"):
            name = self.next()[1]
            self.prefixes[name.rstrip(":")] = self.next()[1][1:-1]
        self.need("SELECT")
        out: dict[str, Any] = {"distinct": bool(self.take("DISTINCT")), "select": [], "group": [], "having": [], "order": [], "limit": None, "offset": 0}
        while not (self.peek()[1] == "{" or self.peek()[1].upper() == "WHERE"):
            if self.take("*"):
                out["select"] = None
            elif self.take("("):
                expression = self.expression()
                self.need("AS")
                out["select"].append((expression, self.variable()))
                self.need(")")
            else:
                name = self.variable()
                out["select"].append((("var", name), name))
        self.take("WHERE")
        out["where"] = self.group()
        if self.take("GROUP"):
            self.need("BY")
            while self.peek()[0] == "var":
                out["group"].append(self.variable())
        if self.take("HAVING"):
            out["having"].append(self.primary())
        if self.take("ORDER"):
            self.need("BY")
            while self.peek()[0] == "var" or self.peek()[1].upper() in ("ASC", "DESC", "("):
                down = self.take("ASC", "DESC") == "DESC"
                out["order"].append((self.primary(), down))
        while (word := self.take("LIMIT", "OFFSET")) is not None:
            out[word.lower()] = int(self.next()[1])
        if self.peek()[0] != "end":
            raise ValueError(f"unexpected {self.peek()[1]!r}")
        return out

    def group(self) -> list[tuple]:
        self.need("{")
        parts: list[tuple] = []
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("OPTIONAL"):
                parts.append(("optional", self.group()))
            elif self.take("MINUS"):
                parts.append(("minus", self.group()))
            elif self.take("FILTER"):
                parts.append(("filter", self.primary()))
            elif self.take("BIND"):
                self.need("(")
                expression = self.expression()
                self.need("AS")
                parts.append(("bind", expression, self.variable()))
                self.need(")")
            elif self.peek()[1] == "{":
                choices = [self.group()]
                while self.take("UNION"):
                    choices.append(self.group())
                parts.append(("union", choices))
            else:
                parts += self.triples()
        return parts

    def triples(self) -> list[tuple]:
        subject, out = self.term(), []
        while True:
            if self.peek() == ("word", "a"):
                self.next()
                predicate = ("uri", RDF_TYPE)
            else:
                predicate = self.term()
            out.append(("triple", subject, predicate, self.term()))
            while self.take(","):
                out.append(("triple", subject, predicate, self.term()))
            if not self.take(";"):
                return out
            if self.peek()[1] in (".", "}"):
                return out

    def expression(self) -> tuple:
        left = self.conjunction()
        while self.take("||"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.relation()
        while self.take("&&"):
            left = ("and", left, self.relation())
        return left

    def relation(self) -> tuple:
        left = self.sum()
        sign = self.take("=", "!=", "<", ">", "<=", ">=", "IN")
        if sign == "IN":
            return ("in", left, self.arguments()[0])
        return (sign, left, self.sum()) if sign else left

    def sum(self) -> tuple:
        left = self.product()
        while (sign := self.take("+", "-")) is not None:
            left = (sign, left, self.product())
        return left

    def product(self) -> tuple:
        left = self.primary()
        while (sign := self.take("*", "/")) is not None:
            left = (sign, left, self.primary())
        return left

    def primary(self) -> tuple:
        if self.take("!"):
            return ("not", self.primary())
        if self.take("("):
            inner = self.expression()
            self.need(")")
            return inner
        kind, text = self.peek()
        if kind == "word" and self.peek(1)[1] == "(":
            self.next()
            arguments, distinct, separator = self.arguments()
            return ("call", text.upper(), arguments, distinct, separator)
        return self.term()

    def arguments(self) -> tuple[list[tuple], bool, str]:
        self.need("(")
        distinct, separator, out = bool(self.take("DISTINCT")), " ", []
        while not self.take(")"):
            if self.take("*"):
                out.append(("all",))
            elif self.take(";"):
                self.need("SEPARATOR")
                self.need("=")
                separator = self.term()[1]
            elif not self.take(","):
                out.append(self.expression())
        return out, distinct, separator


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b),
}
_NUMERIC = {"STRLEN", "ABS", "ROUND", "YEAR", "MONTH", "COUNT", "SUM", "AVG"}


def _is_number(node: tuple) -> bool:
    return node[0] in ("number", "+", "-", "*", "/") or (node[0] == "call" and node[1] in _NUMERIC)


def _column(node: tuple) -> Column:
    """The column of an expression."""
    kind = node[0]
    if kind == "var":
        return F.col(f"`{node[1]}`")
    if kind in ("uri", "literal"):
        return F.lit(node[1])
    if kind == "number":
        return F.lit(float(node[1]))
    if kind == "all":
        return F.lit(1)
    if kind == "not":
        return ~_column(node[1])
    if kind in ("and", "or"):
        left, right = _column(node[1]), _column(node[2])
        return left & right if kind == "and" else left | right
    if kind == "in":
        return _column(node[1]).isin([x[1] for x in node[2]])
    if kind == "call":
        _, name, arguments, distinct, separator = node
        columns = [F.lit(int(x[1])) if x[0] == "number" else _column(x) for x in arguments]
        if name in AGGREGATES:
            return AGGREGATES[name](columns[0], distinct, separator)
        if name not in FUNCTIONS:
            raise ValueError(f"unknown function {name}")
        return FUNCTIONS[name](*columns)
    left, right = _column(node[1]), _column(node[2])
    if kind in "+-*/" or _is_number(node[1]) or _is_number(node[2]):
        left, right = left.try_cast("double"), right.try_cast("double")
    return _COMPARE[kind](left, right)


def _aggregates(node: tuple) -> bool:
    return node[0] == "call" and node[1] in AGGREGATES or any(_aggregates(x) for x in node[1:] if isinstance(x, tuple))


def _pattern(triples: DataFrame, terms: tuple) -> DataFrame:
    rows, names = triples, {}
    for column, term in zip("spo", terms, strict=True):
        if term[0] == "var":
            if term[1] in names:
                rows = rows.where(F.col(column) == F.col(names[term[1]]))
            else:
                names[term[1]] = column
            continue
        rows = rows.where(F.col(column) == term[1])
        if column == "o":
            rows = rows.where(F.col("tipo") == "uri" if term[0] == "uri" else F.col("tipo") != "uri")
            if term[0] == "literal" and term[2]:
                rows = rows.where(F.col("lengua") == term[2])
    return rows.select(*(F.col(c).alias(n) for n, c in names.items()))


def _join(left: DataFrame | None, right: DataFrame, how: str = "inner") -> DataFrame:
    if left is None:
        return right
    shared = [c for c in right.columns if c in left.columns]
    if not shared:
        raise ValueError(f"{right.columns} share no variable with {left.columns}")
    return left.join(right, shared, how)


def _group(triples: DataFrame, parts: list[tuple]) -> DataFrame:
    rows: DataFrame | None = None
    waiting = [p for p in parts if p[0] == "triple"]
    while waiting:
        # The next pattern that shares a variable with those joined.
        fits = next((p for p in waiting if rows is None or any(t[0] == "var" and t[1] in rows.columns for t in p[1:])), waiting[0])
        waiting.remove(fits)
        rows = _join(rows, _pattern(triples, fits[1:]))
    for part in parts:
        if part[0] == "union":
            choices = [_group(triples, g) for g in part[1]]
            whole = choices[0]
            for other in choices[1:]:
                whole = whole.unionByName(other, allowMissingColumns=True)
            rows = _join(rows, whole)
        elif part[0] in ("optional", "minus"):
            if rows is None:
                raise ValueError(f"{part[0]} without a pattern before it")
            rows = _join(rows, _group(triples, part[1]), "left" if part[0] == "optional" else "left_anti")
        elif part[0] == "bind":
            rows = rows.withColumn(part[2], _column(part[1]))
    for part in parts:
        if part[0] == "filter":
            rows = rows.where(_column(part[1]))
    if rows is None:
        raise ValueError("a group without a pattern")
    return rows


def select(triples: DataFrame, text: str) -> DataFrame:
    """The solutions of a SELECT query, one column a variable."""
    query = Parser(text).query()
    rows = _group(triples, query["where"])
    chosen = query["select"] if query["select"] is not None else [(("var", c), c) for c in rows.columns]
    if query["group"] or any(_aggregates(e) for e, _ in chosen):
        keys = query["group"]
        loose = [n for e, n in chosen if not _aggregates(e) and e != ("var", n) or e[0] == "var" and e[1] not in keys]
        if loose:
            raise ValueError(f"{loose} are neither grouped nor aggregated")
        having = [(e, f"_having{i}") for i, e in enumerate(query["having"])]
        values = [(e, n) for e, n in chosen if _aggregates(e)] + having
        rows = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*[_column(e).alias(n) for e, n in values] or [F.count("*").alias("_n")])
        for _, name in having:
            rows = rows.where(F.col(name))
    else:
        names = {n for _, n in chosen}
        rows = rows.select("*", *[_column(e).alias(n) for e, n in chosen if e != ("var", n)]) if any(e != ("var", n) for e, n in chosen) else rows
        missing = [n for n in names if n not in rows.columns]
        if missing:
            raise ValueError(f"{missing} occur in no pattern")
    if query["distinct"]:
        rows = rows.select(*[F.col(f"`{n}`") for _, n in chosen]).distinct()
    if query["order"]:
        rows = rows.orderBy(*[_column(e).desc_nulls_last() if down else _column(e).asc_nulls_first() for e, down in query["order"]])
    if query["offset"]:
        rows = rows.offset(query["offset"])
    if query["limit"] is not None:
        rows = rows.limit(query["limit"])
    return rows.select(*[F.col(f"`{n}`") for _, n in chosen])
