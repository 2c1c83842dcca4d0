"""Predicates: exact, or best effort - the part that a narrow dialect supports, so that results are a superset.

Spark's own parser reads the text.  Best effort keeps comparisons of columns and
literals of matching kinds, IN lists, AND, OR and NOT; anything else is dropped:
from an AND alone, from an OR and a NOT with the whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamellar.errors import PredicateError

_COMPARE = {"EqualTo", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual"}


@dataclass(frozen=True)
class Predicate:
    """text: what is applied (None: nothing); dropped: descriptions of what was left out."""

    text: str | None
    dropped: tuple[str, ...] = ()

    @property
    def column(self) -> Column | None:
        return None if self.text is None else F.expr(self.text)


def _kind(t: T.DataType | None) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "float"
    return "text" if isinstance(t, T.StringType) else "bool" if isinstance(t, T.BooleanType) else "other"


def _backticks(text: str) -> str:
    """Identifiers in double quotes, in Spark's way of writing them."""
    return re.sub(r"'(?:[^'\\]|''|\\.)*'|\"([^\"]+)\"", lambda m: m.group() if m.group(1) is None else f"`{m.group(1)}`", text)


def parse(spark: SparkSession, text: str, schema: T.StructType, best_effort: bool = False) -> Predicate:
    if not text or not text.strip():
        raise PredicateError("empty predicate")
    text = _backticks(text)
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except (Py4JJavaError, ParseException) as e:
        raise PredicateError(f"cannot parse {text!r}") from e
    kinds = {f.name: _kind(f.dataType) for f in schema.fields}
    _known(tree, kinds)
    if not best_effort:
        return Predicate(text)
    dropped: list[str] = []
    return Predicate(_keep(tree, kinds, dropped), tuple(dropped))


def _class(e) -> str:
    return e.getClass().getSimpleName()


def _children(e) -> list:
    c = e.children()
    return [c.apply(i) for i in range(c.size())]


def _known(e, kinds: dict[str, str]) -> None:
    if _class(e) == "UnresolvedAttribute":
        parts = e.nameParts()
        if parts.apply(0) not in kinds:
            raise PredicateError(f"unknown column {parts.apply(0)}")
    for c in _children(e):
        _known(c, kinds)


def _operand(e, kinds: dict[str, str]) -> tuple[bool, str, str] | None:
    """Whether it is a column, its kind, and its text; None if it is neither column nor literal."""
    name = _class(e)
    if name == "UnresolvedAttribute" and e.nameParts().size() == 1:
        return True, kinds[e.nameParts().apply(0)], f"`{e.nameParts().apply(0)}`"
    minus = name == "UnaryMinus"
    if minus:
        e = _children(e)[0]
        name = _class(e)
    if name != "Literal" or e.value() is None:
        return None
    t = e.dataType().typeName()
    if t in ("integer", "long", "short", "byte"):
        return False, "int", f"{'-' if minus else ''}{e.value()}"
    if t in ("double", "float") or t.startswith("decimal"):
        value = float(e.value().toString() if hasattr(e.value(), "toString") else e.value())
        return False, "whole" if value == int(value) else "float", f"{'-' if minus else ''}CAST({value!r} AS DOUBLE)"
    if minus:
        return None
    if t == "string":
        return False, "text", "'" + e.value().toString().replace("\\", "\\\\").replace("'", "\\'") + "'"
    return (False, "bool", str(e.value()).lower()) if t == "boolean" else None


def _fit(a: tuple[bool, str, str] | None, b: tuple[bool, str, str] | None) -> bool:
    if a is None or b is None:
        return False
    numbers = {"int", "whole", "float"}
    for column, value in ((a, b), (b, a)):
        if column[0] and not value[0]:
            if column[1] == "int":
                return value[1] in ("int", "whole")
            return value[1] in numbers if column[1] == "float" else column[1] == value[1] != "other"
    return a[1] == b[1] != "other" or {a[1], b[1]} <= numbers


def _keep(e, kinds: dict[str, str], dropped: list[str]) -> str | None:
    name, parts = _class(e), _children(e)
    if name == "And":
        kept = [t for t in (_keep(c, kinds, dropped) for c in parts) if t]
        return f"({' AND '.join(kept)})" if kept else None
    if name == "Or":
        kept = [_keep(c, kinds, dropped) for c in parts]
        return f"({' OR '.join(kept)})" if all(kept) else None
    if name == "Not":
        inner: list[str] = []
        kept = _keep(parts[0], kinds, inner)
        dropped += inner
        return f"(NOT {kept})" if kept and not inner else None  # a part under NOT cannot be left out
    if name in _COMPARE:
        a, b = (_operand(c, kinds) for c in parts)
        if _fit(a, b):
            return f"({a[2]} {e.symbol()} {b[2]})"
    elif name == "In":
        a, values = _operand(parts[0], kinds), [_operand(c, kinds) for c in parts[1:]]
        if a and a[0] and values and all(v and not v[0] and _fit(a, v) for v in values):
            return f"({a[2]} IN ({', '.join(v[2] for v in values)}))"
    elif name in ("UnresolvedAttribute", "Literal"):
        a = _operand(e, kinds)
        if a and a[1] == "bool":
            return f"({a[2]})"
    dropped.append(e.sql())
    return None
