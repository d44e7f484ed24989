"""The metadata predicate language, compiled to columns.

A filter is a dict of conditions that all must hold: a scalar (equality), a list (membership), an operator dict, or a tuple
shorthand such as ``(">", 3)``. Metadata is a JSON string; a key is a path below its root. Values compare as in SQLite's JSON functions:
booleans are 0 and 1, a JSON null counts as missing, strings never equal numbers, and the ordering operators see numbers only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FILTER_LIST_MAX

#: Shorthand -> operator.
SHORTHAND = {
    "$eq": ("==", "eq"), "$ne": ("!=", "ne"), "$gt": (">", "gt"), "$gte": (">=", "gte"), "$lt": ("<", "lt"), "$lte": ("<=", "lte"),
    "$in": ("in",), "$nin": ("nin",), "$exists": ("exists",), "$between": ("range", "between"),
}
_BY_NAME = {name: op for op, names in SHORTHAND.items() for name in names}
_ORDER = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$"


def _finite(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def _scalar(x: Any) -> bool:
    return isinstance(x, (bool, str)) or _finite(x)


def _check_list(key: str, items: Any) -> None:
    if not isinstance(items, list) or not items:
        raise ValueError(f"{key}: a list with at least one item is needed")
    if len(items) > FILTER_LIST_MAX:
        raise ValueError(f"{key}: {len(items)} items, {FILTER_LIST_MAX} at most")
    if not all(map(_scalar, items)):
        raise ValueError(f"{key}: list items must be finite numbers, strings or booleans")


def _expand(key: str, value: Any) -> dict[str, Any]:
    """Any condition as an operator dict."""
    if isinstance(value, tuple):
        if not value or not isinstance(value[0], str) or value[0] not in _BY_NAME:
            raise ValueError(f"{key}: a tuple starts with one of {sorted(_BY_NAME)}")
        op, rest = _BY_NAME[value[0]], list(value[1:])
        if op in ("$in", "$nin"):
            only = rest[0] if len(rest) == 1 else rest
            return {op: list(only) if isinstance(only, (list, tuple, set)) else [only]}
        if len(rest) != (2 if op == "$between" else 1):
            raise ValueError(f"{key}: {value[0]} takes {2 if op == '$between' else 1} value(s)")
        return {op: rest if op == "$between" else rest[0]}
    if isinstance(value, dict):
        return value
    if isinstance(value, list):
        return {"$in": value}
    if _scalar(value):
        return {"$eq": value}
    raise ValueError(f"{key}: unsupported value {value!r}")


def parse(conditions: dict[str, Any] | None) -> dict[str, dict[str, Any]]:
    """Validate a filter and bring it to operator dicts."""
    out = {}
    for key, value in (conditions or {}).items():
        if not isinstance(key, str) or not key:
            raise ValueError(f"filter keys are strings, not {key!r}")
        ops = _expand(key, value)
        if not ops:
            raise ValueError(f"{key}: no operator")
        for op, arg in ops.items():
            if op not in SHORTHAND:
                raise ValueError(f"{key}: unknown operator {op!r}; there are {sorted(SHORTHAND)}")
            if op in _ORDER and not _finite(arg):
                raise ValueError(f"{key}: {op} takes a finite number")
            if op in ("$eq", "$ne") and not (arg is None or _scalar(arg)):
                raise ValueError(f"{key}: {op} takes a scalar")
            if op in ("$in", "$nin"):
                _check_list(key, arg)
            if op == "$exists" and not isinstance(arg, bool):
                raise ValueError(f"{key}: $exists takes a boolean")
            if op == "$between" and not (isinstance(arg, (list, tuple)) and len(arg) == 2 and all(map(_finite, arg)) and arg[0] <= arg[1]):
                raise ValueError(f"{key}: $between takes two finite numbers in order")
        out[key] = ops
    return out


class _Json:
    """A value (a variant, null where there is none) inside a JSON object, with SQLite's typing."""

    def __init__(self, value: Column):
        kind = F.schema_of_variant(value)
        self.present = F.coalesce(kind != "VOID", F.lit(False))
        self.is_number = F.coalesce(kind.rlike(_NUMBER), F.lit(False))
        self.number = F.when(self.is_number, F.try_variant_get(value, "$", "double"))
        truth = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
        self.numeric = F.coalesce(self.number, truth)
        self.text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind.rlike("^(ARRAY|OBJECT)"), F.to_json(value))

    def equals(self, x: Any) -> Column:
        if x is None:
            return F.lit(False)
        found = self.text == x if isinstance(x, str) else self.numeric == float(x)
        return F.coalesce(found, F.lit(False))


class _Plain:
    """A numeric column."""

    def __init__(self, column: Column):
        self.present, self.is_number, self.number = column.isNotNull(), column.isNotNull(), column.cast("double")
        self._column = column

    def equals(self, x: Any) -> Column:
        return F.coalesce(self._column == x, F.lit(False)) if x is not None else F.lit(False)


def _condition(value: _Json | _Plain, op: str, arg: Any) -> Column:
    any_of = lambda items: _any([value.equals(x) for x in items])
    if op == "$eq":
        return value.equals(arg)
    if op == "$ne":
        return ~value.present | (F.lit(arg is not None) & ~value.equals(arg))
    if op in _ORDER:
        return value.is_number & F.coalesce(getattr(value.number, _ORDER[op])(float(arg)), F.lit(False))
    if op == "$in":
        return any_of(arg)
    if op == "$nin":
        return ~value.present | ~any_of(arg)
    if op == "$exists":
        return value.present if arg else ~value.present
    return value.is_number & F.coalesce(value.number.between(float(arg[0]), float(arg[1])), F.lit(False))


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _all(value: _Json | _Plain, ops: dict[str, Any]) -> Column:
    out = F.lit(True)
    for op, arg in ops.items():
        out = out & _condition(value, op, arg)
    return out


def predicate(conditions: dict[str, Any] | None, metadata: Column, columns: dict[str, Column] | None = None) -> Column:
    """The filter as one boolean column, never null. ``columns``: keys that name real columns, which then reach the scan. Metadata is parsed once a
    row, and each key is looked up once in it."""
    parsed = parse(conditions)
    plain = {key: ops for key, ops in parsed.items() if columns and key in columns}
    inside = {key: ops for key, ops in parsed.items() if key not in plain}
    out = F.lit(True)
    for key, ops in plain.items():
        out = out & _all(_Plain(columns[key]), ops)

    def held(ops: dict[str, Any]) -> Callable[[Column], Column]:
        return lambda v: _all(_Json(v), ops)

    def holds(tree: Column) -> Column:
        every = F.lit(True)
        for key, ops in inside.items():
            every = every & _once(F.try_variant_get(tree, f"$.{key}", "variant"), held(ops))
        return every

    return out & F.coalesce(_once(F.try_parse_json(metadata), holds), F.lit(False)) if inside else out
