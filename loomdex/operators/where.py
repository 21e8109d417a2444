"""Conditions on attributes, from trees to columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.plans import dialect as d


def _list(node: object, enums: Mapping[str, int]) -> Column:
    """An array: a list, or one value as a list of one. A column that is an array already must be named in arrays."""
    if isinstance(node, d.Call) and node.op == "list":
        return F.array(*[column(a, enums) for a in node.args])
    return F.array(column(node, enums))


def column(node: object, enums: Mapping[str, int] | None = None, arrays: frozenset[str] = frozenset()) -> Column:
    """A column for a condition. Names of enumerations stand for their codes; names in arrays are array columns.

    `list IN list` holds if everything on the left is on the right; `list COMMON list` if they share something."""
    enums = enums or {}
    if isinstance(node, d.Value):
        return F.lit(node.value)
    if isinstance(node, d.Name):
        return F.lit(enums[node.name.upper()]) if node.name.upper() in enums else F.col(node.name)
    go = lambda n: column(n, enums, arrays)
    op, args = node.op, node.args
    if op in ("in", "common"):
        left, right = args
        as_list = lambda n: F.col(n.name) if isinstance(n, d.Name) and n.name in arrays else _list(n, enums)
        if op == "common":
            return F.arrays_overlap(as_list(left), as_list(right))
        many = isinstance(left, d.Call) and left.op == "list" or isinstance(left, d.Name) and left.name in arrays
        if not many and isinstance(right, d.Call) and right.op == "list":
            return go(left).isin(*[go(a) for a in right.args])
        if not many and isinstance(right, d.Value):
            return go(left) == go(right)
        return F.size(F.array_except(as_list(left), as_list(right))) == 0
    if op == "list":
        return _list(node, enums)
    if op == "between":
        return go(args[0]).between(go(args[1]), go(args[2]))
    if op in ("isnull", "not", "negative", "~"):
        a = go(args[0])
        return {"isnull": a.isNull, "not": a.__invert__, "negative": a.__neg__, "~": lambda: F.bitwise_not(a)}[op]()
    a, b = go(args[0]), go(args[1])
    return {
        "or": lambda: a | b,
        "and": lambda: a & b,
        "=": lambda: a == b,
        "!=": lambda: a != b,
        "<": lambda: a < b,
        "<=": lambda: a <= b,
        ">": lambda: a > b,
        ">=": lambda: a >= b,
        "+": lambda: a + b,
        "-": lambda: a - b,
        "*": lambda: a * b,
        "/": lambda: F.try_divide(a, b),
        "|": lambda: a.bitwiseOR(b),
        "&": lambda: a.bitwiseAND(b),
    }[op]()


def condition(source: str, enums: Mapping[str, int] | None = None, arrays: frozenset[str] = frozenset()) -> Column:
    return column(d.parse_where(source), enums, arrays)


def legacy(query: str) -> Column:
    """``key:value&key:value`` as equalities; a value with commas is any of them, and low~high a closed range."""
    out = F.lit(True)
    for item in filter(None, query.split("&")):
        key, _, value = item.partition(":")
        low, mark, high = value.partition("~")
        if mark:
            out &= F.col(key).between(low, high)
        elif "," in value:
            out &= F.col(key).cast("string").isin(*value.split(","))
        else:
            out &= F.col(key).cast("string") == value
    return out


def category(column_: Column, code: str, mode: str = "this") -> Column:
    """mode this: equal; below: equal or under it (codes are paths with "/"); multi: any of several joined by ","."""
    if mode == "this":
        return column_ == code
    if mode == "below":
        return (column_ == code) | column_.startswith(code + "/")
    return column_.isin(*code.split(","))
