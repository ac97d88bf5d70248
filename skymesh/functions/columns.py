"""Column expressions: missing values, ranges, longitudes, local time, formulas, column choice."""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: characters that a formula may hold besides its (column) tokens
_FORMULA = re.compile(r"[0-9eE.+\-*/()\s]*\Z")
_TOKEN = re.compile(r"\(([A-Za-z_][\w.]*)\)")


def finite_or_null(c: str) -> Column:
    """NaN and infinities become missing."""
    x = F.col(f"`{c}`")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def all_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite_or_null(c) for c in cols})


def replace_values(c: str, low: float, high: float, value: float | None = None, replace_null: bool = False) -> Column:
    """Values from ``low`` to ``high``, both included, become ``value``; so do missing ones if asked."""
    x = F.col(f"`{c}`")
    hit = x.between(low, high)
    if replace_null:
        hit = hit | x.isNull()
    return F.when(hit, F.lit(value).cast("double")).otherwise(x)


def plain_name(name: str) -> str:
    """A column name without characters that need quoting."""
    return re.sub(r"\W", "_", name)


def column_of(name: str, columns: Sequence[str] | None = None) -> str:
    """The column that ``name`` means: itself, or its plain form if the columns are known and lack it."""
    return name if columns is None or name in columns else plain_name(name)


_OPERATION = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide}


def formula(text: str, columns: Sequence[str] | None = None) -> tuple[Column, list[str]]:
    """The column of an arithmetic formula whose ``(name)`` tokens are columns, and these names.

    Only numbers, ``+ - * /`` and parentheses may stand between the tokens; nothing is evaluated as code.
    A division by zero gives null, whatever the divisor is.  Names may have dots; with ``columns``, one that isn't
    there means its plain form."""
    names = list(dict.fromkeys(_TOKEN.findall(text)))
    if not names:
        raise ValueError(f"no (column) in {text!r}")
    if not _FORMULA.match(_TOKEN.sub("", text)):
        raise ValueError(f"only arithmetic may join columns: {text!r}")
    names = [column_of(n, columns) for n in names]

    def build(node) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATION:
            return _OPERATION[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            return F.col(f"`{names[int(node.id[1:])]}`")
        raise ValueError(f"only arithmetic may join columns: {text!r}")

    tokens = list(dict.fromkeys(_TOKEN.findall(text)))
    try:
        tree = ast.parse(_TOKEN.sub(lambda m: f"(_{tokens.index(m[1])})", text).strip(), mode="eval")
    except SyntaxError as e:
        raise ValueError(f"not a formula: {text!r}") from e
    return build(tree.body), list(dict.fromkeys(names))


def to_east(lon: Column) -> Column:
    """-180..180 to 0..360."""
    return F.when(lon < 0, lon + 360).otherwise(lon)


def to_signed(lon: Column) -> Column:
    """0..360 to -180..180."""
    return F.when(lon >= 180, lon - 360).otherwise(lon)


def utc_offset_hours(lon: Column) -> Column:
    """Hours to add to UTC: bands of 15 degrees around multiples of 15, each with its west edge."""
    return F.floor((to_signed(lon) + 7.5) / 15).cast("int")


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def matching(df: DataFrame, key: str) -> list[str]:
    """The column named ``key``; if there is none, all columns that match it as a whole pattern."""
    if key in df.columns:
        return [key]
    return [c for c in df.columns if re.fullmatch(key, c)]


def edge_index(x: Column, edges: Sequence[float]) -> Column:
    """0-based bin of ``x`` between sorted edges: left-closed, the last one closed on both sides; null
    outside."""
    inner = [float(e) for e in edges[1:-1]]
    n, axis = len(inner), F.array(*(F.lit(e) for e in inner))
    step = (inner[-1] - inner[0]) / (n - 1) if n > 1 else 0.0
    if step > 0 and all(abs(inner[0] + i * step - e) < step / 4 for i, e in enumerate(inner)):
        # a regular axis: one division gives the edge below or one of its neighbours, two comparisons say which
        guess = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((x - inner[0]) / step).cast("int")))  # the edge, from 0
        above = F.coalesce(x >= F.try_element_at(axis, guess + 2), F.lit(False)).cast("int")
        at = guess + above + (x >= F.try_element_at(axis, guess + 1)).cast("int")
    elif n > 8:  # by bisection
        at = F.lit(0)
        for k in reversed(range(n.bit_length())):
            there = at + (1 << k)
            at = F.when((there <= n) & (F.try_element_at(axis, there) <= x), there).otherwise(at)
    else:
        at = sum(((x >= F.lit(e)).cast("int") for e in inner), F.lit(0))
    return F.when(x.between(float(edges[0]), float(edges[-1])), at)
