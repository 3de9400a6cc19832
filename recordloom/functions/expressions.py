"""A whitelist of Python expressions as Spark columns: predicates over metadata and formulas over values."""

from __future__ import annotations

import ast
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as A

_MATH: dict[str, Callable] = {
    "sqrt": F.sqrt, "exp": F.exp, "log10": F.log10, "log2": F.log2, "log1p": F.log1p, "expm1": F.expm1, "sin": F.sin, "cos": F.cos,
    "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "hypot": F.hypot, "degrees": F.degrees, "radians": F.radians, "pow": F.pow, "fabs": F.abs,
    "floor": F.floor, "ceil": F.ceil, "trunc": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)),
    "log": lambda x, base=None: F.log(x) if base is None else F.log(x) / F.log(base), "isnan": F.isnan,
}
_PLAIN: dict[str, Callable] = {
    "abs": F.abs, "pow": F.pow, "round": lambda x, digits=0: F.bround(x, digits if isinstance(digits, int) else int(digits)),
    "min": lambda *x: F.least(*x), "max": lambda *x: F.greatest(*x),
    "amax": A.amax, "amin": A.amin, "mean": A.mean, "std": A.std, "median": A.median,
}
_COMPARE = {ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}


def _modulo(a: Column, b: Column) -> Column:
    """Python's %: the sign of the divisor."""
    return a - b * F.floor(a / b)


_BINARY: dict[type, Callable] = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b,
    ast.FloorDiv: lambda a, b: F.floor(a / b), ast.Mod: _modulo, ast.Pow: lambda a, b: F.pow(a, b),
}


class ExpressionError(ValueError):
    """An expression that is not on the whitelist."""


def translate(text: str, name: Callable[[str], Column], attribute: Callable[[str, str], Column] | None = None) -> Column:
    """The expression as a column; ``name`` and ``attribute`` resolve ``x`` and ``x.y``."""

    def lit(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    def walk(node: ast.AST):
        match node:
            case ast.Expression(body=body):
                return walk(body)
            case ast.Constant(value=value) if isinstance(value, (int, float, str, bool)) or value is None:
                return float(value) if isinstance(value, float) else value
            case ast.Name(id=key):
                return name(key)
            case ast.Attribute(value=ast.Name(id="math"), attr=attr) if attr in ("pi", "e", "tau", "inf", "nan"):
                return getattr(math, attr)
            case ast.Attribute(value=ast.Name(id=key), attr=attr) if attribute:
                return attribute(key, attr)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -walk(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return walk(x)
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~lit(walk(x))
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](lit(walk(a)), lit(walk(b)))
            case ast.BoolOp(op=op, values=values):
                out = lit(walk(values[0]))
                for v in values[1:]:
                    out = out & lit(walk(v)) if isinstance(op, ast.And) else out | lit(walk(v))
                return out
            case ast.IfExp(test=test, body=yes, orelse=no):
                return F.when(lit(walk(test)), lit(walk(yes))).otherwise(lit(walk(no)))
            case ast.Compare(left=left, ops=ops, comparators=right):
                out, a = None, lit(walk(left))
                for op, b in zip(ops, right):
                    if isinstance(op, (ast.In, ast.NotIn)) and isinstance(b, (ast.List, ast.Tuple, ast.Set)):
                        one = a.isin([walk(x) for x in b.elts])
                        one = ~one if isinstance(op, ast.NotIn) else one
                    elif isinstance(op, (ast.Is, ast.IsNot)) and isinstance(b, ast.Constant) and b.value is None:
                        one = a.isNull() if isinstance(op, ast.Is) else a.isNotNull()
                    elif type(op) in _COMPARE:
                        one = getattr(a, _COMPARE[type(op)])(lit(walk(b)))
                        a = lit(walk(b))
                    else:
                        raise ExpressionError(f"comparison not allowed in {text!r}")
                    out = one if out is None else out & one
                return out
            case ast.Call(func=ast.Name(id=f), args=args, keywords=[]) if f in _PLAIN:
                return _PLAIN[f](*[walk(a) if f == "round" and k else lit(walk(a)) for k, a in enumerate(args)])
            case ast.Call(func=ast.Attribute(value=ast.Name(id="math"), attr=f), args=args, keywords=[]) if f in _MATH:
                return _MATH[f](*[lit(walk(a)) for a in args])
        raise ExpressionError(f"not allowed in an expression: {ast.dump(node)[:80]} in {text!r}")

    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as error:
        raise ExpressionError(f"cannot be read: {text!r}") from error
    return lit(walk(tree))
