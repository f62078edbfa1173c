"""Python-like expressions over columns, translated to Catalyst expressions.  Nothing is evaluated."""

from __future__ import annotations

import ast
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ARITHMETIC = {
    ast.Add: lambda a, b: F.try_add(a, b),
    ast.Sub: lambda a, b: F.try_subtract(a, b),
    ast.Mult: lambda a, b: F.try_multiply(a, b),
    ast.Div: lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a.cast("double"), b.cast("double"))),
    ast.Mod: lambda a, b: F.pmod(a, F.nullif(b, F.lit(0))),
    ast.Pow: lambda a, b: F.pow(a, b),
}
_COMPARISON = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}
_FUNCTIONS = {"abs": F.abs, "round": F.round, "len": F.length, "upper": F.upper, "lower": F.lower, "min": F.least, "max": F.greatest}


class ExpressionError(ValueError):
    """The text isn't an expression of the grammar, or names something unknown."""


def to_column(text: str, names: Iterable[str]) -> Column:
    """Arithmetic, comparisons, and/or/not, conditional expressions, membership in literals, the
    functions abs, round, len, upper, lower, min and max; null where a value can't be computed."""
    known = set(names)
    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"not an expression: {text!r}") from e

    def walk(node: ast.AST) -> Column:
        match node:
            case ast.Constant():
                return F.lit(node.value)
            case ast.Name(id=name) if name in known:
                return F.col(f"`{name}`")
            case ast.Attribute(value=inner, attr=name):
                return walk(inner)[name]
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _ARITHMETIC:
                return _ARITHMETIC[type(op)](walk(a), walk(b))
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -walk(a)
            case ast.UnaryOp(op=ast.UAdd(), operand=a):
                return walk(a)
            case ast.UnaryOp(op=ast.Not(), operand=a):
                return ~walk(a)
            case ast.BoolOp(op=op, values=values):
                out = walk(values[0])
                for v in values[1:]:
                    out = (out & walk(v)) if isinstance(op, ast.And) else (out | walk(v))
                return out
            case ast.Compare(left=left, ops=ops, comparators=rest):
                out, a = None, left
                for op, b in zip(ops, rest, strict=True):
                    one = compare(a, op, b)
                    out, a = one if out is None else out & one, b
                return out
            case ast.IfExp(test=t, body=a, orelse=b):
                return F.when(walk(t), walk(a)).otherwise(walk(b))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _FUNCTIONS:
                if name == "round" and len(args) == 2 and isinstance(args[1], ast.Constant):
                    return F.round(walk(args[0]), args[1].value)
                return _FUNCTIONS[name](*map(walk, args))
        raise ExpressionError(f"not allowed in an expression: {ast.unparse(node)}")

    def compare(a: ast.AST, op: ast.cmpop, b: ast.AST) -> Column:
        none = isinstance(b, ast.Constant) and b.value is None
        if isinstance(op, ast.Is | ast.Eq) and none:
            return walk(a).isNull()
        if isinstance(op, ast.IsNot | ast.NotEq) and none:
            return walk(a).isNotNull()
        if isinstance(op, ast.In | ast.NotIn) and isinstance(b, ast.List | ast.Tuple | ast.Set):
            found = walk(a).isin([ast.literal_eval(x) for x in b.elts])
            return found if isinstance(op, ast.In) else ~found
        if type(op) in _COMPARISON:
            return _COMPARISON[type(op)](walk(a), walk(b))
        raise ExpressionError(f"not a comparison: {ast.unparse(a)}")

    return walk(tree)
