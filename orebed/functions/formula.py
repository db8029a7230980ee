"""Arithmetic formulas over named values, compiled to a column."""

from __future__ import annotations

import ast
import operator
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod}
_CALLS = {"min": F.least, "max": F.greatest, "round": F.round, "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": F.sqrt}


def compiled(formula: str, names: Mapping[str, Column]) -> Column:
    """The formula as an expression; anything but numbers, given names, + - * / % **, signs and a few functions is refused."""

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return build(body)
            case ast.Constant(value=value) if type(value) in (int, float):
                return F.lit(float(value))
            case ast.Name(id=name) if name in names:
                return names[name]
            case ast.BinOp(left=left, op=ast.Pow(), right=right):
                return F.pow(build(left), build(right))
            case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
                return _BINARY[type(op)](build(left), build(right))
            case ast.UnaryOp(op=ast.USub(), operand=operand):
                return -build(operand)
            case ast.UnaryOp(op=ast.UAdd(), operand=operand):
                return build(operand)
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _CALLS:
                return _CALLS[name](*map(build, args))
        raise ValueError(f"not allowed in a formula: {ast.dump(node)[:80]}")

    return build(ast.parse(formula, mode="eval"))
