"""Motion types: bit masks, their letters and the type-expression language ``~ | &``."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSLATE, ROTATE, SCALE, ANY = 1, 2, 4, 7
NAMES = {"none": 0, "translate": TRANSLATE, "rotate": ROTATE, "scale": SCALE, "any": ANY}


def atoms(mask: int) -> list[int]:
    """The single types of a mask."""
    return [m for m in (TRANSLATE, ROTATE, SCALE) if m & mask]


def parse_types(text: str) -> int:
    """Mask of an expression such as ``translate|rotate`` or ``~scale``."""

    def value(node: ast.AST) -> int:
        match node:
            case ast.Expression():
                return value(node.body)
            case ast.Name() if node.id in NAMES:
                return NAMES[node.id]
            case ast.UnaryOp(op=ast.Invert()):
                return ~value(node.operand) & ANY
            case ast.BinOp(op=ast.BitOr()):
                return value(node.left) | value(node.right)
            case ast.BinOp(op=ast.BitAnd()):
                return value(node.left) & value(node.right)
        raise ValueError(f"not a type expression: {text!r}")

    try:
        return value(ast.parse(text.strip(), mode="eval"))
    except SyntaxError as e:
        raise ValueError(f"not a type expression: {text!r}") from e


def letters_to_mask(letters: Column) -> Column:
    """Mask of letters T, R, S; K (skew) is no motion type."""
    return sum((F.when(F.contains(letters, F.lit(c)), F.lit(m)).otherwise(F.lit(0)) for c, m in (("T", TRANSLATE), ("R", ROTATE), ("S", SCALE))), F.lit(0))
