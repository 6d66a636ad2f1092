"""Figures of Python source: maintainability index and a lint rating, on the standard library.

The index follows its published formula; the rating follows the published formula of the common
linter over the rules below, a representative subset, and is clamped at 0.
"""

from __future__ import annotations

import ast
import io
import math
import re
import tokenize
import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _parse(source: str) -> ast.Module:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(source)


def halstead_volume(tree: ast.AST) -> float:
    """Length times log2 of vocabulary, over the operators and operands of expressions."""
    operators, operands, n1, n2 = set(), set(), 0, 0
    for node in ast.walk(tree):
        if isinstance(node, (ast.BinOp, ast.UnaryOp, ast.AugAssign)):
            parts = [node.left, node.right] if isinstance(node, ast.BinOp) else [node.operand] if isinstance(node, ast.UnaryOp) else [node.target, node.value]
            ops = [node.op]
        elif isinstance(node, ast.BoolOp):
            parts, ops = node.values, [node.op]
        elif isinstance(node, ast.Compare):
            parts, ops = [node.left, *node.comparators], node.ops
        else:
            continue
        n1 += len(ops)
        n2 += len(parts)
        operators |= {type(o).__name__ for o in ops}
        operands |= {ast.dump(p) if not isinstance(p, (ast.Name, ast.Constant, ast.Attribute)) else getattr(p, "id", getattr(p, "attr", repr(getattr(p, "value", None)))) for p in parts}
    vocabulary = len(operators) + len(operands)
    return (n1 + n2) * math.log2(vocabulary) if vocabulary else 0.0


def cyclomatic_complexity(tree: ast.AST) -> int:
    """1 and one more for every branch."""
    total = 1
    for node in ast.walk(tree):
        if isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler, ast.Assert, ast.comprehension)):
            total += 1
            total += len(node.ifs) if isinstance(node, ast.comprehension) else 0
            total += bool(getattr(node, "orelse", None)) if isinstance(node, (ast.For, ast.AsyncFor, ast.While)) else 0
        elif isinstance(node, ast.BoolOp):
            total += len(node.values) - 1
        elif isinstance(node, ast.match_case):
            total += 1
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
            total += not isinstance(node, ast.Lambda)
    return total


def line_counts(source: str) -> tuple[int, int]:
    """(source lines, comment lines); strings of several lines that stand alone count as comments."""
    code, comments = set(), set()
    for token in tokenize.generate_tokens(io.StringIO(source).readline):
        span = set(range(token.start[0], token.end[0] + 1))
        if token.type == tokenize.COMMENT:
            comments |= span
        elif token.type not in (tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER):
            code |= span
    for node in ast.walk(_parse(source)):
        if isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str) and node.end_lineno > node.lineno:
            span = set(range(node.lineno, node.end_lineno + 1))
            comments |= span
            code -= span
    return len(code), len(comments)


def maintainability(source: str | None) -> float:
    """The maintainability index between 0 and 100; 100 for an empty source, 0 for one that doesn't parse."""
    try:
        tree = _parse(source or "")
        volume, (sloc, comments) = halstead_volume(tree), line_counts(source or "")
        if not sloc or volume <= 0:
            return 100.0
        percent = comments / (sloc + comments) * 100
        raw = 171 - 5.2 * math.log(volume) - 0.23 * cyclomatic_complexity(tree) - 16.2 * math.log(sloc) + 50 * math.sin(math.sqrt(2.4 * math.radians(percent)))
        return min(max(0.0, raw * 100 / 171), 100.0)
    except Exception:
        return 0.0


def lint_findings(source: str) -> dict[str, int]:
    """Findings by class: fatal, error, warning, refactor, convention."""
    tree = _parse(source)
    found = {"error": 0, "warning": 0, "refactor": 0, "convention": 0}
    lines = source.split("\n")
    found["convention"] += sum(len(line) > 100 for line in lines) + sum(line != line.rstrip() for line in lines)
    found["convention"] += bool(source) and not source.endswith("\n")
    found["convention"] += ast.get_docstring(tree) is None
    loaded = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            found["convention"] += ast.get_docstring(node) is None
            found["convention"] += not re.fullmatch(r"_{0,2}[a-z][a-z0-9_]*_{0,2}", node.name)
            found["refactor"] += len(node.args.args) > 5
            found["refactor"] += sum(isinstance(n, (ast.If, ast.For, ast.While, ast.Try)) for n in ast.walk(node)) > 12
            found["warning"] += sum(isinstance(d, (ast.List, ast.Dict, ast.Set)) for d in node.args.defaults)
            for block in (n for n in ast.walk(node) if isinstance(getattr(n, "body", None), list)):
                found["warning"] += any(isinstance(s, (ast.Return, ast.Raise, ast.Break, ast.Continue)) for s in block.body[:-1])
        elif isinstance(node, ast.ClassDef):
            found["convention"] += (ast.get_docstring(node) is None) + (not re.fullmatch(r"_?[A-Z][A-Za-z0-9]*", node.name))
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            found["warning"] += sum(a.name == "*" or (a.asname or a.name.split(".")[0]) not in loaded for a in node.names)
            found["convention"] += isinstance(node, ast.Import) and len(node.names) > 1
        elif isinstance(node, ast.ExceptHandler):
            found["warning"] += node.type is None
        elif isinstance(node, ast.Compare):
            found["convention"] += any(isinstance(c, ast.Constant) and (c.value is None or isinstance(c.value, bool)) and isinstance(o, (ast.Eq, ast.NotEq)) for o, c in zip(node.ops, node.comparators))
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            found["warning"] += node.func.id in ("eval", "exec")
        elif isinstance(node, (ast.Global,)):
            found["warning"] += 1
    return found


def lint_rating(source: str | None) -> float:
    """10 - 10 * (5 errors + warnings + refactorings + conventions) / statements, from 0 to 10; 0 where nothing can be rated."""
    try:
        found = lint_findings(source or "")
        statements = sum(isinstance(n, ast.stmt) for n in ast.walk(_parse(source or "")))
        if not statements:
            return 0.0
        return max(0.0, round(10 - 10 * (5 * found["error"] + found["warning"] + found["refactor"] + found["convention"]) / statements, 2))
    except Exception:
        return 0.0


def score_column(code: Column | str, rate: Callable[[str | None], float]) -> Column:
    """A column of scores by any function from source to number."""

    @F.pandas_udf(T.DoubleType())
    def run(codes: pd.Series) -> pd.Series:
        return pd.Series([rate(c) for c in codes], dtype="float64")

    return run(F.col(code) if isinstance(code, str) else code)
