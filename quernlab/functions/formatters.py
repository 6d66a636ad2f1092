"""Four formatters of Python source on the standard library, chained; each falls back to its input.

They do the common part of what the named kinds of tool do, so results are close to theirs and not the
same. ``FORMATTERS`` takes any function from text to text in their place.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

#: Columns of a docstring line.
DOC_WIDTH = 79


def _parse(source: str) -> ast.Module:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(source)


def _replace_lines(source: str, changes: list[tuple[int, int, list[str]]]) -> str:
    """Lines first..last (1-based) replaced, changes applied from the bottom up."""
    lines = source.split("\n")
    for first, last, new in sorted(changes, reverse=True):
        lines[first - 1 : last] = new
    return "\n".join(lines)


def remove_unused(source: str) -> str:
    """Without imports that nothing names and local variables that are only assigned a value without effects."""
    tree = _parse(source)
    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Load, ast.Del))}
    used |= {e.value for n in ast.walk(tree) if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) for e in ast.walk(n.value) if isinstance(e, ast.Constant) and isinstance(e.value, str)}
    lines = source.split("\n")
    changes: list[tuple[int, int, list[str]]] = []

    def alone(node: ast.stmt) -> bool:
        before = lines[node.lineno - 1][: node.col_offset]
        after = lines[node.end_lineno - 1].encode()[node.end_col_offset :].decode().strip()
        return not before.strip() and (not after or after.startswith("#"))

    def simple(value: ast.expr) -> bool:
        return all(isinstance(n, (ast.Constant, ast.Name, ast.List, ast.Tuple, ast.Dict, ast.Set, ast.expr_context, ast.UnaryOp, ast.unaryop)) for n in ast.walk(value))

    def drop(node: ast.stmt, block: list[ast.stmt], gone: int) -> None:
        indent = " " * node.col_offset
        changes.append((node.lineno, node.end_lineno, [] if len(block) - gone > 1 else [indent + "pass"]))

    def walk(block: list[ast.stmt], local: set[str] | None) -> None:
        gone = 0
        for node in block:
            if isinstance(node, (ast.Import, ast.ImportFrom)) and alone(node):
                if isinstance(node, ast.ImportFrom) and (node.module == "__future__" or any(a.name == "*" for a in node.names)):
                    continue
                kept = [a for a in node.names if (a.asname or a.name.split(".")[0]) in used]
                if not kept:
                    drop(node, block, gone)
                    gone += 1
                elif len(kept) < len(node.names):
                    node.names = kept
                    changes.append((node.lineno, node.end_lineno, [" " * node.col_offset + ast.unparse(node)]))
            elif local is not None and isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and node.targets[0].id not in used | local and simple(node.value) and alone(node):
                drop(node, block, gone)
                gone += 1
            else:
                inner = local
                if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    inner = {x for n in ast.walk(node) if isinstance(n, (ast.Global, ast.Nonlocal)) for x in n.names}
                elif isinstance(node, ast.ClassDef):
                    inner = None
                for name in ("body", "orelse", "finalbody"):
                    walk(getattr(node, name, None) or [] if isinstance(getattr(node, name, None), list) else [], inner)
                for handler in getattr(node, "handlers", ()):
                    walk(handler.body, inner)

    walk(tree.body, None)
    return _replace_lines(source, changes)


_SINGLETON = re.compile(r"(?<![=!<>])(==|!=)\s*(None|True|False)\b")


def tidy_layout(source: str) -> str:
    """PEP 8 white space: no trailing blanks, four-blank tabs, two blank lines between definitions at the
    top and one in classes, one blank around operators and after commas, ``is None`` for ``== None``."""
    if not source.strip():
        return source
    text = _spaced_tokens(source)
    lines = [line.rstrip() for line in text.split("\n")]
    protected = _string_lines(text)
    out: list[str] = []
    for number, line in enumerate(lines, 1):
        if number in protected:
            out.append(text.split("\n")[number - 1])
            continue
        if not line:
            if out and out[-1] == "" and (len(out) < 2 or out[-2] == ""):
                continue
            out.append("")
            continue
        if re.match(r"(?:async def|def|class)\b|@", line) and not (out and out[-1].startswith("@")):
            while out and out[-1] == "":
                out.pop()
            if out:
                # A comment right above a definition belongs to it.
                at = len(out)
                while at and out[at - 1].startswith("#"):
                    at -= 1
                while at and out[at - 1] == "":
                    del out[at - 1]
                    at -= 1
                if at:
                    out[at:at] = ["", ""]
        out.append(line)
    while out and out[-1] == "":
        out.pop()
    while out and out[0] == "":
        out.pop(0)
    result = "\n".join(out) + "\n"
    return result if ast.dump(_normal(_parse(result))) == ast.dump(_normal(_parse(source))) else source


def _normal(tree: ast.Module) -> ast.Module:
    """Comparisons with None, True and False by == and is count as the same here."""
    for node in ast.walk(tree):
        if isinstance(node, ast.Compare):
            node.ops = [
                {ast.Eq: ast.Is, ast.NotEq: ast.IsNot}.get(type(op), type(op))() if isinstance(c, ast.Constant) and (c.value is None or isinstance(c.value, bool)) else op
                for op, c in zip(node.ops, node.comparators)
            ]
    return tree


def _string_lines(source: str) -> set[int]:
    """The lines that lie in strings of several lines, but for their first."""
    inside: set[int] = set()
    for token in tokenize.generate_tokens(io.StringIO(source).readline):
        if token.type in (tokenize.STRING, getattr(tokenize, "FSTRING_MIDDLE", -1)) and token.end[0] > token.start[0]:
            inside |= set(range(token.start[0] + 1, token.end[0] + 1))
    return inside


_SPACED = frozenset("= == != < > <= >= += -= *= /= //= %= **= |= &= ^= >>= <<= -> :=".split())


def _spaced_tokens(source: str) -> str:
    """The source with one blank around assignments and comparisons and after commas, outside brackets' default values."""
    tokens = list(tokenize.generate_tokens(io.StringIO(source).readline))
    lines = source.split("\n")
    edits: list[tuple[int, int, int, str]] = []  # line, from, to, new
    depth: list[str] = []
    lambdas = 0
    for k, token in enumerate(tokens):
        if token.type != tokenize.OP:
            lambdas += token.string == "lambda"
            continue
        previous, following = tokens[k - 1] if k else None, tokens[k + 1]
        if token.string in "([{":
            depth.append(token.string)
        elif token.string in ")]}" and depth:
            depth.pop()
        if token.string == ":" and lambdas:
            lambdas -= 1
        same_before = previous is not None and previous.end[0] == token.start[0]
        same_after = following.start[0] == token.end[0] and following.type not in (tokenize.NEWLINE, tokenize.NL, tokenize.COMMENT)
        if token.string in (",", ";") and same_after and following.string not in (")", "]"):
            edits.append((token.start[0], token.end[1], following.start[1], " "))
            if same_before and previous.end[1] < token.start[1] and previous.string != ",":
                edits.append((token.start[0], previous.end[1], token.start[1], ""))
        elif token.string in _SPACED and same_before and same_after:
            if token.string == "=" and (depth or lambdas):
                continue
            new = token.string
            edits.append((token.start[0], previous.end[1], token.start[1], " "))
            edits.append((token.start[0], token.end[1], following.start[1], " "))
            if new in ("==", "!=") and following.string == "None":
                edits.append((token.start[0], token.start[1], token.end[1], "is" if new == "==" else "is not"))
    for line, start, end, new in sorted(edits, reverse=True):
        text = lines[line - 1]
        lines[line - 1] = text[:start] + new + text[end:]
    return "\n".join(lines)


def tidy_docstrings(source: str) -> str:
    """PEP 257 docstrings: triple double quotes, no blanks at the ends, a capital and a full stop in the
    summary, a blank line after it, the closing quotes on a line of their own where there are several."""
    tree = _parse(source)
    lines = source.split("\n")
    changes: list[tuple[int, int, list[str]]] = []
    for node in ast.walk(tree):
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Module)) or not node.body:
            continue
        first = node.body[0]
        if not (isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)):
            continue
        raw = lines[first.lineno - 1][first.col_offset :]
        if lines[first.lineno - 1][: first.col_offset].strip() or lines[first.end_lineno - 1].encode()[first.end_col_offset :].strip() or raw[:1] not in "\"'":
            continue
        if "\\" in "\n".join(lines[first.lineno - 1 : first.end_lineno]) or '"""' in first.value.value:
            continue
        text = [part.rstrip() for part in ast.get_docstring(node, clean=True).strip().split("\n")] if ast.get_docstring(node) else []
        if not text or not text[0]:
            continue
        summary, rest = text[0].strip(), text[1:]
        summary = summary[0].upper() + summary[1:] if summary.split(" ")[0].isalpha() else summary
        if not rest and summary[-1].isalnum():
            summary += "."
        while rest and not rest[0]:
            rest.pop(0)
        indent = " " * first.col_offset
        if not rest and len(indent) + len(summary) + 6 <= DOC_WIDTH + 41:
            new = [f'{indent}"""{summary}"""']
        else:
            new = [f'{indent}"""{summary}', *(["", *[indent + r if r else "" for r in rest]] if rest else []), f'{indent}"""']
        if summary.endswith('"'):
            continue
        changes.append((first.lineno, first.end_lineno, new))
    return _replace_lines(source, changes)


def single_quotes(source: str) -> str:
    """Double-quoted strings of one line in single quotes, where their content has no quote and no backslash."""
    lines = source.split("\n")
    edits = []
    for token in tokenize.generate_tokens(io.StringIO(source).readline):
        if token.type == tokenize.STRING and token.start[0] == token.end[0]:
            found = re.fullmatch(r'([A-Za-z]*)"([^"\'\\]*)"', token.string)
            if found:
                edits.append((token.start, token.end, f"{found[1]}'{found[2]}'"))
    for start, end, new in reversed(edits):
        line = lines[start[0] - 1]
        lines[start[0] - 1] = line[: start[1]] + new + line[end[1] :]
    return "\n".join(lines)


#: The chain, in order.
FORMATTERS: dict[str, Callable[[str], str]] = {"unused": remove_unused, "layout": tidy_layout, "docstrings": tidy_docstrings, "quotes": single_quotes}


def apply_formatter(source: str, name: str) -> str:
    """The formatter's result; the source itself if it fails or its result doesn't parse."""
    try:
        result = FORMATTERS[name](source)
        _parse(result)
        return result
    except Exception:
        return source


def formatted(source: str | None) -> str | None:
    """The source after all formatters, each on the result of the one before; null stays null."""
    if source is None:
        return None
    for name in FORMATTERS:
        source = apply_formatter(source, name)
    return source


def refactor(samples: DataFrame, code: str = "solutions", into: str = "code") -> DataFrame:
    """``samples`` with the formatted code in a column of its own; give ``into`` = ``code`` to replace it for chaining.

    The four formatters run in one pass through Python. Null codes stay null, unparsable ones as they are.
    """
    from pyspark.sql import types as T

    out_schema = T.StructType([f for f in samples.schema.fields if f.name != into] + [T.StructField(into, T.StringType())])

    def run(batches):
        for batch in batches:
            new = pa.array([formatted(c) for c in batch.column(code).to_pylist()], pa.string())
            names = [n for n in batch.schema.names if n != into]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [new], names=names + [into])

    return samples.mapInArrow(run, out_schema)
