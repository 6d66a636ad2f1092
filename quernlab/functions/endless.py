"""Loops that a program can't leave but by failing."""

from __future__ import annotations

import ast
import re

#: The built-in name of what is raised in their place.
ENDLESS = "__endless__"
# What ends a program, a generator or an iteration without failing.
_QUIET_ENDS = re.compile(r"\b(?:next|StopIteration|StopAsyncIteration|SystemExit|GeneratorExit)\b")
# Names of exceptions but KeyError and ValueError, and what else a handler or a loop could meet that isn't looked for.
_BROAD = re.compile(
    r"\b(?!(?:KeyError|ValueError)\b)\w*(?:Error|Exception|Warning|Interrupt|Group)\b|\b(?:type|bytearray|memoryview|array|decimal|raise)\b"
    r"|\b(?:def|class|as|import)\s+(?:get|values|abs|min|max|len|sum|range|sorted)\b|\b(?:get|values|abs|min|max|len|sum|range|sorted)\b(?!\s*\()"
)
_RANGE_BOUND = re.compile(r"\brange\b(?!\s*\()|\b(?:def|class|as|import)\s+range\b")
_STATEMENTS = (ast.Assign, ast.AugAssign, ast.Expr, ast.If, ast.For, ast.While, ast.Pass, ast.Continue, ast.Assert, ast.Try)
_ORDERS = (ast.Lt, ast.LtE, ast.Gt, ast.GtE)


def _moves_off(statement: ast.stmt, name: str, step: type, counters: set[str]) -> bool:
    """Whether a statement adds to a name, or takes from it, as ``step`` says, a number that isn't below 0."""
    match statement:
        case ast.AugAssign(target=ast.Name(id=target), op=op, value=value):
            pass
        case ast.Assign(targets=[ast.Name(id=target)], value=ast.BinOp(left=ast.Name(id=left), op=op, right=value)) if left == target:
            pass
        case _:
            return False
    whole = (isinstance(value, ast.Constant) and type(value.value) in (int, float) and value.value >= 0) or (isinstance(value, ast.Name) and value.id in counters)
    return target == name and isinstance(op, step) and whole


def _counter(loop: ast.For) -> str | None:
    """The name that a loop over a range from 0, or from a number not below, sets and nothing in it sets otherwise."""
    if not isinstance(loop.target, ast.Name) or not _is_range(loop.iter):
        return None
    args = loop.iter.args
    if len(args) == 2 and not (isinstance(args[0], ast.Constant) and type(args[0].value) is int):
        return None
    stores = sum(isinstance(n, ast.Name) and n.id == loop.target.id and not isinstance(n.ctx, ast.Load) for n in ast.walk(loop))
    return loop.target.id if stores == 1 else None


def _keeps(block: list[ast.stmt], name: str, step: type, counters: set[str]) -> bool:
    """Whether a block sets a name by such statements only, if at all."""
    for statement in block:
        if _moves_off(statement, name, step, counters):
            continue
        inner = [part for field in ("body", "orelse", "finalbody") for part in getattr(statement, field, ())]
        inner += [part for handler in getattr(statement, "handlers", ()) for part in handler.body]
        own = [n for n in ast.iter_child_nodes(statement) if not isinstance(n, (ast.stmt, ast.ExceptHandler))]
        if any(isinstance(n, ast.Name) and n.id == name and not isinstance(n.ctx, ast.Load) for part in own for n in ast.walk(part)):
            return False
        counter = _counter(statement) if isinstance(statement, ast.For) else None
        if not _keeps(inner, name, step, counters | {counter} if counter else counters):
            return False
    return True


def _is_endless(loop: ast.While) -> bool:
    """A comparison of a name with a number, and a body that doesn't set the name, or sets it further off only, and has nothing to leave by.

    What compares with a number is a number, which nothing else changes; so the loop runs for ever or raises.
    """
    test = loop.test
    if not (isinstance(test, ast.Compare) and isinstance(test.left, ast.Name) and len(test.ops) == 1 and isinstance(test.ops[0], _ORDERS)):
        return False
    bound = test.comparators[0]
    if not (isinstance(bound, ast.Constant) and type(bound.value) in (int, float)):
        return False
    for statement in loop.body:
        for node in ast.walk(statement):
            if isinstance(node, ast.stmt) and not isinstance(node, _STATEMENTS):
                return False
            if isinstance(node, (ast.Yield, ast.YieldFrom, ast.Await, ast.NamedExpr)) or (isinstance(node, ast.ExceptHandler) and node.name):
                return False
    return _keeps(loop.body, test.left.id, ast.Add if isinstance(test.ops[0], (ast.Gt, ast.GtE)) else ast.Sub, set())


def _is_range(node: ast.expr) -> bool:
    """A range of one or two names or numbers: a step could be 0."""
    return isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "range" and not node.keywords and len(node.args) in (1, 2) and all(isinstance(a, (ast.Name, ast.Constant)) for a in node.args)


def _is_mild_call(call: ast.Call) -> bool:
    if any(isinstance(a, ast.Starred) for a in call.args):
        return False
    if isinstance(call.func, ast.Attribute):
        return call.func.attr in ("get", "values") and not call.keywords
    if not isinstance(call.func, ast.Name):
        return False
    name, args = call.func.id, call.args
    if name == "sorted":
        return len(args) == 1 and isinstance(args[0], (ast.List, ast.ListComp)) and all(k.arg == "key" and isinstance(k.value, ast.Lambda) for k in call.keywords)
    if call.keywords:
        return False
    if name == "sum":
        return len(args) == 1 and (isinstance(args[0], (ast.List, ast.ListComp)) or (isinstance(args[0], ast.Call) and isinstance(args[0].func, ast.Attribute)))
    return (name in ("abs", "len") and len(args) == 1) or (name in ("min", "max") and len(args) > 1) or _is_range(call)


def _is_mild(loop: ast.While) -> bool:
    """Whether the body can raise no KeyError or ValueError: it computes with names and numbers, fills and adds up dictionaries."""
    every = [n for s in loop.body for n in ast.walk(s)]
    # A text before % is a format; a number is what the loop compares, or what a comprehension takes from a range.
    numeric = {id(n) for c in every if isinstance(c, ast.ListComp) and isinstance(c.generators[0].target, ast.Name) for n in ast.walk(c) if isinstance(n, ast.BinOp) and isinstance(n.left, ast.Name) and n.left.id == c.generators[0].target.id}
    for node in every:
        match node:
            case ast.For(iter=source) | ast.comprehension(iter=source):
                if not (isinstance(node.target, ast.Name) and _is_range(source)):
                    return False
            case ast.BinOp(op=ast.Mod()):
                if not (id(node) in numeric or (isinstance(node.left, ast.Name) and node.left.id == loop.test.left.id)):
                    return False
            case ast.BinOp(op=op):
                if not isinstance(op, (ast.Add, ast.Sub, ast.Mult, ast.FloorDiv, ast.Div)):
                    return False
            case ast.AugAssign(op=op, target=target):
                if not (isinstance(op, (ast.Add, ast.Sub, ast.Mult)) and isinstance(target, ast.Name)):
                    return False
            case ast.Compare(ops=ops):
                if not all(isinstance(op, (*_ORDERS, ast.Eq, ast.NotEq, ast.Is, ast.IsNot)) for op in ops):
                    return False
            case ast.Call():
                if not _is_mild_call(node):
                    return False
            case ast.Attribute(attr=attr):
                if attr not in ("get", "values"):
                    return False
            case ast.Subscript(value=ast.Call(func=ast.Name(id="sorted")), slice=ast.Constant()):
                pass  # a list, so at worst an IndexError
            case ast.Subscript():
                # What is read at an index may not be there.
                if not (isinstance(node.value, ast.Name) and isinstance(node.slice, ast.Constant) and isinstance(node.ctx, ast.Store)):
                    return False
            case ast.Assign(targets=targets):
                if not all(isinstance(t, (ast.Name, ast.Subscript)) for t in targets):
                    return False
            case ast.Dict(keys=[_, *_]) | ast.Set() | ast.JoinedStr() | ast.SetComp() | ast.DictComp() | ast.GeneratorExp() | ast.Starred():
                return False
    return True


def _cut(node: ast.AST, mild: bool = False) -> int:
    """Cut all endless loops below a node; how many there were, or a negative number if something else could catch what they raise.

    With ``mild``, handlers of KeyError and ValueError may be around those loops that can raise neither.
    """
    count = 0
    for child in ast.iter_child_nodes(node):
        if isinstance(child, ast.While) and _is_endless(child) and (not mild or _is_mild(child)):
            child.body = [ast.Raise(exc=ast.Name(id=ENDLESS, ctx=ast.Load()), cause=None)]
            ast.fix_missing_locations(child)
            count += 1
        elif isinstance(child, (ast.TryStar, ast.With, ast.AsyncWith)) or (isinstance(child, ast.Try) and not (mild and not child.finalbody and all(_is_narrow(h.type) for h in child.handlers))):
            return -1
        elif isinstance(child, (ast.stmt, ast.mod, ast.match_case, ast.ExceptHandler)):
            if (below := _cut(child, mild)) < 0:
                return -1
            count += below
    return count


def _is_narrow(kind: ast.expr | None) -> bool:
    """Of a source without _BROAD words, whether a handler can be for KeyError and ValueError only; a renamed one is for what no name stands for."""
    return isinstance(kind, ast.Name) or (isinstance(kind, ast.Tuple) and all(isinstance(x, ast.Name) for x in kind.elts))


def without_endless_loops(source: str) -> ast.Module | None:
    """The tree of a program, whose words say what it does, that raises where it would enter an endless loop.

    Once in such a loop a program is late or fails: only a handler could bring it to another end, and
    where one is outside these loops, or there is no such loop, the result is None.
    """
    if _QUIET_ENDS.search(source) or _RANGE_BOUND.search(source):
        return None
    try:
        tree = ast.parse(source)
        found = _cut(tree)
        if found < 0 and not _BROAD.search(source):
            found = _cut(tree := ast.parse(source), mild=True)
        return tree if found > 0 else None
    except (RecursionError, MemoryError):
        return None
