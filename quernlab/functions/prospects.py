"""Whether every rewrite of a program must fail its tests, told from its source without running it.

``hopeless`` is a proof and no guess: where it says yes, each result of ``rewrite.REWRITES`` on the source
fails a test, whatever else it does, so neither rewriting nor running it can give a program that passes.
Where it says no, nothing is known. All rewrites leave alone what the proofs rest on: the order of the
statements at the top of a module, the names and the numbers of parameters of its functions and classes,
its imports, and an if without else. They bring in no names but ``temp_1``, ``x_iter`` and built-in ones.
"""

from __future__ import annotations

import ast
import builtins
import re
import warnings

from quernlab.functions.compare import stdout_matches

_WORD, _WORD_BEFORE, _CALLED = re.compile(r"[^\W\d]\w*"), re.compile(r"\w"), re.compile(r"\s*\(")
_INPUT_BOUND = re.compile(r"\binput\b(?!\s*\()|\b(?:def|class)\s+input\b")
# Words through which a program could bind names, read its standard input, print or be
# called in ways that its top doesn't show; a source with one of them, even in a comment, is not looked at.
_OPAQUE = frozenset(
    "exec eval compile globals locals vars getattr setattr delattr breakpoint open sys os builtins importlib global nonlocal "
    "Solution stdin stdout gi_frame ag_frame cr_frame f_globals f_builtins f_locals f_back tb_frame code".split()
)
# Modules that on import do nothing that can be seen, and whose functions bind no names of their callers.
_PLAIN_MODULES = frozenset("sys bisect heapq collections math cmath itertools functools string random re typing decimal fractions statistics".split())
_HIDDEN = re.compile(r"\b(?:__(?!name__\b|main__\b|init__\b)|temp_\d|main)|_iter\b|:=|\t|\\[\r\n]|import\s*\(?\s*\*")
#: An import of sys, which is no matter where the word stands nowhere else.
_UNUSED = re.compile(r"^import sys$", re.M)


def _given() -> frozenset[str]:
    """Names that a program has without binding them."""
    from quernlab.functions.sandbox_server import PREAMBLE

    space: dict = {}
    exec(PREAMBLE, space)
    return frozenset(space) | frozenset(dir(builtins))


_GIVEN: frozenset[str] | None = None


def _quiet(node: ast.expr | None) -> bool:
    """Whether an expression is a name, a constant or a subscript of such, so that it calls nothing of the program's."""
    if isinstance(node, ast.Subscript):
        return _quiet(node.value) and _quiet(node.slice)
    if isinstance(node, ast.Tuple):
        return all(map(_quiet, node.elts))
    return node is None or isinstance(node, (ast.Name, ast.Constant))


def _quiet_function(node: ast.stmt) -> bool:
    """A function whose definition runs nothing but itself."""
    if type(node) is not ast.FunctionDef or node.decorator_list or node.type_params:
        return False
    args = node.args
    every = [*args.posonlyargs, *args.args, *args.kwonlyargs, *(a for a in (args.vararg, args.kwarg) if a)]
    return _quiet(node.returns) and all(_quiet(a.annotation) for a in every) and all(map(_quiet, args.defaults)) and all(map(_quiet, args.kw_defaults))


def _quiet_class(node: ast.stmt) -> bool:
    if type(node) is not ast.ClassDef or node.decorator_list or node.bases or node.keywords or node.type_params:
        return False
    return all(_quiet_function(s) or (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant)) or isinstance(s, ast.Pass) for s in node.body)


def _plain_import(node: ast.stmt) -> bool:
    if isinstance(node, ast.Import):
        return all(a.name in _PLAIN_MODULES for a in node.names)
    return isinstance(node, ast.ImportFrom) and node.level == 0 and node.module in _PLAIN_MODULES


def _is_main_guard(node: ast.stmt) -> bool:
    if not isinstance(node, ast.If) or node.orelse or not isinstance(node.test, ast.Compare):
        return False
    test = node.test
    return isinstance(test.left, ast.Name) and test.left.id == "__name__" and len(test.ops) == 1 and isinstance(test.ops[0], ast.Eq) and isinstance(test.comparators[0], ast.Constant) and test.comparators[0].value == "__main__"


def _reads_input(node: ast.expr) -> bool:
    """``input()`` or ``int(input())``, or another name in the place of ``int``."""
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        return (node.func.id == "input" and not node.args) or (len(node.args) == 1 and isinstance(node.args[0], ast.Call) and _reads_input(node.args[0]))
    return False


def _reach(name: str, source: str, tree: ast.Module) -> bool | tuple[int, int]:
    """True if a module never binds a name; from how many arguments to how many it takes, if a function at the top does and nothing else can; False where neither is sure."""
    made = at = 0
    while (at := source.find(name, at)) >= 0:
        end = at + len(name)
        if not _WORD_BEFORE.match(source, max(at - 1, 0), at) and not _WORD.match(source, end) and not source[end : end + 1].isdigit():
            if not _CALLED.match(source, end):
                return False  # it may be bound by more than a definition
            made += source[:at].rstrip().endswith(("def", "class"))
        at = end
    if not made:
        return True
    top = [s for s in tree.body if isinstance(s, (ast.FunctionDef, ast.ClassDef)) and s.name == name]
    inner = sum(isinstance(s, ast.FunctionDef) and s.name == name for c in tree.body if isinstance(c, ast.ClassDef) for s in c.body)
    if len(top) + inner != made or len(top) > 1:
        return False
    if not top:
        return True
    args = top[0].args if isinstance(top[0], ast.FunctionDef) and not top[0].decorator_list else None
    if args is None or args.vararg or args.kwarg or args.kwonlyargs:
        return False
    most = len(args.posonlyargs) + len(args.args)
    return most - len(args.defaults), most


def _misses(found: bool | tuple[int, int], count: int) -> bool:
    return found is True or (found is not False and not found[0] <= count <= found[1])


# Words through which an operand of what isn't a number could answer it: views of dictionaries, arrays.
_ANSWERING = frozenset("keys items viewkeys np numpy".split())
_OTHERS = (str, list, tuple, dict, type(None))
_RANGE_BOUND = re.compile(r"\brange\b(?!\s*\()|\b(?:def|class|as|import)\s+range\b")
_BARE = (ast.Sub, ast.Div, ast.FloorDiv)
_ORDERS = (ast.Lt, ast.LtE, ast.Gt, ast.GtE)


def _is_number(node: ast.expr, numbers: set[str]) -> bool:
    """A number, a name in numbers, or what an empty dictionary, there by its name and .get, gives for want of a key."""
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name):
        return f"{node.func.value.id}.{node.func.attr}" in numbers and len(node.args) == 2 and not node.keywords and isinstance(node.args[0], ast.Constant) and _is_number(node.args[1], set())
    return (isinstance(node, ast.Constant) and type(node.value) in (int, float)) or (isinstance(node, ast.Name) and node.id in numbers)


def _clash(left: ast.expr, op: ast.operator, right: ast.expr, others: set[str], numbers: set[str]) -> bool:
    """Whether an operation raises: others are no numbers."""
    if isinstance(left, ast.Name) and left.id in others:
        return isinstance(op, _BARE) or (isinstance(op, ast.Add) and _is_number(right, numbers))
    return isinstance(right, ast.Name) and right.id in others and isinstance(op, (*_BARE, ast.Add)) and _is_number(left, numbers)


def _breaks(node: ast.expr | None, others: set[str], numbers: set[str], missing: set[str]) -> bool:
    """Whether evaluating an expression asks, whatever happens, for a missing name or for an operation that raises."""
    sets = (others, numbers, missing)
    match node:
        case ast.Name(id=name):
            return name in missing
        case ast.BinOp(left=left, op=op, right=right):
            return _clash(left, op, right, others, numbers) or _breaks(left, *sets) or _breaks(right, *sets)
        case ast.Compare(left=left, ops=[op, *_], comparators=[right, *_]):
            mixed = any(isinstance(x, ast.Name) and x.id in others and _is_number(y, numbers) for x, y in ((left, right), (right, left)))
            return (mixed and isinstance(op, _ORDERS)) or _breaks(left, *sets) or _breaks(right, *sets)
        case ast.Call(func=ast.Name(id=name), args=args):
            if name == "range" and len(args) == 1 and not node.keywords and isinstance(args[0], ast.Name) and args[0].id in others:
                return True
            return name in missing or any(_breaks(a, *sets) for a in args)
        case ast.ListComp(generators=[first, *_]):
            return _breaks(first.iter, *sets)
        case ast.UnaryOp(operand=operand):
            return _breaks(operand, *sets)
        case ast.IfExp(test=test):
            return _breaks(test, *sets)
    return False


def _bound_outside(tree: ast.Module) -> set[str] | None:
    """The names that a module binds at its top; None if by assignments, which renaming could give the name of another."""
    bound: set[str] = set()
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.ClassDef)):
            bound.add(node.name)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            bound |= {a.asname or a.name.partition(".")[0] for a in node.names}
        elif not _is_main_guard(node) and not (isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant)):
            return None
    return bound if all(not _names(g, stored=True) for g in tree.body if isinstance(g, ast.If)) else None


def _names(node: ast.AST, stored: bool = False) -> set[str]:
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and not (stored and isinstance(n.ctx, ast.Load))}


def _turns(node: ast.stmt) -> str | None:
    """The name that a loop sets to a number, if the loop comes to the end of its body at least once or fails."""
    if not isinstance(node, ast.For) or not isinstance(node.target, ast.Name) or any(isinstance(n, (ast.Break, ast.Continue)) for n in ast.walk(node)):
        return None
    call = node.iter
    whole = isinstance(call, ast.Call) and isinstance(call.func, ast.Name) and call.func.id == "range" and len(call.args) == 1 and not call.keywords
    count = call.args[0] if whole else None
    return node.target.id if isinstance(count, ast.Constant) and type(count.value) is int and count.value > 0 else None


def _breaking(block: list[ast.stmt], others: set[str], numbers: set[str], missing: set[str], before: set[str] | None = None) -> list[int]:
    """Which statements of a block raise, were they the first to, if the block is run to its end.

    Binary operations in a loop may be moved before it, so there only what is a number ``before`` it counts for them.
    """
    found = []
    others, numbers, missing = set(others), set(numbers), set(missing)
    for i, node in enumerate(block):
        if not (i and isinstance(block[i - 1], ast.While)):
            at, breaks = None, False
            match node:
                case ast.Assign(value=at) if not isinstance(at, ast.Tuple):
                    pass
                case ast.Expr(value=at) | ast.Return(value=at) | ast.Assert(test=at) | ast.If(test=ast.Compare() as at) | ast.For(iter=at):
                    pass
                case ast.AugAssign(target=ast.Name() as target, op=op, value=at):
                    breaks = target.id in missing or _clash(target, op, at, others, numbers)
                case _:
                    at = None
            if not breaks and (turn := _turns(node)):
                inside = {n for s in node.body for n in _names(s, stored=True)}
                fixed = {n for n in (numbers if before is None else before) if "." not in n} - _names(node, stored=True)
                breaks = bool(_breaking(node.body, others - {turn}, numbers | ({turn} - inside), missing - {turn}, fixed))
            if breaks or _breaks(at, others, numbers if before is None else before, missing):
                found.append(i)
        others -= _names(node, stored=True)
        missing -= _names(node, stored=True)
        numbers = {n for n in numbers if n.removesuffix(".get") not in (_names(node) if n.endswith(".get") else _names(node, stored=True))}
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            if isinstance(node.value, ast.Dict) and not node.value.keys:
                numbers.add(f"{node.targets[0].id}.get")
            elif isinstance(node.value, ast.Constant) and _is_number(node.value, set()):
                numbers.add(node.targets[0].id)
        if not others and not missing:
            break
    return found


def _rejects(function: ast.FunctionDef, arguments: list, source: str, tree: ast.Module) -> bool:
    """Whether a call fails as some arguments are text, lists, dictionaries or None, or as a name isn't there.

    Before it is set anew, such a parameter meets, in a statement that each call gets to, an operation
    for numbers; or such a statement asks for a name that is bound nowhere outside and not yet inside. The only return is the last statement. Rewriting changes the places of statements
    that have no name in common only, so what is set before is set before then, too, and drops none but
    what follows a while loop; whether the return gets before that statement is tried on their names.
    """
    parameters = [p.arg for p in (*function.args.posonlyargs, *function.args.args)]
    others = {p for p, kind in zip(parameters, arguments) if kind in _OTHERS}
    numbers = {p for p, kind in zip(parameters, arguments) if kind in (int, float)}
    words = _WORD.findall(source)
    imports = [s for s in tree.body if isinstance(s, (ast.Import, ast.ImportFrom))]
    if not _ANSWERING.isdisjoint(words) or words.count("import") != len(imports) or not all(map(_plain_import, imports)) or _RANGE_BOUND.search(source):
        return False
    outside = _bound_outside(tree)
    missing = set() if outside is None else {n for n in _names(function) if _told(n)} - outside - set(parameters)
    found = _breaking(function.body, others, numbers, missing)
    if not found:
        return False
    returns = 0
    for statement in function.body:
        for node in ast.walk(statement):
            if isinstance(node, ast.Return):
                returns += 1
            elif isinstance(node, (ast.Yield, ast.YieldFrom, ast.Await, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Match, ast.TryStar)) or (isinstance(node, ast.ExceptHandler) and node.name):
                return False
    last = len(function.body) - 1
    if not isinstance(function.body[last], ast.Return):
        return not returns
    if returns > 1:
        return False
    names = [_names(s) for s in function.body]
    order = list(range(last + 1))
    for i in range(last):
        if not names[order[i]] & names[order[i + 1]]:
            order[i], order[i + 1] = order[i + 1], order[i]
    return any(order.index(i) <= order.index(last) for i in found)


def _fails(name: str, kinds: list, source: str, tree: ast.Module) -> bool:
    """Whether a call of a module's function fails: it isn't there, takes more or fewer arguments, or none of these types, as far as they are known."""
    found = _reach(name, source, tree)
    if _misses(found, len(kinds)):
        return True
    return found is not False and _rejects(next(s for s in tree.body if isinstance(s, ast.FunctionDef) and s.name == name), kinds, source, tree)


_KINDS = {ast.List: list, ast.ListComp: list, ast.Tuple: tuple, ast.Dict: dict}


def _assert_fails(test: str, source: str, tree: ast.Module) -> bool:
    """Whether an assert on a call's result calls what must fail."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            body = ast.parse(test).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    if len(body) != 1 or not isinstance(body[0], ast.Assert):
        return False
    asked = body[0].test
    call = asked.left if isinstance(asked, ast.Compare) else asked
    if not (isinstance(call, ast.Call) and isinstance(call.func, ast.Name)) or call.keywords or any(isinstance(a, ast.Starred) for a in call.args):
        return False
    kinds = [type(a.value) if isinstance(a, ast.Constant) else _KINDS.get(type(a)) for a in call.args]
    return _told(call.func.id) and _fails(call.func.id, kinds, source, tree)


def _told(name: str) -> bool:
    """Whether a name, if a program doesn't bind it, is nothing."""
    return name.isascii() and name.isidentifier() and name not in _GIVEN and not _HIDDEN.search(name)


def _stops_at_top(tree: ast.Module, source: str, fed: bool) -> bool:
    """Whether a statement at the top raises: one that asks for a name bound nowhere, or without input one that reads it.

    Before it stand definitions and imports, then assignments only. Renaming finds no names there, either:
    numbers start anew at functions only, so between the first assignment and the statement no two names are one.
    """
    bound: set[str] = set()
    assigned = False
    for node in tree.body:
        if isinstance(node, (ast.Expr, ast.Assign)) and (value := node.value) is not None:
            if isinstance(value, ast.Constant) and isinstance(node, ast.Expr):
                continue
            if _reads_input(value) and not fed and not assigned and "input" not in bound and not _INPUT_BOUND.search(source):
                return True
            if isinstance(node, ast.Expr):
                if not (isinstance(value, ast.Call) and isinstance(value.func, ast.Name) and value.func.id == "print" and value.args and "print" not in bound):
                    return False
                first = value.args[0]
                first = first.left if isinstance(first, ast.BinOp) else first
                return isinstance(first, ast.Name) and first.id not in bound and _told(first.id)
            if not all(isinstance(t, ast.Name) for t in node.targets) or not (_reads_input(value) or isinstance(value, ast.Constant)):
                return False
            assigned = True
            bound |= {t.id for t in node.targets}
        elif assigned:
            return False
        elif _quiet_function(node) or _quiet_class(node):
            bound.add(node.name)
        elif _plain_import(node):
            bound |= {a.asname or a.name for a in node.names}
        else:
            return False
    return False


def _prints_nothing(tree: ast.Module, source: str) -> bool:
    """Whether a module only defines and imports, but for what it does as the main one, which it is not."""
    guards = [s for s in tree.body if isinstance(s, ast.If)]
    if len(guards) > 1 or not all(map(_is_main_guard, guards)) or source.count("__main__") != len(guards):
        return False
    return all(_quiet_function(s) or _quiet_class(s) or _plain_import(s) or (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant)) for s in tree.body if not isinstance(s, ast.If))


def open_to_view(source: str) -> bool:
    """Whether a source has no way to do what its words don't say."""
    if not source.isascii() or _HIDDEN.search(source):
        return False
    words = _WORD.findall(source)
    hidden = _OPAQUE.intersection(words)
    return not hidden or (hidden == {"sys"} and words.count("sys") == 1 and _UNUSED.search(source) is not None)


def hopeless(source: str, tree: ast.Module, tests: list | dict, isolation: str = "per_test") -> bool:
    """Whether all rewrites of a source that is ``open_to_view``, parsed as ``tree``, fail ``usable`` tests."""
    global _GIVEN
    if _GIVEN is None:
        _GIVEN = _given()
    if isinstance(tests, list):
        return _stops_at_top(tree, source, fed=False) or any(_assert_fails(t, source, tree) for t in (tests if isolation == "per_test" else tests[:1]))
    name, given, wanted = tests.get("fn_name"), tests["inputs"], tests["outputs"]
    if not isinstance(given, list) or not wanted:
        return False
    if name is None:
        if _stops_at_top(tree, source, fed=True):
            return True
        return isinstance(wanted[0], str) and not stdout_matches([], wanted[0]) and _prints_nothing(tree, source)
    if _stops_at_top(tree, source, fed=False):
        return True
    if not isinstance(name, str) or not _told(name):
        return False
    calls = [[x[0]] if x and isinstance(x[0], dict) else x for x in given if isinstance(x, list)]
    return any(_fails(name, [*map(type, x)], source, tree) for x in calls)


# Words by which a program could change what programs after it in its process meet.
_LASTING = frozenset("random np numpy decimal register update_wrapper wraps singledispatch MemoryError RecursionError BaseException".split())
_ONE_ASSERT = re.compile(r"assert [^;\n]*")


def leaves_no_trace(source: str, tree: ast.Module, tests: list | dict) -> bool:
    """Whether what a source that is ``open_to_view`` does, and its tests, ends with it, so that other programs may run in its process.

    It imports plain modules only, sets no attributes but of ``self``, and asks for no private ones.
    """
    if isinstance(tests, list) and not all(_ONE_ASSERT.fullmatch(t) and open_to_view(t) and _LASTING.isdisjoint(_WORD.findall(t)) for t in tests):
        return False
    if not _LASTING.isdisjoint(_WORD.findall(source)):
        return False
    for node in ast.walk(tree):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            if not _plain_import(node):
                return False
        elif isinstance(node, ast.Attribute) and (node.attr[0] == "_" or not isinstance(node.ctx, ast.Load)) and not (isinstance(node.value, ast.Name) and node.value.id == "self"):
            return False
        elif isinstance(node, ast.ExceptHandler) and node.type is None:
            return False
    return True
