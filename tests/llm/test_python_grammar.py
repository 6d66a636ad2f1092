import ast
import random
import re
import warnings
from pathlib import Path

import pytest

from quernlab.llm.syntax.check import defect
from quernlab.llm.syntax.lexer import Broken
from quernlab.llm.syntax.python import parse

GOOD = [
    "x = 1", "x: int = yield", "a.b, *c = d[e], f()[g] = h", "(a): int", "for x, in *y, z: pass", "del (a, [b.c, d[e]]), f", "f(*a, b=1, *c, **d)", "f(x for x in y)", "def f(a, /, b=1, *, c, **d) -> e: ...",
    "lambda *, a, b=1: (yield)", "with (a as b, c as d,): pass", "with (a, b) as c: pass", "match x:\n    case [1, *_] | {'a': b, **c} if d: pass\n    case A.B(x, y=-1+2j) as z: pass\n    case _: pass\n", "match = 1; match(x)[y]; print(match)",
    "type X[T: int = str, *Ts, **P] = list[T]", "type = 1", "try: pass\nexcept* A as b: pass\nelse: pass\nfinally: pass", "f'{a!r:>{w}} {b=} {{}}'", "f'{x:{'a'}}'", "f'''{\n1\n}'''", "a if b else lambda: c", "not a == b and not c", "x = a[b:=1, 1:2, *c]",
    "from . import (a, b as c,)", "async def f():\n    async for x in y: await z\n    async with a as b: pass", "@a.b(c)\nclass D[T](E, metaclass=F): pass", "0xF_F + 0b1 + 1_0.5e-3j + 00", "1if x else 2", "if\"a\" in b: pass", "\\\nx = 1", "x = 'a' f'{b}' r'\\d'", "{**a, 'b': c}, {*d, e}", "print(*a, sep='')", "try:\n\tx\nfinally:\n\ty\n", "é = 1", "return", "match x:\n    case f'{a}': pass",
]
BAD = [
    "1 = x", "f() = x", "a + b = c", "(a, b) += c", "[a]: int", "(*a)", "x = *a if b else", "f(**a, *b)", "f(a=1, b)", "f(x for x in y, z)", "f(a.b=1)", "f(True=1)", "def f(a=1, b): pass", "def f(*): pass", "def f(*, **k): pass", "def f(a, /, b, /): pass", "from x import a,", "from x import (a, b", "import a.b as c.d", "del f()", "del *a", "for f() in x: pass", "a == not b",
    "except: pass", "try: pass", "try: pass\nexcept: pass\nexcept* A: pass", "if x = 1: pass", "x = (yield = 1)", "print 'x'", "exec \"x\"", "a <> b", "`a`", "01", "1_", "0x", "1a", "'\\x1'", "b'é'", "'a' b'c'", "f'{a!x}'", "f'{}'", "f'}'", "f'{a'", "'a\nb'", "x\n  y", "if x:\ny", "if x:\n    y\n  z", "\tx\n        y", "match x:\n    case *a: pass",
    "class A(x for x in y): pass", "{a: *b}", "{**a for b in c}", "[*a for b in c]", "return *a[:1] == b", "lambda: x = 1", "raise a, b", "x = 1 +", "def f(", "(" * 201 + ")" * 201, "a\0b", "x = $", "\\", "with a as f(): pass", "x.1", "async x", "None = 1", "\ufeffx",
]


def accepted(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return False


def ours(text):
    try:
        parse(text)
        return True
    except Broken:
        return False


@pytest.mark.parametrize("text", GOOD)
def test_valid(text):
    assert accepted(text) and ours(text)


@pytest.mark.parametrize("text", BAD)
def test_invalid(text):
    assert not accepted(text) and not ours(text) and defect(text, "python")


def test_changed_sources_like_the_interpreter():
    rng = random.Random(5)
    pieces = "( ) [ ] { } : , = * ** not in is lambda x 1 . if else for and await yield async def class := -> import as with except ; ... match case del += ! f'{x}' b'y'".split()
    for path in sorted(Path(ast.__file__).parent.glob("[a-d]*.py")):
        parts = re.findall(r"\w+|\s+|[^\w\s]", path.read_text()[:2500])
        for _ in range(6):
            some = list(parts)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(some))
                some[k] = rng.choice(["", some[k] + " " + rng.choice(pieces) + " ", rng.choice(pieces)])
            text = "".join(some)
            assert ours(text) == accepted(text), text


@pytest.mark.parametrize("language, text", [
    ("javascript", "x = " + "(" * 1100 + "1" + ")" * 1100 + ";"), ("javascript", "{" * 5000 + "}" * 5000), ("java", "class A { int x = " + "(" * 1100 + "1" + ")" * 1100 + "; }"), ("java", "class A { void f() " + "{" * 5000 + "}" * 5000 + " }"),
    ("cpp", "int x = " + "(" * 1100 + "1" + ")" * 1100 + ";"), ("cpp", "void f() " + "{" * 5000 + "}" * 5000), ("json", "[" * 5000 + "]" * 5000),
], ids=range(7))
def test_nesting_is_not_limited(language, text):
    assert defect(text, language) is None
    assert defect(text[:-2], language) is not None
