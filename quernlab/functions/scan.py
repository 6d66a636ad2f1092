"""A static scanner of Python source: a registry of rules over the syntax tree, one finding per match.

A representative subset of what scanners look for; ``scan_code`` takes any registry of the same shape.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

@dataclass(frozen=True)
class Rule:
    check_id: str
    severity: str
    category: str
    match: Callable[[ast.AST], bool]
    cwe: tuple[str, ...] = ()
    owasp: tuple[str, ...] = ()
    impact: str | None = None
    confidence: str | None = None
    extra: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Calls:
    """Matches calls of some functions, by their dotted names as written; ``findings_of`` looks all of them up at once."""

    names: frozenset[str]

    def __call__(self, node: ast.AST) -> bool:
        return isinstance(node, ast.Call) and _dotted(node.func) in self.names


def _calls(*names: str) -> Calls:
    return Calls(frozenset(names))


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _argument(node: ast.AST, name: str, value: object) -> bool:
    return isinstance(node, ast.Call) and any(k.arg == name and isinstance(k.value, ast.Constant) and k.value.value is value for k in node.keywords)


def _shell(node: ast.AST) -> bool:
    return _argument(node, "shell", True)


def _unverified(node: ast.AST) -> bool:
    return _argument(node, "verify", False)


def _debug_server(node: ast.AST) -> bool:
    return _argument(node, "debug", True) and isinstance(node.func, ast.Attribute) and node.func.attr == "run"


def _no_autoescape(node: ast.AST) -> bool:
    return _argument(node, "autoescape", False)


def _any_address(node: ast.AST) -> bool:
    return isinstance(node, ast.Constant) and node.value == "0.0.0.0"


def _secret(node: ast.AST) -> bool:
    if not (isinstance(node, ast.Assign) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str) and len(node.value.value) > 3):
        return False
    names = [t.id.lower() for t in node.targets if isinstance(t, ast.Name)]
    return any(part in name for name in names for part in ("password", "passwd", "secret", "api_key", "apikey", "token"))


def _built_query(node: ast.AST) -> bool:
    if not (isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("execute", "executemany", "raw") and node.args):
        return False
    first = node.args[0]
    formatted = isinstance(first, ast.Call) and isinstance(first.func, ast.Attribute) and first.func.attr == "format"
    return isinstance(first, (ast.JoinedStr, ast.BinOp)) or formatted


def _wide_rights(node: ast.AST) -> bool:
    return isinstance(node, ast.Call) and _dotted(node.func) == "os.chmod" and len(node.args) > 1 and isinstance(node.args[1], ast.Constant) and isinstance(node.args[1].value, int) and bool(node.args[1].value & 0o022)


def _assert_tuple(node: ast.AST) -> bool:
    return isinstance(node, ast.Assert) and isinstance(node.test, ast.Tuple) and bool(node.test.elts)


def _compare_none(node: ast.AST) -> bool:
    return isinstance(node, ast.Compare) and any(isinstance(o, (ast.Eq, ast.NotEq)) and isinstance(c, ast.Constant) and c.value is None for o, c in zip(node.ops, node.comparators))


def _doubled_key(node: ast.AST) -> bool:
    if not isinstance(node, ast.Dict):
        return False
    keys = [(type(k.value), k.value) for k in node.keys if isinstance(k, ast.Constant)]
    return len(set(keys)) < len(keys)


def _raise_unfit(node: ast.AST) -> bool:
    return isinstance(node, ast.Raise) and isinstance(node.exc, (ast.Constant, ast.Tuple, ast.List, ast.JoinedStr))


def _return_in_finally(node: ast.AST) -> bool:
    return isinstance(node, ast.Try) and any(isinstance(s, (ast.Return, ast.Break, ast.Continue)) for s in node.finalbody)


def _useless_compare(node: ast.AST) -> bool:
    return isinstance(node, ast.Expr) and isinstance(node.value, ast.Compare)


def _code_after_end(node: ast.AST) -> bool:
    return any(isinstance(s, (ast.Return, ast.Raise, ast.Break, ast.Continue)) for block in (getattr(node, "body", None), getattr(node, "orelse", None)) if isinstance(block, list) for s in block[:-1])


def _self_assignment(node: ast.AST) -> bool:
    return isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], (ast.Name, ast.Attribute)) and ast.unparse(node.targets[0]) == ast.unparse(node.value)


def _changed_while_read(node: ast.AST) -> bool:
    if not (isinstance(node, ast.For) and isinstance(node.iter, ast.Name)):
        return False
    changing = ("append", "remove", "pop", "insert", "extend", "clear", "add", "discard")
    return any(isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in changing and isinstance(n.func.value, ast.Name) and n.func.value.id == node.iter.id for n in ast.walk(node))


def _star_import(node: ast.AST) -> bool:
    return isinstance(node, ast.ImportFrom) and any(a.name == "*" for a in node.names)


def _broad_except(node: ast.AST) -> bool:
    return isinstance(node, ast.ExceptHandler) and isinstance(node.type, ast.Name) and node.type.id in ("Exception", "BaseException")


def _many_parameters(node: ast.AST) -> bool:
    return isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and len(node.args.args) + len(node.args.kwonlyargs) > 8


def _empty_length(node: ast.AST) -> bool:
    return isinstance(node, ast.Compare) and isinstance(node.left, ast.Call) and _dotted(node.left.func) == "len" and isinstance(node.comparators[0], ast.Constant) and node.comparators[0].value == 0 and isinstance(node.ops[0], (ast.Eq, ast.NotEq, ast.Gt))


def _index_loop(node: ast.AST) -> bool:
    return isinstance(node, ast.For) and isinstance(node.iter, ast.Call) and _dotted(node.iter.func) == "range" and len(node.iter.args) == 1 and isinstance(node.iter.args[0], ast.Call) and _dotted(node.iter.args[0].func) == "len"


def _sorted_first(node: ast.AST) -> bool:
    return isinstance(node, ast.Subscript) and isinstance(node.value, ast.Call) and _dotted(node.value.func) == "sorted" and isinstance(node.slice, ast.Constant) and node.slice.value == 0


def _list_of_comprehension(node: ast.AST) -> bool:
    return isinstance(node, ast.Call) and _dotted(node.func) in ("list", "set", "tuple", "sum", "any", "all", "max", "min") and len(node.args) == 1 and isinstance(node.args[0], ast.ListComp)


def _mutable_default(node: ast.AST) -> bool:
    return isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and any(isinstance(d, (ast.List, ast.Dict, ast.Set)) for d in [*node.args.defaults, *node.args.kw_defaults])


def _identity(node: ast.AST) -> bool:
    return isinstance(node, ast.Compare) and any(isinstance(o, (ast.Is, ast.IsNot)) and isinstance(c, ast.Constant) and isinstance(c.value, (int, str, float)) and not isinstance(c.value, bool) for o, c in zip(node.ops, node.comparators))


def _equal_branches(node: ast.AST) -> bool:
    return isinstance(node, ast.If) and bool(node.orelse) and [ast.dump(s) for s in node.body] == [ast.dump(s) for s in node.orelse]


def _same_sides(node: ast.AST) -> bool:
    return isinstance(node, ast.Compare) and len(node.ops) == 1 and ast.dump(node.left) == ast.dump(node.comparators[0])


def _endless(node: ast.AST) -> bool:
    return isinstance(node, ast.While) and isinstance(node.test, ast.Constant) and bool(node.test.value) and not any(isinstance(n, (ast.Break, ast.Return, ast.Raise)) for n in ast.walk(node))


def _bare_except(node: ast.AST) -> bool:
    return isinstance(node, ast.ExceptHandler) and node.type is None


def _silent_except(node: ast.AST) -> bool:
    return isinstance(node, ast.ExceptHandler) and len(node.body) == 1 and isinstance(node.body[0], ast.Pass)


def _shadowing(node: ast.AST) -> bool:
    import builtins

    return isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store) and hasattr(builtins, node.id) and not node.id.startswith("_")


def _string_growth(node: ast.AST) -> bool:
    return isinstance(node, (ast.For, ast.While)) and any(isinstance(n, ast.AugAssign) and isinstance(n.op, ast.Add) and isinstance(n.value, (ast.List, ast.JoinedStr)) for n in ast.walk(node))


def _open_unclosed(node: ast.AST) -> bool:
    return isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and _dotted(node.value.func) == "open"


#: The rules.
RULES = (
    Rule("quern.security.dynamic-eval", "ERROR", "security", _calls("eval", "exec"), ("CWE-95",), ("A03:2021",), "HIGH", "MEDIUM"),
    Rule("quern.security.shell-true", "ERROR", "security", _shell, ("CWE-78",), ("A03:2021",), "HIGH", "HIGH"),
    Rule("quern.security.system-call", "ERROR", "security", _calls("os.system", "os.popen"), ("CWE-78",), ("A03:2021",), "HIGH", "MEDIUM"),
    Rule("quern.security.weak-digest", "WARNING", "security", _calls("hashlib.md5", "hashlib.sha1"), ("CWE-327", "CWE-328"), ("A02:2021",), "MEDIUM", "HIGH"),
    Rule("quern.security.guessable-random", "WARNING", "security", _calls("random.random", "random.randint", "random.choice"), ("CWE-330",), ("A02:2021",), "LOW", "LOW"),
    Rule("quern.security.unsafe-load", "ERROR", "security", _calls("pickle.loads", "pickle.load", "yaml.load", "marshal.loads"), ("CWE-502",), ("A08:2021",), "HIGH", "MEDIUM"),
    Rule("quern.security.weak-cipher", "WARNING", "security", _calls("DES.new", "ARC4.new", "Blowfish.new", "Crypto.Cipher.DES.new", "Crypto.Cipher.ARC4.new"), ("CWE-327",), ("A02:2021",), "MEDIUM", "HIGH"),
    Rule("quern.security.unverified-tls", "ERROR", "security", _unverified, ("CWE-295",), ("A07:2021",), "HIGH", "HIGH"),
    Rule("quern.security.unverified-context", "ERROR", "security", _calls("ssl._create_unverified_context", "ssl.wrap_socket"), ("CWE-295",), ("A07:2021",), "HIGH", "MEDIUM"),
    Rule("quern.security.built-query", "ERROR", "security", _built_query, ("CWE-89",), ("A03:2021",), "HIGH", "LOW"),
    Rule("quern.security.secret-in-source", "WARNING", "security", _secret, ("CWE-798",), ("A07:2021",), "HIGH", "LOW"),
    Rule("quern.security.debug-server", "WARNING", "security", _debug_server, ("CWE-489",), ("A05:2021",), "MEDIUM", "MEDIUM"),
    Rule("quern.security.any-address", "INFO", "security", _any_address, ("CWE-605",), ("A05:2021",), "LOW", "LOW"),
    Rule("quern.security.wide-rights", "WARNING", "security", _wide_rights, ("CWE-732",), ("A01:2021",), "MEDIUM", "MEDIUM"),
    Rule("quern.security.guessable-file", "WARNING", "security", _calls("tempfile.mktemp", "os.tempnam", "os.tmpnam"), ("CWE-377",), ("A01:2021",), "LOW", "HIGH"),
    Rule("quern.security.open-xml", "WARNING", "security", _calls("xml.etree.ElementTree.parse", "ET.parse", "xml.dom.minidom.parse", "xml.sax.parse"), ("CWE-611",), ("A05:2021",), "MEDIUM", "LOW"),
    Rule("quern.security.plain-protocol", "WARNING", "security", _calls("telnetlib.Telnet", "ftplib.FTP", "smtplib.SMTP"), ("CWE-319",), ("A02:2021",), "MEDIUM", "LOW"),
    Rule("quern.security.unpacked-archive", "WARNING", "security", _calls("tarfile.open", "shutil.unpack_archive"), ("CWE-22",), ("A01:2021",), "MEDIUM", "LOW"),
    Rule("quern.security.fetched-address", "INFO", "security", _calls("urllib.request.urlopen", "urlopen"), ("CWE-939",), ("A10:2021",), "LOW", "LOW"),
    Rule("quern.security.no-autoescape", "ERROR", "security", _no_autoescape, ("CWE-79",), ("A03:2021",), "MEDIUM", "MEDIUM"),
    Rule("quern.correctness.assert-tuple", "ERROR", "correctness", _assert_tuple),
    Rule("quern.correctness.doubled-key", "ERROR", "correctness", _doubled_key),
    Rule("quern.correctness.raise-unfit", "ERROR", "correctness", _raise_unfit),
    Rule("quern.correctness.return-in-finally", "WARNING", "correctness", _return_in_finally),
    Rule("quern.correctness.useless-compare", "ERROR", "correctness", _useless_compare),
    Rule("quern.correctness.code-after-end", "WARNING", "correctness", _code_after_end),
    Rule("quern.correctness.self-assignment", "WARNING", "correctness", _self_assignment),
    Rule("quern.correctness.changed-while-read", "WARNING", "correctness", _changed_while_read),
    Rule("quern.best-practice.compare-none", "INFO", "best-practice", _compare_none),
    Rule("quern.best-practice.star-import", "INFO", "best-practice", _star_import),
    Rule("quern.best-practice.broad-except", "INFO", "best-practice", _broad_except),
    Rule("quern.best-practice.leftover-breakpoint", "WARNING", "best-practice", _calls("breakpoint", "pdb.set_trace", "ipdb.set_trace")),
    Rule("quern.best-practice.sleeping", "INFO", "best-practice", _calls("time.sleep")),
    Rule("quern.maintainability.many-parameters", "INFO", "maintainability", _many_parameters),
    Rule("quern.maintainability.empty-length", "INFO", "maintainability", _empty_length),
    Rule("quern.maintainability.index-loop", "INFO", "maintainability", _index_loop),
    Rule("quern.performance.sorted-first", "INFO", "performance", _sorted_first),
    Rule("quern.performance.list-of-comprehension", "INFO", "performance", _list_of_comprehension),
    Rule("quern.correctness.identity-literal", "ERROR", "correctness", _identity),
    Rule("quern.correctness.same-sides", "ERROR", "correctness", _same_sides),
    Rule("quern.correctness.mutable-default", "WARNING", "correctness", _mutable_default),
    Rule("quern.correctness.endless-loop", "WARNING", "correctness", _endless),
    Rule("quern.best-practice.bare-except", "INFO", "best-practice", _bare_except),
    Rule("quern.best-practice.silent-except", "INFO", "best-practice", _silent_except),
    Rule("quern.best-practice.open-unclosed", "WARNING", "best-practice", _open_unclosed),
    Rule("quern.maintainability.equal-branches", "WARNING", "maintainability", _equal_branches),
    Rule("quern.maintainability.shadowed-builtin", "INFO", "maintainability", _shadowing),
    Rule("quern.performance.growth-in-loop", "INFO", "performance", _string_growth),
)
FINDING_FIELDS = "check_id string, line int, severity string, category string, cwe array<string>, owasp array<string>, impact string, confidence string"


def findings_of(source: str, rules: tuple[Rule, ...] = RULES) -> Iterator[tuple[Rule, int]]:
    """(rule, line) of every match, by line; raises SyntaxError for a source that doesn't parse."""
    calls: dict[str, list[Rule]] = {}
    others = []
    for rule in rules:
        if isinstance(rule.match, Calls):
            for name in rule.match.names:
                calls.setdefault(name, []).append(rule)
        else:
            others.append(rule)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(source)
    found = []
    for node in ast.walk(tree):
        line = getattr(node, "lineno", None)
        if line is None:
            continue
        if isinstance(node, ast.Call):
            found += [(rule, line) for rule in calls.get(_dotted(node.func), ())]
        found += [(rule, line) for rule in others if rule.match(node)]
    return iter(sorted(found, key=lambda f: (f[1], f[0].check_id)))


def scan_code(df: DataFrame, path: str = "path", code: str = "code", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, is_error, check_id, line, severity, ...): a row per finding, and a row with ``is_error`` per file that doesn't parse.

    Null and blank codes have neither. Files are scanned where they are read; nothing is written.
    """
    schema = T.StructType([df.schema[path], T.StructField("is_error", T.BooleanType())] + T.StructType.fromDDL(FINDING_FIELDS).fields)

    def run(batches):
        lists = pa.list_(pa.string())
        types = [pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.string(), lists, lists, pa.string(), pa.string()]
        for batch in batches:
            rows, at = [], []
            for i, source in enumerate(batch.column(code).to_pylist()):
                if not source or not source.strip():
                    continue
                try:
                    new = [(False, r.check_id, line, r.severity, r.category, list(r.cwe) or None, list(r.owasp) or None, r.impact, r.confidence) for r, line in findings_of(source, rules)]
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    new = [(True, *[None] * 8)]
                rows += new
                at += [i] * len(new)
            columns = list(zip(*rows)) or [()] * 9
            arrays = [batch.column(path).take(pa.array(at, pa.int64()))] + [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return df.select(path, code).mapInArrow(run, schema)
