"""Lexers with a pushdown stack.

``scan`` cuts a text of the C family into tokens and keeps the open brackets on a stack. It reports
literals and comments that don't end, brackets that don't match, texts that end inside brackets, and
the markers of an unresolved merge outside literals and comments. ``scan_python`` does the same for
Python, looking only at what changes the state.
"""

from __future__ import annotations

import re

UNTERMINATED, UNBALANCED, PREMATURE, CONFLICT, INVALID = "unterminated_literal", "unbalanced_delimiter", "premature_end", "merge_conflict", "invalid_syntax"

_CLOSER = {"(": ")", "[": "]", "{": "}"}
_CONFLICT = r"^(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|$)"
_NUMBER = r"(?:0[xX][0-9a-fA-F_'.]+(?:[pP][+-]?\d+)?|0[bB][01_']+|\.?\d(?:[eE][+-]|[\w.]|'(?=\w))*)"
_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
_WORD = r"(?:[A-Za-z_$]|[^\W\d]|\\u[0-9a-fA-F]{4})(?:[\w$]|\\u[0-9a-fA-F]{4})*"
_STRING = r'"[^"\\\n]*(?:\\(?:\r\n|[\s\S])[^"\\\n]*)*"'
_CHAR = r"'[^'\\\n]*(?:\\(?:\r\n|[\s\S])[^'\\\n]*)*'"
# ">" is always one token, as it may end type arguments; the parsers join what belongs together.
_OPERATOR = {
    "java": r"->|::|\.\.\.|\+\+|--|&&|\|\||<<=|<<|[-+*/%&|^!=<]=|[-+*/%&|^!=<>?:;,.@~(){}\[\]]",
    "cpp": r"->\*|->|::|\.\.\.|\.\*|\+\+|--|&&|\|\||<<=|<<|\#\#|[-+*/%&|^!=<]=|[-+*/%&|^!=<>?:;,.~(){}\[\]]",
    "js": r"=>|\.\.\.|\+\+|--|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|\*\*=|\*\*|<<=|<<|>>>=|>>>|>>=|>>|>=|===|!==|[-+*/%&|^!=<]=|[-+*/%&|^!=<>?:;,.~@(){}\[\]]",
}


def _rules(lang: str) -> re.Pattern:
    rules = [("space", r"[^\S\n]+|\n"), ("conflict", _CONFLICT)]
    rules.append(("comment", _COMMENT))
    if lang == "java":
        rules.append(("str", r'"""[^\S\n]*\n[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*"""|' + _STRING))
    elif lang == "cpp":
        rules.append(("str", r'(?:u8|[uUL])?R"(?P<mark>[^()\\\s]{0,16})\([\s\S]*?\)(?P=mark)"|(?:u8|[uUL])?' + _STRING))
    else:
        rules.append(("str", _STRING + "|" + _CHAR))
    if lang != "js":
        rules.append(("char", (r"(?:u8|[uUL])?" if lang == "cpp" else "") + (_CHAR if lang == "cpp" else r"'(?:[^'\\\n]|\\(?:[0-7]{1,3}|u+[0-9a-fA-F]{4}|[^\n]))'")))
    rules += [("num", _NUMBER + ("n?" if lang == "js" else "")), ("word", ("#?" if lang == "js" else "") + _WORD), ("op", _OPERATOR[lang])]
    return re.compile("|".join(f"(?P<{n}>{r})" for n, r in rules), re.MULTILINE)


_RULES = {lang: _rules(lang) for lang in _OPERATOR}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[\w$]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_DIRECTIVE = re.compile(r"[^\S\n]*#(?:[^\n\\]|\\\r?\n|\\)*")
_NUM_OK = {
    "java": re.compile(r"(?:0[xX](?:_*[0-9a-fA-F][0-9a-fA-F_]*\.?[0-9a-fA-F_]*|\.[0-9a-fA-F][0-9a-fA-F_]*)(?:[pP][+-]?\d+)?|0[bB][01][01_]*|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[lLfFdD]?\Z"),
    "js": re.compile(r"(?:0[xX][0-9a-fA-F][0-9a-fA-F_]*n?|0[bB][01][01_]*n?|0[oO][0-7][0-7_]*n?|\d[\d_]*n|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)\Z"),
    "cpp": re.compile(r"(?:0[xX][0-9a-fA-F'.]+(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*\.?[\d']*|\.\d[\d']*)(?:[eE][+-]?\d+)?)(?:[uUlLfFzZ]{0,3}|_\w+|[a-z]+)\Z"),
}
_NO_VALUE = frozenset("return typeof case in of do else void delete throw new instanceof yield await".split())


class Broken(Exception):
    """A text that isn't valid source; args: the kind of defect and the offset."""


class Tokens:
    """Parallel lists: the texts, the kinds (word, num, str, char, op, template, regex), whether a line
    ends before the token, whether it touches the one before, and where the bracket it opens closes."""

    __slots__ = ("text", "kind", "line", "glued", "match")

    def __init__(self):
        self.text, self.kind, self.line, self.glued, self.match = [], [], [], [], {}


def _directive(line: str, stack: list) -> None:
    name, _, rest = re.sub(r"\\\r?\n", " ", line).strip()[1:].strip().partition(" ")
    word = re.match(r"\w*", name)[0]
    rest = (name[len(word):] + " " + rest).strip()
    if word in ("if", "ifdef", "ifndef"):
        stack.append(word)
        if not rest:
            raise Broken(INVALID, 0)
    elif word in ("elif", "else", "endif"):
        if not stack or (word != "endif" and stack[-1] == "else"):
            raise Broken(UNBALANCED, 0)
        stack[-1] = "else" if word == "else" else stack[-1]
        if word == "endif":
            stack.pop()
    elif word == "include":
        if not re.match(r'<[^>]+>|"[^"]+"|[A-Za-z_]\w*', rest):
            raise Broken(UNTERMINATED if rest[:1] in ("<", '"') else INVALID, 0)
    elif word in ("define", "undef"):
        if not re.match(r"[A-Za-z_]\w*", rest):
            raise Broken(INVALID, 0)
    elif word not in ("", "pragma", "line", "error", "warning") or word == "error":
        raise Broken(INVALID, 0)


def scan(text: str, lang: str) -> Tokens:
    """The tokens of a Java, C++ or JavaScript text; raises Broken."""
    out, rules, at, end = Tokens(), _RULES[lang], 0, len(text)
    texts, kinds, lines, glued = out.text, out.kind, out.line, out.glued
    stack: list[tuple[str, int]] = []
    conditions: list[str] = []
    line, last = True, 0
    ok = _NUM_OK[lang]
    if lang == "js" and text.startswith("#!"):
        at = text.find("\n") if "\n" in text else end
    if text.startswith("﻿"):
        at = 1

    def template(at: int) -> int:
        found = _TEMPLATE.match(text, at)
        if not found:
            raise Broken(UNTERMINATED, at)
        if found[1] == "${":
            stack.append(("${", -1))
            texts.append("${"); kinds.append("template"); lines.append(False); glued.append(True)
        else:
            texts.append("`"); kinds.append("template"); lines.append(False); glued.append(True)
        return found.end()

    while at < end:
        if lang == "cpp" and line and text[at] in " \t\r#" and (found := _DIRECTIVE.match(text, at)):
            _directive(re.sub(r"//[^\n]*|/\*.*?\*/", " ", found[0]), conditions)
            at = found.end()
            continue
        found = rules.match(text, at)
        kind = found.lastgroup if found else None
        if kind == "mark":
            kind = "str"
        if kind == "space":
            line = line or "\n" in found[0]
            at = found.end()
            continue
        if kind == "comment":
            line = line or "\n" in found[0]
            at = found.end()
            continue
        if kind == "conflict":
            raise Broken(CONFLICT, at)
        char = text[at]
        if lang == "js":
            if char == "`":
                texts.append("`("); kinds.append("template"); lines.append(line); glued.append(False)
                line, at = False, template(at + 1)
                last = at
                continue
            if char == "/" and (not texts or (kinds[-1] == "op" and texts[-1] not in (")", "]", "}")) or texts[-1] in _NO_VALUE or (texts[-1] in (")", "}") and line and not re.match(r"/\s", text[at:at + 2]))):
                found = _REGEX.match(text, at)
                if not found:
                    raise Broken(UNTERMINATED, at)
                kind = "regex"
        if kind is None:
            if char in "\"'":
                raise Broken(UNTERMINATED, at)
            raise Broken(INVALID, at)
        token = found[0]
        if kind == "op":
            if token == "/" and text.startswith("/*", at):
                raise Broken(UNTERMINATED, at)
            if token in _CLOSER:
                stack.append((token, len(texts)))
            elif token in ")]}":
                if not stack:
                    raise Broken(UNBALANCED, at)
                opener, where = stack.pop()
                if opener == "${":
                    if token != "}":
                        raise Broken(UNBALANCED, at)
                    texts.append("}$"); kinds.append("template"); lines.append(line); glued.append(at == last)
                    line, at = False, template(at + 1)
                    last = at
                    continue
                if _CLOSER[opener] != token:
                    raise Broken(UNBALANCED, at)
                out.match[where] = len(texts)
        elif kind == "num" and not ok.match(token):
            raise Broken(INVALID, at)
        texts.append(token); kinds.append(kind); lines.append(line); glued.append(at == last)
        at = last = found.end()
        line = False
    if stack or conditions:
        raise Broken(PREMATURE, end)
    return out


_CONFLICT_LINE = re.compile(_CONFLICT, re.MULTILINE)
_PYTHON = re.compile(
    r"(?P<comment>\#[^\n]*)|(?P<long>\"\"\"|@@@)"
    r"|(?P<str>\"[^\"\\\n]*(?:\\[\s\S][^\"\\\n]*)*\"|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*')"
    r"|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<quote>[\"'])".replace("@", "'")
)
#: The same for a text in which some line looks like a merge marker; it is one outside literals.
_PYTHON_MERGED = re.compile(_PYTHON.pattern + "|(?P<conflict>" + _CONFLICT + ")", re.MULTILINE)
_LONG_END = {q * 3: re.compile(r"[^\\Q]*(?:(?:\\[\s\S]|Q(?!QQ))[^\\Q]*)*QQQ".replace("Q", q)) for q in ('"', "'")}


def scan_python(text: str) -> str | None:
    """The kind of the first defect of a Python text that its brackets and literals show, or None."""
    stack, at = [], 0
    search = (_PYTHON_MERGED if _CONFLICT_LINE.search(text) else _PYTHON).search
    while found := search(text, at):
        kind = found.lastgroup
        at = found.end()
        if kind == "open":
            stack.append(_CLOSER[found[0]])
        elif kind == "close":
            if not stack or stack.pop() != found[0]:
                return UNBALANCED
        elif kind == "long":
            rest = _LONG_END[found[0]].match(text, at)
            if not rest:
                return UNTERMINATED
            at = rest.end()
        elif kind == "quote":
            return UNTERMINATED
        elif kind == "conflict":
            return CONFLICT
    return PREMATURE if stack else None


_JSON = re.compile(
    r"(?P<space>[ \t\n\r]+)|(?P<str>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")"
    r"|(?P<num>-?(?:0|[1-9]\d*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![\w.])|(?P<name>true|false|null)\b|(?P<op>[{}\[\],:])|(?P<conflict>^(?:<{7}|={7}|>{7}))",
    re.MULTILINE | re.ASCII,
)


def scan_json(text: str) -> str | None:
    """The kind of defect of a JSON text, or None: a pushdown automaton over RFC 8259, without recursion."""
    stack: list[str] = []
    state, at = "value", 0  # value; first: a value or "]"; key; first_key: a key or "}"; colon; next: "," or an end; done
    match = _JSON.match
    while at < len(text):
        found = match(text, at)
        if not found:
            return UNTERMINATED if text[at] == '"' else INVALID
        at, kind, token = found.end(), found.lastgroup, found[0]
        if kind == "space":
            continue
        if kind == "conflict":
            return CONFLICT
        if token in ("}", "]") and kind == "op":
            if not stack or stack[-1] != token:
                return UNBALANCED
            if state != "next" and state != ("first_key" if token == "}" else "first"):
                return INVALID
            stack.pop()
            state = "next" if stack else "done"
        elif state in ("value", "first"):
            if token == "{" and kind == "op":
                stack.append("}")
                state = "first_key"
            elif token == "[" and kind == "op":
                stack.append("]")
                state = "first"
            elif kind in ("str", "num", "name"):
                state = "next" if stack else "done"
            else:
                return INVALID
        elif state in ("key", "first_key") and kind == "str":
            state = "colon"
        elif state == "colon" and token == ":" and kind == "op":
            state = "value"
        elif state == "next" and token == "," and kind == "op":
            state = "key" if stack[-1] == "}" else "value"
        else:
            return INVALID
    return None if state == "done" else PREMATURE
