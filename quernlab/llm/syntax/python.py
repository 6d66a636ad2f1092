"""Python 3 source: a lexer with stacks of brackets and indents, then the grammar.

``lex`` turns a text into token types: the text itself for operators and keywords, "name", "num",
"str", "bytes", and the pieces of formatted strings, with NEWLINE, INDENT and DEDENT between. The
parser only accepts or rejects. Operators need no levels for that: every operand may follow every
operator, but for ``not``, which only stands where a test begins. What a text may be assigned to is
carried upwards as a few bits.
"""

from __future__ import annotations

import re
import unicodedata

from quernlab.llm.syntax.lexer import CONFLICT, INVALID, PREMATURE, UNBALANCED, UNTERMINATED, Broken

#: The keywords; names that are keywords in places are handled there.
KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
#: The interpreter's own limits of brackets, indents and formatted strings in each other.
BRACKETS, INDENTS, FORMATTED = 200, 100, 150
_CLOSER = {"(": ")", "[": "]", "{": "}"}
_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_BINARY = frozenset("| ^ & << >> + - * / // % @ ** == != < > <= >= in is and or".split())
_BITWISE = frozenset("| ^ & << >> + - * / // % @ **".split())
# What an expression may be: an assignment's target, something to delete, a single target, a bare name, starred.
TARGET, DELETABLE, SINGLE, NAME, STARRED = 1, 2, 4, 8, 16

_TOKEN = re.compile(
    r"[ \t\f]*(?:(?P<word>(?:[^\W\d]|[^\x00-\x7f])(?:\w|[^\x00-\x7f])*)|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|>>|<<|[-+*/%@&|^=!<>]=|[-+*/%@&|^=<>~,:;]|\.(?!\d))"
    r"|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<whole>(?:0|[1-9][0-9]*)(?![\w.]|[^\x00-\x7f]))|(?P<newline>\n)|(?P<quote>\'\'\'|\"\"\"|\'|\")|(?P<num>\.?\d)|(?P<comment>\#[^\n]*)|(?P<join>\\\n)|(?P<blank>(?<=[ \t\f])))"
)
#: What may stand before a string's quote, and names that are keywords in places.
_PREFIXES = frozenset(x for p in "r u b br rb f fr rf".split() for x in (p, p.upper(), p.title(), p[:1] + p[1:].upper()))
_SOFT = frozenset(("match", "case", "type", "_"))
_NUMBER = re.compile(
    r"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+"
    r"|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][-+]?\d(?:_?\d)*)?[jJ]?"
)
_LEADING_ZERO = re.compile(r"0[0_]*[1-9]")
_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)")
_CONFLICT_LINE = re.compile(r"(?:<{7}|={7}|>{7}|\|{7})(?=[ \n]|\Z)")
_PLAIN = {q: re.compile(rf"[^{q}\\\n]*(?:\\[\s\S][^{q}\\\n]*)*{q}") for q in "'\""}
_LONG = {q * 3: re.compile(rf"[^\\{q}]*(?:(?:\\[\s\S]|{q}(?!{q}{q}))[^\\{q}]*)*{q}{q}{q}") for q in "'\""}
_ESCAPES = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4})|N(?!\{[^{}]+\}))")
_BYTE_ESCAPES = re.compile(r"\\x(?![0-9a-fA-F]{2})")
_QUOTES = frozenset("'\"")
_NAMED = re.compile(r"(?<!\\)(?:\\\\)*\\N\{([^{}]+)\}")


def _escapes_hold(body: str, bytes_: bool) -> bool:
    if "\\" not in body:
        return True
    plain = body.replace("\\\\", "")
    if (_BYTE_ESCAPES if bytes_ else _ESCAPES).search(plain):
        return False
    if not bytes_ and "\\N{" in plain:
        for name in _NAMED.findall(plain):
            try:
                unicodedata.lookup(name)
            except KeyError:
                return False
    return True


class _Lexer:
    def __init__(self, text: str):
        self.text, self.types, self.words = text, [], {}
        self.add = self.types.append
        self.brackets: list[str] = []
        self.formatted = 0

    def number(self, at: int) -> int:
        found = _NUMBER.match(self.text, at)
        if not found:
            raise Broken(INVALID, at)
        token, end = found[0], found.end()
        if token[0] == "0" and token.isdigit() | ("_" in token) and "." not in token and token[-1] not in "jJ" and token[1:2] not in ("x", "X", "o", "O", "b", "B") and "e" not in token and "E" not in token and _LEADING_ZERO.match(token):
            raise Broken(INVALID, at)
        following = self.text[end : end + 1]
        if following and (following == "_" or following.isalnum() or following > "\x7f" and following.isidentifier()):
            if not _AFTER_NUMBER.match(self.text, end):
                raise Broken(INVALID, at)
        self.add("num")
        return end

    def string(self, prefix: str, quote: str, at: int) -> int:
        kind = prefix.lower()
        if "f" in kind:
            return self.format_string(quote, "r" in kind, at)
        found = (_LONG if len(quote) == 3 else _PLAIN)[quote].match(self.text, at)
        if not found:
            raise Broken(UNTERMINATED, at)
        body = found[0]
        if "b" in kind:
            if not body.isascii() or ("r" not in kind and not _escapes_hold(body, True)):
                raise Broken(INVALID, at)
        elif "r" not in kind and not _escapes_hold(body, False):
            raise Broken(INVALID, at)
        self.add("bytes" if "b" in kind else "str")
        return found.end()

    def format_string(self, quote: str, raw: bool, at: int) -> int:
        self.formatted += 1
        if self.formatted > FORMATTED:
            raise Broken(INVALID, at)
        self.add("f(")
        at = self.format_text(quote, raw, at, False)
        self.add("f)")
        self.formatted -= 1
        return at + len(quote)

    def format_text(self, quote: str, raw: bool, at: int, spec: bool) -> int:
        """The text of a formatted string up to its quote, or a format up to its brace; the end's offset."""
        text, start = self.text, at
        literal: list[str] = []
        while True:
            if at >= len(text):
                raise Broken(UNTERMINATED, start)
            c = text[at]
            if c == "\\":
                if not raw and text.startswith("\\N{", at):
                    end = text.find("}", at)
                    if end < 0:
                        raise Broken(UNTERMINATED, at)
                    literal.append(text[at : end + 1])
                    at = end + 1
                elif text[at + 1 : at + 2] in ("{", "}"):
                    literal.append("\\ ")
                    at += 1
                else:
                    literal.append(text[at : at + 2])
                    at += 2
            elif c == "\n" and len(quote) == 1:
                raise Broken(UNTERMINATED, start)
            elif text.startswith(quote, at):
                if spec:
                    raise Broken(PREMATURE, at)
                break
            elif c == "{":
                if not spec and text.startswith("{{", at):
                    at += 2
                    continue
                at = self.field(quote, raw, at + 1)
            elif c == "}":
                if spec:
                    break
                if not text.startswith("}}", at):
                    raise Broken(UNBALANCED, at)
                at += 2
            else:
                literal.append(c)
                at += 1
        if not raw and not _escapes_hold("".join(literal), False):
            raise Broken(INVALID, start)
        return at

    def field(self, quote: str, raw: bool, at: int) -> int:
        """A replacement field after its brace; the offset after its closing brace."""
        self.add("f{")
        outer, self.brackets = self.brackets, []
        at = self.code(at, quote)
        text = self.text
        if text[at] == "!":
            found = re.compile(r"![^\W\d]\w*").match(text, at)
            if not found or found[0][1:] not in ("r", "s", "a"):
                raise Broken(INVALID, at)
            self.add("f!")
            at = found.end()
            while text[at : at + 1] in (" ", "\t", "\n", "\f") and text[at : at + 1]:
                at += 1
            if text[at : at + 1] not in (":", "}"):
                raise Broken(INVALID if at < len(text) else PREMATURE, at)
        if text[at] == ":":
            self.add("f:")
            at = self.format_text(quote, raw, at + 1, True)
        self.add("f}")
        self.brackets = outer
        return at + 1

    def code(self, at: int, quote: str | None = None) -> int:
        """Tokens up to the end, or with ``quote`` to what ends the code of a replacement field."""
        text, brackets, types, add = self.text, self.brackets, self.types, self.add
        end, match = len(text), _TOKEN.match
        indents, alternative = [0], [0]
        fresh = quote is None  # at the start of a line that counts
        while at < end:
            if fresh:
                # Blank lines and comments count for nothing.
                column = alt = 0
                start = at
                while at < end and text[at] in " \t\f":
                    if text[at] == " ":
                        column, alt = column + 1, alt + 1
                    elif text[at] == "\t":
                        column, alt = (column // 8 + 1) * 8, alt + 1
                    else:
                        column = alt = 0
                    at += 1
                if at >= end:
                    break
                if text[at] == "\n":
                    at += 1
                    continue
                if text[at] == "#":
                    at = text.find("\n", at)
                    if at < 0:
                        at = end
                    continue
                if text[at] in "<=>|" and at == start and _CONFLICT_LINE.match(text, at):
                    raise Broken(CONFLICT, at)
                if text.startswith("\\\n", at):
                    at += 2
                    while at < end and text[at] in " \t\f":
                        at += 1
                    if at >= end:
                        if text[at - 1] == "\n":
                            raise Broken(PREMATURE, at)
                        break
                    if text[at] == "\n":
                        continue
                fresh = False
                if column == indents[-1]:
                    if alt != alternative[-1]:
                        raise Broken(INVALID, at)
                elif column > indents[-1]:
                    if alt <= alternative[-1] or len(indents) >= INDENTS:
                        raise Broken(INVALID, at)
                    indents.append(column)
                    alternative.append(alt)
                    add("INDENT")
                else:
                    while column < indents[-1]:
                        indents.pop()
                        alternative.pop()
                        add("DEDENT")
                    if column != indents[-1] or alt != alternative[-1]:
                        raise Broken(INVALID, at)
            found = match(text, at)
            kind = found.lastgroup if found and found.end() > at else None
            if kind == "word":
                word = found["word"]
                at = found.end()
                if word in KEYWORDS:
                    add(word)
                elif text[at : at + 1] in _QUOTES and word in _PREFIXES and at < end:
                    mark = text[at : at + 3] if text[at : at + 3] in _LONG else text[at]
                    at = self.string(word, mark, at + len(mark))
                else:
                    if not word.isascii():
                        if not word.isidentifier():
                            raise Broken(INVALID, at)
                        word = unicodedata.normalize("NFKC", word)
                        if word in KEYWORDS:
                            add(word)
                            continue
                    if word in _SOFT:
                        self.words[len(types)] = word
                    add("name")
            elif kind == "op":
                token = found["op"]
                at = found.end()
                if quote is not None and not brackets and token[0] == ":":
                    return at - len(token)
                add(token)
            elif kind == "open":
                token = found["open"]
                brackets.append(_CLOSER[token])
                if len(brackets) > BRACKETS:
                    raise Broken(INVALID, at)
                add(token)
                at = found.end()
            elif kind == "close":
                token = found["close"]
                at = found.end()
                if not brackets:
                    if quote is not None and token == "}":
                        return at - 1
                    raise Broken(UNBALANCED, at)
                if brackets.pop() != token:
                    raise Broken(UNBALANCED, at)
                add(token)
            elif kind == "whole":
                add("num")
                at = found.end()
            elif kind == "newline":
                at = found.end()
                if brackets or quote is not None:
                    if brackets and _CONFLICT_LINE.match(text, at):
                        raise Broken(CONFLICT, at)
                else:
                    add("NEWLINE")
                    fresh = True
            elif kind == "quote":
                at = self.string("", found["quote"], found.end())
            elif kind == "num":
                at = self.number(found.start("num"))
            elif kind == "join":
                at = found.end()
                if at >= end:
                    raise Broken(PREMATURE, at)
            elif kind is not None:  # a comment, or blanks before something else
                at = found.end()
            elif quote is not None and text[at] == "!" and not brackets:
                return at
            else:
                raise Broken(PREMATURE if text[at] == "\\" and at + 1 >= end else INVALID, at)
        if quote is not None:
            raise Broken(UNTERMINATED, at)
        if brackets:
            raise Broken(PREMATURE, at)
        if types and types[-1] not in ("NEWLINE", "DEDENT"):
            add("NEWLINE")
        for _ in indents[1:]:
            add("DEDENT")
        return at


def lex(text: str) -> tuple[list[str], dict[int, str]]:
    """(types, words): the tokens of a text, and the names among them that are keywords in places; raises Broken."""
    if "\0" in text:
        raise Broken(INVALID, text.index("\0"))
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    lexer = _Lexer(text)
    lexer.code(0)
    return lexer.types, lexer.words


class Python:
    """Accepts or rejects the tokens of a module."""

    def __init__(self, types: list[str], words: dict[int, str]):
        self.T, self.W, self.i, self.n = [*types, "END"], words, 0, len(types)

    def fail(self):
        raise Broken(PREMATURE if self.i >= self.n or all(t in ("NEWLINE", "DEDENT") for t in self.T[self.i : self.n]) else INVALID, self.i)

    def need(self, token: str):
        if self.T[self.i] != token:
            self.fail()
        self.i += 1

    def take(self, token: str) -> bool:
        if self.T[self.i] == token:
            self.i += 1
            return True
        return False

    def attempt(self, rule) -> bool:
        at = self.i
        try:
            rule()
            return True
        except Broken:
            self.i = at
            return False

    # statements

    def program(self):
        while self.i < self.n:
            self.statement()

    def statement(self):
        rule = _COMPOUND.get(self.T[self.i])
        if rule is not None:
            rule(self)
        elif self.T[self.i] == "name" and self.W.get(self.i) == "match" and self.T[self.i + 1] not in _NOT_A_SUBJECT and self.attempt(self.match_head):
            self.match_rest()
        else:
            self.simple_statements()

    def simple_statements(self):
        while True:
            rule = _SIMPLE.get(self.T[self.i])
            if rule is not None:
                self.i += 1
                rule(self)
            else:
                self.expression_statement()
            if self.take(";"):
                if self.take("NEWLINE"):
                    return
                continue
            self.need("NEWLINE")
            return

    def block(self):
        self.need(":")
        if self.take("NEWLINE"):
            self.need("INDENT")
            while not self.take("DEDENT"):
                self.statement()
        else:
            self.simple_statements()

    def expression_statement(self):
        if self.T[self.i] == "name" and self.W.get(self.i) == "type" and self.T[self.i + 1] == "name" and self.T[self.i + 2] in ("=", "["):
            self.i += 2
            self.type_parameters()
            self.need("=")
            self.expression()
            return
        if self.T[self.i] == "yield":
            self.yield_expression()
            flags = 0
        else:
            flags = self.star_expressions()
        t = self.T[self.i]
        if t == "=":
            while self.take("="):
                if not flags & TARGET:
                    self.fail()
                if self.T[self.i] == "yield":
                    self.yield_expression()
                    flags = 0
                else:
                    flags = self.star_expressions()
        elif t in _AUGMENTED:
            if not flags & SINGLE:
                self.fail()
            self.i += 1
            self.right_side()
        elif t == ":":
            if not flags & SINGLE:
                self.fail()
            self.i += 1
            self.expression()
            if self.take("="):
                self.right_side()

    def right_side(self):
        if self.T[self.i] == "yield":
            self.yield_expression()
        else:
            self.star_expressions()

    def nothing(self):
        pass

    def return_(self):
        if self.T[self.i] not in ("NEWLINE", ";"):
            self.star_expressions()

    def raise_(self):
        if self.T[self.i] not in ("NEWLINE", ";"):
            self.expression()
            if self.take("from"):
                self.expression()

    def names(self):
        self.need("name")
        while self.take(","):
            self.need("name")

    def delete(self):
        while True:
            if not self.expression() & DELETABLE:
                self.fail()
            if not self.take(",") or self.T[self.i] in ("NEWLINE", ";"):
                return

    def assert_(self):
        self.expression()
        if self.take(","):
            self.expression()

    def dotted(self):
        self.need("name")
        while self.take("."):
            self.need("name")

    def import_(self):
        while True:
            self.dotted()
            if self.take("as"):
                self.need("name")
            if not self.take(","):
                return

    def from_(self):
        dots = False
        while self.T[self.i] in (".", "..."):
            self.i += 1
            dots = True
        if not dots or self.T[self.i] == "name":
            self.dotted()
        self.need("import")
        if self.take("*"):
            return
        closed = self.take("(")
        while True:
            self.need("name")
            if self.take("as"):
                self.need("name")
            if not self.take(","):
                break
            if closed and self.T[self.i] == ")":
                break
        if closed:
            self.need(")")

    def if_(self):
        self.i += 1
        self.named_expression()
        self.block()
        while self.take("elif"):
            self.named_expression()
            self.block()
        if self.take("else"):
            self.block()

    def while_(self):
        self.i += 1
        self.named_expression()
        self.block()
        if self.take("else"):
            self.block()

    def targets(self):
        """Targets of a loop, before ``in``."""
        flags, many = self.star_target(), False
        while self.take(","):
            many = True
            if self.T[self.i] in ("in", "="):
                break
            flags &= self.star_target()
        return flags, many

    def star_target(self) -> int:
        self.take("*")
        if self.T[self.i] in ("+", "-", "~", "not", "await", "lambda"):
            self.fail()
        flags = self.primary()
        if not flags & TARGET:
            self.fail()
        return flags

    def for_(self):
        self.i += 1
        self.targets()
        self.need("in")
        self.star_expressions()
        self.block()
        if self.take("else"):
            self.block()

    def try_(self):
        self.i += 1
        self.block()
        if self.take("finally"):
            self.block()
            return
        if self.T[self.i] != "except":
            self.fail()
        starred = self.T[self.i + 1] == "*"
        while self.take("except"):
            if self.take("*") != starred:
                self.fail()
            if self.T[self.i] == ":" and starred:
                self.fail()
            if self.T[self.i] != ":":
                self.expression()
                if self.take("as"):
                    self.need("name")
            self.block()
        if self.take("else"):
            self.block()
        if self.take("finally"):
            self.block()

    def with_(self):
        self.i += 1
        if self.T[self.i] == "(" and self.attempt(self.closed_items):
            self.block()
            return
        self.items()
        self.block()

    def closed_items(self):
        self.need("(")
        while True:
            self.item()
            if not self.take(",") or self.T[self.i] == ")":
                break
        self.need(")")
        if self.T[self.i] != ":":
            self.fail()

    def items(self):
        self.item()
        while self.take(","):
            self.item()

    def item(self):
        self.expression()
        if self.take("as"):
            self.star_target()
            if self.T[self.i] not in (",", ")", ":"):
                self.fail()

    def async_(self):
        self.i += 1
        rule = {"def": Python.def_, "for": Python.for_, "with": Python.with_}.get(self.T[self.i])
        if rule is None:
            self.fail()
        rule(self)

    def decorated(self):
        while self.take("@"):
            self.named_expression()
            self.need("NEWLINE")
        rule = {"def": Python.def_, "class": Python.class_, "async": Python.async_def}.get(self.T[self.i])
        if rule is None:
            self.fail()
        rule(self)

    def async_def(self):
        if self.T[self.i + 1] != "def":
            self.fail()
        self.i += 1
        self.def_()

    def type_parameters(self):
        if not self.take("["):
            return
        while True:
            if self.T[self.i] in ("*", "**"):
                double = self.T[self.i] == "**"
                self.i += 1
                self.need("name")
                if self.take("="):
                    self.expression() if double else self.star_expression()
            else:
                self.need("name")
                if self.take(":"):
                    self.expression()
                if self.take("="):
                    self.expression()
            if not self.take(",") or self.T[self.i] == "]":
                break
        self.need("]")

    def def_(self):
        self.i += 1
        self.need("name")
        self.type_parameters()
        self.need("(")
        self.parameters(")", True)
        self.need(")")
        if self.take("->"):
            self.expression()
        self.block()

    def parameters(self, end: str, typed: bool):
        """Parameters up to ``end``, which stays."""
        default = slash = star = named = False
        while self.T[self.i] != end:
            if self.take("/"):
                if slash or star or not named:
                    self.fail()
                slash = True
            elif self.take("**"):
                self.need("name")
                if typed and self.take(":"):
                    self.expression()
                self.take(",")
                if self.T[self.i] != end:
                    self.fail()
                return
            elif self.take("*"):
                if star:
                    self.fail()
                star = True
                if self.take("name"):
                    if typed and self.take(":"):
                        self.star_expression()
                elif not (self.T[self.i] == "," and self.T[self.i + 1] == "name"):
                    self.fail()
            else:
                self.need("name")
                named = True
                if typed and self.take(":"):
                    self.expression()
                if self.take("="):
                    self.expression()
                    default = True
                elif default and not star:
                    self.fail()
            if not self.take(","):
                break

    def class_(self):
        self.i += 1
        self.need("name")
        self.type_parameters()
        if self.take("("):
            self.arguments(False)
        self.block()

    # match

    def match_head(self):
        self.i += 1
        flags = self.star_named_expression()
        many = False
        while self.take(","):
            many = True
            if self.T[self.i] == ":":
                break
            self.star_named_expression()
        if flags & STARRED and not many:
            self.fail()
        self.need(":")
        self.need("NEWLINE")
        self.need("INDENT")
        if self.T[self.i] != "name" or self.W.get(self.i) != "case":
            self.fail()

    def match_rest(self):
        while not self.take("DEDENT"):
            if self.T[self.i] != "name" or self.W.get(self.i) != "case":
                self.fail()
            self.i += 1
            starred = self.star_pattern()
            many = False
            while self.take(","):
                many = True
                if self.T[self.i] in (":", "if"):
                    break
                self.star_pattern()
            if starred and not many:
                self.fail()
            if self.take("if"):
                self.named_expression()
            self.block()

    def star_pattern(self) -> bool:
        if self.take("*"):
            self.need("name")
            return True
        self.pattern()
        return False

    def pattern(self):
        self.closed_pattern()
        while self.take("|"):
            self.closed_pattern()
        if self.take("as"):
            if self.W.get(self.i) == "_" or self.T[self.i + 1] in (".", "(", "="):
                self.fail()
            self.need("name")

    def signed_number(self) -> bool:
        self.take("-")
        self.need("num")
        if self.T[self.i] in ("+", "-"):
            self.i += 1
            self.need("num")

    def closed_pattern(self):
        t = self.T[self.i]
        if t in ("num", "-"):
            self.signed_number()
        elif t in ("str", "bytes", "f("):
            self.strings()
        elif t in ("None", "True", "False"):
            self.i += 1
        elif t == "name":
            self.i += 1
            while self.take("."):
                self.need("name")
            if self.take("("):
                keyword = False
                while not self.take(")"):
                    if self.T[self.i] == "name" and self.T[self.i + 1] == "=":
                        self.i += 2
                        keyword = True
                    elif keyword:
                        self.fail()
                    self.pattern()
                    if self.T[self.i] != ")":
                        self.need(",")
        elif t in ("(", "["):
            self.i += 1
            end, count, comma, starred = _CLOSER[t], 0, False, False
            while not self.take(end):
                starred = self.star_pattern() or starred
                count += 1
                if self.T[self.i] != end:
                    self.need(",")
                    comma = True
            if t == "(" and count == 1 and starred and not comma:
                self.fail()
        elif t == "{":
            self.i += 1
            rest = False
            while not self.take("}"):
                if rest:
                    self.fail()
                if self.take("**"):
                    self.need("name")
                    rest = True
                else:
                    self.key_pattern()
                    self.need(":")
                    self.pattern()
                if self.T[self.i] != "}":
                    self.need(",")
        else:
            self.fail()

    def key_pattern(self):
        t = self.T[self.i]
        if t in ("num", "-"):
            self.signed_number()
        elif t in ("str", "bytes", "f("):
            self.strings()
        elif t in ("None", "True", "False"):
            self.i += 1
        else:
            self.need("name")
            if self.T[self.i] != ".":
                self.fail()
            while self.take("."):
                self.need("name")

    # expressions; they return what they may be

    def star_expressions(self) -> int:
        flags = self.star_expression()
        if self.T[self.i] != ",":
            return flags
        flags &= TARGET | STARRED
        deletable = not flags & STARRED
        while self.take(","):
            if self.T[self.i] in _ENDS_LIST:
                break
            flags &= self.star_expression() | STARRED
        return flags & TARGET | (DELETABLE if deletable and flags & DELETABLE else 0)

    def star_expression(self) -> int:
        if self.take("*"):
            flags = self.operators(_BITWISE)
            return STARRED | (flags & TARGET)
        return self.expression()

    def star_named_expression(self) -> int:
        if self.take("*"):
            flags = self.operators(_BITWISE)
            return STARRED | (flags & TARGET)
        return self.named_expression()

    def named_expression(self) -> int:
        if self.T[self.i + 1] == ":=" and self.T[self.i] == "name":
            self.i += 2
            self.expression()
            return 0
        return self.expression()

    def yield_expression(self):
        self.need("yield")
        if self.take("from"):
            self.expression()
        elif self.T[self.i] not in _ENDS_LIST:
            self.star_expressions()

    def expression(self) -> int:
        if self.T[self.i] == "lambda":
            self.i += 1
            self.parameters(":", False)
            self.need(":")
            self.expression()
            return 0
        flags = self.operators()
        if self.T[self.i] == "if":
            self.i += 1
            self.operators()
            self.need("else")
            self.expression()
            return 0
        return flags

    def operators(self, within: frozenset = _BINARY) -> int:
        """Operands and operators; with ``within`` only these operators."""
        T, tests = self.T, within is _BINARY
        plain = True
        while True:
            t = T[self.i]
            if tests:
                while t == "not":
                    self.i += 1
                    t = T[self.i]
                    plain = False
            while t in _UNARY:
                self.i += 1
                t = T[self.i]
                plain = False
            if t == "await":
                self.i += 1
                plain = False
            flags = self.primary()
            t = T[self.i]
            if t in within:
                self.i += 1
                if t == "is" and T[self.i] == "not":
                    self.i += 1
                tests = t == "and" or t == "or"
            elif t == "not" and T[self.i + 1] == "in" and within is _BINARY:
                self.i += 2
                tests = False
            else:
                return flags if plain else 0
            plain = False

    def primary(self) -> int:
        flags = self.atom()
        T = self.T
        while True:
            t = T[self.i]
            if t == ".":
                self.i += 1
                self.need("name")
                flags = TARGET | DELETABLE | SINGLE
            elif t == "(":
                self.i += 1
                self.arguments(True)
                flags = 0
            elif t == "[":
                self.i += 1
                self.slices()
                flags = TARGET | DELETABLE | SINGLE
            else:
                return flags

    def slices(self):
        while True:
            if self.take("*"):
                self.operators(_BITWISE)
            else:
                if self.T[self.i] != ":":
                    self.named_expression()
                if self.take(":"):
                    if self.T[self.i] not in (":", ",", "]"):
                        self.expression()
                    if self.take(":") and self.T[self.i] not in (",", "]"):
                        self.expression()
            if not self.take(",") or self.T[self.i] == "]":
                break
        self.need("]")

    def arguments(self, alone: bool):
        """Arguments and the closing bracket; a generator may stand ``alone`` in them."""
        keyword = double = False
        first = True
        while not self.take(")"):
            t = self.T[self.i]
            if t == "**":
                self.i += 1
                self.expression()
                double = True
            elif t == "*":
                if double:
                    self.fail()
                self.i += 1
                self.expression()
            elif t == "name" and self.T[self.i + 1] == "=":
                self.i += 2
                self.expression()
                keyword = True
            else:
                if keyword or double:
                    self.fail()
                self.named_expression()
                if self.T[self.i] in ("for", "async"):
                    self.comprehension()
                    if not (alone and first and self.T[self.i] == ")"):
                        self.fail()
            first = False
            if self.T[self.i] != ")":
                self.need(",")

    def comprehension(self):
        while self.T[self.i] in ("for", "async"):
            self.take("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.operators()
            while self.take("if"):
                self.operators()

    def strings(self):
        """Literals in a row; bytes and texts don't mix."""
        T, text, raw = self.T, False, False
        while True:
            t = T[self.i]
            if t == "str":
                text = True
                self.i += 1
            elif t == "bytes":
                raw = True
                self.i += 1
            elif t == "f(":
                text = True
                self.i += 1
                self.format_parts("f)")
            else:
                break
        if text and raw:
            self.fail()

    def format_parts(self, end: str):
        while not self.take(end):
            self.need("f{")
            if self.T[self.i] == "yield":
                self.yield_expression()
            else:
                self.star_expressions()
            self.take("=")
            self.take("f!")
            if self.take("f:"):
                self.format_parts("f}")
            else:
                self.need("f}")

    def atom(self) -> int:
        t = self.T[self.i]
        if t == "name":
            self.i += 1
            return TARGET | DELETABLE | SINGLE | NAME
        if t in _CONSTANTS:
            self.i += 1
            return 0
        if t == "str" or t == "f(" or t == "bytes":
            self.strings()
            return 0
        if t == "(":
            return self.group()
        if t == "[":
            self.i += 1
            if self.take("]"):
                return TARGET | DELETABLE
            flags, _ = self.members("]")
            return flags
        if t == "{":
            self.i += 1
            self.braces()
            return 0
        self.fail()

    def group(self) -> int:
        self.i += 1
        if self.take(")"):
            return TARGET | DELETABLE
        if self.T[self.i] == "yield":
            self.yield_expression()
            self.need(")")
            return 0
        flags, single = self.members(")")
        if single:
            if flags & STARRED:
                self.fail()
            return flags & (TARGET | DELETABLE | SINGLE)
        return flags

    def members(self, end: str) -> tuple[int, bool]:
        """Members up to ``end``, or a comprehension: what they may be, and whether they are one without a comma."""
        first = flags = self.star_named_expression()
        if self.T[self.i] in ("for", "async"):
            if first & STARRED:
                self.fail()
            self.comprehension()
            self.need(end)
            return 0, False
        if self.take(end):
            if end == ")":
                return first, True
            return first & TARGET | (0 if first & STARRED else first & DELETABLE), False
        starred = first & STARRED
        while True:
            self.need(",")
            if self.take(end):
                break
            one = self.star_named_expression()
            starred |= one & STARRED
            flags &= one
            if self.take(end):
                break
        return flags & TARGET | (0 if starred else flags & DELETABLE), False

    def braces(self):
        if self.take("}"):
            return
        if self.take("**"):
            self.operators(_BITWISE)
            dict_ = True
        else:
            first = self.star_named_expression()
            dict_ = self.T[self.i] == ":"
            if dict_:
                if first & STARRED or self.T[self.i - 1] == ":=":
                    self.fail()
                self.i += 1
                self.expression()
            if self.T[self.i] in ("for", "async"):
                if first & STARRED:
                    self.fail()
                self.comprehension()
                self.need("}")
                return
        while not self.take("}"):
            self.need(",")
            if self.take("}"):
                return
            if not dict_:
                self.star_named_expression()
            elif self.take("**"):
                self.operators(_BITWISE)
            else:
                self.expression()
                self.need(":")
                self.expression()


_UNARY = frozenset("+-~")
_CONSTANTS = frozenset(("num", "None", "True", "False", "..."))
#: Where a list of expressions ends after a comma.
_ENDS_LIST = frozenset(("NEWLINE", ";", "=", ")", "]", "}", ":", "f}", "f!", "f:", *_AUGMENTED))
#: What follows a plain name ``match``, so that it is no statement of its own.
_NOT_A_SUBJECT = frozenset(("=", ".", ",", ")", ":", "NEWLINE", ";", "in", "is", "and", "or", "if", "else", "for", *_AUGMENTED))
_SIMPLE = {
    "pass": Python.nothing, "break": Python.nothing, "continue": Python.nothing, "return": Python.return_, "raise": Python.raise_, "global": Python.names, "nonlocal": Python.names,
    "del": Python.delete, "assert": Python.assert_, "import": Python.import_, "from": Python.from_,
}
_COMPOUND = {
    "if": Python.if_, "while": Python.while_, "for": Python.for_, "try": Python.try_, "with": Python.with_, "async": Python.async_, "@": Python.decorated, "def": Python.def_, "class": Python.class_,
}


def parse(text: str) -> None:
    """Raises Broken where a text is no module."""
    types, words = lex(text)
    Python(types, words).program()
