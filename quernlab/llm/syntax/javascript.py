"""ECMAScript scripts (ES2023)."""

from __future__ import annotations

from quernlab.llm.syntax.base import Parser

#: The reserved words, and those reserved in strict mode only.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
STRICT = frozenset("implements interface let package private protected public static yield".split())
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= ^= |= &&= ||= ??=".split())
BINARY = frozenset("+ - * / % ** << >> >>> < > <= >= == != === !== & ^ | && || ??".split())
PREFIX = frozenset("+ - ! ~".split()) | {"typeof", "void", "delete"}


class JavaScript(Parser):
    def program(self):
        self.functions, self.loops, self.switches, self.asynchronous, self.generator = 0, 0, 0, False, False
        self.strict = False
        self.privates: list[set] = []
        self.directives()
        while self.i < self.n:
            self.statement(True)

    def directives(self):
        k = self.i
        while self.K[k] == "str":
            self.strict = self.strict or self.T[k][1:-1] == "use strict"
            k += 2 if self.T[k + 1] == ";" else 1

    # words

    def name(self):
        t = self.T[self.i]
        if self.K[self.i] != "word" or t in RESERVED or t[0] == "#" or (self.strict and t in STRICT) or (t == "await" and self.asynchronous) or (t == "yield" and self.generator):
            self.fail()
        self.i += 1

    def is_name(self, k: int) -> bool:
        t = self.T[k]
        return self.K[k] == "word" and t not in RESERVED and t[0] != "#" and not (self.strict and t in STRICT)

    def semicolon(self):
        if self.take(";") or self.T[self.i] == "}" or self.L[self.i]:
            return
        self.fail()

    # statements

    def block(self):
        self.need("{")
        self.deeper()
        while not self.take("}"):
            self.statement(True)
        self.depth -= 1

    def statement(self, declarations: bool = False):
        t, k = self.T[self.i], self.K[self.i]
        if k == "end":
            self.fail()
        if k == "op":
            if t == "{":
                return self.block()
            if t == ";":
                self.i += 1
                return None
        elif k == "word":
            rule = getattr(self, "s_" + t, None) if t.islower() else None
            if rule:
                return rule()
            if t == "function" or (t == "async" and self.T[self.i + 1] == "function" and not self.L[self.i + 1]):
                if t == "async" and not declarations:
                    self.fail()
                return self.function(True)
            if t in ("class", "const"):
                if not declarations:
                    self.fail()
                return self.klass(True) if t == "class" else self.variables()
            if t == "let" and (self.is_name(self.i + 1) or self.T[self.i + 1] in ("[", "{", "yield", "let", "static", "await")):
                if not declarations and not self.L[self.i + 1]:
                    self.fail()
                return self.variables()
            if t in ("export", "enum") or (t == "import" and self.T[self.i + 1] not in ("(", ".")):
                self.fail()
            if self.is_name(self.i) and self.T[self.i + 1] == ":":
                self.i += 2
                return self.statement(declarations)
        self.expression()
        self.semicolon()
        return None

    def variables(self, in_for: bool = False):
        keyword = self.T[self.i]
        self.i += 1
        while True:
            pattern = self.T[self.i] in ("[", "{")
            self.target()
            if self.take("="):
                self.assign(not in_for)
            elif in_for and self.T[self.i] in ("of", "in"):
                return
            elif not in_for and (keyword == "const" or pattern):
                self.fail()
            elif in_for and (keyword == "const" or pattern):
                self.fail()
            if not self.take(","):
                break
        if not in_for:
            self.semicolon()

    def s_var(self):
        self.variables()

    def s_if(self):
        self.i += 1
        self.parenthesised()
        self.statement()
        if self.take("else"):
            self.statement()

    def parenthesised(self):
        self.need("(")
        self.expression()
        self.need(")")

    def body(self):
        self.loops += 1
        self.statement()
        self.loops -= 1

    def s_while(self):
        self.i += 1
        self.parenthesised()
        self.body()

    def s_do(self):
        self.i += 1
        self.body()
        self.need("while")
        self.parenthesised()
        self.take(";")

    def s_with(self):
        if self.strict:
            self.fail()
        self.i += 1
        self.parenthesised()
        self.statement()

    def s_for(self):
        self.i += 1
        if self.T[self.i] == "await":
            if not self.asynchronous:
                self.fail()
            self.i += 1
        self.need("(")
        t = self.T[self.i]
        if t == ";":
            pass
        elif t in ("var", "const") or (t == "let" and (self.is_name(self.i + 1) or self.T[self.i + 1] in ("[", "{"))):
            self.variables(True)
        else:
            kind = self.expression(False)
            if self.T[self.i] in ("of", "in") and kind not in ("name", "member", "pattern"):
                self.fail()
        if self.T[self.i] in ("of", "in"):
            self.i += 1
            if self.T[self.i - 1] == "of":
                self.assign()
            else:
                self.expression()
        else:
            self.need(";")
            if self.T[self.i] != ";":
                self.expression()
            self.need(";")
            if self.T[self.i] != ")":
                self.expression()
        self.need(")")
        self.body()

    def s_return(self):
        if not self.functions:
            self.fail()
        self.i += 1
        if self.T[self.i] not in (";", "}") and not self.L[self.i]:
            self.expression()
        self.semicolon()

    def jump(self, allowed: bool):
        self.i += 1
        if self.is_name(self.i) and not self.L[self.i]:
            self.i += 1
        elif not allowed:
            self.fail()
        self.semicolon()

    def s_break(self):
        self.jump(self.loops > 0 or self.switches > 0)

    def s_continue(self):
        self.jump(self.loops > 0)

    def s_throw(self):
        self.i += 1
        if self.L[self.i]:
            self.fail()
        self.expression()
        self.semicolon()

    def s_debugger(self):
        self.i += 1
        self.semicolon()

    def s_try(self):
        self.i += 1
        self.block()
        caught = False
        if self.take("catch"):
            caught = True
            if self.take("("):
                self.target()
                self.need(")")
            self.block()
        if self.take("finally"):
            caught = True
            self.block()
        if not caught:
            self.fail()

    def s_switch(self):
        self.i += 1
        self.parenthesised()
        self.need("{")
        self.switches += 1
        default = False
        while not self.take("}"):
            if self.take("default"):
                if default:
                    self.fail()
                default = True
            else:
                self.need("case")
                self.expression()
            self.need(":")
            while self.T[self.i] not in ("case", "default", "}") or self.K[self.i] == "str":
                self.statement(True)
        self.switches -= 1

    # functions and classes

    def function(self, named: bool):
        asynchronous = self.take("async")
        self.need("function")
        generator = self.take("*")
        if self.T[self.i] != "(":
            self.name()
        elif named:
            self.fail()
        self.rest_of_function(asynchronous, generator)

    def rest_of_function(self, asynchronous: bool, generator: bool):
        saved = self.asynchronous, self.generator, self.loops, self.switches, self.strict
        self.asynchronous, self.generator, self.loops, self.switches = asynchronous, generator, 0, 0
        self.parameters()
        self.functions += 1
        self.function_body()
        self.functions -= 1
        self.asynchronous, self.generator, self.loops, self.switches, self.strict = saved

    def function_body(self):
        self.need("{")
        self.directives()
        self.deeper()
        while not self.take("}"):
            self.statement(True)
        self.depth -= 1

    def parameters(self):
        self.need("(")
        while not self.take(")"):
            rest = self.take("...")
            self.target()
            if not rest and self.take("="):
                self.assign()
            if rest and self.T[self.i] != ")":
                self.fail()
            if self.T[self.i] != ")":
                self.need(",")

    def target(self):
        """A binding: a name or a pattern."""
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.target()
                if self.take("="):
                    self.assign()
                if self.T[self.i] != "]":
                    self.need(",")
        elif self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    self.name()
                else:
                    plain = self.is_name(self.i)
                    self.key()
                    if self.take(":"):
                        self.target()
                    elif not plain:
                        self.fail()
                    if self.take("="):
                        self.assign()
                if self.T[self.i] != "}":
                    self.need(",")
        else:
            self.name()

    def key(self):
        k = self.K[self.i]
        if k in ("word", "num", "str"):
            self.i += 1
        elif self.take("["):
            self.assign()
            self.need("]")
        else:
            self.fail()

    def klass(self, named: bool):
        self.need("class")
        strict, self.strict = self.strict, True
        if self.T[self.i] not in ("{", "extends"):
            self.name()
        elif named:
            self.fail()
        if self.take("extends"):
            self.left()
        close = self.M.get(self.i, self.n)
        self.privates.append({self.T[k] for k in range(self.i, close) if self.T[k][:1] == "#" and self.K[k] == "word"
                              and self.T[k - 1] in ("{", "}", ";", "static", "get", "set", "async", "*")})
        self.need("{")
        self.deeper()
        while not self.take("}"):
            if self.take(";"):
                continue
            if self.T[self.i] == "static" and self.T[self.i + 1] not in ("(", "=", ";", "}"):
                self.i += 1
                if self.T[self.i] == "{":
                    self.block()
                    continue
            self.member()
        self.depth -= 1
        self.privates.pop()
        self.strict = strict

    def member(self):
        asynchronous = generator = False
        if self.T[self.i] in ("async", "get", "set") and self.T[self.i + 1] not in ("(", "=", ";", "}", ","):
            asynchronous = self.T[self.i] == "async"
            self.i += 1
        if self.take("*"):
            generator = True
        self.key()
        if self.T[self.i] == "(":
            self.rest_of_function(asynchronous, generator)
        else:
            if asynchronous or generator:
                self.fail()
            if self.take("="):
                self.functions += 1
                self.assign()
                self.functions -= 1
            self.semicolon()

    # expressions; each returns "name", "member", "pattern" or "value", by what may be assigned to

    def expression(self, in_allowed: bool = True) -> str:
        kind = self.assign(in_allowed)
        while self.take(","):
            self.assign(in_allowed)
            kind = "value"
        return kind

    def arrow_at(self, k: int) -> bool:
        if self.T[k] == "(" and self.K[k] == "op":
            close = self.M.get(k, -1)
            return close > 0 and self.T[close + 1] == "=>" and self.K[close + 1] == "op"
        return self.K[k] == "word" and self.T[k + 1] == "=>" and self.is_name(k)

    def assign(self, in_allowed: bool = True) -> str:
        i = self.i
        t = self.T[i]
        word = self.K[i] == "word"
        if word and t == "yield" and self.generator:
            self.i += 1
            if not self.L[self.i] and self.T[self.i] not in (")", "]", "}", ",", ";", ":", "in", "of", ""):
                self.take("*")
                self.assign(in_allowed)
            return "value"
        asynchronous = word and t == "async" and not self.L[i + 1] and self.T[i + 1] != "=>" and self.arrow_at(i + 1)
        if asynchronous or self.arrow_at(i):
            self.i += asynchronous
            saved = self.asynchronous, self.generator, self.loops, self.switches, self.strict
            self.asynchronous, self.generator = asynchronous, False
            if self.T[self.i] == "(":
                self.parameters()
            else:
                self.name()
            if self.L[self.i]:
                self.fail()
            self.need("=>")
            if self.T[self.i] == "{":
                self.loops = self.switches = 0
                self.functions += 1
                self.function_body()
                self.functions -= 1
            else:
                self.deeper()
                self.assign(in_allowed)
                self.depth -= 1
            self.asynchronous, self.generator, self.loops, self.switches, self.strict = saved
            return "value"
        kind = self.conditional(in_allowed)
        if self.K[self.i] == "op" and self.T[self.i] in ASSIGN:
            if kind not in ("name", "member") and not (kind == "pattern" and self.T[self.i] == "="):
                self.fail()
            self.i += 1
            self.assign(in_allowed)
            return "value"
        return kind

    def conditional(self, in_allowed: bool) -> str:
        kind = self.binary(in_allowed)
        if self.T[self.i] == "?" and self.K[self.i] == "op":
            self.i += 1
            self.deeper()
            self.assign()
            self.need(":")
            self.assign(in_allowed)
            self.depth -= 1
            return "value"
        return kind

    def binary(self, in_allowed: bool) -> str:
        kind = self.unary()
        while True:
            t, k = self.T[self.i], self.K[self.i]
            if (k == "op" and t in BINARY) or (k == "word" and (t == "instanceof" or (t == "in" and in_allowed))):
                self.i += 1
                self.unary()
                kind = "value"
            else:
                return kind

    def unary(self) -> str:
        t, k = self.T[self.i], self.K[self.i]
        if k in ("op", "word") and t in PREFIX:
            self.i += 1
            self.unary()
            if self.T[self.i] == "**":
                self.fail()
            return "value"
        if k == "op" and t in ("++", "--"):
            self.i += 1
            if self.unary() not in ("name", "member"):
                self.fail()
            return "value"
        if k == "word" and t == "await" and self.asynchronous:
            self.i += 1
            self.unary()
            return "value"
        if k == "word" and t[0] == "#" and self.T[self.i + 1] == "in":
            self.private()
            return "value"
        kind = self.left()
        if self.T[self.i] in ("++", "--") and self.K[self.i] == "op" and not self.L[self.i]:
            if kind not in ("name", "member"):
                self.fail()
            self.i += 1
            return "value"
        return kind

    def private(self):
        if not any(self.T[self.i] in known for known in self.privates):
            self.fail()
        self.i += 1

    def arguments(self):
        self.need("(")
        self.deeper()
        while not self.take(")"):
            self.take("...")
            self.assign()
            if self.T[self.i] != ")":
                self.need(",")
        self.depth -= 1

    def left(self) -> str:
        if self.T[self.i] == "new" and self.K[self.i] == "word":
            self.i += 1
            if self.take("."):
                self.need("target")
                kind = "value"
            else:
                if self.T[self.i] == "new":
                    self.left()
                else:
                    self.primary()
                    self.suffixes(False)
                if self.T[self.i] == "(" and self.K[self.i] == "op":
                    self.arguments()
                kind = "value"
        else:
            kind = self.primary()
        return self.suffixes(True) or kind

    def suffixes(self, calls: bool) -> str | None:
        kind = None
        while True:
            t, k = self.T[self.i], self.K[self.i]
            if k == "template" and t == "`(":
                self.template()
                kind = "value"
            elif k != "op":
                return kind
            elif t == ".":
                self.i += 1
                if self.K[self.i] != "word":
                    self.fail()
                if self.T[self.i][0] == "#":
                    self.private()
                else:
                    self.i += 1
                kind = "member"
            elif t == "[":
                self.i += 1
                self.expression()
                self.need("]")
                kind = "member"
            elif t == "(" and calls:
                self.arguments()
                kind = "value"
            elif t == "?." and calls:
                self.i += 1
                if self.T[self.i] == "(":
                    self.arguments()
                elif self.take("["):
                    self.expression()
                    self.need("]")
                elif self.K[self.i] == "word":
                    self.i += 1
                else:
                    self.fail()
                kind = "value"
            else:
                return kind

    def template(self):
        self.need("`(")
        while not self.take("`"):
            self.need("${")
            self.expression()
            self.need("}$")

    def primary(self) -> str:
        t, k = self.T[self.i], self.K[self.i]
        if k in ("num", "str", "regex"):
            self.i += 1
            return "value"
        if k == "template" and t == "`(":
            self.template()
            return "value"
        if k == "op":
            self.deeper()
            if self.take("("):
                kind = self.expression()
                self.need(")")
                kind = kind if kind in ("name", "member") else "value"
            elif self.take("["):
                while not self.take("]"):
                    if self.take(","):
                        continue
                    self.take("...")
                    self.assign()
                    if self.T[self.i] != "]":
                        self.need(",")
                kind = "pattern"
            elif self.take("{"):
                self.members()
                kind = "pattern"
            else:
                self.fail()
            self.depth -= 1
            return kind
        if k != "word":
            self.fail()
        if t == "function" or (t == "async" and self.T[self.i + 1] == "function" and not self.L[self.i + 1]):
            self.function(False)
            return "value"
        if t == "class":
            self.klass(False)
            return "value"
        if t in ("this", "null", "true", "false"):
            self.i += 1
            return "value"
        if t == "super":
            self.i += 1
            if self.T[self.i] not in (".", "[", "("):
                self.fail()
            return "value"
        if t == "import":
            self.i += 1
            if self.T[self.i] != "(":
                self.fail()
            self.arguments()
            return "value"
        self.name()
        return "name"

    def members(self):
        while not self.take("}"):
            if self.take("..."):
                self.assign()
            else:
                asynchronous = generator = accessor = False
                if self.T[self.i] in ("get", "set", "async") and self.K[self.i] == "word" and self.T[self.i + 1] not in (",", ":", "(", "}", "="):
                    accessor, asynchronous = True, self.T[self.i] == "async"
                    self.i += 1
                if self.take("*"):
                    accessor = generator = True
                plain = self.is_name(self.i)
                self.key()
                if self.T[self.i] == "(" and self.K[self.i] == "op":
                    self.rest_of_function(asynchronous, generator)
                elif accessor:
                    self.fail()
                elif self.take(":"):
                    self.assign()
                elif not plain:
                    self.fail()
                elif self.take("="):
                    self.assign()
            if self.T[self.i] != "}":
                self.need(",")
