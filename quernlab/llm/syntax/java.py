"""Java compilation units (up to records, sealed types, switch expressions and patterns)."""

from __future__ import annotations

from quernlab.llm.syntax.base import Parser

#: Keywords and literals that can't be names, the primitive types, the modifiers.
KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
)
PRIMITIVE = frozenset("boolean byte char short int long float double".split())
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
ASSIGN = frozenset("= += -= *= /= %= <<= >>= >>>= &= ^= |=".split())
BINARY = frozenset("+ - * / % << >> >>> < > <= >= == != & ^ | && ||".split())


class Java(Parser):
    def program(self):
        self.modifiers()
        if self.take("package"):
            self.qualified()
            self.need(";")
        while self.T[self.i] in ("import", ";"):
            if self.take(";"):
                continue
            self.i += 1
            self.take("static")
            self.name()
            while self.take("."):
                if self.take("*"):
                    break
                self.name()
            self.need(";")
        while self.i < self.n:
            if not self.take(";"):
                self.modifiers()
                if not self.type_declaration():
                    self.fail()

    # names and types

    def is_name(self, k: int) -> bool:
        return self.K[k] == "word" and self.T[k] not in KEYWORDS

    def name(self):
        if not self.is_name(self.i):
            self.fail()
        self.i += 1

    def qualified(self):
        self.name()
        while self.take("."):
            self.name()

    def annotation(self):
        self.need("@")
        self.qualified()
        if self.T[self.i] == "(" and self.K[self.i] == "op":
            self.i += 1
            while not self.take(")"):
                if self.is_name(self.i) and self.T[self.i + 1] == "=":
                    self.i += 2
                self.element()
                if self.T[self.i] != ")":
                    self.need(",")

    def element(self):
        if self.T[self.i] == "@":
            self.annotation()
        elif self.take("{"):
            while not self.take("}"):
                self.element()
                if self.T[self.i] != "}":
                    self.need(",")
        else:
            self.conditional()

    def annotations(self):
        while self.T[self.i] == "@" and self.T[self.i + 1] != "interface":
            self.annotation()

    def modifiers(self):
        while True:
            t = self.T[self.i]
            if t == "@" and self.T[self.i + 1] != "interface":
                self.annotation()
            elif t == "non" and self.T[self.i + 1] == "-" and self.T[self.i + 2] == "sealed":
                self.i += 3
            elif t in MODIFIERS and self.K[self.i] == "word" and not (t == "sealed" and not (self.K[self.i + 1] == "word" or self.T[self.i + 1] == "@")) and not (t == "default" and self.T[self.i + 1] in (":", "->")):
                self.i += 1
            else:
                return

    def type(self):
        self.annotations()
        if self.T[self.i] in PRIMITIVE and self.K[self.i] == "word":
            self.i += 1
        else:
            self.class_type()
        self.dimensions()

    def class_type(self):
        self.name()
        self.arguments_of_type()
        while self.T[self.i] == "." and (self.is_name(self.i + 1) or self.T[self.i + 1] == "@"):
            self.i += 1
            self.annotations()
            self.name()
            self.arguments_of_type()

    def dimensions(self):
        while self.T[self.i] in ("[", "@") and (self.T[self.i] == "@" or self.T[self.i + 1] == "]"):
            self.annotations()
            self.need("[")
            self.need("]")

    def arguments_of_type(self):
        if self.T[self.i] == "<" and self.K[self.i] == "op":
            self.i += 1
            self.deeper()
            if not self.take(">"):
                while True:
                    self.annotations()
                    if self.take("?"):
                        if self.T[self.i] in ("extends", "super"):
                            self.i += 1
                            self.type()
                    else:
                        self.type()
                    if not self.take(","):
                        break
                self.need(">")
            self.depth -= 1

    def parameters_of_type(self):
        if self.take("<"):
            while True:
                self.annotations()
                self.name()
                if self.take("extends"):
                    self.type()
                    while self.take("&"):
                        self.type()
                if not self.take(","):
                    break
            self.need(">")

    def types(self):
        self.type()
        while self.take(","):
            self.type()

    # declarations

    def type_declaration(self) -> bool:
        t = self.T[self.i]
        if t == "@" and self.T[self.i + 1] == "interface":
            self.i += 1
        if t in ("class", "interface", "@"):
            self.i += 1
            self.name()
            self.parameters_of_type()
            self.heritage()
            self.members()
        elif t == "enum":
            self.i += 1
            self.name()
            self.heritage()
            self.need("{")
            while self.T[self.i] not in (";", "}"):
                self.annotations()
                self.name()
                if self.T[self.i] == "(":
                    self.arguments()
                if self.T[self.i] == "{":
                    self.members()
                if not self.take(","):
                    break
            if self.take(";"):
                self.i -= 1
                self.T[self.i], self.K[self.i] = "{", "op"
                self.members()
            else:
                self.need("}")
        elif t == "record" and self.is_name(self.i + 1) and self.T[self.i + 2] in ("(", "<"):
            self.i += 2
            self.parameters_of_type()
            self.formals()
            self.heritage()
            self.members()
        else:
            return False
        return True

    def heritage(self):
        while self.T[self.i] in ("extends", "implements", "permits"):
            self.i += 1
            self.types()

    def members(self):
        self.need("{")
        self.deeper()
        while not self.take("}"):
            if not self.take(";"):
                self.member()
        self.depth -= 1

    def member(self):
        if self.T[self.i] == "{":
            return self.block()
        if self.T[self.i] == "static" and self.T[self.i + 1] == "{":
            self.i += 1
            return self.block()
        self.modifiers()
        if self.type_declaration():
            return None
        self.parameters_of_type()
        self.annotations()
        if self.is_name(self.i) and self.T[self.i + 1] in ("(", "{"):
            self.i += 1
            if self.T[self.i] == "(":
                self.formals()
            self.throws()
            return self.block()
        if not self.take("void"):
            self.type()
        elif self.T[self.i + 1] != "(":
            self.fail()
        self.name()
        if self.T[self.i] == "(" and self.K[self.i] == "op":
            self.formals()
            self.dimensions()
            self.throws()
            if self.take("default"):
                self.element()
                self.need(";")
            elif not self.take(";"):
                self.block()
        else:
            self.declarators()
            self.need(";")
        return None

    def throws(self):
        if self.take("throws"):
            self.types()

    def formals(self):
        self.need("(")
        while not self.take(")"):
            self.modifiers()
            self.type()
            self.annotations()
            self.take("...")
            if not self.take("this"):
                self.name()
            self.dimensions()
            if self.T[self.i] != ")":
                self.need(",")
                if self.T[self.i] == ")":
                    self.fail()

    def declarators(self):
        """The rest of variable declarators after the first name."""
        while True:
            self.dimensions()
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return
            self.name()

    def initializer(self):
        if self.take("{"):
            while not self.take("}"):
                self.initializer()
                if self.T[self.i] != "}":
                    self.need(",")
        else:
            self.expression()

    # statements

    def block(self):
        self.need("{")
        self.deeper()
        while not self.take("}"):
            self.statement(True)
        self.depth -= 1

    def local(self):
        """The start of a local variable declaration: type, name, and what may follow."""
        self.type()
        self.name()
        if self.T[self.i] not in ("=", ";", ",", "[", ":") or self.K[self.i] != "op":
            self.fail()

    def statement(self, declarations: bool = False):
        t, k = self.T[self.i], self.K[self.i]
        if k == "end":
            self.fail()
        if k == "op" and t == "{":
            return self.block()
        if k == "op" and t == ";":
            self.i += 1
            return None
        if k == "word":
            rule = getattr(self, "s_" + t, None) if t.islower() else None
            if rule and not (t == "yield" and self.T[self.i + 1] in ("=", ".", "(", "[", "++", "--")) and not (t == "synchronized" and self.T[self.i + 1] != "("):
                return rule()
            if self.is_name(self.i) and self.T[self.i + 1] == ":":
                self.i += 2
                return self.statement()
        if declarations:
            at = self.i
            self.modifiers()
            if self.type_declaration():
                return None
            modified = self.i > at
            if (self.is_name(self.i) or self.T[self.i] in PRIMITIVE) and self.attempt(self.local):
                self.declarators()
                self.need(";")
                return None
            if modified:
                self.fail()
        if self.expression() != "statement":
            self.fail()
        self.need(";")
        return None

    def parenthesised(self):
        self.need("(")
        self.expression()
        self.need(")")

    def s_if(self):
        self.i += 1
        self.parenthesised()
        self.statement()
        if self.take("else"):
            self.statement()

    def s_while(self):
        self.i += 1
        self.parenthesised()
        self.statement()

    def s_do(self):
        self.i += 1
        self.statement()
        self.need("while")
        self.parenthesised()
        self.need(";")

    def s_for(self):
        self.i += 1
        self.need("(")
        at = self.i
        self.modifiers()
        if (self.is_name(self.i) or self.T[self.i] in PRIMITIVE) and self.attempt(self.local):
            if self.take(":"):
                self.expression()
                self.need(")")
                return self.statement()
            self.declarators()
        elif self.i > at:
            self.fail()
        elif self.T[self.i] != ";":
            self.statement_expressions()
        self.need(";")
        if self.T[self.i] != ";":
            self.expression()
        self.need(";")
        if self.T[self.i] != ")":
            self.statement_expressions()
        self.need(")")
        return self.statement()

    def statement_expressions(self):
        while True:
            if self.expression() != "statement":
                self.fail()
            if not self.take(","):
                return

    def s_return(self):
        self.i += 1
        if self.T[self.i] != ";":
            self.expression()
        self.need(";")

    def s_throw(self):
        self.i += 1
        self.expression()
        self.need(";")

    s_yield = s_throw

    def s_break(self):
        self.i += 1
        if self.is_name(self.i):
            self.i += 1
        self.need(";")

    s_continue = s_break

    def s_assert(self):
        self.i += 1
        self.expression()
        if self.take(":"):
            self.expression()
        self.need(";")

    def s_synchronized(self):
        self.i += 1
        self.parenthesised()
        self.block()

    def s_else(self):
        self.fail()

    s_case = s_default = s_catch = s_finally = s_else

    def s_try(self):
        self.i += 1
        handled = self.take("(")
        if handled:
            while not self.take(")"):
                self.modifiers()
                if self.attempt(self.local):
                    self.need("=")
                    self.expression()
                else:
                    self.expression()
                if self.T[self.i] != ")":
                    self.need(";")
        self.block()
        while self.take("catch"):
            handled = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.take("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
        if self.take("finally"):
            handled = True
            self.block()
        if not handled:
            self.fail()

    def s_switch(self):
        self.switch()

    def switch(self):
        self.i += 1
        self.parenthesised()
        self.need("{")
        self.deeper()
        while not self.take("}"):
            if not self.take("default"):
                self.need("case")
                while True:
                    if not self.take("default") and not self.attempt(self.pattern):
                        self.conditional()
                    if not self.take(","):
                        break
                if self.T[self.i] == "when":
                    self.i += 1
                    self.expression()
            if self.take("->"):
                if self.T[self.i] == "{":
                    self.block()
                elif self.T[self.i] == "throw":
                    self.s_throw()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while self.T[self.i] not in ("case", "default", "}") or self.K[self.i] == "str":
                    self.statement(True)
        self.depth -= 1

    def pattern(self):
        self.modifiers()
        self.type()
        if self.take("("):
            while not self.take(")"):
                self.pattern()
                if self.T[self.i] != ")":
                    self.need(",")
        else:
            self.name()

    # expressions; each returns "statement" for what may be one, else "value", or "place" for what may be assigned to

    def expression(self) -> str:
        i = self.i
        if self.K[i] == "word" and self.T[i + 1] == "->" and self.is_name(i):
            self.i += 1
            return self.arrow()
        if self.T[i] == "(" and self.K[i] == "op" and self.T[self.M.get(i, i) + 1] == "->":
            self.lambda_parameters()
            return self.arrow()
        kind = self.conditional()
        t = self.joined()
        if t in ASSIGN and self.K[self.i] == "op":
            if kind != "place":
                self.fail()
            self.i += len(t) if t[0] == ">" and t[-1] != "=" else (len(t) if t[0] == ">" else 1)
            self.expression()
            return "statement"
        return kind

    def lambda_parameters(self):
        if not self.attempt(self.formals):
            self.need("(")
            while not self.take(")"):
                self.name()
                if self.T[self.i] != ")":
                    self.need(",")

    def arrow(self) -> str:
        self.need("->")
        self.deeper()
        if self.T[self.i] == "{":
            self.block()
        else:
            self.expression()
        self.depth -= 1
        return "value"

    def conditional(self) -> str:
        kind = self.binary()
        if self.T[self.i] == "?" and self.K[self.i] == "op":
            self.i += 1
            self.deeper()
            self.expression()
            self.need(":")
            i = self.i
            if self.T[i + 1] == "->" or (self.T[i] == "(" and self.T[self.M.get(i, i) + 1] == "->"):
                self.expression()
            else:
                self.conditional()
            self.depth -= 1
            return "value"
        return kind

    def binary(self) -> str:
        kind = self.unary()
        while True:
            if self.K[self.i] == "op":
                t = self.joined()
                if t not in BINARY:
                    return kind
                self.i += len(t) if t[0] == ">" else 1
                self.unary()
            elif self.T[self.i] == "instanceof" and self.K[self.i] == "word":
                self.i += 1
                if not self.attempt(self.pattern):
                    self.type()
            else:
                return kind
            kind = "value"

    def unary(self) -> str:
        t = self.T[self.i]
        if self.K[self.i] == "op":
            if t in ("+", "-", "!", "~"):
                self.i += 1
                self.deeper()
                self.unary()
                self.depth -= 1
                return "value"
            if t in ("++", "--"):
                self.i += 1
                if self.unary() != "place":
                    self.fail()
                return "statement"
            if t == "(" and self.attempt(self.cast):
                return "value"
        kind = self.primary()
        while self.T[self.i] in ("++", "--") and self.K[self.i] == "op":
            if kind != "place":
                self.fail()
            self.i += 1
            kind = "statement"
        return kind

    def cast(self):
        self.need("(")
        primitive = self.T[self.i] in PRIMITIVE
        self.type()
        primitive = primitive and self.T[self.i - 1] != "]"
        while self.take("&"):
            self.type()
        self.need(")")
        t, k = self.T[self.i], self.K[self.i]
        if primitive or k in ("num", "str", "char") or (k == "op" and t in ("(", "!", "~")) or (k == "word" and (t not in KEYWORDS or t in ("this", "super", "new", "true", "false", "null", "switch") or t in PRIMITIVE)):
            if (self.K[self.i] == "word" and self.T[self.i + 1] == "->") or (t == "(" and self.T[self.M.get(self.i, self.i) + 1] == "->"):
                self.expression()
            else:
                self.unary()
        else:
            self.fail()

    def arguments(self):
        self.need("(")
        self.deeper()
        if not self.take(")"):
            while True:
                self.expression()
                if not self.take(","):
                    break
            self.need(")")
        self.depth -= 1

    def reference(self):
        """A method reference's type, as in int[]::new or List<String>::of."""
        self.type()
        if self.T[self.i] != "::":
            self.fail()

    def primary(self) -> str:
        t, k = self.T[self.i], self.K[self.i]
        kind = "value"
        if k in ("num", "str", "char"):
            self.i += 1
        elif k == "op" and t == "(":
            self.i += 1
            self.deeper()
            inner = self.expression()
            self.need(")")
            self.depth -= 1
            kind = "place" if inner == "place" else "value"
        elif k == "word":
            if t in ("this", "super"):
                self.i += 1
                if self.T[self.i] == "(":
                    self.arguments()
                    kind = "statement"
                elif t == "super" and self.T[self.i] not in (".", "::"):
                    self.fail()
            elif t in ("true", "false", "null"):
                self.i += 1
            elif t == "new":
                kind = self.creation()
            elif t == "switch":
                self.switch()
            elif t in PRIMITIVE or t == "void":
                if t == "void":
                    self.i += 1
                else:
                    self.type()
                if self.T[self.i] == "::":
                    pass
                else:
                    self.need(".")
                    self.need("class")
            else:
                if not (self.T[self.i + 1] in ("<", "[") and self.attempt(self.reference)):
                    self.name()
                    kind = "place"
                    if self.T[self.i] == "(" and self.K[self.i] == "op":
                        self.arguments()
                        kind = "statement"
        else:
            self.fail()
        while self.K[self.i] == "op":
            t = self.T[self.i]
            if t == ".":
                self.i += 1
                kind = "place"
                if self.T[self.i] == "new":
                    kind = self.creation()
                elif self.T[self.i] in ("this", "class"):
                    self.i += 1
                    kind = "value"
                else:
                    self.arguments_of_type()
                    if self.T[self.i] == "super":
                        self.i += 1
                    else:
                        self.name()
                    if self.T[self.i] == "(" and self.K[self.i] == "op":
                        self.arguments()
                        kind = "statement"
            elif t == "[":
                if self.T[self.i + 1] == "]":
                    self.dimensions()
                    if self.T[self.i] != "::":
                        self.need(".")
                        self.need("class")
                    kind = "value"
                else:
                    self.i += 1
                    self.expression()
                    self.need("]")
                    kind = "place"
            elif t == "::":
                self.i += 1
                self.arguments_of_type()
                if not self.take("new"):
                    self.name()
                kind = "value"
            else:
                break
        return kind

    def creation(self) -> str:
        self.need("new")
        self.arguments_of_type()
        self.annotations()
        if self.T[self.i] in PRIMITIVE:
            self.i += 1
        else:
            self.class_type()
        if self.T[self.i] == "[":
            sized = False
            while self.T[self.i] == "[":
                self.i += 1
                if self.T[self.i] != "]":
                    self.expression()
                    sized = True
                self.need("]")
                if sized and self.T[self.i] == "[" and self.T[self.i + 1] != "]":
                    continue
            if self.T[self.i] == "{":
                if sized:
                    self.fail()
                self.initializer()
            elif not sized:
                self.fail()
            return "value"
        self.arguments()
        if self.T[self.i] == "{":
            self.members()
        return "statement"
