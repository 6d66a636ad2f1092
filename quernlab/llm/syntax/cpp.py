"""C++17 translation units after preprocessing directives have been set aside.

Names are not looked up, so where the grammar depends on whether a name is a type, every reading is
tried; a text is broken if none fits.
"""

from __future__ import annotations

from quernlab.llm.syntax.base import Parser

#: Keywords, the built-in types and specifiers among them, and the alternative operators.
KEYWORDS = frozenset(
    "alignas alignof asm auto bool break case catch char char16_t char32_t class const constexpr const_cast continue decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept nullptr operator private protected public register reinterpret_cast return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while and and_eq bitand bitor compl not not_eq or or_eq xor xor_eq".split()
)
BUILTIN = frozenset("bool char char16_t char32_t wchar_t short int long signed unsigned float double void auto".split())
SPECIFIER = frozenset("static extern inline constexpr const volatile mutable register thread_local typedef virtual explicit friend".split())
ASSIGN = frozenset("= += -= *= /= %= <<= >>= &= ^= |= and_eq or_eq xor_eq".split())
BINARY = frozenset("+ - * / % << >> < > <= >= == != & ^ | && || .* ->* and or xor bitand bitor not_eq".split())
PREFIX = frozenset("+ - ! ~ * & && ++ -- not compl".split())
OPERATORS = frozenset("+ - * / % ^ & | ~ ! = < > += -= *= /= %= ^= &= |= << >> <<= >>= == != <= >= && || ++ -- , ->* ->".split())


class Cpp(Parser):
    def program(self):
        self.dots = "..." in self.T
        while self.i < self.n:
            self.declaration("file")

    # names and types

    def is_name(self, k: int) -> bool:
        return self.K[k] == "word" and self.T[k] not in KEYWORDS

    def name(self):
        if not self.is_name(self.i):
            self.fail()
        self.i += 1

    def attributes(self):
        while True:
            if self.T[self.i] == "[" and self.T[self.i + 1] == "[" and self.K[self.i] == "op":
                self.i = self.M.get(self.i, self.n) + 1
            elif self.T[self.i] in ("alignas", "__attribute__", "__declspec") and self.T[self.i + 1] == "(":
                self.i = self.M.get(self.i + 1, self.n) + 1
            else:
                return

    def template_arguments(self):
        self.need("<")
        self.deeper()
        if not self.take(">"):
            while True:
                if not self.attempt(self.template_argument_type):
                    self.template_argument_value()
                self.take("...")
                if not self.take(","):
                    break
            self.need(">")
        self.depth -= 1

    def template_argument_type(self):
        self.type_id()
        if self.T[self.i] not in (",", ">", "..."):
            self.fail()

    def template_argument_value(self):
        self.conditional(True)

    def qualified(self, destructor: bool = False):
        """A name with qualifiers and template arguments."""
        self.take("::")
        while True:
            self.take("template")
            if destructor and self.take("~"):
                self.name()
                return
            if self.T[self.i] == "operator":
                self.operator_name()
                return
            self.name()
            if self.T[self.i] == "<" and self.K[self.i] == "op":
                self.attempt(self.template_arguments)
            if self.T[self.i] == "::" and (self.K[self.i + 1] == "word" or self.T[self.i + 1] == "~") and self.T[self.i + 1] != "*":
                self.i += 1
                continue
            return

    def operator_name(self):
        self.need("operator")
        t = self.T[self.i]
        if t in ("(", "["):
            self.i += 1
            self.need(")" if t == "(" else "]")
        elif t in ("new", "delete"):
            self.i += 1
            if self.take("["):
                self.need("]")
        elif self.K[self.i] == "str":
            self.i += 1
            if self.K[self.i] == "word":
                self.i += 1
        elif self.K[self.i] == "op" and (t in OPERATORS):
            whole = self.joined()
            self.i += len(whole) if t == ">" else 1
        else:
            self.specifiers(type_only=True)
            self.pointers()

    def specifiers(self, type_only: bool = False) -> bool:
        """Declaration specifiers; whether there is a type among them."""
        typed = False
        while True:
            t, k = self.T[self.i], self.K[self.i]
            if k != "word":
                if t == "[" and self.T[self.i + 1] == "[":
                    self.attributes()
                    continue
                if t == "::" and not typed and self.is_name(self.i + 1):
                    self.qualified()
                    typed = True
                    continue
                return typed
            if t in BUILTIN:
                if typed == "name":
                    self.fail()
                self.i += 1
                typed = "builtin"
            elif t in SPECIFIER:
                if type_only and t not in ("const", "volatile"):
                    self.fail()
                self.i += 1
                if t == "explicit" and self.T[self.i] == "(":
                    self.i = self.M.get(self.i, self.n) + 1
            elif t in ("class", "struct", "union", "enum"):
                if typed:
                    self.fail()
                self.class_specifier(type_only)
                typed = "name"
            elif t == "typename":
                self.i += 1
                self.qualified()
                typed = "name"
            elif t == "decltype":
                if typed:
                    self.fail()
                self.i += 1
                self.need("(")
                self.expression()
                self.need(")")
                while self.take("::"):
                    self.name()
                typed = "name"
            elif t in ("alignas", "__attribute__", "__declspec"):
                self.attributes()
            elif not typed and t not in KEYWORDS:
                self.qualified()
                if self.T[self.i - 1] in ("operator", "~"):
                    self.fail()
                typed = "name"
            else:
                return typed

    def class_specifier(self, type_only: bool):
        keyword = self.T[self.i]
        self.i += 1
        if keyword == "enum" and self.T[self.i] in ("class", "struct"):
            self.i += 1
        self.attributes()
        named = self.is_name(self.i) or self.T[self.i] == "::"
        if named:
            self.qualified()
            if self.T[self.i] == "final" and self.T[self.i + 1] in ("{", ":"):
                self.i += 1
        if keyword == "enum":
            if self.take(":"):
                self.specifiers(type_only=True)
            if self.T[self.i] == "{" and not type_only:
                self.i += 1
                while not self.take("}"):
                    self.name()
                    self.attributes()
                    if self.take("="):
                        self.conditional()
                    if self.T[self.i] != "}":
                        self.need(",")
            elif not named:
                self.fail()
            return
        if self.T[self.i] == ":" and not type_only and named:
            self.i += 1
            while True:
                self.attributes()
                while self.T[self.i] in ("public", "protected", "private", "virtual"):
                    self.i += 1
                self.qualified()
                self.take("...")
                if not self.take(","):
                    break
            if self.T[self.i] != "{":
                self.fail()
        if self.T[self.i] == "{" and not type_only:
            self.i += 1
            self.deeper()
            while not self.take("}"):
                self.declaration("class")
            self.depth -= 1
        elif not named:
            self.fail()

    def pointers(self):
        while True:
            t = self.T[self.i]
            if t in ("*", "&", "&&") and self.K[self.i] == "op":
                self.i += 1
            elif t in ("const", "volatile", "__restrict", "__restrict__") and self.K[self.i] == "word":
                self.i += 1
            elif t == "[" and self.T[self.i + 1] == "[":
                self.attributes()
            elif self.K[self.i] == "word" and self.is_name(self.i) and self.T[self.i + 1] == "::" and self.attempt(self.member_pointer):
                pass
            else:
                return

    def member_pointer(self):
        self.name()
        if self.T[self.i] == "<":
            self.template_arguments()
        self.need("::")
        while self.is_name(self.i):
            self.name()
            self.need("::")
        self.need("*")

    def type_id(self):
        if not self.specifiers(type_only=True):
            self.fail()
        self.abstract_declarator()

    def abstract_declarator(self):
        self.pointers()
        self.take("...")
        if self.T[self.i] == "(" and self.K[self.i] == "op":
            if not self.attempt(self.nested_abstract):
                self.attempt(self.function_suffix)
        while self.T[self.i] == "[" and self.K[self.i] == "op":
            self.i += 1
            if self.T[self.i] != "]":
                self.conditional()
            self.need("]")

    def nested_abstract(self):
        self.need("(")
        if self.T[self.i] not in ("*", "&", "&&") and not (self.is_name(self.i) and self.T[self.i + 1] == "::"):
            self.fail()
        self.pointers()
        self.need(")")
        self.attempt(self.function_suffix)

    # declarations

    def declaration(self, where: str):
        t, k = self.T[self.i], self.K[self.i]
        if k == "end":
            self.fail()
        if t == ";" and k == "op":
            self.i += 1
            return
        if k == "word":
            if t in ("public", "private", "protected"):
                if where != "class":
                    self.fail()
                self.i += 1
                self.need(":")
                return
            if t == "namespace" or (t == "inline" and self.T[self.i + 1] == "namespace"):
                return self.namespace()
            if t == "extern" and self.K[self.i + 1] == "str":
                self.i += 2
                if self.take("{"):
                    while not self.take("}"):
                        self.declaration(where)
                    return
                return self.declaration(where)
            if t == "extern" and self.T[self.i + 1] == "template":
                self.i += 1
                t = "template"
            if t == "template":
                self.i += 1
                if self.T[self.i] == "<":
                    self.template_parameters()
                return self.declaration(where)
            if t == "using":
                return self.using()
            if t == "static_assert":
                self.i += 1
                self.arguments()
                return self.need(";")
            if t == "asm":
                self.i += 1
                self.arguments()
                return self.need(";")
            if where != "block" and self.is_name(self.i) and self.T[self.i + 1] == "(" and self.attempt(self.macro_call):
                return
        self.simple_declaration(where)

    def macro_call(self):
        """A macro like TEST(a, b) that stands for a declaration, at the end of a line."""
        self.name()
        if not self.T[self.i - 1].isupper():
            self.fail()
        self.i = self.M.get(self.i, self.n) + 1
        if not self.take(";") and not self.L[self.i] and self.T[self.i] != "{":
            self.fail()
        if self.T[self.i] == "{":
            self.block()

    def namespace(self):
        self.take("inline")
        self.need("namespace")
        self.attributes()
        if self.is_name(self.i):
            self.name()
            while self.take("::"):
                self.take("inline")
                self.name()
            if self.take("="):
                self.qualified()
                return self.need(";")
        self.need("{")
        self.deeper()
        while not self.take("}"):
            self.declaration("file")
        self.depth -= 1

    def using(self):
        self.need("using")
        if self.take("namespace"):
            self.qualified()
        elif self.is_name(self.i) and self.T[self.i + 1] in ("=", "["):
            self.name()
            self.attributes()
            self.need("=")
            self.type_id()
        else:
            self.take("typename")
            self.qualified()
            while self.take(","):
                self.qualified()
        self.need(";")

    def template_parameters(self):
        self.need("<")
        while not self.take(">"):
            if self.T[self.i] in ("typename", "class") and not (self.is_name(self.i + 1) and self.T[self.i + 2] == "::"):
                self.i += 1
                self.take("...")
                if self.is_name(self.i):
                    self.name()
                if self.take("="):
                    self.type_id()
            elif self.T[self.i] == "template":
                self.i += 1
                self.template_parameters()
                self.i += self.T[self.i] in ("class", "typename")
                self.take("...")
                if self.is_name(self.i):
                    self.name()
                if self.take("="):
                    self.qualified()
            else:
                if not self.specifiers():
                    self.fail()
                self.pointers()
                self.take("...")
                if self.is_name(self.i):
                    self.name()
                if self.take("="):
                    self.conditional(True)
            if self.T[self.i] != ">":
                self.need(",")

    def simple_declaration(self, where: str):
        """Specifiers and declarators, or a function definition."""
        at = self.i
        if where != "block" and self.attempt(self.special_member):
            pass
        else:
            self.i = at
            if not self.specifiers():
                self.fail()
            if self.take(";"):
                return None
            if "auto" in self.T[at : self.i] and self.attempt(self.bindings):
                return self.need(";")
            self.declarator()
        first = True
        while True:
            if first and where != "block":
                if self.T[self.i] == "{" and self.was_function:
                    return self.block()
                if self.T[self.i] == ":" and self.was_function:
                    self.constructor_initializers()
                    return self.block()
                if self.T[self.i] == "try" and self.was_function:
                    return self.s_try()
            first = False
            self.initializer(where)
            if not self.take(","):
                break
            self.declarator()
        return self.need(";")

    def bindings(self):
        if not self.take("&"):
            self.take("&&")
        self.need("[")
        self.name()
        while self.take(","):
            self.name()
        self.need("]")
        if self.T[self.i] not in ("=", "{", "(", ":"):
            self.fail()
        if self.T[self.i] != ":":
            self.initializer("block")

    def special_member(self):
        """A constructor, destructor or conversion: a declarator without a type."""
        while self.T[self.i] in ("explicit", "virtual", "inline", "constexpr", "friend", "static"):
            self.i += 1
        self.attributes()
        start = self.i
        self.qualified(destructor=True)
        if self.T[self.i] != "(":
            self.fail()
        special = any(self.T[k] in ("~", "operator") for k in range(start, self.i))
        self.function_suffix()
        self.was_function = True
        t = self.T[self.i]
        if not (t in ("{", ":", ";", "try") or (t == "=" and self.T[self.i + 1] in ("default", "delete", "0"))) or (t == ";" and not special and self.T[start + 1] != "("):
            self.fail()
        if t == ":" and self.T[self.i + 1] == ":":
            self.fail()
        if t == "{" and not special and self.T[start + 1] == "(" and not self.in_class(start):
            self.fail()

    def in_class(self, k: int) -> bool:
        return self.depth > 0

    def declarator(self):
        self.was_function = False
        self.pointers()
        self.take("...")
        if self.T[self.i] == "(" and self.K[self.i] == "op":
            self.i += 1
            self.deeper()
            self.declarator()
            self.depth -= 1
            self.need(")")
        elif self.T[self.i] == ":":
            pass  # an unnamed bit-field
        else:
            self.qualified(destructor=True)
        self.attributes()
        while self.K[self.i] == "op":
            if self.T[self.i] == "(" and self.attempt(self.function_suffix):
                self.was_function = True
            elif self.T[self.i] == "[":
                self.i += 1
                if self.T[self.i] != "]":
                    self.expression()
                self.need("]")
            else:
                break

    def function_suffix(self):
        self.need("(")
        self.parameters()
        while True:
            t = self.T[self.i]
            if t in ("const", "volatile", "override", "final", "&", "&&") and self.K[self.i] in ("word", "op"):
                self.i += 1
            elif t == "noexcept":
                self.i += 1
                if self.T[self.i] == "(":
                    self.arguments()
            elif t == "throw" and self.T[self.i + 1] == "(":
                self.i += 1
                self.i = self.M.get(self.i, self.n) + 1
            elif t == "->" and self.K[self.i] == "op":
                self.i += 1
                self.type_id()
            elif t == "[" and self.T[self.i + 1] == "[":
                self.attributes()
            else:
                return

    def parameters(self):
        self.deeper()
        if not self.take(")"):
            while True:
                if self.take("..."):
                    break
                self.attributes()
                if not self.specifiers():
                    self.fail()
                self.parameter_declarator()
                if self.take("="):
                    self.initializer_clause()
                if self.take("..."):
                    break
                if not self.take(","):
                    break
            self.need(")")
        self.depth -= 1

    def parameter_declarator(self):
        self.pointers()
        self.take("...")
        if self.is_name(self.i):
            self.name()
            self.attributes()
            while self.T[self.i] in ("[", "(") and self.K[self.i] == "op":
                if self.T[self.i] == "(":
                    self.function_suffix()
                else:
                    self.i += 1
                    if self.T[self.i] != "]":
                        self.conditional()
                    self.need("]")
        elif self.T[self.i] == "(":
            if not self.attempt(self.named_nested):
                self.abstract_declarator()
        else:
            self.abstract_declarator()

    def named_nested(self):
        self.declarator()

    def initializer(self, where: str):
        t, k = self.T[self.i], self.K[self.i]
        if k != "op":
            return
        if t == "=":
            self.i += 1
            if self.T[self.i] in ("default", "delete") and self.K[self.i] == "word" and self.T[self.i + 1] in (";", ","):
                self.i += 1
            else:
                self.initializer_clause()
        elif t == "{":
            self.braces()
        elif t == "(":
            self.arguments()
        elif t == ":" and where == "class":
            self.i += 1
            self.conditional()

    def initializer_clause(self):
        if self.T[self.i] == "{" and self.K[self.i] == "op":
            self.braces()
        else:
            self.assign()

    def braces(self):
        self.need("{")
        self.deeper()
        while not self.take("}"):
            if self.T[self.i] == "." and self.is_name(self.i + 1):
                self.i += 2
                if self.T[self.i] == "=":
                    self.i += 1
            self.initializer_clause()
            self.take("...")
            if self.T[self.i] != "}":
                self.need(",")
        self.depth -= 1

    def constructor_initializers(self):
        self.need(":")
        while True:
            self.qualified()
            if self.T[self.i] == "(":
                self.arguments()
            else:
                self.braces()
            self.take("...")
            if not self.take(","):
                return

    # statements

    def block(self):
        self.need("{")
        self.deeper()
        while not self.take("}"):
            self.statement()
        self.depth -= 1

    def local_declaration(self):
        self.declaration("block")

    def expression_statement(self):
        self.expression()
        self.need(";")

    def statement(self):
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
            if t == "public" or t == "private" or t == "protected":
                self.fail()
            if self.is_name(self.i) and self.T[self.i + 1] == ":" and self.K[self.i + 1] == "op":
                self.i += 2
                return self.statement()
        self.attributes()
        if k == "word" and (t in BUILTIN or t in SPECIFIER or t in ("class", "struct", "union", "enum", "using", "typename", "static_assert", "namespace", "template", "alignas")):
            if t in BUILTIN and self.T[self.i + 1] in ("(", "{"):
                if self.attempt(self.expression_statement):
                    return None
            return self.declaration("block")
        if k == "word" and (t not in KEYWORDS or t == "decltype") and self.attempt(self.local_declaration):
            return None
        return self.expression_statement()

    def condition_declaration(self):
        if not self.specifiers():
            self.fail()
        if self.attempt(self.bindings):
            return
        self.declarator()
        if self.T[self.i] not in ("=", "{"):
            self.fail()
        self.initializer("block")

    def condition(self):
        self.need("(")
        if not (self.K[self.i] == "word" and self.attempt(self.condition_with_end)):
            if self.attempt(self.init_statement):
                pass
            if not (self.K[self.i] == "word" and self.attempt(self.condition_with_end)):
                self.expression()
        self.need(")")

    def condition_with_end(self):
        self.condition_declaration()
        if self.T[self.i] != ")":
            self.fail()

    def init_statement(self):
        close = self.T[self.i]
        if close == ";":
            self.i += 1
            return
        if not self.attempt(self.local_declaration):
            self.expression_statement()

    def s_if(self):
        self.i += 1
        self.take("constexpr")
        self.condition()
        self.statement()
        if self.take("else"):
            self.statement()

    def s_while(self):
        self.i += 1
        self.condition()
        self.statement()

    s_switch = s_while

    def s_do(self):
        self.i += 1
        self.statement()
        self.need("while")
        self.need("(")
        self.expression()
        self.need(")")
        self.need(";")

    def s_for(self):
        self.i += 1
        self.need("(")
        if self.attempt(self.range_head):
            if self.T[self.i] == "{":
                self.braces()
            else:
                self.expression()
        else:
            self.init_statement()
            if self.T[self.i] != ";":
                if not (self.K[self.i] == "word" and self.attempt(self.condition_declaration)):
                    self.expression()
            self.need(";")
            if self.T[self.i] != ")":
                self.expression()
        self.need(")")
        self.statement()

    def range_head(self):
        if not self.specifiers():
            self.fail()
        if not self.attempt(self.bindings):
            self.pointers()
            self.name()
        self.need(":")

    def s_return(self):
        self.i += 1
        if self.T[self.i] != ";":
            if self.T[self.i] == "{":
                self.braces()
            else:
                self.expression()
        self.need(";")

    def s_break(self):
        self.i += 1
        self.need(";")

    s_continue = s_break

    def s_goto(self):
        self.i += 1
        self.name()
        self.need(";")

    def s_case(self):
        self.i += 1
        self.conditional()
        self.need(":")
        self.statement()

    def s_default(self):
        self.i += 1
        self.need(":")
        self.statement()

    def s_else(self):
        self.fail()

    s_catch = s_else

    def s_try(self):
        self.i += 1
        if self.T[self.i] == ":":
            self.constructor_initializers()
        self.block()
        if self.T[self.i] != "catch":
            self.fail()
        while self.take("catch"):
            self.need("(")
            if not self.take("..."):
                if not self.specifiers():
                    self.fail()
                self.parameter_declarator()
            self.need(")")
            self.block()

    # expressions

    def expression(self):
        self.assign()
        while self.take(","):
            self.assign()

    def assign(self):
        if self.T[self.i] == "throw" and self.K[self.i] == "word":
            self.i += 1
            if self.T[self.i] not in (";", ")", ",", ":"):
                self.assign()
            return
        self.conditional()
        t = self.joined()
        if self.K[self.i] in ("op", "word") and t in ASSIGN:
            self.i += len(t) if t[0] == ">" else 1
            if self.T[self.i] == "{" and self.K[self.i] == "op":
                self.braces()
            else:
                self.assign()

    def conditional(self, in_template: bool = False):
        self.binary(in_template)
        if self.T[self.i] == "?" and self.K[self.i] == "op":
            self.i += 1
            self.deeper()
            self.expression()
            self.need(":")
            self.assign()
            self.depth -= 1

    def binary(self, in_template: bool):
        self.unary()
        while self.K[self.i] in ("op", "word"):
            t = self.joined()
            if t not in BINARY or (in_template and t[0] == ">"):
                return
            self.i += len(t) if t[0] == ">" else 1
            self.unary()

    def unary(self):
        t, k = self.T[self.i], self.K[self.i]
        if k in ("op", "word") and t in PREFIX:
            self.i += 1
            self.deeper()
            self.unary()
            self.depth -= 1
            return
        if k == "word":
            if t in ("sizeof", "alignof"):
                self.i += 1
                if self.take("..."):
                    return self.arguments()
                if self.T[self.i] == "(" and self.attempt(self.type_in_parentheses):
                    return None
                return self.unary()
            if t == "noexcept":
                self.i += 1
                return self.arguments()
            if t == "new" or t == "delete":
                return self.allocation()
        elif k == "op" and t == "::" and self.T[self.i + 1] in ("new", "delete"):
            self.i += 1
            return self.allocation()
        elif k == "op" and t == "(" and self.attempt(self.cast):
            return None
        self.postfix()
        return None

    def type_in_parentheses(self):
        self.need("(")
        self.type_id()
        self.need(")")

    def cast(self):
        builtin = self.T[self.i + 1] in BUILTIN or self.T[self.i + 1] in ("const", "struct", "unsigned")
        self.type_in_parentheses()
        t, k = self.T[self.i], self.K[self.i]
        if k in ("num", "str", "char") or (k == "word" and (t not in KEYWORDS or t in ("this", "true", "false", "nullptr", "sizeof", "new", "static_cast", "not"))) or (k == "op" and (t in ("(", "!", "~") or (t == "{" and not builtin) or (builtin and t in PREFIX))):
            if t == "{":
                self.braces()
            else:
                self.unary()
        else:
            self.fail()

    def allocation(self):
        if self.take("delete"):
            if self.T[self.i] == "[" and self.T[self.i + 1] == "]":
                self.i += 2
            return self.unary()
        self.need("new")
        if self.T[self.i] == "(":
            if not self.attempt(self.placed):
                self.type_in_parentheses()
                return self.new_initializer()
        if self.T[self.i] == "(":
            self.type_in_parentheses()
        else:
            if not self.specifiers(type_only=True):
                self.fail()
            self.pointers()
            while self.T[self.i] == "[":
                self.i += 1
                if self.T[self.i] != "]":
                    self.expression()
                self.need("]")
        return self.new_initializer()

    def placed(self):
        self.arguments()
        if self.K[self.i] != "word" and self.T[self.i] not in ("(", "::"):
            self.fail()

    def new_initializer(self):
        if self.T[self.i] == "(":
            self.arguments()
        elif self.T[self.i] == "{":
            self.braces()

    def arguments(self):
        self.need("(")
        self.deeper()
        if not self.take(")"):
            while True:
                if not (self.K[self.i] == "word" and self.T[self.i] in BUILTIN and self.attempt(self.type_argument)):
                    self.initializer_clause()
                self.take("...")
                if not self.take(","):
                    break
            self.need(")")
        self.depth -= 1

    def type_argument(self):
        """A type where only a macro or sizeof could take one."""
        self.type_id()
        if self.T[self.i] not in (",", ")"):
            self.fail()

    def postfix(self):
        t, k = self.T[self.i], self.K[self.i]
        if k in ("num", "char"):
            self.i += 1
        elif k == "str":
            while self.K[self.i] == "str" or (self.K[self.i] == "word" and self.K[self.i - 1] == "str" and (self.G[self.i] or self.T[self.i].isupper() or self.T[self.i].startswith("PRI"))):
                self.i += 1
        elif k == "op":
            if t == "(":
                self.i += 1
                self.deeper()
                if not (self.dots and self.attempt(self.fold)):
                    self.expression()
                self.need(")")
                self.depth -= 1
            elif t == "[":
                self.lambda_expression()
            elif t == "::":
                self.qualified()
            elif t == "{":
                self.fail()
            else:
                self.fail()
        elif k == "word":
            if t in ("this", "true", "false", "nullptr"):
                self.i += 1
            elif t in ("static_cast", "dynamic_cast", "reinterpret_cast", "const_cast"):
                self.i += 1
                self.need("<")
                self.type_id()
                self.need(">")
                self.need("(")
                self.expression()
                self.need(")")
            elif t == "typeid":
                self.i += 1
                if not self.attempt(self.type_in_parentheses):
                    self.arguments()
            elif t in BUILTIN:
                while self.T[self.i] in BUILTIN:
                    self.i += 1
                if self.T[self.i] == "(":
                    self.arguments()
                else:
                    self.braces()
            elif t == "typename":
                self.i += 1
                self.qualified()
                if self.T[self.i] == "(":
                    self.arguments()
                else:
                    self.braces()
            elif t == "decltype":
                self.i += 1
                self.arguments()
            elif t == "operator":
                self.operator_name()
            else:
                self.expression_name()
                if self.T[self.i] == "{" and self.K[self.i] == "op" and self.G[self.i]:
                    self.braces()
        else:
            self.fail()
        while self.K[self.i] == "op":
            t = self.T[self.i]
            if t == "(":
                self.arguments()
            elif t == "[":
                self.i += 1
                if self.T[self.i] == "{":
                    self.braces()
                else:
                    self.expression()
                self.need("]")
            elif t in (".", "->"):
                self.i += 1
                self.take("template")
                if self.take("~"):
                    self.name()
                elif self.T[self.i] == "operator":
                    self.operator_name()
                else:
                    self.expression_name()
            elif t in ("++", "--"):
                self.i += 1
            else:
                return

    def fold(self):
        if self.take("..."):
            self.i += 1
            self.unary()
        else:
            self.unary()
            self.i += 1
            self.need("...")
            if self.T[self.i] != ")":
                self.i += 1
                self.unary()
        if self.T[self.i] != ")":
            self.fail()

    def expression_name(self):
        """A qualified name; template arguments only where what follows can't be an operand of '>'."""
        while True:
            self.take("template")
            if self.T[self.i] == "operator":
                return self.operator_name()
            if self.take("~"):
                return self.name()
            self.name()
            if self.T[self.i] == "<" and self.K[self.i] == "op":
                self.attempt(self.called_template)
            if self.T[self.i] == "::" and self.K[self.i] == "op":
                self.i += 1
                continue
            return None

    def called_template(self):
        self.template_arguments()
        if self.T[self.i] not in ("(", "::", "{", ")", ",", ";"):
            self.fail()

    def lambda_expression(self):
        self.need("[")
        while not self.take("]"):
            if self.T[self.i] in ("&", "=") and self.T[self.i + 1] in ("]", ","):
                self.i += 1
            else:
                self.take("&")
                self.take("*")
                if not self.take("this"):
                    self.take("...")
                    self.name()
                    self.take("...")
                    if self.T[self.i] in ("=", "{", "("):
                        self.initializer("block")
            if self.T[self.i] != "]":
                self.need(",")
        if self.take("("):
            self.parameters()
        while self.T[self.i] in ("mutable", "constexpr", "noexcept"):
            self.i += 1
        self.attributes()
        if self.take("->"):
            self.type_id()
        self.block()
