"""What the recursive-descent parsers share."""

from __future__ import annotations

from quernlab.llm.syntax.lexer import INVALID, PREMATURE, Broken, Tokens

#: Calls that a token may take, at most. Nesting is not limited: calls of Python functions lie on the heap,
#: and the interpreter's limit is raised to what a source of so many tokens can need.
CALLS = 60


class Parser:
    def __init__(self, tokens: Tokens):
        self.T, self.K, self.L, self.G, self.M = tokens.text, tokens.kind, tokens.line, tokens.glued, tokens.match
        self.n = len(self.T)
        self.T.append("")
        self.K.append("end")
        self.L.append(True)
        self.G.append(False)
        self.i = 0
        self.depth = 0
        self.failed: set[tuple[str, int]] = set()

    def fail(self):
        raise Broken(PREMATURE if self.i >= self.n else INVALID, self.i)

    def need(self, token: str):
        if self.T[self.i] != token or self.K[self.i] in ("str", "char"):
            self.fail()
        self.i += 1

    def take(self, token: str) -> bool:
        if self.T[self.i] == token and self.K[self.i] not in ("str", "char"):
            self.i += 1
            return True
        return False

    def attempt(self, rule) -> bool:
        """Whether ``rule`` matches here; if not, nothing is consumed. Failures are remembered, so
        nested attempts don't multiply."""
        at, depth = self.i, self.depth
        key = (rule.__name__, at)
        if key in self.failed:
            return False
        try:
            rule()
            return True
        except Broken:
            self.i, self.depth = at, depth
            self.failed.add(key)
            return False

    def deeper(self):
        self.depth += 1

    def joined(self) -> str:
        """The operator at this place, with the '>' and '=' that touch it."""
        t = self.T[self.i]
        if t != ">":
            return t
        k = self.i + 1
        while self.G[k] and self.T[k] == ">" and len(t) < 3:
            t += ">"
            k += 1
        if self.G[k] and self.T[k] == "=":
            t += "="
        elif self.G[k] and self.T[k] == "==":
            return t
        return t
