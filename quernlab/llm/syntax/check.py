"""The defect of a source file by its language."""

from __future__ import annotations

import ast
import sys
import warnings
from contextlib import contextmanager

from quernlab.llm.syntax.base import CALLS
from quernlab.llm.syntax.cpp import Cpp
from quernlab.llm.syntax.java import Java
from quernlab.llm.syntax.javascript import JavaScript
from quernlab.llm.syntax.lexer import Broken, scan, scan_json
from quernlab.llm.syntax.python import parse as parse_python

#: The language of a file's extension.
LANGUAGES = {"py": "python", "java": "java", "cpp": "cpp", "js": "javascript", "json": "json"}
_PARSERS = {"java": ("java", Java), "cpp": ("cpp", Cpp), "javascript": ("js", JavaScript)}


@contextmanager
def _deep(text: str):
    """Within, calls may nest as deep as a text's tokens can ask for."""
    usual = sys.getrecursionlimit()
    sys.setrecursionlimit(usual + CALLS * (len(text) + 100))
    try:
        yield
    finally:
        sys.setrecursionlimit(usual)


def python_defect(text: str) -> str | None:
    """The verdict of lexer, stack and grammar; what they call broken, the interpreter's own parser must refuse, too."""
    try:
        with _deep(text):
            parse_python(text)
        return None
    except Broken as broken:
        kind = broken.args[0]
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return None
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return kind


def json_defect(text: str) -> str | None:
    return scan_json(text)


def family_defect(text: str, language: str) -> str | None:
    """Lexer and pushdown stack, then the grammar."""
    lang, parser = _PARSERS[language]
    try:
        with _deep(text):
            parser(scan(text, lang)).program()
        return None
    except Broken as broken:
        return broken.args[0]


def defect(text: str | None, language: str | None) -> str | None:
    """The kind of defect of a text, or None; null and blank texts and unknown languages have none."""
    if text is None or language is None or not text.strip():
        return None
    if language == "python":
        return python_defect(text)
    if language == "json":
        return json_defect(text)
    return family_defect(text, language) if language in _PARSERS else None
