"""Whether a program's result is the expected one."""

from __future__ import annotations

import math


def _same(a, b) -> bool:
    try:
        return bool(a == b)
    except Exception:
        return False


def call_matches(result, expected) -> bool:
    """A returned value: equal to the expected one or to the only element of a list around it; tuples count as lists."""
    if isinstance(result, tuple):
        result = list(result)
    if _same(result, expected):
        return True
    if not isinstance(expected, list) or not expected:
        return False
    if _same(result, expected[0]):
        return True
    nested = isinstance(result, list) and bool(result) and isinstance(result[0], tuple)
    try:
        return nested and _same([list(x) for x in result], expected[0])
    except TypeError:
        return False


def _close(a: float, b: float) -> bool:
    return a == b or (math.isfinite(a) and math.isfinite(b) and abs(a - b) <= 1e-8 + 1e-5 * abs(b))


def _all_close(printed: list[str], expected: list[str]) -> bool:
    try:
        left, right = [float(x) for x in printed], [float(x) for x in expected]
    except ValueError:
        return False
    return len(left) == len(right) and all(map(_close, left, right))


def _token_sets(lines: list[str]) -> set[frozenset[str]]:
    return {frozenset(line.split()) for line in lines}


def _rounded(sets: set[frozenset[str]]) -> set[frozenset[float]] | None:
    try:
        return {frozenset(round(float(t), 3) for t in s) for s in sets}
    except ValueError:
        return None


def stdout_matches(printed: list[str], expected: str) -> bool:
    """Printed lines: equal to the expected text but for outer blanks, blank lines and blanks at line ends;
    or the same numbers nearly; or the same sets of tokens per line, whatever their order and number,
    also after rounding to three places."""
    wanted = expected.strip()
    if "\n".join(printed).strip() == wanted or "\n".join(line.strip() for line in printed).strip() == wanted:
        return True
    if printed == [expected]:
        return True
    lines = [line.strip() for line in expected.split("\n") if line]
    if printed == lines:
        return True
    filled = [line for line in printed if line]
    if filled == lines or _all_close(filled, lines):
        return True
    shown, asked = _token_sets([line for line in filled if line.split()]), _token_sets(lines)
    if shown == asked:
        return True
    left, right = _rounded(shown), _rounded(asked)
    return left is not None and left == right
