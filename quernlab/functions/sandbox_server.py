"""A process that runs untrusted programs, each in a child of its own unless the request says otherwise.

Requests and answers are lines of JSON. The server never runs a program itself: it forks a child for
each request, or for a list of requests that may share one, which limits itself, runs the tests, and writes its results to a pipe; the server kills
the child's process group at the deadline, so a program that swallows its alarms ends there. This
keeps a job going; it is no protection against a determined attack.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import resource
import select
import signal
import sys
import time
import types

from quernlab.functions.compare import call_matches, stdout_matches
from quernlab.functions.endless import ENDLESS, without_endless_loops

ERROR, UNUSABLE = -1, -2
MEMORY_BYTES = 4 << 30
OUTPUT_BYTES = 64 << 20
#: A shared child that has held more than so many KB takes no further program.
SHARED_KB = 400 << 10
# What a solution may take for imported.
PREAMBLE = """import sys
import time
import itertools
from itertools import accumulate, product, permutations, combinations
import collections
from collections import Counter, OrderedDict, deque, defaultdict, ChainMap
from functools import lru_cache
import math
from math import sqrt, sin, cos, tan, ceil, fabs, floor, gcd, exp, log, log2
import fractions
from typing import List, Tuple
import numpy as np
import random
import heapq
from heapq import *
"""


class Late(BaseException):
    """The alarm of a step."""


#: Failures of the program at hand that may be its process's and not its own; its time is its own.
_doubts: list[type] = []


def _noted(failure: BaseException) -> None:
    if isinstance(failure, (MemoryError, RecursionError)):
        _doubts.append(type(failure))


def _alarm(*_):
    raise Late


@contextlib.contextmanager
def _within(seconds: float):
    signal.signal(signal.SIGALRM, _alarm)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)


# Functions of os that a program under test must not have: those of processes, of rights, of places, of files.
_MISSING = (
    "kill", "killpg", "system", "fork", "forkpty", "execv", "execve", "execvp", "spawnv", "posix_spawn",
    "putenv", "setuid", "setgid", "chmod", "fchmod", "lchmod", "chown", "fchown", "lchown", "chflags", "lchflags",
    "chdir", "fchdir", "chroot",
    "remove", "unlink", "rmdir", "removedirs", "rename", "renames", "replace", "truncate",
)


def _confine() -> None:
    """Limits and missing functions, in the child only."""
    for what, most in ((resource.RLIMIT_AS, MEMORY_BYTES), (resource.RLIMIT_FSIZE, OUTPUT_BYTES), (resource.RLIMIT_CORE, 0)):
        with contextlib.suppress(ValueError, OSError):
            resource.setrlimit(what, (most, most))
    import builtins
    import shutil
    import subprocess

    def missing(*_, **__):
        raise PermissionError("not available here")

    for name in _MISSING:
        if hasattr(os, name):
            setattr(os, name, missing)
    for name in ("rmtree", "move", "chown"):
        setattr(shutil, name, missing)
    subprocess.Popen = missing
    builtins.exit = builtins.quit = missing
    builtins.help = None
    setattr(builtins, ENDLESS, Late)


#: Whether the program at hand may end where it enters an endless loop.
_cutting = False


def _code(source: str) -> types.CodeType:
    """The compiled source; where it may, one that is late as soon as it enters a loop that it can't leave but by failing."""
    if _cutting and "while" in source and (tree := without_endless_loops(source)):
        return compile(tree, "<solution>", "exec")
    return compile(source, "<solution>", "exec")


def _module(source: str) -> types.ModuleType:
    module = types.ModuleType("solution")
    exec(_code(source), module.__dict__)
    return module


def _with_int_keys(value):
    """A dictionary whose keys JSON made strings, with integer keys again where all are numbers."""
    try:
        return {int(k): v for k, v in value.items()}
    except (AttributeError, TypeError, ValueError):
        return value


def _as_function(code: str) -> str:
    """A script as the function ``code``: imports before its first other line stay outside, all else goes in."""
    lines = code.split("\n")
    head = 0
    while head < len(lines) and lines[head].startswith(("import ", "from ")):
        head += 1
    body = lines[head:]
    if not body:
        return "\n".join(lines)
    return "\n".join([*lines[:head], "stdin = sys.stdin", "stdout = sys.stdout", "def code():", *["\t" + line for line in body]])


def _run_io(code: str, tests: dict, timeout: float, _: list, whole: bool = False) -> list[int]:
    """A result per input, with ``whole`` up to the first failure: 1 right, 0 wrong, ERROR for an exception or a late answer; [UNUSABLE] for a program that can't be loaded."""
    name, inputs, outputs = tests.get("fn_name"), tests["inputs"], tests["outputs"]
    script = name is None
    has_main = script and "def main" in code and 'if __name__ == "__main__"' in code
    source = PREAMBLE + (code if not script or has_main else _as_function(code))
    try:
        with _within(timeout), contextlib.redirect_stdout(io.StringIO()):
            module = _module(source)
            home = module.Solution() if not script and "class Solution" in code else module
            function = getattr(home, name or ("main" if has_main else "code"))
    except (Exception, SystemExit, Late) as failure:
        _noted(failure)
        return [UNUSABLE]
    results = []
    for index, given in enumerate(inputs):
        try:
            expected = outputs[index]
            if script:
                text = "\n".join(given) if isinstance(given, list) else given
                wanted = "\n".join(expected) if isinstance(expected, list) else expected
                with _within(timeout):
                    printed = _call_script(module, function, text)
                results.append(int(stdout_matches(printed, wanted)))
            else:
                if isinstance(given, list) and given and isinstance(given[0], dict):
                    given = [_with_int_keys(given[0])]
                if isinstance(expected, dict):
                    expected = [_with_int_keys(expected)]
                elif isinstance(expected, list) and expected and isinstance(expected[0], dict):
                    expected = [_with_int_keys(expected[0])]
                with _within(timeout), contextlib.redirect_stdout(io.StringIO()):
                    answer = function(*given)
                results.append(int(call_matches(answer.item() if type(answer).__module__ == "numpy" and getattr(answer, "ndim", 1) == 0 else answer, expected)))
        except (Exception, SystemExit, Late) as failure:
            _noted(failure)
            results.append(ERROR)
        if whole and results[-1] != 1:
            break
    return results


def _call_script(module: types.ModuleType, function, text: str) -> list[str]:
    """The lines a function prints when it reads ``text``; leaving by exit() is a normal end."""
    import builtins

    kept, shown = (sys.stdin, builtins.open), io.StringIO()
    sys.stdin = io.StringIO(text)
    if "stdin" in module.__dict__:
        module.stdin = sys.stdin
    builtins.open = lambda *_, **__: io.StringIO(text)
    try:
        with contextlib.redirect_stdout(shown):
            if "stdout" in module.__dict__:
                module.stdout = sys.stdout
            with contextlib.suppress(SystemExit):
                function()
    finally:
        sys.stdin, builtins.open = kept
    return shown.getvalue().splitlines()


def _run_each(code: str, tests: list[str], timeout: float, imports: list[str], whole: bool = False) -> list[int]:
    """A result per assert, with ``whole`` up to the first failure, each in globals of its own; every step has its own time. Leaving by exit() is a failure."""
    results = []
    for test in tests:
        place: dict = {}
        try:
            for step in (*imports, code, test):
                with _within(timeout), contextlib.redirect_stdout(io.StringIO()):
                    exec(_code(step) if step is code else step, place)
            results.append(1)
        except (Exception, SystemExit, Late) as failure:
            _noted(failure)
            results.append(0)
            if whole:
                break
    return results


def _run_shared(code: str, tests: list[str], timeout: float, imports: list[str], _: bool = False) -> list[int]:
    """A result per assert in shared globals; one time for all. Being late, leaving by exit() or a program that fails is nothing right."""
    place: dict = {}
    results = []
    try:
        with _within(timeout), contextlib.redirect_stdout(io.StringIO()):
            for step in (*imports, code):
                exec(_code(step) if step is code else step, place)
            for test in tests:
                try:
                    exec(test, place)
                    results.append(1)
                except Exception as failure:
                    _noted(failure)
                    results.append(0)
    except (Exception, SystemExit, Late) as failure:
        _noted(failure)
        return [0] * len(tests)
    return results


RUNNERS = {"io": _run_io, "per_test": _run_each, "shared": _run_shared}


def _child(requests: list[dict], out: int) -> None:
    """Writes a line of results for each request, null for one that must be run alone to be sure of."""
    os.setpgid(0, 0)
    null = os.open(os.devnull, os.O_RDWR)
    for fd in (0, 1, 2):
        os.dup2(null, fd)
    write, leave, alone = os.write, os._exit, len(requests) == 1
    _confine()
    global _cutting
    for request in requests:
        _doubts.clear()
        _cutting = bool(request.get("cut"))
        try:
            results = RUNNERS[request["mode"]](request["code"], request["tests"], request["timeout"], request.get("imports") or [], bool(request.get("whole")))
        except BaseException:
            results = [] if alone else None
        signal.setitimer(signal.ITIMER_REAL, 0)
        data = json.dumps(None if results is None or (_doubts and not alone) else [int(r) for r in results]).encode() + b"\n"
        while data:
            data = data[write(out, data) :]
        if resource.getrusage(resource.RUSAGE_SELF).ru_maxrss > SHARED_KB:
            break
    leave(0)


def _forked(requests: list[dict]) -> list[list[int] | None]:
    """The results of requests run in one child, as far as it came; each has its own deadline."""
    read, write = os.pipe()
    pid = os.fork()
    if pid == 0:
        os.close(read)
        try:
            _child(requests, write)
        finally:
            os._exit(1)
    os.close(write)
    data, done = b"", 0
    deadline = time.monotonic() + requests[0]["deadline"]
    try:
        while done < len(requests) and (left := deadline - time.monotonic()) > 0:
            if select.select([read], [], [], left)[0]:
                part = os.read(read, 1 << 16)
                if not part:
                    break
                data += part
                if part.count(b"\n"):
                    done += part.count(b"\n")
                    deadline = time.monotonic() + requests[min(done, len(requests) - 1)]["deadline"]
    finally:
        os.close(read)
        for kill in (os.killpg, os.kill):
            with contextlib.suppress(ProcessLookupError, PermissionError):
                kill(pid, signal.SIGKILL)
        os.waitpid(pid, 0)
    return [json.loads(line) for line in data.split(b"\n")[:-1]]


def run(request: dict) -> list[int]:
    """The results of one request; none if the child ended or was ended without them."""
    try:
        return _forked([request])[0]
    except (ValueError, IndexError):
        return []


def run_together(requests: list[dict]) -> list[list[int]]:
    """The results of requests whose programs may share a child; one that is late, or ends the child, is run again alone."""
    results: list[list[int]] = []
    while len(results) < len(requests):
        rest = requests[len(results) :]
        try:
            got = _forked(rest)
        except ValueError:
            got = []
        got += [None] * (len(got) < len(rest))
        results += [run(request) if found is None else found for request, found in zip(rest, got)]
    return results


def main() -> None:
    # What every child imports is loaded before the forks: by programs and, to confine them, by itself.
    import shutil  # noqa: F401
    import subprocess  # noqa: F401

    import numpy  # noqa: F401

    exec(PREAMBLE, {})
    answers = os.fdopen(os.dup(1), "w")
    os.dup2(2, 1)
    for line in sys.stdin:
        request = json.loads(line)
        answers.write(json.dumps(run_together(request) if isinstance(request, list) else run(request)) + "\n")
        answers.flush()


if __name__ == "__main__":
    main()
