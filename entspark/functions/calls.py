"""Parameters and arguments of functions, from text."""

from __future__ import annotations

import ast
import re
import textwrap
from dataclasses import dataclass

_OPEN, _CLOSE = "([{<", ")]}>"


@dataclass(frozen=True)
class Params:
    least: int
    most: int
    variadic: bool = False


def _parse(text: str) -> ast.AST | None:
    try:
        return ast.parse(textwrap.dedent(text))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def inner(text: str, at: int) -> str:
    """What stands in the parenthesis that opens at ``at``."""
    depth = 0
    for k in range(at, len(text)):
        if text[k] == "(":
            depth += 1
        elif text[k] == ")":
            depth -= 1
            if not depth:
                return text[at + 1 : k]
    return text[at + 1 :]


def parts(text: str) -> list[str]:
    """Cut at commas outside brackets; nothing of a blank text."""
    if not text.strip():
        return []
    out, depth, start = [], 0, 0
    for k, c in enumerate(text):
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE and text[k - 1 : k] not in ("-", "="):
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start:k])
            start = k + 1
    last = text[start:]
    return [*out, last] if last.strip() else out


def param_count(text: str) -> int:
    """Commas and one, of the first parenthesis on the first line; ``self`` counts."""
    line = text.split("\n", 1)[0]
    at = line.find("(")
    return len(parts(inner(line, at))) if at >= 0 else 0


def call_arguments(text: str, name: str) -> int | None:
    """Arguments of the first ``name(`` in a text; None without one."""
    m = re.search(rf"(?<![A-Za-z0-9_]){re.escape(name)}\(", text)
    return len(parts(inner(text, m.end() - 1))) if m else None


def params(text: str, extension: str) -> Params | None:
    """How many arguments a function takes; the receiver isn't one."""
    if extension in (".py", ".pyi"):
        tree = _parse(text)
        f = next((n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)), None) if tree else None
        if f is None:
            return None
        a = f.args
        own = [*a.posonlyargs, *a.args]
        if own and own[0].arg in ("self", "cls"):
            own = own[1:]
        only = sum(d is None for d in a.kw_defaults)
        return Params(max(0, len(own) - len(a.defaults)) + only, len(own) + len(a.kwonlyargs), bool(a.vararg or a.kwarg))
    at = text.find("(")
    if at < 0:
        return None
    if extension == ".go" and re.match(r"\s*func\s*\(", text):
        at = text.find("(", at + len(inner(text, at)) + 2)
    own = [p.strip() for p in parts(inner(text, at))]
    if extension == ".rs":
        own = [p for p in own if not re.match(r"&?\s*(?:'\w+\s+)?(?:mut\s+)?self\b", p)]
    variadic = any("..." in p for p in own)
    optional = sum(bool(re.search(r"=(?!>)|^\w+\?\s*(:|$)", p)) for p in own) if extension in (".ts", ".tsx", ".js", ".jsx") else 0
    return Params(len(own) - optional, len(own), variadic)


def first_call(text: str, name: str, extension: str) -> tuple[int, int] | None:
    """(arguments, line from 0) of the first call of a name; keyword arguments and splats count one each."""
    if extension in (".py", ".pyi"):
        tree = _parse(text)
        if tree is not None:
            todo = [tree]
            while todo:
                n = todo.pop()
                if isinstance(n, ast.Call) and (n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None) == name:
                    return len(n.args) + len(n.keywords), n.lineno - 1
                todo += reversed(list(ast.iter_child_nodes(n)))
            return None
    body = text[text.find("{") + 1 :] if "{" in text else text
    m = re.search(rf"(?<![A-Za-z0-9_]){re.escape(name)}\(", body)
    if not m:
        return None
    offset = len(text) - len(body) + m.start()
    return len(parts(inner(body, m.end() - 1))), text.count("\n", 0, offset)
