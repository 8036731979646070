"""Entities of Python code, from its syntax tree."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from .base import Entity, lines_of


def shape(node: ast.AST) -> str:
    """The tree without places, comments and the definition's own name."""
    named = isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)
    name = node.name if named else None
    if named:
        node.name = ""
    try:
        return ast.dump(node, annotate_fields=False)
    finally:
        if named:
            node.name = name


_BLOCKS = (ast.If, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.For, ast.AsyncFor, ast.While, ast.Match, ast.ExceptHandler, ast.match_case)


def _statements(block: ast.AST) -> Iterator[ast.AST]:
    for name in ("body", "handlers", "orelse", "finalbody", "cases"):
        yield from getattr(block, name, [])


def python(text: str, path: str) -> list[Entity]:
    """Functions, classes and methods, also decorated and nested in classes, functions and any blocks of them.

    A file with a syntax error is read by indentation instead of being lost.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        from .generic import by_indent

        return by_indent(text, path, "py")
    lines = lines_of(text)
    out: list[Entity] = []
    todo: list[tuple[ast.AST, str | None, bool]] = [(n, None, False) for n in reversed(tree.body)]
    while todo:
        node, parent, in_class = todo.pop()
        if isinstance(node, _BLOCKS):
            todo += [(n, parent, in_class) for n in reversed(list(_statements(node)))]
            continue
        if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            continue
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        is_class = isinstance(node, ast.ClassDef)
        e = Entity("class" if is_class else "method" if in_class else "function", node.name, "\n".join(lines[start - 1 : node.end_lineno]), start, node.end_lineno, parent, shape(node))
        out.append(e)
        todo += [(n, e.id(path), is_class) for n in reversed(node.body)]
    return out
