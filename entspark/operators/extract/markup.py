"""Extractors of templates and single-file components."""

from __future__ import annotations

import re
from dataclasses import replace

from .base import Entity, lines_of

_TAG = re.compile(r"<%(?![%#])([=\-]?)(.*?)[\-]?%>", re.S)
_OPENER = re.compile(r"^\s*(if|unless|case|while|until|for|begin)\b|\bdo\s*(\|[^|]*\|)?\s*$")
_MIDDLE = re.compile(r"^\s*(else|elsif|when|in|rescue|ensure)\b")


def _name(code: str) -> str:
    s = " ".join(code.split())
    return s if len(s) <= 60 else s[:57] + "..."


def erb(text: str, path: str) -> list[Entity]:
    """The template, its blocks (opener to ``end``) and its expressions."""
    lines = lines_of(text)
    if not lines:
        return []
    title = path.rsplit("/", 1)[-1].removesuffix(".erb")
    out = [Entity("template", title, text, 1, len(lines))]
    parent, seen, blocks = out[0].id(path), {}, []

    def unique(name: str) -> str:
        seen[name] = seen.get(name, 0) + 1
        return name if seen[name] == 1 else f"{name}#{seen[name]}"

    for m in _TAG.finditer(text):
        code = m[2].strip()
        a, b = text.count("\n", 0, m.start()) + 1, text.count("\n", 0, m.end()) + 1
        if code == "end" or code.startswith(("end ", "end.")):
            if blocks:
                name, start = blocks.pop()
                out.append(Entity("erb_block", unique(name), "\n".join(lines[start - 1 : b]), start, b, parent))
        elif _OPENER.search(code):
            blocks.append((_name(code), a))
        elif code and not _MIDDLE.match(code):
            out.append(Entity("erb_expression", unique(_name(code)), "\n".join(lines[a - 1 : b]), a, b, parent))
    return out


_BLOCK = re.compile(r"^<(template|script|style)\b([^>]*)>", re.M)


def _blocks(text: str):
    """(tag, attributes, start of the block, of its body, end of its body, end of the block) at top level."""
    at = 0
    while m := _BLOCK.search(text, at):
        depth, k = 1, m.end()
        for t in re.finditer(rf"<(/?){m[1]}\b[^>]*?(/?)>", text[m.end() :]):
            if not t[2]:
                depth += -1 if t[1] else 1
            k = m.end() + t.start()
            if not depth:
                yield m[1], m[2], m.start(), m.end(), k, m.end() + t.end()
                at = m.end() + t.end()
                break
        else:
            return


def _delegated(text: str, start: int, body: int, end: int, attributes: str, parent: str, path: str) -> list[Entity]:
    from .generic import code

    offset = text.count("\n", 0, body)
    out = []
    for e in code(text[body:end], path, "ts" if re.search(r"lang=.(ts|tsx)", attributes) else "js"):
        out.append(replace(e, start_line=e.start_line + offset, end_line=e.end_line + offset, parent_id=e.parent_id or parent))
    return out


def vue(text: str, path: str) -> list[Entity]:
    out, count = [], {}
    for tag, attributes, start, body, end, stop in _blocks(text):
        name = "script setup" if tag == "script" and re.search(r"\bsetup\b", attributes) else tag
        count[name] = count.get(name, 0) + 1
        if count[name] > 1:
            name = f"{name}:{count[name]}"
        a, b = text.count("\n", 0, start) + 1, text.count("\n", 0, stop) + 1
        block = Entity("sfc_block", name, text[start:stop], a, b)
        out.append(block)
        if tag == "script":
            out += _delegated(text, start, body, end, attributes, block.id(path), path)
    return out


_MARKUP = re.compile(r"\{#(if|each|await|key|snippet)\b([^}]*)\}|\{@(html|const|render|debug|attach)\b|<(svelte:[a-z]+|slot|[A-Z][A-Za-z.]*|[a-z][a-z0-9-]*)[\s>/]")


def svelte(text: str, path: str) -> list[Entity]:
    """The component: scripts, style, fragment, and its blocks and elements by line; rune modules are plain scripts (approximate)."""
    from .generic import code

    if re.search(r"\.svelte(\.test|\.spec)?\.(js|ts)$", path):
        return code(text, path, path.rsplit(".", 1)[-1])
    lines = lines_of(text)
    if not lines:
        return []
    name = path.rsplit("/", 1)[-1].removesuffix(".svelte")
    out = [Entity("svelte_component", name, text, 1, len(lines))]
    parent, masked = out[0].id(path), text
    for tag, attributes, start, body, end, stop in _blocks(text):
        if tag == "template":
            continue
        module = re.search(r"\bmodule\b", attributes)
        kind = "svelte_style" if tag == "style" else "svelte_module_script" if module else "svelte_instance_script"
        a, b = text.count("\n", 0, start) + 1, text.count("\n", 0, stop) + 1
        block = Entity(kind, tag if tag == "style" else "script module" if module else "script", text[start:stop], a, b, parent, metadata={"svelte.kind": kind})
        out.append(block)
        if tag == "script":
            out += _delegated(text, start, body, end, attributes, block.id(path), path)
        masked = masked[:start] + re.sub(r"[^\n]", " ", masked[start:stop]) + masked[stop:]
    if masked.strip():
        first = next(k for k, s in enumerate(lines_of(masked), 1) if s.strip())
        fragment = Entity("svelte_fragment", "fragment", masked.strip(), first, len(lines), parent)
        out.append(fragment)
        for m in _MARKUP.finditer(masked):
            line = masked.count("\n", 0, m.start()) + 1
            kind = f"svelte_{m[1]}_block" if m[1] else f"svelte_{m[3]}_tag" if m[3] else "svelte_component_use" if m[4][0].isupper() else "svelte_slot" if m[4] == "slot" else "svelte_special_element" if ":" in m[4] else "svelte_element"
            out.append(Entity(kind, f"{m[1] or m[3] or m[4]}@{line}", lines[line - 1].strip(), line, line, fragment.id(path)))
    return out
