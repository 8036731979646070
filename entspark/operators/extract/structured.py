"""Extractors of structured text: rows, headings, keys, chunks."""

from __future__ import annotations

import json
import re

from .base import Entity, last_filled, lines_of

CHUNK_LINES = 20


def chunks(text: str, path: str) -> list[Entity]:
    lines = lines_of(text)
    out = []
    for a in range(0, len(lines), CHUNK_LINES):
        own = lines[a : a + CHUNK_LINES]
        out.append(Entity("chunk", f"lines {a + 1}-{a + len(own)}", "\n".join(own), a + 1, a + len(own)))
    return out


def csv_cells(line: str, separator: str) -> list[str]:
    """Cells of one line, trimmed; quoted ones may hold the separator and doubled quotes, but no line end."""
    cells, now, quoted, k = [], [], False, 0
    while k < len(line):
        c = line[k]
        if c == '"' and quoted and line[k + 1 : k + 2] == '"':
            now.append('"')
            k += 1
        elif c == '"':
            quoted = not quoted
        elif c == separator and not quoted:
            cells.append("".join(now).strip())
            now = []
        else:
            now.append(c)
        k += 1
    return [*cells, "".join(now).strip()]


def csv_rows(text: str, path: str) -> list[Entity]:
    """A row is named by its first cell; lines are counted among those that aren't blank."""
    separator = "\t" if path.lower().endswith(".tsv") else ","
    lines = [s for s in lines_of(text) if s.strip()]
    if not lines:
        return []
    header = csv_cells(lines[0], separator)
    out = []
    for k, line in enumerate(lines[1:], 1):
        cells = csv_cells(line, separator)
        out.append(Entity("row", f"row[{cells[0]}]" if cells[0] else f"row_{k}", line, k + 1, k + 1, metadata=dict(zip(header, cells))))
    return out


_HEADING = re.compile(r"(?P<marks>[#]{1,6})\s+(?P<title>.+)")


def markdown(text: str, path: str) -> list[Entity]:
    out: list[tuple[int, str, int, list[str], str | None]] = []
    open_headings: list[tuple[int, str]] = []
    for k, line in enumerate(lines_of(text), 1):
        m = _HEADING.match(line)
        if m:
            level, name = len(m["marks"]), m["title"].strip()
            open_headings = [h for h in open_headings if h[0] < level]
            above = open_headings[-1][1] if open_headings else None
            out.append((level, name, k, [line], None if above is None else f"{path}::heading::{above}"))
            open_headings.append((level, name))
        elif out:
            out[-1][3].append(line)
        elif line.strip():
            out.append((0, "(preamble)", k, [line], None))
    found = []
    for level, name, start, own, parent in out:
        if content := "\n".join(own).strip():
            found.append(Entity("heading" if level else "preamble", name, content, start, start + len(own) - 1, parent))
    return found


def _json_keys(text: str, at: int) -> list[tuple[str, int, int, int, str]]:
    """Of the object that begins at ``at``: (key, key's place, value's place, value's end, kind). Never fails; stops at what it can't read."""
    out = []
    n, k, depth = len(text), at + 1, 1
    key: tuple[str, int] | None = None
    value = -1
    kind = "property"
    while k < n and depth:
        c = text[k]
        if c == '"':
            e = k + 1
            while e < n and text[e] != '"':
                e += 2 if text[e] == "\\" else 1
            if depth == 1 and key is None:
                key = (text[k + 1 : e], k)
            elif depth == 1 and value < 0 and key:
                value = k
            k = e
        elif c in "{[":
            if depth == 1 and key and value < 0:
                value, kind = k, "object" if c == "{" else "array"
            depth += 1
        elif c in "}]":
            depth -= 1
        elif c == ":" and depth == 1 and key and value < 0:
            pass
        elif depth == 1 and key and value < 0 and not c.isspace() and c != ",":
            value = k
        if key and ((c == "," and depth == 1) or depth == 0):
            out.append((*key, value if value >= 0 else k, k, kind))
            key, value, kind = None, -1, "property"
        k += 1
    if key:
        out.append((*key, value if value >= 0 else n, n, kind))
    return out


def json_keys(text: str, path: str) -> list[Entity]:
    """Keys of nested objects, parents before children, ids by JSON pointer; arrays aren't entered."""
    root = len(text) - len(text.lstrip())
    if text[root : root + 1] != "{":
        return []
    lines = lines_of(text)
    starts = [0]
    for s in text.split("\n"):
        starts.append(starts[-1] + len(s) + 1)
    from bisect import bisect_right

    line = lambda at: min(bisect_right(starts, at), len(lines))
    out: list[Entity] = []
    # (place of the object, pointer, id, last line that its entries may have)
    todo = [(root, "", None, None)]
    pending: list[tuple] = []
    while todo or pending:
        if todo:
            at, pointer, owner, _ = todo.pop()
            keys = _json_keys(text, at)
            if not keys:
                continue
            closing = line(_closing(text, at))
            for i, (key, place, value, end, kind) in reversed(list(enumerate(keys))):
                after = line(keys[i + 1][1]) if i + 1 < len(keys) else closing
                pending.append((key, place, value, end, kind, after, pointer, owner))
        key, place, value, end, kind, after, pointer, owner = pending.pop()
        own = f"{pointer}/{key.replace('~', '~0').replace('/', '~1')}"
        start = line(place)
        stop = last_filled(lines, start, max(start, after - 1), ("", ","))
        content = "\n".join(lines[start - 1 : stop])
        me = f"{path}::{own}"
        out.append(Entity(kind, key, content, start, stop, owner, text[value:end].strip().rstrip(",").strip(), own_id=me))
        if kind == "object":
            todo.append((value, own, me, None))
    return out


def _closing(text: str, at: int) -> int:
    depth, k = 0, at
    while k < len(text):
        c = text[k]
        if c == '"':
            k += 1
            while k < len(text) and text[k] != '"':
                k += 2 if text[k] == "\\" else 1
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return k
        k += 1
    return max(0, len(text) - 1)


def yaml_keys(text: str, path: str) -> list[Entity]:
    """Keys without indentation; what stands before the first is a preamble."""
    lines = lines_of(text)
    keys = []
    for k, s in enumerate(lines, 1):
        if s and s[0] not in " \t#" and not s.startswith(("---", "...")) and (name := s.partition(":")[0].strip()) and ":" in s:
            keys.append((name, k))
    if not keys:
        return [Entity("chunk", "(document)", text, 1, len(lines))] if text.strip() else []
    try:
        import yaml

        parsed = yaml.safe_load(text)
    except Exception:  # unreadable as YAML: all keys are properties
        parsed = None
    sections = {k for k, v in parsed.items() if isinstance(k, str) and isinstance(v, dict | list)} if isinstance(parsed, dict) else set()
    out = []
    if keys[0][1] > 1:
        end = last_filled(lines, 1, keys[0][1] - 1)
        if (content := "\n".join(lines[:end])).strip():
            out.append(Entity("chunk", "(preamble)", content, 1, end))
    for i, (name, start) in enumerate(keys):
        end = last_filled(lines, start, keys[i + 1][1] - 1 if i + 1 < len(keys) else len(lines))
        out.append(Entity("section" if name in sections else "property", name, "\n".join(lines[start - 1 : end]), start, end))
    return out


def toml_sections(text: str, path: str) -> list[Entity]:
    """Headers, and keys before the first of them; hashed by value, so comments don't count."""
    import tomllib

    try:
        parsed = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return []
    lines = lines_of(text)
    found: list[tuple[str, int]] = []
    in_section = False
    for k, raw in enumerate(lines, 1):
        s = raw.strip()
        if s.startswith("["):
            in_section = True
            if name := s.lstrip("[").rstrip("]").strip():
                found.append((name, k))
        elif s and not s.startswith("#") and not in_section and "=" in s and (name := s.partition("=")[0].strip()):
            found.append((name, k))
    out = []
    for i, (name, start) in enumerate(found):
        end = found[i + 1][1] - 1 if i + 1 < len(found) else len(lines)
        while end > start and (not lines[end - 1].strip() or lines[end - 1].strip().startswith("#")):
            end -= 1
        content = "\n".join(lines[start - 1 : end])
        value = parsed.get(name)
        hashed = content if name not in parsed else value if isinstance(value, str) else json.dumps(value, indent=2, default=str)
        out.append(Entity("section" if isinstance(value, dict) else "property", name, content, start, end, hashed=hashed))
    return out
