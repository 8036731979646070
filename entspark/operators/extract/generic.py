"""Entities of code without a parser at hand: declarations by regular expression, extents by braces, ``end`` or indentation.

This is approximate by nature.  Every language is a row of data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

from .base import Entity, lines_of

_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|async|export|default|declare|override|virtual|sealed|partial|open|data|suspend|inline|unsafe|extern|const|pub(?:\([a-z]+\))?|implicit|lazy|case)\s+)*"
_ID = r"([A-Za-z_$][\w$]*)"


@dataclass(frozen=True)
class Language:
    """Patterns (type, regular expression with the name as last group) in order; ``block`` says how a definition ends."""

    name: str
    extensions: tuple[str, ...]
    rules: tuple[tuple[str, str], ...]
    block: str = "brace"
    containers: tuple[str, ...] = ("class", "interface", "impl", "trait", "module", "namespace", "struct", "object", "enum", "extension", "protocol")
    comment: str = "//"
    #: What may be defined within a function; variables aren't entities there, and calls with a block look like methods.
    local: tuple[str, ...] = ("class", "interface", "enum", "struct", "trait", "impl", "object", "function", "macro", "constant", "record")


_JS = (("class", rf"^\s*{_MOD}class\s+{_ID}"), ("function", rf"^\s*{_MOD}function\s*\*?\s*{_ID}"), ("variable", rf"^(?:export\s+)?(?:const|let|var)\s+{_ID}"), ("method", rf"^\s+(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract)\s+|\*)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(#?[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^={{;]+)?\{{"), ("field", rf"^\s+(?:(?:static|public|private|protected|readonly|declare|override)\s+)*(#?[A-Za-z_$][\w$]*)[?!]?\s*(?::[^=;(]+)?=(?!=|>)"))
_TS = (("interface", rf"^\s*{_MOD}interface\s+{_ID}"), ("type", rf"^\s*{_MOD}type\s+{_ID}\s*[=<]"), ("enum", rf"^\s*{_MOD}enum\s+{_ID}"), *_JS)
_JVM = (("class", rf"^\s*{_MOD}(?:class|record)\s+{_ID}"), ("interface", rf"^\s*{_MOD}@?interface\s+{_ID}"), ("enum", rf"^\s*{_MOD}enum\s+{_ID}"), ("method", rf"^\s+{_MOD}(?:<[^>]+>\s*)?(?:[\w<>\[\],.?]+\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|new\b){_ID}\s*\([^;]*\)\s*(?:throws [\w., ]+)?\{{"))
_C = (("struct", rf"^\s*(?:typedef\s+)?(?:struct|union)\s+{_ID}\s*\{{"), ("enum", rf"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?{_ID}"), ("function", rf"^(?!\s*(?:if|for|while|switch|return|else)\b)[\w:<>,*&~\s]+?[\s*&]((?:\w+::)*~?\w+)\s*\([^;]*\)\s*(?:const|noexcept|override|\s)*\{{"))

LANGUAGES = (
    Language("typescript", (".ts", ".mts", ".cts"), _TS), Language("tsx", (".tsx",), _TS), Language("javascript", tuple(".cjs .mjs .jsx .js".split()), _JS),
    Language("python", (".py", ".pyi"), (("class", rf"^\s*class\s+{_ID}"), ("function", rf"^\s*(?:async\s+)?def\s+{_ID}")), "indent", comment="#"),
    Language("go", (".go",), (("method", rf"^func\s+\([^)]*\)\s*{_ID}"), ("function", rf"^func\s+{_ID}"), ("struct", rf"^type\s+{_ID}\s+struct"), ("interface", rf"^type\s+{_ID}\s+interface"), ("type", rf"^type\s+{_ID}"), ("variable", rf"^(?:var|const)\s+{_ID}"))),
    Language("rust", (".rs",), (("function", rf"^\s*{_MOD}fn\s+{_ID}"), ("struct", rf"^\s*{_MOD}struct\s+{_ID}"), ("enum", rf"^\s*{_MOD}enum\s+{_ID}"), ("impl", r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+((?:[\w:<>, ]+ for )?[\w:]+)"), ("trait", rf"^\s*{_MOD}trait\s+{_ID}"), ("module", rf"^\s*{_MOD}mod\s+{_ID}"), ("type", rf"^\s*{_MOD}type\s+{_ID}"), ("constant", rf"^\s*{_MOD}(?:static|const)\s+(?:mut\s+)?{_ID}\s*:"), ("macro", rf"^\s*macro_rules!\s*{_ID}"))),
    Language("java", (".java",), _JVM), Language("c", (".c", ".h"), _C, local=("struct", "enum")),
    Language("cpp", tuple(".hh .hpp .cxx .cc .cpp".split()), (("class", rf"^\s*(?:template\s*<[^>]*>\s*)?class\s+{_ID}[^;]*$"), ("namespace", rf"^\s*namespace\s+{_ID}"), *_C), local=("class", "struct", "enum")),
    Language("ruby", (".rb", ".rake"), (("class", r"^\s*class\s+([A-Z][\w:]*)"), ("module", r"^\s*module\s+([A-Z][\w:]*)"), ("method", r"^\s*def\s+(?:self\.)?([\w?!=]+)")), "end", comment="#"),
    Language("csharp", (".cs",), (("namespace", r"^\s*namespace\s+([\w.]+)"), ("struct", rf"^\s*{_MOD}struct\s+{_ID}"), *_JVM)),
    Language("php", (".php",), (("class", rf"^\s*{_MOD}class\s+{_ID}"), ("interface", rf"^\s*interface\s+{_ID}"), ("trait", rf"^\s*trait\s+{_ID}"), ("function", rf"^\s*{_MOD}function\s+&?{_ID}"))),
    Language("fortran", tuple(".f .f03 .f95 .f90".split()), (("module", rf"^\s*module\s+(?!procedure){_ID}"), ("program", rf"^\s*program\s+{_ID}"), ("subroutine", rf"^\s*(?:\w+\s+)*?subroutine\s+{_ID}"), ("function", rf"^\s*(?!end)(?:[\w()*=]+\s+)*?function\s+{_ID}"), ("type", rf"^\s*type\s*(?:,[^:]*)?(?:::)?\s*{_ID}\s*$")), "end", comment="!"),
    Language("swift", (".swift",), (("class", rf"^\s*{_MOD}(?:class|actor)\s+{_ID}"), ("struct", rf"^\s*{_MOD}struct\s+{_ID}"), ("enum", rf"^\s*{_MOD}enum\s+{_ID}"), ("protocol", rf"^\s*{_MOD}protocol\s+{_ID}"), ("extension", rf"^\s*{_MOD}extension\s+{_ID}"), ("function", rf"^\s*{_MOD}func\s+{_ID}"), ("method", r"^\s*(?:\w+\s+)*(init|deinit)\b[^;]*\{"))),
    Language("elixir", (".ex", ".exs"), (("module", r"^\s*defmodule\s+([\w.]+)"), ("protocol", r"^\s*defprotocol\s+([\w.]+)"), ("impl", r"^\s*defimpl\s+([\w.]+)"), ("macro", r"^\s*defmacrop?\s+(\w+[?!]?)"), ("guard", r"^\s*defguardp?\s+(\w+[?!]?)"), ("struct", r"^\s*def(struct)\b"), ("exception", r"^\s*def(exception)\b"), ("function", r"^\s*defp?\s+(\w+[?!]?)")), "end", comment="#"),
    Language("bash", (".sh", ".bash", ".zsh"), (("function", r"^\s*(?:function\s+)?([\w-]+)\s*\(\)\s*\{?"), ("function", r"^\s*function\s+([\w-]+)")), comment="#"),
    Language("hcl", (".tf", ".hcl", ".tfvars"), (("block", r'^(\w+(?:\s+"[^"]+")*)\s*\{'), ("attribute", r"^(\w+)\s*=")), containers=(), comment="#"),
    Language("kotlin", (".kt", ".kts"), (("class", rf"^\s*{_MOD}(?:enum\s+|annotation\s+)?class\s+{_ID}"), ("interface", rf"^\s*{_MOD}interface\s+{_ID}"), ("object", rf"^\s*{_MOD}(?:companion\s+)?object\s+{_ID}"), ("function", rf"^\s*{_MOD}fun\s+(?:<[^>]*>\s*)?(?:[\w.<>]+\.)?{_ID}"), ("variable", rf"^{_MOD}va[lr]\s+{_ID}"))),
    Language("xml", (".xml", ".svg", ".xhtml", ".plist", ".csproj"), (("element", r"^\s*<([A-Za-z_][\w:.-]*)"),), "tag"),
    Language("dart", (".dart",), (("class", rf"^\s*{_MOD}(?:class|mixin)\s+{_ID}"), ("enum", rf"^\s*enum\s+{_ID}"), ("extension", rf"^\s*extension\s+{_ID}"), ("function", rf"^\s*(?!if\b|for\b|while\b|switch\b|return\b)(?:[\w<>?,]+\s+){_ID}\s*\([^;]*\)\s*(?:async\s*)?\{{")), local=("class", "enum")),
    Language("perl", (".pl", ".pm"), (("package", r"^\s*package\s+([\w:]+)"), ("function", r"^\s*sub\s+(\w+)")), comment="#"),
    Language("ocaml", (".ml",), (("module", r"^\s*module\s+(\w+)"), ("type", r"^\s*type\s+(?:'\w+\s+)?(\w+)"), ("value", r"^let\s+(?:rec\s+)?(\w+)"), ("exception", r"^\s*exception\s+(\w+)")), "indent", comment="(*"),
    Language("ocaml_interface", (".mli",), (("module", r"^\s*module\s+(\w+)"), ("type", r"^\s*type\s+(?:'\w+\s+)?(\w+)"), ("value", r"^\s*val\s+(\w+)")), "indent", comment="(*"),
    Language("scala", (".scala", ".sc"), (("class", rf"^\s*{_MOD}class\s+{_ID}"), ("object", rf"^\s*{_MOD}object\s+{_ID}"), ("trait", rf"^\s*{_MOD}trait\s+{_ID}"), ("function", rf"^\s*{_MOD}def\s+{_ID}"), ("value", rf"^{_MOD}va[lr]\s+{_ID}"))),
    Language("zig", (".zig",), (("function", rf"^\s*{_MOD}fn\s+{_ID}"), ("struct", rf"^\s*{_MOD}const\s+{_ID}\s*=\s*(?:packed |extern )?struct"), ("enum", rf"^\s*{_MOD}const\s+{_ID}\s*=\s*enum"), ("test", r'^\s*test\s+("[^"]+")'), ("variable", rf"^\s*{_MOD}(?:const|var)\s+{_ID}"))),
    Language("nix", (".nix",), (("attribute", r"^\s*([\w.'-]+)\s*=(?!=)"),), "indent", comment="#"),
)

BY_EXTENSION = {e: lang for lang in LANGUAGES for e in lang.extensions}


@cache
def _compiled(name: str) -> tuple[tuple[str, re.Pattern], ...]:
    lang = next(x for x in LANGUAGES if x.name == name)
    return tuple((kind, re.compile(p, re.I if name == "fortran" else 0)) for kind, p in lang.rules)


_TYPE_ALONE = re.compile(r"(?!\s*(?:return|else|do|case|goto)\b)[A-Za-z_][\w\s*:<>,&]*[\w*&>]\s*")


def bare(text: str, comment: str) -> str:
    """The text with strings and comments blanked, of equal length."""
    line = {"#": r"#[^\n]*", "!": r"![^\n]*", "(*": r"\(\*[\s\S]*?\*\)"}.get(comment, r"//[^\n]*|/\*[\s\S]*?(?:\*/|$)")
    pattern = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|" + line)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _brace_end(clean: list[str], k: int, patterns: tuple[tuple[str, re.Pattern], ...] = ()) -> int:
    """The line of the brace that closes the definition of line ``k``; its own line where no block follows.

    Any number of lines may stand between the two, but for another definition.
    """
    depth, opened, rounds = 0, False, 0
    for j in range(k, len(clean)):
        if j > k and not opened and rounds <= 0 and any(p.search(clean[j]) for _, p in patterns):
            return k
        for c in clean[j]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth <= 0:
                    return j
            elif c == ";" and not opened and not depth:
                return j
            elif c in "()":
                rounds += 1 if c == "(" else -1
    return len(clean) - 1 if opened else k


_OPENS = re.compile(r"^\s*(?:class|module|def|if|unless|case|while|until|for|begin|defmodule|defp?|defmacrop?|defimpl|defprotocol|program|subroutine|type|interface)\b|\bdo\s*(?:\|[^|]*\|)?\s*$|\b(?:function)\s+\w+\s*\(", re.I)


def _end_end(clean: list[str], k: int) -> int:
    indent = len(clean[k]) - len(clean[k].lstrip())
    for j in range(k + 1, len(clean)):
        s = clean[j]
        if s.strip() and len(s) - len(s.lstrip()) <= indent:
            return j if re.match(r"\s*end\b", s, re.I) else j - 1 if j - 1 > k else k
    return len(clean) - 1


def _indent_end(clean: list[str], k: int) -> int:
    indent, last = len(clean[k]) - len(clean[k].lstrip()), k
    for j in range(k + 1, len(clean)):
        s = clean[j]
        if s.strip():
            if len(s) - len(s.lstrip()) <= indent and not s.lstrip().startswith((")", "]", "}")):
                break
            last = j
    return last


def _tag_end(lines: list[str], k: int, name: str) -> int:
    depth = 0
    for j in range(k, len(lines)):
        for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s>/])[^>]*?(/?)>|<{re.escape(name)}$", lines[j]):
            depth += 0 if m[2] else -1 if m[1] else 1
        if depth <= 0 and j >= k and ">" in lines[j]:
            return j
    return k


def _signature(clean: list[str], k: int, lang: Language) -> str:
    """Line ``k`` with the lines after it up to the brace that opens its block, where it begins such a signature."""
    line = clean[k]
    if not line.strip() or any(c in line for c in ";{}"):
        return ""
    rounds, parts = line.count("(") - line.count(")"), [line]
    alone = lang.name in ("c", "cpp") and "(" not in line and bool(_TYPE_ALONE.fullmatch(line))
    for j in range(k + 1, len(clean)):
        s = clean[j]
        if not (rounds > 0 or alone or not s.strip() or s.lstrip().startswith("{")):
            return ""
        parts.append(s)
        rounds += s.count("(") - s.count(")")
        if rounds <= 0 and (";" in s or "}" in s.partition("{")[0]):
            return ""
        if "{" in s:
            return " ".join(parts)
        alone = False
    return ""


def scan(text: str, path: str, lang: Language) -> list[Entity]:
    lines = lines_of(text)
    clean = lines_of(bare(text, lang.comment)) if lang.block != "tag" else lines
    clean += [""] * (len(lines) - len(clean))
    out: list[Entity] = []
    open_: list[tuple[int, str, str]] = []  # last line, id, type
    last_brace = max((k for k, line in enumerate(clean) if "{" in line), default=-1)
    for k, line in enumerate(clean):
        while open_ and open_[-1][0] < k:
            open_.pop()
        local = bool(open_) and open_[-1][2] not in lang.containers and lang.block != "tag"
        whole = _signature(clean, k, lang) if lang.block == "brace" and k <= last_brace else ""
        for kind, pattern in _compiled(lang.name):
            m = pattern.search(lines[k] if lang.name in ("hcl", "zig", "xml") else line)
            if not m and whole:
                m = pattern.search(whole)
            if not m:
                continue
            if local and kind not in lang.local:
                break
            if kind == "field" and (not open_ or open_[-1][2] != "class"):
                continue
            if lang.block == "tag":
                end = _tag_end(lines, k, m[1])
            else:
                end = (_brace_end(clean, k, _compiled(lang.name)) if k <= last_brace else k) if lang.block == "brace" else {"end": _end_end, "indent": _indent_end}[lang.block](clean, k)
            start = k
            while start and re.match(r"\s*(@\w|#\[|\[\w)", lines[start - 1]):
                start -= 1
            parent = open_[-1][1] if open_ else None
            if lang.name == "go" and kind == "method":  # of the type that receives it
                of = re.match(r"\s*func\s+\(\s*(?:\w+\s+)?\*?\s*(\w+)", line)
                parent = next((e.id(path) for e in out if of and e.entity_type == "struct" and e.name == of[1]), parent)
            name = re.sub(r'\s*"([^"]+)"', r".\1", m[m.lastindex]) if lang.name == "hcl" else m[m.lastindex].strip()
            if kind == "function" and parent and open_[-1][2] in ("class", "impl", "trait", "interface", "object", "extension", "struct", "protocol"):
                kind = "method"
            content = "\n".join(lines[start : end + 1])
            structure = " ".join(re.sub(rf"(?<![\w$]){re.escape(name)}(?![\w$])", "", bare(content, lang.comment), count=1).split())
            e = Entity(kind, name, content, start + 1, end + 1, parent, structure)
            out.append(e)
            if end > k:
                open_.append((end, e.id(path), kind))
            break
    return out


def code(text: str, path: str, extension: str) -> list[Entity]:
    lang = BY_EXTENSION.get("." + extension.lstrip("."))
    return scan(text, path, lang) if lang else []


def by_indent(text: str, path: str, extension: str) -> list[Entity]:
    return code(text, path, extension)
