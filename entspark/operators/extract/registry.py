"""Which extractor reads a file."""

from __future__ import annotations

import re
from collections.abc import Callable

from . import generic, markup, python_code, structured
from .base import Entity, lines_of

Extractor = Callable[[str, str], list[Entity]]

#: Words of a shebang or a modeline, the first that is met decides, and the extension they stand for.
_SPOKEN = (
    "perl=pl python=py ruby=rb bash=sh shell=sh /sh=sh node=js javascript=js typescript=ts tsx=tsx swift=swift elixir=ex rust=rs go=go kotlin=kt dart=dart php=php java=java "
    "cpp=cpp c++=cpp csharp=cs c#=cs fortran=f90 terraform=tf hcl=hcl ocaml=ml scala=scala zig=zig xml=xml json=json yaml=yaml yml=yaml toml=toml markdown=md csv=csv eruby=erb erb=erb vue=vue svelte=svelte c=c cs=cs"
).split()
SPOKEN = {k: "." + v for k, v in (s.rsplit("=", 1) for s in _SPOKEN)}

_MARKS = tuple(
    (re.compile(p), e)
    for p, e in (
        (r"^<\?(php|PHP)\b|^<\?=$", ".php"), (r"^(use strict|use warnings);$|^my [$@%]", ".pl"), (r"^package [^.;]+$", ".go"), (r"^package \S*\..*;$", ".java"), (r"^package \S*\.[^;]*$", ".kt"),
        (r"^use (std|crate)::.*;$", ".rs"), (r"^defmodule ", ".ex"), (r"^using System.*;$|^namespace .*\{$", ".cs"), (r"^import (Foundation|UIKit|SwiftUI|Combine)$", ".swift"), (r"^import ['\"]dart:", ".dart"),
        (r"^(object|trait) ", ".scala"), (r"@import\(", ".zig"), (r'^(resource|variable|provider) "|^terraform \{', ".tf"), (r"(?i)^program \w|^implicit none$", ".f90"), (r"^require(_relative)? ?['\"]", ".rb"),
    )
)
_CPP = re.compile(r"^\s*(using namespace|class |#include <(iostream|vector|string|memory))", re.M)


def detect(text: str) -> str | None:
    """The extension that a text without a telling name should have."""
    lines = lines_of(text)
    if not lines:
        return None
    if lines[0].startswith("#!"):
        low = lines[0].lower()
        for word, e in SPOKEN.items():
            if word in low:
                return e
    for s in (*lines[:5], *lines[-5:]):
        if (m := re.search(r"\bvim?:.*?\b(?:ft|filetype|syntax)=([\w+#]+)", s)) and m[1].lower() in SPOKEN:
            return SPOKEN[m[1].lower()]
    if re.match(r"<\?xml|<!(DOCTYPE|doctype)", lines[0].strip()):
        return ".xml"
    for raw in lines[:20]:
        s = raw.strip()
        if re.match(r"#include[ \t]", s):
            return ".cpp" if _CPP.search("\n".join(lines[:30])) else ".c"
        if re.match(r"(def|class) .*:$", s) and raw[:1] == s[:1]:
            return ".py"
        for pattern, e in _MARKS:
            if pattern.search(s):
                return e
    return None


def suffixes(path: str) -> list[str]:
    parts = path.rsplit("/", 1)[-1].lower().split(".")
    return ["." + ".".join(parts[k:]) for k in range(1, len(parts))]


def custom_mappings(config: str = "", gitattributes: str = "") -> dict[str, str]:
    """``.ext = language`` lines, and ``*.ext diff=language`` or ``linguist-language=`` attributes; the former win."""
    out = {}
    for m in re.finditer(r"^\s*\*(\.[\w.]+)\s.*?(?:diff|linguist-language)=([\w+#]+)", gitattributes, re.M):
        out[m[1].lower()] = m[2].lower()
    for m in re.finditer(r"^\s*(\.[\w.]+)\s*=\s*[\"']?([\w+#.]+)[\"']?\s*$", config, re.M):
        out[m[1].lower()] = m[2].lower().lstrip(".")
    return {e: SPOKEN.get(lang, "." + lang) for e, lang in out.items()}


class Registry:
    """Extractors by extension, the longest first; then by content; then chunks."""

    def __init__(self, mappings: dict[str, str] | None = None):
        self.by_extension: dict[str, Extractor] = {}
        self.mappings = dict(mappings or {})
        self.register((".json",), structured.json_keys)
        for lang in generic.LANGUAGES:
            self.register(lang.extensions, lambda t, p, x=lang.extensions[0]: generic.code(t, p, x))
        self.register((".py", ".pyi"), python_code.python)
        self.register((".svelte", *(f".svelte{t}.{s}" for t in ("", ".test", ".spec") for s in ("js", "ts"))), markup.svelte)
        self.register((".vue",), markup.vue)
        self.register((".yaml", ".yml"), structured.yaml_keys)
        self.register((".toml",), structured.toml_sections)
        self.register((".csv", ".tsv"), structured.csv_rows)
        self.register((".md", ".mdx", ".markdown"), structured.markdown)
        self.register((".erb",), markup.erb)

    def register(self, extensions: tuple[str, ...], extractor: Extractor) -> None:
        self.by_extension.update(dict.fromkeys(extensions, extractor))

    def lookup(self, path: str, hint: str = "") -> Extractor:
        for e in suffixes(path):
            e = self.mappings.get(e, e)
            if e in self.by_extension:
                return self.by_extension[e]
        found = detect(hint) if hint else None
        return self.by_extension.get(found, structured.chunks)

    def extract(self, text: str, path: str, plugin_path: str | None = None, hint: str | None = None) -> list[Entity]:
        """The entities of a text; what an extractor can't read has none."""
        try:
            return self.lookup(plugin_path or path, hint if hint is not None else text)(text, path)
        except Exception:  # noqa: BLE001  one file's fault mustn't end the others' task
            return []
