"""What an extractor gives back, and small helpers of theirs."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field


@dataclass
class Entity:
    entity_type: str
    name: str
    content: str
    start_line: int
    end_line: int
    parent_id: str | None = None
    #: What the structural hash is of; None for texts that have none.
    structure: str | None = None
    #: What the content hash is of, where that isn't the text.
    hashed: str | None = None
    #: An id that doesn't follow the usual pattern.
    own_id: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    def id(self, path: str) -> str:
        return self.own_id or "::".join((path, self.parent_id if self.parent_id is not None else self.entity_type, self.name))

    def row(self, scope: str, path: str, ordinal: int) -> tuple:
        digest = lambda s: None if s is None else hashlib.md5(s.encode("utf-8", "surrogatepass")).hexdigest()
        return (scope, self.id(path), path, self.entity_type, self.name, self.parent_id, self.content, digest(self.content if self.hashed is None else self.hashed), digest(self.structure), self.start_line, self.end_line, ordinal, self.metadata or None)


def lines_of(text: str) -> list[str]:
    """Lines without ends; no empty one after the last LF, no CR before it."""
    out = text.split("\n")
    if out and out[-1] == "":
        out.pop()
    return [s.removesuffix("\r") for s in out]


def last_filled(lines: list[str], start: int, end: int, blank=("",)) -> int:
    """The last line up to ``end`` (from 1, inclusive) that isn't blank, ``start`` at least."""
    while end > start and lines[end - 1].strip() in blank:
        end -= 1
    return end
