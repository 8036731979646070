"""Results as JSON, and as text for people.  JSON stays distributed; text is for a result that a screen can hold."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import diff as D

_LETTER = {"added": "A", "modified": "M", "deleted": "D", "renamed": "R", "moved": ">", "reordered": "~"}
_CAMEL = {
    "entity_id": "entityId", "change_type": "changeType", "entity_type": "entityType", "entity_name": "entityName", "entity_line": "startLine", "parent_name": "parentName", "file_path": "filePath", "old_entity_name": "oldEntityName",
    "old_file_path": "oldFilePath", "old_parent_id": "oldParentId", "before_content": "beforeContent", "after_content": "afterContent", "structural_change": "structuralChange",
}


def to_json_rows(frame: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """One JSON text a row, absent fields left out."""
    names = names or {}
    return frame.select(F.to_json(F.struct(*(F.col(c).alias(names.get(c, c)) for c in frame.columns))).alias("value"))


def ordered(changes: DataFrame) -> DataFrame:
    return changes.orderBy("file_path", "entity_line", "id")


def diff_json(changes: DataFrame) -> DataFrame:
    """One row: the summary and all changes in order."""
    one = F.struct(*(F.col(c).alias(n) for c, n in _CAMEL.items() if c in changes.columns))
    rows = changes.agg(F.transform(F.array_sort(F.collect_list(F.struct("file_path", "entity_line", "id", one.alias("c")))), lambda s: s["c"]).alias("changes"))
    s = D.summary(changes)
    total = F.struct(F.col("file_count").alias("fileCount"), *(c for c in s.columns if c != "file_count"))
    return s.select(total.alias("summary")).crossJoin(rows).select(F.to_json(F.struct("summary", "changes")).alias("value"))


def graph_json(entities: DataFrame, edges: DataFrame) -> DataFrame:
    e = entities.agg(F.sort_array(F.collect_list(F.struct("id", "name", "entity_type", "file_path", "start_line", "end_line"))).alias("entities"), F.count("*").alias("entityCount"))
    return e.crossJoin(edges.agg(F.sort_array(F.collect_list(F.struct("src", "dst", "ref_type"))).alias("edges"), F.count("*").alias("edgeCount"))).select(F.to_json(F.struct("*")).alias("value"))


def _tag(r) -> str:
    return " [cosmetic]" if r["structural_change"] is False and r["change_type"] == "modified" else ""


def plain(changes: DataFrame, orphans: bool = False) -> str:
    """A line a change under its file; what a person asks to see, so it is collected."""
    out, file = [], None
    for r in ordered(changes).collect():
        if r["entity_type"] == "orphan" and not orphans:
            continue
        if r["file_path"] != file:
            file = r["file_path"]
            out.append(file)
        old = f" (was {r['old_entity_name']})" if r["old_entity_name"] else f" (from {r['old_file_path']})" if r["old_file_path"] else ""
        letter = "O" if r["entity_type"] == "orphan" else _LETTER[r["change_type"]]
        out.append(f"  {letter} {r['entity_type']} {r['entity_name']}{old}{_tag(r)}")
    return "\n".join(out)


def line_diff(before: str | None, after: str | None, context: int = 2) -> str:
    lines = difflib.unified_diff((before or "").split("\n"), (after or "").split("\n"), lineterm="", n=context)
    return "\n".join(list(lines)[2:])


def word_diff(before: str, after: str) -> str:
    """Words taken out in ``[- -]``, words put in in ``{+ +}``."""
    a, b, out = before.split(), after.split(), []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "equal":
            out.append(" ".join(a[i:j]))
            continue
        out += ([f"[-{' '.join(a[i:j])}-]"] if j > i else []) + ([f"{{+{' '.join(b[k:m])}+}}"] if m > k else [])
    return " ".join(out)


def terminal(changes: DataFrame, verbose: bool = False) -> str:
    """``plain`` with what changed under each modified entity: words of one line, else up to three lines (all if verbose)."""
    out, file = [], None
    for r in ordered(changes).collect():
        if r["entity_type"] == "orphan" and not verbose:
            continue
        if r["file_path"] != file:
            file = r["file_path"]
            out += ["", file] if out else [file]
        out.append(f"  {_LETTER[r['change_type']]} {r['entity_type']} {r['entity_name']}{_tag(r)}")
        if r["change_type"] == "modified" and r["before_content"] is not None and r["after_content"] is not None:
            if "\n" not in r["before_content"] + r["after_content"]:
                out.append("      " + word_diff(r["before_content"], r["after_content"]))
            else:
                lines = [s for s in line_diff(r["before_content"], r["after_content"]).split("\n") if s[:1] in "+-"]
                out += ["      " + s for s in (lines if verbose else lines[:3])]
    return "\n".join(out)


def markdown(changes: DataFrame) -> str:
    rows = ordered(changes).collect()
    out = ["| | kind | entity | file |", "|-|-|-|-|"]
    out += [f"| {_LETTER[r['change_type']]} | {r['entity_type']} | `{r['entity_name']}`{_tag(r)} | {r['file_path']} |" for r in rows]
    for r in rows:
        if r["change_type"] == "modified":
            out += ["", f"**{r['entity_name']}**", "```diff", line_diff(r["before_content"], r["after_content"]), "```"]
    return "\n".join(out)


def table_text(frame: DataFrame, *columns: str) -> str:
    """Rows as aligned text, for impact, blame, log, entities, context and verification."""
    rows = [[("" if v is None else str(v)) for v in r] for r in frame.select(*columns).collect()]
    widths = [max(map(len, [c, *(r[k] for r in rows)])) for k, c in enumerate(columns)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in [list(columns), *rows])


def exists(frame: DataFrame) -> Column | bool:
    """Whether a verification found something: its exit code."""
    return not frame.isEmpty()
