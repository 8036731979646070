"""Schemas of the tables that operators exchange."""

from __future__ import annotations

ENTITY = (
    "id string, file_path string, entity_type string, name string, parent_id string, content string, content_hash string, "
    "structural_hash string, start_line int, end_line int, ordinal int, metadata map<string,string>"
)
FILE_CHANGE = "file_path string, status string, old_file_path string, before_content string, after_content string"
CHANGE = (
    "id string, entity_id string, change_type string, entity_type string, entity_name string, entity_line int, parent_name string, file_path string, "
    "old_entity_name string, old_file_path string, old_parent_id string, before_content string, after_content string, structural_change boolean"
)
EDGE = "src string, dst string, ref_type string"
COMMIT = "sha string, short_sha string, author string, ts timestamp, message string"
LINE_BLAME = "file_path string, line int, sha string, author string, ts timestamp, summary string"

#: Order of change kinds wherever one has to be fixed.
CHANGE_TYPES = ("added", "modified", "deleted", "moved", "renamed", "reordered")
CONTAINER_TYPES = (
    "class", "export", "extension", "impl", "interface", "mixin", "module", "namespace", "object", "package",
    "svelte_instance_script", "svelte_module_script", "trait",
)
#: The graph builder and the scope resolver know different class-like types.
GRAPH_CLASS_TYPES = ("class", "class_type", "interface", "struct")
SCOPE_CLASS_TYPES = ("class", "impl", "interface", "struct")
CALLABLE_TYPES = ("arrow_function", "function", "method")
