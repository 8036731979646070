import pytest

from entspark.model import FILE_CHANGE
from entspark.operators import diff as D
from entspark.operators import match as M
from entspark.operators.reorder import longest_increasing


def changes(spark, path, before, after, old=None):
    status = "added" if before is None else "deleted" if after is None else "renamed" if old else "modified"
    found = D.diff_files(spark.createDataFrame([(path, status, old, before, after)], FILE_CHANGE))
    return {(r.entity_name, r.change_type) for r in found.filter("entity_type <> 'orphan'").collect()}


@pytest.mark.parametrize(
    ("before", "after", "want"),
    [
        ('{\n"a": 1\n}', '{\n"a": 2\n}', {("a", "modified")}),
        ('{\n"a": 1\n}', '{\n"a": 1,\n"b": 2\n}', {("a", "modified"), ("b", "added")}),
        ('{\n"a": 11\n}', '{\n"b": 11\n}', {("b", "renamed")}),
        ('{\n"o": {\n"x": 1\n}\n}', '{\n"o": {\n"x": 2\n}\n}', {("x", "modified")}),
        ("{\n}", '{\n"o": {\n"x": 1\n}\n}', {("x", "added")}),
        ('{\n"o": 1\n}', '{\n"o": [1]\n}', {("o", "modified")}),
        ('{\n"o": {\n"x": 1\n}\n}', '{\n"p": {\n"x": 1\n}\n}', {("p", "renamed")}),
        ('{\n"a": 1\n}', '{\n"a": 1\n}', set()),
    ],
)
def test_json_outcomes(spark, before, after, want):
    assert changes(spark, "f.json", before, after) == want


def test_python_rename_move_and_reorder(spark):
    before = "def a():\n    return one(1)\n\n\ndef b():\n    return two(2)\n\n\ndef c():\n    return three(3)\n"
    after = "def c():\n    return three(3)\n\n\ndef a():\n    return one(1)\n\n\ndef bb():\n    return two(2)\n"
    assert changes(spark, "m.py", before, after) == {("bb", "renamed"), ("a", "reordered")}
    assert changes(spark, "n.py", before, before, "m.py") == {("a", "moved"), ("b", "moved"), ("c", "moved")}
    assert changes(spark, "m.py", None, before) == {(n, "added") for n in "abc"}
    assert changes(spark, "m.py", before, None) == {(n, "deleted") for n in "abc"}


def test_cosmetic_and_orphans(spark):
    found = D.diff_files(spark.createDataFrame([("m.py", "modified", None, "import os\n\ndef a():\n    return 1\n", "import re\n\ndef a():\n    return 1  # note\n")], FILE_CHANGE)).collect()
    got = {(r.entity_name, r.change_type, r.structural_change) for r in found}
    assert got == {("a", "modified", False), ("module-level", "modified", True)}


def test_fuzzy_match_takes_the_most_similar(spark):
    words = [f"w{k}" for k in range(20)]
    row = lambda i, w, o: ("s", i, "f", "t", i, None, " ".join(w), i, None, 1, 1, o)
    names = "scope string, id string, file_path string, entity_type string, name string, parent_id string, content string, content_hash string, structural_hash string, start_line int, end_line int, ordinal int"
    before = spark.createDataFrame([row("b1", words[:18] + ["x", "y"], 0), row("b2", words[:19] + ["x"], 1)], names)
    after = spark.createDataFrame([row("a1", words, 0), row("a2", words[:18] + ["p", "q"], 1)], names)
    assert {(r.entity_id, r.old_entity_name, r.change_type) for r in M.match_entities(before, after).collect()} == {("a1", "b2", "renamed"), ("a2", "b1", "renamed")}
    swapped = {r.change_type for r in M.match_entities(before, after, None).collect()}
    assert swapped == {"added", "deleted"}


def test_longest_increasing():
    assert longest_increasing([]) == set()
    for seq in ([3, 1, 2], [1, 1, 1], [5, 4, 3], [1, 3, 2, 4, 0, 5]):
        keep = sorted(longest_increasing(seq))
        values = [seq[k] for k in keep]
        assert values == sorted(set(values))
    assert len(longest_increasing([1, 3, 2, 4, 0, 5])) == 4


def test_parent_names(spark):
    before = "class A:\n    class B:\n        def m(self):\n            return 1\n"
    found = D.diff_files(spark.createDataFrame([("m.py", "modified", None, before, before.replace("1", "2"))], FILE_CHANGE)).collect()
    assert {(r.entity_name, r.parent_name) for r in found if r.entity_name == "m"} == {("m", "A::B")}


def test_summary(spark):
    rows = [("a.json", "modified", None, '{\n"a": 1\n}', '{\n"a": 2\n}'), ("b.py", "added", None, None, "def f():\n    pass\n")]
    s = D.summary(D.diff_files(spark.createDataFrame(rows, FILE_CHANGE))).first()
    assert (s.file_count, s.added, s.modified, s.total) == (2, 1, 1, 2 + s.orphan)
