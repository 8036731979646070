import pytest

from entspark.operators.extract import Registry, custom_mappings, detect
from entspark.operators.extract import generic, structured

R = Registry()


def names(path, text):
    return [(e.entity_type, e.name, e.start_line, e.end_line) for e in R.extract(text, path)]


def test_json_pointers_and_lines():
    text = '{\n  "name": "x",\n  "run": {\n    "a/b": "t~",\n    "list": [1,\n      {"no": 1}]\n  },\n\n  "v": 1\n}\n'
    es = R.extract(text, "p.json")
    assert [(e.entity_type, e.name, e.start_line, e.end_line) for e in es] == [("property", "name", 2, 2), ("object", "run", 3, 7), ("property", "a/b", 4, 4), ("array", "list", 5, 6), ("property", "v", 9, 9)]
    assert es[2].id("p.json") == "p.json::/run/a~1b" and es[2].parent_id == "p.json::/run"
    assert es[0].structure == '"x"'


@pytest.mark.parametrize("text", ["[1]", "", "{", '{"a', '{"a":', '{"a": {"b": [}', "{}}", '{"a" 1}', "x"])
def test_malformed_json_never_fails(text):
    R.extract(text, "p.json")


def test_markdown_parents():
    es = R.extract("intro\n# A\nt\n## B\n### C\n## D\n# E\n", "d.md")
    assert [(e.name, e.parent_id and e.parent_id.split("::")[-1]) for e in es] == [("(preamble)", None), ("A", None), ("B", "A"), ("C", "B"), ("D", "A"), ("E", None)]


def test_yaml_toml_csv_chunks():
    assert names("a.yaml", "# c\n\nk: 1\ns:\n  a: 2\n\nz: [1]\n") == [("chunk", "(preamble)", 1, 1), ("property", "k", 3, 3), ("section", "s", 4, 5), ("section", "z", 7, 7)]
    assert names("a.yml", "# only\n") == [("chunk", "(document)", 1, 1)]
    a, b = R.extract("[p]\ny = 2 # c\n", "a.toml")[0], R.extract("[p]\n# more\ny = 2\n", "a.toml")[0]
    assert a.hashed == b.hashed and a.content != b.content
    assert R.extract("not = = toml", "a.toml") == []
    assert structured.csv_cells('1, "a, ""b""" ,', ",") == ["1", 'a, "b"', ""]
    assert names("a.csv", "id,n\n\n1,x\n,y\n") == [("row", "row[1]", 2, 2), ("row", "row_2", 3, 3)]
    assert R.extract("id\tn\n1\tx\n", "a.tsv")[0].metadata == {"id": "1", "n": "x"}
    assert names("LICENSE", "x\n" * 21) == [("chunk", "lines 1-20", 1, 20), ("chunk", "lines 21-21", 21, 21)]


def test_python_names_and_shapes():
    es = {e.name: e for e in R.extract("@d\ndef f(x):\n    # c\n    return g(x)\n\n\n@d\nclass A:\n    def m(self):\n        pass\n", "a.py")}
    assert es["f"].start_line == 1 and es["m"].entity_type == "method" and es["m"].parent_id == "a.py::class::A"
    other = R.extract("def renamed(x):\n    return g( x )\n", "a.py")[0]
    plain = R.extract("def f(x):\n    return g(x)\n", "a.py")[0]
    assert other.structure == plain.structure
    assert [e.name for e in R.extract("def f(:\n  pass\ndef g():\n  pass\n", "a.py")] == ["f", "g"]


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a.ts", "export class K {\n  run(a: string): void {\n  }\n}\nexport function foo() {}\ninterface I { a: 1 }\n", ["K", "run", "foo", "I"]),
        ("a.go", "func (s *S) M() {\n}\nfunc F() {\n}\ntype S struct {\n}\n", ["M", "F", "S"]),
        ("a.rs", "impl Foo for Bar {\n  fn b(&self) {}\n}\npub struct S {\n}\nmacro_rules! m {\n}\n", ["Foo for Bar", "b", "S", "m"]),
        ("a.java", "public class A {\n  public int f(int a) {\n    if (a) {\n    }\n  }\n}\n", ["A", "f"]),
        ("a.rb", "module M\n  class A\n    def b?\n    end\n  end\nend\n", ["M", "A", "b?"]),
        ("a.c", "struct s {\n};\nint main(void) {\n  return 0;\n}\n", ["s", "main"]),
        ("a.sh", "deploy() {\n  x\n}\n", ["deploy"]),
        ("a.tf", 'resource "x" "y" {\n a = 1\n}\n', ["resource.x.y"]),
        ("a.ex", "defmodule A.B do\n  def f(x) do\n    x\n  end\nend\n", ["A.B", "f"]),
        ("a.kt", "class A {\n  fun b() {\n  }\n}\n", ["A", "b"]),
        ("a.swift", "struct S {\n  func f() {\n  }\n}\n", ["S", "f"]),
        ("a.xml", "<a>\n<b>t</b>\n</a>\n", ["a", "b"]),
        ("a.vue", "<script setup>\nfunction f() {\n}\n</script>\n", ["script setup", "f"]),
        ("a.erb", "<% if a %>\n<%= b %>\n<% end %>\n<%= b %>\n", ["a", "b", "if a", "b#2"]),
    ],
)
def test_other_languages(path, text, want):
    assert [e.name for e in R.extract(text, path)] == want


def test_all_language_rules_compile():
    assert len(generic.LANGUAGES) == 26
    for lang in generic.LANGUAGES:
        generic._compiled(lang.name)


@pytest.mark.parametrize(
    ("text", "want"),
    [("#!/usr/bin/env python3\n", ".py"), ("#!/bin/bash\n", ".sh"), ("x\n# vim: ft=ruby\n", ".rb"), ("<?php\n", ".php"), ("#include <vector>\n", ".cpp"), ("#include <a.h>\n", ".c"), ("package a.b;\n", ".java"), ("package main\n", ".go"), ("def f():\n", ".py"), ("hello\n", None), ("", None)],
)
def test_detection(text, want):
    assert detect(text) == want


def test_custom_mappings_and_compound_suffixes():
    m = custom_mappings(".inc = php\n", "*.inc diff=python\n*.q linguist-language=sql\n*.y diff=yaml\n")
    assert m[".inc"] == ".php" and m[".y"] == ".yaml"
    assert [e.name for e in Registry(m).extract("k: 1\n", "a.y")] == ["k"]
    assert [e.name for e in R.extract("function f() {\n}\n", "a.svelte.js")] == ["f"]


@pytest.mark.parametrize(
    ("path", "text", "inner"),
    [
        ("a.ts", "function outer() {\n    function inner() {\n        return 42;\n    }\n    const x = 1;\n    each(function () {\n    });\n    return inner();\n}\n", "a.ts::a.ts::function::outer::inner"),
        ("a.py", "def outer():\n    if x:\n        def inner():\n            return 42\n    return inner()\n", "a.py::a.py::function::outer::inner"),
        ("a.rs", "fn outer() {\n    fn inner() -> i32 {\n        42\n    }\n    inner();\n}\n", "a.rs::a.rs::function::outer::inner"),
        ("a.go", "type S struct {\n}\n\nfunc (s *S) M() {\n}\n", "a.go::a.go::struct::S::M"),
    ],
)
def test_nested_definitions(path, text, inner):
    es = R.extract(text, path)
    assert len(es) == 2 and es[1].id(path) == inner and es[1].parent_id == es[0].id(path)
    assert es[0].end_line >= es[1].end_line or path == "a.go"


def test_a_body_far_below_its_signature():
    far = "fn far(\n" + "".join(f"    a{k}: u8,\n" for k in range(40)) + ")\nwhere\n    T: Copy,\n{\n    x\n}\nfn next() {\n}\n"
    assert [(e.name, e.start_line, e.end_line) for e in R.extract(far, "a.rs")] == [("far", 1, 47), ("next", 48, 49)]
    assert [(e.name, e.start_line, e.end_line) for e in R.extract("class A {\n  fun one(): Int = 3\n  fun two() {\n  }\n}\n", "a.kt")] == [("A", 1, 5), ("one", 2, 2), ("two", 3, 4)]


def test_forms_of_c_and_typescript():
    assert [(e.name, e.start_line, e.end_line) for e in R.extract("static int\nmain(int a)\n{\n  return f(a);\n}\n", "a.c")] == [("main", 1, 5)]
    names_ = [e.name for e in R.extract("class K {\n  static top = 1;\n  #hidden = 2;\n  run = (a: string) => {\n    let b = 1;\n    b = 2;\n  };\n  #secret(): void {\n  }\n}\n", "a.ts")]
    assert names_ == ["K", "top", "#hidden", "run", "#secret"]


def test_a_fault_of_one_file_loses_no_other(spark):
    from entspark.operators.extract import extract_files

    def broken(text, path):
        raise AttributeError("no such thing")

    registry = Registry()
    registry.register((".odd",), broken)
    out = extract_files(spark.createDataFrame([("a.odd", "x"), ("b.py", "def f():\n    pass\n")], "path string, content string"), registry)
    assert [r.name for r in out.collect()] == ["f"]
