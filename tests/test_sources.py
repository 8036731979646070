import json
import subprocess

import pytest

from entspark.plans import render
from entspark.plans.api import Project
from entspark.plans.minirepo import AFTER, BEFORE
from entspark.sources import changes, files, git


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    sh = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=n", "-c", "user.email=e@example.org", *a], check=True, capture_output=True)

    def put(texts):
        for p, t in texts.items():
            (root / p).parent.mkdir(parents=True, exist_ok=True)
            (root / p).write_text(t)

    sh("init", "-q", "-b", "main")
    put(BEFORE | {".gitignore": "ignored.py\n", "crlf.txt": "a\r\nb\n"})
    sh("add", "-A")
    sh("commit", "-qm", "first")
    put(AFTER)
    sh("commit", "-qam", "second")
    put({"shop/shop.py": AFTER["shop/shop.py"].replace("shelf.add(name)", "shelf.add(name, 1)"), "ignored.py": "x", "node_modules/m.js": "function x() {}"})
    return str(root)


def test_walk(spark, repo):
    found = files.read_files(spark, repo)
    assert {r.path for r in found.collect()} == {"crlf.txt", "ignored.py", *BEFORE}
    assert found.filter("path = 'crlf.txt'").first().content == "a\nb\n"
    assert {r.path for r in files.git_tracked(spark, found, repo).collect()} == {"crlf.txt", *BEFORE}
    assert {r.path for r in files.read_files(spark, repo, ["py"], "shop").collect()} == set(BEFORE)


def test_scopes(spark, repo):
    assert [r[0] for r in git.changed_files(repo)] == ["shop/shop.py"]
    assert git.changed_files(repo, git.Scope("staged")) == []
    assert sorted(r[0] for r in git.changed_files(repo, git.Scope("commit", "HEAD"))) == sorted(p for p in BEFORE if BEFORE[p] != AFTER[p])
    assert {r[1] for r in git.changed_files(repo, git.Scope("commit", "HEAD~1"))} == {"added"}
    scope, paths = git.parse_arguments(repo, ["HEAD~1..HEAD", "--", "shop/models.py"])
    assert (scope.kind, paths) == ("range", ["shop/models.py"]) and len(git.changed_files(repo, scope, paths)) == 1
    assert git.parse_arguments(repo, ["HEAD~1", "HEAD"])[0].kind == "range" and git.parse_arguments(repo, ["HEAD~1"])[0].kind == "ref" and git.parse_arguments(repo, ["shop"]) == (git.Scope(), ["shop"])
    assert git.parse_arguments(repo, ["HEAD~1...HEAD"])[0].kind == "range" and git.parse_arguments(repo, [], True)[0].kind == "staged"


def test_project(spark, repo):
    p = Project(spark, repo, ["py"])
    assert {r.name for r in p.impact(name="shorten").collect()} == {"label", "add", "describe"}
    assert {r.name for r in p.tests(name="shorten").collect()} == {"test_report"}
    assert {r.name for r in p.dependents(name="open_shelf").collect()} == {"run", "test_report"}
    assert {r.name for r in p.dependencies(name="describe").collect()} >= {"add", "label"}
    assert {r.actual_args for r in p.verify().collect()} == {2}
    assert {r.callee_entity for r in p.verify_diff().collect()} == set()
    assert {(r.entity_name, r.change_type) for r in p.diff().filter("entity_type <> 'orphan'").collect()} == {("run", "modified")}
    assert {r.summary for r in p.blame("shop/models.py").collect()} == {"first", "second"}
    assert [r.kind for r in p.log("shorten", "shop/models.py").orderBy("ts").collect()][0] == "added"
    assert p.hotspots().count() > 0 and p.context(name="shorten").filter("role = 'target'").count() == 1
    assert {r.name for r in p.search("SHEL").collect()} == {"Shelf", "open_shelf", "add", "describe", "__init__"}  # ids count too


def test_renderings(spark, repo):
    d = Project(spark, repo, ["py"]).diff("HEAD~1", "HEAD")
    text = json.loads(render.diff_json(d).first().value)
    assert text["summary"]["renamed"] == 1 and {c["entityName"] for c in text["changes"]} >= {"shorten", "summary"}
    assert "R function summary (was report)" in render.plain(d) and "| R |" in render.markdown(d) and "shorten" in render.terminal(d, True)
    assert render.word_diff("a b c", "a x c") == "a [-b-] {+x+} c" and render.table_text(d, "entity_name").startswith("entity_name")


def test_json_and_patch(spark, repo):
    text = json.dumps([{"filePath": "a.json", "status": "modified", "beforeContent": '{"a": 1}', "afterContent": '{"a": 2}'}])
    assert changes.from_json(spark.createDataFrame([(text,)], "value string")).first().status == "modified"
    patch = git.run(repo, "diff", "HEAD~1", "HEAD")
    got = {r.file_path: r for r in changes.from_patch(spark, patch, repo).collect()}
    assert got["shop/models.py"].before_content == BEFORE["shop/models.py"] and got["shop/models.py"].after_content == AFTER["shop/models.py"]
    assert changes.parse_patch("diff --git a/x b/y\nsimilarity index 100%\nrename from x\nrename to y\n")[0]["status"] == "renamed"


def test_two_files(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    (tmp_path / "b").write_text("y")
    assert tuple(files.compare_files(spark, str(tmp_path / "a"), str(tmp_path / "b"), "n", "n").first())[3:] == ("x", "y")


def test_entities_that_move_between_files(spark, tmp_path):
    sh = lambda *a: subprocess.run(["git", "-C", tmp_path, "-c", "user.name=n", "-c", "user.email=e@example.org", *a], check=True, capture_output=True)
    f = "def walker(x):\n    return x + 1\n"
    sh("init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text(f + "\n\ndef other():\n    return 2\n")
    sh("add", "-A")
    sh("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("def other():\n    return 2\n")
    (tmp_path / "b.py").write_text(f)
    (tmp_path / ".entspark").mkdir()
    (tmp_path / ".entspark" / "x.py").write_text(f)
    sh("add", "-A", "-f")
    sh("commit", "-qm", "two")
    p = Project(spark, str(tmp_path), ["py"])
    assert sorted((r.kind, r.to_path) for r in p.log("walker", "a.py").collect()) == [("added", None), ("moved", "b.py")]
    assert {r.entity_name for r in p.hotspots(5).collect()} >= {"walker"} and {r.file_path for r in p.hotspots(5, "b.py").collect()} == {"b.py"}
    assert {r.path for r in git.read_tree(spark, str(tmp_path), "HEAD~1").collect()} == {"a.py"}
    assert [r[0] for r in git.changed_files(str(tmp_path), git.Scope("commit", "HEAD"))] == ["a.py", "b.py"]


def test_cache(spark, repo, tmp_path):
    from entspark.operators import store as ST

    cache = str(tmp_path / "cache")
    plain = Project(spark, repo, ["py"])
    want = lambda p: (sorted(map(repr, p.entities.select("id", "content_hash").collect())), sorted(map(repr, p.edges.collect())))
    assert want(Project(spark, repo, ["py"], cache=cache)) == want(plain)
    assert want(Project(spark, repo, ["py"], cache=cache)) == want(plain) and ST._versions(spark, cache) == [1]
    new = f"{repo}/shop/extra.py"
    try:
        with open(new, "w") as f:
            f.write("from stock import open_shelf\n\n\ndef more():\n    return open_shelf()\n")
        assert want(Project(spark, repo, ["py"], cache=cache)) == want(Project(spark, repo, ["py"])) and ST._versions(spark, cache) == [1, 2]
        one = spark.createDataFrame([("shop/extra.py",)], "file_path string")
        manifest, entities, edges = ST.cached(spark, cache, one)
        assert manifest.count() == 1 and {r.name for r in entities.collect()} == {"more"} and edges.count() == 1
    finally:
        import os

        os.remove(new)


def test_command_line(spark, repo, capsys, monkeypatch):
    import io

    from entspark.__main__ import main

    lines = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    at = ["-C", repo, "--ext", "py"]
    assert main([*at, "verify"], spark) == 1 and lines()[0]["actual_args"] == 2
    assert main([*at, "impact", "shorten"], spark) == 0 and {x["name"] for x in lines()} == {"label", "add", "describe"}
    assert main(["-C", repo, "diff", "--format", "json"], spark) == 0 and "run" in {x["entity_name"] for x in lines()}
    assert main([*at, "search", "shelf"], spark) == 0 and lines()
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps([{"filePath": "a.py", "status": "added", "afterContent": "def f():\n    pass\n"}])))
    assert main(["-C", repo, "diff", "--stdin", "--format", "json"], spark) == 0 and [x["entity_name"] for x in lines()] == ["f"]
