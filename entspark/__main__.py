"""Command line over ``plans.api.Project``: results as JSON lines, or the diff as text or Markdown."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="entspark", description=__doc__)
    p.add_argument("-C", dest="root", default=".", help="the repository's folder")
    p.add_argument("--ext", action="append", help="an extension of the files that count; all without any")
    p.add_argument("--cache", help="folder that keeps entities and edges between calls")
    sub = p.add_subparsers(dest="command")
    diff = sub.add_parser("diff", help="changes between revisions, the index and the working tree")
    diff.add_argument("args", nargs="*")
    diff.add_argument("--staged", action="store_true")
    diff.add_argument("--commit")
    diff.add_argument("--stdin", action="store_true", help="file changes as JSON")
    diff.add_argument("--format", choices=("json", "text", "markdown"), default="text")
    for name in ("impact", "tests", "context", "dependents", "dependencies"):
        one = sub.add_parser(name)
        one.add_argument("entity")
        one.add_argument("--file")
        if name == "impact":
            one.add_argument("--depth", type=int, default=2)
        if name == "context":
            one.add_argument("--budget", type=int, default=8_000)
    sub.add_parser("entities").add_argument("path", nargs="?", default="")
    sub.add_parser("graph")
    sub.add_parser("blame").add_argument("file")
    log = sub.add_parser("log")
    log.add_argument("entity")
    log.add_argument("--file", required=True)
    log.add_argument("--limit", type=int, default=50)
    verify = sub.add_parser("verify")
    verify.add_argument("--diff", action="store_true")
    sub.add_parser("search").add_argument("text")
    hot = sub.add_parser("hotspots")
    hot.add_argument("--file")
    hot.add_argument("--limit", type=int, default=50)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """Runs a command; the exit code is 1 where verifying finds something."""
    from pyspark.sql import functions as F

    from .plans import render
    from .plans.api import Project
    from .session import session
    from .sources import changes as CH

    options = parser().parse_args(argv)
    command = options.command or "diff"
    if options.command is None:
        options = parser().parse_args([*(argv if argv is not None else sys.argv[1:]), "diff"])
    project = Project(spark or session(), options.root, options.ext, cache=options.cache)
    which = {"name": options.entity} | ({"file_path": options.file} if options.file else {}) if command in ("impact", "tests", "context", "dependents", "dependencies") else {}
    if command == "diff":
        if options.stdin:
            texts = project.spark.createDataFrame([(sys.stdin.read(),)], "value string")
            found = project.diff_of(CH.from_json(texts), options.ext)
        else:
            found = project.diff_commit(options.commit) if options.commit else project.diff(*options.args, staged=options.staged, extensions=options.ext)
        if options.format == "text":
            print(render.terminal(found))
            return 0
        if options.format == "markdown":
            print(render.markdown(found))
            return 0
        found = render.ordered(found)
    elif command == "entities":
        found = project.entities.filter(F.startswith("file_path", F.lit(options.path))).drop("content").orderBy("file_path", "start_line", "id")
    elif command == "graph":
        found = project.edges.orderBy("src", "dst")
    elif command == "blame":
        found = project.blame(options.file).orderBy("id")
    elif command == "log":
        found = project.log(options.entity, options.file, options.limit).orderBy(F.desc("ts"))
    elif command == "verify":
        found = (project.verify_diff() if options.diff else project.verify()).orderBy("file_path", "line")
    elif command == "search":
        found = project.search(options.text).drop("content").orderBy("id")
    elif command == "hotspots":
        found = project.hotspots(options.limit, options.file)
    elif command == "impact":
        found = project.impact(options.depth, **which).drop("content").orderBy("depth", "id")
    elif command == "context":
        found = project.context(options.budget, **which)
    else:
        found = getattr(project, command)(**which).drop("content").orderBy("id")
    many = 0
    for row in render.to_json_rows(found).toLocalIterator():
        print(row.value)
        many += 1
    return int(command == "verify" and many > 0)


if __name__ == "__main__":
    sys.exit(main())
