"""Changes, commits and blame of a git repository: the driver asks git what there is, tasks read the texts."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..model import COMMIT, FILE_CHANGE, LINE_BLAME

EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def run(repository: str, *args: str, check: bool = True) -> str:
    out = subprocess.run(["git", "-C", repository, "-c", "core.quotepath=off", *args], capture_output=True, check=False)
    if check and out.returncode:
        raise ValueError(out.stderr.decode("utf-8", "replace").strip())
    return out.stdout.decode("utf-8", "replace") if not out.returncode else ""


def blob(repository: str, spec: str) -> str | None:
    """A text by ``revision:path`` (``:path`` is the index); None if there is none, or it isn't UTF-8."""
    out = subprocess.run(["git", "-C", repository, "show", spec], capture_output=True, check=False)
    try:
        return None if out.returncode else re.sub("\r\n?", "\n", out.stdout.decode("utf-8"))
    except UnicodeDecodeError:
        return None


def working(repository: str, path: str) -> str | None:
    try:
        with open(f"{repository}/{path}", encoding="utf-8", newline="") as f:
            return re.sub("\r\n?", "\n", f.read())
    except (OSError, UnicodeDecodeError):
        return None


@dataclass(frozen=True)
class Scope:
    """``working``, ``staged``, ``commit`` (of ``a``), ``range`` (``a`` to ``b``) or ``ref`` (``a`` to the working tree)."""

    kind: str = "working"
    a: str | None = None
    b: str | None = None


def is_revision(repository: str, name: str) -> bool:
    return bool(run(repository, "rev-parse", "--verify", "--quiet", f"{name}^{{commit}}", check=False).strip())


def head(repository: str) -> str:
    return run(repository, "rev-parse", "HEAD").strip()


def merge_base(repository: str, a: str, b: str) -> str:
    return run(repository, "merge-base", a, b).strip()


def resolve(repository: str, name: str) -> str:
    """A revision's hash, where the folder is one of Jujutsu's also of its revsets; what no one knows stays as it is."""
    if os.path.isdir(f"{repository}/.jj") and shutil.which("jj") and not re.fullmatch("[0-9a-f]{7,40}", name):
        out = subprocess.run(["jj", "log", "-R", repository, "--no-graph", "-r", name, "-T", 'commit_id ++ "\\n"'], capture_output=True, check=False, text=True)
        if not out.returncode and out.stdout.strip():
            return out.stdout.split()[0]
    return run(repository, "rev-parse", "--verify", "--quiet", name, check=False).strip() or name


def parse_arguments(repository: str, args: list[str], staged: bool = False) -> tuple[Scope, list[str]]:
    """Scope and path filters of arguments as git reads them: ``a..b``, ``a...b``, ``a b``, ``a``, ``-- path``."""
    paths: list[str] = []
    loose: list[str] = []
    if "--" in args:
        k = args.index("--")
        args, paths = args[:k], args[k + 1 :]
    names: list[str] = []
    for arg in args:
        if ".." in arg and not loose and not names and (m := re.fullmatch(r"(.*?)(\.{2,3})(.*)", arg)):
            a, b = m[1] or "HEAD", m[3] or "HEAD"
            names = [merge_base(repository, a, b) if m[2] == "..." else a, b]
        elif not loose and len(names) < 2 and is_revision(repository, arg):
            names.append(arg)
        else:
            loose.append(arg)
    paths = loose + paths
    if staged:
        return Scope("staged"), paths
    if len(names) == 2:
        return Scope("range", *names), paths
    return (Scope("ref", names[0]) if names else Scope()), paths


_STATUS = {"A": "added", "M": "modified", "T": "modified", "D": "deleted", "R": "renamed"}
#: Our own files in a repository, which are no one's change.
OWN = ".entspark/"


class Blobs:
    """Texts of objects, by id or ``revision:path``, from one process of git."""

    def __init__(self, repository: str):
        self.repository = repository
        self.process = subprocess.Popen(["git", "-C", repository, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def __enter__(self) -> Blobs:
        return self

    def __exit__(self, *_: object) -> None:
        self.process.stdin.close()
        self.process.wait()

    def text(self, spec: str | None) -> str | None:
        """A text; None if there is none, or it isn't UTF-8.  ``disk:path`` is a file of the working tree."""
        if spec is None or spec.startswith("disk:"):
            return spec and working(self.repository, spec[5:])
        if "\n" in spec:
            return blob(self.repository, spec)
        self.process.stdin.write(spec.encode("utf-8", "surrogateescape") + b"\n")
        self.process.stdin.flush()
        header = self.process.stdout.readline().split()
        if len(header) != 3 or not header[2].isdigit():
            return None
        data = self.process.stdout.read(int(header[2]))
        self.process.stdout.read(1)
        try:
            return re.sub("\r\n?", "\n", data.decode("utf-8")) if header[1] == b"blob" else None
        except UnicodeDecodeError:
            return None


def _deltas(repository: str, args: list[str], paths: list[str]) -> Iterator[tuple[str, str, str, str]]:
    """(path, status, object before, object after) of each changed file."""
    items = run(repository, "diff", "--raw", "--abbrev=40", "-z", "--no-renames", *args, "--", *paths).split("\0")
    k = 0
    while k + 1 < len(items):
        _, _, old, new, letter = items[k].split()
        if letter[:1] in _STATUS and not items[k + 1].startswith(OWN):
            yield items[k + 1], _STATUS[letter[:1]], old, new
        k += 2


def listed_changes(repository: str, scope: Scope = Scope(), paths: list[str] = ()) -> list[tuple]:
    """Rows of (path, status, old path, where the text before is, where the text after is); no text is read."""
    head_of, disk = lambda p, _: f"HEAD:{p}", lambda p, _: f"disk:{p}"
    known = lambda p, identity: identity if identity.strip("0") else f"disk:{p}"
    if scope.kind == "working":
        args, before, after = [], head_of, disk
    elif scope.kind == "staged":
        args, before, after = ["--cached"], known, known
    elif scope.kind == "commit":
        parent = run(repository, "rev-parse", "--verify", "--quiet", f"{scope.a}^", check=False).strip() or EMPTY_TREE
        args, before, after = [parent, scope.a], known, known
    elif scope.kind == "range":
        args, before, after = [scope.a, scope.b], known, known
    else:
        args, before, after = [scope.a], known, disk
    return [(p, status, None, None if status == "added" else before(p, old), None if status == "deleted" else after(p, new)) for p, status, old, new in _deltas(repository, args, list(paths))]


def changed_files(repository: str, scope: Scope = Scope(), paths: list[str] = ()) -> list[tuple]:
    """Rows of file changes: path, status, old path, text before, text after."""
    with Blobs(repository) as blobs:
        return [(p, status, old, blobs.text(b), blobs.text(a)) for p, status, old, b, a in listed_changes(repository, scope, paths)]


def with_texts(rows: DataFrame, repository: str, *columns: str) -> DataFrame:
    """``rows`` with these columns' texts in place of their places.

    The driver lists; tasks read, each with one process of git, so the
    repository has to be where executors reach it.
    """
    schema = rows.schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Blobs(repository) as blobs:
            for batch in batches:
                for name in columns:
                    k = batch.schema.get_field_index(name)
                    batch = batch.set_column(k, name, pa.array([blobs.text(x) for x in batch.column(k).to_pylist()], pa.string()))
                yield batch

    return rows.mapInArrow(read, schema)


def read_changes(spark: SparkSession, repository: str, scope: Scope = Scope(), paths: list[str] = ()) -> DataFrame:
    return with_texts(spark.createDataFrame(listed_changes(repository, scope, paths), FILE_CHANGE), repository, "before_content", "after_content")


def read_tree(spark: SparkSession, repository: str, revision: str = "HEAD") -> DataFrame:
    """(path, content) of a revision's files that are texts."""
    items = run(repository, "ls-tree", "-r", "-z", revision).split("\0")
    rows = [(x.partition("\t")[2], x.split()[2]) for x in items if x and x.split()[1] == "blob"]
    return with_texts(spark.createDataFrame(rows, "path string, content string"), repository, "content").filter("content IS NOT NULL")


def _commits(repository: str, *args: str) -> list[tuple]:
    text = run(repository, "log", "--format=%H%x1f%an%x1f%at%x1f%s%x1e", *args, check=False)
    rows = [r.strip("\n").split("\x1f") for r in text.split("\x1e") if r.strip()]
    return [(sha, sha[:7], author, datetime.fromtimestamp(int(at), timezone.utc), message) for sha, author, at, message in rows]


def read_log(spark: SparkSession, repository: str, limit: int | None = None, path: str | None = None) -> DataFrame:
    """Commits from HEAD back, or only those that changed a file."""
    return spark.createDataFrame(_commits(repository, *([f"-{limit}"] if limit else []), "HEAD", *(["--", path] if path else [])), COMMIT)


def commit_files(spark: SparkSession, repository: str, sha: str) -> DataFrame:
    rows = [(sha, p, old) for p, _, old, *_ in listed_changes(repository, Scope("commit", sha))]
    return spark.createDataFrame(rows, "sha string, file_path string, old_file_path string")


def read_versions(spark: SparkSession, repository: str, path: str, limit: int | None = None) -> DataFrame:
    """(path, sha, ts, content) of a file at each commit that changed it."""
    rows = [(path, c[0], c[3], f"{c[0]}:{path}") for c in _commits(repository, *([f"-{limit}"] if limit else []), "HEAD", "--", path)]
    return with_texts(spark.createDataFrame(rows, "path string, sha string, ts timestamp, content string"), repository, "content")


def read_blame(spark: SparkSession, repository: str, path: str) -> DataFrame:
    rows, seen, now = [], {}, None
    for line in run(repository, "blame", "--line-porcelain", "HEAD", "--", path).split("\n"):
        if m := re.match(r"([0-9a-f]{40}) \d+ (\d+)", line):
            now = {"sha": m[1], "line": int(m[2])}
        elif now and line.startswith(("author ", "author-time ", "summary ")):
            k, _, v = line.partition(" ")
            now[k] = v
        elif now and line.startswith("\t"):
            seen.setdefault(now["sha"], now)
            rows.append((path, now["line"], now["sha"], now.get("author"), datetime.fromtimestamp(int(now.get("author-time", 0)), timezone.utc), now.get("summary")))
    return spark.createDataFrame(rows, LINE_BLAME)
