"""Entry points: each gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diff as D
from ..operators import graph as G
from ..operators import history as H
from ..operators import scope as SC
from ..operators import search as SE
from ..operators import store as ST
from ..operators import verify as V
from ..operators.extract import Registry, extract_entities, extract_files
from ..session import cut
from ..sources import files as FI
from ..sources import git


class Project:
    """A folder's entities and edges, read once.

    With a ``cache`` (a folder, one for each choice of extensions) they are kept
    there: files whose text is as it was aren't extracted again, and where no
    file changed nothing is.
    """

    def __init__(self, spark: SparkSession, root: str, extensions: list[str] | None = None, registry: Registry | None = None, cache: str | None = None):
        self.spark, self.root, self.registry, self.cache = spark, root, registry, cache
        self.files = FI.read_files(spark, root, extensions)
        self._entities: DataFrame | None = None
        self._edges: DataFrame | None = None

    @property
    def entities(self) -> DataFrame:
        if self._entities is None:
            self._entities = cut(extract_files(self.files, self.registry)) if self.cache is None else self._refreshed()[0]
        return self._entities

    def _refreshed(self) -> tuple[DataFrame, DataFrame]:
        """Entities and edges of the cache, brought up to date first."""
        files = cut(self.files)
        now = files.select(F.col("path").alias("file_path"), F.md5("content").alias("mtime"))
        stored = ST.cached(self.spark, self.cache)
        if stored is None:
            entities = cut(extract_files(files, self.registry))
        else:
            stale = cut(ST.staleness(stored[0], now).select("file_path"))
            if stale.isEmpty():
                self._edges = stored[2]
                return stored[1], stored[2]
            fresh = extract_files(files.join(stale.withColumnRenamed("file_path", "path"), "path", "left_semi"), self.registry)
            entities = cut(stored[1].join(stale, "file_path", "left_anti").unionByName(fresh.select(*stored[1].columns)))
        self._entities = entities
        self._edges = self._resolved(files, entities)
        ST.keep(self.cache, now, entities, self._edges)
        return entities, self._edges

    def _resolved(self, files: DataFrame, entities: DataFrame) -> DataFrame:
        facts = cut(SC.python_facts(files))
        return cut(G.build_graph(entities, SC.import_table(facts, entities), SC.resolve(facts, entities).drop("way")))

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            self._edges = self._resolved(self.files, self.entities) if self.cache is None else self._refreshed()[1]
        return self._edges

    def find(self, name: str | None = None, entity_id: str | None = None, file_path: str | None = None) -> DataFrame:
        return SE.find(self.entities, name, entity_id, file_path)

    def search(self, query: str) -> DataFrame:
        return SE.search(self.entities, query)

    def dependents(self, **which: str) -> DataFrame:
        return G.dependents(self.edges, self.entities, self.find(**which).select(F.col("id").alias("target")))

    def dependencies(self, **which: str) -> DataFrame:
        return G.dependencies(self.edges, self.entities, self.find(**which).select(F.col("id").alias("target")))

    def impact(self, depth: int = 2, cap: int | None = None, **which: str) -> DataFrame:
        """What a change reaches over ``depth`` edges (0: any number)."""
        return G.impact(self.edges, self.entities, self.find(**which).select(F.col("id").alias("start")), depth, cap)

    def tests(self, **which: str) -> DataFrame:
        return G.impacted_tests(self.edges, self.entities, self.find(**which).select(F.col("id").alias("start")))

    def context(self, budget: int = G.BUDGET, **which: str) -> DataFrame:
        return G.context(self.edges, self.entities, self.find(**which).select(F.col("id").alias("target")), budget)

    def verify(self) -> DataFrame:
        return V.arity_mismatches(self.edges, self.entities)

    def verify_diff(self) -> DataFrame:
        """Calls that the uncommitted changes of functions broke."""
        before = extract_files(git.read_tree(self.spark, self.root), self.registry)
        return V.broken_callers(before, self.entities, self.edges)

    def diff(self, *args: str, staged: bool = False, extensions: list[str] | None = None) -> DataFrame:
        scope, paths = git.parse_arguments(self.root, list(args), staged)
        return self.diff_of(git.read_changes(self.spark, self.root, scope, paths), extensions)

    def diff_commit(self, sha: str) -> DataFrame:
        return self.diff_of(git.read_changes(self.spark, self.root, git.Scope("commit", sha)))

    def diff_of(self, changes: DataFrame, extensions: list[str] | None = None) -> DataFrame:
        """The diff of any table of file changes, as JSON, a patch or two files give one."""
        return D.diff_files(changes.filter(T.has_extension("file_path", extensions or [])), self.registry)

    def blame(self, file_path: str) -> DataFrame:
        spans = self.entities.filter(F.col("file_path") == file_path).select("file_path", "id", "start_line", "end_line")
        return H.blame(spans, git.read_blame(self.spark, self.root, file_path))

    def log(self, name: str, file_path: str, limit: int | None = 50) -> DataFrame:
        """What each commit of its file did to an entity."""
        versions = cut(git.read_versions(self.spark, self.root, file_path, limit))
        sides = versions.select(F.col("sha").alias("scope"), "path", F.col("path").alias("plugin_path"), F.col("content").alias("hint"), "content")
        found = extract_entities(sides, self.registry).filter(F.col("name") == name).groupBy(F.col("scope").alias("sha")).agg(F.min_by("content_hash", "ordinal").alias("content_hash"), F.min_by("structural_hash", "ordinal").alias("structural_hash"))
        steps = cut(H.evolution(versions.select("path", "sha", "ts", F.col("sha").alias("seq")).join(found, "sha", "left"), ["path"]))
        return steps.join(self._moved(name, file_path, steps, found), "sha", "left").withColumn("kind", F.when(F.col("to_path").isNotNull(), "moved").otherwise(F.col("kind")))

    def _moved(self, name: str, file_path: str, steps: DataFrame, found: DataFrame) -> DataFrame:
        """(sha, to_path) of commits in which the entity left the file for another that they changed."""
        order = W.orderBy("ts", "seq")  # the versions of one file, as many as the log's limit
        gone = steps.select("sha", "kind", F.last("structural_hash", True).over(order).alias("structural_hash")).filter("kind = 'deleted'")
        gone = cut(gone.select("sha", F.lit(name).alias("name"), "structural_hash", F.lit(file_path).alias("file_path")))
        rows = [(r.sha, p, after) for r in gone.select("sha").collect() for p, _, _, _, after in git.listed_changes(self.root, git.Scope("commit", r.sha)) if after and p != file_path]
        files = git.with_texts(self.spark.createDataFrame(rows, "scope string, path string, content string"), self.root, "content")
        there = extract_entities(files.select("scope", "path", F.col("path").alias("plugin_path"), F.col("content").alias("hint"), "content"), self.registry)
        return H.moved_to(gone, there.withColumnRenamed("scope", "sha")).select("sha", "to_path")

    def hotspots(self, limit: int = 50, file_path: str | None = None) -> DataFrame:
        """How often each entity changed over the latest commits, of all files or of one."""
        shas = [r.sha for r in git.read_log(self.spark, self.root, limit + 1).collect()]
        paths = [file_path] if file_path else []
        rows = [row for newer, older in zip(shas, shas[1:]) for row in git.listed_changes(self.root, git.Scope("range", older, newer), paths)]
        scoped = [(f"{k}/{p}", s, o, b, a) for k, (p, s, o, b, a) in enumerate(rows)]
        from ..model import FILE_CHANGE

        texts = git.with_texts(self.spark.createDataFrame(scoped, FILE_CHANGE), self.root, "before_content", "after_content")
        changes = D.diff_files(texts, self.registry)
        return H.hotspots(changes.withColumn("file_path", F.regexp_replace("file_path", "^[0-9]+/", "")))
