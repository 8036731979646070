"""Steps whose share of a task mustn't grow with the input."""

import pytest

from entspark import session as S
from entspark.operators import graph as G
from entspark.operators import suppress as SU


def test_wide_steps_have_as_many_parts_as_the_input_asks_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "TASK_BYTES", 1_000)
    spark.range(5_000).selectExpr("concat('a', id) AS src", "concat('b', id % 900) AS dst", "'calls' AS ref_type", "0 AS pass", "0 AS seq").write.parquet(f"{tmp_path}/e")
    edges = spark.read.parquet(f"{tmp_path}/e")
    assert S.parts(edges) > 8
    once = G.distinct_edges(edges.unionAll(edges))
    assert once.count() == 5_000 and once.rdd.getNumPartitions() > 8
    ids = edges.select("src").unionAll(edges.select("dst")).distinct().withColumnRenamed("src", "id")
    found = G.dependents(edges, ids, edges.select("dst").distinct().withColumnRenamed("dst", "target"))
    assert found.count() == 5_000 and found.rdd.getNumPartitions() > 8
    starts = spark.createDataFrame([("b1",), ("b2",)], "start string")
    assert G.reach(edges, starts).count() == 12


@pytest.mark.parametrize("many", [2, 150])
def test_starts_share_rows(spark, many):
    """Starts are bits: ids that all of a block reach have one row, whatever the number of starts."""
    edges = spark.createDataFrame([("m", f"s{k}") for k in range(many)] + [(f"x{k}", "m") for k in range(5)], "src string, dst string")
    starts = spark.createDataFrame([(f"s{k}",) for k in range(many)], "start string")
    numbered = G._numbered(starts)
    assert G._reach_sets(edges, numbered, 0).count() == 6 * numbered.select("block").distinct().count()
    assert set(map(tuple, G.reach(edges, starts).collect())) == {(f"s{k}", i, d) for k in range(many) for i, d in [("m", 1), *((f"x{j}", 2) for j in range(5))]}


def test_own_text_of_modified_containers(spark):
    """A container whose own text is the same goes with its changed child; one whose own text changed stays."""
    names = "scope string, id string, name string, entity_type string, parent_id string, content string, start_line int, end_line int, ordinal int"
    rows = lambda a, v, p: [("s", "A", "A", "class", None, f"class A:\n{a}", 1, 2, 0), ("s", "a", "a", "method", "A", a, 2, 2, 1), ("s", "B", "B", "class", None, f"class B{v}:\n{p}", 4, 5, 2), ("s", "b", "b", "method", "B", p, 5, 5, 3)]
    before, after = spark.createDataFrame(rows("x", "", "y"), names), spark.createDataFrame(rows("z", "(C)", "w"), names)
    changes = spark.createDataFrame([("s", i, t, "modified", None, None, None) for i, t in (("A", "class"), ("a", "method"), ("B", "class"), ("b", "method"))], "scope string, entity_id string, entity_type string, change_type string, old_parent_id string, old_entity_name string, parent_id string")
    assert {r.entity_id for r in SU.suppress_parents(changes, before, after).collect()} == {"a", "B", "b"}
