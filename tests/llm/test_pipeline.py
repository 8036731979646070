import pytest

import corpus_pipeline as P
from entspark.llm import decontaminate, ngram_join, quality, secret_scan

from .conftest import SCHEMA, prose
from .test_mixing import brute as mixed
from .test_ngram_join import brute as pairs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs):
    out = str(tmp_path_factory.mktemp("tables"))
    junk = [(k, " ".join(w + "%%%***" for w in prose(k, 40).split()), "en", "s0", None) for k in range(200, 260)]
    good = [(k, prose(k, 50) + ".", "en", "s1", None) for k in range(300, 420)]
    item = prose(999, 30)
    planted = [(500, f"{prose(1000, 20)} {item} {prose(1001, 20)}", "en", "s1", None), (501, f"{prose(1002, 30)} password=abcdefgh12345", "en", "s1", None)]
    docs.unionByName(spark.createDataFrame(junk + good + planted, SCHEMA)).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, int(k >= 300), 0) for k in (*range(200, 240), *range(300, 380))], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    a = P.quality_stage(spark, docs, folder)
    kept = {r.doc_id for r in a.collect()}
    assert a.columns == columns and kept.isdisjoint(range(200, 260)) and kept >= set(range(300, 420))
    data = a.collect()
    b = P.near_duplicate_stage(spark, a, folder)
    gone = {j for _, j, *_ in pairs(data)}
    assert b.columns == columns and {r.doc_id for r in b.collect()} == kept - gone
    c = P.decontamination_stage(spark, b, folder)
    assert c.columns == columns and prose(999, 30) not in " ".join(r.text for r in c.collect()) and c.count() == b.count()
    d = P.secret_stage(spark, c, folder)
    assert d.columns == columns and "password=[assigned_password]" in {r.doc_id: r for r in d.collect()}[501].text
    e = P.mixing_stage(spark, d, folder)
    assert sorted(((r.doc_id, r.text, r.copy) for r in e.collect()), key=repr) == mixed(d.collect())


def test_run_is_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(repr, P.run(spark, folder).collect())) == sorted(map(repr, docs.collect()))


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "ngram_jaccard_dedup", "benchmark_decontamination", "secret_scan", "mix_sources"]
    assert all(m.__doc__ for m in (decontaminate, ngram_join, quality, secret_scan))
