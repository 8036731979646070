import random
from pathlib import Path

import numpy as np
import pytest

from entspark.llm import quality as Q

from .conftest import SCHEMA, prose, rows


SF = "/root/testdata/sf0.01"


def junk(seed):
    rng = random.Random(seed)
    words = prose(seed, rng.randint(10, 80)).split()
    return rng.choice((" ".join(w + rng.choice(("%%%", "***", "###")) for w in words), " ".join(w.upper() + "!!" for w in words), " ".join(w for w in words for _ in range(9)), " | ".join(words)))


@pytest.fixture(scope="module")
def corpus(spark):
    data = [(k, junk(k) if k % 5 == 0 else prose(k, 10 + k % 70) + ".", "en", f"s{k % 4}", None) for k in range(800)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(0, 400)] + [(None, 1, 0), (900, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus, labels):
    out = {r.doc_id: r for r in Q.score(corpus, labels).collect()}
    assert len(out) == 800
    held = range(400, 800)
    assert sum(out[k].keep == (k % 5 != 0) for k in held) >= 0.98 * len(held)
    assert all(out[k].keep for k in held if k % 5)  # clean documents stay


def test_rounds_exchange_labels(corpus, labels):
    model = Q.train(corpus, labels)
    assert min(model.pseudo) > 0
    again = Q.train(corpus.repartition(7), labels.repartition(3))
    assert np.allclose(model.weights[0], again.weights[0], atol=1e-4)


def test_calibration_is_monotone(corpus, labels):
    model = Q.train(corpus, labels)
    assert all(s >= 0 for s, _ in model.scale)


def test_defined_results(spark, corpus, labels, clashing, no_docs, docs):
    odd = spark.createDataFrame([(1000, None, "en", "s0", 0), (1001, "", "en", "s0", 0), (1002, " \n", "en", "s0", 0), (None, prose(1, 60) + ".", None, None, None), (1003, prose(2, 30_000), "en", "s1", 0), (1004, prose(9, 40), "en", "s0", 0), (1004, prose(9, 40), "en", "s0", 0)], SCHEMA)
    out = Q.score(corpus.unionByName(odd), labels).filter("doc_id IS NULL OR doc_id >= 1000").collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 7 and [got[k].keep for k in (1000, 1001, 1002)] == [False] * 3 and got[1000].score == 0.0
    assert got[None].keep and got[1003].keep and len({r.score for r in out if r.doc_id == 1004}) == 1
    assert Q.score(no_docs, labels).count() == 0 and Q.keep_good(no_docs, labels).count() == 0
    mixed = clashing.unionByName(corpus, allowMissingColumns=True)
    assert Q.keep_good(mixed, labels).columns == mixed.columns
    plain = Q.keep_good(docs.unionByName(corpus), labels)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, Q.keep_good(mixed, labels).select(*docs.columns).collect()))


def test_without_labels_all_with_content_stay(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0)], none.schema)
    want = sorted(repr(r) for r in docs.collect() if r.text and r.text.strip())
    for labels in (none, one):
        assert sorted(map(repr, Q.keep_good(docs, labels).collect())) == want
        assert {r.score for r in Q.score(docs, labels).filter("keep").collect()} == {None}


def test_contradicting_labels_are_left_out(corpus, labels, spark):
    wrong = spark.createDataFrame([(k, 0, 0) for k in range(1, 60)], labels.schema)
    assert Q._known(labels.unionByName(wrong)).count() == 400 - sum(k % 5 != 0 for k in range(1, 60))


def test_the_bound_on_labels_is_kept(labels, monkeypatch):
    monkeypatch.setattr(Q, "LABELLED", 50)
    known = Q._known(labels)
    assert known.count() == 50 and sorted(map(tuple, known.collect())) == sorted(map(tuple, Q._known(labels.repartition(5)).collect()))


def brute(docs, labels):
    """score() with lists in place of tables: every round looks at all unlabelled documents."""
    quality = {}
    for r in labels:
        if r.doc_id is not None and r.quality in (0, 1):
            quality.setdefault(r.doc_id, set()).add(r.quality)
    quality = {k: v.pop() for k, v in quality.items() if len(v) == 1}
    full = {(r.doc_id, r.text, r.source, r.lang) for r in docs if r.text and r.text.strip()}
    half = lambda v: v.astype(np.float16).astype(np.float32)
    views = {k: tuple(map(half, next(Q._views([k[1]], [k[2]], [k[3]])))) for k in full}
    known = sorted(((quality[k[0]], *(v.astype(np.float16).tobytes() for v in views[k]), k) for k in full if k[0] in quality), key=lambda r: (r[1], r[2], r[0]))
    model = Q.Model(*(np.array([views[r[3]][v] for r in known]) for v in (0, 1)), np.array([r[0] for r in known], float))
    rest = sorted((k for k in full if k[0] not in quality), key=repr)
    good, bad = model.wanted()
    for _ in range(Q.ROUNDS):
        given = ({}, {})
        for v in (0, 1):
            raw = {k: round(float(views[k][v] @ model.weights[v][:-1] + model.weights[v][-1]), 4) for k in rest if repr(k) not in model.taken[1 - v]}
            for k in sorted((k for k in raw if raw[k] > 0), key=lambda k: -raw[k])[:good]:
                given[1 - v][repr(k)] = (1.0, views[k][1 - v])
            for k in sorted((k for k in raw if raw[k] < 0), key=lambda k: raw[k])[:bad]:
                given[1 - v][repr(k)] = (0.0, views[k][1 - v])
        model.exchange(given)
    model.calibrate()
    out = {}
    for r in docs:
        k = (r.doc_id, r.text, r.source, r.lang)
        out[k] = float(model.score(*(np.array([v]) for v in next(Q._views([r.text], [r.source], [r.lang]))))[2][0]) if k in views else 0.0
    return out


@pytest.mark.skipif(not Path(SF).exists(), reason="the tables aren't here")
def test_the_query_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "labels"))
    want = {k[0]: v for k, v in brute(docs, labels).items()}
    got = {r.doc_id: r for r in Q.query(spark, SF).collect()}
    assert set(got) == set(want) and len(docs) == len(want)
    assert sum(abs(got[i].score - want[i]) < 0.02 for i in want) >= 0.99 * len(want)
    assert sum(got[i].keep == (want[i] >= Q.THRESHOLD) for i in want) >= 0.995 * len(want)
