import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from entspark.llm import kernels as K
from entspark.llm import ngram_join as J

from .conftest import SCHEMA, prose, rows


def grams(text, n=3):
    w = K.WORD.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(data, t=0.5):
    """Pairs of documents that are linked."""
    sets = sorted({(r[0], frozenset(grams(r[1]))) for r in data if r[0] is not None and grams(r[1])}, key=lambda x: x[0])
    out = set()
    for (i, a), (j, b) in combinations(sets, 2):
        if i != j and len(a & b) >= t * len(a | b):
            out.add((i, j, len(a & b), len(a | b)))
    return sorted(out)


def classes(data, t=0.5):
    """(doc_id, class_id, n_links) of all documents by comparing all of them."""
    sets = sorted({(r[0], frozenset(grams(r[1]))) for r in data if r[0] is not None and grams(r[1])}, key=lambda x: x[0])
    label, links = {r[0]: r[0] for r in data if r[0] is not None}, dict.fromkeys((r[0] for r in data if r[0] is not None), 0)
    for (i, a), (j, b) in combinations(sets, 2):
        if len(a & b) >= t * len(a | b):
            links[i], links[j] = links[i] + 1, links[j] + 1
            x, y = sorted((label[i], label[j]))
            label = {k: x if v == y else v for k, v in label.items()}
    return sorted((i, label[i], links[i]) for i in label)


def test_like_brute_force_with_nulls_copies_and_long_texts(docs):
    assert sorted(rows(J.ngram_jaccard_join(docs))) == classes(docs.collect())


def near(seed=3, groups=12, copies=4):
    rng = random.Random(seed)
    data = []
    for g in range(groups):
        base = prose(g, rng.randint(3, 120)).split()
        for _ in range(copies):
            w = [x if rng.random() > 0.08 else rng.choice(base) for x in base]
            data.append((len(data), " ".join(w[: rng.randint(max(1, len(w) // 2), len(w))]), "en", "s", None))
    return data


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8, 1.0])
def test_thresholds(spark, t):
    data = near()
    assert sorted(rows(J.ngram_jaccard_join(spark.createDataFrame(data, SCHEMA), 3, t))) == classes(data, t)


@pytest.mark.parametrize("most", [1, 3, 20])
def test_large_tiles_are_cut_without_losing_a_link(spark, monkeypatch, most):
    monkeypatch.setattr(J, "TILE_ROWS", most)
    passage = prose(77, 30)
    data = near(5, 2, 40) + [(1_000 + k, f"{passage} {prose(500 + k, k)}", "en", "s", None) for k in range(30)]
    frame = spark.createDataFrame(data, SCHEMA)
    want = classes(data)
    assert sorted(rows(J.ngram_jaccard_join(frame))) == want
    got = dict(rows(J.groups(frame)))
    assert got == {i: c for i, c, _ in want if i in got} and {i for i, _, n in want if n} <= set(got)


def test_rows_grow_with_documents_not_with_pairs(spark):
    data = [(k, prose(1, 60), "en", "s", None) for k in range(400)] + [(400 + k, prose(1, 60) + f" tail{k}", "en", "s", None) for k in range(300)]
    out = J.ngram_jaccard_join(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(out) == 700 and {r.class_id for r in out} == {0} and {r.n_links for r in out} == {699}


def test_a_block_of_other_rows_is_an_error():
    with pytest.raises(RuntimeError):
        list(J._survivors(0.5)(iter([J._batch("part block payload", J._BLOCK_TYPES, [(3, 5, bytes(12))])])))


def test_empty_and_clashing_columns(no_docs, docs, clashing):
    assert rows(J.ngram_jaccard_join(no_docs)) == []
    assert rows(J.ngram_jaccard_join(clashing)) == rows(J.ngram_jaccard_join(docs))


def test_ties_at_the_threshold(spark):
    # 3 of 6 grams: exactly one half
    frame = spark.createDataFrame([(1, "a b c d e f", "", "", 0), (2, "a b c d e g h", "", "", 0), (3, "a b c d e", "", "", 0)], SCHEMA)
    assert (1, 2, 3, 6) in brute(frame.collect())
    assert sorted(rows(J.ngram_jaccard_join(frame))) == classes(frame.collect())


def test_deduplicate_keeps_the_least_of_each_group(docs, clashing, no_docs):
    data = docs.collect()
    label = {r[0]: r[0] for r in data}
    for _ in data:
        for i, j, *_ in brute(data):
            label[i] = label[j] = min(label[i], label[j])
    kept = {(r[0], r[1]) for r in data if r[0] is None or label[r[0]] == r[0]}
    out = J.deduplicate(docs)
    assert out.columns == docs.columns
    got = [(r[0], r[1]) for r in out.collect()]
    assert set(got) == kept
    assert len([g for g in got if g[0] == 41]) == 1  # the repeated row
    assert J.deduplicate(clashing).columns == clashing.columns
    assert J.deduplicate(clashing).count() == len(got)
    assert J.deduplicate(no_docs).count() == 0


def test_same_id_with_different_texts(spark):
    data = [(1, prose(1, 30), "", "", 0), (1, prose(2, 30), "", "", 0), (2, prose(2, 30), "", "", 0), (2, prose(3, 30), "", "", 0), (3, prose(3, 30), "", "", 0), (4, prose(4, 30), "", "", 0), (5, None, "", "", 0)]
    frame = spark.createDataFrame(data, SCHEMA)
    assert sorted(rows(J.ngram_jaccard_join(frame))) == classes(data) == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 4, 0), (5, 5, 0)]
    assert sorted(r[0] for r in J.deduplicate(frame).collect()) == [1, 1, 4, 5]


def test_components_of_a_chain_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (102, 100)]
    out = dict(J.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {out[i] for i in range(1, 51)} == {0} and {out[i] for i in (101, 102)} == {100}


def test_bitmap_bound_never_loses_a_pair(monkeypatch):
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 40, 400)
    sets = sorted((np.unique(rng.choice(pool, rng.integers(1, 200))) for _ in range(60)), key=len)
    sizes = np.array([len(s) for s in sets])
    for t in (0.1, 0.3, 0.6):
        want = {(i, j) for i, j in combinations(range(60), 2) if len(np.intersect1d(sets[i], sets[j])) >= t * len(np.union1d(sets[i], sets[j]))}
        for at_once in (1, 1 << 20):
            monkeypatch.setattr(J, "AT_ONCE", at_once)
            assert {(i, int(j)) for i, js in J.tile_links(sizes, np.concatenate(sets), sizes, t) for j in js} == want
            side = np.arange(60) % 2
            assert {(i, int(j)) for i, js in J.tile_links(sizes, np.concatenate(sets), sizes, t, side) for j in js} == {p for p in want if (p[0] + p[1]) % 2}


def test_grams_of_lower_case_that_changes_length():
    a, b = K.gram_hashes(["İstanbul köprü yolu açık", None], 3)
    assert len(a) == 2 and len(b) == 0


def test_oracle_words_are_python_words(docs):
    text = docs.filter("doc_id = 23").first().text
    assert len(K.WORD.findall(text.lower())) == 80
    assert docs.select(F.size(F.regexp_extract_all(F.lower("text"), F.lit("[0-9a-z_\\x{80}-\\x{10FFFF}]+"), F.lit(0)))).first()[0] == len(K.WORD.findall(docs.first().text))
