import random
from pathlib import Path

import numpy as np
import pytest

from entspark.llm import language_id as G

from .conftest import SCHEMA, rows

SF = "/root/testdata/sf0.01"
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "ra"], "bb": ["sch", "ei", "ung", "keit", "ge"], "cc": ["ñó", "ción", "ez", "lla", "ue"]}


def text(lang, seed, words=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def labelled(spark):
    data = [(k, text(lang, k), lang, "s", 0) for k, lang in enumerate(list(SYLLABLES) * 60)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def model(labelled):
    return G.fitted(G.sample(labelled))


def texts(labelled):
    out = {}
    for r in G.sample(labelled).collect():
        out.setdefault(r.lang, []).append(r.text)
    return out


def test_the_sample_is_that_of_the_least_hashes(spark, labelled):
    import hashlib

    point = lambda r: int(hashlib.md5(f"{G.SEED}|{r.doc_id}".encode()).hexdigest()[:13], 16)
    by = {}
    for r in labelled.collect():
        by.setdefault(r.lang, []).append((point(r), r.text))
    got = {}
    for r in G.sample(labelled.unionByName(labelled), 25).collect():
        got.setdefault(r.lang, []).append(r.text)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(t for _, t in sorted(v)[:25]) for k, v in by.items()}
    hot = spark.createDataFrame([(1, "one text", "aa", "s", 0)] * 300 + [(None, "no id", "aa", "s", 0)], SCHEMA)
    assert [r.text for r in G.sample(hot, 25).collect()] == ["one text"]


def test_held_out_accuracy(model):
    held = [(lang, text(lang, 10_000 + k)) for k, lang in enumerate(list(SYLLABLES) * 100)]
    got = model.decide([t for _, t in held])
    assert sum(a == g[0] for (a, _), g in zip(held, got)) >= 0.99 * len(held)


def test_bits_are_those_of_single_filters(labelled, model):
    samples = texts(labelled)
    probe = np.arange(0, 1 << 32, 9_973, dtype=np.uint32)
    masks = model.containing(probe)
    for k, lang in enumerate(model.languages):
        alone = G.LanguageFilter(G.frequent({lang: samples[lang]})).containing(probe)
        assert np.array_equal((masks >> k) & 1, alone & 1)
        found, count = np.unique(np.concatenate([G.grams(t) for t in samples[lang]]), return_counts=True)
        assert (((model.containing(found[count >= 2]) >> k) & 1) == 1).all()  # no false negatives


def test_correction_of_false_positives(labelled):
    small = G.LanguageFilter(G.frequent(texts(labelled)), places=1 << 8)
    rng = np.random.default_rng(0)
    noise = small.containing(rng.integers(0, 1 << 32, 200_000, dtype=np.uint32))
    assert small.false.max() > 0.05 and small.score(noise).max() < 0.01


def test_defined_results(spark, model, clashing, docs, no_docs):
    data = [(1, None, "aa", "s", 0), (2, "", None, None, None), (3, "12 !!", "aa", "s", 0), (4, "xyzzy qqq wwww", "aa", "s", 0), (5, text("cc", 1, 30_000), None, "s", 0), (None, text("bb", 2), "aa", "s", 0), (6, text("aa", 3), "bb", "s", 0), (6, text("aa", 3), "bb", "s", 0)]
    out = rows(G.identify(spark.createDataFrame(data, SCHEMA), model).select("doc_id", "predicted"))
    assert out == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "und"), (5, "cc"), (None, "bb"), (6, "aa"), (6, "aa")], key=repr)
    assert rows(G.identify(no_docs)) == []
    assert rows(G.identify(clashing)) == rows(G.identify(docs)) and G.identify(docs).count() == docs.count()
    assert {r.predicted for r in G.identify(spark.createDataFrame([(1, "some text here", None, "s", 0)], SCHEMA)).collect()} == {"und"}


def test_many_languages_and_ties():
    same = {f"l{k:02d}": ["abcd efgh abcd efgh"] for k in range(20)}
    f = G.LanguageFilter(G.frequent(same))
    assert f.masks.dtype == np.uint32 and f.decide(["abcd efgh"])[0][0] == "l00"


def test_more_languages_than_a_mask_holds():
    names = [f"l{k:03d}" for k in range(150)]
    f = G.LanguageFilter(G.frequent({n: [f"{n[1]}{n[2]}{n[3]}".translate(str.maketrans("0123456789", "abcdefghij")) * 3 + " common words"] * 2 for n in names}))
    for k in (3, 70, 149):
        word = f"l{k:03d}"[1:].translate(str.maketrans("0123456789", "abcdefghij")) * 3
        assert f.decide([f"{word} {word}"])[0][0] == f"l{k:03d}"


def brute(data):
    """(doc_id, predicted, n_grams) of all rows of a table with sets in place of filters: what the places of no false positive would give."""
    by = {}
    for r in sorted({(r.lang, G_point(r), r.text) for r in data if r.lang and r.text is not None and r.doc_id is not None}):
        by.setdefault(r[0], []).append(r)
    known = {k: set(v.tolist()) for k, v in G.frequent({k: [t for _, _, t in own[: G.PER_LANGUAGE]] for k, own in by.items()}).items()}
    out = []
    for r in data:
        own = G.grams(r.text or "").tolist()
        share = {k: sum(g in v for g in own) / max(1, len(own)) for k, v in known.items()}
        best = min(share, key=lambda k: (-share[k], k)) if share else "und"
        out.append((r.doc_id, best if len(own) >= G.LEAST_GRAMS and share and share[best] >= G.LEAST_SCORE else "und"))
    return out


def G_point(r):
    import hashlib

    return int(hashlib.md5(f"{G.SEED}|{r.doc_id}".encode()).hexdigest()[:13], 16)


@pytest.mark.skipif(not Path(SF).exists(), reason="the tables aren't here")
def test_the_query_against_brute_force(spark):
    data = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want, got = brute(data), [(r.doc_id, r.predicted) for r in G.query(spark, SF).collect()]
    assert len(got) == len(want) and sum(a == b for a, b in zip(sorted(got, key=repr), sorted(want, key=repr))) >= 0.99 * len(want)
