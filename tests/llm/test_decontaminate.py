
import numpy as np
import pytest

from entspark.llm import decontaminate as D
from entspark.llm import kernels as K
from entspark.llm.fm_index import FMIndex, WaveletMatrix, suffix_array

from .conftest import SCHEMA, prose, rows


def brute(docs, items, n=D.N, least=D.LEAST_WORDS):
    phrases = {}
    for i, t in items:
        w = K.WORD.findall((t or "").lower())
        size = min(n, len(w))
        if len(w) >= least:
            for k in range(len(w) - size + 1):
                phrases.setdefault((size, tuple(w[k : k + size])), set()).add(i)
    found = set()
    for d, t in docs:
        w = K.WORD.findall((t or "").lower())
        for size in {s for s, _ in phrases}:
            for k in range(len(w) - size + 1):
                for i in phrases.get((size, tuple(w[k : k + size])), ()):
                    found.add((d, k, k + size, i))
    return found


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, prose(900, 40)), (2, prose(901, 14)), (3, "Six words make this whole item"), (4, "too short"), (5, None), (6, ""), (7, prose(900, 40)), (8, prose(902, 9))]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def leaky(spark, docs, benchmark):
    item = {r[0]: r[1] for r in benchmark.collect()}
    more = [
        (50, f"{prose(50, 30)} {item[1]} {prose(51, 30)}", "en", "s0", None),
        (51, f"Start. {item[2].upper()}; {item[2]}", "en", "s0", 1),
        (52, " ".join(item[1].split()[5:20]), None, None, None),
        (53, f"{prose(60, 9)} SIX words, make (this) whole item. {prose(61, 9)}", "en", "s0", None),
        (54, " ".join(item[1].split()[:7]), "en", "s0", None),
        (54, " ".join(item[1].split()[:7]), "en", "s0", None),
    ]
    return docs.unionByName(spark.createDataFrame(more, SCHEMA))


def test_occurrences_like_brute_force(leaky, benchmark):
    got = set(map(tuple, D.occurrences(leaky, benchmark).collect()))
    assert got == brute([(r[0], r[1]) for r in leaky.collect()], benchmark.collect())
    assert {g[0] for g in got} == {50, 51, 52, 53}


def test_spans_merge(leaky, benchmark):
    got = rows(D.spans(leaky, benchmark))
    assert (50, 30, 70, 2) in got and (51, 1, 29, 1) in got and (53, 9, 15, 1) in got


def test_removal(leaky, benchmark):
    out = {r.doc_id: r for r in D.decontaminate(leaky, benchmark).filter("doc_id >= 50").collect()}
    assert out[50].text == f"{prose(50, 30)}  {prose(51, 30)}" and out[50].n_chars == len(out[50].text)
    assert 52 not in out and out[51].text == "Start. "
    assert out[54].text == " ".join(prose(900, 40).split()[:7]) and out[54].n_chars is None


def test_clean_documents_stay_as_they_are(docs, benchmark, clashing):
    assert rows(D.decontaminate(docs, benchmark)) == rows(docs)
    assert rows(D.decontaminate(clashing, benchmark)) == rows(clashing)


def test_empty_tables(spark, docs, no_docs, benchmark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert rows(D.spans(no_docs, benchmark)) == [] and rows(D.spans(docs, nothing)) == []
    assert rows(D.decontaminate(no_docs, benchmark)) == [] and rows(D.decontaminate(docs, nothing)) == rows(docs)


def test_slices_find_the_same(leaky, benchmark, monkeypatch):
    whole = rows(D.spans(leaky, benchmark))
    monkeypatch.setattr(D, "SLICE_CHARS", 150)
    assert rows(D.spans(leaky, benchmark)) == whole


def test_slices_cut_the_same(spark, clashing, monkeypatch):
    """Items that share words, and words that cutting brings together."""
    items, texts = [], []
    for k in range(8):
        a, shared, b = prose(2000 + k, 6), prose(2100 + k, 8), prose(2200 + k, 5)
        items += [f"{a} {shared}", f"{shared} {b}", f"{a} {b}"]
        texts += [f"{prose(2300 + k, 20)} {a} {shared} {b} {prose(2400 + k, 20)}", f"{prose(2500 + k, 9)} {a} {shared} {b}", f"{a} {shared} {b}", f"{a}, {prose(2600 + k, 3)} {b}"]
    # clean words around a passage that are a phrase of their own without it
    items += [f"{prose(2700 + k, 4)} {prose(2800 + k, 4)}" for k in range(8)] + [prose(2900 + k, 9) for k in range(8)]
    texts += [f"{prose(2700 + k, 4)} {prose(2900 + k, 9)} {prose(2800 + k, 4)} end" for k in range(8)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    leaky = spark.createDataFrame([(k // 2 * 2 if k % 5 else None, t, "en", "s0", k if k % 3 else None) for k, t in enumerate(texts)], SCHEMA)
    whole = rows(D.decontaminate(leaky, benchmark))
    odd = clashing.selectExpr("*", "'mine' AS _spans")
    kept = rows(D.decontaminate(odd, benchmark))
    monkeypatch.setattr(D, "SLICE_CHARS", 400)
    assert len(list(D._slices(benchmark))) > 3
    assert rows(D.decontaminate(leaky, benchmark)) == whole and len(whole) == len(texts) - 8
    assert rows(D.decontaminate(odd, benchmark)) == kept == rows(odd)


def test_shards_find_the_same(leaky, benchmark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_WORDS", 50)
    texts = [r[1] for r in leaky.collect()]
    phrases = D.Phrases([(r[0], r[1]) for r in benchmark.collect() if r[1]])
    whole = {(d, p, s) for d, p, s, _ in phrases.find(texts)}
    assert whole == {(k, p, s) for k, t in enumerate(texts) for _, p, s, _ in phrases.find([t])}


def test_suffix_array_and_wavelet_ranks():
    rng = np.random.default_rng(1)
    for _ in range(30):
        text = rng.integers(0, 5, rng.integers(1, 120))
        seps = np.cumsum(text == 0)
        key = lambda i: [(0, seps[j]) if text[j] == 0 else (1, text[j]) for j in range(i, len(text))]  # noqa: B023, E731
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=key)
        w = WaveletMatrix(text, 5)
        at, sym = rng.integers(0, len(text) + 1, 40), rng.integers(0, 5, 40)
        assert w.rank(sym, at).tolist() == [int((text[:a] == s).sum()) for a, s in zip(at, sym)]


def test_search_and_locate():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 500)
    index = FMIndex(text, 4)
    phrases = np.array([[a, b, c] for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)])
    which, low, high = index.search(phrases)
    for w, a, b in zip(which, low, high):
        want = [i for i in range(len(text) - 2) if text[i : i + 3].tolist() == phrases[w].tolist()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_cutting_where_lower_case_is_longer():
    text = "İİ one two three"
    assert D.cut_words(text, [(1, 3)]) == "İİ  three"
