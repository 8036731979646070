import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from entspark.llm import mixing as X

from .conftest import SCHEMA, rows


def brute(data, weights=None, budget=1.0, temperature=0.5):
    size = Counter()
    for r in data:
        size[r[3]] += (r[4] if r[4] is not None else len(r[1] or "")) + 1
    w = {s: (n**temperature if weights is None else weights.get(s, 0.0)) for s, n in size.items()}
    out = []
    for r in data:
        rate = w[r[3]] / sum(w.values()) * budget * sum(size.values()) / size[r[3]] if sum(w.values()) else 0
        ident = str(r[0]) if r[0] is not None else hashlib.md5(r[1].encode()).hexdigest() if r[1] is not None else ""
        parts, count = max(1, math.ceil(rate / X.LARGEST_RATE)), 0
        for j in range(1, parts + 1):
            u = int(hashlib.md5(f"{X.SEED}|{ident}|{j}".encode()).hexdigest()[:13], 16) / 2**52
            lam, k = rate / parts, 0
            p = c = math.exp(-lam)
            while c <= u and k < lam + 12 * math.sqrt(lam) + 20:
                k += 1
                p *= lam / k
                c += p
            count += k
        out += [(r[0], r[1], k) for k in range(1, count + 1)]
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r.doc_id, r.text, r.copy) for r in frame.collect()), key=repr)


def test_like_brute_force(docs):
    assert got(X.mix(docs)) == brute(docs.collect())


@pytest.mark.parametrize("budget", [0.0, 3.0, 900.0])
def test_weights_and_large_rates(docs, budget):
    few = docs.filter("doc_id < 12 OR doc_id IS NULL")
    weights = {"s0": 3.0, "s1": 1.0, None: 2.0}
    assert got(X.mix(few, weights, budget=budget)) == brute(few.collect(), weights, budget)


def test_weights_are_met(spark):
    data = [(k, "word " * 20, "en", f"s{int(k % 10 == 0)}", None) for k in range(4_000)]
    frame = spark.createDataFrame(data, SCHEMA)
    n = dict(X.mix(frame, {"s0": 0.25, "s1": 0.75}).groupBy("source").count().collect())
    assert abs(n["s1"] / sum(n.values()) - 0.75) < 0.03 and abs(sum(n.values()) / 4_000 - 1) < 0.05


def test_global_order_mixes_sources(spark):
    frame = spark.createDataFrame([(k, "text", "en", f"s{k // 500}", None) for k in range(1_000)], SCHEMA)
    first = [r.source for r in X.mix(frame).limit(100).collect()]
    assert 25 < first.count("s0") < 75


def test_columns_stay_and_clashing_ones_give_way(clashing, docs):
    out = X.mix(clashing)
    assert set(out.columns) == set(clashing.columns) and {r._key for r in out.collect()} == {"mine-_key"} and out.filter(F.col("copy").cast("string").startswith("mine")).count() == 0
    assert got(out) == got(X.mix(docs))


def test_empty(no_docs, docs):
    assert rows(X.mix(no_docs)) == [] and rows(X.mix(docs, {})) == []
