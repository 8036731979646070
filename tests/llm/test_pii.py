import itertools
import re
from pathlib import Path

import numpy as np
import pytest

from entspark.llm import pii as P

from .conftest import SCHEMA, prose, rows


SF = "/root/testdata/sf0.01"


def brute(local, edges, pair):
    n, labels = local.shape
    total = np.zeros((n, labels))
    for y in itertools.product(range(labels), repeat=n):
        s = sum(local[k, c] for k, c in enumerate(y)) + sum(p[y[i], y[j]] for (i, j), p in zip(edges, pair))
        for k, c in enumerate(y):
            total[k, c] += np.exp(s)
    return total / total.sum(1, keepdims=True)


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(0)
    for edges in ([(0, 1), (1, 2), (2, 3)], [(0, 1), (0, 2), (0, 3), (3, 4)], [(1, 0)]):
        n = 1 + max(max(e) for e in edges)
        local, pair = rng.normal(size=(n, 3)), rng.normal(size=(len(edges), 3, 3))
        assert np.allclose(P.marginals(local, np.array(edges), pair), brute(local, edges, pair), atol=1e-3)


def test_messages_on_loops_are_near():
    rng = np.random.default_rng(1)
    for _ in range(20):
        edges = [(0, 1), (1, 2), (2, 3), (0, 2), (1, 3)]
        local, pair = rng.normal(size=(4, 3)), rng.normal(size=(5, 3, 3)) * 0.5
        assert np.abs(P.marginals(local, np.array(edges), pair) - brute(local, edges, pair)).max() < 0.15


def test_runs_of_plain_words_are_summed_out_exactly():
    w = P.weights()
    plain = w.emit[0] + w.emit[1]
    rng = np.random.default_rng(2)
    ends = rng.normal(size=(2, len(P.LABELS)))
    for gap in (0, 1, 2, 3, 70, 200):
        local = np.vstack([ends[:1], *[plain[None]] * gap, ends[1:]])
        full = P.marginals(local, np.array([(i, i + 1) for i in range(gap + 1)]), np.array([w.chain] * (gap + 1)))
        short = P.marginals(ends, np.array([(0, 1)]), w.run(gap)[None])
        assert np.allclose(full[[0, -1]], short, atol=1e-3)


def test_a_document_does_not_hang_on_its_batch():
    import random

    rng = random.Random(4)
    texts = [" ".join(P._document(rng)[0] for _ in range(1 + k % 7)) for k in range(120)]
    together = P.entities(texts)
    alone = [(k, *rest) for k, t in enumerate(texts) for _, *rest in P.entities([t])]
    assert [x[:4] for x in together] == [x[:4] for x in alone] and max(abs(a[4] - b[4]) for a, b in zip(together, alone)) < 1e-9


def labelled(text):
    return [(text[a:b], label) for _, a, b, label, _ in P.entities([text])]


def test_entities():
    assert labelled("write to jo.12@mail3.example.com, or call +1 (724) 555-7058.") == [("jo.12@mail3.example.com", "EMAIL"), ("+1 (724) 555-7058", "PHONE")]
    assert labelled("from 43.203.110.141 with 4111111111111111") == [("43.203.110.141", "IP"), ("4111111111111111", "CARD")]
    assert labelled("not 4111111111111112 nor 300.1.2.999 nor 1.2.3 nor user@ nor 2024-01-02 nor 17") == []
    assert labelled("ssn 123-45-6789") == [("123-45-6789", "SSN")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("(kim.12@abc1.example.com)", [("kim.12@abc1.example.com", "EMAIL")]), ("email:kim@abc.org", [("kim@abc.org", "EMAIL")]), ("tel:555-123-4567", [("555-123-4567", "PHONE")]), ("10.0.0.1:8080", [("10.0.0.1", "IP")]), ("ip=10.0.0.1", [("10.0.0.1", "IP")]),
        ("a@x.com,b@y.com", [("a@x.com", "EMAIL"), ("b@y.com", "EMAIL")]), ("a,b@c.com,555-123-4567,7", [("b@c.com", "EMAIL"), ("555-123-4567", "PHONE")]), ('{"email":"a1@b.com","n":12}', [("a1@b.com", "EMAIL")]), ("Foo<foo@bar.com>", [("foo@bar.com", "EMAIL")]),
        ("4111 1111 1111 1111", [("4111 1111 1111 1111", "CARD")]), ("2001:db8:85a3::8a2e:370:7334", [("2001:db8:85a3::8a2e:370:7334", "IP")]), ("jose@m\u00fcller.de", [("jose@m\u00fcller.de", "EMAIL")]), ("+44 20 7946 0958", [("+44 20 7946 0958", "PHONE")]), ("call 724 555 7058 now", [("724 555 7058", "PHONE")]),
        ("\u8054\u7cfb\u90ae\u7bb1foo@bar.com\u8bf7", [("foo@bar.com", "EMAIL")]), ("x" * 400 + "@" + "y" * 400, []), ("z" * 330 + ",me@host.org", [("me@host.org", "EMAIL")]), ("phone" + " " * 300 + "+1 (724) 555-7058", [("+1 (724) 555-7058", "PHONE")]),
        ("time 12:30:45 and 00:1B:44:11:3A:B7", []), ("rows 12 15 18 22 41 and 1999 2004 2020", []), ("costs 1,234,567 or $12.50", []), ("see 10/12/2024 page 44", []), ("Abc::Def v1.2.3.4", []),
    ],
)
def test_what_is_glued_and_grouped(text, want):
    assert labelled(text) == want


@pytest.mark.parametrize("piece", [" 9", "a1", "1.", ":1", "1 ", "1-", "(1) ", "a@", "4111 ", "+1 ", "a1,", "x", "::"])
def test_long_texts_take_linear_time(piece):
    import time

    began = time.perf_counter()
    P.entities([piece * 10_000])
    assert time.perf_counter() - began < 20


def test_a_distant_mention_makes_a_weak_token_consistent():
    rest = " ".join(["word"] * 60)
    alone, both = f"{rest} 555-7058 {rest}", f"call +1 (724) 555-7058 now {rest} 555-7058 {rest}"
    assert labelled(alone) == [] and [x for x, _ in labelled(both)] == ["+1 (724) 555-7058", "555-7058"]


def test_held_out_accuracy():
    """Sentences, rows and objects that the training generator doesn't make."""
    import random

    rng = random.Random(99)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    found = wrong = missed = 0
    for k in range(300):
        mail, phone, ip = f"user{d(3)}@corp-{d(2)}.example.net", rng.choice((f"+49 30 {d(8)}", f"(0{d(2)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}")), f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}"
        text = rng.choice((f"On 2023-0{k % 9 + 1}-12 Kim wrote from {ip}; reply to <{mail}> or ring {phone}, room {d(3)}.", f"id,{d(5)},{mail},{ip},{phone},{d(2)}.{d(2)}", f'{{"user": "{mail}", "tel": "{phone}", "host": "{ip}", "size": {d(4)}, "version": "1.{d(1)}.{d(2)}"}}'))
        got, want = {x for x, _ in labelled(text)}, {mail, phone, ip}
        found, wrong, missed = found + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert found / (found + missed) > 0.95 and found / (found + wrong) > 0.95


@pytest.mark.skipif(not Path(SF).exists(), reason="the tables aren't here")
def test_the_query_against_plain_patterns(spark):
    """All that an unmistakable pattern finds in the table, and nothing that has no digit and no @."""
    data = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text}
    got = {}
    for r in P.query(spark, SF).collect():
        got.setdefault((r.doc_id, r.label), []).append(data[r.doc_id][r.start : r.stop])
    sure = {"EMAIL": r"[0-9A-Za-z][0-9A-Za-z._]*@[0-9A-Za-z]+\.[a-z]+\.[a-z]+\b", "IP": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![0-9.])", "PHONE": r"\+\d \(\d{3}\) \d{3}-\d{4}"}
    want = {(i, label): found for i, t in data.items() for label, pattern in sure.items() if (found := re.findall(pattern, t))}
    assert want and sum(sorted(got.get(k, [])) == sorted(v) for k, v in want.items()) >= 0.99 * len(want)
    assert all(any(c in "0123456789@" for c in x) for own in got.values() for x in own)
    assert {k[0] for k in got} - {k[0] for k in want} <= {i for i, t in data.items() if re.search(r"\d{13}|\d{4}[- ]\d{4}|\d{3}[-. ]\d", t)}


def test_table(spark, docs, clashing, no_docs):
    more = [(80, f"{prose(1, 20_000)} a.b@c1.example.com", "en", "s", 0), (81, "x" * 200_000 + " 9" * 3_000, "en", "s", 0), (82, "1.2.3.4", None, None, None), (82, "1.2.3.4", None, None, None), (None, "me@host.org", "en", "s", 0)]
    out = P.find_pii(docs.unionByName(spark.createDataFrame(more, SCHEMA)))
    assert sorted(((r.doc_id, r.label) for r in out.collect()), key=repr) == sorted([(80, "EMAIL"), (82, "IP"), (82, "IP"), (None, "EMAIL")], key=repr)
    assert rows(P.find_pii(docs)) == rows(P.find_pii(clashing)) == [] and rows(P.find_pii(no_docs)) == []
