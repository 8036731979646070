import itertools

import pytest

from entspark.llm import license_scan as L

from .conftest import SCHEMA, prose, rows


@pytest.mark.parametrize(
    ("text", "normal", "category"),
    [
        ("MIT", "MIT", "permissive"),
        ("mit or gpl-3.0-only", "MIT OR GPL-3.0-only", "permissive"),
        ("MIT AND GPL-3.0-only", "MIT AND GPL-3.0-only", "copyleft"),
        ("GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only WITH Classpath-exception-2.0", "weak-copyleft"),
        ("(MIT OR Apache-2.0) AND CC-BY-NC-4.0", "(MIT OR Apache-2.0) AND CC-BY-NC-4.0", "restricted"),
        ("MIT OR Apache-2.0 AND CC-BY-NC-4.0", "MIT OR Apache-2.0 AND CC-BY-NC-4.0", "permissive"),
        ("MIT AND Own-License", "MIT AND Own-License", "unknown"),
    ],
)
def test_expressions(text, normal, category):
    out, k = L.evaluate(L.parse(text))
    assert (out, L.CATEGORIES[k]) == (normal, category)


@pytest.mark.parametrize("text", ["", "AND", "MIT MIT", "(MIT", "MIT)", "MIT AND", "OR MIT", "()", "MIT WITH", "(MIT OR ISC) WITH x", "MIT ; ISC"])
def test_unreadable(text):
    with pytest.raises(ValueError):
        L.evaluate(L.parse(text))


def test_like_brute_force_evaluation():
    names = {"MIT": 1, "GPL-3.0-only": 3, "CC-BY-NC-4.0": 4}
    for a, b, c in itertools.product(names, repeat=3):
        for x, y in itertools.product(("AND", "OR"), repeat=2):
            fx, fy = max if x == "AND" else min, max if y == "AND" else min
            flat = fy(fx(names[a], names[b]), names[c]) if (x, y) != ("OR", "AND") else fx(names[a], fy(names[b], names[c]))
            assert L.evaluate(L.parse(f"{a} {x} {b} {y} {c}"))[1] == flat
            assert L.evaluate(L.parse(f"{a} {x} ({b} {y} {c})"))[1] == fx(names[a], fy(names[b], names[c]))


def test_findings():
    assert L.findings("Released under the\n  MIT   License.") == {"MIT": 1}
    assert L.findings("I submit licenses") == {} and L.findings("mit licensed") == {}
    assert L.findings("GNU Lesser General Public License, version 3") == {"LGPL-3.0-only": 2}
    assert L.findings("# SPDX-License-Identifier: MIT OR Apache-2.0\ncode") == {"MIT OR Apache-2.0": 1}
    assert L.findings("SPDX-License-Identifier: MIT and then prose follows") == {"MIT": 1}
    assert L.findings("SPDX-License-Identifier: (MIT OR ISC) WITH x-1 */") == {"MIT OR ISC": 1}
    many = " OR ".join(["MIT"] * 5_000)
    assert L.findings(f"SPDX-License-Identifier: {many}") == {many: 1}
    assert L.findings("SPDX-License-Identifier: ???") == {L.UNREADABLE: 5}
    assert L.findings("SPDX-License-Identifier:") == {L.UNREADABLE: 5}


@pytest.mark.parametrize(
    ("tag", "normal", "category"),
    [
        ("MIT AND OpenSSL", "MIT AND OpenSSL", "unknown"),
        ("MIT OR WTFPL", "MIT OR WTFPL", "permissive"),
        ("NCSA OR MIT", "NCSA OR MIT", "permissive"),
        ("NCSA AND MIT */", "NCSA AND MIT", "unknown"),
        ("mit and openssl", "MIT AND openssl", "unknown"),
        ("(MIT AND Foo) OR GPL-3.0-only", "MIT AND Foo OR GPL-3.0-only", "copyleft"),
        ("(Foo OR MIT) AND Bar -->", "(Foo OR MIT) AND Bar", "unknown"),
        ("MIT AND Foo, see the notice", "MIT AND Foo", "unknown"),
        ("MIT AND Foo see the notice", "MIT AND Foo", "unknown"),
        ("GPL-2.0-only WITH Own", "GPL-2.0-only WITH Own", "weak-copyleft"),
        *((x, x, "unknown") for x in ("Ruby", "PostgreSQL", "Vim", "curl", "Beerware", "Proprietary")),
        ("Ruby is the license", "Ruby", "unknown"),
        ("see the file", L.UNREADABLE, "unknown"),
        ("MIT and others follow", "MIT", "permissive"),
        ("MIT -- see", "MIT", "permissive"),
        ("--", L.UNREADABLE, "unknown"),
        ("AND MIT", L.UNREADABLE, "unknown"),
    ],
)
def test_unknown_identifiers_stay(tag, normal, category):
    assert L.findings(f"# SPDX-License-Identifier: {tag}\nand code") == {normal: L.CATEGORIES.index(category)}


def test_table(spark, docs, clashing, no_docs):
    more = [(70, f"{prose(1, 20_000)} Apache License, Version 2.0 {prose(2, 20)} CC BY-NC 4.0", "en", "s", 1), (71, "MIT License", "en", "s", 1), (71, "MIT License", "en", "s", 1), (None, "ISC License", None, None, None)]
    out = rows(L.scan_licenses(docs.unionByName(spark.createDataFrame(more, SCHEMA))))
    assert out == sorted([(70, "Apache-2.0 AND CC-BY-NC-4.0", 2, "restricted"), (71, "MIT", 1, "permissive"), (71, "MIT", 1, "permissive"), (None, "ISC", 1, "permissive")], key=repr)
    assert rows(L.scan_licenses(docs)) == [] and rows(L.scan_licenses(clashing)) == [] and rows(L.scan_licenses(no_docs)) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SPDX-License-Identifier: MIT OR\n  Apache-2.0\ncode", {"MIT OR Apache-2.0": 1}),
        ("# SPDX-License-Identifier: MIT AND\n# GPL-3.0-only\n# other", {"MIT AND GPL-3.0-only": 3}),
        (" * SPDX-License-Identifier: (MIT\r\n *   OR Apache-2.0) AND\r\n *   Foo-1\r\n */", {"(MIT OR Apache-2.0) AND Foo-1": 5}),
        ("SPDX-License-Identifier: MIT\nOR not", {"MIT": 1}),
        ("SPDX-License-Identifier: GPL-3.0-only OR MIT", {"GPL-3.0-only OR MIT": 1}),
        ("under CC-BY-NC-4.0.", {"CC-BY-NC-4.0": 4}), ("It is GPLv3.", {"GPL-3.0-only": 3}), ("GPL-3.0", {"GPL-3.0-only": 3}), ("Licensed under MIT.", {"MIT": 1}), ("Licensed under the MIT license", {"MIT": 1}),
        ("GPL-3.0.1 and xgpl-3.0 and mpl-2.0-like", {}), ("Apache-2.0, MPL-2.0; LGPL-3.0", {"Apache-2.0": 1, "MPL-2.0": 2, "LGPL-3.0-only": 2}),
        ("SPDX-License-Identifier: MIT AND Proprietary", {"MIT AND Proprietary": 5}), ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND Foo", {"(MIT OR Apache-2.0) AND Foo": 5}), ("SPDX-License-Identifier: MIT OR Beerware", {"MIT OR Beerware": 1}),
    ],
)
def test_wrapped_tags_and_versions(text, want):
    assert L.findings(text) == want


def test_long_tags_take_linear_time():
    import time

    began = time.perf_counter()
    L.findings("SPDX-License-Identifier: " + "(MIT OR\n" * 20_000)
    L.findings("SPDX-License-Identifier: MIT\n" * 20_000)
    assert time.perf_counter() - began < 20


def test_phrases_like_the_sql(spark):
    import duckdb

    texts = [f"before {phrase.upper()}{end}" for phrase in L.PHRASES for end in (" after", ".", ", and", "-x", "1", ".5 b")] + [" ".join(list(L.PHRASES)[k::7]) for k in range(7)]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    frame = spark.createDataFrame([(k, t, "", "", 0) for k, t in enumerate(texts)], SCHEMA)
    assert rows(L.scan_licenses(frame)) == sorted(db.sql(f"SELECT doc_id, expression, n_licenses, category FROM ({L.ORACLE})").fetchall(), key=repr)
