import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "amber basin cedar delta ember fjord grove haven inlet jetty knoll larch mason noble ocean piano quilt raven solar tulip umbra vigil wharf xenon yacht zebra".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(("", "s", "ed", "ly", "ing")) for _ in range(words))


@pytest.fixture(scope="session")
def docs(spark):
    """Plain documents, nulls, empty and blank texts, copies, near copies, a repeated row, a very long text."""
    rows = [(k, prose(k, 40 + k), "en", f"s{k % 3}", None) for k in range(12)]
    base = prose(100, 80).split()
    rows += [(20, " ".join(base), "en", "s0", None), (21, " ".join(base), "en", "s1", None), (22, " ".join(base[:-6] + ["changed"] * 2), None, None, 5), (23, "  ".join(w.upper() for w in base) + "!", "en", "s0", 0)]
    rows += [(30, None, "en", "s0", None), (31, "", "en", "s0", 0), (32, " \n ", None, None, None), (None, prose(101, 30), "en", "s0", None), (None, None, None, None, None), (33, "one", "de", "s1", 3), (34, "One!", "de", "s1", 4)]
    rows += [(40, prose(102, 20_000), "en", "s2", None), (41, prose(103, 50), "fr", "s2", 7), (41, prose(103, 50), "fr", "s2", 7)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = "sid size prefix part block payload rule blob at todo copy shuffle_key _key _count _draws _cdf _identity _point _blob _flagged _quality _pool identity score keep quality label start tile group_id u root item_id first_word".split()
    return docs.withColumns({n: F.lit(f"mine-{n}") for n in names})


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)
