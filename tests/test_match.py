import random

from entspark.operators import match as M

TEXTS = "scope string, entity_type string, id string, ordinal int, content string, file_path string"


def texts(n, seed):
    """Texts of all sizes, near copies and copies among them."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            words = out[r.randrange(len(out))].split()
            for _ in range(r.choice((0, 0, 1, 2, 4))):
                words[r.randrange(len(words))] = f"w{r.randrange(400)}"
            if r.random() < 0.3:
                words += [f"w{r.randrange(400)}"]
        else:
            words = [f"w{min(r.randrange(400), r.randrange(400))}" for _ in range(r.choice((1, 2, 5, 9, 30, 31, 33, 70, 150)))]
        out.append(" ".join(words))
    return out


def similar(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b), len(a | b)


def test_near_sets_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_SETS", 7)  # bands are cut in parts
    rows = [("xy"[k % 2], k, t) for k, t in enumerate(texts(160, 1))]
    least = {}
    for kind, k, t in rows:
        least.setdefault((kind, frozenset(t.split())), k)
    want = set()
    for kind, k, t in rows:
        first = least[kind, frozenset(t.split())]
        if first != k:
            want.add((kind, first, k, *similar(t, t)))
            continue
        for other, j, u in rows:
            if other == kind and j > k and least[kind, frozenset(u.split())] == j:
                inter, union = similar(t, u)
                if 5 * inter >= 4 * union:
                    want.add((kind, k, j, inter, union))
    found = [tuple(r) for r in M.near_sets(spark.createDataFrame(rows, "entity_type string, id long, content string")).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def greedy(before, after):
    taken, out = set(), set()
    for _, a, t in sorted(after):
        best = None
        for ordinal, b, u in before:
            inter, union = similar(t, u)
            if b not in taken and 5 * inter >= 4 * union:
                best = min(x for x in (best, (-inter / union, ordinal, b)) if x)
        if best:
            taken.add(best[2])
            out.add((best[2], a))
    return out


def test_greedy_matches_are_those_of_brute_force(spark, monkeypatch):
    both = [(k * 7 % 150, f"e{k}", t) for k, t in enumerate(texts(150, 2))]
    before, after = both[::2], both[1::2]
    frame = lambda rows: spark.createDataFrame([("s", "t", i, o, t, "f") for o, i, t in rows], TEXTS)
    for most in (M.ONE_GROUP, 1):  # in one group, and in connected parts
        monkeypatch.setattr(M, "ONE_GROUP", most)
        found = M.match_by_similarity(frame(before), frame(after)).select("b_id", "a_id").collect()
        assert set(map(tuple, found)) == greedy(before, after) and len(found) > 10


def test_copies_are_one_class(spark):
    """Two hundred copies against as many are one pair of classes, not 40,000 pairs."""
    rows = [("k", k % 2, f"e{k}", "a b c d e") for k in range(400)] + [("k", 0, "x", "a b c d e f"), ("other", 1, "y", "a b c d e")]
    members, pairs = M.similar_classes(spark.createDataFrame(rows, "kind string, side int, id string, content string"), 0.8)
    assert members.count() == 402 and sorted((r.inter, r.size_union) for r in pairs.collect()) == [(5, 5), (5, 6)]


def test_parent_names_without_broadcasts(spark):
    """Chains, cycles of all lengths and ways into them; what walks carry doesn't grow, and no join sends it to the driver."""
    parents = {"a": None, "b": "a", "c": "b", "s": "s", "u": "v", "v": "u", "p": "q", "q": "r", "r": "p", "x": "p", "y": "x", "z": "y", "d": "none"} | {f"l{k}": f"l{k - 1}" if k else None for k in range(12)}
    nodes = spark.createDataFrame([("f", i, i.upper() if i != "b" else "", p) for i, p in parents.items()], "scope string, id string, name string, parent_id string")
    changes = spark.createDataFrame([("f", f"c{k}", p) for k, p in enumerate([*parents, "c", "gone", None])], "scope string, id string, parent_id string")

    def want(at):
        names, seen = [], set()
        while at in parents and at not in seen:
            seen.add(at)
            names.append(at.upper() if at != "b" else "")
            at = parents[at]
        return "::".join(n for n in reversed(names) if n) or None

    found = M.with_parent_names(changes, nodes, nodes.limit(0))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert len(rows) == changes.count() and all(r.parent_name == want(r.parent_id) for r in rows)
