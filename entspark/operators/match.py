"""Matching the entities of two snapshots.

The cascade: equal ids; then one-to-one pairs of equal content hash; then of
equal structural hash; then the most similar token sets; what is left was added
or deleted.  Each phase is an equi-join on what the phases before left over
(anti-joins), so nothing is compared all against all.

Entities match within one ``scope``: the column that names the pair of files
they come from, or a constant for snapshots that are compared as a whole.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut, parts, spread

SIMILARITY = 0.8
#: Candidates up to this number are chosen from in one group; more in the connected parts of their graph, with the same result.
ONE_GROUP = 1_000_000
#: Sets of one band of sizes that a task compares at once with as many others; cells (pairs of sets) that are compared in one step.
PART_SETS, CELLS = 16_384, 1 << 17
#: Cells that a task should compare; up to so many ids are broadcast.
TASK_CELLS, BROADCAST_IDS = 200_000_000, 200_000


def latest_occurrence(entities: DataFrame) -> DataFrame:
    """One row an id: the last in order of extraction."""
    w = W.partitionBy("scope", "id").orderBy(F.desc("ordinal"), F.desc("content_hash"))
    return entities.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _side(entities: DataFrame, prefix: str) -> DataFrame:
    return entities.select("scope", *(F.col(c).alias(prefix + c) for c in entities.columns if c != "scope"))


def match_by_id(before: DataFrame, after: DataFrame) -> DataFrame:
    """All pairs of equal ids, with b_ and a_ columns."""
    b, a = _side(before, "b_"), _side(after, "a_").withColumnRenamed("scope", "_scope")
    return b.join(a, F.expr("scope = _scope AND b_id = a_id")).drop("_scope")


def residual(side: DataFrame, matched: DataFrame, id_column: str) -> DataFrame:
    """What no pair has."""
    return side.join(matched.select("scope", F.col(id_column).alias("id")), ["scope", "id"], "left_anti")


def match_by_key(before: DataFrame, after: DataFrame, key: str, last_first: bool) -> DataFrame:
    """One-to-one pairs of equal ``key``: the k-th after entity with the k-th before entity, from the last or the first on; nulls never match."""
    order = F.desc if last_first else F.asc
    rank_b = F.row_number().over(W.partitionBy("scope", key).orderBy(order("ordinal"), order("id")))
    rank_a = F.row_number().over(W.partitionBy("scope", key).orderBy("ordinal", "id"))
    b = _side(before.filter(F.col(key).isNotNull()).withColumn("_rank", rank_b), "b_")
    a = _side(after.filter(F.col(key).isNotNull()).withColumn("_rank", rank_a), "a_").withColumnRenamed("scope", "_scope")
    return b.join(a, F.expr(f"scope = _scope AND b_{key} = a_{key} AND b__rank = a__rank")).drop("_scope", "b__rank", "a__rank")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) of all vertices of the undirected edges (u, v), the root the least: alternating large-star and small-star until nothing changes.

    No vertex' neighbours are collected: a star is a minimum, summed up before
    the shuffle, and a join of the edges with it.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        rest = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return rest.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    e, before = edges.filter("u <> v").distinct(), None
    while True:
        e = cut(small(large(e)))
        now = e.agg(F.count("*"), total).first()
        if now == before:
            return e.select("u", F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("u"), F.col("v").alias("root"))).distinct()
        before = now


_SKETCH = "kind string, side int, id {id}, n int, shape long, map binary"


def _hashed(content: str) -> Column:
    """The sorted 64-bit hashes of a text's words."""
    return F.array_sort(F.array_distinct(F.transform(T.tokens(content), lambda w: F.xxhash64(w))))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words' hashes become a bitmap of two to four bits a word, a power of two of 64-bit words."""
    for batch in batches:
        *rest, arrays = batch.columns
        values, ends = arrays.values.to_numpy(zero_copy_only=False).view(np.uint64), arrays.offsets.to_numpy()
        maps = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            words = 1 << max(0, math.ceil(math.log2((b - a) / 32)))
            bit = (values[a:b] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) % np.uint64(64 * words)
            out = np.zeros(words, np.uint64)
            np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
            maps.append(out.tobytes())
        yield pa.RecordBatch.from_arrays([*rest, pa.array(maps, pa.binary())], names=["kind", "side", "id", "n", "shape", "map"])


def _folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps in the width of the narrowest: a bit's place there is its place modulo that width."""
    words = min(map(len, maps)) // 8
    out = np.empty((len(maps), words), np.uint64)
    for k, m in enumerate(maps):
        out[k] = np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, words), axis=0)
    return out


def _may_be_similar(rows: list[tuple], t: float) -> list[tuple[int, int]]:
    """Of a block's rows (role, side, shape, n, map), pairs of shapes whose bitmaps don't rule out the threshold; of different sides, if there are sides, that of side 0 first."""
    role, side, shape, n = (np.array([r[k] for r in rows], np.int64) for k in range(4))
    maps = _folded([r[4] for r in rows])
    own = not role.any()
    left, right = (np.flatnonzero(role == k) for k in ((0, 0) if own else (0, 1)))
    left, right = left[np.argsort(n[left], kind="stable")], right[np.argsort(n[right], kind="stable")]
    if not len(left) or not len(right):
        return []
    count, sided = np.bitwise_count(maps).sum(1, dtype=np.int64), bool((side >= 0).any())
    share, half = t / (1 + t), max(1, maps.shape[1] // 2)
    a, b = np.ascontiguousarray(maps[left].T), np.ascontiguousarray(~maps[right].T)
    na, nb = n[left], n[right]
    room, less = (na - share * na + 1e-3 + 1e-6 * na).astype(np.float32), (share * nb - 1e-6 * nb).astype(np.float32)
    found: list[tuple[int, int]] = []
    step = max(1, CELLS // len(right))
    for i in range(0, len(left), step):
        j = min(i + step, len(left))
        lo, hi = int(np.searchsorted(nb, t * na[i] - 1e-6)), int(np.searchsorted(nb, na[j - 1] / t + 1e-6, side="right"))
        if own:
            lo = max(lo, i + 1)
        if lo >= hi:
            continue
        missing = np.zeros((j - i, hi - lo), np.uint32)
        for w in range(half):
            missing += np.bitwise_count(a[w, i:j, None] & b[w, None, lo:hi])
        x, y = np.nonzero(missing <= room[i:j, None] - less[None, lo:hi])
        x, y = x + i, y + lo
        keep = x < y if own else np.ones(len(x), bool)
        if sided:
            keep &= side[left[x]] != side[right[y]]
        x, y = x[keep], y[keep]
        for k in range(0, len(x), CELLS):
            p, q = left[x[k : k + CELLS]], right[y[k : k + CELLS]]
            lost = np.bitwise_count(maps[p] & ~maps[q]).sum(1, dtype=np.int64)
            most = np.minimum(n[p] - lost, n[q] - (lost + count[q] - count[p]))
            fits = most >= share * (n[p] + n[q]) - 1e-6
            p, q = p[fits], q[fits]
            if sided:
                p, q = np.where(side[p] == 0, p, q), np.where(side[p] == 0, q, p)
            found += zip(shape[p].tolist(), shape[q].tolist())
    return found


def _blocks(t: float):
    """Rows sorted by block -> (kind, x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def solved():
            pairs = _may_be_similar(rows, t) if len(rows) > 1 else []
            for k in range(0, len(pairs), 100_000):
                part = pairs[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(part), pa.string()), pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], names=["kind", "x", "y"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:5] != key:
                    yield from solved()
                    key, rows = row[:5], []
                rows.append(row[5:])
        yield from solved()

    return run


def _placed(classes: DataFrame, t: float) -> tuple[DataFrame, int]:
    """Each class in all blocks that it is compared in, and how many tasks these are worth.

    Sets at the threshold are of one band of sizes (of ratio 1/t) or of
    neighbouring ones; bands are cut in parts by hash, and a block is two parts.
    """
    band = F.floor(F.log("n") / F.lit(math.log(1 / t)) + 1e-9).cast("int") if t < 1 else F.col("n")
    sets = classes.withColumn("band", band)
    bands = cut(sets.groupBy("kind", "band").agg(F.count("*").alias("m"), F.ceil(F.count("*") / PART_SETS).cast("int").alias("g")))
    w = W.partitionBy("kind").orderBy("band")
    at = lambda f, d, c: F.coalesce(F.when(f("band").over(w) == F.col("band") + d, f(c).over(w)), F.lit(0))
    sized = cut(bands.select("kind", "band", "m", "g", at(F.lead, 1, "g").alias("up"), at(F.lag, -1, "g").alias("down"), at(F.lead, 1, "m").alias("m_up")))
    cells = sized.agg(F.sum(F.col("m").cast("double") * (F.col("m") / 2 + F.col("m_up")))).first()[0] or 0
    me = F.pmod("shape", "g").cast("int")
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    block = lambda b1, g1, b2, g2, role: F.struct(b1.alias("b1"), g1.alias("g1"), b2.alias("b2"), g2.alias("g2"), F.lit(role).alias("role"))
    b, own = F.col("band"), F.col("me")
    within = F.transform(upto("g"), lambda x: F.when(x >= own, block(b, own, b, x, 0)).otherwise(block(b, x, b, own, 1)))
    every = F.concat(within, F.transform(upto("up"), lambda x: block(b, own, b + 1, x, 0)), F.transform(upto("down"), lambda x: block(b - 1, x, b, own, 1)))
    placed = sets.join(sized, ["kind", "band"]).withColumn("me", me).select("kind", F.explode(every).alias("at"), "side", "shape", "n", "map").select("kind", "at.*", "side", "shape", "n", "map")
    return placed, math.ceil(cells / TASK_CELLS)


def similar_classes(entities: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Members (kind, side, id, n, shape) of classes of equal word sets, and pairs (kind, x, y, inter, size_union) of shapes at the threshold.

    ``entities`` has (kind, side, id, content); kinds don't meet.  Sides 0 and 1
    meet each other only, -1 itself: there a pair is two different shapes.  Of
    each set a bitmap is kept, which bounds the size of an overlap from above, so
    only bitmaps are sent where sets meet.  The word sets themselves are made
    again for the few classes that are left, and intersected.  A word is its
    64-bit hash, and so is a set (its shape).
    """
    spark = entities.sparkSession
    named = entities.filter("kind IS NOT NULL AND content IS NOT NULL").select("kind", F.col("side").cast("int").alias("side"), "id", _hashed("content").alias("words"))
    columns = ["kind", "side", "id", F.size("words").alias("n"), F.xxhash64("words").alias("shape"), "words"]
    sketches = cut(named.filter("size(words) > 0").select(*columns).mapInArrow(_sketch, _SKETCH.format(id=dict(entities.dtypes)["id"])))
    classes = cut(sketches.groupBy("kind", "side", "shape").agg(F.min("n").alias("n"), F.min("map").alias("map"), F.min("id").alias("id")))
    placed, tasks = _placed(classes, threshold)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(tasks, 10_000))
    keys = ["kind", "b1", "g1", "b2", "g2"]
    met = cut(placed.select(*keys, "role", "side", "shape", "n", "map").repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(_blocks(threshold), "kind string, x long, y long"))
    # one member has the words of a class
    ends = met.select("kind", F.col("x").alias("shape")).unionByName(met.select("kind", F.col("y").alias("shape"))).distinct()
    needed = cut(classes.join(ends, ["kind", "shape"]).groupBy("kind", "shape").agg(F.min(F.struct("side", "id")).alias("m")).select("kind", "m.side", "m.id", "shape"))
    few = needed.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    words = cut(named.join(F.broadcast(needed) if few else needed, ["kind", "side", "id"]).groupBy("kind", "shape").agg(F.min("words").alias("words")))
    of = lambda p: words.select("kind", F.col("shape").alias(p), F.col("words").alias("w" + p))
    both = met.join(of("x"), ["kind", "x"]).join(of("y"), ["kind", "y"]).withColumn("inter", F.size(F.array_intersect("wx", "wy"))).withColumn("size_union", F.size("wx") + F.size("wy") - F.col("inter"))
    pairs = both.filter(F.col("inter") >= F.lit(threshold) * F.col("size_union") - 1e-9).select("kind", "x", "y", "inter", "size_union")
    return sketches.drop("map"), pairs


def near_sets(entities: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(entity_type, a, b, inter, size_union) of pairs a < b of entities of one type with similar token sets.

    ``entities`` has (entity_type, id, content), the id a number.  Entities of
    equal sets are one class, for which its least id stands: there is a row of it
    with each other member, and of classes with each other, so a group of copies
    has as many rows as members.
    """
    members, pairs = similar_classes(entities.select(F.col("entity_type").alias("kind"), F.lit(-1).alias("side"), "id", "content"), threshold)
    classes = members.groupBy("kind", "shape").agg(F.min("id").alias("a"))
    copies = members.join(classes, ["kind", "shape"]).filter("id <> a").select(F.col("kind").alias("entity_type"), "a", F.col("id").alias("b"), F.col("n").alias("inter"), F.col("n").alias("size_union"))
    of = lambda p: classes.select("kind", F.col("shape").alias(p), F.col("a").alias("id_" + p))
    met = pairs.join(of("x"), ["kind", "x"]).join(of("y"), ["kind", "y"])
    return met.select(F.col("kind").alias("entity_type"), F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"), "inter", "size_union").unionByName(copies)


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of a group: pairs of classes (x before, y after, score), and members (side, shape, ordinal, id)."""
    pairs, members = rows[rows["side"] < 0], rows[rows["side"] >= 0].sort_values(["ordinal", "id"])
    near: dict = defaultdict(list)
    for kind, x, y, score in zip(pairs["kind"], pairs["x"], pairs["y"], pairs["score"]):
        near[kind, int(y)].append((score, (kind, int(x))))
    for options in near.values():
        options.sort(key=lambda o: -o[0])
    free: dict = defaultdict(deque)
    before = members["side"] == 0
    for kind, x, ordinal, i in zip(*(members.loc[before, c] for c in ("kind", "x", "ordinal", "id"))):
        free[kind, int(x)].append((ordinal, i))
    out = []
    for kind, y, i in zip(*(members.loc[~before, c] for c in ("kind", "x", "id"))):
        options, best, at = near[kind, int(y)], None, None
        spent = False
        for score, x in options:
            if best is not None and score < at:
                break
            if not free[x]:
                spent = True
            elif best is None or free[x][0] < free[best][0]:
                best, at = x, score
        if best is not None:
            out.append((kind, free[best].popleft()[1], i))
        if spent:
            options[:] = [o for o in options if free[o[1]]]
    return pd.DataFrame(out, columns=["kind", "b_id", "a_id"])


def match_by_similarity(before: DataFrame, after: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One-to-one pairs: each after entity in order takes the most similar before entity still free, the earlier of equal ones.

    Entities of equal word sets are one class with a queue of members, so copies aren't paired all with all.
    """
    kind = F.concat(F.length("scope").cast("string"), F.lit(":"), "scope", "entity_type")
    named = lambda side, k: side.select(kind.alias("kind"), F.lit(k).alias("side"), "id", "content")
    members, pairs = similar_classes(named(before, 0).unionByName(named(after, 1)), threshold)
    pairs = cut(pairs.select("kind", "x", "y", (F.col("inter") / F.col("size_union")).alias("score")))
    ends = pairs.select("kind", F.lit(0).alias("side"), F.col("x").alias("shape")).unionByName(pairs.select("kind", F.lit(1).alias("side"), F.col("y").alias("shape"))).distinct()
    orders = before.select(kind.alias("kind"), F.lit(0).alias("side"), "id", "ordinal").unionByName(after.select(kind.alias("kind"), F.lit(1).alias("side"), "id", "ordinal"))
    linked = members.join(ends, ["kind", "side", "shape"]).select("kind", "side", "id", "shape").join(orders, ["kind", "side", "id"])
    # nulls would make pandas read numbers as doubles
    fill = lambda x, t, c: F.lit(x).cast(t).alias(c)
    id_type, order_type = dict(before.dtypes)["id"], dict(orders.dtypes)["ordinal"]
    rows = pairs.select("kind", F.lit(-1).alias("side"), "x", "y", "score", fill(0, order_type, "ordinal"), fill(None, id_type, "id")).unionByName(linked.select("kind", "side", F.col("shape").alias("x"), fill(0, "long", "y"), fill(0, "double", "score"), "ordinal", "id"))
    rows, keys = cut(rows), ["kind"]
    if rows.limit(ONE_GROUP + 1).count() > ONE_GROUP:
        # classes of different connected parts can't take each other's partners
        vertex = lambda side, c: F.xxhash64(F.lit("b_") if side == 0 else F.lit("a_"), "kind", c)
        parts = components(pairs.select(vertex(0, "x").alias("u"), vertex(1, "y").alias("v")))
        rows = rows.withColumn("u", F.when(F.col("side") == 1, vertex(1, "x")).otherwise(vertex(0, "x"))).join(parts, "u").drop("u")
        keys = ["root"]
    chosen = rows.groupBy(*keys).applyInPandas(_greedy, f"kind string, b_id {id_type}, a_id {id_type}")
    b, a = _side(before, "b_").withColumn("kind", F.concat(F.length("scope").cast("string"), F.lit(":"), "scope", "b_entity_type")), _side(after, "a_").withColumn("kind", F.concat(F.length("scope").cast("string"), F.lit(":"), "scope", "a_entity_type")).drop("scope")
    return chosen.join(b, ["kind", "b_id"]).join(a, ["kind", "a_id"]).select(*(c for c in b.columns if c != "kind"), *(c for c in a.columns if c != "kind"))


def classify(pairs: DataFrame) -> DataFrame:
    """Pairs of different ids: moved to another file or parent, else renamed; the same thing under another id is no change."""
    moved = ~F.col("b_file_path").eqNullSafe(F.col("a_file_path")) | ~F.col("b_parent_id").eqNullSafe(F.col("a_parent_id"))
    same = (F.col("b_name") == F.col("a_name")) & ~moved & (F.col("b_content_hash") == F.col("a_content_hash"))
    return pairs.filter(~same | same.isNull()).withColumn("change_type", F.when(moved, "moved").otherwise("renamed"))


def _changes(pairs: DataFrame, change_type: Column, structural: Column | None = None) -> DataFrame:
    """Change rows of pairs with b_ and a_ columns."""
    old = lambda c: F.when(~F.col("b_" + c).eqNullSafe(F.col("a_" + c)), F.col("b_" + c))
    return pairs.select(
        "scope", F.concat(F.lit("change::"), "a_id").alias("id"), F.col("a_id").alias("entity_id"), change_type.alias("change_type"), F.col("a_entity_type").alias("entity_type"), F.col("a_name").alias("entity_name"),
        F.col("a_start_line").alias("entity_line"), F.col("a_parent_id").alias("parent_id"), F.col("a_file_path").alias("file_path"), old("name").alias("old_entity_name"), old("file_path").alias("old_file_path"),
        old("parent_id").alias("old_parent_id"), F.col("b_content").alias("before_content"), F.col("a_content").alias("after_content"), (F.lit(None).cast("boolean") if structural is None else structural).alias("structural_change"),
    )


def one_sided(side: DataFrame, kind: str) -> DataFrame:
    """Added, deleted or reordered entities as change rows."""
    none = F.lit(None).cast("string")
    return side.select(
        "scope", F.concat(F.lit(f"change::{kind}::"), "id").alias("id"), F.col("id").alias("entity_id"), F.lit(kind).alias("change_type"), "entity_type", F.col("name").alias("entity_name"), F.col("start_line").alias("entity_line"),
        "parent_id", "file_path", none.alias("old_entity_name"), none.alias("old_file_path"), none.alias("old_parent_id"), (F.col("content") if kind == "deleted" else none).alias("before_content"),
        (F.col("content") if kind == "added" else none).alias("after_content"), F.lit(None).cast("boolean").alias("structural_change"),
    )


def match_entities(before: DataFrame, after: DataFrame, similarity: float | None = SIMILARITY) -> DataFrame:
    """The changes between two snapshots with a ``scope``; without the fuzzy phase if ``similarity`` is None."""
    # one outer join has the pairs of equal ids and both rests; what is neither changed nor left over isn't written
    b, a = _side(latest_occurrence(before), "b_"), _side(latest_occurrence(after), "a_").withColumnRenamed("scope", "_scope")
    both = b.join(a, F.expr("scope = _scope AND b_id = a_id"), "full_outer").filter("b_id IS NULL OR a_id IS NULL OR b_content_hash <> a_content_hash")
    both = cut(both.withColumn("scope", F.coalesce("scope", "_scope")).drop("_scope"))
    modified = both.filter("b_id IS NOT NULL AND a_id IS NOT NULL")
    out = _changes(modified, F.lit("modified"), F.col("b_structural_hash") != F.col("a_structural_hash"))
    rest = lambda p, other: both.filter(f"{other}id IS NULL").select("scope", *(F.col(c).alias(c[2:]) for c in both.columns if c.startswith(p)))
    left_b, left_a = rest("b_", "a_"), rest("a_", "b_")
    phases = [lambda b, a: match_by_key(b, a, "content_hash", True), lambda b, a: match_by_key(b, a, "structural_hash", False)]
    if similarity is not None:
        phases.append(lambda b, a: match_by_similarity(b, a, similarity))
    for phase in phases:
        pairs = cut(phase(left_b, left_a))
        classified = classify(pairs)
        out = out.unionByName(_changes(classified, F.col("change_type")))
        left_b, left_a = residual(left_b, pairs, "b_id"), residual(left_a, pairs, "a_id")
    return out.unionByName(one_sided(left_a, "added")).unionByName(one_sided(left_b, "deleted"))


def with_parent_names(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``changes`` with ``parent_name``: the names of all ancestors from the outermost on, joined by ``::``; the after snapshot's first, cycles cut.

    Each step goes up one level from all different parents at once, until none
    has a parent.  A walk keeps no list of where it was: it ends where it comes
    back to a place marked at the last power of two of steps, and of a place
    met twice the first visit counts.  Joins are by shuffles: nothing that grows
    with the changes is broadcast.
    """
    changes = cut(changes)
    both = after.select("scope", "id", "name", "parent_id", F.lit(0).alias("p")).unionByName(before.select("scope", "id", "name", "parent_id", F.lit(1).alias("p")))
    n = parts(before, after)
    known = cut(spread(both, n, "scope", "id").groupBy("scope", "id").agg(F.min_by(F.struct("name", "parent_id"), "p").alias("e")).select("scope", "id", "e.name", "e.parent_id"))
    known = known.withColumnRenamed("id", "at").hint("merge")
    walk = changes.filter("parent_id IS NOT NULL").select("scope", F.col("parent_id").alias("start")).distinct().withColumns({"at": F.col("start"), "mark": F.lit(None).cast("string")})
    found, depth = None, 0
    while True:
        here = cut(spread(walk, n, "scope", "at").join(spread(known, n, "scope", "at"), ["scope", "at"]))
        step = here.select("scope", "start", "at", F.lit(depth).alias("depth"), "name")
        found = step if found is None else found.unionByName(step)
        up = here.filter("parent_id IS NOT NULL AND NOT (parent_id <=> mark)")
        if up.isEmpty():
            break
        depth += 1
        mark = F.col("at") if depth & (depth - 1) == 0 else F.col("mark")
        walk = up.select("scope", "start", F.col("parent_id").alias("at"), mark.alias("mark"))
    first = found.repartition(max(n, parts(changes)), "scope", "start").groupBy("scope", "start", "at").agg(F.min(F.struct("depth", "name")).alias("s"))
    names = first.filter("s.name <> ''").groupBy("scope", "start").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s"), asc=False), lambda s: s["name"]), "::").alias("parent_name"))
    return changes.join(names.withColumnRenamed("start", "parent_id").hint("merge"), ["scope", "parent_id"], "left").select(*changes.columns, "parent_name")
