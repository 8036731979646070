"""Edges between entities, and walks over them.

An edge (src, dst, ref_type) says that src depends on dst.  Adjacency is never
collected: every step of a walk is a join of a frontier with the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut, parts, spread

#: Entities that an unbounded walk returns from one start.
IMPACT_CAP = 10_000
BUDGET = 8_000
#: Rows of a frontier that are broadcast to the edges; bits of a word that are used for starts.
BROADCAST_ROWS, BITS = 10_000, 63


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): that of the earliest (pass, seq)."""
    edges = spread(edges, parts(edges), "src", "dst")
    first = F.row_number().over(W.partitionBy("src", "dst").orderBy("pass", "seq", "ref_type"))
    return edges.withColumn("_rn", first).filter("_rn = 1").select("src", "dst", "ref_type")


def dependents(edges: DataFrame, entities: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, entity columns) of what depends on each target directly."""
    n = parts(edges)
    met = spread(targets, n, "target").join(spread(edges.select(F.col("dst").alias("target"), F.col("src").alias("id")), n, "target"), "target").distinct()
    return spread(met, n, "id").join(spread(entities, n, "id"), "id")


def dependencies(edges: DataFrame, entities: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, entity columns) of what each target depends on directly."""
    n = parts(edges)
    met = spread(targets, n, "target").join(spread(edges.select(F.col("src").alias("target"), F.col("dst").alias("id")), n, "target"), "target").distinct()
    return spread(met, n, "id").join(spread(entities, n, "id"), "id")


def _numbered(starts: DataFrame) -> DataFrame:
    """(start, block, bit) of all different starts: BITS of them share a block."""
    starts = cut(starts.filter("start IS NOT NULL").select("start").distinct())
    bucket = F.pmod(F.xxhash64("start"), F.lit(max(1, starts.count() // BITS)))
    place = F.row_number().over(W.partitionBy("bucket").orderBy("start")) - 1
    return cut(starts.withColumn("bucket", bucket).withColumn("place", place).select("start", (F.col("bucket") * (1 << 24) + F.floor(F.col("place") / BITS)).alias("block"), (F.col("place") % BITS).alias("bit")))


def _reach_sets(edges: DataFrame, numbered: DataFrame, depth: int) -> DataFrame:
    """(block, id, depth, bits): which starts of a block reach the id first at that depth.

    Breadth first from all starts at once, starts as bits of a word, so a hop
    has a row for an id and not one for each start.  The edges are written once,
    in as many parts as their size asks for; a small frontier is broadcast to
    them.  Ids without dependents take part in no further hop.  Each hop is
    written to the shared folder, so plans stay short and cycles end where
    nothing new is found.
    """
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("next")).filter("id IS NOT NULL AND next IS NOT NULL")
    n = parts(back)
    back = cut(spread(back, n, "id"))  # every hop reads it
    inner = cut(back.select("id").distinct())
    seen = numbered.select("block", F.col("start").alias("id"), F.lit(0).alias("depth"), F.expr("shiftleft(1L, bit)").alias("bits"))
    frontier = cut(spread(seen, n, "id").join(spread(inner, n, "id"), "id", "left_semi"))
    hop = 0
    while not depth or hop < depth:
        rows = frontier.count()
        if not rows:
            break
        hop += 1
        few = rows <= BROADCAST_ROWS
        met = (spread(back, n, "id") if not few else back).join(F.broadcast(frontier) if few else spread(frontier, n, "id"), "id")
        both = met.select("block", F.col("next").alias("id"), F.col("bits").alias("got"), F.lit(0).cast("long").alias("had")).unionByName(seen.select("block", "id", F.lit(0).cast("long").alias("got"), F.col("bits").alias("had")))
        new = spread(both, n, "id").groupBy("block", "id").agg(F.bit_or("got").alias("got"), F.bit_or("had").alias("had"))
        new = cut(new.select("block", "id", F.lit(hop).alias("depth"), F.expr("got & ~had").alias("bits")).filter("bits <> 0"))
        seen = seen.unionByName(new)
        frontier = cut(spread(new, n, "id").join(spread(inner, n, "id"), "id", "left_semi"))
    return seen.filter("depth > 0")


def _expanded(sets: DataFrame, numbered: DataFrame) -> DataFrame:
    """A row for each start in place of (block, bits)."""
    few = numbered.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda k: F.getbit("bits", k) == 1)
    each = sets.withColumn("bit", F.explode(bits)).drop("bits")
    return each.join(F.broadcast(numbered) if few else numbered, ["block", "bit"]).drop("block", "bit")


def reach(edges: DataFrame, starts: DataFrame, depth: int = 0) -> DataFrame:
    """(start, id, depth) of all that depends on each ``start`` over at most ``depth`` edges (0: any number); never the start itself."""
    numbered = _numbered(starts)
    return _expanded(_reach_sets(edges, numbered, depth), numbered).select("start", "id", "depth")


def _reached(edges: DataFrame, entities: DataFrame, numbered: DataFrame, depth: int = 0) -> DataFrame:
    """The sets of reached ids with the entities' columns."""
    n = parts(edges, entities)
    return spread(_reach_sets(edges, numbered, depth), n, "id").join(spread(entities, n, "id"), "id")


def impact(edges: DataFrame, entities: DataFrame, starts: DataFrame, depth: int = 0, cap: int | None = None) -> DataFrame:
    """Entities that a change of each start reaches, with their depth; at most ``cap`` of them by (depth, id)."""
    numbered = _numbered(starts)
    found = _expanded(_reached(edges, entities, numbered, depth), numbered)
    if cap is None:
        return found
    rank = F.row_number().over(W.partitionBy("start").orderBy("depth", "id"))
    return found.withColumn("_rn", rank).filter(F.col("_rn") <= cap).drop("_rn")


def impact_count(edges: DataFrame, starts: DataFrame, most: int = IMPACT_CAP) -> DataFrame:
    """(start, n): how many ids are reached, counted to ``most``; ids without an entity count."""
    counted = reach(edges, starts).groupBy("start").agg(F.count("*").alias("n"))
    return starts.distinct().join(counted, "start", "left").select("start", F.least(F.coalesce("n", F.lit(0)), F.lit(most)).cast("long").alias("n"))


def impacted_tests(edges: DataFrame, entities: DataFrame, starts: DataFrame) -> DataFrame:
    """Reached entities that are tests."""
    numbered = _numbered(starts)
    return _expanded(_reached(edges, entities, numbered).filter(T.is_test_entity("name", "file_path", "content")), numbered)


def _fold(items: Column, budget: int) -> Column:
    """The items that fit, one after the other: one that doesn't is passed over; nothing more is taken once the budget is used up."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<role:int,depth:int,id:string,tokens:int>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] < budget) & (acc["used"] + x["tokens"] <= budget) | ((x["role"] == 0) & (x["tokens"] <= budget))
        return F.when(fits, F.struct((acc["used"] + x["tokens"]).alias("used"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)

    return F.aggregate(items, zero, step, lambda acc: acc["kept"])


def context(edges: DataFrame, entities: DataFrame, targets: DataFrame, budget: int = BUDGET) -> DataFrame:
    """What fits in a token budget for each target: itself, then direct dependents in full, then the first lines of the rest.

    Texts aren't carried through the fold; they are joined to the ids it keeps.
    """
    starts = targets.select(F.col("target").alias("start"))
    entities = cut(entities)
    sizes = entities.select("id", T.estimate_tokens("content").alias("full"), T.estimate_tokens(T.first_line("content")).alias("line"))
    numbered = _numbered(starts)
    own = numbered.select("block", F.col("start").alias("id"), F.lit(0).alias("depth"), F.expr("shiftleft(1L, bit)").alias("bits")).join(sizes, "id")
    role = F.least(F.col("depth"), F.lit(2))
    sized = own.unionByName(_reached(edges, sizes, numbered)).withColumn("tokens", F.when(role < 2, F.col("full")).otherwise(F.col("line")))
    # of ids that the same starts reach at one depth the first few of a size are enough for each of these starts; parts by hash first, so no task sorts them all
    n = parts(edges)
    first = F.row_number().over(W.partitionBy("block", "bits", "depth", "tokens", "part").orderBy("id"))
    sized = sized.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n))).select("block", "bits", "depth", "tokens", "part", "id")
    sized = spread(sized, n, "part").withColumn("place", first).filter(F.col("place") * F.col("tokens") <= budget)
    sized = _expanded(sized.drop("place", "part"), numbered).select("start", role.alias("role"), "depth", "id", "tokens")
    # what is left of the budget never grows, so of the items of one size a first few are taken: no more than fit in all of it
    place = F.row_number().over(W.partitionBy("start", "tokens").orderBy("role", "depth", "id"))
    sized = sized.withColumn("place", place).filter(F.col("place") * F.col("tokens") <= budget)
    item = F.struct("role", "depth", "id", "tokens")
    kept = sized.groupBy("start").agg(F.sort_array(F.collect_list(item)).alias("items")).select(F.col("start").alias("target"), F.inline(_fold(F.col("items"), budget)))
    name = F.element_at(F.array(F.lit("target"), F.lit("direct_dependent"), F.lit("transitive_dependent")), F.col("role") + 1)
    text = F.when(F.col("role") < 2, F.col("content")).otherwise(T.first_line("content"))
    return kept.join(entities, "id").select("target", "id", name.alias("role"), F.col("tokens").alias("estimated_tokens"), text.alias("content"))


def word_edges(entities: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges from the names in entity texts: an import of the file decides first, then an entity of that name in the same file.

    ``imports`` has (file_path, local_name, target).  A name without either has
    no edge; parents and children have none between them, and a class has none
    to the names of its own members.
    """
    words = entities.select(F.col("id").alias("src"), "file_path", "parent_id", "content", F.posexplode(T.references("content", "name")).alias("seq", "name"))
    symbols = entities.select("file_path", "name", F.col("id").alias("same"), F.col("parent_id").alias("same_parent"), "ordinal")
    imported = imports.groupBy("file_path", F.col("local_name").alias("name")).agg(F.min("target").alias("import"))
    own = words.join(symbols, ["file_path", "name"], "left").filter("same IS NULL OR same <> src")
    own = own.withColumn("_rn", F.row_number().over(W.partitionBy("src", "name").orderBy(F.col("ordinal").asc_nulls_last()))).filter("_rn = 1")
    other = words.select("src", "name", "file_path", "parent_id", "content", "seq").join(imported, ["file_path", "name"])
    by_import = other.select("src", "name", "parent_id", "content", "seq", F.col("import").alias("dst"))
    by_file = own.filter("same IS NOT NULL").join(imported.select("file_path", "name"), ["file_path", "name"], "left_anti").select("src", "name", "parent_id", "content", "seq", F.col("same").alias("dst"))
    found = by_import.unionByName(by_file).filter("dst <> src AND NOT (dst <=> parent_id)")
    family = entities.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))
    members = entities.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), "name").distinct()
    kept = found.join(family, ["src", "dst"], "left_anti").join(members, ["src", "name"], "left_anti")
    return kept.select("src", "dst", T.ref_type("content", "name").alias("ref_type"), F.lit(2).alias("pass"), "seq")


def dot_chain_edges(entities: DataFrame) -> DataFrame:
    """Edges from ``self.member`` to the sibling in the enclosing class, and from ``Class.member`` to that member."""
    chains = entities.select(F.col("id").alias("src"), "parent_id", "content", F.posexplode(T.dot_chains(T.strip_comments_and_strings("content"))).alias("seq", "chain"))
    chains = chains.withColumn("receiver", F.substring_index("chain", ".", 1)).withColumn("member", F.substring_index("chain", ".", -1))
    from ..model import GRAPH_CLASS_TYPES

    classes = entities.filter(F.col("entity_type").isin(*GRAPH_CLASS_TYPES)).select(F.col("id").alias("class_id"), F.col("name").alias("class_name"))
    members = entities.join(classes, entities.parent_id == classes.class_id).select("class_id", "class_name", F.col("name").alias("member"), F.col("id").alias("dst"), "ordinal")
    own = chains.filter("receiver IN ('self', 'this')").join(members.withColumnRenamed("class_id", "parent_id").drop("class_name"), ["parent_id", "member"])
    named = chains.join(members.withColumnRenamed("class_name", "receiver").drop("class_id"), ["receiver", "member"])
    cols = ["src", "seq", "member", "content", "dst", "ordinal"]
    both = own.select(*cols).unionByName(named.select(*cols)).filter("src <> dst")
    both = both.withColumn("_rn", F.row_number().over(W.partitionBy("src", "seq").orderBy("ordinal", "dst"))).filter("_rn = 1")
    return both.select("src", "dst", T.ref_type("content", "member").alias("ref_type"), F.lit(1).alias("pass"), "seq")


def build_graph(entities: DataFrame, imports: DataFrame, scope_edges: DataFrame | None = None) -> DataFrame:
    """All edges: those of the scope resolver first; entities without one get edges from dot chains and names."""
    rest = entities if scope_edges is None else entities.join(scope_edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    words = word_edges(entities, imports).unionByName(dot_chain_edges(entities)).join(rest.select(F.col("id").alias("src")), "src", "left_semi")
    every = words if scope_edges is None else words.unionByName(scope_edges.withColumn("pass", F.lit(0)).withColumn("seq", F.lit(0)))
    return distinct_edges(every)


def accuracy(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision, recall and F1 of edges (src, dst) against expected ones."""
    f, e = found.select("src", "dst").distinct().withColumn("f", F.lit(1)), expected.select("src", "dst").distinct().withColumn("e", F.lit(1))
    n = f.join(e, ["src", "dst"], "full").agg(F.sum(F.coalesce(F.col("f") * F.col("e"), F.lit(0))).alias("tp"), F.count("f").alias("nf"), F.count("e").alias("ne"))
    p, r = F.try_divide("tp", "nf"), F.try_divide("tp", "ne")
    return n.select(p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))
