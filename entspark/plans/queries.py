"""Registered queries of the operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import diff as D
from ..operators import graph as G
from ..operators import history as HI
from ..operators import match as M
from ..operators import orphans as O
from ..operators import reorder as R
from ..operators import search as SE
from ..operators import store as ST
from ..operators import suppress as SU
from ..operators.chunks import chunk_text
from ..session import cut, parts, spread
from . import snapshots as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- lines and chunks -------------------------------------------------------

_LINES = """
lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no
  FROM (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM documents)
)"""


@register("chunk_documents", f"""
WITH {_LINES},
chunks AS (SELECT doc_id, (line_no - 1) // 20 AS k, string_agg(line, chr(10) ORDER BY line_no) AS content, min(line_no) AS a, max(line_no) AS b FROM lines GROUP BY 1, 2)
SELECT doc_id, 'lines ' || a || '-' || b AS name, a AS start_line, b AS end_line, md5(content) AS content_hash,
  CAST(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) * 13 // 10 AS INTEGER) AS estimated_tokens FROM chunks
""")  # fmt: skip
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("scope"), "doc_id", F.col("text").alias("content"))
    chunks = chunk_text(docs.select("doc_id", "content"), "doc_id")
    return chunks.select("doc_id", "name", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5("content").alias("content_hash"), T.estimate_tokens("content").alias("estimated_tokens"))


@register("document_line_entities", f"WITH {_LINES} SELECT doc_id, line_no, md5(line) AS content_hash, length(line) AS n FROM lines")
def document_line_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(T.lines_of(T.normalise_eol("text"))).alias("at", "line"))
    return lines.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), H.content_hash("line").alias("content_hash"), F.length("line").cast("long").alias("n"))


@register("page_elements", "SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@register("json_keys_events", """
SELECT event_type, key, count(*) AS n, CAST(sum(CAST(value AS BIGINT)) AS BIGINT) AS total
FROM (SELECT event_type, unnest(regexp_extract_all(props, '"([^"]+)": ?-?[0-9]+', 1)) AS key, unnest(regexp_extract_all(props, '"[^"]+": ?(-?[0-9]+)', 1)) AS value FROM events) GROUP BY 1, 2
""")
def json_keys_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))
    return events.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


_ORDER_TEXT = "concat_ws('|', cast(o_orderkey as varchar(20)), cast(o_custkey as varchar(20)), o_orderstatus, cast(cast(round(o_totalprice * 100) as bigint) as varchar(20)), o_orderpriority)"


@register("row_entities_orders", f"SELECT 'orders.csv::row::row[' || o_orderkey || ']' AS id, md5({_ORDER_TEXT}) AS content_hash, o_orderstatus AS status FROM orders")
def row_entities_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    name = F.concat(F.lit("row["), F.col("o_orderkey").cast("string"), F.lit("]"))
    meta = F.create_map(F.lit("o_orderstatus"), F.col("o_orderstatus"))
    return orders.select(T.entity_id(F.lit("orders.csv"), F.lit("row"), name).alias("id"), F.md5(F.expr(_ORDER_TEXT)).alias("content_hash"), F.element_at(meta, "o_orderstatus").alias("status"))


@register("exact_duplicates", "SELECT md5(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies, max(doc_id) AS last_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", H.content_hash("text").alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("doc_id").alias("last_id")).filter("copies > 1")


# --- diffs of snapshots -----------------------------------------------------

_CHANGES = f"""
WITH b AS ({S.BEFORE}), a AS ({S.AFTER}),
same AS (SELECT a.*, b.content_hash AS b_hash, b.structural_hash AS b_shape FROM a JOIN b ON a.id = b.id),
rb AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY ordinal DESC, id DESC) AS rk FROM b WHERE id NOT IN (SELECT id FROM same)),
ra AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY ordinal, id) AS rk FROM a WHERE id NOT IN (SELECT id FROM same)),
p1 AS (SELECT ra.*, rb.id AS b_id, rb.name AS b_name, rb.file_path AS b_file FROM ra JOIN rb ON ra.content_hash = rb.content_hash AND ra.rk = rb.rk),
sb AS (SELECT * EXCLUDE (rk), row_number() OVER (PARTITION BY structural_hash ORDER BY ordinal, id) AS rk FROM rb WHERE id NOT IN (SELECT b_id FROM p1)),
sa AS (SELECT * EXCLUDE (rk), row_number() OVER (PARTITION BY structural_hash ORDER BY ordinal, id) AS rk FROM ra WHERE id NOT IN (SELECT id FROM p1)),
p2 AS (SELECT sa.*, sb.id AS b_id, sb.name AS b_name, sb.file_path AS b_file FROM sa JOIN sb ON sa.structural_hash = sb.structural_hash AND sa.rk = sb.rk),
pairs AS (SELECT id, name, file_path, b_id, b_name, b_file FROM p1 UNION ALL SELECT id, name, file_path, b_id, b_name, b_file FROM p2),
changes AS (
  SELECT 'modified' AS change_type, id AS entity_id, name AS entity_name, file_path, CAST(NULL AS VARCHAR) AS old_entity_name, CAST(NULL AS VARCHAR) AS old_file_path, b_shape <> structural_hash AS structural_change FROM same WHERE b_hash <> content_hash
  UNION ALL SELECT CASE WHEN file_path <> b_file THEN 'moved' ELSE 'renamed' END, id, name, file_path, CASE WHEN name <> b_name THEN b_name END, CASE WHEN file_path <> b_file THEN b_file END, CAST(NULL AS BOOLEAN) FROM pairs
  UNION ALL SELECT 'added', id, name, file_path, NULL, NULL, NULL FROM sa WHERE id NOT IN (SELECT id FROM p2)
  UNION ALL SELECT 'deleted', id, name, file_path, NULL, NULL, NULL FROM sb WHERE id NOT IN (SELECT b_id FROM p2)
)
"""


def part_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the catalogue's revision, without the fuzzy phase."""
    return M.match_entities(S.snapshot(spark, sf_dir, S.BEFORE), S.snapshot(spark, sf_dir, S.AFTER), None)


_COLUMNS = ["change_type", "entity_id", "entity_name", "file_path", "old_entity_name", "old_file_path", "structural_change"]


@register("diff_changes", f"{_CHANGES} SELECT * FROM changes")
def diff_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_changes(spark, sf_dir).select(*_COLUMNS)


for _kind in ("modified", "added", "deleted", "renamed", "moved"):

    @register(f"diff_{_kind}", f"{_CHANGES} SELECT entity_id, entity_name, old_entity_name, old_file_path FROM changes WHERE change_type = '{_kind}'")
    def _of_kind(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        return part_changes(spark, sf_dir).filter(F.col("change_type") == kind).select("entity_id", "entity_name", "old_entity_name", "old_file_path")


@register("diff_summary", f"""{_CHANGES} SELECT count(DISTINCT file_path) AS file_count, count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'modified') AS modified,
  count(*) FILTER (change_type = 'deleted') AS deleted, count(*) FILTER (change_type = 'moved') AS moved, count(*) FILTER (change_type = 'renamed') AS renamed, CAST(0 AS BIGINT) AS reordered, CAST(0 AS BIGINT) AS orphan, count(*) AS total FROM changes""")  # fmt: skip
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.summary(part_changes(spark, sf_dir))


@register("diff_by_file", f"{_CHANGES} SELECT file_path, change_type, count(*) AS n FROM changes GROUP BY 1, 2")
def diff_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.by_file(part_changes(spark, sf_dir))


@register("diff_rollup", f"{_CHANGES} SELECT file_path, 'part' AS entity_type, change_type, count(*) AS n FROM changes GROUP BY file_path, change_type UNION ALL SELECT file_path, 'part', NULL, count(*) FROM changes GROUP BY 1 UNION ALL SELECT file_path, NULL, NULL, count(*) FROM changes GROUP BY 1 UNION ALL SELECT NULL, NULL, NULL, count(*) FROM changes")
def diff_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.rollup_counts(part_changes(spark, sf_dir))


@register("diff_histogram", f"{_CHANGES} SELECT 'part' AS entity_type, change_type, count(*) AS n FROM changes GROUP BY 2")
def diff_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.histogram(part_changes(spark, sf_dir), "entity_type", "change_type")


def _documents_as_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select(F.lit("corpus").alias("scope"), F.col("lang").alias("entity_type"), F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ordinal"), F.col("text").alias("content"))


@register("fuzzy_near_copies", """
WITH t AS (SELECT DISTINCT doc_id, lang, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, lang, count(*) AS n, string_agg(w, ' ' ORDER BY w) AS ws FROM t GROUP BY 1, 2),
k AS (SELECT lang, ws, n, min(doc_id) AS a FROM s GROUP BY 1, 2, 3),
r AS (SELECT t.* FROM t JOIN k ON k.a = t.doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM r x JOIN r y ON x.w = y.w AND x.lang = y.lang AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT a AS doc_id_a, b AS doc_id_b, inter, p.n + q.n - inter AS size_union FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 5 * inter >= 4 * (p.n + q.n - inter)
UNION ALL SELECT k.a, s.doc_id, s.n, s.n FROM s JOIN k USING (lang, ws, n) WHERE s.doc_id <> k.a
""")
def fuzzy_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different texts by the least document of each, and copies with the least of theirs."""
    docs = _read(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("lang").alias("entity_type"), F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return M.near_sets(docs).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"), F.col("inter").cast("long").alias("inter"), F.col("size_union").cast("long").alias("size_union"))


@register("fuzzy_greedy_matches", """
WITH RECURSIVE t AS (SELECT DISTINCT doc_id, lang, source < 'src15' AS old, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT x.lang, x.doc_id AS b, y.doc_id AS a, count(*) AS inter FROM t x JOIN t y ON x.w = y.w AND x.lang = y.lang AND x.old AND NOT y.old GROUP BY 1, 2, 3),
p AS (SELECT lang, a, b, inter / (m.n + q.n - inter) AS score FROM c JOIN s m ON m.doc_id = b JOIN s q ON q.doc_id = a WHERE 5 * inter >= 4 * (m.n + q.n - inter)),
l AS (SELECT lang, a, list(b ORDER BY score DESC, b) AS bs FROM p GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY a) AS k FROM l),
fold(lang, k, taken, a, b) AS (
  SELECT DISTINCT lang, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM o
  UNION ALL
  SELECT f.lang, o.k, list_concat(f.taken, list_filter(o.bs, lambda x: NOT list_contains(f.taken, x))[1:1]), o.a, list_filter(o.bs, lambda x: NOT list_contains(f.taken, x))[1] FROM fold f JOIN o ON o.lang = f.lang AND o.k = f.k + 1
)
SELECT b AS before_id, a AS after_id FROM fold WHERE b IS NOT NULL
""")
def fuzzy_greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of sources before src15 and from it on as two snapshots, matched by similarity one to one."""
    docs = _documents_as_entities(spark, sf_dir).withColumn("ordinal", F.col("ordinal").cast("int"))
    half = F.expr("scope")
    source = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "source")
    sided = docs.join(source, "id").withColumn("scope", half)
    b, a = sided.filter("source < 'src15'"), sided.filter("source >= 'src15'")
    return M.match_by_similarity(b, a).select(F.col("b_id").cast("long").alias("before_id"), F.col("a_id").cast("long").alias("after_id"))


def _shelves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts of a brand in order of their key, and in order of price."""
    part = S.snapshot(spark, sf_dir, S.BEFORE, None)
    price = part.withColumn("place", F.row_number().over(W.partitionBy("file_path").orderBy(F.regexp_extract("content", "price ([0-9]+)", 1).cast("long"), "id")))
    return part, price.withColumn("start_line", F.col("place")).drop("place")


@register("reordered")
def reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _shelves(spark, sf_dir)
    return R.reordered(before, after).select("entity_id", "change_type", "file_path")


@register("reordered_counts", f"""
WITH RECURSIVE b AS ({S.BEFORE}),
p AS (SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY ordinal, id) AS k, row_number() OVER (PARTITION BY file_path ORDER BY CAST(regexp_extract(content, 'price ([0-9]+)', 1) AS BIGINT), id) AS place FROM b),
fold(file_path, k, tails) AS (
  SELECT DISTINCT file_path, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM p
  UNION ALL
  SELECT f.file_path, p.k, list_concat(list_concat(list_filter(f.tails, lambda x: x < p.place), [p.place]), list_filter(f.tails, lambda x: x >= p.place)[2:]) FROM fold f JOIN p ON p.file_path = f.file_path AND p.k = f.k + 1
),
ends AS (SELECT file_path, max(k) AS n, max(len(tails)) AS longest FROM fold GROUP BY 1)
SELECT file_path, n - longest AS n FROM ends WHERE n > longest
""")
def reordered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entities of each file are outside a longest increasing run."""
    before, after = _shelves(spark, sf_dir)
    return R.reordered(before, after).groupBy("file_path").agg(F.count("*").alias("n"))


@register("reordered_steps", f"""
WITH b AS ({S.BEFORE}), p AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY CAST(regexp_extract(content, 'price ([0-9]+)', 1) AS BIGINT), id) AS place FROM b),
l AS (SELECT file_path, CASE WHEN lag(place) OVER (PARTITION BY file_path ORDER BY ordinal, id) > place THEN 1 ELSE 0 END AS back FROM p)
SELECT file_path, CAST(sum(back) AS BIGINT) AS steps_back FROM l GROUP BY 1
""")
def reordered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _shelves(spark, sf_dir)
    places = before.select("id", "file_path", F.col("start_line").alias("b_start_line")).join(after.select("id", F.col("start_line").alias("a_start_line")), "id")
    return R.steps_back(places)


@register("parent_suppression", """
WITH kids AS (SELECT DISTINCT l_orderkey, l_partkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, l_partkey) AS gone FROM lineitem),
parents AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'P')
SELECT 'object' AS entity_type, count(*) AS n FROM parents WHERE o_orderkey NOT IN (SELECT l_orderkey FROM kids WHERE gone = 1)
UNION ALL SELECT 'property', count(*) FROM kids WHERE gone = 1
""")
def parent_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines changed aren't reported themselves."""
    orders, lines = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    orders, lines = spread(orders, parts(orders), "o_orderkey"), spread(lines, parts(lines), "l_orderkey", "l_partkey")
    oid = F.concat(F.lit("o::"), F.col("o_orderkey").cast("string"))
    none = F.lit(None).cast("string")
    parents = orders.filter("o_orderkey IS NOT NULL").groupBy("o_orderkey").agg(F.max((F.col("o_orderstatus") == "P").cast("int")).alias("gone")).select(oid.alias("id"), F.lit("object").alias("entity_type"), none.alias("parent_id"), "gone")
    kids = lines.groupBy("l_orderkey", "l_partkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("gone")).select(F.concat(F.lit("o::"), F.col("l_orderkey").cast("string"), F.lit("::"), F.col("l_partkey").cast("string")).alias("id"), F.lit("property").alias("entity_type"), F.concat(F.lit("o::"), F.col("l_orderkey").cast("string")).alias("parent_id"), "gone")
    every = parents.unionByName(kids).select(F.lit("orders").alias("scope"), "*", F.col("id").alias("name"), F.col("id").alias("content"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(0).alias("ordinal"))
    changes = M.one_sided(every.filter("gone = 1").withColumn("file_path", F.lit("orders")), "deleted")
    return SU.suppress_parents(changes, every, every.filter("gone = 0")).groupBy("entity_type").agg(F.count("*").alias("n"))


@register("orphan_lines", f"""
WITH {_LINES} SELECT doc_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS content_hash FROM lines WHERE line_no > 20 GROUP BY doc_id
""")
def orphan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first chunk of each document leaves uncovered."""
    docs = _read(spark, sf_dir, "documents")
    first = chunk_text(docs.select("doc_id", F.col("text").alias("content")), "doc_id").filter("start_line = 1").select(F.col("doc_id").alias("scope"), "start_line", "end_line")
    found = O.orphan_text(docs.select(F.col("doc_id").alias("scope"), F.col("text").alias("content")), first)
    return found.select(F.col("scope").alias("doc_id"), F.size(F.split("orphan", "\n")).cast("long").alias("n_lines"), F.md5("orphan").alias("content_hash"))


# --- history ----------------------------------------------------------------


@register("hotspots", "SELECT CAST(user_id AS VARCHAR) AS entity_name, event_type AS entity_type, 'events' AS file_path, count(*) AS change_count FROM events GROUP BY 1, 2")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("entity_name"), F.col("event_type").alias("entity_type"), F.lit("events").alias("file_path"))
    return HI.hotspots(events)


@register("blame_latest", """
WITH spans AS (SELECT DISTINCT o_orderkey FROM orders),
lines AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey) AS rn FROM lineitem JOIN spans ON l_orderkey = o_orderkey WHERE l_linenumber BETWEEN 1 AND 7)
SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS sha, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lines WHERE rn = 1
""")
def blame_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entities of seven lines, lines blamed on their shipment."""
    spans = _read(spark, sf_dir, "orders").select("o_orderkey").distinct().select(F.col("o_orderkey").alias("file_path"), F.col("o_orderkey").alias("id"), F.lit(1).alias("start_line"), F.lit(7).alias("end_line"))
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_partkey").alias("sha"))
    return HI.blame(spans, lines).select(F.col("id").alias("order_id"), "line", "sha", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@register("entity_evolution", """
WITH v AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN md5(event_type || props) END AS h, CASE WHEN event_type <> 'error' THEN md5(event_type) END AS s, ts FROM events),
m AS (SELECT *, lag(h) OVER w AS b, lag(s) OVER w AS bs, coalesce(max(CASE WHEN h IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ever FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, CASE WHEN h IS NOT NULL AND ever = 0 THEN 'added' WHEN h IS NOT NULL AND b IS NULL THEN 'reappeared' WHEN h IS NULL AND b IS NOT NULL THEN 'deleted' WHEN h <> b THEN CASE WHEN s = bs THEN 'modified (cosmetic)' ELSE 'modified (logic)' END END AS kind FROM m)
SELECT user_id, event_id, kind FROM k WHERE kind IS NOT NULL
""")
def entity_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user as an entity with a version at each event, an error being its absence."""
    there = F.col("event_type") != "error"
    versions = _read(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_id").alias("seq"), F.when(there, F.md5(F.concat("event_type", "props"))).alias("content_hash"), F.when(there, F.md5("event_type")).alias("structural_hash"))
    return HI.evolution(versions, ["user_id"]).select("user_id", "event_id", "kind")


@register("file_history", """
WITH m AS (SELECT *, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM (SELECT event_id, ts, user_id, CASE WHEN event_type <> 'error' THEN props END AS props FROM events))
SELECT user_id, event_id, CASE WHEN b IS NULL THEN 'added' WHEN props IS NULL THEN 'deleted' ELSE 'modified' END AS kind FROM m WHERE b IS DISTINCT FROM props
""")
def file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = _read(spark, sf_dir, "events").select(F.col("user_id").alias("file_path"), F.col("event_id").alias("sha"), "ts", F.when(F.col("event_type") != "error", F.col("props")).alias("blob"))
    return HI.file_history(blobs).select(F.col("file_path").alias("user_id"), F.col("sha").alias("event_id"), "kind")


@register("touched_paths", "SELECT o_orderkey AS sha, CAST(o_custkey AS VARCHAR) AS path FROM orders UNION SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) FROM lineitem")
def touched_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    changes = orders.select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").cast("string").alias("file_path"), F.lit(None).cast("string").alias("old_file_path")).unionByName(lines.select(F.col("l_orderkey").alias("sha"), F.col("l_suppkey").cast("string").alias("file_path"), F.lit(None).cast("string").alias("old_file_path")))
    return HI.touched_paths(changes)


@register("commit_log", "SELECT event_id AS sha, user_id AS author FROM events ORDER BY ts DESC, event_id LIMIT 50")
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _read(spark, sf_dir, "events").select(F.col("event_id").alias("sha"), F.col("user_id").alias("author"), "ts")
    return HI.log(commits, 50).select("sha", "author")


# --- graph ------------------------------------------------------------------


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sql(spark, S.NODES, **S.views(spark, sf_dir, "region", "nation", "supplier", "customer", "orders"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sql(spark, S.LINKS, **S.views(spark, sf_dir, "nation", "customer", "supplier", "orders", "lineitem"))


def repeated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges with repeats, for steps that drop them themselves."""
    return S.sql(spark, S.REPEATED_LINKS, **S.views(spark, sf_dir, "nation", "customer", "supplier", "orders", "lineitem"))


def _regions(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _read(spark, sf_dir, "region").select(F.concat(F.lit("region::"), F.col("r_regionkey").cast("string")).alias(name))


_GRAPH = f"""
WITH RECURSIVE e AS ({S.LINKS}), n AS ({S.NODES}),
walk(start, id, depth) AS (SELECT 'region::' || r_regionkey, 'region::' || r_regionkey, 0 FROM region UNION SELECT w.start, e.src, w.depth + 1 FROM walk w JOIN e ON e.dst = w.id),
reach AS (SELECT start, id, min(depth) AS depth FROM walk GROUP BY 1, 2)
"""


@register("fk_edges", f"SELECT ref_type, split_part(src, '::', 1) AS src_type, split_part(dst, '::', 1) AS dst_type, count(*) AS n FROM ({S.LINKS}) GROUP BY 1, 2, 3")
def fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.distinct_edges(repeated_edges(spark, sf_dir).withColumn("pass", F.lit(0)).withColumn("seq", F.lit(0)))
    return e.groupBy("ref_type", F.substring_index("src", "::", 1).alias("src_type"), F.substring_index("dst", "::", 1).alias("dst_type")).agg(F.count("*").alias("n"))


@register("direct_dependents", f"WITH e AS ({S.LINKS}) SELECT dst AS target, count(DISTINCT src) AS n FROM e GROUP BY 1")
def direct_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return G.dependents(repeated_edges(spark, sf_dir), n, n.select(F.col("id").alias("target"))).groupBy("target").agg(F.count("*").alias("n"))


@register("direct_dependencies", f"WITH e AS ({S.LINKS}), n AS ({S.NODES}) SELECT src AS target, n.entity_type AS entity_type, count(DISTINCT dst) AS n FROM e JOIN n ON n.id = e.dst GROUP BY 1, 2")
def direct_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return G.dependencies(repeated_edges(spark, sf_dir), n, repeated_edges(spark, sf_dir).select(F.col("src").alias("target")).distinct()).groupBy("target", "entity_type").agg(F.count("*").alias("n"))


@register("impact_depth2", f"{_GRAPH} SELECT start, id, depth FROM reach WHERE depth BETWEEN 1 AND 2")
def impact_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.impact(repeated_edges(spark, sf_dir), nodes(spark, sf_dir), _regions(spark, sf_dir, "start"), 2).select("start", "id", "depth")


@register("impact_all", f"{_GRAPH} SELECT start, reach.id AS id, depth, name FROM reach JOIN n ON n.id = reach.id WHERE depth > 0")
def impact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.impact(repeated_edges(spark, sf_dir), nodes(spark, sf_dir), _regions(spark, sf_dir, "start")).select("start", "id", "depth", "name")


@register("impact_count", f"{_GRAPH} SELECT start, least(count(*) FILTER (depth > 0), 10000) AS n FROM reach GROUP BY 1")
def impact_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.impact_count(repeated_edges(spark, sf_dir), _regions(spark, sf_dir, "start"))


@register("impact_by_depth", f"{_GRAPH} SELECT start, depth, count(*) AS n FROM reach WHERE depth > 0 GROUP BY 1, 2")
def impact_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reach(repeated_edges(spark, sf_dir), _regions(spark, sf_dir, "start")).groupBy("start", "depth").agg(F.count("*").alias("n"))


@register("impact_tests", f"{_GRAPH} SELECT start, reach.id AS id FROM reach JOIN n ON n.id = reach.id WHERE depth > 0 AND contains(file_path, '/tests/') AND contains(content, '@test')")
def impact_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.impacted_tests(repeated_edges(spark, sf_dir), nodes(spark, sf_dir), _regions(spark, sf_dir, "start")).select("start", "id")


_SIZED = f"""{_GRAPH},
sized AS (SELECT start, reach.id AS id, depth, least(depth, 2) AS role, len(list_filter(string_split(replace(CASE WHEN depth < 2 THEN content ELSE string_split(content, chr(10))[1] END, chr(10), ' '), ' '), lambda w: w <> '')) * 13 // 10 AS tokens FROM reach JOIN n ON n.id = reach.id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY role, depth, id) AS rn FROM sized),
fold(start, rn, used, kept) AS (
  SELECT start, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ordered WHERE rn = 1
  UNION ALL
  SELECT f.start, f.rn + 1, CASE WHEN f.used + o.tokens <= 8000 AND (f.used < 8000 OR o.role = 0) THEN f.used + o.tokens ELSE f.used END, CASE WHEN f.used + o.tokens <= 8000 AND (f.used < 8000 OR o.role = 0) THEN f.kept + 1 ELSE f.kept END
  FROM fold f JOIN ordered o ON o.start = f.start AND o.rn = f.rn + 1 WHERE f.used < 8000
)
"""


@register("context_budget", f"{_SIZED} SELECT start AS target, max(used) AS tokens, max(kept) AS n FROM fold GROUP BY 1")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.context(repeated_edges(spark, sf_dir), nodes(spark, sf_dir), _regions(spark, sf_dir, "target"))
    return found.groupBy("target").agg(F.sum("estimated_tokens").alias("tokens"), F.count("*").alias("n"))


@register("word_references", """
WITH names AS (SELECT DISTINCT c_mktsegment AS name FROM customer UNION SELECT DISTINCT regexp_extract(text, '[A-Za-z]{3,}') FROM benchmark),
words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS name FROM documents)
SELECT doc_id, name FROM words JOIN names USING (name) WHERE name <> ''
""")
def word_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name a symbol: a market segment, or the first word of a benchmark item."""
    names = _read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).union(_read(spark, sf_dir, "benchmark").select(F.regexp_extract("text", "[A-Za-z]{3,}", 0))).filter("name <> ''").distinct()
    words = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.identifier_words("text"))).alias("name"))
    return words.join(names, "name").select("doc_id", "name")


@register("ref_types", """
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(html, '(^|[^A-Za-z0-9_])track\\(') THEN 'calls' WHEN regexp_matches(html, '(^|\\n)[ ]*(import |use |from |require\\()[^\\n]*track') THEN 'imports' ELSE 'typeref' END AS kind FROM pages) GROUP BY 1
""")
def ref_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select(T.ref_type("html", F.lit("track")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@register("search_entities", f"WITH b AS ({S.BEFORE}) SELECT id, name FROM b WHERE contains(lower(name), 'in') OR contains(lower(id), 'in')")
def search_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.search(S.snapshot(spark, sf_dir, S.BEFORE), "IN").select("id", "name")


# --- incremental ------------------------------------------------------------


@register("stale_manifest", f"""
WITH b AS (SELECT id AS f, content_hash AS h FROM ({S.BEFORE})), a AS (SELECT id AS f, content_hash AS h FROM ({S.AFTER}))
SELECT coalesce(b.f, a.f) AS file_path, CASE WHEN b.h IS NULL THEN 'new' WHEN a.h IS NULL THEN 'removed' ELSE 'changed' END AS state FROM b FULL JOIN a ON a.f = b.f WHERE a.h IS DISTINCT FROM b.h
""")
def stale_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = lambda text: S.snapshot(spark, sf_dir, text).select(F.col("id").alias("file_path"), F.col("content_hash").alias("mtime"))
    return ST.staleness(manifest(S.BEFORE), manifest(S.AFTER))


def _name_edges(entities: DataFrame) -> DataFrame:
    """A part refers to the other parts of its file and type that follow it in price; enough of a resolver to refresh."""
    own = entities.select(F.col("id").alias("src"), "file_path", F.split("content", " size ")[0].alias("kind"), "ordinal")
    w = W.partitionBy("file_path", "kind").orderBy("ordinal", "src")
    return own.select("src", F.lead("src").over(w).alias("dst"), F.lit("typeref").alias("ref_type")).filter("dst IS NOT NULL")


_NEXT = "SELECT * FROM (SELECT id AS src, lead(id) OVER (PARTITION BY file_path, string_split(content, ' size ')[1] ORDER BY ordinal, id) AS dst, 'typeref' AS ref_type FROM a) WHERE dst IS NOT NULL"


@register("incremental_equals_full", f"WITH a AS ({S.AFTER}) {_NEXT}")
def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the revised catalogue, refreshed from those of the one before for the brands that changed."""
    before, after = S.snapshot(spark, sf_dir, S.BEFORE), S.snapshot(spark, sf_dir, S.AFTER)
    digest = lambda e: e.groupBy("file_path").agg(F.md5(F.array_join(F.sort_array(F.collect_list(F.concat("id", "content_hash"))), ",")).alias("mtime"))
    stale = ST.staleness(digest(before), digest(after)).select("file_path")
    fresh = after.join(stale, "file_path", "left_semi")
    resolve = lambda ids, e: _name_edges(e).join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return ST.refresh(before, _name_edges(before), fresh, stale, resolve)[1]


# --- entities of code --------------------------------------------------------


def _code(spark: SparkSession, after: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, entities, edges) of the small repository."""
    from ..operators import scope as SC
    from ..operators.extract import extract_files
    from . import minirepo as R_

    files = R_.files(spark, R_.AFTER if after else R_.BEFORE)
    entities = cut(extract_files(files))
    return files, entities, cut(SC.resolve(SC.python_facts(files), entities))


@register("python_entities", """SELECT * FROM (VALUES ('shop/models.py::class::Base', 'class', 'Base', 1, 3), ('shop/models.py::shop/models.py::class::Base::save', 'method', 'save', 2, 3), ('shop/models.py::class::Item', 'class', 'Item', 6, 12), ('shop/models.py::shop/models.py::class::Item::__init__', 'method', '__init__', 7, 9), ('shop/models.py::shop/models.py::class::Item::label', 'method', 'label', 11, 12), ('shop/models.py::function::shorten', 'function', 'shorten', 15, 16), ('shop/models.py::function::store', 'function', 'store', 19, 20), ('shop/stock.py::class::Shelf', 'class', 'Shelf', 4, 15), ('shop/stock.py::shop/stock.py::class::Shelf::__init__', 'method', '__init__', 5, 6), ('shop/stock.py::shop/stock.py::class::Shelf::add', 'method', 'add', 8, 11), ('shop/stock.py::shop/stock.py::class::Shelf::describe', 'method', 'describe', 13, 15), ('shop/stock.py::function::open_shelf', 'function', 'open_shelf', 18, 19), ('shop/shop.py::function::run', 'function', 'run', 5, 9), ('shop/shop.py::function::report', 'function', 'report', 12, 14), ('shop/shop.py::function::test_report', 'function', 'test_report', 17, 18)) t(id, entity_type, name, start_line, end_line)""")
def python_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code(spark)[1].select("id", "entity_type", "name", "start_line", "end_line")


@register("scope_edges", """SELECT * FROM (VALUES ('shop/models.py::class::Item', 'shop/models.py::class::Base', 'typeref', 'scope_chain'), ('shop/models.py::shop/models.py::class::Base::save', 'shop/models.py::function::store', 'calls', 'scope_chain'), ('shop/models.py::shop/models.py::class::Item::label', 'shop/models.py::function::shorten', 'calls', 'scope_chain'), ('shop/stock.py::shop/stock.py::class::Shelf::__init__', 'shop/models.py::class::Item', 'typeref', 'import'), ('shop/stock.py::shop/stock.py::class::Shelf::add', 'shop/models.py::class::Item', 'typeref', 'import'), ('shop/stock.py::shop/stock.py::class::Shelf::add', 'shop/models.py::shop/models.py::class::Item::label', 'calls', 'type_tracking'), ('shop/stock.py::shop/stock.py::class::Shelf::add', 'shop/models.py::shop/models.py::class::Base::save', 'calls', 'type_tracking'), ('shop/stock.py::shop/stock.py::class::Shelf::describe', 'shop/stock.py::shop/stock.py::class::Shelf::add', 'calls', 'scope_chain'), ('shop/stock.py::shop/stock.py::class::Shelf::describe', 'shop/models.py::shop/models.py::class::Item::label', 'calls', 'type_tracking'), ('shop/stock.py::function::open_shelf', 'shop/stock.py::class::Shelf', 'typeref', 'scope_chain'), ('shop/shop.py::function::run', 'shop/stock.py::function::open_shelf', 'calls', 'import'), ('shop/shop.py::function::run', 'shop/stock.py::shop/stock.py::class::Shelf::add', 'calls', 'type_tracking'), ('shop/shop.py::function::run', 'shop/shop.py::function::report', 'calls', 'scope_chain'), ('shop/shop.py::function::report', 'shop/stock.py::class::Shelf', 'typeref', 'import'), ('shop/shop.py::function::report', 'shop/stock.py::shop/stock.py::class::Shelf::describe', 'calls', 'type_tracking'), ('shop/shop.py::function::test_report', 'shop/shop.py::function::report', 'calls', 'scope_chain'), ('shop/shop.py::function::test_report', 'shop/stock.py::function::open_shelf', 'calls', 'import')) t(src, dst, ref_type, way)""")
def scope_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code(spark)[2]


@register("code_graph", """SELECT * FROM (VALUES ('shop/models.py::class::Item', 'shop/models.py::class::Base', 'typeref'), ('shop/models.py::shop/models.py::class::Base::save', 'shop/models.py::function::store', 'calls'), ('shop/models.py::shop/models.py::class::Item::label', 'shop/models.py::function::shorten', 'calls'), ('shop/stock.py::shop/stock.py::class::Shelf::__init__', 'shop/models.py::class::Item', 'typeref'), ('shop/stock.py::shop/stock.py::class::Shelf::add', 'shop/models.py::class::Item', 'typeref'), ('shop/stock.py::shop/stock.py::class::Shelf::add', 'shop/models.py::shop/models.py::class::Item::label', 'calls'), ('shop/stock.py::shop/stock.py::class::Shelf::add', 'shop/models.py::shop/models.py::class::Base::save', 'calls'), ('shop/stock.py::shop/stock.py::class::Shelf::describe', 'shop/stock.py::shop/stock.py::class::Shelf::add', 'calls'), ('shop/stock.py::shop/stock.py::class::Shelf::describe', 'shop/models.py::shop/models.py::class::Item::label', 'calls'), ('shop/stock.py::function::open_shelf', 'shop/stock.py::class::Shelf', 'typeref'), ('shop/shop.py::function::run', 'shop/stock.py::function::open_shelf', 'calls'), ('shop/shop.py::function::run', 'shop/stock.py::shop/stock.py::class::Shelf::add', 'calls'), ('shop/shop.py::function::run', 'shop/shop.py::function::report', 'calls'), ('shop/shop.py::function::report', 'shop/stock.py::class::Shelf', 'typeref'), ('shop/shop.py::function::report', 'shop/stock.py::shop/stock.py::class::Shelf::describe', 'calls'), ('shop/shop.py::function::test_report', 'shop/shop.py::function::report', 'calls'), ('shop/shop.py::function::test_report', 'shop/stock.py::function::open_shelf', 'calls'), ('shop/models.py::class::Base', 'shop/models.py::function::store', 'calls'), ('shop/stock.py::class::Shelf', 'shop/models.py::class::Item', 'calls')) t(src, dst, ref_type)""")
def code_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import scope as SC

    files, entities, resolved = _code(spark)
    return G.build_graph(entities, SC.import_table(SC.python_facts(files), entities), resolved.drop("way"))


@register("code_diff", """SELECT * FROM (VALUES ('deleted', 'function', 'store', 'shop/models.py', NULL, NULL), ('modified', 'orphan', 'module-level', 'shop/models.py', NULL, true), ('modified', 'function', 'run', 'shop/shop.py', NULL, true), ('modified', 'function', 'shorten', 'shop/models.py', NULL, true), ('modified', 'function', 'test_report', 'shop/shop.py', NULL, true), ('renamed', 'function', 'summary', 'shop/shop.py', 'report', NULL)) t(change_type, entity_type, entity_name, file_path, old_entity_name, structural_change)""")
def code_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minirepo as R_

    return D.diff_files(R_.changes(spark)).select("change_type", "entity_type", "entity_name", "file_path", "old_entity_name", "structural_change")


@register("arity_mismatches", """SELECT * FROM (VALUES ('shop/models.py::shop/models.py::class::Item::label', 'shop/models.py::function::shorten', 3, 3, 2, 'shop/models.py', 12)) t(caller_entity, callee_entity, expected_min, expected_max, actual_args, file_path, line)""")
def arity_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import verify as V

    _, entities, edges_ = _code(spark, True)
    return V.arity_mismatches(edges_, entities)


@register("broken_callers", """SELECT * FROM (VALUES ('shop/models.py::shop/models.py::class::Item::label', 'shop/models.py::function::shorten', 3, 3, 2, 'shop/models.py', 12)) t(caller_entity, callee_entity, expected_min, expected_max, actual_args, file_path, line)""")
def broken_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import verify as V

    _, before, _ = _code(spark)
    _, after, edges_ = _code(spark, True)
    return V.broken_callers(before, after, edges_)


@register("contract_violations", """SELECT * FROM (VALUES ('describe', 'shop/stock.py', 1, 'summary', 'shop/shop.py', 0), ('label', 'shop/models.py', 1, 'add', 'shop/stock.py', 0), ('save', 'shop/models.py', 1, 'add', 'shop/stock.py', 0), ('label', 'shop/models.py', 1, 'describe', 'shop/stock.py', 0), ('add', 'shop/stock.py', 2, 'run', 'shop/shop.py', 1), ('add', 'shop/stock.py', 2, 'describe', 'shop/stock.py', 1), ('shorten', 'shop/models.py', 3, 'label', 'shop/models.py', 2)) t(entity_name, file_path, expected_params, caller_name, caller_file, actual_args)""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import verify as V

    _, entities, edges_ = _code(spark, True)
    return V.contract_violations(edges_, entities)


# --- windows of events (an extension) ---------------------------------------


@register("windowed_hotspots", "SELECT epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT AS start, event_type, count(*) AS change_count FROM events GROUP BY 1, 2")
def windowed_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import windowed_hotspots as by_window

    found = by_window(_read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], "1 hour")
    return found.select(F.unix_timestamp("start").alias("start"), "event_type", "change_count")


@register("sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 minute THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS change_count FROM s GROUP BY user_id, k
""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import sessions as by_session

    found = by_session(_read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"])
    return found.select("user_id", F.unix_timestamp("start").alias("start"), "change_count")


@register("content_hashes", "SELECT doc_id, md5(text) AS md5, substr(md5(text), 1, 8) AS short, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 37) || '...' END AS preview FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", H.content_hash("text").alias("md5"), T.short_hash(H.content_hash("text"), 8).alias("short"), T.truncated("text", 40).alias("preview"))
