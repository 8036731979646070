"""Queries that send texts made of the tables through the extractors and text functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import graph as G
from ..operators import history as HI
from ..operators import match as M
from ..operators import search as SE
from ..operators.extract import extract_files
from ..session import cut
from .queries import _read, register


def _files(frame: DataFrame, path, content) -> DataFrame:
    return frame.select(path.alias("path"), content.alias("content"))


# --- structured files ---------------------------------------------------------

_CSV_ROW = "o_orderkey || ',' || o_orderstatus || ',\"' || o_orderpriority || '\"'"


@register("csv_entities", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT 'orders/' || o_custkey || '.csv::row::row[' || o_orderkey || ']' AS id, 'row' AS entity_type, 'row[' || o_orderkey || ']' AS name, k + 1 AS start_line, md5({_CSV_ROW}) AS content_hash, o_orderstatus AS status, o_orderpriority AS priority FROM r
""")  # fmt: skip
def csv_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file of each customer's orders, its rows as entities."""
    orders = _read(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", F.expr(_CSV_ROW).alias("line")).alias("o"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list("o")), lambda o: o["line"]), "\n")
    files = orders.groupBy("o_custkey").agg(lines.alias("lines"))
    found = extract_files(_files(files, F.concat(F.lit("orders/"), F.col("o_custkey").cast("string"), F.lit(".csv")), F.concat(F.lit("o_orderkey,o_orderstatus,o_orderpriority\n"), "lines", F.lit("\n"))))
    return found.select("id", "entity_type", "name", F.col("start_line").cast("long").alias("start_line"), "content_hash", F.element_at("metadata", "o_orderstatus").alias("status"), F.element_at("metadata", "o_orderpriority").alias("priority"))


@register("json_entities", """
WITH k AS (SELECT event_id, unnest(regexp_extract_all(props, '"([^"]+)": ?-?[0-9]+', 1)) AS name, unnest(regexp_extract_all(props, '"[^"]+": ?(-?[0-9]+)', 1)) AS value FROM events)
SELECT 'event/' || event_id || '.json::/' || name AS id, 'property' AS entity_type, name, md5(value) AS structural_hash FROM k
UNION ALL SELECT 'event/' || event_id || '.json::/of', 'object', 'of', md5('{"user": ' || user_id || '}') FROM events
UNION ALL SELECT 'event/' || event_id || '.json::/of/user', 'property', 'user', md5(CAST(user_id AS VARCHAR)) FROM events
""")
def json_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's properties with an object inside as a JSON file, its keys as entities."""
    events = _read(spark, sf_dir, "events")
    nested = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "of": {"user": '), F.col("user_id").cast("string"), F.lit("}}"))
    found = extract_files(_files(events, F.concat(F.lit("event/"), F.col("event_id").cast("string"), F.lit(".json")), nested))
    return found.select("id", "entity_type", "name", "structural_hash")


@register("markdown_entities", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
c AS (SELECT DISTINCT o_custkey FROM orders)
SELECT 'notes/' || o_custkey || '.md::heading::customer ' || o_custkey AS id, 'customer ' || o_custkey AS name, CAST(NULL AS VARCHAR) AS parent_id, 1 AS start_line, 2 AS end_line FROM c
UNION ALL SELECT 'notes/' || o_custkey || '.md::notes/' || o_custkey || '.md::heading::customer ' || o_custkey || '::order ' || o_orderkey, 'order ' || o_orderkey, 'notes/' || o_custkey || '.md::heading::customer ' || o_custkey, 3 * k, 3 * k + 2 FROM r
""")
def markdown_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown file of each customer, the orders as sections under the customer's."""
    section = F.concat(F.lit("## order "), F.col("o_orderkey").cast("string"), F.lit("\n\nstatus "), "o_orderstatus")
    orders = _read(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", section.alias("text")).alias("o"))
    files = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("o")), lambda o: o["text"]), "\n").alias("text"))
    key = F.col("o_custkey").cast("string")
    found = extract_files(_files(files, F.concat(F.lit("notes/"), key, F.lit(".md")), F.concat(F.lit("# customer "), key, F.lit("\n\n"), "text", F.lit("\n"))))
    return found.select("id", "name", "parent_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@register("yaml_entities", """
SELECT 's/' || s_suppkey || '.yaml::property::name' AS id, 'property' AS entity_type, 1 AS start_line, 1 AS end_line, md5('name: "' || s_name || '"') AS content_hash FROM supplier
UNION ALL SELECT 's/' || s_suppkey || '.yaml::section::place', 'section', 2, 3, md5('place:' || chr(10) || '  nation: ' || s_nationkey) FROM supplier
UNION ALL SELECT 's/' || s_suppkey || '.yaml::property::key', 'property', 4, 4, md5('key: ' || s_suppkey) FROM supplier
""")
def yaml_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A YAML file of each supplier, its top-level keys as entities."""
    s = _read(spark, sf_dir, "supplier")
    text = F.expr("""'name: "' || s_name || '"\\nplace:\\n  nation: ' || cast(s_nationkey as string) || '\\nkey: ' || cast(s_suppkey as string) || '\\n'""")
    found = extract_files(_files(s, F.expr("'s/' || cast(s_suppkey as string) || '.yaml'"), text))
    return found.select("id", "entity_type", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "content_hash")


@register("toml_entities", """
SELECT 's/' || s_suppkey || '.toml::property::key' AS id, 'property' AS entity_type, 1 AS start_line, 1 AS end_line, md5(CAST(s_suppkey AS VARCHAR)) AS content_hash FROM supplier
UNION ALL SELECT 's/' || s_suppkey || '.toml::section::place', 'section', 2, 4, md5('{' || chr(10) || '  "nation": ' || s_nationkey || chr(10) || '}') FROM supplier
""")
def toml_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TOML file of each supplier; a section is hashed by its value, so its comment doesn't count."""
    s = _read(spark, sf_dir, "supplier")
    text = F.expr("""'key = ' || cast(s_suppkey as string) || '\\n[place]\\n# where it is: ' || s_name || '\\nnation = ' || cast(s_nationkey as string) || '\\n'""")
    found = extract_files(_files(s, F.expr("'s/' || cast(s_suppkey as string) || '.toml'"), text))
    return found.select("id", "entity_type", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "content_hash")


@register("vue_entities", """
SELECT 'p/' || page_id || '.vue::sfc_block::template' AS id, 'sfc_block' AS entity_type, 1 AS start_line, 3 AS end_line FROM pages
UNION ALL SELECT 'p/' || page_id || '.vue::sfc_block::script', 'sfc_block', 4, 7 FROM pages
UNION ALL SELECT 'p/' || page_id || '.vue::p/' || page_id || '.vue::sfc_block::script::load' || page_id, 'function', 5, 6 FROM pages
""")
def vue_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component of each page, with its link as the template and a function that loads it."""
    pages = _read(spark, sf_dir, "pages")
    text = F.expr("""'<template>\\n<a href="' || url || '">x</a>\\n</template>\\n<script>\\nfunction load' || cast(page_id as string) || '() {\\n}\\n</script>\\n'""")
    found = extract_files(_files(pages, F.expr("'p/' || cast(page_id as string) || '.vue'"), text))
    return found.select("id", "entity_type", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@register("template_entities", """
SELECT 'p/' || page_id || '.erb::template::' || page_id AS id, 'template' AS entity_type FROM pages
UNION ALL SELECT 'p/' || page_id || '.erb::p/' || page_id || '.erb::template::' || page_id || '::title_' || page_id, 'erb_expression' FROM pages
UNION ALL SELECT 'p/' || page_id || '.xml::element::page', 'element' FROM pages
UNION ALL SELECT 'p/' || page_id || '.xml::p/' || page_id || '.xml::element::page::url', 'element' FROM pages
""")
def template_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template and an XML file of each page."""
    pages = _read(spark, sf_dir, "pages")
    erb = _files(pages, F.expr("'p/' || cast(page_id as string) || '.erb'"), F.expr("'<h1><%= title_' || cast(page_id as string) || ' %></h1>\\n'"))
    xml = _files(pages, F.expr("'p/' || cast(page_id as string) || '.xml'"), F.expr("'<page>\\n<url>' || cast(page_id as string) || '</url>\\n</page>\\n'"))
    return extract_files(erb.unionByName(xml)).select("id", "entity_type")


# --- code ---------------------------------------------------------------------

#: Extension, text, and its entities (type, name, parent's type and name, first line, last line); # is a nation's key.
CODE = (
    ("ts", "export class C# {\n  run(a: string): void {\n  }\n}\nfunction outer#() {\n  function inner() {\n  }\n}\ninterface I# {\n}\n", (("class", "C#", None, 1, 4), ("method", "run", "class::C#", 2, 3), ("function", "outer#", None, 5, 8), ("function", "inner", "function::outer#", 6, 7), ("interface", "I#", None, 9, 10))),
    ("js", "const x# = 1;\nfunction f#() {\n}\n", (("variable", "x#", None, 1, 1), ("function", "f#", None, 2, 3))),
    ("py", "class K#:\n    def m(self):\n        pass\n\n\ndef f#():\n    def g():\n        return 1\n    return g\n", (("class", "K#", None, 1, 3), ("method", "m", "class::K#", 2, 3), ("function", "f#", None, 6, 9), ("function", "g", "function::f#", 7, 8))),
    ("go", "type S# struct {\n}\n\nfunc (s *S#) M() {\n}\n\nfunc F#() {\n}\n", (("struct", "S#", None, 1, 2), ("method", "M", "struct::S#", 4, 5), ("function", "F#", None, 7, 8))),
    ("rs", "pub struct S# {\n}\n#[test]\nfn t#() {\n    fn inner() {\n    }\n}\n", (("struct", "S#", None, 1, 2), ("function", "t#", None, 3, 7), ("function", "inner", "function::t#", 5, 6))),
    ("java", "public class A# {\n  public int f(int a) {\n    if (a > 0) {\n    }\n  }\n}\n", (("class", "A#", None, 1, 6), ("method", "f", "class::A#", 2, 5))),
    ("c", "struct s# {\n};\nstatic int\nmain#(void)\n{\n  return 0;\n}\n", (("struct", "s#", None, 1, 2), ("function", "main#", None, 3, 7))),
    ("cpp", "class P# {\n  int g() {\n  }\n};\n", (("class", "P#", None, 1, 4), ("method", "g", "class::P#", 2, 3))),
    ("cs", "namespace N# {\n  class B\n  {\n  }\n}\n", (("namespace", "N#", None, 1, 5), ("class", "B", "namespace::N#", 2, 4))),
    ("rb", "module M#\n  class A\n  end\nend\n", (("module", "M#", None, 1, 4), ("class", "A", "module::M#", 2, 3))),
    ("php", "<?php\nfunction f#() {\n}\n", (("function", "f#", None, 2, 3),)),
    ("kt", "class A# {\n  fun b() {\n  }\n}\n", (("class", "A#", None, 1, 4), ("method", "b", "class::A#", 2, 3))),
    ("swift", "struct S# {\n}\n", (("struct", "S#", None, 1, 2),)),
    ("sh", "deploy#() {\n  x\n}\n", (("function", "deploy#", None, 1, 3),)),
    ("tf", 'resource "x" "y#" {\n}\n', (("block", "resource.x.y#", None, 1, 2),)),
    ("ex", "defmodule A# do\n  def f(x) do\n    x\n  end\nend\n", (("module", "A#", None, 1, 5), ("function", "f", "module::A#", 2, 4))),
    ("pl", "sub run# {\n}\n", (("function", "run#", None, 1, 2),)),
    ("scala", "object O# {\n}\n", (("object", "O#", None, 1, 2),)),
    ("dart", "class D# {\n}\n", (("class", "D#", None, 1, 2),)),
    ("f90", "module m#\nend module m#\n", (("module", "m#", None, 1, 2),)),
    ("ml", "let f# x =\n  x\n", (("value", "f#", None, 1, 2),)),
    ("zig", "fn f#() void {\n}\n", (("function", "f#", None, 1, 2),)),
    ("nix", "a# = 1;\n", (("attribute", "a#", None, 1, 1),)),
)


def _code_oracle() -> str:
    rows = ", ".join(f"('{ext}', '{kind}', '{name}', {f"'{parent}'" if parent else 'NULL'}, {a}, {b})" for ext, _, own in CODE for kind, name, parent, a, b in own)
    return f"""
WITH t(ext, kind, name, parent, a, b) AS (VALUES {rows}),
n AS (SELECT 'n/' || n_nationkey || '.' || ext AS path, kind, replace(name, '#', CAST(n_nationkey AS VARCHAR)) AS name, replace(parent, '#', CAST(n_nationkey AS VARCHAR)) AS parent, a, b FROM t, nation)
SELECT path || '::' || coalesce(path || '::' || parent, kind) || '::' || name AS id, kind AS entity_type, path || '::' || parent AS parent_id, a AS start_line, b AS end_line FROM n
"""


def _code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame([(ext, text) for ext, text, _ in CODE], "ext string, text string")
    nations = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"))
    both = nations.crossJoin(F.broadcast(texts))  # 23 rows of data for each nation
    return both.select(F.concat(F.lit("n/"), "key", F.lit("."), "ext").alias("path"), F.replace("text", F.lit("#"), F.col("key")).alias("content"))


@register("code_entities", _code_oracle())
def code_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file in each of 23 languages for each nation."""
    found = extract_files(_code_files(spark, sf_dir).withColumn("content", F.regexp_replace("content", r"(?m)^[0-9]+\[test\]", "#[test]")))
    return found.select("id", "entity_type", "parent_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@register("parent_chains", """
WITH RECURSIVE up(s_suppkey, depth) AS (SELECT s_suppkey, 20 FROM supplier UNION ALL SELECT s_suppkey, depth - 1 FROM up WHERE depth > 1)
SELECT s_suppkey, string_agg('p' || depth, '::' ORDER BY depth) AS parent_name FROM up GROUP BY s_suppkey
""")
def parent_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of twenty ancestors for each supplier's entity, by their names."""
    every = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("scope"))
    levels = every.select("scope", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k"))
    parents = levels.select("scope", F.concat(F.lit("p"), "k").alias("id"), F.concat(F.lit("p"), "k").alias("name"), F.when(F.col("k") > 1, F.concat(F.lit("p"), F.col("k") - 1)).alias("parent_id"))
    changes = every.select("scope", F.lit("c").alias("id"), F.lit("p20").alias("parent_id"))
    found = M.with_parent_names(changes, parents, parents.limit(0))
    return found.select(F.col("scope").cast("long").alias("s_suppkey"), "parent_name")


# --- functions ----------------------------------------------------------------


@register("similarity_of_neighbours", """
WITH t AS (SELECT doc_id, lead(doc_id) OVER (ORDER BY doc_id) AS other, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT a.doc_id, len(a.w) AS na, len(b.w) AS nb, len(list_intersect(list_distinct(a.w), list_distinct(b.w))) AS common, len(list_distinct(a.w || b.w)) AS whole FROM t a JOIN t b ON b.doc_id = a.other)
SELECT doc_id, round(CASE WHEN whole = 0 THEN 0 ELSE common / whole END, 9) AS jaccard, CASE WHEN greatest(na, nb) = 0 THEN true ELSE least(na, nb) >= 0.5 * greatest(na, nb) END AS near_size,
  round(CASE WHEN greatest(na, nb) > 0 AND least(na, nb) < 0.6 * greatest(na, nb) OR whole = 0 THEN 0 ELSE common / whole END, 9) AS similarity FROM p
""")
def similarity_of_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the next one by doc_id."""
    docs = _read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    following = HI.consecutive(docs.select(F.col("doc_id").alias("sha"), (-F.col("doc_id")).alias("ts")))  # the next id is the older one
    b = docs.select(F.col("doc_id").alias("newer"), F.col("text").alias("other"))
    pairs = following.select(F.col("older").alias("newer"), F.col("newer").alias("doc_id")).join(b, "newer").join(docs, "doc_id")
    return pairs.select("doc_id", F.round(T.jaccard(T.token_set("text"), T.token_set("other")), 9).alias("jaccard"), T.size_ratio_at_least(F.size(T.tokens("text")), F.size(T.tokens("other")), 0.5).alias("near_size"), F.round(T.default_similarity("text", "other"), 9).alias("similarity"))


#: Function, its argument, what it gives.
FUNCTIONS = (
    ("strip", 'a = "x # y" # c', "a =    "), ("strip", "f(1) // no\ng /* b\nc */ h", "f(1)  \ng   h"),
    ("chains", "self.run() + Shelf.add(self.run, 1.5)", "self.run|Shelf.add"),
    ("references", "def total(order):\n    return price(order.rate) * Rate('price_text')  # skipped", "order|price|rate|Rate"),
    ("ref_type", "x = track(1)", "calls"), ("ref_type", "from lib import track", "imports"), ("ref_type", "y = track", "typeref"), ("ref_type", "backtrack(1)", "typeref"),
    ("stem", "src/models/item.py", "item"), ("stem", "lib/a.b.ts", "a.b"), ("stem", "README", "README"),
    ("extensions", "dir/a.svelte.TS", ".svelte.ts|.ts"), ("extensions", "Makefile", ""),
    ("base_type", "&mut Vec<Item>", "Vec"), ("base_type", ": *Shelf", "Shelf"), ("base_type", "Map[str, int]", "Map"),
    ("is_test", "test_add", "true"), ("is_test", "addTest", "true"), ("is_test", "contest", "false"),
    ("has_extension", "a/b.py", "true"), ("has_extension", "a/b.pyc", "false"),
    ("params", "def f(self, a, b=(1, 2)):", "3"), ("params", "fn f()", "0"), ("params", "void g(Map<K, V> m, int n)", "2"),
    ("date", "86399", "1970-01-01"), ("date", "1700000000", "2023-11-14"),
    ("tokens", "one two\n three  four", "5"), ("tokens", "", "0"),
    ("first_line", "a\r\nb", "a"), ("first_line", "only", "only"),
    ("lines", "a\nb\n", "a|b"), ("lines", "a\r\n\nb", "a||b"),
    ("truncated", "abcdefghij", "abcde..."), ("truncated", "abc", "abc"),
    ("xxh3", "abc", "78af5f94892f3950"),
    ("same_structure", "f(1)  # note", "true"), ("same_structure", "f(2)", "false"),
)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'"


@register("text_functions", "WITH f(fn, arg, result) AS (VALUES " + ", ".join(f"('{fn}', {_quoted(arg)}, {_quoted(result)})" for fn, arg, result in FUNCTIONS) + ") SELECT DISTINCT fn, arg, result, r_name FROM f, region")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions of texts on stated cases, for each region."""
    cases = spark.createDataFrame([(fn, arg) for fn, arg, _ in FUNCTIONS], "fn string, arg string")
    rows = _read(spark, sf_dir, "region").select("r_name").crossJoin(F.broadcast(cases))
    arg = F.col("arg")
    text = lambda c: c.cast("string")
    joined = lambda c: F.array_join(c, "|")
    by = {
        "strip": T.strip_comments_and_strings(arg), "chains": joined(T.dot_chains(arg)), "references": joined(T.references(arg, F.lit("total"))), "ref_type": T.ref_type(arg, F.lit("track")), "stem": T.file_stem(arg), "extensions": joined(T.extensions(arg)),
        "base_type": T.base_type(arg), "is_test": text(T.is_test_entity(arg, F.lit("src/a.py"), F.lit(""))), "has_extension": text(T.has_extension(arg, ["py"])), "params": text(T.param_count(arg)), "date": T.utc_date(F.try_to_number(arg, F.lit("9999999999"))), "tokens": text(T.estimate_tokens(arg)),
        "first_line": T.first_line(arg), "lines": joined(T.lines_of(arg)), "truncated": T.truncated(arg, 8), "xxh3": H.content_hash(arg, "xxh3"), "same_structure": text(H.structural_proxy(arg) == H.structural_proxy(F.lit("f(1)"))),
    }
    result = F.coalesce(*(F.when(F.col("fn") == name, value) for name, value in by.items()))
    return rows.select("fn", "arg", result.alias("result"), "r_name")


# --- graphs of words and finding entities -------------------------------------


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer as a function of the file of its market segment, which calls the function of the next key and names its nation's."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    name = F.concat(F.lit("Fn"), F.col("c_custkey").cast("string"))
    body = F.concat(F.lit("def "), name, F.lit("():\n    return Fn"), (F.col("c_custkey") + 1).cast("string"), F.lit("() + Nation"), F.col("c_nationkey").cast("string"), F.lit("\n"))
    path = F.concat("c_mktsegment", F.lit(".py"))
    return c.select(T.entity_id(path, F.lit("function"), name).alias("id"), path.alias("file_path"), F.lit("function").alias("entity_type"), name.alias("name"), F.lit(None).cast("string").alias("parent_id"), body.alias("content"), F.col("c_custkey").cast("int").alias("start_line"), F.col("c_custkey").cast("int").alias("ordinal"))


_NATION_ID = "'nations.py::class::Nation' || n_nationkey"


@register("word_graph", f"""
WITH c AS (SELECT c_custkey AS k, c_mktsegment || '.py::function::Fn' || c_custkey AS id, c_mktsegment AS seg, c_nationkey AS n FROM customer)
SELECT a.id AS src, b.id AS dst, 'calls' AS ref_type FROM c a JOIN c b ON b.k = a.k + 1 AND a.seg = b.seg
UNION ALL SELECT c.id, {_NATION_ID}, 'typeref' FROM c JOIN nation ON n_nationkey = c.n WHERE n_nationkey % 2 = 0
""")
def word_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by names: to functions of the same file, and to the nations that every file imports; the others are named in vain."""
    nations = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), (F.col("n_nationkey") % 2 == 0).alias("even"))
    classes = nations.select(F.concat(F.lit("nations.py::class::Nation"), "key").alias("id"), F.lit("nations.py").alias("file_path"), F.lit("class").alias("entity_type"), F.concat(F.lit("Nation"), "key").alias("name"), F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("content"), F.lit(1).alias("start_line"), F.lit(1).alias("ordinal"))
    customers = cut(_customers(spark, sf_dir))
    # every file imports the even nations
    imports = customers.select("file_path").distinct().crossJoin(F.broadcast(nations.filter("even"))).select("file_path", F.concat(F.lit("Nation"), "key").alias("local_name"), F.concat(F.lit("nations.py::class::Nation"), "key").alias("target"))
    return G.build_graph(customers.unionByName(classes), imports).select("src", "dst", "ref_type")


@register("found_entities", """
WITH c AS (SELECT c_mktsegment || '.py::function::Fn' || c_custkey AS id, 'Fn' || c_custkey AS name, c_mktsegment || '.py' AS file_path FROM customer)
SELECT 'by name' AS way, min(id) AS id FROM c WHERE name = 'Fn7' UNION ALL SELECT 'by id', id FROM c WHERE name = 'Fn11' UNION ALL SELECT 'near', min(id) FROM c WHERE name = 'Fn12'
""")
def found_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity by its name, by its id, and by its name rather in a file that hasn't got it."""
    c = cut(_customers(spark, sf_dir))
    eleven = c.filter("name = 'Fn11'").select("id").first()["id"]
    ways = (("by name", SE.find(c, name="Fn7")), ("by id", SE.find(c, entity_id=eleven)), ("near", SE.find_near(c, "Fn12", "none.py")))
    found = [frame.select(F.lit(way).alias("way"), "id") for way, frame in ways]
    return found[0].unionByName(found[1]).unionByName(found[2])


@register("graph_accuracy", "SELECT 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1")
def graph_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges by names against those that the table says."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    name = lambda key: F.concat("c_mktsegment", F.lit(".py::function::Fn"), key.cast("string"))
    following = c.select((F.col("c_custkey") - 1).alias("c_custkey"), "c_mktsegment").join(c.select("c_custkey", "c_mktsegment"), ["c_custkey", "c_mktsegment"])
    calls = following.select(name(F.col("c_custkey")).alias("src"), name(F.col("c_custkey") + 1).alias("dst"))
    named = c.filter("c_nationkey % 2 = 0").select(name(F.col("c_custkey")).alias("src"), F.concat(F.lit("nations.py::class::Nation"), F.col("c_nationkey").cast("string")).alias("dst"))
    return G.accuracy(word_graph(spark, sf_dir), calls.unionByName(named))


@register("moved_entities", """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) = 1))
SELECT o_orderkey AS sha, 'order' AS name, 'old/' || o_custkey AS file_path, 'new/' || o_custkey AS to_path FROM o WHERE o_orderstatus <> 'P'
""")
def moved_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a commit in which an entity leaves its file and is found in another: by its name, or by its structure; others go for good."""
    orders = _read(spark, sf_dir, "orders")
    single = orders.groupBy("o_orderkey").count().filter("count = 1").select("o_orderkey")
    o = orders.join(single, "o_orderkey").select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").cast("string").alias("cust"), "o_orderstatus")
    gone = o.select("sha", F.lit("order").alias("name"), F.lit("s").alias("structural_hash"), F.concat(F.lit("old/"), "cust").alias("file_path"))
    name = F.when(F.col("o_orderstatus") == "O", "order").otherwise("renamed")
    there = o.select("sha", name.alias("name"), F.when(F.col("o_orderstatus") == "F", "s").otherwise("t").alias("structural_hash"), F.concat(F.lit("new/"), "cust").alias("file_path"), F.col("cust").alias("id"))
    return HI.moved_to(gone, there).select("sha", "name", "file_path", "to_path")
