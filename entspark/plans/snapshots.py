"""Tables of the test schema as entities, in SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations")

_PART = "p_name || '#' || cast(p_partkey as varchar(20))"
_TEXT = "p_type || ' size ' || cast(p_size as varchar(20)) || ' price ' || cast(cast(round(p_retailprice * 100) as bigint) as varchar(20))"

#: The catalogue before its revision: what is launched by it (sizes 1 and 2) isn't there yet.
BEFORE = f"""
SELECT *, md5(content) AS content_hash, md5(shape) AS structural_hash, file_path || '::part::' || name AS id FROM (
  SELECT p_brand AS file_path, 'part' AS entity_type, {_PART} AS name, {_TEXT} AS content, p_type || cast(p_size as varchar(20)) AS shape, p_partkey AS ordinal
  FROM part WHERE p_size > 2
) b
"""
#: After it: sizes 49 and 50 are discontinued, 10 is renamed, 20 is another brand's, 30 to 32 are described anew, 33 and 34 rebuilt.
AFTER = f"""
SELECT *, md5(content) AS content_hash, md5(shape) AS structural_hash, file_path || '::part::' || name AS id FROM (
  SELECT CASE WHEN p_size = 20 THEN 'Brand#99' ELSE p_brand END AS file_path, 'part' AS entity_type, CASE WHEN p_size = 10 THEN {_PART} || ' v2' ELSE {_PART} END AS name,
    CASE WHEN p_size BETWEEN 30 AND 32 THEN {_TEXT} || ' revised' WHEN p_size BETWEEN 33 AND 34 THEN {_TEXT} || ' rebuilt' ELSE {_TEXT} END AS content,
    CASE WHEN p_size BETWEEN 33 AND 34 THEN p_type || ' rebuilt' ELSE p_type || cast(p_size as varchar(20)) END AS shape, p_partkey AS ordinal
  FROM part WHERE p_size < 49
) a
"""

#: Everything that the foreign keys link, as entities.
NODES = """
SELECT 'region::' || cast(r_regionkey as varchar(20)) AS id, r_name AS name, 'region' AS entity_type, 'geo/region' AS file_path, r_name AS content FROM region
UNION ALL SELECT 'nation::' || cast(n_nationkey as varchar(20)), n_name, 'nation', 'geo/nation', n_name FROM nation
UNION ALL SELECT 'supplier::' || cast(s_suppkey as varchar(20)), s_name, 'supplier', 'trade/supplier', s_name FROM supplier
UNION ALL SELECT 'customer::' || cast(c_custkey as varchar(20)), c_name, 'customer', CASE WHEN c_acctbal < 0 THEN 'trade/tests/' ELSE 'trade/' END || c_mktsegment, c_name || ' ' || c_mktsegment || CASE WHEN c_acctbal < 0 THEN ' @test debtor' ELSE ' creditor' END FROM customer
UNION ALL SELECT 'order::' || cast(o_orderkey as varchar(20)), 'order ' || cast(o_orderkey as varchar(20)), 'order', 'trade/orders', 'order ' || o_orderpriority || chr(10) || 'status ' || o_orderstatus FROM orders
"""

#: src depends on dst.
LINKS = """
SELECT DISTINCT src, dst, ref_type FROM (
  SELECT 'nation::' || cast(n_nationkey as varchar(20)) AS src, 'region::' || cast(n_regionkey as varchar(20)) AS dst, 'typeref' AS ref_type FROM nation
  UNION ALL SELECT 'customer::' || cast(c_custkey as varchar(20)), 'nation::' || cast(c_nationkey as varchar(20)), 'typeref' FROM customer
  UNION ALL SELECT 'supplier::' || cast(s_suppkey as varchar(20)), 'nation::' || cast(s_nationkey as varchar(20)), 'typeref' FROM supplier
  UNION ALL SELECT 'order::' || cast(o_orderkey as varchar(20)), 'customer::' || cast(o_custkey as varchar(20)), 'calls' FROM orders
  UNION ALL SELECT 'order::' || cast(l_orderkey as varchar(20)), 'supplier::' || cast(l_suppkey as varchar(20)), 'calls' FROM lineitem
) l WHERE src IS NOT NULL AND dst IS NOT NULL
"""

#: The same with repeats.
REPEATED_LINKS = LINKS.replace("SELECT DISTINCT", "SELECT", 1)


def views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """The text's result over these tables, which no session-wide view has to name."""
    for name in tables:
        text = _named(text, name)
    return spark.sql(text, **tables)


def _named(text: str, name: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)


def snapshot(spark: SparkSession, sf_dir: str, text: str, scope: str | None = "catalogue") -> DataFrame:
    """A snapshot of ``part`` with the columns that matching needs."""
    out = sql(spark, text, **views(spark, sf_dir, "part"))
    return out.selectExpr(f"'{scope}' AS scope" if scope else "file_path AS scope", "id", "file_path", "entity_type", "name", "cast(null AS string) AS parent_id", "content", "content_hash", "structural_hash", "cast(ordinal AS int) AS start_line", "cast(ordinal AS int) AS end_line", "cast(ordinal AS int) AS ordinal")
