"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is the number of times that each of its
documents has to be seen, on average, for the mixture to have the target
weights and ``budget`` times the corpus' size.  Each document's count is drawn
by inverting the Poisson distribution with that mean at a point that is hashed
from the seed and the document, so that a rerun, on any number of executors,
repeats the same draw.  The document is exploded by its count, and the copies
are put in one global pseudo-random order.

A document's size is its characters plus one, so no source is empty.

Defined results: a null source is a source of its own.  A null text counts as
an empty one and stays null.  Rows with one doc_id get one count each, so
repeated rows repeat alike; a null doc_id draws by the MD5 of its text.  A text
of any length is a row like any other.  An empty table gives an empty result.
The order is that of ``shuffle_key`` within each of spark.sql.shuffle.partitions
parts, which are hashed by it: other settings give another order of the same
rows.  Ties of key and copy, which only repeated rows have, stand in no order.  All columns of ``docs`` stay; the added
``copy`` (1, 2, ...) and ``shuffle_key`` replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

#: Without given weights a source weighs its share of characters to this power.
TEMPERATURE = 0.5
#: Size of the mixture as a multiple of the corpus.
BUDGET = 1.0
SEED = "mix-1"
#: More sources than this are joined by shuffling, fewer by broadcasting a row of numbers for each.
BROADCAST_SOURCES = 20_000
#: exp(-rate) of a higher rate would lose its digits; such a rate is split in equal draws.
LARGEST_RATE = 200.0


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, budget: float = BUDGET) -> DataFrame:
    """(source_key, rate) of each source: target weight x budget x size of the corpus / size of the source.

    ``weights`` needn't add up to one; a source that it doesn't name gets none.
    """
    size = F.coalesce(F.col("n_chars") if "n_chars" in docs.columns else F.lit(None).cast("long"), F.length("text"), F.lit(0)).cast("long") + 1
    sizes = docs.groupBy(_key().alias("source_key")).agg(F.sum(size).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(temperature))))
    else:
        pairs = [x for s, w in weights.items() for x in (F.lit("n" if s is None else "s" + s), F.lit(float(w)))]
        weighed = sizes.withColumn("weight", F.coalesce(F.element_at(F.create_map(*pairs), F.col("source_key")), F.lit(0.0)) if pairs else F.lit(0.0))
    total = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.lit(float(budget)) * F.col("all_size") / F.col("size")).otherwise(F.lit(0.0))
    return weighed.crossJoin(total).select("source_key", rate.alias("rate"))


def _key():
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))


def _cdf(rate):
    """P(X <= k) for k = 0, 1, ... beyond any mass that a double can hold."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    zero = F.exp(-rate)
    grown = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("all")),
        lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), (acc["c"] + acc["p"] * rate / k).alias("c"), F.concat(acc["all"], F.array(acc["c"] + acc["p"] * rate / k)).alias("all")),
        lambda acc: acc["all"],
    )
    return grown


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, budget: float = BUDGET, seed: str = SEED) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in a global pseudo-random order."""
    key, draws, cdf, ident, point, count = K.spare(docs, "_key", "_draws", "_cdf", "_identity", "_point", "_count")
    table = rates(docs, weights, temperature, budget).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_RATE)).cast("int"))
    table = K.cut(table.select(F.col("source_key").alias(key), F.col("draws").alias(draws), _cdf(F.col("rate") / F.col("draws")).alias(cdf)))
    few = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    identity = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    several = F.aggregate(F.sequence(F.lit(1), F.col(draws)), F.lit(0), lambda n, j: n + F.size(F.filter(cdf, lambda c: c <= K.unit_hash(F.lit(seed), F.col(ident), j.cast("string")))))
    # most rows are drawn once: their point is hashed once, outside the lambdas
    number = F.when(F.col(draws) == 1, F.size(F.filter(cdf, lambda c: c <= F.col(point)))).otherwise(several)
    copies = (
        docs.withColumn(key, _key())
        .join(F.broadcast(table) if few else table, key)
        .withColumn(ident, identity)
        .withColumn(point, K.unit_hash(F.lit(seed), F.col(ident), F.lit("1")))
        .withColumn(count, number)
        .filter(F.col(count) > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(count))))
        .withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), ident, F.col("copy").cast("string"))))
        .drop(key, draws, cdf, ident, point, count)
    )
    return copies.repartition(K.parallelism(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key", "copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(K.table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE sized AS (
  SELECT source, sum(coalesce(n_chars, length(text), 0) + 1) AS size FROM documents GROUP BY source
),
rated AS (
  SELECT source, sqrt(size::DOUBLE) / (SELECT sum(sqrt(size::DOUBLE)) FROM sized) * (SELECT sum(size) FROM sized)::DOUBLE / size::DOUBLE AS rate FROM sized
),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rated
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 20)
),
placed AS (
  SELECT d.*, coalesce(doc_id::VARCHAR, md5(text), '') AS identity FROM documents d
),
drawn AS (
  SELECT p.*, ('0x' || substr(md5('mix-1|' || identity || '|1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM placed p
),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.identity, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u) AS n FROM drawn d
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, md5('mix-1|order|' || identity || '|' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM counted)
"""
