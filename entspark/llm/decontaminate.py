"""Benchmark decontamination with an FM-index of each shard of the corpus.

A phrase is a run of N words of a benchmark item (an item of fewer words, but
LEAST_WORDS at least, is one phrase; a shorter one is left out, as it would
match by chance).  A task cuts its documents in shards of about SHARD_WORDS
words; words that no phrase has become separators, runs of which are one.
Each shard gets an FM-index; all phrases are searched backward at once through
wavelet ranks, and occurrences are located by sampled suffix positions.
Overlapping and touching occurrences merge to spans of words.

Words are those of ``kernels``: case and punctuation between words don't count.

The phrases travel with the task when their text is at most SLICE_CHARS;
a larger benchmark goes in slices by hash, each a pass over the corpus that
searches the original text; the result is that of one slice.

Defined results: a null or wordless text has no spans; a document of any
length is indexed whole (a long one is a shard of its own).  Equal rows have
equal spans; ``occurrences`` and ``spans`` give them once per doc_id and
place.  A null doc_id is allowed.  Null or wordless benchmark items are left
out; an empty benchmark or corpus gives no spans.  ``decontaminate`` keeps all
columns of ``docs``; other columns of ``benchmark`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .fm_index import FMIndex

N, LEAST_WORDS = 8, 5
SHARD_WORDS = 1_000_000
#: Characters of benchmark text that are sent with each task.
SLICE_CHARS = 16_000_000


class Phrases:
    """The phrases of some benchmark items, by length, as rows of word numbers from 1."""

    def __init__(self, items: list[tuple[int | None, str]], n: int = N, least: int = LEAST_WORDS):
        hashes, at = K.word_hashes([t for _, t in items])
        self.vocabulary = np.unique(hashes)
        number = np.searchsorted(self.vocabulary, hashes) + 1
        rows: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for k, (item, _) in enumerate(items):
            own = number[at[k] : at[k + 1]].tolist()
            size = min(n, len(own))
            if size >= min(n, least):
                for i in range(len(own) - size + 1):
                    rows.setdefault(size, {}).setdefault(tuple(own[i : i + size]), []).append(item)
        self.by_size = {size: (np.array(list(own), np.int64), [sorted({i for i in x if i is not None}) for x in own.values()]) for size, own in rows.items()}
        # words of no phrase needn't be told apart
        used = np.unique(np.concatenate([m.ravel() for m, _ in self.by_size.values()])) if self.by_size else np.empty(0, np.int64)
        self.vocabulary = self.vocabulary[used - 1] if len(used) else np.empty(0, np.uint64)
        for size, (matrix, own) in self.by_size.items():
            self.by_size[size] = (np.searchsorted(used, matrix) + 1, own)
        # a table by the hashes' low bits spares most words the binary search
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for one of no phrase."""
        out = np.zeros(len(hashes), np.int64)
        some = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        own = hashes[some]
        at = np.searchsorted(self.vocabulary, own)
        at[at == len(self.vocabulary)] = 0
        out[some] = np.where(self.vocabulary[at] == own, at + 1, 0)
        return out

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, list[int]]]:
        """(text, first word, number of words, items) of every occurrence in a shard."""
        if not self.by_size:
            return []
        numbers, counts = [], []
        for a, b in K.chunks(texts):
            hashes, at = K.word_hashes(texts[a:b])
            counts.append(np.diff(at))
            numbers.append(self.numbers(hashes))
        count = np.concatenate(counts)
        number = np.concatenate(numbers)
        if not number.any():
            return []
        # a separator after each text
        ends = np.cumsum(count)
        text = np.insert(number, ends, 0)
        keep = np.ones(len(text), bool)
        keep[1:] = (text[1:] != 0) | (text[:-1] != 0)
        place = np.flatnonzero(keep)
        index = FMIndex(text[keep], len(self.vocabulary) + 1)
        begins = np.concatenate([[0], ends[:-1]]) + np.arange(len(count))
        out = []
        for size, (matrix, items) in self.by_size.items():
            which, low, high = index.search(matrix)
            if not len(which):
                continue
            many = high - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            at = place[index.locate(rows)]
            doc = np.searchsorted(begins, at, side="right") - 1
            for d, p, w in zip(doc.tolist(), (at - begins[doc]).tolist(), np.repeat(which, many).tolist()):
                out.append((d, p, size, items[w]))
        return out


def merged(found: list[tuple[int, int, int, list[int]]]) -> dict[int, list[tuple[int, int]]]:
    """Of each text the spans of words, overlapping and touching ones in one."""
    out: dict[int, list[tuple[int, int]]] = {}
    for d, p, size, _ in sorted(found, key=lambda x: x[:3]):
        own = out.setdefault(d, [])
        if own and p <= own[-1][1]:
            own[-1] = (own[-1][0], max(own[-1][1], p + size))
        else:
            own.append((p, p + size))
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without these spans of words and what stands between their words."""
    low = text.lower()
    if len(low) == len(text):
        words = [m.span() for m in K.WORD.finditer(low)]
    else:  # lower-casing changed the length: carry every character's place along
        owner = [i for i, c in enumerate(text) for _ in c.lower()]
        low = "".join(c.lower() for c in text)
        words = [(owner[m.start()], owner[m.end() - 1] + 1) for m in K.WORD.finditer(low)]
    parts, at = [], 0
    for first, end in spans:
        parts.append(text[at : words[first][0]])
        at = words[end - 1][1]
    return "".join([*parts, text[at:]])


def _shards(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of a task in tables of about SHARD_WORDS words (by six characters each)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)) if pa.types.is_string(texts.type) else np.array([len(t or "") for t in texts.to_pylist()])
        at = 0
        for k, many in enumerate(lengths):
            size += int(many)
            if size >= 6 * SHARD_WORDS:
                held.append(batch.slice(at, k + 1 - at))
                yield pa.Table.from_batches(held)
                held, size, at = [], 0, k + 1
        if at < len(lengths):
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct items in lists of a bounded size."""
    items = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    many = -(-chars // SLICE_CHARS)
    for k in range(many):
        part = items if many == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(many)) == k)
        yield [(r.item_id, r.text) for r in part.collect()]


def occurrences(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, first_word, end_word, item_id) of each phrase's every occurrence, words counted from 0."""
    schema = "doc_id long, first_word long, end_word long, item_id long"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _slices(benchmark):
        phrases = Phrases(items, n)

        def run(batches: Iterator[pa.RecordBatch], phrases: Phrases = phrases) -> Iterator[pa.RecordBatch]:
            for shard in _shards(batches, "text"):
                ids = shard.column(0).to_pylist()
                rows = [(ids[d], p, p + size, i) for d, p, size, own in phrases.find(shard.column(1).to_pylist()) for i in own or [None]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "first_word", "end_word", "item_id"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL").mapInArrow(run, schema))
    return out


def spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, first_word, end_word, n_items) of the merged removal spans."""
    ordered = W.partitionBy("doc_id").orderBy("first_word", "end_word")
    found = occurrences(docs, benchmark, n).groupBy("doc_id", "first_word", "end_word").agg(F.collect_set("item_id").alias("items"))
    fresh = F.coalesce((F.col("first_word") > F.max("end_word").over(ordered.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(0))
    grouped = found.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy("doc_id", "span").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.size(F.array_distinct(F.flatten(F.collect_list("items")))).cast("long").alias("n_items")).drop("span")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``docs`` without the benchmark's passages; ``n_chars`` follows where it is a column, and a document with nothing left goes.

    It is one pass over the documents without a shuffle.  With a benchmark of
    several slices each pass adds what it finds in the text, which stays as it
    was, to a column of spans, and the last one cuts them all.
    """
    fields = docs.schema.fields
    (marks,) = K.spare(docs, "_spans")
    slices = _slices(benchmark)
    items, first = next(slices, None), True
    while items is not None:
        phrases, following = Phrases(items, n), next(slices, None)

        def run(batches: Iterator[pa.RecordBatch], phrases: Phrases = phrases, first: bool = first, last: bool = following is None) -> Iterator[pa.RecordBatch]:
            for shard in _shards(batches, "text"):
                found = phrases.find(shard.column("text").to_pylist())
                if not first:
                    found += [(d, a, b - a, []) for d, own in enumerate(shard.column(marks).to_pylist()) for a, b in zip(own[::2], own[1::2])]
                    shard = shard.drop_columns([marks])
                spans = merged(found)
                if not last:
                    shard = shard.append_column(marks, pa.array([[x for span in spans.get(d, ()) for x in span] for d in range(len(shard))], pa.list_(pa.int64())))
                elif spans:
                    shard = _without(shard, spans)
                yield from shard.to_batches(max_chunksize=10_000)

        docs = docs.mapInArrow(run, T.StructType(fields if following is None else [*fields, T.StructField(marks, T.ArrayType(T.LongType()))]))
        items, first = following, False
    return docs


def _without(shard: pa.Table, spans: dict[int, list[tuple[int, int]]]) -> pa.Table:
    """The rows of a shard without these spans of words of each text."""
    columns = shard.column_names
    at = columns.index("text")
    texts = shard.column(at).to_pylist()
    for d, own in spans.items():
        texts[d] = cut_words(texts[d], own)
    shard = shard.set_column(at, shard.field(at), pa.array(texts, shard.field(at).type))
    if "n_chars" in columns:
        k = columns.index("n_chars")
        counts = shard.column(k).to_pylist()
        for d in spans:
            counts[d] = len(texts[d])
        shard = shard.set_column(k, shard.field(k), pa.array(counts, shard.field(k).type))
    empty = {d for d in spans if not K.WORD.search(texts[d].lower())}
    if empty:
        shard = shard.filter(pa.array([d not in empty for d in range(len(texts))]))
    return shard


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(K.table(spark, sf_dir, "documents"), K.table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(lower(text), '[0-9a-z_\\x{80}-\\x{10FFFF}]+')"

ORACLE = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
phrases AS (
  SELECT DISTINCT item_id, least(len(w), {N}) AS size, unnest(list_transform(range(1, len(w) - least(len(w), {N}) + 2), lambda i: array_to_string(w[i:i + least(len(w), {N}) - 1], ' '))) AS phrase
  FROM items WHERE len(w) >= {LEAST_WORDS}
),
words AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT DISTINCT size FROM phrases),
windows AS (
  SELECT doc_id, size, unnest(range(0, len(w) - size + 1)) AS first_word, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM words, sizes WHERE len(w) >= size
),
found AS (SELECT DISTINCT doc_id, first_word, first_word + p.size AS end_word, item_id FROM windows v JOIN phrases p ON v.phrase = p.phrase AND v.size = p.size),
marked AS (
  SELECT *, CASE WHEN first_word > max(end_word) OVER (PARTITION BY doc_id ORDER BY first_word, end_word, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM found
),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY first_word, end_word, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span FROM marked)
SELECT doc_id, min(first_word) AS first_word, max(end_word) AS end_word, count(DISTINCT item_id) AS n_items FROM grouped GROUP BY doc_id, span
"""
