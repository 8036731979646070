"""Quality classifier by co-training of two views.

The text view sees hashed byte 4-grams of the content; the metadata view sees
the source, the language, the length and how the page is laid out (lines,
shares of upper case, digits and symbols, shares of distinct words and of
words that repeat the one before).  Each is a
logistic regression.  Both begin from the same labelled documents; over rounds
each judges all other documents of the corpus, and of those that the other view
hasn't learned from, its most confident ones of both classes go to the other
view's training set.  Views are calibrated (Platt) on labelled documents kept
out of training, and their log odds are added, less the prior's that both
contain.  All documents are then scored in one pass; what travels is two weight
vectors of fixed size, and in a round 2 x PER_ROUND documents' features.

The features of all documents are written once, to the shared folder, and each
round reads them; they are removed after training.  Learning uses at most
LABELLED labelled documents, those of the least hashes of their doc_id;
everything else sees all rows.

Defined results: every row has a row.  A null text or one without any
non-blank character has the score 0.0 and is rejected.  A null source or
language is a value of its own.  Labels of one doc_id that contradict each
other are left out, and so are null ones.  Without labels of both classes no
document is judged: the score is null and all with content are kept.  Repeated
rows get equal scores and are learned from once; of equally confident documents
the least hash goes first.  A text of any length is read whole; an empty table
gives an empty result.  ``keep_good`` keeps the columns of ``docs`` as they are,
whatever others there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from .language_id import windows

LABELLED = 3_000
ROUNDS, PER_ROUND = 5, 100
#: Places of hashed 4-grams, of hashed sources and languages; share of labelled documents that only calibrate.
TEXT_DIMS, NAME_DIMS, HELD_OUT = 2_048, 64, 0.3
SHRINK = 64
#: A document goes when its probability of good quality is below this: losing a good one counts four times keeping a bad one.
THRESHOLD = 0.2
SEED = "quality-1"

_CLASS = np.zeros((256, 5), np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [65 <= _b <= 90, 97 <= _b <= 122 or _b >= 128, 48 <= _b <= 57, _b in (32, 9, 13), _b == 10]


def text_view(data: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte 4-grams; SHRINK further ones are nowhere, so a short text says little."""
    if len(data) < 4:
        return np.zeros(TEXT_DIMS, np.float32)
    place = (windows(np.frombuffer(data, np.uint8)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - TEXT_DIMS.bit_length() + 1)
    return np.sqrt(np.bincount(place, minlength=TEXT_DIMS) / (len(place) + SHRINK)).astype(np.float32)


def _bins(x: float, edges: tuple[float, ...]) -> list[float]:
    out = [0.0] * (len(edges) + 1)
    out[int(np.searchsorted(edges, x))] = 1.0
    return out


def _name(kind: str, value: str | None) -> list[float]:
    import zlib

    out = [0.0] * NAME_DIMS
    out[zlib.crc32(f"{kind}:{'' if value is None else '=' + value}".encode("utf-8", "surrogatepass")) % NAME_DIMS] = 1.0
    return out


def metadata_view(text: str, data: bytes, source: str | None, lang: str | None) -> np.ndarray:
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS if data else np.zeros(5, np.int64)
    total = max(1, len(data))
    upper, lower, digit, blank, line = count / total
    symbol = max(0.0, 1 - upper - lower - digit - blank - line)
    words = text.split()
    distinct = len(set(words)) / max(1, len(words))
    again = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words) - 1)
    lines = int(count[4]) + 1
    row = [upper, digit, symbol, distinct, again, np.log1p(lines) / 5, np.log1p(len(data) / lines) / 8, np.log1p(len(data)) / 12]
    row += _bins(again, (0.05, 0.15, 0.3, 0.6)) + _bins(upper, (0.02, 0.1, 0.3)) + _bins(symbol, (0.02, 0.05, 0.1, 0.2)) + _bins(distinct, (0.05, 0.1, 0.2, 0.4, 0.6, 0.8)) + _bins(np.log10(1 + len(data)), (1, 1.5, 2, 2.5, 3, 3.5, 4, 4.5))
    return np.array(row + _name("source", source) + _name("lang", lang), np.float32)


def _views(texts: list[str], sources: list[str | None], langs: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for t, s, l in zip(texts, sources, langs):
        data = t.encode("utf-8", "surrogatepass")
        yield text_view(data), metadata_view(t, data, s, l)


def fit(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, l2: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Logistic regression by accelerated gradient descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    y = y.astype(np.float32)
    w = np.zeros(x.shape[1], np.float32) if start is None else start.astype(np.float32)
    ahead, rate = w, np.float32(4.0 * len(y) / max(1e-9, float((x**2).sum())))
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        after = ahead - rate * (x.T @ (p - y) / np.float32(len(y)) + np.float32(l2) * ahead)
        ahead, w = after + np.float32(k / (k + 3)) * (after - w), after
    return w


class Model:
    """Two views' weights and calibrations, and the prior's log odds."""

    def __init__(self, a: np.ndarray, b: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(7)
        held = rng.random(len(y)) < HELD_OUT
        if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
            held = np.arange(len(y)) % 2 == 0 if len(y) > 7 else np.ones(len(y), bool)
        learn = ~held if len(set(y[~held])) == 2 else np.ones(len(y), bool)
        self.y, self.held, self.views = y, held, (a, b)
        self.sets = ((a[learn], y[learn]), (b[learn], y[learn]))
        self.share = y[learn].mean()
        self.taken: tuple[dict, dict] = ({}, {})  # of each view, the unlabelled documents that it learns from, with label and features
        self.weights = [fit(*own) for own in self.sets]
        self.prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))

    @property
    def pseudo(self) -> list[int]:
        return [len(t) for t in self.taken]

    def wanted(self, per_round: int = PER_ROUND) -> tuple[int, int]:
        """How many good and bad documents a view gives in a round."""
        return max(1, round(per_round * self.share)), max(1, round(per_round * (1 - self.share)))

    def exchange(self, given: tuple[dict, dict]) -> None:
        """Learn again, with ``given[v]`` (key -> label and features) added to what view v learns from."""
        for v in (0, 1):
            self.taken[v].update(given[v])
            own = sorted(self.taken[v].items())
            x = np.vstack([self.sets[v][0], *(f[None, :] for _, (_, f) in own)])
            t = np.concatenate([self.sets[v][1], [label for _, (label, _) in own]])
            self.weights[v] = fit(x, t, self.weights[v], steps=80)

    def calibrate(self) -> Model:
        """Platt: targets drawn in by one document of each class, so that a perfect split has finite odds."""
        good, bad = self.y[self.held].sum(), (1 - self.y[self.held]).sum()
        target = np.where(self.y[self.held] == 1, (good + 1) / (good + 2), 1 / (bad + 2))
        self.scale = []
        for v in (0, 1):
            raw = self._raw(v, self.views[v][self.held])
            spread = max(1e-6, float(raw.std()))
            w = fit((raw / spread)[:, None], target, l2=1e-6, steps=2_000)
            self.scale.append((max(0.0, w[0] / spread), w[1]))
        return self

    def __getstate__(self) -> dict:
        """Only what scoring needs travels."""
        return {k: self.__dict__[k] for k in ("weights", "scale", "prior")}

    def _raw(self, v: int, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[v][:-1] + self.weights[v][-1]

    def log_odds(self, v: int, x: np.ndarray) -> np.ndarray:
        s, c = self.scale[v]
        return self._raw(v, x) * s + c

    def score(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality by text, by metadata, by both."""
        la, lb = self.log_odds(0, a), self.log_odds(1, b)
        return tuple(1 / (1 + np.exp(-np.clip(x, -40, 40))) for x in (la, lb, la + lb - self.prior))


def _matrix(column, view: int) -> np.ndarray:
    """Packed features as rows."""
    width = TEXT_DIMS if view == 0 else len(metadata_view("", b"", None, None))
    return np.frombuffer(b"".join(map(bytes, column)), np.float16).astype(np.float32).reshape(-1, width)


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, _quality) of at most LABELLED labels that nothing contradicts."""
    judged = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most")).filter("least = most")
    return K.cut(judged.orderBy(K.unit_hash(F.lit(SEED), F.col("doc_id").cast("string")), "doc_id").limit(LABELLED).select("doc_id", F.col("most").alias("_quality")))


def _features(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(key, quality, a, b) of all documents with content: a hash of the row, its label or null, both views' features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sources, langs = (c.to_pylist() for c in batch.columns[2:])
            rows = [tuple(v.astype(np.float16).tobytes() for v in views) for views in _views(texts, sources, langs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1))], names=["key", "quality", "a", "b"])

    named = _with_names(docs).filter(F.rlike(F.coalesce("text", F.lit("")), F.lit(r"\S"))).join(F.broadcast(known), "doc_id", "left")
    return named.select(F.xxhash64("doc_id", "text", "source", "lang"), F.col("_quality").cast("int"), "text", "source", "lang").mapInArrow(run, "key long, quality int, a binary, b binary")


def _confident(model: Model) -> tuple:
    """Rows of features -> of this task's, the most confident (view, good, rank, key) of each view that the other may learn from."""
    weights, taken, wanted = model.weights, [np.array(sorted(t), np.int64) for t in model.taken], model.wanted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {(v, good): (np.empty(0), np.empty(0, np.int64)) for v in (0, 1) for good in (False, True)}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            for v in (0, 1):
                # rounded, so that the order doesn't hang on how rows are summed up
                raw = np.round((_matrix(batch.column(v + 1).to_pylist(), v) @ weights[v][:-1] + weights[v][-1]).astype(float), 4)
                free = ~np.isin(keys, taken[1 - v])
                for good in (False, True):
                    own = free & ((raw > 0) if good else (raw < 0))
                    rank, key = np.concatenate([best[v, good][0], -raw[own] if good else raw[own]]), np.concatenate([best[v, good][1], keys[own]])
                    key, first = np.unique(key, return_index=True)
                    rank = rank[first]
                    order = np.lexsort((key, rank))[: wanted[0] if good else wanted[1]]
                    best[v, good] = rank[order], key[order]
        rows = [(v, good, float(r), int(k)) for (v, good), (rank, key) in best.items() for r, k in zip(rank, key)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.bool_(), pa.float64(), pa.int64()))], names=["view", "good", "rank", "key"])

    return run


def _with_names(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", *(c if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The co-trained model; None without labels of both classes."""
    known = _known(labels)
    if known.select("_quality").distinct().count() < 2:
        return None
    spark = docs.sparkSession
    path = f"{K.shared_dir(spark)}/features-{uuid.uuid4().hex}"
    _features(docs, known).write.option("compression", "zstd").parquet(path)
    try:
        features = spark.read.parquet(path)
        rows = sorted(((r.quality, bytes(r.a), bytes(r.b)) for r in features.filter("quality IS NOT NULL").dropDuplicates(["key"]).collect()), key=lambda r: (r[1], r[2], r[0]))
        y = np.array([r[0] for r in rows], float)
        if len(set(y)) < 2:
            return None
        model = Model(_matrix([r[1] for r in rows], 0), _matrix([r[2] for r in rows], 1), y)
        for _ in range(ROUNDS):
            given = _given(features.filter("quality IS NULL"), model)
            if not any(given):
                break
            model.exchange(given)
    finally:
        K.remove(spark, path)
    return model.calibrate()


def _given(unlabelled: DataFrame, model: Model) -> tuple[dict, dict]:
    """What each view learns from the other in this round: key -> label and features."""
    good, bad = model.wanted()
    found = unlabelled.select("key", "a", "b").mapInArrow(_confident(model), "view int, good boolean, rank double, key long").distinct()
    place = F.row_number().over(W.partitionBy("view", "good").orderBy("rank", "key"))
    chosen = [(r.view, r.good, r.key) for r in found.withColumn("place", place).filter(F.col("place") <= F.when(F.col("good"), good).otherwise(bad)).collect()]
    out: tuple[dict, dict] = ({}, {})
    if chosen:
        keys = F.broadcast(unlabelled.sparkSession.createDataFrame([(k,) for k in sorted({k for _, _, k in chosen})], "key long"))
        rows = {r.key: (bytes(r.a), bytes(r.b)) for r in unlabelled.join(keys, "key").dropDuplicates(["key"]).collect()}
        for view, is_good, key in chosen:
            out[1 - view][key] = (float(is_good), _matrix([rows[key][1 - view]], 1 - view)[0])
    return out


def _judge(model: Model | None, texts: list, sources: list, langs: list) -> list[tuple[float | None, float | None, float | None, bool]]:
    blank = [t is None or not t.strip() for t in texts]
    out: list = [(0.0, 0.0, 0.0, False) if b else (None, None, None, True) for b in blank]
    full = [k for k, b in enumerate(blank) if not b]
    if model is not None:
        for k in range(0, len(full), 256):
            own = full[k : k + 256]
            a, b = (np.array(v) for v in zip(*_views([texts[i] for i in own], [sources[i] for i in own], [langs[i] for i in own])))
            for i, pa_, pb, p in zip(own, *model.score(a, b)):
                out[i] = (round(float(pa_), 6), round(float(pb), 6), round(float(p), 6), bool(p >= THRESHOLD))
    return out


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_text, p_metadata, score, keep) of every document."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _judge(model, *(batch.column(k).to_pylist() for k in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.float64(), pa.bool_())))], names=["doc_id", "p_text", "p_metadata", "score", "keep"])

    return _with_names(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, p_text double, p_metadata double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    model = train(docs, labels)
    at = {c: docs.columns.index(c) if c in docs.columns else None for c in ("text", "source", "lang")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _judge(model, *([None] * batch.num_rows if k is None else batch.column(k).to_pylist() for k in at.values()))
            yield batch.filter(pa.array([r[3] for r in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(K.table(spark, sf_dir, "documents"), K.table(spark, sf_dir, "labels"))
