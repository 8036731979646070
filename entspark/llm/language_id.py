"""Language identification with a bit-sliced Bloom filter of character n-grams.

The filter holds a bitmask of languages at each of its places; adding an n-gram
of a language sets that language's bit at K places, and the AND of the K masks
of an n-gram gives all languages that contain it, in one look-up for all.  A
document's score for a language is the share of its n-grams with that bit,
corrected for the rate of false positives that the language's fill implies.

N-grams are four bytes of UTF-8 of the lower-cased text in which whatever is
not a letter is a blank (runs of them one).

The filters are fitted on at most ``PER_LANGUAGE`` labelled documents of each
language, whole: those of the least hashes of their doc_id.  Their n-grams are
counted where they are; only the n-grams that a language has often enough travel.

Defined results: every row of ``docs`` has a row.  A null, empty or too short
text, and one whose best score is under LEAST_SCORE, is ``und``; the score is
then the best one, or 0.  Equal scores go to the first language by name.
Repeated rows repeat.  A text of any length is read whole.  Rows with a null
label or a null doc_id are not learned from, and of rows of one doc_id and label
the least text is; without any labelled text all are ``und``.  An empty table gives an empty result.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

#: Labelled documents of a language that are learned from, at most.
PER_LANGUAGE = 500
#: Places of the filter (a power of two), hashes, and how often an n-gram has to occur in a language's sample.
PLACES, HASHES, LEAST_COUNT = 1 << 20, 3, 2
LEAST_SCORE, LEAST_GRAMS = 0.3, 3
SEED = "language-1"

_BLANK = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def grams(text: str) -> np.ndarray:
    """The four-byte windows of a text."""
    data = b" ".join([b"", *text.lower().encode("utf-8", "surrogatepass").translate(_BLANK).split(), b""])
    if len(data) < 4:
        return np.empty(0, np.uint32)
    return windows(np.frombuffer(data, np.uint8))


def windows(b: np.ndarray) -> np.ndarray:
    w = b.astype(np.uint32)
    return w[:-3] | (w[1:-2] << np.uint32(8)) | (w[2:-1] << np.uint32(16)) | (w[3:] << np.uint32(24))


class LanguageFilter:
    def __init__(self, known: dict[str, np.ndarray], places: int = PLACES):
        """``known`` are the n-grams of each language."""
        self.languages = sorted(known)
        # a mask holds 64 languages; more are in further filters
        self.more = LanguageFilter({k: known[k] for k in self.languages[64:]}, places) if len(self.languages) > 64 else None
        self.languages = self.languages[:64]
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(self.languages) <= 8 * np.dtype(t).itemsize)
        self.shift = np.uint32(32 - (places.bit_length() - 1))
        self.masks = np.zeros(places, kind)
        for k, name in enumerate(self.languages):
            for at in self.places(known[name]):
                self.masks[at] |= kind(1 << k)
        fill = np.array([((self.masks >> kind(k)) & kind(1)).mean() for k in range(len(self.languages))])
        self.false = fill**HASHES

    def places(self, g: np.ndarray) -> list[np.ndarray]:
        return [(g * np.uint32(m)) >> self.shift for m in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)[:HASHES]]

    def containing(self, g: np.ndarray) -> np.ndarray:
        """The bitmask of the languages that contain each n-gram."""
        first, *rest = self.places(g)
        out = self.masks[first]
        for at in rest:
            out = out & self.masks[at]
        return out

    def score(self, masks: np.ndarray) -> np.ndarray:
        """Per language the corrected share of a document's n-grams."""
        if len(self.languages) <= 8:
            each = np.bincount(masks, minlength=256)
            hits = np.array([each[(np.arange(256) >> k) & 1 == 1].sum() for k in range(len(self.languages))]) if len(each) > 256 else _BITS[: len(self.languages)] @ each
        else:
            hits = np.array([np.count_nonzero(masks & masks.dtype.type(1 << k)) for k in range(len(self.languages))])
        share = hits / max(1, len(masks))
        return np.clip((share - self.false) / np.maximum(1e-9, 1 - self.false), 0, 1)

    def decide(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """(language, score, n-grams) of each text."""
        out: list[tuple[str, float, int]] = []
        for a, b in K.chunks(texts):
            data = [b"" if not t else b" ".join([b"", *t.lower().encode("utf-8", "surrogatepass").translate(_BLANK).split(), b""]) for t in texts[a:b]]
            whole = np.frombuffer(b"".join([*data, b"    "]), np.uint8)
            masks = self.containing(windows(whole))
            at = 0
            for d in data:
                many = max(0, len(d) - 3)
                if many < LEAST_GRAMS or not self.languages:
                    out.append(("und", 0.0, many))
                else:
                    score = self.score(masks[at : at + many])
                    best = int(np.argmax(score))
                    out.append((self.languages[best] if score[best] >= LEAST_SCORE else "und", round(float(score[best]), 6), many))
                at += len(d)
        if self.more is not None:
            out = [max(a, b, key=lambda x: (x[1], x is a)) for a, b in zip(out, self.more.decide(texts))]
        return out


_BITS = np.array([[(m >> k) & 1 for m in range(256)] for k in range(8)])


def frequent(samples: dict[str, list[str]]) -> dict[str, np.ndarray]:
    """The n-grams that each language's texts have LEAST_COUNT times at least."""
    out = {}
    for name, texts in samples.items():
        found, count = np.unique(np.concatenate([np.empty(0, np.uint32), *map(grams, texts)]), return_counts=True)
        out[name] = found[count >= LEAST_COUNT]
    return out


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text) of at most ``per_language`` documents of each language, those of the least hashes."""
    point = K.unit_hash(F.lit(SEED), F.col("doc_id").cast("string"))
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("lang", "text", point.alias("point"))
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    by_language = lambda numbers: F.element_at(F.create_map(*[x for k, n in numbers.items() for x in (F.lit(k), F.lit(n))]), F.col("lang"))
    if not counts:
        return labelled.select("lang", "text").limit(0)
    # the hashes under a bound that all but surely holds enough of them, in rising order; else all
    few = {k: min(1.0, (1.5 * per_language + 50) / n) for k, n in counts.items()}
    while True:
        points: dict[str, list[float]] = {k: [] for k in counts}
        for r in labelled.filter(F.col("point") < by_language(few)).select("lang", "point").distinct().collect():
            points[r.lang].append(r.point)
        short = {k: 1.0 for k, own in points.items() if len(own) < per_language and few[k] < 1}
        if not short:
            break
        few |= {k: min(1.0, 4 * few[k]) for k in short}
    last = {k: sorted(own)[min(per_language, len(own)) - 1] for k, own in points.items()}
    return labelled.filter(F.col("point") <= by_language(last)).groupBy("lang", "point").agg(F.min("text").alias("text")).select("lang", "text")


def fitted(samples: DataFrame) -> LanguageFilter:
    """The filter of the languages of labelled texts (lang, text), each with the n-grams that occur LEAST_COUNT times at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(names)):
                found, count = np.unique(np.concatenate([np.empty(0, np.uint32), *(grams(t) for n, t in zip(names, texts) if n == name)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(count.astype(np.int64))], names=["lang", "gram", "n"])

    counted = samples.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT).select("lang", "gram").toArrow()
    known = {r[0]: np.empty(0, np.uint32) for r in samples.select("lang").distinct().collect()}
    if counted.num_rows:
        names, found = np.array(counted.column(0).to_pylist()), counted.column(1).to_numpy().astype(np.uint32)
        known |= {k: np.sort(found[names == k]) for k in np.unique(names).tolist()}
    return LanguageFilter(known)


def identify(docs: DataFrame, model: LanguageFilter | None = None) -> DataFrame:
    """(doc_id, predicted, score, n_grams) of every document; fits on the documents' own labels without a model."""
    model = model or fitted(K.cut(sample(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = model.decide(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64())))], names=["doc_id", "predicted", "score", "n_grams"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, predicted string, score double, n_grams long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(K.table(spark, sf_dir, "documents"))
