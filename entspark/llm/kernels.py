"""Byte-level text kernels and small helpers that the operators share.

A *word* is a maximal run of ASCII letters, digits, underscores or any
non-ASCII character, in the lower-cased text.  In RE2 and Java notation that is
``[0-9a-z_\\x{80}-\\x{10FFFF}]+``; ``WORD`` is the Python spelling.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_dir  # noqa: F401

WORD = re.compile("[0-9a-z_\u0080-\U0010ffff]+")

_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15
_IS_WORD = np.zeros(256, dtype=bool)
for _b in b"0123456789abcdefghijklmnopqrstuvwxyz_":
    _IS_WORD[_b] = True
_IS_WORD[128:] = True

#: Bytes of text that one vectorised pass works on.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, element by element."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_PRIME, -1, 1 << 64)
    up = np.full(n, _PRIME, dtype=_U)
    down = np.full(n, inverse, dtype=_U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _CACHE:
        _CACHE.clear()
        _CACHE[size] = _powers(size)
    return _CACHE[size]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of ``texts`` and, of every text, where its words begin (one more than texts)."""
    encoded = [b"" if t is None else t.lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(b) + 1 for b in encoded), dtype=np.int64, count=len(encoded))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b" ".join([*encoded, b""]), dtype=np.uint8)
    if not len(data):
        return np.empty(0, _U), np.zeros(len(texts) + 1, np.int64)
    word = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)])])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U)), np.searchsorted(start, begins)


def chunks(texts: list[str | None]):
    """Slices of ``texts`` of about CHUNK_BYTES each; a longer text stands alone and whole."""
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > CHUNK_BYTES:
            yield begin, k
            begin, size = k, 0
        size += len(t or "")
    if begin < len(texts):
        yield begin, len(texts)


def gram_hashes(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its word n-grams.

    A text of fewer than ``n`` words has one gram of all its words; one without
    words has none.
    """
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        words, at = word_hashes(texts[a:b])
        many = len(words)
        grams = np.zeros(max(0, many - n + 1), _U)
        for k in range(n):
            grams = grams * _U(_PRIME) + words[k : k + len(grams)]
        grams = mix(grams)
        for k in range(b - a):
            i, j = at[k], at[k + 1]
            if j - i >= n:
                g = np.sort(grams[i : j - n + 1])
                out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
            elif j > i:
                h = _U(0)
                with np.errstate(over="ignore"):
                    for w in words[i:j]:
                        h = h * _U(_PRIME) + w
                    out.append(mix(np.array([h + _U(j - i)], _U)))
            else:
                out.append(np.empty(0, _U))
    return out


def strings(column) -> list[str | None]:
    """A pyarrow string column as Python strings."""
    return column.to_pylist()


def spare(frame: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before those that ``frame`` has as columns."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


#: Rows of a batch for Python: texts are long, and a batch is held several times over.
BATCH_ROWS = 1_000


def small_batches(frame: DataFrame) -> DataFrame:
    """``frame``, with Arrow batches of BATCH_ROWS rows in its session unless that has its own setting."""
    conf, key = frame.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return frame


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system that nothing reads any more."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit_hash(*columns: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the columns' texts joined by ``|``; the same in SQL of other engines."""
    digest = F.md5(F.concat_ws("|", *columns))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
