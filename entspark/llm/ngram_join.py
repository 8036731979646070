"""N-gram Jaccard self-join.

Two documents are linked when the Jaccard similarity of their sets of word
n-grams is at least a threshold.  The join is exact up to the width of the
grams' fingerprints (40 bits or more).  Its result is one row a document: its
class (a connected part of the links) and how many links it has, so rows grow
with the documents and not with the square of a group of copies.

How it works, in three shuffles of compact numpy blocks:

1. Every document becomes its sorted distinct gram hashes.  The entries go to
   the gram's range of the hash space as (document, low 32 bits) blocks, where
   grams that only one document has are dropped: they can't be in an overlap.
   The others return to the block of documents that they came from, with a
   class of document frequency and a name: the least hash of all documents
   that have the gram, so that the grams of a group of copies have few names.
2. A pair at threshold t shares one of the ``n - ceil(t n) + 1`` rarest grams
   of either document.  Where the dropped grams fill these places a document
   has no partner and is out.  Each remaining set is sent to the tiles that
   its rare grams name, if another set is there.
3. A tile of more than TILE_ROWS sets is cut by size in bands of ratio 1/t,
   bands in parts by hash, and each pair of parts within reach is a block of
   its own, so no task holds more than two parts.  In a block, sets have
   hashed bitmaps of one width; bits of A that B lacks bound the overlap from
   above, and only pairs that pass are intersected as sorted arrays.  A pair
   that meets in several tiles counts in the least of them.  A block gives back
   each set's number of links, and the edges of a spanning forest.

Documents with equal gram sets are one set with a weight until the end, so
copies cost nothing in the tiles.  ``deduplicate`` needs the classes alone: it
doesn't look at pairs that are in one class already.

Defined results: a document with a null or wordless text has an empty set: it
is a class of its own without links.  Rows that repeat a doc_id with equal sets
count once; different sets of one doc_id are in one class, and the links of each
to any other (doc_id, set) add up.  A null doc_id is left out.  Ties at the
threshold are links.  A text of any length is read whole.  Empty input gives an
empty result.  Further columns of ``docs``, whatever their names, are ignored.

``docs`` should be read from a table or checkpoint: a block is named by its
documents in their order, so a task that runs again has to see the same rows
in order, and the join fails (it doesn't guess) where it doesn't.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

N, THRESHOLD = 3, 0.5
#: Entries that a block of documents holds before it is sent; documents of a block (16 bits name them).
BLOCK_GRAMS, BLOCK_DOCS = 1_000_000, 65_000
#: Parts of the hash space at least; with 32 bits in the part this makes fingerprints of 40 bits, and one more for each doubling of the shuffle's partitions.
LEAST_PARTS = 256
#: Sets of a tile that one task looks at together, and of a part of a larger tile.
TILE_ROWS = 2_048
#: Cells (pairs x words of their bitmaps) that are compared at once.
AT_ONCE = 1 << 20
#: Up to so many doc_ids to drop are broadcast (8 bytes each); more are joined by shuffling the documents.
BROADCAST_IDS = 1_000_000

_BLOCKS = "part int, block long, payload binary"
_SURVIVORS = "doc_id long, sid long, size int, tiles array<long>, shared array<long>"
_FOUND = "sid long, links long, u long, v long"


def _needed(size: np.ndarray | int, t: float):
    """The least overlap with any partner."""
    return np.ceil(t * size - 1e-9).astype(np.int64) if isinstance(size, np.ndarray) else math.ceil(t * size - 1e-9)


def _batch(names: str, types: tuple, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names.split())


_BLOCK_TYPES = (pa.int32(), pa.int64(), pa.binary())


def _entries(n: int, bits: int):
    """docs (doc_id, text) -> blocks of entries by part, and what each block needs of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        grams: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal ids, grams, held, serial
            sizes = np.array([len(g) for g in grams], np.int64)
            every = np.concatenate(grams)
            doc = np.repeat(np.arange(len(grams), dtype=np.uint16), sizes)
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            sids = K.mix(np.bitwise_xor.reduceat(every, at) + np.add.reduceat(K.mix(every), at) * np.uint64(31) + sizes.astype(np.uint64))
            own = np.array(ids, np.int64)
            place = K.mix(np.arange(1, len(ids) + 1, dtype=np.uint64))
            block = int(K.mix(np.array([(task << 20) + serial], np.uint64) + ((K.mix(own.view(np.uint64)) ^ sids) * place).sum()).view(np.int64)[0])
            serial += 1
            part = (every >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            order = np.argsort(part, kind="stable")
            part, doc, low = part[order], doc[order], every.astype(np.uint32)[order]
            edges = np.searchsorted(part, np.arange((1 << bits) + 1))
            rows = [(p, block, doc[a:b].tobytes() + low[a:b].tobytes()) for p, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if a < b]
            rows.append((-1 - block % (1 << bits), block, np.concatenate([own, sids.view(np.int64), sizes]).tobytes()))
            ids, grams, held = [], [], 0
            return _batch("part block payload", _BLOCK_TYPES, rows)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for a, b in K.chunks(texts):
                for i, g in zip(doc_ids[a:b], K.gram_hashes(texts[a:b], n)):
                    if i is None or not len(g):
                        continue
                    ids.append(i)
                    grams.append(g)
                    held += len(g)
                    if held >= BLOCK_GRAMS or len(ids) >= BLOCK_DOCS:
                        yield flush()
        if ids:
            yield flush()

    return run


def _runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
    """The rows of a sorted partition in lists of one value of a column."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part in turn: entries of grams that several documents have return to their blocks, with a class of df and a name of 40 bits."""
    for rows in _runs(batches, 0):
        if rows[0][0] < 0:
            yield _batch("part block payload", _BLOCK_TYPES, [(-1, b, payload) for _, b, payload in rows])
            continue
        blocks, docs, lows, names = [], [], [], []
        for _, block, payload in rows:
            many = len(payload) // 6
            docs.append(np.frombuffer(payload, np.uint16, many))
            lows.append(np.frombuffer(payload, np.uint32, many, 2 * many))
            names.append(K.mix(np.array([block], np.int64).view(np.uint64) + docs[-1].astype(np.uint64)) >> np.uint64(24))
            blocks.append(block)
        low = np.concatenate(lows)
        order = np.argsort(low, kind="stable")
        low = low[order]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        df = np.diff(np.concatenate([first, [len(low)]]))
        each, name = np.empty(len(low), np.uint8), np.empty(len(low), np.uint64)
        # eight classes to a doubling: one total order of grams for all documents, as ties go by the gram
        each[order] = np.repeat(np.minimum(255, 8 * np.log2(df)).astype(np.uint8), df)
        name[order] = np.repeat(np.minimum.reduceat(np.concatenate(names)[order], first), df)
        at, out = 0, []
        for block, doc, l in zip(blocks, docs, lows):
            e, n = each[at : at + len(l)], name[at : at + len(l)]
            at += len(l)
            keep = e > 0
            if keep.any():
                n = n[keep]
                out.append((rows[0][0], block, doc[keep].tobytes() + l[keep].tobytes() + n.astype(np.uint32).tobytes() + (n >> np.uint64(32)).astype(np.uint8).tobytes() + e[keep].tobytes()))
        if out:
            yield _batch("part block payload", _BLOCK_TYPES, out)


def _survivors(t: float):
    """Of each block in turn: the documents that can have a partner, with the tiles that their rare grams name and all shared grams.

    Of the documents of a block that have one set only the first has these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 1):
            own_meta = [x for p, _, x in rows if p < 0]
            if len(own_meta) != 1:
                raise RuntimeError("a task that ran again saw other rows: write the documents to a table before the join")
            meta = np.frombuffer(own_meta[0], np.int64).reshape(3, -1)
            doc_ids, sids, sizes = meta
            docs, keys, ranks, names = [], [], [], []
            for p, _, payload in rows:
                if p < 0:
                    continue
                many = len(payload) // 12
                docs.append(np.frombuffer(payload, np.uint16, many))
                keys.append((np.int64(p) << 32) | np.frombuffer(payload, np.uint32, many, 2 * many).astype(np.int64))
                names.append(np.frombuffer(payload, np.uint32, many, 6 * many).astype(np.int64) | (np.frombuffer(payload, np.uint8, many, 10 * many).astype(np.int64) << 32))
                ranks.append(np.frombuffer(payload, np.uint8, many, 11 * many))
            if not docs:
                continue
            doc = np.concatenate(docs)
            alive = np.bincount(doc, minlength=len(sizes)) >= _needed(sizes, t)
            known = np.flatnonzero(alive)
            if not len(known):
                continue
            sole = np.zeros(len(sizes), bool)  # the first of each set
            sole[known[np.unique(sids[known], return_index=True)[1]]] = True
            keep = sole[doc]
            doc, key, rank, name = doc[keep], np.concatenate(keys)[keep], np.concatenate(ranks)[keep], np.concatenate(names)[keep]
            order = np.lexsort((key, rank, doc))
            doc, key, name = doc[order], key[order], name[order]
            edges = np.searchsorted(doc, np.arange(len(sizes) + 1))
            tiles, shared = [], []
            for d in known:
                own = key[edges[d] : edges[d + 1]]
                prefix = int(sizes[d]) - _needed(int(sizes[d]), t) + 1 - (int(sizes[d]) - len(own))
                tiles.append(np.unique(name[edges[d] : edges[d] + prefix]) if sole[d] else None)
                shared.append(np.sort(own) if sole[d] else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids[known], pa.int64()), pa.array(sids[known], pa.int64()), pa.array(sizes[known], pa.int32()), pa.array(tiles, pa.list_(pa.int64())), pa.array(shared, pa.list_(pa.int64()))], names=["doc_id", "sid", "size", "tiles", "shared"]
            )

    return run


class Sets:
    """Sorted arrays one after the other, numbered from 0 where ``number``, so that any can be intersected with many at once."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        distinct, self.values = np.unique(values, return_inverse=True)
        self.mark = np.zeros(len(distinct), bool)

    def overlaps(self, i: int, others: np.ndarray) -> np.ndarray:
        """The sizes of the intersections of set ``i`` with each of ``others``."""
        own = self.values[self.begin[i] : self.begin[i] + self.lengths[i]]
        lengths = self.lengths[others]
        total = int(lengths.sum())
        if not total or not len(own):
            return np.zeros(len(others), np.int64)
        ends = np.cumsum(lengths)
        at = np.repeat(self.begin[others] - (ends - lengths), lengths) + np.arange(total)
        self.mark[own] = True
        hits = np.concatenate([[0], np.cumsum(self.mark[self.values[at]])])
        self.mark[own] = False
        return hits[ends] - hits[ends - lengths]


def bitmaps(values: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Hashed bitmaps of ``width`` bits (a multiple of 64), a row of 64-bit words for each set of ``values`` one after the other."""
    out = np.zeros((len(lengths), width // 64), np.uint64)
    bit = (K.mix(values.astype(np.uint64)) % np.uint64(width)).astype(np.int64)
    np.bitwise_or.at(out, (np.repeat(np.arange(len(lengths)), lengths), bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def tile_links(sizes: np.ndarray, values: np.ndarray, lengths: np.ndarray, t: float, side: np.ndarray | None = None, owned=None, label: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the j > i that are linked to i) for each set i of a block; ``sizes`` ascending.

    Sets may leave out grams that no other set has; ``sizes`` counts them.  With
    a ``side`` only sets of different sides are looked at.  ``owned(i, js)`` says
    which pairs count here.  With ``label`` pairs of one label are passed over,
    which the caller keeps up to date.
    """
    many = len(sizes)
    width = 64 << max(0, math.ceil(math.log2(max(1, 4 * int(lengths.max(initial=1)) / 64))))
    maps = bitmaps(values, lengths, width)
    sets = Sets(values, lengths)
    words = width // 64
    stop = np.searchsorted(sizes, sizes / t + 1e-9, side="right")
    step = max(1, AT_ONCE // (max(1, many) * words)) if label is None else 1
    for a in range(0, many, step):
        rows = np.arange(a, min(a + step, many))
        cols = np.arange(a, int(stop[rows[-1]]))
        if label is not None:
            cols = cols[label[cols] != label[a]]
        if side is not None and step == 1:
            cols = cols[side[cols] != side[a]]
        if not len(cols):
            continue
        missing = np.zeros((len(rows), len(cols)), np.int32)
        for w in range(words):
            missing += np.bitwise_count(maps[rows, w][:, None] & ~maps[cols, w][None, :])
        least = np.ceil(t / (1 + t) * (sizes[rows][:, None] + sizes[cols][None, :]) - 1e-9).astype(np.int64)
        fits = (np.minimum(lengths[rows][:, None] - missing, lengths[cols][None, :]) >= least) & (rows[:, None] < cols[None, :])
        if side is not None:
            fits &= side[rows][:, None] != side[cols][None, :]
        for k in np.flatnonzero(fits.any(1)):
            i, js = int(rows[k]), cols[fits[k]]
            if owned is not None:
                js = js[owned(i, js)]
            if len(js):
                js = js[sets.overlaps(i, js) >= np.ceil(t / (1 + t) * (sizes[i] + sizes[js]) - 1e-9)]
                if len(js):
                    yield i, js


def _solve(members: list[tuple], t: float, count: bool) -> list[tuple]:
    """Rows of a block (tile, pair, side, sid, size, weight, least, tiles, shared) -> (sid, links, u, v)."""
    members = sorted({m[3]: m for m in members}.values(), key=lambda m: (m[4], m[3]))
    if len(members) < 2:
        return []
    tile = members[0][0]
    sizes, weight, least = (np.array([m[k] for m in members], np.int64) for k in (4, 5, 6))
    side = np.array([m[2] for m in members]) if members[0][1] and len({m[2] for m in members}) > 1 else None
    if side is None and members[0][1] and not members[0][1].endswith("="):
        return []  # one of two different parts is empty
    lengths = np.array([len(m[8]) for m in members], np.int64)
    lower = [np.array(m[7], np.int64) for m in members]
    lower = [x[x < tile] for x in lower]
    below = np.array([len(x) for x in lower])
    before = Sets(np.concatenate(lower), below) if below.any() else None
    owned = (lambda i, js: before.overlaps(i, js) == 0) if before is not None else None
    links = np.zeros(len(members), np.int64)
    label = np.arange(len(members))
    out: list[tuple] = []
    for i, js in tile_links(sizes, np.concatenate([m[8] for m in members]), lengths, t, side, owned if count else None, None if count else label):
        if count:
            links[i] += weight[js].sum()
            links[js] += weight[i]
        own = np.unique(label[js])
        own = own[own != label[i]]
        if len(own):
            for x in own:
                out.append((None, None, int(least[i]), int(least[x])))
            new = min(int(own[0]), int(label[i]))
            label[np.isin(label, np.append(own, label[i]))] = new
    out += [(members[k][3], int(links[k]), None, None) for k in np.flatnonzero(links)]
    return out


def _tiles(t: float, count: bool):
    """Rows sorted by block -> links of sets and edges of forests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, found = None, [], []
        types = (pa.int64(),) * 4
        for batch in batches:
            arrays = batch.column(8)
            values, offsets = arrays.values.to_numpy(zero_copy_only=False), arrays.offsets.to_numpy()
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(8)))):
                if row[:2] != key:
                    found += _solve(members, t, count)
                    key, members = row[:2], []
                    if len(found) >= 50_000:
                        yield _batch("sid links u v", types, found)
                        found = []
                members.append((*row, values[offsets[k] : offsets[k + 1]].copy()))
        found += _solve(members, t, count)
        if found:
            yield _batch("sid links u v", types, found)

    return run


def survivors(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """Documents that can have a partner, with set id, size, tiles and shared grams; written to the shared folder."""
    bits = max(LEAST_PARTS, K.parallelism(docs.sparkSession)) - 1
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_entries(n, bits.bit_length()), _BLOCKS)
    back = blocks.repartition(F.when(F.col("part") < 0, -1 - F.col("part")).otherwise(F.col("part"))).sortWithinPartitions("part").mapInArrow(_frequencies, _BLOCKS)
    return K.cut(back.repartition("block").sortWithinPartitions("block").mapInArrow(_survivors(t), _SURVIVORS))


def _statistics(alive: DataFrame) -> DataFrame:
    """(sid, weight, least, holder) of each set: its documents, the least of them, and the least that brings the grams."""
    one = alive.groupBy("sid", "doc_id").agg(F.bool_or(F.col("shared").isNotNull()).alias("brings"))
    return one.groupBy("sid").agg(F.count("*").alias("weight"), F.min("doc_id").alias("least"), F.min(F.when(F.col("brings"), F.col("doc_id"))).alias("holder"))


def _placed(alive: DataFrame, stats: DataFrame, t: float) -> DataFrame:
    """Each set in all blocks of pairs that it is looked at in: (tile, pair, side, sid, size, weight, least, tiles, shared)."""
    band = F.floor(F.log("size") / F.lit(math.log(1 / t)) + 1e-9).cast("int") if t < 1 else F.col("size")
    at = alive.filter("shared IS NOT NULL").select("sid", band.alias("band"), F.explode("tiles").alias("tile"))
    by_band = at.groupBy("tile", "band").agg(F.count("*").alias("n"), F.min("sid").alias("lo"), F.max("sid").alias("hi"))
    parts = F.map_from_entries(F.sort_array(F.collect_list(F.struct("band", F.ceil(F.col("n") / TILE_ROWS).cast("int").alias("g")))))  # at most as many as bands
    tiles = by_band.groupBy("tile").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), parts.alias("parts")).filter("lo < hi").select("tile", F.when(F.col("n") > TILE_ROWS, F.col("parts")).alias("parts"))
    here = F.struct("tile", "parts")
    where = at.join(tiles, "tile").groupBy("sid").agg(F.collect_set(here.dropFields("parts")["tile"]).alias("names"), F.collect_list(F.when(F.col("parts").isNotNull(), here)).alias("large"))
    sets = alive.filter("shared IS NOT NULL").select("sid", F.col("doc_id").alias("holder"), "size", band.alias("band"), "shared").join(stats, ["sid", "holder"]).join(where, "sid")

    # a part within a band meets itself and the others; and all parts of the bands above and below
    def blocks(x):
        b, own = F.col("band"), F.element_at(x["parts"], F.col("band"))
        me = F.pmod(F.xxhash64("sid"), own).cast("int")
        name = lambda b1, g1, b2, g2: F.concat_ws(".", b1.cast("string"), g1.cast("string"), b2.cast("string"), g2.cast("string"))
        block = lambda pair, side: F.struct(x["tile"].alias("tile"), pair.alias("pair"), side.cast("int").alias("side"))
        others = lambda g: F.sequence(F.lit(0), g - 1)
        within = F.transform(others(own), lambda g: F.when(g == me, block(F.concat(name(b, me, b, me), F.lit("=")), F.lit(0))).otherwise(block(name(b, F.least(g, me), b, F.greatest(g, me)), (g < me).cast("int"))))
        none = F.array().cast("array<struct<tile:bigint,pair:string,side:int>>")
        up, down = F.try_element_at(x["parts"], b + 1), F.try_element_at(x["parts"], b - 1)
        above = F.when(up.isNotNull(), F.transform(others(F.coalesce(up, F.lit(1))), lambda g: block(name(b, me, b + 1, g), F.lit(0)))).otherwise(none)
        below = F.when(down.isNotNull(), F.transform(others(F.coalesce(down, F.lit(1))), lambda g: block(name(b - 1, g, b, me), F.lit(1)))).otherwise(none)
        return F.concat(within, above, below)

    big = F.transform("large", lambda x: x["tile"])
    small = F.transform(F.array_except("names", big), lambda x: F.struct(x.alias("tile"), F.lit("").alias("pair"), F.lit(0).alias("side")))
    return sets.select(F.explode(F.concat(small, F.flatten(F.transform("large", blocks)))).alias("at"), "sid", "size", "weight", "least", F.array_sort("names").alias("tiles"), "shared").select("at.tile", "at.pair", "at.side", "sid", "size", "weight", "least", "tiles", "shared")


def _found(alive: DataFrame, t: float, count: bool) -> DataFrame:
    placed = _placed(alive, _statistics(alive), t)
    return K.cut(placed.repartition("tile", "pair").sortWithinPartitions("tile", "pair").mapInArrow(_tiles(t, count), _FOUND))


def _classes(alive: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) of the documents of ``alive``; the links are those of other sets that were counted, and of the copies."""
    members = alive.select("sid", "doc_id").distinct()
    stats = members.groupBy("sid").agg(F.count("*").alias("weight"), F.min("doc_id").alias("least"))
    several = members.groupBy("doc_id").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo < hi").select("doc_id")
    versions = members.join(several, "doc_id").join(stats.select("sid", "least"), "sid").select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
    labels = components(found.filter("u IS NOT NULL").select("u", "v").unionByName(versions))
    links = found.filter("links IS NOT NULL").groupBy("sid").agg(F.sum("links").alias("links"))
    by_set = stats.join(links, "sid", "left").join(labels, stats.least == labels.u, "left")
    by_set = by_set.select("sid", F.coalesce("root", "least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    return members.join(by_set, "sid").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("n_links"))


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) of every document: the least doc_id of its class, and the documents at a similarity of ``threshold`` or more."""
    alive = survivors(docs, n, threshold)
    linked = _classes(alive, _found(alive, threshold, True)).withColumnRenamed("doc_id", "linked")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    return every.join(linked, every.doc_id == linked.linked, "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) of each document that can have a partner."""
    alive = survivors(docs, n, threshold)
    return _classes(alive, _found(alive, threshold, False)).select("doc_id", "class_id")


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
        e = K.cut(small(large(e)))
        now = e.agg(F.count("*"), total).first()
        if now == before:
            return e.select("u", F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("u"), F.col("v").alias("root"))).distinct()
        before = now


def deduplicate(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those whose class has a smaller doc_id.

    Rows of one doc_id with equal texts leave one row; with different texts
    they stay or go together.  Rows without a doc_id, or without words, stay.
    """
    gone = K.cut(groups(docs, n, threshold).filter("doc_id <> class_id").select("doc_id"))
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = K.cut(docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"))
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(K.table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_\\x{80}-\\x{10FFFF}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
sets AS (
  SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END)) AS s
  FROM words WHERE len(w) > 0
),
versions AS (SELECT row_number() OVER () AS k, doc_id, s, len(s) AS n FROM sets),
grams AS (SELECT k, n, unnest(s) AS g FROM versions),
links AS (
  SELECT a.k AS x, b.k AS y FROM grams a JOIN grams b ON a.g = b.g AND a.k <> b.k GROUP BY a.k, b.k, a.n, b.n HAVING 2 * count(*) >= a.n + b.n - count(*)
),
pairs AS (SELECT DISTINCT v.doc_id AS x, r.doc_id AS y FROM links JOIN versions v ON v.k = x JOIN versions r ON r.k = y WHERE v.doc_id <> r.doc_id),
reach(doc_id, other) AS (SELECT DISTINCT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT r.doc_id, p.y FROM reach r JOIN pairs p ON p.x = r.other),
classes AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id),
degrees AS (SELECT v.doc_id, count(*) AS n_links FROM links JOIN versions v ON v.k = x GROUP BY v.doc_id)
SELECT c.doc_id, c.class_id, coalesce(d.n_links, 0) AS n_links FROM classes c LEFT JOIN degrees d ON d.doc_id = c.doc_id
"""
