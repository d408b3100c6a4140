"""Near-duplicates by SimHash, linked through vantage-point trees.

Fingerprints: words are runs of anything but ASCII white space, ASCII capitals become small letters;
the XXH64 hashes of all word shingles vote on each of 64 bits.

Links at ``radius`` or fewer differing bits:

1. *Shards.*  Random 64-bit fingerprints lie 32 +- 4 bits apart, so a ball of radius 4 overlaps both
   sides of almost every cut that a vantage point can make, and one tree over all would send each query to most of its
   leaves.  The set is therefore first partitioned in projected Hamming spaces: of ``radius + 1`` blocks of bits, two
   fingerprints within ``radius`` bits agree on at least one, so the first bits of each block are one partition, and
   each close pair shares a shard in one of them.  As many bits are taken as give shards of ``SHARD_ROWS``; where
   a block has too few, there are more blocks, of which close pairs agree on several.
2. *Vantage-point trees.*  Inside a shard the full 64-bit metric rules: points are split at the median
   distance from a vantage point down to ``LEAF`` points, both halves are searched on their own, and across the boundary only
   points that the triangle inequality leaves (within ``radius`` of it) are compared.  Branches whose
   points are linked already are pruned, so a dense group costs no pairs.
3. *Large shards* are cut into tiles; each pair of tiles is a shard of its own, so nothing is dropped
   and no task holds more than two tiles.
4. A shard returns a spanning set of its links, never all pairs; components come from ``components``.

All links are exact: every result equals that of comparing all pairs.

Edge cases: null and word-less texts have fingerprint zero and link like any other; null ids are carried
and are no one's smallest id (a component of null ids only has a null id); repeated rows share a
fingerprint; empty tables give empty tables; other columns are carried along.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import free_name, keep, read_table, text_bytes, with_fields
from caseloom.llm.components import components
from caseloom.llm.registry import query

SEED = 42
RADIUS = 4
# A shard's expected number of fingerprints decides how many bits are cut by; a tile holds at most so many.
SHARD_ROWS = 1 << 11
TILE_ROWS = 1 << 12
LEAF = 32

_BYTE = np.arange(8) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def simhash(text: bytes | None, words: int) -> int:
    """SimHash of a text's word shingles; a text of fewer words is one shingle, one of none is zero."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    line, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:n].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(8 * 256, np.int64)
    stops = (ends[words - 1 :] - 1).tolist()
    for a in range(0, n, 1 << 16):  # so that a very long text needs little memory
        hashes = b"".join([digest(line[i:j], SEED) for i, j in zip(starts[a : a + (1 << 16)], stops[a : a + (1 << 16)])])
        octets = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
        counts += np.bincount((octets + _BYTE).ravel(), minlength=8 * 256)
    votes = (counts.reshape(8, 256) @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def with_simhash(df: DataFrame, text: str, name: str, words: int, without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the SimHash of ``text`` as a (signed) long; columns in ``without`` are left out."""
    fields = [f for f in df.schema.fields if f.name not in without]
    places, place = [df.columns.index(f.name) for f in fields], df.columns.index(text)
    names = [*(f.name for f in fields), name]

    def run(batches):
        for batch in batches:
            values = np.fromiter((simhash(t, words) for t in text_bytes(batch.column(place))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in places), pa.array(values.view(np.int64))], names=names
            )

    return df.mapInArrow(run, with_fields(T.StructType(fields), (name, T.LongType())))


def _block_ranges(blocks: int) -> list[tuple[int, int]]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:]))


def shard_masks(n: int, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> list[int]:
    """Bit masks of the projections: pairs within ``radius`` agree under at least one of them.

    The fewest bits whose shards hold ``shard_rows`` of ``n`` evenly spread fingerprints; any number is
    exact, and any part of a mask is a mask.
    """
    bits = max(1, (max(n, 1) - 1).bit_length() - max(shard_rows, 1).bit_length() + 1)
    for blocks in range(radius + 1, radius + 6):
        ranges = _block_ranges(blocks)
        masks = [
            sum(((1 << (b - a)) - 1) << a for a, b in chosen)
            for chosen in combinations(ranges, blocks - radius)
        ]
        if bits <= min(m.bit_count() for m in masks):
            break
    return [_lowest_bits(m, bits) for m in masks]


def _lowest_bits(mask: int, n: int) -> int:
    kept = 0
    while mask and n:
        kept |= mask & -mask
        mask &= mask - 1
        n -= 1
    return kept


class _Links:
    """Links among the fingerprints of one shard, found through a vantage-point tree."""

    def __init__(self, points: np.ndarray, radius: int):
        self.x, self.radius = points, radius
        self.group = np.arange(len(points))
        self.splits, self.compared = 0, 0  # of branches, and pairs of points whose distance was taken

    def _merge(self, members: np.ndarray) -> None:
        groups = np.unique(self.group[members])
        if len(groups) > 1:
            self.group[np.isin(self.group, groups[1:])] = groups[0]

    def _one_group(self, a: np.ndarray) -> bool:
        return bool((self.group[a] == self.group[a[0]]).all())

    def _tile(self, a: np.ndarray, b: np.ndarray) -> None:
        self.compared += len(a) * len(b)
        near = np.bitwise_count(self.x[a][:, None] ^ self.x[b][None, :]) <= self.radius
        for i in np.flatnonzero(near.any(axis=1)):
            self._merge(np.append(b[near[i]], a[i]))

    def within(self, a: np.ndarray) -> None:
        """All links inside ``a``."""
        if len(a) < 2 or self._one_group(a):
            return
        if len(a) <= LEAF:
            self.compared += len(a) * (len(a) - 1) // 2
            near = np.bitwise_count(self.x[a][:, None] ^ self.x[a][None, :]) <= self.radius
            if np.count_nonzero(near) > len(a):
                for i in np.flatnonzero(near.sum(axis=1) > 1):
                    self._merge(a[near[i]])
            return
        self.splits += 1
        self.compared += len(a) - 1
        d = np.bitwise_count(self.x[a] ^ self.x[a[0]])
        self._merge(a[d <= self.radius])
        cut = int(np.median(d))
        inner = d <= cut
        if inner.all():
            cut, inner = cut - 1, d < cut
        if not inner.any():  # all as far from the vantage point as itself: equal points
            return
        self.within(a[inner])
        self.within(a[~inner])
        self.across(a[inner & (d > cut - self.radius)], a[~inner & (d <= cut + self.radius)])

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        """All links between ``a`` and ``b``."""
        if not len(a) or not len(b) or self._one_group(np.append(a, b)):
            return
        if len(a) * len(b) <= LEAF * LEAF or min(len(a), len(b)) <= 8:
            step = max(1, (1 << 22) // len(b))
            for i in range(0, len(a), step):
                self._tile(a[i : i + step], b)
            return
        self.splits += 1
        self.compared += len(a) + len(b)
        at = self.x[a[0]] if len(a) >= len(b) else self.x[b[0]]
        da, db = np.bitwise_count(self.x[a] ^ at), np.bitwise_count(self.x[b] ^ at)
        cut, r = int(np.median(np.append(da, db))), self.radius
        if max(da.max(), db.max()) <= cut:
            cut -= 1
        ia, ib = da <= cut, db <= cut
        if (ia.all() and ib.all()) or not (ia.any() or ib.any()):
            return self._tile(a, b)
        self.across(a[ia], b[ib])
        self.across(a[~ia], b[~ib])
        self.across(a[ia & (da > cut - r)], b[~ib & (db <= cut + r)])
        self.across(a[~ia & (da <= cut + r)], b[ib & (db > cut - r)])


def shard_links(points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links among distinct fingerprints: each linked one with one of its group."""
    found = _Links(points, radius)
    found.within(np.arange(len(points)))
    child = np.flatnonzero(found.group != np.arange(len(points)))
    return points[child], points[found.group[child]]


def _sharded(fps: DataFrame, masks: list[int], tile_rows: int) -> DataFrame:
    """``fps`` (``fp long``, distinct) as ``shard, tile_a, tile_b, fp``: each row once per shard and tile pair."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(
        *(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed))
    )
    rows = keep(fps.select("fp", F.explode(keys).alias("shard")), "simhash-shards")
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tiled = rows.join(sizes, "shard").withColumn("tiles", F.ceil(F.col("n") / F.lit(tile_rows)))
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1),
        lambda t: F.struct(F.least(t, "tile").alias("a"), F.greatest(t, "tile").alias("b")),
    )
    return tiled.withColumn("tile", tile).select("shard", F.explode(pairs).alias("pair"), "fp")


def links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Spanning links ``u, v`` between the distinct fingerprints ``fp`` that differ in ``radius`` bits or fewer."""
    masks = shard_masks(fps.count(), radius, shard_rows)
    shards = (
        _sharded(fps, masks, tile_rows)
        .groupBy("shard", "pair")
        .agg(F.collect_list("fp").alias("fps"))
        .filter(F.size("fps") > 1)
        .select("fps")
    )

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            ends = np.asarray(column.offsets)
            values = np.asarray(column.values).view(np.uint64)
            us, vs = [], []
            for a, b in zip(ends, ends[1:]):
                u, v = shard_links(np.unique(values[a:b]), radius)
                if len(u):
                    us.append(u)
                    vs.append(v)
            none = np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((np.concatenate(x) if x else none).view(np.int64)) for x in (us, vs)], names=["u", "v"]
            )

    return shards.mapInArrow(run, "u long, v long")


def _grouped(df: DataFrame, key: str, text: str, words: int, radius: int, **sizes) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``df``."""
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    marked = keep(with_simhash(docs, "text", "fp", words, without=("text",)), "simhash-docs")
    fps = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-fps")
    roots = components(links(fps.select("fp"), radius, **sizes))
    placed = fps.join(roots, fps.fp == roots.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = placed.join(lows, "root").select("fp", "component_id")
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


def near_duplicate_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, radius: int = RADIUS, **sizes
) -> DataFrame:
    """One row per row of ``df``: ``doc_id, fingerprint, component_id``."""
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _grouped(df, key, text, words, radius, **sizes).select("doc_id", shown.alias("fingerprint"), "component_id")


def drop_near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, radius: int = RADIUS
) -> DataFrame:
    """``df`` with one document of each group: the one with the smallest id.

    Rows of a group that share that id (or have none, in a group without ids) are one document and stay
    together; an id that stands in several groups is judged in each on its own.
    """
    mark = free_name(df, "simhash")
    gone = _grouped(df, key, text, words, radius).filter("not (doc_id <=> component_id)")
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("fp").alias("gone_fp")).distinct()
    marked = with_simhash(df, text, mark, words)
    same = (marked[mark] == gone.gone_fp) & marked[key].eqNullSafe(gone.gone_id)
    return marked.join(gone, same, "left_anti").select(*df.columns)


@query("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every row of ``documents``."""
    return near_duplicate_groups(read_table(spark, sf_dir, "documents"), words=4)
