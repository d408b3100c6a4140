"""Exact nearest neighbours in knowledge bases too large to broadcast, by pivots and the triangle inequality.

Every row belongs to the cell of its nearest pivot and knows its distance to that pivot, its ring.  Rows sorted by
filter fields, cell and ring are cut into blocks of at most ``BLOCK_ROWS``; a block is a shell around a pivot, of one
combination of filter fields.  For a query at distance ``D`` from the pivot nothing in a shell ``lo .. hi`` can be nearer
than ``max(D - hi, lo - D)``, so it visits

* only blocks whose fields match what it asks for, and
* in rounds, nearest bounds first: a few blocks to have ``k`` rows at all, then some of those whose bound is not
  above its ``k``-th distance so far, then all that are left.

The first rounds are one equi-join on the block each.  In the last one a query goes once to every group of neighbouring
blocks (``GROUP_ROWS`` rows) with a block it still may need; which these are is worked out where the group is, as the
bound falls.  So where the bounds leave most blocks, a query is copied once a group, and no list of blocks
grows with the knowledge base.  Queries travel to the blocks they visit and bring their bound along, so
that only rows which improve a result come back.  A block that many queries visit is dealt out to several tasks, each
with its share of the queries; rows that many documents share make many blocks.  What is broadcast is the pivots and one
line per block, both limited (``MAX_PIVOTS``, ``MAX_BLOCKS``).

Bounds are taken with a margin for rounding, and final distances as everywhere in ``retrieval``, so the rows are
those of a search through everything, ties by document id included, whatever the pivots and blocks are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.operators.retrieval import METRICS, _best, _Copies, _first_equal, _improve, _matrix, _merged, _Points
from caseloom.session import written

MAX_PIVOTS = 1024
BLOCK_ROWS = 1024
MAX_BLOCKS = 1_000_000
GROUP_QUERIES = 2048  # queries that meet a block in one task
GROUP_ROWS = 1 << 15  # rows of neighbouring blocks that make a group
GROUP_SHARE = 1 << 14  # queries that meet a group in one task
WIDTHS = (1, 8)  # blocks a query may visit in the first rounds
PLAN_CELLS = 1 << 22  # bounds that are held at once while visits are planned
MARGIN = 1e-6
_BEST = "array<struct<distance: double, doc_id: string>>"


class TooManyBlocks(ValueError):
    """The filter fields have so many combinations that blocks would be too many to broadcast."""


@dataclass(frozen=True)
class _Shells:
    """What every planning task knows: pivots, and per block its shell, size and filter fields."""

    pivots: np.ndarray
    reach: float  # the longest row
    number: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    fields: dict[str, np.ndarray]
    group: np.ndarray


@dataclass(frozen=True)
class MetricIndex:
    """A knowledge base in blocks; reusable across searches."""

    docs: DataFrame
    match_on: tuple[str, ...]
    metric: str
    rows: int
    blocks: int
    shells: Broadcast | None


def _points(vectors: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as points of a space in which distances obey the triangle inequality, and which of them have a place."""
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        size = np.sqrt((vectors**2).sum(1))
        known = np.isfinite(size) & ((size > 0) if metric == "cosine" else True)
        points = vectors / size[:, None] if metric == "cosine" else vectors
    return np.where(known[:, None], points, 0.0), known


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances of all left points to all right ones."""
    square = (left**2).sum(1)[:, None] + (right**2).sum(1)[None, :] - 2.0 * left @ right.T
    return np.sqrt(np.maximum(square, 0.0))


def build_metric_index(
    kb: DataFrame, match_on: Sequence[str] = (), metric: str = "l2sq", pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> MetricIndex:
    """Assign all rows with a usable vector to blocks.

    Pivots are rows chosen by a hash, about the square root of the row count and ``MAX_PIVOTS`` at most.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark, fields = kb.sparkSession, list(match_on)
    docs = kb.select(F.col("doc_id").cast("string"), "embedding", *fields).filter(F.col("embedding").isNotNull())
    rows = docs.count()
    wanted = min(MAX_PIVOTS, pivots or int(np.ceil(np.sqrt(rows))))
    chosen = docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(wanted).select("embedding").toPandas()
    points = np.zeros((0, 0))
    if len(chosen):
        points, known = _points(_matrix(chosen["embedding"]), metric)
        points = np.unique(points[known], axis=0)
    if not len(points):
        points = np.zeros((1, points.shape[1]))
    shared = spark.sparkContext.broadcast(points)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            at, known = _points(_matrix(batch["embedding"]), metric)
            apart = _apart(at, shared.value)
            cell = apart.argmin(1)
            size = np.sqrt((at**2).sum(1))
            placed = batch.assign(cell=cell, ring=apart[np.arange(len(at)), cell], reach=size)
            yield placed[known]

    placed = T.StructType(
        [*docs.schema.fields, T.StructField("cell", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("ring", "reach")]
    )
    assigned = written(docs.mapInPandas(assign, placed), "metric-cells")
    order = [*fields, "cell", "ring", "doc_id"]
    ordered = assigned.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, filled, number = None, 0, -1
        for batch in batches:
            numbers = np.empty(len(batch), np.int64)
            keys = list(zip(*(batch[c].where(batch[c].notna(), None) for c in [*fields, "cell"])))
            for i, key in enumerate(keys):
                if key != last or filled == block_rows:
                    last, filled, number = key, 0, number + 1
                numbers[i] = number
                filled += 1
            yield batch.drop(columns="part").assign(block=batch["part"].to_numpy(np.int64) * 2**32 + numbers)

    numbered = T.StructType([*placed.fields, T.StructField("block", T.LongType())])
    blocks = written(
        ordered.withColumn("part", F.spark_partition_id()).mapInPandas(cut, numbered), "metric-blocks"
    )
    lines = (
        blocks.groupBy("block")
        .agg(
            *(F.first(c).alias(c) for c in [*fields, "cell"]),
            F.min("ring").alias("low"), F.max("ring").alias("high"), F.max("reach").alias("reach"),
            F.count(F.lit(1)).alias("n"),
        )
        .limit(MAX_BLOCKS + 1)
        .toPandas()
        .sort_values("block")
    )
    if len(lines) > MAX_BLOCKS:
        raise TooManyBlocks(f"more than {MAX_BLOCKS} blocks")
    if lines.empty:
        return MetricIndex(docs, tuple(fields), metric, 0, 0, None)
    shells = _Shells(
        points, float(lines["reach"].max()), *(lines[c].to_numpy() for c in ("block", "cell", "low", "high", "n")),
        {c: lines[c].to_numpy(dtype=object) for c in fields},
        (lines["n"].cumsum() - lines["n"]).to_numpy() // GROUP_ROWS,
    )
    table = blocks.select("block", "doc_id", "embedding")
    return MetricIndex(
        table, tuple(fields), metric, int(lines["n"].sum()), len(lines), spark.sparkContext.broadcast(shells)
    )


def _bounds_below(at: np.ndarray, shells: _Shells, matching: np.ndarray, metric: str) -> tuple[np.ndarray, ...]:
    """Per query and block the distance from its pivot, how near a row may be at least, and this as a distance of ``metric``."""
    pivots = _apart(at, shells.pivots)
    cell = pivots[:, shells.cell[matching]]
    low = np.maximum(np.maximum(cell - shells.high[matching], shells.low[matching] - cell), 0.0)
    margin = MARGIN * (np.sqrt((at**2).sum(1)) + shells.reach)
    nearest = np.maximum(low - margin[:, None], 0.0) ** 2
    if metric == "cosine":
        nearest /= 2.0
    return cell, low, nearest


def _within(bounds: np.ndarray) -> np.ndarray:
    return bounds * (1.0 + 1e-9) + np.finfo(float).tiny


def _choose(
    at: np.ndarray, shells: _Shells, matching: np.ndarray, bounds: np.ndarray, missing: np.ndarray,
    visited: list, metric: str, width: int | None,
) -> list[np.ndarray]:
    """The blocks that some queries visit next, as places in ``shells``; without a width the groups of all that are left."""
    cell, low, nearest = _bounds_below(at, shells, matching, metric)
    open_ones = nearest <= _within(bounds)[:, None]
    out = []
    for i in range(len(at)):
        open_ones[i, np.isin(matching, visited[i])] = False
        there = np.flatnonzero(open_ones[i])
        if width is None:
            out.append(np.unique(shells.group[matching[there]]))
            continue
        there = there[np.lexsort((there, cell[i, there], low[i, there]))]
        n = width
        if missing[i] > 0:  # enough rows for a first result
            n = max(n, int(np.searchsorted(np.cumsum(shells.rows[matching[there]]), missing[i])) + 1)
        out.append(matching[there[:n]])
    return out


def _fitting(asked: pd.DataFrame, shells: _Shells, match_on: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks that fit the filters, as places in ``shells``, and the queries that ask for these."""
    values = asked[[f"{c}_filter" for c in match_on]].astype(object)
    values = values.where(values.notna() & (values != ""), None)
    for wanted, places in _same(list(map(tuple, values.to_numpy()))):
        fits = np.ones(len(shells.number), bool)
        for c, value in zip(match_on, wanted):
            if value is not None:
                fits &= shells.fields[c] == value
        yield np.flatnonzero(fits), places


def _planned(state: DataFrame, index: MetricIndex, k: int, width: int | None) -> DataFrame:
    """``state`` with the block numbers each query visits next; without a width, the groups of blocks."""
    shared, metric, match_on = index.shells, index.metric, index.match_on

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shells = shared.value
        rows = max(1, PLAN_CELLS // max(1, len(shells.number)))
        for batch in batches:
            if not len(batch):
                continue
            at, known = _points(_matrix(batch["embedding"]), metric)
            best = batch["best"].tolist()
            missing = np.array([k - len(b) for b in best])
            bounds = np.array([b[-1]["distance"] if len(b) >= k else np.inf for b in best])
            visited = [np.searchsorted(shells.number, v) for v in batch["visited"]]
            chosen: list = [np.zeros(0, np.int64)] * len(batch)
            for matching, places in _fitting(batch, shells, match_on):
                places = places[known[places]]
                for i in range(0, len(places), rows):
                    some = places[i : i + rows]
                    found = _choose(
                        at[some], shells, matching, bounds[some], missing[some], [visited[j] for j in some], metric, width
                    )
                    for j, blocks in zip(some, found):
                        chosen[j] = blocks
            yield batch.assign(next=[c if width is None else shells.number[c] for c in chosen])

    schema = T.StructType([*state.schema.fields, T.StructField("next", T.ArrayType(T.LongType()))])
    return state.mapInPandas(run, schema)


def _same(values: list[tuple]) -> Iterator[tuple[tuple, np.ndarray]]:
    groups: dict[tuple, list[int]] = {}
    for i, value in enumerate(values):
        groups.setdefault(value, []).append(i)
    for value, places in groups.items():
        yield value, np.array(places)


def _visited(visits: DataFrame, index: MetricIndex, k: int, kind: T.DataType) -> DataFrame:
    """Rows of the visited blocks that may belong to a query's result: ``query_id, distance, doc_id``."""
    metric = index.metric
    tasks = F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).cast("int")
    shares = F.broadcast(visits.groupBy("block").agg(tasks.alias("tasks")))  # at most MAX_BLOCKS rows of 12 bytes
    asked = visits.join(shares, "block").withColumn("share", F.pmod(F.xxhash64("query_id"), "tasks").cast("int"))
    there = index.docs.join(shares, "block").withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))
    )
    schema = T.StructType(
        [T.StructField("query_id", kind), T.StructField("distance", T.DoubleType()), T.StructField("doc_id", T.StringType())]
    )

    def search(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or docs.empty:
            return pd.DataFrame({c: [] for c in schema.fieldNames()})
        docs = docs.sort_values("doc_id", kind="stable")
        bound = queries["bound"].to_numpy()
        vectors = _matrix(docs["embedding"])
        copies = _Copies(_first_equal(vectors))
        q, d, distance = _best(_matrix(queries["embedding"]), vectors[copies.first], k, metric, bound)
        q, d, distance, _ = _merged([copies.rows(q, d, distance, k)], k)
        near = distance <= queries["bound"].to_numpy()[q]
        return pd.DataFrame(
            {
                "query_id": queries["query_id"].to_numpy()[q[near]],
                "distance": distance[near],
                "doc_id": docs["doc_id"].to_numpy(dtype=object)[d[near]],
            }
        )

    keys = ("block", "share")
    left = asked.select(*keys, "query_id", "embedding", "bound").groupBy(*keys)
    right = there.select(*keys, "doc_id", "embedding").groupBy(*keys)
    return left.cogroup(right).applyInPandas(search, schema)


def _rest(planned: DataFrame, index: MetricIndex, k: int, kind: T.DataType) -> DataFrame:
    """Rows of all blocks that may still matter, by groups: ``query_id, distance, doc_id``, and how many blocks were ``met``."""
    shared, metric, match_on, spark = index.shells, index.metric, index.match_on, planned.sparkSession
    bound = F.when(F.size("best") >= k, F.element_at("best", -1)["distance"]).otherwise(F.lit(float("inf")))
    filters = [f"{c}_filter" for c in match_on]
    visits = planned.select("query_id", "embedding", "visited", *filters, bound.alias("bound"), F.explode("next").alias("group"))
    tasks = F.ceil(F.count(F.lit(1)) / GROUP_SHARE).cast("int")
    shares = F.broadcast(visits.groupBy("group").agg(tasks.alias("tasks")))  # fewer than blocks
    asked = visits.join(shares, "group").withColumn("share", F.pmod(F.xxhash64("query_id"), "tasks").cast("int"))
    lines = pd.DataFrame({"block": shared.value.number, "group": shared.value.group})
    placed = index.docs.join(F.broadcast(spark.createDataFrame(lines)), "block")
    there = placed.join(shares, "group").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    schema = T.StructType(
        [T.StructField("query_id", kind), T.StructField("distance", T.DoubleType()), T.StructField("doc_id", T.StringType()),
         T.StructField("met", T.LongType())]
    )

    def search(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or docs.empty:
            return pd.DataFrame({c: [] for c in schema.fieldNames()})
        shells = shared.value
        docs = docs.sort_values("doc_id", kind="stable")
        names, vectors, of = docs["doc_id"].to_numpy(dtype=object), _matrix(docs["embedding"]), docs["block"].to_numpy()
        members = {}
        for place in np.flatnonzero(np.isin(shells.number, of)):
            rows = np.flatnonzero(of == shells.number[place])
            copies = _Copies(_first_equal(vectors[rows]))
            members[place] = _Points(vectors[rows[copies.first]], metric), copies, rows
        asked = _matrix(queries["embedding"])
        at, _ = _points(asked, metric)
        asked = _Points(asked, metric)
        start = queries["bound"].to_numpy()
        near, which = np.full((len(queries), k), np.inf), np.full((len(queries), k), len(docs), np.int64)
        met = np.zeros(len(queries), np.int64)
        seen = [np.asarray(v, np.int64) for v in queries["visited"]]
        for matching, places in _fitting(queries, shells, match_on):
            matching = matching[[p in members for p in matching]]
            rows = max(1, PLAN_CELLS // max(1, 4 * len(matching), max((len(v) for v, _, _ in members.values()), default=1)))
            for i in range(0, len(places) if len(matching) else 0, rows):
                some = places[i : i + rows]
                _, low, nearest = _bounds_below(at[some], shells, matching, metric)
                fresh, numbers = np.ones(nearest.shape, bool), shells.number[matching]
                been, who = np.concatenate([seen[j] for j in some]), np.repeat(np.arange(len(some)), [len(seen[j]) for j in some])
                column = np.minimum(np.searchsorted(numbers, been), len(numbers) - 1)
                here = numbers[column] == been
                fresh[who[here], column[here]] = False
                for m in np.argsort(low.mean(0), kind="stable"):
                    bounds = np.minimum(start[some], near[some, k - 1])
                    open_ones = some[fresh[:, m] & (nearest[:, m] <= _within(bounds))]
                    if not len(open_ones):
                        continue
                    met[open_ones] += 1
                    block, copies, rows_of = members[matching[m]]
                    q, d, distance = _best(asked.take(open_ones), block, k, metric, np.minimum(start, near[:, k - 1])[open_ones])
                    if len(q):
                        q, d, distance = copies.rows(q, d, distance, k)
                        _improve(near, which, open_ones[q], rows_of[d], distance)
        q, rank = np.nonzero(np.isfinite(near) & (near <= start[:, None]))
        ids = queries["query_id"].to_numpy()
        found = {"query_id": ids[q], "distance": near[q, rank], "doc_id": names[which[q, rank]], "met": np.zeros(len(q), np.int64)}
        counts = {"query_id": ids, "distance": np.nan, "doc_id": None, "met": met}
        return pd.concat([pd.DataFrame(found), pd.DataFrame(counts)[met > 0]], ignore_index=True)

    keys = ("group", "share")
    left = asked.select(*keys, "query_id", "embedding", "visited", "bound", *filters).groupBy(*keys)
    right = there.select(*keys, "block", "doc_id", "embedding").groupBy(*keys)
    return left.cogroup(right).applyInPandas(search, schema)


def search_state(queries: DataFrame, index: MetricIndex, k: int) -> DataFrame:
    """Each query's result and the blocks it visited: ``query_id, best, visited, met`` and what it was asked with.

    ``visited`` are the blocks of the first rounds; ``met`` counts those of the last one.
    """
    asked = queries.select("query_id", "embedding", *[f"{c}_filter" for c in index.match_on])
    state = asked.filter(F.col("embedding").isNotNull()).select(
        "*", F.array().cast(_BEST).alias("best"), F.array().cast("array<bigint>").alias("visited"), F.lit(0).cast("long").alias("met")
    )
    if index.shells is None:
        return state
    kind = queries.schema["query_id"].dataType
    for width in (*WIDTHS, None):
        planned = written(_planned(state, index, k, width), "metric-plan")
        if planned.filter(F.size("next") > 0).isEmpty():
            return planned.drop("next")
        if width is None:
            rows = _rest(planned, index, k, kind)
            visited = F.col("visited")
        else:
            bound = F.when(F.size("best") >= k, F.element_at("best", -1)["distance"]).otherwise(F.lit(float("inf")))
            visits = planned.select("query_id", "embedding", bound.alias("bound"), F.explode("next").alias("block"))
            rows = _visited(visits, index, k, kind).withColumn("met", F.lit(0).cast("long"))
            visited = F.concat("visited", "next")
        hit = F.when(F.col("doc_id").isNotNull(), F.struct("distance", "doc_id"))
        found = rows.groupBy("query_id").agg(F.collect_list(hit).alias("found"), F.sum("met").alias("more"))
        merged = F.array_sort(F.concat("best", F.coalesce("found", F.array().cast(_BEST))))
        state = planned.join(found, "query_id", "left").select(
            *asked.columns, F.slice(merged, 1, k).alias("best"), visited.alias("visited"),
            (F.col("met") + F.coalesce("more", F.lit(0))).alias("met"),
        )
        state = written(state, "metric-round")
    return state


def hits_of(state: DataFrame) -> DataFrame:
    """The neighbours in a search's state: ``query_id, doc_id, distance, rank``."""
    rows = state.select("query_id", F.posexplode("best").alias("at", "hit"))
    return rows.select("query_id", "hit.doc_id", "hit.distance", (F.col("at") + 1).cast("int").alias("rank"))


def visits_of(state: DataFrame, index: MetricIndex) -> DataFrame:
    """One row: queries, blocks, the pairs of them that met, and all pairs."""
    n = F.count(F.lit(1))
    met = F.coalesce(F.sum(F.size("visited") + F.col("met")), F.lit(0)).cast("long")
    return state.agg(n.alias("queries"), met.alias("pairs_met")).select(
        "queries", F.lit(index.blocks).cast("long").alias("blocks"), "pairs_met",
        (F.col("queries") * index.blocks).alias("pairs_in_all"),
    )


def knn_pruned(queries: DataFrame, index: MetricIndex, k: int) -> DataFrame:
    """The ``k`` nearest rows of each query: (query_id, doc_id, distance, rank)."""
    return hits_of(search_state(queries, index, k))
