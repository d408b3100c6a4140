"""Exact nearest-neighbour retrieval.

A query meets every knowledge-base row, so the work is one big matrix product.  The physical plans
give the same rows:

* A knowledge base of checked size becomes a broadcast matrix.  Queries stream through it where
  they are: no shuffle, one output row per neighbour.
* A larger one is searched by ``metric_index``: queries only meet the blocks of rows that the triangle
  inequality and their filters leave.  Where filter fields have too many combinations for that, or a tile
  size is given, it is cut into groups of tiles, and so are the queries.  An equi-join on (knowledge group, query
  group) lets each task hold exactly one group of either side, whatever the keys look like; it emits
  the best ``k`` per query of its tile, never the pairs.  A ranking window merges the tiles, and
  Spark limits each group before that last shuffle.

In all, candidates come from the matrix product and their final distance from a plain left-to-right
sum over the dimensions, so equal vectors get equal distances and ties fall by document id.  The product
may be off by an error that grows with the lengths of the vectors; everything within a bound of that
error counts as a candidate, so tile and block sizes never change the rows.  Pairs without a distance (a
vector of zeros under cosine, a vector with NaN or infinity) are no neighbours in any plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom import fixed_values as fixed
from caseloom.functions.text import normalize_text
from caseloom.session import written

BROADCAST_BYTES = 256 * 1024 * 1024
TILE_BYTES = 128 * 1024 * 1024
BLOCK_ROWS = 2048
QUERY_ROWS = 1024
PRODUCT_ROWS = 256  # queries whose products with a block are held at once
GROUPS = 256  # groups of docs whose least distances give a first bound
PAIRS = 1 << 16  # exact distances taken at once
TILE_GROUPS = 16  # groups that the tiles of a side are put in, more only where one would exceed
GROUP_ROWS = 1 << 16  # rows
METRICS = ("l2sq", "cosine")


def overfetch_k(top_k: int = fixed.EVIDENCE_LIMIT) -> int:
    """Candidates to fetch for ``top_k`` evidence rows."""
    return max(top_k * fixed.OVERFETCH_FACTOR, fixed.OVERFETCH_FLOOR)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


class _Tile:
    """Knowledge-base rows as arrays, sorted by document id."""

    def __init__(self, rows: pd.DataFrame, match_on: Sequence[str]):
        rows = rows.sort_values("doc_id", kind="stable")
        self.doc_ids = rows["doc_id"].to_numpy(dtype=object)
        self.vectors = _matrix(rows["embedding"])
        self.first_equal = _first_equal(self.vectors)
        self.keys = {c: rows[c].to_numpy(dtype=object) for c in match_on}

    def matching(self, wanted: dict[str, object]) -> np.ndarray:
        keep = np.ones(len(self.doc_ids), dtype=bool)
        for column, value in wanted.items():
            if value is not None and value != "":
                keep &= self.keys[column] == value
        return np.flatnonzero(keep)


def _distances(queries: np.ndarray, docs: np.ndarray, metric: str) -> np.ndarray:
    """Distance of paired rows, summed over the dimensions from left to right."""
    total = np.zeros(len(queries))
    if metric == "l2sq":
        for j in range(queries.shape[1]):
            total += (queries[:, j] - docs[:, j]) ** 2
        return total
    q_norm, d_norm = np.zeros(len(queries)), np.zeros(len(queries))
    for j in range(queries.shape[1]):
        total += queries[:, j] * docs[:, j]
        q_norm += queries[:, j] ** 2
        d_norm += docs[:, j] ** 2
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1.0 - total / (np.sqrt(q_norm) * np.sqrt(d_norm))


class _Points:
    """Vectors as one side of products in single precision: their lengths, and which of them have a place."""

    def __init__(self, vectors: np.ndarray, metric: str):
        self.vectors, self.rows = vectors, np.arange(len(vectors))
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            size = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            self.there = np.isfinite(size) & ((size > 0) if metric == "cosine" else True)
            self.size = np.where(self.there, size, 0.0)
            single = vectors / size[:, None] if metric == "cosine" else vectors
            self.single = np.where(self.there[:, None], single, 0.0).astype(np.float32)

    def __len__(self) -> int:
        return len(self.rows)

    def take(self, rows: np.ndarray) -> _Points:
        some = object.__new__(_Points)
        some.vectors, some.rows = self.vectors, self.rows[rows]
        some.there, some.size, some.single = self.there[rows], self.size[rows], self.single[rows]
        return some


def _few_pairs(
    queries: _Points, docs: _Points, k: int, metric: str, bound: np.ndarray
) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs among which are the ``k`` nearest docs of each query, by a product in single precision.

    A query with a bound looks no farther.  For others the ``k``-th of the least distances of ``GROUPS`` groups of docs is
    no less than the ``k``-th distance of all, so no row of products is ever sorted.  Products are taken for a few
    queries at a time, so that they are looked at while the processor's cache has them.  None where single precision
    would leave too many pairs.
    """
    kept = np.flatnonzero(docs.there)
    if len(kept) < len(docs):
        docs = docs.take(kept)
    if not len(docs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, most = (1e-100, 1e100) if metric == "cosine" else (1e-15, 1e15)
    for side in (queries, docs):
        sizes = side.size[side.there]
        low = sizes.min(initial=np.inf) if metric == "cosine" else max(queries.size.max(initial=0.0), docs.size.max())
        if len(sizes) and not (least < low and sizes.max() < most):
            return None
    if metric == "cosine":
        q_length, longest, half = np.ones(len(queries)), 1.0, None
        near_bound = bound - 1.0
    else:
        q_length, longest, half = queries.size, docs.size.max(), (docs.size**2 / 2.0).astype(np.float32)
        near_bound = (bound - q_length**2) / 2.0
    rounding = np.finfo(np.float32).eps * (queries.vectors.shape[1] + 16)
    error = rounding * (q_length * longest + longest**2 + q_length**2) + 1e-30
    groups = min(max(GROUPS, 8 * k), len(docs))
    width = len(docs) // groups
    found, n = [], 0
    for at in range(0, len(queries), PRODUCT_ROWS):
        some = slice(at, at + PRODUCT_ROWS)
        # what a distance takes off the query's own share, halved: the more, the nearer
        near = queries.single[some] @ docs.single.T
        if half is not None:
            near -= half
        cut = -near_bound[some]
        if len(docs) > k and not np.isfinite(cut).all():
            best = near[:, : groups * width].reshape(len(near), width, groups).max(1)
            cut = np.maximum(cut, np.partition(best, groups - k, axis=1)[:, groups - k])
        with np.errstate(over="ignore"):
            cut = np.where(queries.there[some], cut - 2.0 * error[some], np.inf).astype(np.float32)
        rows = np.flatnonzero(near.max(1) >= cut)
        places = np.flatnonzero(near[rows] >= cut[rows, None])
        found.append((at + rows[places // len(docs)], kept[places % len(docs)]))
        n += len(places)
        if n > (at + len(near)) * 4 * max(k, 16) + PRODUCT_ROWS and len(docs) > k:
            return None
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(side) for side in zip(*found))


def _near_pairs(queries: np.ndarray, docs: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """``_few_pairs`` in double precision."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        products = queries @ docs.T
        q_sizes, d_sizes = (queries**2).sum(1), (docs**2).sum(1)
        rounding = 8.0 * np.finfo(np.float64).eps * queries.shape[1]
        if metric == "l2sq":
            near = q_sizes[:, None] + d_sizes[None, :] - 2.0 * products
            largest = d_sizes[np.isfinite(d_sizes)].max(initial=0.0)
            slack = 2.0 * rounding * (q_sizes + largest)
        else:
            near = 1.0 - products / (np.sqrt(q_sizes)[:, None] * np.sqrt(d_sizes)[None, :])
            slack = np.full(len(queries), 2.0 * rounding)
    there = np.isfinite(near)
    if docs.shape[0] > k:
        cut = np.partition(np.where(there, near, np.inf), k - 1, axis=1)[:, k - 1]
        there &= near <= (cut + np.where(np.isfinite(slack), slack, 0.0))[:, None]
    return np.nonzero(there)


def _best(queries: np.ndarray | _Points, docs: np.ndarray | _Points, k: int, metric: str, bound: np.ndarray | None = None):
    """(query row, doc row, distance) of the ``k`` nearest docs per query, nearest first.

    Docs farther than a query's ``bound`` may be left out.
    """
    queries, docs = (side if isinstance(side, _Points) else _Points(side, metric) for side in (queries, docs))
    pairs = _few_pairs(queries, docs, k, metric, np.full(len(queries), np.inf) if bound is None else bound)
    if pairs is None:
        pairs = _near_pairs(queries.vectors[queries.rows], docs.vectors[docs.rows], k, metric)
    at_query, at_doc = pairs
    exact = np.empty(len(at_query))
    for at in range(0, len(exact), PAIRS):
        some = slice(at, at + PAIRS)
        left, right = queries.vectors[queries.rows[at_query[some]]], docs.vectors[docs.rows[at_doc[some]]]
        exact[some] = _distances(left, right, metric)
    known = np.isfinite(exact)
    at_query, at_doc, exact = at_query[known], at_doc[known], exact[known]
    order = np.lexsort((at_doc, exact, at_query))
    at_query, at_doc, exact = at_query[order], at_doc[order], exact[order]
    first = np.searchsorted(at_query, at_query, side="left")
    keep = np.arange(len(at_query)) - first < k
    return at_query[keep], at_doc[keep], exact[keep]


def _first_equal(vectors: np.ndarray) -> np.ndarray:
    """Per row the first row with the same vector, or itself where hashes of different vectors meet."""
    hashes = np.empty(len(vectors), np.uint64)
    factors = np.cumprod(np.full(vectors.shape[1], 0x9E3779B97F4A7C15, np.uint64))
    for at in range(0, len(vectors), BLOCK_ROWS):
        bits = (vectors[at : at + BLOCK_ROWS] + 0.0).view(np.uint64)
        hashes[at : at + BLOCK_ROWS] = ((bits ^ (bits >> np.uint64(32))) * factors).sum(1, dtype=np.uint64)
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    first = first[of]
    for at in range(0, len(vectors), BLOCK_ROWS):
        some = slice(at, at + BLOCK_ROWS)
        differs = at + np.flatnonzero((vectors[some] != vectors[first[some]]).any(1))
        first[differs] = differs
    return first


class _Copies:
    """Rows with equal vectors as one: ``first`` are the first rows of each vector, in order.

    The ``k`` nearest rows are among the rows of the ``k`` nearest vectors, if equal distances fall by first rows.
    """

    def __init__(self, first_equal: np.ndarray):
        _, first, of = np.unique(first_equal, return_index=True, return_inverse=True)
        order = np.argsort(first)
        place = np.empty(len(first), np.int64)
        place[order] = np.arange(len(first))
        self.first, of = first[order], place[of]
        self.members, self.count = np.argsort(of, kind="stable"), np.bincount(of, minlength=len(first))
        self.start = np.cumsum(self.count) - self.count

    def rows(self, q: np.ndarray, d: np.ndarray, distance: np.ndarray, k: int):
        """Pairs of queries and vectors as pairs with rows, no more than ``k`` rows of a vector."""
        count = np.minimum(self.count[d], k)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(q, count), self.members[np.repeat(self.start[d], count) + within], np.repeat(distance, count)


def _improve(near: np.ndarray, which: np.ndarray, q: np.ndarray, d: np.ndarray, distance: np.ndarray) -> None:
    """Merge new pairs into the nearest docs of each query, in place."""
    k, touched = near.shape[1], np.unique(q)
    owner = np.concatenate([np.repeat(touched, k), q])
    doc, far = np.concatenate([which[touched].ravel(), d]), np.concatenate([near[touched].ravel(), distance])
    order = np.lexsort((doc, far, owner))
    owner, doc, far = owner[order], doc[order], far[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
    kept = rank < k
    near[owner[kept], rank[kept]], which[owner[kept], rank[kept]] = far[kept], doc[kept]


def _merged(parts: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest docs per query of several results, with their ranks."""
    q, d, dist = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((d, dist, q))
    q, d, dist = q[order], d[order], dist[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, side="left") + 1
    keep = rank <= k
    return q[keep], d[keep], dist[keep], rank[keep]


def _search(
    queries: pd.DataFrame, tile: _Tile, k: int, metric: str, match_on: Sequence[str]
) -> pd.DataFrame:
    """Nearest rows of one tile for a batch of queries; equal vectors are searched once."""
    found = []
    wanted_columns = [f"{c}_filter" for c in match_on]
    if match_on:
        groups = queries.groupby(wanted_columns, dropna=False, sort=False)
    else:
        groups = [((), queries)]
    for wanted, group in groups:
        values = [None if pd.isna(w) else w for w in wanted]
        rows = tile.matching(dict(zip(match_on, values)))
        if not len(rows):
            continue
        copies = _Copies(tile.first_equal[rows])
        once = rows[copies.first]
        blocks = [_Points(tile.vectors[once[lo : lo + BLOCK_ROWS]], metric) for lo in range(0, len(once), BLOCK_ROWS)]
        for at in range(0, len(group), QUERY_ROWS):
            block = group.iloc[at : at + QUERY_ROWS]
            asked = _Points(_matrix(block["embedding"]), metric)
            ids = block["query_id"].to_numpy()
            near, which = np.full((len(block), k), np.inf), np.full((len(block), k), len(once), np.int64)
            for i, docs in enumerate(blocks):
                q, d, dist = _best(asked, docs, k, metric, near[:, k - 1])
                if len(q):
                    _improve(near, which, q, d + i * BLOCK_ROWS, dist)
            q, rank = np.nonzero(np.isfinite(near))
            q, d, dist = copies.rows(q, which[q, rank], near[q, rank], k)
            q, d, dist, rank = _merged([(q, rows[d], dist)], k)
            found.append(
                pd.DataFrame(
                    {
                        "query_id": ids[q],
                        "doc_id": tile.doc_ids[d],
                        "distance": dist,
                        "rank": rank.astype("int32"),
                    }
                )
            )
    if not found:
        return pd.DataFrame(
            {
                "query_id": queries["query_id"].iloc[:0],
                "doc_id": pd.Series(dtype=object),
                "distance": pd.Series(dtype="float64"),
                "rank": pd.Series(dtype="int32"),
            }
        )
    return pd.concat(found, ignore_index=True)


def _hit_schema(queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            queries.schema["query_id"],
            T.StructField("doc_id", T.StringType()),
            T.StructField("distance", T.DoubleType()),
            T.StructField("rank", T.IntegerType()),
        ]
    )


@dataclass(frozen=True)
class Index:
    """A knowledge base made ready for searching; reusable across searches."""

    docs: DataFrame
    match_on: tuple[str, ...]
    rows: int
    dimension: int
    matrix: Broadcast | None
    cells: dict = field(default_factory=dict, compare=False)  # by metric, built by the first search that needs it


def prepare_index(
    kb: DataFrame, match_on: Sequence[str] = (), broadcast_bytes: int = BROADCAST_BYTES
) -> Index:
    """Measure the knowledge base, and broadcast it if it has at most ``broadcast_bytes``."""
    docs = kb.select(F.col("doc_id").cast("string"), "embedding", *match_on).filter(
        F.col("embedding").isNotNull()
    )
    text_bytes = sum((F.octet_length(F.coalesce(c, F.lit(""))) for c in match_on), F.lit(0))
    size = docs.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"),
        F.coalesce(F.sum(F.octet_length("doc_id") + text_bytes + 128), F.lit(0)).alias("text"),
    ).first()
    fits = size["rows"] * size["dimension"] * 8 + size["text"] <= broadcast_bytes
    matrix = None
    if fits and size["rows"]:
        matrix = kb.sparkSession.sparkContext.broadcast(_Tile(docs.toArrow().to_pandas(), match_on))
    return Index(docs, tuple(match_on), size["rows"], size["dimension"], matrix)


def _knn_broadcast(queries: DataFrame, index: Index, k: int, metric: str) -> DataFrame:
    matrix, match_on = index.matrix, index.match_on

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield _search(batch, matrix.value, k, metric, match_on)

    return queries.mapInPandas(search, _hit_schema(queries))


def _tile_search(k: int, metric: str, match_on: Sequence[str]) -> Callable:
    def search(query_tile: pd.DataFrame, doc_tile: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "doc_id", "distance", "rank"]
        if query_tile.empty or doc_tile.empty:
            return pd.DataFrame(columns=columns)
        return _search(query_tile, _Tile(doc_tile, match_on), k, metric, match_on)

    return search


def _knn_tiles(
    queries: DataFrame, index: Index, k: int, metric: str, tile_rows: int | None
) -> DataFrame:
    if tile_rows is None:
        tile_rows = max(1, TILE_BYTES // (max(1, index.dimension) * 8))
    docs, match_on = index.docs, index.match_on
    # A row is copied once for each group of tiles on the other side, not for each tile.
    largest = min(GROUP_ROWS, max(1, TILE_BYTES // (max(1, index.dimension) * 8)))

    def groups(rows: int) -> int:
        return max(1, min(-(-rows // tile_rows), max(TILE_GROUPS, -(-rows // largest))))

    doc_tiles, query_tiles = groups(index.rows), groups(queries.count())
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    tiled_queries = queries.select(
        "*", spread("query_id", query_tiles).alias("query_tile"), each(doc_tiles).alias("doc_tile")
    )
    tiled_docs = docs.select(
        "*", spread("doc_id", doc_tiles).alias("doc_tile"), each(query_tiles).alias("query_tile")
    )
    keys = ("query_tile", "doc_tile")
    hits = (
        tiled_queries.groupBy(*keys)
        .cogroup(tiled_docs.groupBy(*keys))
        .applyInPandas(_tile_search(k, metric, match_on), _hit_schema(queries))
    )
    nearest = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return hits.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def knn_topk(
    queries: DataFrame,
    kb: DataFrame | Index,
    k: int,
    metric: str = "l2sq",
    match_on: Sequence[str] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
    tile_rows: int | None = None,
) -> DataFrame:
    """The ``k`` nearest knowledge-base rows of each query: (query_id, doc_id, distance, rank).

    ``queries`` holds distinct ``query_id`` with an ``embedding``; ``kb`` holds ``doc_id`` and
    ``embedding``, or is an ``Index`` of it.  For each column in ``match_on`` a query's
    ``<column>_filter``, where given, restricts the rows before they are ranked.  Rows without a
    vector, or whose vector has no distance to the query, take no part.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    index = kb if isinstance(kb, Index) else prepare_index(kb, match_on, broadcast_bytes)
    queries = queries.select(
        "query_id", "embedding", *[f"{c}_filter" for c in index.match_on]
    ).filter(F.col("embedding").isNotNull())
    if index.rows == 0:
        return queries.sparkSession.createDataFrame([], _hit_schema(queries))
    if index.matrix is not None:
        return _knn_broadcast(queries, index, k, metric)
    if tile_rows is None:
        from caseloom.operators import metric_index

        try:
            if metric not in index.cells:
                index.cells[metric] = metric_index.build_metric_index(index.docs, index.match_on, metric)
            return metric_index.knn_pruned(queries, index.cells[metric], k)
        except metric_index.TooManyBlocks:
            pass
    return _knn_tiles(queries, index, k, metric, tile_rows)


def filter_metadata(kb: DataFrame, **wanted: str | None) -> DataFrame:
    """Knowledge-base rows whose fields have the wanted values; null or empty ones do not restrict."""
    for column, value in wanted.items():
        if value:
            kb = kb.filter(F.col(column) == value)
    return kb


def matching_incidents(tickets: DataFrame, kb: DataFrame, match_on: Sequence[str]) -> DataFrame:
    """How many incidents each ticket's filters leave to search in: tickets with ``incidents``, 0 included.

    One pass counts incidents per combination of fields and of fields left open, so a filter a ticket
    leaves empty costs no more than one it has.
    """
    keys = [F.col(c) for c in match_on]
    given = [F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(c)) for c in match_on]
    open_ones = [F.grouping(c).alias(f"_open_{c}") for c in match_on]
    counts = kb.cube(*keys).agg(F.count(F.lit(1)).alias("incidents"), *open_ones)
    condition = F.lit(True)
    asked = tickets.withColumns({f"_want_{c}": g for c, g in zip(match_on, given)})
    for c in match_on:
        left_open = F.col(f"_want_{c}").isNull().cast("tinyint")
        asked = asked.withColumn(f"_left_{c}", left_open)
    counts = counts.withColumnsRenamed({c: f"_kb_{c}" for c in match_on})
    for c in match_on:
        condition &= F.col(f"_left_{c}") == F.col(f"_open_{c}")
        condition &= F.coalesce(f"_want_{c}", F.lit("")) == F.when(
            F.col(f"_open_{c}") == 1, F.lit("")
        ).otherwise(F.col(f"_kb_{c}"))
    found = asked.join(counts, condition, "left")
    return found.select(*tickets.columns, F.coalesce("incidents", F.lit(0)).alias("incidents"))


def retrieved_incidents(hits: DataFrame, kb: DataFrame, digests: bool = False) -> DataFrame:
    """Hits with their knowledge-base fields, missing ones as empty text.

    ``normalized`` is the text near-duplicates are judged by, computed once per knowledge-base row.  With
    ``digests`` it is that text's digest, empty for an empty text: enough where only equal texts repeat each other.
    Hits are written first, as they are read twice and the search behind them is the costliest step.
    """
    hits = written(hits.select("query_id", "doc_id", "distance", "rank"), "hits")
    plain = normalize_text("issue_description")
    if digests:
        plain = F.when(plain == "", "").otherwise(F.sha2(plain, 256))
    text = ("issue_description", "resolution", "type", "queue", "priority")
    named = kb.withColumn("doc_id", F.col("doc_id").cast("string"))
    # Only what was found is normalised and moved.
    found = named.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    fields = found.select(
        "doc_id",
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in text],
        F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("tags"),
        "retrieval_text",
        plain.alias("normalized"),
    )
    return hits.join(fields, "doc_id", "left").select(
        "query_id", "rank", "doc_id", "distance", *text, "tags", "retrieval_text", "normalized"
    )


def embed_text(
    texts: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text"
) -> DataFrame:
    """Add an ``embedding`` column with a user-supplied encoder.

    ``encoder`` is called once per task and returns a function from a list of texts to a matrix, so
    model weights load once however many batches follow.
    """
    schema = T.StructType(
        [*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for batch in batches:
            vectors = np.asarray(model(batch[text].fillna("").tolist()), dtype="float32")
            yield batch.assign(embedding=list(vectors))

    return texts.mapInPandas(encode, schema)
