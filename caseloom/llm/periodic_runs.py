"""Periodic runs of words, found by seeds that are extended along diagonals.

A run is a longest stretch of words in which words ``q`` apart are equal, ``q`` its smallest period, and which is
at least ``max(SHORTEST, REPEATS * q)`` words long.  On the diagonal of lag ``q`` it is a row of at least ``(REPEATS - 1) * q``
equal pairs, so a stretch of that many words starts at its first word and again ``q`` words later.

*Index.*  Lags are taken in classes ``low .. 3 * low // 2``.  The k-grams of a class have the smallest overlap that a run
of its lags guarantees, ``k = max(SHORTEST - low, 3 * low)``.  K-grams are named exactly, by doubling: the name of a
longer gram is the pair of names of the two that cover it, and no hash can collide.

*Pairs.*  Each occurrence is paired with the next one in the document alone.  That is enough: let a run of smallest period
``q`` start with gram ``u`` and ``u`` occur again ``d < q`` later.  As ``d + q <= 3 * low <= k``, ``u`` has both periods and
so (Fine and Wilf) their greatest common divisor, which divides ``q`` and covers the run's period: ``q`` would not be the
smallest.  So there are fewer pairs than words in a class, and not the square of a frequent gram's count.

*Extension.*  A pair is extended both ways along its diagonal.  A table of the furthest word covered on each lag passes over
pairs inside a stretch that is known, so a stretch is extended once.

Documents of an Arrow batch lie in one array of word numbers with a unique number between neighbours, so no gram that
crosses a border repeats.  Only documents in which a gram of one class repeats stay for the next.
A document is one row of a task; memory is a few numbers a word of ``SLICE`` bytes of text, or of one longer text.

Defined cases: null and wordless texts have no word and no run.  Long texts are read whole.  Rows are
independent: repeated rows, null ids and other columns change nothing.  Runs may overlap; ties for the longest run go
to the smallest start, then the smallest period.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import read_table, text_bytes
from caseloom.llm.registry import query

SHORTEST, REPEATS = 6, 4
SLICE = 4 << 20  # bytes of text worked on at once, where there are several texts
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_STEP = 1 << 12
Run = tuple[int, int, int]  # start, length, period


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last byte of every word ``[^\\x20\\x09-\\x0D]+``."""
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~_BLANK[np.frombuffer(raw, np.uint8)]
    edges = np.diff(word)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_ids(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A number for every word, equal for equal words."""
    if not len(starts):
        return np.zeros(0, np.int64)
    bounds = np.empty(2 * len(starts), np.int64)  # of words and of what is between them
    bounds[0::2], bounds[1::2] = starts, stops
    cells = pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw)]
    )
    words = cells.take(pa.array(np.arange(0, len(cells), 2)))
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def lag_class(low: int) -> tuple[int, int]:
    """The highest lag of the class that begins with ``low``, and its ``k``."""
    return low * 3 // 2, max(SHORTEST - low, (REPEATS - 1) * low)


class Grams:
    """Exact names of the k-grams of a row of numbers, for growing ``k``."""

    def __init__(self, numbers: np.ndarray):
        self.size, self.names = 1, numbers

    def of(self, k: int) -> np.ndarray:
        while 2 * self.size <= k:
            self.names = self._pairs(self.names, self.size)
            self.size *= 2
        return self.names if k == self.size else self._pairs(self.names, k - self.size)

    @staticmethod
    def _pairs(names: np.ndarray, apart: int) -> np.ndarray:
        left, right = names[: len(names) - apart], names[apart:]
        if not len(left):
            return left
        both = left * (int(right.max()) + 1) + right
        return np.unique(both, return_inverse=True)[1]


def _stretch(numbers: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """First and one-past-last position around ``at`` with equal words ``lag`` apart."""
    stop = at
    while True:
        here = numbers[stop : min(stop + _STEP, len(numbers) - lag)]
        other = np.flatnonzero(here != numbers[stop + lag : stop + lag + len(here)])
        if len(other):
            stop += int(other[0])
            break
        stop += len(here)
        if len(here) < _STEP:
            break
    start = at
    while start:
        low = max(0, start - _STEP)
        other = np.flatnonzero(numbers[low:start] != numbers[low + lag : start + lag])
        if len(other):
            return low + int(other[-1]) + 1, stop
        start = low
    return start, stop


def runs_of_documents(documents: list[np.ndarray]) -> list[list[Run]]:
    """The runs of each document, given as its words' numbers (small and not negative), sorted."""
    sizes = np.array([len(d) for d in documents], np.int64)
    out: list[list[Run]] = [[] for _ in documents]
    chosen = np.flatnonzero(sizes >= SHORTEST)
    if not len(chosen):
        return out
    row = np.concatenate([x for i in chosen for x in (documents[i], [0])]).astype(np.int64)
    row[np.cumsum(sizes[chosen] + 1) - 1] = row.max() + 1 + np.arange(len(chosen))
    grams, low = Grams(row), 1
    while max(SHORTEST, REPEATS * low) <= sizes[chosen].max():
        high, k = lag_class(low)
        borders = np.cumsum(sizes[chosen] + 1)
        begins = borders - sizes[chosen] - 1
        names = grams.of(k)
        order = np.argsort(names, kind="stable")
        at, lags = order[:-1], np.diff(order)
        owner = np.searchsorted(borders, order, "right")
        again = (names[order[1:]] == names[at]) & (owner[1:] == owner[:-1])
        seeds = np.flatnonzero(again & (lags >= low) & (lags <= high))
        covered: dict[int, int] = {}
        for place, lag in sorted(zip(at[seeds].tolist(), lags[seeds].tolist())):
            if place < covered.get(lag, 0):
                continue
            start, stop = _stretch(row, place, lag)
            covered[lag] = stop
            length = stop - start + lag
            if length >= max(SHORTEST, REPEATS * lag):
                n = int(np.searchsorted(borders, start, "right"))
                out[chosen[n]].append((start - int(begins[n]), length, lag))
        stay = np.zeros(len(chosen), bool)
        stay[owner[:-1][again]] = True  # where no gram repeats, no longer one does
        if not stay.any():
            break
        if sizes[chosen[stay]].sum() < 0.7 * len(row):
            places = np.repeat(stay, sizes[chosen] + 1)
            row, chosen = row[places], chosen[stay]
            grams.names = grams.names[places[: len(grams.names)]]
        low = high + 1
    return [sorted(runs) for runs in out]


def kept_words(n: int, runs: list[Run]) -> np.ndarray | None:
    """Which of ``n`` words stay when each run keeps its first period; ``None`` if all do."""
    if not runs:
        return None
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def joined(raw: bytes, starts: np.ndarray, stops: np.ndarray, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The words between the bounds, in their order and with one space between them, in parts."""
    for i in range(0, len(starts), chunk):
        words = zip(starts[i : i + chunk].tolist(), stops[i : i + chunk].tolist())
        yield (b" " if i else b"") + b" ".join([raw[a:b] for a, b in words])


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word order of a document that is made periodic, or ``None``; a null id makes none."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return order


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def periodic_runs(
    df: DataFrame, key: str = "doc_id", text: str = "text",
    rearrange: Callable[[object, int], np.ndarray | None] | None = None, with_text: bool = False,
) -> DataFrame:
    """``key, n_words, runs, collapsed_sha256[, collapsed]`` of every row.

    ``runs`` has start, length and period in words, sorted.  ``collapsed`` is the text with one space between words
    and without the repetitions of runs.  ``rearrange`` may give a document's words another order before the search.
    """
    fields = [("n_words", T.LongType()), ("runs", RUNS), ("collapsed_sha256", T.StringType())]
    fields += [("collapsed", T.StringType())] if with_text else []
    schema = T.StructType([df.schema[key], *(T.StructField(n, t) for n, t in fields)])

    def solved(ids: list, texts: list[bytes]) -> Iterator[tuple]:
        """Words, runs, digest and collapsed text of some documents."""
        bounds = [word_bounds(raw) for raw in texts]
        counts = [len(b[0]) for b in bounds]
        shifts = np.cumsum([0, *(len(raw) + 1 for raw in texts[:-1])])
        whole = [np.concatenate([b[i] + shift for b, shift in zip(bounds, shifts)]) for i in (0, 1)]
        documents = np.split(word_ids(b" ".join(texts), *whole), np.cumsum(counts)[:-1])
        orders = [rearrange(i, n) if rearrange else None for i, n in zip(ids, counts)]
        documents = [d if o is None else d[o] for d, o in zip(documents, orders)]
        for raw, (starts, stops), n, order, runs in zip(texts, bounds, counts, orders, runs_of_documents(documents)):
            stay = kept_words(n, runs)
            if order is not None:
                starts, stops = starts[order], stops[order]
            if stay is not None:
                starts, stops = starts[stay], stops[stay]
            digest, parts = hashlib.sha256(), []
            for part in joined(raw, starts, stops):
                digest.update(part)
                if with_text:
                    parts.append(part)
            yield n, runs, digest.hexdigest(), b"".join(parts).decode("utf-8", "replace")

    def table(keys: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        counts, runs, digests, said = zip(*solved(keys.to_pylist(), texts))
        flat = np.array([x for each in runs for x in each], np.int64).reshape(-1, 3)
        names = ["start", "length", "period"]
        struct = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=names)
        offsets = pa.array(np.cumsum([0, *map(len, runs)]).astype(np.int32))
        columns = [keys, pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, struct), pa.array(digests, pa.string())]
        columns += [pa.array(said, pa.string())] if with_text else []
        return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    def run(batches):
        for batch in batches:
            held, size, begun = [], 0, 0
            for i, raw in enumerate(text_bytes(batch.column(1))):
                raw = raw or b""
                if held and size + len(raw) > SLICE:
                    yield table(batch.column(0).slice(begun, len(held)), held)
                    held, size, begun = [], 0, i
                held.append(raw)
                size += len(raw)
            if held:
                yield table(batch.column(0).slice(begun, len(held)), held)

    return df.select(key, text).mapInArrow(run, schema)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all ``documents``, a tenth of which are made periodic, and digests of what is left without them."""
    found = periodic_runs(read_table(spark, sf_dir, "documents"), rearrange=planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(told, ""), 256).alias("runs_sha256"), "collapsed_sha256",
    )
    return best.select(
        "doc_id", "n_runs", (-F.col("best.col2")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"), F.expr("1000 * best.length div -best.col3").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )
