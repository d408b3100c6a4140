"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values.

``fit`` learns from at most about ``LABELLED_ROWS`` labelled documents (chosen by a hash of the id),
each distinct text once:

* *Log-odds with a Dirichlet prior.*  Documents are counted per word, in toxic and in other texts; the
  prior is ``PRIOR`` times the counts of both together.  Words whose log-odds are at least ``MIN_Z``
  standard deviations above zero, and at least ``MIN_ODDS``, make the lexicon; a word that one document repeats counts once.  The
  beginnings of words (``STEMS`` bytes) are counted and kept in the same way, for inflected words; a
  token scores by the longest of its forms that the lexicon has.
* Other tokens score the log-ratio of their rates outside and inside toxic texts, a small negative
  number, so that scattered words make a passage only where they stand close.

``passages`` then scans a text once and keeps every maximal segment (the disjoint segments of highest
total, each with no better part), by the linear stack algorithm over hits and gaps.  Of ``n`` tokens, a
total of ``s`` or more is expected ``K n exp(-lambda s)`` times by chance; lambda solves the moment
equation on the tokens of clean texts and K matches their best totals.  Segments expected at most
``MAX_EXPECTED`` times are significant.  A text's evidence is ``-log`` of the probability that its best
segment arises by chance, turned into a probability by a logistic fit on a third of the sample that the
lexicon has not seen.

Edge cases: null, empty and word-less texts have no segment and score the probability at no evidence;
without labels, or with one label only, there is no lexicon and every text scores the share of toxic rows.
Repeated rows count once in training, and an id or text with very many rows fills no sample; equal texts score alike.
Long texts are scanned whole.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import dataclasses
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import keep, read_table, text_bytes, with_fields
from caseloom.llm.decontaminate import broadcast_checked
from caseloom.llm.language_id import held_out, sample_share
from caseloom.llm.registry import query

LABELLED_ROWS = 12_000
PRIOR = 0.02
MIN_Z = 1.9
MIN_ODDS = 3.5
MAX_SCORE = 8.0
STEMS = (10, 9, 8, 7, 6, 5)
MAX_EXPECTED = 0.01
MAX_EVIDENCE = 40.0
CUT = 0.3

# ASCII letters in small, digits, bytes beyond ASCII; all else separates words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def tokens(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_TABLE).split()


def stems(word: bytes) -> list[bytes]:
    return [word[:n] + b"*" for n in STEMS if len(word) > n]


def forms(words: list[bytes]) -> set[bytes]:
    """Distinct words of a text, and the stems of those."""
    distinct = set(words)
    return distinct.union(*map(stems, distinct)) if distinct else distinct


def maximal_segments(hits: list[tuple[int, float]], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, total) of a sequence of hits (place, score > 0).

    Every token between hits scores ``gap`` < 0.  One pass with a stack of candidates that hold the
    cumulated total before and after them.
    """
    stack: list[tuple[float, float, int, int]] = []
    total, before = 0.0, None
    for place, score in hits:
        if before is not None:
            total += gap * (place - before - 1)
        left, first = total, place
        total += score
        before = place
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j -= 1
            if j < 0 or stack[j][1] >= total:
                stack.append((left, total, first, place))
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, right - left) for left, right, a, b in stack]


@dataclasses.dataclass
class Model:
    lexicon: dict[bytes, float]
    gap: float = -0.05
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    shift: float = 0.0
    heads: frozenset = frozenset()

    def __post_init__(self):
        self.heads = frozenset(form[: min(STEMS)] for form in self.lexicon)

    def hits(self, words: list[bytes]) -> list[tuple[int, float]]:
        """Places of the words that the lexicon has in some form, and their scores."""
        known, heads, short = self.lexicon, self.heads, min(STEMS)
        out = []
        for i, word in enumerate(words):
            if word[:short] in heads:
                for form in (word, *stems(word)):
                    if form in known:
                        out.append((i, known[form]))
                        break
        return out

    def segments(self, raw: bytes | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = tokens(raw)
        return len(words), maximal_segments(self.hits(words), self.gap) if self.lexicon else []

    def expected(self, total: float, n: int) -> float:
        """How many segments of ``total`` or more chance gives in ``n`` tokens."""
        return self.k * n * math.exp(-self.lam * total)

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        if not segments:
            return 0.0
        e = self.expected(max(s[2] for s in segments), n)
        return min(MAX_EVIDENCE, -math.log(max(-math.expm1(-e), 1e-300)))

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * evidence + self.shift))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and shift of a logistic fit, lightly ridged, by Newton steps."""
    w, design = np.zeros(2), np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (y - p) - np.array([1e-2, 1e-3]) * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-3])
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    if w[0] < 0:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return 0.0, float(np.log(share / (1 - share)))
    return float(w[0]), float(w[1])


def log_odds(toxic: Counter, other: Counter, prior: float = PRIOR, min_z: float = MIN_Z) -> dict[bytes, float]:
    """Words significantly more frequent in toxic texts, with their log-odds under a Dirichlet prior."""
    nt, no = sum(toxic.values()), sum(other.values())
    if not nt or not no:
        return {}
    out = {}
    for word, t in toxic.items():
        o = other.get(word, 0)
        a, whole = prior * (t + o), prior * (nt + no)
        delta = math.log((t + a) / (nt + whole - t - a)) - math.log((o + a) / (no + whole - o - a))
        if delta >= MIN_ODDS and delta >= min_z * math.sqrt(1 / (t + a) + 1 / (o + a)):
            out[word] = min(delta, MAX_SCORE)
    return out


def train(examples: list[tuple[bytes, int]]) -> Model:
    """Fit on distinct texts: two thirds make the lexicon, the rest calibrates."""
    if not examples:
        return Model({}, shift=-10.0)
    part = [zlib.crc32(b"part" + raw) % 3 for raw, _ in examples]
    learn = [e for e, p in zip(examples, part) if p]
    check = [e for e, p in zip(examples, part) if not p] or learn
    toxic, other = Counter(), Counter()
    for raw, label in learn:
        (toxic if label else other).update(forms(tokens(raw)))
    model = Model(log_odds(toxic, other))
    # token rates of lexicon words, in toxic texts that have any and in other texts
    hits, sizes, values = [0, 0], [0, 0], Counter()
    for raw, label in learn:
        words = tokens(raw)
        found = [score for _, score in model.hits(words)]
        if not label:
            values.update(found)
        if found or not label:
            hits[bool(label)] += len(found)
            sizes[bool(label)] += len(words)
    inside = min(max(hits[1] / max(sizes[1], 1), 0.02), 0.5)
    outside = min(hits[0] / max(sizes[0], 1), inside / 2)
    model.gap = math.log((1 - inside) / (1 - outside))
    # lambda: clean tokens' mean of exp(lambda * score) is one; rates that are zero count as half a token
    n = max(sizes[0], 1)
    rates = values or Counter({MAX_SCORE: 0.5})
    low, high = 0.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        gained = sum(c / n * math.expm1(min(mid * s, 600)) for s, c in rates.items())
        lost = (1 - sum(rates.values()) / n) * math.expm1(mid * model.gap)
        low, high = (mid, high) if gained + lost < 0 else (low, mid)
    model.lam = max(low, 0.1)
    tops = []
    for raw, label in check:
        size, segments = model.segments(raw)
        if not label and size:
            tops.append(model.lam * max((s[2] for s in segments), default=0.0) - math.log(size))
    if tops:
        model.k = float(np.clip(np.exp(np.mean(tops) - np.euler_gamma), 1e-6, 1.0))
    x = np.array([model.evidence(*model.segments(raw)) for raw, _ in check])
    y = np.array([float(bool(label)) for _, label in check])
    model.slope, model.shift = _logistic(x, y)
    return model


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = LABELLED_ROWS,
) -> Model:
    """Train on labelled rows outside the held-out part; a text with several labels takes the largest.

    About ``rows`` label rows are drawn by a hash of the id, and at most ``rows`` different texts under their ids
    reach the driver, drawn by a hash of the text, however many rows an id or a text has.
    """
    usable = labels.filter(~held_out(key) & F.col(label).isNotNull() & F.col(key).isNotNull())
    share = sample_share(usable.count(), rows)
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col(key)), F.lit(1_000_000)) / 1_000_000
    chosen = usable.filter(draw < share).groupBy(F.col(key).alias("labelled")).agg(F.max(label).cast("int").alias("label"))
    picked = docs.select(F.col(key).alias("id"), F.col(text).alias("said")).join(
        broadcast_checked(chosen), F.col("id") == F.col("labelled")
    )
    texts = keep(
        picked.filter("said is not null").groupBy("said").agg(F.max("label").alias("label")), "toxicity-sample"
    )
    lot = F.pmod(F.xxhash64(F.lit("text"), F.col("said")), F.lit(1_000_000)) / 1_000_000
    found = texts.filter(lot < sample_share(texts.count(), rows)).limit(rows).collect()
    return train(sorted((r.said.encode(), r.label) for r in found))


PASSAGES = T.ArrayType(
    T.StructType(
        [
            T.StructField("first_token", T.LongType()),
            T.StructField("last_token", T.LongType()),
            T.StructField("total", T.DoubleType()),
            T.StructField("expected", T.DoubleType()),
        ]
    )
)


def score_toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``score`` and the significant ``passages``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = with_fields(T.StructType([docs.schema[key]]), ("score", T.DoubleType()), ("passages", PASSAGES))
    kind = pa.list_(
        pa.struct([("first_token", pa.int64()), ("last_token", pa.int64()), ("total", pa.float64()), ("expected", pa.float64())])
    )

    def run(batches):
        model = shared.value
        for batch in batches:
            scores, passages = [], []
            for raw in text_bytes(batch.column(1)):
                n, segments = model.segments(raw)
                scores.append(model.score(model.evidence(n, segments)))
                listed = [(a, b, s, model.expected(s, n)) for a, b, s in segments]
                passages.append(
                    [dict(zip(("first_token", "last_token", "total", "expected"), x)) for x in listed if x[3] <= MAX_EXPECTED]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)], names=schema.fieldNames()
            )

    return docs.select(key, text).mapInArrow(run, schema)


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every row of ``documents``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )
