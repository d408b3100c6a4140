"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's letters are cut into byte n-grams (2 to 4 bytes, never across two separators), each hashed to
one of ``BUCKETS`` embeddings; their average goes through a linear softmax.  Embeddings and softmax are
trained together by stochastic gradient descent in numpy, on windows of words of at most
``SAMPLE_PER_LANG`` labelled documents a language and ``SAMPLE_ROWS`` in all (``fit``).  A tenth of the sample is kept from
training: it sets the temperature of the softmax and the score below which a text is rejected, so that
about ``REJECT_RATE`` of texts in a known language would be, and never more than those scored under one half.

For prediction the average and the linear layer commute, so every n-gram just adds its row of
``embeddings @ weights``; whole texts are read in blocks, whatever their length.

Edge cases: a null text, and one without any letter, is ``und`` with score 0; one with letters but no
n-gram gets the languages' shares; rows without a language or id train nothing or are still predicted;
without any labelled row every text is ``und``, and only texts without letters are rejected.  Equal texts count once
in training and score alike; ties of two languages go to the first in order; other columns are carried along.
"""

from __future__ import annotations

import dataclasses
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import free_name, read_table, text_bytes, with_fields
from caseloom.llm.registry import query

ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
DIM = 12
SAMPLE_PER_LANG = 1200
SAMPLE_ROWS = 240_000
MAX_LANGS = 10_000
WORD_BYTES = 240
WINDOW_WORDS = (2, 5, 12, 40)
STEPS = 600
STEPS_PER_LANG = 20
REJECT_RATE = 0.001
BLOCK = 1 << 18

_LETTER = regex.compile(r"\p{L}")
# ASCII letters in small, bytes beyond ASCII as they are, all else a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SALT = {2: 0x9E3779B1, 3: 0x85EBCA6B, 4: 0xC2B2AE35}


def has_letter(raw: bytes) -> bool:
    return _LETTER.search(raw.decode("utf-8", "replace")) is not None


def buckets(values: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams that start at each byte, per order; ``BUCKETS`` where there is none."""
    space = values == 32
    double = space[:-1] & space[1:]
    wide, out = values.astype(np.uint32), []
    for order in ORDERS:
        n = len(values) - order + 1
        if n < 1:
            out.append(np.full(len(values), BUCKETS, np.int64))
            continue
        h = np.full(n, _SALT[order], np.uint32)
        broken = np.zeros(n, bool)
        for i in range(order):
            h = (h ^ wide[i : i + n]) * np.uint32(16777619)
            if i + 1 < order:
                broken |= double[i : i + n]
        h = ((h >> np.uint32(15)) ^ h) & np.uint32(BUCKETS - 1)
        full = np.full(len(values), BUCKETS, np.int64)
        full[:n] = np.where(broken, BUCKETS, h)
        out.append(full)
    return out


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one array, apart by spaces that no n-gram crosses, and where each starts."""
    plain = [b" " + t.translate(_TABLE) + b"   " for t in texts]
    starts = np.cumsum([0, *map(len, plain[:-1])])
    return np.frombuffer(b"".join(plain), np.uint8), starts


@dataclasses.dataclass
class Model:
    langs: list[str]
    rows: np.ndarray  # BUCKETS + 1 rows of logits; the last, of no n-gram, is zero
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def _sums(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        values, starts = _joined(texts)
        sums, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for found in buckets(values):
            sums += np.add.reduceat(self.rows[found], starts, axis=0)
            counts += np.add.reduceat((found < BUCKETS).astype(np.int64), starts)
        return sums, counts

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Calibrated probabilities of each language, texts read in blocks of about ``BLOCK`` bytes."""
        sums, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        block, at, size = [], [], 0

        def flush():
            s, c = self._sums(block)
            np.add.at(sums, at, s)
            np.add.at(counts, at, c)

        for i, text in enumerate(texts):
            for a in range(0, max(len(text), 1), BLOCK):  # blocks of one text share the n-grams at the cut
                block.append(text[a : a + BLOCK])
                at.append(i)
                size += len(block[-1])
                if size >= BLOCK:
                    flush()
                    block, at, size = [], [], 0
        if block:
            flush()
        logits = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float, bool]]:
        """Language, score and whether the text is rejected."""
        letters = [bool(t) and has_letter(t) for t in texts]
        if not self.langs:
            return [("und", 0.0, not some) for some in letters]
        p = self.probabilities([t or b"" for t in texts])
        best = p.argmax(axis=1)
        return [
            (self.langs[b], float(row[b]), bool(row[b] < self.threshold)) if some else ("und", 0.0, True)
            for some, b, row in zip(letters, best, p)
        ]


def train(examples: list[tuple[bytes, str]], steps: int = STEPS, batch: int = 64, rate: float = 12.0, seed: int = 7) -> Model:
    """Fit embeddings and softmax by SGD, then temperature and threshold on the part kept out.

    At least three passes over the examples, and more where those are fewer than ``steps`` steps, or than
    ``STEPS_PER_LANG`` for each language.
    """
    langs = sorted({lang for _, lang in examples})
    steps = max(steps, STEPS_PER_LANG * len(langs))
    if not langs:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0))
    number = {lang: i for i, lang in enumerate(langs)}
    rng = np.random.default_rng(seed)
    apart = np.array([zlib.crc32(t) % 10 == 0 for t, _ in examples])
    bags, labels = [], np.array([number[lang] for _, lang in examples])
    for text, _ in examples:
        values, _starts = _joined([text])
        bag = np.concatenate(buckets(values))
        bags.append(bag[bag < BUCKETS])
    usable = np.array([len(b) > 0 for b in bags])
    fit, check = np.flatnonzero(~apart & usable), np.flatnonzero(apart & usable)
    if not len(fit):
        fit = np.flatnonzero(usable)
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    weights, bias = rng.normal(0, 1 / DIM, (DIM, len(langs))), np.zeros(len(langs))
    per_epoch = max(1, -(-len(fit) // batch))
    epochs = max(3, -(-steps // per_epoch))
    total, done = epochs * per_epoch, 0
    for _ in range(epochs):
        order = rng.permutation(fit)
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            sizes = np.array([len(bags[i]) for i in rows])
            ids = np.concatenate([bags[i] for i in rows])
            starts = np.cumsum(sizes) - sizes
            hidden = np.add.reduceat(emb[ids], starts, axis=0) / sizes[:, None]
            z = hidden @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1.0
            step = rate * (1 - done / total) / len(rows)
            back = (p @ weights.T) / sizes[:, None]
            weights -= step / 8 * hidden.T @ p
            bias -= step / 40 * p.sum(axis=0)
            np.add.at(emb, ids, -step * np.repeat(back, sizes, axis=0))
            done += 1
    model = Model(langs, np.vstack([emb @ weights, np.zeros(len(langs))]).astype(np.float32), bias)
    held = check if len(check) else fit
    if len(held):
        texts = [examples[i][0] for i in held]
        losses = {}
        for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0):
            model.temperature = t
            p = model.probabilities(texts)
            losses[t] = -np.log(np.maximum(p[np.arange(len(held)), labels[held]], 1e-12)).mean()
        model.temperature = min(losses, key=losses.get)
        top = model.probabilities(texts).max(axis=1)
        model.threshold = float(min(0.5, np.quantile(top, REJECT_RATE)))
    return model


def windows(raw: bytes) -> list[bytes]:
    """Training windows of a text: runs of words of several sizes, places chosen by its checksum."""
    words, seed = raw.split(), zlib.crc32(raw)
    out = []
    for k, size in enumerate(WINDOW_WORDS):
        a = (seed >> (3 * k)) % max(1, len(words) - size + 1)
        out.append(b" ".join(map(cut_word, words[a : a + size])))
    return list(dict.fromkeys(out))


def cut_word(word: bytes) -> bytes:
    """A word of at most ``WORD_BYTES``, whole characters only: scripts without blanks have very long words."""
    if len(word) <= WORD_BYTES:
        return word
    end = WORD_BYTES
    while word[end] & 0xC0 == 0x80:
        end -= 1
    return word[:end]


def held_out(key) -> F.Column:
    """Rows that no model may learn from: the checksum of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_share(n: int, most: int) -> float:
    return min(1.0, most / max(n, 1))


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Train on the windows of about ``per_lang`` labelled texts a language, ``SAMPLE_ROWS`` in all, chosen by a
    hash of the text.

    Equal texts count as one, so no text fills the sample.  The languages are all that occur, the most frequent
    ``MAX_LANGS`` where a column holds more different values than there are languages.
    """
    usable = df.filter(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    usable = usable.select(F.col(lang).alias("name"), F.col(text).alias("said"))
    counted = usable.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(MAX_LANGS).collect()
    if not counted:
        return train([])
    each = max(1, min(per_lang, SAMPLE_ROWS // len(counted)))
    shares = df.sparkSession.createDataFrame(
        [(r["name"], sample_share(r["n"], each)) for r in counted], "of string, share double"
    )  # at most MAX_LANGS rows
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("said")), F.lit(1_000_000)) / 1_000_000
    drawn = usable.join(F.broadcast(shares), F.col("name") == F.col("of")).filter(draw < F.col("share"))
    chosen = drawn.select("name", "said").distinct().limit(2 * each * len(counted))

    def run(batches):
        for batch in batches:
            langs, found = batch.column(0).to_pylist(), []
            for name, raw in zip(langs, text_bytes(batch.column(1))):
                found += [(w, name) for w in windows(raw or b"") if w]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.string())],
                names=["said", "lang"],
            )

    rows = chosen.mapInArrow(run, "said binary, lang string").collect()
    return train(sorted((bytes(r.said), r.lang) for r in rows))


def with_language(df: DataFrame, model: Model, text: str = "text", without: tuple[str, ...] = (), name: str = "language") -> DataFrame:
    """``df`` with a struct ``lang, score, rejected`` of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in df.schema.fields if f.name not in without]
    places, place = [df.columns.index(f.name) for f in fields], df.columns.index(text)
    kind = T.StructType(
        [T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    )

    def run(batches):
        model = shared.value
        for batch in batches:
            said = model.predict(list(text_bytes(batch.column(place))))
            langs, scores, rejected = ([s[i] for s in said] for i in range(3))
            marks = pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["lang", "score", "rejected"],
            )
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in places), marks], names=[*(f.name for f in fields), name]
            )

    return df.mapInArrow(run, with_fields(T.StructType(fields), (name, kind)))


def drop_rejected(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose language is recognised."""
    mark = free_name(df, "language")
    return with_language(df, model, text, name=mark).filter(~F.col(mark)["rejected"]).select(*df.columns)


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every row of ``documents``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    said = with_language(docs.select("doc_id", "text"), fit(docs), without=("text",))
    return said.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.rejected").alias("rejected"),
    )
