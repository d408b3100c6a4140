"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

Tokens are words; the ``WORDS`` most frequent of the whole corpus are classes of their own, all others
fall into ``TAILS`` classes by their last two bytes.  The network hides a token and predicts its class from the
``REACH`` tokens on either side: one embedding table per place, their sum through tanh, a softmax over all classes.
Inside its class every word of the corpus has its share of the class's tokens; one count of each class is left for
words that the corpus lacks, by their spelling.  The ``HELD`` most frequent words travel with the network, the
rest of the vocabulary stays in a table that is joined by word.
A document's score is the sum of the log-probabilities of all of its tokens, class times word, each given
both its sides.

Training reads every document and hides every token once: a round masks one in ``EVERY`` tokens, another
residue each round, through all residues; every partition trains a copy of the network on its own documents,
and the copies' parameters are averaged by tokens seen, in a distributed aggregation of (parameter, sum,
weight) rows.  The network has one size; the vocabulary grows with the corpus.

Texts are split into words twice: to count them, and to write each document's ids to the shared folder.
Training and scoring read those ids.

Edge cases: null, empty and word-less texts have 0 tokens, score 0 and null mean and perplexity; repeated rows
count as often as they stand; null ids are carried; an empty table trains nothing and gives no rows.  Very long
texts are scored in blocks of ``BLOCK`` tokens, their ids are four bytes a token.  Words of equal frequency are
ranked by their bytes.  Extra columns, of whatever name, are not read.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import keep, read_table, text_bytes
from caseloom.llm.registry import query
from caseloom.llm.toxicity import tokens

WORDS = 95
TAILS = 32
SIZE = WORDS + TAILS + 1
PAD = SIZE - 1
REACH = 2
DIM = 24
EVERY = 2
ROUNDS = EVERY
RATES = (0.1, 0.05)
STEP = 1024
BLOCK = 1024
# No sum of exponentials overflows or vanishes in single precision while scores are within this.
HIGHEST = 80.0
FLUSH = 250_000
HELD = 1 << 17
# Spellings of unknown words that a task remembers.
SPELLED = 100_000
# Shares from the table are multiples of this, so that their sums do not depend on the order.
GRAIN = 2.0**-20
# Symbols of a spelling: bytes of words and the start; weight of the shorter context; endings that a class may have.
SYMBOLS = 36 + 128 + 1
SHORTER = 8.0
ENDINGS = (164 * 164 + 164) / TAILS

_PLACES = [o for o in range(-REACH, REACH + 1) if o]
_SHAPES = [(len(_PLACES), SIZE, DIM), (DIM,), (DIM, SIZE), (SIZE,)]


def tail(word: bytes) -> int:
    """The class of a word that is none of its own."""
    return WORDS + zlib.crc32(word[-2:]) % TAILS


class Lexicon:
    """Log-probabilities of words inside their classes; ids of words, dense from ``SIZE`` on.

    ``counts`` are those of the words held.  Unknown words share one count of their class: last two bytes
    given the class, then byte by byte towards the start, each given the two after it, as in the distinct
    words of the corpus.  ``gathered`` has the tokens of each class under four bytes, distinct words by their last
    bytes under one or two, and triples of bytes.
    """

    def __init__(self, own: dict[bytes, int], counts: dict[bytes, int], gathered: dict[bytes, int]):
        self.ids = own | {w: SIZE + i for i, w in enumerate(counts)}
        self.base = SIZE + len(counts)
        self.classes = np.append(np.arange(SIZE), np.array([tail(w) for w in counts], np.int64))
        n, self.kinds, whole = np.array(list(counts.values()), float), np.zeros(SIZE), np.ones(SIZE)
        self.endings, self.seen = {}, [Counter() for _ in range(4)]
        triples, pairs, contexts, last = self.seen
        for key, times in gathered.items():
            if len(key) < 3:
                self.endings[key] = times
                self.kinds[tail(key)] += times
            elif len(key) > 3:
                whole[int(key)] += times
            else:
                triples[key] += times
                contexts[key[1:]] += times
                pairs[key[:2]] += times
                last[key[1:2]] += times
        self.left = -np.log(whole)
        self.inside = np.append(np.zeros(SIZE), np.log(n) + self.left[self.classes[SIZE:]])
        self.logs: dict[bytes, float] = {}

    def _log(self, key: bytes) -> float:
        """Of a byte, given the two after it."""
        triples, pairs, contexts, last = self.seen
        shorter = (pairs[key[:2]] + SHORTER / SYMBOLS) / (last[key[1:2]] + SHORTER)
        found = self.logs[key] = float(np.log((triples[key] + SHORTER * shorter) / (contexts[key[1:]] + SHORTER)))
        return found

    def spelling(self, word: bytes) -> float:
        """Of a word that the corpus lacks, given its class."""
        at, end, logs = tail(word), word[-2:], self.logs
        total = self.left[at] + np.log((self.endings.get(end, 0) + 1 / ENDINGS) / (self.kinds[at] + 1))
        line = b"\0" + word
        for i in range(len(line) - 2):
            key = line[i : i + 3]
            total += logs[key] if key in logs else self._log(key)
        return float(total)


@dataclasses.dataclass
class Network:
    words: dict[bytes, int]
    inputs: np.ndarray
    hidden: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray
    powers: list[np.ndarray] | None = None  # squared slopes so far, while training
    lexicon: Lexicon | None = None
    rest: DataFrame | None = None  # word, inside: of the words not held

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.inputs, self.hidden, self.outputs, self.bias)])

    def with_parameters(self, flat: np.ndarray) -> Network:
        parts, at = [], 0
        for shape in _SHAPES:
            n = int(np.prod(shape))
            parts.append(flat[at : at + n].reshape(shape).astype(np.float32))
            at += n
        return Network(self.words, *parts)

    def ids(self, raw: bytes | None, unknown: list[bytes] | None = None) -> np.ndarray:
        """Ids of a text's words between pads; those of their classes without a lexicon.

        Words that the lexicon does not hold have the id of their class and go into ``unknown``, if given.
        """
        known, missing = (self.lexicon.ids if self.lexicon else self.words), [] if unknown is None else unknown
        words = tokens(raw)
        out = padded(np.fromiter(map(known.get, words, itertools.repeat(-1)), np.int64, len(words)))
        for i in np.flatnonzero(out < 0).tolist():
            word = words[i - REACH]
            out[i] = tail(word)
            missing.append(word)
        return out

    def _classes(self, ids: np.ndarray) -> np.ndarray:
        return self.lexicon.classes.take(ids) if self.lexicon else ids

    def _hidden(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = self.hidden + self.inputs[0].take(self._classes(ids[at + _PLACES[0]]), axis=0)
        for table, place in zip(self.inputs[1:], _PLACES[1:]):
            total += table.take(self._classes(ids[at + place]), axis=0)
        return np.tanh(total, out=total)

    def _softmax(self, hidden: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All classes' scores raised to e, their sums, and the log-probabilities of ``classes``.

        Hidden values lie between -1 and 1, which bounds the scores; only where they could overflow, the highest is
        taken off first.
        """
        z = hidden @ self.outputs
        z += self.bias
        if (np.abs(self.outputs).sum(axis=0) + np.abs(self.bias)).max() > HIGHEST:
            z -= z.max(axis=1, keepdims=True)
        said = z[np.arange(len(z)), classes].astype(np.float64)
        np.exp(z, out=z)
        sums = z @ np.ones(SIZE, np.float32)
        return z, sums, said - np.log(sums.astype(np.float64))

    def log_probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the tokens at the places ``at``, each given its neighbours."""
        said = self._softmax(self._hidden(ids, at), self._classes(ids[at]))[2]
        return said + self.lexicon.inside.take(ids[at]) if self.lexicon else said

    def step(self, ids: np.ndarray, at: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the masked tokens at ``at``, each parameter at its own pace (Adagrad)."""
        if self.powers is None:
            self.powers = [np.zeros_like(x) for x in (self.inputs, self.hidden, self.outputs, self.bias)]
        n = len(at)
        h = self._hidden(ids, at)
        z, sums, _ = self._softmax(h, ids[at])
        z *= (1 / (sums * n))[:, None]
        z[np.arange(n), ids[at]] -= 1 / n
        back = (z @ self.outputs.T) * (1 - h * h)
        # a row of the flattened tables for each place of each token; equal rows are added up
        near = np.concatenate([ids[at + place] + k * SIZE for k, place in enumerate(_PLACES)]).astype(np.int16)
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.diff(near[order], prepend=-1))
        grown = np.zeros_like(self.inputs)
        grown.reshape(-1, DIM)[near[order][first]] = np.add.reduceat(back.take(order % n, axis=0), first, axis=0)
        slopes = (grown, back.sum(axis=0), h.T @ z, np.ones(n, np.float32) @ z)
        for value, slope, power in zip((self.inputs, self.hidden, self.outputs, self.bias), slopes, self.powers):
            power += slope * slope
            value -= rate * slope / np.sqrt(power + 1e-12)


def padded(found: np.ndarray) -> np.ndarray:
    out = np.full(len(found) + 2 * REACH, PAD, np.int64)
    out[REACH : REACH + len(found)] = found
    return out


def fresh(words: list[bytes], seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    parts = [
        rng.normal(0, 0.1, _SHAPES[0]), np.zeros(_SHAPES[1]), rng.normal(0, 0.1, _SHAPES[2]), np.zeros(_SHAPES[3]),
    ]
    return Network({w: i for i, w in enumerate(words)}, *(p.astype(np.float32) for p in parts))


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id arrays end to end, the places of their tokens, and the text each belongs to."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes - 2 * REACH)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes - 2 * REACH) - (sizes - 2 * REACH), sizes - 2 * REACH)
    return np.concatenate(texts), starts[owner] + REACH + inner, owner


def train_on(network: Network, texts, round_no: int) -> int:
    """Train in place on the masked tokens of an iterable of texts; how many there were."""
    return train_on_ids(network, map(network.ids, texts), round_no)


def train_on_ids(network: Network, texts, round_no: int) -> int:
    """As ``train_on``, for texts that are class ids between pads."""
    seen, held, held_tokens = 0, [], 0

    def learn():
        nonlocal seen
        ids, at, _ = _joined(held)
        at = at[(at * 2654435761 >> 7) % EVERY == round_no % EVERY]
        for a in range(0, len(at), STEP):
            network.step(ids, at[a : a + STEP], RATES[min(round_no, len(RATES) - 1)])
        seen += len(at)

    for found in texts:
        if len(found) > 2 * REACH:
            held.append(found)
            held_tokens += len(found)
        if held_tokens > STEP * EVERY * 4:
            learn()
            held, held_tokens = [], 0
    if held:
        learn()
    return seen


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``word, n`` of all texts; kept.  Counts leave a task before they grow large."""

    def run(batches):
        counts = Counter()
        for batch in batches:
            for raw in text_bytes(batch.column(0)):
                counts.update(tokens(raw))
                if len(counts) > FLUSH:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    def rows(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    counted = df.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return keep(counted, "lm-words")


def frequent_words(counted: DataFrame, n: int = WORDS) -> list[bytes]:
    return [bytes(r.word) for r in counted.orderBy(F.desc("n"), "word").limit(n).collect()]


def lexicon(counted: DataFrame, own: dict[bytes, int], held: int = HELD) -> tuple[Lexicon, DataFrame | None]:
    """Of all counted words, and the table of those that it does not hold."""

    def gather(batches):
        counts = Counter()
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word in own:
                    continue
                counts[b"%04d" % tail(word)] += n
                counts[word[-2:]] += 1
                line = b"\0" + word
                for i in range(len(line) - 2):
                    counts[line[i : i + 3]] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["key", "n"]
        )

    def pairs(df):
        table = df.toArrow()
        return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))

    gathered = pairs(counted.mapInArrow(gather, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n")))
    least, so_far = 1, 0
    most = F.least("n", F.lit(1_000_000))
    for n, kinds in sorted(pairs(counted.groupBy(most.alias("n")).count()).items(), reverse=True):
        so_far += kinds
        if so_far > held:
            least = n + 1
            break
    counts = pairs(counted.filter(F.col("n") >= least))
    found = Lexicon(own, {w: n for w, n in counts.items() if w not in own}, gathered)
    if least == 1:
        return found, None
    left = found.left

    def share(batches):
        for batch in batches:
            logs = np.log(batch.column(1).to_numpy().astype(float))
            logs += left[np.fromiter(map(tail, batch.column(0).to_pylist()), np.int64, len(logs))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.rint(logs / GRAIN) * GRAIN)], names=["word", "inside"])

    rest = counted.filter(F.col("n") < least)
    return found, keep(rest.mapInArrow(share, "word binary, inside double"), "lm-rest")


def vocabulary(df: DataFrame, text: str = "text", held: int = HELD) -> Network:
    """A fresh network with the lexicon of all texts."""
    counted = word_counts(df, text)
    network = fresh(frequent_words(counted))
    network.lexicon, network.rest = lexicon(counted, network.words, held)
    return network


def encode(df: DataFrame, network: Network, text: str = "text", key: str | None = None) -> DataFrame:
    """``row, key, ids, spelled, rest`` of every row of ``df``; kept.

    ``ids`` are four bytes a word.  Words that the network does not hold have the id of their class there; they stand in
    ``rest`` where a table has their shares, else ``spelled`` is the sum of their log-probabilities by spelling.
    """
    complete = network.rest is None
    shared = df.sparkSession.sparkContext.broadcast(dataclasses.replace(network, rest=None))
    name = F.lit(None).cast("long") if key is None else F.col(key)
    numbered = df.select(F.monotonically_increasing_id().alias("row"), name.alias("key"), F.col(text).alias("text"))
    schema = T.StructType(
        [*numbered.schema.fields[:2], T.StructField("ids", T.BinaryType()), T.StructField("spelled", T.DoubleType()),
         T.StructField("rest", T.ArrayType(T.BinaryType()))]
    )

    def run(batches):
        network = shared.value
        spelling = functools.lru_cache(SPELLED)(network.lexicon.spelling)
        for batch in batches:
            ids, spelled, rest = [], [], []
            for raw in text_bytes(batch.column(2)):
                unknown: list[bytes] = []
                ids.append(network.ids(raw, unknown)[REACH:-REACH].astype("<i4").tobytes())
                spelled.append(sum(map(spelling, unknown), 0.0) if complete else 0.0)
                rest.append(None if complete else unknown)
            arrays = [*batch.columns[:2], pa.array(ids, pa.binary()), pa.array(spelled), pa.array(rest, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return keep(numbered.mapInArrow(run, schema), "lm-ids")


def id_arrays(column: pa.Array):
    return (np.frombuffer(raw, "<i4") for raw in text_bytes(column))


def train(encoded: DataFrame, network: Network, rounds: int = ROUNDS) -> Network:
    """``network`` trained on all rows of ``encoded``, every token hidden once in ``EVERY`` rounds."""
    context = encoded.sparkSession.sparkContext
    classes = context.broadcast(network.lexicon.classes)
    trained = dataclasses.replace(network, lexicon=None, rest=None)
    for round_no in range(rounds):
        shared = context.broadcast(trained)

        def run(batches, shared=shared, round_no=round_no):
            own, kinds = shared.value.with_parameters(shared.value.flat().copy()), classes.value
            texts = (padded(kinds[found]) for batch in batches for found in id_arrays(batch.column(0)))
            seen = train_on_ids(own, texts, round_no)
            if seen:
                flat = own.flat().astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat * seen), pa.array(np.full(len(flat), float(seen)))],
                    names=["i", "total", "weight"],
                )

        copies = encoded.select("ids").mapInArrow(run, "i long, total double, weight double")
        mean = copies.groupBy("i").agg((F.sum("total") / F.sum("weight")).alias("value")).collect()
        if not mean:
            break
        flat = np.zeros(len(mean))
        for row in mean:
            flat[row.i] = row.value
        trained = trained.with_parameters(flat)
    return dataclasses.replace(trained, lexicon=network.lexicon, rest=network.rest)


def fit(df: DataFrame, text: str = "text", rounds: int = ROUNDS, held: int = HELD) -> Network:
    """Train on all texts of ``df``, every token hidden once in ``EVERY`` rounds."""
    network = vocabulary(df, text, held)
    return train(encode(df, network, text), network, rounds)


def score_documents(df: DataFrame, network: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: id, ``n_tokens``, ``log_likelihood``, its mean and the perplexity."""
    return score_encoded(encode(df, network, text, key), network, key)


def fit_and_score(df: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, held: int = HELD) -> DataFrame:
    """The scores of all rows of ``df`` under a network trained on them, encoded once for both."""
    network = vocabulary(df, text, held)
    encoded = encode(df, network, text, key)
    return score_encoded(encoded, train(encoded, network, rounds), key)


def score_encoded(encoded: DataFrame, network: Network, key: str) -> DataFrame:
    slim = Lexicon.__new__(Lexicon)  # classes and shares are all that ids need
    slim.classes, slim.inside = network.lexicon.classes, network.lexicon.inside
    shared = encoded.sparkSession.sparkContext.broadcast(dataclasses.replace(network, words={}, lexicon=slim, rest=None))
    schema = T.StructType(
        [*encoded.schema.fields[:2], T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType())]
    )

    def run(batches):
        network = shared.value
        for batch in batches:
            sizes, sums = np.zeros(batch.num_rows, np.int64), batch.column(3).to_numpy().copy()
            held, held_rows, held_tokens = [], [], 0

            def score():
                ids, at, owner = _joined(held)
                for a in range(0, len(at), BLOCK):
                    part = network.log_probabilities(ids, at[a : a + BLOCK])
                    np.add.at(sums, np.asarray(held_rows)[owner[a : a + BLOCK]], part)

            for i, found in enumerate(id_arrays(batch.column(2))):
                sizes[i] = len(found)
                held.append(padded(found))
                held_rows.append(i)
                held_tokens += len(found)
                if held_tokens >= 8 * BLOCK:
                    score()
                    held, held_rows, held_tokens = [], [], 0
            if held:
                score()
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes), pa.array(sums)], names=schema.fieldNames())

    scored = encoded.select("row", "key", "ids", "spelled").mapInArrow(run, schema)
    if network.rest is not None:
        scored = _with_rest(scored, encoded, network)
    mean = F.col("log_likelihood") / F.nullif(F.col("n_tokens"), F.lit(0))
    return (
        scored.select(F.col("key").alias(key), "n_tokens", "log_likelihood")
        .withColumn("mean_log_likelihood", mean)
        .withColumn("perplexity", F.exp(-F.col("mean_log_likelihood")))
    )


def _with_rest(scored: DataFrame, encoded: DataFrame, network: Network) -> DataFrame:
    """``scored`` with the shares of its words that are not held: from the table, else by their spelling."""
    shared = encoded.sparkSession.sparkContext.broadcast(network.lexicon)

    def spell(batches):
        lexicon = shared.value
        for batch in batches:
            inside = batch.column(1)
            if inside.null_count:
                words = batch.column(2).to_pylist()
                values = [
                    round(lexicon.spelling(w) / GRAIN) * GRAIN if v is None else v for v, w in zip(inside.to_pylist(), words)
                ]
                inside = pa.array(values, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), inside], names=["row", "inside"])

    words = encoded.select("row", F.explode("rest").alias("word")).join(network.rest, "word", "left")
    unknown = F.when(F.col("inside").isNull(), F.col("word"))
    shares = words.select("row", "inside", unknown.alias("word")).mapInArrow(spell, "row long, inside double")
    totals = shares.groupBy("row").agg(F.sum("inside").alias("inside"))
    total = F.col("log_likelihood") + F.coalesce("inside", F.lit(0.0))
    return scored.join(totals, "row", "left").withColumn("log_likelihood", total)


@query("op5_lm_score")
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every row of ``documents`` under a network trained on all of them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return fit_and_score(docs)
