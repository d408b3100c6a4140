"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole, so that tokens are those a model sees; the character span of
every token follows from the byte lengths of the ids.  Token spans and section spans, both in order, are
then joined as intervals (two binary searches for all tokens of a document), and a token that more than one
section, or a section and a gap, holds is given out by ``rule``:

* ``start``: to the section that holds its first character;
* ``majority``: to the one that holds most of its characters, the first of equals;
* ``split``: to each in proportion to the characters it holds.

Characters outside all sections count for the section with a null name, so the counts of a document
always add up to its tokens.  A token that is part of one character has that character's span.

Edge cases: a null or empty text has no token and no section row unless sections are given (those count
0); null or absent sections put all tokens under the null name; spans beyond the text are cut to
it, sections of no character count 0; repeated rows give repeated results; ids may be null.
Long texts are encoded whole, also where white space runs for millions of characters; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import read_table, text_bytes
from caseloom.llm.pack import END_OF_TEXT, VOCABULARY, encode, encoder
from caseloom.llm.registry import query

RULES = ("start", "majority", "split")
SECTIONS = T.ArrayType(
    T.StructType(
        [T.StructField("name", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]
    )
)


@functools.cache
def _lengths(path: str) -> np.ndarray:
    """Bytes of each id."""
    known = encoder(path)
    out = np.zeros(known.n_vocab + 1, np.int64)
    for token in known.token_byte_values():
        out[known.encode_single_token(token)] = len(token)
    out[END_OF_TEXT[1]] = len(END_OF_TEXT[0])
    return out


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last character of every token of a text."""
    ids = encode(text, path)
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stops = np.cumsum(_lengths(path)[ids])
    starts = np.append(0, stops[:-1])
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    characters = np.cumsum((raw & 0xC0) != 0x80)  # up to and with each byte
    return characters[starts] - 1, characters[stops - 1]


def attribute(
    starts: np.ndarray, stops: np.ndarray, sections: list[tuple[int, int]], rule: str
) -> tuple[np.ndarray, float]:
    """Tokens of each section (ordered, disjoint spans) and those outside of all."""
    counts, n = np.zeros(len(sections)), len(starts)
    if not n:
        return counts, 0.0
    # sections and the gaps around them as one row of neighbouring cells
    edges = np.array([x for span in sections for x in span], np.int64)
    edges = np.concatenate([[0], edges, [max(int(stops[-1]), int(edges[-1]) if len(edges) else 0)]])
    cells = np.zeros(len(edges) - 1)
    first = np.searchsorted(edges, starts, "right") - 1
    last = np.searchsorted(edges, stops, "left") - 1
    first = np.minimum(first, len(cells) - 1)
    inside = first == last
    cells += np.bincount(first[inside], minlength=len(cells))
    for a, b, i, j in zip(starts[~inside], stops[~inside], first[~inside], last[~inside]):
        if rule == "start":
            cells[i] += 1
            continue
        shares = np.minimum(edges[i + 1 : j + 2], b) - np.maximum(edges[i : j + 1], a)
        if rule == "majority":
            cells[i + int(shares.argmax())] += 1
        else:
            cells[i : j + 1] += shares / (b - a)
    return cells[1::2][: len(sections)], float(cells[0::2].sum())


def attribute_tokens(
    df: DataFrame, key: str = "doc_id", text: str = "text",
    sections: str | Callable[[str], list[dict]] = "sections",
    rule: str = "majority", vocabulary: str | None = None,
) -> DataFrame:
    """One row per section: ``key, section_no, section, start, stop, n_tokens``.

    ``sections`` is a column with an array of ``name, start, stop`` in characters, disjoint and in order, or
    a function that finds such sections in a text.  Tokens outside come last under a null name, where
    there are any.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    named = [("section_no", T.LongType()), ("section", T.StringType()), ("start", T.LongType()), ("stop", T.LongType())]
    schema = T.StructType(
        [df.schema[key], *(T.StructField(n, t) for n, t in named), T.StructField("n_tokens", T.DoubleType())]
    )

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, raw in enumerate(text_bytes(batch.column(1))):
                said = (raw or b"").decode("utf-8", "replace")
                spans = (sections(said) if callable(sections) else batch.column(2)[i].as_py()) or []
                cut, reached = [], 0
                for span in spans:
                    a = max(reached, min(span["start"] or 0, len(said)))
                    reached = max(a, min(len(said) if span["stop"] is None else span["stop"], len(said)))
                    cut.append((a, reached))
                counts, outside = attribute(*token_spans(said, path), cut, rule)
                for k, (span, (a, b), n) in enumerate(zip(spans, cut, counts.tolist())):
                    at.append(i)
                    rows.append((k, span["name"], a, b, n))
                if outside:
                    at.append(i)
                    rows.append((len(spans), None, None, None, outside))
            columns = zip(*rows) if rows else ((),) * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), k) for c, k in zip(columns, kinds))],
                names=schema.fieldNames(),
            )

    given = [] if callable(sections) else [F.col(sections).cast(SECTIONS)]
    return df.select(key, text, *given).mapInArrow(run, schema)


def line_sections(said: str) -> list[dict]:
    """Lines as sections, each with its line break: ``table`` where cells are parted by bars, ``short`` up to
    three words, else ``prose``.  The empty text has none."""
    out, at = [], 0
    for line in said.splitlines(keepends=True) if said else []:
        name = "table" if " | " in line else "short" if len(line.split(None, 3)) <= 3 else "prose"
        out.append({"name": name, "start": at, "stop": at + len(line)})
        at += len(line)
    return out


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every row of ``documents``, boundary tokens to the line with most of them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = attribute_tokens(docs, sections=line_sections)
    return counted.select("doc_id", "section_no", "section", "start", "stop", F.col("n_tokens").cast("long").alias("n_tokens"))
