"""Splits, text features and weights for training, as DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.functions.text import col_of, strip
from caseloom.session import broadcast_if_small

MAX_BROADCAST_TERMS = 200_000
# Counted terms of a document take up to fifty times the bytes of its text, in two tables at once.
TEXT_BYTES_PER_TASK = 8_000_000

# Our own keyword lists behind the engineered flags.
KEYWORDS = {
    "has_error_keyword": ("error", "exception", "bug"),
    "has_failure_keyword": ("fail", "crash", "broken", "not working"),
    "has_urgent_keyword": ("urgent", "critical", "immediate", "emergency", "asap"),
    "has_access_keyword": ("login", "access", "password", "account"),
    "has_payment_keyword": ("payment", "billing", "invoice", "refund"),
}


def _split_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")).cast("binary"))


def _test_quotas(per_label: DataFrame, label: str, fraction: float) -> DataFrame:
    """Test rows per label: proportional floors, the rest to the largest remainders."""
    everything = Window.partitionBy()
    sized = per_label.withColumn("n_test", F.ceil(F.sum("n").over(everything) * F.lit(fraction)))
    share = F.col("n") * F.col("n_test") / F.sum("n").over(everything)
    floored = sized.withColumn("share", share).withColumn("quota", F.floor("share"))
    by_remainder = Window.partitionBy().orderBy((F.col("share") - F.col("quota")).desc(), label)
    missing = F.col("n_test") - F.sum("quota").over(everything)
    extra = (F.row_number().over(by_remainder) <= missing).cast("bigint")
    return floored.withColumn("quota", F.col("quota") + extra).select(label, "quota")


def stratified_split(
    df: DataFrame,
    key: str,
    label: str = fixed.LABEL_COLUMN,
    test_fraction: float = 0.2,
    seed: int = 42,
    hash_digits: int = 4,
) -> DataFrame:
    """Add ``is_test``: exactly proportional per label and the same on every run.

    Within a label the test rows are the first ones by a keyed hash.  The cut is found on a
    histogram of hash prefixes, so no label is ever sorted as a whole: rows away from the cut are
    decided where they are, and only the one prefix bucket holding the cut is ranked.  With four
    hexadecimal digits that is one row in 65,536.
    """
    prefix = F.substring(_split_order(key, seed), 1, hash_digits)
    histogram = df.groupBy(label, prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    quotas = _test_quotas(histogram.groupBy(label).agg(F.sum("n").alias("n")), label, test_fraction)
    running = Window.partitionBy(label).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        histogram.withColumn("upto", F.sum("n").over(running))
        .join(quotas, label)
        .filter((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
        .select(
            label,
            F.col("prefix").alias("_cut"),
            (F.col("quota") - (F.col("upto") - F.col("n"))).alias("_wanted"),
        )
    )
    placed = df.join(broadcast_if_small(cuts), label, "left")
    at_cut = F.coalesce(prefix == F.col("_cut"), F.lit(False))
    away = placed.filter(~at_cut).withColumn(
        "is_test", F.coalesce(prefix < F.col("_cut"), F.lit(False))
    )
    in_bucket = Window.partitionBy(label).orderBy(_split_order(key, seed), key)
    near = placed.filter(at_cut).withColumn(
        "is_test", F.row_number().over(in_bucket) <= F.col("_wanted")
    )
    return away.unionByName(near).drop("_cut", "_wanted")


def tokenize(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col_of(text)), F.lit(f"({fixed.WORD_PATTERN})"), F.lit(1))


def remove_stopwords(tokens: Column | str, stop_words: Sequence[str]) -> Column:
    """Tokens that are no stop words; the list is a literal set, looked up in the JVM."""
    words = sorted(set(stop_words))
    return F.filter(col_of(tokens), lambda t: ~t.isin(*words)) if words else col_of(tokens)


def ngrams_1_2(tokens: Column | str) -> Column:
    """Tokens followed by the pairs of neighbouring tokens."""
    tokens = col_of(tokens)
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    bigrams = F.zip_with(
        F.slice(tokens, F.lit(1), pairs),
        F.slice(tokens, F.lit(2), pairs),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(tokens, bigrams)


def tasks_for_text(n_bytes: int | None) -> int:
    """How many tasks count the terms of so much text without spilling them."""
    return max(1, -(-(n_bytes or 0) // TEXT_BYTES_PER_TASK))


def document_terms(
    documents: DataFrame,
    key: str,
    text: str,
    stop_words: Sequence[str],
    bigrams: bool = True,
    tasks: int | None = None,
) -> DataFrame:
    """(key, terms) per document, placed by key.

    The raw text is what gets shuffled; it is smaller than its terms.  Whatever counts terms per
    document afterwards finds the rows in place.  With ``tasks`` rows are placed in so many partitions,
    which adaptive execution then leaves alone; see ``tasks_for_text``.
    """
    kept = remove_stopwords(tokenize(text), stop_words)
    placed = documents.select(key, text)
    placed = placed.repartition(tasks, key) if tasks else placed.repartition(key)
    if not bigrams:
        return placed.select(key, kept.alias("terms"))
    return placed.select(key, kept.alias("kept")).select(key, ngrams_1_2("kept").alias("terms"))


def vocabulary(
    documents: DataFrame, terms: str = "terms", min_df: int = 1, max_features: int | None = None
) -> DataFrame:
    """Terms in at least ``min_df`` documents, the most frequent first: (term, tf, df).

    Corpus and document counts come from one pass and one shuffle by term; equal counts go by term.
    """

    def counted(values: Column, tf: int, df: int) -> Column:
        return F.transform(
            values, lambda t: F.struct(t.alias("term"), F.lit(tf).alias("tf"), F.lit(df).alias("df"))
        )

    both = F.concat(counted(F.col(terms), 1, 0), counted(F.array_distinct(terms), 0, 1))
    counts = (
        documents.select(F.inline_outer(both))
        .filter(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    )
    return _most_frequent(counts, min_df, max_features)


def term_counts(documents: DataFrame, key: str = "doc_id", terms: str = "terms") -> DataFrame:
    """(key, term, n) of ``document_terms``.

    The outer form of explode keeps Spark from adding a filter on the size of the array, for which
    it would build all terms a second time, ahead of the shuffle.
    """
    return (
        documents.select(key, F.explode_outer(terms).alias("term"))
        .filter(F.col("term").isNotNull())
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def vocabulary_of_counts(
    counts: DataFrame, min_df: int = 1, max_features: int | None = None
) -> DataFrame:
    """``vocabulary`` from ``term_counts``."""
    totals = counts.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))
    return _most_frequent(totals, min_df, max_features)


def _most_frequent(counts: DataFrame, min_df: int, max_features: int | None) -> DataFrame:
    counts = counts.filter(F.col("df") >= min_df)
    if max_features is None:
        return counts
    return counts.orderBy(F.col("tf").desc(), "term").limit(max_features)


def tfidf(
    counts: DataFrame,
    vocab: DataFrame,
    n_documents: int,
    key: str = "doc_id",
    max_features: int | None = None,
) -> DataFrame:
    """Weights of vocabulary terms per document, each document at length one: (key, term, weight).

    ``counts`` are ``term_counts``.  A vocabulary limited to ``max_features`` terms is broadcast,
    and document lengths need no further shuffle; one without a limit is joined by shuffling.
    """
    limited = max_features is not None and max_features <= MAX_BROADCAST_TERMS
    idf = F.log((F.lit(1.0) + n_documents) / (F.lit(1.0) + F.col("df"))) + 1
    weighted = vocab.select("term", idf.alias("idf"))
    weights = counts.join(F.broadcast(weighted) if limited else weighted, "term").select(
        key, "term", (F.col("n") * F.col("idf")).alias("weight")
    )
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return weights.withColumn("weight", F.col("weight") / length)


def scale_parameters(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column divides by one."""
    row = df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
    ).first()
    return {c: (row[f"{c}_mean"] or 0.0, row[f"{c}_std"] or 1.0) for c in columns}


def standard_scale(df: DataFrame, columns: Sequence[str] = fixed.NUMERIC_COLUMNS) -> DataFrame:
    parameters = scale_parameters(df, columns)
    return df.withColumns(
        {c: (F.col(c) - F.lit(mean)) / F.lit(std) for c, (mean, std) in parameters.items()}
    )


def class_weights(df: DataFrame, label: str = fixed.LABEL_COLUMN) -> DataFrame:
    """Add ``class_weight`` = rows / (labels * rows of the label)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every_label = Window.partitionBy()
    weight = F.sum("n").over(every_label) / (F.count(F.lit(1)).over(every_label) * F.col("n"))
    return df.join(
        broadcast_if_small(counts.select(label, weight.alias("class_weight"))), label, "left"
    )


def engineered_features(df: DataFrame, text: str = fixed.TEXT_COLUMN) -> DataFrame:
    """The seven numeric feature columns of a ticket text.

    Only their names are given; what counts as a keyword is our own choice (``KEYWORDS``).
    """
    lower = F.lower(F.col(text))
    words = F.split(strip(F.col(text)), fixed.WHITESPACE_RUN)
    flags = {}
    for name, terms in KEYWORDS.items():
        hit = F.lit(False)
        for term in terms:
            hit = hit | F.contains(lower, F.lit(term))
        flags[name] = hit.cast("double")
    return df.withColumns(
        {
            "text_length": F.length(text).cast("double"),
            "word_count": F.when(strip(F.col(text)) == "", F.lit(0)).otherwise(F.size(words)).cast("double"),
            **flags,
        }
    )
