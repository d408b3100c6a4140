"""What is very long, very frequent or very many: blanks, ids, texts, languages."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseloom.llm import language_id, pack, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize(
    "text",
    [" " * 2_000_000, "a" + "\n" * 1_200_000 + "b", "x" + " " * 1_000_001 + "word", " \t\u00a0" * 400_000 + "!" + "\u3000" * 150_000],
)
def test_long_blanks_equal_the_tokenizers(tokenizer, text):
    path = public_tokenizers.path(pack.VOCABULARY)
    assert pack.encode(text, path) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\u00a0", "\u2028", "\x1c"])
def test_cuts_at_blanks_change_nothing(blank, monkeypatch, tokenizer):
    rng, path = random.Random(9), public_tokenizers.path(pack.VOCABULARY)
    import regex

    monkeypatch.setattr(pack, "LONG_BLANK", 3)
    monkeypatch.setattr(pack, "_LONG_BLANK", regex.compile(r"\p{White_Space}{3,}"))
    for _ in range(300):
        text = "".join(rng.choice([blank, blank, " ", "\n", "ab", "1", "!", "é", "<|endoftext|>"]) for _ in range(rng.randrange(25)))
        assert pack.encode(text, path) == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_blanks_do_not_end_a_job(spark):
    text = "one" + " " * 1_500_000 + "two"
    df = spark.createDataFrame([(1, text, None, None, None), (2, "short", None, None, None)], SCHEMA)
    tokens = {r.doc_id: r.doc_tokens for r in pack.pieces(df).collect()}
    counted = token_counts.attribute_tokens(df, sections=token_counts.line_sections).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.doc_id: r.n + 1 for r in counted} == tokens


def test_hot_ids_and_texts_fill_no_sample(spark):
    hot = spark.range(20_000).select(F.lit(0).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    same = spark.range(20_000).select((F.col("id") + 1).alias("doc_id"), F.lit("the same text").alias("text"))
    labels = spark.range(20_001).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    seen = []
    trained, toxicity.train = toxicity.train, lambda rows: seen.append(rows) or trained([])
    try:
        toxicity.fit(hot.unionByName(same), labels, rows=500)
    finally:
        toxicity.train = trained
    assert len(seen[0]) <= 500 and len({t for t, _ in seen[0]}) == len(seen[0])


def test_equal_texts_count_once_for_languages(spark, monkeypatch):
    words = {"aa": "alpha beta gamma delta", "bb": "uno dos tres cuatro"}
    rows = [(i, f"{words[n]} {n}{i}", n) for i, n in enumerate(["aa", "bb"] * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df = df.unionByName(spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("hot hot hot").alias("text"), F.lit("aa").alias("lang")))
    seen = []
    monkeypatch.setattr(language_id, "train", lambda pairs: seen.append(pairs))
    language_id.fit(df)
    assert sum(said == b"hot hot hot" for said, _ in seen[0]) <= 1 and len(seen[0]) <= 400


def test_more_than_two_hundred_languages(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{i:03}" for i in range(210)]
    words = {n: ["".join(rng.choices(letters, k=6)) for _ in range(6)] for n in names}
    rows = [(i, " ".join(rng.choices(words[n], k=12)), n) for i, n in enumerate(names * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert len(model.langs) == 210
    out = language_id.with_language(df.filter(language_id.held_out("doc_id")), model).collect()
    assert sum(r.language.lang == r.lang for r in out) / len(out) > 0.9


def test_words_are_cut_between_characters():
    word = ("x" + "é" * 300).encode()
    assert language_id.cut_word(word) == word[:239] and language_id.cut_word(word).decode()
