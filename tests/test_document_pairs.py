"""Pairs of texts that begin alike: what is dropped from a text, the ratio, and where pairs are compared."""

import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from caseloom.functions import similarity
from caseloom.functions.text import normalize_text
from workload.text_queries import _document_pairs, is_near_duplicate

LETTERS = ("ab", "abcdé ", "eeeeeeetttttaaaooiinnsshhrrdlu   qzxjkv0123456789")


def _texts(seed):
    draw = random.Random(seed)
    for _ in range(150):
        letters = draw.choice(LETTERS)
        a = "".join(draw.choices(letters, k=draw.choice((0, 1, 30, 199, 200, 420))))
        b = "".join(draw.choices(letters, k=draw.choice((0, 1, 30, 199, 200, 420))))
        if a and draw.random() < 0.6:
            cut = draw.randrange(len(a))
            b = a[cut:] + b[:20] + a[:cut]
        yield a, b


def test_ratio_is_that_of_the_standard_library(monkeypatch):
    for most, few in ((10**6, 48), (10**6, 0), (300, 5), (50, 0)):
        monkeypatch.setattr(similarity, "MOST_MEETINGS", most)
        monkeypatch.setattr(similarity, "FEW_MEETINGS", few)
        for a, b in _texts(most + few):
            assert similarity.matching_ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)


def test_dropped_characters(spark):
    said = ["".join(map(chr, range(1, 0x250))) + "\U0001f600z￿q\U0010ffff9 é x", "a - b", "", None]
    rows = spark.createDataFrame([(t,) for t in said], "text string")
    lowered = [r[0] for r in rows.select(F.lower("text")).collect()]
    got = [r[0] for r in rows.select(normalize_text("text")).collect()]
    space = r"[\t-\r\x1c-\x20\x85\xa0  -     　]+"
    want = [re.sub("[^a-z0-9 ]", "", re.sub(space, " ", re.sub(f"^{space}|{space}$", "", t or ""))) for t in lowered]
    assert got == want


def test_pairs_of_texts_that_begin_alike_are_compared_in_many_tasks(spark, tmp_path):
    start = "all of these texts begin with the very same forty letters "
    docs = [(n, start + f"{n % 7} and then they differ a little") for n in range(200)] + [(None, start), (7, start)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    pairs = _document_pairs(spark, str(tmp_path))
    assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    found = is_near_duplicate(spark, str(tmp_path)).collect()
    assert len(found) == 200 and all(r.near_duplicate is not None for r in found)
