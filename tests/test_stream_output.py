"""What a stream leaves on disk: tickets that found the same incidents stand together, in a codec that sees it."""

import random

import pyarrow.parquet as pq

from caseloom.plans import triage as T
from caseloom.streaming.triage_stream import CODEC, search_in, triage_stream

TICKET = "ticket_id long, issue string, type string, queue string, ml_priority string, query_key long"


def test_repeated_evidence_takes_little_room(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(120)]
    kb = spark.createDataFrame(
        [(f"d{i}", [float(i), 1.0 + i * i], t, "r", "INCIDENT", "QQ", "HIGH", ["t"], t) for i, t in enumerate(texts)],
        "doc_id string, embedding array<double>, issue_description string, resolution string, "
        "type string, queue string, priority string, tags array<string>, retrieval_text string",
    )
    vectors = spark.createDataFrame([(i, [float(3 * i), 1.0 + 9 * i * i]) for i in range(40)], "query_id long, embedding array<double>")
    rows = [(i, f"issue number {i}", "INCIDENT", "QQ", "LOW", i % 40) for i in range(2000)]
    spark.createDataFrame(rows, TICKET).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(TICKET).parquet(source)
    triage_stream(stream, vectors, search_in(kb), out, state, trigger={"availableNow": True}).awaitTermination()
    found = spark.read.parquet(out)
    assert found.count() == 2000 and found.select("ticket_id").distinct().count() == 2000
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in found.inputFiles()]
    used = {f.metadata.row_group(g).column(c).compression for f in files for g in range(f.metadata.num_row_groups) for c in range(f.metadata.num_columns)}
    assert used == {CODEC.upper()}
    seen = [tuple(e["doc_id"] for e in evidence) for f in files for evidence in f.read(["evidence"])["evidence"].to_pylist()]
    changes = sum(a != b for a, b in zip(seen, seen[1:]))
    assert changes < 40 * len(files)  # not a change at almost every row


def test_equal_texts_repeat_each_other_by_digest(spark):
    kb = spark.createDataFrame(
        [(d, t, "r", "INCIDENT", "QQ", "HIGH", ["t"], t) for d, t in [("a", "Same text!"), ("b", "same  text"), ("c", "other"), ("d", "?"), ("e", "!")]],
        "doc_id string, issue_description string, resolution string, type string, queue string, priority string, "
        "tags array<string>, retrieval_text string",
    )
    hits = spark.createDataFrame([(1, d, 0.1 * i, i + 1) for i, d in enumerate("abcde")], "query_id long, doc_id string, distance double, rank int")
    row = T.retrieve_candidates(hits.select("query_id"), kb, threshold=1.0, hits=hits).first()
    assert [c.doc_id for c in row.candidates] == list("abcde") and "normalized" not in row.candidates[0]
    assert row.repeats == [[2], [1], [], [], []]
