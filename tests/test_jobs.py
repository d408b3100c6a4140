"""Request rules, the stream, session helpers, and every registered query against its SQL."""

import duckdb
import numpy as np
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from caseloom import session
from caseloom.operators import requests
from caseloom.streaming.triage_stream import read_stream_output, search_in, triage_stream

SF_DIR = "/root/testdata/sf0.001"
TICKET = "ticket_id long, issue string, type string, queue string, ml_priority string, query_key long"


def test_validation(spark):
    rows = [
        (1, "12345", "INCIDENT", "QQ"), (2, "1234", "INCIDENT", "QQ"), (3, "  abc", "PROBLEM", "QQ"),
        (4, "12345", "incident", "QQ"), (5, "12345", "PROBLEM", "Q"), (6, None, None, None),
    ]
    df = spark.createDataFrame(rows, "ticket_id long, issue string, type string, queue string")
    assert {r.ticket_id for r in requests.valid_tickets(df).collect()} == {1, 3}
    assert {r.ticket_id for r in requests.valid_tickets(df, trimmed=True).collect()} == {1}
    reasons = {r.ticket_id: r.reject_reason for r in requests.rejected_tickets(df).collect()}
    assert reasons[4] == "unknown type" and reasons[5] == "queue too short" and len(reasons) == 4


def test_manual_tickets_are_repeatable(spark):
    df = spark.sql("SELECT repeat('x', 60) issue_description, 'Problem' type, 'Q' queue, timestamp'2026-01-02 03:04:05' timestamp")
    one, two = requests.manual_tickets(df).first(), requests.manual_tickets(df).first()
    assert one == two and one.id.startswith("MAN-2026") and len(one.id) == 12
    assert one.title == "Problem: " + "x" * 52 + "..."


def test_stream(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    kb = spark.createDataFrame(
        [(f"d{i}", [float(i), 1.0], "abcdef"[i] * 12, "r", "INCIDENT", "QQ", "HIGH", ["t"], "x") for i in range(6)],
        "doc_id string, embedding array<double>, issue_description string, resolution string, "
        "type string, queue string, priority string, tags array<string>, retrieval_text string",
    )
    vectors = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, embedding array<double>")
    first = [(1, "first issue", "INCIDENT", "QQ", "LOW", 1), (2, "bad", "INCIDENT", "QQ", "LOW", 1)]
    second = [(3, "no vector for this", "PROBLEM", "QQ", "LOW", 5)]

    def run():
        stream = spark.readStream.schema(TICKET).parquet(source)
        triage_stream(
            stream, vectors, search_in(kb), out, state, trigger={"availableNow": True}
        ).awaitTermination()
        return {r.ticket_id: r for r in spark.read.parquet(out).collect()}

    spark.createDataFrame(first, TICKET).write.mode("append").parquet(source)
    assert set(run()) == {1}
    spark.createDataFrame(second, TICKET).write.mode("append").parquet(source)
    rows = run()
    assert set(rows) == {1, 3}
    assert rows[1].recommended_priority == "HIGH" and len(rows[1].evidence) == 3
    assert rows[3].recommended_priority == "LOW" and rows[3].evidence == []


def test_stream_goes_on_after_a_failure(spark, tmp_path):
    """A batch that fails half way is repeated by the next start; nothing is lost or there twice."""
    source, out, rejects, state = (str(tmp_path / d) for d in ("in", "out", "rejects", "state"))
    kb = spark.createDataFrame(
        [(f"d{i}", [float(i), 1.0], "abcdef"[i] * 12, "r", "INCIDENT", "QQ", "HIGH", ["t"], "x") for i in range(6)],
        "doc_id string, embedding array<double>, issue_description string, resolution string, "
        "type string, queue string, priority string, tags array<string>, retrieval_text string",
    )
    vectors = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, embedding array<double>")
    find, calls = search_in(kb), []

    def failing(asked):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return find(asked)

    for n in range(3):
        rows = [(10 * n + i, "some issue" if i else "bad", "incident ", "QQ", "LOW", 1) for i in range(3)]
        spark.createDataFrame(rows, TICKET).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(TICKET).option("maxFilesPerTrigger", 1).parquet(source)
        triage_stream(
            stream, vectors, failing, out, state, trigger={"availableNow": True}, rejects=rejects
        ).awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    assert read_stream_output(spark, out).count() == 2  # the first batch alone
    run()
    done = sorted(r.ticket_id for r in read_stream_output(spark, out).collect())
    refused = sorted(r.ticket_id for r in read_stream_output(spark, rejects).collect())
    assert done == [1, 2, 11, 12, 21, 22] and refused == [0, 10, 20]


def test_session_helpers(spark):
    assert session.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df = spark.range(20)
    assert session.broadcast_if_small(df, 5) is df
    assert session.broadcast_if_small(df, 50).count() == 20
    assert session.spread(spark.range(0, 4, 1, 2)).rdd.getNumPartitions() == 8
    many = spark.range(0, 4, 1, 16)
    assert session.spread(many) is many


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 1000 and "recommended_priority" in df.columns


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries()))
def test_registered_query(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    sql = oracle_sql().get(name)
    if sql is None:
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert {c: check.ALIKE[k] for c, k in df.dtypes} == dict(zip(want.columns, map(str, want.types)))
    assert check.normal(df.columns, rows) == check.normal(want.columns, want.fetchall())


def test_letter_encoder_is_unit_length():
    from workload.decision_queries import letter_counts

    assert np.allclose(np.linalg.norm(letter_counts(["abc", "zz top"]), axis=1), 1.0)
