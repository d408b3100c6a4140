"""Chat formatting, WARC archives and the pipeline against plain Python."""

import base64
import gzip
import hashlib
import io
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseloom.llm import chat_format as chat
from caseloom.llm import warc_normalise as warc
from caseloom.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

# chat


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(2)
    bits = ["<|im_start|>", "<|im_end|>", "\n", "\\", "\\n", "<\\|", "é", "ok", "", "<|", "assistant"]
    rows = []
    for conv in (1, 2, 3, None):
        for turn in range({1: 3, 2: 120, 3: 1, None: 2}[conv]):
            role = rng.choice(["user", "assistant", "system", "we\nird", None])
            rows.append((conv, turn, role, "".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) or None))
    return rows + [(1, 0, None, None), (1, None, "user", "no turn")]


def ordered(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append({"role": role or "", "text": text or ""})
    return out


def test_round_trip(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    pieces = {}
    for r in chat.format_turns(df).collect():
        pieces.setdefault(r.conv_id, []).append(r)
    for conv, messages in ordered(turns).items():
        rows = sorted(pieces[conv], key=lambda r: r.position)
        whole = "".join(r.piece for r in rows)
        assert whole == chat.chat_template(messages)
        assert chat.read_back(whole) == [(m["role"], m["text"]) for m in messages]
        assert [chat.unescape(whole[r.text_start : r.text_stop]) for r in rows] == [m["text"] for m in messages]
        assert not any(r.rewrites for r in rows)


def test_read_back_refuses_other_texts():
    with pytest.raises(ValueError):
        chat.read_back("<|im_start|>user\nhello")


def test_rewriting_templates_are_found():
    def only_last_in_full(messages):
        return "".join(m["text"][: None if i == len(messages) - 1 else 1] + "\n" for i, m in enumerate(messages))

    renderer = chat.Renderer(only_last_in_full)
    assert [renderer.add({"role": "user", "text": t})["rewrites"] for t in ("ab", "cd", "ef")] == [False, True, True]


def test_templates_with_long_memory_keep_their_prefix():
    def counts_all(messages):
        return "".join(f"{i}:{m['text']};" for i, m in enumerate(messages))

    messages = [{"role": "user", "text": str(i * i)} for i in range(100)]
    renderer = chat.Renderer(counts_all, window=4)
    out = [renderer.add(m) for m in messages]
    assert "".join(r["piece"] for r in out) == counts_all(messages)


def test_rewriting_that_begins_late_is_found(spark):
    def last_forty(messages):
        return "".join(f"{m['text']};" for m in messages[-40:])

    def reminded(messages):
        return "".join(f"{m['text']};" + "remember;" * (i % 50 == 49) for i, m in enumerate(messages))

    messages = [{"role": "user", "text": str(i * i)} for i in range(120)]
    renderer = chat.Renderer(last_forty)
    assert [renderer.add(m)["rewrites"] for m in messages] == [False] * 40 + [True] * 80
    turns = spark.createDataFrame([(1, i, "user", m["text"]) for i, m in enumerate(messages)], "conv_id long, turn long, role string, text string")
    rows = chat.format_turns(turns, reminded).orderBy("position").collect()
    assert "".join(r.piece for r in rows) == reminded(messages)
    assert sum(r.rewrites for r in chat.format_turns(turns, last_forty).collect()) == 80
    kept = chat.Renderer(chat.chat_template, window=4, independent=True)
    assert "".join(kept.add(m)["piece"] for m in messages) == chat.chat_template(messages) and len(kept.kept) <= 9


def test_op2_sql(spark):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = connection.sql(ORACLES["op2_chat_format"])
    columns, rows = want.columns, want.fetchall()
    got = QUERIES["op2_chat_format"](spark, SF).select(*columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(rows)
    assert any(r[0] == -1 and r[1] == 2 for r in rows)


def test_no_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digests(chat.format_turns(none)).count() == 0


# archives


def expected_pages(rows):
    first, out = {}, []
    for i, _, html in rows:
        old = first.get(html or "")
        first[html or ""] = i if old is None else old if i is None else min(old, i)
    for i, _, html in rows:
        raw = (html or "").encode()
        low = first[html or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == low else "revisit", None if i == low else low))
    return sorted(out, key=repr)


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "x\r\n\r\nWARC/1.1\r\n" * 100_000
    rows = [(5, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (9, "u", big), (7, "u", big)]
    rows += [(2, "again", "<p>é</p>"), (None, "u", "<p>é</p>"), (None, "u", "alone"), (11, "u", "\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("same", F.lit(1))
    archives = warc.write_archives(pages.repartition(2), str(tmp_path), limit=1 << 20)
    got = warc.read_records(warc.normalise(archives, str(tmp_path)), str(tmp_path)).drop("url").collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected_pages(rows)


def test_a_file_becomes_one_member_per_record():
    records = [warc.page_record(i, f"http://x/{i}", bytes([i]) * (i * 50_000), None, True) for i in range(6)]
    for stored in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records[:3])) + gzip.compress(b"".join(records[3:]))):
        out = io.BytesIO()
        index = list(warc.normalise_file(io.BytesIO(stored), out))
        assert [e["id"] for e in index] == [f"<{warc.URN}{i}>" for i in range(6)]
        for entry, record in zip(index, records):
            member = out.getvalue()[entry["offset"] : entry["offset"] + entry["length"]]
            assert gzip.decompress(member) == record
        assert sum(e["length"] for e in index) == len(out.getvalue())
        assert json.dumps(index[0])
    with pytest.raises(ValueError):
        list(warc.normalise_file(io.BytesIO(gzip.compress(records[1][:-9])), io.BytesIO()))


def test_op4(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = QUERIES["op4_warc_normalise"](spark, SF).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected_pages(rows)


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    archives = warc.write_archives(none, str(tmp_path))
    assert warc.read_records(warc.normalise(archives, str(tmp_path)), str(tmp_path)).count() == 0


# pipeline


def test_pipeline_stages(spark):
    """Each stage on its own input, compared with its operator's brute-force twin where there is one."""
    from test_dedup import norm, slow_groups, slow_simhash
    from test_texts import slow_contamination

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(5000, None, "en", "s", 0), (5001, "...", "en", "s", 0), (5002, items[0][1], "en", "s", 0)], docs.schema
    )
    docs = docs.unionByName(extra).withColumn("fingerprint", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        after = {r.doc_id for r in kept.collect()}
        if name == "language_id":
            assert before.keys() - after == {5000, 5001}
        elif name == "exact_dedup":
            best = {}
            for i, t in before.items():
                best[norm(t)] = max(best.get(norm(t), i), i)
            assert after == set(best.values())
        elif name == "near_dedup":
            ids = list(before)
            lows = slow_groups(ids, [slow_simhash(before[i], 4) for i in ids], 4)
            assert after == {i for i, low in zip(ids, lows) if i == low}
        else:
            assert after == {x[0] for x in slow_contamination(before.items(), items) if not x[4]}
            assert 5002 in before and 5002 not in after
        docs = docs.join(kept.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_runs_and_takes_no_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 100
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
