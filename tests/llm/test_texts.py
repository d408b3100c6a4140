"""Packing, token counts, benchmark search, language, toxicity and LM scoring against plain Python."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseloom.llm import cutting_stock, decontaminate, language_id, lm_score, pack, token_counts, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def odd(spark, texts):
    rows = [(i, t, "en", "s", 1) for i, t in texts[:25]]
    rows += [(1000, None, None, None, None), (None, "", "en", "s", 0), (1001, "*** 12", "en", "s", 0), (1001, "*** 12", "en", "s", 0)]
    rows += [(1002, "a <|endoftext|> b", "de", "s", 0), (1003, "word " * 60_000, "en", "s", 0), (1004, "😀 naïve\n\n", None, "s", 0)]
    extra = {c: F.lit(7) for c in ("start", "length", "size", "rank", "n_words", "row", "pos", "term", "score", "language", "gone")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


# packing


def check_packed(rows, texts, tokenizer, capacity):
    want = {}
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.setdefault(i, []).append(ids)
    at = {}
    for r in rows:
        ids = [x for x in want[r.doc_id] if len(x) == r.doc_tokens]
        piece = {zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in ids}
        assert r.ids_crc32 in piece
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(x) for v in want.values() for x in v)
    fills = []
    for spans in at.values():
        reached = 0
        for offset, length in sorted(spans):
            assert offset == reached
            reached += length
        assert reached <= capacity
        fills.append(reached)
    return fills


@pytest.mark.parametrize("capacity", [64, 1024])
def test_pack_holds_every_id_once(odd, tokenizer, capacity):
    rows = pack.pack(odd, capacity=capacity).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in odd.collect()], tokenizer, capacity)


def test_op1(spark, texts, tokenizer):
    fills = check_packed(pack.op1_pack(spark, SF).collect(), texts, tokenizer, 1024)
    assert sum(1024 - f for f in fills) < 0.05 * sum(fills)


def test_pack_ids(odd):
    for r in pack.pack(odd, with_ids=True).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length


@pytest.mark.parametrize("n,low,high", [(1, 5, 6), (300, 1, 129), (5000, 1, 129), (4000, 65, 66), (900, 128, 129)])
def test_plan_holds_the_histogram(n, low, high):
    rng = np.random.default_rng(n)
    sizes, counts = np.unique(rng.integers(low, high, n), return_counts=True)
    histogram = dict(zip(sizes.tolist(), counts.tolist()))
    patterns = cutting_stock.plan(histogram, 128)
    held = {}
    for pattern, uses in patterns:
        assert sum(s * k for s, k in pattern.items()) <= 128
        for s, k in pattern.items():
            held[s] = held.get(s, 0) + k * uses
    assert held == histogram
    bound = max(sum(s * k for s, k in histogram.items()) / 128, sum(k for s, k in histogram.items() if s > 64))
    assert sum(u for _, u in patterns) <= 1.03 * bound + len(histogram) / 4 + 1


def test_knapsack_prices_the_best_pattern():
    sizes, duals = np.array([3, 5, 7]), np.array([0.2, 0.4, 0.5])
    best, last = cutting_stock.price(sizes, duals, 17)
    brute = max(0.2 * a + 0.4 * b + 0.5 * c for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 17)
    assert np.isclose(best[np.isfinite(best)].max(), brute)


# token counts


def test_offsets_equal_the_tokenizers(texts, tokenizer):
    path = public_tokenizers.path(token_counts.VOCABULARY)
    for text in [t for _, t in texts[:60]] + ["", "a😀b é ñ 漢字\n\n x", "<|endoftext|> z"]:
        a, b = token_counts.token_spans(text, path)
        assert list(zip(a.tolist(), b.tolist())) == tokenizer.encode(text, add_special_tokens=False).offsets


def slow_attribution(starts, stops, sections, rule):
    counts, outside = [0.0] * len(sections), 0.0
    cells, reached = [], 0
    for i, (a, b) in enumerate(sections):
        cells += [(None, reached, a), (i, a, b)]
        reached = b
    cells.append((None, reached, 10**9))
    for a, b in zip(starts, stops):
        held = [max(0, min(b, y) - max(a, x)) for _, x, y in cells]
        if rule == "split":
            shares = [h / (b - a) for h in held]
        else:
            best = next(k for k, h in enumerate(held) if h) if rule == "start" else held.index(max(held))
            shares = [float(k == best) for k in range(len(cells))]
        for (i, _, _), share in zip(cells, shares):
            if i is None:
                outside += share
            else:
                counts[i] += share
    return counts, outside


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_equals_brute_force(texts, rule):
    rng, path = random.Random(4), public_tokenizers.path(token_counts.VOCABULARY)
    for _, text in texts[:40]:
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), 2 * rng.randint(0, 9))))
        sections = list(zip(cuts[: len(cuts) // 2 * 2 : 2], cuts[1::2]))
        starts, stops = token_counts.token_spans(text, path)
        counts, outside = token_counts.attribute(starts, stops, sections, rule)
        want, rest = slow_attribution(starts, stops, sections, rule)
        assert np.allclose(counts, want) and abs(outside - rest) < 1e-9


def test_token_counts_add_up(odd, tokenizer):
    spans = F.array(
        F.struct(F.lit("head").alias("name"), F.lit(0).cast("long").alias("start"), F.lit(3).cast("long").alias("stop")),
        F.struct(F.lit("far").alias("name"), F.lit(10).cast("long").alias("start"), F.lit(10**9).cast("long").alias("stop")),
    )
    given = odd.withColumn("sections", F.when(F.col("doc_id") != 3, spans))
    got = {}
    for r in token_counts.attribute_tokens(given, rule="split").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    want = {}
    for r in odd.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
    assert {k: round(v, 6) for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_op10_lines(spark, texts, tokenizer):
    got = {}
    for r in token_counts.op10_token_counts(spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.section_no, r.start, r.stop, r.n_tokens))
    for i, t in texts:
        lines = t.splitlines(keepends=True)
        rows = sorted(got[i])
        assert [b - a for _, a, b, _ in rows] == [len(x) for x in lines]
        assert sum(n for *_, n in rows) == len(tokenizer.encode(t, add_special_tokens=False).ids)


# benchmark


def slow_contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: word.findall((t or "").translate(lower))
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + k]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if names := windows.get(tuple(w[s : s + k])):
                    hit.update(range(s, s + k))
                    found |= names
        out.append((doc, len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_contamination_equals_brute_force(spark, odd, texts):
    a, b = texts[3][1].split(), texts[4][1].split()
    items = [
        (1, " ".join(a[5:40])), (2, " ".join(b[:13]).upper()), (2, "two words"), (3, None), (4, "..."), (None, "naïve"),
        (10, "word " * 30), (11, " ".join(a[30:43])), (12, " ".join(a[5:17]) + " absent " + " ".join(a[18:30])),
    ]
    docs = odd.union(odd.limit(0)).unionByName(
        spark.createDataFrame([(2000, "two Words, two words; two-words", None, None, None), (2001, " ".join(a[10:25]), None, None, None)], SCHEMA),
        allowMissingColumns=True,
    )
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("x"))
    got = decontaminate.contamination(docs, table).collect()
    want = slow_contamination([(r.doc_id, r.text) for r in docs.collect()], items)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got), key=repr) == want
    assert sum(x[4] for x in want) >= 4
    kept = decontaminate.drop_contaminated(docs, table)
    assert kept.columns == docs.columns
    gone = {x[0] for x in want if x[4]}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((x[0] for x in want if x[0] not in gone), key=repr)


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    bad = "x " + " ".join(f"w{i}" for i in range(20))
    docs = [(None, bad), (None, "clean one"), (None, "clean one"), (None, None), (5, bad), (5, "clean two"), (6, "clean three")]
    kept = decontaminate.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), items)
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(repr(d) for d in docs if d[1] != bad)


def slow_near(docs, items, window=13, slop=3):
    """Items near some place of a document, but not in it, by the definition; word counts over item words in all documents."""
    said = {i: [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w] for i, t in items}
    texts = {i: [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w] for i, t in docs}
    freq = collections.Counter(w for t in texts.values() for w in t)
    out = {}
    for i, text in texts.items():
        places = collections.defaultdict(list)
        for p, w in enumerate(text):
            places[w].append(p)
        near, exact = set(), set()
        for item, words in said.items():
            k = min(len(words), window)
            for s in range(len(words) - k + 1):
                win = words[s : s + k]
                if any(text[p : p + k] == win for p in range(len(text) - k + 1)):
                    exact.add(item)
                trio = sorted((freq[w], j, w) for j, w in enumerate(win) if w in freq)[:3]
                for _, j, w in trio if k > 1 else ():
                    for d in (p - j for p in places[w]):
                        met = sum(any(abs(p - d - x) <= slop for p in places[v]) for x, v in enumerate(win))
                        if met >= k - k // window:
                            near.add(item)
        out[i] = len(near - exact)
    return out


def test_near_items_equal_brute_force(spark):
    """One word replaced, unknown, left out or put in; two replaced are too many; shared windows name all their items."""
    rng = random.Random(3)
    words = [rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randrange(6)) for _ in range(400)]
    passage = words[:13]
    items = [(i, " ".join(words[i : i + 20])) for i in range(0, 120, 12)] + [(500 + i, " ".join(passage)) for i in range(4)]
    items += [(600, "one two three"), (601, " ".join(passage[:6] + ["unheard"] + passage[7:])), (602, "solo")]
    filler = lambda n: [rng.choice(words) for _ in range(n)]
    variants = [passage, passage[:4] + ["new"] + passage[5:], passage[:4] + passage[5:], passage[:7] + ["in", "side"] + passage[7:]]
    variants += [["p"] + passage[1:3] + ["q"] + passage[4:], words[24:30] + ["z9"] + words[31:44], ["one", "x", "two", "three"], ["one", "two"], ["solo"]]
    docs = [(i, " ".join(filler(15) + v + filler(15))) for i, v in enumerate(variants)]
    docs += [(100 + i, " ".join(filler(200))) for i in range(6)] + [(200, " ".join(passage * 20)), (201, "")]
    table, wanted = (spark.createDataFrame(x, s) for x, s in ((docs, "doc_id long, text string"), (items, "item_id long, text string")))
    got = {r.doc_id: r.n_near_items for r in decontaminate.contamination(table, wanted, near=True).collect()}
    want = slow_near(docs, items)
    assert got == want and sum(v > 0 for v in want.values()) >= 4


def test_items_that_share_a_window_are_searched_once(spark):
    """Postings grow with distinct windows, not with the items that have them."""
    sentence = " ".join(f"w{i}" for i in range(13))
    items = spark.createDataFrame([(i, sentence) for i in range(60)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x{i} {sentence} y") for i in range(50)], "doc_id long, text string")
    terms = decontaminate.item_terms(items, "item_id", "text")
    index, windows = decontaminate.build_index(docs, terms), decontaminate.item_windows(terms)
    leads = windows.filter("item = lead and start = lead_start").select("item", "start")
    assert leads.count() == 1
    ranked = decontaminate.ranked_words(terms, index, leads=leads)
    assert decontaminate.rare_postings(index, decontaminate.rare_pairs(terms, index, ranked=ranked)).count() == 100
    assert {tuple(r)[2:4] for r in decontaminate.contamination(docs, items).collect()} == {(13, 60)}


def test_proximity_matches(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = [(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "alpha " + "x " * 9 + "beta gamma"), (4, "gamma")]
    terms = decontaminate.item_terms(items, "item_id", "text")
    index = decontaminate.build_index(spark.createDataFrame(docs, "doc_id long, text string"), terms)
    pairs = decontaminate.rare_pairs(terms, index)
    near = decontaminate.proximity_matches(pairs, decontaminate.rare_postings(index, pairs), slop=3)
    rows = near.join(index.filter("term = ''"), "row").select("doc_id").distinct().collect()
    assert {r.doc_id for r in rows} == {1, 2}


# language


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op6_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").collect()
    assert len(got) > 200 and np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert sum(r.rejected for r in got) <= 2
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(odd, none):
    model = language_id.train([(b"the and of with", "en"), (b"der die und nicht", "de")] * 30)
    said = {(r.doc_id, r.text): r.language for r in language_id.with_language(odd.drop("language"), model).collect()}
    assert said[(1000, None)].lang == said[(None, "")].lang == said[(1001, "*** 12")].lang == "und"
    assert said[(1001, "*** 12")].rejected and not said[(1003, "word " * 60_000)].lang == "und"
    kept = language_id.drop_rejected(odd, model)
    assert kept.columns == odd.columns and kept.filter("doc_id = 1001 or text is null").count() == 0
    assert language_id.fit(none).langs == [] and language_id.drop_rejected(none, model).count() == 0
    unlabelled = language_id.drop_rejected(odd, language_id.fit(odd.withColumn("lang", F.lit(None).cast("string"))))
    assert unlabelled.count() == odd.filter("text is not null and text not in ('', '*** 12')").count()


def test_blocks_of_a_long_text_add_up(monkeypatch):
    model = language_id.train([(b"the and of with", "en"), (b"der die und nicht", "de")] * 30)
    text = b"the and der " * 500
    whole = model.probabilities([text])
    monkeypatch.setattr(language_id, "BLOCK", 1200)
    assert np.allclose(model.probabilities([text, b""])[0], whole[0], atol=1e-3)


# toxicity


def slow_segments(scores):
    """All maximal scoring segments by their definition: recursive best segments."""
    if not scores:
        return []
    best = max(((sum(scores[a:b]), a - b, -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    left, right = slow_segments(scores[:a]), slow_segments(scores[b:])
    return left + [(a, b - 1, best[0])] + [(x + b, y + b, s) for x, y, s in right]


def test_segments_equal_their_definition():
    rng = random.Random(5)
    for _ in range(150):
        gap, n = -rng.choice([0.37, 1.13, 2.71]), rng.randint(1, 22)
        hits = [(i, rng.choice([0.71, 1.93, 3.3])) for i in range(n) if rng.random() < 0.4]
        scores = [gap] * n
        for i, s in hits:
            scores[i] = s
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(hits, gap)]
        assert sum(s for *_, s in got) >= sum(s for *_, s in slow_segments(scores)) - 1e-6
        assert max(got, key=lambda x: x[2], default=None) is None or np.isclose(
            max(s for *_, s in got), max(s for *_, s in slow_segments(scores))
        )
        assert all(x[1] < y[0] for x, y in zip(got, got[1:]))


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.op7_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    true = sum(r.predicted and labels[r.doc_id] for r in rows)
    assert true / sum(labels[r.doc_id] for r in rows) > 0.8
    assert true / sum(r.predicted for r in rows) > 0.9


def test_toxicity_edge_cases(spark, odd, none):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(25)] + [(None, 1, 1), (1000, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    empty = toxicity.fit(odd, labels.limit(0))
    assert all(r.score < toxicity.CUT and not r.passages for r in toxicity.score_toxicity(odd, empty).collect())
    assert toxicity.score_toxicity(none, model).count() == 0


# LM scoring


def test_network_slopes_are_right():
    rng = np.random.default_rng(0)
    net = lm_score.fresh([b"a", b"b"])
    ids = np.concatenate([[lm_score.PAD] * 2, rng.integers(0, 50, 30), [lm_score.PAD] * 2])
    at = np.arange(2, 32)
    before = net.log_probabilities(ids, at).mean()
    for _ in range(20):
        net.step(ids, at, 0.05)
    assert net.log_probabilities(ids, at).mean() > before + 0.5
    full = [np.exp(net.log_probabilities(np.where(np.arange(len(ids)) == 9, v, ids), np.array([9]))[0]) for v in range(lm_score.SIZE)]
    assert np.isclose(sum(full), 1, atol=1e-4)


def plain_log_probability(net, ids, i):
    """Of token ``i`` given its neighbours, one number at a time."""
    hidden = [float(b) for b in net.hidden]
    for table, place in zip(net.inputs, (-2, -1, 1, 2)):
        hidden = [h + float(x) for h, x in zip(hidden, table[ids[i + place]])]
    hidden = [math.tanh(h) for h in hidden]
    scores = [float(b) + sum(h * float(net.outputs[d][c]) for d, h in enumerate(hidden)) for c, b in enumerate(net.bias)]
    return scores[ids[i]] - math.log(sum(math.exp(x) for x in scores))


def test_network_against_plain_numbers_and_numeric_slopes():
    rng = np.random.default_rng(5)
    net = lm_score.fresh([b"a", b"b"])
    ids = np.concatenate([[lm_score.PAD] * 2, rng.integers(0, 9, 12), [lm_score.PAD] * 2])
    at = np.arange(2, 14)
    loss = lambda n: -sum(plain_log_probability(n, ids, i) for i in at) / len(at)
    assert np.isclose(-net.log_probabilities(ids, at).mean(), loss(net), atol=1e-5)
    before = net.with_parameters(net.flat().copy())
    net.step(ids, at, 1e-3)
    parts = [(b, a, p) for b, a, p in zip(*[[n.inputs, n.hidden, n.outputs, n.bias] for n in (before, net)], net.powers)]
    for old, new, power in parts:
        slopes = -np.sign(new - old) * np.sqrt(power)
        largest = np.argsort(-power.ravel())[:3]
        for place in [*largest, int(rng.integers(power.size))]:
            found, kept = [], old.flat[place]
            for shift in (1e-2, -1e-2):
                old.flat[place] = kept + shift
                found.append(loss(before))
            old.flat[place] = kept
            assert np.isclose((found[0] - found[1]) / 2e-2, slopes.flat[place], atol=2e-4)


def test_ids_are_written_once(spark):
    """Scores of texts encoded once for training and scoring are those of two separate steps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    once, twice = lm_score.fit_and_score(docs), lm_score.score_documents(docs, lm_score.fit(docs))
    a, b = ({r.doc_id: (r.n_tokens, r.log_likelihood) for r in x.collect()} for x in (once, twice))
    assert a.keys() == b.keys() and all(a[i][0] == b[i][0] and np.isclose(a[i][1], b[i][1], rtol=1e-3) for i in a)


def test_trained_scores_beat_word_frequencies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    net = lm_score.fit(docs)
    rows = lm_score.score_documents(docs, net).collect()
    ids = np.concatenate([net.ids(r.text.encode())[2:-2] for r in docs.collect()])
    share = np.bincount(ids, minlength=lm_score.SIZE) / len(ids)
    unigram = np.log(share[ids]).mean()
    assert sum(r.log_likelihood for r in rows) / sum(r.n_tokens for r in rows) > unigram + 0.1
    one = rows[0]
    text = {r.doc_id: r.text for r in docs.collect()}[one.doc_id].encode()
    alone = net.ids(text)
    slow = sum(net.log_probabilities(alone, np.array([i]))[0] for i in range(2, len(alone) - 2))
    assert np.isclose(one.log_likelihood, slow, rtol=1e-4)


def test_lm_edge_cases(odd, none):
    rows = {(r.doc_id): r for r in lm_score.score_documents(odd, lm_score.fit(odd)).collect()}
    assert rows[1000].n_tokens == 0 and rows[1000].log_likelihood == 0 and rows[1000].perplexity is None
    assert lm_score.score_documents(none, lm_score.fit(none)).count() == 0


def test_words_of_a_class_have_their_own_probability(spark):
    """Rare words that nonsense of the same class replaces cost likelihood; the words of a class make its probability."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    net = lm_score.fit(docs)
    assert net.rest is None
    for c in range(lm_score.WORDS, lm_score.WORDS + lm_score.TAILS):
        own = [net.lexicon.inside[i] for w, i in net.lexicon.ids.items() if w not in net.words and lm_score.tail(w) == c]
        assert np.isclose(np.exp(own).sum() + np.exp(net.lexicon.left[c]), 1)
    row = max(docs.collect(), key=lambda r: len(r.text))
    words = lm_score.tokens(row.text.encode())
    other = [w if w in net.words else b"zqxj9" + w[-2:] for w in words]
    assert [net.words.get(w, lm_score.tail(w)) for w in words] == [net.words.get(w, lm_score.tail(w)) for w in other]
    both = spark.createDataFrame([(1, b" ".join(words).decode()), (2, b" ".join(other).decode(errors="replace"))], "doc_id long, text string")
    plain, changed = sorted(lm_score.score_documents(both, net).collect())
    assert plain.n_tokens == changed.n_tokens and plain.log_likelihood > changed.log_likelihood + len(words)


def test_words_not_held_are_joined(spark):
    """The same scores whatever part of the vocabulary travels with the network, also for unknown words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    whole, part = lm_score.fit(docs), lm_score.fit(docs, held=300)
    assert part.rest.count() + part.lexicon.base == whole.lexicon.base and part.lexicon.base < 400 + lm_score.SIZE
    more = docs.union(spark.createDataFrame([(-1, "an unheardofword, xqzzk 9q9q9 and é"), (None, None)], docs.schema))
    a, b = ({r.doc_id: tuple(r)[1:] for r in lm_score.score_documents(more, n).collect()} for n in (whole, part))
    assert a.keys() == b.keys()
    for i in a:
        assert a[i][0] == b[i][0] and np.allclose(a[i][1], b[i][1], rtol=1e-4, atol=1e-3)


def test_spellings_of_a_class_add_up():
    """All words over two letters, up to a length at which little is left, share the count of unknown words."""
    gathered = {b"ab": 4, b"bb": 2, b"b": 1, b"\0ab": 3, b"\0bb": 2, b"aab": 1, b"\0aa": 1, b"%04d" % lm_score.tail(b"ab"): 9}
    lexicon = lm_score.Lexicon({}, {}, gathered)
    for c in {lm_score.tail(e) for e in (b"ab", b"bb", b"b")}:
        alike = [w for n in range(1, 9) for w in map(bytes, itertools.product(b"ab", repeat=n)) if lm_score.tail(w) == c]
        assert 0.1 < sum(np.exp(lexicon.spelling(w)) for w in alike) / np.exp(lexicon.left[c]) <= 1


def test_every_token_is_trained_on():
    texts = [b"one two three four five six seven " * n for n in range(1, 40)]
    net = lm_score.fresh([b"one", b"two"])
    seen = [lm_score.train_on(net, texts, n) for n in range(lm_score.ROUNDS)]
    assert min(seen) > 0 and sum(seen) == sum(len(t.split()) for t in texts)


# empty tables


def test_empty_tables(none, spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert pack.pack(none).count() == 0
    assert token_counts.attribute_tokens(none, sections=token_counts.line_sections).count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.drop_contaminated(none, items).columns == none.columns
