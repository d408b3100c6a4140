"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf, every group (a source) a tree of ``ARITY`` children a node, and the groups' roots are the
leaves of one more tree, whose root stands for the dataset.  Nodes are labelled by level and index, so a
node's label is larger than its children's.

*Forward sweep.*  Nodes are taken in label order from a priority queue of messages ``(label, child, digest)``: all
messages of the smallest label are a node's child digests; the node hashes them and sends its digest to its
parent's, always later, label.  The queue is external: its bulk are rows that Spark shuffles and sorts (and
spills) by tree, segment and position; a task only holds the messages of the segment it is in, ``ARITY ** LEVELS``
neighbouring nodes of a tree.  Digests that leave a segment are written to the shared folder as the messages of
the next round, which has ``ARITY ** LEVELS`` times fewer nodes.

*Reversed sweep.*  The rounds are gone through backwards.  A node's message is its proof suffix, the siblings
above it as text to the left and right of its own digest; it puts each child's siblings before that and sends it
on, so that a leaf receives its whole proof.  A segment's message is sorted before the segment's nodes.

No tree is ever whole in a task, however many rows a source has; a round's rows are evenly spread segments.
A lost executor costs the reading of a segment.

Defined cases: rows of a group are ordered by key, null keys first, then by leaf digest, so ties have one order, and
wholly equal rows are interchangeable leaves of their own.  A null field is ``-``, an empty text ``0:``.
A null group is a group, before all others.  Texts are hashed whole, however long.  An empty table gives an empty
table.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import keep, read_table
from caseloom.llm.registry import query
from caseloom.session import broadcast_if_small

ARITY = 16
LEVELS = 2  # of a segment, that is of one round
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = T.ArrayType(
    T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])
)
ARROW_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PART, _SEQ = "part_", "seq_"


def leaf_digest(fields: Iterable[Column]) -> Column:
    """Hex SHA-256 of the fields, each ``-`` if null, else its bytes counted and told."""
    told = []
    for field in fields:
        text = field.cast("string")
        counted = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        told.append(F.when(field.isNull(), F.lit("-")).otherwise(counted))
    return F.sha2(F.concat(*told), 256)


def _levels(size: int, most: int) -> int:
    """Levels of a segment's part of a tree with ``size`` nodes: ``most``, or up to its root."""
    levels = 0
    while size > 1 and levels < most:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def sweep_up(digests: Sequence[str], levels: int) -> list[tuple[tuple[int, int], str, str]]:
    """Inner nodes above ``digests`` in label order: (label, the children's digests as one text, digest)."""
    if not levels:
        return []
    queue = [((1, i // ARITY), i, d) for i, d in enumerate(digests)]  # sorted, thus a heap
    nodes = []
    while queue:
        label, told = queue[0][0], []
        while queue and queue[0][0] == label:
            told.append(heapq.heappop(queue)[2])
        children = "".join(told)
        digest = hashlib.sha256(children.encode()).hexdigest()
        nodes.append((label, children, digest))
        level, index = label
        if level < levels:
            heapq.heappush(queue, ((level + 1, index // ARITY), index, digest))
    return nodes


def sweep_down(nodes: list[tuple[tuple[int, int], str, str]], n: int, suffix: list) -> list[list]:
    """The proof of each of the ``n`` lowest digests, from the nodes of ``sweep_up`` and the segment's suffix."""
    if not nodes:
        return [suffix] * n
    proofs: list[list] = [suffix] * n
    top, index = nodes[-1][0]
    queue = [((-top, -index), suffix)]
    for label, children, _ in reversed(nodes):
        level, index = label
        _, above = heapq.heappop(queue)
        for j in range(len(children) // 64):
            proof = [(children[: 64 * j], children[64 * (j + 1) :]), *above]
            child = index * ARITY + j
            if level == 1:
                proofs[child] = proof
            else:
                heapq.heappush(queue, ((1 - level, -child), proof))
    return proofs


def _placed(df: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` sorted and numbered, and the runs of a group's rows in each of its sorted parts.

    Runs: ``group, part_, first_, before_, size_``: the number of a run's first row, the group's rows in earlier
    runs and in all.  As many rows as sorted parts and groups.
    """
    ordered = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = keep(ordered.withColumn(_SEQ, F.monotonically_increasing_id()), "merkle-sorted")
    rows = rows.withColumn(_PART, F.shiftright(_SEQ, 33))
    runs = rows.groupBy(group, _PART).agg(F.min(_SEQ).alias("first_"), F.count(F.lit(1)).alias("n_"))
    whole = Window.partitionBy(group)
    so_far = whole.orderBy(_PART).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.select(
        group, _PART, "first_", (F.sum("n_").over(so_far) - F.col("n_")).alias("before_"), F.sum("n_").over(whole).alias("size_")
    )
    return rows, keep(runs, "merkle-runs")


def _positions(rows: DataFrame, runs: DataFrame, group: str) -> DataFrame:
    """``rows`` with ``position`` in their group, its ``size`` and what else ``runs`` says."""
    there = broadcast_if_small(runs.withColumnRenamed(group, "group_").withColumnRenamed(_PART, "run_"))
    same = rows[group].eqNullSafe(there["group_"]) & (rows[_PART] == there["run_"])
    place = F.col("before_") + F.col(_SEQ) - F.col("first_")
    return (
        rows.join(there, same)
        .withColumn("position", place)
        .withColumnRenamed("size_", "size")
        .drop("group_", "run_", "before_", "first_", _SEQ, _PART)
    )


def _segments(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[tuple[int, int], list[tuple]]]:
    """Rows of sorted batches by ``(tree, segment)``, the first two of ``names``."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            if row[:2] != at:
                if held:
                    yield at, held
                at, held = row[:2], []
            held.append(row[2:])
    if held:
        yield at, held


def ascend(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Rounds of a forest from its leaves (``tree, position, size, digest``): the last has one node a tree."""
    span, rounds = ARITY**levels, [nodes]
    schema = "tree long, position long, size long, digest string"
    names = ["tree", "segment", "size", "digest"]

    def run(batches):
        out = []
        for (tree, segment), rows in _segments(batches, names):
            size, digests = rows[0][0], [r[1] for r in rows]
            above = sweep_up(digests, _levels(size, levels))
            out.append((tree, segment, max(1, -(-size // span)), above[-1][2] if above else digests[0]))
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out))), names=schema_names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out))), names=schema_names)

    schema_names = ["tree", "position", "size", "digest"]
    while True:
        cut = rounds[-1].select("tree", F.floor(F.col("position") / span).alias("segment"), "position", "size", "digest")
        sorted_ = cut.repartition("tree", "segment").sortWithinPartitions("tree", "segment", "position")
        rounds.append(keep(sorted_.select(*names).mapInArrow(run, schema), "merkle-round"))
        if rounds[-1].filter("size > 1").isEmpty():
            return rounds


def descend(rounds: list[DataFrame], tops: DataFrame, carry: Sequence[str] = (), levels: int = LEVELS) -> DataFrame:
    """Proofs of the leaves: ``tree, position, digest, subroot, proof`` and the leaves' columns ``carry``.

    ``tops`` has each tree's message, ``tree, subroot, proof``.
    """
    messages = tops.withColumn("position", F.lit(0).cast("long"))
    for low in range(len(rounds) - 2, -1, -1):
        more = list(carry) if low == 0 else []
        messages = _delivered(rounds[low], messages, more, levels)
        if low:
            messages = keep(messages, "merkle-proofs")
    return messages


def _delivered(nodes: DataFrame, messages: DataFrame, more: list[str], levels: int) -> DataFrame:
    span, kinds = ARITY**levels, {f.name: f.dataType for f in nodes.schema.fields}
    sent = messages.select(
        "tree", F.col("position").alias("segment"), F.lit(-1).cast("long").alias("position"),
        F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("digest"), "subroot", "proof",
        *(F.lit(None).cast(kinds[c]).alias(c) for c in more),
    )
    own = nodes.select(
        "tree", F.floor(F.col("position") / span).alias("segment"), "position", "size", "digest",
        F.lit(None).cast("string").alias("subroot"), F.lit(None).cast(STEPS).alias("proof"), *more,
    )
    both = sent.unionByName(own).repartition("tree", "segment").sortWithinPartitions("tree", "segment", "position")
    schema = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("tree", "position")]
        + [T.StructField(n, T.StringType()) for n in ("digest", "subroot")]
        + [T.StructField("proof", STEPS), *(T.StructField(c, kinds[c]) for c in more)]
    )

    def run(batches):
        kinds = None

        def typed():
            nonlocal kinds
            for batch in batches:
                kinds = kinds or {f.name: f.type for f in batch.schema}
                yield batch

        def flushed():
            columns = [list(c) for c in zip(*out)]
            lists = columns[4]
            offsets, left, right = [0], [], []
            for steps in lists:
                left += [s[0] for s in steps]
                right += [s[1] for s in steps]
                offsets.append(len(left))
            flat = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
            columns[4] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat).cast(ARROW_STEPS)
            plain = [pa.int64(), pa.int64(), pa.string(), pa.string(), None, *(kinds[c] for c in more)]
            arrays = [c if k is None else pa.array(c, k) for c, k in zip(columns, plain)]
            return pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

        names, out = ["tree", "segment", "position", "size", "digest", "subroot", "proof", *more], []
        for (tree, _), rows in _segments(typed(), names):
            _, _, _, subroot, suffix, *_ = rows[0]
            suffix = [(s["left"], s["right"]) for s in suffix]
            leaves = rows[1:]
            above = sweep_up([r[2] for r in leaves], _levels(leaves[0][1], levels))
            for row, proof in zip(leaves, sweep_down(above, len(leaves), suffix)):
                out.append((tree, row[0], row[2], subroot, proof, *row[5:]))
            if len(out) >= 1024:
                yield flushed()
                out = []
        if out:
            yield flushed()

    return both.select("tree", "segment", "position", "size", "digest", "subroot", "proof", *more).mapInArrow(run, schema)


def manifest(
    df: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS,
    carry: dict[str, Column] | None = None, levels: int = LEVELS,
) -> DataFrame:
    """``key, leaf, subroot, root, proof`` of every row, and the expressions ``carry`` over its columns.

    ``proof`` is an array of steps from the leaf up to the dataset's root: the digests to the ``left`` and
    ``right`` of one's own, as text.  ``fold`` turns a leaf and its proof into a root.
    """
    carry = carry or {}
    leaves = df.select(
        F.col(key).alias("key_"), F.col(group).alias("source_"), leaf_digest([F.col(c) for c in fields]).alias("digest"),
        *(c.alias(f"carried_{n}") for n, c in carry.items()),
    ).withColumn("row_", F.monotonically_increasing_id())
    rows, runs = _placed(keep(leaves, "merkle-leaves"), "source_", ["key_", "digest", "row_"])
    sources = runs.groupBy("source_").agg(F.max("size_").alias("n_")).withColumn("all_", F.lit(0).cast("long"))
    named = _positions(*_placed(sources, "all_", ["source_"]), "all_").select(
        F.col("source_").alias("named_"), F.col("position").alias("tree"), F.col("size").alias("sources_")
    )
    named = keep(named, "merkle-sources")
    small = broadcast_if_small(named)
    runs = runs.join(small, runs.source_.eqNullSafe(small.named_)).drop("named_", "sources_")
    nodes = _positions(rows, runs, "source_")
    rounds = ascend(nodes, levels)
    subroots = rounds[-1].select(F.col("tree").alias("position"), "digest")
    trees = subroots.join(broadcast_if_small(named.select("tree", "sources_")), F.col("position") == F.col("tree"))
    top = trees.select(F.lit(0).cast("long").alias("tree"), "position", F.col("sources_").alias("size"), "digest")
    top_rounds = ascend(top, levels)
    peak = top_rounds[-1].first()  # the one node that is left
    nothing = F.array().cast(STEPS)
    tops = top_rounds[-1].select("tree", F.lit(None).cast("string").alias("subroot"), nothing.alias("proof"))
    sent = descend(top_rounds, tops, levels=levels).select(F.col("position").alias("tree"), F.col("digest").alias("subroot"), "proof")
    carried = [f"carried_{n}" for n in carry]
    proved = descend(rounds, keep(sent, "merkle-proofs"), ["key_", *carried], levels)
    root = F.lit(peak["digest"] if peak else None).cast("string")
    return proved.select(
        F.col("key_").alias(key), F.col("digest").alias("leaf"), "subroot", root.alias("root"), "proof",
        *(F.col(f"carried_{n}").alias(n) for n in carry),
    )


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof as one text, from the leaf up, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


SQL_LEVELS = 8  # more than 4 * 10**9 leaves or sources


def _tree_sql(name: str, leaves: str) -> str:
    """Levels of a forest ``leaves(tree, pos, d)``: ``{name}0, ...``, with siblings, up to ``SQL_LEVELS``."""
    out = []
    for level in range(SQL_LEVELS + 1):
        before = (
            f"SELECT tree, pos, d, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}"
            if level == 0
            else f"""SELECT tree, pos // {ARITY} AS pos,
                CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d,
                (any_value(n) + {ARITY - 1}) // {ARITY} AS n
                FROM {name}{level - 1} GROUP BY tree, pos // {ARITY}"""
        )
        run = f"(PARTITION BY tree, pos // {ARITY} ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}{level} AS (
            SELECT *, coalesce(string_agg(d, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(d, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM ({before}))""")
    return ",\n".join(out)


def _climb_sql(name: str, start: str, tree: str, position: str, begin: str) -> str:
    """Rows of ``start`` folded up a tree: ``proof`` grows and ``folded`` rises, level by level."""
    out, last = [], start
    for level in range(SQL_LEVELS):
        cell = f"{name}{level}"
        out.append(f"""{start}_{name}{level} AS (
            SELECT s.* REPLACE (s.proof || t.l || t.r AS proof,
                     CASE WHEN t.n = 1 THEN s.folded ELSE sha256(t.l || s.folded || t.r) END AS folded)
            FROM {last} s JOIN {cell} t ON t.tree = s.{tree} AND t.pos = s.{position} // {ARITY**level})""")
        last = f"{start}_{name}{level}"
    return ",\n".join(out)


_TOLD = "\n || ".join(
    f"CASE WHEN {{{c}}} IS NULL THEN '-' ELSE strlen({{{c}}}::VARCHAR) || ':' || {{{c}}}::VARCHAR END" for c in FIELDS
)
_CRC32 = """xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(doc_id::VARCHAR)),
    lambda i: ascii(substr(doc_id::VARCHAR, (i + 1)::INT, 1)))), lambda c, b: xor(c >> 8,
    list_reduce(list_concat([xor(c, b) & 255], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
    )), 4294967295)"""
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH digests AS (
  SELECT doc_id, source, sha256({_TOLD.format(**dict(zip(FIELDS, FIELDS)))}) AS leaf,
         CASE WHEN {_CRC32} % 5 = 0 THEN sha256({_TOLD.format(**dict(zip(FIELDS, FIELDS)) | dict(text=_LOWERED))}) END AS tampered
  FROM documents
),
leaves AS (
  SELECT doc_id, leaf, leaf AS d, coalesce(tampered, leaf) AS folded, '' AS proof,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM digests
),
{_tree_sql("low", "leaves")},
subroots AS (SELECT 0 AS tree, tree AS pos, d FROM low{SQL_LEVELS}),
{_tree_sql("high", "subroots")},
{_climb_sql("low", "leaves", "tree", "pos", "leaf")},
sprouts AS (SELECT s.*, r.d AS subroot, 0 AS zero FROM leaves_low{SQL_LEVELS - 1} s JOIN subroots r ON r.pos = s.tree),
{_climb_sql("high", "sprouts", "zero", "tree", "folded")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM sprouts_high{SQL_LEVELS - 1}, (SELECT d AS root FROM high{SQL_LEVELS})
"""


@query("op11_merkle_manifest", SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of ``documents``; a fifth of the texts is altered before verification."""
    docs = read_table(spark, sf_dir, "documents")
    lowered = F.translate("text", _UPPER, _UPPER.lower())
    altered = leaf_digest([lowered if c == "text" else F.col(c) for c in FIELDS])
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    proved = manifest(docs, carry={"tampered": F.when(hit, altered)})
    folded = proved.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
