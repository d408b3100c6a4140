"""Scalar functions over texts and results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.functions import display, render, sections, similarity, text
from caseloom.operators import similarity_join
from caseloom.operators.retrieval import retrieved_incidents
from workload import sql as S
from workload import views as V
from workload.registry import query
from workload.source_queries import query_text_sql


@query(
    "c1_normalize_issue_text",
    f"SELECT doc_id, {S.norm_issue('text')} AS normalized FROM documents",
)
def normalize_issue_text(spark, sf_dir):
    return V.documents(spark, sf_dir).select(
        "doc_id", text.normalize_issue_text("text").alias("normalized")
    )


@query("c2_normalize_text", f"SELECT doc_id, {S.norm('text')} AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return V.documents(spark, sf_dir).select(
        "doc_id", text.normalize_text("text").alias("normalized")
    )


@query(
    "c3_extract_issue_signals",
    f"SELECT ticket_id, {S.signals('issue')} AS signals FROM tickets",
    ("tickets",),
)
def extract_issue_signals(spark, sf_dir):
    signals = F.array_join(text.extract_issue_signals("issue"), ", ")
    return V.tickets(spark, sf_dir).select("ticket_id", signals.alias("signals"))


@query(
    "c3_extract_document_signals",
    f"SELECT doc_id, {S.signals('text')} AS signals FROM documents",
)
def extract_document_signals(spark, sf_dir):
    signals = F.array_join(text.extract_issue_signals("text"), ", ")
    return V.documents(spark, sf_dir).select("doc_id", signals.alias("signals"))


@query(
    "c4_distinct_in_order",
    """SELECT conv_id, turn, string_agg(w, ' ' ORDER BY first_at) AS words FROM (
  SELECT conv_id, turn, w, min(place) AS first_at FROM (
    SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w,
      generate_subscripts(string_split(text, ' '), 1) AS place FROM conversations)
  GROUP BY conv_id, turn, w) GROUP BY conv_id, turn""",
)
def distinct_in_order(spark, sf_dir):
    words = text.distinct_in_order(F.split("text", " "))
    return V.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(words, " ").alias("words")
    )


@query(
    "c5_build_query",
    f"SELECT ticket_id, {query_text_sql()} AS retrieval_query FROM tickets",
    ("tickets",),
)
def build_query(spark, sf_dir):
    return V.tickets(spark, sf_dir).select(
        "ticket_id", text.build_query("issue", "type", "queue").alias("retrieval_query")
    )


@query(
    "c6_normalize_tags",
    f"""SELECT ticket_id, array_to_string(list_filter(list_transform(
    string_split(replace(issue, ' ', ' , '), ','), lambda t: {S.strip('t')}), lambda t: t <> ''), '|') AS tags
FROM tickets""",
    ("tickets",),
)
def normalize_tags(spark, sf_dir):
    raw = F.replace("issue", F.lit(" "), F.lit(" , "))
    return V.tickets(spark, sf_dir).select(
        "ticket_id", F.array_join(text.normalize_tags(raw), "|").alias("tags")
    )


def _text_pairs(spark, sf_dir):
    """Each turn of a conversation with the turn before it; a long conversation is no one group."""
    turns = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return turns.join(before, ["conv_id", "turn"])


@query("c7_text_similarity_ratio")
def text_similarity_ratio(spark, sf_dir):
    ratio = similarity.text_similarity_ratio("text", "before")
    return _text_pairs(spark, sf_dir).select("conv_id", "turn", F.round(ratio, 6).alias("ratio"))


PAIR_CHARS = 40


def _document_pairs(spark, sf_dir):
    """Each document with the one before it, by id, among those that begin alike."""
    docs = V.documents(spark, sf_dir).select("doc_id", "text", text.normalize_text("text").alias("plain"))
    beginning = Window.partitionBy(F.md5(F.substring("plain", 1, PAIR_CHARS))).orderBy("doc_id")
    paired = docs.withColumns(
        {"before_id": F.lag("doc_id").over(beginning), "before": F.lag("text").over(beginning)}
    )
    # Many texts may begin alike, so pairs are dealt out anew before they are compared, to a number of tasks that
    # adaptive execution does not merge by bytes: a pair costs far more time than its bytes say.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return paired.filter(F.col("before_id").isNotNull()).repartition(tasks, "doc_id", "before_id")


@query("c8_is_near_duplicate")
def is_near_duplicate(spark, sf_dir):
    same = similarity.is_near_duplicate("text", "before")
    return _document_pairs(spark, sf_dir).select("doc_id", "before_id", same.alias("near_duplicate"))


@query("c8_similar_documents")
def similar_documents(spark, sf_dir):
    """All documents against all: every document with the smallest one of its text, and that text's near ones."""
    members, pairs = similarity_join.similar_pairs(V.documents(spark, sf_dir))
    both = pairs.unionAll(pairs.select(F.col("earlier").alias("later"), F.col("later").alias("earlier")))
    links = both.groupBy(F.col("later").alias("class_id")).agg(F.count(F.lit(1)).alias("links"))
    return members.join(links, "class_id", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


@query(
    "c8_equal_documents",
    f"""SELECT doc_id, min(doc_id) OVER (PARTITION BY plain) AS class_id
FROM (SELECT doc_id, {S.norm("text")} AS plain FROM documents) WHERE plain <> ''""",
)
def equal_documents(spark, sf_dir):
    """The classes of equal texts that the join starts from."""
    return similarity_join.text_classes(V.documents(spark, sf_dir), "doc_id", "text")[0]


@query(
    "c7_text_similarity_bounds",
    f"""SELECT doc_id, before_id, plain = before AS is_one, true AS within_lengths,
  plain = before AND plain <> '' AS equal_and_near
FROM (SELECT doc_id, plain, lag(doc_id) OVER p AS before_id, lag(plain) OVER p AS before
  FROM (SELECT doc_id, {S.norm("text")} AS plain FROM documents)
  WINDOW p AS (PARTITION BY substr(plain, 1, {PAIR_CHARS}) ORDER BY doc_id)) WHERE before_id IS NOT NULL""",
)
def text_similarity_bounds(spark, sf_dir):
    """What SQL can say of the ratio: it is 1 for equal texts only, and the lengths bound it."""
    pairs = _document_pairs(spark, sf_dir).withColumns(
        {"ratio": similarity.text_similarity_ratio("text", "before"), "before": text.normalize_text("before")}
    )
    short, both = F.least(F.length("plain"), F.length("before")), F.length("plain") + F.length("before")
    equal = F.col("plain") == F.col("before")
    return pairs.select(
        "doc_id",
        "before_id",
        (F.col("ratio") == 1.0).alias("is_one"),
        (F.col("ratio") * both <= 2 * short + 1e-6).alias("within_lengths"),
        # Texts that differ need not be compared for this.
        (equal & similarity.is_near_duplicate(F.when(equal, F.col("plain")), F.when(equal, F.col("before")))).alias(
            "equal_and_near"
        ),
    )


SCORE = "(event_id % 101) / 100.0"


def _scores(spark, sf_dir):
    return V.table(spark, sf_dir, "events").withColumn(
        "score", (F.col("event_id") % 101) / F.lit(100.0)
    )


@query(
    "c9_confidence_level",
    f"""SELECT event_id, CASE WHEN {SCORE} >= 0.75 THEN 'High' WHEN {SCORE} >= 0.45 THEN 'Medium'
  ELSE 'Low' END AS level FROM events""",
)
def confidence_level(spark, sf_dir):
    return _scores(spark, sf_dir).select(
        "event_id", display.confidence_level("score").alias("level")
    )


ODD_VALUE = "CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 13 = 0 THEN 'Infinity'::DOUBLE WHEN event_id % 17 = 0 THEN NULL ELSE value END"


def _odd_values(spark, sf_dir):
    key = F.col("event_id")
    return V.table(spark, sf_dir, "events").withColumn(
        "odd",
        F.when(key % 11 == 0, F.lit(float("nan")))
        .when(key % 13 == 0, F.lit(float("inf")))
        .when(key % 17 == 0, F.lit(None))
        .otherwise(F.col("value")),
    )


@query(
    "c10_rescale_confidence",
    f"""SELECT event_id, round(CASE WHEN v IS NULL OR isnan(v) THEN 0 WHEN v > 1 THEN least(1, v / 100)
  WHEN isinf(v) THEN 0 ELSE v END, 6) AS score FROM (SELECT event_id, {ODD_VALUE} AS v FROM events)""",
)
def rescale_confidence(spark, sf_dir):
    return _odd_values(spark, sf_dir).select(
        "event_id", F.round(display.rescale_confidence("odd"), 6).alias("score")
    )


@query(
    "c11_evidence_similarity",
    f"""SELECT event_id, round(CASE
    WHEN d IS NOT NULL AND NOT isnan(d) THEN greatest(0, least(1, 1 / (1 + d)))
    WHEN a IS NOT NULL AND NOT isnan(a) THEN greatest(0, least(1, 1 / (1 + abs(a))))
    ELSE 0 END, 6) AS similarity
FROM (SELECT event_id, {ODD_VALUE} AS d,
    CASE WHEN event_id % 22 = 0 THEN NULL ELSE -value / 10 END AS a FROM events)""",
)
def evidence_similarity(spark, sf_dir):
    adjusted = F.when(F.col("event_id") % 22 == 0, F.lit(None)).otherwise(-F.col("value") / 10)
    return _odd_values(spark, sf_dir).select(
        "event_id", F.round(display.evidence_similarity("odd", adjusted), 6).alias("similarity")
    )


@query(
    "c12_evidence_defaults",
    """SELECT ticket_id, unnest([1, 2]) AS position,
  unnest([CASE WHEN ticket_id % 3 = 0 THEN 'evidence-1' ELSE 'doc ' || ticket_id END,
          'evidence-2']) AS id,
  unnest([CASE WHEN ticket_id % 5 = 0 THEN '—' ELSE queue END, queue]) AS queue,
  unnest([ml_priority, '—']) AS priority,
  unnest([CASE WHEN ticket_id % 2 = 0 THEN '' ELSE issue END, issue]) AS issue_description,
  unnest(['', 'done']) AS resolution, unnest([0.5::DOUBLE, 0.8::DOUBLE]) AS similarity_score
FROM tickets""",
    ("tickets",),
)
def evidence_defaults(spark, sf_dir):
    key, nothing = F.col("ticket_id"), F.lit(None).cast("string")

    def entry(doc_id, queue, priority, distance, adjusted, issue, resolution):
        return F.struct(
            doc_id.alias("doc_id"),
            queue.alias("queue"),
            priority.alias("priority"),
            distance.cast("double").alias("distance"),
            adjusted.cast("double").alias("adjusted_score"),
            issue.alias("issue_description"),
            resolution.alias("resolution"),
        )

    evidence = F.array(
        entry(
            F.when(key % 3 == 0, F.lit(" ")).otherwise(
                F.concat(F.lit(" doc "), key.cast("string"))
            ),
            F.when(key % 5 == 0, nothing).otherwise(F.col("queue")),
            F.col("ml_priority"),
            F.lit(1.0),
            nothing,
            F.when(key % 2 == 0, nothing).otherwise(F.col("issue")),
            nothing,
        ),
        entry(
            nothing, F.col("queue"), nothing, nothing, F.lit(-0.25), F.col("issue"), F.lit("done")
        ),
    )
    shown = V.tickets(spark, sf_dir).select(
        "ticket_id", F.posexplode(display.evidence_defaults(evidence)).alias("at", "e")
    )
    return shown.select("ticket_id", (F.col("at") + 1).alias("position"), "e.*")


def _escalation(spark, sf_dir):
    key = F.col("ticket_id")
    part = lambda n, words: F.when(key % n == 0, F.lit(None)).otherwise(F.lit(words))
    return V.tickets(spark, sf_dir).select(
        "ticket_id",
        F.struct(
            F.when(key % 2 == 0, F.lit("Escalate now")).otherwise(F.lit("  ")).alias("decision"),
            part(3, "Platform Team").alias("team"),
            part(5, "Immediate risk").alias("reason"),
            F.when(key % 4 == 0, F.lit(" Declare incident ")).otherwise(F.lit(" ")).alias("raw"),
        ).alias("escalation"),
    )


ESCALATION_SQL = """SELECT ticket_id, CASE WHEN ticket_id % 4 = 0 THEN 'Declare incident' ELSE
  concat_ws(' — ', CASE WHEN ticket_id % 2 = 0 THEN 'Escalate now' END,
    CASE WHEN ticket_id % 3 <> 0 THEN 'Platform Team' END,
    CASE WHEN ticket_id % 5 <> 0 THEN 'Immediate risk' END) END AS escalation FROM tickets"""


@query("c13_escalation_text", ESCALATION_SQL, ("tickets",))
def escalation_text(spark, sf_dir):
    return _escalation(spark, sf_dir).select(
        "ticket_id", display.escalation_text("escalation").alias("escalation")
    )


@query(
    "c14_confidence_percent",
    f"SELECT event_id, CAST(floor({SCORE} * 100 + 0.5) AS BIGINT) || '%' AS percent FROM events",
)
def confidence_percent(spark, sf_dir):
    return _scores(spark, sf_dir).select(
        "event_id", display.confidence_percent("score").alias("percent")
    )


WORDS = ("p0", " P1", "high ", "Critical", "SEVERE", "p2", " medium", "moderate", "P3", "", "low")
WORD_SQL = f"{S.text_list(WORDS)}[event_id % {len(WORDS)} + 1]"


def _priority_words(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select(
        "event_id", V.pick(WORDS, F.col("event_id") % len(WORDS)).alias("word")
    )


def _level_sql(word: str, high: tuple[str, ...]) -> str:
    return f"""CASE WHEN {word} IN {S.in_list(high)} THEN 'HIGH'
  WHEN {word} IN ('P2', 'MEDIUM', 'MODERATE') THEN 'MEDIUM' ELSE 'LOW' END"""


@query(
    "c15_priority_level",
    f"""SELECT event_id,
  {_level_sql(f"upper({S.strip(WORD_SQL)})", fixed.HIGH_WORDS)} AS level,
  {_level_sql(f"upper({WORD_SQL})", fixed.HIGH_WORDS_IN_LIST)} AS list_level FROM events""",
)
def priority_level(spark, sf_dir):
    return _priority_words(spark, sf_dir).select(
        "event_id",
        display.priority_level("word").alias("level"),
        display.incident_priority_level("word").alias("list_level"),
    )


@query(
    "c16_escalation_severity",
    f"""SELECT ticket_id, CASE WHEN contains(lower(escalation), 'declare')
    OR contains(lower(escalation), 'immediate') THEN 'critical'
  WHEN contains(lower(escalation), 'escalate') THEN 'elevated' ELSE 'normal' END AS severity
FROM ({ESCALATION_SQL})""",
    ("tickets",),
)
def escalation_severity(spark, sf_dir):
    shown = display.escalation_text("escalation")
    return _escalation(spark, sf_dir).select(
        "ticket_id", display.escalation_severity(shown).alias("severity")
    )


@query(
    "c17_status_class",
    """SELECT id, CASE WHEN contains(lower(status), 'escalated') THEN 'escalated'
  WHEN contains(lower(status), 'investigating') THEN 'investigating'
  WHEN contains(lower(status), 'mitigating') THEN 'mitigating'
  WHEN contains(lower(status), 'open') THEN 'open' ELSE 'other' END AS status_class
FROM ui_tickets""",
    ("ui_tickets",),
)
def status_class(spark, sf_dir):
    return V.ui_tickets(spark, sf_dir).select(
        "id", display.status_class("status").alias("status_class")
    )


NAMES = ("summary", "root_cause", "evidence", "actions", "checks", "escalation")


@query(
    "c18_parse_section",
    "SELECT ticket_id, "
    + ", ".join(f"{S.section('text', h)} AS {n}" for h, n in zip(fixed.SECTION_HEADERS, NAMES))
    + " FROM documents_text",
    ("documents_text",),
)
def parse_section(spark, sf_dir):
    parts = [
        sections.parse_named_section("text", h).alias(n)
        for h, n in zip(fixed.SECTION_HEADERS, NAMES)
    ]
    return V.decision_documents(spark, sf_dir).select("ticket_id", *parts)


def _joined(expression: str) -> str:
    return f"array_to_string({expression}, '|')"


@query(
    "c19_parse_bullets",
    f"SELECT ticket_id, {_joined(S.bullets('text'))} AS bullets FROM documents_text",
    ("documents_text",),
)
def parse_bullets(spark, sf_dir):
    return V.decision_documents(spark, sf_dir).select(
        "ticket_id", F.array_join(sections.parse_bullets("text"), "|").alias("bullets")
    )


_PARSED = {n: f"({S.section('text', h)})" for h, n in zip(fixed.SECTION_HEADERS, NAMES)}


def _escalation_line(at: int, label: str = "") -> str:
    line = f"coalesce(({S.bullets('escalation')})[{at}], '')"
    return S.strip(f"replace({line}, '{label}', '')") if label else line


@query(
    "c20_parse_decision_output",
    f"""SELECT ticket_id, summary AS assessment_summary, root_cause,
  {_joined(S.bullets('evidence'))} AS evidence_from_similar_incidents,
  {_joined(S.bullets('actions'))} AS action_plan, {_joined(S.bullets('checks'))} AS next_diagnostics,
  {_escalation_line(1)} AS decision, {_escalation_line(2, 'Team:')} AS team,
  {_escalation_line(3, 'Reason:')} AS reason, escalation AS raw, text AS raw_decision
FROM (SELECT ticket_id, text, {", ".join(f"{e} AS {n}" for n, e in _PARSED.items())}
  FROM documents_text)""",
    ("documents_text",),
)
def parse_decision_output(spark, sf_dir):
    parsed = V.decision_documents(spark, sf_dir).select(
        "ticket_id", sections.parse_decision_output("text").alias("p")
    )
    lists = ("evidence_from_similar_incidents", "action_plan", "next_diagnostics")
    return parsed.select(
        "ticket_id",
        "p.assessment_summary",
        "p.root_cause",
        *[F.array_join(f"p.{c}", "|").alias(c) for c in lists],
        "p.escalation_recommendation.*",
        "p.raw_decision",
    )


@query(
    "c21_extract_escalation",
    """SELECT ticket_id, CASE WHEN ticket_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS escalation
FROM tickets""",
    ("tickets",),
)
def extract_escalation(spark, sf_dir):
    return V.decision_documents(spark, sf_dir).select(
        "ticket_id", sections.extract_escalation("text").alias("escalation")
    )


@query(
    "c22_extract_recommended_priority",
    r"""SELECT ticket_id, coalesce(nullif(upper(regexp_extract(text,
  '(?i)Assessment Summary:\s*- Recommended Priority:\s*(LOW|MEDIUM|HIGH|CRITICAL)', 1)), ''),
  'UNKNOWN') AS priority FROM documents_text""",
    ("documents_text",),
)
def extract_recommended_priority(spark, sf_dir):
    return V.decision_documents(spark, sf_dir).select(
        "ticket_id", sections.extract_recommended_priority("text").alias("priority")
    )


INCIDENT_SQL = S.fill(
    fixed.INCIDENT_FORMAT,
    position="h.rank",
    type="k.type",
    queue="k.queue",
    priority="k.priority",
    distance="printf('%.4f', h.distance)",
    adjusted_score="printf('%.4f', h.distance)",
    tags="array_to_string(k.tags, ', ')",
    issue_description="k.issue_description",
)


@query(
    "c23_format_incidents",
    f"""SELECT h.query_id, string_agg(rtrim({INCIDENT_SQL}, {S.lit(fixed.WHITESPACE)}),
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY h.rank) AS incidents
FROM cos_hits h JOIN kb k USING (doc_id) WHERE h.rank <= 3 GROUP BY h.query_id""",
    ("cos_hits",),
)
def format_incidents(spark, sf_dir):
    found = retrieved_incidents(V.hits(spark, sf_dir, 3), V.knowledge_base(spark, sf_dir))
    fields = ("rank", "distance", "type", "queue", "priority", "tags", "issue_description")
    entry = F.struct(*fields, F.lit(None).cast("double").alias("adjusted_score"))
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("incidents"))
    return lists.select("query_id", render.format_incidents("incidents").alias("incidents"))


PROMPT_SQL = S.fill(
    fixed.PROMPT_FORMAT,
    issue="issue",
    type="type",
    queue="queue",
    predicted="ml_priority",
    recommended="ml_priority",
    score=SCORE.replace("event_id", "ticket_id"),
    level="'Medium'",
    summary=query_text_sql(),
    incidents="'none'",
)


@query(
    "c24_build_prompt",
    f"""SELECT ticket_id, md5(prompt) AS prompt_md5, length(prompt) AS prompt_chars
FROM (SELECT ticket_id, {PROMPT_SQL} AS prompt FROM tickets)""",
    ("tickets",),
)
def build_prompt(spark, sf_dir):
    prompt = render.build_prompt(
        "issue",
        "type",
        "queue",
        "ml_priority",
        "ml_priority",
        (F.col("ticket_id") % 101) / F.lit(100.0),
        F.lit("Medium"),
        text.build_query("issue", "type", "queue"),
        F.lit("none"),
    )
    prompts = V.tickets(spark, sf_dir).select("ticket_id", prompt.alias("prompt"))
    return prompts.select(
        "ticket_id",
        F.md5("prompt").alias("prompt_md5"),
        F.length("prompt").cast("bigint").alias("prompt_chars"),
    )


FALLBACK_SQL = S.fill(
    fixed.FALLBACK_DECISION_FORMAT,
    recommended="ml_priority",
    predicted="ml_priority",
    score=SCORE.replace("event_id", "ticket_id"),
    level="'Low'",
    reason=S.lit(fixed.NO_TEXT_REASON),
)


@query(
    "c25_fallback_decision", f"SELECT ticket_id, {FALLBACK_SQL} AS decision FROM tickets", ("tickets",)
)
def fallback_decision(spark, sf_dir):
    decision = render.fallback_decision(
        "ml_priority", "ml_priority", (F.col("ticket_id") % 101) / F.lit(100.0), F.lit("Low")
    )
    return V.tickets(spark, sf_dir).select("ticket_id", decision.alias("decision"))


@query(
    "c26_manual_ticket",
    """SELECT type || ': ' || substr(issue, 1, 52) || CASE WHEN length(issue) > 52 THEN '...' ELSE ''
  END AS title, issue AS issue_description, type, queue, 'Open' AS status, 'manual' AS category,
  'MAN-' || year("timestamp") AS id_prefix, 12 AS id_chars,
  strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS "timestamp"
FROM tickets""",
    ("tickets",),
)
def manual_ticket(spark, sf_dir):
    from caseloom.operators.requests import manual_tickets

    entries = V.tickets(spark, sf_dir).withColumnRenamed("issue", "issue_description")
    made = manual_tickets(entries)
    return made.select(
        "title",
        "issue_description",
        "type",
        "queue",
        "status",
        "category",
        F.substring("id", 1, 8).alias("id_prefix"),
        F.length("id").alias("id_chars"),
        V.shown_time("timestamp").alias("timestamp"),
    )
