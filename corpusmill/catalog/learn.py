"""Queries over annotation, agreement, active learning and whole chains."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.catalog.base import (
    DIRTY,
    DOCS,
    answer,
    dirty,
    docs,
    query,
    strip,
    table,
    text_table,
    top,
)
from corpusmill.catalog.quality import CLEANED, cleaned, row, union
from corpusmill.functions.answers import normalize_answer, parse_answer
from corpusmill.operators import active as ac
from corpusmill.operators import agreement as ag
from corpusmill.operators import annotate as an
from corpusmill.operators import training as tr
from corpusmill.plans.chain import chain, table_stage
from corpusmill.settings import cut_lineage

CLASSES = [
    {"name": "english", "description": "English prose", "keywords": ["the", "and", "of"]},
    {"name": "french", "description": "French prose", "keywords": ["le", "la", "et", "des"]},
    {"name": "german", "description": "German prose", "keywords": ["der", "die", "und"]},
]

# --------------------------------------------------------------------------- annotation

_PAYLOAD = (
    "'{\"task\":\"topic\",\"prompt\":\"Name it\",\"classes\":[{\"name\":\"a\"}],\"examples\":[],' || "
    "substr(json_object('text', text)::VARCHAR, 2)"
)


@query("build_payload", f"WITH {DIRTY} SELECT doc_id, {_PAYLOAD} AS payload FROM dirty")
def _(spark, folder):
    rows = dirty(spark, folder)
    return rows.select("doc_id", an.build_payload(rows, "topic", "Name it", [{"name": "a"}]).alias("payload"))


def _longest_word(payloads):
    """Stands for a model: answers with the longest word of a payload's text, fails on some."""
    answers = []
    for payload in payloads:
        found = max(json.loads(payload)["text"].split(), key=len, default="")
        if not found:
            raise ValueError("nothing to answer")
        answers.append({"label": found.lower()})
    return answers


@query(
    "annotate_pass",
    r"""
    WITH s AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS words FROM documents),
         w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM s),
         l AS (SELECT doc_id, word FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(word) DESC, i) = 1)
    SELECT doc_id, replace(json_object('label', lower(word))::VARCHAR, '{"label":', '{"label": ') AS pass_1_raw,
           CAST(NULL AS VARCHAR) AS pass_1_error FROM l
    """,
)
def _(spark, folder):
    rows = text_table(spark, folder, "documents").select("doc_id", "text")
    payload = an.build_payload(rows, "topic", "Name the longest word", [{"name": "a"}])
    return an.annotate_pass(rows, payload, _longest_word, "pass_1").select("doc_id", "pass_1_raw", "pass_1_error")


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _hits(keywords: list[str]) -> str:
    listed = ", ".join(f"'{k}'" for k in keywords)
    return f"len(list_filter(w, lambda x: x IN ({listed})))"


@query(
    "keyword_annotator",
    f"""
    WITH h AS (SELECT doc_id, {_hits(CLASSES[0]["keywords"])} AS a, {_hits(CLASSES[1]["keywords"])} AS b,
                      {_hits(CLASSES[2]["keywords"])} AS c FROM (SELECT doc_id, {_WORDS} AS w FROM documents))
    SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a >= b AND a >= c THEN 'english'
                        WHEN b >= c THEN 'french' ELSE 'german' END AS label FROM h
    """,
)
def _(spark, folder):
    rows = text_table(spark, folder, "documents")
    return rows.select("doc_id", an.keyword_annotator(F.col("text"), CLASSES).alias("label"))


# One raw answer per turn, in the shapes models answer in.
_ONE_LINE = r"regexp_replace(text, '[`{}\[\]\\\n\r\"]', ' ', 'g')"


def _raw_answers(turns):
    line = F.regexp_replace("text", r'[`{}\[\]\\\n\r"]', " ")
    n = F.length("text")
    shape = (
        F.when(F.col("role") == "system", F.lit("We cannot determine it."))
        .when(n < 60, F.concat(F.lit('{"label": "'), line, F.lit('"}')))
        .when(n < 120, F.concat(F.lit('So:\n```json\n{"label": "", "answer": "'), line, F.lit('"}\n```')))
        .when(n < 240, F.concat(F.lit("Thus \\boxed{"), line, F.lit("} or \\boxed{7}.")))
        .when(n < 480, F.concat(F.lit("Answer: 1\nFinal answer = "), line, F.lit("  \n")))
        .when(n < 960, F.lit('{"label": true}'))
        .otherwise(line)
    )
    return turns.select("conv_id", "turn", shape.alias("raw"))


_PARSED = f"""
    SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'invalid'
        WHEN length(text) < 480 THEN NULLIF({strip(_ONE_LINE)}, '')
        WHEN length(text) < 960 THEN 'True' END AS answer FROM conversations
"""


@query("parse_answer", _PARSED)
def _(spark, folder):
    raw = _raw_answers(text_table(spark, folder, "conversations"))
    return raw.select("conv_id", "turn", parse_answer(F.col("raw")).alias("answer"))


@query(
    "normalize_answer",
    "SELECT doc_id, "
    + answer("a")
    + " AS answer FROM (SELECT doc_id, CASE WHEN n_chars < 60 THEN ' None ' WHEN lang = 'es' THEN 'NaN' ELSE text END AS a "
    "FROM documents)",
)
def _(spark, folder):
    raw = F.when(F.col("n_chars") < 60, " None ").when(F.col("lang") == "es", "NaN").otherwise(F.col("text"))
    return text_table(spark, folder, "documents").select("doc_id", normalize_answer(raw).alias("answer"))


def _passes(spark, folder):
    """Two passes over the labelled documents: quality and, turned round, toxicity."""
    labels = table(spark, folder, "labels")
    first = F.when(F.col("quality") == 1, "good").otherwise("bad")
    second = F.when(F.col("toxic") == 1, "bad").otherwise("good")
    passes = labels.select("doc_id", first.alias("p1"), second.alias("p2"), F.col("quality").alias("given"))
    rows = text_table(spark, folder, "documents").join(passes, "doc_id", "left")
    raw_1 = F.when(F.col("p1").isNotNull(), F.concat(F.lit('{"label": "'), F.col("p1"), F.lit('"}')))
    raw_2 = F.when(
        F.col("p2").isNotNull() & (F.col("lang") != "de"), F.concat(F.lit("Answer: "), F.col("p2"))
    )
    given = F.when(F.col("lang") == "fr", F.when(F.col("given") == 1, "good").otherwise("bad"))
    return rows.select("doc_id", "text", "source", raw_1.alias("raw_1"), raw_2.alias("raw_2"), given.alias("label"))


PASSES = """passes AS (
    SELECT doc_id, d.text, d.source,
           CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'bad' END AS a1,
           CASE WHEN d.lang <> 'de' THEN CASE WHEN l.toxic = 1 THEN 'bad' WHEN l.toxic = 0 THEN 'good' END END AS a2,
           CASE WHEN d.lang = 'fr' THEN CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END END AS label
    FROM documents d LEFT JOIN labels l USING (doc_id))"""

FINAL = f"""{PASSES}, final AS (
    SELECT *, a1 IS NOT DISTINCT FROM a2 AS agree, CASE WHEN a1 = a2 THEN a1 END AS annotation_label,
           CASE WHEN a1 = a2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
           a1 IS NULL OR a2 IS NULL OR a1 <> a2 AS review FROM passes),
    reasoned AS (SELECT *, CASE WHEN NOT review THEN 'none' WHEN a1 IS NULL OR a2 IS NULL
        THEN 'parser_failed_or_empty_answer' ELSE 'pass_disagreement' END AS reason FROM final)"""


def _annotated(spark, folder):
    parsed = an.parse_passes(_passes(spark, folder), "raw_1", "raw_2")
    return an.finalize_annotations(an.reconcile(parsed))


@query(
    "reconcile",
    f"WITH {FINAL} SELECT doc_id, 'ok' AS status, agree, annotation_label AS final_label, CAST(NULL AS VARCHAR) AS error FROM final",
)
def _(spark, folder):
    parsed = an.parse_passes(_passes(spark, folder), "raw_1", "raw_2")
    return an.reconcile(parsed).select("doc_id", "compare.*")


@query(
    "reconcile_comparator",
    f"WITH {FINAL} SELECT doc_id, CASE WHEN a1 IS DISTINCT FROM a2 AND (a1 IS NULL OR a2 IS NULL) THEN 'error' ELSE 'ok' END AS status, "
    "agree AS agree, annotation_label AS final_label, "
    "CASE WHEN a1 IS DISTINCT FROM a2 AND (a1 IS NULL OR a2 IS NULL) THEN 'one answer is missing' END AS error FROM final",
)
def _(spark, folder):
    def judge(first, second):
        one = first.isNull() | second.isNull()
        return F.struct(
            F.lit(False).alias("agree"),
            F.lit(None).cast("string").alias("final_label"),
            F.when(one, "one answer is missing").alias("error"),
        )

    parsed = an.parse_passes(_passes(spark, folder), "raw_1", "raw_2")
    return an.reconcile(parsed, judge).select("doc_id", "compare.*")


@query(
    "finalize_annotations",
    f"""
    WITH {FINAL} SELECT doc_id, a1 AS annotation_auto_label_pass_1, a2 AS annotation_auto_label_pass_2,
        annotation_label, annotation_label AS annotation_auto_label,
        CASE WHEN annotation_label IS NULL THEN 'unresolved' ELSE 'agreed_llm' END AS annotation_label_origin,
        agree AS annotation_intra_agreement, confidence AS annotation_confidence, review AS annotation_needs_review,
        'ok' AS annotation_compare_status, CAST(NULL AS VARCHAR) AS annotation_compare_error FROM final
    """,
)
def _(spark, folder):
    done = _annotated(spark, folder)
    kept = [c for c in done.columns if c.startswith("annotation_") and "extracted" not in c]
    return done.select("doc_id", *kept)


@query("keep_existing_labels", f"WITH {FINAL} SELECT doc_id, label, annotation_label FROM final")
def _(spark, folder):
    original = _passes(spark, folder)
    annotated = _annotated(spark, folder).drop("label")
    return an.keep_existing_labels(annotated, original, "doc_id").select("doc_id", "label", "annotation_label")


def _kappa_sql(name: str, a: str, b: str) -> str:
    """One row: compared rows, agreement and kappa of two label columns."""
    return f"""
    SELECT n AS compared, round(po, 6) AS agreement_rate,
           round(CASE WHEN n < 2 THEN NULL WHEN abs(1 - pe) < 1e-12 THEN (CASE WHEN po = 1 THEN 1.0 ELSE 0.0 END)
                 ELSE (po - pe) / (1 - pe) END, 6) AS kappa
    FROM (SELECT count(*) AS n, avg(({a} = {b})::INT) AS po FROM {name} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
         (SELECT sum(x * y) AS pe FROM
            (SELECT {a} AS v, count(*) / sum(count(*)) OVER () AS x FROM {name}
             WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a})
            JOIN (SELECT {b} AS v, count(*) / sum(count(*)) OVER () AS y FROM {name}
             WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {b}) USING (v))"""


@query("agreement_rate", f"SELECT compared, agreement_rate FROM ({_kappa_sql('labels', 'quality', 'toxic')})")
def _(spark, folder):
    return ag.agreement_rate(table(spark, folder, "labels"), "quality", "toxic")


@query("cohen_kappa", f"SELECT compared, kappa FROM ({_kappa_sql('labels', 'quality', 'toxic')})")
def _(spark, folder):
    return ag.cohen_kappa(table(spark, folder, "labels"), "quality", "toxic")


@query(
    "supports_agreement",
    "SELECT count(event_type) >= 2 AND count(DISTINCT event_type) <= least(20, greatest(5, floor(count(event_type) / 2))) "
    "AND avg((try_cast(event_type AS DOUBLE) IS NOT NULL)::INT) < 0.8 AS supported FROM events",
)
def _(spark, folder):
    return ag.supports_agreement(table(spark, folder, "events"), "event_type")


@query(
    "annotation_quality",
    f"WITH {FINAL}, intra AS ({_kappa_sql('final', 'a1', 'a2')}), inter AS ({_kappa_sql('final', 'label', 'annotation_label')}) "
    + union(
        [
            row("annotation", f"{k}_agreement_rate", "", "agreement_rate", k) for k in ("intra", "inter")
        ]
        + [
            row("annotation", f"{k}_agreement_pct", "", e, f"({_kappa_sql('final', a, b).replace('round(po, 6)', 'po * 100')})")
            for k, a, b, e in (
                ("intra", "a1", "a2", "agreement_rate"),
                ("inter", "label", "annotation_label", "agreement_rate"),
            )
        ]
        + [row("annotation", f"{k}_kappa", "", "kappa", k) for k in ("intra", "inter")]
        + [
            row("annotation", "confidence_mean", "", "avg(confidence)", "final"),
            row("annotation", "review_count", "", "count(*) FILTER (review)", "final"),
            row("annotation", "review_rate", "", "avg(review::INT)", "final"),
            "SELECT 'annotation', 'label_dist', annotation_label, count(*)::DOUBLE FROM final "
            "WHERE annotation_label IS NOT NULL GROUP BY annotation_label",
        ]
    ),
)
def _(spark, folder):
    return ag.annotation_quality(_annotated(spark, folder))


@query("flag_for_review", f"WITH {FINAL} SELECT doc_id, source FROM final WHERE review OR confidence < 0.75")
def _(spark, folder):
    return an.flag_for_review(_annotated(spark, folder)).select("doc_id", "source")


@query("review_reason", f"WITH {FINAL} SELECT doc_id, reason FROM reasoned")
def _(spark, folder):
    return _annotated(spark, folder).select("doc_id", an.review_reason().alias("reason"))


@query(
    "label_tasks",
    f"""
    WITH {FINAL} SELECT row_number() OVER (ORDER BY doc_id) AS id, text, source, confidence, annotation_label AS label,
        review AS needs_review, reason, CASE WHEN annotation_label IS NULL THEN 0 ELSE 1 END::BIGINT AS results,
        annotation_label AS choice FROM reasoned
    """,
)
def _(spark, folder):
    tasks = an.label_tasks(_annotated(spark, folder), "doc_id")
    result = F.col("predictions")[0]["result"]
    return tasks.select(
        "id",
        "data.text",
        "data.source",
        "meta.confidence",
        F.col("data.annotation_label").alias("label"),
        "meta.needs_review",
        F.col("meta.review_reason").alias("reason"),
        F.size(result).alias("results"),
        F.try_element_at(F.try_element_at(result, F.lit(1))["value"]["choices"], F.lit(1)).alias("choice"),
    )


@query(
    "label_tasks_review",
    f"WITH {FINAL} SELECT row_number() OVER (ORDER BY doc_id) AS id, source, reason FROM reasoned WHERE review",
)
def _(spark, folder):
    tasks = an.label_tasks(_annotated(spark, folder), "doc_id", review_only=True)
    return tasks.select("id", "data.source", F.col("meta.review_reason").alias("reason"))


_EXAMPLES = (
    "SELECT label::VARCHAR AS label, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS position, text AS example "
    "FROM docs WHERE label IS NOT NULL AND text IS NOT NULL QUALIFY position <= 3"
)


@query("examples_per_class", f"WITH {DOCS} {_EXAMPLES}")
def _(spark, folder):
    return an.examples_per_class(docs(spark, folder), "doc_id")


@query(
    "annotation_spec",
    f"WITH {DOCS}, e AS ({_EXAMPLES}), s AS (SELECT label, string_agg(example, '|' ORDER BY position) AS examples FROM e GROUP BY label) "
    "SELECT 1::BIGINT AS position, '1' AS label, 'well written' AS definition, 'good' AS keywords, (SELECT examples FROM s WHERE label = '1') AS examples "
    "UNION ALL SELECT 2, '0', 'No explicit description configured.', '', (SELECT examples FROM s WHERE label = '0') "
    "UNION ALL SELECT 3, 'unsure', 'not decided', '', 'given one'",
)
def _(spark, folder):
    classes = [
        {"name": "1", "description": "well written", "keywords": ["good"]},
        {"name": "0"},
        {"name": "unsure", "description": "not decided", "examples": ["given one"]},
    ]
    spec = an.annotation_spec(docs(spark, folder), "doc_id", classes)
    return spec.select(
        "position",
        "label",
        "definition",
        F.array_join("keywords", "|").alias("keywords"),
        F.array_join("examples", "|").alias("examples"),
    )


def _shout(row: dict) -> dict | None:
    """Changes French rows, leaves others, fails on German ones."""
    if row["lang"] == "de":
        raise ValueError("no German")
    if row["lang"] != "fr":
        return None
    return {"lang": None, "source": row["source"].upper(), "size": len(row["text"])}


@query(
    "transform_rows",
    "SELECT doc_id, text, CASE WHEN lang <> 'fr' THEN lang END AS lang, "
    "CASE WHEN lang = 'fr' THEN upper(source) ELSE source END AS source, n_chars, "
    "CASE WHEN lang = 'fr' THEN length(text) END AS size FROM documents",
)
def _(spark, folder):
    return an.transform_rows(text_table(spark, folder, "documents"), _shout, "size bigint")


# ---------------------------------------------------------------------- active learning


@query("split_labeled_pool", f"WITH {DOCS} SELECT doc_id, CASE WHEN label IS NULL THEN 'pool' ELSE 'labeled' END AS part FROM docs")
def _(spark, folder):
    labeled, pool = ac.split_labeled_pool(docs(spark, folder), "label")
    return labeled.select("doc_id", F.lit("labeled").alias("part")).union(
        pool.select("doc_id", F.lit("pool").alias("part"))
    )


@query(
    "normalize_label",
    "SELECT doc_id, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS label_text FROM labels",
)
def _(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return ac.with_label(labels, "good").select("doc_id", "label_text")


@query(
    "class_check",
    "SELECT quality::VARCHAR AS label_text, count(*) AS size, (SELECT count(DISTINCT quality) FROM labels) AS classes "
    "FROM labels WHERE quality IS NOT NULL GROUP BY quality",
)
def _(spark, folder):
    return ac.class_check(table(spark, folder, "labels"), "quality")


@query(
    "infer_features",
    "WITH s AS (SELECT 'text' AS column, 3.0 * 1 + 4.0 + least(avg(length(text)) / 80.0, 4.0) AS score FROM documents) "
    "SELECT \"column\", round(score, 6) AS score, TRUE AS selected FROM s",
)
def _(spark, folder):
    rows = table(spark, folder, "documents").drop("n_chars")
    return ac.infer_features(rows, "Classify the text by topic", "doc_id")


@query(
    "select_task_columns",
    "SELECT 'feature' AS role, 'text' AS name UNION ALL SELECT 'target', 'annotation_label' "
    "UNION ALL SELECT 'asked_feature', 'lang' UNION ALL SELECT 'asked_target', 'source'",
)
def _(spark, folder):
    rows = table(spark, folder, "documents").drop("n_chars").withColumn("annotation_label", F.lit("x"))
    features, target = ac.select_task_columns(rows, "Classify the text by topic", "doc_id")
    asked, other = ac.select_task_columns(rows, "Classify", "doc_id", ["lang", "absent"], "source")
    told = [("feature", f) for f in features] + [("target", target)]
    told += [("asked_feature", f) for f in asked] + [("asked_target", other)]
    return spark.createDataFrame(told, "role string, name string")


@query(
    "compose_text",
    f"WITH {DIRTY} SELECT doc_id, 'Task: Rate' || chr(10) || concat_ws(chr(10), text, source, audio) AS composed FROM dirty",
)
def _(spark, folder):
    rows = dirty(spark, folder)
    return rows.select("doc_id", ac.compose_text(rows, ["text", "source", "audio"], " Rate ").alias("composed"))


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_DIVERSITY = (
    f"CASE WHEN len({_TOKENS}) = 0 THEN 0 ELSE len(list_distinct({_TOKENS})) / len({_TOKENS}) END::FLOAT"
)
_RANDOM = "(('0x' || substr(md5('13:' || doc_id), 1, 8))::BIGINT / 4294967296.0)::DOUBLE::FLOAT"
_MARGIN = "(1.0 / (1.0 + abs(length(text) - (SELECT median(length(text)) FROM {0}))))::DOUBLE::FLOAT"


@query("score_diversity", f"SELECT doc_id, round({_DIVERSITY}::DOUBLE, 6) AS score FROM documents")
def _(spark, folder):
    rows = text_table(spark, folder, "documents")
    return ac.with_score(rows, "doc_id", "text", "entropy").select("doc_id", "score")


@query("score_margin", f"SELECT doc_id, round({_MARGIN.format('documents')}::DOUBLE, 6) AS score FROM documents")
def _(spark, folder):
    rows = text_table(spark, folder, "documents")
    return ac.with_score(rows, "doc_id", "text", "margin").select("doc_id", "score")


@query("score_random", f"SELECT doc_id, round({_RANDOM}::DOUBLE, 6) AS score FROM documents")
def _(spark, folder):
    rows = table(spark, folder, "documents")
    return ac.with_score(rows, "doc_id", "text", "random").select("doc_id", "score")


def _scored_pool(spark, folder, strategy="entropy"):
    _, pool = ac.split_labeled_pool(docs(spark, folder), "label")
    return ac.with_score(pool, "doc_id", "text", strategy)


_BATCH = (
    f"(SELECT doc_id, {_DIVERSITY} AS score, row_number() OVER (ORDER BY {_DIVERSITY} DESC, doc_id) AS rank "
    "FROM docs WHERE label IS NULL QUALIFY rank <= 20)"
)


@query("query_batch", f"WITH {DOCS} SELECT doc_id, round(score::DOUBLE, 6) AS score, rank FROM {_BATCH}")
def _(spark, folder):
    return ac.query_batch(_scored_pool(spark, folder), "doc_id").select("doc_id", "score", "rank")


@query(
    "enrich_queries",
    f"WITH {DOCS}, b AS {_BATCH} SELECT doc_id, source, round(score::DOUBLE, 6) AS active_learning_score, "
    "rank AS active_learning_rank, rank IS NOT NULL AS active_learning_selected, 'label' AS active_learning_target_column, "
    "'text' AS active_learning_feature_columns FROM docs LEFT JOIN b USING (doc_id)",
)
def _(spark, folder):
    batch = ac.query_batch(_scored_pool(spark, folder), "doc_id")
    rows = docs(spark, folder).select("doc_id", "source")
    return ac.enrich_queries(rows, batch, "doc_id", "label", ["text"])


@query(
    "stratified_split",
    """
    WITH r AS (SELECT doc_id, quality::VARCHAR AS y, md5('13:' || doc_id) AS h FROM labels),
         c AS (SELECT y, count(*) AS size FROM r GROUP BY y),
         t AS (SELECT sum(size)::BIGINT AS n, count(*) AS k, sum(size - 1)::BIGINT AS most FROM c),
         w AS (SELECT n, CASE WHEN n < 6 THEN 0 ELSE least(greatest(1, least(n - k, round_even(n * 0.25, 0)::BIGINT)), most) END AS wanted FROM t),
         b AS (SELECT y, size, size - 1 AS cap, least(size - 1, floor(size / n * wanted)) AS base,
                      size / n * wanted - floor(size / n * wanted) AS fraction, wanted FROM c, w),
         e AS (SELECT *, base < cap AS open, row_number() OVER (PARTITION BY base < cap ORDER BY fraction DESC, y DESC) AS spot,
                      wanted - sum(base) OVER () AS rest FROM b),
         s AS (SELECT y, base + (open AND spot <= rest)::INT AS take FROM e)
    SELECT doc_id, r.y AS label, CASE WHEN row_number() OVER (PARTITION BY r.y ORDER BY h, doc_id) <= take THEN 'val' ELSE 'train' END AS split
    FROM r JOIN s ON r.y = s.y
    """,
)
def _(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return ac.stratified_split(labels, "doc_id", "label")


def _cycle(spark, folder, strategy):
    labeled, pool = ac.split_labeled_pool(docs(spark, folder), "label")
    return ac.run_cycle(labeled, pool, "doc_id", "text", strategy, n_iterations=4, batch_size=25)


def _history_sql(strategy: str) -> str:
    return (
        f"WITH {DOCS}, s AS (SELECT count(label) AS n, count(*) - count(label) AS pool FROM docs) "
        f"SELECT i::BIGINT AS iteration, n + least(pool, (i - 1) * 25) AS n_labeled, '{strategy}' AS strategy "
        "FROM s, range(1, 5) g(i) WHERE i <= ceil(pool / 25) + 1"
    )


def _acquired_sql(score: str) -> str:
    return (
        f"WITH {DOCS}, r AS (SELECT doc_id, row_number() OVER (ORDER BY {score} DESC, doc_id) AS spot FROM docs WHERE label IS NULL) "
        "SELECT doc_id, ((spot - 1) // 25 + 1)::BIGINT AS iteration, ((spot - 1) % 25 + 1)::BIGINT AS rank FROM r WHERE spot <= 100"
    )


@query("run_cycle_history", _history_sql("entropy"))
def _(spark, folder):
    return _cycle(spark, folder, "entropy")[0]


@query("run_cycle", _acquired_sql(_DIVERSITY))
def _(spark, folder):
    return _cycle(spark, folder, "entropy")[1]


@query("run_cycle_random", _acquired_sql(_RANDOM))
def _(spark, folder):
    return _cycle(spark, folder, "random")[1]


def _margin_cycle_sql(rounds: int, batch: int) -> str:
    """Each round orders what is left around its own median."""
    steps = [f"WITH {DOCS}, p0 AS (SELECT doc_id, length(text) AS size FROM docs WHERE label IS NULL)"]
    for i in range(1, rounds + 1):
        score = f"(1.0 / (1.0 + abs(size - (SELECT median(size) FROM p{i - 1}))))::DOUBLE::FLOAT"
        steps.append(
            f"b{i} AS (SELECT doc_id, {i}::BIGINT AS iteration, row_number() OVER (ORDER BY {score} DESC, doc_id) AS rank "
            f"FROM p{i - 1} QUALIFY rank <= {batch}), "
            f"p{i} AS (SELECT * FROM p{i - 1} WHERE doc_id NOT IN (SELECT doc_id FROM b{i}))"
        )
    return ", ".join(steps) + " " + union([f"SELECT * FROM b{i}" for i in range(1, rounds + 1)])


@query("run_cycle_margin", _margin_cycle_sql(4, 25))
def _(spark, folder):
    return _cycle(spark, folder, "margin")[1]


@query(
    "loss_history",
    "SELECT l_orderkey, l_linenumber, 1::BIGINT AS epoch, l_tax AS train_loss, l_discount AS val_loss FROM lineitem "
    "UNION ALL SELECT l_orderkey, l_linenumber, 3, l_discount, l_tax FROM lineitem",
)
def _(spark, folder):
    items = table(spark, folder, "lineitem")

    def entry(epoch, train, val):
        return F.struct(
            F.lit(epoch).cast("int").alias("epoch"), F.col(train).alias("train_loss"), val.alias("val_loss")
        )

    none = F.lit(None).cast("double")
    runs = F.array(
        entry(None, "l_tax", F.col("l_discount")), entry(2, "l_tax", none), entry(None, "l_discount", F.col("l_tax"))
    )
    metrics = items.select(
        F.struct("l_orderkey", "l_linenumber").alias("run"), F.to_json(F.struct(runs.alias("loss_history"))).alias("m")
    )
    return ac.loss_history(metrics, "m", "run").select("run.*", "epoch", "train_loss", "val_loss")


@query(
    "al_summary",
    f"WITH {DOCS} SELECT count(label) AS labeled_rows, count(*) - count(label) AS pool_rows, "
    "least(20, count(*) - count(label)) AS selected_rows, count(DISTINCT label) AS classes, 'entropy' AS strategy FROM docs",
)
def _(spark, folder):
    batch = ac.query_batch(_scored_pool(spark, folder), "doc_id")
    rows = docs(spark, folder).select("doc_id", "label")
    return ac.al_summary(ac.enrich_queries(rows, batch, "doc_id", "label", ["text"]), "label", "entropy")


def _labeled_split(spark, folder):
    labeled = ac.with_label(docs(spark, folder).where("label IS NOT NULL"), "label")
    rows = labeled.select("doc_id", "text", "label_text")
    split = cut_lineage(ac.stratified_split(rows, "doc_id", "label_text"))
    return split.where("split = 'train'"), split.where("split = 'val'")


@query("train_classifier")
def _(spark, folder):
    train, val = _labeled_split(spark, folder)
    return tr.training_losses(train, val, epochs=3)


@query(
    "evaluate",
    """
    WITH f AS (SELECT v, 2.0 * (SELECT count(*) FROM labels WHERE quality = v AND toxic = v) /
        ((SELECT count(*) FROM labels WHERE quality = v) + (SELECT count(*) FROM labels WHERE toxic = v)) AS f1
        FROM (SELECT quality AS v FROM labels UNION SELECT toxic FROM labels))
    SELECT (SELECT count(*) FROM labels) AS evaluated_rows,
           round((SELECT avg((quality = toxic)::INT) FROM labels), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f
    """,
)
def _(spark, folder):
    return tr.evaluate(table(spark, folder, "labels"), "quality", "toxic")


@query("uncertainty_scores")
def _(spark, folder):
    train, _ = _labeled_split(spark, folder)
    _, pool = ac.split_labeled_pool(docs(spark, folder), "label")
    scored = tr.predict(tr.train_classifier(train), pool.select("doc_id", "text"))
    return tr.uncertainty_scores(scored).select("doc_id", "prediction_text", "entropy", "margin")


@query("learning_curve")
def _(spark, folder):
    train, val = _labeled_split(spark, folder)
    halves = cut_lineage(ac.stratified_split(train.drop("split"), "doc_id", "label_text", 0.5))
    start, rest = halves.where("split = 'train'"), halves.where("split = 'val'")
    return tr.learning_curve(
        start, rest, val, "doc_id", n_iterations=2, batch_size=50, epochs=3
    )


# A given curve of quality, one row per source as the round it was reached in.
_CURVE = """
    c AS (SELECT 'random' AS strategy, iteration, 10 * iteration AS n_labeled, 0.25 * iteration AS macro_f1 FROM r
          UNION ALL SELECT 'entropy', iteration, 10 * iteration, 0.5 * iteration FROM r)"""


@query(
    "labels_saved",
    f"""
    WITH r AS (SELECT row_number() OVER (ORDER BY source) AS iteration FROM (SELECT DISTINCT source FROM documents)), {_CURVE},
    g AS (SELECT max(macro_f1) AS goal FROM c WHERE strategy = 'random'),
    n AS (SELECT goal AS macro_f1, min(n_labeled) FILTER (strategy = 'random') AS base_labels,
                 min(n_labeled) FILTER (strategy = 'entropy') AS other_labels FROM c, g WHERE macro_f1 >= goal GROUP BY goal)
    SELECT CAST(macro_f1 AS DOUBLE) AS macro_f1, base_labels, other_labels, base_labels - other_labels AS labels_saved FROM n
    """,
)
def _(spark, folder):
    sources = table(spark, folder, "documents").select("source").distinct()
    rounds = sources.select(F.row_number().over(Window.orderBy("source")).cast("long").alias("iteration"))
    sides = [
        rounds.select(F.lit(s).alias("strategy"), "iteration", (10 * F.col("iteration")).alias("n_labeled"), (g * F.col("iteration")).alias("macro_f1"))
        for s, g in (("random", 0.25), ("entropy", 0.5))
    ]
    return tr.labels_saved(sides[0].union(sides[1]))


# -------------------------------------------------------------------------------- chain


@query(
    "chain",
    f"WITH {CLEANED}, e AS (SELECT *, CASE WHEN label IS NULL THEN 'pool' ELSE 'labeled' END AS part FROM cleaned) "
    + union(
        [
            row("collected", "row_count", "", "count(*)", "dirty"),
            row("cleaned", "row_count", "", "count(*)", "cleaned"),
            row("pool", "row_count", "", "count(*) FILTER (part = 'pool')", "e"),
        ]
    ),
)
def _(spark, folder):
    stages = [
        table_stage("collected", lambda df: df),
        table_stage("cleaned", cleaned),
        table_stage("pool", lambda df: ac.split_labeled_pool(df, "label")[1]),
    ]
    return chain(dirty(spark, folder), stages).metrics


@query(
    "chain_batch",
    f"WITH {CLEANED} "
    + top(
        f"SELECT doc_id, source, round({_DIVERSITY}::DOUBLE, 6) AS score FROM cleaned WHERE label IS NULL",
        "round(score, 6) DESC, doc_id",
        20,
    ),
)
def _(spark, folder):
    def pick(df):
        pool = ac.split_labeled_pool(df, "label")[1]
        return ac.query_batch(ac.with_score(pool, "doc_id", "text"), "doc_id")

    stages = [table_stage("cleaned", cleaned), table_stage("batch", pick)]
    return chain(dirty(spark, folder), stages).df.select("doc_id", "source", "score")


