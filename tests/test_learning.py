import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import batches
from corpusmill.operators import active, agreement, annotate, training


def answers(spark, pairs):
    return spark.createDataFrame(
        [(i, *p) for i, p in enumerate(pairs)], f"id int, {annotate.ANSWER_1} string, {annotate.ANSWER_2} string"
    )


def test_payload(spark):
    df = spark.createDataFrame([("é \"q\"", None, 1.5)], "question string, classes string, x double")
    base = df.select(annotate.build_payload(df, "t", "p", [{"name": "a"}]).alias("j")).first()["j"]
    assert json.loads(base) == {"task": "t", "prompt": "p", "classes": [{"name": "a"}], "examples": [], "question": 'é "q"'}
    own = df.select(annotate.build_payload(df, "t", "p", [], columns=["classes", "x"]).alias("j")).first()["j"]
    assert json.loads(own) == {"task": "t", "prompt": "p", "classes": None, "examples": [], "x": 1.5}


def test_annotator_failures_stay_with_their_row(spark):
    def fussy(batch):
        if any("bad" in x for x in batch):
            raise ValueError("no")
        return [{"label": x} for x in batch]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id int, p string").coalesce(1)
    got = {r["id"]: (r["pass_1_raw"], r["pass_1_error"]) for r in annotate.annotate_pass(df, "p", fussy, "pass_1").collect()}
    assert got == {1: ('{"label": "a"}', None), 2: (None, "ValueError: no"), 3: ('{"label": "c"}', None)}


def test_keyword_annotator(spark):
    classes = [
        {"name": "positive", "keywords": ["great", "love"]},
        {"name": "negative", "keywords": ["awful", "hate"]},
        {"name": "silent"},
    ]
    df = spark.createDataFrame([("Great, I love it",), ("awful great",), ("whatever",), (None,)], "t string")
    got = [r[0] for r in df.select(annotate.keyword_annotator(F.col("t"), classes)).collect()]
    assert got == ["positive", "positive", None, None]


def test_finalize(spark):
    df = answers(spark, [("a", " a "), ("a", "b"), (None, "none"), ("a", None)])
    rows = annotate.finalize_annotations(annotate.reconcile(df)).orderBy("id").collect()
    assert [r["annotation_label"] for r in rows] == ["a", None, None, None]
    assert [r["annotation_intra_agreement"] for r in rows] == [True, False, True, False]
    assert [r["annotation_confidence"] for r in rows] == [1.0, 0.0, 0.0, 0.0]
    assert [r["annotation_needs_review"] for r in rows] == [False, True, True, True]
    assert [r["annotation_label_origin"] for r in rows] == ["agreed_llm"] + ["unresolved"] * 3


def test_comparator_decides_only_disagreements(spark):
    def judge(a, b):
        error = F.when(a.isNull() | b.isNull(), "missing")
        return F.struct((F.lower(a) == F.lower(b)).alias("agree"), F.lower(a).alias("final_label"), error.alias("error"))

    df = answers(spark, [("A", "A"), ("A", "a"), ("A", None)])
    rows = annotate.finalize_annotations(annotate.reconcile(df, judge)).orderBy("id").collect()
    assert [r["annotation_label"] for r in rows] == ["A", "a", None]
    assert [r["annotation_compare_status"] for r in rows] == ["ok", "ok", "error"]
    assert rows[2]["annotation_compare_error"] == "missing" and rows[2]["annotation_needs_review"]


def test_review_reason(spark):
    rows = [
        (False, "ok", "a", "b", 0.1),
        (None, "ok", "a", "a", 1.0),
        (True, "error", "a", "b", 0.0),
        (True, "ok", None, "b", 0.0),
        (True, "ok", "a", "b", 0.0),
        (True, "ok", "a", "a", 0.5),
        (True, "ok", "a", "a", 1.0),
    ]
    df = spark.createDataFrame(
        rows,
        "annotation_needs_review boolean, annotation_compare_status string, "
        f"{annotate.ANSWER_1} string, {annotate.ANSWER_2} string, annotation_confidence double",
    )
    got = [r[0] for r in df.select(annotate.review_reason()).collect()]
    assert got == [
        "none",
        "none",
        "reconciliation_error",
        "parser_failed_or_empty_answer",
        "pass_disagreement",
        "low_confidence",
        "unresolved_row",
    ]
    assert annotate.flag_for_review(df).count() == 6


def test_label_tasks(spark):
    df = answers(spark, [("a", "a"), ("a", "b")]).withColumn("text", F.concat(F.lit("t"), "id"))
    tasks = annotate.label_tasks(annotate.finalize_annotations(annotate.reconcile(df)), "id").orderBy("id").collect()
    assert [t["id"] for t in tasks] == [1, 2]
    assert tasks[0]["predictions"][0]["result"][0]["value"]["choices"] == ["a"]
    assert tasks[1]["predictions"][0]["result"] == [] and tasks[1]["meta"]["review_reason"] == "pass_disagreement"


def test_dense_ids_follow_the_key(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "k").repartition(9)
    got = annotate.dense_ids(df, "k").orderBy("k").select("id").collect()
    assert [r["id"] for r in got] == list(range(1, len(got) + 1))


def test_existing_labels_stay(spark):
    original = spark.createDataFrame([(1, "x"), (2, None), (3, " nan ")], "id int, label string")
    annotated = original.select("id", F.lit("m").alias("annotation_label"))
    got = {r["id"]: r["label"] for r in annotate.keep_existing_labels(annotated, original, "id").collect()}
    assert got == {1: "x", 2: None, 3: None}
    assert "kind" in annotate.keep_existing_labels(annotated, annotated.select("id"), "id", "kind").columns


def test_transform_rows_answers_in_slices(spark, monkeypatch):
    """A batch of long rows is never a list of Python strings as a whole, and rows keep their places."""
    cut, plain = [], batches.sliced_array

    def counted(texts):
        for part in plain(texts):
            cut.append(len(part))
            yield part

    monkeypatch.setattr(annotate, "sliced_array", counted)
    taken, udf = [], annotate.F.arrow_udf
    monkeypatch.setattr(annotate.F, "arrow_udf", lambda f, kind: taken.append(f) or udf(f, kind))
    df = spark.createDataFrame([(1, "a")], "id bigint, text string")
    annotate.transform_rows(df, lambda row: {"size": len(row["text"])} if row["id"] % 2 else None, "size bigint")
    rows = [json.dumps({"id": i, "text": "x" * 500_000}) for i in range(20)] + ["{", None]
    got = taken[0](pa.array(rows))
    assert len(cut) > 4 and max(cut) <= 6 and sum(cut) == 22
    assert got.field("known").to_pylist() == [None, '{"size": 500000}'] * 10 + [None, None]
    assert taken[0](pa.array([], pa.string())).to_pylist() == []


def test_transform_rows(spark):
    df = spark.createDataFrame(
        [(1, "Hello", "en"), (2, "Salut", "fr"), (3, "Bye", "en"), (4, "x", "bad"), (5, "y", "list")],
        "id bigint, text string, lang string",
    )

    def change(row):
        if row["lang"] == "bad":
            raise ValueError
        if row["lang"] == "list":
            return "[1]"
        if row["lang"] == "en":
            return '```json\n{"text": null, "size": %d}\n```' % len(row["text"])
        return None

    got = {r["id"]: (r["text"], r["lang"], r["size"]) for r in annotate.transform_rows(df, change, "size int").collect()}
    assert got == {1: (None, "en", 5), 2: ("Salut", "fr", None), 3: (None, "en", 3), 4: ("x", "bad", None), 5: ("y", "list", None)}


def test_examples_and_spec(spark):
    df = spark.createDataFrame([(i, f"t{i}", "p" if i % 2 else "n") for i in range(9)], "id int, text string, label string")
    spec = annotate.annotation_spec(df, "id", [{"name": "p", "keywords": ["k"]}, {"name": "q", "examples": ["e"]}])
    got = {r["label"]: r["examples"] for r in spec.collect()}
    assert got == {"p": ["t1", "t3", "t5"], "q": ["e"]}


def test_kappa(spark):
    def kappa(pairs):
        df = spark.createDataFrame(pairs, "a string, b string")
        row = agreement.pairwise_agreement(df, "a", "b").first()
        return row["compared"], row["agreement_rate"], row["kappa"]

    assert kappa([("x", "x")]) == (1, 1.0, None)
    assert kappa([(None, "x")]) == (0, None, None)
    assert kappa([("x", "x")] * 3) == (3, 1.0, 1.0)
    pairs = [("x", "x"), ("y", "y"), ("x", "y"), ("y", "y")]
    assert kappa(pairs)[2] == pytest.approx(0.5)
    assert kappa([(b, a) for a, b in pairs])[2] == pytest.approx(0.5)


def test_supports_agreement(spark):
    def ok(values):
        return agreement.supports_agreement(spark.createDataFrame([(v,) for v in values], "label string")).first()[0]

    assert ok(["a", "b", "a"]) and not ok(["a"]) and not ok(["1", "2", "3"]) and not ok([f"v{i}" for i in range(12)])
    assert not agreement.supports_agreement(spark.range(1), "label").first()[0]


def test_annotation_quality_of_nothing(spark):
    df = annotate.finalize_annotations(annotate.reconcile(answers(spark, []))).where("false")
    got = {r["metric"]: r["value"] for r in agreement.annotation_quality(df).collect()}
    assert got["review_rate"] == 0.0 and got["confidence_mean"] == 0.0 and got["intra_kappa"] is None


def test_scores(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "é")], "id int, text string")
    for strategy in ("entropy", "anything"):
        got = [r["score"] for r in active.with_score(df, "id", "text", strategy).orderBy("id").collect()]
        assert got == pytest.approx([2 / 3, 0.0, 0.0, 0.0], abs=1e-6)
    sized = spark.createDataFrame([(1, "aaaa"), (2, "a"), (3, "aaaaaaa")], "id int, text string")
    got = [r["score"] for r in active.with_score(sized, "id", "text", "margin").orderBy("id").collect()]
    assert got == pytest.approx([1.0, 0.25, 0.25])


def test_query_ranks_and_enrichment(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(10)], "id int, score double")
    batch = active.query_batch(df, "id", batch_size=4)
    got = batch.orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in got] == [(1, 2), (2, 5), (3, 8), (4, 1)]
    full = active.enrich_queries(df, batch, "id", "label", ["text"])
    assert full.count() == 10 and full.where("active_learning_selected").count() == 4


@pytest.mark.parametrize(
    ("sizes", "test_size", "expected"),
    [
        ({"a": 3, "b": 2}, 0.25, {"a": 0, "b": 0}),
        ({"a": 5, "b": 5}, 0.25, {"a": 1, "b": 1}),
        ({"a": 9, "b": 1}, 0.9, {"a": 8, "b": 0}),
        ({"a": 10, "b": 10}, 0.3, {"a": 3, "b": 3}),
        ({"a": 7, "b": 2, "c": 1}, 0.3, {"a": 2, "b": 1, "c": 0}),
    ],
)
def test_stratified_split(spark, sizes, test_size, expected):
    rows = [(f"{label}{i}", label) for label, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id string, label string")
    split = active.stratified_split(df, "id", "label", test_size).collect()
    assert len(split) == len(rows) and {r["id"] for r in split} == {r[0] for r in rows}
    got = {label: sum(r["split"] == "val" and r["label"] == label for r in split) for label in sizes}
    assert got == expected


def test_split_needs_two_classes(spark):
    df = spark.createDataFrame([(str(i), "a") for i in range(8)], "id string, label string")
    with pytest.raises(Exception, match="two classes"):
        active.stratified_split(df, "id", "label").collect()
    with pytest.raises(Exception, match="two classes"):
        active.class_check(df, "label").collect()


@pytest.mark.parametrize("strategy", ["entropy", "random", "margin"])
def test_cycle_counts(spark, strategy):
    labeled = spark.createDataFrame([(i, f"t {i}") for i in range(6)], "id int, text string")
    pool = spark.createDataFrame([(10 + i, "w " * (i + 1)) for i in range(4)], "id int, text string")
    history, acquired = active.run_cycle(labeled, pool, "id", "text", strategy, n_iterations=5, batch_size=2)
    assert [r["n_labeled"] for r in history.orderBy("iteration").collect()] == [6, 8, 10]
    got = acquired.collect()
    assert sorted(r["id"] for r in got) == [10, 11, 12, 13]
    assert sorted((r["iteration"], r["rank"]) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_infer_features(spark):
    df = spark.createDataFrame(
        [(i, "a long enough problem text", "notes that are long too", "x", True) for i in range(3)],
        "id int, text string, notes string, code string, flag boolean",
    )
    got = {r["column"]: r["selected"] for r in active.infer_features(df, "solve the problem", "id").collect()}
    assert got == {"text": True, "notes": False}


def test_compose_text(spark):
    df = spark.createDataFrame([("a", None, True)], "t string, u string, b boolean")
    assert df.select(active.compose_text(df, ["t", "u", "b"], " p ")).first()[0] == "Task: p\na\nTrue"
    assert df.select(active.compose_text(df, ["t"], "")).first()[0] == "a"


def test_loss_history(spark):
    good = '{"loss_history": [{"epoch": 5, "train_loss": 1, "val_loss": 2}, {"train_loss": 1}, {"train_loss": 3, "val_loss": 4}]}'
    df = spark.createDataFrame([(1, good)], "run int, m string")
    assert [tuple(r)[1:] for r in active.loss_history(df, "m", "run").collect()] == [(3, 3.0, 4.0), (5, 1.0, 2.0)]
    bad = spark.createDataFrame([(1, '{"loss_history": []}')], "run int, m string")
    with pytest.raises(Exception, match="malformed"):
        active.loss_history(bad, "m", "run").collect()


def test_training_and_curve(spark):
    words = {"a": "red green blue", "b": "one two three"}
    rows = [(i, f"{words[c]} {i}", c) for i, c in enumerate("ab" * 20)]
    df = spark.createDataFrame(rows, "id int, text string, label_text string")
    train, val = df.where("id < 30"), df.where("id >= 30")
    losses = training.training_losses(train, val, epochs=3, features=64).orderBy("epoch").collect()
    assert losses[-1]["train_loss"] < losses[0]["train_loss"]
    model = training.train_classifier(train, features=64)
    quality = training.evaluate(training.predict(model, val), "label_text", "prediction_text").first()
    assert tuple(quality) == (10, 1.0, 1.0)
    scored = training.uncertainty_scores(training.predict(model, val)).first()
    assert 0 <= scored["margin"] <= 1 and scored["entropy"] >= 0
    curve = training.learning_curve(
        df.where("id < 6"), df.where("id >= 6 AND id < 30"), val, "id", n_iterations=2, batch_size=4, epochs=2, features=64
    )
    assert sorted((r["strategy"], r["n_labeled"]) for r in curve.collect()) == [
        ("entropy", 6),
        ("entropy", 10),
        ("random", 6),
        ("random", 10),
    ]
    saved = training.labels_saved(curve).first()
    assert saved["base_labels"] is not None


def plain_losses(train, val, epochs, features):
    """The same training with dense rows."""
    labels = sorted({c for _, c in train})

    def dense(texts):
        x = np.zeros((len(texts), features + 1))
        for row, text in zip(x, texts):
            for t in re.findall("[a-z0-9]+", (text or "").lower()):
                row[zlib.crc32(t.encode()) % features] += 1
            row /= np.linalg.norm(row) or 1
            row[-1] = 1
        return x

    def soft(x, w):
        e = np.exp(x @ w.T)
        return e / e.sum(axis=1, keepdims=True)

    def loss(x, y, w):
        p = soft(x, w)
        return np.mean([-np.log(max(p[i, labels.index(c)] if c in labels else 0, 1e-15)) for i, c in enumerate(y)])

    x, y = dense([t for t, _ in train]), [c for _, c in train]
    hot = np.array([[float(c == k) for k in labels] for c in y])
    shrink = np.append(np.full(features, training.PENALTY), 0)
    curve = 0.5 * (x * x.sum(axis=1, keepdims=True)).mean(axis=0) + shrink
    w = ahead = np.zeros((len(labels), features + 1))
    pace, out = 1.0, []
    for _ in range(epochs):
        new = ahead - ((soft(x, ahead) - hot).T @ x / len(x) + shrink * ahead) / np.maximum(curve, 1e-12)
        more = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead, w, pace = new + (pace - 1) / more * (new - w), new, more
        out.append((loss(x, y, w), loss(dense([t for t, _ in val]), [c for _, c in val], w)))
    return out


def test_losses_equal_training_on_dense_rows(spark):
    rng = random.Random(6)
    rows = [(" ".join(rng.choices([f"{c}{i}" for i in range(12)] + ["and", "the"], k=rng.randrange(1, 30))), c) for c in "abc" * 40]
    rows += [("", "a"), (None, "b"), ("the " * 3000, "c")]
    rng.shuffle(rows)
    train, val = rows[:90], [*rows[90:], ("a1 a2", "never seen")]
    frames = [spark.createDataFrame(x, "text string, label_text string").repartition(5) for x in (train, val)]
    got = training.training_losses(*frames, epochs=4, features=64).orderBy("epoch").collect()
    want = plain_losses(train, val, 4, 64)
    assert [tuple(r) for r in got] == [(e, pytest.approx(a, abs=1e-9), pytest.approx(b, abs=1e-9)) for e, (a, b) in enumerate(want, 1)]
    # Sums do not depend on how rows are dealt.
    again = training.training_losses(frames[0].repartition(2), frames[1].coalesce(1), epochs=4, features=64)
    assert [r["train_loss"] for r in again.orderBy("epoch").collect()] == pytest.approx([r["train_loss"] for r in got], abs=1e-12)


def test_training_goes_on_where_it_stopped(spark):
    rows = [(f"{c} word{i % 5}", c) for i, c in enumerate("ab" * 30)]
    df = spark.createDataFrame(rows, "text string, label_text string")
    whole = training.train_classifier(df, epochs=6, features=32)
    slots = training.vectors(df, ["a", "b"], 32).withColumn("val", F.lit(False))
    half = training.train_more(training.untrained(["a", "b"], 32), slots, 3)
    assert np.allclose(training.train_more(half, slots, 3).weights, whole.weights, atol=1e-12)
    scored = training.predict(whole, spark.createDataFrame([("a", 1), (None, 2), ("b zz", 3)], "text string, probability_of int"))
    assert scored.columns == ["text", "probability_of", "prediction_text", "probability"]
    assert [r["prediction_text"] for r in scored.collect()][::2] == ["a", "b"]
    assert all(abs(sum(r["probability"]) - 1) < 1e-12 for r in scored.collect())


def test_training_makes_one_pass_an_epoch(spark, monkeypatch):
    passes = []
    plain = training._sums
    monkeypatch.setattr(training, "_sums", lambda *args: passes.append(1) or plain(*args))
    df = spark.createDataFrame([("a b", "x"), ("c", "y")] * 9, "text string, label_text string")
    training.train_classifier(df, epochs=3, features=16)
    assert len(passes) == 3
    training.training_losses(df, df, epochs=3, features=16)
    assert len(passes) == 7


def test_summary(spark):
    df = spark.createDataFrame([("x", True), ("y", None), (None, None)], "label string, active_learning_selected boolean")
    assert tuple(active.al_summary(df, "label", "entropy").first()) == (2, 1, 1, 2, "entropy")


def test_tasks_ask_an_annotator_once_per_row(spark):
    asked = spark.sparkContext.accumulator(0)

    def annotator(payloads):
        asked.add(len(payloads))
        return ['{"label": "a"}'] * len(payloads)

    rows = spark.range(40).selectExpr("id", "concat('text ', id) AS text")
    done = annotate.annotate_pass(rows, "text", annotator, "p")
    done = done.withColumns({"annotation_label": F.get_json_object("p_raw", "$.label"), "annotation_confidence": F.lit(1.0)})
    fixed = {"annotation_needs_review": False, "annotation_label_origin": "agreed", "annotation_compare_status": "ok"}
    done = done.withColumns({c: F.lit(v) for c, v in (fixed | {annotate.ANSWER_1: "a", annotate.ANSWER_2: "a"}).items()})
    tasks = annotate.label_tasks(done, "id").orderBy("id").collect()
    assert [t["id"] for t in tasks] == list(range(1, 41)) and tasks[7]["data"]["text"] == "text 7"
    assert asked.value == 40


def test_task_columns(spark):
    rows = [(i, f"a long enough text number {i}", "en", None if i < 15 else "word " * 9, "x") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, body string, lang string, title string, annotation_label string")
    assert active.select_task_columns(df, "Rate the body", "id") == (["body"], "annotation_label")
    assert active.select_task_columns(df, "Rate the title", "id")[0] == ["title"]
    assert active.select_task_columns(df, "Rate", "id", ["lang", "none"], "body") == (["lang"], "body")
    for options in ({"prompt": ""}, {"features": ["none"]}, {"target": "none"}):
        with pytest.raises(ValueError):
            active.select_task_columns(**{"df": df, "prompt": "Rate the body", "key": "id"} | options)
    with pytest.raises(ValueError):
        active.select_task_columns(df.drop("annotation_label"), "Rate the body", "id")
    with pytest.raises(ValueError):
        active.select_task_columns(df.select("id", "lang", "annotation_label"), "Rate", "id")


def test_annotation_quality_of_no_and_empty_rows(spark):
    schema = "id int, label string, annotation_auto_label_pass_1 string, annotation_auto_label_pass_2 string, annotation_label string, annotation_confidence double, annotation_needs_review boolean"
    for rows in ([], [(1, None, None, " None ", None, None, None)]):
        got = {(r["metric"], r["column"]): r["value"] for r in agreement.annotation_quality(spark.createDataFrame(rows, schema)).collect()}
        assert got["intra_kappa", ""] is None and got["inter_agreement_rate", ""] is None
        assert got["review_count", ""] == 0 and got["confidence_mean", ""] == 0 and len(got) == 9
