import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import stats
from corpusmill.functions.text import normalize_text
from corpusmill.operators import clean, compare, detect, neardup, profile
from corpusmill.plans import strategy
from corpusmill.plans.chain import StageResult, chain, table_stage

ROWS = [
    (1, "Alpha text one.", "a", 10.0, "yes"),
    (2, "alpha TEXT one", "a", 12.0, None),
    (3, "  ", "b", None, None),
    (4, None, "b", 11.0, "no"),
    (5, "Beta text two", "b", 900.0, "yes"),
    (6, "Alpha text one.", "a", 10.0, "yes"),
]
SCHEMA = "id bigint, text string, source string, score double, label string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def values(df):
    return {(r["metric"], r["column"]): r["value"] for r in df.collect()}


def test_quantiles_are_exact(spark, monkeypatch):
    # A coarse sketch, so that the brackets really leave values out.
    monkeypatch.setattr(stats, "SKETCH_ACCURACY", 200)
    monkeypatch.setattr(stats, "_MARGIN", 4.0 / 200)
    rng = random.Random(5)
    data = [(rng.choice([None, float("nan"), rng.gauss(0, 1), 7.0, rng.expovariate(1e-6)]), rng.randrange(9)) for _ in range(4000)]
    df = spark.createDataFrame(data, "a double, b int").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["column"]: (r["n"], r["q"]) for r in stats.quantile_table(df, ["a", "b"], probs).collect()}
    clean_rows = df.where("a IS NOT NULL AND NOT isnan(a)")
    wanted = clean_rows.agg(F.percentile("a", F.array(*map(F.lit, probs)))).first()[0]
    assert got["a"][0] == clean_rows.count() and got["a"][1] == pytest.approx(wanted, rel=1e-12)
    assert got["b"][1] == pytest.approx(df.agg(F.percentile("b", F.array(*map(F.lit, probs)))).first()[0])


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert stats.quantile_table(df, ["a"], [0.5]).count() == 0
    assert clean.clip_iqr(df).first()["a"] is None and clean.impute_median(df).first()["a"] is None


def test_missing(rows, spark):
    assert values(detect.detect_missing(rows))[("total", "")] == 4
    worded = spark.createDataFrame([("N/A",), (" None ",), ("x",), (None,)], "v string")
    assert values(detect.detect_missing(worded))[("by_column", "v")] == 1
    assert values(detect.detect_missing(worded, sentinels=True))[("by_column", "v")] == 3


def test_duplicates(rows):
    assert detect.detect_duplicate_rows(rows, {"id"}).first()["duplicate_rows"] == 1
    assert detect.detect_duplicate_rows(rows).first()["duplicate_rows"] == 0
    assert tuple(detect.detect_duplicate_text(rows).first()) == (4, 2, 2)
    assert detect.detect_duplicate_text(rows, normalized=False).first()["duplicate_text_rows"] == 1


def test_equal_nulls_are_duplicates(spark):
    df = spark.createDataFrame([(1, None, {"a": 1, "b": 2}), (2, None, {"b": 2, "a": 1})], "k int, v string, m map<string,int>")
    assert detect.detect_duplicate_rows(df, {"k"}).first()["duplicate_rows"] == 1
    assert clean.drop_duplicate_rows(df, "k").first()["k"] == 1


def test_outliers_and_fences(rows):
    got = values(detect.outliers_iqr(rows, ["score"]))
    assert got[("iqr_count", "score")] == got[("iqr_total", "")] == 1
    clipped = {r["id"]: r["score"] for r in clean.clip_iqr(rows, ["score"]).collect()}
    assert clipped[5] == got[("iqr_upper", "score")] and clipped[3] is None and clipped[1] == 10.0
    assert {r["id"] for r in clean.drop_iqr(rows, ["score"]).collect()} == {1, 2, 3, 4, 6}


def test_imbalance_and_semantics(spark):
    labels = spark.createDataFrame([(str(i),) for i in range(1, 31)] + [(None,)] * 5, "label string")
    assert detect.label_semantics(labels).first()["kind"] == "regression"
    got = values(detect.detect_imbalance(labels))
    assert got[("applicable", "label")] == 0 and got[("majority_share", "label")] is None
    few = spark.createDataFrame([("x",)] * 3 + [("y",)], "target string")
    got = values(detect.detect_imbalance(few))
    assert got[("majority_share", "target")] == 0.75 and got[("is_imbalanced", "target")] == 1


def test_text_profile(rows):
    got = values(detect.text_profile(rows))
    assert got[("empty_rows", "")] == 2 and got[("truncated_rows", "")] == 2
    assert got[("duplicate_text_rows", "")] == 2 and got[("near_empty_rows", "")] == 0


def test_sparsity_separates_unlabelled_rows(spark):
    df = spark.createDataFrame(
        [("t", None, "s", "x"), (None, "l", "s", "x"), ("t", None, None, None), ("t", "l", "s", "x")],
        "text string, label string, a string, b string",
    )
    got = {r["bucket"]: r["rows"] for r in detect.sparsity_profile(df).collect()}
    assert got == {"informative_unlabeled": 1, "no_content": 1, "sparse": 1, "complete": 1}
    assert clean.drop_sparse_rows(df).count() == 2


def test_richest_row_is_kept(spark):
    df = spark.createDataFrame(
        [(1, "A b", None, "{}"), (2, "a  B!", "y", None), (3, "a b", "y", '{"long":1}'), (4, " ", None, None), (5, None, None, None)],
        "id int, text string, label string, metadata string",
    )
    assert sorted(r["id"] for r in clean.dedup_text_keep_richest(df, "id").collect()) == [3, 4, 5]
    math = spark.createDataFrame([(1, "1+1"), (2, "1-1")], "id int, text string")
    assert clean.dedup_text_keep_richest(math, "id").count() == 1
    assert clean.dedup_text_keep_richest(math, "id", keep_math=True).count() == 2


def test_impute_mode_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    assert df.transform(clean.impute_mode, ["v"]).where("v = 'a'").count() == 3


def test_fix_protects_label_and_is_idempotent(spark):
    df = spark.createDataFrame(
        [(i, f"text {i}", float(i % 5), 100.0 if i == 7 else 1.0) for i in range(20)] + [(20, "text 20", None, None)],
        "id bigint, text string, x double, label double",
    )
    options = {"missing": "mean", "outliers": None}
    once = clean.fix(df, "id", options)
    assert once.where("id = 7").first()["label"] == 100.0 and once.where("id = 20").first()["label"] is None
    assert once.where("id = 20").first()["x"] == pytest.approx(2.0)
    twice = clean.fix(once, "id", options)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    with pytest.raises(ValueError):
        clean.fix(df, "id", {"missing": "guess"})


def test_compare_with_itself_has_no_delta(rows):
    same = compare.compare(rows, rows, "id", "text", "label")
    assert same.where("delta <> 0").count() == 0
    directions = {r["direction"] for r in compare.delta_direction(same).collect()}
    assert directions <= {"unchanged", "not available"}


def test_delta_direction(spark):
    pairs = [(2.0, 0.0), (0.0, 1.0), (1.0, 1.0), (None, 1.0)]
    left = spark.createDataFrame([("s", str(i), "", b) for i, (b, _) in enumerate(pairs)], "section string, metric string, column string, value double")
    right = spark.createDataFrame([("s", str(i), "", a) for i, (_, a) in enumerate(pairs)], left.schema)
    got = compare.delta_direction(compare.compare_reports(left, right)).orderBy("metric").collect()
    assert [(r["direction"], r["amount"]) for r in got] == [
        ("improved", 2.0),
        ("increased", 1.0),
        ("unchanged", 0.0),
        ("not available", None),
    ]


def test_retention_and_stage_metrics(rows):
    after = clean.drop_empty_text(rows)
    got = {r["bucket"]: (r["kept"], r["dropped"]) for r in compare.compare_retention(rows, after, "id").collect()}
    assert got == {"complete": (3, 0), "informative_unlabeled": (1, 0), "no_content": (0, 2)}
    metrics = compare.stage_metrics(compare.compare(rows, after, "id", "text", "label")).first()
    assert metrics["row_count"] == 4 and metrics["missing_total_after"] == 1


def test_actions(rows):
    with pytest.raises(ValueError, match="polish"):
        strategy.apply_actions(rows, {"text_actions": ["polish"]}, "id")
    out = strategy.apply_actions(
        rows.withColumn("audio", F.lit(None).cast("string")),
        {
            "row_actions": ["drop_exact_duplicates", "keep_only_rows_with_text", "drop_sparse_rows"],
            "column_actions": ["drop_audio_column", "drop_all_null_optional_columns"],
            "text_actions": ["trim_text"],
            "label_actions": ["validate_solution_format_consistency", "split_supervised_subset_without_discarding_raw_rows"],
        },
        "id",
    )
    assert out.count() == 3 and "audio" not in out.columns
    assert out.where("label_format_mismatch").count() == 0 and out.where("in_supervised_subset").count() == 2


def test_recommended_strategy(rows):
    advice = strategy.recommend_strategy(
        detect.quality_report(rows, "id", "text", "label"), {"row_actions": ["drop_exact_duplicates"]}
    )
    assert {r["option"] for r in advice.collect()} == {"retain", "supervised_only", "configured"}
    blocks = strategy.strategy_of(advice)
    assert "drop_rows_missing_label" not in blocks.get("row_actions", [])
    assert strategy.apply_actions(rows, blocks, "id").count() == 2


def test_findings_skip_zero_counts(spark):
    df = spark.createDataFrame([(1, "One thing."), (2, "Another thing.")], "id int, text string")
    lines = [r["finding"] for r in detect.findings(detect.quality_report(df, "id")).orderBy("position").collect()]
    assert lines[0] == "0 cells have no value" and not any("without text" in x for x in lines)


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([("a b",), ("c d",)], "text string")
    bars = {r["bin"]: r["rows"] for r in profile.length_histogram(df).collect()}
    assert len(bars) == 30 and bars[15] == 2


def test_profile_sections(spark):
    df = spark.createDataFrame([(None, "t", None)], "label string, text string, source string")
    got = [r["section"] for r in profile.recommended_sections(df).orderBy("position").collect()]
    assert got == ["overview", "missingness", "text_length_distribution"]
    assert profile.profile_source(df).count() == 0
    assert profile.boxplot_stats(spark.createDataFrame([(1,)], "label int"), modality="text").count() == 0


def brute_force(rows, threshold=0.8):
    sets = {r["k"]: set(neardup.shingles(r["t"]).tolist()) for r in rows if r["t"]}
    keys, found = sorted(sets), set()
    for i, later in enumerate(keys):
        for earlier in keys[:i]:
            shared = len(sets[later] & sets[earlier])
            if shared / (len(sets[later]) + len(sets[earlier]) - shared) >= threshold:
                found.add(later)
                break
    return found


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    # Small blocks, so that lists have several.
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(25):
            changed = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            texts.append(" ".join(changed))
    texts += ["", None, "short one", "Short  one!", "w1"]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = neardup.near_duplicates(df, "doc_id").collect()
    wanted = brute_force(df.select(F.col("doc_id").alias("k"), normalize_text(F.col("text")).alias("t")).collect())
    assert {r["doc_id"] for r in got} == wanted and len(got) == len(wanted)


def test_near_duplicates_of_the_documents_match_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = df.select(F.col("doc_id").alias("k"), normalize_text(F.col("text")).alias("t")).collect()
    got = neardup.near_duplicates(df, "doc_id").collect()
    # Brute force with an inverted list per run, whole lists.
    sets = {r["k"]: set(neardup.shingles(r["t"]).tolist()) for r in rows if r["t"]}
    lists, found = {}, set()
    for later in sorted(sets):
        shared = collections.Counter(k for run in sets[later] for k in lists.get(run, ()))
        if any(n / (len(sets[k]) + len(sets[later]) - n) >= 0.8 for k, n in shared.items()):
            found.add(later)
        for run in sets[later]:
            lists.setdefault(run, []).append(later)
    assert {r["doc_id"] for r in got} == found and len(got) == len(found)


def template_rows(spark, n, own):
    """Rows of one template, each with words of its own: all pairs just below the threshold."""
    rng = random.Random(9)
    texts = []
    for i in range(n):
        words = [f"w{k}" for k in range(150)]
        for k in rng.sample(range(150), own):
            words[k] = f"own{i}x{k}"
        texts.append((i, " ".join(words)))
    return spark.createDataFrame(texts, "doc_id bigint, text string")


def test_rows_of_a_template_below_the_threshold_make_rows_in_proportion(spark, monkeypatch):
    met = []
    plain = neardup._in_blocks

    def counted(sets, lists, still_open, key, threshold):
        met.append(lists.count())
        return plain(sets, lists, still_open, key, threshold)

    monkeypatch.setattr(neardup, "_in_blocks", counted)
    for n in (100, 200, 400):
        assert neardup.near_duplicates(template_rows(spark, n, 5), "doc_id").count() == 0
    assert met[1] <= 2.5 * met[0] and met[2] <= 2.5 * met[1] and met[2] < 400 * 60


def leading(spark, sets):
    """Rows by run of the leading lists, without those that can match nothing."""
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "doc_id bigint, runs array<bigint>")
    lists = collections.defaultdict(set)
    for r in neardup._leading_runs(df, "doc_id", 0.8).where("enough").collect():
        lists[r["run"]].add(r["doc_id"])
    return lists


def test_a_shared_text_makes_one_list(spark):
    shared = range(100)
    # 13 of the shared runs lead in each row.
    lists = leading(spark, [{*shared, *range(1000 * i, 1000 * i + 10)} for i in range(1, 7)])
    assert list(lists.values()) == [{0, 1, 2, 3, 4, 5}]
    # Rows that share a passage too short for the threshold meet nowhere.
    assert not leading(spark, [{*range(5), *range(1000 * i, 1000 * i + 10), *range(50, 100)} for i in (1, 2)])


def test_similar_sets_of_all_sizes_share_a_list(spark):
    rng = random.Random(5)
    sets = []
    for family in range(12):
        base = [1000 * family + k for k in range(rng.choice([5, 20, 60]))]
        # Parts of one another down to the threshold, some with runs of their own or of other families.
        for _ in range(12):
            part = set(rng.sample(base, rng.randint(-(-8 * len(base) // 10), len(base))))
            sets.append(part | set(rng.sample(range(10**6), rng.choice([0, 0, 1, 3]))) | set(rng.sample(range(4), rng.choice([0, 2]))))
    lists = leading(spark, sets)
    met = {pair for rows in lists.values() for pair in itertools.combinations(sorted(rows), 2)}
    similar = {
        (i, j) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if len(a & b) >= 0.8 * len(a | b)
    }
    assert len(similar) > 100 and similar <= met


def test_sets_are_made_only_for_rows_that_share_a_bucket(spark, monkeypatch):
    made = []
    plain = neardup._leading_runs

    def counted(sets, key, threshold):
        made.append(sets.count())
        return plain(sets, key, threshold)

    monkeypatch.setattr(neardup, "_leading_runs", counted)
    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(50)]
    texts += [texts[0] + " more", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(neardup.near_duplicates(df, "doc_id").collect()) == [(50, "near"), (51, "copy")]
    assert made == [2]


def test_reached_counts_earlier_rows_only():
    sets = [np.array([1, 2, 3, 4, 5]), np.array([1, 2, 3, 4, 5]), np.array([1, 2, 3, 4, 9]), np.array([7]), np.array([1, 2, 3, 4])]
    keys, every = np.array([10, 20, 5, 40, 1]), np.arange(5)
    assert neardup._reached(sets, every, every, keys, 0.8).tolist() == [True, True, True, False, False]
    assert neardup._reached(sets, every, every, keys, 0.9).tolist() == [False, True, False, False, False]


def test_one_text_in_a_third_of_all_rows(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "the same text in very many rows").otherwise(F.concat(F.lit("text number "), "id")).alias("text"),
    )
    got = neardup.near_duplicates(df, "doc_id")
    assert got.count() == 999 and got.where("kind = 'copy'").count() == 999
    assert clean.dedup_text_keep_richest(df, "doc_id").count() == 2001


def test_chain(rows):
    with pytest.raises(ValueError):
        chain(rows, [])
    stages = [table_stage("x", clean.drop_empty_text), table_stage("x", clean.drop_rows_missing_label)]
    done = chain(rows, stages)
    assert isinstance(done, StageResult) and done.df.count() == 3
    assert [(r["section"], r["value"]) for r in done.metrics.collect()] == [("x", 3.0)]


def test_modes_of_all_columns_in_one_grouping(spark):
    rows = [(1, "b", 1.0, None, "x"), (2, "b", 2.0, "only", None), (3, "a", 2.0, None, "y"), (4, "a", None, None, "y"), (5, None, float("nan"), None, "x")]
    df = spark.createDataFrame(rows, "id long, tied string, number double, single string, two string")
    got = {r["id"]: tuple(r)[1:] for r in clean.impute_mode(df, df.columns, ["id"]).collect()}
    assert got[5] == ("a", 2.0, "only", "x") and got[2] == ("b", 2.0, "only", "x") and got[4] == ("a", 2.0, "only", "y")
    alone = spark.createDataFrame([(3, "c"), (1, "a"), (None, None)], "n int, t string")
    assert sorted(tuple(r) for r in clean.impute_mode(alone, ["n", "t"]).collect()) == [(1, "a"), (1, "a"), (3, "c")]
    empty = spark.createDataFrame([(None, None)], "n int, t string")
    assert [tuple(r) for r in clean.impute_mode(empty, ["n", "t"]).collect()] == [(None, None)]


@pytest.mark.parametrize("missing", ["median", "mean", "mode", "drop", "keep"])
@pytest.mark.parametrize("outliers", ["clip_iqr", "drop_iqr", "keep"])
def test_fix_equals_its_steps(spark, missing, outliers):
    rows = [(i, f"text {i % 37}", float(i % 11) if i % 5 else None, 1000.0 if i % 50 == 0 else float(i % 7), "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string, a double, b double, label string")
    got = clean.fix(df, "id", {"missing": missing, "outliers": outliers})
    want = clean.drop_duplicate_rows(df, "id")
    if missing in ("median", "mean"):
        want = (clean.impute_median if missing == "median" else clean.impute_mean)(want, ["a", "b"])
    elif missing == "mode":
        want = clean.impute_mode(want, df.columns, ["id", "label"])
    elif missing == "drop":
        want = clean.drop_missing(want)
    if outliers != "keep":
        want = (clean.clip_iqr if outliers == "clip_iqr" else clean.drop_iqr)(want, ["a", "b"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_a_configured_strategy_is_listed_only_when_it_differs(rows):
    report = detect.quality_report(rows, "id")
    told = strategy.recommend_strategy(report)
    blocks = strategy.strategy_of(told)
    options = lambda configured: {r["option"] for r in strategy.recommend_strategy(report, configured).collect()}
    assert options(blocks) == {"retain", "supervised_only"}
    assert options({**blocks, "label_actions": []}) == {"retain", "supervised_only", "configured"}
    assert options({"row_actions": ["drop_exact_duplicates"]}) == {"retain", "supervised_only", "configured"}


def test_comparison_reads_both_tables_once_and_keeps_their_columns_apart(spark):
    before = spark.createDataFrame([(1, "a", 1.0, None), (2, "a", 2.0, None), (3, None, 900.0, None)], "id int, text string, n double, gone string")
    after = before.where("id < 3").drop("gone").withColumn("more", F.lit(5))
    rows = {(r["section"], r["metric"], r["column"]): (r["before"], r["after"], r["delta"]) for r in compare.compare(before, after, "id").collect()}
    assert rows["table", "row_count", ""] == (3, 2, 1) and rows["table", "column_count", ""] == (4, 4, 0)
    assert rows["missing", "by_column", "gone"] == (3, None, None) and rows["missing", "by_column", "more"] == (None, 0, None)
    assert rows["text", "duplicate_text_rows", ""] == (1, 1, 0) and rows["text", "empty_rows", ""] == (1, 0, 1)
    empty = {(r["section"], r["metric"], r["column"]): r["after"] for r in compare.compare(before, before.limit(0), "id").collect()}
    assert empty["table", "row_count", ""] == 0 and empty["missing", "total", ""] == 0 and empty["duplicates", "rows", ""] == 0
