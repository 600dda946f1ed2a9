"""Operators over whole tables: near duplicates, mixing, toxicity, training order, nearest vectors."""

import collections
import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import components, minhash, mixing, nearest, toxicity, trainorder
from corpusmill.llm.bpe import Replay, public_vocabulary
from corpusmill.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()


# --------------------------------------------------------------------- near duplicates


def shingles(text, length=2):
    words = (text or "").encode().lower().split()
    if len(words) < length:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + length]) for i in range(len(words) - length + 1))


def groups(docs, length=2):
    """Smallest key of each component, by comparing all pairs of sets."""
    sets = {}
    for key, text in docs:
        sets.setdefault(shingles(text, length), key)
    names = [s for s in sets if s]
    root = {s: s for s in names}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(names):
        for b in names[:i]:
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = find(a), find(b)
                if x != y:
                    low, high = sorted((x, y), key=lambda s: sets[s])
                    root[high] = low
    return {k: sets[find(shingles(t, length))] if shingles(t) else k for k, t in docs}


def check_groups(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = groups(sorted(docs))
    got = {r.doc_id: r for r in minhash.near_duplicate_groups(df).collect()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(got[k].n_shingles == len(shingles(t)) for k, t in docs)
    assert all(r.kept == (r.component_id == k) for k, r in got.items())


def test_groups_of_templates_chains_and_short_texts(spark):
    rng = random.Random(11)
    docs = []
    for base in range(6):
        words = [f"b{base}x{i}" for i in range(rng.choice((9, 40, 150)))]
        for _ in range(30):
            own = list(words)
            for _ in range(rng.randrange(0, max(2, len(own) // 6))):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(own)))
    chain = [f"c{i}" for i in range(80)]
    for step in range(12):
        docs.append((len(docs), " ".join(chain[: 60 + step])))
        chain[step * 5] = f"d{step}"
    docs += [(len(docs) + i, t) for i, t in enumerate(("one", "ONE", "One two", "one two", "", "  ", "a b c", "a b c d e f"))]
    check_groups(spark, docs)


def test_short_texts_at_the_threshold_share_a_list():
    rng = random.Random(3)
    for _ in range(2000):
        words = [f"s{rng.randrange(10**6)}" for _ in range(6)]
        a, b = minhash._sets([" ".join(words).encode(), " ".join(words[:5]).encode()], 2)
        assert (len(a), len(b)) == (5, 4)
        assert len(np.intersect1d(minhash._runs(a), minhash._runs(b)))


def test_unions_up_to_the_sketch_share_a_list_at_the_threshold():
    rng = np.random.default_rng(6)
    for size in range(5, minhash.RETAINED + 1):
        union = np.unique(rng.integers(1, 1 << 63, size, dtype=np.uint64))
        for _ in range(400):
            lost = rng.permutation(size)[: size // 5]
            side = rng.random(len(lost)) < 0.5
            a, b = np.delete(union, lost[side]), np.delete(union, lost[~side])
            assert len(np.intersect1d(minhash._runs(a), minhash._runs(b)))


def test_bits_differ_no_more_than_the_sets(spark):
    """Pairs at the threshold always pass the filter; unlike short sets seldom do."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(3000):
        union = np.unique(rng.integers(1, 1 << 63, rng.integers(5, 400), dtype=np.uint64))
        lost = rng.permutation(len(union))[: len(union) // 5]
        side = rng.random(len(lost)) < 0.5
        sets = np.delete(union, lost[side]), np.delete(union, lost[~side])
        other = np.unique(np.append(rng.integers(1, 1 << 63, 20, dtype=np.uint64), union[:10]))
        for kind, (a, b) in enumerate((sets, (union[: len(other)], other))):
            rows.append((kind, len(a), len(b), minhash._bits(a).tolist(), minhash._bits(b).tolist()))
    df = spark.createDataFrame(rows, "kind int, a_n long, b_n long, a_bits array<bigint>, b_bits array<bigint>")
    told = dict(df.groupBy("kind").agg(F.avg(minhash._near("a_", "b_", 80).cast("int"))).collect())
    assert told[0] == 1.0 and told[1] < 0.05


def test_groups_of_five_and_six_words(spark):
    rng = random.Random(12)
    docs = []
    for i in range(120):
        words = [f"s{i}x{j}" for j in range(6)]
        texts = [words, words[:5], words[1:], [*words[:5], "end"]]
        docs += [(len(docs) + j, " ".join(t)) for j, t in enumerate(texts[: rng.randrange(2, 5)])]
    check_groups(spark, docs)


def test_large_group_below_the_threshold_makes_no_pairs(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(250):
        own = list(base)
        for j in rng.sample(range(120), 9):
            own[j] = f"n{i}x{j}"
        docs.append((i, " ".join(own)))
    check_groups(spark, docs)


def test_groups_of_the_documents(spark):
    docs = [(r.doc_id, r.text) for r in rows_of(spark, "documents")]
    want = groups(docs)
    got = {r.doc_id: r.component_id for r in QUERIES["op4_minhash_groups"](spark, FOLDER).collect()}
    assert got == want


def test_groups_of_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "x y z", 5), (3, "x y z", 5), (None, "x y z", 5), (None, "q", 5), (9, "X Y z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicate_groups(df).collect())
    assert got == collections.Counter(
        [(1, 1, True), (2, 2, True), (3, 3, True), (3, 3, True), (None, 3, False), (None, None, True), (9, 3, False)]
    )
    one = minhash.one_of_each(df)
    assert one.columns == df.columns
    assert sorted((r.doc_id or 0) for r in one.collect()) == [0, 0, 1, 2, 3]
    assert minhash.near_duplicate_groups(df.limit(0)).count() == 0


def test_repeated_keys_with_other_texts_make_one_set_each(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "z y x w"), (2, "A B C D E F g"), (2, "a b c d e f g h"), (3, "z y x w")]
    got = minhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1)}


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# ----------------------------------------------------------------------------- mixing


def filled(sizes, weights, total, cap):
    targets, left, open_ = {}, total, set(sizes)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > cap * sizes[s] + 1e-9}
        if not full:
            return targets | {s: level * weights[s] for s in open_}
        for s in full:
            targets[s] = cap * sizes[s]
            left -= targets[s]
        open_ -= full
    return targets


def test_mix_meets_its_targets(spark):
    docs = {r.doc_id: r for r in rows_of(spark, "documents")}
    rows = QUERIES["op9_source_mix"](spark, FOLDER).collect()
    sizes, taken, targets = collections.Counter(), collections.Counter(), {}
    largest = collections.Counter()
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == len((docs[r.doc_id].text or "").encode().split())
        assert r.taken in (0, r.size, 2 * r.size)
        sizes[s] += r.size
        taken[s] += r.taken
        targets[s] = r.target
        largest[s] = max(largest[s], r.size)
    order = sorted(sizes)
    want = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    for s in order:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], largest[s] / 2)
    again = QUERIES["op9_source_mix"](spark, FOLDER).collect()
    assert sorted(rows) == sorted(again)


def test_mix_of_odd_rows(spark):
    rows = [(i, "w " * (i % 50), ("b", "a", None)[i % 3], 1, 1) for i in range(600)]
    rows += [(None, "a b c", "a", 1, 1), (5, None, "c", 1, 1), (6, "", None, 1, 1), (6, "", None, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, target int")
    got = mixing.copies_for_weights(df).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 2 for r in got)
    assert all(r.copies == 0 and r.target == 0 for r in got if r.source_size == 0)
    total = collections.Counter()
    for r in got:
        total[r.source_size, r.target] += r.copies * r.size
    assert all(abs(v - t) <= 0.01 * t + 1 for (_, t), v in total.items())
    assert mixing.mix(df).columns == df.columns
    assert mixing.copies_for_weights(df.limit(0)).count() == 0


def test_hot_source_is_rounded_in_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 50)
    df = spark.range(2000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"),
    )
    got = mixing.copies_for_weights(df).groupBy("target").agg(F.sum(F.col("copies") * F.col("size")).alias("t")).collect()
    assert all(abs(r.t / r.target - 1) < 0.01 for r in got)


def test_mix_meets_a_second_margin(spark):
    """Words of each source over two classes as asked, though the sources have them otherwise."""
    rng = random.Random(7)
    rows = []
    for i in range(4000):
        source = "abc"[i % 3]
        kind = "long" if rng.random() < {"a": 0.3, "b": 0.5, "c": 0.6}[source] else "short"
        rows.append((i, "w " * (rng.randrange(60, 90) if kind == "long" else rng.randrange(50, 80)), source, kind))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kind string")
    asked = {"long": 0.4, "short": 0.6}
    got = mixing.copies_for_weights(df, share=1.0, weights=(1.0,), margin="kind", margin_shares=asked).collect()
    by, taken, target = {r[0]: r for r in rows}, collections.Counter(), {}
    for r in got:
        assert 0 <= r.copies <= 2
        taken[by[r.doc_id][2:]] += r.copies * r.size
        target[by[r.doc_id][2]] = r.target
    for s in "abc":
        whole = taken[s, "long"] + taken[s, "short"]
        assert whole == pytest.approx(target[s], rel=0.01)
        assert taken[s, "long"] / whole == pytest.approx(0.4, abs=0.02)
    # Uniform rates would not do.
    plain = {r.doc_id: r.copies for r in mixing.copies_for_weights(df, share=1.0, weights=(1.0,)).collect()}
    assert any(plain[r.doc_id] != r.copies for r in got)


def test_a_margin_that_cannot_be_met_is_an_error(spark):
    df = spark.createDataFrame([(i, "a b c", "s", "x" if i else "y") for i in range(50)], "doc_id long, text string, source string, kind string")
    with pytest.raises(mixing.Unbalanced):
        mixing.copies_for_weights(df, share=1.0, margin="kind", margin_shares={"x": 0.5, "y": 0.5})


# --------------------------------------------------------------------------- toxicity


def test_toxicity_learns_from_positives_alone(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(900):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        toxic = i % 8 == 0
        if toxic:
            words[:4] = ["bozo", "dimwit", f"grumpus{rng.randrange(9)}", "Bozo!"]
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame([*docs, (900, None, "en", "s"), (901, "", "en", "s"), (None, "bozo", "en", "s")],
                               "doc_id long, text string, lang string, score string")
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, known)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = {r.doc_id for r in df.where(toxicity.held_out(F.col("doc_id"))).collect()}
    toxic = [got[i] for i in held if i < 900 and i % 8 == 0]
    clean = [got[i] for i in held if i < 900 and i % 8]
    assert min(toxic) > 0.3 > max(clean) and got[900] == got[901] < 0.3
    flipped = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(df, flipped)
    assert np.array_equal(model.chosen, again.chosen) and np.allclose(model.weights, again.weights)


def test_features_are_counted_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "POSITIVES", 40)
    monkeypatch.setattr(toxicity, "UNLABELLED", 100)
    docs, labels = [], []
    for i in range(3000):
        toxic = i % 6 == 0
        rare = f" bozo{i // 6 % 25}" if toxic else ""
        docs.append((i, f"the text of row {i % 50}" + rare))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {toxicity._hash(f"bozo{j}") for j in range(25)} <= set(model.chosen.tolist())
    want = {r[0]: r[1:] for r in toxicity._frequency(df.withColumn("positive", F.col("doc_id") % 6 == 0)).collect()}
    for j in range(25):
        both = sum(t.split()[-1] == f"bozo{j}" for _, t in docs)
        assert want[np.array([toxicity._hash(f"bozo{j}")], np.uint64).view(np.int64)[0]] == (both, both)


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(df, toxicity.fit(df, none)).first().score < 0.3
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), none)).count() == 0


def test_negative_risk_never_runs_away():
    rng = np.random.default_rng(0)
    n, d = 300, 400
    dense = rng.random((2 * n, d)) < 0.05
    rows, cols = np.nonzero(dense[:n])
    urows, ucols = np.nonzero(dense[n:])
    weights, bias = toxicity.train((rows, cols, n), (urows, ucols, n), d, 0.2)
    z = bias + dense[n:] @ weights
    assert np.isfinite(weights).all() and np.mean(1 / (1 + np.exp(-z))) == pytest.approx(0.2, abs=1e-3)


# --------------------------------------------------------------------- training order


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(size):
    places = trainorder.Feistel(size, 9)
    slots = places.slot(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))
    assert np.array_equal(places.number(slots), np.arange(size))
    if size > 100:
        assert not np.array_equal(slots, trainorder.Feistel(size, 10).slot(np.arange(size)))
        assert abs(np.corrcoef(slots, np.arange(size))[0, 1]) < 0.2


def test_shards_hold_the_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trainorder, "SHARD_BYTES", 400)
    rng = random.Random(1)
    rows = [(i // 7, i % 7, [rng.randrange(60_000) for _ in range(rng.choice((0, 1, 9, 200)))], "x") for i in range(150)]
    rows += [(3, None, None, "x"), (None, 1, [10, 13, 10], "x"), (5, 5, [1], "x"), (5, 5, [1], "x")]
    df = spark.createDataFrame(rows, "conv long, turn int, ids array<int>, slot string")
    layout = trainorder.write_shards(df.repartition(5), str(tmp_path), ["conv", "turn"], length=16, end=7)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, np.array(r[2] or [], "<u2").tobytes()))
    stream = np.array([t for r in ordered for t in [*(r[2] or []), 7]], dtype="<u2")
    assert layout["tokens"] == len(stream) and layout["sequences"] == -(-len(stream) // 16)
    got = sorted(trainorder.read_slots(spark, str(tmp_path)).collect())
    assert [r.slot for r in got] == list(range(layout["sequences"])) and len({r.shard for r in got}) > 5
    for r in got:
        assert bytes(r.tokens) == stream[r.sequence * 16 : (r.sequence + 1) * 16].tobytes()
    assert sorted(trainorder.read_slots(spark, str(tmp_path), first=50).collect()) == got[50:]
    sizes = {p.stat().st_size for p in (tmp_path / "shards").glob("part-*")}
    assert all(s % layout["stride"] == 0 for s in sizes)


def test_training_order_of_the_conversations(spark):
    got = sorted(QUERIES["op8_training_order"](spark, FOLDER).collect())
    turns = sorted(rows_of(spark, "conversations"), key=lambda r: (r.conv_id, r.turn, r.role))
    ids = Replay(*public_vocabulary()).encode([r.text for r in turns])
    stream = np.concatenate([np.append(x, trainorder.END) for x in ids]).astype("<u2")
    assert [r.slot for r in got] == list(range(-(-len(stream) // trainorder.LENGTH)))
    for r in got:
        part = stream[r.sequence * trainorder.LENGTH : (r.sequence + 1) * trainorder.LENGTH]
        assert (r.n_tokens, r.ids_sha256) == (len(part), hashlib.sha256(part.tobytes()).hexdigest())


def test_training_order_of_the_documents(spark):
    got = sorted(QUERIES["training_order_documents"](spark, FOLDER).collect())
    docs = sorted(rows_of(spark, "documents"), key=lambda r: r.doc_id)
    ids = Replay(*public_vocabulary()).encode([r.text or "" for r in docs])
    stream = np.concatenate([np.append(x, trainorder.END) for x in ids]).astype("<u2")
    assert [r.slot for r in got] == list(range(-(-len(stream) // trainorder.LENGTH)))
    for r in got:
        part = stream[r.sequence * trainorder.LENGTH : (r.sequence + 1) * trainorder.LENGTH]
        assert (r.n_tokens, r.ids_sha256) == (len(part), hashlib.sha256(part.tobytes()).hexdigest())


def test_training_order_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "conv long, ids array<int>")
    assert trainorder.write_shards(df, str(tmp_path), ["conv"])["sequences"] == 0
    assert trainorder.read_slots(spark, str(tmp_path)).count() == 0


# -------------------------------------------------------------------- nearest vectors


def best(ids, x, q, k=20):
    score = (x * x[q]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]]
    return [(int(ids[i]), float(score[i])) for i in order[:k]]


def found(frame):
    got = collections.defaultdict(list)
    for r in frame.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


def test_nearest_of_the_embeddings(spark):
    rows = sorted(rows_of(spark, "embeddings"))
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = found(QUERIES["op10_nearest_vectors"](spark, FOLDER))
    asked = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    assert sorted(got) == sorted(ids[asked].tolist())
    hits = 0
    for i in asked:
        want = best(ids, x, i)
        hits += len({v for v, _ in want} & {v for v, _ in got[ids[i]]})
        assert all(s == pytest.approx(float(x[i] @ x[np.searchsorted(ids, v)]), abs=1e-12) for v, s in got[ids[i]])
    assert hits >= 0.9 * 20 * len(asked)


def test_nearest_of_many_cells_ties_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_ROWS", 100)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.2, 3, (1500, 1))
    x[300:800] = x[0]
    ids = np.arange(1500)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = found(nearest.nearest(df, F.col("vec_id") % 20 == 0))
    hits = total = 0
    for i in range(0, 1500, 20):
        want = best(ids, x, i)
        assert len(got[i]) == 20 and got[i] == sorted(got[i], key=lambda r: (-r[1], r[0]))
        hits += len({v for v, _ in want} & {v for v, _ in got[i]})
        total += 20
    assert hits >= 0.9 * total


def recall(spark, x, monkeypatch):
    """Recall of every twentieth row against brute force, and the share of rows verified."""
    seen = []
    plain = nearest.Scratch.store

    def stored(self, df, name="table"):
        out = plain(self, df, name)
        if name == "visits":
            seen.append(out.groupBy("cell").count().collect())
        return out

    monkeypatch.setattr(nearest.Scratch, "store", stored)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)})).repartition(8)
    got = found(nearest.nearest(df, F.col("vec_id") % 20 == 0))
    asked = np.arange(0, len(x), 20)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = np.argpartition(-scores, 20, axis=1)[:, :20]
    hits = sum(len(set(w.tolist()) & {v for v, _ in got[i]}) for i, w in zip(asked.tolist(), want))
    visits = sum(r["count"] for rows in seen for r in rows)
    return hits / want.size, visits / (len(asked) * sum(1 for _ in {r["cell"] for rows in seen for r in rows})), len(seen)


def test_recall_with_production_parameters(spark, monkeypatch):
    """50,000 vectors of 64 components: of one kind, and in 200 clusters."""
    rng = np.random.default_rng(5)
    even = rng.standard_normal((50_000, 64))
    clustered = rng.standard_normal((200, 64))[rng.integers(0, 200, 50_000)] * 2 + 0.3 * rng.standard_normal((50_000, 64))
    share, cells, rounds = recall(spark, even, monkeypatch)
    assert share >= 0.9, share
    share, fewer, more = recall(spark, clustered, monkeypatch)
    assert share >= 0.9 and fewer < 0.85 * cells, (share, fewer, cells, rounds, more)


def test_nearest_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
            (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5]), (1, [0.5, 0.5]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = found(nearest.nearest(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(1, 0.5), (20, 0.5)], 20: [(0, 0.5), (1, 0.5)]}
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_visits_come_out_some_at_a_time(spark, monkeypatch):
    """A batch of queries gives batches of a bounded size, however many cells a round visits."""
    monkeypatch.setattr(nearest, "CELL_ROWS", 2)
    x = np.random.default_rng(9).standard_normal((500, 8))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(500), "embedding": list(x)}))
    taken, plain = [], type(df).mapInArrow

    def seen(self, f, schema, *rest):
        if "query_id" in schema and "cell" in schema:
            taken.append(f)
        return plain(self, f, schema, *rest)

    monkeypatch.setattr(type(df), "mapInArrow", seen)
    nearest.nearest(df, F.col("vec_id") % 20 == 0)
    assert len(taken) == 4
    queries = [r.tobytes() for r in np.tile(x, (6, 1))]
    batch = pa.record_batch(
        [pa.array(np.arange(3000)), pa.array(queries), pa.nulls(3000, pa.float64())], ["id", "x", "worst"]
    )
    parts = list(taken[3](iter([batch])))
    assert max(p.nbytes for p in parts) < 2_000_000
    # Places 84 to 256 of each query's order.
    cells = pa.Table.from_batches(parts).to_pandas()
    assert len(cells) == 3000 * 172 and (cells.groupby("query_id")["cell"].nunique() == 172).all()


def test_nearest_does_not_depend_on_packs_and_turns(spark, monkeypatch):
    """Tasks of one part each, hot cells in parts, and queries in turns: the same rows."""
    monkeypatch.setattr(nearest, "CELL_ROWS", 150)
    monkeypatch.setattr(nearest, "PART_ROWS", 90)
    rng = np.random.default_rng(10)
    x = rng.standard_normal((1200, 6)).astype(np.float32)
    x[200:500] = x[0]
    rows = [(f"k{i:04d}", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    asks = F.substring("vec_id", 5, 1) == "0"
    wanted = sorted(nearest.nearest(df, asks).collect())
    assert len(wanted) == 120 * 20
    names = []
    plain = nearest.Scratch.store
    monkeypatch.setattr(nearest.Scratch, "store", lambda self, f, name="table": names.append(name) or plain(self, f, name))
    monkeypatch.setattr(nearest, "PACK_BYTES", 8 * 6 * 60)
    monkeypatch.setattr(nearest, "TURN_BYTES", 0)
    assert sorted(nearest.nearest(df, asks).collect()) == wanted
    assert names.count("visits") > names.count("best")


def test_nearest_of_all_lengths_is_exact_within_a_leaf(spark):
    """Products in single precision only leave rows out; scores and ranks are those of doubles."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((200, 12))
    x[:120] = x[0] + 1e-11 * rng.standard_normal((120, 12))
    for scale in (np.ones((200, 1)), 10.0 ** rng.integers(-30, 30, (200, 1)), np.full((200, 1), 1e-170)):
        v = x * scale
        df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(200), "embedding": list(v)}))
        got = found(nearest.nearest(df, F.col("vec_id") % 20 == 0))
        assert got == {i: best(np.arange(200), v, i) for i in range(0, 200, 20)}


def test_first_cells_and_packs():
    values = np.random.default_rng(12).integers(0, 6, (50, 40)).astype(float)
    for count in (0, 1, 7, 39, 40, 41):
        order = np.argsort(values, axis=1, kind="stable")[:, :count]
        want = np.zeros(values.shape, dtype=bool)
        np.put_along_axis(want, order, True, axis=1)
        assert (nearest._first(values, count) == want).all()
    sizes = {c: 10 for c in range(300)} | {300: 3 * nearest.PART_ROWS, 301: 5}
    cells = nearest.packed(sizes, nearest.PART_ROWS)
    spots = [(p, s) for _, packs, places in cells for p, s in zip(packs, places)]
    assert [c for c, _, _ in cells] == sorted(sizes) and [len(p) for _, p, _ in cells] == [1] * 300 + [3, 1]
    assert len(set(spots)) == len(spots) == 304 and spots == sorted(spots)
    assert max(s for _, s in spots) < nearest.BITS * nearest.WORDS and len({p for p, _ in spots}) >= 5


# ----------------------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    labels = {r.doc_id: r.quality for r in rows_of(spark, "labels")}
    seen = [{r.doc_id: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        seen.append({r.doc_id: r for r in docs.collect()})
    start, good, single, clean, mixed = seen
    lost = [k for k in start if k not in good and labels.get(k) == 1]
    assert len(lost) <= 0.1 * sum(v == 1 for v in labels.values())
    # The stage takes five words, the query of the operator two.
    want = groups([(r.doc_id, r.text) for r in good.values()], 5)
    assert set(single) == {k for k in good if want[k] == k}
    assert set(clean) == set(single) and all(r.n_chars == len(r.text) for r in clean.values())
    assert set(mixed) <= set(clean)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert len(last) == docs.count()
    assert all(r.decoded_sha256 == hashlib.sha256(mixed[r.doc_id].text.encode()).hexdigest() for r in last)
    run = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(run) == sorted(last)


def test_pipeline_of_odd_and_no_documents(spark):
    """Null, empty, blank, long and repeated texts, a null key; and an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    good = next(r for r in rows_of(spark, "documents") if r.n_chars > 800)
    odd = [(None, "de", "s"), ("", None, None), (" \n", "en", "s"), ("long " * 30_000, "en", "s"), (good.text, "en", "s"), (good.text, "en", "s")]
    rows = [(900_000 + i, t, lang, source, None) for i, (t, lang, source) in enumerate(odd)]
    rows += [rows[4], (None, good.text, "en", "s", 5)]
    named = {f.name: i for i, f in enumerate(schema)}
    docs = spark.createDataFrame([tuple(r[("doc_id", "text", "lang", "source", "n_chars").index(c)] for c in named) for r in rows], schema)
    for start in (docs, docs.limit(0)):
        held = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, held, FOLDER)
            assert out.columns == start.columns, name
            held = spark.createDataFrame(out.collect(), schema)
        last = corpus_pipeline.STAGES[-1][1](spark, held, FOLDER).collect()
        assert len(last) == held.count()
        assert bool(last) == (start is docs)


def test_shards_are_read_some_slots_at_a_time(spark, tmp_path, monkeypatch):
    """The batches that come out hold a bounded number of slots, whatever a task's files hold."""
    encoded = spark.createDataFrame([(i, [i] * 30) for i in range(60)], "k bigint, ids array<int>")
    trainorder.write_shards(encoded, str(tmp_path / "s"), ["k"], length=8)
    wanted = sorted(trainorder.read_slots(spark, str(tmp_path / "s")).collect())
    taken, plain = [], type(encoded).mapInArrow
    monkeypatch.setattr(
        type(encoded), "mapInArrow", lambda self, f, *rest: taken.append(f) or plain(self, f, *rest)
    )
    monkeypatch.setattr(trainorder, "READ_SLOTS", 50)
    trainorder.read_slots(spark, str(tmp_path / "s"), 7)
    files = sorted((tmp_path / "s" / "shards").glob("part-*"))
    held = pa.record_batch([pa.array([str(f) for f in files]), pa.array([f.read_bytes() for f in files])], ["path", "content"])
    made = list(taken[0](iter([held])))
    assert len(made) > 3 and max(b.num_rows for b in made) == 50
    assert sorted(tuple(r.values()) for b in made for r in b.to_pylist()) == [tuple(r) for r in wanted if r["slot"] >= 7]
