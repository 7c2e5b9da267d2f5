"""Forests whose out-of-bag votes are known; cross-validation by trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import deep_forest, ml


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    kind = np.where(x[:, 0] + 0.3 * rng.normal(size=400) > 0, "Fishing", np.where(x[:, 1] > 0.5, "Hauling", "Steaming"))
    rows = [(i, f"t{i // 20}", *map(float, v), str(k)) for i, (v, k) in enumerate(zip(x, kind, strict=True))]
    return spark.createDataFrame(rows, "rec_id long, trip_id string, a double, b double, c double, behaviour string").repartition(3).persist()


def test_bootstrap_samples_are_poisson(spark):
    rows = spark.range(20_000).select(F.col("id").alias("rec_id"))
    counts = np.array(rows.select(*[ml._drawn("rec_id", 1, F.lit(t)).alias(f"t{t}") for t in range(3)]).toPandas())
    for n in range(4):
        assert (counts == n).mean(axis=0) == pytest.approx([math.exp(-1) / math.factorial(n)] * 3, abs=0.012)
    assert abs(np.corrcoef(counts.T)[0, 1]) < 0.03


def test_out_of_bag_votes_equal_those_of_the_trees(labelled):
    forest = ml.train_bagged_forest(labelled, ["a", "b", "c"], trees=7, depth=6)
    got = {r.rec_id: r for r in forest.out_of_bag(labelled).collect()}
    everyone = {r.rec_id: r.predicted for r in forest.predict(labelled).collect()}
    rows = forest.prepared.transform(labelled).select("rec_id", "features", *[ml._drawn("rec_id", 1, F.lit(t)).alias(f"t{t}") for t in range(7)]).collect()
    assert len(got) == 400 and forest.labels == ["Fishing", "Hauling", "Steaming"]
    for r in rows:
        said = [int(t.trees[0].predict(r.features)) for t in forest.trees]
        unseen = [s for i, s in enumerate(said) if r[f"t{i}"] == 0]
        assert got[r.rec_id].n_votes == len(unseen)
        most = lambda votes: forest.labels[max(range(3), key=lambda c: (votes.count(c), -c))] if votes else None
        assert got[r.rec_id].predicted == most(unseen) and everyone[r.rec_id] == most(said)
    wrong = np.mean([r.predicted != r.behaviour for r in got.values() if r.predicted])
    inside = np.mean([everyone[i] != r.behaviour for i, r in got.items()])
    assert inside < wrong < 0.4  # what trees saw they know better


def test_trees_of_one_leaf_and_printed_forms(labelled):
    one = labelled.filter("behaviour = 'Fishing'")
    forest = ml.train_bagged_forest(one, ["a", "b"], trees=3)
    assert {r.predicted for r in forest.predict(one).collect()} == {"Fishing"}
    text = "Tree\n  If (feature 0 <= 1.5)\n   If (feature 2 <= -1.0E-4)\n    Predict: 0.0\n   Else (feature 2 > -1.0E-4)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 2.0\n"
    assert ml._walked(ml._nodes(text), np.array([[1.5, 0, -1], [1, 0, 0], [2, 0, 0]], float)).tolist() == [0, 1, 2]


def test_folds_are_predicted_by_models_that_did_not_see_them(spark, labelled):
    done = ml.cross_validate(labelled, ["a", "b", "c"], k=4, trees=5).collect()
    assert len(done) == 3 * 400 and {r.model for r in done} == {"forest", "lda", "qda"}
    folds = {r.trip_id: r.fold for r in done}
    assert len(folds) == 20 and all(folds[r.trip_id] == r.fold for r in done)
    for model in ("forest", "lda", "qda"):
        mine = [r for r in done if r.model == model]
        assert len({r.rec_id for r in mine}) == 400 and np.mean([r.predicted == r.behaviour for r in mine]) > 0.7
    # The discriminant of a fold, trained by hand on the others.
    fold = sorted(set(folds.values()))[0]
    train = labelled.filter(~F.col("trip_id").isin([t for t, f in folds.items() if f == fold]))
    by_hand = {r.rec_id: r.predicted for r in ml.predict_discriminant(ml.train_qda(train, ["a", "b", "c"]), labelled, ["a", "b", "c"]).collect()}
    assert all(by_hand[r.rec_id] == r.predicted for r in done if r.model == "qda" and r.fold == fold)


def test_other_models_are_named(labelled):
    with pytest.raises(ValueError):
        ml.train_other(labelled, ["a"], kind="svm")


def plain_tree(bins, label, weight, classes, depth):
    """Leaf shares and falls of impurity by feature of a tree that tries all features, node after node."""
    shares, falls = np.zeros((len(bins), classes)), np.zeros(bins.shape[1])
    square = lambda rows: (np.bincount(label[rows], weight[rows], classes) ** 2).sum() / max(weight[rows].sum(), 1)
    waiting = [(np.arange(len(bins)), 0)]
    while waiting:
        rows, level = waiting.pop()
        counts = np.bincount(label[rows], weight[rows], classes)
        best = (0.0, None)
        if counts.max() < counts.sum() and level < depth:
            for f in range(bins.shape[1]):
                for b in range(32):
                    left = bins[rows, f] <= b
                    if 0 < weight[rows[left]].sum() < counts.sum():
                        fall = round(square(rows[left]) + square(rows[~left]) - square(rows), 9)
                        best = max(best, (fall, (f, b)), key=lambda x: x[0]) if fall > best[0] else best
        if best[1] is None:
            shares[rows] = counts / counts.sum()
            continue
        f, b = best[1]
        falls[f] += best[0]
        waiting += [(rows[bins[rows, f] <= b], level + 1), (rows[bins[rows, f] > b], level + 1)]
    return shares, falls


@pytest.mark.parametrize("depth", [3, 30])
def test_a_deep_tree_equals_a_plain_one(depth):
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 32, (300, 4)).astype(np.uint8)
    label, weight = (bins[:, 0] // 8 + rng.integers(0, 2, 300)) % 3, rng.poisson(1, 300).astype(float)
    got = deep_forest._grown(bins, label, weight, 3, 4, 1, depth, np.random.default_rng(1), block=7)
    want = plain_tree(bins, label, weight, 3, depth)
    assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1])


def test_deep_forests_leave_no_model_and_do_not_depend_on_how_rows_are_dealt(labelled):
    """The large nodes' way (by all tasks) and the small ones' (in one) give one forest; a bagged forest's errors are like its."""
    names = ["a", "b", "c"]
    forest = lambda df, **more: deep_forest.DeepForest(df, names, trees=15, **more)
    whole = forest(labelled)
    parts = forest(labelled.repartition(7), small=60, mtry=3)
    same = forest(labelled, small=10**6, mtry=3)
    assert all(len(t.feature) == 1 for t in whole.top) and all(len(t.feature) > 3 for t in parts.top)
    got, other = ({r.rec_id: (r.predicted, r.n_votes) for r in f.votes().collect()} for f in (parts, same))
    assert got == other and len(got) > 395  # all features are tried at a node, so no draw tells the ways apart
    assert dict(parts.importance().collect()) == pytest.approx(dict(same.importance().collect())) and sum(dict(same.importance().collect()).values()) == pytest.approx(1)
    drawn = labelled.select("rec_id", *[ml._drawn("rec_id", 1, F.lit(t)).alias(f"t{t}") for t in range(15)]).collect()
    assert {r.rec_id: sum(r[f"t{t}"] == 0 for t in range(15)) for r in drawn if any(r[f"t{t}"] == 0 for t in range(15))} == {i: n for i, (_, n) in got.items()}
    rows = ml.out_of_bag_votes(labelled, names, trees=15).collect()
    bagged = ml.train_bagged_forest(labelled, names, trees=15).out_of_bag(labelled).filter("n_votes > 0").collect()
    wrong = lambda rows: np.mean([r.predicted != r.behaviour for r in rows if r.n_votes])
    assert len(rows) == 400 and abs(wrong(rows) - wrong(bagged)) < 0.06
    spark_s = dict(ml.feature_importance(ml.train_forest(labelled, names, trees=15), names, labelled).collect())
    assert dict(ml.forest_importance(labelled, names, trees=15).collect()) == pytest.approx(spark_s, abs=0.1)


def test_rows_in_open_nodes_are_found_as_by_a_walk():
    """Bit masks over pairs of features, 64 nodes at a time, against a walk down the tree."""
    rng = np.random.default_rng(3)
    top, waiting = deep_forest._Top(), [0]
    top.add(0, None)
    while len(waiting) < 150:
        v = waiting.pop(int(rng.integers(len(waiting))))
        top.feature[v], top.cut[v] = int(rng.integers(5)), int(rng.integers(31))
        top.left[v], top.right[v] = (top.add(top.depth[v] + 1, None) for _ in range(2))
        waiting += [top.left[v], top.right[v]]
    bins = rng.integers(0, 32, (4000, 5)).astype(np.uint8)
    rows = np.flatnonzero(rng.random(4000) < 0.7)
    walked = deep_forest._at(top.arrays(), bins.ravel(), rows * 5)
    asked = np.sort(rng.permutation(waiting)[:100]).tolist()
    got, at = deep_forest._met(deep_forest._masks(deep_forest._boxes(top, asked, 5)), deep_forest._pairs(bins), rows)
    want = {int(r): asked.index(v) for r, v in zip(rows, walked, strict=True) if v in asked}
    assert len(want) > 1000 and dict(zip(got.tolist(), at.tolist(), strict=True)) == want and len(got) == len(want)
    plain = np.zeros(4000, int)
    for i, b in enumerate(bins):
        while top.left[plain[i]] != plain[i]:
            plain[i] = (top.left if b[top.feature[plain[i]]] <= top.cut[plain[i]] else top.right)[plain[i]]
    assert (plain[rows] == walked).all()


def test_a_forest_hands_on_a_row_for_a_node_and_a_block(labelled):
    """Not one for each ping and tree: what 400 pings of 15 trees hand on is bounded by the trees' leaves and the table's pieces."""
    forest = deep_forest.DeepForest(labelled, ["a", "b", "c"], trees=15, small=60, mtry=3)
    handed, plain = [], forest._handed
    forest._handed = lambda *how: handed.append(plain(*how)) or handed[-1]
    assert len(forest.votes().collect()) > 395
    rows = handed[0].selectExpr("length(often) n", "length(bins) bins", "length(place) place").collect()
    leaves = sum(left == v for top in forest.top for v, left in enumerate(top.left))
    assert len(rows) <= leaves * forest.data.select("block").distinct().count() < sum(r.n for r in rows)
    assert all(r.bins == 3 * r.n and r.place <= 4 * r.n for r in rows)


def test_discriminants_of_all_folds_come_from_two_readings(labelled, monkeypatch):
    """Products by fold, added up without one, are those of a fit to the others."""
    names, read = ["a", "b", "c"], []
    plain = ml._moments
    monkeypatch.setattr(ml, "_moments", lambda *how: read.append(1) or plain(*how))
    folds = ml.trip_folds(labelled, 4)
    assert ml.cross_validate(labelled, names, k=4, trees=1).count() == 1200 and len(read) == 1
    centre, rows = plain(folds, names, "behaviour", F.col("fold"))
    for f in range(1, 5):
        got = ml._discriminant(centre, [r for r in rows if r["fold"] != f], True)
        want = ml.train_qda(folds.filter(F.col("fold") != f), names)
        assert [(c["label"], c["n"]) for c in got] == [(c["label"], c["n"]) for c in want]
        for c, w in zip(got, want, strict=True):
            assert c["mean"] == pytest.approx(w["mean"]) and c["inverse"] == pytest.approx(w["inverse"]) and c["prior"] == pytest.approx(w["prior"])
