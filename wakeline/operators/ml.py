"""Behaviour classifiers on ping features, with folds by trip."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import staged
from .deep_forest import DEEPEST, DeepForest
from .deep_forest import drawn as _drawn


def _stages(features: list[str], label: str, scale: bool = False) -> list:
    stages = [StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=features, outputCol="raw" if scale else "features")]
    return stages + ([StandardScaler(inputCol="raw", outputCol="features", withMean=True)] if scale else [])


def train_forest(df: DataFrame, features: list[str], label: str = "behaviour", trees: int = 500, min_node: int = 1, mtry: int | None = None, seed: int = 1, depth: int = DEEPEST) -> PipelineModel:
    forest = RandomForestClassifier(numTrees=trees, minInstancesPerNode=min_node, featureSubsetStrategy=str(mtry) if mtry else "auto", maxDepth=depth, seed=seed)
    return Pipeline(stages=[*_stages(features, label), forest]).fit(df)


class BaggedForest:
    """Trees each grown on a bootstrap sample of its own, by which out-of-bag votes can be told.

    ``prepared`` makes labels and feature vectors, ``labels`` are the classes, ``trees`` Spark's models.
    """

    def __init__(self, prepared: PipelineModel, trees: list, key: str, seed: int):
        self.prepared, self.labels, self.trees, self.key, self.seed = prepared, prepared.stages[0].labels, trees, key, seed

    def arrays(self) -> list[tuple[np.ndarray, ...]]:
        """Each tree's nodes: feature, threshold, children and class; a leaf is its own child."""
        return [_nodes(t.trees[0].toDebugString) for t in self.trees]

    def _voted(self, df: DataFrame, out_of_bag: bool) -> DataFrame:
        n, classes, names, columns = len(self.trees), len(self.labels), self.labels, df.columns
        arrays = df.sparkSession.sparkContext.broadcast(self.arrays())
        rows = self.prepared.stages[-1].transform(df).withColumn("_x", vector_to_array("features"))
        drawn = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: _drawn(self.key, self.seed, t)) if out_of_bag else F.lit(None).cast("array<tinyint>")
        rows = rows.select(*df.columns, "_x", drawn.alias("_drawn"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False)
                x = x.reshape(batch.num_rows, len(x) // max(batch.num_rows, 1))
                seen = batch.column("_drawn").flatten().to_numpy(zero_copy_only=False).reshape(-1, n) > 0 if out_of_bag else np.zeros((len(x), n), bool)
                votes, every = np.zeros((len(x), classes), np.int64), np.arange(len(x))
                for t, tree in enumerate(arrays.value):
                    said = _walked(tree, x)
                    votes[every, said] += ~seen[:, t]
                count = votes.sum(axis=1)
                said = pa.array([names[i] for i in votes.argmax(axis=1).tolist()], pa.string(), mask=count == 0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), said, pa.array(count)], names=[*columns, "predicted", "n_votes"])

        return rows.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("predicted", T.StringType()), T.StructField("n_votes", T.LongType())]))

    def out_of_bag(self, df: DataFrame) -> DataFrame:
        """``predicted`` by the majority of the trees that did not see a row, ``n_votes`` of them; null where all saw it. For the rows of the training table."""
        return self._voted(df, True)

    def predict(self, df: DataFrame) -> DataFrame:
        """``predicted`` by the majority of all trees."""
        return self._voted(df, False)


def _nodes(text: str) -> tuple[np.ndarray, ...]:
    """A tree's printed form as arrays; its lines are in the order of a walk, the left side first."""
    feature, cut, left, right, said = [], [], [], [], []
    waiting: list[tuple[int, bool]] = []  # nodes whose left or right child comes next
    for line in text.splitlines()[1:]:
        line = line.strip()
        if line.startswith("Else"):
            continue
        here = len(feature)
        if waiting:
            parent, is_left = waiting.pop()
            (left if is_left else right)[parent] = here
        left.append(here)
        right.append(here)
        if line.startswith("If"):
            words = line.split()
            feature.append(int(words[2]))
            cut.append(float(words[4].rstrip(")")))
            said.append(0)
            waiting += [(here, False), (here, True)]
        else:
            feature.append(0)
            cut.append(0.0)
            said.append(int(float(line.split()[-1])))
    return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(said)


def _walked(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The class that a tree gives each row."""
    feature, cut, left, right, said = tree
    at = np.zeros(len(x), np.int64)
    going = np.arange(len(x))
    while len(going):
        here = at[going]
        to = np.where(x[going, feature[here]] <= cut[here], left[here], right[here])
        going = going[to != here]
        at[going] = to[to != here]
    return said[at]


def train_bagged_forest(df: DataFrame, features: list[str], label: str = "behaviour", key: str = "rec_id", trees: int = 500, min_node: int = 1, mtry: int | None = None, seed: int = 1, depth: int = DEEPEST, threads: int = 8) -> BaggedForest:
    """A forest whose trees' samples are drawn by a hash of ``key`` and tree, so that it is known which trees did not see a row.

    A tree's features are drawn anew at each node. Trees are fitted several at a time over the cached vectors.
    """
    prepared = Pipeline(stages=_stages(features, label)).fit(df)
    data = prepared.transform(df).select(key, "label", "features").persist()
    subset = str(mtry or max(1, math.isqrt(len(features))))

    def grown(t: int):
        rows = data.withColumn("weight", _drawn(key, seed, F.lit(t)).cast("double")).filter("weight > 0")
        return RandomForestClassifier(numTrees=1, bootstrap=False, weightCol="weight", featureSubsetStrategy=subset, minInstancesPerNode=min_node, maxDepth=depth, seed=seed + t).fit(rows)

    fitted = _at_once([(t,) for t in range(trees)], grown, threads)
    data.unpersist()
    return BaggedForest(prepared, fitted, key, seed)


def predict(model: PipelineModel, df: DataFrame, out: str = "predicted") -> DataFrame:
    """The label's text as predicted by a model of ``train_forest`` or ``train_other``."""
    labels = model.stages[0].labels
    drop = ["label", "raw", "features", "rawPrediction", "probability", "prediction"]
    named = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    data = model.stages[1:] if "label" not in df.columns else model.stages
    scored = df
    for stage in data:
        scored = stage.transform(scored)
    return scored.withColumn(out, named).drop(*drop)


def feature_importance(model: PipelineModel, features: list[str], like: DataFrame) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return like.sparkSession.createDataFrame(list(zip(features, values, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def forest_importance(df: DataFrame, features: list[str], label: str = "behaviour", key: str = "rec_id", trees: int = 500, min_node: int = 1, seed: int = 1, depth: int = DEEPEST) -> DataFrame:
    """``feature, importance`` of a forest that is grown by all tasks and not kept; the root of the number of features, rounded up, is tried at a node."""
    return DeepForest(df, features, label, key, trees, min_node, math.ceil(math.sqrt(len(features))), seed, depth).importance()


def out_of_bag_votes(df: DataFrame, features: list[str], label: str = "behaviour", key: str = "rec_id", trees: int = 500, min_node: int = 1, mtry: int | None = None, seed: int = 1, depth: int = DEEPEST) -> DataFrame:
    """``df`` with ``predicted`` and ``n_votes`` as of ``train_bagged_forest(...).out_of_bag``, of a forest that is grown by all tasks and not kept. ``key`` is unique."""
    votes = DeepForest(df, features, label, key, trees, min_node, mtry, seed, depth).votes()
    return df.join(votes, key, "left").withColumn("n_votes", F.coalesce("n_votes", F.lit(0)))


def _spread(low: float, high: float, n: int) -> list[int]:
    """Up to ``n`` whole numbers evenly from ``low`` to ``high``."""
    return sorted({max(1, round(v)) for v in np.linspace(low, max(low, high), n)})


def _at_once(jobs: list[tuple], run, threads: int) -> list:
    """Independent fits, several in flight, as their stages are short."""
    with ThreadPool(threads) as pool:
        return pool.starmap(run, jobs)


def tune_forest(df: DataFrame, features: list[str], label: str = "behaviour", key: str = "trip_id", rows: int = 10_000, trees: int = 50, n: int = 5, seed: int = 1, threads: int = 8) -> DataFrame:
    """``min_node, mtry, error, predicted_error`` over the full grid, the least predicted error first.

    Two designs of ``n`` by ``n`` are tried: least node sizes up to a third of the rows and numbers of
    features up to all (and their root); then between the two best sizes and among the three best
    numbers. A forest fitted to all errors (of held-out trips) predicts those of the full grid.
    ``rows`` bounds what each fit sees (rows by hash), as tuning needs no more.
    """
    part = staged(trip_folds(df.orderBy(F.md5(F.concat_ws("|", F.col("rec_id").cast("string"), F.lit(str(seed))))).limit(rows), 4, key, seed), "tuning-rows")
    train, test = part.filter("fold <> 1").persist(), part.filter("fold = 1").persist()
    most = max(1, part.count() // 3)

    def error(node: int, mtry: int) -> float:
        done = predict(train_forest(train, features, label, trees, node, mtry, seed), test)
        return float(done.agg(F.avg((F.col("predicted") != F.col(label)).cast("double"))).first()[0] or 0.0)

    found: dict[tuple[int, int], float] = {}

    def tried(nodes: list[int], tries: list[int]) -> None:
        design = [(a, m) for a in nodes for m in tries if (a, m) not in found]
        found.update(zip(design, _at_once(design, error, threads), strict=True))

    def best(which: int, k: int) -> list[int]:
        mean: dict[int, list[float]] = {}
        for c, e in found.items():
            mean.setdefault(c[which], []).append(e)
        return sorted(mean, key=lambda v: (sum(mean[v]) / len(mean[v]), v))[:k]

    tried(_spread(1, most, n), sorted({*_spread(1, len(features), n), max(1, math.isqrt(len(features)))}))
    nodes, tries = best(0, 2), best(1, 3)
    tried(_spread(min(nodes) + 1, max(nodes) - 1, n), _spread(min(tries), max(tries), n))
    train.unpersist()
    test.unpersist()
    spark = df.sparkSession
    seen = spark.createDataFrame([(float(a), float(m), e) for (a, m), e in found.items()], "min_node double, mtry double, error double")
    shape = VectorAssembler(inputCols=["min_node", "mtry"], outputCol="features")
    surrogate = RandomForestRegressor(labelCol="error", numTrees=100, minInstancesPerNode=1, seed=seed).fit(shape.transform(seen))
    grid = spark.range(1, most + 1).select(F.col("id").cast("double").alias("min_node"), F.explode(F.array(*[F.lit(float(m)) for m in range(1, len(features) + 1)])).alias("mtry"))
    guessed = surrogate.transform(shape.transform(grid)).withColumnRenamed("prediction", "predicted_error").drop("features")
    return guessed.join(seen, ["min_node", "mtry"], "left").orderBy("predicted_error", "min_node", "mtry")


def _products(df: DataFrame, features: list[str], label: str, centre: np.ndarray, fold: Column) -> DataFrame:
    """``label, fold, n, sums``: a class's rows of a fold, and over its rows for each pair of features, as three matrices: how many know both, the first's sum where the second is known, and their products' sum.

    Values are taken from ``centre``. A task adds up its rows by matrix products and hands on a row for each class and fold.
    """
    k, kind = len(features), df.schema[label].dataType
    schema = T.StructType([T.StructField("label", kind), T.StructField("fold", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def table(found: dict) -> pa.Table:
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * 3 * k * k), pa.array(np.concatenate([s.ravel() for _, s in found.values()] or [np.zeros(0)])))
        names, folds = ([key[i] for key in found] for i in range(2))
        return pa.table({"label": pa.array(names, to_arrow_type(kind)), "fold": pa.array(folds, pa.int32()), "n": pa.array([n for n, _ in found.values()], pa.int64()), "sums": sums})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            x = _matrix(batch.columns[2:]) - centre
            known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns[2:]], axis=1).astype(float)
            x = np.where(known > 0, x, 0.0)
            codes, fold = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            for i, name in enumerate(codes.dictionary.to_pylist()):
                for f in np.unique(fold).tolist():
                    rows = (codes.indices.to_numpy() == i) & (fold == f)
                    if rows.any():
                        a, m = x[rows], known[rows]
                        n, sums = found.get((name, f), (0, 0.0))
                        found[name, f] = n + len(a), sums + np.stack([m.T @ m, a.T @ m, a.T @ a])
        yield from table(found).to_batches()

    def merged(group: pa.Table) -> pa.Table:
        sums = np.sum(sorted(group["sums"].to_pylist()), axis=0)
        return table({(group["label"][0].as_py(), group["fold"][0].as_py()): (sum(group["n"].to_pylist()), sums)})

    rows = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), fold.cast("int").alias("fold"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    return rows.mapInArrow(added, schema).groupBy("label", "fold").applyInArrow(merged, schema)


def _matrix(columns: list[pa.Array]) -> np.ndarray:
    """A column for each feature; nan where it is null."""
    return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)


def _moments(df: DataFrame, features: list[str], label: str, fold: Column) -> tuple[np.ndarray, list]:
    """The middle of all rows and the products by class and fold, from two passes; at most a few rows reach the driver."""
    centre = np.array(df.agg(*[F.coalesce(F.avg(f), F.lit(0.0)) for f in features]).first(), float)
    return centre, _products(df, features, label, centre, fold).orderBy("label", "fold").collect()


def _discriminant(centre: np.ndarray, rows: list, quadratic: bool) -> list[dict]:
    """Classes with priors, means and covariances (pooled unless ``quadratic``) from the products of some folds."""
    k = len(centre)
    total = sum(r["n"] for r in rows)
    classes = []
    for name in dict.fromkeys(r["label"] for r in rows):
        mine = [r for r in rows if r["label"] == name]
        n = sum(r["n"] for r in mine)
        both, first, products = sum(np.array(r["sums"]) for r in mine).reshape(3, k, k)
        mean = centre + np.diag(first) / np.maximum(np.diag(both), 1)
        cov = np.where(both > 1, (products - first * first.T / np.maximum(both, 1)) / np.maximum(both - 1, 1), 0.0)
        classes.append({"label": name, "n": n, "prior": n / total, "mean": mean, "cov": cov})
    pooled = sum((c["n"] - 1) * c["cov"] for c in classes) / max(total - len(classes), 1)
    for c in classes:
        cov = (c["cov"] if quadratic else pooled) + np.eye(k) * 1e-9
        c["inverse"], c["logdet"] = np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])
    return classes


def train_discriminant(df: DataFrame, features: list[str], label: str = "behaviour", quadratic: bool = False) -> list[dict]:
    """Classes with priors, means and covariances (pooled unless ``quadratic``) from two passes, one for the middle of all rows and one for products; at most a few rows reach the driver."""
    return _discriminant(*_moments(df, features, label, F.lit(0)), quadratic)


def train_lda(df: DataFrame, features: list[str], label: str = "behaviour") -> list[dict]:
    return train_discriminant(df, features, label, False)


def train_qda(df: DataFrame, features: list[str], label: str = "behaviour") -> list[dict]:
    return train_discriminant(df, features, label, True)


def _best_class(classes: list[dict], x: np.ndarray) -> np.ndarray:
    """Which class has the highest score, by matrix products; ties go to the first."""
    scores = []
    for c in classes:
        d = x - c["mean"]
        scores.append(math.log(c["prior"]) - 0.5 * c["logdet"] - 0.5 * ((d @ c["inverse"]) * d).sum(axis=1))
    return np.argmax(scores, axis=0)


def predict_discriminant(classes: list[dict], df: DataFrame, features: list[str], out: str = "predicted") -> DataFrame:
    """The class of the highest score, by matrix products over a batch of rows. Ties, and rows that lack a feature, go to the last class."""
    kind = df.sparkSession.createDataFrame([(classes[0]["label"],)], ["label"]).schema["label"].dataType
    return _predict_folds({0: classes}, df, features, kind, F.lit(0), out)


def _predict_folds(models: dict[int, list[dict]], df: DataFrame, features: list[str], kind: T.DataType, fold: Column, out: str) -> DataFrame:
    """``predict_discriminant`` by the model of each row's fold."""
    models = {f: classes[::-1] for f, classes in models.items()}

    @F.arrow_udf(returnType=kind)
    def best(folds: pa.Array, *columns: pa.Array) -> pa.Array:
        x, folds = _matrix(columns), folds.to_numpy()
        said = pa.nulls(len(x), to_arrow_type(kind))
        for f in np.unique(folds).tolist():
            rows = folds == f
            labels = pa.array([c["label"] for c in models[f]], to_arrow_type(kind))
            said = pc.replace_with_mask(said, pa.array(rows), labels.take(pa.array(_best_class(models[f], x[rows]))))
        return said

    return df.withColumn(out, best(fold.cast("int"), *[F.col(f).cast("double") for f in features]))


def trip_folds(df: DataFrame, k: int = 5, key: str = "trip_id", seed: int = 1) -> DataFrame:
    """``fold`` 1 to k, whole trips: floor(n / k) of them each in the order of a seeded hash, the rest in the last.

    A trip's rank is its place among those of its hash's first byte plus the number of trips in the
    bytes before, so no window goes over all trips.
    """
    trips = df.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("_h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    trips = trips.withColumn("_b", F.substring("_h", 1, 2))
    sizes = trips.groupBy("_b").agg(F.count("*").alias("_n"))  # at most 256 rows
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    base = sizes.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("_all"))
    rank = F.row_number().over(W.partitionBy("_b").orderBy("_h", key)) + F.col("_base") - 1
    each = F.greatest(F.lit(1), F.floor(F.col("_all") / k))
    folds = trips.join(F.broadcast(base), "_b").select(key, F.least(F.lit(k), F.floor(rank / each) + 1).cast("int").alias("fold"))
    return df.join(folds, key)


def cross_validate(df: DataFrame, features: list[str], label: str = "behaviour", key: str = "trip_id", k: int = 5, trees: int = 100, seed: int = 1, depth: int = DEEPEST, threads: int = 8) -> DataFrame:
    """Every ping as predicted by models that saw no ping of its fold: ``model`` forest, lda or qda. ``rec_id`` is unique.

    The forests of all folds are grown together. The discriminants of all folds come of products by fold, added up
    without the fold that is told, so rows are read as often as for one fold. ``threads`` is not needed any more.
    """
    d = staged(trip_folds(df, k, key, seed))
    keep = [key, "rec_id", "gear", label, "fold"] if "gear" in d.columns else [key, "rec_id", label, "fold"]
    centre, rows = _moments(d, features, label, F.col("fold"))
    folds = [r[0] for r in d.select("fold").distinct().collect()]
    said = d
    for name in ("lda", "qda"):
        models = {f: _discriminant(centre, [r for r in rows if r["fold"] != f], name == "qda") for f in folds}
        said = _predict_folds(models, said, features, d.schema[label].dataType, F.col("fold"), name)
    forests = DeepForest(d, features, label, "rec_id", trees, 1, math.ceil(math.sqrt(len(features))), seed, depth, "fold", k)
    said = said.select(*keep, "lda", "qda").join(forests.votes(soft=True).withColumnRenamed("predicted", "forest"), "rec_id", "left")
    each = F.explode(F.array(*[F.struct(F.col(m).alias("predicted"), F.lit(m).alias("model")) for m in ("forest", "lda", "qda")]))
    return said.select(*keep, each.alias("_said")).select(*keep, "_said.predicted", "_said.model")


def confusion(df: DataFrame, label: str = "behaviour", by: list[str] = []) -> DataFrame:  # noqa: B006
    return df.groupBy(*by, F.col("predicted"), F.col(label).alias("actual")).agg(F.count("*").alias("n"))


def overall(conf: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``accuracy``, ``kappa`` and ``no_information_rate`` from confusion counts."""
    cells = conf.filter("predicted is not null and actual is not null")
    keys = by or ["_all"]
    cells = cells if by else cells.withColumn("_all", F.lit(1))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(0)).alias("hit"))
    rows = cells.groupBy(*keys, F.col("predicted").alias("c")).agg(F.sum("n").alias("p"))
    cols = cells.groupBy(*keys, F.col("actual").alias("c")).agg(F.sum("n").alias("a"))
    both = rows.join(cols, [*keys, "c"], "full").groupBy(*keys).agg(F.sum(F.coalesce("p", F.lit(0)) * F.coalesce("a", F.lit(0))).alias("pa"), F.max("a").alias("most"))
    chance = F.col("pa") / (F.col("n") * F.col("n"))
    accuracy = F.col("hit") / F.col("n")
    return total.join(both, keys).select(
        *by, F.round(accuracy, 6).alias("accuracy"), F.round(F.try_divide(accuracy - chance, 1 - chance), 6).alias("kappa"), F.round(F.col("most") / F.col("n"), 6).alias("no_information_rate")
    )


def split_train_test(df: DataFrame, share: float = 0.7, seed: int = 1) -> DataFrame:
    """``part`` train or test by a seeded hash of rec_id, the same for a row each time and on any engine."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("rec_id").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return df.withColumn("part", F.when(h < int(share * (1 << 32)), "train").otherwise("test"))


def train_other(df: DataFrame, features: list[str], label: str = "behaviour", kind: str = "forest", folds: int = 10, trees: int = 50, seed: int = 1, threads: int = 8) -> PipelineModel:
    """Centred and scaled features; forest, boosted or bagged trees, chosen by cross-validation over tree depth.

    Boosted trees have one depth, so no folds are fitted: the model of all rows is what would be chosen.
    """
    if kind not in ("forest", "boosted", "bagged"):
        raise ValueError(f"kind must be forest, boosted or bagged, not {kind!r}")
    prepared = Pipeline(stages=_stages(features, label, scale=True)).fit(df)
    data = prepared.transform(df).select("label", "features").persist()
    if kind == "boosted":
        one = GBTClassifier(maxIter=20, seed=seed)
        best = (one if len(prepared.stages[0].labels) == 2 else OneVsRest(classifier=one)).fit(data)
    else:
        model = RandomForestClassifier(numTrees=trees, featureSubsetStrategy="all" if kind == "bagged" else "auto", seed=seed)
        grid = ParamGridBuilder().addGrid(model.maxDepth, [5, 10]).build()
        best = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, seed=seed, parallelism=threads).fit(data).bestModel
    data.unpersist()
    return PipelineModel([*prepared.stages, best])


def compare_models(df: DataFrame, features: list[str], label: str = "behaviour", kinds: tuple[str, ...] = ("forest", "boosted", "bagged"), share: float = 0.7, folds: int = 10, trees: int = 50, seed: int = 1) -> DataFrame:
    """``model, accuracy, kappa, no_information_rate``: each kind trained on ``share`` of the pings, by folds, and judged on the rest."""
    parts = split_train_test(df, share, seed)
    train, test = parts.filter("part = 'train'").drop("part"), parts.filter("part = 'test'").drop("part")
    said = [predict(train_other(train, features, label, kind, folds, trees, seed), test).select(label, "predicted", F.lit(kind).alias("model")) for kind in kinds]
    return overall(confusion(reduce(DataFrame.unionByName, said), label, ["model"]), ["model"])
