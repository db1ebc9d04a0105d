"""Random Forest pre-filter: one model per dataset, trained and applied to whole tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark import domains as D
from flowspark.functions.labels import threat_target
from flowspark.operators.cleaning import name, numeric_columns
from flowspark.operators.forest import LEAF, TREE_SCHEMA, Forest, batch, coded, cut_points, from_mllib, grown_batches, in_order, shares, trees_of
from flowspark.operators.sampling import sample_n, train_test_split
from flowspark.session import shared_folder, written

IN_TASKS = 1 << 24  # feature values that the driver gathers and every task holds as codes
TREES_A_TASK = 2


def safe_value(df: DataFrame, column: str) -> Column:
    """A feature present, numeric and finite; anything else counts as 0."""
    value = name(column).try_cast("double") if column in df.columns else F.lit(None).cast("double")
    usable = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(usable, value).otherwise(0.0)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and balanced weight n / (2 * n_class) of both classes; an absent class is an error."""
    y = threat_target(F.col(label))
    counts = df.agg(F.count_if(y == 0.0).alias("b"), F.count_if(y == 1.0).alias("t"))
    checked = counts.filter(F.when((F.col("b") > 0) & (F.col("t") > 0), True).otherwise(
        F.raise_error(F.lit("both classes are needed for training"))))
    total = F.col("b") + F.col("t")
    return checked.select(F.inline(F.array(
        F.struct(F.lit(0).alias("target"), F.col("b").alias("n"), (total / (2.0 * F.col("b"))).alias("weight")),
        F.struct(F.lit(1).alias("target"), F.col("t").alias("n"), (total / (2.0 * F.col("t"))).alias("weight")),
    )))


def weighted(df: DataFrame, label: str, weights: dict[int, float]) -> DataFrame:
    """Add ``target`` and ``weight``; the two weights are constants of the plan."""
    y = threat_target(F.col(label))
    return df.withColumns({"target": y, "weight": F.when(y == 0.0, weights[0]).otherwise(weights[1])})


def train_forest(train: DataFrame, features: list[str], label: str = "label", trees: int = 100, depth: int = 20,
                 bins: int = 32, seed: int = D.DEFAULT_SEED, in_tasks: int = IN_TASKS) -> Forest:
    """A forest of both classes with balanced weights; a node tries the square root of all features.

    Up to ``in_tasks`` feature values every task holds all rows as codes and grows whole trees of its own; beyond that the
    rows stay distributed and MLlib passes over them once per level.
    """
    classes = {r["target"]: r for r in class_weights(train, label).collect()}
    weights = {target: r["weight"] for target, r in classes.items()}
    columns = [f"f{i}" for i in range(len(features))]
    rows = weighted(train, label, weights).select("target", "weight", *[safe_value(train, f).alias(c) for f, c in zip(features, columns, strict=True)])
    if len(features) * sum(r["n"] for r in classes.values()) > in_tasks or bins >= LEAF:
        return from_stored(train.sparkSession, _distributed_forest(rows, columns, trees, depth, bins, seed), list(features))
    found = rows.toArrow()
    values = [found[c].to_numpy() for c in columns]
    target, weight = found["target"].to_numpy().astype("uint8"), found["weight"].to_numpy()
    thresholds = [cut_points(v, weight, bins) for v in values]
    context = train.sparkSession.sparkContext
    data = context.broadcast(in_order(coded(values, thresholds), target))
    try:
        grow = grown_batches(data, (weights[0], weights[1]), bins, depth, math.ceil(math.sqrt(len(features))), seed)
        numbers = train.sparkSession.range(0, trees, 1, -(-trees // TREES_A_TASK))
        return Forest(list(features), thresholds, trees_of(numbers.mapInArrow(grow, TREE_SCHEMA).toArrow()))
    finally:
        data.unpersist()


def _distributed_forest(rows: DataFrame, columns: list[str], trees: int, depth: int, bins: int, seed: int) -> RandomForestClassificationModel:
    """MLlib's forest over rows of any number.

    Every depth is a pass over the rows, so they are dealt to all cores once, as narrow rows in memory; the node that a row has
    reached is kept per row instead of being found again from the root, and checkpointed in the shared folder.
    Small groups of nodes per pass keep the statistics of deep, sparse levels small.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="target", weightCol="weight", numTrees=trees, maxDepth=depth, maxBins=bins,
        featureSubsetStrategy="sqrt", seed=seed, maxMemoryInMB=256, cacheNodeIds=True, checkpointInterval=10)
    vectors = VectorAssembler(inputCols=columns, outputCol="features")
    rows = rows.repartition(context.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return forest.fit(vectors.transform(rows))
    finally:
        rows.unpersist()


def from_stored(spark: SparkSession, model: RandomForestClassificationModel, features: list[str]) -> Forest:
    """MLlib's model as arrays, by way of its files in the shared folder."""
    target = shared_folder(spark)
    model.write().save(target)
    node = F.col("nodeData")
    stats, split = node["impurityStats"], node["split"]
    return from_mllib(features, spark.read.parquet(f"{target}/data").orderBy("treeID", node["id"]).select(
        F.col("treeID").alias("tree"), stats[0].alias("benign"), stats[1].alias("threat"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        split["featureIndex"].alias("feature"), F.coalesce(F.get(split["leftCategoriesOrThreshold"], 0), F.lit(0.0)).alias("threshold")).toArrow())


def feature_list(model: Forest) -> list[str]:
    return model.features


def benign_share(df: DataFrame, models: list[Forest], which: Column) -> Column:
    """Mean share of benign weight over the trees of model number ``which``, null without one; models are sent to every executor once."""
    features = list(dict.fromkeys(f for model in models for f in model.features))
    sent = df.sparkSession.sparkContext.broadcast([([features.index(f) for f in m.features], m.thresholds, m.trees) for m in models])

    @F.pandas_udf(T.DoubleType())
    def share(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        known = sent.value
        for number, *values in columns:
            numbers, found = number.to_numpy(), np.full(len(number), np.nan)
            for i, (places, thresholds, trees) in enumerate(known):
                if len(own := np.flatnonzero(numbers == i)):
                    found[own] = shares(coded([values[k].to_numpy()[own] for k in places], thresholds).T, trees)
            yield pd.Series(found)

    return share(which, *[safe_value(df, f) for f in features])


def score(df: DataFrame, model: Forest) -> DataFrame:
    """Add rf_label (argmax, ties benign), rf_confidence and rf_benign, without touching other columns."""
    return _scored(df, [model], F.lit(0))


def score_by_source(df: DataFrame, models: dict[str, Forest], source: str = "dataset_source") -> DataFrame:
    """Score rows by the model of their dataset, all in one pass; rows without a model are Unknown with confidence 0."""
    which = F.lit(-1)
    for number, known in enumerate(models):
        which = F.when(F.col(source) == known, number).otherwise(which)
    return _scored(df, list(models.values()), which)


def _scored(df: DataFrame, models: list[Forest], which: Column) -> DataFrame:
    share = F.when(which >= 0, benign_share(df, models, which)) if models else F.lit(None).cast("double")
    benign, threat = F.col("_p"), 1 - F.col("_p")
    return df.withColumn("_p", share).select(
        *[name(c) for c in df.columns],
        F.when(benign.isNull(), D.UNKNOWN).when(benign >= threat, "Benign").otherwise("Threat").alias("rf_label"),
        F.coalesce(F.greatest(benign, threat), F.lit(0.0)).alias("rf_confidence"),
        benign.alias("rf_benign"),
    )


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def holdout_metrics(scored: DataFrame, label: str = "label", confident: float = 0.95) -> DataFrame:
    """One row with accuracy, precision, recall, F1 of the threat class, the 2x2 counts, and how many
    benign rows and threats look confidently benign."""
    y, p = threat_target(F.col(label)), F.when(F.col("rf_label") == "Benign", 0.0).otherwise(1.0)
    sure = F.col("rf_benign") >= confident
    counts = scored.agg(
        F.count("*").alias("n"),
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & sure).alias("sure_benign"), F.count_if((y == 1) & sure).alias("sure_missed"),
    )
    precision = ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(
        "n", "tn", "fp", "fn", "tp",
        ratio_or_zero(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        precision.alias("precision_threat"), recall.alias("recall_threat"),
        ratio_or_zero(2 * precision * recall, precision + recall).alias("f1_threat"),
        ratio_or_zero(F.col("sure_benign"), F.col("tn") + F.col("fp")).alias("benign_high_confidence_coverage"),
        ratio_or_zero(F.col("sure_missed"), F.col("tp") + F.col("fn")).alias("threat_misclassified_high_conf"),
    )


def holdout_split(df: DataFrame, key: str, label: str = "label", sample_size: int | None = None,
                  test_fraction: float = 0.2, seed: int = D.DEFAULT_SEED) -> DataFrame:
    """The rows a model of this dataset is made from, with ``is_test``; the same rows on every call.

    ``sample_size`` bounds the labelled rows that a model is fitted to; None takes all.
    """
    if sample_size is not None:
        df = written(sample_n(df, sample_size, key, seed=seed))  # the split passes over it several times
    classed = df.withColumn("_class", threat_target(F.col(label)))
    return train_test_split(classed, key, "_class", test_fraction, seed).drop("_class")


def train_dataset(df: DataFrame, key: str, label: str = "label", sample_size: int | None = None,
                  test_fraction: float = 0.2, seed: int = D.DEFAULT_SEED, features: list[str] | None = None,
                  **forest) -> tuple[Forest, DataFrame]:
    """Sample, split, train and evaluate one dataset: (model, one-row metrics)."""
    if features is None:
        features = [c for c in numeric_columns(df) if c != key]
    if not features:
        raise ValueError("no numeric feature to train on")
    split = written(holdout_split(df, key, label, sample_size, test_fraction, seed))  # training passes over it many times
    model = train_forest(split.filter(~F.col("is_test")), features, label, seed=seed, **forest)
    metrics = holdout_metrics(score(split.filter("is_test"), model), label)
    sizes = split.agg(
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"),
        F.count_if(~F.col("is_test") & (threat_target(F.col(label)) == 0)).alias("n_benign_train"),
        F.count_if(~F.col("is_test") & (threat_target(F.col(label)) == 1)).alias("n_threat_train")).first()
    constants = {**sizes.asDict(), "feature_count": len(features),
                 "n_estimators": forest.get("trees", 100), "max_depth": forest.get("depth", 20)}
    row = {**metrics.first().asDict(), **constants}
    schema = metrics.schema
    for column in constants:
        schema = schema.add(column, T.LongType())
    return model, df.sparkSession.createDataFrame([tuple(row[c] for c in schema.names)], schema)


def save_model(model: Forest, path: str) -> None:
    """A row per tree, and one that holds the features and their thresholds."""
    spark = SparkSession.active()
    trees = pa.Table.from_batches([batch(i, tree) for i, tree in enumerate(model.trees)])
    spark.createDataFrame(trees).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    cuts = [(i, f, t.tolist()) for i, (f, t) in enumerate(zip(model.features, model.thresholds, strict=True))]
    spark.createDataFrame(cuts, "i int, feature string, thresholds array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load_model(path: str) -> Forest:
    spark = SparkSession.active()
    cuts = spark.read.parquet(f"{path}/features").orderBy("i").collect()
    return Forest([r["feature"] for r in cuts], [np.array(r["thresholds"], dtype=float) for r in cuts], trees_of(spark.read.parquet(f"{path}/trees").toArrow()))
