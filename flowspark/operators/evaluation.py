"""Scoring of triage results: accuracy, confusion, rankings, run comparison, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark import domains as D
from flowspark.functions.labels import is_threat, labels_match


def scored(df: DataFrame, predicted: str = "attack_type", actual: str = "ground_truth") -> DataFrame:
    """Add ``is_match``, ``pred_threat`` and ``true_threat``."""
    p, a = F.col(predicted), F.col(actual)
    return df.withColumns({"is_match": labels_match(p, a), "pred_threat": is_threat(p), "true_threat": is_threat(a)})


def _round_ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """Null when there is nothing to divide by."""
    return F.round(F.try_divide(part.cast("double"), whole), digits)


def confusion(df: DataFrame, by: tuple[str, ...] = (), predicted: str = "attack_type", actual: str = "ground_truth") -> DataFrame:
    """tp, tn, fp, fn of threat against benign per group; null unless every row has a ground truth."""
    p, a = F.col("pred_threat"), F.col("true_threat")
    complete = F.count(actual) == F.count("*")
    counts = {"tp": p & a, "tn": ~p & ~a, "fp": p & ~a, "fn": ~p & a}
    return scored(df, predicted, actual).groupBy(*by).agg(
        F.count("*").alias("n_records"),
        *[F.when(complete, F.count_if(test)).alias(k) for k, test in counts.items()],
    )


STATE = ("n_records", "n_known", "n_valid", "n_timed", "elapsed", "n_hit", "n_tp", "n_tn", "n_fp", "n_fn")


def metric_state(df: DataFrame, by: tuple[str, ...] = (), mode: str = "reference", predicted: str = "attack_type",
                 actual: str = "ground_truth", errors: str = "validation_errors", elapsed: str = "elapsed_seconds") -> DataFrame:
    """Counts and sums per group from which all run figures follow; states of parts add up.

    ``reference`` counts failed records as predicted threats; ``valid_only`` leaves them out.
    """
    valid = F.size(errors) == 0
    df = df if mode == "reference" else df.filter(valid)
    p, a = F.col("pred_threat"), F.col("true_threat")
    tests = {"n_valid": valid, "n_hit": F.col("is_match"), "n_tp": p & a, "n_tn": ~p & ~a, "n_fp": p & ~a, "n_fn": ~p & a}
    return scored(df, predicted, actual).groupBy(*by).agg(
        F.count("*").alias("n_records"), F.count(actual).alias("n_known"), F.count(elapsed).alias("n_timed"),
        F.coalesce(F.sum(elapsed), F.lit(0.0)).cast("double").alias("elapsed"), *[F.count_if(test).alias(n) for n, test in tests.items()],
    ).select(*by, *STATE)


def metrics_of(state: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All run figures of each group's state; null where they need a ground truth that some record lacks."""
    complete = F.col("n_known") == F.col("n_records")
    tp, tn, fp, fn = [F.when(complete, F.col(c)) for c in ("n_tp", "n_tn", "n_fp", "n_fn")]
    precision, recall = F.try_divide(tp.cast("double"), tp + fp), F.try_divide(tp.cast("double"), tp + fn)
    f1 = F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), F.when(complete, 0.0))
    return state.select(
        *by, "n_records", "n_valid", F.coalesce(F.try_divide("elapsed", F.col("n_timed")), F.lit(0.0)).alias("avg_elapsed_seconds"),
        _round_ratio(F.when(complete, F.col("n_hit")), F.col("n_records")).alias("accuracy_exact"),
        _round_ratio(tp + tn, F.col("n_records")).alias("accuracy_binary"),
        F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"),
        tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"),
    )


def metrics(df: DataFrame, by: tuple[str, ...] = (), mode: str = "reference", predicted: str = "attack_type",
            actual: str = "ground_truth", errors: str = "validation_errors", elapsed: str = "elapsed_seconds") -> DataFrame:
    """All run figures per group in one pass."""
    return metrics_of(metric_state(df, by, mode, predicted, actual, errors, elapsed), by)


def run_summary(df: DataFrame, errors: str = "validation_errors") -> DataFrame:
    """Counts by class and by severity plus overall means, as one long table (item, name, n, value)."""
    item = F.explode(F.array(
        F.struct(F.lit("attack_type").alias("item"), F.col("attack_type").alias("name")),
        F.struct(F.lit("severity").alias("item"), F.col("severity").alias("name")),
        F.struct(F.lit("all").alias("item"), F.lit(None).cast("string").alias("name")),
    ))
    return df.select(item.alias("i"), "confidence", "elapsed_seconds", errors).groupBy("i.item", "i.name").agg(
        F.count("*").alias("n"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("elapsed_seconds").alias("avg_elapsed_seconds"),
        F.count_if(F.size(errors) == 0).alias("n_valid"),
    )


def ranking(runs: DataFrame) -> DataFrame:
    """Configurations by mean exact accuracy over their runs, best first."""
    return runs.groupBy("config").agg(
        F.count("*").alias("runs"),
        F.round(F.avg("accuracy_exact"), 4).alias("avg_exact"),
        F.round(F.avg("accuracy_binary"), 4).alias("avg_binary"),
        F.round(F.avg("precision"), 4).alias("avg_precision"),
        F.round(F.avg("recall"), 4).alias("avg_recall"),
        F.round(F.avg("avg_elapsed"), 1).alias("avg_time"),
    ).orderBy(F.desc("avg_exact"), "config")


def run_differences(first: DataFrame, second: DataFrame, key: str = "record_key") -> DataFrame:
    """Two configurations over one sample, record by record: which outcomes changed."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return scored(df).select(
            key, F.col("ground_truth").alias(f"truth_{tag}"), F.col("attack_type").alias(f"attack_type_{tag}"),
            F.col("is_match").alias(f"match_{tag}"))

    joined = side(first, "a").join(side(second, "b"), key, "full_outer")
    change = (
        F.when(F.col("attack_type_a").isNull(), "only_b").when(F.col("attack_type_b").isNull(), "only_a")
        .when(F.col("match_a") & F.col("match_b"), "both_right")
        .when(F.col("match_a"), "lost").when(F.col("match_b"), "gained").otherwise("both_wrong")
    )
    return joined.select(
        key, F.coalesce("truth_a", "truth_b").alias("ground_truth"), "attack_type_a", "attack_type_b",
        change.alias("outcome"))


def outcome_matrix(differences: DataFrame) -> DataFrame:
    return differences.groupBy("outcome", "attack_type_a", "attack_type_b").agg(F.count("*").alias("n"))


def running_progress(df: DataFrame, run: str = "run", order: str = "record_key", elapsed: str = "elapsed_seconds",
                     block_width: int = 100_000) -> DataFrame:
    """Ordinal, percent, cumulative and mean time, and expected remaining time after every record.

    ``order`` is a whole number, unique within a run.  Runs are cut into blocks of
    ``block_width`` consecutive order values, so one block never holds more rows than that:
    totals run over blocks first, then over the rows of each block.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block_width))
    totals = blocked.groupBy(run, "_block").agg(F.count("*").alias("_n"), F.sum(elapsed).alias("_t"))
    whole = Window.partitionBy(run)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        run, "_block", F.sum("_n").over(whole).alias("_all"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_t0"))
    inner = Window.partitionBy(run, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = blocked.withColumns({"_i": F.count("*").over(inner), "_s": F.sum(elapsed).over(inner)}).join(offsets, [run, "_block"])
    i, total = F.col("_i") + F.col("_n0"), F.col("_s") + F.col("_t0")
    return rows.select(
        run, order, i.alias("ordinal"), (100.0 * i / F.col("_all")).alias("pct"), total.alias("elapsed_total"),
        (total / i).alias("avg_elapsed"), (total / i * (F.col("_all") - i)).alias("remaining"))


def run_tag(use_rag: Column, rerank: Column, two_stage: Column, use_rf: Column, stratified: Column, n: Column,
            stamp: Column | None = None) -> Column:
    """Run name from its attributes."""
    parts = [F.lit("run")] if stamp is None else [F.lit("run"), stamp]
    return F.concat_ws(
        "_", *parts,
        F.when(use_rag, "rag").otherwise("norag"),
        F.when(use_rag & rerank, "rerank"), F.when(two_stage, "2stage"), F.when(use_rf, "rf"),
        F.when(stratified, "stratified").otherwise("random"),
        F.concat(F.lit("n"), n.cast("string")))


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Newest row of every group, as an aggregate: it combines map-side, so a large group costs one row per task."""
    newest = F.max_by(F.struct(*[c for c in df.columns if c not in by]), F.struct(*order))
    return df.groupBy(*by).agg(newest.alias("_row")).select(*by, "_row.*")


def preview(df: DataFrame, order: list[str], n: int = 3, width: int = 150) -> DataFrame:
    """First results in order, long explanations cut."""
    text = F.col("explanation")
    shown = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)
    return df.withColumn("explanation", shown).orderBy(*order).limit(n)


def expand_grid(sample: DataFrame, configs=D.CONFIG_GRID) -> DataFrame:
    """Every record once per configuration; the flags become columns and one job scores all."""
    rows = F.array(*[F.struct(
        F.lit(c[0]).alias("config"), F.lit(c[1]).alias("use_rag"), F.lit(c[2]).alias("rerank"),
        F.lit(c[3]).alias("two_stage"), F.lit(c[4]).alias("use_rf")) for c in configs])
    return sample.select("*", F.explode(rows).alias("_c")).select("*", "_c.*").drop("_c")
