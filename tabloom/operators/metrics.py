"""Metrics of scored frames.

Classification frames carry ``actual`` and ``predicted`` labels, ranked ones a
``score`` and a boolean ``positive``; regression frames ``actual`` and
``predicted`` numbers.  Every metric reads a small aggregate (label pairs or
distinct scores), never the rows in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.values import quoted, rounded
from tabloom.plans.ordering import evenly_spaced, running_totals
from tabloom.session import cut_lineage


def label_pairs(
    scored: DataFrame, actual: str = "actual", predicted: str = "predicted", by: Sequence[str] = ()
) -> DataFrame:
    return scored.groupBy(
        *by,
        quoted(actual).cast("string").alias("actual"),
        quoted(predicted).cast("string").alias("predicted"),
    ).agg(F.count("*").alias("n"))


def confusion(
    scored: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """All cells of label × label over the union of labels."""
    pairs = label_pairs(scored, actual, predicted)
    labels = pairs.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()
    # Every cell of the matrix is wanted, also the empty ones.
    all_labels = labels.agg(F.array_sort(F.collect_set("label")).alias("all"))
    grid = all_labels.select(F.explode("all").alias("actual"), "all").select(
        "actual", F.explode("all").alias("predicted")
    )
    return grid.join(pairs, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("count")
    )


def label_metrics(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, label, support, predicted_count, hits) from label pairs."""
    sides = pairs.select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.col("actual").alias("label"), F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("predicted_count"),
                    F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("predicted_count"), F.lit(0).cast("long").alias("hits"),
                ),
            )
        ).alias("s"),
    ).select(*by, "s.*")
    return sides.groupBy(*by, "label").agg(
        F.sum("support").alias("support"),
        F.sum("predicted_count").alias("predicted_count"),
        F.sum("hits").alias("hits"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification_metrics(
    scored: DataFrame,
    actual: str = "actual",
    predicted: str = "predicted",
    by: Sequence[str] = (),
    digits: int = 4,
) -> DataFrame:
    """accuracy, balanced accuracy, macro precision, recall and F1."""
    per_label = label_metrics(label_pairs(scored, actual, predicted, by), by)
    hits, support, seen = F.col("hits"), F.col("support"), F.col("predicted_count")
    return per_label.groupBy(*by).agg(
        F.sum("support").alias("rows"),
        rounded(F.sum("hits") / F.sum("support"), digits).alias("accuracy"),
        rounded(F.avg(F.when(support > 0, hits / support)), digits).alias("balanced_accuracy"),
        rounded(F.avg(_ratio(hits, seen)), digits).alias("precision_macro"),
        rounded(F.avg(_ratio(hits, support)), digits).alias("recall_macro"),
        rounded(F.avg(_ratio(2 * hits, support + seen)), digits).alias("f1_macro"),
    )


def regression_metrics(
    scored: DataFrame,
    actual: str = "actual",
    predicted: str = "predicted",
    by: Sequence[str] = (),
    digits: int = 4,
) -> DataFrame:
    """MAE, RMSE and R² in one pass."""
    y, p = quoted(actual).cast("double"), quoted(predicted).cast("double")
    residual = y - p
    unexplained = F.sum(residual * residual)
    spread = F.var_pop(y) * F.count(y)
    return scored.groupBy(*by).agg(
        F.count("*").alias("rows"),
        rounded(F.avg(F.abs(residual)), digits).alias("mae"),
        rounded(F.sqrt(F.avg(residual * residual)), digits).alias("rmse"),
        rounded(1 - unexplained / F.nullif(spread, F.lit(0.0)), digits).alias("r2"),
    )


def score_counts(
    scored: DataFrame, score: str, positive: Column, by: Sequence[str] = ()
) -> DataFrame:
    """(by…, score, pos, neg): ties collapse before anything is ordered."""
    return scored.groupBy(*by, quoted(score).cast("double").alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )


def _cumulated(
    scored: DataFrame, score: str, positive: Column, by: Sequence[str], pieces: int | None
) -> DataFrame:
    """Distinct scores with the positives and negatives at or above each."""
    counts = cut_lineage(score_counts(scored, score, positive, by))
    summed = running_totals(
        counts, "score", {"pos_to": F.col("pos"), "neg_to": F.col("neg")}, by, pieces
    )
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    joined = (
        summed.join(totals, list(by)) if by else summed.crossJoin(F.broadcast(totals))
    )
    return joined.withColumn("tp", F.col("P") - F.col("pos_to") + F.col("pos")).withColumn(
        "fp", F.col("N") - F.col("neg_to") + F.col("neg")
    )


def roc_auc(
    scored: DataFrame,
    score: str,
    positive: Column,
    by: Sequence[str] = (),
    pieces: int | None = None,
) -> DataFrame:
    """Rank-sum area under the curve; a tie counts one half."""
    points = _cumulated(scored, score, positive, by, pieces)
    below = F.col("neg_to") - F.col("neg")
    wins = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2))
    size = F.max("P").cast("double") * F.max("N")
    return points.groupBy(*by).agg(
        F.max("P").alias("positives"),
        F.max("N").alias("negatives"),
        rounded(wins / F.nullif(size, F.lit(0.0))).alias("roc_auc"),
    )


def roc_auc_weighted(
    scored: DataFrame, scores: Sequence[tuple[str, str]], actual: str = "actual"
) -> DataFrame:
    """One-versus-rest AUC weighted by class size; ``scores`` pairs label and column."""
    entries = F.array(
        *[
            F.struct(F.lit(label).alias("label"), quoted(column).cast("double").alias("score"))
            for label, column in scores
        ]
    )
    long = scored.select(quoted(actual).cast("string").alias("_y"), F.explode(entries).alias("e"))
    long = long.select("_y", "e.label", "e.score")
    per_class = roc_auc(long, "score", F.col("_y") == F.col("label"), ["label"])
    weight = F.when(F.col("roc_auc").isNotNull(), F.col("positives"))
    return per_class.agg(
        rounded(F.sum(F.col("roc_auc") * weight) / F.sum(weight)).alias("roc_auc")
    )


def roc_curve(
    scored: DataFrame, score: str, positive: Column, pieces: int | None = None
) -> DataFrame:
    """One point per distinct score, from the highest down, and the origin."""
    points = _cumulated(scored, score, positive, [], pieces)
    curve = points.select(
        F.col("score").alias("threshold"),
        rounded(F.col("fp") / F.nullif(F.col("N"), F.lit(0)), 6).alias("fpr"),
        rounded(F.col("tp") / F.nullif(F.col("P"), F.lit(0)), 6).alias("tpr"),
    )
    origin = scored.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return curve.unionByName(origin)


def pr_curve(
    scored: DataFrame, score: str, positive: Column, pieces: int | None = None
) -> DataFrame:
    points = _cumulated(scored, score, positive, [], pieces)
    return points.select(
        F.col("score").alias("threshold"),
        rounded(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"),
        rounded(F.col("tp") / F.nullif(F.col("P"), F.lit(0)), 6).alias("recall"),
    )


def average_precision(
    scored: DataFrame, score: str, positive: Column, pieces: int | None = None
) -> DataFrame:
    """Sum of precision times recall gain; the gain at a score is pos / P."""
    points = _cumulated(scored, score, positive, [], pieces)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    gain = F.col("pos") / F.nullif(F.col("P"), F.lit(0))
    return points.agg(rounded(F.sum(precision * gain)).alias("average_precision"))


def auc(
    scored: DataFrame, score: str, positive: Column, pieces: int | None = None
) -> DataFrame:
    """Trapezoid area of the ROC curve.

    Each distinct score is one segment of width neg/N that starts at the true
    positive rate of the higher scores, so no neighbour has to be looked up.
    """
    points = _cumulated(scored, score, positive, [], pieces)
    width = F.col("neg") / F.nullif(F.col("N"), F.lit(0))
    height = (2 * F.col("tp") - F.col("pos")) / (2 * F.nullif(F.col("P"), F.lit(0)))
    return points.agg(rounded(F.sum(width * height)).alias("auc"))


def thin(curve: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """At most n evenly spaced points of a curve, ends included."""
    return evenly_spaced(curve, n, order_by).drop("_pos")


def threshold_analysis(
    scored: DataFrame, score: str, positive: Column, thresholds: Sequence[float]
) -> DataFrame:
    """Counts and metrics at each threshold from one pass over the rows.

    Rows are counted per interval between thresholds; the few intervals are
    then summed from the top.
    """
    cuts = sorted(set(float(t) for t in thresholds))
    s = quoted(score).cast("double")
    interval = F.lit(0)
    for cut in cuts:
        interval = interval + F.when(s >= cut, 1).otherwise(0)
    counts = scored.groupBy(interval.alias("b")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    one = counts.agg(
        *[F.coalesce(F.sum(F.when(F.col("b") > i, F.col("pos"))), F.lit(0)).alias(f"tp{i}") for i in range(len(cuts))],
        *[F.coalesce(F.sum(F.when(F.col("b") > i, F.col("neg"))), F.lit(0)).alias(f"fp{i}") for i in range(len(cuts))],
        F.sum("pos").alias("P"),
        F.sum("neg").alias("N"),
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(cut).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
                (F.col("N") - F.col(f"fp{i}")).alias("tn"), (F.col("P") - F.col(f"tp{i}")).alias("fn"),
            )
            for i, cut in enumerate(cuts)
        ]
    )
    rows = one.select(F.explode(entries).alias("r")).select("r.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.select(
        "*",
        rounded(_ratio(tp, tp + fp)).alias("precision"),
        rounded(_ratio(tp, tp + fn)).alias("recall"),
        rounded(_ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
    )


def metric_rows(one_row: DataFrame, metrics: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Wide metrics to (keep…, metric, value)."""
    entries = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    return one_row.select(*keep, F.explode(entries).alias("m")).select(*keep, "m.metric", "m.value")


CLASSIFICATION = ["accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro"]
REGRESSION = ["mae", "rmse", "r2"]


def error_samples(
    scored: DataFrame, key: Sequence[str], task: str, k: int = 20,
    actual: str = "actual", predicted: str = "predicted",
) -> DataFrame:
    """First k wrong rows by key, or the k largest absolute residuals."""
    if task == "classification":
        wrong = scored.where(quoted(actual).cast("string") != quoted(predicted).cast("string"))
        return wrong.orderBy(*key).limit(k)
    gap = F.abs(quoted(actual) - quoted(predicted))
    return scored.withColumn("absolute_error", gap).orderBy(F.desc("absolute_error"), *key).limit(k)


def residuals(
    scored: DataFrame, key: Sequence[str], k: int = 50,
    actual: str = "actual", predicted: str = "predicted",
) -> DataFrame:
    rows = scored.orderBy(*key).limit(k)
    return rows.select(
        *key, actual, predicted, rounded(quoted(actual) - quoted(predicted)).alias("residual")
    )


def class_weights(df: DataFrame, label: str, mode: str = "auto") -> DataFrame:
    """(label, count, weight): n / (classes × count), or one.

    ``auto`` balances only when the largest class reaches sixty percent.
    """
    counts = df.where(quoted(label).isNotNull()).groupBy(
        quoted(label).cast("string").alias("label")
    ).agg(F.count("*").alias("count"))
    total = counts.agg(
        F.sum("count").alias("n"), F.count("*").alias("k"), F.max("count").alias("top")
    )
    balanced = F.col("n") / (F.col("k") * F.col("count"))
    if mode == "balanced":
        weight = balanced
    elif mode == "none":
        weight = F.lit(1.0)
    elif mode == "auto":
        weight = F.when(F.col("top") / F.col("n") >= 0.6, balanced).otherwise(F.lit(1.0))
    else:
        raise ValueError(f"unknown weight mode: {mode}")
    return counts.crossJoin(F.broadcast(total)).select("label", "count", rounded(weight, 6).alias("weight"))


def select_best(results: DataFrame, task: str, metric: str | None = None) -> DataFrame:
    """Rank models: cross-validated value before holdout, NULLs last."""
    if task == "classification":
        order = F.coalesce("cv_mean", metric or "f1_macro").desc_nulls_last()
    else:
        order = F.coalesce("cv_mean", metric or "rmse").asc_nulls_last()
    from pyspark.sql import Window

    # One row per trained model: small by construction.
    ranked = Window.orderBy(order, F.col("model"))
    return results.withColumn("rank", F.row_number().over(ranked)).withColumn(
        "is_best", F.col("rank") == 1
    )
