"""Calibration, residual diagnostics, permutation importance and contributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.values import quoted, rounded
from tabloom.operators import metrics as M
from tabloom.operators.features import source_column
from tabloom.operators.supervised import predict
from tabloom.plans.draws import with_draws
from tabloom.plans.longform import numeric_long
from tabloom.plans.ordering import evenly_spaced, hash_position
from tabloom.plans.permute import replicas
from tabloom.plans.quantiles import long_quantiles
from tabloom.session import cut_lineage, shared_folder

# Most rows, background rows, repeats and features shown.
SAMPLE_ROWS = 200
TOP_FEATURES = 15


def calibration(
    scored: DataFrame, score: str, positive: Column, bins: int = 10
) -> DataFrame:
    """(bin, mean_predicted, fraction_positive, count) over quantile bins; empty ones drop out."""
    pairs = scored.select(quoted(score).cast("double").alias("p"), positive.cast("double").alias("y"))
    q = long_quantiles(
        numeric_long(pairs, ["p"]), [i / bins for i in range(bins + 1)]
    ).select("q")
    passed = F.expr(" + ".join(f"CAST(q[{i}] < p AS INT)" for i in range(1, bins)) or "0")
    return (
        pairs.crossJoin(F.broadcast(q))
        .groupBy(passed.alias("bin"))
        .agg(
            rounded(F.avg("p"), 6).alias("mean_predicted"),
            rounded(F.avg("y"), 6).alias("fraction_positive"),
            F.count("*").alias("count"),
        )
    )


def residual_diagnostics(
    scored: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """One row: residual mean, population std, median, largest error."""
    rows = scored.select((quoted(actual) - quoted(predicted)).cast("double").alias("r"))
    one = rows.agg(
        F.count("r").alias("rows"),
        rounded(F.avg("r"), 6).alias("residual_mean"),
        rounded(F.stddev_pop("r"), 6).alias("residual_std"),
        rounded(F.max(F.abs("r")), 6).alias("max_absolute_error"),
    )
    median = long_quantiles(numeric_long(rows, ["r"]), [0.5]).select(
        rounded(F.col("q")[0], 6).alias("residual_median")
    )
    return one.crossJoin(F.broadcast(median))


def residual_points(
    scored: DataFrame, key: Sequence[str], n: int = 250,
    actual: str = "actual", predicted: str = "predicted",
) -> DataFrame:
    """Evenly spaced points of actual, predicted and residual."""
    rows = scored.select(*key, actual, predicted)
    return evenly_spaced(rows, n, key).select(
        *key, actual, predicted, rounded(quoted(actual) - quoted(predicted), 6).alias("residual")
    )


def worst_residuals(
    scored: DataFrame, key: Sequence[str], k: int = 25,
    actual: str = "actual", predicted: str = "predicted",
) -> DataFrame:
    return M.error_samples(scored, key, "regression", k, actual, predicted)


def sample_rows(df: DataFrame, key: Sequence[str], n: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """A bounded sample in seeded hash order: the explanation operators' feature."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def permuted_replicas(df: DataFrame, columns: Sequence[str], key: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """(f, r, columns of ``df``): all rows once per feature number and repeat, that feature shuffled.

    Rows are numbered once, by a unique key.  A keyed permutation of the numbers tells every
    value where it goes; values travel packed and without their places; a NULL is a value like others.
    """
    return _replicas(cut_lineage(hash_position(df, seed, key, name="_pos")), df.columns, columns, repeats, seed)


def _replicas(placed: DataFrame, kept: Sequence[str], columns: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """``permuted_replicas`` of numbered rows."""
    number = F.col("id")
    feature, repeat = F.floor(number / repeats).cast("int"), (number % repeats).cast("int")
    drawn = placed.sparkSession.range(0, len(columns) * repeats, numPartitions=1).orderBy("id")
    keys = [r[0] for r in drawn.select(F.xxhash64(F.lit(seed + 1), feature, repeat)).collect()] if repeats else []
    return replicas(placed, kept, columns, [keys[f * repeats : (f + 1) * repeats] for f in range(len(columns))])


def permutation_importance(
    model: PipelineModel,
    df: DataFrame,
    columns: Sequence[str],
    actual: str,
    task: str,
    key: Sequence[str],
    repeats: int = 5,
    seed: int = 42,
) -> DataFrame:
    """(feature, importance_mean, importance_std): drop of macro-F1 or of −RMSE."""
    names = list(columns)
    used = list(dict.fromkeys([*names, actual]))
    numbered = hash_position(df.select(*[quoted(c) for c in dict.fromkeys([*key, *used])]), seed, key, name="_pos")
    # Without the key and compressed: the table is read once for the base and twice for the replicas.
    path = f"{shared_folder(df.sparkSession)}/numbered"
    numbered.select("_pos", *[quoted(c) for c in used]).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    measure = M.classification_metrics if task == "classification" else M.regression_metrics
    metric = "f1_macro" if task == "classification" else "rmse"
    sign = 1.0 if task == "classification" else -1.0
    base = measure(predict(model, rows), actual, "predicted", digits=9).select(
        (F.col(metric) * sign).alias("base")
    )
    scored = predict(model, _replicas(rows, used, names, repeats, seed))
    each = measure(scored, actual, "predicted", ["f", "r"], digits=9)
    drops = each.crossJoin(F.broadcast(base)).select(
        "f", (F.col("base") - F.col(metric) * sign).alias("drop")
    )
    name = F.element_at(F.array(*map(F.lit, names)), F.col("f") + 1)
    return (
        drops.groupBy(name.alias("feature"))
        .agg(
            rounded(F.avg("drop"), 6).alias("importance_mean"),
            rounded(F.stddev_pop("drop"), 6).alias("importance_std"),
        )
        .orderBy(F.desc("importance_mean"), "feature")
    )


def linear_contributions(
    rows: DataFrame,
    background: DataFrame,
    key: Sequence[str],
    names: Sequence[str],
    coefficients: Sequence[float],
    intercept: float,
    vector: str = "features",
) -> DataFrame:
    """(key…, feature, source_column, contribution, base_value), additive.

    coefficient × (value − background mean); the base value is the prediction
    at the background mean.
    """
    def long(df: DataFrame, keep: Sequence[str]) -> DataFrame:
        column = quoted(vector)
        values = column if df.schema[vector].dataType.typeName() == "array" else vector_to_array(column)
        return df.select(*keep, F.posexplode(values).alias("i", "x"))

    spark = rows.sparkSession
    table = spark.createDataFrame(
        [(i, n, source_column(n), float(c)) for i, (n, c) in enumerate(zip(names, coefficients, strict=True))],
        "i int, feature string, source_column string, coefficient double",
    )
    # One row per feature.
    centre = long(background, []).groupBy("i").agg(F.avg("x").alias("m")).join(F.broadcast(table), "i")
    base = centre.agg((F.sum(F.col("coefficient") * F.col("m")) + intercept).alias("base_value"))
    return (
        long(rows, key)
        .join(F.broadcast(centre), "i")
        .crossJoin(F.broadcast(base))
        .select(
            *key, "feature", "source_column",
            (F.col("coefficient") * (F.col("x") - F.col("m"))).alias("contribution"), "base_value",
        )
    )


def linear_shap(
    model: PipelineModel, rows: DataFrame, background: DataFrame, key: Sequence[str], names: Sequence[str]
) -> DataFrame:
    """Linear contributions of a fitted linear or binary logistic pipeline."""
    prepared, fitted = model.stages[0], model.stages[1]
    return linear_contributions(
        prepared.transform(rows), prepared.transform(background), key, names,
        list(fitted.coefficients.toArray()), float(fitted.intercept),
    )


def sampled_shapley(
    model: PipelineModel,
    rows: DataFrame,
    background: DataFrame,
    columns: Sequence[str],
    key: Sequence[str],
    samples: int = 20,
    output: Column | None = None,
    seed: int = 42,
    background_rows: int | None = None,
) -> DataFrame:
    """(key…, feature, source_column, contribution, base_value) for any model.

    Monte-Carlo Shapley values: each sample walks from a background row to the
    explained row in a random feature order; all steps are scored in one batch.
    Per row the contributions add up to prediction − base value.  ``background_rows``
    draws a sample of the background; by default all of it takes part.
    """
    names = list(columns)
    d = len(names)
    if background_rows is not None:
        background = sample_rows(background, key, background_rows, seed)
    spark = background.sparkSession
    path = f"{shared_folder(spark)}/background"
    hash_position(background.select(*dict.fromkeys([*key, *names])), seed, key).select("_pos", *[quoted(c) for c in names]).write.parquet(path)
    own = {c: f"_key_{i}" for i, c in enumerate(key)}
    # Every row draws by its key, so rows that share a key share their draws; only positions go to the background and
    # only its values come back.
    explained = rows.select(
        *[quoted(c).alias(alias) for c, alias in own.items()], *[quoted(c).alias(f"_own_{j}") for j, c in enumerate(names)]
    ).dropna(subset=list(own.values()))
    met = with_draws(
        explained, F.xxhash64(F.lit(seed + 1), *own.values()), samples, spark.read.parquet(path),
        {c: f"_bg_{j}" for j, c in enumerate(names)},
    )
    ordered = F.array_sort(
        F.array(*[F.struct(F.xxhash64(F.lit(seed), *own.values(), "t", F.lit(j)).alias("h"), F.lit(j).alias("j")) for j in range(d)])
    )
    walks = met.withColumn("_order", F.transform(ordered, lambda s: s["j"])).withColumn(
        "s", F.explode(F.sequence(F.lit(0), F.lit(d)))
    )
    mixed = {
        c: F.when(F.array_position("_order", F.lit(j)) <= F.col("s"), F.col(f"_own_{j}")).otherwise(F.col(f"_bg_{j}"))
        for j, c in enumerate(names)
    }
    steps = walks.select(
        *own.values(), "s", F.get("_order", F.col("s") - 1).alias("_to"), F.get("_order", F.col("s")).alias("_from"),
        *[mixed[c].alias(c) for c in names],
    )
    value = output if output is not None else F.col("prediction")
    scored = predict(model, steps).select(*own.values(), "s", "_to", "_from", value.alias("_f"))
    # A feature gains the value of the step that sets it less that of the step before: no walk has to meet.
    gains = [
        F.sum(F.when(F.col("_to") == j, F.col("_f")).when(F.col("_from") == j, -F.col("_f")).otherwise(F.lit(0.0)))
        for j in range(d)
    ]
    # Rows that share a key share its gain, so the count divides once for the walks and once for the copies.
    walked = F.count_if(F.col("s") == 0)
    summed = scored.groupBy(*own.values()).agg(
        F.avg(F.when(F.col("s") == 0, F.col("_f"))).alias("base_value"),
        F.array(
            *[F.struct(F.lit(c).alias("feature"), (g / walked * (F.lit(samples) / walked)).alias("c")) for c, g in zip(names, gains, strict=True)]
        ).alias("_parts"),
    )
    return summed.select("*", F.explode("_parts").alias("_p")).select(
        *[F.col(alias).alias(c) for c, alias in own.items()],
        F.col("_p.feature").alias("feature"), F.col("_p.feature").alias("source_column"),
        F.col("_p.c").alias("contribution"), "base_value",
    )


def importance(
    contributions: DataFrame, key: Sequence[str], level: str = "source_column"
) -> DataFrame:
    """(name, mean_absolute): per prepared feature, or per source column after
    its features are added up row by row."""
    per_row = contributions.groupBy(*key, F.col(level).alias("name")).agg(F.sum("contribution").alias("c"))
    return (
        per_row.groupBy("name")
        .agg(rounded(F.avg(F.abs("c")), 6).alias("mean_absolute"))
        .orderBy(F.desc("mean_absolute"), "name")
    )


def beeswarm(
    contributions: DataFrame, key: Sequence[str], k: int = TOP_FEATURES
) -> DataFrame:
    """Contribution points of the k features with the largest mean |value|."""
    top = importance(contributions, key, "feature").limit(k).select(F.col("name").alias("feature"))
    return contributions.join(F.broadcast(top), "feature", "left_semi").select(
        *key, "feature", rounded(F.col("contribution"), 6).alias("contribution")
    )


def explain_row(contributions: DataFrame, row: Column, k: int = TOP_FEATURES) -> DataFrame:
    """Largest contributions of one row with its base value and total."""
    own = contributions.where(row)
    total = own.agg(
        (F.max("base_value") + F.sum("contribution")).alias("t")
    ).select(rounded(F.col("t"), 6).alias("prediction"))
    return (
        own.orderBy(F.desc(F.abs("contribution")), "feature")
        .limit(k)
        .crossJoin(F.broadcast(total))
        .select(
            "feature",
            rounded(F.col("contribution"), 6).alias("contribution"),
            rounded(F.col("base_value"), 6).alias("base_value"),
            "prediction",
        )
    )
