"""Chart-ready aggregates: the data of a chart, not its drawing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import dates
from tabloom.functions.stats import sample_skewness
from tabloom.functions.stats import pearson
from tabloom.functions.values import (
    OTHER_LABEL,
    as_label,
    null_if_nan,
    quoted,
    rounded,
    safe_ratio,
    to_number,
)
from tabloom.operators import eda
from tabloom.operators.profile import missing_by_column, moments, schema_table
from tabloom.plans.longform import numeric_long, to_long
from tabloom.plans.ordering import evenly_spaced
from tabloom.plans.quantiles import long_quantiles

# How much of each kind a chart shows.
FALLBACK_BINS = 12
FIXED_BINS = 10


def _number(df: DataFrame, column: str) -> Column:
    return to_number(quoted(column), df.schema[column].dataType, strip_commas=True)


def _label(df: DataFrame, column: str) -> Column:
    return as_label(null_if_nan(quoted(column), df.schema[column].dataType))


def missing_bar(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return (
        missing_by_column(df, columns)
        .where(F.col("missing_count") > 0)
        .select("column", "missing_count", "missing_ratio")
        .orderBy(F.desc("missing_count"), "column")
    )


def missing_heatmap(
    df: DataFrame, order_by: Sequence[str], n: int = 80, columns: Sequence[str] | None = None,
    most_columns: int | None = None,
) -> DataFrame:
    """(row_index, column, is_missing) on evenly spaced rows and (the first) columns with gaps."""
    names = list(columns or df.columns)
    gaps = (
        missing_by_column(df, names)
        .where(F.col("missing_count") > 0)
        .join(F.broadcast(schema_table(df, names)), "column")
        .orderBy("position")
        .limit(len(names) if most_columns is None else most_columns)
        .select("column")
    )
    sample = evenly_spaced(df, n, order_by)
    # The sample holds at most n rows, so numbering it in one task is bounded.
    numbered = sample.withColumn(
        "row_index", (F.row_number().over(Window.orderBy("_pos")) - 1).cast("int")
    )
    keyed = numbered.select("row_index", *[quoted(c) for c in names if c != "row_index"])
    long = to_long(keyed, names, keep=["row_index"])
    return long.join(F.broadcast(gaps), "column", "left_semi").select(
        "row_index", "column", F.col("value").isNull().cast("int").alias("is_missing")
    )


def correlation_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Indexed matrix cells; the strongest off-diagonal pair is marked."""
    names = list(columns)
    cells = eda.correlation_matrix(df, names)
    best = eda.strongest_pairs(df, names, 1).select(
        F.col("column_a").alias("_a"), F.col("column_b").alias("_b")
    )
    best = best.agg(F.first("_a").alias("_a"), F.first("_b").alias("_b"))

    def index(name: str) -> Column:
        return (F.array_position(F.array(*map(F.lit, names)), F.col(name)) - 1).cast("int")

    hit = ((F.col("column_x") == F.col("_a")) & (F.col("column_y") == F.col("_b"))) | (
        (F.col("column_x") == F.col("_b")) & (F.col("column_y") == F.col("_a"))
    )
    return cells.crossJoin(F.broadcast(best)).select(
        index("column_x").alias("x_index"),
        index("column_y").alias("y_index"),
        "column_x",
        "column_y",
        "correlation",
        F.coalesce(hit, F.lit(False)).alias("is_strongest"),
    )


def _boxes(long: DataFrame, by: Sequence[str], groups: int | None) -> DataFrame:
    bounds = eda.fences(long, by)
    # Without groups there is one row per column; with them adaptive execution decides.
    bounds = F.broadcast(bounds) if groups is None else bounds
    v = F.col("value")
    inside = (v >= F.col("lower")) & (v <= F.col("upper"))
    return (
        long.join(bounds, list(by))
        .groupBy(*by, "q25", "median", "q75")
        .agg(
            F.count("*").alias("count"),
            F.min(F.when(inside, v)).alias("low"),
            F.max(F.when(inside, v)).alias("high"),
            F.count_if(~inside).alias("outlier_count"),
        )
        .where((F.col("count") >= 4) & F.col("low").isNotNull())
        .select(
            *by,
            "count",
            rounded(F.col("low")).alias("whisker_low"),
            rounded(F.col("q25")).alias("q25"),
            rounded(F.col("median")).alias("median"),
            rounded(F.col("q75")).alias("q75"),
            rounded(F.col("high")).alias("whisker_high"),
            "outlier_count",
        )
    )


def box_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whiskers are the extreme inliers of the IQR fences."""
    return _boxes(numeric_long(df, columns), ["column"], None)


def box_outliers(
    df: DataFrame, columns: Sequence[str], order_by: Sequence[str], limit: int | None = None
) -> DataFrame:
    """The outlier points of a box chart in row order, all or the first ``limit``."""
    long = numeric_long(df, columns, keep=order_by)
    bounds = eda.fences(long.select("column", "value"))
    v = F.col("value")
    outside = (v < F.col("lower")) | (v > F.col("upper"))
    position = F.array_position(F.array(*map(F.lit, columns)), F.col("column"))
    points = long.join(F.broadcast(bounds), "column").where(outside).orderBy(position, *order_by)
    return (
        (points if limit is None else points.limit(limit))
        .select("column", *order_by, rounded(v).alias("value"))
    )


def top_groups(labelled: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent labels, ties by label."""
    counts = labelled.groupBy(column).agg(F.count("*").alias("_n"))
    return counts.orderBy(F.desc("_n"), column).limit(n).select(column)


def box_stats_by(df: DataFrame, value: str, group: str, n: int = 12) -> DataFrame:
    pairs = df.select(
        _label(df, group).alias("group"), _number(df, value).alias("value")
    ).where(F.col("value").isNotNull())
    kept = pairs.join(F.broadcast(top_groups(pairs, "group", n)), "group", "left_semi")
    return _boxes(kept, ["group"], n)


def _bin_counts(values: DataFrame, shape: DataFrame) -> DataFrame:
    """(bin, lower, upper, count) for one row (lo, hi, bins) of ``shape``."""
    v, lo, bins = F.col("v"), F.col("lo"), F.col("bins")
    step = (F.col("hi") - lo) / bins
    guess = F.least(
        F.floor((v - lo) * bins / (F.col("hi") - lo)).cast("int"), (bins - 1).cast("int")
    )
    guess = F.when(F.col("hi") == lo, F.lit(0)).otherwise(guess)
    # Rounding may put a value one bin off its edges.
    down = (v < lo + F.col("g") * step).cast("int")
    up = ((v >= lo + (F.col("g") + 1) * step) & (F.col("g") + 1 < bins)).cast("int")
    counts = (
        values.crossJoin(F.broadcast(shape))
        .withColumn("g", guess)
        .groupBy((F.col("g") - down + up).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    all_bins = shape.select("*", F.explode(F.sequence(F.lit(0), (bins - 1).cast("int"))).alias("bin"))
    last = F.col("bin") + 1 == bins
    return all_bins.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        rounded(lo + F.col("bin") * step).alias("lower_bound"),
        rounded(F.when(last, F.col("hi")).otherwise(lo + (F.col("bin") + 1) * step)).alias(
            "upper_bound"
        ),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def _values(df: DataFrame, column: str) -> DataFrame:
    return df.select(_number(df, column).alias("v")).where(F.col("v").isNotNull())


def histogram_auto(df: DataFrame, column: str, most_bins: int | None = None) -> DataFrame:
    """Bin width is the smaller of Sturges and Freedman–Diaconis; if that makes more
    than ``most_bins`` bins, there are twelve."""
    values = _values(df, column)
    quartiles = long_quantiles(
        values.select(F.lit("c").alias("column"), F.col("v").alias("value")), [0.25, 0.75]
    )
    size = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    iqr = F.col("q")[1] - F.col("q")[0]
    ptp = F.col("hi") - F.col("lo")
    sturges = ptp / (F.log2("n") + 1)
    scott_free = 2 * iqr / F.pow(F.col("n"), F.lit(1.0 / 3.0))
    width = F.when(scott_free > 0, F.least(scott_free, sturges)).otherwise(sturges)
    if "int" in df.schema[column].dataType.simpleString():
        width = F.greatest(width, F.lit(1.0))
    wanted = F.when(ptp > 0, F.ceil(ptp / width)).otherwise(F.lit(1))
    shape = size.crossJoin(F.broadcast(quartiles)).where(ptp > 0).select(
        "lo",
        "hi",
        (wanted if most_bins is None else F.when(wanted > most_bins, F.lit(FALLBACK_BINS)).otherwise(wanted))
        .cast("long").alias("bins"),
    )
    return _bin_counts(values, shape)


def histogram(df: DataFrame, column: str, bins: int = FIXED_BINS) -> DataFrame:
    """min(bins, distinct values) equal bins."""
    values = _values(df, column)
    few = values.distinct().limit(bins).agg(F.count("*").alias("bins"))
    shape = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).crossJoin(F.broadcast(few))
    return _bin_counts(values, shape.where(F.col("bins") >= 2))


def skew_note(df: DataFrame, column: str) -> DataFrame:
    v = _values(df, column)
    skew = rounded(sample_skewness(F.col("v")))
    return v.agg(skew.alias("skewness")).withColumn(
        "note",
        F.when(F.col("skewness").isNull(), "unknown")
        .when(F.abs("skewness") >= 1, "strongly skewed")
        .otherwise("limited skew"),
    )


def category_bar(df: DataFrame, column: str, n: int = 12) -> DataFrame:
    """Top n labels; the rest is summed as one row."""
    counts = df.groupBy(_label(df, column).alias("label")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("total"), F.count("*").alias("labels"))
    top = counts.orderBy(F.desc("c"), "label").limit(n)
    ranked = top.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("c"), "label"))  # n rows at most
    )
    shown = ranked.crossJoin(F.broadcast(total)).select(
        "rank", "label", F.col("c").alias("count"), safe_ratio(F.col("c"), F.col("total")).alias("ratio")
    )
    rest = top.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("s")).crossJoin(F.broadcast(total))
    other = rest.where(F.col("labels") > n).select(
        F.lit(n + 1).alias("rank"),
        F.lit(OTHER_LABEL).alias("label"),
        (F.col("total") - F.col("s")).alias("count"),
        safe_ratio(F.col("total") - F.col("s"), F.col("total")).alias("ratio"),
    )
    return shown.unionByName(other)


def top_categories(df: DataFrame, column: str, n: int = 10, most_unique: int | None = None) -> DataFrame:
    """Top values of a column; with ``most_unique``, nothing if it has more distinct values."""
    counts = df.groupBy(_label(df, column).alias("label")).agg(F.count("*").alias("count"))
    top = counts.orderBy(F.desc("count"), "label").limit(n)
    if most_unique is None:
        return top
    few = counts.limit(most_unique + 1).agg((F.count("*") <= most_unique).alias("few"))
    return top.crossJoin(F.broadcast(few)).where("few").select("label", "count")


def target_distribution(df: DataFrame, target: str, task: str) -> DataFrame:
    """Classes with counts, or a histogram for a regression target."""
    if task == "regression":
        return histogram_auto(df, target)
    present = df.where(null_if_nan(quoted(target), df.schema[target].dataType).isNotNull())
    counts = present.groupBy(quoted(target).cast("string").alias("label")).agg(
        F.count("*").alias("count")
    )
    total = counts.agg(F.sum("count").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(
        "label", "count", safe_ratio(F.col("count"), F.col("_t")).alias("ratio")
    )


def composition(df: DataFrame, feature: str, target: str, n: int = 12) -> DataFrame:
    """Share of each top feature value within every target class."""
    cells = df.groupBy(_label(df, target).alias("target"), _label(df, feature).alias("feature")).agg(
        F.count("*").alias("count")
    )
    tops = (
        cells.groupBy("feature")
        .agg(F.sum("count").alias("_n"))
        .orderBy(F.desc("_n"), "feature")
        .limit(n)
        .select("feature")
    )
    kept = cells.join(F.broadcast(tops), "feature", "left_semi")
    totals = kept.groupBy("target").agg(F.sum("count").alias("_t"))
    grid = totals.crossJoin(F.broadcast(tops))
    full = grid.join(kept, ["target", "feature"], "left")
    count = F.coalesce("count", F.lit(0))
    return full.select(
        "target", "feature", count.alias("count"), safe_ratio(count, F.col("_t")).alias("share")
    )


def scatter_sample(
    df: DataFrame, x: str, y: str, order_by: Sequence[str], n: int = 200
) -> DataFrame:
    """Evenly spaced complete points and the correlation of that sample."""
    points = df.select(
        *order_by, _number(df, x).alias("x"), _number(df, y).alias("y")
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    sample = evenly_spaced(points, n, order_by).drop("_pos")
    corr = sample.agg(rounded(pearson("x", "y")).alias("correlation"))
    return sample.crossJoin(F.broadcast(corr)).select(
        *order_by, rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"), "correlation"
    )


def daily_mean(df: DataFrame, ts: str, value: str) -> DataFrame:
    stamp = dates.parse_timestamp(quoted(ts), df.schema[ts].dataType)
    pairs = df.select(F.to_date(stamp).alias("day"), _number(df, value).alias("v")).dropna()
    return pairs.groupBy("day").agg(rounded(F.avg("v")).alias("value"))


def mean_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    pairs = df.select(_label(df, group).alias("group"), _number(df, value).alias("v"))
    return (
        pairs.where(F.col("v").isNotNull())
        .groupBy("group")
        .agg(F.count("*").alias("count"), rounded(F.avg("v")).alias("mean"))
    )


def linspace_sample(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """Rows at evenly spaced positions of the order key."""
    return evenly_spaced(df, n, order_by).drop("_pos")


def rank_features(df: DataFrame, target: str, columns: Sequence[str], task: str) -> DataFrame:
    """Class separation, or absolute correlation with a numeric target."""
    names = [c for c in columns if c != target]
    if task == "regression":
        numbers = df.select(
            _number(df, target).alias("_t"), *[_number(df, c).alias(f"_v{i}") for i, c in enumerate(names)]
        )
        one = numbers.agg(*[pearson(f"_v{i}", "_t").alias(f"_c{i}") for i in range(len(names))])
        entries = [
            F.struct(F.lit(c).alias("column"), rounded(F.abs(f"_c{i}")).alias("score"))
            for i, c in enumerate(names)
        ]
        scored = one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    else:
        keyed = df.select(
            _label(df, target).alias("_t"), *[quoted(c) for c in names]
        )
        long = numeric_long(keyed, names, keep=["_t"])
        # Mean per class first: a few rows per column reach the second step.
        means = long.groupBy("column", "_t").agg(F.avg("value").alias("m"))
        spread = means.groupBy("column").agg(
            (F.max("m") - F.min("m")).alias("range"), F.count("*").alias("classes")
        )
        scored = (
            spread.where(F.col("classes") >= 2)
            .join(F.broadcast(moments(df, names).select("column", "std")), "column")
            .where(F.col("std") > 0)
            .select("column", rounded(F.col("range") / F.col("std")).alias("score"))
        )
    position = F.array_position(F.array(*map(F.lit, names)), F.col("column"))
    return scored.where(F.col("score").isNotNull()).orderBy(F.desc("score"), position)


@dataclass(frozen=True)
class ChartSpec:
    chart_type: str
    x: str | None = None
    y: str | None = None
    group: str | None = None
    target: str | None = None
    task: str = "classification"
    sample_rows: int = 80
    max_categories: int = 12


class ChartError(ValueError):
    """The request does not fit the columns of the table."""


def chart(df: DataFrame, spec: ChartSpec, order_by: Sequence[str] = ()) -> DataFrame:
    """Check a chart request against the schema and build its data."""

    def need(column: str | None, kind: str = "any") -> str:
        if not column or column not in df.columns:
            raise ChartError(f"no such column: {column}")
        type_name = df.schema[column].dataType.simpleString()
        numeric = type_name in ("tinyint", "smallint", "int", "bigint", "float", "double") or (
            type_name.startswith("decimal")
        )
        if kind == "numeric" and not numeric:
            raise ChartError(f"column must be numeric: {column}")
        if kind == "datetime" and not type_name.startswith(("date", "timestamp")):
            raise ChartError(f"column must be a date: {column}")
        return column

    kind = spec.chart_type
    if kind == "histogram":
        return histogram_auto(df, need(spec.x, "numeric"))
    if kind == "boxplot":
        value = need(spec.x, "numeric")
        if spec.group:
            return box_stats_by(df, value, need(spec.group), spec.max_categories)
        return box_stats(df, [value])
    if kind == "category_bar":
        return category_bar(df, need(spec.x), spec.max_categories)
    if kind == "scatter":
        return scatter_sample(
            df, need(spec.x, "numeric"), need(spec.y, "numeric"), order_by, spec.sample_rows
        )
    if kind == "line":
        return daily_mean(df, need(spec.x, "datetime"), need(spec.y, "numeric"))
    if kind == "correlation_heatmap":
        names = [need(c, "numeric") for c in (spec.x, spec.y) if c]
        return correlation_cells(df, names or eda.analysed_columns(df))
    if kind == "feature_target":
        target = need(spec.target)
        x = need(spec.x)
        if spec.task == "regression":
            return scatter_sample(df, x, target, order_by, spec.sample_rows)
        numeric = x in eda.analysed_columns(df)
        if numeric:
            return box_stats_by(df, x, target, spec.max_categories)
        return composition(df, x, target, spec.max_categories)
    raise ChartError(f"unknown chart type: {kind}")


def recommend_charts(
    profile: DataFrame, per_family: int | None = None, heatmap_columns: int | None = None,
    correlated: int | None = None, boxes: int | None = None,
) -> DataFrame:
    """(chart, family, priority, columns) that apply to a profiled table.

    The limits keep the first columns of a chart family; by default all are kept.
    The profile has one row per column of the table, so its windows are small.
    """
    role = F.col("semantic_role")
    usable = profile.where(role != "identifier")
    feature = role != "target_candidate"
    numeric = usable.where(feature & (F.col("inferred_type") == "numeric"))
    categorical = usable.where(feature & F.col("inferred_type").isin("categorical", "boolean"))
    by_position = Window.orderBy("position")

    def first(rows: DataFrame, k: int | None) -> DataFrame:
        numbered = rows.withColumn("r", F.row_number().over(by_position))
        return numbered if k is None else numbered.where(F.col("r") <= k)

    def joined() -> Column:
        listed = F.array_sort(F.collect_list(F.struct("position", "column")))
        return F.array_join(F.transform(listed, lambda s: s["column"]), ",")

    def whole(rows: DataFrame, name: str, family: str, priority: int, least: int) -> DataFrame:
        return rows.agg(joined().alias("columns"), F.count("*").alias("n")).where(
            F.col("n") >= least
        ).select(
            F.lit(name).alias("chart"), F.lit(family).alias("family"),
            F.lit(priority).alias("priority"), "columns",
        )

    def each(rows: DataFrame, name: str, family: str, priority: int) -> DataFrame:
        return first(rows, per_family).select(
            F.lit(name).alias("chart"), F.lit(family).alias("family"),
            (F.col("r") - 1 + priority).cast("int").alias("priority"), F.col("column").alias("columns"),
        )

    gaps = usable.where(F.col("missing_count") > 0)
    target = first(usable.where(role == "target_candidate"), 1)
    dated = first(usable.where(F.col("inferred_type") == "datetime"), 1)
    measure = first(numeric, 1)
    trend = first(dated.drop("r").unionByName(measure.drop("r")), 2)
    trend_ok = trend.agg(
        F.max(F.when(F.col("inferred_type") == "datetime", F.col("column"))).alias("d"),
        F.max(F.when(F.col("inferred_type") == "numeric", F.col("column"))).alias("v"),
    ).where(F.col("d").isNotNull() & F.col("v").isNotNull())
    parts = [
        whole(gaps, "missing_bar", "quality", 10, 1),
        whole(first(gaps, heatmap_columns), "missing_heatmap", "quality", 11, 1),
        whole(first(numeric, correlated), "correlation_heatmap", "relationship", 20, 2),
        whole(first(numeric, boxes), "box_overview", "distribution", 30, 1),
        each(numeric, "histogram", "distribution", 40),
        each(categorical, "category_bar", "category", 50),
        whole(target, "target_distribution", "target", 60, 1),
        whole(target, "feature_target", "target", 70, 1),
        trend_ok.select(
            F.lit("line").alias("chart"), F.lit("trend").alias("family"),
            F.lit(80).alias("priority"), F.concat_ws(",", "d", "v").alias("columns"),
        ),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result

