"""Feature selection and preparation.

Tidy functions give the values a preparation step uses; the ``pyspark.ml``
stages at the end are what training pipelines are made of.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    ElementwiseProduct,
    Normalizer,
    OneHotEncoder,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import dates
from tabloom.functions.values import (
    null_if_nan,
    quoted,
    rounded,
    to_number,
)
from tabloom.plans.longform import numeric_long
from tabloom.plans.quantiles import long_quantiles
from tabloom.plans.sizing import spread
from tabloom.session import cut_lineage

# Names and length that make a label column text, feature limits.
TEXT_NAMES = [
    "comment", "comments", "description", "message", "note", "notes", "review",
    "summary", "text",
]
TEXT_FEATURE_LENGTH = 20.0
MANY_FEATURES = 5000
DATE_FEATURES = ["year", "month", "day", "dayofweek", "quarter", "is_month_end"]
WORD = r"[\p{L}\p{N}_]{2,}"
INFREQUENT = "(infrequent)"


class FeatureError(ValueError):
    """No usable feature, or an unknown column was asked for."""


def select_features(
    profile: DataFrame,
    target: str | None = None,
    requested: Sequence[str] = (),
    excluded: Sequence[str] = (),
) -> DataFrame:
    """(column, included, reason) for every profiled column."""
    name = F.col("column")
    reason = F.when(name == F.lit(target), "target") if target else F.when(F.lit(False), "")
    if excluded:
        reason = reason.when(name.isin(list(excluded)), "excluded")
    reason = (
        reason.when(F.col("semantic_role") == "identifier", "identifier")
        .when(F.col("semantic_role") == "target_candidate", "other target")
        .when(F.col("inferred_type") == "unknown", "unknown type")
    )
    if requested:
        reason = reason.when(~name.isin(list(requested)), "not requested")
    return profile.select(
        "column", "position", reason.isNull().alias("included"),
        F.coalesce(reason, F.lit("")).alias("reason"),
    )


def feature_groups(
    profile: DataFrame, include_text: bool = True, include_datetime: bool = True
) -> DataFrame:
    """(column, group): numeric, categorical, datetime, text or excluded."""
    kind = F.col("inferred_type")
    texty = F.lower(F.trim("column")).isin(TEXT_NAMES) | (F.col("mean_length") >= TEXT_FEATURE_LENGTH)
    labelled = kind.isin("categorical", "boolean")
    group = F.when(kind == "numeric", "numeric")
    if include_text:
        group = group.when(labelled & texty, "text").when(kind == "text", "text")
    group = group.when(labelled, "categorical")
    if include_datetime:
        group = group.when(kind == "datetime", "datetime")
    return profile.select("column", "position", group.otherwise("excluded").alias("group"))


def estimate_features(
    profile: DataFrame, text_features: int = 100, include_text: bool = True
) -> DataFrame:
    """One row: expected width of the prepared matrix and a warning above 5 000."""
    groups = feature_groups(profile, include_text).drop("position")
    joined = profile.join(F.broadcast(groups), "column")  # one row per column
    width = (
        F.when(F.col("group") == "numeric", 1)
        .when(F.col("group") == "datetime", len(DATE_FEATURES))
        .when(F.col("group") == "categorical", F.greatest(F.lit(1), F.col("unique_count")))
        .when(F.col("group") == "text", text_features)
        .otherwise(0)
    )
    total = F.sum(width)
    return joined.agg(total.alias("estimated_features"), (total > MANY_FEATURES).alias("is_wide"))


def _one_row(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """One row (a_i, b_i): centre and scale of each column."""
    numbers = df.select(
        *[to_number(quoted(c), df.schema[c].dataType).alias(f"_v{i}") for i, c in enumerate(columns)]
    )
    if kind == "robust":
        q = long_quantiles(numeric_long(df, columns, strip_commas=False), [0.25, 0.5, 0.75])
        picks = []
        for i, c in enumerate(columns):
            here = F.max(F.when(F.col("column") == c, F.col("q")))
            picks += [here[1].alias(f"_a{i}"), (here[2] - here[0]).alias(f"_b{i}")]
        return q.agg(*picks)
    picks = []
    for i in range(len(columns)):
        v = f"_v{i}"
        if kind == "standard":
            picks += [F.avg(v).alias(f"_a{i}"), F.stddev_pop(v).alias(f"_b{i}")]
        elif kind == "minmax":
            picks += [F.min(v).alias(f"_a{i}"), (F.max(v) - F.min(v)).alias(f"_b{i}")]
        else:
            raise FeatureError(f"unknown scaler: {kind}")
    return numbers.agg(*picks)


def scale(df: DataFrame, columns: Sequence[str], kind: str = "standard") -> DataFrame:
    """standard (population std), robust (median, IQR) or minmax; zero scale is one."""
    joined = df.crossJoin(F.broadcast(_one_row(df, columns, kind)))
    scaled = {}
    for i, c in enumerate(columns):
        v = to_number(quoted(c), df.schema[c].dataType)
        spread = F.when(F.col(f"_b{i}") == 0, 1.0).otherwise(F.col(f"_b{i}"))
        scaled[c] = (v - F.col(f"_a{i}")) / spread
    return joined.select(*[scaled.get(c, quoted(c)).alias(c) for c in df.columns])


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    from tabloom.operators.recipe import Fill, fill_missing

    return fill_missing(df, [Fill(c, "mode") for c in columns])


def impute_numeric(df: DataFrame, columns: Sequence[str], strategy: str = "median") -> DataFrame:
    from tabloom.operators.recipe import Fill, fill_missing

    return fill_missing(df, [Fill(c, strategy) for c in columns])


def level_map(df: DataFrame, column: str, min_frequency: int = 1) -> DataFrame:
    """(level, mapped): levels below the minimum share one name."""
    counts = df.where(quoted(column).isNotNull()).groupBy(
        quoted(column).cast("string").alias("level")
    ).agg(F.count("*").alias("count"))
    return counts.select(
        "level",
        "count",
        F.when(F.col("count") >= min_frequency, F.col("level")).otherwise(INFREQUENT).alias("mapped"),
    )


def one_hot(
    train: DataFrame, df: DataFrame, column: str, key: Sequence[str], min_frequency: int = 1
) -> DataFrame:
    """Long one-hot: (key…, feature, value); a level unseen in ``train`` gives no row."""
    levels = level_map(train, column, min_frequency)
    cells = df.select(*key, quoted(column).cast("string").alias("level"))
    return cells.join(levels, "level").select(
        *key, F.concat(F.lit(column + "="), "mapped").alias("feature"), F.lit(1.0).alias("value")
    )


def datetime_features(df: DataFrame, column: str) -> DataFrame:
    """Adds year, month, day, dayofweek, quarter and is_month_end."""
    stamp = dates.parse_timestamp(quoted(column), df.schema[column].dataType)
    return df.select(
        "*", *[dates.date_part(stamp, p).cast("int").alias(f"{column}_{p}") for p in DATE_FEATURES]
    )


def words_of(text: Column) -> Column:
    """Lower-cased words of two or more characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def with_pairs(words: Column) -> Column:
    """Words followed by the pairs of neighbouring words."""
    later = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    earlier = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat(words, F.zip_with(earlier, later, lambda a, b: F.concat_ws(" ", a, b)))


def neighbouring_words(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, _word, _next): every word with the one after it, NULL after the last."""
    rows = spread(df.select(*keep, quoted(column)))
    split = rows.select(*keep, words_of(quoted(column)).alias("_words"))
    later = F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0)))
    both = F.explode(F.arrays_zip(F.col("_words").alias("_word"), later.alias("_next"))).alias("_p")
    return split.select(*keep, both).select(*keep, F.col("_p._word").alias("_word"), F.col("_p._next").alias("_next"))


def vocabulary(df: DataFrame, column: str, max_features: int) -> DataFrame:
    """(term, total): the most frequent terms of the whole corpus, ties by term.

    Only neighbouring words are counted row by row; a word's total is the sum over what follows it.
    """
    pairs = neighbouring_words(df, column).groupBy("_word", "_next").agg(F.count("*").alias("n"))
    words = pairs.groupBy(F.col("_word").alias("term")).agg(F.sum("n").alias("total"))
    # No count is below one: with it the condition stays above the sum, and both uses read one shuffle.
    followed = pairs.where(F.col("_next").isNotNull() | (F.col("n") < 1))
    terms = followed.select(F.concat_ws(" ", "_word", "_next").alias("term"), F.col("n").alias("total"))
    return words.unionByName(terms).orderBy(F.desc("total"), "term").limit(max_features)


def tfidf(df: DataFrame, key: str, column: str, max_features: int = 100) -> DataFrame:
    """(key, term, weight) with smoothed idf and unit length per row.

    Only terms of the bounded vocabulary are shuffled by row.
    """
    vocab = cut_lineage(vocabulary(df, column, max_features))
    first = vocab.select(F.substring_index("term", " ", 1).alias("_word")).distinct()
    near = neighbouring_words(df, column, [key]).join(F.broadcast(first), "_word", "left_semi")
    pair = F.when(F.col("_next").isNotNull(), F.concat_ws(" ", "_word", "_next"))
    rows = df.agg(F.count("*").alias("_n"))
    counts = (
        near.select(key, F.explode(F.array("_word", pair)).alias("term"))
        .join(F.broadcast(vocab.select("term")), "term")
        .groupBy(key, "term")
        .agg(F.count("*").alias("tf"))
    )
    df_counts = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = df_counts.crossJoin(F.broadcast(rows)).select(
        "term", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf")
    )
    weighted = counts.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", rounded(F.col("w") / norm, 6).alias("weight"))


# --- pyspark.ml stages -------------------------------------------------------


class _Columns(Params):
    columns = Param(Params._dummy(), "columns", "input columns", TypeConverters.toListString)

    def out(self, column: str) -> str:
        return f"{column}__{self.suffix}"


class NumericPrepModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fill with fitted values, then centre and scale, as plain expressions."""

    suffix = "num"
    fills = Param(Params._dummy(), "fills", "fill values", TypeConverters.toListFloat)
    centres = Param(Params._dummy(), "centres", "centres", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "scales", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        new = {}
        for c, fill, centre, spread in zip(
            get("columns"), get("fills"), get("centres"), get("scales"), strict=True
        ):
            v = to_number(quoted(c), dataset.schema[c].dataType, strip_commas=True)
            new[self.out(c)] = (F.coalesce(v, F.lit(fill)) - centre) / spread
        return dataset.withColumns(new)


class NumericPrep(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Exact imputation (mean, median, most_frequent) and scaling in one fit."""

    suffix = "num"
    strategy = Param(Params._dummy(), "strategy", "imputation", TypeConverters.toString)
    scaler = Param(Params._dummy(), "scaler", "scaling", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns=None, strategy="median", scaler="standard"):
        super().__init__()
        self._setDefault(strategy="median", scaler="standard")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> NumericPrepModel:
        names = self.getOrDefault("columns")
        numbers = dataset.select(
            *[to_number(quoted(c), dataset.schema[c].dataType, strip_commas=True).alias(c) for c in names]
        )
        strategy = self.getOrDefault("strategy")
        fills: dict[str, float | None] = {}
        if strategy == "mean":
            row = numbers.agg(*[F.avg(quoted(c)).alias(c) for c in names]).first()
            fills = row.asDict()
        elif strategy == "median":
            q = long_quantiles(numeric_long(numbers, names), [0.5]).collect()  # one row per column
            fills = {r["column"]: r["q"][0] for r in q}
        elif strategy == "most_frequent":
            for c in names:
                top = numbers.where(quoted(c).isNotNull()).groupBy(quoted(c).alias("v")).count()
                row = top.orderBy(F.desc("count"), "v").first()
                fills[c] = row["v"] if row else None
        else:
            raise FeatureError(f"unknown imputation: {strategy}")
        values = [float(fills.get(c) or 0.0) for c in names]
        filled = numbers.select(
            *[F.coalesce(quoted(c), F.lit(v)).alias(c) for c, v in zip(names, values, strict=True)]
        )
        kind = self.getOrDefault("scaler")
        if kind == "none":
            centres, scales = [0.0] * len(names), [1.0] * len(names)
        else:
            row = _one_row(filled, names, kind).first()
            centres = [float(row[f"_a{i}"]) for i in range(len(names))]
            scales = [float(row[f"_b{i}"]) or 1.0 for i in range(len(names))]
        model = NumericPrepModel()
        return model._set(columns=names, fills=values, centres=centres, scales=scales)


class LabelPrepModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fill with the most frequent label; rare labels share one name."""

    suffix = "cat"
    fills = Param(Params._dummy(), "fills", "fill labels", TypeConverters.toListString)
    levels = Param(Params._dummy(), "levels", "kept labels per column", TypeConverters.toList)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        new = {}
        for c, fill, kept in zip(get("columns"), get("fills"), get("levels"), strict=True):
            source = null_if_nan(quoted(c), dataset.schema[c].dataType).cast("string")
            label = F.coalesce(source, F.lit(fill))
            if kept:
                label = F.when(label.isin(kept), label).otherwise(INFREQUENT)
            new[self.out(c)] = label
        return dataset.withColumns(new)


class LabelPrep(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps at most rows / min_frequency labels; with 1 every label stays."""

    suffix = "cat"
    minFrequency = Param(Params._dummy(), "minFrequency", "smallest count", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, columns=None, minFrequency=1):
        super().__init__()
        self._setDefault(minFrequency=1)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> LabelPrepModel:
        names, least = self.getOrDefault("columns"), self.getOrDefault("minFrequency")
        fills, levels = [], []
        for c in names:
            counts = level_map(
                dataset.select(null_if_nan(quoted(c), dataset.schema[c].dataType).alias(c)), c, least
            )
            top = counts.orderBy(F.desc("count"), "level").first()
            fills.append(top["level"] if top else "")
            kept = counts.where(F.col("count") >= least) if least > 1 else None
            levels.append(sorted(r["level"] for r in kept.select("level").collect()) if kept is not None else [])
        return LabelPrepModel()._set(columns=names, fills=fills, levels=levels)


class DateFeatures(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Six numeric columns per date column."""

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        new = {}
        for c in self.getOrDefault("columns"):
            stamp = dates.parse_timestamp(quoted(c), dataset.schema[c].dataType)
            for part in DATE_FEATURES:
                new[f"{c}_{part}"] = dates.date_part(stamp, part).cast("double")
        return dataset.withColumns(new)


class Terms(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Words and word pairs of each text column."""

    suffix = "terms"

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = self.getOrDefault("columns")
        split = dataset.withColumns({self.out(c): words_of(quoted(c).cast("string")) for c in names})
        return split.withColumns({self.out(c): with_pairs(quoted(self.out(c))) for c in names})


class SmoothIdf(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Term weights ln((1 + n) / (1 + df)) + 1; fits to a JVM vector product."""

    inputCol = Param(Params._dummy(), "inputCol", "counts", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "weights", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> Transformer:
        source, target = self.getOrDefault("inputCol"), self.getOrDefault("outputCol")
        plain = IDF(inputCol=source, outputCol="_idf").fit(dataset)
        return ElementwiseProduct(
            inputCol=source, outputCol=target, scalingVec=DenseVector(plain.idf.toArray() + 1.0)
        )


@dataclass(frozen=True)
class FeatureConfig:
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    datetime: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    imputer: str = "median"
    scaler: str = "standard"
    min_frequency: int = 1
    text_features: int = 100

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical, *self.datetime, *self.text]


def config_from_profile(profile: DataFrame, target: str | None, **options) -> FeatureConfig:
    """Feature groups of the selected columns (a few rows) as a config."""
    chosen = select_features(profile, target, options.pop("requested", ()), options.pop("excluded", ()))
    groups = feature_groups(profile, options.pop("include_text", True), options.pop("include_datetime", True))
    rows = (
        chosen.where("included").join(groups.drop("position"), "column").orderBy("position").collect()
    )
    by = {g: tuple(r["column"] for r in rows if r["group"] == g) for g in ("numeric", "categorical", "datetime", "text")}
    if not any(by.values()):
        raise FeatureError("no usable feature column")
    return FeatureConfig(**by, **options)


def build_preprocessor(config: FeatureConfig, output: str = "features") -> Pipeline:
    """Impute, scale, encode and assemble into one (sparse) vector."""
    stages, parts = [], []
    if config.numeric:
        prep = NumericPrep(columns=list(config.numeric), strategy=config.imputer, scaler=config.scaler)
        stages.append(prep)
        parts += [prep.out(c) for c in config.numeric]
    if config.categorical:
        prep = LabelPrep(columns=list(config.categorical), minFrequency=config.min_frequency)
        labels = [prep.out(c) for c in config.categorical]
        stages += [
            prep,
            StringIndexer(
                inputCols=labels, outputCols=[f"{c}_ix" for c in labels],
                handleInvalid="keep", stringOrderType="alphabetAsc",
            ),
            # The slot StringIndexer keeps for unseen labels is the last one: dropping
            # it turns an unseen label into zeros.
            OneHotEncoder(
                inputCols=[f"{c}_ix" for c in labels], outputCols=[f"{c}_hot" for c in labels], dropLast=True
            ),
        ]
        parts += [f"{c}_hot" for c in labels]
    if config.datetime:
        derived = [f"{c}_{p}" for c in config.datetime for p in DATE_FEATURES]
        prep = NumericPrep(columns=derived, strategy="most_frequent", scaler=config.scaler)
        stages += [DateFeatures(columns=list(config.datetime)), prep]
        parts += [prep.out(c) for c in derived]
    if config.text:
        words = Terms(columns=list(config.text))
        stages.append(words)
        for c in config.text:
            base = words.out(c)
            stages += [
                CountVectorizer(inputCol=base, outputCol=f"{base}_tf", vocabSize=config.text_features),
                SmoothIdf(inputCol=f"{base}_tf", outputCol=f"{base}_w"),
                Normalizer(inputCol=f"{base}_w", outputCol=f"{base}_unit", p=2.0),
            ]
            parts.append(f"{base}_unit")
    if not parts:
        raise FeatureError("no feature column")
    stages.append(VectorAssembler(inputCols=parts, outputCol=output, handleInvalid="keep"))
    return Pipeline(stages=stages)


def feature_names(prepared: DataFrame, column: str = "features") -> list[str]:
    """Readable names in vector order, from the column's metadata."""
    attributes = prepared.schema[column].metadata.get("ml_attr", {})
    size = attributes.get("num_attrs", 0)
    names = [f"f{i}" for i in range(size)]
    for group in attributes.get("attrs", {}).values():
        for entry in group:
            names[entry["idx"]] = (
                entry.get("name", names[entry["idx"]])
                .replace("__num", "")
                .replace("__cat_ix_hot_", "=")
                .replace("__cat_hot_", "=")
                .replace("__terms_unit_", "~")
            )
    return names


def source_column(feature: str) -> str:
    """Column a prepared feature comes from."""
    for mark in ("=", "~"):
        if mark in feature:
            return feature.split(mark)[0]
    for part in DATE_FEATURES:
        if feature.endswith("_" + part):
            return feature[: -len(part) - 1]
    return feature
