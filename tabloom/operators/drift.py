"""Drift between two versions or windows of a table.

Both sides become one long frame (column, value, reference count, current
count); type decisions, PSI, Jensen–Shannon and Kolmogorov–Smirnov read it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.stats import js_term, psi_term, smoothed_share
from tabloom.functions.values import (
    DRIFT_BOOLEAN_TOKENS,
    DRIFT_MISSING_LABEL,
    is_floating_type,
    is_numeric_type,
    is_temporal_type,
    null_if_nan,
    quoted,
    rounded,
    to_number,
)
from tabloom.operators import metrics as M
from tabloom.operators.profile import base_profile, physical_kind, schema_table
from tabloom.plans.longform import numeric_long, rows_from_one, to_long
from tabloom.plans.ordering import running_totals
from tabloom.plans.quantiles import long_quantiles
from tabloom.plans.sizing import spread
from tabloom.session import cut_lineage

# Smoothing, status limits and retrain score.
PSI_DRIFT = 0.25
PSI_WARNING = 0.1
NUMERIC_SHARE = 0.8
DECILES = [i / 10 for i in range(11)]
METRIC_ALARM = 0.1


def _column_kinds(df: DataFrame, observed: bool) -> DataFrame:
    """(column, kind): from the schema, or for text from what the cells hold."""
    kinds = schema_table(df).select("column", F.col("physical").alias("kind"))
    texts = [c for c in df.columns if physical_kind(df.schema[c].dataType) == "text"]
    if not observed or not texts:
        return kinds
    # Only text is looked into; of the other columns no cell is read.
    seen = base_profile(df, texts, approximate=True).select("column", "inferred_type")
    return kinds.join(F.broadcast(seen), "column", "left").select("column", F.coalesce("inferred_type", "kind").alias("kind"))


def schema_drift(reference: DataFrame, current: DataFrame, observed: bool = False) -> DataFrame:
    """(column, change, kinds) for added, removed and retyped columns.

    ``observed`` looks into text columns, so a number stored as text counts as
    a number.
    """
    ref = _column_kinds(reference, observed).withColumnRenamed("kind", "reference_kind")
    cur = _column_kinds(current, observed).withColumnRenamed("kind", "current_kind")
    both = ref.join(cur, "column", "full_outer")
    change = (
        F.when(F.col("reference_kind").isNull(), "added")
        .when(F.col("current_kind").isNull(), "removed")
        .when(F.col("reference_kind") != F.col("current_kind"), "type_changed")
        .otherwise("same")
    )
    return both.select("column", "reference_kind", "current_kind", change.alias("change"))


def shared_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    return [c for c in reference.columns if c in current.columns]


def side_counts(
    reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """(column, value, ref, cur): one shuffle of combined counts for both sides."""
    names = list(columns or shared_columns(reference, current))
    long = to_long(reference.select(*names).withColumn("_side", F.lit(0)), names, ["_side"]).unionByName(
        to_long(current.select(*names).withColumn("_side", F.lit(1)), names, ["_side"])
    )
    return long.groupBy("column", "value").agg(
        F.count_if(F.col("_side") == 0).alias("ref"), F.count_if(F.col("_side") == 1).alias("cur")
    )


def _boolean_bits(column: Column, data_type: T.DataType) -> Column:
    """Aggregate to a bit set of the tokens seen; bit 0 stands for any other value."""
    if isinstance(data_type, T.BooleanType):
        return F.bit_or(F.when(column.isNotNull(), F.lit(2)).cast("long"))
    if is_floating_type(data_type) or is_temporal_type(data_type):
        return F.max(F.when(column.isNotNull(), F.lit(1)).cast("long"))
    token = F.lower(F.trim(column.cast("string")))
    position = F.array_position(F.array(*map(F.lit, DRIFT_BOOLEAN_TOKENS)), token)
    return F.bit_or(F.when(token.isNotNull(), F.pow(F.lit(2), position).cast("long")))


def side_facts(
    reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Kind, shares and means per column from one scan that shuffles a single row."""
    names = list(columns or shared_columns(reference, current))

    def side(df: DataFrame, tag: str) -> DataFrame:
        aggs = [F.count("*").alias(f"{tag}_n")]
        for i, c in enumerate(names):
            data_type = df.schema[c].dataType
            number = to_number(quoted(c), data_type)
            aggs += [
                F.count(number).alias(f"{tag}_p{i}"),
                F.avg(number).alias(f"{tag}_m{i}"),
                _boolean_bits(null_if_nan(quoted(c), data_type), data_type).alias(f"{tag}_b{i}"),
            ]
        return df.agg(*aggs)

    both = side(reference, "ref").crossJoin(F.broadcast(side(current, "cur")))
    rows = []
    for i, c in enumerate(names):
        typed = "boolean" in (
            reference.schema[c].dataType.simpleString(), current.schema[c].dataType.simpleString()
        )
        bits = f"(coalesce(ref_b{i}, 0) | coalesce(cur_b{i}, 0))"
        boolean = f"({bits} > 0 AND {bits} & 1 = 0 AND bit_count({bits}) <= 2)"
        numeric = " AND ".join(
            f"coalesce({s}_p{i} / nullif({s}_n, 0), 0) >= {NUMERIC_SHARE}" for s in ("ref", "cur")
        )
        flag = "true" if typed else boolean
        rows.append(
            {
                "column": F.lit(c),
                "kind": F.expr(f"CASE WHEN NOT {flag} AND {numeric} THEN 'numeric' ELSE 'categorical' END"),
                "boolean_like": F.expr(flag),
                "reference_mean": rounded(F.col(f"ref_m{i}")),
                "current_mean": rounded(F.col(f"cur_m{i}")),
            }
        )
    return rows_from_one(both, rows)


def drift_kind(
    reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    return side_facts(reference, current, columns).select("column", "kind", "boolean_like")


def _psi_js(cells: DataFrame) -> DataFrame:
    """(column, psi, js_distance, uniques) from (column, label, value, ref, cur)."""
    totals = cells.groupBy("column").agg(
        F.sum("ref").alias("R"),
        F.sum("cur").alias("C"),
        F.count("*").alias("labels"),
        F.count_if(F.col("value").isNotNull() & (F.col("ref") > 0)).alias("reference_unique"),
        F.count_if(F.col("value").isNotNull() & (F.col("cur") > 0)).alias("current_unique"),
    )
    # One row per column.
    joined = cells.join(F.broadcast(totals), "column")
    p = smoothed_share(F.col("ref"), F.col("R"), F.col("labels"))
    q = smoothed_share(F.col("cur"), F.col("C"), F.col("labels"))
    summed = joined.groupBy("column", "R", "C", "reference_unique", "current_unique").agg(
        F.sum(psi_term(p, q)).alias("psi"), F.sum(js_term(p, q)).alias("js")
    )
    whole = (F.col("R") > 0) & (F.col("C") > 0)
    return summed.select(
        "column",
        F.when(whole, rounded(F.col("psi"))).alias("psi"),
        F.when(whole, rounded(F.sqrt(F.greatest(F.col("js"), F.lit(0.0))))).alias("js_distance"),
        "reference_unique",
        "current_unique",
    )


def psi_categorical(
    reference: DataFrame, current: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """PSI over labels, missing as a label of its own, and distinct counts."""
    return _categorical(reference, current, columns).drop("js_distance")


def js_distance(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _categorical(reference, current, columns).select("column", "js_distance")


def _categorical(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    label = F.coalesce("value", F.lit(DRIFT_MISSING_LABEL))
    return _psi_js(side_counts(reference, current, columns).withColumn("label", label))


def psi_numeric(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PSI over reference deciles; NULL with fewer than three distinct edges."""
    ref = numeric_long(reference, columns, strip_commas=False)
    cur = numeric_long(current, columns, strip_commas=False)
    return _psi_numeric_long(ref, cur)


# Inner edges only: the outer bins are open.  Repeated edges make no bin.
INNER_BIN = " + ".join(
    f"CAST(q[{i}] > q[0] AND q[{i}] < q[10] AND q[{i}] <= {{v}} AS INT)" for i in range(1, 10)
)


def _psi_numeric_long(ref: DataFrame, cur: DataFrame) -> DataFrame:
    edges = long_quantiles(ref, DECILES)
    both = ref.select("column", "value", F.lit(0).alias("s")).unionByName(
        cur.select("column", "value", F.lit(1).alias("s"))
    )
    return _psi_of_bins(
        both.join(F.broadcast(edges), "column")
        .groupBy("column", F.size(F.array_distinct("q")).alias("edges"), F.expr(INNER_BIN.format(v="value")).alias("bin"))
        .agg(F.count_if(F.col("s") == 0).alias("ref"), F.count_if(F.col("s") == 1).alias("cur"))
    )


def _psi_of_bins(cells: DataFrame) -> DataFrame:
    """(column, psi) from (column, edges, bin, ref, cur)."""
    # At most ten bins per column, so one column's bins fit one task.  Bins that
    # are empty on both sides are added in closed form.
    whole = Window.partitionBy("column")
    shares = cells.select(
        "column", "edges", "ref", "cur", F.sum("ref").over(whole).alias("R"),
        F.sum("cur").over(whole).alias("C"), (F.col("edges") - 1).alias("bins"),
        (F.col("edges") - 1 - F.count("*").over(whole)).alias("empty"),
    )
    p = smoothed_share(F.col("ref"), F.col("R"), F.col("bins"))
    q = smoothed_share(F.col("cur"), F.col("C"), F.col("bins"))
    p0 = smoothed_share(F.lit(0), F.col("R"), F.col("bins"))
    q0 = smoothed_share(F.lit(0), F.col("C"), F.col("bins"))
    summed = shares.groupBy("column", "edges", "R", "C").agg(
        (F.sum(psi_term(p, q)) + F.max(F.col("empty") * psi_term(p0, q0))).alias("psi")
    )
    usable = (F.col("edges") >= 3) & (F.col("R") > 0) & (F.col("C") > 0)
    return summed.select("column", F.when(usable, rounded(F.col("psi"))).alias("psi"))


def _numbers(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, number, ref, cur) per distinct number of both sides."""
    ref = numeric_long(reference, columns, strip_commas=False).withColumn("s", F.lit(0))
    cur = numeric_long(current, columns, strip_commas=False).withColumn("s", F.lit(1))
    return ref.unionByName(cur).groupBy("column", F.col("value").alias("number")).agg(
        F.count_if(F.col("s") == 0).alias("ref"), F.count_if(F.col("s") == 1).alias("cur")
    )


def _ks_from(numbers: DataFrame, pieces: int | None = None) -> DataFrame:
    summed = running_totals(
        numbers, "number", {"ref_to": F.col("ref"), "cur_to": F.col("cur")}, ["column"], pieces
    )
    totals = numbers.groupBy("column").agg(F.sum("ref").alias("R"), F.sum("cur").alias("C"))
    gap = F.abs(
        F.col("ref_to") / F.nullif(F.col("R"), F.lit(0))
        - F.col("cur_to") / F.nullif(F.col("C"), F.lit(0))
    )
    return (
        summed.join(F.broadcast(totals), "column")
        .groupBy("column")
        .agg(rounded(F.max(gap)).alias("ks_statistic"))
    )


def ks(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], pieces: int | None = None
) -> DataFrame:
    """Largest gap of the two distribution functions, over distinct values."""
    return _ks_from(cut_lineage(_numbers(reference, current, columns)), pieces)


def mean_shift(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    facts = side_facts(reference, current, columns)
    return facts.select("column", "reference_mean", "current_mean")


def drift_status(psi: Column) -> Column:
    return (
        F.when(psi.isNull(), "warning")
        .when(psi >= PSI_DRIFT, "drift")
        .when(psi >= PSI_WARNING, "warning")
        .otherwise("stable")
    )


def side_values(
    reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """(column, value, number, ref, cur): every distinct cell of both sides, from one scan of each.

    A number of one type on both sides stays a number (``value`` is NULL); all else is text,
    which is read as a number once per distinct text and side (``ref_number``, ``cur_number``).
    """
    names = list(columns or shared_columns(reference, current))
    kinds = {c: (reference.schema[c].dataType, current.schema[c].dataType) for c in names}
    plain = {c for c, (r, k) in kinds.items() if r == k and is_numeric_type(r)}

    def side(df: DataFrame, which: int) -> DataFrame:
        cells = [
            F.struct(
                (F.lit(None) if c in plain else null_if_nan(quoted(c), kinds[c][which]))
                .cast("string").alias("value"),
                (to_number(quoted(c), kinds[c][which]) if c in plain else F.lit(None)).cast("double").alias("number"),
            ).alias(c)
            for c in names
        ]
        long = spread(df.select(*[quoted(c) for c in names])).select(*cells)
        return long.unpivot([], [quoted(c) for c in names], "column", "cell").select(
            "column", "cell.value", "cell.number", F.lit(which).alias("_side")
        )

    counts = side(reference, 0).unionByName(side(current, 1)).groupBy("column", "value", "number").agg(
        F.count_if(F.col("_side") == 0).alias("ref"), F.count_if(F.col("_side") == 1).alias("cur")
    )
    read = [F.lit(None).cast("double")] * 2
    for which in (0, 1):
        for c in names:
            if c not in plain and not is_temporal_type(kinds[c][which]):
                boolean = isinstance(kinds[c][which], T.BooleanType)
                number = F.col("value").cast("boolean").cast("double") if boolean else to_number(F.col("value"))
                read[which] = F.when(F.col("column") == c, number).otherwise(read[which])
    return counts.select(
        "*", *[F.coalesce("number", r).alias(n) for n, r in zip(("ref_number", "cur_number"), read)]
    )


def _facts_of(values: DataFrame, reference: DataFrame, current: DataFrame) -> list[Row]:
    """One row per column: kind, flag and means, from the distinct cells."""
    aggs = []
    for side, df in (("ref", reference), ("cur", current)):
        kinds = {f.name: f.dataType for f in df.schema.fields}
        broken = [c for c, k in kinds.items() if is_floating_type(k) or is_temporal_type(k)]
        whole = F.coalesce("value", F.col("number").cast("decimal(38, 0)").cast("string"))
        token = F.lower(F.trim(whole))
        bit = F.array_position(F.array(*map(F.lit, DRIFT_BOOLEAN_TOKENS)), token)
        bits = F.when(F.col("column").isin(broken), F.lit(1)).otherwise(F.pow(F.lit(2), bit).cast("long"))
        present = (F.col(side) > 0) & F.coalesce("value", F.col("number").cast("string")).isNotNull()
        number = F.col(f"{side}_number")
        counted = F.sum(F.when(number.isNotNull(), F.col(side)))
        aggs += [
            F.sum(side).alias(f"{side}_n"), counted.alias(f"{side}_p"),
            rounded(F.sum(number * F.col(side)) / counted).alias(f"{side}_mean"),
            F.bit_or(F.when(present, bits)).alias(f"{side}_bits"),
        ]
    return values.groupBy("column").agg(*aggs).collect()


def _is_numeric(row: Row, reference: DataFrame, current: DataFrame) -> bool:
    types = [df.schema[row["column"]].dataType for df in (reference, current)]
    if any(isinstance(t, T.BooleanType) for t in types):
        return False
    bits = (row["ref_bits"] or 0) | (row["cur_bits"] or 0)
    if bits > 0 and bits & 1 == 0 and bits.bit_count() <= 2:
        return False
    return all(row[f"{s}_n"] and (row[f"{s}_p"] or 0) / row[f"{s}_n"] >= NUMERIC_SHARE for s in ("ref", "cur"))


def _numeric_drift(numbers: DataFrame) -> DataFrame:
    """(column, psi, ks_statistic): ranks, deciles and gaps all come from one running count."""
    totals = numbers.groupBy("column").agg(F.sum("ref").alias("R"), F.sum("cur").alias("C"))
    # One row per column.
    summed = running_totals(
        numbers, "number", {"ref_to": F.col("ref"), "cur_to": F.col("cur")}, ["column"]
    ).join(F.broadcast(totals), "column")
    share = [F.col(f"{s}_to") / F.nullif(F.col(n), F.lit(0)) for s, n in (("ref", "R"), ("cur", "C"))]
    picks = []
    for i, p in enumerate(DECILES):
        for end in ("floor", "ceil"):
            rank = f"{end}({p!r}D * (R - 1))"
            picks.append(F.expr(f"max(CASE WHEN ref_to - ref <= {rank} AND {rank} < ref_to THEN number END) AS _{end}{i}"))
    found = summed.groupBy("column", "R", "C").agg(rounded(F.max(F.abs(share[0] - share[1]))).alias("ks_statistic"), *picks)
    deciles = ", ".join(
        f"CASE WHEN {p!r}D * (R - 1) = floor({p!r}D * (R - 1)) THEN _floor{i} ELSE "
        f"_floor{i} + ({p!r}D * (R - 1) - floor({p!r}D * (R - 1))) * (_ceil{i} - _floor{i}) END"
        for i, p in enumerate(DECILES)
    )
    edges = cut_lineage(found.select("column", "ks_statistic", F.expr(f"array({deciles})").alias("q")))
    cells = (
        numbers.join(F.broadcast(edges), "column")
        .groupBy("column", F.size(F.array_distinct("q")).alias("edges"), F.expr(INNER_BIN.format(v="number")).alias("bin"))
        .agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    )
    return edges.select("column", "ks_statistic").join(F.broadcast(_psi_of_bins(cells)), "column", "left")


def column_drift(
    reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per shared column with the measures of its kind and a status.

    Each side is scanned once into distinct cells with their counts on both sides; kinds,
    means, deciles, running counts and label counts are all taken from those.
    """
    values = cut_lineage(side_values(reference, current, columns))
    facts = _facts_of(values, reference, current)
    spark = reference.sparkSession
    numeric = [r for r in facts if _is_numeric(r, reference, current)]
    names = [r["column"] for r in numeric]
    categorical = [r["column"] for r in facts if r["column"] not in names]
    schema = (
        "column string, kind string, psi double, status string, ks_statistic double, "
        "js_distance double, reference_mean double, current_mean double, "
        "reference_unique bigint, current_unique bigint"
    )
    parts = []
    if numeric:
        means = spark.createDataFrame(
            [(r["column"], r["ref_mean"], r["cur_mean"]) for r in numeric],
            "column string, reference_mean double, current_mean double",
        )
        sides = F.array(
            F.struct(F.col("ref_number").alias("number"), "ref", F.lit(0).cast("bigint").alias("cur")),
            F.struct(F.col("cur_number").alias("number"), F.lit(0).cast("bigint").alias("ref"), "cur"),
        )
        pairs = values.where(F.col("column").isin(names)).select("column", F.explode(sides).alias("s"))
        numbers = pairs.where(F.col("s.number").isNotNull()).groupBy("column", F.col("s.number").alias("number")).agg(
            F.sum("s.ref").alias("ref"), F.sum("s.cur").alias("cur")
        )
        found = _numeric_drift(cut_lineage(numbers.where("ref > 0 OR cur > 0")))
        parts.append(means.join(F.broadcast(found), "column", "left").withColumn("kind", F.lit("numeric")))
    if categorical:
        label = F.coalesce("value", F.col("number").cast("string"), F.lit(DRIFT_MISSING_LABEL))
        value = F.coalesce("value", F.col("number").cast("string"))
        cells = values.where(F.col("column").isin(categorical)).select("column", value.alias("value"), label.alias("label"), "ref", "cur")
        listed = spark.createDataFrame([(c,) for c in categorical], "column string")
        parts.append(listed.join(_psi_js(cells), "column", "left").withColumn("kind", F.lit("categorical")))
    if not parts:
        return spark.createDataFrame([], schema)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    result = result.withColumn("status", drift_status(F.col("psi")))
    fields = T._parse_datatype_string(schema).fields
    return result.select(
        *[
            (F.col(f.name) if f.name in result.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


def target_drift(reference: DataFrame, current: DataFrame, target: str) -> DataFrame:
    return column_drift(reference, current, [target])


def prediction_drift(scored_reference: DataFrame, scored_current: DataFrame, prediction: str) -> DataFrame:
    """Drift of the predictions of one model on both sides."""
    return column_drift(scored_reference, scored_current, [prediction])


def performance_drift(
    scored_reference: DataFrame, scored_current: DataFrame, task: str,
    actual: str = "actual", predicted: str = "predicted",
) -> DataFrame:
    """(metric, reference, current, delta) from one grouped pass over both sides."""
    both = scored_reference.select(F.lit("r").alias("_side"), actual, predicted).unionByName(
        scored_current.select(F.lit("c").alias("_side"), actual, predicted)
    )
    if task == "classification":
        wide, names = M.classification_metrics(both, actual, predicted, ["_side"]), ["accuracy", "f1_macro"]
    else:
        wide, names = M.regression_metrics(both, actual, predicted, ["_side"]), M.REGRESSION
    rows = M.metric_rows(wide, names, ["_side"])
    ref = F.max(F.when(F.col("_side") == "r", F.col("value")))
    cur = F.max(F.when(F.col("_side") == "c", F.col("value")))
    return rows.groupBy("metric").agg(
        ref.alias("reference"), cur.alias("current"), rounded(cur - ref).alias("delta")
    )


def drift_report(
    reference: DataFrame,
    current: DataFrame,
    target: str | None = None,
    predictions: DataFrame | None = None,
    performance: DataFrame | None = None,
    has_model: bool = False,
) -> DataFrame:
    """One row: overall status, counts by status, retrain score and action."""
    measured = target is not None and target in reference.columns and target in current.columns
    # Features and target in one pass over both sides; one row per column is kept.
    whole = cut_lineage(column_drift(reference, current))
    drift = whole.where(F.col("column") != F.lit(target)) if measured else whole
    signals = drift.agg(
        F.count_if(F.col("status") == "drift").alias("drifted"),
        F.count_if(F.col("status") == "warning").alias("warned"),
        F.array_join(
            F.array_sort(F.collect_list(F.when(F.col("status") == "drift", F.col("column")))), ","
        ).alias("drifted_columns"),
    )
    changed = schema_drift(reference, current, observed=True).agg(
        F.count_if(F.col("change") != "same").alias("schema_changes")
    )
    signals = signals.crossJoin(F.broadcast(changed))

    def status_of(df: DataFrame | None, name: str) -> DataFrame:
        if df is None:
            return reference.sparkSession.range(1).select(F.lit(None).cast("string").alias(name))
        return df.agg(F.first("status").alias(name))

    on_target = whole.where(F.col("column") == target) if measured else None
    signals = signals.crossJoin(F.broadcast(status_of(on_target, "target_status")))
    signals = signals.crossJoin(F.broadcast(status_of(predictions, "prediction_status")))
    if performance is None:
        worst = reference.sparkSession.range(1).select(F.lit(None).cast("double").alias("worst_delta"))
    else:
        worst = performance.agg(F.max(F.abs("delta")).alias("worst_delta"))
    signals = signals.crossJoin(F.broadcast(worst))

    moved = F.coalesce(F.col("worst_delta") >= METRIC_ALARM, F.lit(False))
    schema_moved = F.col("schema_changes") > 0

    def any_status(name: str) -> Column:
        return (
            F.coalesce(F.col("target_status") == name, F.lit(False))
            | F.coalesce(F.col("prediction_status") == name, F.lit(False))
        )

    status = (
        F.when(schema_moved | (F.col("drifted") > 0) | any_status("drift"), "drift")
        .when((F.col("warned") > 0) | any_status("warning") | moved, "warning")
        .otherwise("stable")
    )
    # Points of the retrain score.
    points = (
        F.when(schema_moved, 30).otherwise(0)
        + F.when(F.col("drifted") > 0, F.least(F.lit(35), 10 + 5 * F.col("drifted"))).otherwise(0)
        + F.least(F.lit(15), 3 * F.col("warned"))
        + F.when(F.col("prediction_status") == "drift", 20)
        .when(F.col("prediction_status") == "warning", 10)
        .otherwise(0)
        + F.when(moved, 25).otherwise(0)
    )
    score = F.least(F.lit(100), points).cast("int")
    if has_model:
        action = (
            F.when(score >= 50, "retrain_challenger").when(score >= 25, "review").otherwise("monitor")
        )
    else:
        action = F.lit("monitor")
    return signals.select(
        status.alias("status"),
        "schema_changes",
        "drifted",
        "warned",
        "drifted_columns",
        "target_status",
        "prediction_status",
        "worst_delta",
        score.alias("retrain_score"),
        action.alias("action"),
        ((score >= 50) & F.lit(has_model)).alias("retrain_recommended"),
    )


def append_report(report: DataFrame, path: str, dataset_id: str, report_id: str) -> None:
    """Keep a report row; the history is an append-only table."""
    report.select(
        F.lit(report_id).alias("report_id"),
        F.lit(dataset_id).alias("dataset_id"),
        F.current_timestamp().alias("created_at"),
        "*",
    ).write.mode("append").parquet(path)


def drift_history(
    reports: DataFrame, dataset_id: str | None = None, report_id: str | None = None
) -> DataFrame:
    """Reports newest first, by dataset or by id."""
    kept = reports
    if dataset_id is not None:
        kept = kept.where(F.col("dataset_id") == dataset_id)
    if report_id is not None:
        kept = kept.where(F.col("report_id") == report_id)
    return kept.orderBy(F.desc("created_at"), "report_id")
