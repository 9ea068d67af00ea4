"""Train/test splits and folds that depend on row keys only.

The same rows land on the same side whatever the partitioning, and a class that
holds most rows is still numbered by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.values import quoted
from tabloom.plans.ordering import hash_position

SEED = 42
SALTS = 32


def _group(df: DataFrame, label: str | None, least: int) -> DataFrame:
    """Stratify by label when every class has ``least`` rows, else one group."""
    if label is None:
        return df.withColumn("_g", F.lit("all"))
    counts = df.groupBy(quoted(label).cast("string").alias("_y")).agg(F.count("*").alias("_c"))
    smallest = counts.agg((F.min("_c") >= least).alias("_ok"))
    text = F.coalesce(quoted(label).cast("string"), F.lit(""))
    joined = df.crossJoin(F.broadcast(smallest))
    return joined.withColumn("_g", F.when(F.col("_ok"), text).otherwise("all")).drop("_ok")


def split(
    df: DataFrame,
    key: Sequence[str],
    label: str | None = None,
    test_size: float = 0.2,
    seed: int = SEED,
    cover_classes: bool = False,
) -> DataFrame:
    """Adds ``is_test``; per class the rounded share, at least one row each side.

    ``cover_classes`` enlarges an unstratified test side to the number of classes.
    """
    grouped = _group(df, label, 2)
    placed = hash_position(grouped, seed, key, ["_g"])
    sizes = placed.groupBy("_g").agg(F.count("*").alias("_n"))
    quota = F.greatest(F.lit(1), F.round(F.col("_n") * test_size).cast("long"))
    if cover_classes and label is not None:
        classes = df.agg(F.count_distinct(quoted(label)).alias("_k"))
        sizes = sizes.crossJoin(F.broadcast(classes))
        quota = F.when(F.col("_g") == "all", F.greatest(quota, F.col("_k"))).otherwise(quota)
    sizes = sizes.select("_g", F.least(quota, F.col("_n") - 1).alias("_q"))
    # A hot class is dealt out over many tasks; its one row of sizes is copied to each.
    salted = placed.withColumn("_salt", F.pmod("_pos", F.lit(SALTS)).cast("int"))
    copies = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["_g", "_salt"]).select(
        *[quoted(c) for c in df.columns], (F.col("_pos") < F.col("_q")).alias("is_test")
    )


def assign_folds(
    df: DataFrame, key: Sequence[str], k: int, label: str | None = None, seed: int = SEED
) -> DataFrame:
    """Adds ``fold`` in 0…k−1, balanced per class; k shrinks to the smallest class."""
    if label is None:
        return hash_position(df, seed, key).withColumn(
            "fold", F.pmod("_pos", F.lit(k)).cast("int")
        ).drop("_pos")
    text = F.coalesce(quoted(label).cast("string"), F.lit(""))
    grouped = df.withColumn("_g", text)
    smallest = grouped.groupBy("_g").count().agg(
        F.greatest(F.lit(2), F.least(F.lit(k), F.min("count"))).alias("_k")
    )
    placed = hash_position(grouped, seed, key, ["_g"]).crossJoin(F.broadcast(smallest))
    return placed.select(
        *[quoted(c) for c in df.columns], F.pmod("_pos", F.col("_k")).cast("int").alias("fold")
    )


def holdout(
    df: DataFrame,
    key: Sequence[str],
    saved_ids: DataFrame | None = None,
    label: str | None = None,
    test_size: float = 0.2,
    seed: int = SEED,
) -> DataFrame:
    """The saved holdout rows, or the test side of the deterministic split."""
    if saved_ids is not None:
        return df.join(saved_ids.select(*key), list(key), "left_semi")
    return split(df, key, label, test_size, seed).where("is_test").drop("is_test")
